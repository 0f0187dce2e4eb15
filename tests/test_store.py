import os
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom import store_queries
from ledgerloom.errors import CommitRejected, FailedPrecondition, InvalidRequest, NotFound
from ledgerloom.operators import compat, health
from ledgerloom.operators.commit import Change, _repeated, backfill_batches, choose_change
from ledgerloom.operators.ingest import build_artifacts
from ledgerloom.operators.reader import MAX_ROOTS
from ledgerloom.plans.stored import PACKING, StoredLedger
from ledgerloom.schema import SUBTREE_LEAVES, conform
from ledgerloom.sources.jobs import Sizes, sizes_below
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming import events as log
from tests.chain import Chain, block_hash, epoch_row
from tests.measure import moved_mb
from tests.oracle import DATA


@pytest.fixture(scope="module")
def chain(spark):
    return Chain(spark)


@pytest.fixture()
def store(spark, tmp_path):
    return LedgerStore(spark, f"file://{tmp_path}/store", 3, create=True)


def test_snapshot_stays_pinned_across_append_and_replace(chain, store):
    store.commit(epoch_row(1, 3), Change("extend"), chain.blocks(1, 3))
    pinned = store.reader()
    store.commit(epoch_row(2, 4), Change("extend"), chain.blocks(4, 4))
    assert pinned.latest_block()["height"] == 3 and {r["height"] for r in pinned.visible().collect()} == {1, 2, 3}
    store.commit(epoch_row(3, 4, branch=1), Change("replace", 3), chain.blocks(3, 4, branch=1, base=0))
    new = store.reader()
    assert [r["block_hash"] for r in new.visible().orderBy("height").collect()] == [block_hash(1), block_hash(2), block_hash(3, 1), block_hash(4, 1)]
    old = store.reader(pinned.pin)
    assert [r["block_hash"] for r in old.visible().orderBy("height").collect()] == [block_hash(1), block_hash(2), block_hash(3)]
    events = [(r["sequence"], r["event_kind"], r["start_height"], r["end_height"], r["reverted_epoch"], r["reverted_end"]) for r in store.tables()["chain_event"].orderBy("sequence").collect()]
    assert events == [(1, "committed", 1, 3, None, None), (2, "committed", 4, 4, None, None), (3, "reorged", 3, 4, 2, 4)]


def test_pins_must_match(chain, store):
    with pytest.raises(FailedPrecondition):
        store.reader()
    store.commit(epoch_row(1, 2), Change("extend"), chain.blocks(1, 2))
    with pytest.raises(FailedPrecondition):
        store.reader(7)
    with pytest.raises(FailedPrecondition):
        store.reader(Row(**(store.current().asDict() | {"tip_height": 9})))


def test_a_remined_outpoint_is_read_from_the_new_branch(chain, store):
    first = chain.blocks(1, 2) | {"utxo": chain.table("utxo", [chain.output("0a", 0, 50_000, 2)])}
    store.commit(epoch_row(1, 2), Change("extend"), first)
    second = chain.blocks(2, 2, branch=1, base=0) | {"utxo": chain.table("utxo", [chain.output("0a", 0, 75_000, 2, branch=1)])}
    store.commit(epoch_row(2, 2, branch=1), Change("replace", 2), second)
    assert [r["value_zat"] for r in store.reader().unspent_outputs().collect()] == [75_000]
    assert [r["value_zat"] for r in store.reader(1).unspent_outputs().collect()] == [50_000]


def test_spends_count_only_on_the_visible_branch(chain, store):
    made = chain.blocks(1, 2) | {"utxo": chain.table("utxo", [chain.output("0a", 0, 5, 1), chain.output("0b", 1, 7, 2)]), "utxo_spend": chain.table("utxo_spend", [chain.spend("0a", 0, 2)])}
    store.commit(epoch_row(1, 2), Change("extend"), made)
    assert [r["value_zat"] for r in store.reader().unspent_outputs().collect()] == [7]
    store.commit(epoch_row(2, 2, branch=1), Change("replace", 2), chain.blocks(2, 2, branch=1, base=0))
    assert [r["value_zat"] for r in store.reader().unspent_outputs().collect()] == [5]
    assert store.reader().balances().first()["balance_zat"] == 5


def test_missing_none_and_error(chain, store):
    store.commit(epoch_row(1, 3), Change("extend"), chain.blocks(1, 3))
    reader = store.reader()
    assert reader.block(9).isEmpty() and reader.transaction("ff" * 32).isEmpty() and reader.subtree_roots(1, 0).isEmpty()
    assert reader.status("ff" * 32) == "NotFound"
    assert [r["height"] for r in reader.compact_blocks(1, 3).collect()] == [1, 2, 3]
    assert [r["height"] for r in reader.descending_blocks(3, 1).collect()] == [3, 2, 1]
    for wrong in ((3, 1), (1, 2000)):
        with pytest.raises(InvalidRequest):
            reader.compact_blocks(*wrong)
    with pytest.raises(InvalidRequest):
        reader.compact_blocks(1, 2, pools=["silver"])
    with pytest.raises(NotFound):
        reader.compact_blocks(1, 5)
    with pytest.raises(NotFound):
        reader.tree_state(2)
    with pytest.raises(InvalidRequest):
        reader.subtree_roots(1, 0, 0)


def test_reverted_artifacts_are_hidden(chain, store):
    def of(branch):
        own = dict(height=2, block_hash=block_hash(2, branch))
        return {"transaction": chain.table("transaction", [dict(txid=f"0{branch}" * 32, payload=b"x", **own)]), "tree_state": chain.table("tree_state", [dict(payload="{}", **own)]), "subtree_root": chain.table("subtree_root", [dict(protocol=1, subtree_index=0, root_hash=f"{branch}0" * 32, **own)])}

    tree = dict(sapling_tree_size=65536)
    store.commit(epoch_row(1, 2, **tree), Change("extend"), chain.blocks(1, 2) | of(0))
    store.commit(epoch_row(2, 2, branch=1, **tree), Change("replace", 2), chain.blocks(2, 2, branch=1, base=0) | of(1))
    reader = store.reader()
    assert reader.transaction("00" * 32).isEmpty() and reader.status("01" * 32) == "Mined"
    assert reader.latest_tree_state().first()["block_hash"] == block_hash(2, 1)
    assert reader.subtree_roots(1, 0).first()["root_hash"] == "10" * 32


RULES = [
    ("epoch_order", lambda c: (epoch_row(1, 4), Change("extend"), c.blocks(4, 4))),
    ("finalized", lambda c: (epoch_row(2, 4, finalized=5), Change("extend"), c.blocks(4, 4))),
    ("artifacts", lambda c: (epoch_row(2, 4), Change("extend"), {"block": c.blocks(4, 4)["block"]})),
    ("artifacts", lambda c: (epoch_row(2, 3), Change("finalize"), c.blocks(4, 4))),
    ("tip_hash", lambda c: (epoch_row(2, 4, branch=5), Change("extend"), c.blocks(4, 4))),
    ("coverage", lambda c: (epoch_row(2, 5), Change("extend"), c.blocks(5, 5))),
    ("tip", lambda c: (epoch_row(2, 3, branch=1), Change("finalize"), {})),
    ("parent_link", lambda c: (epoch_row(2, 4), Change("extend"), c.blocks(4, 4, base=7))),
    ("reorg_window", lambda c: (epoch_row(2, 3, branch=1), Change("replace", 0), c.blocks(1, 3, branch=1))),
    ("replace", lambda c: (epoch_row(2, 5, branch=1), Change("replace", 4), c.blocks(4, 5, branch=1))),
    ("conflict", lambda c: (epoch_row(2, 4), Change("extend"), {k: v.unionByName(c.blocks(4, 4, branch=2)[k]) for k, v in c.blocks(4, 4).items()})),
    ("block_match", lambda c: (epoch_row(2, 4), Change("extend"), c.blocks(4, 4) | {"utxo": c.table("utxo", [c.output("0a", 0, 1, 4, branch=9)])})),
    ("height", lambda c: (epoch_row(2, 4), Change("extend"), c.blocks(4, 4) | {"utxo": c.table("utxo", [c.output("0a", 0, 1, 6)])})),
    ("unique", lambda c: (epoch_row(2, 4), Change("extend"), c.blocks(4, 4) | {"utxo_spend": c.table("utxo_spend", [c.spend("0a", 0, 4)] * 2)})),
    ("finalized_hash", lambda c: (epoch_row(2, 4, finalized=2, finalized_hash="00" * 32), Change("extend"), c.blocks(4, 4))),
    ("tip", lambda c: (epoch_row(2, 7, finalized=2), Change("finalize"), {})),
    ("finalized_hash", lambda c: (epoch_row(2, 3, finalized=2, finalized_hash="ff" * 32), Change("finalize"), {})),
    ("finalized", lambda c: (epoch_row(2, 3), Change("finalize"), {})),
    ("network", lambda c: (epoch_row(2, 4, network=1), Change("extend"), c.blocks(4, 4))),
]


@pytest.mark.parametrize("rule,make", RULES, ids=[f"{k}-{r[0]}" for k, r in enumerate(RULES)])
def test_broken_rules_reject_a_commit(spark, chain, rule, make, broken_store):
    new, change, artifacts = make(chain)
    with pytest.raises(CommitRejected) as told:
        broken_store.commit(new, change, artifacts)
    assert told.value.rule == rule
    assert broken_store.current()["epoch"] == 1


@pytest.fixture(scope="module")
def broken_store(spark, chain, tmp_path_factory):
    store = LedgerStore(spark, f"file://{tmp_path_factory.mktemp('rules')}/store", 3, create=True)
    store.commit(epoch_row(1, 3), Change("extend"), chain.blocks(1, 3))
    return store


def test_bootstrap_finalize_and_checkpoint(spark, chain, store, tmp_path):
    store.commit(epoch_row(1, 10, finalized=10), Change("finalize"), {})
    store.commit(epoch_row(2, 12, finalized=10), Change("extend"), chain.blocks(11, 12))
    store.finalize(12, block_hash(12), 1)
    last = store.tables()["chain_event"].orderBy(F.desc("sequence")).first()
    assert (last["start_height"], last["end_height"], last["finalized_height"]) == (12, 12, 12)
    store.checkpoint(f"file://{tmp_path}/copy")
    copy = LedgerStore(spark, f"file://{tmp_path}/copy", 3)
    assert copy.epochs() == [1, 2, 3] and copy.reader().visible().count() == 2
    assert store.catch_up(1) == (1, 3)
    with pytest.raises(FailedPrecondition):
        LedgerStore(spark, f"file://{tmp_path}/copy", 1)


def test_an_unpublished_commit_is_not_seen(chain, store, monkeypatch):
    """A writer that dies between staging and publishing leaves nothing behind that a reader sees."""
    store.commit(epoch_row(1, 2), Change("extend"), chain.blocks(1, 2))

    def dies(name, content):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "_create", dies)
    with pytest.raises(RuntimeError):
        store.commit(epoch_row(2, 3), Change("extend"), chain.blocks(3, 3))
    monkeypatch.undo()
    assert store.reader().latest_block()["height"] == 2 and store.reader().visible().count() == 2
    store.commit(epoch_row(2, 3), Change("extend"), chain.blocks(3, 3))
    assert store.reader().visible().count() == 3


def test_only_one_writer_publishes_an_epoch(spark, chain, store):
    other = LedgerStore(spark, store.path, 3)
    store.commit(epoch_row(1, 2), Change("extend"), chain.blocks(1, 2))
    with pytest.raises(CommitRejected):
        other._create("epochs/00000000000000000001.json", {})


def test_history_pages_cursors_andretention(spark, chain, store):
    for k in range(1, 5):
        store.commit(epoch_row(k, k, finalized=k if k % 2 else k - 1), Change("extend"), chain.blocks(k, k))
    events = store.tables()["chain_event"]
    page = log.history(events, store.cursor_key, 3, max_events=2).collect()
    assert [r["sequence"] for r in page] == [1, 2]
    rest = log.history(events, store.cursor_key, 3, token=bytes(page[-1]["cursor"])).collect()
    assert [r["sequence"] for r in rest] == [3, 4]
    assert [r["sequence"] for r in log.history(events, store.cursor_key, 3, family="finalized").collect()] == [1, 3]
    token = bytearray(page[-1]["cursor"])
    token[20] ^= 1
    with pytest.raises(InvalidRequest):
        log.history(events, store.cursor_key, 3, token=bytes(token))
    with pytest.raises(InvalidRequest):
        log.history(events, b"another key", 3, token=bytes(page[-1]["cursor"]))
    with pytest.raises(FailedPrecondition):
        log.history(events, store.cursor_key, 3, token=bytes(page[0]["cursor"]), floor=3)
    assert log.retention_floor(events, 1_774_668_500_003).first()[0] == 3
    assert log.retention_floor(events, 1 << 60).first()[0] == 4


def test_pruning_keeps_a_floor(spark, chain, store):
    for k in range(1, 5):
        store.commit(epoch_row(k, k), Change("extend"), chain.blocks(k, k))
    token = bytes(store.history(max_events=1).first()["cursor"])
    assert store.prune(1_774_668_500_003) == 3 and store.prune(0) == 3
    assert [r["sequence"] for r in store.history().collect()] == [3, 4]
    with pytest.raises(FailedPrecondition):
        store.history(token)
    assert store.reader().visible().count() == 4  # rows stay
    assert store.prune(1 << 60) == 4 and LedgerStore(spark, store.path, 3).floor() == 4


def test_a_rejected_commit_leaves_no_rows(spark, chain, store):
    store.commit(epoch_row(1, 2), Change("extend"), chain.blocks(1, 2))
    with pytest.raises(CommitRejected):
        store.commit(epoch_row(2, 9), Change("extend"), chain.blocks(3, 3))
    assert spark.read.parquet(f"{store.path}/block").count() == 2 and store.epochs() == [1]


def test_choosing_a_change():
    tip = epoch_row(5, 50)
    assert choose_change(tip, 51, block_hash(50)).kind == "extend"
    assert choose_change(tip, 49, "xx") == Change("replace", 49)
    with pytest.raises(CommitRejected):
        choose_change(tip, 2, "xx", window=10)
    assert backfill_batches(1, 2500, 9000) == [(1, 1000), (1001, 2000), (2001, 2500)]
    with pytest.raises(FailedPrecondition):
        backfill_batches(1, 8999, 9000)


def test_filling_a_store_shuffles_keys_and_not_digests(spark):
    before = moved_mb(spark)
    StoredLedger(spark, f"{DATA}/sf0.01/.").store()  # a source of its own, so that it is filled here
    assert moved_mb(spark) - before < 70  # 60,000 line items; keys, numbers and the store's own files


def test_a_key_that_repeats_is_found_behind_its_hash(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("a", 1)], "txid STRING, output_index BIGINT")
    assert [tuple(r)[:2] for r in _repeated(rows, ["txid", "output_index"]).collect()] == [("a", 1)]
    assert _repeated(rows.distinct(), ["txid", "output_index"]).isEmpty()


def test_compact_blocks_of_a_store_are_not_shuffled(spark):
    reader = StoredLedger(spark, f"{DATA}/sf0.001").store().reader()
    rows = reader.compact_blocks(1, reader.tip, cap=None, ordered=False)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert not any("vtx" in line for line in shuffles) and "max_by(struct(epoch, epoch#0L, block_hash, block_hash#0, vtx" not in plan
    assert not any("vtx" in line for line in plan.splitlines() if "Aggregate" in line)


def test_the_fill_shuffles_line_items_once_and_only_those_of_its_branch(spark):
    ledger = StoredLedger(spark, f"{DATA}/sf0.01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ledger.keyed(0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 7
    before = moved_mb(spark)
    ledger.keyed(1).write.format("noop").mode("overwrite").save()
    assert moved_mb(spark) - before < 0.5  # of 60,000 line items those of five blocks


def test_a_filled_store_takes_no_more_than_its_input(spark, tmp_path):
    """Keys and numbers are shuffled, written and kept; digests, ten times the input, are made where they are read."""
    before = moved_mb(spark)
    store = StoredLedger(spark, f"{DATA}/sf0.01/./././.").store()  # a source of its own, so that it is filled here
    files = lambda top: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names)
    assert moved_mb(spark) - before < 8
    assert files(store.path.removeprefix("file://")) < sum(os.path.getsize(f"{DATA}/sf0.01/{t}.parquet") for t in ("orders", "lineitem"))
    assert {r["family"]: r["n_rows"] for r in health.counts(store).collect()}["utxo"] > 60_000


def test_packed_families_are_those_that_the_ingest_builds(spark):
    ledger = StoredLedger(spark, f"{DATA}/sf0.001")
    built = build_artifacts(ledger.parsed(0))
    packed = ledger.packed(0).withColumn("epoch", F.lit(0).cast("bigint"))
    for family, make in PACKING.families.items():
        one, other = conform(built[family], family), conform(make(packed), family)
        assert one.count() == other.count() > 0 and one.exceptAll(other).isEmpty()


def test_packed_rows_are_checked_and_read_as_their_families(spark, chain, tmp_path):
    item = lambda n: (n, 7, n % 2 == 0, True, False, 100 + n)

    def packed(height, *keys):
        return spark.createDataFrame([(1, height, block_hash(height), [(k, [item(0), item(1)], None) for k in keys])], PACKING.columns)

    store = LedgerStore(spark, f"file://{tmp_path}/store", 3, create=True, packing=PACKING)
    block = lambda h: {"block": chain.blocks(h, h)["block"]}
    for rule, rows in (("unique", packed(1, 5, 5)), ("height", packed(2, 5)), ("artifacts", packed(1, 5).limit(0))):
        with pytest.raises(CommitRejected) as told:
            store.commit(epoch_row(1, 1), Change("extend"), block(1) | {"packed": rows})
        assert told.value.rule == rule
    store.commit(epoch_row(1, 1), Change("extend"), block(1) | {"packed": packed(1, 5, 6)})
    store.commit(epoch_row(2, 2), Change("extend"), chain.blocks(2, 2))
    store.checkpoint(f"file://{tmp_path}/copy")
    for kept in (store, LedgerStore(spark, f"file://{tmp_path}/copy", 3, packing=PACKING)):
        tables = kept.tables()
        assert [tables[f].count() for f in ("block", "compact_block", "transaction", "utxo")] == [2, 2, 2, 4]
        assert [tuple(r) for r in kept.additions().orderBy("height").collect()] == [(1, 1, 2, 2), (2, 2, 0, 0)]
        assert kept.reader(1).unspent_outputs().count() == 4
    with pytest.raises(FailedPrecondition):
        LedgerStore(spark, store.path, 3).tables()


def test_a_store_without_blocks_adds_no_notes(store):
    store.commit(epoch_row(1, 10, finalized=10), Change("finalize"), {})
    assert store.additions().isEmpty() and sizes_below(store, 5, Sizes(3, 4)) == Sizes(3, 4)


def test_the_query_of_subtree_roots_has_more_than_a_reply_holds(chain, store):
    n = {1: MAX_ROOTS + 5, 2: 2 * MAX_ROOTS + 1}
    of = lambda p, k: dict(protocol=p, subtree_index=k, root_hash=f"{p}{k:063x}", height=1 + k % 2, block_hash=block_hash(1 + k % 2))
    roots = chain.table("subtree_root", [of(p, k) for p in n for k in range(n[p])])
    sizes = dict(sapling_tree_size=n[1] * SUBTREE_LEAVES, orchard_tree_size=n[2] * SUBTREE_LEAVES + 7)
    store.commit(epoch_row(1, 2, **sizes), Change("extend"), chain.blocks(1, 2) | {"subtree_root": roots})
    got = store_queries.store_subtree_roots(SimpleNamespace(store=lambda: store)).collect()
    assert sorted((r["protocol"], r["root_hash"], r["completing_block_height"]) for r in got) == [(p, f"{p}{k:063x}", 1 + k % 2) for p in n for k in range(n[p])]
    reader = store.reader()
    assert [compat.subtree_roots(reader, p, 0).count() for p in n] == [MAX_ROOTS, MAX_ROOTS]  # the reply stays a page
    assert compat.subtree_roots(reader, 1, MAX_ROOTS).count() == 5 and reader.subtree_roots(1, n[1], None).isEmpty()
    with pytest.raises(InvalidRequest):
        reader.subtree_roots(1, -1, None)


def test_a_missing_root_fails_the_whole_read(chain, store):
    roots = chain.table("subtree_root", [dict(protocol=1, subtree_index=k, root_hash=f"{k:064x}", height=1, block_hash=block_hash(1)) for k in (0, 2)])
    store.commit(epoch_row(1, 1, sapling_tree_size=3 * SUBTREE_LEAVES), Change("extend"), chain.blocks(1, 1) | {"subtree_root": roots})
    with pytest.raises(NotFound):
        store.reader().subtree_roots(1, 0, None)
