"""Queries that read a store through its readers, logs and replies, each with its DuckDB oracle.

The store is filled from the order tables by the ingest jobs (``plans.stored``), once for each application. The last
section's queries run commits and jobs on small made-up chains; their oracles list what the rules say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import CommitRejected
from ledgerloom.functions import compact, scalars
from ledgerloom.operators import compat, health
from ledgerloom.operators.commit import Change, check_commit
from ledgerloom.plans.projection import digest
from ledgerloom.plans.stored import BELOW, CREATED, STORED_SQL, StoredLedger, script_of
from ledgerloom.schema import SUBTREE_LEAVES, ddl, schema
from ledgerloom.streaming import events as log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, stored: bool = True):
    """Registers a function of (StoredLedger) or, with ``stored`` false, of (spark, sf_dir)."""

    def register(function):
        name = function.__name__
        QUERIES[name] = (lambda spark, sf_dir: function(StoredLedger(spark, sf_dir))) if stored else function
        ORACLES[name] = STORED_SQL + sql if stored else sql
        return function

    return register


# epochs and snapshots

_WHOLE = f"(SELECT CAST({{}} + count(*) AS BIGINT) FROM items JOIN orders ON o_orderkey = key WHERE {{}} orchard)"


@query(f""", tips AS (SELECT 1 AS epoch, size AS tip, 0 AS branch, size AS final FROM lim UNION ALL SELECT 2, half, 0, half FROM lim UNION ALL SELECT 3, t, 0, half FROM lim
  UNION ALL SELECT 4, t - 1, 1, half FROM lim UNION ALL SELECT 5, t - 1, 1, fork - 1 FROM lim)
SELECT CAST(epoch AS BIGINT) AS epoch, CAST(tip AS BIGINT) AS tip_height, sha256('b:' || tip || ':' || branch) AS tip_hash, CAST(final AS BIGINT) AS finalized_height, sha256('b:' || final || ':0') AS finalized_hash,
  CASE WHEN epoch = 3 THEN {_WHOLE.format(BELOW.sapling, 'NOT')} ELSE s.sapling END AS sapling_tree_size, CASE WHEN epoch = 3 THEN {_WHOLE.format(BELOW.orchard, '')} ELSE s.orchard END AS orchard_tree_size
FROM tips LEFT JOIN sizes s ON s.height = tip""")
def store_epochs(led: StoredLedger) -> DataFrame:
    return led.store().tables()["chain_epoch"].select("epoch", "tip_height", "tip_hash", "finalized_height", "finalized_hash", "sapling_tree_size", "orchard_tree_size")


@query("""SELECT CAST(2 AS BIGINT) AS pinned, height, block_hash, parent_hash FROM blocks WHERE epoch <= 2 UNION ALL SELECT 3, height, block_hash, parent_hash FROM blocks WHERE epoch <= 3
UNION ALL SELECT 5, height, block_hash, parent_hash FROM seen""")
def store_snapshots(led: StoredLedger) -> DataFrame:
    """What readers see that are pinned before, at and after the replaced tip."""
    store, out = led.store(), None
    for epoch in (2, 3, None):
        reader = store.reader(epoch)
        own = reader.visible().select(F.lit(reader.epoch).cast("bigint").alias("pinned"), "height", "block_hash", "parent_hash")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT height, block_hash, parent_hash, 'raw:' || height || ':0' AS said FROM (SELECT * FROM seen, lim WHERE height = half + 1)")
def store_block_at(led: StoredLedger) -> DataFrame:
    height = led.top // 2 + 1
    said = F.concat_ws(":", F.lit("raw"), F.col("height").cast("string"), F.lit("0"))
    return led.store().reader().block(height).where(F.unhex(F.sha2(said, 256)) == F.col("payload")).select("height", "block_hash", "parent_hash", said.alias("said"))


@query("SELECT height, block_hash FROM seen ORDER BY height DESC LIMIT 1")
def store_latest_block(led: StoredLedger) -> DataFrame:
    tip = led.store().reader().latest_block()
    return led.spark.createDataFrame([(tip["height"], tip["block_hash"])], "height BIGINT, block_hash STRING")


# compact blocks

_HELD = """, held AS (SELECT height, txid, ordinal, count(*) FILTER (WHERE flag = 'A') AS spends, count(*) FILTER (WHERE NOT orchard) AS outputs, count(*) FILTER (WHERE orchard) AS actions, count(*) AS vout FROM notes GROUP BY ALL),
ins AS (SELECT height, by_txid AS txid, count(*) AS vin FROM inputs GROUP BY ALL),
ctx AS (SELECT t.height, t.txid, t.ordinal, coalesce(spends, 0) AS spends, coalesce(outputs, 0) AS outputs, coalesce(actions, 0) AS actions, coalesce(vout, 0) AS vout, coalesce(vin, 0) AS vin
  FROM txs t LEFT JOIN held h USING (height, txid) LEFT JOIN ins i USING (height, txid) WHERE h.txid IS NOT NULL OR i.txid IS NOT NULL)
"""


def _sizes(vtx: str = "vtx") -> list:
    total = lambda name: F.aggregate(vtx, F.lit(0).cast("bigint"), lambda n, tx: n + F.size(tx[name]))
    return [F.size(vtx).cast("bigint").alias("n_txs"), *[total(n).alias(f"n_{n.lower()}") for n in ("spends", "outputs", "actions", "vin", "vout")]]


@query(_HELD + """SELECT s.height, count(c.txid) AS n_txs, coalesce(sum(spends), 0)::BIGINT AS n_spends, coalesce(sum(outputs), 0)::BIGINT AS n_outputs, coalesce(sum(actions), 0)::BIGINT AS n_actions,
  coalesce(sum(vin), 0)::BIGINT AS n_vin, coalesce(sum(vout), 0)::BIGINT AS n_vout, true AS cut FROM seen s LEFT JOIN ctx c USING (height) GROUP BY s.height""")
def store_compact_blocks(led: StoredLedger) -> DataFrame:
    """All compact blocks of the newest snapshot: what they hold, and whether each ciphertext is cut to its prefix."""
    reader = led.store().reader()
    cut = F.forall("vtx", lambda tx: F.forall(tx["outputs"], lambda o: F.octet_length(o["ciphertext"]) == scalars.CIPHERTEXT_BYTES) & F.forall(tx["actions"], lambda a: F.octet_length(a["ciphertext"]) == scalars.CIPHERTEXT_BYTES))
    return reader.compact_blocks(1, reader.tip, cap=None, ordered=False).select("height", *_sizes(), cut.alias("cut"))


@query(_HELD + """, pools AS (SELECT unnest(['transparent', 'sapling', 'orchard']) AS pool)
SELECT s.height, pool, count(c.txid) AS n_txs, coalesce(sum(spends) FILTER (WHERE pool = 'sapling'), 0)::BIGINT AS n_spends, coalesce(sum(outputs) FILTER (WHERE pool = 'sapling'), 0)::BIGINT AS n_outputs,
  coalesce(sum(actions) FILTER (WHERE pool = 'orchard'), 0)::BIGINT AS n_actions, coalesce(sum(vin) FILTER (WHERE pool = 'transparent'), 0)::BIGINT AS n_vin, coalesce(sum(vout) FILTER (WHERE pool = 'transparent'), 0)::BIGINT AS n_vout
FROM seen s CROSS JOIN pools LEFT JOIN ctx c ON c.height = s.height AND CASE pool WHEN 'transparent' THEN vin + vout > 0 WHEN 'sapling' THEN spends + outputs > 0 ELSE actions > 0 END GROUP BY s.height, pool""")
def store_pool_blocks(led: StoredLedger) -> DataFrame:
    """The compact blocks as each pool's selection leaves them."""
    reader, out = led.store().reader(), None
    for pool in compact.POOLS:
        own = reader.compact_blocks(1, reader.tip, pools=[pool], cap=None, ordered=False).select("height", F.lit(pool).alias("pool"), *_sizes())
        out = own if out is None else out.unionByName(own)
    return out


@query(_HELD + """, nulls AS (SELECT height, CASE WHEN orchard THEN sha256('f:' || key || ':' || n) END AS f, CASE WHEN flag = 'A' THEN sha256('s:' || key || ':' || n) END AS s FROM notes)
SELECT s.height, (SELECT count(*) FROM ctx c WHERE c.height = s.height AND spends + actions > 0) AS n_txs, count(n.s) AS n_spends, count(n.f) AS n_actions, min(n.s) AS first_spend, min(n.f) AS first_action, true AS blank
FROM seen s LEFT JOIN nulls n USING (height) GROUP BY s.height""")
def store_nullifier_blocks(led: StoredLedger) -> DataFrame:
    """Nullifiers alone: what is left of each compact block, and whether all else of an action is blank."""
    reader = led.store().reader()
    rows = reader.compact_blocks(1, reader.tip, nullifiers_only=True, cap=None, ordered=False)
    blank = F.forall("vtx", lambda tx: (F.size(tx["outputs"]) + F.size(tx["vin"]) + F.size(tx["vout"]) == 0) & F.forall(tx["actions"], lambda a: (a["cmx"] == "") & (a["ephemeralKey"] == "") & (F.octet_length(a["ciphertext"]) == 0)))
    total = lambda name: F.aggregate("vtx", F.lit(0).cast("bigint"), lambda n, tx: n + F.size(tx[name]))
    least = lambda name, of: F.array_min(F.flatten(F.transform("vtx", lambda tx: of(tx[name]))))
    return rows.select(
        "height", F.size("vtx").cast("bigint").alias("n_txs"), total("spends").alias("n_spends"), total("actions").alias("n_actions"),
        least("spends", lambda x: x).alias("first_spend"), least("actions", lambda x: x["nullifier"]).alias("first_action"), blank.alias("blank"),
    )


@query(_HELD + "SELECT height, ordinal::BIGINT AS tx_index, txid FROM ctx")
def store_transaction_index(led: StoredLedger) -> DataFrame:
    """Every visible transaction by height and index."""
    return led.store().reader().positions()


@query(_HELD + "SELECT height, txid, 'Mined' AS status FROM ctx, lim WHERE height = half AND ordinal = (SELECT min(ordinal) FROM ctx, lim WHERE height = half AND ordinal > 0)")
def store_transaction_at(led: StoredLedger) -> DataFrame:
    """A transaction by height and index, then by its id."""
    reader, height = led.store().reader(), led.top // 2
    index = compact_index(reader, height)
    found = reader.transaction_at(height, index)
    txid = found.select("txid").first()
    return found.select("height", "txid", F.lit(reader.status(txid["txid"]) if txid else "NotFound").alias("status"))


def compact_index(reader, height: int) -> int:
    """The second index that the block uses."""
    vtx = reader.compact_block(height).select(F.explode("vtx").alias("tx")).where("tx.index > 0")
    return vtx.agg(F.coalesce(F.min("tx.index"), F.lit(0))).first()[0]


# tree states and subtree roots

_STATES = """SELECT 'zcash-regtest' AS network, height, (SELECT string_agg(substr(block_hash, 63 - 2 * k, 2), '' ORDER BY k) FROM (SELECT unnest(range(0, 32)) AS k)) AS hash, 1700000000 + height AS time,
  sha256('sapling:' || height) AS sapling_tree, sha256('orchard:' || height) AS orchard_tree FROM sizes"""


@query(_STATES)
def store_tree_states(led: StoredLedger) -> DataFrame:
    reader = led.store().reader()
    return compat.shown_tree_states(reader.tree_states(1, reader.tip), reader.pin["network"])


@query(_STATES + " WHERE height = (SELECT max(height) FROM sizes)")
def store_latest_tree_state(led: StoredLedger) -> DataFrame:
    return compat.tree_state(led.store().reader())


@query("SELECT height, sapling, orchard FROM sizes")
def store_observed_sizes(led: StoredLedger) -> DataFrame:
    """The tree sizes that the node reported, read from its documents."""
    reader = led.store().reader()
    return reader.tree_states(1, reader.tip).select("height", *[scalars.observed_size(F.col("payload"), p).alias(p) for p in ("sapling", "orchard")])


@query(f""", pools AS (SELECT 1 AS protocol, height, block_hash, sapling AS n FROM sizes UNION ALL SELECT 2, height, block_hash, orchard FROM sizes),
steps AS (SELECT *, n // {SUBTREE_LEAVES} AS done, lag(n // {SUBTREE_LEAVES}, 1, 0) OVER (PARTITION BY protocol ORDER BY height) AS had FROM pools)
SELECT protocol, sha256('r:' || protocol || ':' || (done - 1)) AS root_hash, block_hash AS completing_block_hash, height AS completing_block_height FROM steps WHERE done > had""")
def store_subtree_roots(led: StoredLedger) -> DataFrame:
    """All completed roots of both pools, where a reply holds one page."""
    reader = led.store().reader()
    whole = lambda p: compat.shown_subtree_roots(reader.subtree_roots(p, 0, None)).withColumn("protocol", F.lit(p))
    return whole(1).unionByName(whole(2))


# outputs of addresses

_LEFT = """, left_over AS (SELECT n.txid, n.n::BIGINT AS output_index, n.address, sha256(unhex('76a9' || lpad(hex(n.address), 16, '0'))) AS script_hash, n.value_zat, n.height FROM notes n
  WHERE NOT EXISTS (SELECT 1 FROM inputs i WHERE i.txid = n.txid AND i.n = n.n))
"""


@query(_LEFT + "SELECT txid, output_index, script_hash, value_zat, height FROM left_over")
def store_unspent(led: StoredLedger) -> DataFrame:
    return led.store().reader().unspent_outputs().select("txid", "output_index", "script_hash", "value_zat", "height")


@query(_LEFT + "SELECT script_hash, count(*) AS n_unspent, sum(value_zat)::BIGINT AS balance_zat FROM left_over GROUP BY script_hash")
def store_balances(led: StoredLedger) -> DataFrame:
    return led.store().reader().balances()


@query(_LEFT + """SELECT script_hash, txid, output_index::INT AS output_index, '76a9' || lpad(hex(address), 16, '0') AS script, value_zat, height FROM (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY height, txid, output_index) AS r FROM left_over WHERE address IN (1, 2, 3)) WHERE r <= 25 ORDER BY height, txid, output_index, script_hash LIMIT 25""")
def store_address_outputs(led: StoredLedger) -> DataFrame:
    """The reply for three addresses, cut to 25 entries after the merge."""
    named = led.spark.createDataFrame([(1,), (2,), (3,)], "a BIGINT").select(F.sha2(F.unhex(script_of(F.col("a"))), 256).alias("script_hash"))
    return compat.address_outputs(led.store().reader(), named, max_entries=25)


# the change log

_LOG = f""", log AS (
  SELECT 1 AS sequence, 'committed' AS event_kind, 1 AS start_height, size AS end_height, NULL AS reverted_epoch, NULL AS reverted_start, NULL AS reverted_end, size AS tip_height, size AS finalized_height FROM lim
  UNION ALL SELECT 2, 'committed', size + 1, half, NULL, NULL, NULL, half, half FROM lim
  UNION ALL SELECT 3, 'committed', half + 1, t, NULL, NULL, NULL, t, half FROM lim
  UNION ALL SELECT 4, 'reorged', fork, t - 1, 3, fork, t, t - 1, half FROM lim
  UNION ALL SELECT 5, 'committed', fork - 1, fork - 1, NULL, NULL, NULL, t - 1, fork - 1 FROM lim)
"""
_EVENT = ["sequence", "event_kind", "start_height", "end_height", "reverted_epoch", "reverted_start", "reverted_end", "tip_height", "finalized_height"]
_EVENT_SQL = "sequence::BIGINT AS sequence, event_kind, start_height::BIGINT AS start_height, end_height::BIGINT AS end_height, reverted_epoch::BIGINT AS reverted_epoch, reverted_start::BIGINT AS reverted_start, reverted_end::BIGINT AS reverted_end, tip_height::BIGINT AS tip_height, finalized_height::BIGINT AS finalized_height"


@query(_LOG + f"SELECT {_EVENT_SQL}, ((sequence - 1) // 2)::BIGINT AS page, 82 AS cursor_bytes FROM log")
def store_event_pages(led: StoredLedger) -> DataFrame:
    """The whole log in pages of two, each asked for with the last one's cursor."""
    store, token, out, nth = led.store(), None, None, 0
    while last := (page := store.history(token, max_events=2)).orderBy(F.desc("sequence")).first():
        own = page.select(*_EVENT, F.lit(nth).cast("bigint").alias("page"), F.octet_length("cursor").alias("cursor_bytes"))
        out, token, nth = own if out is None else out.unionByName(own), bytes(last["cursor"]), nth + 1
    return out


@query(_LOG + f"SELECT {_EVENT_SQL} FROM log WHERE event_kind = 'committed' AND tip_height <= finalized_height")
def store_finalized_events(led: StoredLedger) -> DataFrame:
    return led.store().history(family="finalized").select(*_EVENT)


@query("SELECT height, epoch, block_hash FROM seen")
def store_replay(led: StoredLedger) -> DataFrame:
    """What a consumer of the whole log holds; the replacement has fewer blocks than what it reverts."""
    tables = led.store().tables()
    return log.replayed(tables["chain_event"], tables["block"])


@query("SELECT height, block_hash, height <= (SELECT fork - 1 FROM lim) AS final FROM seen")
def store_finality(led: StoredLedger) -> DataFrame:
    store = led.store()
    return log.with_finality(store.reader().visible().select("height", "block_hash"), store.tables()["chain_event"])


@query(_LOG + f"SELECT coalesce(min(sequence) FILTER (WHERE {CREATED} + (sequence - 1) * 60000 >= {CREATED} + 150000), max(sequence))::BIGINT AS floor_sequence FROM log")
def store_retention_floor(led: StoredLedger) -> DataFrame:
    return log.retention_floor(led.store().tables()["chain_event"], CREATED + 150_000)


# information


@query("SELECT 'zcash-regtest' AS chain_name, t - 1 AS block_height, t - 1 AS estimated_height, 'ledgerloom' AS vendor, true AS taddr_support, 2 AS sapling_activation_height, '76b809bb' AS consensus_branch_id FROM lim")
def store_server_info(led: StoredLedger) -> DataFrame:
    upgrades = led.spark.createDataFrame([("Overwinter", "5BA81B19", 1), ("Sapling", "76B809BB", 2), ("Later", "ffffffff", 1 << 31)], "name STRING, branch_id STRING, activation_height BIGINT")
    return compat.server_info(led.store().reader(), upgrades)


@query("SELECT 3 AS network, CAST(5 AS BIGINT) AS epoch, t - 1 AS tip_height, 2 AS artifact_schema_version, 1000 AS max_blocks, 1000 AS max_roots, 9 AS n_capabilities, true AS has_events FROM lim")
def store_info(led: StoredLedger) -> DataFrame:
    info = led.store().reader().info()
    return info.select("*", F.size("capabilities").alias("n_capabilities"), F.array_contains("capabilities", "wallet.events.chain_v1").alias("has_events")).drop("capabilities")


@query("""SELECT CAST(5 AS BIGINT) AS writer_epoch, CAST(2 AS BIGINT) AS reader_epoch, CAST(3 AS BIGINT) AS lag_epochs, half AS tip_height, t - half AS lag_blocks, CAST(1 AS BIGINT) AS age_hours,
  CASE WHEN t - half > 2 THEN 'syncing' ELSE 'ready' END AS cause, t - half <= 2 AS ready FROM lim""")
def store_readiness(led: StoredLedger) -> DataFrame:
    store = led.store()
    return health.readiness(store, store.reader(2), led.top, CREATED + 3_600_000)


@query(_HELD + """, whole AS (SELECT o_orderkey AS key, o_orderkey // 75 + 1 AS height FROM orders), every AS (
  SELECT 0 AS branch, key, height FROM whole UNION ALL SELECT 1, key, height FROM whole, lim WHERE height BETWEEN fork AND t - 1 AND key % 7 <> 0),
every_first AS (SELECT branch, height, min(key) AS key FROM every GROUP BY ALL), spent AS (SELECT e.branch, e.height FROM items i JOIN every_first e ON e.height = i.key // 75 + 3 WHERE i.flag = 'R')
SELECT 'block' AS family, count(*) AS n_rows, count(DISTINCT epoch) AS n_epochs FROM blocks UNION ALL SELECT 'compact_block', count(*), count(DISTINCT epoch) FROM blocks
UNION ALL SELECT 'tree_state', count(*), count(DISTINCT epoch) FROM blocks
UNION ALL SELECT 'transaction', count(*), count(DISTINCT b.epoch) FROM every e JOIN blocks b ON b.height = e.height AND b.branch = e.branch
UNION ALL SELECT 'utxo', count(*), count(DISTINCT b.epoch) FROM every e JOIN items USING (key) JOIN blocks b ON b.height = e.height AND b.branch = e.branch
UNION ALL SELECT 'utxo_spend', count(*), count(DISTINCT b.epoch) FROM spent s JOIN blocks b ON b.height = s.height AND b.branch = s.branch""")
def store_counts(led: StoredLedger) -> DataFrame:
    """Committed rows of each family but the subtree roots, which ``store_subtree_roots`` tells."""
    return health.counts(led.store()).where("family <> 'subtree_root'")


# commit rules


def _name(height: int, branch: int = 0) -> str:
    return f"{height:032x}{branch:032x}"


def commit_cases(spark: SparkSession) -> list[tuple[str, str | None]]:
    """(case, rule that rejects it or null): changes of a chain of five blocks, final up to 2."""

    def rows(start: int, end: int, branch: int = 0, base: int = 0) -> dict[str, DataFrame]:
        made = [(2, h, _name(h, branch), _name(h - 1, branch if h > start else base), None) for h in range(start, end + 1)]
        return {"block": spark.createDataFrame(made, ddl("block")), "compact_block": spark.createDataFrame([(2, h, name, []) for _, h, name, _, _ in made], schema("compact_block"))}

    def epoch(number: int, tip: int, branch: int = 0, final: int = 2, **more) -> Row:
        return Row(**(dict(epoch=number, network=3, tip_height=tip, tip_hash=_name(tip, branch), finalized_height=final, finalized_hash=_name(final), artifact_schema_version=2, created_at_millis=0, sapling_tree_size=0, orchard_tree_size=0) | more))

    def spend(height: int, *outs: int, branch: int = 0) -> DataFrame:
        return spark.createDataFrame([(2, "aa" * 32, n, height, _name(height, branch)) for n in outs], ddl("utxo_spend"))

    known = spark.createDataFrame([(1, h, _name(h), _name(h - 1), None) for h in range(1, 6)], ddl("block"))
    now, extend, final = epoch(1, 5), Change("extend"), Change("finalize")
    other = rows(6, 6, branch=9)
    cases = {
        "extend by one": (epoch(2, 6), extend, rows(6, 6)),
        "extend and finalize": (epoch(2, 7, final=6), extend, rows(6, 7)),
        "replace the tip": (epoch(2, 5, 1), Change("replace", 5), rows(5, 5, 1)),
        "replace by fewer": (epoch(2, 4, 1), Change("replace", 4), rows(4, 4, 1)),
        "finalize a visible block": (epoch(2, 5, final=4), final, {}),
        "reorg window of zero": (epoch(2, 6), extend, rows(6, 6)),
        "old epoch": (epoch(1, 6), extend, rows(6, 6)),
        "other network": (epoch(2, 6, network=1), extend, rows(6, 6)),
        "no compact blocks": (epoch(2, 6), extend, {"block": rows(6, 6)["block"]}),
        "finalize with blocks": (epoch(2, 6, final=3), final, rows(6, 6)),
        "finalized above the tip": (epoch(2, 6, final=7), extend, rows(6, 6)),
        "tip of another hash": (epoch(2, 6, 4), extend, rows(6, 6)),
        "two blocks at a height": (epoch(2, 6), extend, {k: v.unionByName(other[k]) for k, v in rows(6, 6).items()}),
        "a spend above the tip": (epoch(2, 6), extend, rows(6, 6) | {"utxo_spend": spend(8, 0)}),
        "a spend of an unknown block": (epoch(2, 6), extend, rows(6, 6) | {"utxo_spend": spend(6, 0, branch=9)}),
        "a spend twice": (epoch(2, 6), extend, rows(6, 6) | {"utxo_spend": spend(6, 0, 0)}),
        "a height left out": (epoch(2, 7), extend, rows(7, 7)),
        "finalize moves the tip": (epoch(2, 7, final=4), final, {}),
        "finalize renames the tip": (epoch(2, 5, 3, final=4), final, {}),
        "finalize an unknown hash": (epoch(2, 5, final=4, finalized_hash="ff" * 32), final, {}),
        "finalize nothing": (epoch(2, 5), final, {}),
        "finalized goes back": (epoch(2, 6, final=1), extend, rows(6, 6)),
        "finalized is renamed": (epoch(2, 6, finalized_hash="ff" * 32), extend, rows(6, 6)),
        "replace what is final": (epoch(2, 5, 1), Change("replace", 2), rows(2, 5, 1)),
        "replace above the tip": (epoch(2, 8, 1), Change("replace", 7), rows(7, 8, 1)),
        "a block outside the range": (epoch(2, 6), extend, rows(5, 6)),
        "a parent that is not there": (epoch(2, 6), extend, rows(6, 6, base=5)),
    }
    out = []
    for name, (new, change, artifacts) in cases.items():
        try:
            check_commit(new, change, artifacts, now, known, 0 if name == "reorg window of zero" else 100)
            out.append((name, None))
        except CommitRejected as told:
            out.append((name, told.rule))
    return out


@query("""SELECT * FROM (VALUES ('extend by one', NULL), ('extend and finalize', NULL), ('replace the tip', NULL), ('replace by fewer', NULL), ('finalize a visible block', NULL), ('reorg window of zero', 'window'), ('old epoch', 'epoch_order'),
('other network', 'network'), ('no compact blocks', 'artifacts'), ('finalize with blocks', 'artifacts'), ('finalized above the tip', 'finalized'), ('tip of another hash', 'tip_hash'), ('two blocks at a height', 'conflict'),
('a spend above the tip', 'height'), ('a spend of an unknown block', 'block_match'), ('a spend twice', 'unique'), ('a height left out', 'coverage'), ('finalize moves the tip', 'tip'), ('finalize renames the tip', 'tip'),
('finalize an unknown hash', 'finalized_hash'), ('finalize nothing', 'finalized'), ('finalized goes back', 'finalized'), ('finalized is renamed', 'finalized'), ('replace what is final', 'reorg_window'), ('replace above the tip', 'replace'),
('a block outside the range', 'range'), ('a parent that is not there', 'parent_link')) AS v(case_name, rule)""", stored=False)
def commit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(commit_cases(spark), "case_name STRING, rule STRING")
