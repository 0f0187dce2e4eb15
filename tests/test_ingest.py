import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import CommitRejected, DataLoss, InvalidRequest, NotFound
from ledgerloom.operators import compat, ingest
from ledgerloom.operators.commit import Change
from ledgerloom.schema import schema
from ledgerloom.sources.store import LedgerStore
from tests.chain import Chain, block_hash, epoch_row


@pytest.fixture(scope="module")
def parsed(spark):
    """Two blocks: a coinbase that pays, then a transaction that spends it and has one note of each pool."""
    note, action = ("c", "e", b"x" * 80), ("n", "c", "e", b"y" * 60)
    coinbase = (0, "aa" * 32, [], [], [], [(None, None)], [(50, "0011")])
    spend = (0, "bb" * 32, ["f"], [note], [action], [("aa" * 32, 0)], [(30, "0011"), (20, "0022")])
    kind = schema("compact_block")["vtx"].dataType.simpleString()
    rows = [(1, h, block_hash(h), block_hash(h - 1), b"raw", [tx]) for h, tx in ((1, coinbase), (2, spend))]
    return spark.createDataFrame(rows, f"epoch BIGINT, height BIGINT, block_hash STRING, parent_hash STRING, payload BINARY, vtx {kind}")


def states(spark, *payloads):
    return spark.createDataFrame([(k + 1, p) for k, p in enumerate(payloads)], "height BIGINT, payload STRING")


def test_artifacts_of_parsed_blocks_commit_and_read(spark, parsed, tmp_path):
    tree = states(spark, '{"time": 1, "sapling": {"size": 0}}', '{"time": 2, "sapling": {"size": 1}, "orchard": {"size": "1"}}')
    made = ingest.build_artifacts(parsed, tree)
    store = LedgerStore(spark, f"file://{tmp_path}/s", 3, create=True)
    store.commit(epoch_row(1, 2), Change("extend"), made)
    reader = store.reader()
    assert sorted(r["value_zat"] for r in reader.unspent_outputs().collect()) == [20, 30]
    assert reader.transaction_at(2, 0).first()["txid"] == "bb" * 32
    hashes = made["utxo"].where("value_zat = 30").select("script_hash")
    assert [(r["value_zat"], r["output_index"]) for r in compat.address_outputs(reader, hashes).collect()] == [(30, 0)]
    shown = compat.tree_state(reader).first()
    assert (shown["network"], shown["time"], shown["sapling_tree"], shown["hash"]) == ("zcash-regtest", 2, "", bytes.fromhex(block_hash(2))[::-1].hex())
    assert compat.block(reader, 1, block_hash(1)).count() == 1 and compat.server_info(reader).first()["block_height"] == 2
    for height, own in ((0, None), (1, "00" * 32), (9, None)):
        with pytest.raises(NotFound):
            compat.block(reader, height, own)
    with pytest.raises(InvalidRequest):
        compat.address_outputs(reader, hashes, max_entries=-1)


def test_tree_sizes_are_carried_and_checked(spark, parsed):
    sizes = ingest.tree_sizes(parsed, 10, 20)
    assert [tuple(r) for r in sizes.orderBy("height").collect()] == [(1, 10, 20), (2, 11, 21)]
    with pytest.raises(DataLoss):
        ingest.build_artifacts(parsed, states(spark, '{"sapling": {"size": 7}}'))
    with pytest.raises(Exception, match="overflows"):
        ingest.tree_sizes(parsed, (1 << 32) - 1).collect()


def test_subtree_roots_are_filled_from_the_batch(spark, parsed):
    sizes = ingest.tree_sizes(parsed, 65535, 0)
    roots = spark.createDataFrame([(0, "ab" * 32, 2), (1, "cd" * 32, 9)], "subtree_index BIGINT, root_hash STRING, height BIGINT")
    found = ingest.fill_subtree_roots(roots, parsed, sizes, 1, 65535).collect()
    assert [(r["subtree_index"], r["block_hash"]) for r in found] == [(0, block_hash(2))]
    assert ingest.fill_subtree_roots(roots, parsed, sizes, 2, 0).count() == 0
    with pytest.raises(CommitRejected):
        ingest.fill_subtree_roots(roots.where(F.col("height") > 5), parsed, sizes, 1, 65535)


def test_a_page_of_several_addresses_is_cut_after_the_merge(spark, tmp_path):
    chain = Chain(spark)
    made = chain.blocks(1, 3) | {"utxo": chain.table("utxo", [chain.output(f"0{k}", 0, k, 1 + k % 3, script="aa" if k % 2 else "bb") for k in range(1, 9)])}
    store = LedgerStore(spark, f"file://{tmp_path}/s", 3, create=True)
    store.commit(epoch_row(1, 3), Change("extend"), made)
    both = spark.createDataFrame([("aa" * 32,), ("bb" * 32,)], "script_hash STRING")
    rows = store.reader().address_outputs(both, max_entries=3).collect()
    assert [(r["height"], r["value_zat"]) for r in rows] == [(1, 3), (1, 6), (2, 1)]
    twice = both.limit(1).unionByName(both.limit(1))
    assert len(store.reader().address_outputs(twice, max_entries=100).collect()) == 8
