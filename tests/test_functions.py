import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.errors import DataLoss, InvalidRequest
from ledgerloom.functions import address, compact, cursor, scalars
from ledgerloom.schema import narrowed, schema
from ledgerloom.sources import node
from tests.chain import block_hash


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**63 - 1), st.integers(0, 2**32 - 1), st.binary(min_size=32, max_size=32), st.integers(0, 1))
def test_cursors_round_trip_and_do_not_bend(sequence, height, tip, family):
    at = cursor.Position(3, sequence, height, tip.hex(), family)
    token = cursor.encode(b"k", at)
    assert len(token) == 82 and cursor.decode(b"k", 3, cursor.from_text(cursor.to_text(token))) == at
    for wrong in (token[:-1], token[:30] + bytes([token[30] ^ 1]) + token[31:]):
        with pytest.raises(InvalidRequest):
            cursor.decode(b"k", 3, wrong)
    with pytest.raises(InvalidRequest):
        cursor.decode(b"k", 1, token)


STATES = [
    ('{"time": 5, "sapling": {"commitments": {"finalState": "ab"}}}', "ab"), ('{"time": 5}', ""), ('{"sapling": {}}', ""), ('{"sapling": {"commitments": {}}}', ""),
    ('{"sapling": {"commitments": {"x": 1}}}', None), ('{"sapling": {"commitments": null}}', None), ('{"sapling": {"commitments": [1]}}', None), ('{"sapling": 7}', None), ('{"sapling": {"commitments": "s"}}', None),
]


@pytest.mark.parametrize("payload,want", STATES)
def test_final_states(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "payload STRING").select(scalars.final_state(F.col("payload"), "sapling").alias("s"))
    if want is None:
        with pytest.raises(Exception, match="data loss"):
            df.collect()
    else:
        assert df.first()[0] == want


@pytest.mark.parametrize("payload,want", [('{"time": 7}', 7), ('{"time": 4294967295}', 4294967295), ('{"time": 4294967296}', None), ('{"time": -1}', None), ("{}", None), ('{"time": "x"}', None)])
def test_tree_times(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "payload STRING").select(scalars.tree_time(F.col("payload")).alias("t"))
    if want is None:
        with pytest.raises(Exception, match="data loss"):
            df.collect()
    else:
        assert df.first()[0] == want


def test_observed_sizes(spark):
    rows = ['{"sapling": {"commitments": {"size": 4}}}', '{"sapling": {"size": "12"}}', '{"trees": {"sapling": {"size": 9}}}', '{"sapling": {"commitments": {}}}', '{"sapling": {"commitments": {"finalState": "000000"}}}', '{"sapling": {"commitments": {"finalState": "0102"}}}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "payload STRING").select(scalars.observed_size(F.col("payload"), "sapling"))
    assert [r[0] for r in df.collect()] == [4, 12, 9, 0, 0, None, None]


def test_small_scalars(spark):
    row = spark.range(1).select(
        scalars.display_hash(F.lit("0102ff")), scalars.completed_subtrees(F.lit(131_073)), scalars.saturating_lag(F.lit(3), F.lit(9)),
        scalars.broadcast_code(F.lit("rejected")), scalars.broadcast_code(F.lit("rejected"), F.lit(-99)), scalars.classify_broadcast(F.lit(True), F.lit(-27)),
        scalars.classify_broadcast(F.lit(True), F.lit(-1)), scalars.classify_broadcast(F.lit(True), F.lit(None).cast("int")), scalars.classify_broadcast(F.lit(False), F.lit(None).cast("int")),
    ).first()
    assert tuple(row) == ("ff0201", 2, 0, -26, -99, "duplicate", "rejected", "unknown", "accepted")
    with pytest.raises(Exception, match="data loss"):
        spark.range(1).select(narrowed(F.lit(1 << 33), "value")).collect()


def vtx(spark):
    note = (("c", "e", b"x" * 60),)
    txs = [(5, "t0", [], list(note), [], [(None, None)], [(7, "00")]), (6, "t1", ["n"], [], [("a", "c", "e", b"y" * 52)], [("t9", 1)], []), (7, "t2", [], [], [], [(None, None)], [])]
    kind = schema("compact_block")["vtx"].dataType.simpleString()
    return spark.createDataFrame([(1, 2, "h", txs)], f"epoch BIGINT, height BIGINT, block_hash STRING, vtx {kind}")


def test_compact_blocks(spark):
    made = vtx(spark).withColumn("vtx", compact.compacted(F.col("vtx")))
    got = made.first()["vtx"]
    assert [(t["index"], t["txid"], len(t["vin"])) for t in got] == [(0, "t0", 0), (1, "t1", 1)] and len(got[0]["outputs"][0]["ciphertext"]) == 52
    pruned = made.select(compact.prune(F.col("vtx"), ["orchard"]).alias("v")).first()["v"]
    assert [t["txid"] for t in pruned] == ["t1"] and not pruned[0]["spends"] and pruned[0]["actions"]
    assert [t["txid"] for t in made.select(compact.prune(F.col("vtx")).alias("v")).first()["v"]] == ["t0", "t1"]
    bare = made.select(compact.nullifiers_only(F.col("vtx")).alias("v")).first()["v"]
    assert [t["txid"] for t in bare] == ["t1"] and bare[0]["actions"][0]["cmx"] == "" and bare[0]["actions"][0]["nullifier"] == "a"
    assert [(r["txid"], r["output_index"], r["value_zat"]) for r in compact.transparent_outputs(made).collect()] == [("t0", 0, 7)]
    assert [(r["txid"], r["output_index"]) for r in compact.transparent_spends(made).collect()] == [("t9", 1)]
    assert tuple(compact.tree_additions(made).first()) == (2, 1, 1)
    assert compact.transaction_at(made, 2, 1).first()["txid"] == "t1" and compact.transaction_at(made, 2, 2).isEmpty()


def test_addresses(spark):
    good = address.encode58(bytes.fromhex("1cb8") + bytes(range(20)))
    script = "76a914" + bytes(range(20)).hex() + "88ac"
    assert address.script_of(good, "zcash-mainnet") == script
    for text, network in ((good, "zcash-testnet"), (good[:-1] + ("1" if good[-1] != "1" else "2"), "zcash-mainnet"), ("0OIl", "zcash-mainnet")):
        with pytest.raises(InvalidRequest):
            address.script_of(text, network)
    df = spark.createDataFrame([(good,), ("x",), (None,)], "a STRING").select(address.script_column(F.col("a"), "zcash-mainnet"))
    assert [r[0] for r in df.collect()] == [script, None, None]


def write_blocks(folder, heights):
    folder.mkdir(exist_ok=True)
    for h in heights:
        (folder / f"{h}.json").write_text(json.dumps({"network": "zcash-regtest", "height": h, "hash": block_hash(h), "previousblockhash": block_hash(h - 1), "time": 1000 + h, "raw_block_hex": "00"}))


def test_node_source_in_batches_and_streams(spark, tmp_path):
    spark.dataSource.register(node.NodeBlocks)
    write_blocks(tmp_path / "n", range(1, 6))
    options = {"path": f"{tmp_path}/n", "heights_per_task": "2"}
    rows = spark.read.format("node_blocks").options(**options).load()
    assert sorted(r["height"] for r in rows.collect()) == [1, 2, 3, 4, 5]
    stream = spark.readStream.format("node_blocks").options(**options).load()
    run = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        run.processAllAvailable()
        write_blocks(tmp_path / "n", [6])
        run.processAllAvailable()
    finally:
        run.stop()
    assert sorted(r["height"] for r in spark.table("seen").collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(DataLoss):
        node.source_row({"height": 3}, 4, "zcash-regtest")


def test_retry_gives_up_and_succeeds():
    pauses, left = [], [2]

    def flaky():
        if left[0]:
            left[0] -= 1
            raise node.Retryable
        return "ok"

    assert node.with_retry(flaky, sleep=pauses.append) == "ok" and pauses == [0.25, 0.5]
    left[0] = 99
    with pytest.raises(node.Retryable):
        node.with_retry(flaky, sleep=pauses.append)
