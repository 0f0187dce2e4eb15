import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import CommitRejected, DataLoss, FailedPrecondition
from ledgerloom.schema import schema
from ledgerloom.sources import node
from ledgerloom.sources.jobs import Sizes, Source, backfill, follow
from ledgerloom.sources.store import LedgerStore
from tests.chain import block_hash


class Node:
    """A node whose best chain can change: branch by height."""

    def __init__(self, spark, tip):
        self.spark, self.branch = spark, dict.fromkeys(range(1, tip + 1), 0)

    @property
    def tip(self):
        return max(self.branch)

    def header(self, height):
        return (block_hash(height, self.branch[height]), block_hash(height - 1, self.branch.get(height - 1, 0))) if height in self.branch else None

    def source(self):
        def parsed(a, b):
            note = ("c", "e", b"x" * 60)
            rows = [(h, *self.header(h), b"raw", [(0, f"{h:064x}", [], [note], [], [], [])]) for h in range(a, b + 1) if h in self.branch]
            kind = schema("compact_block")["vtx"].dataType.simpleString()
            return self.spark.createDataFrame(rows, f"height BIGINT, block_hash STRING, parent_hash STRING, payload BINARY, vtx {kind}")

        roots = lambda p: self.spark.createDataFrame([(0, "ab" * 32, 7)] if p == 1 else [], "subtree_index BIGINT, root_hash STRING, height BIGINT")
        return Source(parsed, None, roots)


@pytest.fixture()
def store(spark, tmp_path):
    return LedgerStore(spark, f"file://{tmp_path}/store", 3, create=True)


BELOW = Sizes(65529, 5)


def seen(store):
    return [r["block_hash"] for r in store.reader().visible().orderBy("height").collect()]


def test_backfill_resumes_and_follow_keeps_up(spark, store):
    from_node = Node(spark, 20)
    clock = iter(range(1, 1000)).__next__
    run = dict(node_tip=20, size=3, window=4, sizes=BELOW, clock=clock)
    with pytest.raises(FailedPrecondition):
        backfill(store, from_node.source(), 1, 17, **run)  # too near to the tip
    assert backfill(store, from_node.source(), 1, 5, **run) == 2
    assert backfill(store, from_node.source(), 1, 8, **run) == 1  # goes on at 6
    assert backfill(store, from_node.source(), 1, 8, **run) == 0
    with pytest.raises(FailedPrecondition):
        backfill(store, from_node.source(), 11, 12, **run)
    now = store.current()
    assert (now["tip_height"], now["finalized_height"], now["sapling_tree_size"], now["orchard_tree_size"]) == (8, 8, 65537, 5)
    assert store.reader().subtree_roots(1, 0).first()["height"] == 7
    step = lambda tip=None: follow(store, from_node.source(), from_node.header, tip or from_node.tip, window=4, sizes=BELOW, clock=clock)
    assert step(7) == "wait" and step(8) == "none"
    assert [step() for _ in range(5)] == ["extend"] * 5
    now = store.current()
    assert (now["tip_height"], now["finalized_height"], now["finalized_hash"]) == (13, 9, block_hash(9))
    for h in (12, 13, 14):
        from_node.branch[h] = 1
    for h in range(15, 21):
        del from_node.branch[h]
    assert step() == "replace"
    assert seen(store) == [block_hash(h, int(h > 11)) for h in range(1, 15)]
    now = store.current()
    assert (now["tip_height"], now["finalized_height"], now["sapling_tree_size"]) == (14, 10, 65529 + 14)
    from_node.branch |= {h: 2 for h in range(9, 16)}  # a fork below what is final
    with pytest.raises(CommitRejected):
        step()
    assert store.current()["tip_height"] == 14


def test_follow_needs_a_filled_store(spark, store):
    with pytest.raises(FailedPrecondition):
        follow(store, Node(spark, 3).source(), lambda h: None, 3)


def test_replies_of_a_node():
    reply = {"pool": "sapling", "start_index": 2, "subtrees": [{"root": "ab" * 32, "end_height": 9}]}
    assert node.subtree_rows(reply, 1, 2) == [(2, "ab" * 32, 9)]
    for wrong in (reply | {"pool": "orchard"}, reply | {"start_index": 1}, reply | {"subtrees": [{"root": "ab", "end_height": 9}]}):
        with pytest.raises(DataLoss):
            node.subtree_rows(wrong, 1, 2)
    assert node.upgrade_rows({"upgrades": {"76b809bb": {"name": "Sapling", "activationheight": 5, "status": "active"}}}) == [("Sapling", "76b809bb", 5)]
    assert "describe" not in node.node_capabilities(None) and node.node_capabilities({"methods": [{"name": "getblock"}, {"name": "x"}]}) == {"block", "describe"}
