from pyspark.sql import functions as F

from ledgerloom.operators.commit import Change
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming.events import DerivedBlocks, replayed, tail, with_finality
from tests.chain import Chain, block_hash, epoch_row


def rows(df):
    return sorted(tuple(r) for r in df.select("height", "epoch", "block_hash").collect())


def test_replay_follows_reorgs_and_a_restart_changes_nothing(spark, tmp_path):
    """A tail of the store's log through an append, a longer, a shorter replacement; the view equals what a reader sees."""
    chain, store = Chain(spark), LedgerStore(spark, f"file://{tmp_path}/store", 3, create=True)
    steps = [
        (epoch_row(1, 5), Change("extend"), chain.blocks(1, 5)),
        (epoch_row(2, 6, branch=1), Change("replace", 5), chain.blocks(5, 6, branch=1, base=0)),
        (epoch_row(3, 4, branch=2), Change("replace", 4), chain.blocks(4, 4, branch=2, base=0)),
        (epoch_row(4, 4, branch=2, finalized=3), Change("finalize"), {}),
    ]
    view = None
    for k, step in enumerate(steps):
        store.commit(*step)
        blocks = store.tables()["block"].select("epoch", "height", "block_hash")
        view = DerivedBlocks(blocks, f"file://{tmp_path}/view", span=2)
        view.start(tail(spark, store.path), f"file://{tmp_path}/checkpoint").awaitTermination()
        seen = rows(store.reader().visible())
        assert rows(view.read(spark, k)) == seen
        events = store.tables()["chain_event"]
        assert rows(replayed(events, blocks)) == seen
    view.apply(store.tables()["chain_event"].where("sequence = 3"), 2)
    assert rows(view.read(spark, 3)) == seen == [(1, 1, block_hash(1)), (2, 1, block_hash(2)), (3, 1, block_hash(3)), (4, 3, block_hash(4, 2))]
    assert {(r["height"], r["final"]) for r in with_finality(store.reader().visible(), events).collect()} == {(1, True), (2, True), (3, True), (4, False)}
    # a batch rewrites only the spans that it changes
    assert {r["span"] for r in spark.read.parquet(f"file://{tmp_path}/view").where(F.col("batch") == 1).select("span").distinct().collect()} == {2, 3}
