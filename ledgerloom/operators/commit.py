"""Rules of a commit, each a set-based check; the first broken one rejects the commit before anything is written.

A change is one of: ``extend`` (new blocks on the tip), ``replace`` (from a height inside the reorg window), ``finalize``
(no artifacts; the finalized height moves up to a visible block, and the tip stays). Only the first commit of a store may
name a tip and a finalized height without blocks: it starts the ledger at a checkpoint. A finalize commit that moves
nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.errors import CommitRejected, FailedPrecondition
from ledgerloom.operators.visibility import visible_blocks
from ledgerloom.schema import ARTIFACT_SCHEMA_VERSION, FAMILIES

#: Unique keys of families inside a commit.
UNIQUE = {"compact_block": ["height"], "subtree_root": ["protocol", "subtree_index"], "utxo": ["txid", "output_index"], "utxo_spend": ["txid", "output_index"]}


@dataclass(frozen=True)
class Change:
    kind: str
    from_height: int | None = None


def _stop(rule: str, when: bool, message: str) -> None:
    if when:
        raise CommitRejected(rule, message)


def _none(rule: str, bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise CommitRejected(rule, message)


def check_commit(new: Row, change: Change, artifacts: Mapping[str, DataFrame], current: Row | None, blocks: DataFrame, reorg_window: int = 100) -> Row:
    """Checks a commit against the store's current epoch and blocks; returns its event (without sequence)."""
    _stop("window", reorg_window <= 0, "reorg window must be positive")
    _stop("epoch_order", new["epoch"] <= (current["epoch"] if current else 0), "epoch id must grow")
    _stop("network", current is not None and new["network"] != current["network"], "another network")
    _stop("finalized", new["finalized_height"] > new["tip_height"], "finalized above the tip")
    counts = {f: artifacts[f].count() if f in artifacts else 0 for f in FAMILIES}
    bare = change.kind == "finalize"
    _stop("artifacts", any(counts.values()) if bare else not (counts["block"] and counts["compact_block"]), "wrong families for the change")
    tip, finalized = new["tip_height"], new["finalized_height"]
    old_tip = current["tip_height"] if current else 0
    own = {f: artifacts[f] for f in FAMILIES if counts[f]}
    start = end = None
    if not bare:
        bounds = own["block"].agg(F.min("height").alias("low"), F.max("height").alias("high")).first()
        start, end = _changed_range(new, change, current, bounds["low"], reorg_window)
        _check_artifacts(own, tip, start, end)
    _check_monotone(new, change, current, own.get("block"))
    if own:
        _check_links(own["block"], current, blocks, start)
    seen = own.get("block")
    known = None if seen is None else seen.where(F.col("height") == finalized).select("block_hash").first()
    if known is None and current is not None and finalized:
        known = visible_blocks(blocks.where(F.col("height") == finalized), current["epoch"], current["tip_height"]).select("block_hash").first()
    _stop("finalized_hash", known is not None and known[0] != new["finalized_hash"], "finalized hash is not that of the block there")
    _stop("finalized_hash", known is None and current is not None and finalized > current["finalized_height"], "finalized block is unknown")
    reverted = {"reverted_epoch": current["epoch"], "reverted_start": change.from_height, "reverted_end": old_tip} if change.kind == "replace" else {"reverted_epoch": None, "reverted_start": None, "reverted_end": None}
    if bare:
        start = end = finalized
    return Row(epoch=new["epoch"], event_kind="reorged" if change.kind == "replace" else "committed", start_height=start, end_height=end, **reverted, tip_height=tip, tip_hash=new["tip_hash"], finalized_height=finalized, created_at_millis=new["created_at_millis"])


def _changed_range(new: Row, change: Change, current: Row | None, low: int, window: int) -> tuple[int, int]:
    tip = new["tip_height"]
    if change.kind == "replace":
        _stop("replace", current is None, "nothing to replace")
        first = change.from_height
        least = max(current["finalized_height"] + 1, current["tip_height"] - window + 1)
        _stop("reorg_window", first < least, f"replacement starts below {least}")
        _stop("replace", first > tip or first > current["tip_height"], "replacement starts above a tip")
        return first, tip
    if current is None:
        return low, tip
    _stop("tip", tip <= current["tip_height"] and change.kind == "extend", "blocks without a new tip")
    return current["tip_height"] + 1, tip


def _check_artifacts(own: Mapping[str, DataFrame], tip: int, start: int, end: int) -> None:
    block = own["block"]
    _none("conflict", block.groupBy("height").agg(F.count_distinct("block_hash", "parent_hash").alias("n")).where("n > 1"), "two blocks at one height")
    _none("range", block.where((F.col("height") > tip) | ~F.col("height").between(start, end)), "block outside the changed range")
    here = block.select("height", "block_hash").distinct()
    for family, rows in own.items():
        if family != "block":
            _none("height", rows.where(F.col("height") > tip), f"{family} above the tip")
            _none("block_match", rows.select("height", "block_hash").distinct().join(here, ["height", "block_hash"], "left_anti"), f"{family} of a block that is not in the commit")
        if family in UNIQUE:
            _none("unique", _repeated(rows, UNIQUE[family]), f"{family} repeats a key")
        if family in ("block", "compact_block"):
            wanted = rows.sparkSession.range(start, end + 1).withColumnRenamed("id", "height")
            _none("coverage", wanted.join(rows.select("height"), "height", "left_anti"), f"{family} misses a height")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once. Hashes are shuffled in their place; only keys of a repeated hash are then compared."""
    hashed = rows.select(F.xxhash64(*keys).alias("_hash"), *keys)
    again = hashed.groupBy("_hash").count().where("count > 1").select("_hash")
    if again.isEmpty():
        return again.limit(0)  # known to be empty: not worked out again
    return hashed.join(again, "_hash").groupBy(*keys).count().where("count > 1")


def _check_monotone(new: Row, change: Change, current: Row | None, block: DataFrame | None) -> None:
    if block is not None:
        tip = block.where(F.col("height") == new["tip_height"]).select("block_hash").first()
        _stop("tip_hash", tip is not None and tip[0] != new["tip_hash"], "tip hash is not that of the block there")
    if current is None:
        return
    _stop("finalized", new["finalized_height"] < current["finalized_height"], "finalized height decreases")
    _stop("finalized", new["finalized_height"] == current["finalized_height"] and new["finalized_hash"] != current["finalized_hash"], "finalized hash changes")
    if change.kind == "finalize":
        _stop("tip", (new["tip_height"], new["tip_hash"]) != (current["tip_height"], current["tip_hash"]), "tip moves without blocks")
        _stop("finalized", new["finalized_height"] == current["finalized_height"], "nothing is finalized")
    elif change.kind != "replace":
        _stop("tip", new["tip_height"] < current["tip_height"], "tip decreases")
        _stop("tip", new["tip_height"] == current["tip_height"] and new["tip_hash"] != current["tip_hash"], "tip hash changes without a replacement")


def _check_links(block: DataFrame, current: Row | None, blocks: DataFrame, start: int) -> None:
    """Each block's parent is the block below: in the commit, or visible at start - 1. The first commit's is free."""
    below = block.select((F.col("height") + 1).alias("height"), F.col("block_hash").alias("below_hash"))
    if current is not None and start == current["tip_height"] + 1:  # the tip may be a checkpoint without a block
        below = below.unionByName(block.sparkSession.createDataFrame([(start, current["tip_hash"])], "height BIGINT, below_hash STRING"))
    elif current is not None:
        base = visible_blocks(blocks.where(F.col("height") == start - 1), current["epoch"], current["tip_height"])
        below = below.unionByName(base.select((F.col("height") + 1).alias("height"), F.col("block_hash").alias("below_hash")))
    linked = block.join(below, "height", "left")
    unknown = F.lit(current is not None) | (F.col("height") != start)
    _none("parent_link", linked.where(F.when(F.col("below_hash").isNull(), unknown).otherwise(F.col("below_hash") != F.col("parent_hash"))), "parent is not the block below")


def choose_change(tip: Row | None, height: int, parent_hash: str, window: int = 100) -> Change:
    """How a new best block changes the chain: it extends the tip, or replaces from its height inside the window."""
    if tip is None or (height == tip["tip_height"] + 1 and parent_hash == tip["tip_hash"]):
        return Change("extend")
    depth = tip["tip_height"] - height + 1
    if depth > window:
        raise CommitRejected("reorg_window", f"replacement of {depth} blocks")
    return Change("replace", height)


def backfill_batches(start: int, end: int, tip: int, size: int = 1000, window: int = 100, near_tip: bool = False) -> list[tuple[int, int]]:
    """Height ranges of a backfill's commits; heights near the tip are refused unless asked for."""
    if not near_tip and end > tip - window:
        raise FailedPrecondition(f"backfill to {end} is nearer than {window} to the tip {tip}")
    return [(a, min(a + size - 1, end)) for a in range(start, end + 1, size)]


def checked_schema(version: int) -> None:
    if version > ARTIFACT_SCHEMA_VERSION:
        raise FailedPrecondition(f"artifact schema {version} is newer than {ARTIFACT_SCHEMA_VERSION}")
