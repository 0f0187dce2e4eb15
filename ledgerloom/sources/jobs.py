"""Jobs that move a node's blocks into a store: backfill of a range, and steps that follow the tip.

Both take ``parsed``, a function of a height range to the parsed blocks there (epoch, height, block_hash, parent_hash,
payload, vtx; the epoch is set by the commit), and ``states``, one to the tree states there (height, payload). The first
may read the ``node_blocks`` source and parse it. Blocks and artifacts stay in Spark; single rows reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.errors import FailedPrecondition
from ledgerloom.operators.commit import Change, backfill_batches, choose_change
from ledgerloom.operators.ingest import build_artifacts, fill_subtree_roots, summed_sizes, tree_sizes
from ledgerloom.operators.visibility import visible_blocks
from ledgerloom.schema import ARTIFACT_SCHEMA_VERSION, PROTOCOLS
from ledgerloom.sources.store import PACKED, LedgerStore

Range = Callable[[int, int], DataFrame]


@dataclass(frozen=True)
class Source:
    """What a node gives: blocks, tree states, and per protocol the roots (subtree_index, root_hash, height). ``outer`` gives
    the same blocks with no more than txid, vin and vout of their transactions, where that is cheaper to parse; ``counted``
    with no more than outputs and actions, of any content. ``packed`` gives them in the form of the store's packing."""

    parsed: Range
    states: Range | None = None
    roots: Callable[[int], DataFrame] | None = None
    outer: Range | None = None
    counted: Range | None = None
    packed: Range | None = None


@dataclass(frozen=True)
class Sizes:
    """Leaves of both trees below the first block of a commit."""

    sapling: int = 0
    orchard: int = 0


def sizes_below(store: LedgerStore, height: int, start: Sizes) -> Sizes:
    """Tree sizes below ``height`` on the branch that the newest epoch sees, from the compact blocks; ``start`` is below
    the store's first block."""
    now = store.current()
    if now is None:
        return start
    if height == now["tip_height"] + 1:
        return Sizes(now["sapling_tree_size"], now["orchard_tree_size"])
    added = store.additions().where(F.col("height") < height)  # before versions meet: numbers, not blocks, are shuffled
    below = visible_blocks(added, now["epoch"], now["tip_height"])
    last = summed_sizes(below, start.sapling, start.orchard).agg(*[F.max_by(p, "height").alias(p) for p in PROTOCOLS.values()]).first()
    return Sizes(*[last[p] if last[p] is not None else getattr(start, p) for p in PROTOCOLS.values()])


def commit_range(store: LedgerStore, source: Source, change: Change, start: int, end: int, finalized: tuple[int, str] | None, created_at_millis: int, below: Sizes, reorg_window: int = 100) -> int:
    """Builds the artifacts of start..end and commits them as the next epoch; without ``finalized`` the tip is final."""
    parsed, outer = [None if of is None else of(start, end).withColumn("epoch", F.lit(0).cast("bigint")) for of in (source.parsed, source.outer)]
    sizes = tree_sizes(parsed if source.counted is None else source.counted(start, end), below.sapling, below.orchard).persist()  # two numbers a block, asked for by several jobs
    try:
        return _commit(store, source, change, start, end, finalized, created_at_millis, below, reorg_window, parsed, outer, sizes)
    finally:
        sizes.unpersist()


def _commit(store: LedgerStore, source: Source, change: Change, start: int, end: int, finalized: tuple[int, str] | None, created_at_millis: int, below: Sizes, reorg_window: int, parsed: DataFrame, outer: DataFrame | None, sizes: DataFrame) -> int:
    made = build_artifacts(parsed, None if source.states is None else source.states(start, end), below.sapling, below.orchard, sizes, outer)
    if source.packed is not None:
        made = {f: rows for f, rows in made.items() if f not in store.packing.families} | {PACKED: source.packed(start, end)}
    if source.roots is not None:
        filled = [fill_subtree_roots(source.roots(p), made["block"], sizes, p, getattr(below, name)) for p, name in PROTOCOLS.items()]
        made["subtree_root"] = filled[0].unionByName(filled[1])
    after = sizes.agg(*[F.max(p).alias(p) for p in PROTOCOLS.values()]).first()
    tip = made["block"].where(F.col("height") == end).select("block_hash").first()
    if tip is None:
        raise FailedPrecondition(f"the source has no block {end}")
    now = store.current()
    at, named = finalized or (end, tip["block_hash"])
    new = Row(epoch=(now["epoch"] if now else 0) + 1, network=store.network, tip_height=end, tip_hash=tip["block_hash"], finalized_height=at, finalized_hash=named, artifact_schema_version=ARTIFACT_SCHEMA_VERSION, created_at_millis=created_at_millis, sapling_tree_size=after["sapling"], orchard_tree_size=after["orchard"])
    return store.commit(new, change, made, reorg_window)


def backfill(store: LedgerStore, source: Source, start: int, end: int, node_tip: int, size: int = 1000, window: int = 100, near_tip: bool = False, sizes: Sizes = Sizes(), clock: Callable[[], int] = lambda: int(time.time() * 1000)) -> int:
    """Commits start..end in ranges of ``size``, each one final; returns how many. A store that has a part of the range goes
    on behind its tip, one that has all of it gives 0, and a gap between its tip and ``start`` is refused, as are heights
    nearer to the node's tip than ``window`` (unless ``near_tip``)."""
    now = store.current()
    if now is not None:
        if end <= now["tip_height"]:
            return 0
        if start > now["tip_height"] + 1:
            raise FailedPrecondition(f"backfill from {start} leaves a gap above {now['tip_height']}")
        start = now["tip_height"] + 1
    ranges = backfill_batches(start, end, node_tip, size, window, near_tip)
    for a, b in ranges:
        commit_range(store, source, Change("extend"), a, b, None, clock(), sizes_below(store, a, sizes), window)
    return len(ranges)


def follow(store: LedgerStore, source: Source, header: Callable[[int], tuple[str, str] | None], node_tip: int, window: int = 100, sizes: Sizes = Sizes(), clock: Callable[[], int] = lambda: int(time.time() * 1000)) -> str:
    """One step behind a node whose best chain ends at ``node_tip``; ``header(height)`` gives hash and parent there. What it
    did: ``wait`` (the node is behind), ``none`` (same tip), ``extend`` (one block) or ``replace`` (from the fork on). After
    a commit the block ``window`` below the new tip is made final by an epoch of its own."""
    now = store.current()
    if now is None:
        raise FailedPrecondition("follow needs a store that has been filled")
    tip, at = now["tip_height"], (now["finalized_height"], now["finalized_hash"])
    if node_tip < tip:
        return "wait"
    here = header(tip)
    if here is not None and here[0] == now["tip_hash"]:
        if node_tip == tip:
            return "none"
        change, start, end = choose_change(now, tip + 1, header(tip + 1)[1], window), tip + 1, tip + 1
    else:
        start = tip  # down to the first block whose parent the store has, inside the window
        known = {r["height"]: r["block_hash"] for r in store.reader().visible().where(F.col("height") > tip - window - 1).select("height", "block_hash").collect()}
        while start > tip - window and (found := header(start)) is not None and known.get(start - 1) != found[1]:
            start -= 1
        change, end = choose_change(now, start, header(start)[1], window), node_tip
    commit_range(store, source, change, start, end, at, clock(), sizes_below(store, start, sizes), window)
    due = end - window
    if due > at[0]:
        block = store.reader().visible().where(F.col("height") == due).select("block_hash").first()
        if block is not None:
            store.finalize(due, block["block_hash"], clock())
    return change.kind
