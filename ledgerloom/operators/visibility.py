"""Snapshot visibility: the newest version of each key up to an epoch, and the branch that a snapshot sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(table: DataFrame, keys: list[str], epoch: int | Column) -> DataFrame:
    """Of each key the row with the greatest epoch up to ``epoch``: one aggregate with partial maxima, no window."""
    rest = [c for c in table.columns if c not in keys]
    newest = table.where(F.col("epoch") <= epoch).groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(table.columns)


def visible_blocks(blocks: DataFrame, epoch: int, tip_height: int) -> DataFrame:
    """The blocks of the branch that the snapshot sees, one for each height up to its tip."""
    return as_of(blocks.where(F.col("height") <= tip_height), ["height"], epoch)


def on_branch(artifacts: DataFrame, visible: DataFrame) -> DataFrame:
    """Artifacts whose block is the visible one at its height. ``visible`` has a row for each height."""
    return artifacts.join(visible.select("height", "block_hash"), ["height", "block_hash"], "left_semi").select(artifacts.columns)


def off_branch(blocks: DataFrame, visible: DataFrame, block: list[str]) -> DataFrame:
    """Those of ``blocks`` that are not on the visible branch: few, as only replaced ones are."""
    return blocks.select(*block).distinct().join(visible.select(*block), block, "left_anti")


def without_blocks(artifacts: DataFrame, off: DataFrame, block: list[str]) -> DataFrame:
    """``on_branch`` for artifacts whose blocks are all known, by the known blocks that are not visible: those are sent to the
    artifacts, which stay where they are."""
    return artifacts.join(F.broadcast(off), block, "left_anti").select(artifacts.columns)


def valid_intervals(blocks: DataFrame) -> DataFrame:
    """Each block version with the epochs [valid_from, valid_to) in which it is visible; null: still. Turns a read as of
    an epoch into a range filter."""
    order = Window.partitionBy("height").orderBy("epoch")
    return blocks.select("*", F.col("epoch").alias("valid_from"), F.lead("epoch").over(order).alias("valid_to"))


def parent_links(visible: DataFrame) -> DataFrame:
    """height, block_hash, parent_hash and linked: the parent is the visible block below (null for the lowest one). A
    join on the height instead of a window, which would order the whole chain in one task."""
    below = visible.select((F.col("height") + 1).alias("height"), F.col("block_hash").alias("below_hash"))
    return visible.join(below, "height", "left").select("height", "block_hash", "parent_hash", (F.col("below_hash") == F.col("parent_hash")).alias("linked"))


def missing_heights(visible: DataFrame, start: int, end: int) -> DataFrame:
    """Heights of [start, end] that have no row."""
    wanted = visible.sparkSession.range(start, end + 1).withColumnRenamed("id", "height")
    return wanted.join(visible.select("height"), "height", "left_anti")


def common_ancestor(candidate: DataFrame, visible: DataFrame) -> DataFrame:
    """The greatest height at which both branches have the same block, as ancestor_height (null: none)."""
    return candidate.join(visible.select("height", "block_hash"), ["height", "block_hash"], "left_semi").agg(F.max("height").alias("ancestor_height"))
