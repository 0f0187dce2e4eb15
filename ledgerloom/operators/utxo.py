"""Unspent outputs, balances and histories of addresses at a snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.errors import InvalidRequest
from ledgerloom.operators.visibility import on_branch, without_blocks

#: Entries of a reply when the request names no number.
DEFAULT_ENTRIES = 1000
OUTPOINT = ["txid", "output_index"]
ORDER = ["height", "txid", "output_index"]


@dataclass(frozen=True)
class Keys:
    """Columns that tell outpoints and blocks apart, which may be narrower than their ids; with ``off``, the known blocks
    that are not visible, artifacts are not shuffled to find their branch."""

    outpoint: list[str] = field(default_factory=lambda: list(OUTPOINT))
    block: list[str] = field(default_factory=lambda: ["height", "block_hash"])
    off: DataFrame | None = None

    def seen(self, artifacts: DataFrame, visible: DataFrame) -> DataFrame:
        return on_branch(artifacts, visible) if self.off is None else without_blocks(artifacts, self.off, self.block)


def unspent(outputs: DataFrame, spends: DataFrame, visible: DataFrame, epoch: int, start_height: int = 0, keys: Keys = Keys()) -> DataFrame:
    """Outputs on the visible branch that no visible block spends, one row for each outpoint: the first in key order
    (height, transaction, index, epoch)."""
    made = keys.seen(outputs.where((F.col("epoch") <= epoch) & (F.col("height") >= start_height)), visible)
    gone = keys.seen(spends.where(F.col("epoch") <= epoch), visible).select(*keys.outpoint)
    left = made.join(gone, keys.outpoint, "left_anti")
    rest = [c for c in left.columns if c not in keys.outpoint]
    first = left.groupBy(*keys.outpoint).agg(F.min_by(F.struct(*rest), F.struct("height", "epoch")).alias("_row"))
    return first.select(*keys.outpoint, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(outputs.columns)


def spent(outputs: DataFrame, spends: DataFrame, visible: DataFrame, epoch: int, keys: Keys = Keys()) -> DataFrame:
    """Visible outputs with the height that spends them."""
    made = keys.seen(outputs.where(F.col("epoch") <= epoch), visible)
    gone = keys.seen(spends.where(F.col("epoch") <= epoch), visible).groupBy(*keys.outpoint).agg(F.min("height").alias("spent_height"))
    return made.dropDuplicates(keys.outpoint).join(gone, keys.outpoint)


def page(rows: DataFrame, max_entries: int = 0) -> DataFrame:
    """The first rows in key order; 0 means the default number."""
    if max_entries < 0:
        raise InvalidRequest("max_entries is negative")
    return rows.orderBy(*ORDER).limit(max_entries or DEFAULT_ENTRIES)


def for_addresses(rows: DataFrame, addresses: DataFrame, max_entries: int = 0, key: str = "script_hash") -> DataFrame:
    """Entries of several addresses: each address gives at most ``max_entries`` in key order, the union is sorted by
    (height, transaction, index, address) and cut to ``max_entries``. An address named twice counts twice."""
    most = max_entries or DEFAULT_ENTRIES
    named = addresses.select(key, F.monotonically_increasing_id().alias("_nth"))
    own = Window.partitionBy("_nth").orderBy(*ORDER)
    each = rows.join(named, key).withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= most)
    return each.orderBy(*ORDER, key).limit(most).select(rows.columns)


def balances(unspent_rows: DataFrame, key: str = "address") -> DataFrame:
    return unspent_rows.groupBy(key).agg(F.count("*").alias("n_unspent"), F.sum("value_zat").alias("balance_zat"))


def history(outputs: DataFrame, spends: DataFrame, visible: DataFrame, epoch: int, key: str = "address", keys: Keys = Keys()) -> DataFrame:
    """Per address and visible height: what came in and what went out."""
    made = keys.seen(outputs.where(F.col("epoch") <= epoch), visible).dropDuplicates(keys.outpoint)
    gone = keys.seen(spends.where(F.col("epoch") <= epoch), visible).groupBy(*keys.outpoint).agg(F.min("height").alias("_spent"))
    both = made.select(*keys.outpoint, key, "height", "value_zat").join(gone, keys.outpoint, "left")  # outputs are shuffled once for both of their moves
    came, went = F.struct("height", F.col("value_zat").alias("delta")), F.struct(F.col("_spent").alias("height"), (-F.col("value_zat")).alias("delta"))
    moved = both.select(key, F.inline(F.when(F.col("_spent").isNotNull(), F.array(came, went)).otherwise(F.array(came))))
    return moved.groupBy(key, "height").agg(
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).alias("received_zat"),
        F.coalesce(F.sum(F.when(F.col("delta") < 0, -F.col("delta"))), F.lit(0)).alias("spent_zat"),
    )
