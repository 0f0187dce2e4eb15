"""Replies in the shape that light wallets expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidRequest, NotFound
from ledgerloom.functions import scalars
from ledgerloom.operators.reader import MAX_ROOTS, EpochReader
from ledgerloom.schema import NETWORKS, narrowed


def block(reader: EpochReader, height: int, block_hash: str | None = None, nullifiers_only: bool = False) -> DataFrame:
    """A compact block by height, if need be of a given hash; there is none at height 0."""
    if height <= 0 or height > reader.tip:
        raise NotFound(f"block {height}")
    found = reader.compact_blocks(height, height, nullifiers_only=nullifiers_only)
    if block_hash is not None and found.where(F.col("block_hash") == block_hash).isEmpty():
        raise NotFound(f"block {height} of that hash")
    return found


def shown_subtree_roots(rows: DataFrame) -> DataFrame:
    """Roots with their completing blocks."""
    return rows.select("root_hash", F.col("block_hash").alias("completing_block_hash"), F.col("height").alias("completing_block_height"))


def subtree_roots(reader: EpochReader, protocol: int, start: int, max_entries: int = 0) -> DataFrame:
    """A page of roots; 0 entries means the default number."""
    return shown_subtree_roots(reader.subtree_roots(protocol, start, max_entries or MAX_ROOTS))


def address_outputs(reader: EpochReader, addresses: DataFrame, start_height: int = 0, max_entries: int = 0) -> DataFrame:
    """Unspent outputs with values and ordinals checked to fit the reply's signed integers. Transaction ids keep their
    byte order here."""
    if max_entries < 0:
        raise InvalidRequest("max_entries is negative")
    rows = reader.address_outputs(addresses, start_height, max_entries)
    return rows.select("script_hash", "txid", narrowed(F.col("output_index"), "output index", 31).cast("int").alias("output_index"), "script", narrowed(F.col("value_zat"), "value", 63).alias("value_zat"), "height")


def shown_tree_states(rows: DataFrame, network: int) -> DataFrame:
    """Network, height, displayed hash, time and the final states of both trees."""
    payload = F.col("payload")
    return rows.select(F.lit(NETWORKS[network]).alias("network"), "height", scalars.display_hash(F.col("block_hash")).alias("hash"), scalars.tree_time(payload).alias("time"), scalars.final_state(payload, "sapling").alias("sapling_tree"), scalars.final_state(payload, "orchard").alias("orchard_tree"))


def tree_state(reader: EpochReader, height: int | None = None) -> DataFrame:
    return shown_tree_states(reader.tree_state(reader.tip if height is None else height), reader.pin["network"])


def server_info(reader: EpochReader, upgrades: DataFrame | None = None) -> DataFrame:
    """``upgrades`` (name, branch_id, activation_height) are those that the node names: the info has the sapling one's height
    and the branch id in force at the tip, zeros if unknown."""
    names = F.create_map(*[F.lit(x) for pair in NETWORKS.items() for x in pair])
    spark = reader.tables["chain_epoch"].sparkSession
    upgrades = spark.createDataFrame([], "name STRING, branch_id STRING, activation_height BIGINT") if upgrades is None else upgrades
    reached = F.col("activation_height") <= reader.tip
    known = upgrades.agg(F.max(F.when(F.lower("name") == "sapling", F.col("activation_height"))).alias("sapling"), F.max_by(F.when(reached, F.lower("branch_id")), F.when(reached, F.col("activation_height"))).alias("branch"))
    return reader.info().join(known).select(
        names[F.col("network")].alias("chain_name"), F.col("tip_height").alias("block_height"), F.col("tip_height").alias("estimated_height"), F.lit("ledgerloom").alias("vendor"), F.lit(True).alias("taddr_support"),
        F.coalesce("sapling", F.lit(0).cast("bigint")).alias("sapling_activation_height"), F.coalesce("branch", F.lit("00000000")).alias("consensus_branch_id"),
    )
