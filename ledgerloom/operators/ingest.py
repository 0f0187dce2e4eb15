"""Parsed blocks to the artifacts of a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import CommitRejected, DataLoss
from ledgerloom.functions import compact
from ledgerloom.functions.scalars import completed_subtrees, observed_size
from ledgerloom.operators.derive import running_sums
from ledgerloom.schema import PROTOCOLS, SUBTREE_LEAVES, U32_MAX


def tree_sizes(blocks: DataFrame, sapling: int = 0, orchard: int = 0) -> DataFrame:
    """(height, sapling, orchard): tree sizes after each block, from the sizes before the first. Sizes past 32 bits fail
    the job."""
    return summed_sizes(compact.tree_additions(blocks), sapling, orchard)


def summed_sizes(additions: DataFrame, sapling: int = 0, orchard: int = 0) -> DataFrame:
    """``tree_sizes`` from what each block adds (height, sapling, orchard)."""
    sums = running_sums(additions, "height", ["sapling", "orchard"])

    def size(name: str, before: int) -> Column:
        total = F.col(name) + before
        return F.when(total <= U32_MAX, total).otherwise(F.raise_error(F.lit(f"data loss: {name} tree size overflows")).cast("bigint")).alias(name)

    return sums.select("height", size("sapling", sapling), size("orchard", orchard))


def check_observed_sizes(sizes: DataFrame, tree_states: DataFrame) -> None:
    """Sizes that a node reported (``payload`` by height) must be the ones that the blocks add up to."""
    seen = tree_states.select("height", *[observed_size(F.col("payload"), p).alias(f"seen_{p}") for p in PROTOCOLS.values()])
    wrong = sizes.join(seen, "height").where(" OR ".join(f"(seen_{p} IS NOT NULL AND seen_{p} <> {p})" for p in PROTOCOLS.values())).first()
    if wrong is not None:
        raise DataLoss(f"tree sizes at height {wrong['height']} differ from the node's")


def build_artifacts(parsed: DataFrame, tree_states: DataFrame | None = None, sapling: int = 0, orchard: int = 0, sizes: DataFrame | None = None, outer: DataFrame | None = None) -> dict[str, DataFrame]:
    """Families of a commit from parsed blocks: epoch, height, block_hash, parent_hash, payload and vtx (full
    transactions in their order). ``tree_states`` has height and payload. ``sizes`` are their tree sizes if known; ``outer`` has
    the same blocks with no more than txid, vin and vout."""
    outer = parsed if outer is None else outer
    blocks = parsed.withColumn("vtx", compact.compacted(F.col("vtx")))
    raw = outer.select("epoch", "height", "block_hash", F.explode("vtx").alias("tx"))
    out = {
        "block": parsed.select("epoch", "height", "block_hash", "parent_hash", "payload"),
        "compact_block": blocks.select("epoch", "height", "block_hash", "vtx"),
        "transaction": raw.select("epoch", F.col("tx.txid").alias("txid"), "height", "block_hash", F.lit(None).cast("binary").alias("payload")),
        "utxo": compact.transparent_outputs(outer),
        "utxo_spend": compact.transparent_spends(outer).where("txid IS NOT NULL"),
    }
    if tree_states is not None:
        check_observed_sizes(tree_sizes(blocks, sapling, orchard) if sizes is None else sizes, tree_states)
        out["tree_state"] = parsed.select("epoch", "height", "block_hash").join(tree_states.select("height", "payload"), "height")
    return out


def fill_subtree_roots(roots: DataFrame, blocks: DataFrame, sizes: DataFrame, protocol: int, before: int) -> DataFrame:
    """Rows of the subtrees that ``blocks`` complete: ``roots`` (subtree_index, root_hash, height) of a node, each with the
    hash of its completing block. Too few roots, or one completed outside the batch, reject the commit."""
    name = PROTOCOLS[protocol]
    after = sizes.agg(F.max(completed_subtrees(F.col(name)))).first()[0] or 0
    first = before // SUBTREE_LEAVES
    wanted = roots.where(F.col("subtree_index").between(first, after - 1))
    found = wanted.join(blocks.select("epoch", "height", "block_hash"), "height").select("epoch", F.lit(protocol).alias("protocol"), "subtree_index", "root_hash", "height", "block_hash")
    if found.count() < max(after - first, 0):
        raise CommitRejected("subtree_roots", "a completed subtree has no root in the batch")
    return found
