"""Reshaping of nested compact blocks: pool selection, nullifiers only, projection into artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidRequest
from ledgerloom.functions.scalars import CIPHERTEXT_BYTES, prefix

POOLS = ("transparent", "sapling", "orchard")
#: Arrays of a compact transaction by pool.
ARRAYS = {"transparent": ("vin", "vout"), "sapling": ("spends", "outputs"), "orchard": ("actions",)}


def selected_pools(pools: list[str] | None) -> set[str]:
    """No pool named means the shielded ones; an unknown one is an invalid request."""
    wanted = set(pools or ("sapling", "orchard"))
    if unknown := wanted - set(POOLS):
        raise InvalidRequest(f"unknown pools: {sorted(unknown)}")
    return wanted


def _emptied(tx: Column, name: str) -> Column:
    return tx.withField(name, F.slice(tx[name], 1, 0))


def has_payload(tx: Column) -> Column:
    names = [n for own in ARRAYS.values() for n in own]
    filled = F.lit(False)
    for n in names:
        filled = filled | (F.coalesce(F.size(tx[n]), F.lit(0)) > 0)
    return filled


def prune(vtx: Column, pools: list[str] | None = None) -> Column:
    """Arrays of other pools are emptied, then transactions without any content are dropped."""
    off = [n for pool in POOLS if pool not in selected_pools(pools) for n in ARRAYS[pool]]

    def one(tx: Column) -> Column:
        for n in off:
            tx = _emptied(tx, n)
        return tx

    return F.filter(F.transform(vtx, one), has_payload)


def nullifiers_only(vtx: Column) -> Column:
    """Nullifiers of spends and actions alone; what else an action or a transaction holds is blanked or emptied."""

    def blank(action: Column) -> Column:
        return action.withField("cmx", F.lit("")).withField("ephemeralKey", F.lit("")).withField("ciphertext", F.lit(b""))

    def one(tx: Column) -> Column:
        for n in ("outputs", "vin", "vout"):
            tx = _emptied(tx, n)
        return tx.withField("actions", F.transform(tx["actions"], blank))

    return F.filter(F.transform(vtx, one), has_payload)


def compacted(txs: Column) -> Column:
    """Parsed transactions to compact ones: ordinals, ciphertext prefixes, no coinbase inputs, none without content."""

    def cut(note: Column) -> Column:
        return note.withField("ciphertext", prefix(note["ciphertext"], CIPHERTEXT_BYTES))

    def one(tx: Column, k: Column) -> Column:
        return tx.withField("index", k.cast("bigint")).withField("outputs", F.transform(tx["outputs"], cut)).withField("actions", F.transform(tx["actions"], cut)).withField("vin", F.filter(tx["vin"], lambda v: v["txid"].isNotNull()))

    return F.filter(F.transform(txs, one), has_payload)


def transparent_outputs(blocks: DataFrame) -> DataFrame:
    """An unspent-output row for each transparent output of ``vtx``; the script's hash is its address."""
    tx = blocks.select("epoch", "height", "block_hash", F.explode("vtx").alias("tx"))
    out = tx.select("epoch", "height", "block_hash", F.col("tx.txid").alias("txid"), F.posexplode("tx.vout").alias("output_index", "out"))
    return out.select("epoch", F.sha2(F.unhex("out.script"), 256).alias("script_hash"), F.col("out.script").alias("script"), "txid", F.col("output_index").cast("bigint").alias("output_index"), F.col("out.value_zat").alias("value_zat"), "height", "block_hash")


def transparent_spends(blocks: DataFrame) -> DataFrame:
    tx = blocks.select("epoch", "height", "block_hash", F.explode("vtx").alias("tx"))
    return tx.select("epoch", F.explode("tx.vin").alias("i"), "height", "block_hash").select("epoch", F.col("i.txid").alias("txid"), F.col("i.output_index").alias("output_index"), "height", "block_hash")


def tree_additions(blocks: DataFrame, *keep: str) -> DataFrame:
    """Notes that each block adds to the sapling and orchard trees, with the columns ``keep``."""
    count = lambda name: F.aggregate("vtx", F.lit(0).cast("bigint"), lambda n, tx: n + F.coalesce(F.size(tx[name]), F.lit(0)))
    return blocks.select(*keep, "height", count("outputs").alias("sapling"), count("actions").alias("orchard"))


def transaction_at(blocks: DataFrame, height: int, index: int) -> DataFrame:
    """The transaction whose own ordinal is ``index``; those without content are not addressable."""
    tx = blocks.where(F.col("height") == height).select("height", "block_hash", F.explode("vtx").alias("tx"))
    return tx.where(F.col("tx.index") == index).select("height", "block_hash", "tx.*")
