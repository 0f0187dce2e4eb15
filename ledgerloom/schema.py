"""Schemas of the ledger tables and the limits of their values.

Heights, sequences and counts of the ledger are unsigned 32- or 64-bit integers and are held as BIGINT; identifiers of
32 bytes are lower-case hex text of 64 characters in the analytic tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U32_MAX = (1 << 32) - 1
#: Leaves of a completed subtree of either note-commitment tree.
SUBTREE_LEAVES = 1 << 16
STORE_SCHEMA_VERSION, ARTIFACT_SCHEMA_VERSION = 1, 2
#: Networks by persistent id; protocols of shielded pools by id.
NETWORKS = {1: "zcash-mainnet", 2: "zcash-testnet", 3: "zcash-regtest"}
PROTOCOLS = {1: "sapling", 2: "orchard"}


_DDL = {
    "chain_epoch": "epoch BIGINT, network INT, tip_height BIGINT, tip_hash STRING, finalized_height BIGINT, finalized_hash STRING, artifact_schema_version INT, created_at_millis BIGINT, sapling_tree_size BIGINT, orchard_tree_size BIGINT",
    "block": "epoch BIGINT, height BIGINT, block_hash STRING, parent_hash STRING, payload BINARY",
    "compact_block": "epoch BIGINT, height BIGINT, block_hash STRING, vtx ARRAY<STRUCT<index: BIGINT, txid: STRING, spends: ARRAY<STRING>, outputs: ARRAY<STRUCT<cmu: STRING, ephemeralKey: STRING, ciphertext: BINARY>>, actions: ARRAY<STRUCT<nullifier: STRING, cmx: STRING, ephemeralKey: STRING, ciphertext: BINARY>>, vin: ARRAY<STRUCT<txid: STRING, output_index: BIGINT>>, vout: ARRAY<STRUCT<value_zat: BIGINT, script: STRING>>>>",
    "transaction": "epoch BIGINT, txid STRING, height BIGINT, block_hash STRING, payload BINARY",
    "tree_state": "epoch BIGINT, height BIGINT, block_hash STRING, payload STRING",
    "subtree_root": "epoch BIGINT, protocol INT, subtree_index BIGINT, root_hash STRING, height BIGINT, block_hash STRING",
    "utxo": "epoch BIGINT, script_hash STRING, script STRING, txid STRING, output_index BIGINT, value_zat BIGINT, height BIGINT, block_hash STRING",
    "utxo_spend": "epoch BIGINT, txid STRING, output_index BIGINT, height BIGINT, block_hash STRING",
    "chain_event": "sequence BIGINT, epoch BIGINT, event_kind STRING, start_height BIGINT, end_height BIGINT, reverted_epoch BIGINT, reverted_start BIGINT, reverted_end BIGINT, tip_height BIGINT, tip_hash STRING, finalized_height BIGINT, created_at_millis BIGINT",
}
#: The artifact families that a commit may hold.
FAMILIES = ("block", "compact_block", "transaction", "tree_state", "subtree_root", "utxo", "utxo_spend")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


def ddl(name: str) -> str:
    return _DDL[name]


def is_identifier(column: Column) -> Column:
    """32 bytes as lower-case hex."""
    return column.rlike("^[0-9a-f]{64}$")


def narrowed(column: Column, name: str, bits: int = 32) -> Column:
    """``column`` checked to fit an unsigned integer of ``bits``; the job fails on others."""
    most = (1 << min(bits, 63)) - 1
    return F.when(column.isNull() | column.between(0, most), column).otherwise(F.raise_error(F.concat(F.lit(f"data loss: {name} out of range: "), column.cast("string"))))


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of table ``name`` (or of a DDL text) in its order and types; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(_DDL.get(name, name)).fields])
