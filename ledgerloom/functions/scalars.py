"""Functions of single values: byte order, prefixes, tree states, reply codes, saturating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import SUBTREE_LEAVES, U32_MAX

#: Bytes of a compact output's ciphertext.
CIPHERTEXT_BYTES = 52
#: Codes of broadcast outcomes.
BROADCAST_CODES = {"accepted": 0, "invalid_encoding": -22, "rejected": -26, "duplicate": -27, "unknown": -1}


def display_hash(hex_text: Column) -> Column:
    """The byte-reversed form in which hashes are shown."""
    bytes_ = F.transform(F.sequence(F.lit(1), (F.length(hex_text) / 2).cast("int")), lambda k: F.substring(hex_text, k * 2 - 1, F.lit(2)))
    return F.array_join(F.reverse(bytes_), "")


def completed_subtrees(tree_size: Column) -> Column:
    return F.floor(tree_size / SUBTREE_LEAVES).cast("bigint")


def saturating_lag(writer: Column, reader: Column) -> Column:
    """How far a reader is behind; never negative."""
    return F.greatest(writer - reader, F.lit(0))


def prefix(payload: Column, size: int = CIPHERTEXT_BYTES) -> Column:
    """The first ``size`` bytes; a shorter value fails the job."""
    return F.when(F.octet_length(payload) >= size, F.substring(payload, 1, size)).otherwise(F.raise_error(F.lit("data loss: ciphertext is too short")))


def broadcast_code(outcome: Column, node_code: Column | None = None) -> Column:
    """The code of an outcome; one that the node gave wins."""
    code = F.lit(BROADCAST_CODES["unknown"])
    for name, value in BROADCAST_CODES.items():
        code = F.when(outcome == name, F.lit(value)).otherwise(code)
    return code.cast("int") if node_code is None else F.coalesce(node_code.cast("int"), code.cast("int"))


def classify_broadcast(failed: Column, code: Column) -> Column:
    """The outcome of a broadcast from the node's answer: whether it failed and with which code."""
    known = F.when(code == BROADCAST_CODES["invalid_encoding"], "invalid_encoding").when(code == BROADCAST_CODES["duplicate"], "duplicate")
    return F.when(~failed, "accepted").otherwise(known.when(code.isNotNull(), "rejected").otherwise("unknown"))


def _kind(value: Column) -> Column:
    return F.substring(F.ltrim(value), 1, 1)


def final_state(payload: Column, pool: str) -> Column:
    """``{pool}.commitments.finalState`` of a tree-state document: empty if the pool, its commitments or their content
    are absent; other shapes fail the job."""
    whole, commitments = F.get_json_object(payload, f"$.{pool}"), F.get_json_object(payload, f"$.{pool}.commitments")
    state = F.get_json_object(payload, f"$.{pool}.commitments.finalState")
    named = F.array_contains(F.json_object_keys(payload), pool)
    wrong = F.raise_error(F.lit(f"data loss: {pool} has an unexpected shape"))
    inner = F.array_contains(F.json_object_keys(whole), "commitments")
    return (
        F.when(~F.coalesce(named, F.lit(False)), F.lit("")).when(whole.isNull() | (_kind(whole) != "{"), wrong.cast("string")).when(~F.coalesce(inner, F.lit(False)), F.lit(""))
        .when(commitments.isNull() | (_kind(commitments) != "{"), wrong.cast("string")).when(state.isNotNull(), state)
        .when(F.size(F.json_object_keys(commitments)) == 0, F.lit("")).otherwise(wrong.cast("string"))
    )


def _integer(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def tree_time(payload: Column) -> Column:
    """The required ``time`` of a tree-state document: an unsigned 32-bit integer, else the job fails."""
    number = _integer(F.get_json_object(payload, "$.time"))
    return F.when(number.between(0, U32_MAX), number).otherwise(F.raise_error(F.lit("data loss: time is missing or out of range")).cast("bigint"))


def observed_size(payload: Column, pool: str) -> Column:
    """The tree size that a node reported, as an integer or its digits, by any of three paths; 0 for an empty tree; null
    if unknown. A size of another kind fails the job."""
    size = F.coalesce(*[F.get_json_object(payload, f"$.{path}") for path in (f"{pool}.commitments.size", f"{pool}.size", f"trees.{pool}.size")])
    number = F.when(_integer(size).between(0, U32_MAX), _integer(size)).otherwise(F.raise_error(F.lit(f"data loss: {pool} size is not an unsigned integer")).cast("bigint"))
    commitments = F.get_json_object(payload, f"$.{pool}.commitments")
    state = F.get_json_object(payload, f"$.{pool}.commitments.finalState")
    empty = (F.size(F.json_object_keys(commitments)) == 0) | state.isin("", "000000")
    return F.when(size.isNotNull(), number).when(empty, F.lit(0).cast("bigint"))
