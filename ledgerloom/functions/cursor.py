"""Opaque event cursors: a position in the change log, bound to its snapshot and signed.

Layout (82 bytes, big-endian): version 1, network 4, sequence 8, tip height 4, tip hash 32, flags 1, HMAC-SHA256 32. The
key belongs to one store, so a cursor of another store or a changed one does not verify.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import struct
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidRequest

VERSION, SIZE = 1, 82
TIP, FINALIZED = 0, 1
_HEAD = struct.Struct(">BIQI32sB")


class Position(NamedTuple):
    network: int
    sequence: int
    tip_height: int
    tip_hash: str
    family: int


def encode(key: bytes, at: Position) -> bytes:
    head = _HEAD.pack(VERSION, at.network, at.sequence, at.tip_height, bytes.fromhex(at.tip_hash), at.family)
    return head + hmac.digest(key, head, hashlib.sha256)


def decode(key: bytes, network: int, token: bytes) -> Position:
    """The position of a token of this store and network; anything else is an invalid request."""
    if len(token) != SIZE:
        raise InvalidRequest("cursor has a wrong length")
    head, signature = token[: _HEAD.size], token[_HEAD.size :]
    if not hmac.compare_digest(hmac.digest(key, head, hashlib.sha256), signature):
        raise InvalidRequest("cursor does not verify")
    version, own, sequence, height, tip, family = _HEAD.unpack(head)
    if version != VERSION or family not in (TIP, FINALIZED):
        raise InvalidRequest("cursor of an unknown version or family")
    if own != network:
        raise InvalidRequest("cursor of another network")
    return Position(own, sequence, height, tip.hex(), family)


def to_text(token: bytes) -> str:
    """URL-safe base64 without padding."""
    return base64.urlsafe_b64encode(token).rstrip(b"=").decode()


def from_text(text: str) -> bytes:
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except ValueError as wrong:
        raise InvalidRequest("cursor is not base64") from wrong


def cursor_column(key: bytes, network: int, family: int = TIP) -> Column:
    """Cursors of rows with sequence, tip_height and tip_hash."""

    @F.pandas_udf("binary")
    def sign(sequence: pd.Series, height: pd.Series, tip: pd.Series) -> pd.Series:
        return pd.Series([encode(key, Position(network, int(s), int(h), t, family)) for s, h, t in zip(sequence, height, tip, strict=True)])

    return sign("sequence", "tip_height", "tip_hash")
