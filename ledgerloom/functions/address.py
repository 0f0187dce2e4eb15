"""Transparent addresses to scripts, checked against the network."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidRequest

# Fixed values of base58check and of address prefixes: (networks, template of the script).
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
PREFIXES = {
    bytes.fromhex("1cb8"): (("zcash-mainnet",), "76a914{}88ac"),
    bytes.fromhex("1cbd"): (("zcash-mainnet",), "a914{}87"),
    bytes.fromhex("1d25"): (("zcash-testnet", "zcash-regtest"), "76a914{}88ac"),
    bytes.fromhex("1cba"): (("zcash-testnet", "zcash-regtest"), "a914{}87"),
}


def decode58(text: str) -> bytes:
    """The payload of a base58check text."""
    number = 0
    for c in text:
        place = ALPHABET.find(c)
        if place < 0:
            raise InvalidRequest("address holds a character that base58 lacks")
        number = number * 58 + place
    zeros = len(text) - len(text.lstrip("1"))
    raw = b"\x00" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")
    if len(raw) < 5 or hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] != raw[-4:]:
        raise InvalidRequest("address checksum is wrong")
    return raw[:-4]


def encode58(payload: bytes) -> str:
    raw = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    number, out = int.from_bytes(raw, "big"), ""
    while number:
        number, rest = divmod(number, 58)
        out = ALPHABET[rest] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\x00"))) + out


def script_of(address: str, network: str) -> str:
    """The output script, in hex, that pays to ``address`` on ``network``."""
    payload = decode58(address)
    networks, script = PREFIXES.get(payload[:2], ((), ""))
    if len(payload) != 22 or network not in networks:
        raise InvalidRequest("address is of another kind or network")
    return script.format(payload[2:].hex())


def script_column(address: Column, network: str) -> Column:
    """Scripts of a column of addresses; null for what is not an address of the network."""

    @F.pandas_udf("string")
    def scripts(addresses: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else script_of(text, network)
            except InvalidRequest:
                return None

        return addresses.map(one)

    return scripts(address)
