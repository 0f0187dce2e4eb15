"""Blocks of a node as a Spark data source, for batches and streams.

The connector reads one JSON document for each height through a ``fetch`` function named by an import path (for a
folder of files: ``height``.json), checks what the node says against what was asked for, and retries what may pass.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerloom.errors import DataLoss, InvalidRequest
from ledgerloom.schema import PROTOCOLS

SCHEMA = "network STRING, height BIGINT, block_hash STRING, parent_hash STRING, time BIGINT, raw_hex STRING, tree_state STRING"
#: Attempts of a request, first and longest pause between them in seconds.
ATTEMPTS, PAUSE, LONGEST = 5, 0.25, 5.0


class Retryable(Exception):
    """A failure that may pass."""


def with_retry(request: Callable[[], Any], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Any:
    pause = PAUSE
    for attempt in range(1, attempts + 1):
        try:
            return request()
        except Retryable:
            if attempt == attempts:
                raise
            sleep(pause)
            pause = min(2 * pause, LONGEST)


class Folder:
    """A node's blocks as files ``<height>.json`` of a folder that every executor reaches."""

    def __init__(self, path: str):
        self.path = path

    def block(self, height: int) -> dict:
        try:
            with open(f"{self.path}/{height}.json", encoding="utf-8") as file:
                return json.load(file)
        except FileNotFoundError as missing:
            raise Retryable(f"no block {height} yet") from missing

    def tip(self) -> int:
        import os

        return max((int(n.split(".")[0]) for n in os.listdir(self.path) if n.endswith(".json") and n.split(".")[0].isdigit()), default=0)


def source_row(document: dict, height: int, network: str) -> tuple:
    """A row of a node's document, which must be of the height, network and form that were asked for."""
    hashes = [document.get("hash"), document.get("previousblockhash")]
    if document.get("height") != height or document.get("network", network) != network:
        raise DataLoss(f"node answered for another block than {height}")
    if any(not isinstance(h, str) or len(h) != 64 for h in hashes) or not 0 <= int(document.get("time", -1)) < 1 << 32:
        raise DataLoss(f"block {height} has a malformed header")
    state = document.get("tree_state")
    return network, height, *hashes, int(document["time"]), document.get("raw_block_hex"), None if state is None else json.dumps(state)


def subtree_rows(document: dict, protocol: int, start: int) -> list[tuple[int, str, int]]:
    """(subtree_index, root_hash, height) of a node's reply about completed subtrees, which must be of the pool and start that
    were asked for."""
    if document.get("pool") != PROTOCOLS[protocol] or document.get("start_index") != start:
        raise DataLoss("node answered for other subtrees")
    found = [(start + k, s.get("root"), s.get("end_height")) for k, s in enumerate(document.get("subtrees", []))]
    if any(not isinstance(root, str) or len(root) != 64 or not isinstance(height, int) for _, root, height in found):
        raise DataLoss("a subtree root is malformed")
    return found


def upgrade_rows(document: dict) -> list[tuple[str, str, int]]:
    """(name, branch_id, activation_height) of the upgrades in a node's reply about its chain."""
    return [(u["name"], branch, int(u["activationheight"])) for branch, u in sorted(document.get("upgrades", {}).items())]


#: Methods of a node and what they let it be asked for; a node that does not describe itself is trusted with all but the first.
METHODS = {"rpc.discover": "describe", "getblock": "block", "getblockchaininfo": "tip", "z_gettreestate": "tree_state", "z_getsubtreesbyindex": "subtree_roots", "sendrawtransaction": "broadcast"}


def node_capabilities(document: dict | None) -> set[str]:
    """What a node offers, by its own description of its methods (null: it gives none)."""
    if document is None:
        return set(METHODS.values()) - {"describe"}
    return {METHODS[m["name"]] for m in document.get("methods", []) if m.get("name") in METHODS} | {"describe"}


class _Heights(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _node(options: dict[str, str]):
    module, _, name = options.get("node", "ledgerloom.sources.node:Folder").partition(":")
    return getattr(importlib.import_module(module), name)(options["path"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.start, self.end = int(options.get("start", 1)), int(options["end"]) if "end" in options else None
        if self.end is not None and self.start > self.end:
            raise InvalidRequest("start is above end")

    def ranges(self, start: int, end: int) -> list[InputPartition]:
        size = int(self.options.get("heights_per_task", 1000))
        return [_Heights(a, min(a + size - 1, end)) for a in range(start, end + 1, size)]

    def partitions(self) -> list[InputPartition]:
        return self.ranges(self.start, self.end if self.end is not None else _node(self.options).tip())

    def read(self, partition: _Heights) -> Iterator[tuple]:
        node, network = _node(self.options), self.options.get("network", "zcash-regtest")
        for height in range(partition.start, partition.end + 1):
            yield source_row(with_retry(lambda h=height: node.block(h)), height, network)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.inner = _Reader(options)

    def initialOffset(self) -> dict:
        return {"height": self.inner.start - 1}

    def latestOffset(self) -> dict:
        return {"height": max(_node(self.inner.options).tip(), self.inner.start - 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.inner.ranges(start["height"] + 1, end["height"])

    def read(self, partition: _Heights) -> Iterator[tuple]:
        return self.inner.read(partition)


class NodeBlocks(DataSource):
    """Format ``node_blocks``; options: path, network, start, end, heights_per_task, node."""

    @classmethod
    def name(cls) -> str:
        return "node_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
