"""Reads pinned to one snapshot.

A missing row means different things: above the tip there is nothing (an empty result); at or below it a missing block,
compact block or tree state is an error (``NotFound``); an unknown transaction is an empty result; subtree roots past
the completed ones are an empty result, missing ones before that an error. Requests that are wrong in themselves raise
``InvalidRequest`` before any job runs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.errors import FailedPrecondition, InvalidRequest, NotFound
from ledgerloom.functions import compact
from ledgerloom.operators import utxo
from ledgerloom.operators.visibility import as_of, missing_heights, off_branch, on_branch, visible_blocks, without_blocks
from ledgerloom.schema import PROTOCOLS, SUBTREE_LEAVES

#: Blocks, roots and events of a reply, at most.
MAX_BLOCKS, MAX_ROOTS = 1000, 1000
# Names of what a reader can be asked for.
CAPABILITIES = (
    "wallet.read.latest_block_v1", "wallet.read.compact_block_at_v1", "wallet.read.compact_block_range_v1", "wallet.read.tree_state_at_v1",
    "wallet.read.latest_tree_state_v1", "wallet.read.subtree_roots_in_range_v1", "wallet.read.transaction_by_id_v1", "wallet.read.server_info_v1", "wallet.events.chain_v1",
)


class EpochReader:
    """``tables`` has the append-only tables by name; ``pin`` is a row of ``chain_epoch``."""

    def __init__(self, tables: Mapping[str, DataFrame], pin: Row):
        self.tables, self.pin = tables, pin
        self.epoch, self.tip = pin["epoch"], pin["tip_height"]

    @classmethod
    def open(cls, tables: Mapping[str, DataFrame], pin: int | Row | None = None) -> EpochReader:
        """The current epoch, an epoch by id, or a pinned epoch, each field of which must equal the stored one."""
        epochs = tables["chain_epoch"]
        if pin is None:
            found = epochs.orderBy(F.desc("epoch")).first()
            if found is None:
                raise FailedPrecondition("no visible epoch")
            return cls(tables, found)
        found = epochs.where(F.col("epoch") == (pin if isinstance(pin, int) else pin["epoch"])).first()
        if found is None:
            raise FailedPrecondition("pinned epoch is unavailable")
        if isinstance(pin, Row) and pin.asDict() != found.asDict():
            raise FailedPrecondition("pinned epoch does not match the stored one")
        return cls(tables, found)

    def visible(self) -> DataFrame:
        return visible_blocks(self.tables["block"].drop("payload"), self.epoch, self.tip)

    def off(self) -> DataFrame:
        """Blocks committed up to this epoch that it does not see. A commit's artifacts are checked to be of its blocks."""
        return off_branch(self.tables["block"].where(F.col("epoch") <= self.epoch), self.visible(), ["height", "block_hash"])

    def latest_block(self) -> Row:
        return Row(height=self.tip, block_hash=self.pin["tip_hash"])

    def _at(self, table: str, height: int) -> DataFrame:
        rows = self.tables[table]
        if height > self.tip:
            return rows.limit(0)
        found = as_of(rows.where(F.col("height") == height), ["height"], self.epoch)
        if found.isEmpty():
            raise NotFound(f"{table} {height}")
        return found

    def block(self, height: int) -> DataFrame:
        return self._at("block", height)

    def compact_block(self, height: int) -> DataFrame:
        return self._at("compact_block", height)

    def compact_blocks(self, start: int, end: int, pools: list[str] | None = None, nullifiers_only: bool = False, cap: int | None = MAX_BLOCKS, ordered: bool = True) -> DataFrame:
        """Blocks start..end in order; a gap fails the whole range. With start > end the order is descending when the
        caller allows it by ``descending_blocks``. Not ``ordered``, blocks stay in their files' order and none is shuffled."""
        if start > end:
            raise InvalidRequest("start is above end")
        if cap is not None and end - start + 1 > cap:
            raise InvalidRequest(f"range of more than {cap} blocks")
        shape = compact.nullifiers_only if nullifiers_only else (lambda vtx: compact.prune(vtx, pools)) if pools is not None else None
        if pools is not None:
            compact.selected_pools(pools)
        rows = self.tables["compact_block"].where(F.col("height").between(start, min(end, self.tip)) & (F.col("epoch") <= self.epoch))
        found = without_blocks(rows, self.off(), ["height", "block_hash"])
        gap = missing_heights(found, start, end).agg(F.min("height")).first()[0]
        if gap is not None:
            raise NotFound(f"compact_block {gap}")
        shaped = found if shape is None else found.withColumn("vtx", shape(F.col("vtx")))
        return shaped.orderBy("height") if ordered else shaped

    def descending_blocks(self, first: int, last: int, **how) -> DataFrame:
        """Blocks from the higher bound down to the lower one."""
        return self.compact_blocks(min(first, last), max(first, last), **how).orderBy(F.desc("height"))

    def transaction(self, txid: str) -> DataFrame:
        """The newest version of a transaction if its block is visible; no older version takes its place."""
        newest = as_of(self.tables["transaction"].where(F.col("txid") == txid), ["txid"], self.epoch)
        return on_branch(newest, self.visible())

    def transaction_at(self, height: int, index: int) -> DataFrame:
        found = compact.transaction_at(self.compact_block(height), height, index).select("txid").first()
        return self.tables["transaction"].limit(0) if found is None else self.transaction(found["txid"])

    def positions(self) -> DataFrame:
        """(height, tx_index, txid) of every visible transaction that compact blocks hold; its index is its own ordinal."""
        blocks = self.tables["compact_block"].where((F.col("height") <= self.tip) & (F.col("epoch") <= self.epoch))
        placed = without_blocks(blocks, self.off(), ["height", "block_hash"]).select("height", F.explode("vtx").alias("tx"))
        newest = on_branch(as_of(self.tables["transaction"], ["txid"], self.epoch), self.visible()).select("txid", "height")
        return placed.select("height", F.col("tx.index").alias("tx_index"), F.col("tx.txid").alias("txid")).join(newest, ["txid", "height"]).select("height", "tx_index", "txid")

    def status(self, txid: str) -> str:
        return "NotFound" if self.transaction(txid).isEmpty() else "Mined"

    def tree_state(self, height: int) -> DataFrame:
        found = self._at("tree_state", height)
        if height <= self.tip and on_branch(found, self.visible()).isEmpty():
            raise NotFound(f"tree_state {height}")
        return found

    def tree_states(self, start: int, end: int) -> DataFrame:
        """The visible tree states of start..end, up to the tip."""
        rows = self.tables["tree_state"].where(F.col("height").between(start, min(end, self.tip)))
        return on_branch(as_of(rows, ["height"], self.epoch), self.visible())

    def latest_tree_state(self) -> DataFrame:
        return self.tree_state(self.tip)

    def subtree_roots(self, protocol: int, start: int, max_entries: int | None = MAX_ROOTS) -> DataFrame:
        """Completed roots from ``start`` on; without ``max_entries`` all of them."""
        if protocol not in PROTOCOLS:
            raise InvalidRequest("unknown protocol")
        if (max_entries is not None and max_entries <= 0) or start < 0:
            raise InvalidRequest("max_entries must be positive")
        completed = self.pin[f"{PROTOCOLS[protocol]}_tree_size"] // SUBTREE_LEAVES
        wanted = completed - start if max_entries is None else min(completed - start, max_entries)
        rows = self.tables["subtree_root"]
        if wanted <= 0:
            return rows.limit(0)
        own = rows.where((F.col("protocol") == protocol) & F.col("subtree_index").between(start, start + wanted - 1))
        found = on_branch(as_of(own, ["protocol", "subtree_index"], self.epoch), self.visible())
        if found.count() < wanted:
            raise NotFound("subtree_root")
        return found.orderBy("subtree_index")

    def unspent_outputs(self, script_hash: str | None = None, start_height: int = 0, max_entries: int | None = None) -> DataFrame:
        rows = self.tables["utxo"]
        rows = rows if script_hash is None else rows.where(F.col("script_hash") == script_hash)
        left = utxo.unspent(rows, self.tables["utxo_spend"], self.visible(), self.epoch, start_height, utxo.Keys(off=self.off()))
        return left if max_entries is None else utxo.page(left, max_entries)

    def address_outputs(self, addresses: DataFrame, start_height: int = 0, max_entries: int = 0) -> DataFrame:
        """Unspent outputs of several addresses (script_hash), all at this snapshot."""
        wanted = self.tables["utxo"].join(addresses.select("script_hash").distinct(), "script_hash", "left_semi")
        left = utxo.unspent(wanted, self.tables["utxo_spend"], self.visible(), self.epoch, start_height, utxo.Keys(off=self.off()))
        return utxo.for_addresses(left, addresses, max_entries)

    def balances(self) -> DataFrame:
        return utxo.balances(self.unspent_outputs(), "script_hash")

    def info(self) -> DataFrame:
        return self.tables["chain_epoch"].where(F.col("epoch") == self.epoch).select("network", "epoch", "tip_height", "artifact_schema_version", F.lit(MAX_BLOCKS).alias("max_blocks"), F.lit(MAX_ROOTS).alias("max_roots"), F.array(*map(F.lit, CAPABILITIES)).alias("capabilities"))
