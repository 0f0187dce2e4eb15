"""A store of append-only Parquet tables whose only commit point is one manifest file.

A commit stages its rows in folders of their own, checks what it has staged and then creates ``epochs/<id>.json``, which
names them; the file is created without overwriting, so of two writers that race one fails and leaves only unnamed
folders. Readers take the manifests up to an epoch, as one table, and of each family the rows of the commits that they
name, so a snapshot never changes under them. A manifest also holds the commit's event: the manifests are the change
log, which a stream can tail. Files are reached through Hadoop's file systems, as Spark reaches its own.

A store with a packing keeps families in a shorter form: a commit writes one table of packed rows, and its families are
made of them where they are checked and read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import CommitRejected, FailedPrecondition
from ledgerloom.functions import compact
from ledgerloom.operators.commit import Change, check_commit, checked_schema
from ledgerloom.operators.reader import EpochReader
from ledgerloom.schema import FAMILIES, STORE_SCHEMA_VERSION, conform, ddl, schema
from ledgerloom.streaming.events import history, retention_floor

#: The folder of packed rows.
PACKED = "packed"
#: Columns that the files of a family are sorted by.
SORTED = {"block": ["height"], "compact_block": ["height"], "transaction": ["txid"], "tree_state": ["height"], "subtree_root": ["protocol", "subtree_index"], "utxo": ["script_hash", "height", "txid", "output_index"], "utxo_spend": ["txid", "output_index"], PACKED: ["height"]}


MANIFEST = f"commit STRING, families ARRAY<STRING>, previous BIGINT, chain_epoch STRUCT<{ddl('chain_epoch')}>, event STRUCT<{ddl('chain_event')}>"


@dataclass(frozen=True)
class Packing:
    """A shorter form of families: ``columns`` of its rows (epoch and height are among them), how each family is made of
    them, and blocks with height and vtx of no more than outputs and actions, of any content, from which notes are counted."""

    columns: str
    families: Mapping[str, Callable[[DataFrame], DataFrame]]
    counted: Callable[[DataFrame], DataFrame]


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str, network: int, create: bool = False, meta: dict | None = None, packing: Packing | None = None):
        self.spark, self.path, self.network, self.packing = spark, path.rstrip("/"), network, packing
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fresh, meta = meta, self._read("_meta.json")
        if meta is None:
            if not create:
                raise FailedPrecondition("no store here")
            self._create("_meta.json", fresh or {"store_schema_version": STORE_SCHEMA_VERSION, "network": network, "key": uuid.uuid4().hex + uuid.uuid4().hex})
            meta = self._read("_meta.json")
        if meta["store_schema_version"] != STORE_SCHEMA_VERSION:
            raise FailedPrecondition("store schema differs")
        if meta["network"] != network:
            raise FailedPrecondition("store of another network")
        self.cursor_key = bytes.fromhex(meta["key"])

    # files
    def _read(self, name: str) -> dict | None:
        path = self._hadoop(f"{self.path}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, name: str, content: dict) -> None:
        """A new file by a rename that does not overwrite (atomic where the file system's is, as in HDFS); fails if the
        name is taken."""
        target, draft = self._hadoop(f"{self.path}/{name}"), self._hadoop(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self._fs.mkdirs(target.getParent())
        context = self.spark.sparkContext
        rename = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = context._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(draft, target, how)
        except Py4JJavaError as failed:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise CommitRejected("single_writer", f"{name} exists") from failed
            raise

    def epochs(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/epochs")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    # reads
    def manifest(self, epoch: int | None = None) -> dict | None:
        """The manifest of an epoch or the newest one. An epoch's manifest lists its own folders and the one before it."""
        ids = self.epochs()
        if not ids:
            return None
        if epoch is None:
            epoch = ids[-1]
        return self._read(f"epochs/{epoch:020d}.json") if epoch in ids else None

    def manifests(self, epoch: int | None = None) -> DataFrame:
        """A row for each commit, up to an epoch."""
        if not self.epochs():
            return self.spark.createDataFrame([], MANIFEST)
        listed = self.spark.read.schema(MANIFEST).json(f"{self.path}/epochs")
        return listed if epoch is None else listed.where(F.col("chain_epoch.epoch") <= epoch)

    def tables(self, epoch: int | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot: of each family the folders of commits that manifests up to it name. Events below the
        retention floor are left out."""
        listed = self.manifests(epoch)
        packed = self._kept(PACKED, listed)
        out = {}
        for family in FAMILIES:
            rows = self._kept(family, listed)
            if packed is not None and family in self.packing.families:
                made = conform(self.packing.families[family](packed), family)
                rows = made if rows is None else rows.unionByName(made)
            out[family] = self.spark.createDataFrame([], schema(family)) if rows is None else rows
        out["chain_epoch"] = listed.select("chain_epoch.*")
        out["chain_event"] = listed.select("event.*").where(F.col("sequence") >= self.floor())
        return out

    def _columns(self, family: str) -> str:
        if family == PACKED and self.packing is None:
            raise FailedPrecondition("packed rows need their packing")
        return self.packing.columns if family == PACKED else ddl(family)

    def _kept(self, family: str, listed: DataFrame) -> DataFrame | None:
        """Rows in the folders of a family that the manifests ``listed`` name; none, if no commit wrote any."""
        place = f"{self.path}/{family}"
        if not self._fs.exists(self._hadoop(place)):
            return None
        own = listed.select("commit", F.explode("families").alias("family")).where(F.col("family") == family).select("commit")
        rows = self.spark.read.schema(f"{self._columns(family)}, commit STRING").option("basePath", place).parquet(place)
        return rows.join(own, "commit", "left_semi").drop("commit")  # prunes the folders of other commits

    def additions(self) -> DataFrame:
        """(epoch, height, sapling, orchard): notes of each committed compact block, counted in the form that it is kept in."""
        listed = self.manifests()
        plain, packed = self._kept("compact_block", listed), self._kept(PACKED, listed)
        added = compact.tree_additions(self.spark.createDataFrame([], schema("compact_block")) if plain is None else plain, "epoch")
        return added if packed is None else added.unionByName(compact.tree_additions(self.packing.counted(packed), "epoch"))

    def floor(self) -> int:
        """The oldest retained event; 1 if nothing was pruned."""
        folder = self._hadoop(f"{self.path}/retention")
        found = [int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max(found, default=1)

    def prune(self, cutoff_millis: int) -> int:
        """Raises the retention floor over the events before the first one as young as the cutoff (the newest event always
        stays); returns the floor. It never sinks, and cursors below it expire."""
        found = retention_floor(self.tables()["chain_event"], cutoff_millis).first()[0]
        if found is not None and found > self.floor():
            self._create(f"retention/{found:020d}.json", {"floor_sequence": found, "cutoff_millis": cutoff_millis})
        return self.floor()

    def history(self, token: bytes | None = None, **how) -> DataFrame:
        """A page of this store's events, each with its cursor."""
        return history(self.tables()["chain_event"], self.cursor_key, self.network, token, floor=self.floor() if self.epochs() else None, **how)

    def reader(self, pin: int | Row | None = None) -> EpochReader:
        return EpochReader.open(self.tables(), pin)

    def current(self) -> Row | None:
        found = self.manifest()
        return None if found is None else Row(**found["chain_epoch"])

    # writes
    def commit(self, new: Row, change: Change, artifacts: Mapping[str, DataFrame], reorg_window: int = 100) -> int:
        """Checks and publishes a commit; returns its event sequence. Artifacts named ``packed`` stand for the families of the
        store's packing."""
        checked_schema(new["artifact_schema_version"])
        if new["network"] != self.network:
            raise CommitRejected("network", "another network")
        last = self.manifest()
        current = Row(**last["chain_epoch"]) if last else None
        sequence = (last["event"]["sequence"] if last else 0) + 1
        name = f"{new['epoch']:020d}-{uuid.uuid4().hex}"
        blocks = self.tables()["block"]
        staged = {}
        try:
            for family, rows in artifacts.items():
                place = f"{self.path}/{family}/commit={name}"
                columns = self._columns(family)
                own = conform(rows.withColumn("epoch", F.lit(new["epoch"])), columns)
                own.sortWithinPartitions(*SORTED[family]).write.option("compression", "zstd").option("parquet.bloom.filter.enabled#txid", "true").option("parquet.bloom.filter.enabled#script_hash", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(place)
                staged[family] = self.spark.read.schema(columns).parquet(place)
            checked = {f: rows for f, rows in staged.items() if f != PACKED}
            if PACKED in staged:
                checked |= {f: conform(make(staged[PACKED]), f) for f, make in self.packing.families.items()}
            event = check_commit(new, change, checked, current, blocks, reorg_window)
        except Exception:
            for family in artifacts:
                self._fs.delete(self._hadoop(f"{self.path}/{family}/commit={name}"), True)
            raise
        fields = [f.name for f in schema("chain_epoch").fields]
        self._create(f"epochs/{new['epoch']:020d}.json", {"commit": name, "families": sorted(staged), "previous": current["epoch"] if current else None, "chain_epoch": {f: new[f] for f in fields}, "event": event.asDict() | {"sequence": sequence}})
        if (now := self.current())["epoch"] != new["epoch"]:
            raise CommitRejected("epoch_order", f"epoch {now['epoch']} was published meanwhile")
        return sequence

    def finalize(self, height: int, block_hash: str, created_at_millis: int) -> int:
        """An artifact-free epoch that moves the finalized height."""
        now = self.current()
        return self.commit(Row(**(now.asDict() | {"epoch": now["epoch"] + 1, "finalized_height": height, "finalized_hash": block_hash, "created_at_millis": created_at_millis})), Change("finalize"), {})

    def checkpoint(self, path: str) -> None:
        """A consistent copy of what the manifests name; Spark copies the rows, one job for each family."""
        epochs, floor = self.epochs(), self.floor()
        listed = [self._read(f"epochs/{k:020d}.json") for k in epochs]
        copy = LedgerStore(self.spark, path, self.network, create=True, meta=self._read("_meta.json"), packing=self.packing)
        for family in (*FAMILIES, PACKED):
            commits = [m["commit"] for m in listed if family in m["families"]]
            if commits:
                rows = self.spark.read.schema(f"{self._columns(family)}, commit STRING").parquet(f"{self.path}/{family}").where(F.col("commit").isin(commits))
                rows.repartition("commit").sortWithinPartitions("commit", *SORTED[family]).write.partitionBy("commit").option("compression", "zstd").parquet(f"{copy.path}/{family}")
        for k, manifest in zip(epochs, listed, strict=True):
            copy._create(f"epochs/{k:020d}.json", manifest)
        if floor > 1:
            copy._create(f"retention/{floor:020d}.json", {"floor_sequence": floor})

    def catch_up(self, seen: int | None) -> tuple[int | None, int | None]:
        """What a reader saw before and what it can see now; one that reads on from there opens ``reader()`` anew."""
        ids = self.epochs()
        return seen, ids[-1] if ids else None


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], ddl(name)) for name in (*FAMILIES, "chain_epoch", "chain_event")}
