"""The ordered change log: ranges, pages behind cursors, families, retention, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import FailedPrecondition, InvalidRequest
from ledgerloom.functions import cursor
from ledgerloom.operators.visibility import as_of
from ledgerloom.shared import exists

DEFAULT_EVENTS = 1000
FAMILIES = {"tip": cursor.TIP, "finalized": cursor.FINALIZED}


def of_family(events: DataFrame, family: str) -> DataFrame:
    """``tip``: all events; ``finalized``: committed ones whose tip is final."""
    if family not in FAMILIES:
        raise InvalidRequest("unknown event family")
    return events if family == "tip" else events.where((F.col("event_kind") == "committed") & (F.col("tip_height") <= F.col("finalized_height")))


def history(events: DataFrame, key: bytes, network: int, token: bytes | None = None, max_events: int = DEFAULT_EVENTS, family: str = "tip", floor: int | None = None) -> DataFrame:
    """The next matching events in order, each with its cursor. Without a cursor from the oldest retained one; with one
    strictly after it. The cursor's own family counts. ``floor`` is the oldest retained sequence."""
    if max_events <= 0:
        raise InvalidRequest("max_events must be positive")
    bounds = events.agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).first()
    low = floor if floor is not None else bounds["low"]
    after = (low or 1) - 1
    if token is not None:
        at = cursor.decode(key, network, token)
        if bounds["high"] is None or at.sequence > bounds["high"] or at.sequence == 0:
            raise InvalidRequest("cursor is not of this log")
        row = events.where(F.col("sequence") == at.sequence).first() if at.sequence >= low else None
        if row is None:
            raise FailedPrecondition("cursor has expired")
        if (row["tip_height"], row["tip_hash"]) != (at.tip_height, at.tip_hash):
            raise InvalidRequest("cursor names another snapshot")
        after, family = at.sequence, "finalized" if at.family == cursor.FINALIZED else "tip"
    page = of_family(events.where(F.col("sequence") > after), family).orderBy("sequence").limit(max_events)
    return page.withColumn("cursor", cursor.cursor_column(key, network, FAMILIES[family])).orderBy("sequence")


def retention_floor(events: DataFrame, cutoff_millis: int) -> DataFrame:
    """The oldest sequence to keep: the first event as young as the cutoff, or the newest event."""
    return events.agg(F.coalesce(F.min(F.when(F.col("created_at_millis") >= cutoff_millis, F.col("sequence"))), F.max("sequence")).alias("floor_sequence"))


def retention_report(events: DataFrame, now_millis: int, window_hours: int = 168, warning_hours: int = 24) -> DataFrame:
    """Oldest and newest sequence, how many are retained, the oldest one's age and whether cursors there are at risk."""
    sums = events.agg(F.min("sequence").alias("oldest"), F.max("sequence").alias("newest"), F.min_by("created_at_millis", "sequence").alias("created"))
    age = F.greatest(F.lit(now_millis) - F.col("created"), F.lit(0)) / 3_600_000
    return sums.select("oldest", "newest", (F.col("newest") - F.col("oldest") + 1).alias("retained"), F.floor(age).cast("bigint").alias("age_hours"), (age > window_hours - warning_hours).alias("at_risk"))


def reverted_heights(events: DataFrame) -> DataFrame:
    """(height, gone): the newest event that reverted each height. An event reverts no more heights than the reorg window
    has, so its range can be spelled out."""
    ranges = events.where("reverted_start IS NOT NULL AND reverted_start <= reverted_end")
    return ranges.select(F.explode(F.sequence("reverted_start", "reverted_end")).alias("height"), "sequence").groupBy("height").agg(F.max("sequence").alias("gone"))


def replayed(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a consumer holds after the whole log: for each height the block of the newest event that committed it, unless
    a later event reverted that height without a new block. A finalize-only event names one height and brings no block;
    it does not move rows."""
    own = events.select("epoch", "sequence", "start_height", "end_height")
    rows = blocks.join(own, "epoch").where(F.col("height").between(F.col("start_height"), F.col("end_height")))
    newest = as_of(rows.select("height", "epoch", "block_hash", "sequence"), ["height"], F.lit((1 << 63) - 1))
    kept = newest.join(reverted_heights(events), "height", "left").where("gone IS NULL OR sequence >= gone")
    return kept.select("height", "epoch", "block_hash")


def with_finality(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``rows`` (with height) with ``final``: no later event may revert them, so undo state up to there can go."""
    final = events.agg(F.coalesce(F.max("finalized_height"), F.lit(0)).alias("_final"))
    return rows.join(F.broadcast(final)).withColumn("final", F.col("height") <= F.col("_final")).drop("_final")  # one row


def tail(spark, path: str, max_files: int = 16) -> DataFrame:
    """The log of the store at ``path`` as a stream: each commit publishes one file, which holds its event. How many files
    a trigger takes bounds a batch."""
    from ledgerloom.sources.store import MANIFEST

    return spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", max_files).json(f"{path}/epochs").select("event.*")


class DerivedBlocks:
    """A view that follows the log: (height, epoch, block_hash), kept in spans of heights.

    ``apply`` is a ``foreachBatch`` function: it takes out the reverted range of each event and puts in the committed
    rows. A batch writes only the spans that it changes, each as a whole and with a row of its own that has no height (so
    that a span of no block is known, too); a reader takes the newest version of each span. A batch that is seen again
    writes the same rows to the same folder, so a restart changes nothing.
    """

    COLUMNS = "height BIGINT, epoch BIGINT, block_hash STRING, sequence BIGINT"

    def __init__(self, blocks: DataFrame, path: str, span: int = 1000):
        self.blocks, self.path, self.span = blocks, path.rstrip("/"), span

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select("epoch", "sequence", "start_height", "end_height")
        rows = self.blocks.join(own, "epoch").where(F.col("height").between(F.col("start_height"), F.col("end_height"))).select("height", "epoch", "block_hash", "sequence")
        gone = reverted_heights(batch)
        span = F.floor(F.col("height") / self.span).cast("bigint").alias("span")
        changed = rows.select(span).union(gone.select(span)).distinct()
        before = self.versions(spark, batch_id - 1).join(changed, "span", "left_semi").where("height IS NOT NULL").select("height", "epoch", "block_hash", "sequence")
        newest = as_of(before.unionByName(rows), ["height"], F.lit((1 << 63) - 1))
        kept = newest.join(gone, "height", "left").where("gone IS NULL OR sequence >= gone").drop("gone").withColumn("span", span)
        marks = changed.selectExpr("CAST(NULL AS BIGINT) AS height", "CAST(NULL AS BIGINT) AS epoch", "CAST(NULL AS STRING) AS block_hash", "CAST(NULL AS BIGINT) AS sequence", "span")
        kept.unionByName(marks).write.mode("overwrite").partitionBy("span").parquet(f"{self.path}/batch={batch_id}")

    def versions(self, spark, batch_id: int) -> DataFrame:
        """The newest version of each span up to a batch."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], f"{self.COLUMNS}, span BIGINT")
        stored = spark.read.schema(f"{self.COLUMNS}, batch BIGINT, span BIGINT").parquet(self.path).where(F.col("batch") <= batch_id)
        newest = stored.where("height IS NULL").groupBy("span").agg(F.max("batch").alias("batch"))
        return stored.join(newest, ["span", "batch"], "left_semi").drop("batch")

    def read(self, spark, batch_id: int) -> DataFrame:
        return self.versions(spark, batch_id).where("height IS NOT NULL").select("height", "epoch", "block_hash")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
