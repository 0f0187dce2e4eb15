"""What an operator of a store watches: readiness, lag, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import saturating_lag
from ledgerloom.operators.reader import EpochReader
from ledgerloom.schema import FAMILIES
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming.events import retention_report

#: Lag of a reader behind its writer, in epochs, from which it is not ready; blocks behind the node that still count as ready.
MOST_EPOCHS, MOST_BLOCKS = 4, 2


def readiness(store: LedgerStore, reader: EpochReader, node_tip: int | None, now_millis: int, most_epochs: int = MOST_EPOCHS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row: writer and reader epoch, lag in epochs and blocks, the oldest event's age, and the first cause that holds of
    ``node_unavailable``, ``replica_lagging``, ``syncing``, ``cursor_at_risk`` and ``ready``. Cursors at risk are a warning:
    the row stays ready."""
    writer = store.current()
    report = retention_report(store.tables()["chain_event"], now_millis)
    rows = report.select(
        F.lit(writer["epoch"]).cast("bigint").alias("writer_epoch"), F.lit(reader.epoch).cast("bigint").alias("reader_epoch"),
        F.lit(node_tip).cast("bigint").alias("node_tip"), F.lit(reader.tip).cast("bigint").alias("tip_height"), "age_hours", "at_risk",
    )
    lag = rows.withColumns({"lag_epochs": saturating_lag(F.col("writer_epoch"), F.col("reader_epoch")), "lag_blocks": saturating_lag(F.col("node_tip"), F.col("tip_height"))})
    cause = F.when(F.col("node_tip").isNull(), "node_unavailable").when(F.col("lag_epochs") > most_epochs, "replica_lagging").when(F.col("lag_blocks") > most_blocks, "syncing").when(F.col("at_risk"), "cursor_at_risk").otherwise("ready")
    found = lag.withColumn("cause", cause)
    return found.select("writer_epoch", "reader_epoch", "lag_epochs", "tip_height", "lag_blocks", "age_hours", "cause", F.col("cause").isin("ready", "cursor_at_risk").alias("ready"))


def counts(store: LedgerStore) -> DataFrame:
    """Committed rows and distinct epochs of each family."""
    tables = store.tables()
    each = [tables[f].agg(F.lit(f).alias("family"), F.count("*").alias("n_rows"), F.count_distinct("epoch").alias("n_epochs")) for f in FAMILIES]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    return out
