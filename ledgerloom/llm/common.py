"""Shared pieces: Arrow batches in bounded runs, byte-level word scanning and hashing, the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import shared

#: Bytes of text that one vectorised step takes at once (a longer document is a run of its own).
RUN_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which becomes the checkpoint folder, too."""
    base = shared.shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


_KEPT: dict[Hashable, Any] = {}


def worker_keeps(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps from task to task: one thing, made when a task first asks for it."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """A task of another operator frees what earlier ones have left in its worker, as Spark uses workers again."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _at(spark.read.schema(df.schema).parquet(path), path)


def _at(df: DataFrame, path: str | None) -> DataFrame:
    df.stored_at = path
    return df


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``stored`` has written and that nothing will read again."""
    for df in tables:
        if df is not None and (path := getattr(df, "stored_at", None)):
            shared.delete(df.sparkSession, path)


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a string column with at most ``limit`` bytes each, or one row."""
    if not len(column):
        return
    ends = offsets_of(column)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(ends, ends[a] + limit, "right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b
        a = b


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends Python at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at once: rows with whole
    texts are large, and both sides hold a batch."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def kept_rows(docs: DataFrame, text_col: str, decider: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the decision of ``decider()`` keeps. The decision is
    made on batches of whole texts where the rows are; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        decide = decider()
        for batch in batches:
            for a, b in runs(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(decide(part.column(at).to_pylist()), pa.bool_()))

    return in_batches(docs).mapInArrow(work, docs.schema)


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids``. The ids are written first, so that Spark knows their size and
    sends them to the rows if they are few, or else joins by key; rows with a null id stay."""
    gone = stored(ids.where(F.col(id_col).isNotNull()).distinct())
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = offsets_of(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, RUN_BYTES + 1024)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.ones(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Byte classes that end a word: the white space of ASCII; all of ASCII but letters and digits.
SPACES, NOT_ALNUM = _SPACE, _ALNUM
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows, A-Z lower-cased, as 64-bit hashes in order, and for each row the index of its first word
    (with one index more for the end). A hash stands for its word: among a thousand million different words, any two
    share one with a chance of 3 %. Bytes are taken in pieces of ``RUN_BYTES``, wherever rows and words end, so that a
    row of any length costs a few bytes for each of its words besides its text."""
    raw: list[np.ndarray] = []  # hashes before the last mix
    sizes: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    open_word: tuple[int, int, int] | None = None  # hash, size and start of a word that the next piece may go on with
    for a in range(0, len(data), RUN_BYTES):
        b = min(a + RUN_BYTES, len(data))
        low, high = np.searchsorted(offsets, (a, b))
        h, size, start = _piece(data[a:b], offsets[low:high] - a, ends_word)
        start += a
        if open_word is not None:
            if len(start) and start[0] == a and offsets[low] != a:
                had, n, begun = open_word
                h[0] = np.uint64((had + pow(_BASE, n, 1 << 64) * int(h[0])) % (1 << 64))
                size[0] += n
                start[0] = begun
            else:
                raw, sizes, starts = [*raw, np.array([open_word[0]], np.uint64)], [*sizes, np.array([open_word[1]])], [*starts, np.array([open_word[2]])]
        open_word = None
        if b < len(data) and len(start) and start[-1] + size[-1] == b:
            open_word = int(h[-1]), int(size[-1]), int(start[-1])
            h, size, start = h[:-1], size[:-1], start[:-1]
        raw.append(h)
        sizes.append(size)
        starts.append(start)
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return mix(np.concatenate(raw) + (np.concatenate(sizes) - 1).astype(np.uint64)), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def _piece(data: np.ndarray, cuts: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (before the last mix), size and start of each word of a piece; rows begin at ``cuts``."""
    inside = ~ends_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    first[cuts] = inside[cuts]
    before_cut = cuts[cuts > 0] - 1
    last[before_cut] = inside[before_cut]
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(len(data))
    total = np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)
    before = total[start - 1]
    before[start == 0] = 0
    return (total[stop] - before) * down[start], stop - start + 1, start


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, in order, and the index of each row's first one."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    return out, begin


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)
