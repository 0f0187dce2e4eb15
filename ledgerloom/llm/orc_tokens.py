"""Token ids in ORC files: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Whole texts are encoded with the tokenizers library and an end id is appended. Rows are range-partitioned and sorted
by document id, so files, stripes and row groups follow each other in the order of ids: a reader's predicate on the id
prunes files and stripes by their statistics and row groups by the row index and the Bloom filter, and stripes are
read in parallel. Columns: doc_id, part (the file's place in the order), local_start (ids of the part before the
document), n_tokens, ids. A document's place among all ids is local_start and the totals of the parts before it.

Of texts of Latin script (characters that normalisation handles one by one) a worker asks the library only for words that
it has not met (a table of bounded size keeps the others): words are joined by a blank, which the vocabulary drops, and
the last token of a word ends with the mark of a word's end. Any other text goes to the library as a whole.

Defined cases: a null or empty text has the end id alone; a null id comes first; rows that repeat an id stand in the
order of a hash of their texts; an empty table writes no rows; a text of any length is one row; other columns do not matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ledgerloom.llm.bpe import WORD_END, vocabulary_text, task_encoder
from ledgerloom.llm.common import in_batches, runs, shared_folder, stored

#: Rows of a row group, bytes of a stripe, false positives of the Bloom filters.
ROW_GROUP, STRIPE_BYTES, FALSE_POSITIVES = 1_000, 16 << 20, 0.01
#: Files whose totals one task adds up.
FILES = 1_024
_ENCODED = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


class LibraryEncoder:
    """Ids of words by the tokenizers library."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_padding()
        self.library.no_truncation()
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(tokens.values()) + 1, bool)
        self.ends_word[[k for token, k in tokens.items() if token.endswith(WORD_END)]] = True

    def encode(self, words: set[str]) -> Iterator[tuple[str, bytes, str]]:
        """Each word with its ids; a word of the pre-tokenizer never holds white space."""
        order = list(words)
        for a in range(0, len(order), 10_000):
            part = order[a : a + 10_000]
            ids = self.ids(" ".join(part))
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                for word, low, high in zip(part, [0, *ends], ends, strict=False):
                    yield word, raw[4 * low : 4 * high], ""
            else:  # the library saw other words than the pre-tokenizer did
                for word in part:
                    yield word, self.ids(word).tobytes(), ""

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def encoded(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """(doc_id, local_start, n_tokens, ids) in the order of ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    tail = np.uint32(end_id).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = task_encoder(vocabulary.value, LibraryEncoder), 0
        for batch in batches:
            for a, b in runs(batch.column(1)):
                raw = [ids + tail for ids, _ in encoder.encode(batch.column(1).slice(a, b - a).to_pylist(), decode=False)]
                counts = np.array([len(r) // 4 for r in raw], np.int64)
                ends = np.concatenate(([0], np.cumsum(counts)))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(total + ends[:-1]), pa.array(counts), ids], schema=_ENCODED)
                total += int(ends[-1])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = [partitions] if partitions else []
    # the hash lets rows that repeat an id, or have none, fall into several ranges
    ordered = picked.withColumn("hash", F.xxhash64("text")).repartitionByRange(*parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    return in_batches(ordered).mapInArrow(work, "doc_id BIGINT, local_start BIGINT, n_tokens BIGINT, ids ARRAY<INT>")


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    rows = encoded(docs, vocabulary_path, end_id, id_col, text_col).withColumn("part", F.spark_partition_id())
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.create.index": "true", "orc.row.index.stride": ROW_GROUP, "orc.stripe.size": STRIPE_BYTES, "compression": "zstd"}
    rows.select("doc_id", "part", "local_start", "n_tokens", "ids").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents; filters on doc_id reach the files' statistics, row indexes and Bloom filters."""
    return spark.read.schema("doc_id BIGINT, part INT, local_start BIGINT, n_tokens BIGINT, ids ARRAY<INT>").orc(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files, per document: doc_id, start, n_tokens, ids_crc32."""
    rows = read_tokens(spark, path)
    # a row for each file, and a running total in two steps: inside groups of files, then over the groups' totals
    totals = stored(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("files", F.floor(F.col("part") / FILES)))
    inside = F.sum("n").over(Window.partitionBy("files").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    groups = totals.groupBy("files").agg(F.sum("n").alias("n"))
    groups = groups.select("files", F.sum("n").over(Window.orderBy("files").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    base = stored(totals.withColumn("inside", inside).join(groups, "files").select("part", (F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("base")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")
    return in_batches(placed).mapInArrow(work, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def write_and_digest(docs: DataFrame, vocabulary_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to the shared folder and describe what the files hold."""
    path = f"{shared_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, vocabulary_path, end_id, id_col, text_col)
    return digest(docs.sparkSession, path).withColumnRenamed("doc_id", id_col)
