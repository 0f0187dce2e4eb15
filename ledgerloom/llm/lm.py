"""Language-model scores by deleted interpolation.

The probability of a token after its context mixes maximum-likelihood estimates of n-grams of length 1 to n and a
uniform share, with weights by bucket of the context's frequency. The weights are learned by expectation-maximisation
on held-out counts: a part of the training documents is deleted from the counts and then predicted by what is left.
All counts cover all training documents.

How it runs: documents are gathered into chunks, and the chunks of a task into packs (a row of the stored table each,
texts compressed). Each pack sends its distinct n-grams with their counts to the buckets of their hashes; a bucket adds
the counts up and answers each pack with the totals of what it sent, in the order sent. A pack with its answers then
scores its documents, chunk by chunk. So an n-gram crosses the network once per pack, whatever its frequency, and no
count table has to fit anywhere. Words are 64-bit hashes; n-grams of two and more words are 48-bit hashes that travel as
steps of 32 bits.

Defined cases: a null or empty text is the end token alone; a null id counts as a training document; without training
documents every score is 0 counts' uniform share; repeated rows count each time; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, discard, in_batches, mix, offsets_of, stored, utf8, words
from ledgerloom.llm.quality import held_out

#: Bytes of text of a chunk, of a pack of chunks and for each bucket, about.
CHUNK_BYTES, PACK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20, 8 << 20
#: One of so many training documents (by crc32) is deleted for the mixture weights.
DELETED_OF = 16
#: Frequency classes of contexts (powers of two), classes of estimates by which held-out events are gathered.
CLASSES, LEVELS = 32, 48
_END, _START = np.uint64(0x5EED5EED5EED5EED), np.uint64(0xB0B0B0B0B0B0B0B1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASK48 = np.uint64((1 << 48) - 1)

PACK = "pack BIGINT, deleted BOOLEAN, bytes BIGINT, chunks ARRAY<STRUCT<ids: ARRAY<BIGINT>, kinds: BINARY, ends: BINARY, texts: BINARY>>"
_CHUNK = pa.struct([("ids", pa.list_(pa.int64())), ("kinds", pa.binary()), ("ends", pa.binary()), ("texts", pa.binary())])
_PACK = pa.schema([("pack", pa.int64()), ("deleted", pa.bool_()), ("bytes", pa.int64()), ("chunks", pa.list_(_CHUNK))])
SENT = "size INT, bucket INT, pack BIGINT, gone BOOLEAN, keys BINARY, counts BINARY"
_SENT = pa.schema([("size", pa.int32()), ("bucket", pa.int32()), ("pack", pa.int64()), ("gone", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = "size INT, bucket INT, pack BIGINT, gone BOOLEAN, totals BINARY, without BINARY, types BIGINT, tokens BIGINT, tokens_left BIGINT"
_ANSWER = pa.schema([("size", pa.int32()), ("bucket", pa.int32()), ("pack", pa.int64()), ("gone", pa.bool_()), ("totals", pa.binary()), ("without", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("tokens_left", pa.int64())])
_CELL = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])
_SCORED = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

_press = zstandard.ZstdCompressor(level=1)
_open = zstandard.ZstdDecompressor()


def press(x: bytes) -> bytes:
    return _press.compress(x)


def pack(x: np.ndarray, kind: str) -> bytes:
    return press(x.astype(kind).tobytes())


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_open.decompress(x), kind)


def steps(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 48-bit keys as 32-bit steps, and where they stand among the steps; a longer way takes empty steps."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    empty = (gaps // np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = np.arange(len(keys)) + np.cumsum(empty)
    out = np.full(int(place[-1]) + 1 if len(keys) else 0, 0xFFFFFFFF, np.uint32)
    out[place] = (gaps - empty.astype(np.uint64) * np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out, place


def pack_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table of packs; deleted documents have packs of their own. ``kinds``: 0 held out, 1 training, 2 deleted."""
    trains = ~held_out("id", 7, 2)
    deleted = trains & F.coalesce(F.crc32(F.concat(F.lit("deleted "), F.col("id").cast("string"))) % DELETED_OF == 0, F.lit(False))
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.select("id", "text", F.when(deleted, 2).when(trains, 1).otherwise(0).cast("int").alias("kind"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[pa.Array, pa.Array, pa.Array]]] = {True: [], False: []}
        size, chunks, total, made = {True: 0, False: 0}, {True: [], False: []}, {True: 0, False: 0}, 0

        def close_chunk(gone: bool) -> None:
            if held[gone]:
                ids, texts, kinds = (pa.concat_arrays(list(c)) for c in zip(*held[gone], strict=True))
                data, ends = utf8(texts)
                chunks[gone].append({"ids": ids.to_pylist(), "kinds": kinds.to_numpy().astype(np.uint8).tobytes(), "ends": pack(ends, "<i8"), "texts": press(data.tobytes())})
                total[gone] += size[gone]
                held[gone], size[gone] = [], 0

        def close_pack(gone: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            if chunks[gone]:
                row = [(TaskContext.get().partitionId() << 32) + made, gone, total[gone], chunks[gone]]
                made, total[gone], chunks[gone] = made + 1, 0, []
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _PACK.types, strict=True)], schema=_PACK)

        for batch in batches:
            kinds = batch.column(2).to_numpy()
            for gone in (True, False):
                part = batch.filter(pa.array((kinds == 2) == gone))
                a = 0
                while a < part.num_rows:
                    ends = offsets_of(part.column(1))
                    b = int(np.searchsorted(ends, ends[a] + CHUNK_BYTES - size[gone], "right")) - 1
                    b = min(max(b, a + 1), part.num_rows)
                    held[gone].append(tuple(part.column(c).slice(a, b - a) for c in range(3)))
                    size[gone] += int(ends[b] - ends[a])
                    a = b
                    if size[gone] >= CHUNK_BYTES * 7 // 8:
                        close_chunk(gone)
                    if total[gone] >= PACK_BYTES * 7 // 8:
                        yield from close_pack(gone)
        for gone in (True, False):
            close_chunk(gone)
            yield from close_pack(gone)

    return in_batches(picked).mapInArrow(work, PACK)


class Grams:
    """A chunk's distinct n-grams of each length, ascending, and which one ends at each token."""

    def __init__(self, chunk: dict, order: int):
        data, ends = np.frombuffer(_open.decompress(chunk["texts"]), np.uint8), unpack(chunk["ends"], "<i8")
        h, first = words(data, ends, SPACES)
        self.kinds = np.frombuffer(chunk["kinds"], np.uint8)
        docs = len(self.kinds)
        self.first = first + np.arange(docs + 1)  # each document has its end token, too
        tokens = np.empty(len(h) + docs, np.uint64)
        tokens[self.first[1:] - 1] = _END
        word = np.ones(len(tokens), bool)
        word[self.first[1:] - 1] = False
        tokens[word] = h
        keys, before = tokens, tokens
        self.orders: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, order + 1):
            if size > 1:  # the token that stands size - 1 places before, or the document's start
                before = np.concatenate((np.full(1, _START, np.uint64), before[:-1]))
                before[self.first[:-1]] = _START
                keys = mix(before * _GOLD + mix(keys + np.uint64(size))) & _MASK48
            own, place = np.unique(keys, return_inverse=True)
            self.orders.append((own, place.astype(np.int32)))

    def counts(self, size: int, kind: int) -> np.ndarray:
        """How often each distinct n-gram stands in documents of a kind or more."""
        own, place = self.orders[size - 1]
        return np.bincount(place, np.repeat((self.kinds >= kind).astype(np.float64), np.diff(self.first)), len(own)).astype(np.int64)


class Pack:
    """The n-grams of a pack's chunks, and the distinct ones of all of them, cut up by bucket."""

    def __init__(self, row: dict, order: int, buckets: int):
        self.buckets = buckets
        self.chunks = [Grams(chunk, order) for chunk in row["chunks"]]
        self.orders: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]] = []
        for size in range(1, order + 1):
            each = [c.orders[size - 1][0] for c in self.chunks]
            own, place = np.unique(np.concatenate(each), return_inverse=True)
            high = np.uint64(32 if size == 1 else 16)
            bucket = ((own >> high) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            self.orders.append((own, np.split(place.astype(np.int32), np.cumsum([len(e) for e in each])[:-1]), cuts))

    def counts(self, size: int, kind: int) -> np.ndarray:
        own, places, _ = self.orders[size - 1]
        out = np.zeros(len(own), np.int64)
        for chunk, place in zip(self.chunks, places, strict=True):
            out[place] += chunk.counts(size, kind)  # a chunk has each n-gram once
        return out

    def parts(self, size: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(bucket, from, to, steps or keys, places among them)."""
        own, _, cuts = self.orders[size - 1]
        for b in range(self.buckets):
            a, z = int(cuts[b]), int(cuts[b + 1])
            if a < z:
                if size == 1:
                    yield b, a, z, own[a:z], np.arange(z - a)
                else:
                    low = np.uint64(-((-b << 32) // self.buckets) << 16)
                    yield b, a, z, *steps(own[a:z] - low)

    def token_counts(self, answers: list[dict], column: str) -> Iterator[tuple[Grams, list[np.ndarray]]]:
        """Each chunk with, for each length, the count of the n-gram that ends at each token."""
        found = {(a["size"], a["bucket"]): a[column] for a in answers}
        totals = []
        for size, (own, *_) in enumerate(self.orders, 1):
            total = np.zeros(len(own), np.int64)
            for b, a, z, _, at in self.parts(size):
                total[a:z] = unpack(found[size, b], "<u4")[at]
            totals.append(total)
        for k, chunk in enumerate(self.chunks):
            yield chunk, [total[places[k]][place] for total, (_, places, _), (_, place) in zip(totals, self.orders, chunk.orders, strict=True)]


def send(order: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = Pack(row, order, buckets)
                for size in range(1, order + 1):
                    counts = own.counts(size, 1)
                    out = []
                    for b, a, z, keys, place in own.parts(size):
                        spread = np.zeros(len(keys), np.int64)
                        spread[place] = counts[a:z]
                        out.append((size, b, row["pack"], row["deleted"], keys.tobytes(), pack(spread, "<u4")))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _SENT.types, strict=True)], schema=_SENT)

    return work


def answer(table: pa.Table) -> pa.Table:
    """The totals of a bucket's n-grams, for each pack in the order in which it sent them."""
    rows = table.to_pylist()
    size = rows[0]["size"]
    keys = [np.frombuffer(r["keys"], np.uint64) if size == 1 else np.cumsum(np.frombuffer(r["keys"], np.uint32), dtype=np.uint64) for r in rows]
    counts = [unpack(r["counts"], "<u4").astype(np.int64) for r in rows]
    ends = np.cumsum([0, *map(len, keys)])
    own, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(own)).astype(np.int64)
    gone = np.concatenate([c if r["gone"] else np.zeros(len(c), np.int64) for r, c in zip(rows, counts, strict=True)])
    left = total - np.bincount(place, gone, len(own)).astype(np.int64)
    out = []
    for k, r in enumerate(rows):
        at = place[ends[k] : ends[k + 1]]
        sums = (int((total > 0).sum()), int(total.sum()), int(left.sum())) if k == 0 and size == 1 else (0, 0, 0)
        out.append((size, r["bucket"], r["pack"], r["gone"], pack(total[at], "<u4"), pack(left[at], "<u4") if r["gone"] else None, *sums))
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _ANSWER.types, strict=True)], schema=_ANSWER)


def estimates(grams: Grams, counts: list[np.ndarray], tokens: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates of each length, and the class of the longest context's frequency. The context of
    a document's first token is its start, as frequent as the end."""
    ends = counts[0][grams.first[1] - 1] if len(grams.first) > 1 else 0
    start = np.zeros(len(counts[0]), bool)
    start[grams.first[:-1]] = True
    out, context = [counts[0] / max(tokens, 1)], np.zeros(len(counts[0]), np.int64)
    for size in range(2, len(counts) + 1):
        context = np.where(start, ends, np.concatenate(([0], counts[size - 2][:-1])))
        out.append(np.where(context > 0, counts[size - 1] / np.maximum(context, 1), 0.0))
    kind = np.minimum(np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0), CLASSES - 1).astype(np.int64)
    return out, kind


def mixture_weights(cells: list[tuple[int, int, list[float]]], order: int, uniform: float, rounds: int = 60, lean: float = 50.0) -> np.ndarray:
    """A row of weights (uniform, then n-grams by length) for each class, by expectation-maximisation; a class leans
    towards the weights of all classes as if it had seen ``lean`` events of theirs."""
    weights = np.full((CLASSES, order + 1), 1 / (order + 1))
    if not cells:
        return weights
    kind = np.array([c // LEVELS**order for c, _, _ in cells])
    n = np.array([c[1] for c in cells], np.float64)
    p = np.column_stack([np.full(len(cells), uniform), np.array([c[2] for c in cells]) / n[:, None]])

    def learned(start: np.ndarray, rows: np.ndarray, lean: float) -> np.ndarray:
        w = start
        for _ in range(rounds):
            share = w * p[rows]
            share *= (n[rows] / np.maximum(share.sum(1), 1e-300))[:, None]
            w = share.sum(0) + lean * start
            w = w / w.sum()
        return w

    whole = learned(np.full(order + 1, 1 / (order + 1)), np.arange(len(cells)), 1.0)
    for k in range(CLASSES):
        rows = np.flatnonzero(kind == k)
        weights[k] = learned(whole, rows, lean) if len(rows) else whole
    return weights


def score(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    packs = stored(pack_rows(docs, id_col, text_col))
    buckets = max(16, -(-(packs.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    sent = packs.mapInArrow(send(order, buckets), SENT)
    answers = stored(sent.groupBy("size", "bucket").applyInArrow(answer, ANSWER))
    sums = answers.agg(F.sum("types"), F.sum("tokens"), F.sum("tokens_left")).first()
    types, tokens, left = (int(v or 0) for v in sums)
    uniform = 1 / (types + 1)

    def gather(key, row: pa.Table, found: pa.Table) -> pa.Table:
        cells: dict[int, tuple[int, np.ndarray]] = {}
        own = row.to_pylist()
        for grams, counts in Pack(own[0], order, buckets).token_counts(found.to_pylist(), "without") if own else ():
            p, kind = estimates(grams, counts, left)
            cell = kind
            for e in p:
                level = np.where(e > 0, 1 + np.clip(np.floor(-2 * np.log2(np.maximum(e, 1e-300))), 0, LEVELS - 2), 0)
                cell = cell * LEVELS + level.astype(np.int64)
            which, place = np.unique(cell, return_inverse=True)
            sums = np.column_stack([np.bincount(place, e, len(which)) for e in p])
            for c, n, s in zip(which.tolist(), np.bincount(place, minlength=len(which)).tolist(), sums, strict=True):
                had, sum_had = cells.get(c, (0, 0.0))
                cells[c] = had + n, sum_had + s
        return pa.table([pa.array([*cells], pa.int64()), pa.array([n for n, _ in cells.values()], pa.int64()), pa.array([s.tolist() for _, s in cells.values()], pa.list_(pa.float64()))], schema=_CELL)

    held = packs.where("deleted").groupBy("pack").cogroup(answers.where("gone").groupBy("pack")).applyInArrow(gather, "cell BIGINT, n BIGINT, sums ARRAY<DOUBLE>")
    added = held.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(order)])
    # at most CLASSES * LEVELS ** order rows
    cells = sorted((r["cell"], r["n"], [r[f"s{k}"] for k in range(order)]) for r in added.collect())
    weights = mixture_weights(cells, order, uniform)

    def scored(key, row: pa.Table, found: pa.Table) -> pa.Table:
        own, made = row.to_pylist(), []
        for (grams, counts), chunk in zip(Pack(own[0], order, buckets).token_counts(found.to_pylist(), "totals"), own[0]["chunks"], strict=True) if own else ():
            p, kind = estimates(grams, counts, tokens)
            mixed = weights[kind, 0] * uniform
            for k, e in enumerate(p):
                mixed += weights[kind, k + 1] * e
            at = grams.first[:-1]
            base = np.add.reduceat(np.log10(counts[0] + 1.0) - math.log10(tokens + types + 1), at)
            columns = [chunk["ids"], grams.kinds, np.diff(grams.first), np.add.reduceat((counts[0] > 0).astype(np.int64), at), base, np.add.reduceat(np.log10(mixed), at)]
            made.append(pa.table([pa.array(c, t) for c, t in zip(columns, _SCORED.types, strict=True)], schema=_SCORED))
        return pa.concat_tables(made) if made else _SCORED.empty_table()

    out = stored(packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(scored, "id BIGINT, kind INT, n_tokens BIGINT, n_known BIGINT, base_score DOUBLE, score DOUBLE"))
    discard(packs, answers)
    return out.select(F.col("id").alias(id_col), (F.col("kind") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
