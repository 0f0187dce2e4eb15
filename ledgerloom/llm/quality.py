"""Quality scores: random-indexing word vectors pooled per document, and a calibrated two-layer network in numpy.

Each term (a run of letters, digits or marks; a rare one counts as its shape) has a sparse random index vector drawn
from its own hash. A term's word vector is the sum of the index vectors that stand near it. A document is the mean of
its terms' word and index vectors, weighted by the logarithm of their counts (a term that repeats the one before it
counts as a term of its own, too), with its length; a network with one
hidden layer turns that into a logit, and a temperature fitted on rows that the network has not seen turns it into a
probability.

Terms, vectors and network are fitted on at most ``SAMPLE`` labelled rows (each class by hash order, up to half of it;
weights restore the classes' shares); every row is scored on its whole text.

Defined cases: a null or empty text, or one without terms, is a document of length 0 and gets the network's score for
that; without labels of both classes the score is the share of label 1 (a half without labels); a null id is never
held out; repeated rows get equal scores; a text of any length is one row of work; an empty table gives no rows; other
columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, in_batches, kept_rows, let_go, runs, stored

#: Labelled rows that the model is fitted on, at most; from how many documents of the sample on a term has a vector of its
#: own (a rarer one has that of its shape); size of the vectors, places of an index vector, words to either side.
SAMPLE, TERM_DOCS, SIZE, PLACES, WINDOW = 6_000, 5, 64, 6, 2
#: Terms whose sums travel together.
PART = 1_024
#: Terms at which a document's vector counts half; the doubt that calibration leaves about a label.
SHRINK, DOUBT = 8, 0.02

_TERM = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text has the remainder ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


#: The term that stands for "the term before, once more".
_AGAIN = "\x01"


def term_counts(text: str) -> Counter[str]:
    found = _TERM.findall(text)
    counts = Counter(found)
    if again := sum(map(eq, found, islice(found, 1, None))):
        counts[_AGAIN] = again
    return counts


def shape(term: str) -> str:
    """What a rare term counts as: its case and length, or its marks."""
    size = min(len(term), 12) // 3
    if term.isalpha():
        return f"\x00{'a' if term.islower() else 'A' if term.isupper() and len(term) > 1 else 'Aa' if term[1:].islower() else 'aA'}{size}"
    return f"\x000{size}" if term.isdigit() else f"\x00{term[0]}{size}{len(set(term[:12])) > 1}"


def index_vectors(terms: list[str]) -> np.ndarray:
    out = np.zeros((len(terms), SIZE), np.float32)
    for k, term in enumerate(terms):
        draw = np.random.default_rng(zlib.crc32(term.encode("utf-8", "replace")))
        out[k, draw.choice(SIZE, PLACES, replace=False)] = draw.choice([-1.0, 1.0], PLACES)
    return out


class Model(NamedTuple):
    number: dict[str, int]  # terms and shapes
    vectors: np.ndarray  # a row for each, and one for what is neither
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None


def numbers(terms: list[str], number: dict[str, int]) -> list[int]:
    other = len(number)
    return [number[t] if t in number else number.get(shape(t), other) for t in terms]


def pooled(texts: list[str | None], number: dict[str, int], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), vectors.shape[1] + 2))
    for k, text in enumerate(texts):
        counts = term_counts(text) if text else None
        if counts:
            tally: dict[int, int] = {}
            for at, n in zip(numbers(list(counts), number), counts.values(), strict=True):
                tally[at] = tally.get(at, 0) + n
            weight = np.log1p(np.fromiter(tally.values(), np.float64, len(tally)))
            out[k, :-2] = weight @ vectors[np.fromiter(tally, np.int64, len(tally))] / weight.sum()
            total = sum(counts.values())
            out[k, -2:] = np.log1p(total), len(counts) / total
    return out


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features about the mean; those of short documents, which rest on few terms, shrink towards it."""
    n = np.expm1(x[:, -2:-1])
    z = (x - mean) / scale
    z[:, :-2] *= n / (n + SHRINK)
    return z


def _network(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> list[np.ndarray]:
    draw = np.random.default_rng(5)
    layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for a in range(0, len(y), 128):
            at = order[a : a + 128]
            h = np.tanh(x[at] @ layers[0] + layers[1])
            z = h @ layers[2] + layers[3]
            g = weight[at] * (1 / (1 + np.exp(-z)) - y[at]) / len(at)
            back = np.outer(g, layers[2]) * (1 - h * h)
            grads = [x[at].T @ back + decay * layers[0], back.sum(0), h.T @ g + decay * layers[2], g.sum(keepdims=True)]
            step += 1
            for p, m, v, d in zip(layers, first, second, grads, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of the least weighted log loss, by a fine search."""
    tried, y = np.exp(np.linspace(np.log(0.25), np.log(16), 300)), y * (1 - DOUBT) + DOUBT / 2
    loss = [np.average(np.logaddexp(0, logits / t) - y * logits / t, weights=weight) for t in tried]
    return float(tried[int(np.argmin(loss))]) if len(y) else 1.0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text, share) of at most ``SAMPLE`` labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).where(~held_out("id"))
    order = F.xxhash64(F.col("id"), F.lit(11))
    picked = known.where("label = 0").orderBy(order, "id").limit(SAMPLE // 2).unionByName(known.where("label = 1").orderBy(order, "id").limit(SAMPLE // 2)).dropDuplicates(["id"])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "id").select("id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    known = labels.where(F.col(label_col).isin(0, 1)).where(~held_out(id_col))
    shares = {r[0]: r[1] for r in known.groupBy(F.col(label_col).cast("int")).count().collect()}
    constant = shares.get(1, 0) / max(sum(shares.values()), 1) if shares else 0.5
    if len(shares) < 2:
        return Model({}, np.zeros((1, 2 * SIZE), np.float32), np.zeros(0), np.ones(0), [], 1.0, constant)
    chosen = stored(labelled_sample(docs, labels, id_col, text_col, label_col))
    sample = chosen.repartition(8)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = set(term_counts(text.as_py() or ""))
                seen.update(found)
                seen.update({shape(t) for t in found})
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

    counted = sample.select("text").mapInArrow(terms, "term STRING, n BIGINT").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= TERM_DOCS)
    number = {r["term"]: k for k, r in enumerate(counted.orderBy("term").collect())}
    index = index_vectors([*number, "\x00"])
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((number, index))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index = shared.value
        sums = np.zeros(index.shape, np.float32)
        for batch in batches:
            for text in batch.column(0):
                at = np.array(numbers(_TERM.findall(text.as_py() or ""), number), np.int64)
                for k in range(1, WINDOW + 1):
                    if len(at) > k:
                        np.add.at(sums, at[:-k], index[at[k:]])
                        np.add.at(sums, at[k:], index[at[:-k]])
        parts = [sums[k : k + PART].tobytes() for k in range(0, len(sums), PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.float32) for x in table.column("sums")], axis=0, dtype=np.float64)
        return pa.table([table.column("part").slice(0, 1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "sums"])

    # the tasks' sums meet part by part; the driver gets one vector for each term of the sample
    met = sample.select("text").mapInArrow(near, "part INT, sums BINARY").groupBy("part").applyInArrow(added, "part INT, sums BINARY")
    sums = np.zeros(index.shape, np.float32)
    for row in met.toLocalIterator():
        own = np.frombuffer(row["sums"], np.float32).reshape(-1, SIZE)
        sums[row["part"] * PART : row["part"] * PART + len(own)] = own
    shared.destroy()
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    vectors = np.concatenate([sums, index / np.sqrt(PLACES)], axis=1).astype(np.float32)
    model = context.broadcast((number, vectors))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "id", "x"])

    del index, sums
    rows = sorted(sample.select("label", "text", F.xxhash64("id").alias("id")).mapInArrow(features, "label INT, id BIGINT, x BINARY").collect(), key=lambda r: (r["id"], r["x"]))
    model.destroy()
    discard(chosen)
    y = np.array([r["label"] for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return Model({}, np.zeros((1, 2 * SIZE), np.float32), np.zeros(0), np.ones(0), [], 1.0, constant)
    x = np.stack([np.frombuffer(r["x"]) for r in rows])
    weight = np.where(y == 1, shares[1] / max(y.sum(), 1), shares[0] / max((1 - y).sum(), 1))
    weight *= len(y) / weight.sum()
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = standardised(x, mean, scale)
    check = np.arange(len(y)) % 5 == 0
    layers = fit_network(x[~check], y[~check], weight[~check])
    temperature = fit_temperature(_network(x[check], layers), y[check], weight[check])
    return Model(number, vectors, mean, scale, layers, temperature, None)


def predict(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = standardised(pooled(texts, model.number, model.vectors), model.mean, model.scale)
    return 1 / (1 + np.exp(-np.clip(_network(x, model.layers) / model.temperature, -40, 40)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per row: id, held_out, score (probability of label 1), predicted (1 from ``threshold`` on)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(2)):
                scores = predict(model.value, batch.column(2).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = in_batches(docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))).mapInArrow(work, f"id {kind}, held_out BOOLEAN, score DOUBLE")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more. A null or empty text stays or goes by the network's score for
    an empty document, repeated rows stay or go together, a null id does not matter, an empty table gives an empty one and
    all columns pass unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    return kept_rows(docs, text_col, lambda: lambda texts: predict(model.value, texts) >= threshold)
