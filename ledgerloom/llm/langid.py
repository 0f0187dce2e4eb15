"""Language identification by a linear-chain conditional random field over words.

A text is a sequence of words (runs of letters, lower-cased). A word's features are its affixes of up to four letters,
its letter trigrams, the word itself and the languages whose list of frequent words holds it; transitions between the
labels of neighbouring words are learned with the feature weights. Training sequences are windows of labelled texts,
half of them spliced from two languages, so that the transitions know code-switched text. Forward-backward gives each
word of a whole text the chances of its labels; the text's language is the one with the largest sum of them, its score
that sum's share. Long texts are cut into chunks whose transfer matrices are multiplied up first, which gives the same
chances as one pass over all words and lets a batch of texts be worked on at once.

The field is fitted on windows of at most ``SAMPLE`` labelled rows outside the held-out fold (one of each language at
least), spread evenly over the languages; every row is judged by its whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if no row has a label;
ties go to the language that comes first by name; a null id is never held out; repeated rows get equal results; a text of
any length is worked on in chunks; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import cycle, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import in_batches, kept_rows, let_go, runs
from ledgerloom.llm.quality import held_out

#: Labelled rows that windows are taken from, at most; windows of a row at most, words of a window; frequent words a language
#: lists; words whose label scores a task keeps.
SAMPLE, WINDOWS, LENGTH, LISTED, KEPT = 2_000, 4, 24, 300, 200_000
#: Words between two splits of a long text.
CHUNK = 32

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if found and not text.isascii():  # numerals such as ½ are word characters, yet neither digits nor letters
        found = [w for w in found if any(map(str.isalpha, w))]
    return found


def features(word: str) -> list[str]:
    s = f"^{word}$"
    n = len(s)
    return [s, *(s[:k] for k in range(2, min(n, 6))), *(s[-k:] for k in range(2, min(n, 6))), *(s[k : k + 3] for k in range(1, n - 3))]


class Field(NamedTuple):
    langs: list[str]
    number: dict[str, int]  # features; the last rows of ``weights`` are the lists' features and an empty one
    listed: dict[str, tuple[int, ...]]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def feature_rows(self, word: str) -> list[int]:
        number, base = self.number, len(self.number)
        found = [number[f] for f in features(word) if f in number]
        return found + [base + k for k in self.listed.get(word, ())]


def _padded(rows: list[list[int]], fill: int) -> np.ndarray:
    width = max(map(len, rows), default=1) or 1
    out = np.full((len(rows), width), fill, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit_field(windows: list[tuple[str, list[str]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-5) -> Field:
    """``windows``: (language, words). The log likelihood's gradient by forward-backward, with AdaGrad."""
    langs = sorted({lang for lang, _ in windows})
    n_langs = len(langs)
    draw = np.random.default_rng(3)
    streams = [[w for lang, words in windows if lang == one for w in words] for one in langs]
    counts = [Counter(s) for s in streams]
    listed: dict[str, tuple[int, ...]] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LISTED]:
            listed[w] = (*listed.get(w, ()), k)
    vocabulary = sorted({w for c in counts for w in c})
    number = {f: k for k, f in enumerate(sorted({f for w in vocabulary for f in features(w)}))}
    place = {w: k for k, w in enumerate(vocabulary)}
    blank = len(number) + n_langs
    field = Field(langs, number, listed, np.zeros((blank + 1, n_langs)), np.zeros((n_langs, n_langs)), np.zeros(n_langs))
    if n_langs < 2:
        return field
    table = _padded([field.feature_rows(w) for w in vocabulary], blank)
    # a language's last window goes on with its first words, so that none of its words is left out
    pieces = [([place[w] for w in [*s[a : a + LENGTH], *islice(cycle(s), LENGTH)][:LENGTH]], k) for k, s in enumerate(streams) for a in range(0, len(s), LENGTH)]
    if not pieces:
        return field
    sequences, labels = np.array([p for p, _ in pieces]), np.repeat([[k] for _, k in pieces], LENGTH, 1)
    other = draw.permutation(len(pieces))  # every second sequence goes on with another one's words after some point
    for k in range(0, len(pieces), 2):
        cut = draw.integers(4, LENGTH - 4)
        sequences[k, cut:], labels[k, cut:] = sequences[other[k], cut:], labels[other[k], cut:]
    params = [field.weights, field.trans, field.start]
    squares = [np.full_like(p, 1e-6) for p in params]
    for _ in range(epochs):
        order = draw.permutation(len(sequences))
        for a in range(0, len(order), 128):
            x, y = sequences[order[a : a + 128]], labels[order[a : a + 128]]
            b = len(x)
            rows = table[x.reshape(-1)]
            emit = field.weights[rows].sum(1).reshape(b, LENGTH, n_langs)
            alpha, beta = np.empty_like(emit), np.zeros_like(emit)
            alpha[:, 0] = field.start + emit[:, 0]
            for t in range(1, LENGTH):
                alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + field.trans, 1) + emit[:, t]
            for t in range(LENGTH - 2, -1, -1):
                beta[:, t] = _logsum(field.trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            whole = _logsum(alpha[:, -1], 1)
            chance = np.exp(alpha + beta - whole[:, None, None])
            pair = np.exp(alpha[:, :-1, :, None] + field.trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]).sum((0, 1))
            hot = np.eye(n_langs)[y]
            seen = np.zeros_like(field.trans)
            np.add.at(seen, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
            gap = (hot - chance).reshape(-1, n_langs)
            flat = rows.reshape(-1)
            by_feature = np.stack([np.bincount(flat, np.repeat(gap[:, k], rows.shape[1]), blank + 1) for k in range(n_langs)], 1)
            by_feature[blank] = 0
            for p, s, g in zip(params, squares, [by_feature, seen - pair, (hot[:, 0] - chance[:, 0]).sum(0)], strict=True):
                g = g / b - decay * p
                s += g * g
                p += rate * g / np.sqrt(s)
    return field


def label_chances(field: Field, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chances of each word's labels by forward-backward: ``emit`` has the scores of the words of all texts, one after
    the other, ``first`` where each text begins (and the end); no text is empty."""
    n_langs = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True))
    step, start = np.exp(field.trans - field.trans.max()), np.exp(field.start - field.start.max())
    sizes = np.diff(first)
    pieces = -(-sizes // CHUNK)
    begin = np.concatenate(([0], np.cumsum(pieces)))
    n = begin[-1]
    doc = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(n) - begin[doc]
    at = first[doc] + nth * CHUNK
    full = np.minimum(first[doc + 1] - at, CHUNK)
    cells = np.ones((n, CHUNK, n_langs))
    inside = np.arange(CHUNK) < full[:, None]
    cells[inside] = e
    opening = nth == 0
    m = np.broadcast_to(np.eye(n_langs), (n, n_langs, n_langs)).copy()
    for j in range(CHUNK):
        on = inside[:, j]
        if j == 0:
            m[opening] = np.eye(n_langs) * (start * cells[opening, 0])[:, None, :]
            on = on & ~opening
        new = (m[on] @ step) * cells[on, j][:, None, :]
        m[on] = new / new.sum((1, 2), keepdims=True)
    entry, leave = np.ones((n, n_langs)), np.ones((n, n_langs))
    for k in range(1, int(pieces.max(initial=0))):
        at_k = begin[:-1][pieces > k] + k
        a = (entry[at_k - 1][:, None, :] @ m[at_k - 1])[:, 0]
        entry[at_k] = a / a.sum(1, keepdims=True)
    for k in range(1, int(pieces.max(initial=0))):
        at_k = begin[1:][pieces > k] - 1 - k
        b = (m[at_k + 1] @ leave[at_k + 1][:, :, None])[:, :, 0]
        leave[at_k] = b / b.sum(1, keepdims=True)
    alpha = np.empty_like(cells)
    now = entry
    for j in range(CHUNK):
        new = now @ step
        if j == 0:
            new[opening] = start
        new = new * cells[:, j]
        now = np.where(inside[:, j, None], new / new.sum(1, keepdims=True), now)
        alpha[:, j] = now
    now = leave
    for j in range(CHUNK - 1, -1, -1):
        alpha[:, j] *= now
        new = (cells[:, j] * now) @ step.T
        now = np.where(inside[:, j, None], new / new.sum(1, keepdims=True), now)
    chance = alpha[inside]
    return chance / chance.sum(1, keepdims=True)


class Labeller:
    """Label chances of whole texts; a task keeps the scores of words it has met, up to a bound."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(field.langs)))

    def word_scores(self, split: list[list[str]]) -> np.ndarray:
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, set().union(*split)
            self.scores = self.scores[:0]
        if new:
            rows = _padded([self.field.feature_rows(w) for w in new], len(self.field.weights) - 1)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, *(self.field.weights[rows[a : a + 20_000]].sum(1) for a in range(0, len(rows), 20_000))])
        at = np.fromiter((k for words in split for k in map(self.known.__getitem__, words)), np.int64, sum(map(len, split)))
        return self.scores[at]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs = self.field.langs
        split = [words_of(t) for t in texts]
        some = [k for k, words in enumerate(split) if words]
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if some and langs:
            first = np.concatenate(([0], np.cumsum([len(split[k]) for k in some])))
            chance = label_chances(self.field, self.word_scores([split[k] for k in some]), first)
            total = np.add.reduceat(chance, first[:-1], axis=0) / np.diff(first)[:, None]
            best = total.argmax(1)
            score[some] = np.clip(total[np.arange(len(some)), best], 0, 1)
            for k, b in zip(some, best, strict=True):
                names[k] = langs[b]
        return names, score


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """Windows of words of at most ``SAMPLE`` labelled rows, evenly over the languages."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").where(~held_out("id"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    # by hash order, which a first look at the hash makes cheap; no more of a language than its part, whatever repeats
    part = max(SAMPLE // len(counts), 1)
    shares = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, 2 * part / n)])
    order = F.xxhash64("id", "text", F.lit(17))
    looked = known.withColumn("seed", order).where(F.pmod("seed", F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("seed", "id"))
    chosen = looked.withColumn("place", place).where(F.col("place") <= part).select("lang", "text", "seed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for lang, text, seed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words_of(text)
                places = sorted(np.random.default_rng(abs(seed)).choice(max(len(found) // LENGTH, 1), min(WINDOWS, max(len(found) // LENGTH, 1)), replace=False))
                out += [(lang, seed, " ".join(found[p * LENGTH : (p + 1) * LENGTH])) for p in places if found]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["lang", "seed", "words"])

    rows = in_batches(chosen).mapInArrow(cut, "lang STRING, seed BIGINT, words STRING").orderBy("lang", "seed", "words").collect()  # at most WINDOWS rows for each of SAMPLE
    return [(r["lang"], r["words"].split(" ")) for r in rows]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    windows = training_windows(docs, id_col, text_col, lang_col)
    field = docs.sparkSession.sparkContext.broadcast(fit_field(windows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field.value)
        for batch in batches:
            for a, b in runs(batch.column(2)):
                names, score = labeller.predict(batch.column(2).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    found = in_batches(docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))).mapInArrow(work, f"id {kind}, held_out BOOLEAN, lang_pred STRING, score DOUBLE")
    return found.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and at least the share ``least`` of the label chances. So a null or
    empty text goes, repeated rows stay or go together, a null id does not matter, an empty table gives an empty one and
    all columns pass unchanged."""
    field = docs.sparkSession.sparkContext.broadcast(fit_field(training_windows(docs, id_col, text_col, lang_col)))

    def decider():
        labeller = Labeller(field.value)

        def decide(texts: list[str | None]) -> np.ndarray:
            names, score = labeller.predict(texts)
            return (np.array(names, object) != "und") & (score >= least)

        return decide

    return kept_rows(docs, text_col, decider)
