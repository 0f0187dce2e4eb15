"""Benchmark decontamination by a positional inverted index that is spread over the cluster.

The training side is indexed shard by shard: a shard is a run of documents inside a task, and its row of the index
holds, for each term that the test items use, the ascending list of the term's positions (documents of a shard follow
each other on one axis, with gaps that no phrase bridges). Terms that no test item uses cannot be part of a match and
are left out. A search takes the windows of the test items, orders the terms of each by the length of their lists in
the shard, starts from the rarest term's list, and keeps a start only if each further list, moved by the term's
offset, has it. With ``slack`` 0 that is the exact phrase; with more, each term may stand up to so many words away
from its place after the start (a proximity match), and the words of a match are those up to ``slack`` around it. No list leaves its shard, so no shuffle and no skew arise.

Defined cases: a null or empty text, or one without a word, has no words and no hits; null or repeated item ids count
as they stand (null ids are left out of the list of ids); repeated documents give repeated rows; an empty test table
finds nothing; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import NOT_ALNUM, discard, in_batches, runs, stored, utf8, without, words

#: Test items are searched in blocks of at most so many bytes of text; more items make more passes over the index.
BLOCK_BYTES = 8 << 20
#: Up to so many terms of test items choose what is indexed; beyond that all terms are.
VOCABULARY_TERMS = 8 << 20

_INDEX = [("doc_ids", pa.int64()), ("n_words", pa.int32()), ("terms", pa.int64()), ("list_sizes", pa.int32()), ("steps", pa.int32())]
_HITS = [("hit_from", pa.int32()), ("hit_to", pa.int32()), ("hit_doc", pa.int32()), ("hit_item", pa.string())]
_SHARD = pa.schema([(name, pa.list_(kind)) for name, kind in _INDEX + _HITS])
SHARD = "doc_ids ARRAY<BIGINT>, n_words ARRAY<INT>, terms ARRAY<BIGINT>, list_sizes ARRAY<INT>, steps ARRAY<INT>, hit_from ARRAY<INT>, hit_to ARRAY<INT>, hit_doc ARRAY<INT>, hit_item ARRAY<STRING>"
FOUND = "doc_id BIGINT, n_words BIGINT, n_hit BIGINT, items ARRAY<STRING>"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Windows(NamedTuple):
    """Distinct windows of a block of test items: ``terms`` is the sorted vocabulary (hashes); ``at`` has a row of
    term numbers for each window, filled up with -1; the items of window w are ``items[ends[w]:ends[w + 1]]``."""

    terms: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    items: list[str]
    ends: np.ndarray


def windows_of(ids: list[str], texts: list[str], width: int) -> Windows:
    h, first = words(*utf8(pa.array(texts, pa.string())), NOT_ALNUM)
    terms, number = np.unique(h, return_inverse=True)
    owners: dict[tuple[int, ...], list[str]] = {}
    for k, item in enumerate(ids):
        row = number[first[k] : first[k + 1]].tolist()
        for j in range(max(len(row) - width + 1, 1 if row else 0)):
            owners.setdefault(tuple(row[j : j + width]), []).append(item)
    at = np.full((len(owners), width), -1, np.int64)
    for k, window in enumerate(owners):
        at[k, : len(window)] = window
    owned = [list(dict.fromkeys(x)) for x in owners.values()]
    return Windows(terms, at, (at >= 0).sum(1), [i for x in owned for i in x], np.concatenate(([0], np.cumsum([len(x) for x in owned]))).astype(np.int64))


def item_blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> Iterator[Windows]:
    """The windows of the test items, in blocks of bounded size."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    items = stored(items)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // (BLOCK_BYTES // 2)) + 1
    for k in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        rows = block.collect()
        yield windows_of([r["id"] for r in rows], [r["text"] for r in rows], width)
    discard(items)


def build_index(docs: DataFrame, terms: np.ndarray | None, gap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``docs``, a row for each shard; of the given terms (sorted hashes) or of all."""
    wanted = docs.sparkSession.sparkContext.broadcast(terms)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(1)):
                h, first = words(*utf8(batch.column(1).slice(a, b - a)), NOT_ALNUM)
                counts = np.diff(first)
                axis = np.arange(len(h)) + gap * np.repeat(np.arange(len(counts)), counts)
                if wanted.value is not None:
                    place = np.searchsorted(wanted.value, h)
                    place[place == len(wanted.value)] = 0
                    kept = wanted.value[place] == h if len(wanted.value) else np.zeros(len(h), bool)
                    h, axis = h[kept], axis[kept]
                order = np.argsort(h, kind="stable")
                h, axis = h[order], axis[order]
                own, begin, sizes = np.unique(h, return_index=True, return_counts=True)
                steps = np.diff(axis, prepend=0)
                steps[begin] = axis[begin]
                made = [batch.column(0).slice(a, b - a).to_pylist(), counts, own.view(np.int64), sizes, steps, [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, _SHARD.types, strict=True)], schema=_SHARD)

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(picked).mapInArrow(shards, SHARD)


def occurrences(w: Windows, terms: np.ndarray, sizes: np.ndarray, axis: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts on a shard's axis and the windows that occur there: lists are intersected from the rarest term on.
    ``terms`` are term numbers of ``w``, ascending; ``axis`` has their lists one after the other."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(axis) or not len(w.at):
        return none
    begin = np.zeros(len(w.terms) + 1, np.int64)
    begin[terms + 1] = sizes
    count = np.append(begin[1:], np.iinfo(np.int64).max)  # the last stands for the places after a short window's end
    begin = np.cumsum(begin)
    per_term = count[w.at]
    live = np.flatnonzero(per_term.min(1) > 0)
    if not len(live):
        return none
    order = np.argsort(per_term[live], axis=1, kind="stable")
    rarest = w.at[live, order[:, 0]]
    n = count[rarest]
    row = np.repeat(np.arange(len(live)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[rarest], n)
    start = axis[at] - order[row, 0]
    if slack:  # the rarest term itself may stand away from its place, too
        row, start = np.repeat(row, 2 * slack + 1), (start[:, None] + np.arange(-slack, slack + 1)).ravel()
    room = int(axis.max()) + 2 * (w.at.shape[1] + slack) + 2
    keyed = np.repeat(terms, sizes) * room + axis
    for k in range(1, w.at.shape[1]):
        place = order[row, k]
        term = w.at[live[row], place]
        due = term * room + start + place
        found = np.minimum(np.searchsorted(keyed, due - slack), len(keyed) - 1)
        keep = (term < 0) | ((keyed[found] >= due - slack) & (keyed[found] <= due + slack))
        row, start = row[keep], start[keep]
    return start, live[row]


def search(block: Broadcast, gap: int, slack: int = 0) -> Step:
    """A step over index batches that adds the hits of a block of windows to each shard: ranges of its axis, documents
    and items."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = block.value
        for batch in batches:
            for k in range(batch.num_rows):
                shard = [batch.column(c).slice(k, 1).flatten() for c in range(batch.num_columns)]
                counts, terms, sizes, steps = (x.to_numpy().astype(np.int64) for x in shard[1:5])
                terms = terms.view(np.uint64)
                total = np.cumsum(steps)
                begin = np.cumsum(sizes) - sizes
                axis = total - np.repeat(total[begin] - steps[begin], sizes) if len(steps) else total
                number = np.searchsorted(w.terms, terms)
                number[number == len(w.terms)] = 0
                known = w.terms[number] == terms if len(w.terms) else np.zeros(len(terms), bool)
                start, window = occurrences(w, number[known], sizes[known], axis[np.repeat(known, sizes)], slack)
                ends = np.cumsum(counts) + gap * np.arange(len(counts))
                base = ends - counts
                doc = np.searchsorted(base, start + slack, "right") - 1
                spans = np.unique(np.stack([np.maximum(start - slack, base[doc]), np.minimum(start + w.sizes[window] + slack, ends[doc])]), axis=1)
                owned = sorted({(d, i) for d, x in {*zip(doc.tolist(), window.tolist(), strict=True)} for i in w.items[w.ends[x] : w.ends[x + 1]] if i is not None})
                added = [spans[0], spans[1], [d for d, _ in owned], [i for _, i in owned]]
                made = shard[:5] + [pa.concat_arrays([old, pa.array(new, old.type)]) for old, new in zip(shard[5:], added, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in made], schema=_SHARD)

    return hits


def matches(gap: int) -> Step:
    """A step that tells for each document of the shards its words, the words inside hits and the items found."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts, *_, start, stop, doc, item = (batch.column(c).slice(k, 1).flatten() for c in range(batch.num_columns))
                counts = counts.to_numpy().astype(np.int64)
                ends = np.cumsum(counts) + gap * np.arange(len(counts))
                cover = np.zeros((int(ends[-1]) if len(ends) else 0) + 1, np.int64)
                np.add.at(cover, start.to_numpy(), 1)
                np.add.at(cover, stop.to_numpy(), -1)
                inside = np.concatenate(([0], np.cumsum(np.cumsum(cover) > 0)))
                items: list[set[str]] = [set() for _ in range(len(counts))]
                for d, i in zip(doc.to_pylist(), item.to_pylist(), strict=True):
                    items[d].add(i)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(inside[ends] - inside[ends - counts], pa.int64()), pa.array([[*x] for x in items], pa.list_(pa.string()))], schema=_FOUND_ARROW)

    return documents


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: words, words inside any occurrence of a window of ``width`` item words, the items found.

    Columns: the id, n_words, n_hit, n_items, items_sha256 (of the sorted ids joined by commas), contaminated.
    """
    gap, vocabulary, blocks = width + 2 * slack + 1, np.zeros(0, np.uint64), 0
    for block in item_blocks(benchmark, width, item_id_col, item_text_col):
        blocks += 1
        if vocabulary is not None:
            vocabulary = np.union1d(vocabulary, block.terms)
            vocabulary = vocabulary if len(vocabulary) <= VOCABULARY_TERMS else None
    index = stored(build_index(docs, vocabulary, gap, id_col, text_col))
    tell = matches(gap)
    for k, windows in enumerate(item_blocks(benchmark, width, item_id_col, item_text_col)):
        step = search(docs.sparkSession.sparkContext.broadcast(windows), gap, slack)
        if k < blocks - 1:
            older, index = index, stored(index.mapInArrow(step, SHARD))
            discard(older)
    found = stored(index.mapInArrow(lambda batches: tell(step(batches)), FOUND))
    discard(index)
    return found.select(
        F.col("doc_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of a test item occurs. Null and empty texts and rows with a null id stay; of
    rows that repeat an id all go if one holds a window; an empty table gives an empty one; all columns pass unchanged."""
    found = contamination(docs, benchmark, width, id_col=id_col, text_col=text_col)
    return without(docs, found.where("contaminated").select(id_col), id_col)
