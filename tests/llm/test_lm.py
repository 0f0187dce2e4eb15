import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import lm, queries
from tests.llm.common import DATA, ODD, documents, fold, prose, split_space


def tokens(text):
    return [*split_space(text), None]


def brute_base(texts):
    """doc_id -> (held out, tokens, known, train tokens, base score)."""
    train = [t for k, t in texts.items() if k is None or fold(k, 7) != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {k: (k is not None and fold(k, 7) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in texts.items()}


def check(rows, texts):
    want = brute_base(texts)
    assert len(rows) == len(texts)
    for r in rows:
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and np.isfinite(r["score"]) and r["score"] <= 0


def test_query_base_equals_brute_force_and_the_model_is_better(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    rows = queries.op5_lm(spark, f"{DATA}/sf0.001").collect()
    check(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_scores(texts, order):
    """The whole model in plain Python: counts, deleted counts, weights by the operator's EM, scores."""
    import zlib

    gone = {k for k in texts if fold(k, 7) != 2 and zlib.crc32(f"deleted {k}".encode()) % lm.DELETED_OF == 0}
    grams = [Counter() for _ in range(order)]
    cut = [Counter() for _ in range(order)]

    def of(text):
        t = tokens(text)
        return [[tuple((["<s>"] * order + t)[order + k - size + 1 : order + k + 1]) for size in range(1, order + 1)] for k in range(len(t))]

    for k, t in texts.items():
        if fold(k, 7) != 2:
            for own in of(t):
                for s, g in enumerate(own):
                    grams[s][g] += 1
                    cut[s][g] += k in gone

    def parts(text, less):
        counts = [Counter(g) - Counter(c) if less else g for g, c in zip(grams, cut)]
        n = sum(counts[0].values())
        for own in of(text):
            context, p = 0, [counts[0][own[0]] / max(n, 1)]
            for s in range(1, order):
                h = own[s][:-1]
                context = counts[0][(None,)] if h[-1] == "<s>" else counts[s - 1][h]
                p.append(counts[s][own[s]] / context if context else 0.0)
            yield min(1 + int(math.log2(context)), lm.CLASSES - 1) if context else 0, p

    uniform = 1 / (len(grams[0]) + 1)
    cells = {}
    for k in gone:
        for kind, p in parts(texts[k], True):
            cell = kind
            for e in p:
                cell = cell * lm.LEVELS + (1 + min(max(math.floor(-2 * math.log2(e)), 0), lm.LEVELS - 2) if e > 0 else 0)
            n, s = cells.get(cell, (0, [0.0] * order))
            cells[cell] = (n + 1, [a + b for a, b in zip(s, p)])
    weights = lm.mixture_weights(sorted((c, n, s) for c, (n, s) in cells.items()), order, uniform)
    return {k: sum(math.log10(weights[kind] @ np.array([uniform, *p])) for kind, p in parts(t, False)) for k, t in texts.items()}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "DELETED_OF", 4)
    texts = {k: t for k, t in enumerate([*ODD, *(prose(k, 20 + k, 60) for k in range(60)), prose(7, 27, 60)])}
    docs = documents(spark, [texts[k] for k in range(len(texts))]).repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, order).collect()}
    want = brute_scores(texts, order)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in got)


def test_small_chunks_change_nothing(spark, monkeypatch):
    texts = [prose(k, 40, 50) for k in range(40)]
    whole = {r["doc_id"]: r["score"] for r in lm.score(documents(spark, texts)).collect()}
    for chunk, pack, bucket in ((500, 500, 8 << 20), (500, 2_000, 400), (2_000, 500, 100)):
        for name, size in (("CHUNK_BYTES", chunk), ("PACK_BYTES", pack), ("BUCKET_BYTES", bucket)):
            monkeypatch.setattr(lm, name, size)
        assert {r["doc_id"]: r["score"] for r in lm.score(documents(spark, texts)).collect()} == pytest.approx(whole)


def test_rows_sent_follow_packs_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 500)
    monkeypatch.setattr(lm, "PACK_BYTES", 4_000)
    packs = lm.pack_rows(documents(spark, [prose(k, 40, 50) for k in range(60)]).coalesce(1), "doc_id", "text").collect()
    assert max(len(p["chunks"]) for p in packs) > 3 and sorted(i for p in packs for c in p["chunks"] for i in c["ids"]) == [*range(60)]
    rows = [{"pack": p["pack"], "deleted": p["deleted"], "bytes": p["bytes"], "chunks": [c.asDict() for c in p["chunks"]]} for p in packs]
    sent = pa.Table.from_batches(lm.send(2, 4)(iter(pa.Table.from_pylist(rows, lm._PACK).to_batches()))).to_pylist()
    assert len(sent) <= len(packs) * 4 * 2


def test_defined_cases(spark):
    docs = documents(spark, ODD)
    check(lm.score(docs).collect(), dict(enumerate(ODD)))
    assert lm.score(docs.limit(0)).count() == 0
    held = [k for k in range(60) if fold(k, 7) == 2]
    only = documents(spark, ["a b"] * 60).where(f"doc_id IN ({','.join(map(str, held))})")
    assert {(r["train_tokens"], r["base_score"]) for r in lm.score(only).collect()} == {(0, 0.0)}


def test_steps_round_trip():
    keys = np.array([5, 6, (1 << 33) + 1, (1 << 47), (1 << 48) - 1], np.uint64)
    made, place = lm.steps(keys)
    assert (np.cumsum(made, dtype=np.uint64)[place] == keys).all()
