import numpy as np
import pytest

from ledgerloom.llm import ann, queries
from tests.llm.common import DATA
from tests.oracle import oracle, same_rows


def brute(rows, every, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = []
    for i, q in good:
        if i % every == 0:
            near = sorted(((-float(sum(a * b for a, b in zip(q, v))), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, rank INT, score STRING")


def vectors(n, d, seed):
    return [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(np.random.default_rng(seed).normal(size=(n, d)))]


def test_query_equals_its_oracle(spark):
    same_rows(queries.op6_ann(spark, f"{DATA}/sf0.01"), oracle(f"{DATA}/sf0.01"), queries.ORACLES["op6_ann"])


@pytest.mark.parametrize("block,group", [(16_384, 16_384), (50, 7)])
def test_blocks_and_groups_give_what_brute_force_gives(spark, monkeypatch, block, group):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "GROUP", group)
    rows = vectors(300, 24, 1)
    rows += [(1000 + k, rows[3][1]) for k in range(60)] + [(2000, rows[3][1])] * 2  # one vector many times, one row twice
    rows += [(3000, None), (3020, []), (3040, [0.0] * 24), (3060, [float("nan")] * 24), (3080, [float("inf")] + [1.0] * 23), (3100, [None] + [1.0] * 23), (None, rows[0][1]), (3120, rows[5][1][:9])]
    assert got(ann.nearest(frame(spark, rows), 20, 10)) == brute(rows, 20, 10)


def test_few_and_no_candidates(spark):
    rows = vectors(4, 8, 2)
    assert got(ann.nearest(frame(spark, rows), 2, 20)) == brute(rows, 2, 20)
    assert ann.nearest(frame(spark, rows).limit(0)).count() == 0
    assert ann.nearest(frame(spark, rows[:1])).count() == 0


def test_tiny_large_and_negative(spark):
    rows = [(k, [float(x) for x in np.random.default_rng(abs(k)).normal(size=6) * 10.0 ** e]) for k, e in ((-20, 0), (0, -200), (1, -200), (2, 150), (3, 0), (4, 0), (20, -170))]
    rows += [(-20, rows[0][1]), (-7, rows[3][1]), (-7, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert got(ann.nearest(df, 20, 20)) == brute(rows, 20, 20)


def test_recall_on_a_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    want = set()
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        want |= {(int(ids[k]), int(i)) for i in ids[np.lexsort((ids, -s))[:20]]}
    found = {(r["query_id"], r["vec_id"]) for r in queries.op6_ann(spark, f"{DATA}/sf0.1").collect()}
    assert len(found) == len(want) and len(found & want) / len(want) >= 0.99


def test_bounds_hold_as_often_as_they_should():
    x = np.random.default_rng(3).normal(size=(2000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    packed, length, cosine = ann.codes(x)
    middle, half = ann.estimates(packed, cosine, unit[:50] @ ann.rotation(64))
    off = np.abs(middle - unit[:50] @ unit.T) > half
    assert np.allclose(length, np.linalg.norm(x, axis=1)) and off[:, 50:].mean() < 0.06
