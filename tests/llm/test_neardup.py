import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import neardup, queries
from tests.llm.common import DATA, ODD, documents, prose, split_space
from tests.oracle import oracle, same_rows


def shingles(text, size):
    w = split_space(text)
    return {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()


def brute(texts, size, percent=80):
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {k: (len(sets[k]), top(k), top(k) == k) for k in range(len(texts))}


def edited(text, edits, seed):
    draw, w = random.Random(seed), text.split()
    for k in range(edits):
        w[draw.randrange(len(w))] = f"e{seed}x{k}"
    return " ".join(w)


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_its_oracle(spark):
    same_rows(queries.op8_neardup(spark, f"{DATA}/sf0.01"), oracle(f"{DATA}/sf0.01"), queries.ORACLES["op8_neardup"])


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(spark, size):
    base, other = prose(1, 150), prose(2, 60)
    texts = [*ODD, base, base.upper(), base + "  ", *(edited(base, 1 + k % 5, k) for k in range(60)), other, *(edited(other, 1 + k % 2, 100 + k) for k in range(20)), *(prose(50 + k, 30) for k in range(30)), "a b c", "A  B c", "a b", "b a"]
    assert got(neardup.near_duplicates(documents(spark, texts), size)) == brute(texts, size)


def test_a_group_without_its_origin(spark):
    """Copies that link only now and then: many components in the same buckets, verified in blocks."""
    base = prose(3, 120)
    texts = [edited(base, 3, 1000 + k) for k in range(120)]
    assert got(neardup.near_duplicates(documents(spark, texts), 4)) == brute(texts, 4)


def test_chains_have_few_edges(spark, monkeypatch):
    """A node of many buckets with other least nodes is chained by an edge or two, not by one for each bucket."""
    base, counts, whole = prose(3, 120), [], neardup.components

    def counted(edges):
        counts.append(edges.count())
        return whole(edges)

    monkeypatch.setattr(neardup, "components", counted)
    texts = [edited(base, 6, 1000 + k) for k in range(300)]
    assert got(neardup.near_duplicates(documents(spark, texts), 4)) == brute(texts, 4)
    assert max(counts) <= 2 * len(texts)


def test_blocks_of_a_cluster_meet(spark, monkeypatch):
    base = prose(4, 100)
    texts = [edited(base, 2 + k % 3, 2000 + k) for k in range(60)]
    want = brute(texts, 4)
    sets = spark.createDataFrame([(k, [hash(s) % (1 << 62) for s in shingles(t, 4)]) for k, t in enumerate(texts)], "doc_id BIGINT, shingles ARRAY<BIGINT>")
    placed = spark.createDataFrame([(k, 0) for k in range(len(texts))], "node BIGINT, cluster BIGINT")
    for most in (7, 1000):
        monkeypatch.setattr(neardup, "UNIT_SETS", most)
        labels = {r["node"]: r["comp"] for r in neardup.components(neardup.verified_clusters(sets, placed, 80)).collect()}
        assert {k: labels.get(k, k) for k in range(len(texts))} == {k: v[1] for k, v in want.items()}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a BIGINT, b BIGINT")
    assert {r["comp"] for r in neardup.components(edges).collect()} == {0, 100}


def test_sketches_fill_and_estimate():
    texts = pa.array(["one", prose(5, 30), prose(6, 400), edited(prose(6, 400), 8, 7)])
    g, begin = neardup.shingle_sets(texts, 4)
    table = neardup.sketches(g, begin, 256)
    assert (table != np.iinfo(np.uint64).max).all()
    a, b = shingles(texts[2].as_py(), 4), shingles(texts[3].as_py(), 4)
    assert abs((table[2] == table[3]).mean() - len(a & b) / len(a | b)) < 0.1
    assert (table == neardup.sketches(g, begin, 256)).all()


def test_defined_cases(spark):
    docs = documents(spark, ["same text of some words here", None, ""])
    nulls = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars", "id", "score", "held_out")
    rows = neardup.near_duplicates(docs.unionByName(nulls).unionByName(docs), 4).collect()
    assert len(rows) == 9 and all(r["kept"] for r in rows)
    assert sorted(str(r["component_id"]) for r in rows) == ["0", "0", "1", "1", "2", "2", "None", "None", "None"]
    assert neardup.near_duplicates(docs.limit(0), 4).count() == 0
    once = neardup.keep_one(docs.unionByName(docs).unionByName(nulls))
    assert once.columns == docs.columns and sorted(str(r["doc_id"]) for r in once.collect()) == ["0", "1", "2", "None", "None", "None"]


def test_columns_of_any_name_pass(spark):
    rows = [(1, prose(1, 40), "a", "b"), (1, prose(2, 40), "c", "d"), (2, prose(1, 40), "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, row STRING, _ROW STRING")
    assert sorted(tuple(r) for r in neardup.keep_one(docs).collect()) == sorted(rows[:2])


def test_hot_buckets_and_leaders_are_salted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    base = prose(3, 120)
    texts = [edited(base, 1 + k % 3, 1000 + k) for k in range(90)]
    assert got(neardup.near_duplicates(documents(spark, texts), 4)) == brute(texts, 4)


def test_rows_that_repeat_an_id_with_other_texts(spark):
    x, y, z = prose(11, 80), prose(12, 80), prose(13, 80)
    near = edited(x, 1, 3)
    rows = [(3, x), (5, x), (5, y), (7, y), (8, z), (8, near), (9, z), (9, ""), (9, None), (None, x)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    kept = [(r["doc_id"], r["text"] or "") for r in neardup.keep_one(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(3, x), (5, y), (8, z), (9, ""), (None, x)], key=repr)
