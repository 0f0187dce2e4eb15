import hashlib

import pytest

from ledgerloom.llm import decontam, queries
from tests.llm.common import DATA, ODD, documents, prose, split_alnum
from tests.oracle import oracle, same_rows


def brute(texts, items, width=10, slack=0):
    windows = {}
    for item, text in items:
        w = split_alnum(text)
        for k in range(max(len(w) - width + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = {}
    for k, text in enumerate(texts):
        w, hit, found = split_alnum(text), set(), set()
        for window, owners in windows.items():
            for a in range(-slack, len(w)):
                if all(any(0 <= a + j + s < len(w) and w[a + j + s] == t for s in range(-slack, slack + 1)) for j, t in enumerate(window)):
                    hit.update(range(max(a - slack, 0), min(a + len(window) + slack, len(w))))
                    found |= {str(o) for o in owners if o is not None}
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id BIGINT, text STRING, doc_id STRING")


PASSAGE = prose(1, 30)
ITEMS = [(1, PASSAGE), (10, "Only, three words!"), (2, "three words"), (3, None), (4, ""), (None, "three words"), (5, PASSAGE.upper()), (6, "a a a a a a a a a a a a"), (7, "École d'été à 2 pas")]
TEXTS = [*ODD, PASSAGE, "before " + PASSAGE + " after", " ".join(PASSAGE.split()[:9]), " ".join(PASSAGE.split()[3:14]), "only-three... words", "words three", "a " * 30, "l'École D'été à 2 pas!", prose(9, 500) + " three words " + prose(10, 500)]


def test_query_equals_its_oracle(spark):
    same_rows(queries.op9_decontam(spark, f"{DATA}/sf0.01"), oracle(f"{DATA}/sf0.01"), queries.ORACLES["op9_decontam"])


@pytest.mark.parametrize("width", [1, 3, 10])
def test_phrases_equal_brute_force(spark, width):
    docs = documents(spark, TEXTS).repartition(3)
    assert got(decontam.contamination(docs, benchmark(spark, ITEMS), width)) == brute(TEXTS, ITEMS, width)


@pytest.mark.parametrize("slack", [1, 2])
def test_proximity_equals_brute_force(spark, slack):
    w = PASSAGE.split()
    texts = [*TEXTS, " ".join([*w[:5], "extra", *w[5:12]]), " ".join([*w[:4], w[5], w[4], *w[6:12]])]
    assert got(decontam.contamination(documents(spark, texts), benchmark(spark, ITEMS), 10, slack)) == brute(texts, ITEMS, 10, slack)


def test_blocks_of_items_and_an_index_of_all_terms(spark, monkeypatch):
    want = brute(TEXTS, ITEMS)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    assert got(decontam.contamination(documents(spark, TEXTS), benchmark(spark, ITEMS))) == want
    monkeypatch.setattr(decontam, "VOCABULARY_TERMS", 3)
    assert got(decontam.contamination(documents(spark, TEXTS), benchmark(spark, ITEMS))) == want


def test_defined_cases(spark):
    docs = documents(spark, TEXTS)
    assert got(decontam.contamination(docs, benchmark(spark, ITEMS).limit(0))) == brute(TEXTS, [])
    assert decontam.contamination(docs.limit(0), benchmark(spark, ITEMS)).count() == 0
    kept = decontam.keep_clean(docs, benchmark(spark, ITEMS))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in brute(TEXTS, ITEMS).items() if not v[4]}
