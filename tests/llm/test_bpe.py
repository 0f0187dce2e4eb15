import hashlib
import random

import numpy as np
import pytest
import zlib
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from ledgerloom.llm import bpe, common, orc_tokens, queries
from tests.llm.common import DATA, ODD, documents
from tokenizers import Tokenizer

PATH = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def encoders():
    text = bpe.vocabulary_text(PATH)
    return [bpe.Encoder(text, kind(text)) for kind in (bpe.TrieEncoder, orc_tokens.LibraryEncoder)]


def check(encoders, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    for k, encoder in enumerate(encoders):
        (raw, decoded), = encoder.encode([text])
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert k or decoded == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [t for t in ODD if t is not None], ids=range(len(ODD) - 1))
def test_odd_texts(encoders, library, text):
    check(encoders, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdefg ABCDE'.!019 \n\u0130\u0322\u0307"), st.characters(min_codepoint=32, max_codepoint=0x24F), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_texts_encode_as_the_library_does(encoders, library, text):
    check(encoders, library, text)


def test_each_character_encodes_as_the_library_does(encoders, library):
    """Every character of the Basic Multilingual Plane and those past it, alone, between letters, after a capital."""
    points = [k for k in (*range(0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x10000), *range(0x10000, 0x1FFFF, 53)) if chr(k) not in "<|>"]
    for texts in ([chr(k) for k in points], [f"a{chr(k)}b 1{chr(k)}" for k in points], [f"É{chr(k)}'s{chr(k)}" for k in points]):
        want = library.encode_batch_fast(texts, add_special_tokens=False)
        for encoder in encoders:
            for k, w, (raw, _) in zip(texts, want, encoder.encode(texts, decode=False), strict=True):
                assert np.frombuffer(raw, "<u4").tolist() == w.ids, repr(k)


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 8)
    text = bpe.vocabulary_text(PATH)
    encoder = bpe.Encoder(text, bpe.TrieEncoder(text))
    for t in ("some words of a text", "other words in another one", "some words of a text"):
        check([encoder], library, t)


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op7_bpe(spark, f"{DATA}/sf0.001").collect()}
    assert got == want


def test_orc_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, {}
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op2_orc_tokens(spark, f"{DATA}/sf0.001").collect()} == want


def test_orc_files_prune_and_round_trip(spark, library, tmp_path):
    docs = documents(spark, [*ODD, *(f"text number {k}" for k in range(500))]).unionByName(documents(spark, ["one more"], first=3))
    path = f"file://{tmp_path}/ids"
    orc_tokens.write(docs, path, PATH)
    back = orc_tokens.read_tokens(spark, path)
    assert back.count() == docs.count()
    for r in back.where("doc_id < 40").collect():
        texts = [d["text"] for d in docs.where(F.col("doc_id") == r["doc_id"]).collect()]
        assert r["ids"] in [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    plan = back.where("doc_id = 77")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,77)" in plan
    parts = [[r["doc_id"] for r in spark.read.orc(f).collect()] for f in sorted(back.inputFiles())]
    flat = [k for p in parts for k in p]
    assert flat == sorted(flat)


def test_defined_cases(spark):
    docs = documents(spark, ODD)
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(docs, PATH).collect()}
    assert got[0] == got[1] == got[2] == 0 and len(got) == len(ODD)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
    ends = {r["doc_id"]: r["n_tokens"] for r in orc_tokens.write_and_digest(docs, PATH).collect()}
    assert ends[0] == ends[1] == 1
    assert orc_tokens.write_and_digest(docs.limit(0), PATH).count() == 0


def test_places_over_groups_of_files(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(orc_tokens, "FILES", 3)
    path = f"file://{tmp_path}/ids"
    rows = orc_tokens.encoded(documents(spark, [f"text {'more ' * (k % 7)}" for k in range(200)]), PATH, 1, "doc_id", "text", partitions=11)
    rows.withColumn("part", F.spark_partition_id()).write.orc(path)
    start = 0
    for r in orc_tokens.digest(spark, path).orderBy("doc_id").collect():
        assert r["start"] == start
        start += r["n_tokens"]
    assert len(orc_tokens.read_tokens(spark, path).inputFiles()) > 6


def test_runs_cut_a_column_by_bytes():
    import pyarrow as pa

    column = pa.array(["abc", None, "x" * 50, "", "de"]).slice(0, 5)
    assert [*common.runs(column, 4)] == [(0, 2), (2, 3), (3, 5)] and [*common.runs(column.slice(0, 0))] == []


def test_a_worker_lets_go_of_the_encoder_for_another_operator(spark):
    """Workers are used again: what token ids keep in them must not stay beside another operator's own memory."""
    docs = documents(spark, ["some words here"] * 40).repartition(8)

    def left():
        kept = len(common._KEPT)
        return lambda texts: np.full(len(texts), kept > 0)

    for _ in range(2):
        assert bpe.encode_documents(docs, PATH).count() == 40
        bpe.encode_documents(docs, PATH).collect()
        assert common.kept_rows(docs, "text", left).count() == 0


def test_tokens_stay_apart_where_merging_leaves_them():
    """Looking at the border of two tokens alone tells the same as merging their letters."""
    kind = bpe.TrieEncoder(bpe.vocabulary_text(PATH))
    assert kind.ordered
    pick = random.Random(3)
    tokens = sorted(kind.ids)
    opens = [t for t in tokens if not t.endswith(bpe.WORD_END)]
    pairs = [(pick.choice(opens), pick.choice(tokens)) for _ in range(2_000)] + [(t, t) for t in pick.sample(opens, 500)] + [(t[-1], t) for t in pick.sample(opens, 500)]
    told = [kind.apart(*p) for p in pairs]
    assert told == [kind.merged(kind.symbols(a) + kind.symbols(b)) == [a, b] for a, b in pairs] and {*told} == {True, False}
