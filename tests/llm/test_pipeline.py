import corpus_pipeline
from ledgerloom.llm import langid, quality
from ledgerloom.llm.common import stored
from ledgerloom.tables import read
from tests.llm.common import DATA, ODD, documents
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_neardup import brute as brute_copies


def test_stages_equal_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    docs = read(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality", "language", "near_duplicates", "decontamination", "token_ids"]
    good = stored(stages["quality"](spark, docs, sf))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, read(spark, sf, "labels")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {k for k, s in scores.items() if s >= 0.3} and good.columns == docs.columns
    known = stored(stages["language"](spark, good, sf))
    langs = {r["doc_id"]: r for r in langid.identify(good).collect()}
    assert {r["doc_id"] for r in known.collect()} == {k for k, r in langs.items() if r["lang_pred"] != "und" and r["score"] >= 0.35}
    single = stored(stages["near_duplicates"](spark, known, sf))
    rows = sorted(known.collect(), key=lambda r: r["doc_id"])
    copies = brute_copies([r["text"] for r in rows], 5)
    assert {r["doc_id"] for r in single.collect()} == {rows[k]["doc_id"] for k, v in copies.items() if v[2]}
    clean = stored(stages["decontamination"](spark, single, sf))
    rows = single.collect()
    hits = brute_hits([r["text"] for r in rows], [(r["item_id"], r["text"]) for r in read(spark, sf, "benchmark").collect()])
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for k, r in enumerate(rows) if not hits[k][4]}
    assert clean.columns == docs.columns
    last = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in clean.collect()}


def test_stages_take_odd_rows(spark, tmp_path):
    docs = documents(spark, ODD, clash=False)
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(len(ODD))], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one"), (None, None)], "item_id BIGINT, text STRING").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() >= 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
