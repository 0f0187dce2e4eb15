"""Quality, language and URL classifiers: held-out accuracy, calibration, exact inference, defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import gbt, langid, quality, queries, urlfilter
from ledgerloom.tables import read
from tests.llm.common import DATA, ODD, documents, fold, prose


def test_quality_of_held_out_documents(spark):
    rows = queries.op1_quality(spark, f"{DATA}/sf0.1").join(read(spark, f"{DATA}/sf0.1", "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    for label in (0, 1):
        own = [r["predicted"] == label for r in held if r["quality"] == label]
        assert np.mean(own) > 0.95
    p, y = np.array([r["score"] for r in held]), np.array([r["quality"] for r in held])
    assert np.mean((p - y) ** 2) < 0.03 and abs(p.mean() - y.mean()) < 0.03


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, quality INT, toxic INT")


def test_quality_defined_cases(spark):
    docs = documents(spark, ODD)
    for rows, share in (([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, None, 0)], 0.5)):
        scored = quality.score(docs, labels(spark, rows)).collect()
        assert len(scored) == len(ODD) and {r["score"] for r in scored} == {share}
    both = labels(spark, [(k, k % 2, 0) for k in range(len(ODD))] * 2)
    scored = quality.score(docs, both).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(docs.limit(0), both).count() == 0
    kept = quality.keep_good(docs, labels(spark, []), threshold=0.3)
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_quality_equals_a_plain_version(spark):
    """Word vectors, pooling and scores worked out anew, term by term, with the fitted network's weights."""
    from collections import Counter

    texts = [f"{'good' if k % 3 else 'BAD'} {prose(k, 5 + k % 40, 60 if k % 3 else 90)} {'!!' if not k % 3 else ''} x{k} the the" for k in range(160)] + [None, "", "one"]
    docs, table = documents(spark, texts), labels(spark, [(k, int(bool(k % 3)), 0) for k in range(150)])
    model = quality.fit(docs, table)
    split = [quality._TERM.findall(t or "") for t in texts]
    fitted = [split[k] for k in range(150) if fold(k, 5)]
    seen = Counter(x for words in fitted for x in {*words, *({"\x01"} if any(a == b for a, b in zip(words, words[1:])) else ()), *map(quality.shape, words), *({quality.shape("\x01")} if any(a == b for a, b in zip(words, words[1:])) else ())})
    own = {x for x, n in seen.items() if n >= quality.TERM_DOCS}
    assert set(model.number) == own
    name = lambda x: x if x in own else quality.shape(x) if quality.shape(x) in own else "\x00"
    index = {x: quality.index_vectors([x])[0].astype(float) for x in (*own, "\x00")}
    near = {x: np.zeros(quality.SIZE) for x in index}
    for words in fitted:
        named = [name(x) for x in words]
        for i, x in enumerate(named):
            for j in range(max(0, i - quality.WINDOW), min(len(named), i + quality.WINDOW + 1)):
                if i != j:
                    near[x] = near[x] + index[named[j]]
    vector = {x: np.concatenate((near[x] / max(np.linalg.norm(near[x]), 1e-9), index[x] / np.sqrt(quality.PLACES))) for x in index}
    want = []
    for words in split:
        counts = Counter(words)
        if again := sum(a == b for a, b in zip(words, words[1:])):
            counts["\x01"] = again
        tally = Counter()
        for x, n in counts.items():
            tally[name(x)] += n
        total = sum(counts.values())
        pool = sum((np.log1p(n) * vector[x] for x, n in tally.items()), np.zeros(2 * quality.SIZE)) / max(sum(map(np.log1p, tally.values())), 1e-9)
        z = (np.concatenate((pool, [np.log1p(total), len(counts) / max(total, 1)])) - model.mean) / model.scale
        z[:-2] *= total / (total + quality.SHRINK)
        w1, b1, w2, b2 = model.layers
        want.append(1 / (1 + np.exp(-(np.tanh(z @ w1 + b1) @ w2 + b2[0]) / model.temperature)))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, table).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-4)


def test_quality_network_gradients_fit():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # needs the hidden layer
    layers = quality.fit_network(x, y, np.ones(600), epochs=200)
    assert np.mean((quality._network(x, layers) > 0) == (y == 1)) > 0.9
    assert quality.fit_temperature(np.array([30.0, -30.0, 30.0]), np.array([1.0, 0.0, 0.0]), np.ones(3)) > 4


def test_language_of_held_out_documents(spark):
    rows = queries.op3_langid(spark, f"{DATA}/sf0.1").join(read(spark, f"{DATA}/sf0.1", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_defined_cases(spark):
    docs = documents(spark, ODD)
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for k, text in enumerate(ODD):
        has_letter = bool(text) and any(map(str.isalpha, text))
        assert (rows[k]["lang_pred"] == "und") == (not has_letter)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(ODD)


def test_a_language_of_few_words_is_learned(spark):
    rows = [(k, prose(k, 60), "w") for k in range(40)] + [(100 + k, "bonjour le monde entier", "fr") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    asked = docs.unionByName(spark.createDataFrame([(500, "bonjour monde", None)], docs.schema))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked).collect()}[500] == "fr"


def test_windows_come_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    docs = spark.createDataFrame([(1, f"same id {k}", "en") for k in range(300)] + [(2, "ein text", "de")], "doc_id BIGINT, text STRING, lang STRING")
    windows = langid.training_windows(docs, "doc_id", "text", "lang")
    assert len(windows) == 11 and {lang for lang, _ in windows} == {"en", "de"}


def test_forward_backward_in_chunks_is_exact():
    draw = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"], {}, {}, np.zeros((4, 3)), draw.normal(size=(3, 3)), draw.normal(size=3))
    sizes = [1, 5, 31, 32, 33, 64, 65, 300]
    emit, first = draw.normal(size=(sum(sizes), 3)) * 3, np.concatenate(([0], np.cumsum(sizes)))
    found = langid.label_chances(field, emit, first)
    for a, b in zip(first, first[1:]):
        e = emit[a:b]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = field.start + e[0]
        for t in range(1, len(e)):
            alpha[t] = langid._logsum(alpha[t - 1][:, None] + field.trans, 0) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = langid._logsum(field.trans + e[t + 1] + beta[t + 1], 1)
        assert np.allclose(found[a:b], np.exp(alpha + beta - langid._logsum(alpha[-1], 0)), atol=1e-9)


def test_code_switched_words_get_their_own_labels(spark):
    docs = read(spark, f"{DATA}/sf0.1", "documents")
    field = langid.fit_field(langid.training_windows(docs, "doc_id", "text", "lang"))
    labeller = langid.Labeller(field)
    en, de = (docs.where(f"lang = '{x}' AND n_chars BETWEEN 500 AND 900 AND text NOT LIKE '%|%'").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    split = [langid.words_of(en)[:40] + langid.words_of(de)[:40]]
    chance = langid.label_chances(field, labeller.word_scores(split), np.array([0, 80]))
    label = np.array(field.langs)[chance.argmax(1)]
    assert np.mean(label[:40] == "en") > 0.9 and np.mean(label[40:] == "de") > 0.9


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[end : min([rest.find(c, end) for c in "?#" if c in rest[end:]] or [len(rest)])]
    fit = [(len(r), r, v) for v, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fit)[1:] if fit else (None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://example.com/en/", "https://example.com/en", "https://example.com", "https://a.b.example.com/en/1?x=/es/#y", "x://net/es/1", "x://notnet/es/1", "x://a.net/fr/?q", "x://a.net?/es/", "x://a.net#/es/", "x://a://b.net/es/", "x://É.Net/es/a\nb", "ftp://www.example.com/en/z", "x://xexample.com/en/"]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(URLS)], "page_id BIGINT, url STRING, host STRING, top DOUBLE")
    for r in urlfilter.judge(pages, queries.URL_RULES).collect():
        host, path, rule, verdict = brute_url(URLS[r["page_id"]], queries.URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert urlfilter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, []).collect()} == {"allow"}


def test_url_query_equals_brute_force_and_trees_agree_with_rules(spark):
    pages = {r["page_id"]: r["url"] for r in read(spark, f"{DATA}/sf0.01", "pages").collect()}
    rows = queries.op4_urlfilter(spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute_url(pages[r["page_id"]], queries.URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (rule is None or r["verdict"] == verdict)
    ruled = [r for r in rows if r["rule"]]
    assert np.mean([(r["block_score"] >= 0.5) == (r["verdict"] == "block") for r in ruled]) > 0.85


def test_boosted_trees_learn_an_interaction():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = gbt.fit(x[:2000], y[:2000], rounds=40, depth=3)
    assert np.mean((gbt.predict(model, x[2000:]) > 0.5) == (y[2000:] == 1)) > 0.95
    for y in (np.zeros(5), np.ones(5)):
        assert ((gbt.predict(gbt.fit(x[:5], y), x[:5]) > 0.5) == (y == 1)).all()
    assert len(gbt.predict(gbt.fit(x[:0], y[:0]), x[:0])) == 0
