"""URL filters: allow and block rules by host and path, and gradient-boosted trees on lexical features elsewhere.

Host and path, the longest fitting rule and the features are DataFrame expressions; the trees are fitted on a sample of
at most ``SAMPLE`` labelled URLs (those that a rule decides, chosen by hash) and applied to batches. Suffix statistics
are the smoothed shares of blocked URLs by top-level domain and by the last two labels of the host, over all labelled
URLs; they are joined by key, through joins that Spark can split where one key holds a large part of the rows.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the trees;
without labelled URLs, or with labels of one kind, the trees give that kind (allow if there is none); repeated rows
give repeated results; an empty table gives no rows; a URL of any length is judged whole; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import gbt
from ledgerloom.llm.common import in_batches, stored

#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (from there up to ? or
    # or the end); (?s) lets a line end stand anywhere in them."""
    url = F.col(url_col).cast("string")
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` ((verdict, "host/path") pairs) that fits host and path, as struct(rule, verdict)."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        host, _, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        said = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits & F.col("path").startswith("/" + path), said).otherwise(found)
    return found


def entropy(texts: pd.Series) -> np.ndarray:
    """Bits per byte of each text."""
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8))
        share = counts[counts > 0] / max(counts.sum(), 1)
        out[k] = -(share * np.log2(share)).sum()
    return out


#: Lexical features; the shares by suffix are added to them.
FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "parameters", "query_length", "fragment", "secure", "dotted_end")


def features(df: DataFrame, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*[?]([^#]*)", 1)
    gone = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    digits = lambda text: F.length(text) - F.length(F.translate(text, "0123456789", ""))
    tail = F.split("host", "[.]")
    return df.withColumns(
        {
            "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "labels": F.size(tail),
            "depth": gone(F.col("path"), "/"), "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)), "host_digits": digits(F.col("host")),
            "hyphens": gone(F.col("host"), "-"),
            "parameters": F.when(query != "", gone(query, "&") + 1).otherwise(0), "query_length": F.length(query),
            "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.lower(url).startswith("https:").cast("int"), "dotted_end": F.col("path").rlike("[.][A-Za-z0-9]+$").cast("int"),
            "top": F.coalesce(F.try_element_at(tail, F.lit(-1)), F.lit("")), "site": F.array_join(F.slice(tail, F.greatest(F.size(tail) - 1, F.lit(1)), F.lit(2)), "."),
        }
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict (allow or block) and block_score of the trees."""
    pages = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    found = features(split_url(pages, "url").withColumn("found", rule_of(rules)), "url")
    labelled = found.where("found IS NOT NULL").withColumn("blocked", (F.col("found.verdict") == "block").cast("double"))
    # Blocked and all labelled URLs by suffix, in one pass. How many suffixes there are is not bounded: the tables of
    # shares (with one URL of either kind added) are written first, so that Spark sends one to the rows if its size allows
    # that, and else joins by key and splits the keys of many rows.
    counts = stored(labelled.groupBy("top", "site").agg(F.sum("blocked").alias("blocked"), F.count("*").alias("n")))
    shares = {key: stored(counts.groupBy(key).agg(((F.sum("blocked") + 1) / (F.sum("n") + 2)).alias(f"{key}_share"))) for key in ("top", "site")}
    own = [*FEATURES, "top_share", "site_share"]

    def matrix(part: pd.DataFrame) -> np.ndarray:
        return np.column_stack([part[own].to_numpy(np.float64), entropy(part["url"]), entropy(part["host"])])

    def with_shares(df: DataFrame) -> DataFrame:
        for key, table in shares.items():
            df = df.join(table, key, "left").withColumn(f"{key}_share", F.coalesce(f"{key}_share", F.lit(0.5)))
        return df

    sample = with_shares(stored(labelled.orderBy(F.xxhash64(id_col, "url")).limit(SAMPLE))).select("url", "host", *own, "blocked").toPandas()
    x, y = matrix(sample), sample["blocked"].to_numpy(np.float64)
    model = gbt.fit(x, y) if len(y) else gbt.Trees([], -8.0, [])
    kept = pages.sparkSession.sparkContext.broadcast(model)

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[["id", "host", "path", "rule", "said"]].copy()
            out["block_score"] = gbt.predict(kept.value, matrix(part))
            yield out

    ready = with_shares(found).select(F.col(id_col).alias("id"), "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("said"), F.coalesce("url", F.lit("")).alias("url"), *own)
    kind = dict(pages.dtypes)[id_col]
    judged = in_batches(ready).mapInPandas(scored, f"id {kind}, host string, path string, rule string, said string, block_score double")
    verdict = F.coalesce("said", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")
