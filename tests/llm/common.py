"""Fixtures of the operators' tests: documents with nulls, empty, long and repeated texts, and clashing columns."""

import random
import re
import zlib

DATA = "/root/testdata"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \t\n", "one", "Two words", "A b C d", "a B c D", "École d'été   x", "日本語 \U0001f600\U0001f44d\U0001f3fd", "x" * 3000, "<|endoftext|>a<|startoftext|>", "ΣΑΣ I'll &&& 's 12345 ½", "!!! ???", "\x00\x01 \x1c\x1d a\x1cb"]


def documents(spark, texts, first=0, clash=True):
    """doc_id, text and the other columns of documents, with columns of names that operators use inside."""
    rows = [(first + k, t, None if k % 5 == 4 else "en", f"s{k % 3}", None if t is None else len(t), "x", k, 0.5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id STRING, score BIGINT, held_out DOUBLE")
    return df if clash else df.drop("id", "score", "held_out")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def split_space(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def split_alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{int(vocabulary * draw.random() ** 2)}" for _ in range(n))
