import hashlib
import itertools
import random

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from tidelog.llm import substring
from tidelog.llm import textkit as tk

SCHEMA = "doc_id long, text string"


def hash_of(text):
    """Spark's xxhash64: seed 42, signed; the seed itself for null."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, window=20):
    docs = sorted((-(1 << 63) if i is None else i, hash_of(t), t or "", i) for i, t in rows)
    first, out = {}, []
    words = [t.encode().split() for _, _, t, _ in docs]
    for d, w in enumerate(words):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (d, p))
    for d, w in enumerate(words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (d, p):
                gone.update(range(p, p + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((docs[d][3], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in substring.digest(df, **options).collect()), key=str)


def test_small_cases(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(33)]
    rows = [(None, " ".join(passage)), (1, None), (2, ""), (3, " \t\n"), (4, "a b c")]
    for i in range(5, 60):
        w = [rng.choice("abc") for _ in range(rng.randrange(60))]
        k = rng.randrange(len(w) + 1)
        cut = rng.randrange(14)
        rows.append((i, "  ".join(w[:k] + passage[cut : cut + rng.randrange(18, 24)] + w[k:])))
    # rows that share an id, or have none, in several chunks
    for i in (None, 8):
        rows += [(i, " ".join(passage[k:] + [f"t{i}{k}"])) for k in range(12)]
    rows += [(7, "x y z " * 30), (7, "x y z " * 30), (61, "é" * 40 + " " + "w " * 90)]
    assert run(spark, rows, chunk_bytes=300, bucket_bytes=500) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.digest(empty).count() == 0
    rows = [(1, "q " * 25, 1, 2), (2, "q " * 25, 3, 4)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("n_words", T.LongType())]))
    assert sorted(tuple(r) for r in substring.digest(df).collect()) == brute([(r[0], r[1]) for r in rows])
    assert {r.doc_id: r.text for r in substring.kept_text(df).collect()}[2] == ""


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substring.digest(docs).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def thue_morse(n):
    """Two words that polynomial hashes modulo a power of two can't tell apart."""
    return ["".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for k in range(2)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_defeat_polynomial_hashes(spark, n):
    a, b = thue_morse(n)
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{b} {tail}")]
    got = run(spark, rows)
    assert got == brute(rows) and [r[2] for r in got] == [0, 0, 20]


def test_word_hashes_of_all_lengths():
    words = sorted({("ab" * 200)[:n] + c for n in range(300) for c in "xyé"} | {"".join(p) for p in itertools.product("ab", repeat=8)} | set(thue_morse(64) + thue_morse(512)))
    batch = next(tk.batches(pa.array([" ".join(words), " ".join(reversed(words))], pa.large_string())))[2]
    batch.words(tk.SPACE_NOT)
    for kind in ("byte", "byte2"):
        hashes = batch.word_hashes(kind)
        assert len(set(hashes.tolist())) == len(words) and (hashes[: len(words)] == hashes[len(words) :][::-1]).all()


def test_bad_cover(spark):
    with pytest.raises(ValueError):
        substring.digest(spark.createDataFrame([], SCHEMA), cover=(0, 1))
