import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import simhash

SCHEMA = "doc_id long, text string"
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def brute_print(text):
    words = [w.decode() for w in (text or "").translate(ASCII_LOWER).encode().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """Of (id, fingerprint) rows, by union-find over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{p:016x}", least.get(root(i))) for i, (d, p) in enumerate(prints)]


def check(spark, rows):
    got = [tuple(r) for r in simhash.digest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(brute_components([(d, brute_print(t)) for d, t in rows]), key=str)


def test_small_cases(spark):
    rng = random.Random(3)
    base = [f"W{rng.randrange(400)}é" for _ in range(300)]
    rows = [(None, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "a B"), (6, "A\t b"), (7, "a b c"), (7, "a b c")]
    for i in range(8, 40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "x"
        rows.append((i, "  ".join(w)))
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def test_segments_grow_with_the_table():
    sizes = [simhash.segments_for(n) for n in (0, 10**5, 10**8, 10**9, 10**10, 10**12)]
    assert sizes[0] == 5 and sizes == sorted(sizes) and sizes[-1] == simhash.MOST_SEGMENTS
    for n in (10**8, 10**9):
        m = simhash.segments_for(n)
        assert n / 2 ** (64 * (m // 2) // m) <= simhash.PER_KEY


def test_extra_columns_and_a_long_text(spark):
    rows = [(1, "a b " * 150_000, "x", 1), (2, "a b " * 150_000, "y", 2), (None, "q", None, 3)]
    got = simhash.digest(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, fp long"))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_components([(d, brute_print(t)) for d, t, _, _ in rows]), key=str)


@pytest.mark.parametrize("hot,segments", [(1, None), (8, 7), (10_000, 15)])
def test_links_of_crowded_fingerprints(spark, hot, segments):
    rng = random.Random(hot)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:
        x = rng.choice(sorted(prints)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, hot=hot, segments=segments)).collect()}
    want = {p: c for p, (_, _, c) in zip(prints, brute_components(list(enumerate(prints))), strict=True)}
    signed = {p: int(np.uint64(p).astype(np.int64)) for p in prints}
    got = {p: roots.get(s, s) for p, s in signed.items()}
    for i, p in enumerate(prints):
        for q in prints[:i]:
            assert (want[p] == want[q]) == (got[p] == got[q])


def test_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert simhash.components(edges).where("root <> 0").count() == 0
