import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidelog.llm import neardup, simhash

SCHEMA = "doc_id long, text string"
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = (text or "").translate(ASCII_LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Components of (doc_id, text) by all pairs, as {doc_id: smallest doc_id}."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def words(rng, n):
    return [f"W{rng.randrange(5000)}" for _ in range(n)]


def planted():
    """(rows, similarities): originals and copies of them with one stretch of words exchanged, at 0.8 to 0.95 and below."""
    rng, rows, at = random.Random(5), [], []
    for k, want in enumerate([0.8, 0.82, 0.85, 0.9, 0.95, 0.7, 0.79]):
        base = words(rng, 404)
        # 400 shingles, x of them changed: similarity (400 - x) / (400 + x)
        x = int(400 * (1 - want) / (1 + want))
        copy = list(base)
        copy[100 : 100 + x - 4] = words(rng, x - 4)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = map(shingles, (rows[-2][1], rows[-1][1]))
        at.append(len(a & b) / len(a | b))
    return rows, at


def test_pipeline_stage_finds_planted_copies(spark):
    rows, at = planted()
    assert all(abs(a - b) < 0.01 for a, b in zip(at, [0.8, 0.82, 0.85, 0.9, 0.95, 0.7, 0.79], strict=True))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {d for d, first in brute(rows).items() if d == first} == {2 * k for k in range(7)} | {11, 13}


@pytest.mark.parametrize("hot,block,sample", [(2, 4, 4000), (3, 2048, 4000), (64, 5, 20)])
def test_against_all_pairs(spark, hot, block, sample):
    rng = random.Random(hot)
    passage, rows = words(rng, 60), [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "a b c d e"), (5, "A  b c\nd e")]
    for _ in range(8):
        base = words(rng, rng.choice([12, 60, 200]))
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = "x"
            rows.append((len(rows), " ".join(w + passage * rng.randrange(2))))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component_id for r in neardup.groups(df, hot=hot, block=block, sample=sample).collect()}
    assert got == brute(rows)
    assert neardup.leaders(df.where("false")).count() == 0


def test_leaders_by_row(spark):
    schema = "doc_id long, text string, `row.r1` string"
    rows = [(7, "x y z q", "a"), (3, "x y z q", "a"), (None, "x y z q", "a"), (3, "x y z q", "a"), (3, "X y z q", "b"), (9, "other words here", None), (None, None, "c"), (None, "", "d"), (None, "only one", "e")]
    got = [tuple(r) for r in neardup.leaders(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == 4 and sum(r[0] == 3 for r in got) == 1
    assert {r[0] for r in got} == {3, 9, None} and (None, "only one", "e") in got and sum(not r[1] for r in got) == 1


def test_runs():
    rng = random.Random(1)
    for hot in (2, 5, 100):
        rows = sorted((rng.randrange(30), node, rng.randrange(1, 9)) for node in range(200))
        runs, out, at = neardup._Runs(hot), [], 0
        while at < len(rows):
            step = rng.randrange(1, 30)
            out.append(runs.take(*np.array(rows[at : at + step]).T))
            at += step
        out.append(runs.take(*[np.zeros(0, np.int64)] * 3, last=True))
        got = [tuple(r.values()) for b in out for r in b.to_pylist()]
        size = Counter(k for k, _, _ in rows)
        assert sorted(r[1:] for r in got if r[0] == 1) == [r for r in rows if size[r[0]] > hot]
        want = {(max(a[1], b[1]), min(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and size[a[0]] <= hot and 5 * min(a[2], b[2]) >= 4 * max(a[2], b[2])}
        assert {r[2:] for r in got if r[0] == 0} == want


def test_prefixes_and_parities():
    """Whatever the order, similar sets share a shingle of their prefixes, and parities differ in no more places than sets do."""
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 2, 5, 9, 10, 46, 300):
        a = rng.integers(-(1 << 62), 1 << 62, n)
        sets += [np.unique(a), np.unique(np.concatenate([a[: n - n // 10], rng.integers(-(1 << 62), 1 << 62, n // 10)]))]
    key, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    common = np.unique(rng.choice(key, 900))
    prefix, ends, crowd = neardup.Order(common, rng.integers(2, 9, len(common)), 5).prefixes(key, at)
    bits = neardup.parities_of(key, at)
    assert crowd.any() and not crowd.all()
    for k in range(0, len(sets), 2):
        a, b = set(sets[k].tolist()), set(sets[k + 1].tolist())
        if 5 * len(a & b) >= 4 * len(a | b):
            assert set(prefix[ends[k] : ends[k + 1]].tolist()) & set(prefix[ends[k + 1] : ends[k + 2]].tolist())
        assert np.bitwise_count((bits[k] ^ bits[k + 1]).view(np.uint64)).sum() <= len(a ^ b)


def test_chains():
    """A piece of the ring from which all chains stay within their share, by brute force."""
    rng = random.Random(3)
    rows = [([rng.randrange(rng.choice([2, 6])) for _ in range(6)], rng.randrange(20)) for _ in range(300)]
    got = simhash.has_chain(np.array([d for d, _ in rows]), np.array([m for _, m in rows])).tolist()
    for (d, most), ok in zip(rows, got, strict=True):
        assert ok == any(all(6 * sum((d + d)[s : s + n]) <= n * most for n in range(1, 7)) for s in range(6))
        assert ok or sum(d) > most
    assert not all(got)


def test_long_unlike_sets_are_rejected(spark):
    """Of long texts that share a passage, only pairs as similar as asked go on to have their texts compared, whatever their lengths."""
    rng = random.Random(8)
    passage, rows = words(rng, 60), []
    for n in (900, 1100, 2600, 3000, 3300, 5000, 5200):
        base = words(rng, n)
        copy = base[: -n // 12] + words(rng, n // 20)
        rows += [(len(rows), " ".join(base + passage)), (len(rows) + 1, " ".join(copy + passage))]
    prints = neardup.prints_of(neardup._rows(spark.createDataFrame(rows, SCHEMA)))
    distinct = prints.select("node", "n", "bits")
    node = {r.doc_id: r.node for r in prints.select("doc_id", "node").collect()}
    sets = {d: shingles(t) for d, t in rows}
    # candidates are of like sizes
    every = [(node[a], node[b]) for a in node for b in node if a > b and 4 * len(sets[a]) <= 5 * len(sets[b]) <= 25 * len(sets[a]) / 4]
    got = {tuple(r) for r in neardup._pruned(spark.createDataFrame(every, "u long, v long"), distinct).collect()}
    alike = {(node[a], node[b]) for a in sets for b in sets if a > b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert got == alike == {(node[d + 1], node[d]) for d in range(0, len(rows), 2)}


def test_widths_and_places():
    """Parities of unlike widths differ in no more places than the sets do; similar sets have enough left from the first shingle that they share."""
    rng = np.random.default_rng(4)
    sets, similar = [], 0
    for n in (1, 30, 1000, 1030, 2040, 2060, 9000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (1.0, 0.97, 0.9, 0.5):
            sets.append(np.unique(np.concatenate([rng.permutation(a)[: int(n * share)], rng.integers(-(1 << 62), 1 << 62, n // 50)])))
    sets = [s for s in sets if len(s)]
    values, at = neardup.vectors_of(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    vectors = neardup.Vectors(neardup._lists(values, at))
    assert all(w == 16 or 32 * w < len(s) <= 64 * w for w, s in zip(vectors.words.tolist(), sets, strict=True)) and len(set(vectors.words.tolist())) > 2
    p, q = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    n = np.array([len(s) for s in sets])
    keep, _ = neardup.passing(vectors, vectors, p, q, n[p], n[q])
    keep = set(keep.tolist())
    for k, (i, j) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        both = np.intersect1d(sets[i], sets[j])
        words_ = int(min(vectors.words[i], vectors.words[j]))
        (row, x) = vectors.folded(words_)
        assert np.bitwise_count(x[row[i]] ^ x[row[j]]).sum() <= n[i] + n[j] - 2 * len(both)
        if 9 * len(both) >= 4 * (n[i] + n[j]):
            similar += i != j
            assert k in keep
            rest = [n[y] - np.searchsorted(sets[y], both[0]) for y in (i, j)]
            assert neardup.enough(n[i], rest[0], n[j], rest[1])
    assert similar > 20
