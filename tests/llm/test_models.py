import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing, ordinal, quality, toxicity
from tidelog.llm import textkit as tk

SPACE = " \t\n\x0b\x0c\r"


def brute_counts(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [ln for ln in (text or "").split("\n") if ln.strip(SPACE)]
    n3 = {}
    for i in range(len(words) - 2):
        n3.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {j for at in n3.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts(spark, sf_dir):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "é", "a a a a", "x\nx\n\nx \nx", "<a> # *\n<a> # *", "w " * 70, "\x0b\x0c z y"]
    texts += ["".join(rng.choice("ab é\n|$\t") for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:6] for r in quality.with_statistics(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_lines_that_defeat_polynomial_hashes(spark):
    a, b = ("".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in range(2))
    texts = [f"{a}\n{b}", f"{a}\n{b}\n{a}", f"{a} {b} x {b} {a} x"]
    got = {r.doc_id: tuple(r)[1:6] for r in quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)} and [got[i][3] for i in range(3)] == [0, 1, 0]


def test_trees_keep_their_signs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + np.sin(9 * x[:, 1]) / 2 + rng.normal(0, 0.2, 3000) < 0.7).astype(float)
    trees = quality.grow(x, y, (-1, 0, 1), n_trees=40)
    p = trees.score(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.85
    for f, sign in ((0, -1), (2, 1)):
        line = np.repeat(x[:200, None], 30, 1)
        line[:, :, f] = np.linspace(0, 1, 30)
        steps = np.diff(trees.score(line.reshape(-1, 3)).reshape(200, 30), axis=1)
        assert (sign * steps >= -1e-12).all()

    def walk(root, row):  # the flat arrays mean what a tree means
        while trees.left[root] != root:
            root = trees.left[root] if row[trees.feature[root]] <= trees.cut[root] else trees.right[root]
        return trees.value[root]

    slow = [1 / (1 + np.exp(-(trees.base + sum(walk(r, row) for r in trees.roots)))) for row in x[:50]]
    assert np.allclose(slow, p[:50])
    assert (quality.grow(x[:0], y[:0], (0, 0, 0)).score(x[:5]) == 0.5).all()


def test_quality_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    trees = quality.train(docs, labels.where(~held))
    rows = quality.judged(docs, trees).join(labels.where(held).select("doc_id", F.col("quality").alias("label")), "doc_id").toPandas()
    good, bad = rows[rows.label == 1], rows[rows.label == 0]
    # the hard limits reject short documents whatever their label
    assert good[~good.base_failed].kept.mean() > 0.99 and bad.kept.mean() < 0.2


def test_toxicity_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.digest(docs, labels).join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows.itertuples())
    out = rows[rows.held_out]
    # about a seventh of the toxic labels are of texts with nothing in them that others of the kind share
    assert (out.predicted == out.toxic).mean() > 0.97 and out[out.toxic == 1].predicted.mean() > 0.78 and out[out.toxic == 0].predicted.mean() < 0.005
    model = toxicity.train(docs, labels)
    assert 0 < len(model.places) < 20_000


def test_toxicity_small():
    texts = ["you are a fool", "have a nice day", "what a FOOL", "a nice walk", None, ""] * 30
    model = toxicity.fit(texts, np.array([1, 0, 1, 0, 0, 0] * 30, float), l1=0.1, alpha=0.5)
    score = lambda t: model.score(next(tk.batches(pa.array([t], pa.large_string())))[2])[0]
    assert score("such a fool") > 0.5 > score("nice") and 0 <= score(None) == score("") <= 1
    assert toxicity.fit([], np.zeros(0)).constant == 0


def test_edges_of_scores(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "", 1.0), (2, "word " * 3000, 1.0), (2, "word " * 3000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (9, None, 1)], "doc_id long, quality int, toxic int")
    for df, n in ((docs, 4), (docs.where("false"), 0)):
        for lab in (labels, labels.where("false")):
            assert toxicity.digest(df, lab).count() == ordinal.digest(df, lab).count() == quality.digest(df, lab).count() == n
    assert toxicity.digest(docs, labels).where("score < 0 or score > 1 or predicted is null or held_out is null").count() == 0


def test_ordinal_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rows = ordinal.digest(docs, labels.where(~held)).join(labels.where(held), "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.3
    assert good.expected_grade.mean() > bad.expected_grade.mean() + 0.5
    assert (rows.tail_prob >= rows.top_prob).all()


def test_plan():
    tokens = {"big": 6000, "mid": 1000, "small": 500, None: 0}
    p = mixing.plan(tokens, {"big": 60, "mid": 10, "small": 5, None: 1}, target=0.9, repeats=3.0)
    w = [p.weight[s] for s in ("big", "mid", "small")]
    assert abs(sum(w) - 1) < 1e-9 and w == sorted(w, reverse=True) and p.weight[None] == 0
    assert mixing.entropy(w) <= 0.9 * np.log(3) + 1e-6 or p.exponent == 0
    assert abs(max(p.passes.values()) - 3.0) < 1e-6 or mixing.entropy(w) >= 0.9 * np.log(3) - 1e-6
    assert min(p.passes.values()) == 1.0
    free = mixing.plan(tokens, {}, target=0.9, repeats=1e9)
    assert abs(mixing.entropy([x for x in free.weight.values() if x]) - 0.9 * np.log(3)) < 1e-6
    assert mixing.plan({}, {}).weight == {} and mixing.plan({"a": 5}, {"a": 1}).passes == {"a": 1.0}


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", None]), "w " * rng.randrange(1, 60)) for i in range(3000)] + [(None, "big", "x"), (7000, "empty", ""), (7001, "empty", None), (7002, "big", None)] + [(1, "mid", "q q")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("clash"))
    got = mixing.digest(df, block_docs=100).toPandas()
    assert len(got) == len(rows)
    total, taken = got.groupby("source", dropna=False).n_tokens.sum(), got.assign(t=got.n_tokens * got.copies).groupby("source", dropna=False).t.sum()
    weight = got.groupby("source", dropna=False).weight.first()
    assert (got.copies >= 1).all()
    for s in weight.index:
        blocks = got[got.source.isna() if s is None or s != s else got.source == s].block.nunique()
        assert abs(taken[s] - weight[s] * (total["big"] / weight["big"])) <= 60 * blocks or weight[s] == 0
    # each block's fractional pass is a prefix of its permutation by budget, as brute force takes it
    some = got[got.source == "mid"]
    whole = int(some.copies.min())
    for _, block in some.groupby("block"):
        flags = (block.sort_values("place").copies > whole).tolist()
        assert flags == sorted(flags, reverse=True)
    mixed = mixing.mixed(df, block_docs=100)
    assert mixed.columns == df.columns and mixed.count() == got.copies.sum()
    taken = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    copies = dict(zip(zip(got.doc_id.astype(object).where(got.doc_id.notna(), None), got.source.astype(object).where(got.source.notna(), None), got.n_tokens, strict=True), got.copies, strict=True))
    many = Counter(rows)
    assert all(n == many[k] * copies[k[0], k[1], len((k[2] or "").split())] for k, n in taken.items())
    # the same plan, made by jobs over a table, and dealt out
    again = mixing.digest(df, block_docs=100, most_sources=1).toPandas()
    both = [x.sort_values(["doc_id", "source", "n_tokens", "place"]).reset_index(drop=True) for x in (got, again)]
    assert (both[0].copies == both[1].copies).all() and np.allclose(both[0].weight, both[1].weight)
    dotted = df.withColumn("a.b", F.lit(1))
    assert mixing.mixed(dotted, block_docs=100).columns == dotted.columns and mixing.mixed(dotted, block_docs=100).count() == mixed.count()
    assert mixing.digest(df.where("false")).count() == 0 == mixing.mixed(df.where("false")).count()


@pytest.mark.parametrize("totals", [[7, 7, 7], [10**9, 3, 50, 10**5], [5], [0, 4], [0, 0]])
def test_plan_by_jobs_is_the_plan(spark, totals):
    names = {f"s{i}": t for i, t in enumerate(totals)}
    want = mixing.plan(names, dict.fromkeys(names, 3000), target=0.8, repeats=50.0)
    df = spark.createDataFrame([(s, t, 3000) for s, t in names.items()], "source string, t long, n long")
    got = {r.source: r for r in mixing.plan_table(df, target=0.8, repeats=50.0).collect()}
    for s in names:
        assert abs(got[s].weight - want.weight[s]) < 1e-9 and abs(got[s].passes - want.passes[s]) < 1e-6 * want.passes[s] and got[s].blocks == want.blocks[s]


def slow_ftrl(rows, labels, rounds, alpha, beta, l1):
    """The published update, one coordinate at a time in dictionaries; "" is the constant, without L1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        slack = 0.0 if i == "" else l1
        return 0.0 if abs(z[i]) <= slack else -(z[i] - math.copysign(slack, z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    for _ in range(rounds):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in (*row, "")}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_is_the_published_update():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    labels = [float("a" in t and rng.random() < 0.9) for t in texts]
    model = toxicity.fit(texts, np.array(labels), rounds=3, alpha=0.7, beta=0.5, l1=0.4)
    rows = []
    for t in texts:
        doc, place = toxicity.features(next(tk.batches(pa.array([t], pa.large_string())))[2])
        rows.append(sorted(set(place.tolist())))
    want = slow_ftrl(rows, labels, 3, 0.7, 0.5, 0.4)
    got = dict(zip(model.places.tolist(), model.values.tolist(), strict=True))
    assert {i for i, w in want.items() if w and i != ""} == set(got) and 0 < len(got) < len(want)
    assert all(abs(want[i] - w) < 1e-5 * max(1, abs(w)) for i, w in got.items()) and abs(model.constant - want[""]) < 1e-9
    # words, pairs of neighbours and pairs around one word, each by its own hash
    for t, row in zip(texts, rows, strict=True):
        w = t.split()
        assert len(row) == len({*w}) + len({*zip(w, w[1:], strict=False)}) + len({*zip(w, w[2:], strict=False)})


def test_ordinal_small():
    texts, grades = ["good words here", "bad", "middling text", "good again", "bad bad"] * 8, np.array([2, 0, 1, 2, 0] * 8)
    model = ordinal.fit(texts, grades, 3, rounds=20)
    assert (np.diff(model.thresholds) > 0).all()
    tails = np.concatenate([model.tails(x) for _, _, x in tk.batches(pa.array(texts, pa.large_string()))])
    chance = np.column_stack([1 - tails[:, 0], tails[:, 0] - tails[:, 1], tails[:, 1]])
    assert (chance > 0).all() and np.allclose(chance.sum(1), 1) and (chance.argmax(1) == grades).mean() > 0.9


@pytest.mark.parametrize("grade", [0, 2])
def test_first_step_against_numerical_slopes(grade):
    # (the middle grade starts in the middle of its thresholds, where the slope is zero)
    text, one = ["some words, some MORE 12"], np.array([grade])
    start, after = (ordinal.fit(text, one, 3, rounds=r) for r in (0, 1))
    assert not len(start.places) and len(after.places)

    def loss(values, cuts):
        t = ordinal.Model(after.places, values, cuts).tails(next(tk.batches(pa.array(text, pa.large_string())))[2])[0]
        return -math.log([1 - t[0], t[0] - t[1], t[1]][grade])

    zero = np.zeros(len(after.places))
    for k in range(len(zero)):
        bump = zero.copy()
        bump[k] = 1e-3
        slope = loss(bump, start.thresholds) - loss(-bump, start.thresholds)
        assert slope * after.values[k] < 0
    for k in range(2):
        moved = start.thresholds.copy()
        moved[k] = after.thresholds[k]
        assert loss(zero, moved) <= loss(zero, start.thresholds) + 1e-3
    assert loss(zero, after.thresholds) < loss(zero, start.thresholds)


def test_grades_from_labels(spark):
    rows = [(q, t) for q in (0, 1, None) for t in (0, 1, None)]
    got = [r.g for r in spark.createDataFrame(rows, "quality int, toxic int").select(ordinal.grade_of().alias("g")).collect()]
    assert got == [0, 0, 0, 2, 1, None, None, None, None]


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 50, "x" * 100) for i in range(200)] + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(50)] + [(None, 1.0), (3, None)], "doc_id long, y double")
    texts, ys = tk.sampled(docs, labels, 30, 1)
    assert len(texts) == len(ys) == 30
    assert len(tk.sampled(docs, labels, 300, 1)[0]) == 200 and len(tk.sampled(docs, labels, 300, 1, most_bytes=1000)[0]) == 10 and tk.sampled(docs.where("false"), labels, 9, 1) == ([], [])


def slow_verdicts(trees, rows):
    """Trees walked node by node, and the two limits, of (n_words, n_repeat_words, features)."""
    out = []
    for n, repeats, x in rows:
        total = trees.base
        for root in trees.roots.tolist():
            while trees.left[root] != root:
                root = trees.left[root] if x[trees.feature[root]] <= trees.cut[root] else trees.right[root]
            total += trees.value[root]
        out.append(not (n < 50 or 100 * repeats > 50 * n) and 1 / (1 + math.exp(-total)) >= quality.LEAST)
    return out


def test_verdicts_of_a_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels)
    plain = quality.with_statistics(docs).collect()
    want = dict(zip((r.doc_id for r in plain), slow_verdicts(trees, [(r.n_words, r.n_repeat_words, r.features) for r in plain]), strict=True))
    got = quality.digest(docs, labels).collect()
    assert {r.doc_id: r.kept for r in got} == want and len(set(want.values())) == 2
    assert not any(r.kept and r.base_failed for r in got)


def test_words_of_mixing(spark):
    texts = [None, "", " \t", "a", " a  b\x0bc\n", "é b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", mixing.n_tokens().alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == [len((t or "").encode().split()) for t in texts]
