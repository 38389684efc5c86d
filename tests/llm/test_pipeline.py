"""The pipeline against brute force, stage by stage on what the stage before kept."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import test_decontam
import test_neardup
import test_tokens

import corpus_pipeline
from tidelog.llm import mixing, quality
from tidelog.llm.textkit import table, written


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mixing", "token_output"]
    docs = table(spark, sf_dir, "documents")
    # copies by design, one with a clashing id and null columns
    more = spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate([docs.first().text, docs.first().text + " end", None, ""])], docs.schema)
    docs = docs.unionByName(more)
    stages = dict(corpus_pipeline.STAGES)
    kept = written(stages["quality_rules"](spark, docs, sf_dir), "q")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    good = {r.doc_id for r in quality.judged(docs, trees).where("kept").collect()}
    before = {r.doc_id: tuple(r) for r in docs.collect()}
    assert kept.columns == docs.columns and rows_of(kept) == sorted((before[d] for d in good), key=str)
    assert not good & {10_002, 10_003}

    single = written(stages["near_dedup"](spark, kept, sf_dir), "n")
    first = test_neardup.brute([(r.doc_id, r.text) for r in kept.collect()])
    assert rows_of(single) == sorted((before[d] for d, c in first.items() if d == c), key=str)
    assert single.count() < kept.count() and not {10_000} & {r.doc_id for r in single.collect()}

    clean = written(stages["decontamination"](spark, single, sf_dir), "d")
    bench = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    hit = {r[0]: r[5] for r in test_decontam.brute([(r.doc_id, r.text) for r in single.collect()], bench)}
    assert rows_of(clean) == sorted((before[d] for d, h in hit.items() if not h), key=str)

    mixed = written(stages["source_mixing"](spark, clean, sf_dir), "m")
    copies = {r.doc_id: r.copies for r in mixing.digest(clean).collect()}
    assert mixed.columns == docs.columns and rows_of(mixed) == sorted((before[d] for d, n in copies.items() for _ in range(n)), key=str)
    assert min(copies.values()) >= 1

    last = stages["token_output"](spark, mixed, sf_dir)
    assert rows_of(last) == sorted(test_tokens.expected([(r.doc_id, r.text) for r in mixed.collect()]), key=str)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_edges(spark, tmp_path):
    """Empty tables, and tables of nulls, repeated rows and clashing columns, go through all stages."""
    text = " ".join(f"word{i} of{i % 7}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 1), (2, text + " end", "a", 2), (None, text[::-1], None, 3), (3, None, None, None), (4, "", "b", 0)], "doc_id long, text string, source string, `row.r1` long")
    docs = docs.selectExpr("*", "1 AS node", "'x' AS copies", "2.0 AS n_words", "3 AS hash")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "nothing that occurs")], "item_id long, text string")
    for name, tables in (("some", (docs, labels, bench)), ("none", (docs, labels.where("false"), bench.where("false"))), ("empty", (docs.where("false"), labels, bench))):
        for table_, t in zip(("documents", "labels", "benchmark"), tables, strict=True):
            t.write.parquet(str(tmp_path / name / f"{table_}.parquet"))
        at = str(tmp_path / name)
        now = table(spark, at, "documents")
        columns = now.columns
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = written(f(spark, now, at), stage)
            assert now.columns == columns
        last = corpus_pipeline.STAGES[-1][1](spark, now, at).collect()
        # the two texts of words that are no copies of each other, once each or more
        assert {r.doc_id for r in last} == (set() if name == "empty" else {1, None})
