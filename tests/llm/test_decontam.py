import hashlib
import re

import pytest

from tidelog.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).update([] if item is None else [item])
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontam.digest(d, b, **options).collect()), key=str)
    assert got == brute(docs, items)


ITEMS = [(1, "The quick brown Fox jumps over the lazy dog and runs far away"), (2, "Äpfel über 9 Bäume"), (3, None), (4, " .,! "), (10, "fox jumps over the lazy dog and runs far away"), (1, "one"), (5, "fox jumps over the lazy dog and runs far away home"), (None, "nameless passage"), (None, "one")]
DOCS = [(1, "So the QUICK, brown fox\njumps over the lazy dog and runs far away home."), (2, None), (3, ""), (4, "äpfel äpfel Äpfel über 9-Bäume!"), (5, "two one. one-two anyone"), (5, "two one. one-two anyone"), (None, "one"), (6, "?!"), (8, "a Nameless-passage here"), (7, "x " * 5000 + "one")]


@pytest.mark.parametrize("most", [900, 1 << 20])
def test_small_cases(spark, most):
    check(spark, DOCS, ITEMS, most=most)
    check(spark, DOCS, [], most=most)
    check(spark, [], ITEMS, most=most)


def test_spans_lie_in_the_original():
    patterns = decontam.Patterns(ITEMS)
    text = "é… So: Äpfel -- Über 9\tBäume, and one!"
    text = text.replace("Über", "über").replace("Äpfel", "Äpfel")
    _, hits, _ = patterns.scan(text)
    spans = decontam.spans_of(text, hits)
    assert [text[a:b] for a, b in zip(spans[::2], spans[1::2], strict=True)] == ["Äpfel -- über 9\tBäume", "one"]


def test_extra_columns(spark):
    d = spark.createDataFrame([(1, "one", 5, "q")], "doc_id long, text string, n_words int, source string")
    b = spark.createDataFrame([(1, "one", "x")], "item_id long, text string, doc_id string")
    assert decontam.digest(d, b).first().contaminated
    assert decontam.clean(d, b).count() == 0
    kept = decontam.clean(d, b.where("false"))
    assert kept.columns == d.columns and kept.collect() == d.collect()


def test_whole_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    bench = [tuple(r) for r in items.select("item_id", "text").collect()]
    assert sorted((tuple(r)[:6] for r in decontam.digest(docs, items).collect()), key=str) == brute(rows, bench)
