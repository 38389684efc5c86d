import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import coder, textkit, tokens
from tidelog.llm.queries import vocabulary

ALPHABET = "\x01aBé ßİ\x1c\x1f́ \u0085 'sll \n\t\r\x0b\x0c<|endoftext|>1२٣ΣςﬁǅΩ\x00‍汉字😀"


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 5000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 49408, np.full(n, 65535), np.zeros(n, int), np.arange(n) % 3, rng.integers(0, 65536, n)):
        prior, frames = coder.compress(ids, 512)
        assert len(frames) == -(-n // 512)
        assert (coder.decompress(prior, b"".join(frames)) == ids).all()
        # blocks stand alone
        assert (coder.decompress(prior, frames[-1]) == ids[512 * (len(frames) - 1) :]).all()


def test_repetition_is_predicted():
    ids = np.tile(np.random.default_rng(0).integers(0, 49408, 40), 50)
    assert sum(map(len, coder.compress(ids, 2000)[1])) < len(ids) * 2 / 5


def test_smaller_than_deflate_and_order_0(sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").sort_by("doc_id").column("text").to_pylist()
    ids = np.concatenate(tokens.tokenizer(vocabulary()).ids([(t or "").encode() for t in rows]))
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    prior, frames = coder.compress(ids)
    bits = 8 * sum(map(len, frames)) / len(ids)
    assert bits < -(share * np.log2(share)).sum()
    assert bits < 0.8 * 8 * sum(len(zlib.compress(ids[i : i + coder.BLOCK].tobytes(), 9)) for i in range(0, len(ids), coder.BLOCK)) / len(ids)
    assert (coder.Prior.unpacked(prior).size[np.unique(ids)] > 0).all()


@given(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=700), st.integers(1, 300))
@settings(max_examples=60, deadline=None)
def test_any_ids_come_back(ids, block):
    prior, frames = coder.compress(np.array(ids, np.int64), block)
    assert coder.decompress(prior, b"".join(frames)).tolist() == ids


def test_all_ids_at_once():
    ids = np.concatenate([np.arange(65536), np.zeros(300_000, int), np.arange(65536)[::-1]])
    prior, frames = coder.compress(ids)
    assert (coder.decompress(prior, b"".join(frames)) == ids).all()


def test_bounds_and_damage():
    prior, none = coder.compress(np.zeros(0, int))
    assert none == [] and len(coder.decompress(prior, b"")) == 0
    with pytest.raises(ValueError):
        coder.compress(np.array([65536]))
    prior, (whole,) = coder.compress(np.arange(300))
    for at, wrong in ((0, 1), (coder.HEADER.size + 9, 255), (12, 7), (5, 3)):
        bad = bytearray(whole)
        bad[at] ^= wrong
        with pytest.raises(coder.CorruptBlock):
            coder.decompress(prior, bytes(bad))
    for data in (whole[:-2], whole[:7]):
        with pytest.raises(coder.CorruptBlock):
            coder.decompress(prior, data)
    other, _ = coder.compress(np.arange(300) % 7)
    for table in (other, prior[:-1], prior[:3], bytes([*prior[:-1], prior[-1] ^ 1])):
        with pytest.raises(coder.CorruptBlock):
            coder.decompress(table, whole)


def hash_of(text):
    """Spark's xxhash64: seed 42, signed."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def expected(rows):
    library = Tokenizer.from_file(vocabulary())
    rows = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda r: (r[0], hash_of(r[1]), r[1].encode()))
    out, start = [], 0
    for _, text, doc in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(spark, rows, **options):
    got = tokens.digest(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected(rows), key=str)


def test_small_cases(spark):
    rng = random.Random(2)
    rows = [(None, "null id"), (5, None), (4, ""), (4, "again"), (4, "again"), (3, "one two " * 3000), (9, "x" * 5000), (10, "it's <|endoftext|> we'll<|startoftext|>x")]
    rows += [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40)))) for i in range(20, 300)]
    check(spark, rows, shards=3, segment=2000)


def test_empty_table(spark):
    check(spark, [])


def test_whole_table(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def test_ids_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y")], "doc_id long, text string, start string")
    tokens.write(df, str(tmp_path / "t"), vocabulary())
    got = {r.doc_id: r.ids for r in tokens.read(spark, str(tmp_path / "t")).collect()}
    assert got == {1: [*Tokenizer.from_file(vocabulary()).encode("hello world", add_special_tokens=False).ids, 2], 2: [2]}


def test_pieces_go_the_way_without_offsets():
    """Pieces are encoded without the offsets that nobody reads: the slower call is left for those that hold the sign between pieces."""

    class Fast:
        def __init__(self, library):
            self.encode_batch_fast = library.encode_batch_fast

    library, own = Tokenizer.from_file(vocabulary()), tokens.Tokenizer(vocabulary())
    own.library = Fast(own.library)
    text = "".join(c for c in ALPHABET * 3 if c != tokens.PART) + " one TWO three's <|endoftext|>x " * 2
    assert own.ids([text.encode()])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_memory_goes_back_between_batches(monkeypatch):
    """Once before the first batch, and after each when the next is asked for, also the last."""
    seen = []
    monkeypatch.setattr(textkit, "release", lambda: seen.append("release"))
    for b in textkit.lean(iter("ab")):
        seen.append(b)
    assert seen == ["release", "a", "release", "b", "release"]
    monkeypatch.undo()
    textkit.release()


PLAIN = "aBzZàÀéßÿ×÷Þ 'slltT<|>endoftext# 12.,-$_~\x7f\x01\xa0¿́İΣ中\n"


@given(st.lists(st.text(st.sampled_from(PLAIN), max_size=40), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_and_whole_pieces_give_the_library_s_ids(texts):
    own = tokens.tokenizer(vocabulary())
    assert own.plain
    got = own.ids([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [[*own.library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_plain_pieces_skip_the_rules():
    """The rules, which cost most, run only on pieces that need them, each once."""

    class Asked:
        def __init__(self, library):
            self.library, self.texts, self.encode = library, [], library.encode

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.library.encode_batch_fast(texts, **options)

    own = tokens.Tokenizer(vocabulary())
    own.library = Asked(own.library)
    text = "One two, THREE (four4) élan Über 汉字 it's"
    for _ in range(2):
        assert own.ids([text.encode()])[0].tolist() == [*own.library.encode(text, add_special_tokens=False).ids, 2]
    assert sorted(own.library.texts[0].split(f" {tokens.PART} ")) == ["it's", "汉字"] and len(own.library.texts) == 1


def test_remembered_words_take_few_bytes():
    own = tokens.Tokenizer(vocabulary())
    words = ["".join(random.Random(i).choices("abcdefghij", k=8)) for i in range(20_000)]
    own.ids([" ".join(words).encode()])
    held = own.known.nbytes + own.stored.nbytes + own.sizes.nbytes
    assert len(own.known) == len(set(words)) and held < 40 * len(own.known)


def test_other_rules_than_the_known_go_through_the_library(tmp_path):
    import json

    with open(vocabulary()) as f:
        rules = json.load(f)
    rules["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules))
    own = tokens.Tokenizer(str(path))
    assert not own.plain
    text = "One two, THREE one"
    assert own.ids([text.encode()])[0].tolist() == [*Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids, 2]


def test_shards_follow_cores_and_bytes(spark, tmp_path):
    """Not the shuffle partitions: short shards leave the coder few blocks to work on at once."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "doc_id long, text string")
        tokens.write(df, str(tmp_path / "t"), vocabulary())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.read.parquet(str(tmp_path / "t")).select("shard").distinct().count() <= spark.sparkContext.defaultParallelism
