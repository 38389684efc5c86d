"""Words merged many at once, and the coder's bytes."""

import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import coder, merges, tokens
from tidelog.llm.queries import vocabulary

LETTERS = "aeiounrstlhédcmßü4!?.,_-<>|~"


class Never:
    def encode_batch_fast(self, texts, **options):
        raise AssertionError(f"{len(texts)} texts went to the library")


def test_plain_words_are_merged_without_the_library():
    library, own = Tokenizer.from_file(vocabulary()), tokens.Tokenizer(vocabulary())
    own.words = own.library = Never()
    rng = random.Random(1)
    text = " ".join("".join(rng.choices(LETTERS.replace("<", ""), k=rng.randrange(1, 30))) for _ in range(6000)) + " " + "x" * merges.LONGEST
    for _ in range(2):
        assert own.ids([text.encode()])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@given(st.lists(st.text(st.sampled_from(LETTERS + "ab"), min_size=1, max_size=80) | st.integers(1, 200).map(lambda n: "ha" * n), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_merges_give_the_library_s_ids(words):
    own = tokens.tokenizer(vocabulary())
    text = " ".join(words)
    assert own.ids([text.encode()])[0].tolist() == [*own.library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize(("key", "value"), [("ignore_merges", True), ("dropout", 0.0), ("unk_token", "!")])
def test_other_models(tmp_path, key, value):
    with open(vocabulary()) as f:
        rules = json.load(f)
    rules["model"][key] = value
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    own = tokens.Tokenizer(str(path))
    assert own.plain and (own.merges is None) == bool(value)
    text = "One two, THREE thousand and straßen4x"
    assert own.ids([text.encode()])[0].tolist() == [*Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids, 2]


def test_pairs_that_share_a_slot_are_told_apart():
    letters = [chr(0x61 + k) for k in range(26)]
    pairs = [(a, b) for a in letters for b in letters]
    vocab = {t: k for k, t in enumerate([*letters, *(t + "$" for t in letters), *(a + b for a, b in pairs)])}
    random.Random(0).shuffle(pairs)
    model = {"type": "BPE", "vocab": vocab, "merges": [f"{a} {b}" for a, b in pairs], "end_of_word_suffix": "$"}
    model |= dict.fromkeys(("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    own = merges.Merges(model, {ord(t): t for t in letters})
    left, right = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(52), np.arange(52)))
    ranks = {(vocab[a], vocab[b]): k << 6 for k, (a, b) in enumerate(pairs)}
    assert own.found(left, right).tolist() == [ranks.get(p, (1 << 31) - 1) for p in zip(left.tolist(), right.tolist(), strict=True)]


def test_the_coder_s_bytes_stay():
    """Of ids of few and of many kinds, with a last block that is shorter: those of the coder before its steps were made cheaper."""
    rng = np.random.default_rng(7)
    ids = np.concatenate([rng.zipf(1.3, 9000) % 49408, np.full(700, 65535), np.zeros(700, int), rng.integers(0, 65536, 2000), np.arange(900) % 3, rng.integers(0, 5, 777)])
    prior, frames = coder.compress(ids, 512)
    assert (coder.decompress(prior, b"".join(frames)) == ids).all()
    assert (len(frames), zlib.crc32(prior), zlib.crc32(b"".join(frames))) == (28, 3742318337, 694635375)
