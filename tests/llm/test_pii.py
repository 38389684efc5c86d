import hashlib
import re
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import pii
from tidelog.llm import textkit as tk

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@given(st.text(alphabet="ab.@-+_1257 ()é%", max_size=80))
@settings(max_examples=1500, deadline=None)
def test_base_matches_the_expressions(text):
    assert pii.detect(text) == brute(text)
    base, spans = pii.scan(text)
    assert base == brute(text) and set(base) <= set(spans)


def found(text):
    base, spans = pii.scan(text)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in spans if (a, k, b) not in base]


def test_disguises():
    assert found("write to jane.doe [at] mail (dot) example [dot] com now") == [("email", "jane.doe [at] mail (dot) example [dot] com")]
    assert found("write to jane at example dot com, please") == [("email", "jane at example dot com")]
    assert found("é jоhn@exаmple.org!") == [("email", "jоhn@exаmple.org")]
    assert found("ｊｏｅ＠ｍａｉｌ．ｃｏｍ") == [("email", "ｊｏｅ＠ｍａｉｌ．ｃｏｍ")]
    assert found("call plus one five five five one two three four five six seven eight ok") == [("phone", "plus one five five five one two three four five six seven eight")]
    assert found("card four one one one 1111 1111 1111") == [("card", "four one one one 1111 1111 1111")]
    assert found("host 10 dot 0 dot 0 dot 1 is up") == [("ip", "10 dot 0 dot 0 dot 1")]
    assert found("４１１１ １１１１ １１１１ １１１１") == [("card", "４１１１ １１１１ １１１１ １１１１")]


def test_more_disguises():
    assert found("write to jane at example.com today") == [("email", "jane at example.com")]
    assert found("jane at firma dot it") == [("email", "jane at firma dot it")]
    assert found("info@firma dot com dot br") == [("email", "info@firma dot com dot br")]
    assert found("4111 1111 1111 111 one") == [("card", "4111 1111 1111 111 one")]
    assert found("call plus one one one one one one one one one one now") == [("phone", "plus one one one one one one one one one one")]
    assert found("+49 30 one two 34567") == [("phone", "+49 30 one two 34567")]


LOCALS, DOMAINS = ["jane", "j.doe", "bob_7", "x+y"], [["example", "com"], ["mail", "firma", "it"], ["a-b", "co", "uk"]]
ALIKE = {"a": "а", "e": "е", "o": "ο", "p": "р", "c": "ｃ", "1": "１", "2": "٢", "4": "𝟒", "@": "＠", ".": "．"}
SPELLED = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))


@st.composite
def disguised(draw):
    """(kind, text) of an identifier with at least one sign, digit or letter in disguise."""
    kind = draw(st.sampled_from(["email", "card", "phone", "ip"]))
    if kind == "email":
        at = draw(st.sampled_from([" at ", " [at] ", "(at)", " { AT } ", "@", "[@]"]))
        dot = draw(st.sampled_from([" dot ", " (dot) ", "[.]", "<DOT>"]))
        name = draw(st.sampled_from(LOCALS))
        if draw(st.booleans()):
            name = "".join(ALIKE.get(c, c) if c.isalpha() else c for c in name)
        return kind, name + at + dot.join(draw(st.sampled_from(DOMAINS)))
    if kind == "ip":
        return kind, " dot ".join(str(draw(st.integers(0, 255))) for _ in range(4))
    digits = "4111111111111111" if kind == "card" else "49301234567"
    flags = draw(st.lists(st.booleans(), min_size=len(digits), max_size=len(digits)))
    flags[draw(st.integers(0, len(digits) - 1))] = True
    if draw(st.booleans()):  # spelled, between spaces
        body = " ".join(SPELLED[d] if f else d for d, f in zip(digits, flags, strict=True))
        return kind, (draw(st.sampled_from(["+", "plus "])) if kind == "phone" else "") + body
    body = "".join(ALIKE.get(d, d) if f else d for d, f in zip(digits, flags, strict=True))
    return kind, ("+" if kind == "phone" else "") + body


PROSE = ["", "We met", "über all", "look here,", "five of them", "(see below)", "12 days"]


@given(disguised(), st.sampled_from(PROSE), st.sampled_from(PROSE))
@settings(max_examples=600, deadline=None)
def test_disguised_identifiers_come_back_whole(what, before, after):
    """Brute force from the other end: what was put in is found, at its place in the source."""
    kind, body = what
    text = f"{before}\n: {body} ;\n{after}"
    a = len(before) + 3
    base, spans = pii.scan(text)
    assert (a, pii.KINDS.index(kind), a + len(body)) in spans and set(base) == set(brute(text)) and set(base) <= set(spans)


@given(st.lists(st.sampled_from(["one", "oh", "nine", "plus", " ", "-", " at ", " dot ", ".", "@", "(", "[at]", "jane", "com", "7", "12", "ο", "１", "é", ",", "ONE"]) | st.text(max_size=3), max_size=40))
@settings(max_examples=1500, deadline=None)
def test_no_text_with_spans_is_turned_away(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    batch = next(tk.batches(pa.array([text], pa.large_string())))[2]
    assert pii._worth(batch) == [True] or pii.scan(text) == ([], [])


def test_clean_texts_stay_clean():
    for text in ("we met at noon and at night", "look at the dot at the end", "one two three four five", "пример текста", "a (at) b", "nine lives, seven seas", "", "été à Paris – où ?"):
        assert pii.scan(text) == ([], [])


def test_long_runs_are_linear():
    assert pii.detect("a" * 300_000 + " " + "1" * 300_000 + "+" * 100_000 + "@" * 100_000) == []
    n = 300_000
    for text in ("12345 " + " " * n, "( " * n, "(" + " \t" * n, "a at b" + " " * n + "x", "a" + " " * n + "at" + " " * n + "b", "one " * n, "plus " * n, "7" + " " * n + "dot", "a at b." * n, "at dot " * n, "." * n + " at " + "." * n, "+1" + "." * n, "ο" * n, "a.b-" * n + "@", "[at](dot)" * n, "a@b.co " * (n // 7)):
        start = time.process_time()
        pii.scan(text)
        assert time.process_time() - start < 20, text[:20]


def test_digest(spark, sf_dir):
    late = spark.createDataFrame([(1, "call plus one one one one one one one one one one now"), (2, "x " * 200_000 + "joe [at] b [dot] co")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.digest(late).collect()} == {1: "phone:5:49", 2: "email:400000:400019"}
    extra = spark.createDataFrame([(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, None, "y"), (2, "", "z"), (3, "joe [at] b [dot] co 10.0.0.1", "z")], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.digest(extra).collect()}
    assert pii.digest(extra).count() == 5 and rows[3].n_ip == 1 and rows[3].n_email == 0 and rows[3].spans == "email:0:19,ip:20:28" and rows[3].n_added == 1
    assert pii.digest(extra.where("false")).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.digest(docs).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert r.n_added == 0
