import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, duck
from pyspark.sql import functions as F
from run_twin import plain_collapsed, plain_runs
from text_samples import prose
from trie_twin import rebuilt, trie

from tidemark.llm.common import QUERIES, SQL
from tidemark.llm.personal import BASE, Finder, iban_fits, luhn, mask_personal_data, personal_data
from tidemark.llm.runs import periodic_runs, runs_of_texts
from tidemark.llm.tries import ending_digests, paths, prefix_trie, turn_sequences

FINDER = Finder()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_periodic_runs"])
def test_agrees_with_sql(spark, sf, name):
    assert compare(spark, duck(sf), QUERIES[name], SQL[name], sf) == ""


def as_trie(walks, shards=None):
    ends = {bytes(r["end_key"]): r["ends_sha256"] for r in ending_digests(walks).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {
        (r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], ends[bytes(r["end_key"])] if r["end_key"] else none)
        for r in prefix_trie(walks, shards).collect()
    }


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_trie_by_brute_force(spark, shards):
    rng = random.Random(shards)
    rows = []
    for conv in range(150):
        # Few different turns, so that prefixes are shared at every depth; one conversation of 40 turns and its copies.
        turns = [("user", "a b")] * 40 if conv % 3 == 0 else [("user", rng.choice(["a b", "c", "d  e f"])) for _ in range(rng.choice([1, 2, 3, 5, 18, 33]))]
        rows += [(conv * 7, t, role, text) for t, (role, text) in enumerate(turns)]
    walks = paths(turn_sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    own = {}
    for conv, _, role, text in rows:
        own.setdefault(conv, []).append((role, text))
    assert as_trie(walks, shards) == trie(own)


def test_trie_cases(spark, sf):
    rows = [(1, None, "user", "x"), (1, 0, None, None), (2, 0, "user", "x"), (2, 1, None, ""), (2, 1, None, ""), (None, 0, "user", "lost"), (3, 0, "", "w " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("seq", "_s", "depth", "end_key", "turns")})
    walks = paths(turn_sequences(df))
    # A missing turn comes first, null and empty are the same, a repeated row is a turn.
    want = {1: [("user", "x"), ("", "")], 2: [("user", "x"), ("", ""), ("", "")], 3: [("", "w " * 30_000)]}
    assert as_trie(walks) == trie(want)
    assert prefix_trie(paths(turn_sequences(df.limit(0)))).count() == 0
    assert ending_digests(paths(turn_sequences(df.limit(0)))).count() == 0


def test_rebuilt_without_turns(spark):
    from tidemark.llm.tries import branched

    rows = [(21, 0, "user", "x"), (40, 0, "user", "y"), (41, 0, "user", "y"), (41, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conv = F.col("conv_id")
    heads = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    got = as_trie(paths(branched(turn_sequences(df), conv - conv % 20, heads, 3)))
    assert got == trie(rebuilt(rows)) and sum(v[0] is None for v in got.values()) == 1


texts_of_words = st.lists(st.one_of(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("abcdefg"), max_size=60), st.builds(lambda b, n: (b * n)[:90], st.lists(st.sampled_from("abcd"), min_size=1, max_size=20), st.integers(1, 30))), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts_of_words)
def test_runs_by_brute_force(texts):
    got = runs_of_texts([[w.encode() for w in t] for t in texts])
    assert [[(s, e - s, p) for s, e, p in r] for r in got] == [plain_runs(t) for t in texts]


def test_runs_of_long_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    tail = prose(3, 500).split()
    for words in (["x"] * 4000, list(fib[-1][:3000]), prose(1, 700).split() * 4 + tail, tail + ["x", "y"] * 900 + tail):
        (got,) = runs_of_texts([[w.encode() for w in words]])
        assert [(s, e - s, p) for s, e, p in got] == plain_runs(words)
    (got,) = runs_of_texts([[b"x"] * 1_000_000])
    assert got == [(0, 1_000_000, 1)]


def test_periodic_runs(spark, messy, empty):
    rows = [(1, "go " * 20 + "on"), (2, None), (3, ""), (4, " a  b " * 9), (5, "a b c"), (5, "a b c"), (None, "z\n" * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "runs", "collapsed", "_text")})
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect()]
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        want.append((i, runs, plain_collapsed(words, runs)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs(messy).count() == messy.count() and periodic_runs(empty).count() == 0


def plain_personal(text):
    """The base spans by the contract's patterns."""
    out = []
    for k, (pattern, fits) in enumerate((
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    )):
        out += [(k, m.start(), m.end()) for m in re.finditer(pattern, text) if fits(m[0])]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("0123456789.. --@@+() aZ_%é\n4"), max_size=60))
def test_base_spans_are_the_patterns(text):
    assert [s for s in FINDER.spans(text) if s[0] < len(BASE)] == plain_personal(text)


def test_base_spans_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op12_personal_data"](spark, sf).collect()}
    for d in docs.collect():
        want, r = plain_personal(d["text"]), rows[d["doc_id"]]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == i for s in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{BASE[k]}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert r["spans"].startswith(",".join(f"{BASE[k]}:{s}:{e}" for k, s, e in want))
    assert len(rows) == docs.count()


def added(text):
    return [(k, text[s:e]) for k, s, e in FINDER.spans(text) if k >= len(BASE)]


def test_added_spans():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert iban_fits("GB82 WEST 1234 5698 7654 32") and not iban_fits("GB82 WEST 1234 5698 7654 33")
    assert added("see ftp://ann:pw@files.example.com/x and http://example.com/@b") == [(4, "ftp://ann:pw@files.example.com")]
    assert added("sip:bob@pbx, mailto:a@b.example, tel:555-123-4567") == [(4, "bob@pbx"), (4, "555-123-4567")]
    assert added("write ann.lee (at) mail (dot) example.com now") == [(4, "ann.lee (at) mail (dot) example.com")]
    assert added("IBAN: GB82 WEST 1234 5698 7654 32.") == [(5, "GB82 WEST 1234 5698 7654 32")]
    assert added("IBAN: GB82 WEST 1234 5698 7654 33.") == []
    assert added("Account No. 12345-678, ssn 123-45-6789, SSN 000-12-3456, account of Ann, accounts 1234567") == [(5, "12345-678"), (5, "123-45-6789")]
    assert added("username: ann_lee7; login page; a username is asked for") == [(5, "ann_lee7")]


def test_long_texts_take_linear_time():
    for text in ("a" * 500_000 + "@", "1." * 300_000, "1 " * 300_000, "+1" + "(" * 500_000, "a@" * 200_000, "account " * 60_000, "://" * 100_000):
        FINDER.spans(text)
    assert len(FINDER.spans("x@y.z " * 50_000)) == 50_000


def test_personal_cases(messy, empty, spark):
    assert personal_data(messy).count() == messy.count() and personal_data(empty).count() == 0
    df = spark.createDataFrame([(1, "🙂 a@b.c +1 (555) 123-4567!"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "spans", "kind")})
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in personal_data(df).collect()}
    assert got == {1: [("email", 2, 7, "a@b.c"), ("phone", 8, 25, "+1 (555) 123-4567")], 2: []}
    masked = mask_personal_data(df)
    assert masked.columns == df.columns and [r["text"] for r in masked.orderBy("doc_id").collect()] == ["🙂 [email] [phone]!", None]
    assert mask_personal_data(messy).columns == messy.columns
