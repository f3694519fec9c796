"""Collocations against their SQL and against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import collocations, queries
from tests.llm.compare import both

DOCS = "doc_id long, text string, lang string, prefix string, phrase int, `a.b` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(docs):
    """Counts of (lang, phrase) of one to three words."""
    f = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang if lang is not None else "und", " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return f


def brute(docs, least=10, most=2000):
    f = grams(docs)
    n = Counter()
    for (lang, p), a in f.items():
        n[lang] += a * (" " not in p)
    out = []
    for lang in n:
        found = []
        for (own, p), a in f.items():
            w = p.split(" ")
            if own != lang or len(w) < 2 or a < least:
                continue
            longer = [b for (o, q), b in f.items() if o == lang and b >= least and q.count(" ") == 2 and (q.startswith(p + " ") or q.endswith(" " + p))] if len(w) == 2 else []
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            found.append((-s, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
        out += [(lang, r, p.decode(), -a, l, rr, n[lang], -s) for r, (s, a, p, l, rr) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def run(spark, docs, **more):
    d = spark.createDataFrame([(k, t, l, "x", 1, 2) for k, (t, l) in enumerate(docs)], DOCS)
    return sorted(tuple(r) for r in collocations.mine(d, **more).collect())


def test_equals_its_sql(spark, sf):
    got, want = both(spark, sf, queries.op12_collocations, queries.oracle_sql()["op12_collocations"])
    assert got == want and got


def test_awkward_rows(spark):
    docs = [(None, "en"), ("", "en"), (None, None), ("One two\tthree. one TWO  three\x0bfour", None)] * 12
    docs += [("a a a a a", "xx")] * 5 + [("ÉtÉ de la mer; ÉtÉ de la terre", "fr")] * 10 + [("x y. " * 20_000, "long")] + [("p q r s", "")] * 11
    docs += [("new york city", "en")] * 10 + [("new york times", "en")] * 9 + [("old york town", "en")] * 30
    assert run(spark, docs) == brute(docs)


def test_limit_and_ties(spark):
    docs = [(f"w{k} v{k}", "en") for k in range(40) for _ in range(10)]
    got = run(spark, docs, most=7)
    assert got == brute(docs, most=7) and [r[1] for r in got] == list(range(1, 8))


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize(("at_once", "words", "size"), [(5, 1 << 19, 9), (1 << 21, 4, 1 << 20), (11, 6, 3), (1 << 21, 1 << 19, 1 << 20)])
def test_bounds_change_nothing(monkeypatch, at_once, words, size):
    """Stripes handed on in the middle of a text or a piece add up to the same counts."""
    monkeypatch.setattr(collocations, "AT_ONCE", at_once)
    monkeypatch.setattr(collocations, "WORDS", words)
    monkeypatch.setattr(collocations, "SLICE", size)
    docs = [("the cat sat. the cat ran on the mat, a cat", "en"), ("le chat\tnoir", "fr"), (None, "en"), ("averyveryverylongword b c " * 9 + ".", "en"), ("b c", "fr")]
    batches = [pa.RecordBatch.from_pydict({"lang": [l for _, l in docs[k : k + 2]], "text": [t for t, _ in docs[k : k + 2]]}, pa.schema([("lang", pa.string()), ("text", pa.string())])) for k in (0, 2, 4)]
    got, roots, chunks = Counter(), Counter(), {}
    everything = np.full(4, 2**64 - 1, np.uint64)
    for b in (b for frequent in (None, everything) for b in collocations._stripes(iter(batches), frequent)):
        for r in b.to_pylist():
            for w, n in zip(r["nexts"], r["counts"], strict=True):
                if r["prefix"]:
                    got[r["lang"], " ".join(filter(None, (r["prefix"], w)))] += n
                else:
                    roots[r["lang"]] += n
                assert chunks.setdefault((r["lang"], r["prefix"], w), r["chunk"]) == r["chunk"]
    want = grams(docs)
    assert got == want
    assert roots == Counter({lang: sum(n for (o, p), n in want.items() if o == lang and " " not in p) for lang in ("en", "fr")})


def test_filter_holds_its_pairs_and_little_else(spark):
    made = [("en" if k % 2 else "fr", f"a{k}", f"b{k}") for k in range(5000)]
    table = collocations.pair_filter(spark.createDataFrame(made, "lang string, prefix string, next string"))
    assert len(table) == 8192

    def passes(rows):
        hit = 0
        for lang, x, y in rows:
            block, mask = collocations.pair_bits(lang, collocations.hashes([x.encode()]), collocations.hashes([y.encode()]), len(table))
            hit += int(table[block[0]] & mask[0] == mask[0])
        return hit

    assert passes(made) == len(made)
    assert passes([("en", y, x) for _, x, y in made]) < 50
    assert len(collocations.pair_filter(spark.createDataFrame([], "lang string, prefix string, next string"))) == 2


@pytest.mark.parametrize("blocks", [2, 4])
def test_a_full_filter_changes_nothing(spark, monkeypatch, blocks):
    monkeypatch.setattr(collocations, "MOST_BLOCKS", blocks)
    docs = [(f"aa bb cc dd{k % 7} ee ff{k % 3}", "en") for k in range(60)]
    assert run(spark, docs) == brute(docs)


def test_large_counts_are_exact(spark):
    big = 3_037_000_499_123
    row = spark.createDataFrame([(big, big + 7, big + 11)], "a long, l long, r long").select(collocations.score("a", "l", "r")).first()
    assert row[0] == 10**6 * big * big // ((big + 7) * (big + 11))
