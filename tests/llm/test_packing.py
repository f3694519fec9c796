import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from quillon.llm import packing
from quillon.llm.queries import tokenizer_files


def check(pieces, want, window):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, ids in want.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert set(by_doc) == set(want)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "doc_id")
    files = tokenizer_files()
    t = Tokenizer.from_file(files["tokenizer_json"])
    want = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    check(packing.pack(docs, **files).collect(), want, 2048)
    check(packing.pack(docs, **files, window=64, shard_tokens=3000).collect(), want, 64)


def test_edges(spark):
    files = tokenizer_files()
    t = Tokenizer.from_file(files["tokenizer_json"])
    texts = {1: None, 2: "", 3: "long text " * 40000, 4: "end<|endoftext|>here", 5: "½²  é́ ㊙ 't 've", None: "x"}
    docs = spark.createDataFrame([(i, x, 7) for i, x in texts.items()], "doc_id long, text string, start int")
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    check(packing.pack(docs, **files).collect(), want, 2048)
    check(packing.pack(docs, tokenizer_json=files["tokenizer_json"]).collect(), want, 2048)
    twice = packing.pack(docs.where("doc_id = 2").union(docs.where("doc_id = 2")), **files).collect()
    assert [p.length for p in twice] == [1, 1]
    assert packing.pack(docs.limit(0), **files).count() == 0


def test_best_fit_leaves_no_padding():
    random.seed(2)
    for window in (8, 64, 2048):
        for _ in range(40):
            lengths = [random.choice([1, random.randint(1, window), random.randint(1, 3 * window)]) for _ in range(random.randint(0, 60))]
            seen = [[0] * n for n in lengths]
            for sequence in packing.plan(lengths, window):
                n = sum(k for _, _, k in sequence)
                assert n == window or n & (n - 1) == 0
                for d, s, k in sequence:
                    for i in range(s, s + k):
                        seen[d][i] += 1
            assert all(c == 1 for x in seen for c in x)


def test_tightest_window():
    random.seed(3)
    tree, bag = packing.OpenWindows(64), []
    for i in range(3000):
        if random.random() < 0.5:
            c = random.randint(0, 64)
            tree.put(c, i)
            bag.append((c, i))
        else:
            n = random.randint(0, 64)
            got, fit = tree.take(n), [c for c, _ in bag if c >= n]
            assert (got is None) == (not fit)
            if got:
                assert got[0] == min(fit)
                bag.remove(got)
