"""The audit against its SQL and against a walk through all orders, on rows with every awkward case."""

import re
from itertools import permutations

import pytest

from quillon.llm import audit, queries
from tests.llm.compare import both

DOCS = "doc_id long, text string, lang string, n long, good int, bits string, `a.b` int"
LABELS = "doc_id long, quality int, toxic int, lang string, digest string"


def brute(docs, labels):
    """Rows of the audit by applying every order to every document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                own = [r for r in rows if r[0] == part and f in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def run(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, 1, "x", 2) for x in docs], DOCS)
    l = spark.createDataFrame([(*x, "en", "y") for x in labels], LABELS)
    return sorted(tuple(r) for r in audit.audit(d, l).collect())


def test_equals_its_sql(spark, sf):
    got, want = both(spark, sf, queries.op11_filter_audit, queries.oracle_sql()["op11_filter_audit"])
    assert got == want and len(got) % 600 == 0 and got


def test_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    plain = " ".join(f"v{k}" for k in range(300))
    docs = [
        (1, plain, "en"), (2, plain, "de"), (2, plain, "de"), (3, plain, None), (1, plain, "en"), (None, plain, "en"), (4, None, "en"), (5, "", "en"),
        (6, long, ""), (7, long + " #", "fr"), (8, "word " * 250, "en"), (9, "WORD " * 250, "en"), (10, "a\x0bb\tc d e", "en"),
        (11, "\U0001f600" * 97 + "ABC", "en"), (12, "\U0001f600" * 96 + "ABCD", "en"), (13, "  \n ", "en"), (14, " ".join(["x", "y"] * 100), "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (7, 1, 1), (99, 1, 1), (8, 1, 0)]
    assert run(spark, docs, labels) == brute(docs, labels)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_empty_tables(spark, labels):
    assert run(spark, [], labels) == []
    one = run(spark, [(1, "x", "en")], labels)
    assert len(one) == 600 and {r[4] for r in one} == {0, 1}


def test_copies_in_any_number(spark):
    docs = [(k, "same text", "en" if k % 3 else "de") for k in range(2000)] + [(5000, "other", "en")]
    assert run(spark, docs, [(0, 1, 0), (1999, 1, 1)]) == brute(docs, [(0, 1, 0), (1999, 1, 1)])
