"""The formatted texts read back as the turns they were made of, whatever stands in them."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import chat, queries
from tests.llm.compare import both

TURNS = "conv_id long, turn long, role string, text string, turns string, formatted int, `a.b` int"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    """Digests by conversation, from the rows alone but for the length of the formatted text."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        out[c] = (len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(loss), sha(loss))
    return out


def run(spark, rows):
    t = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.formatted(t)).collect()}


def test_equals_its_sql(spark, sf):
    got, want = both(spark, sf, queries.op13_chat_format, queries.oracle_sql()["op13_chat_format"])
    assert got == want and len(got) > 1


def test_plan_has_no_python(spark, sf):
    plan = queries.op13_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_awkward_rows(spark):
    rows = [
        (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nhi"), (1, 1, "assistant", "<\\|im_sep|> <\\\\|x <| |> <"), (1, 2, "assistant", "|im_end|>"), (1, 3, "user", None),
        (2, 1, None, "a"), (2, 0, "assistant\nuser", "b\nc"), (2, 2, "<|im_end|>\\n", "\\"), (2, 2, "<|im_end|>\\n", "\\"), (2, None, "assistant", "first"),
        (3, 0, "assistant", ""), (4, 0, "assistant", "\U0001f600" * 5 + "<"), (4, 1, "assistant", "\U0001f600|"), (4, 2, "assistant", ""),
        (None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 0, "user", "long <| " * 200_000), (5, 1, "assistant", "<\\|" * 200_000),
        (6, 0, "assistant", None), (6, 0, "assistant", None),
    ]
    assert run(spark, rows) == expected(rows)


def test_adjacent_turns_of_a_role_are_one_block(spark):
    t = spark.createDataFrame([(1, 0, "user", "a", "", 0, 0), (1, 1, "user", "b", "", 0, 0), (1, 2, "assistant", "c", "", 0, 0)], TURNS)
    row = chat.formatted(t).first()
    assert row.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [row.formatted.encode()[s.start : s.start + s.length] for s in row.loss_spans] == [b"c"]


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_many_turns(spark):
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], f"text {k} <|im_sep|>") for k in range(3000)]
    assert run(spark, rows) == expected(rows)


marks = st.text(alphabet="<\\|\n>ims_aé", max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.one_of(st.none(), st.sampled_from(["user", "assistant"]), marks), st.one_of(st.none(), marks)), max_size=60))
def test_round_trip(spark, rows):
    assert run(spark, rows) == expected(rows)


def test_escape_is_one_to_one(spark):
    texts = ["", "<|", "<\\|", "<\\\\|", "<<||", "\\<|\\", "<", "|", "\\"]
    t = spark.createDataFrame([(x,) for x in texts], "x string").select("x", chat.escaped(F.col("x")).alias("e"))
    rows = t.select("x", "e", chat.unescaped(F.col("e")).alias("u")).collect()
    assert all(r.u == r.x and "<|" not in r.e for r in rows) and len({r.e for r in rows}) == len(texts)
