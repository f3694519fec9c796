"""Chat formatting: conversations as one text with turn marks and a loss mask, and the way back; Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._batches import columns

#: The marks of the template. Inside a text ``<|`` never stands, so no text can look like a mark.
START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
SPANS = "array<struct<start:bigint,length:bigint>>"


def escaped(text: Column) -> Column:
    """``text`` with one more backslash in each ``<``, backslashes, ``|``; so no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    """A role without line breaks and ``<``, each of its backslashes, breaks and ``<`` as a backslash and a letter."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it and in whatever loop."""
    return F.transform(F.array(value), f)[0]


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation.

    Its turns, sorted by (turn, role, text), are written as ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a
    line break; adjacent turns of one role are merged into one such block, with ``<|im_sep|>`` between their texts, so they can be
    told apart again. loss_spans are (start, length) in bytes of the UTF-8 text, of each text of the ``learned`` role.

    A null text or role reads as an empty one; a null turn sorts first; repeated rows are turns of their own; rows without
    conv_id are one conversation; an empty table gives an empty result. A conversation is one row, so it must fit into one.
    """
    t = columns(turns, conv_id=conv, turn=turn, role=role, text=text)
    rows = t.groupBy("conv_id").agg(F.collect_list(F.struct("turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])).alias("turns"))
    empty = F.struct(
        F.lit(None).cast("string").alias("role"), F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"), F.array().cast(SPANS).alias("spans")
    )

    def add(acc: Column, x: Column) -> Column:
        opened = F.concat(F.when(acc["role"].isNull(), "").otherwise(END), F.lit(START), _role(x["role"]), F.lit("\n"))
        mark = F.when(acc["role"] == x["role"], NEXT).otherwise(opened)

        def placed(p: Column) -> Column:
            start, length = acc["at"] + F.octet_length(p["mark"]), F.octet_length(p["body"]).cast("long")
            span = F.when(x["role"] == learned, F.array(F.struct(start.alias("start"), length.alias("length")))).otherwise(F.array().cast(SPANS))
            parts = F.concat(acc["parts"], F.array(p["mark"], p["body"]))
            return F.struct(x["role"].alias("role"), (start + length).alias("at"), parts.alias("parts"), F.concat(acc["spans"], span).alias("spans"))

        return _bound(F.struct(mark.alias("mark"), escaped(x["text"]).alias("body")), placed)

    done = rows.select("conv_id", F.aggregate(F.array_sort("turns"), empty, add).alias("done"))
    return done.select("conv_id", F.concat(F.array_join("done.parts", ""), F.lit(END)).alias("formatted"), F.col("done.spans").alias("loss_spans"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, an array of (role, text)."""
    blocks = F.split(text, r"<\|im_end\|>\n")
    opened = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.substr(b, F.lit(len(START) + 1)))
    split = lambda b, end: F.struct(
        _role_back(F.left(b, end - 1)).alias("role"), F.split(F.substr(b, end + 1), r"<\|im_sep\|>").alias("texts")
    )
    parsed = F.transform(opened, lambda b: split(b, F.instr(b, F.lit("\n"))))
    return F.flatten(F.transform(parsed, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))


def learned_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, without escapes, nothing between."""
    cut = lambda whole: F.transform(spans, lambda s: unescaped(F.substr(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return F.array_join(_bound(text.cast("binary"), cut), "")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from formatted texts and their spans."""
    read = rows.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns_of(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def format_all(turns: DataFrame) -> DataFrame:
    """``digests`` of all conversations and of one more, -1, whose two texts hold the template's own marks."""
    own = turns.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("t")
    )
    marks = own.select("conv_id", "t.turn", "t.role", F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    t = columns(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    return digests(formatted(t.unionByName(marks)))
