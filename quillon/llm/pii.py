"""Personal data: base patterns, and terms that corpus co-occurrence shows to disclose a protected entity."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._batches import batch, columns, fresh, rows, small_batches
from quillon.session import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
FOUND = (
    "struct<key:string,n_email:long,n_ip:long,n_card:long,n_phone:long,spans:array<struct<start:long,end:long,kind:string>>,"
    "entities:array<string>,terms:array<struct<term:string,places:array<struct<start:long,end:long>>>>>"
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the leftmost search of local-part@domain finds: from each domain the run of local characters to its left,
    down to the last match; linear also in long runs that hold no @."""
    last = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four patterns, leftmost and non-overlapping within a kind; failing matches are dropped. By start, then kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entities(text: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """The distinct protected entities of a text, in order."""
    return sorted({kind + ":" + text[a:b].lower() for a, b, kind in spans})


def terms(text: str, spans: list[tuple[int, int, str]]) -> dict[str, list[tuple[int, int]]]:
    """Each word of three or more letters of the whole text with its places (start, end) outside all spans (sorted by start)."""
    out: dict[str, list[tuple[int, int]]] = {}
    at = last = 0
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            last = max(last, spans[at][1])
            at += 1
        if last <= m.start():
            out.setdefault(m[0].lower(), []).append(m.span())
    return out


def find_base(docs: DataFrame, text_col: str = "text"):
    """A struct column (``FOUND``) from ``text_col``: a key of the text, counts, base spans, and where there are some its entities and terms."""
    small_batches(docs.sparkSession)
    kind = pa.struct([
        ("key", pa.string()), *[(f"n_{k}", pa.int64()) for k in KINDS],
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))),
        ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))),
    ])

    @F.arrow_udf(FOUND)
    def column(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            text = text or ""
            spans = base_spans(text)
            n = Counter(k for _, _, k in spans)
            out.append({
                "key": hashlib.md5(text.encode()).hexdigest(), **{f"n_{k}": n[k] for k in KINDS},
                "spans": [{"start": a, "end": b, "kind": k} for a, b, k in spans],
                "entities": entities(text, spans),
                "terms": [{"term": t, "places": [{"start": a, "end": b} for a, b in at]} for t, at in terms(text, spans).items()] if spans else [],
            })
        return pa.array(out, kind)

    return column.asNondeterministic()(F.coalesce(F.col(text_col), F.lit("")))  # so that no plan evaluates it twice


def term_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, documents): in how many rows each word of three or more letters occurs, over whole texts."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("term", pa.string()), ("documents", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for (text,) in rows([b]):
                held.update({w.lower() for w in WORD.findall(text or "")})
            if len(held) > 400_000:
                yield batch(schema, list(held.items()))
                held = Counter()
        yield batch(schema, list(held.items()))

    return columns(docs, text=text_col).mapInArrow(run, "term string, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))


def disclosing_terms(found: DataFrame, docs: DataFrame, least: float = 0.9, least_documents: int = 2, text_col: str = "text") -> DataFrame:
    """(entity, term, disclosure) of terms whose co-occurrence gives away an entity.

    Over N rows, with n(e) rows that hold entity e, n(t) that hold term t and n(e, t) that hold e and, anywhere outside base spans, t,
    disclosure = PMI(e; t) / IC(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)): 1 if t occurs with e alone, 0 or less if
    they are independent. Pairs seen in fewer than ``least_documents`` rows estimate nothing and are left out.
    """
    n = docs.count()
    words = F.first(F.transform("terms", lambda t: t["term"])).alias("words")
    texts = materialize(found.where("size(entities) > 0").groupBy("key").agg(F.count("*").alias("m"), F.first("entities").alias("entities"), words), "pii-texts")
    held = texts.select("m", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("m").alias("n_e"))
    alone = materialize(held.where((F.col("n_e") >= least_documents) & (F.col("n_e") < n)), "pii-entities")  # fewer rows hold too few pairs
    often = texts.select("m", "words", F.explode("entities").alias("entity")).join(alone.select("entity"), "entity")
    pairs = often.select("m", "entity", F.explode("words").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.sum("m").alias("n_et")).where(F.col("n_et") >= least_documents)
    together = materialize(together, "pii-pairs")
    known = term_documents(docs, text_col).join(together.select("term").distinct(), "term", "left_semi")
    both = together.join(alone, "entity").join(known, "term")
    pmi = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("documents")))
    return both.withColumn("disclosure", pmi / F.log(F.lit(float(n)) / F.col("n_e"))).where(F.col("disclosure") >= least).select("entity", "term", "disclosure")


def term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, terms): by text, all places (start, end, disclosure) of terms that disclose an entity the text holds.

    A text's words meet the terms by the term, never by the entity alone: with disclosure of at least ``least``, a share of
    at least (n(e) / N) ** (1 - least) of the texts that hold a term holds its entity, so what meets is in proportion to
    what is found, also where one entity stands in very many texts.
    """
    texts = found.where("size(entities) > 0").groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("words"))
    held = texts.select("key", F.explode("entities").alias("entity"))
    places = texts.select("key", F.explode("words").alias("w")).select("key", "w.term", "w.places")
    wanted = places.join(terms, "term").join(held, ["key", "entity"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"), F.first("places").alias("places"))
    hits = wanted.select("key", "disclosure", F.explode("places").alias("p"))
    return hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("p.start", "p.end", "disclosure"))).alias("terms"))


def _listed(spans) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, least: float = 0.9, least_documents: int = 2) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 of the base spans, and all spans as kind:start:end.

    Added spans have the kind ``term``. A null text is empty, a text without data has an empty list (its base_sha256 is
    that of the empty string), rows repeated under one doc_id are each judged by their own text, an empty table gives
    no rows.
    """
    d = columns(docs, doc_id="doc_id", text="text")
    found = materialize(d.select("doc_id", find_base(d).alias("f")).select("doc_id", "f.*"), "pii-base")
    extra = term_spans(found, disclosing_terms(found, d, least, least_documents))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    more = F.transform(F.coalesce("terms", F.expr("array()")), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("rank"), s["end"].alias("end"), F.lit(TERM).alias("kind")))
    plain = found.drop("terms").where("size(spans) = 0").withColumn("terms", F.lit(None).cast(extra.schema["terms"].dataType))
    both = found.drop("terms").where("size(spans) > 0").join(extra, "key", "left").unionByName(plain)  # texts without spans meet in no join
    return both.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.array_distinct(F.concat(base, more)))).alias("spans"),
    )


def sanitized(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each span (start, end, replacement) replaced; overlapping spans become one with the first's replacement."""
    if text is None or not spans:
        return text
    out, last = [], 0
    for a, b, by in sorted(spans):
        if a >= last:
            out += [text[last:a], by]
        last = max(last, b)
    return "".join([*out, text[last:]])


def broader(term: str) -> str:
    """What a disclosing term is generalised to: a name, an abbreviation or a word."""
    return "[abbreviation]" if term.isupper() else "[name]" if term[:1].isupper() else "[word]"


def sanitize(docs: DataFrame, least: float = 0.9, least_documents: int = 2, remove_from: float = 0.999) -> DataFrame:
    """The rows and columns of ``docs`` with personal data replaced in ``text``; ``n_chars``, where there is one, follows.

    Base data are generalised to their kind (``[email]``), a disclosing term to its broader class (``[name]``,
    ``[abbreviation]`` or ``[word]``); one that discloses its entity wholly (at least ``remove_from``) is removed. A null
    text stays null, other columns stay whatever their names. Only texts with personal data meet in a join, by a hash.
    """
    d = columns(docs, text="text")
    found = materialize(d.select(find_base(d).alias("f")).select("f.*").where("size(spans) > 0"), "pii-base")
    extra = term_spans(found, disclosing_terms(found, d, least, least_documents))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("by")))
    terms = F.transform(F.coalesce("terms", F.expr("array()")), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.when(s["disclosure"] >= remove_from, "").alias("by")))
    key, marks, own = (fresh(docs, c) for c in ("pii_key", "pii_marks", "pii_own"))
    marked = found.drop("terms").dropDuplicates(["key"]).join(extra, "key", "left").select(F.col("key").alias(key), F.concat(spans, terms).alias(marks))

    @F.arrow_udf("string")
    def replace(texts: pa.Array, marks: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), marks.to_pylist(), strict=True)
        return pa.array([sanitized(t, [(m["a"], m["b"], broader(t[m["a"] : m["b"]]) if m["by"] is None else m["by"]) for m in ms or []]) for t, ms in both], pa.string())

    keyed = docs.withColumn(own, F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    out = keyed.join(marked, keyed[own] == marked[key], "left").withColumn("text", replace("text", marks))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(key).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
