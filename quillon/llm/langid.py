"""Language identification: known words by per-language log frequency, unseen words by shrinking character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.llm._batches import batch, columns, named, rows, small_batches

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
SMOOTHING = 0.1
UNDETERMINED = "und"
#: The most frequent words are scored where the texts are read, all others by a join; only the way, not the result, depends on it.
HEAD = 200_000
COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


@dataclass
class Model:
    """Log frequencies: a row of ``known`` for each word, one of ``grams`` for each character n-gram (``^`` and ``$`` mark a word's ends)."""

    langs: list[str]
    words: dict[str, int]
    known: np.ndarray
    gram_at: dict[str, int]
    grams: np.ndarray

    def word(self, w: str) -> np.ndarray:
        """A known word's log frequencies; else the mean over its known n-grams of the longest length that has any."""
        if (k := self.words.get(w)) is not None:
            return self.known[k]
        padded = f"^{w}$"
        for n in range(min(LONGEST, len(padded)), 0, -1):
            text = padded if n > 1 else w
            at = [k for i in range(len(text) - n + 1) if (k := self.gram_at.get(text[i : i + n])) is not None]
            if at:
                return self.grams[at].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def _log_frequencies(table: pa.Table, langs: list[str], totals: list[float] | None = None) -> tuple[dict[str, int], np.ndarray]:
    """(key -> row, smoothed log frequency per language) of a table (key, langs, counts), of ``totals`` or else of its own sums."""
    at = {lang: k for k, lang in enumerate(langs)}
    keys, lists, n = (table.column(c).combine_chunks() for c in ("key", "langs", "counts"))
    counts = np.zeros((len(keys), len(langs)))
    row = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(keys) else np.zeros(0, int)
    counts[row, [at[x] for x in lists.flatten().to_pylist()]] = n.flatten().to_numpy(zero_copy_only=False)
    smoothed = counts + SMOOTHING
    return {key: k for k, key in enumerate(keys.to_pylist())}, np.log(smoothed / (smoothed.sum(axis=0) if totals is None else np.array(totals))).astype(np.float32)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, n) over whole texts, lower-cased letter runs; counted where the rows are read, then summed."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in rows([b]):
                held.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, held.values())) > 400_000:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            yield batch(COUNTS, [(lang, w, n) for w, n in c.items()])

    pairs = columns(docs, lang=lang_col, text=text_col).where("lang is not null and text is not null")
    return pairs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _largest(counts: DataFrame, key: str, most: int | None) -> pa.Table:
    """(key, langs, counts), ascending by key, of all keys or of the most frequent, ``most`` at most: those above the level of
    total count (64 levels to a doubling) at which there would be more."""
    level = F.floor(F.log2(F.sum("n")) * 64)
    sizes = counts.groupBy(key).agg(level.alias("level")).groupBy("level").agg(F.count("*").alias("n")).collect()
    above, held, most = -1, 0, math.inf if most is None else most
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["n"]
        if held > most:
            above = r["level"]
            break
    pair = F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("by_lang")
    kept = counts.groupBy(F.col(key).alias("key")).agg(level.alias("level"), pair).where(F.col("level") > above)
    return kept.select("key", F.col("by_lang.lang").alias("langs"), F.col("by_lang.n").alias("counts")).orderBy("key").toArrow()


def train(docs: DataFrame, max_words: int | None = None, max_grams: int | None = None, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of a table whose vocabulary the driver can hold; ``identified`` scores by the same counts as tables.

    Counts words over all given rows with a language and character n-grams of lengths 1 to 5, weighted by the words'
    counts. All are kept, or at most the ``max_words`` and ``max_grams`` most frequent.
    Rows with a null language or text teach nothing; no such rows give a model of no language.
    """
    from quillon.session import materialize

    counts = materialize(word_counts(docs, lang_col, text_col), "lang-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    sizes = F.array(*[F.lit(k) for k in range(1, LONGEST + 1)])
    gram = F.explode(F.flatten(F.transform(
        F.filter(sizes, lambda k: k <= F.length("padded")),
        lambda k: F.transform(F.sequence(F.lit(1), F.length("padded") - k + 1), lambda i: F.substring("padded", i, k)),
    )))
    grams = counts.select("lang", "n", padded.alias("padded")).select("lang", "n", gram.alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "lang-grams")
    words, known = _log_frequencies(_largest(counts, "word", max_words), langs)
    gram_at, gram_rows = _log_frequencies(_largest(grams, "gram", max_grams), langs)
    return Model(langs, words, known, gram_at, gram_rows)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column (lang, score) from ``text_col``: ``und`` and 0 for a null text or one without a letter; else the
    learned language of the greatest summed log frequency (ties: the first by name) and its posterior share.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])

    @F.arrow_udf(kind)
    def column(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        most = max(1, min(300_000, 8_000_000 // max(1, len(m.langs))))
        vectors = np.zeros((most, len(m.langs)), np.float32)

        class Seen(dict):
            def __missing__(self, w: str) -> int:
                k = len(self)
                vectors[k] = m.word(w)
                self[w] = k
                return k

        seen = Seen()
        for texts in parts:
            langs, scores = [], []
            for text in texts.to_pylist():
                found = WORD.findall(text.lower()) if text else []
                if not m.langs or not any(c.isalpha() for w in found for c in w):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = np.zeros(len(m.langs))
                for at in range(0, len(found), 50_000):
                    some = found[at : at + 50_000]
                    if len(seen) + len(some) > most:
                        seen.clear()
                    if len(some) > most:
                        total += sum(m.word(w) for w in some)
                    else:
                        total += vectors[[seen[w] for w in some]].sum(axis=0, dtype=np.float64)
                share = np.exp(total - total.max())
                langs.append(m.langs[int(total.argmax())])
                scores.append(float(share.max() / share.sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return column.asNondeterministic()(F.col(text_col))  # so that no plan evaluates it twice


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _wide(counts: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """(key, c): the counts of each key by language, in the order of ``langs``."""
    return counts.groupBy(key).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in langs]).alias("c"))


def _logs(wide: DataFrame, key: str, langs: list[str]) -> tuple[DataFrame, list[float]]:
    """(key, v) of smoothed log frequencies of counts (key, c), and their denominators."""
    sums = wide.agg(F.count("*").alias("size"), *[F.sum(F.col("c")[k]).alias(f"s{k}") for k in range(len(langs))]).first()
    totals = [float(sums[f"s{k}"] or 0) + SMOOTHING * sums["size"] for k in range(len(langs))]
    return wide.select(key, F.array(*[F.log((F.col("c")[k] + SMOOTHING) / F.lit(t)) for k, t in enumerate(totals)]).alias("v")), totals


def _pieces(word: str, n: int) -> Column:
    """The n-grams of a word, repeats included; ``^`` and ``$`` mark its ends where n exceeds 1."""
    text = F.concat(F.lit("^"), word, F.lit("$")) if n > 1 else F.col(word)
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def _backed_off(unseen: DataFrame, grams: DataFrame, langs: list[str]) -> DataFrame:
    """(word, v): the mean over a word's known n-grams of the longest length that has any; no row for a word without one."""
    from quillon.session import materialize

    found = []
    for n in range(LONGEST, 0, -1):
        pieces = unseen.select("word", F.explode(_pieces("word", n)).alias("gram"))
        mean = F.array(*[F.avg(F.col("v")[k]) for k in range(len(langs))]).alias("v")
        found.append(materialize(pieces.join(grams.where(F.length("gram") == n), "gram").groupBy("word").agg(mean), f"lang-backoff-{n}"))
        unseen = materialize(unseen.join(found[-1].select("word"), "word", "left_anti"), "lang-unseen")  # few are left for shorter ones
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def identified(docs: DataFrame, taught: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``name`` (lang, score), as ``predict`` gives it, learned from all of ``taught``.

    No word and no n-gram is left out, whatever the size. The ``HEAD`` most frequent words are added up where the texts are
    read; of the others each document's counts are joined with the tables of word and n-gram frequencies, then summed.
    """
    from quillon.session import materialize

    small_batches(docs.sparkSession)
    counts = materialize(word_counts(taught), "lang-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    none = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    if not langs:
        return docs.select(*keep, none.alias(name))
    known, totals = _logs(materialize(_wide(counts, "word", langs), "lang-wide"), "word", langs)
    shared = docs.sparkSession.sparkContext.broadcast(_log_frequencies(_largest(counts, "word", HEAD), langs, totals))
    kind = pa.struct([("letters", pa.bool_()), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))])

    @F.arrow_udf("struct<letters:boolean,head:array<double>,tail:array<struct<word:string,n:long>>>")
    def read(texts: pa.Array) -> pa.Array:
        at, logs = shared.value
        out = []
        for text in texts.to_pylist():
            found = Counter(WORD.findall(text.lower()) if text else [])
            own = [(k, n) for w, n in found.items() if (k := at.get(w)) is not None]
            total = np.zeros(len(langs))
            if own:
                rows_at, times = np.array(own).T
                total = times @ logs[rows_at].astype(np.float64)
            out.append({
                "letters": any(c.isalpha() for w in found for c in w), "head": total.tolist(),
                "tail": [{"word": w, "n": n} for w, n in found.items() if w not in at],
            })
        return pa.array(out, kind)

    row, part = f"{name}_row", f"{name}_part"
    marked = docs.select(*keep, F.monotonically_increasing_id().alias(row), read.asNondeterministic()(F.col("text")).alias(part))
    marked = materialize(marked, "lang-rows")
    tails = marked.select(row, F.explode(F.col(part)["tail"]).alias("t")).select(row, "t.word", "t.n")
    asked = materialize(tails.select("word").distinct().join(known, "word", "left"), "lang-asked")
    grams = counts.select("lang", "n", F.explode(F.concat(F.array(F.lit("^"), F.lit("$")), *[F.coalesce(_pieces("word", n), F.array().cast("array<string>")) for n in range(1, LONGEST + 1)])).alias("gram"))
    grams, _ = _logs(materialize(_wide(grams, "gram", langs), "lang-grams"), "gram", langs)
    every = asked.where("v is not null").unionByName(_backed_off(asked.where("v is null").select("word"), grams, langs))
    sums = tails.join(every, "word").groupBy(row).agg(F.array(*[F.sum(F.col("n") * F.col("v")[k]) for k in range(len(langs))]).alias("more"))
    total = F.when(F.col("more").isNull(), F.col(part)["head"]).otherwise(F.zip_with(F.col(part)["head"], "more", lambda a, b: a + b))
    out = marked.join(sums, row, "left").withColumn("total", total).withColumn("best", F.array_max("total"))
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("total", F.col("best")).cast("int"))
    score = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return out.select(*keep, F.when(F.col(part)["letters"], F.struct(lang.alias("lang"), score.alias("score"))).otherwise(none).alias(name))


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows not held out and predicts every row: doc_id, held_out, lang_pred, score.

    A null doc_id is not held out. Repeated rows are predicted each; an empty table gives no rows.
    """
    d = columns(docs, doc_id="doc_id", text="text", lang="lang").withColumn("held_out", held_out())
    found = identified(d, d.where("not held_out"), "found", ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least ``least_score``, all columns kept, ``lang`` set to it."""
    d = columns(docs, doc_id="doc_id", text="text", lang="lang").withColumn("held_out", held_out())
    inner = [f"c{k}" for k in range(len(docs.columns))]  # so that no column of the table clashes
    found = identified(docs.select(*[named(docs, c).alias(i) for c, i in zip(docs.columns, inner, strict=True)], docs["text"]), d.where("not held_out"), "found", inner)
    found = found.where(F.col("found.lang") != UNDETERMINED).where(F.col("found.score") >= least_score)
    return found.select(*[(F.col("found.lang") if c == "lang" else F.col(i)).alias(c) for c, i in zip(docs.columns, inner, strict=True)])
