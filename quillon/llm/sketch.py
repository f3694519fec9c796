"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._batches import batch, columns, rows, small_batches

#: Hex digits kept of each hash, its high bits.
DIGITS = 12
#: Shingles of a text at most whose hashes are all retained: a short text's sketch would else be empty or say little.
WHOLE = 64
#: Ranges of ids at most, whatever the table's size; larger ones are read in order all the same.
MOST_RANGES = 16_000
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sketch(NamedTuple):
    """The hashes, cut to their high bits, distinct and ascending, of all shingles whose hash is below the threshold of ``level``."""

    level: int
    hashes: np.ndarray


def threshold(level: int, fraction: float) -> int:
    """What hashes, cut to their high bits, lie below at a level: the whole range at level 0, ``fraction`` of it at level 1."""
    return int((fraction if level else 1) * 16**DIGITS)


class Sketcher:
    """Sketches of texts: every hash of a ``words``-word shingle that lies below ``fraction`` of the hash range (level 1), or,
    of a text of at most ``WHOLE`` shingles, every hash (level 0).

    Words are lower-cased and split at white space. A text of fewer words is one shingle; one without words has an empty
    sketch. Two sketches compare and merge at the lower of their thresholds, where each holds all hashes below it, so the
    union of sketches is the sketch of the union.
    """

    def __init__(self, fraction: float, words: int) -> None:
        self.fraction, self.words = fraction, words
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> Sketch:
        return self.sketch(self.shingles(text))

    def shingles(self, text: str) -> np.ndarray:
        """The hash, cut to its high bits, of every shingle in turn."""
        found = text.lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        h = np.empty(len(found), np.uint64)
        for k, w in enumerate(found):
            v = seen.get(w)
            if v is None:
                v = seen[w] = xxhash.xxh3_64_intdigest(w)
            h[k] = v
        n = max(1, len(found) - self.words + 1)
        mixed = np.zeros(n, np.uint64)
        for k in range(min(self.words, len(found))):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return mixed >> np.uint64(64 - 4 * DIGITS)

    def sketch(self, every: np.ndarray) -> Sketch:
        """The sketch of a text's shingles."""
        level = int(len(every) > WHOLE)
        return Sketch(level, np.unique(every[every < np.uint64(threshold(level, self.fraction))] if level else every))

    def at(self, sketch: Sketch, level: int) -> np.ndarray:
        """The hashes of a sketch below the threshold of ``level``, at least its own."""
        return sketch.hashes if level == sketch.level else sketch.hashes[sketch.hashes < np.uint64(threshold(level, self.fraction))]

    def merged(self, a: Sketch, b: Sketch) -> Sketch:
        """The sketch of both texts' shingles."""
        level = max(a.level, b.level)
        return Sketch(level, np.union1d(self.at(a, level), self.at(b, level)))

    def containment(self, a: Sketch, b: Sketch) -> float:
        """Estimated share of the smaller text's shingles that the other holds, by the hashes below the lower threshold of the
        two; 1 where neither has any hash there, 0 where one has none."""
        level = max(a.level, b.level)
        x, y = self.at(a, level), self.at(b, level)
        least = min(len(x), len(y))
        return len(np.intersect1d(x, y, assume_unique=True)) / least if least else float(len(x) == len(y))

    def likeness(self, a: Sketch, b: Sketch, every_a: np.ndarray, every_b: np.ndarray) -> float:
        """Containment where all shingles of both texts are at hand: a short text's hashes, all retained, are looked for among
        all of a longer one, of which a sketch holds too few of them to tell; other pairs are compared by their sketches."""
        if a.level == b.level:
            return self.containment(a, b)
        return self.containment(*(s if s.level == 0 else Sketch(0, np.unique(every)) for s, every in ((a, every_a), (b, every_b))))


def written(sketch: Sketch) -> str:
    """A sketch as text: its level, then its hashes ascending, ``DIGITS`` hex digits each."""
    return str(sketch.level) + sketch.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(
    docs: DataFrame, fraction: float = 1 / 4, words: int = 5, rows_per_task: int = 4000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by (doc_id, text), a null doc_id first; after the last comes the first. Rows are
    dealt over ranges of doc_id with bounds from its approximate quantiles (several a task, to even out what they hold; at
    most ``MOST_RANGES``, whose bounds the driver holds), sorted there and read in order; each range
    also gets the first row of the next one (found by a broadcast of one id a range), so texts are shuffled once and no task
    holds more than a row at a time.
    A fingerprint is the level of the sketch and its hashes (see ``Sketcher``); likeness is the estimated containment (see
    ``Sketcher.likeness``; it is exact where one text is short).
    A null text is empty; a table of one row follows itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = columns(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("at"))
    n = d.count()
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_task)))
    ranges = min(MOST_RANGES, 8 * parts)
    steps = [k / ranges for k in range(1, ranges)] or [0.5]
    bounds = np.unique(np.array(d.agg(F.percentile_approx("at", steps, 20 * ranges)).first()[0] or [], np.int64))

    @F.arrow_udf("int")
    def place(at: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, at.to_numpy(), "right").astype(np.int32))

    d = d.withColumn("range", place("at"))
    first = sorted((r["range"], r["first"]) for r in d.groupBy("range").agg(F.min("at").alias("first")).collect())
    follows = [(k, first[(i + 1) % len(first)][1]) for i, (k, _) in enumerate(first)]
    edge = spark.createDataFrame(follows, "to_range int, first long")
    after = d.join(F.broadcast(edge), d["at"] == edge["first"]).select("doc_id", "text", "at", F.col("to_range").alias("range"), F.lit(1).alias("after"))
    dealt = d.select("doc_id", "text", "at", "range", F.lit(0).alias("after")).unionByName(after)
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "after", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(fraction, words)
        last = None
        for b in batches:
            out = []
            for doc_id, text, _, place, is_after in rows([b]):
                every = sketch.shingles(text)
                own = sketch.sketch(every)
                if last and last[2] == place and not last[4]:
                    changed = edited(last[1], text)
                    every_changed = sketch.shingles(changed)
                    s = sketch.sketch(every_changed)
                    out.append((
                        last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), written(last[3]), written(s),
                        sketch.likeness(last[3], s, last[5], every_changed), sketch.likeness(last[3], own, last[5], every),
                    ))
                last = (doc_id, text, place, own, is_after, every)
            yield batch(SCHEMA, out)

    return dealt.mapInArrow(run, DDL)
