"""Phrase collocation mining by stripes: each prefix keys a counter of next words, counters merge elementwise."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillon.llm._batches import columns, rows, small_batches
from quillon.session import materialize

#: Words a task counts before it hands on its stripes, and distinct ones of them; memory bounds, no result depends on them.
AT_ONCE, WORDS = 1 << 22, 1 << 19
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Parts into which the stripe of a one-word and a two-word prefix is dealt by the next word, so no stripe is whole in one task.
CHUNKS = {1: 32, 2: 8}
#: Bits of a word's id within a task; a slice beyond the bound on words stays below.
BITS = 21
#: 64-bit blocks of the filter of frequent pairs: two a pair, and at most 32 MB of them, the bound of what is broadcast.
MOST_BLOCKS = 1 << 22

STRIPES = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("chunk", pa.int32()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _byte_map() -> bytes:
    """A-Z to a-z, a tab to a space, what ends a piece to a full stop; bytes of longer characters stay."""
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    for b in b",;:!?\n\x0b\x0c\r":
        table[b] = ord(".")
    table[ord("\t")] = ord(" ")
    return bytes(table)


BYTES = _byte_map()


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with a full stop where a piece ends and at the end, some at a time."""
    at, text = 0, text.translate(BYTES)
    while at < len(text):
        end = at + SLICE
        if end < len(text):  # a slice ends where a word does
            cut = max(text.rfind(b" ", at, end), text.rfind(b".", at, end))
            while cut < 0 and end < len(text):
                end += SLICE
                cut = max(text.rfind(b" ", at, end), text.rfind(b".", at, end))
            end = len(text) if cut < 0 else cut + 1
        yield text[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


def _rows(lang: str, prefix: pa.Array, chunk: np.ndarray, group: np.ndarray, nexts: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Entries sorted by group as rows of one stripe each; prefix and chunk are those of the entries."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    offsets = pa.array(np.r_[starts, len(group)].astype(np.int32))
    first = pa.array(starts)
    lists = [pa.ListArray.from_arrays(offsets, nexts), pa.ListArray.from_arrays(offsets, pa.array(counts))]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(starts), pa.string()), prefix.take(first), pa.array(chunk[starts].astype(np.int32)), *lists], schema=STRIPES)


def pair_bits(lang: str, first: np.ndarray, last: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, mask) of pairs in a blocked Bloom filter of ``blocks`` (a power of two) times 64 bits, from the hashes of their words."""
    with np.errstate(over="ignore"):
        h = (first * np.uint64(0x9E3779B97F4A7C15) + last) ^ np.uint64(xxh64_intdigest(lang))
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return (h >> np.uint64(24) & np.uint64(blocks - 1)).astype(np.int64), mask


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def stripes_of(lang: str, ids: np.ndarray, words: list[bytes], frequent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The stripes of a stream of word ids, 0 where a piece ends, after its first two, which are context only.

    Without ``frequent``: of each word the counts of the words after it within a piece, and of the word itself under the empty
    next word; and the stripe of the empty prefix, which counts all words so. With it, a filter of the frequent pairs: of
    two words the counts of the words after them, where both pairs may be frequent.
    """
    text = pa.array(words, pa.binary()).cast(pa.string())
    deal = np.array([zlib.crc32(w) for w in words], np.int64)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    both = (b > 0) & (c > 0)
    if frequent is None:
        k, keys = 1, (b << BITS | c)[both]
        own, n = np.unique(c[c > 0], return_counts=True)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([[""]]), pa.array([[int(n.sum())]], pa.list_(pa.int64()))], schema=STRIPES)
            yield _rows(lang, text.take(pa.array(own)), np.zeros(len(own), np.int64), own, pa.array([""] * len(own)), n)
    else:
        word = hashes(words)
        pairs, at = np.unique(ids[:-1] << BITS | ids[1:], return_inverse=True)
        block, mask = pair_bits(lang, word[pairs >> BITS], word[pairs & (1 << BITS) - 1], len(frequent))
        passes = (frequent[block] & mask == mask)[at]
        k, keys = 2, (a << 2 * BITS | b << BITS | c)[both & (a > 0) & passes[:-1] & passes[1:]]
    if not len(keys):
        return
    found, n = np.unique(keys, return_counts=True)
    last, head = found & (1 << BITS) - 1, found >> BITS
    group = head * CHUNKS[k] + deal[last] % CHUNKS[k]
    order = np.argsort(group, kind="stable")
    head, last, group = head[order], last[order], group[order]
    prefix = text.take(pa.array(head & (1 << BITS) - 1))
    if k == 2:
        prefix = pc.binary_join_element_wise(text.take(pa.array(head >> BITS)), prefix, " ")
    yield _rows(lang, prefix, group % CHUNKS[k], group, text.take(pa.array(last)), n[order])


def _stripes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The stripes of (lang, text) rows, merged over as many rows as the bounds let a task hold."""
    streams: dict[str, list[np.ndarray]] = {}
    ids = defaultdict(count().__next__, {})
    n = ids[b"."]  # 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in streams.items():
            for made in stripes_of(lang, np.concatenate(parts), list(ids), frequent):
                yield from (made.slice(k, 50_000) for k in range(0, made.num_rows, 50_000))
        streams.clear()

    for lang, text in rows(batches):
        last: list[bytes] = []
        for some in tokens((text or "").encode()):
            stream = streams.setdefault(lang, [np.zeros(2, np.int64)])
            stream.append(np.fromiter(map(ids.__getitem__, some), np.int64, len(some)))
            n, last = n + len(some), (last + some)[-2:]
            if n >= AT_ONCE or len(ids) >= WORDS:
                yield from flush()
                ids = defaultdict(count().__next__, {})
                n = ids[b"."]
                streams[lang] = [np.array([0, 0, *map(ids.__getitem__, last)], np.int64)[-2:]]
    yield from flush()


def stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", frequent: Broadcast | None = None) -> DataFrame:
    """(lang, prefix, chunk, nexts, counts): the stripes of each task, of one-word prefixes or, with a filter of frequent pairs, of
    two-word ones. Null languages are ``und``, null texts empty."""
    small_batches(docs.sparkSession)
    d = columns(docs, lang=lang_col, text=text_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    run = lambda batches: _stripes(batches, frequent.value if frequent else None)
    return d.mapInArrow(run, "lang string, prefix string, chunk int, nexts array<string>, counts array<bigint>")


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A Bloom filter of the pairs (lang, prefix, next): 128 bits a pair, of which each sets four in one block, at most
    ``MOST_BLOCKS`` blocks. With more pairs it lets more through, which costs work and changes no result."""
    n = pairs.count()
    blocks = 1 << min(MOST_BLOCKS, max(2, 2 * n)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = (hashes(b.column(c).cast(pa.binary()).to_pylist()) for c in ("prefix", "next"))
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs):
                at = langs == lang
                block, mask = pair_bits(lang, first[at], last[at], blocks)
                yield pa.RecordBatch.from_pydict({"block": block, "mask": mask.view(np.int64)})

    bits = pairs.select("lang", "prefix", "next").mapInArrow(run, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[bits["block"].to_numpy()] = bits["mask"].to_numpy().view(np.uint64)
    return out


def merged(parts: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, next, n): the elements of the merged stripes that reach ``least``, and all totals of the empty prefix.

    All parts of a stripe's chunk meet in a task and are added up by next word there, which Spark spills; a chunk has an entry
    for each task at most, whatever a phrase's share of the text.
    """
    met = parts.repartition("lang", "prefix", "chunk").select("lang", "prefix", "chunk", F.inline(F.arrays_zip("nexts", "counts")).alias("next", "n"))
    added = met.groupBy("lang", "prefix", "chunk", "next").agg(F.sum("n").alias("n"))
    return added.where((F.col("n") >= least) | (F.col("prefix") == "")).select("lang", "prefix", "next", "n")


def score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a^2 / (l r)) in whole numbers of up to 38 digits."""
    x, y, z = (f"CAST({c} AS DECIMAL(19, 0))" for c in (a, l, r))
    return F.expr(f"CAST((1000000BD * {x} * {x}) DIV ({y} * {z}) AS BIGINT)")


def _best(found: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """The first ``most`` phrases of each language: first of each of ``salts`` parts of a language, then of what these leave, so
    that a task which orders a language has ``most * salts`` rows at most."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    few = found.withColumn("_salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_salt")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, covers: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of two or three words.

    Texts are read twice. The one-word stripes come first; their elements of ``least`` or more are the frequent pairs, of which a
    bounded filter goes along to the two-word stripes, since a phrase that counts holds frequent pairs only.

    A phrase counts from ``least`` occurrences within pieces on. Its score is that of its lowest cut; a phrase of which a longer
    one makes up ``covers`` in 100 or more is dropped. From the merged stripes come the extensions (an entry is a phrase of
    its prefix and next word), the prefix totals, and the greatest entry that holds a phrase at its start (its own stripe)
    or end. A null language is ``und``, a null text empty; repeated rows count each; an empty table gives no row.
    """
    ones = materialize(merged(stripes(docs, text_col, lang_col), least), "stripes")
    total = ones.where("prefix = ''").select("lang", "n")
    word = ones.where("prefix <> '' and next = ''").select("lang", F.col("prefix").alias("word"), F.col("n").alias("f"))
    pair = ones.where("next <> ''").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("prefix").alias("first"), F.col("next").alias("last"), F.col("n").alias("a"))
    frequent = docs.sparkSession.sparkContext.broadcast(pair_filter(ones.where("next <> ''")))
    twos = materialize(merged(stripes(docs, text_col, lang_col, frequent), least), "stripes")
    left, right = word.withColumnsRenamed({"word": "first", "f": "l"}), word.withColumnsRenamed({"word": "last", "f": "r"})
    pair = materialize(pair.join(left, ["lang", "first"]).join(right, ["lang", "last"]).select("lang", "phrase", "a", "l", "r"), "pairs")
    tail = F.concat_ws(" ", F.substring_index("prefix", " ", -1), "next")
    triple = twos.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("prefix").alias("head"), tail.alias("tail"), F.col("n").alias("a"))
    covered = triple.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = pair.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < covers * F.col("a"), F.lit(True)))
    short = kept.select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"))
    head = pair.select("lang", F.col("phrase").alias("head"), F.col("a").alias("head_a"), F.col("l").alias("first_a"))
    tail = pair.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("tail_a"), F.col("r").alias("last_a"))
    both = triple.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    cut = lambda l, r, k: F.struct(score("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    long = both.select("lang", "phrase", "a", F.least(cut("first_a", "tail_a", 1), cut("head_a", "last_a", 2)).alias("cut"))
    long = long.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = _best(short.unionByName(long), most)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
