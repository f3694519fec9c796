"""Packing of tokenised documents into fixed windows: best-fit decreasing over a segment tree of open windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillon.llm._batches import batch, columns, rows, small_batches

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity; a segment tree of counts over the capacities finds the tightest that fits."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, capacity: int, bin_no: int) -> None:
        self.bins[capacity].append(bin_no)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of least capacity that is at least ``need``, removed; None if none is open."""
        count, k = self.count, need + self.leaves
        while not count[k]:
            while k & 1:  # a right child: its subtree ends here, go on above
                k >>= 1
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:  # wrapped to the next level: nothing to the right
                return None
        while k < self.leaves:
            k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def plan(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token once.

    Overlong documents are first cut into full windows. What remains of each goes, longest first, into the open
    window with the least sufficient room. Then the emptiest windows are dissolved: their pieces are cut to fill the
    gaps of the fuller ones, until one window with a gap remains; that one is cut into sequences whose lengths are
    powers of two, which need no padding.
    """
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        full += [[(d, s, window)] for s in range(0, n - window + 1, window)]
        if n % window:
            rest.append((n % window, d, n - n % window))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins, used = OpenWindows(window), [], []
    for n, d, s in rest:
        got = tree.take(n)
        if got is None:
            got = window, len(bins)
            bins.append([])
            used.append(0)
        capacity, b = got
        bins[b].append((d, s, n))
        used[b] += n
        if capacity > n:
            tree.put(capacity - n, b)
    order = sorted((b for b in range(len(bins)) if used[b] < window), key=lambda b: (used[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        donor, to = bins[order[lo]], order[hi]
        gap = window - used[to]
        while gap and donor:
            d, s, n = donor.pop()
            k = min(n, gap)
            bins[to].append((d, s + n - k, k))
            if n > k:
                donor.append((d, s, n - k))
            gap -= k
        used[to] = window - gap
        used[order[lo]] = sum(n for _, _, n in donor)
        lo += not donor
        hi -= not gap
    out = full + [bins[b] for b in range(len(bins)) if used[b] == window]
    left = [p for b in range(len(bins)) if 0 < used[b] < window for p in bins[b]]
    total = sum(n for _, _, n in left)
    for k in range(total.bit_length() - 1, -1, -1):
        if total >> k & 1:
            sequence, need = [], 1 << k
            while need:
                d, s, n = left.pop()
                take = min(n, need)
                sequence.append((d, s, take))
                if n > take:
                    left.append((d, s + take, n - take))
                need -= take
            out.append(sequence)
    return out


def encoder(tokenizer_json: str, ranks: str | None, pattern: str | None):
    """text -> token ids of the tokenizer file, without added special tokens.

    With ``ranks`` (the same vocabulary as merge ranks) and its split ``pattern``, texts are encoded through the ranks,
    which is several times faster; a text that holds the string of a special token goes through the tokenizer itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_json)
    if not ranks:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return lambda text: slow.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast(text)


def pack(
    docs: DataFrame, tokenizer_json: str, ranks: str | None = None, pattern: str | None = None, window: int = 2048,
    end_id: int = 1, shard_tokens: int = 8_000_000, shard_docs: int = 200_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document (a null text is empty) becomes its token ids and ``end_id``. Documents are packed where they are
    read, without a shuffle, in runs of at most about ``shard_tokens`` tokens and ``shard_docs`` documents, so a task's memory is bounded whatever
    the partition size; a run leaves no padding (see ``plan``). sequence_id is unique over the table: the partition's
    number in the high half. Repeated rows are packed as often as they occur, a null doc_id stays null, an empty
    table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = None, TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            out = []
            for pieces in plan([len(t) for t in tokens], window):
                offset = 0
                for d, s, n in pieces:
                    out.append((ids[d], s, n, zlib.crc32(tokens[d][s : s + n].tobytes()), len(tokens[d]), sequence, offset))
                    offset += n
                sequence += 1
                if len(out) >= 20_000:
                    yield batch(SCHEMA, out)
                    out = []
            yield batch(SCHEMA, out)
            ids.clear()
            tokens.clear()
            held = 0

        for doc_id, text in rows(batches):
            encode = encode or encoder(tokenizer_json, ranks, pattern)
            ids.append(doc_id)
            tokens.append(np.array([*encode(text or ""), end_id], "<u4"))
            held += len(tokens[-1])
            if held >= shard_tokens or len(ids) >= shard_docs:
                yield from flush()
        if ids:
            yield from flush()

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, DDL)
