"""Quality by co-training: a text view and a metadata view teach each other, then score every document together."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._batches import batch, columns, rows, small_batches
from quillon.llm.mixing import draw
from quillon.session import materialize

WORD_BUCKETS = 256
SOURCE_BUCKETS, LANG_BUCKETS, LENGTH_STEPS = 64, 32, 24
META_SIZE = SOURCE_BUCKETS + LANG_BUCKETS + LENGTH_STEPS
#: Partial sums that one task adds up, or the driver at the end.
SUMS_AT_ONCE = 8
PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


class TextView:
    """Features of whole texts: hashed words, shares of character classes and of each ASCII mark, repetition and length."""

    size = WORD_BUCKETS + len(PUNCTUATION) + 9

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, text: str | None, *_: object) -> np.ndarray:
        text = text or ""
        words = text.lower().split()
        if len(self.seen) > 400_000:
            self.seen.clear()
        seen = self.seen
        at = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            v = seen.get(w)
            if v is None:
                v = seen[w] = zlib.crc32(w.encode()) % WORD_BUCKETS
            at[k] = v
        n = max(1, len(words))
        share = np.sqrt(np.bincount(at, minlength=WORD_BUCKETS) / n)
        raw = np.frombuffer(text.encode(), np.uint8)
        marks = np.bincount(raw, minlength=256) / max(1, len(raw))
        shape = [
            marks[65:91].sum(), marks[97:123].sum(), marks[48:58].sum(), marks[32], marks[10], marks[128:].sum(),
            len(set(words)) / n, math.log1p(len(words)) / 10, (at[1:] == at[:-1]).sum() / n,
        ]
        return np.concatenate([share, np.sqrt(marks[PUNCTUATION]), shape]).astype(np.float32)


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """A page's metadata as three places of a one-hot vector: hashed source and language, and the length in powers of two."""
    return [
        zlib.crc32((source or "").encode()) % SOURCE_BUCKETS, SOURCE_BUCKETS + zlib.crc32((lang or "").encode()) % LANG_BUCKETS,
        SOURCE_BUCKETS + LANG_BUCKETS + min(LENGTH_STEPS - 1, max(0, n_chars or 0).bit_length()),
    ]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """A linear function of features."""

    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def moments(x: np.ndarray) -> np.ndarray:
    """The sums of products of the features and a constant, all that ``ridge`` needs of a class; they add up over rows."""
    one = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    return one.T @ one


def ridge(good: np.ndarray, bad: np.ndarray, l2: float = 0.01) -> Linear:
    """Least squares of the label (1 or 0) from the moments of both classes."""
    every = good + bad
    n = every[-1, -1]
    mean, share = every[:-1, -1] / n, good[-1, -1] / n
    spread = every[:-1, :-1] / n - np.outer(mean, mean)
    weights = np.linalg.solve(spread + np.diag(l2 * np.diag(spread) + 1e-6), good[:-1, -1] / n - mean * share)
    return Linear(weights, float(share - mean @ weights))


def calibrated(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> Linear:
    """A logistic regression on a few scores (columns of ``x``) by Newton's method, scores standardised."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = sigmoid(z @ w)
        w = w - np.linalg.solve((z.T * (p * (1 - p))) @ z / len(y) + penalty, z.T @ (p - y) / len(y) + penalty @ w)
    return Linear(w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ mean))


@dataclass
class Model:
    """The two views, each with its calibration, and their combination."""

    text: Linear
    meta: Linear
    text_scale: Linear
    meta_scale: Linear
    both: Linear

    def logits(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The calibrated logits of both views, a row per document."""
        return np.stack([self.text_scale(self.text(text)[:, None]), self.meta_scale(self.meta(meta)[:, None])], axis=1)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(text, metadata, combined) calibrated probabilities, a row per document."""
        two = self.logits(text, meta)
        return np.concatenate([sigmoid(two), sigmoid(self.both(two))[:, None]], axis=1)


def fitted(text: list[np.ndarray], meta: list[np.ndarray], hold: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
    """The model of both views' moments (of good, of bad rows), calibrated on the rows held out (text, meta, label)."""
    a, b = ridge(*text), ridge(*meta)
    xa, xb, y = a(hold[0])[:, None], b(hold[1])[:, None], hold[2]
    scale_a, scale_b = calibrated(xa, y), calibrated(xb, y)
    return Model(a, b, scale_a, scale_b, calibrated(np.stack([scale_a(xa), scale_b(xb)], axis=1), y))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m) per row of ``docs`` (doc_id, text, source, lang, n_chars): the text features in half precision and
    the metadata's places; made once."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.binary()), ("m", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for b in batches:
            yield batch(schema, [(i, view(t).astype(np.float16).tobytes(), metadata(*rest)) for i, t, *rest in rows([b])])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, t binary, m array<int>")


def unpacked(t: list[bytes], m: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The feature matrices of both views."""
    text = np.frombuffer(b"".join(t), np.float16).reshape(len(t), TextView.size).astype(np.float32)
    meta = np.zeros((len(m), META_SIZE), np.float32)
    if m:
        meta[np.arange(len(m))[:, None], np.array(m)] = 1
    return text, meta


def pseudo_moments(pool: DataFrame, model: Model, confident: float) -> list[np.ndarray]:
    """The moments of good and bad rows for the text view, then for the metadata view, over all rows of ``pool``: each view's
    rows are those of which the other view is at least ``confident``. Sums are made where the rows are, then added up in
    a tree of tasks, so the driver gets at most ``SUMS_AT_ONCE`` of them.
    """
    spark = pool.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sizes = [TextView.size + 1] * 2 + [META_SIZE + 1] * 2
    schema = pa.schema([("part", pa.int64()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, k)) for k in sizes]
        for b in batches:
            if not b.num_rows:
                continue
            text, meta = unpacked(b.column("t").to_pylist(), b.column("m").to_pylist())
            p = sigmoid(shared.value.logits(text, meta))
            for k, (x, other) in enumerate(((text, p[:, 1]), (text, 1 - p[:, 1]), (meta, p[:, 0]), (meta, 1 - p[:, 0]))):
                sums[k] += moments(x[other >= confident])
        yield batch(schema, [(TaskContext.get().partitionId(), np.concatenate([x.ravel() for x in sums]).tobytes())])

    def add(t: pa.Table) -> pa.Table:
        raw = t.column("sums").to_pylist()
        total = np.frombuffer(raw[0]).copy()
        for x in raw[1:]:
            total += np.frombuffer(x)
        return pa.Table.from_batches([batch(schema, [(t.column("part")[0].as_py() // SUMS_AT_ONCE, total.tobytes())])])

    now = materialize(pool.select("t", "m").mapInArrow(run, "part long, sums binary"), "cotrain-sums")
    while now.count() > SUMS_AT_ONCE:
        now = materialize(now.groupBy(F.floor(F.col("part") / SUMS_AT_ONCE)).applyInArrow(add, "part long, sums binary"), "cotrain-sums")
    got = [np.frombuffer(x) for x in now.toArrow().column("sums").to_pylist()]
    total = np.sum(got, axis=0) if got else np.zeros(sum(k * k for k in sizes))
    ends = np.cumsum([k * k for k in sizes])
    return [total[e - k * k : e].reshape(k, k) for e, k in zip(ends, sizes, strict=True)]


def joined(labelled: list[np.ndarray], pseudo: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of a view's labelled rows and its pseudo-labelled ones; these weigh as much as the labelled rows in all and
    have the same share of good ones, however many there are."""
    return [x + y * (x[-1, -1] / y[-1, -1]) if y[-1, -1] else x for x, y in zip(labelled, pseudo, strict=True)]


def dealt(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows teach and which calibrate: of each label every fifth row (of fewer than five the last) calibrates, the others
    teach; the only row of a label does both."""
    held = np.zeros(len(y), bool)
    lone = np.zeros(len(y), bool)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        held[at[min(4, len(at) - 1) :: 5]] = True
        lone[at] = len(at) == 1
    return ~held | lone, held


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: DataFrame, rounds: int = 3, confident: float = 0.9) -> Model:
    """Every fifth row of a label calibrates, the others teach (see ``dealt``). In each round each view labels all rows of ``pool`` of which it
    is sure (a calibrated probability of at least ``confident`` either way) for the other view, which is fitted to these
    and the labelled rows; labels are given anew each round. A regression on both calibrated logits combines the views.
    """
    teach, hold = dealt(y)
    taught = [[moments(x[teach & (y == c)]) for c in (1, 0)] for x in (text, meta)]
    held = text[hold], meta[hold], y[hold]
    model = fitted(*taught, held)
    for _ in range(rounds):
        pseudo = pseudo_moments(pool, model, confident)
        model = fitted(joined(taught[0], pseudo[:2]), joined(taught[1], pseudo[2:]), held)
    return model


def train(made: DataFrame, labels: DataFrame, max_labelled: int = 12_000, label_col: str = "quality", rounds: int = 3, confident: float = 0.9) -> Model | None:
    """Learns from rows of ``features``: from a sample by id hash of at most about ``max_labelled`` labelled ids (0 or 1; an id
    labelled both ways counts as 1), the stated bound of what the driver holds (about 1.7 kB each), and from all other
    rows as unlabelled ones. Of an id's rows the one of the least features teaches. None without both labels.
    """
    given = labels.select(labels["doc_id"].alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    given = given.groupBy("doc_id").agg(F.max("label").alias("label"))
    part = materialize(given.where(draw(F.col("doc_id"), 1) < min(1.0, max_labelled / max(1, given.count()))), "cotrain-labels")
    one = made.join(F.broadcast(part), "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "m", "label")).alias("x"))
    got = one.toArrow().sort_by("doc_id")
    x = got.column("x").to_pylist()
    y = np.array([r["label"] for r in x], float)
    if len(np.unique(y)) < 2:
        return None
    text, meta = unpacked([r["t"] for r in x], [r["m"] for r in x])
    return cotrain(text, meta, y, made.join(F.broadcast(part.select("doc_id")), "doc_id", "left_anti"), rounds, confident)


def score(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, max_labelled: int = 12_000, rounds: int = 3, confident: float = 0.9) -> DataFrame:
    """Per row: doc_id, text_score, meta_score, quality_score (0 to 1) and keep, whether quality_score is at least ``keep_from``.

    A null text is empty and null metadata a value of its own. Without labels of both kinds nothing is known: scores are
    null and every row is kept. Repeated rows are scored each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    d = columns(docs, doc_id="doc_id", text="text", source="source", lang="lang", n_chars="n_chars")
    made = materialize(features(d), "cotrain-features")
    model = train(made, labels, max_labelled, rounds=rounds, confident=confident)
    names = ("text_score", "meta_score", "quality_score")
    if model is None:
        return made.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in names], F.lit(True).alias("keep"))
    shared = d.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.float64()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.scores(*unpacked(b.column("t").to_pylist(), b.column("m").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(got[:, k]) for k in range(3)]], schema=schema)

    out = made.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} double" for c in names]]))
    return out.withColumn("keep", F.col("quality_score") >= keep_from)
