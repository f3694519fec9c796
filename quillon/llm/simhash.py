"""SimHash near-copies: fingerprints of word shingles, linked through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import batch, columns, fresh, named, rows, small_batches
from quillon.operators.graph import connected_components
from quillon.session import materialize

#: Blocks of 9 bits in each word of a wide fingerprint, and the steps around the circle of all blocks that pair them up.
WIDE_WORDS, WIDE_BITS, WIDE_STEPS = 4, 9, (1, 3, 9)
WIDE_BLOCKS = WIDE_WORDS * (64 // WIDE_BITS)
WIDE_PAIRS = [(a, (a + s) % WIDE_BLOCKS) for s in WIDE_STEPS for a in range(WIDE_BLOCKS)]
PIVOTS = 24
#: Members of a group that one task compares at once.
CELL = 8192
#: A root at most so many of 256 bits away is near enough for the one edge to it; else a node's nearest is asked, too.
SURE = 28
#: Rows that a task gathers before it compares their groups.
CHUNK = 60_000
EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("bits", pa.int32())])


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of whole ``text``, repeats included: A-Z lower-cased, words between the six ASCII
    white spaces, ``words`` of them joined by a space; fewer words are one shingle, no word none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of ``text``: a bit is 1 if set in over half the shingles' hashes; 0 without words."""
    return majority(shingle_hashes(text, words))


def mixings(h: np.ndarray) -> list[np.ndarray]:
    """The hashes mixed in ``WIDE_WORDS`` ways, for as many independent fingerprints."""
    out = []
    for k in range(WIDE_WORDS):
        mixed = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return out


def wide_fingerprint(text: str | None, words: int = 5) -> list[int]:
    """Four 64-bit SimHashes of the distinct shingles, each from its own mixing of their hashes."""
    return [majority(m) for m in mixings(np.unique(shingle_hashes(text, words)))]


def _signed(bits: int) -> int:
    return bits - (bits >> 63 << 64)


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random values, a row each, as many words as the widest fingerprint."""
    return np.array([[xxhash.xxh64_intdigest(f"pivot {k} {w}", 0) for w in range(WIDE_WORDS)] for k in range(PIVOTS)], np.uint64)


def distances(bits: list[int], refs: np.ndarray) -> bytes:
    """The Hamming distance of a fingerprint to each pivot, a byte each (255 also stands for 256)."""
    far = np.bitwise_count(np.array(bits, np.uint64) ^ refs[:, : len(bits)]).sum(axis=1)
    return np.minimum(far, 255).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, words: int = 4, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, shingle_key, far, f0) per row, or f0 to f3 for wide ones: keys of the text (as Spark's
    ``xxhash64`` of it, null as empty) and of its distinct shingles, the distances to the pivots, and the bits as signed longs."""
    small_batches(docs.sparkSession)
    names = [f"f{k}" for k in range(WIDE_WORDS if wide else 1)]
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("shingle_key", pa.int64()), ("far", pa.binary()), *[(n, pa.int64()) for n in names]])
    refs = pivots()

    def one(i: int | None, text: str | None) -> tuple:
        h = shingle_hashes(text, words)
        own = np.unique(h) if wide else h
        bits = [majority(m) for m in mixings(own)] if wide else [majority(own)]
        keys = xxhash.xxh64_intdigest((text or "").encode(), 42), xxhash.xxh64_intdigest(own.tobytes(), 42) if wide else 0
        return i, *map(_signed, keys), distances(bits, refs), *map(_signed, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [one(i, t) for i, t in rows([b])])

    ddl = ", ".join(["doc_id long, text_key long, shingle_key long, far binary", *[f"{n} long" for n in names]])
    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, ddl)


def widths(n: int) -> tuple[tuple[int, ...], int]:
    """(widths of the blocks that 64 bits are cut into, blocks in a key) for ``n`` fingerprints of which those at most 4 bits
    apart must share a key: all but four of six, seven or eight blocks, so that keys of 21, 27 or 32 bits keep chance meetings few."""
    blocks = 6 if n <= 1 << 21 else 7 if n <= 1 << 27 else 8
    return tuple(64 // blocks + (k < 64 % blocks) for k in range(blocks)), blocks - 4


def _keys(fp: Column, n: int) -> Column:
    """An array of longs: for each choice of blocks, its number and a hash of their bits."""
    cut, size = widths(n)
    edges = np.cumsum((0, *cut)).tolist()
    part = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for k, w in enumerate(cut)]

    def key(number: int, chosen: tuple[int, ...]) -> Column:
        out, at = F.shiftleft(F.lit(number).cast("long"), 48), 0
        for k in chosen:
            out, at = out.bitwiseOR(F.shiftleft(part[k], at)), at + cut[k]
        return out

    return F.array(*[key(k, chosen) for k, chosen in enumerate(combinations(range(len(cut)), size))])


def _wide_keys(words: list[str]) -> Column:
    """Keys of two 9-bit blocks each, for blocks some steps apart on the circle of all blocks."""
    mask = F.lit((1 << WIDE_BITS) - 1).cast("long")
    blocks = [F.shiftrightunsigned(F.col(w), WIDE_BITS * k).bitwiseAND(mask) for w in words for k in range(64 // WIDE_BITS)]
    return F.array(*[
        F.shiftleft(F.lit(n).cast("long"), 48).bitwiseOR(F.shiftleft(blocks[a], WIDE_BITS)).bitwiseOR(blocks[b]) for n, (a, b) in enumerate(WIDE_PAIRS)
    ])


class Table:
    """Fingerprints (a column for each 64 bits) with their distances to the pivots (a column for each pivot)."""

    def __init__(self, fps: list[np.ndarray], far: np.ndarray) -> None:
        self.fps, self.far = fps, far.astype(np.int16)

    def bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the pairs differ."""
        return sum(np.bitwise_count(f[i] ^ f[j]).astype(np.int16) for f in self.fps)

    def met_before(self, i: np.ndarray, j: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the pairs (of wide fingerprints) share a key of a smaller number than ``number``, too."""
        apart = [f[i] ^ f[j] for f in self.fps]
        same = [(x >> np.uint64(WIDE_BITS * k)) & np.uint64((1 << WIDE_BITS) - 1) == 0 for x in apart for k in range(64 // WIDE_BITS)]
        out = np.zeros(len(i), bool)
        for n, (a, b) in enumerate(WIDE_PAIRS[: int(number.max(initial=0))]):
            out |= same[a] & same[b] & (n < number)
        return out

    def linked(self, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the index pairs, those at most ``most`` bits apart, with that number. A pair whose distances to any pivot differ
        by more is discarded on the table alone; only survivors are verified."""
        for d in self.far:
            if not len(i):
                break
            near = np.abs(d[i] - d[j]) <= most
            i, j = i[near], j[near]
        apart = self.bits(i, j)
        near = apart <= most
        return i[near], j[near], apart[near]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j in ``label`` (index -> smallest index of its class), in place."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def _pairs(group: np.ndarray, side: np.ndarray, table: Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits) of all linked pairs under one of the groups (sorted), some at a time. In a group with both sides only
    pairs across are compared."""
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 64, sizes)
    for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
        yield table.linked(i, i + step, most)
    for at, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        one = np.arange(at, at + size)
        left, right = (one, one) if not side[at : at + size].any() else (one[side[one] == 0], one[side[one] == 1])
        left, right = left[np.argsort(table.far[0][left], kind="stable")], right[np.argsort(table.far[0][right], kind="stable")]
        far = table.far[0][right]
        for k in range(0, len(left), 128):
            some = left[k : k + 128]
            near = right[np.searchsorted(far, table.far[0][some[0]] - most) : np.searchsorted(far, table.far[0][some[-1]] + most, "right")]
            i, j = np.repeat(some, len(near)), np.tile(near, len(some))
            other = i != j
            yield table.linked(i[other], j[other], most)


def _forest(nodes: np.ndarray, group: np.ndarray, side: np.ndarray, table: Table, most: int) -> pa.RecordBatch:
    """Edges (smaller node, larger node, bits) over the groups' links: each node to the smallest of its class."""
    names, node = np.unique(nodes, return_inverse=True)
    row_of = np.zeros(len(names), np.int64)
    row_of[node] = np.arange(len(node))
    label = np.arange(len(names))
    for i, j, _ in _pairs(group, side, table, most):
        merge(label, node[i], node[j])
    dst = np.flatnonzero(label != np.arange(len(names)))
    src = label[dst]
    return _edges(names[src], names[dst], table.bits(row_of[src], row_of[dst]) if len(src) else dst)


def _near_forest(nodes: np.ndarray, group: np.ndarray, side: np.ndarray, table: Table, most: int, sure: int, number: np.ndarray) -> pa.RecordBatch:
    """Edges (smaller node, larger node, bits) over the links of each group (rows by group and node; ``number``: that of its
    key): each node to the smallest of its class, and where that one is over ``sure`` bits away, and of each smallest one, also
    to the one that fewest bits tell it from (ties: the smallest).

    A linked pair that shares a key of a smaller number is left to that key's group, which compares it as well. Step by step
    down to the first key two nodes share, the edges of all groups together connect what each group alone would, and give each
    node an edge to its nearest, or to one within ``sure``. So edges follow the nodes, not the keys that two nodes share.
    """
    own = np.arange(len(nodes))
    label, best = own.copy(), np.full(len(nodes), np.iinfo(np.int64).max)
    for i, j, bits in _pairs(group, side, table, most):
        merge(label, i, j)
        np.minimum.at(best, i, (bits.astype(np.int64) << 40) + j)
        np.minimum.at(best, j, (bits.astype(np.int64) << 40) + i)
    dst = np.flatnonzero(label != own)
    rooted = (label != own) & (table.bits(label, own) <= sure) if len(own) else label != own
    at = np.flatnonzero((best < np.iinfo(np.int64).max) & ~rooted)
    other = best[at] & ((1 << 40) - 1)
    src, dst = np.r_[label[dst], np.minimum(at, other)], np.r_[dst, np.maximum(at, other)]
    if not len(src):
        return _edges(src, dst, dst)
    bits = table.bits(src, dst)
    kept = np.flatnonzero((bits > most) | ~table.met_before(src, dst, number[dst]))
    src, dst, bits = nodes[src[kept]], nodes[dst[kept]], bits[kept]
    once = np.unique(np.stack([src, dst]), axis=1, return_index=True)[1]
    return _edges(src[once], dst[once], bits[once])


def _edges(src: np.ndarray, dst: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(bits.astype(np.int32))], schema=EDGES)


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst, bits) edges between rows of ``nodes`` (node, far, f0; each once) that connect exactly those whose
    fingerprints are linked, directly or through others, by differing in at most ``most`` (at most 4) bits.

    Nodes meet under the choices of bit blocks, one of which any linked pair shares; these only deal the work out.
    """
    if not 0 <= most <= 4:
        raise ValueError("the blocks guarantee all links only up to 4 differing bits")
    return compared(nodes, ["f0"], _keys(F.col("f0"), nodes.count()), most)


def wide_links(nodes: DataFrame, most: int = 56) -> DataFrame:
    """(src, dst, bits) edges between ``nodes`` (node, far, f0 to f3) that differ in at most ``most`` of the 256 bits and share
    one of 84 pairs of 9-bit blocks, and of each such node far from its root to its nearest. At a similarity of 0.8, 39 bits differ on
    average with a deviation of 6; by the binomial 99 in 100 such pairs share a key and more lie within 56 bits.
    """
    words = [f"f{k}" for k in range(WIDE_WORDS)]
    return compared(nodes, words, _wide_keys(words), most, sure=SURE)


def crowded(keyed: DataFrame, nodes: int) -> DataFrame:
    """(key, n) of the keys with over ``CELL`` rows in ``keyed`` (key; some 15 to 84 rows for each of ``nodes``).

    Buckets of keys are counted first, so many that few hold over ``CELL`` rows without such a key, then the keys of those one
    by one; both are summed where rows are read, so no key gathers its rows in a task and little is shuffled.
    """
    bucketed = keyed.select("key", F.pmod(F.xxhash64("key"), F.lit(max(1 << 16, nodes // 16))).alias("bucket"))
    full = materialize(bucketed.groupBy("bucket").count().where(F.col("count") > CELL).select("bucket"), "simhash-full")
    counts = bucketed.join(full, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    return materialize(counts.where(F.col("n") > CELL), "simhash-hot")


def compared(nodes: DataFrame, words: list[str], keys: Column, most: int, sure: int | None = None) -> DataFrame:
    """Edges that connect the nodes under a common key whose fingerprints, over ``words``, differ in at most ``most`` bits.

    Within a group, pairs are discarded by their distances to the pivots and survivors verified, where the rows have been
    dealt by key. A group over ``CELL`` members is dealt over square cells of a salt, never by its key, so no task gets more
    than two cells' worth of a group; each task returns a forest of the links of some groups at a time, not the pairs: ``_forest``, or
    with ``sure``, for wide fingerprints and their keys, ``_near_forest``.
    """
    small_batches(nodes.sparkSession)
    keyed = nodes.select("node", "far", *words, F.explode(keys).alias("key"))
    hot = crowded(nodes.select(F.explode(keys).alias("key")), nodes.count())
    met = keyed.join(hot, "key", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    zero = [F.lit(0).alias(c) for c in ("row", "col", "side")]
    few = met.select("node", "far", *words, "key", *zero).sortWithinPartitions("key", "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    many = keyed.join(hot, "key").withColumn("parts", F.ceil(F.col("n") / CELL).cast("int")).withColumn("own", own)
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = many.select(
        "node", "far", *words, "key", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), (F.col("own") > F.col("other")).cast("int").alias("side")
    ).repartition("key", "row", "col").sortWithinPartitions("key", "row", "col", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(parts: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
            t = pa.Table.from_batches(parts)
            key, row, col = (t.column(c).to_numpy() for c in ("key", "row", "col"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])) + 1
            cut = t.num_rows if last else int(change[-1]) if len(change) else 0
            if not cut:
                return None, parts
            group = np.zeros(cut, np.int64)
            group[change[change < cut]] = 1
            far = np.frombuffer(b"".join(t.column("far").slice(0, cut).to_pylist()), np.uint8).reshape(cut, -1).T
            table = Table([t.column(w).to_numpy()[:cut].view(np.uint64) for w in words], far)
            what = t.column("node").to_numpy()[:cut], np.cumsum(group), t.column("side").to_numpy()[:cut], table, most
            edges = _forest(*what) if sure is None else _near_forest(*what, sure, key[:cut] >> 48)
            return edges, t.slice(cut).combine_chunks().to_batches()

        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= CHUNK:
                edges, held = solved(held, False)
                count = sum(x.num_rows for x in held)
                if edges is not None:
                    yield edges
        if held:
            edges, _ = solved(held, True)
            if edges is not None:
                yield edges

    edges = [part.mapInArrow(run, "src long, dst long, bits int") for part in (few, cells)]
    return edges[0].unionByName(edges[1])


def thinned(edges: DataFrame) -> DataFrame:
    """(src, dst) with the same components as ``edges`` (src < dst): each node keeps its smallest neighbour below it, to which
    its other ones are linked instead; since those are few, far fewer distinct edges are left."""
    least = edges.groupBy("dst").agg(F.min("src").alias("least"))
    others = edges.join(least, "dst").select(F.col("least").alias("src"), F.col("src").alias("dst")).where("src < dst")
    return least.select(F.col("least").alias("src"), "dst").unionByName(others).distinct()


def components(docs: DataFrame, words: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, component_id) per row: component_id is the smallest doc_id reachable over links, its own included.

    Rows without words share fingerprint 0 and are linked like any other; a row with a null doc_id gets a null
    component_id and links nothing; repeated rows keep one row each; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, words, False, id_col, text_col), "simhash")
    nodes = materialize(fps.where("doc_id is not null").groupBy("f0").agg(F.min("doc_id").alias("node"), F.min("far").alias("far")), "simhash-nodes")
    found = connected_components(materialize(thinned(materialize(links(nodes, most).select("src", "dst"), "simhash-links")), "simhash-forest"))
    of = nodes.join(found, "node", "left").select("f0", F.coalesce("component", "node").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return fps.join(of, "f0", "left").select("doc_id", "f0", own)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row, by 4-word shingles and 4 bits."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def alike(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (src, dst) of which the Jaccard similarity of the distinct ``shingles`` (node, h) is at least ``least``."""
    a, b = (shingles.select(F.col("node").alias(c), F.col("h").alias(f"h_{c}")) for c in ("src", "dst"))
    both = pairs.join(a, "src").join(b, "dst").select("src", "dst", F.size(F.array_intersect("h_src", "h_dst")).alias("n"), (F.size("h_src") + F.size("h_dst")).alias("all"))
    return both.where(F.col("n") >= F.lit(least) * (F.col("all") - F.col("n"))).select("src", "dst")


def _shingles(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, h): the distinct shingles of the ``wanted`` nodes (node, doc_id, text_key), one row each."""
    schema = pa.schema([("node", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [(node, np.unique(shingle_hashes(t, words)).view(np.int64)) for node, t in rows([b])])

    texts = columns(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = texts.join(wanted, ["doc_id", "text_key"]).select("node", "text").mapInArrow(run, "node long, h array<long>")
    return materialize(found.dropDuplicates(["node"]), "near-shingles")


def alike_classes(docs: DataFrame, words: int = 5, least: float = 0.8, most: int = 56, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows' keys (doc_id, text_key, class columns) and the nodes (class columns, doc_id and text_key of the first row,
    component): components over links whose ends SimHash finds near and whose shingles are verified to be at least
    ``least`` alike (Jaccard).

    Rows of the same shingles are one node; rows without words are one, too. Links come from ``wide_links``. Two of each
    node are verified first: to the root of what SimHash alone links, and to its nearest. Then every link of a node that
    did not join its root is verified, unless its ends have met already. Rows with a null doc_id are left out.
    """
    by = [*[f"f{k}" for k in range(WIDE_WORDS)], "shingle_key"]
    fps = materialize(fingerprints(docs, words, True, id_col, text_col).where("doc_id is not null"), "near-simhash")
    first = fps.groupBy(*by).agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.min("far").alias("far"))
    nodes = materialize(first.select(F.monotonically_increasing_id().alias("node"), *by, "far", "of.doc_id", "of.text_key"), "near-nodes")
    found = materialize(wide_links(nodes, most).groupBy("src", "dst").agg(F.min("bits").alias("bits")), "near-links")
    roots = materialize(connected_components(materialize(thinned(found), "near-forest")), "near-roots")
    shingles = _shingles(docs, nodes.join(roots, "node", "left_semi").select("node", "doc_id", "text_key"), words, id_col, text_col)
    ends = [found.select(F.col(a).alias("node"), F.struct("bits", F.col(b).alias("other")).alias("near")) for a, b in (("src", "dst"), ("dst", "src"))]
    nearest = ends[0].unionByName(ends[1]).groupBy("node").agg(F.min("near")["other"].alias("other"))
    asked = roots.where("node <> component").select("node", F.col("component").alias("other")).unionByName(nearest)
    asked = materialize(asked.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct(), "near-first")
    good = materialize(alike(asked, shingles, least), "near-alike")
    met = materialize(connected_components(good), "near-met")
    label = roots.join(met.withColumnRenamed("component", "met"), "node", "left").select("node", "component", F.coalesce("met", "node").alias("met"))
    label = materialize(label, "near-labels")
    of_root = label.where("node = component").select("component", F.col("met").alias("met_root"))
    loose = materialize(label.join(of_root, "component").where("met <> met_root").select("node"), "near-loose")
    rest = [found.join(loose.select(F.col("node").alias(c)), c, "left_semi").select("src", "dst") for c in ("src", "dst")]
    rest = rest[0].unionByName(rest[1]).distinct().join(asked, ["src", "dst"], "left_anti")
    for c in ("src", "dst"):
        rest = rest.join(label.select(F.col("node").alias(c), F.col("met").alias(f"met_{c}")), c)
    rest = materialize(rest.where("met_src <> met_dst").select("src", "dst"), "near-rest")
    if not rest.isEmpty():
        met = connected_components(materialize(good.unionByName(alike(rest, shingles, least)), "near-alike"))
    return fps, nodes.join(met, "node", "left").select(*by, "doc_id", "text_key", F.coalesce("component", "node").alias("component"))


def alike_components(docs: DataFrame, words: int = 5, least: float = 0.8, most: int = 56, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) per row with a doc_id: the smallest doc_id of its component (see ``alike_classes``)."""
    fps, nodes = alike_classes(docs, words, least, most, id_col, text_col)
    nodes = materialize(nodes, "near-classes")
    of = nodes.join(nodes.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component")
    return fps.join(of.drop("doc_id", "text_key"), [c for c in nodes.columns[:-3]]).select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, least: float = 0.8, most: int = 56) -> DataFrame:
    """Of each group of near copies one row, that of the smallest doc_id (then of the least hash of the text), with all columns.

    Near copies are verified to be ``least`` alike in shingles of five words, directly or through others. Rows with a null
    doc_id stay. Unlike texts under one doc_id both stay; of rows equal in doc_id and text the first by its other columns
    as JSON stays. Rows without words are copies of each other. An empty table stays empty.
    """
    _, nodes = alike_classes(docs, words, least, most)
    key, kept_id, kept_key, place = (fresh(docs, c) for c in ("text_key", "kept_id", "kept_key", "place"))
    best = nodes.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("of"))
    kept = materialize(best.select(F.col("of.doc_id").alias(kept_id), F.col("of.text_key").alias(kept_key)), "near-kept")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    both = keyed.join(kept, (keyed["doc_id"] == kept[kept_id]) & (keyed[key] == kept[kept_key]))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy(kept_id, kept_key).orderBy(F.to_json(F.struct(*[named(docs, c) for c in others])) if others else F.lit(0))
    first = both.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return first.select(*[named(first, c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
