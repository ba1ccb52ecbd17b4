"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits, and their components.

Candidates come from a grid over the segment-popcount embedding. A fingerprint's 64 bits are cut into 32 segments of
two bits, and its embedding is the number of set bits of each: the Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints. The segments form eight groups. If the Manhattan distance is at most four,
at least four groups agree in every count, so the pair meets in the grid cell of some four of the eight groups. In a cell
the Manhattan bound is applied first, then the exact bit distance.

No pairs leave a cell: only edges that span its linked fingerprints do. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import join_counted, stored

SHINGLE = 4
MAX_BITS = 4
HASH_SEED = 42
GROUPS = 8
#: Fingerprints of one cell that a task compares by itself; larger cells are dealt out in pairs of such blocks.
BLOCK = 2048
EVEN = np.uint64(0x5555555555555555)
BYTE_LOWS = np.uint64(0x0101010101010101)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text: ASCII letters lowered, words between ASCII white space, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in spans), np.uint64, n)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (the fingerprint as a long) of every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", shingle) for t in batch.column("text")]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"),
                "fp": pa.array(np.array(found, np.uint64).view(np.int64), pa.int64()),
            })

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """The 32 segment counts, two bits each, packed in one word."""
    return (fps & EVEN) + ((fps >> np.uint64(1)) & EVEN)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed embeddings: |a - b| of each two-bit count, summed."""
    total = np.zeros(len(a), np.int64)
    for segment in range(0, 64, 2):
        x = (a >> np.uint64(segment)).astype(np.int8) & 3
        total += np.abs(x - ((b >> np.uint64(segment)).astype(np.int8) & 3))
    return total


def _cells(max_bits: int) -> list[tuple[int, ...]]:
    """The sets of groups that make a cell; pairs within max_bits agree in all groups of one of them."""
    if not 0 <= max_bits < GROUPS:
        raise ValueError(f"max_bits must be below {GROUPS}")
    return list(combinations(range(GROUPS), GROUPS - max_bits))


def grid(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(cell, fp): each fingerprint in the cells of its embedding."""
    cells = _cells(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            packed = embed(fps)
            for number, groups in enumerate(cells):
                keep = np.uint64(sum(255 << 8 * g for g in groups))
                mixed = (packed & keep) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1)
                yield pa.record_batch({"cell": pa.array(mixed.view(np.int64)), "fp": batch.column("fp")})

    return nodes.select("fp").mapInArrow(run, "cell long, fp long")


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are links: the embedding's bound first, then the bits of the fingerprints."""
    near = np.flatnonzero(np.bitwise_count(embed(a) ^ embed(b)) <= 2 * max_bits)  # a count that differs, differs in a bit or two
    near = near[_manhattan(embed(a[near]), embed(b[near])) <= max_bits]
    return near[np.bitwise_count(a[near] ^ b[near]) <= max_bits]


def _spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every fingerprint to the smallest of its local component."""
    if not len(a):
        return a, b
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = ends[: len(a)], ends[len(a):], np.arange(len(names))
    while True:
        low, was = np.minimum(root[left], root[right]), root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == was).all():
            break
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


class _Links:
    """Links found so far, cut back to spanning edges whenever they grow."""

    def __init__(self) -> None:
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > 1 << 20:
            self.spanned()

    def spanned(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, np.uint64)]
        a, b = _spanned(np.concatenate(none + self.a), np.concatenate(none + self.b))
        self.a, self.b, self.n = [a], [b], 0
        return a, b


def _compare(cells: np.ndarray, fps: np.ndarray, links: _Links, max_bits: int) -> None:
    """All pairs inside runs of equal cells, by their distance in the sorted order."""
    at = np.arange(len(cells))
    for lag in range(1, len(cells)):
        at = at[at < len(cells) - lag]
        at = at[cells[at] == cells[at + lag]]
        if not len(at):
            return
        found = at[_linked(fps[at], fps[at + lag], max_bits)]
        links.add(fps[found], fps[found + lag])


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64()), ("block", pa.int32())])


def _edges(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Edges from rows in order of cell. A cell of over BLOCK rows is passed on in blocks (fp, cell, block) instead."""
    found, cells, fps = _Links(), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begun, block = None, 0  # the cell that is being passed on, and its blocks so far

    def take(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal cells, fps, begun, block
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(cells)]]))
        ended = np.arange(len(sizes)) < len(sizes) - (not last)
        large = (sizes > BLOCK) | (cells[starts] == begun if begun is not None else False)
        plain = np.repeat(ended & ~large, sizes)
        _compare(cells[plain], fps[plain], found, max_bits)
        left = starts[-1] if not last else len(cells)
        for run in np.flatnonzero(large):
            cell, at, end = cells[starts[run]], starts[run], starts[run] + sizes[run]
            block = block if cell == begun else 0
            begun = cell
            while at + BLOCK <= end or ended[run] and at < end:
                rows = fps[at: min(at + BLOCK, end)]
                yield pa.record_batch([
                    pa.array(rows.view(np.int64)), pa.nulls(len(rows), pa.int64()),
                    pa.array(np.full(len(rows), cell)), pa.array(np.full(len(rows), block, np.int32)),
                ], schema=EDGES)
                at, block = at + len(rows), block + 1
            if not ended[run]:
                left = at
        cells, fps = cells[left:], fps[left:]

    for batch in batches:
        cells = np.concatenate([cells, batch.column("cell").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        if len(cells) >= 1 << 17:
            yield from take(False)
    if len(cells):
        yield from take(True)
    a, b = found.spanned()
    yield pa.record_batch([
        pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()),
    ], schema=EDGES)


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that span every link of two different fingerprints."""
    cells = grid(nodes, max_bits).repartition("cell").sortWithinPartitions("cell", "fp")
    found = stored(cells.mapInArrow(
        lambda batches: _edges(batches, max_bits), "a long, b long, cell long, block int"), "simhash-links")
    edges = found.filter("cell is null").select("a", "b")
    large = found.filter("cell is not null").select("cell", "block", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        fps, got = rows["fp"].to_numpy().view(np.uint64), _Links()
        _compare(np.zeros(len(fps), np.int64), fps, got, max_bits)
        a, b = got.spanned()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    counts = large.groupBy("cell").agg(F.max("block").alias("last"))
    dealt = large.join(counts, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).select(
        "cell", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return edges.unionByName(dealt.groupBy("cell", "i", "j").applyInPandas(pair, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges with the smallest node that it is connected to.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"): each
    step hangs a node's neighbours on the smallest of them. Every round is written to the shared folder, and ends
    when a round changes nothing.
    """
    now = stored(_star(edges.filter("a <> b")), "components")
    while True:
        after = stored(_star(_large_star(now)), "components")
        if _same(now, after):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after


def _same(one: DataFrame, two: DataFrame) -> bool:
    sums = [f.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first() for f in (one, two)]
    return sums[0] == sums[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")


def _star(edges: DataFrame) -> DataFrame:
    """Small star: each node and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    hung = down.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return low.select("a", F.col("low").alias("b")).unionByName(hung).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, fp, component_id, root (the component's smallest fingerprint).

    Null and empty texts have fingerprint 0 and are linked like any other. component_id is the smallest doc_id
    reachable; null ids do not count, and a component of null ids only has none. Repeated rows are links of distance 0.
    Extra columns are not read; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, shingle), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes, max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stored(rooted.join(ids, "root").select("fp", "n", "component_id", "root"), "simhash-known")
    return join_counted(rows, known, "fp", "n", rows.count()).select("doc_id", "text_key", "fp", "component_id", "root")


def distinct_documents(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with their own columns, one of each component: that with the smallest (doc_id, text hash), null
    ids last. Of rows equal in both, one stays.
    """
    found = near_duplicates(docs, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    kept = found.groupBy("root").agg(F.min(order).alias("first")).select(
        F.col("first.id").alias("keep_id"), F.col("first.key").alias("keep_key"))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.xxhash64("text").alias("text_key"))
    own = F.col(f"c{names.index('doc_id')}")
    joined = keyed.join(kept, own.eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key")), "left_semi")
    nth = F.row_number().over(Window.partitionBy(own, "text_key").orderBy(own))
    return joined.withColumn("nth", nth).filter("nth = 1").select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
