"""SimHash near-dedup: 64-bit fingerprints and all that differ in few bits, found exactly by a vantage-point tree.

Documents with the same fingerprint are one point, so exact copies cost nothing further on.  The upper tree splits points by their Hamming
distance from a vantage point: those within the radius go left, the others right.  It is fitted on a sample whose size depends on the number
of leaves (``SAMPLE`` points for each, ``LEAVES`` at most), and places every point: in one leaf, its home, and as a visitor in those leaves
across a radius where the triangle inequality leaves room for a neighbour.  A pair across a radius is sought from its left point only, so each pair is met in
one leaf.  The sample decides how even leaves are, never what is found.

In a leaf, points are sorted by their distance from one more vantage point and compared only with those whose distance differs by no more than
the bits allowed.  A leaf with many points, such as a large family that no radius divides, is compared in pairs of blocks of ``BLOCK`` points, each a group of its own.
A group gives links that span its components, not all pairs; star contraction joins them.

Odd input: an empty or null text, or one without words, has fingerprint zero and links like any other; repeated rows are repeated in the
result; rows with a null id take part, and get the smallest other id they reach, null where there is none.  Texts of any length are hashed whole, in slices.
Other columns, whatever their names, are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._text import Words, slices
from ._work import Work, pick, ship

SEED, WIDTH, BITS = 42, 3, 2
#: Points of a leaf aimed at, leaves at most, and points of the sample for each leaf.
LEAF, LEAVES, SAMPLE = 4000, 1024, 64
#: Points of a block; points compared at once with their neighbours in a group; points routed at once.
BLOCK, CHUNK, ROUTE = 8000, 64, 1 << 16
_U = np.uint64


def _fingerprint(joined: bytes, begin: np.ndarray, end: np.ndarray) -> int:
    """The fingerprint of one document, whose shingles are the spans of ``joined``."""
    from xxhash import xxh64_intdigest

    total = np.zeros(64, np.int64)
    for at in range(0, len(begin), 1 << 16):
        spans = zip(begin[at : at + (1 << 16)].tolist(), end[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], _U)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(begin), bitorder="little").view(np.int64)[0])


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for first, last, data, offs in slices(batch.column("text")):
                words = Words(data, offs)
                size = words.end - words.start
                begin = np.concatenate([[0], np.cumsum(size + 1)])
                joined = np.full(int(begin[-1]), 32, np.uint8)
                shift = np.repeat(words.start - begin[:-1], size)
                to = np.flatnonzero(np.repeat(np.tile([True, False], len(size)), np.stack([size, np.ones_like(size)], 1).ravel()))
                joined[to] = words.data[to + shift]
                whole = joined.tobytes()
                for i in range(last - first):
                    a, b = int(words.row[i]), int(words.row[i + 1])
                    if a < b:
                        m = max(1, b - a - width + 1)
                        ends = begin[a + min(width, b - a) : a + min(width, b - a) + m] - 1
                        out[first + i] = _fingerprint(whole, begin[a : a + m], ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed integer."""
    ship(docs.sparkSession)
    return pick(docs, doc_id="long", text="string").mapInArrow(_fingerprints(width), "doc_id long, fp long")


class Tree:
    """Vantage points and radii of the upper tree; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, cap: int, bits: int):
        self.vantage, self.radius, self.left, self.right, self.bits = [], [], [], [], bits
        self.leaves = 0
        self.root = self._grow(np.unique(sample), cap)

    def _grow(self, points: np.ndarray, cap: int) -> int:
        """The node over these points of the sample; a leaf is its number's complement."""
        split = self._split(points) if len(points) > cap else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        at = len(self.vantage)
        self.vantage.append(split[0])
        self.radius.append(split[1])
        self.left.append(0)
        self.right.append(0)
        inside = np.bitwise_count(points ^ split[0]) <= split[1]
        self.left[at], self.right[at] = self._grow(points[inside], cap), self._grow(points[~inside], cap)
        return at

    def _split(self, points: np.ndarray) -> tuple[np.uint64, int] | None:
        """Of a few vantage points, the one with the radius that fewest points lie close to, with a fifth on either side at least."""
        best = None
        for v in points[np.linspace(0, len(points) - 1, 16).astype(int)]:
            at = np.bincount(np.bitwise_count(points ^ v), minlength=68) / len(points)
            inside = np.cumsum(at)
            for r in np.flatnonzero((inside[:64] >= 0.2) & (inside[:64] <= 0.8)):
                close = at[max(0, r - self.bits + 1) : r + self.bits + 1].sum() + 0.1 * abs(inside[r] - 0.5)
                if best is None or close < best[0]:
                    best = close, v, int(r)
        return best and best[1:]

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, indices of points, whether they are visitors) for all leaves that points go to."""
        todo = [(self.root, np.arange(len(points)), False)]
        while todo:
            node, at, visitor = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, at, visitor
                continue
            d, r = np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int64), self.radius[node]
            if visitor:
                todo += [(self.left[node], at[d - self.bits <= r], True), (self.right[node], at[d + self.bits > r], True)]
            else:
                todo += [(self.left[node], at[d <= r], False), (self.right[node], at[d > r], False)]
                todo.append((self.right[node], at[(d <= r) & (d + self.bits > r)], True))


def _route(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        have, n = [], 0
        for b in batches:
            have.append(b.column("fp").to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= ROUTE:
                yield np.concatenate(have)
                have, n = [], 0
        if n:
            yield np.concatenate(have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in gathered(batches):
            for leaf, at, visitor in tree.route(fp.view(_U)):
                arrays = [pa.array(np.full(len(at), leaf, np.int32)), pa.array(fp[at]), pa.array(np.full(len(at), visitor))]
                yield pa.RecordBatch.from_arrays(arrays, ["leaf", "fp", "visitor"])

    return run


def _close(rows: np.ndarray, cols: np.ndarray, own: bool, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices of ``rows`` and ``cols`` that differ in up to ``bits`` bits; with ``own`` the two are the same points, each pair once."""
    if not len(rows) or not len(cols):
        return
    v = cols.min()
    d = np.bitwise_count(cols ^ v).astype(np.int64)
    by = np.argsort(d, kind="stable")
    d, sorted_cols = d[by], cols[by]
    row_d = d if own else np.bitwise_count(rows ^ v).astype(np.int64)
    order = by if own else np.argsort(row_d, kind="stable")
    if not own:
        row_d = row_d[order]
    for at in range(0, len(order), CHUNK):
        mine = order[at : at + CHUNK]
        low = at if own else int(np.searchsorted(d, row_d[at] - bits, "left"))
        high = int(np.searchsorted(d, row_d[min(at + CHUNK, len(order)) - 1] + bits, "right"))
        r, c = np.nonzero(np.bitwise_count(rows[mine][:, None] ^ sorted_cols[None, low:high]) <= bits)
        if own:
            r, c = r[c > r], c[c > r]
        yield mine[r], by[low + c]


def _spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs of ``n`` points those that join components not joined before."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            open_ = np.flatnonzero(x != y)
            if not len(open_):
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            # one pair for each higher root, with its lowest partner
            by = np.lexsort((y, x))
            one = by[np.concatenate([[True], x[by][1:] != x[by][:-1]])]
            yield a[one], b[one]
            hook = np.arange(n)
            hook[x[one]] = y[one]
            while (hook[hook] != hook).any():
                hook = hook[hook]
            root = hook[root]


def _cell(bits: int, every: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        fp, role = table.column("fp").to_numpy().view(_U), table.column("role").to_numpy()
        rows, cols, both = (np.flatnonzero(role == k) for k in (0, 1, 2))
        targets = np.concatenate([both, cols])
        found = [*((both[a], both[b]) for a, b in _close(fp[both], fp[both], True, bits))] if every else []
        if every:
            found += [(rows[a], targets[b]) for a, b in _close(fp[rows], fp[targets], False, bits)]
        else:

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield from ((both[a], both[b]) for a, b in _close(fp[both], fp[both], True, bits))
                yield from ((rows[a], targets[b]) for a, b in _close(fp[rows], fp[targets], False, bits))

            found = list(_spanning(len(fp), pairs()))
        a = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(fp[a].view(np.int64)), "b": pa.array(fp[b].view(np.int64))})

    return run


def links(points: DataFrame, work: Work, bits: int = BITS, every: bool = False) -> DataFrame:
    """(a, b) of the distinct fingerprints ``points(fp)`` that differ in up to ``bits`` bits.

    All such pairs, each once, where ``every`` is set; else pairs that span the same components, at most one a point and group.
    """
    n = points.count()
    leaves = min(LEAVES, -(-n // LEAF))
    wanted, whole = leaves * SAMPLE, 1 << 30
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(whole)) < int(whole * min(1.0, wanted / max(1, n)))).select("fp")
    tree = Tree(np.array([r.fp for r in sample.collect()] if leaves > 1 else [], np.int64).view(_U), SAMPLE, bits)
    routed = work.write(points.select("fp").mapInArrow(_route(tree), "leaf int, fp long, visitor boolean"), "routed")
    # one row a leaf, at most twice LEAVES
    load = routed.groupBy("leaf").agg(F.ceil(F.sum((~F.col("visitor")).cast("int")) / BLOCK).cast("int").alias("blocks"))
    dealt = routed.join(F.broadcast(load), "leaf").withColumn("own", F.pmod(F.xxhash64("fp"), F.greatest("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    as_row = F.col("visitor") | (F.col("o") > F.col("own"))
    row = dealt.where(as_row).select("leaf", F.col("own").alias("i"), F.col("o").alias("j"), "fp", F.lit(0).alias("role"))
    col = dealt.where(~F.col("visitor")).select("leaf", F.col("o").alias("i"), F.col("own").alias("j"), "fp", F.when(F.col("o") == F.col("own"), 2).otherwise(1).alias("role"))
    return row.union(col).groupBy("leaf", "i", "j").applyInArrow(_cell(bits, every), "a long, b long")


def simhash_components(docs: DataFrame, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs(doc_id, text)``; component_id is the smallest doc_id reachable by links."""
    spark = ship(docs.sparkSession)
    work = Work(spark, "simhash")
    rows = work.write(fingerprints(docs, width), "fingerprints")
    points = work.write(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    edges = work.write(links(points, work, bits), "links")
    if edges.isEmpty():
        known = points.select(F.col("fp").alias("_fp"), F.col("rep").alias("component_id"))
    else:
        group = components(edges, work, "components").select(F.col("node").alias("fp"), "component")
        known = points.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
        known = work.write(known.join(least, "component").select(F.col("fp").alias("_fp"), "component_id"), "known")
    return rows.join(known, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
