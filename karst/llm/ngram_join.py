"""N-gram Jaccard join: all links between documents whose shingle sets overlap enough.

Size-banded tiles with hashed bitmap signatures.  Documents with the same shingle set form one
class and are compared once.  A class sends the first ``n - ceil(t n) + 1`` of its shingles, in
an order common to all, to the shingles' tiles: two sets with Jaccard similarity t or more share one
of them, so no link is lost.  The order puts shingles last that a fixed-size count sketch of the whole corpus
calls frequent; it only decides how full tiles get, never which links are found.  In a tile, members are
sorted by set size and only those within the size band of one another are paired; the bit counts of hashed bitmaps bound
the overlap from above, and what is left is settled by an exact intersection of sorted arrays.

A tile with up to ``SMALL`` members pairs them all.  A larger one first pairs each member with the
smallest member of its size band, which is linear.  Once the links found so have been joined into
components, only pairs from different components of the tile matter: in a few rounds each component's best pair is
verified, then all pairs left that the bitmaps allow.

Near copies meet in as many tiles as they have shingles in common, so tiles with the same smallest member are one family, whose members
are compared once, unless its tiles have so little in common that comparing them one by one is less work.  Members of the component
that most of a family belongs to are not compared among themselves; the others meet them, and each other, in pairs of blocks of about
``BLOCK`` shingles, each a group of its own, so no task holds a whole tile or family.

Pairs that the bitmaps allow are verified where their part of the pairs is dealt to: each set comes there once, not once a pair.  The texts
of these sets are found by a bitmap of their ids and are not shuffled.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._graph import components
from ._work import Work, maybe_in, parallelism, pick, ship

SMALL = 8
#: Shingles of the members of a block, and of the sets that one group verifies; a member counts as LEAST of them at least.
BLOCK, LEAST = 1 << 19, 256
#: Pairs of a part that are verified together.
PAIRS = 2048
#: Rounds in which the large tiles offer only each component's best pair, before they offer all that are left.
BEST_ROUNDS = 2
#: The sketch has a counter for every SKETCH_BYTES of input, within these powers of two.
SKETCH_BYTES, SKETCH_BITS, MOST_SKETCH_BITS = 2048, 20, 23
#: Shingles whose sketch counter says so many members are never gathered by token (nor any in a counter eight times the mean).
HOT = 16_384
#: Parts of the sketch summed together at the first of two levels.
FAN_IN = 256
_CHUNK = 1 << 12
#: Shingles of one bucket of the exchange.
BUCKET = 400_000
_U = np.uint64


def _set_sig(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """One 64-bit name of each row's set of distinct values (as a signed integer)."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(T.mix(values ^ _U(0x2545F4914F6CDD1D)))])
    n = np.diff(bound).astype(_U)
    return T.mix((total[bound[1:]] - total[bound[:-1]]) + n * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _width(n: int) -> int:
    return 1 << max(6, min(16, int(2 * n - 1).bit_length()))


def _bitmap(values: np.ndarray) -> bytes:
    w = _width(len(values))
    bits = np.zeros(w, np.uint8)
    bits[(values >> _U(20)).astype(np.int64) & (w - 1)] = 1
    return np.packbits(bits).tobytes()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, each row's sorted distinct shingles, bounds)."""
    for a, b, data, offs in T.slices(batch.column("text")):
        words = T.Words(data, offs)
        yield a, b, *T.distinct_per_row(*T.shingle_hashes(words.hashes(), words.row, width))


_FEATURES = "kind int, doc_id long, n long, sig long, bits binary"


def _sketch_bits(docs: DataFrame) -> int:
    """Bits of the sketch's index, from the size of the files read; it only decides how full tiles get."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, (size // SKETCH_BYTES).bit_length()))


def _features(width: int, sketch_bits: int):
    def run(batches):
        sketch = np.zeros(1 << sketch_bits, np.uint32)
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, v, bound in _sets(batch, width):
                np.add.at(sketch, (v >> _U(64 - sketch_bits)).astype(np.int64), np.uint32(1))
                n = np.diff(bound)
                bits = [_bitmap(v[bound[i] : bound[i + 1]]) if n[i] else b"" for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), ids.slice(a, b - a), pa.array(n), pa.array(_set_sig(v, bound)), pa.array(bits, pa.binary())], ["kind", "doc_id", "n", "sig", "bits"])
        parts = [(i, sketch[i * _CHUNK : (i + 1) * _CHUNK]) for i in range(len(sketch) // _CHUNK)]
        parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in parts if p.any()]
        if parts:
            k = len(parts)
            task = TaskContext.get()
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array([i for i, _ in parts], pa.int64()), pa.array(np.full(k, task.partitionId() if task else 0)), pa.nulls(k, pa.int64()), pa.array([p for _, p in parts], pa.binary())], ["kind", "doc_id", "n", "sig", "bits"])

    return run


def _sum_sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK, np.uint64)
    for x in table.column("bits"):
        raw = zlib.decompress(x.as_py())
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * _CHUNK else np.uint64)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _frequency(features: DataFrame, sketch_bits: int) -> np.ndarray:
    """log2 of each sketch counter over the mean counter, as uint8: 2**MOST_SKETCH_BITS bytes at most, whatever the input.

    The tasks' sketches are summed in two levels, so no group holds one of every task.
    """
    rows = features.where("kind = 1").select(F.col("doc_id").alias("chunk"), "bits", F.floor(F.col("n") / FAN_IN).alias("part"))
    schema = "chunk long, bits binary"
    rows = rows.groupBy("chunk", "part").applyInArrow(_sum_sketch, schema).groupBy("chunk").applyInArrow(_sum_sketch, schema).collect()
    counts = np.zeros(1 << sketch_bits, np.float64)
    for r in rows:
        counts[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(r.bits), np.uint64)
    mean = max(1.0, counts.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / mean)) - 1).astype(np.uint8)


_MEMBERS = ["bucket", "tok", "sig", "n"]


def _pack(tok: np.ndarray, sig: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    part = ((tok >> _U(11)) % _U(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, cols = part[order], (tok[order], sig[order], n[order].astype(np.int32))
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    spans = list(zip(cut[:-1], cut[1:], strict=True)) if len(part) else []
    return pa.RecordBatch.from_arrays([pa.array([int(part[i]) for i, _ in spans], pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in cols)], _MEMBERS)


def _members(width: int, percent: int, rank, buckets: int, hot: int, only_hot: bool, sketch_bits: int):
    """The shingles that send each class to tiles, with its name and size.

    Those of a sketch class from ``hot`` on come as rows (``only_hot``), which Spark can deal out and sum
    without gathering them; the others come packed by bucket, and a row of bucket -1 says that there are hot ones.
    """

    def run(batches):
        freq = rank.value
        held: list[tuple] = []
        size, met = 0, False
        for batch in batches:
            for _, _, v, bound in _sets(batch, width):
                n = np.diff(bound)
                sig = _set_sig(v, bound)
                once = np.zeros(len(n), bool)
                once[np.unique(sig, return_index=True)[1]] = True
                row = np.repeat(np.arange(len(n)), n)
                level = freq[(v >> _U(64 - sketch_bits)).astype(np.int64)]
                if level.any():
                    order = np.lexsort((v, level, row))
                    v, level = v[order], level[order]
                place = np.arange(len(v)) - np.repeat(bound[:-1], n)
                take = (place < np.repeat(n - (percent * n + 99) // 100 + 1, n)) & once[row]
                much = level >= hot
                if not (only_hot or met) and (take & much).any():
                    met = True
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *[pa.array([b""], pa.binary())] * 3], _MEMBERS)
                take &= much == only_hot
                v, row = v[take], row[take]
                if only_hot:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v.view(np.int64), sig[row], n[row])], ["tok", "sig", "n"])
                else:
                    held.append((v, sig[row], n[row]))
                    size += len(v)
                if size > 2_000_000:
                    yield _pack(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, size = [], 0
        if size:
            yield _pack(*map(np.concatenate, zip(*held, strict=True)), buckets)

    return run


def _tile(percent: int):
    """Of the members of a bucket's tiles: pairs to compare (kind 0), and members of large tiles (kind 1); kind 2 if there are hot ones."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return pa.table({"kind": pa.array([2], pa.int32()), "a": pa.array([0], pa.int64()), "b": pa.array([0], pa.int64())})
        tok = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("tok")])
        sig = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("sig")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("n")]).astype(np.int64)
        # only shingles met at least twice matter, and they are few: sort just those
        order = np.argsort(tok, kind="stable")
        tok, sig, n = tok[order], sig[order], n[order]
        twice = np.zeros(len(tok), bool)
        same = tok[1:] == tok[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        tok, sig, n = tok[twice], sig[twice], n[twice]
        order = np.lexsort((sig, n, tok))
        tok, sig, n = tok[order], sig[order], n[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
        tok, sig, n = tok[new], sig[new], n[new]
        starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(tok)))
        pairs = []
        per = np.repeat(size, size)
        end = np.repeat(starts + size, size)
        small = per <= SMALL
        at = np.arange(len(tok))
        for gap in range(1, SMALL):
            k = at[small & (at + gap < end)]
            k = k[percent * n[k + gap] <= 100 * n[k]]
            pairs.append(np.stack([sig[k], sig[k + gap]]))
        for s, m in zip(starts[size > SMALL], size[size > SMALL], strict=True):
            i = s
            while i < s + m:
                j = s + int(np.searchsorted(n[s : s + m], 100 * n[i] // percent, "right"))
                pairs.append(np.stack([np.full(j - i - 1, sig[i]), sig[i + 1 : j]]))
                i = j
        p = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        p = np.unique(np.stack([p.min(0), p.max(0)]), axis=1)
        big = per > SMALL
        return pa.table({
            "kind": pa.array(np.repeat([0, 1], [p.shape[1], int(big.sum())]).astype(np.int32)),
            "a": pa.array(np.concatenate([p[0], tok[big].view(np.int64)])),
            "b": pa.array(np.concatenate([p[1], sig[big]])),
        })

    return run


def _within(na: np.ndarray, nb: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (na + nb - both)


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed bits, folded by OR to ``width`` bits (the hash's low bits)."""
    while bits.shape[1] * 8 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(bits).view(np.uint64)).sum(1).astype(np.int64)


def overlap_bound(na, nb, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """At least the size of each intersection: a bit of one side only stands for an element of that side only."""
    return np.minimum(na - _count(bits_a & ~bits_b), nb - _count(bits_b & ~bits_a))


def _bounded(percent: int):
    """Keep the pairs whose bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            wa, wb = (np.array([len(x.as_py()) for x in batch.column(c)]) * 8 for c in ("bits_a", "bits_b"))
            keep = np.zeros(len(na), bool)
            for x, y in {*zip(wa.tolist(), wb.tolist(), strict=True)}:
                k = np.flatnonzero((wa == x) & (wb == y))
                a, b = (np.frombuffer(b"".join(v.as_py() for v in batch.column(c).take(pa.array(k))), np.uint8).reshape(len(k), -1) for c in ("bits_a", "bits_b"))
                w = min(x, y)
                keep[k] = _within(na[k], nb[k], overlap_bound(na[k], nb[k], _fold(a, w), _fold(b, w)), percent)
            yield batch.select(["a", "b", "rep_a", "rep_b", "part"]).filter(pa.array(keep))

    return run


def _exact(percent: int):
    """Keep the pairs of a part whose sorted arrays really overlap enough."""

    def run(key: tuple[pa.Scalar, ...], pairs: pa.Table, sets: pa.Table) -> pa.Table:
        names = sets.column("member").to_numpy()
        order = np.argsort(names)
        elements = [np.frombuffer(x.as_py(), np.uint64) for x in sets.column("elements").take(pa.array(order)).combine_chunks()] if len(order) else []
        left, right = (np.searchsorted(names[order], pairs.column(c).to_numpy()) for c in ("a", "b"))
        keep = np.zeros(len(left), bool)
        for i, (j, k) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            small, large = sorted((elements[j], elements[k]), key=len)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            keep[i] = 100 * both >= percent * (len(small) + len(large) - both)
        return pa.table({"a": pairs.column("x"), "b": pairs.column("y")}).filter(pa.array(keep))

    return run


def _arrays(width: int):
    def run(batches):
        for batch in batches:
            for a, b, v, bound in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(_set_sig(v, bound)), pa.array([v[bound[i] : bound[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["sig", "elements"])

    return run


def _sides(side: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows to compare, of different components and within the size band: sides 0 and 2 with side 1, side 2 also with itself."""
    left, right = [], []
    own = np.flatnonzero(side == 2)
    for a, b in ((np.flatnonzero(side != 1), np.flatnonzero(side == 1)), (own, own)):
        for at in np.array_split(a, 1 + len(a) * len(b) // (1 << 22)):
            ok = (label[at][:, None] != label[b]) & (percent * n[at][:, None] <= 100 * n[b]) & (percent * n[b] <= 100 * n[at][:, None])
            if b is own:
                ok &= at[:, None] < b
            i, j = np.nonzero(ok)
            left.append(at[i])
            right.append(b[j])
    return np.concatenate(left), np.concatenate(right)


def _blocks(percent: int, best_only: bool):
    """Pairs of a part's rows that lie in different components and may link.

    ``best_only``: of those just each component's pair with the largest bound; ``left`` says that the part has others.
    """

    def run(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
        name, n, label, rep, side = (members.column(c).to_numpy() for c in ("sig", "n", "label", "rep", "side"))
        left, right = _sides(side, n, label, percent)
        both = np.zeros(len(left), np.int64)
        if len(left):
            bits = members.column("bits").to_pylist()
            width = np.array([8 * len(x) for x in bits])
            place, rows = np.zeros(len(bits), np.int64), {}
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                place[own] = np.arange(len(own))
                rows[w] = np.frombuffer(b"".join(bits[i] for i in own), np.uint8).reshape(len(own), -1)
            for x, y in {*zip(width[left].tolist(), width[right].tolist(), strict=True)}:
                a, b = (_fold(rows[w], min(x, y)) for w in (x, y))
                every = np.flatnonzero((width[left] == x) & (width[right] == y))
                for k in np.array_split(every, 1 + len(every) * min(x, y) // (1 << 26)):
                    both[k] = overlap_bound(n[left[k]], n[right[k]], a[place[left[k]]], b[place[right[k]]])
        keep = np.flatnonzero(_within(n[left], n[right], both, percent))
        left, right, both = left[keep], right[keep], both[keep]
        found = len(left)
        if best_only and found:
            alike = both / (n[left] + n[right] - both)
            from_, score = np.concatenate([label[left], label[right]]), np.concatenate([alike, alike])
            pair = np.concatenate([np.arange(len(left))] * 2)
            order = np.lexsort((pair, -score, from_))
            first = np.concatenate([[True], np.diff(from_[order]) != 0])
            pair = np.unique(pair[order][first])
            left, right = left[pair], right[pair]
        turn = name[left] > name[right]  # a pair's first is the smaller, in whichever part it is met
        left, right = np.where(turn, right, left), np.where(turn, left, right)
        part, more = np.full(len(left), key[0].as_py()), np.full(len(left), found > len(left))
        return pa.table({"a": name[left], "b": name[right], "rep_a": rep[left], "rep_b": rep[right], "x": label[left], "y": label[right], "part": part, "left": more})

    return run


def _verified(docs: DataFrame, pairs: DataFrame, work: Work, percent: int, width: int, name: str, mean: float) -> DataFrame:
    """(x, y) of those of ``pairs(a, b, rep_a, rep_b, x, y, part)`` of set names that really link.

    Pairs of one part are verified together, a part of over PAIRS pairs in pairs of smaller blocks; ``mean`` is how many shingles a set has.
    """
    count = pairs.count()
    many = pairs.groupBy("part").agg(F.count("*").alias("c")).where(F.col("c") > PAIRS)
    pairs = pairs.join(many.select("part", F.ceil(F.sqrt(F.col("c") / PAIRS)).cast("long").alias("k")), "part", "left")
    block = lambda x: F.coalesce(F.pmod(F.xxhash64(x), F.col("k")), F.lit(0).cast("long"))
    parts = max(4 * parallelism(docs.sparkSession), int(2 * count * max(mean, LEAST) / BLOCK))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("part", block("a"), block("b")), F.lit(parts))).drop("k")
    pairs = work.write(pairs, f"{name}-dealt", work.parts(count))
    end = lambda x: pairs.select("part", F.col(x).alias("sig"), F.col(f"rep_{x}").alias("doc_id"))
    nodes = work.write(end("a").union(end("b")).distinct(), f"{name}-nodes", work.parts(2 * count))
    sets = maybe_in(docs, nodes, "doc_id").select("text").mapInArrow(_arrays(width), "sig long, elements binary")
    wanted = nodes.select("part", "sig").withColumnRenamed("part", "spot")
    sets = work.write(sets.join(nodes.select("sig").distinct(), "sig", "left_semi"), f"{name}-sets").dropDuplicates(["sig"])
    placed = wanted.join(sets, "sig").select("spot", F.col("sig").alias("member"), "elements")
    links = pairs.groupBy("part").cogroup(placed.groupBy("spot")).applyInArrow(_exact(percent), "a long, b long")
    links = work.write(links, name)
    for done in ("sets", "nodes", "dealt"):
        work.drop(f"{name}-{done}")
    return links


def _families(big: DataFrame, info: DataFrame) -> DataFrame:
    """(kind, family, sig, label, n): what is compared with one another: the members of all tiles of one smallest member, or of one tile.

    Only the tiles of ``big(tok, sig)`` whose members are not all in one component count.  Comparing a family's members once takes the
    square of their number, comparing its tiles the sum of their squares; the lesser is done.
    """
    labelled = big.select("tok", "sig").join(info.select("sig", "label", "n"), "sig")
    tiles = labelled.groupBy("tok").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.min("sig").alias("low"), F.count("*").cast("double").alias("m")).where("u != v")
    members = labelled.join(tiles.select("tok", "low"), "tok")
    union = members.groupBy("low", "sig").agg(F.min("label").alias("label"), F.min("n").alias("n"))
    size = union.groupBy("low").agg(F.count("*").cast("double").alias("u"))
    cost = tiles.groupBy("low").agg(F.sum(F.col("m") * F.col("m")).alias("each")).join(size, "low")
    apart = cost.where("u * u > each").select("low")
    once = union.join(apart, "low", "left_anti").select(F.lit(0).alias("kind"), F.col("low").alias("family"), "sig", "label", "n")
    alone = members.join(apart, "low", "left_semi").select(F.lit(1).alias("kind"), F.col("tok").alias("family"), "sig", "label", "n")
    return once.union(alone)


def _parts(families: DataFrame) -> DataFrame:
    """(part, kind, family, side, sig) of the block pairs: members outside the family's largest component with all, those inside only with these."""
    key = ["kind", "family"]
    counts = families.groupBy(*key, "label").agg(F.sum(F.greatest("n", F.lit(LEAST))).alias("c"))
    head = counts.groupBy(*key).agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m")).where("m > top.c")  # in shingles
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    head = head.select(*key, F.col("top.label").alias("top"), blocks(F.col("m") - F.col("top.c")).alias("probes"), blocks(F.col("top.c")).alias("base"))
    rows = families.join(head, key).withColumn("inside", F.col("label") == F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sig"), F.when(F.col("inside"), F.col("base")).otherwise(F.col("probes"))).cast("int"))
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("k"), i.alias("i"), j.alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    upto = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    block = F.col("block")
    # a probe's block meets itself where it meets the first block of the base
    others = F.filter(F.sequence(F.lit(0), F.col("probes") - 1), lambda o: o != block)
    among = F.transform(others, lambda o: spot(1, F.least(o, block), F.greatest(o, block), (block > o).cast("int")))
    based = upto(F.col("base"), lambda o: spot(0, block, o, F.when(o == 0, 2).otherwise(0)))
    spots = F.when(F.col("inside"), upto(F.col("probes"), lambda o: spot(0, o, block, 1))).otherwise(F.concat(among, based))
    rows = rows.select(*key, "sig", F.explode(spots).alias("s"))
    return rows.select(F.xxhash64(*key, "s.k", "s.i", "s.j").alias("part"), *key, F.col("s.side").alias("side"), "sig")


def _mixed_pairs(families: DataFrame, info: DataFrame, work: Work, percent: int, best_only: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``_blocks`` of ``families``, and those of the families that have more."""
    families = work.write(families, f"{name}-families")
    parts = work.write(_parts(families), f"{name}-parts")
    rows = parts.join(info, "sig").select("part", "side", "sig", "n", "label", "rep", "bits")
    schema = "a long, b long, rep_a long, rep_b long, x long, y long, part long, left boolean"
    found = work.write(rows.groupBy("part").applyInArrow(_blocks(percent, best_only), schema), name)
    key = ["kind", "family"]
    open_ = parts.join(found.where("left").select("part").distinct(), "part", "left_semi").select(*key).distinct()
    again = families.drop("label").join(open_, key, "left_semi")
    return found.drop("left").dropDuplicates(["a", "b"]), again


def _merged(info: DataFrame, links: DataFrame, work: Work, name: str) -> DataFrame:
    """``info`` with the labels that ``links`` connect made one."""
    if links.isEmpty():
        return info
    merged = components(links, work, name).select(F.col("node").alias("label"), "component")
    return info.join(merged, "label", "left").select("sig", "rep", "n", "bits", F.coalesce("component", "label").alias("label"))


def jaccard_components(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Words are runs of anything but space and 0x09-0x0D with A-Z lower-cased; a document is the set of its
    ``width``-word shingles, or its whole sequence where it has fewer words.  Two documents link when
    ``100 * |intersection| >= percent * |union|``; component_id is the smallest doc_id reachable.
    Null or empty texts, and texts without words, have n_shingles 0 and are their own component.
    Repeated rows give repeated result rows; rows with a null doc_id link with nothing and get a null
    component_id.  Other columns of ``docs`` are ignored.  An empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    work = Work(spark, "ngram-join")
    docs = pick(docs, doc_id="long", text="string")
    sketch_bits = _sketch_bits(docs)
    every = work.write(docs.mapInArrow(_features(width, sketch_bits), _FEATURES), "features")
    rows = every.where("kind = 0").select("doc_id", "n", "sig", "bits")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits"))
    classes = work.write(classes, "classes")
    shingles, sets = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not sets:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    freq = _frequency(every, sketch_bits)
    # levels are powers of two of the mean counter, less one
    hot = int(np.ceil(np.log2(max(8.0, HOT * (1 << sketch_bits) / shingles)))) - 1
    rank = spark.sparkContext.broadcast(freq)
    buckets = max(4 * parallelism(spark), int(shingles * (100 - percent) / 100 / BUCKET))
    texts = docs.where("doc_id IS NOT NULL").select("text")
    packed = texts.mapInArrow(_members(width, percent, rank, buckets, hot, False, sketch_bits), "bucket long, tok binary, sig binary, n binary")
    found = work.write(packed.groupBy("bucket").applyInArrow(_tile(percent), "kind int, a long, b long"), "found")
    pairs = found.where("kind = 0").select("a", "b")
    big = found.where("kind = 1").select(F.col("a").alias("tok"), F.col("b").alias("sig"))
    if not found.where("kind = 2").isEmpty():
        tiles = texts.mapInArrow(_members(width, percent, rank, buckets, hot, True, sketch_bits), "tok long, sig long, n long").distinct()
        tiles = work.write(tiles.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent)))), "hot")
        first = tiles.groupBy("tok", "band").agg(F.min("sig").alias("low"))
        star = tiles.join(first, ["tok", "band"]).where("sig != low")
        pairs = pairs.union(star.select(F.col("low").alias("a"), F.col("sig").alias("b")))
        big = big.union(tiles.select("tok", "sig"))
    side = lambda x: classes.select(F.col("sig").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    # a tile's star is verified together, dealt out in 64 parts
    pairs = pairs.distinct().withColumn("part", F.xxhash64("a", F.pmod("b", F.lit(64))))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(percent), "a long, b long, rep_a long, rep_b long, part long")
    pairs = work.write(pairs, "pairs")
    mean = shingles / sets
    links = _verified(docs, pairs.withColumns({"x": F.col("rep_a"), "y": F.col("rep_b")}), work, percent, width, "links", mean)
    info = classes.withColumn("label", F.col("rep"))
    for turn in range(BEST_ROUNDS):
        # links hold pairs of labels; join them into the components of all labels
        info = work.write(_merged(info, links, work, f"components-{turn}"), f"info-{turn}", work.parts(sets, 50_000))
        best = turn < BEST_ROUNDS - 1
        families = again.join(info.select("sig", "label"), "sig").select("kind", "family", "sig", "label", "n") if turn else _families(big, info)
        more, again = _mixed_pairs(families, info, work, percent, best, f"more-{turn}")
        if more.isEmpty():
            break
        links = _verified(docs, more, work, percent, width, f"links-{turn}", mean)
        if not best:
            info = _merged(info, links, work, "components-last")
    out = rows.select("doc_id", "n", "sig").join(info.select("sig", "label"), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("label"))).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Links at 75 % of five-word shingles over the whole of ``documents``."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] FOR i IN range(1, len(w) - 3)]) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(r.b) AS BIGINT) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
