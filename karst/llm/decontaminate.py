"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are reduced to lower-case letters and digits with single spaces between words.  An
item of m bytes found in a text with at most k edits leaves at least ``m - q + 1 - k q`` of its q-grams there, on
diagonals (text position less item position) at most k apart.  So shared q-grams are counted in bands of diagonals,
each overlapping the next by half; the regions of bands that meet the bound are verified by banded alignment.  k is ``ERRORS`` of m, and never so
large that the bound falls under 1.

Items of fewer than ``SHORT`` reduced bytes are common wording.  Those of ``SHORT_WORDS`` words or more, and of Q bytes or more, count where they stand word
for word, between other words; the others only where a text is nothing else.

One pass over the texts, with no shuffle.  A long text is reduced piece by piece and searched in overlapping parts of the reduced text.  Benchmark items come to the executors in blocks of about ``BLOCK_BYTES``, a pass each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._work import pick, ship

Q = 8
ERRORS = 0.08
#: Items of fewer reduced bytes are found without any edit: within texts from SHORT_WORDS words on, else as whole texts only.
SHORT, SHORT_WORDS = 20, 3
BLOCK_BYTES = 4_000_000
_SEGMENT = 1 << 20
_FILTER_BITS = 22
_U = np.uint64
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, places in ``data``) of the reduced texts."""
    out = _NORMAL[data]
    if len(data) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    space = out == 32
    follows = np.ones(len(data), bool)  # a space at a text's beginning goes, as does one after a space
    follows[1:] = space[:-1] | edge[1:-1]
    keep = np.flatnonzero(~(space & follows))
    return out[keep], np.searchsorted(keep, offs), keep


def grams(data: np.ndarray) -> np.ndarray:
    """The Q (8) bytes from each position on as one number, its bits spread; equal only for equal bytes."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, _U)
    x = data.astype(_U)
    x = x[:-1] | x[1:] << _U(8)
    x = x[:-2] | x[2:] << _U(16)
    return T.mix(x[:-4] | x[4:] << _U(32))


class Items:
    """The q-gram index of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = pa.array([t or "" for _, t in rows], pa.large_string())
        _, offs, data = texts.buffers()
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        raw, bound, _ = normal(data, np.frombuffer(offs, np.int64)[: len(rows) + 1])
        self.ids = [i for i, _ in rows]
        self.bytes = [raw[a:b].tobytes().rstrip(b" ") for a, b in zip(bound[:-1], bound[1:], strict=True)]
        size = np.array([len(x) for x in self.bytes], np.int64)
        self.size = size
        self.edits = np.where(size < SHORT, 0, np.maximum(0, np.minimum((size * ERRORS).astype(np.int64), (size - Q) // Q)))
        self.least = size - Q + 1 - self.edits * Q
        self.short = {x: [k for k, y in enumerate(self.bytes) if y == x] for x in self.bytes if 0 < len(x) < SHORT}
        long = [k for k in range(len(rows)) if size[k] >= SHORT or (size[k] >= Q and self.bytes[k].count(b" ") >= SHORT_WORDS - 1)]
        parts = [grams(np.frombuffer(self.bytes[k], np.uint8)) for k in long]
        gram = np.concatenate([*parts, np.zeros(0, _U)])
        item = np.repeat(np.array(long, np.int64), [len(p) for p in parts])
        place = np.concatenate([*(np.arange(len(p)) for p in parts), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.gram >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.most = int(size.max(initial=0))


def best_alignment(item: bytes, region: bytes, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item's best place in the region if at most ``edits`` away.

    A band of diagonals is as wide as the region allows; the row minimum ends the search early.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if not edits:
        return None
    m, n = len(item), len(region)
    width = n - m + 2 * edits + 1  # diagonals from -edits to n - m + edits
    if width <= 0:
        return None
    far = m + n
    text = np.frombuffer(region, np.uint8)
    j = np.arange(width) - edits  # the text place of each diagonal before item place 0
    cost = np.where((j >= 0) & (j <= n), 0, far)
    start = j.copy()
    step = np.arange(width)
    for i in range(m):
        at = j + i
        inside = (at >= 0) & (at < n)
        change = np.where(inside, text[np.clip(at, 0, n - 1)] != item[i], far)
        down = np.append(cost[1:] + 1, far)  # the item's byte is missing in the text
        by_down = down < cost + change
        new = np.where(by_down, down, cost + change)
        begin = np.where(by_down, np.append(start[1:], 0), start)
        new = np.where((at + 1 < 0) | (at + 1 > n), far, new)
        low = np.minimum.accumulate(new - step)  # text bytes that the item lacks
        source = np.maximum.accumulate(np.where(new - step == low, step, 0))
        cost, start = low + step, begin[source]
        if cost.min() > edits:
            return None
    ends = j + m
    ok = (ends >= 0) & (ends <= n)
    k = int(np.argmin(np.where(ok, cost, far)))
    return (int(cost[k]), int(start[k]), int(ends[k])) if cost[k] <= edits else None


def _reduced(data: np.ndarray, offs: np.ndarray, overlap: int):
    """(rows, bytes, offsets, places in ``data``, whether the texts' beginnings and ends are there): of whole texts, or of parts of one long text that overlap by ``overlap`` reduced bytes."""
    size = int(offs[-1])
    if size <= 2 * _SEGMENT or len(offs) > 2:
        yield np.arange(len(offs) - 1), *normal(data, offs), True, True
        return
    text, place = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at, begins = 0, True
    while at < size:
        end = min(size, at + _SEGMENT)
        while end < size and data[end] & 0xC0 == 0x80:  # not within a character
            end += 1
        # the byte before says whether a space follows a word; it is not kept twice
        before = min(at, 1)
        new, _, where = normal(data[at - before : end], np.array([0, end - at + before]))
        own = where >= before
        begins = begins and len(text) <= overlap  # nothing of the text was let go yet
        text, place = np.concatenate([text[-overlap:], new[own]]), np.concatenate([place[-overlap:], where[own] + at - before])
        yield np.zeros(1, np.int64), text, np.array([0, len(text)]), place, begins, end == size
        at = end


def find(items: Items, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first byte, end byte, distance): the best place of every item in every text that holds it."""
    best: dict[tuple[int, int], tuple] = {}
    for rows, text, at, place, begins, ends in _reduced(data, offs, 2 * items.most + 64):
        if items.short and len(rows) == len(offs) - 1:
            for r in range(len(rows)):
                for k in items.short.get(text[at[r] : at[r + 1]].tobytes().rstrip(b" "), ()) if at[r + 1] - at[r] <= SHORT else ():
                    best[int(rows[r]), k] = (0, 0, int(offs[r + 1] - offs[r]))
        g = grams(text)
        hit = np.flatnonzero(items.filter[(g >> _U(64 - _FILTER_BITS)).astype(np.int64)])
        first, last = np.searchsorted(items.gram, g[hit], "left"), np.searchsorted(items.gram, g[hit], "right")
        n = last - first
        hit, first, n = hit[n > 0], first[n > 0], n[n > 0]
        if not len(hit):
            continue
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + Q <= at[row + 1]
        hit, first, n, row = hit[inside], first[inside], n[inside], row[inside]
        index = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        hit, row, item = np.repeat(hit, n), np.repeat(row, n), items.item[index]
        pair, back, count = np.unique(row * len(items.ids) + item, return_inverse=True, return_counts=True)
        enough = (count >= items.least[pair % len(items.ids)])[back]
        hit, row, item, index = hit[enough], row[enough], item[enough], index[enough]
        if not len(hit):
            continue
        width = items.edits[item] + 1
        band = (hit - items.place[index] + items.most) // width  # diagonals, shifted to be at least 0
        span = len(text) + 2 * items.most + 2
        code = (row * len(items.ids) + item) * span
        code, count = np.unique(np.concatenate([code + band, code + np.maximum(band - 1, 0)]), return_counts=True)
        item = (code // span) % len(items.ids)
        good = count >= items.least[item]
        code, item = code[good], item[good]
        for c, k in zip(code.tolist(), item.tolist(), strict=True):
            r, w, e = c // span // len(items.ids), int(items.edits[k]) + 1, int(items.edits[k])
            left = (c % span) * w - items.most - e
            right = left + 2 * (w + e) + int(items.size[k])
            # one byte more on either side says where words end; what an inner edge cuts off is whole in the part beside
            if (left < 1 and not begins) or (right + 1 > len(text) and not ends):
                continue
            left, right = max(int(at[r]), left), min(int(at[r + 1]), right)
            found = best_alignment(items.bytes[k], text[left:right].tobytes(), e)
            if found and found[0] < best.get((int(rows[r]), k), (1 << 30,))[0]:
                first, last = left + found[1], left + found[2]
                if items.size[k] < SHORT and not ((first == at[r] or text[first - 1] == 32) and (last == at[r + 1] or text[last] == 32)):
                    continue  # within a longer word
                best[int(rows[r]), k] = (found[0], int(place[first] - offs[rows[r]]), int(place[last - 1] + 1 - offs[rows[r]]))
    return [(r, k, a, b, d) for (r, k), (d, a, b) in sorted(best.items())]


_indexed: dict[int, Items] = {}


def _index(rows: list[tuple[int, str]]) -> Items:
    key = hash(tuple(rows))
    if key not in _indexed:
        _indexed.clear()
        _indexed[key] = Items(rows)
    return _indexed[key]


def _blocks(items: DataFrame):
    """The items (item_id, text) in blocks of about BLOCK_BYTES, as broadcast variables."""
    items = pick(items, item_id="long", text="string").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield ship(items.sparkSession).sparkContext.broadcast([(r.item_id, r.text) for r in rows])


MATCHES = "doc_id long, item_id long, first_byte long, end_byte long, distance int"


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_byte, end_byte, distance) of every document of ``docs(doc_id, text)`` that holds an item.

    One row a (row of docs, item) with the item's best place, in bytes of the text.  Null or empty texts hold none; items that are null
    or have no letters or digits are held by none, and items under ``SHORT`` reduced bytes see above.  Repeated rows
    are each reported.  Texts of any length are searched whole.  Other columns are ignored; an empty table gives no rows.
    """

    def over(shared):
        def run(batches):
            index = _index(shared.value)
            for batch in batches:
                ids = batch.column("doc_id")
                for a, _, data, offs in T.slices(batch.column("text")):
                    got = find(index, data, offs)
                    if got:
                        r, k, x, y, d = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + i for i in r])), pa.array([index.ids[i] for i in k], pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(d, pa.int32())], ["doc_id", "item_id", "first_byte", "end_byte", "distance"])

        return run

    docs = pick(docs, doc_id="long", text="string")
    parts = [docs.mapInArrow(over(b), MATCHES) for b in _blocks(items)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], MATCHES)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; null and empty texts hold none, repeated rows are each judged."""

    def over(shared):
        def run(batches):
            index = _index(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, data, offs in T.slices(batch.column("text")):
                    clean[[a + x[0] for x in find(index, data, offs)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for b in _blocks(items):
        docs = docs.mapInArrow(over(b), docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by any of ``documents``."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
