"""Operators 11 to 13 against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from karst.llm import fill_middle, sale_enrichment, simhash
from karst.llm._work import Work

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, fp string, component_id string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- 11: simhash


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(points, bits):
    points = np.array(sorted(points), np.uint64)
    return {(int(points[i]), int(points[i + 1 + j])) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= bits)}


def families(rng, n):
    """Fingerprints far apart, near ones at every small distance, and one dense ball that no radius divides."""
    out = set()
    for _ in range(n):
        p = rng.getrandbits(64)
        out.add(p)
        for _ in range(rng.randint(0, 3)):
            out.add(p := p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    ball = rng.getrandbits(64)
    out |= {ball ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4))) for _ in range(400)}
    return sorted(out)


@pytest.mark.parametrize("leaf,block,bits", [(40, 30, 2), (4000, 8000, 2), (60, 5000, 1), (100, 64, 3)])
def test_no_link_is_lost(spark, monkeypatch, leaf, block, bits):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", block)
    points = families(random.Random(leaf), 500)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in points]
    df = spark.createDataFrame(signed, "fp long").repartition(3)
    unsigned = lambda x: x & (1 << 64) - 1
    got = [tuple(sorted((unsigned(r.a), unsigned(r.b)))) for r in simhash.links(df, Work(spark, "t"), bits, every=True).collect()]
    want = near(points, bits)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    spanning = [tuple(sorted((unsigned(r.a), unsigned(r.b)))) for r in simhash.links(df, Work(spark, "t"), bits).collect()]
    assert set(spanning) <= want

    def parts(pairs):
        root = {p: p for p in points}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {p: find(p) for p in points}

    assert parts(spanning) == parts(want) and len(spanning) < len(want)


def test_simhash_components(spark):
    rng = random.Random(3)
    base = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "x"
        rows.append((100 + i, " ".join(w).upper() if i % 5 == 0 else " \n".join(w)))
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one"), (304, "One"), (305, "one two"), (306, "é ü " * 40_000), (None, base[2]), (307, base[2]), (307, base[2]), (None, "alone here")]
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(table(spark, rows)).collect()]
    fps = {p for p in (fingerprint(t) for _, t in rows)}
    root = {p: p for p in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near(fps, 2):
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, t in rows:
        least[find(fingerprint(t))] += [i] if i is not None else []
    want = [(i, fingerprint(t), min(least[find(fingerprint(t))], default=None)) for i, t in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.simhash_components(table(spark, rows).limit(0)).collect() == []


# ---------------------------------------------------------------- 13: fill in the middle

TEXTS = [
    (1, None), (2, ""), (3, "one"), (4, "Ab,c  d\n\te"), (5, "has <P> in it"), (6, "<S>"), (7, "a<M"), (8, "\x01\x02 a\x021\x01b\x022"), (9, "é𝒳a日本b1 2"), (None, "no id at all"),
    (10, "same row"), (10, "same row"), (11, "$1 \\ $0 .*"), (12, "<"), (13, "\x02"), (14, "word " * 60_000), (15, "x" * 100_000), (16, "\x01" * 5),
]


def transformed(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    rng = random.Random(4)
    rows = TEXTS + [(1000 + k, "".join(rng.choice("aBc ,.\n<>PSM\x01\x02é0") for _ in range(rng.randint(0, 40)))) for k in range(400)]
    done = fill_middle.transform(table(spark, rows))
    got = [(r.doc_id, r.n, r.form, r.prefix, r.middle, r.output, r.again) for r in done.withColumn("again", fill_middle.restore(F.col("output"), F.col("form"))).collect()]
    want = [(i, *transformed(i, t), t or "") for i, t in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.transform(table(spark, rows).limit(0)).collect() == []


# ---------------------------------------------------------------- 12: sales

START = datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, sold_at timestamp, arrived_at timestamp, op string, valid_at string"
CHANGES = "change_id long, client_id long, op string, valid_at timestamp, balance double, sold_at string"


def folded(sales, changes, batches=10):
    """The contract, client by client, row by row."""
    cut = lambda day: 9 if day is None else max(0, min(batches - 1, (day - 19723) * batches // 152))
    day = lambda t: (t.date() - datetime(1970, 1, 1).date()).days
    changes = [c for c in dict.fromkeys(changes) if c[3] is not None]
    late_by = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 4
    sale_batch = [cut(None if s[3] is None else day(s[3])) for s in sales]
    change_batch = [cut(None if c[0] is None else day(c[3]) + late_by(c[0])) for c in changes]
    versions, waiting, out, h = defaultdict(list), [], [], None
    order = lambda c: (c[3], c[0] is not None, c[0] or 0, c[2] is not None, c[2] or "", c[4] is not None, c[4] or 0)

    def emit(s, b):
        own = sorted(versions[s[1]], key=order) if s[1] is not None else []
        hit = [c for c in own if s[2] is not None and c[3] <= s[2]][-1:]
        c = hit[0] if hit else (None,) * 5
        cents = None if c[4] is None else int(np.floor(100 * c[4] + 0.5))
        out.append(("sale", s[0], b, len(own), c[0], cents, c[2]))

    for b in range(batches):
        ws = max((s[2] for s, k in zip(sales, sale_batch) if k < b and s[2]), default=None)
        wc = max((c[3] for c, k in zip(changes, change_batch) if k < b), default=None)
        ws, wc = (None if w is None else w - timedelta(hours=24) for w in (ws, wc))
        h = None if ws is None or wc is None else min(ws, wc)
        for c, k in zip(changes, change_batch):
            if k == b:
                if wc is not None and c[3] < wc:
                    out.append(("late", c[0], b, None, None, None, None))
                else:
                    versions[c[1]].append(c)
        waiting += [s for s, k in zip(sales, sale_batch) if k == b]
        go = [s for s in waiting if s[2] is None or (h is not None and s[2] < h)]
        waiting = [s for s in waiting if not (s[2] is None or (h is not None and s[2] < h))]
        for s in go:
            emit(s, b)
        for client, own in versions.items():
            settled = sorted((c for c in own if h is not None and c[3] <= h), key=order)
            versions[client] = [c for c in own if c not in settled[:-1]]
    for s in waiting:
        emit(s, batches)
    return out


@pytest.mark.parametrize("seed,clients", [(1, 30), (2, 2)])
def test_sale_enrichment(spark, seed, clients):
    """Many clients, and few enough that each is cut into pieces."""
    rng = random.Random(seed)
    at = lambda: START + timedelta(hours=rng.randrange(0, 24 * 125, 6))
    client = lambda: rng.choice([None, *range(clients)]) if rng.random() < 0.3 else rng.randrange(clients)
    sales = []
    for k in range(500):
        sold = None if rng.random() < 0.03 else at()
        arrived = None if rng.random() < 0.01 else (sold or at()) + timedelta(hours=rng.choice([0, 1, 30, 500]))
        sales.append((None if rng.random() < 0.01 else k, client(), sold, arrived, "x", "y"))
    sales += sales[:5] + [(900, 1, datetime(2023, 12, 1), datetime(2023, 12, 2), None, None)]
    changes = [(k, client(), rng.choice("IUD"), None if rng.random() < 0.03 else at(), rng.choice([None, -0.125, 7.77, 1e6]), None) for k in range(300)]
    changes += changes[:20] + [(7, 1, None, at(), 1.0, "z"), (None, 0, "U", at(), 2.0, None)]
    changes += [(5, 0, op, START + timedelta(days=50), v, None) for op, v in (("U", 1.0), ("D", 2.0))]
    got = sale_enrichment.enrich(spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(changes, CHANGES).repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(folded(sales, changes), key=key)
    assert len({r.batch for r in got}) > 6 and any(r.rec == "late" for r in got) and any(r.change_id is not None for r in got)


def test_sales_keep_no_native_stores(spark):
    """Each start opens a store a partition: they are files of Spark's own, not databases whose native memory outlives them."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("sales-*"))
    sales = [(k, k % 3, START + timedelta(days=k), START + timedelta(days=k), None, None) for k in range(6)]
    changes = [(k, k % 3, "I", START + timedelta(hours=k), 1.0, None) for k in range(3)]
    got = sale_enrichment.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), batches=1).collect()
    assert sorted((r.id, r.change_id, r.balance_cents) for r in got) == [(k, k % 3 if k else 0, 100) for k in range(6)]
    (work,) = set(folder.glob("sales-*")) - before
    kinds = {f.suffix for f in (work / "state/state/0").glob("*/*")}
    assert ".delta" in kinds and not kinds & {".changelog", ".zip"}


def test_sales_of_nothing(spark):
    assert sale_enrichment.enrich(spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES), batches=1).collect() == []
