"""The registered llm queries against their SQL, and the pipeline against a brute-force version, on the smallest driver tables."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from karst.llm import bpe, quality_model, registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = registry.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(zip(*(df[c].astype(str).tolist() for c in columns), strict=True))
    assert rows(got) == rows(want)


def test_held_out_accuracy(spark):
    import pandas as pd

    path = Path("/root/testdata/sf0.01")
    got = registry.QUERIES["op8_quality_model"](spark, str(path)).toPandas().merge(pd.read_parquet(path / "labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert (held.predicted == held.quality).mean() > 0.9


def test_pipeline(spark):
    import pandas as pd

    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    weights = quality_model.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_model.score(docs, weights).collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect() if scores[r.doc_id] >= quality_model.THRESHOLD}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for i, t in rows.items():
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    kept = {}
    for i, t in rows.items():
        lines = t.split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        if len(left) == len(lines) or "\n".join(left).strip(" \t\n\x0b\x0c\r"):
            kept[i] = "\n".join(left)
    sets = {}
    for i, t in kept.items():
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(lower))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in kept}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    norm = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    items = [norm(t) for t in pd.read_parquet(DATA / "benchmark.parquet").text]
    want = {i: t for i, t in kept.items() if root(i) == i and not any(b in norm(t) for b in items)}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert set(got) == set(want)
    _, encoder = bpe.coder(bpe.read_file())
    assert all(got[i] == [x for b in encoder.encode(t) for x in b] for i, t in want.items())
