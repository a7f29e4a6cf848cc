"""Every pipeline stage on odd tables: nulls anywhere, repeated rows, an empty table, columns named as the stages' own."""

from __future__ import annotations

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped string, score string, sig string, ids string, line string"
OWN = ("a", "b", "c", "d", "e", "f")
ROWS = [
    (1, "one line that stays here\nand one that repeats below", "en", "s", 50),
    (2, "and one that repeats below\nsomething else entirely follows", None, None, None),
    (3, "and one that repeats below", "en", "s", 26),
    (4, None, None, None, None),
    (5, "", "en", "s", 0),
    (None, "and one that repeats below", None, None, None),
    (6, "the very same row twice over", "en", "s", 28),
    (6, "the very same row twice over", "en", "s", 28),
    (7, "long " * 60_000, "en", "s", 300_000),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "something else entirely follows"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, tables, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame([(*r, *OWN) for r in ROWS], SCHEMA)
    out = stage(spark, docs, tables)
    rows = out.collect()
    if name == "BPE encoding and decoding":
        assert len(rows) == len(ROWS)
        return
    assert out.columns == docs.columns
    assert all((r.n_lines, r.n_dropped, r.score, r.sig, r.ids, r.line) == OWN for r in rows)
    ids = sorted(str(r.doc_id) for r in rows)
    every = sorted(str(r[0]) for r in ROWS)
    gone = {"line dedup": ["3"], "benchmark decontamination": ["2"]}.get(name, [])
    assert ids == [i for i in every if i not in gone]
    if name == "line dedup":
        kept = {r.doc_id: r.text for r in rows if r.doc_id}
        assert kept[2] == "something else entirely follows" and kept[1] == ROWS[0][1] and kept[4] == ""


@pytest.mark.parametrize("k", range(5))
def test_no_rows(spark, tables, k):
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), tables).collect() == []
