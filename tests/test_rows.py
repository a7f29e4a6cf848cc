"""Small row operations, and rounding on binary values."""

from __future__ import annotations

from pyspark.sql import functions as F

from karst import model
from karst.functions.numeric import rounded
from karst.functions.parity import round_exact_binary
from karst.operators import rows
from karst.session import ensure_checkpoint_dir


def test_where_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows.where_all(df, v=None).first().k == 2
    assert rows.where_all(df).count() == 2
    assert rows.where_all(df, k=1, v="b").count() == 0


def test_has_final_answer(spark):
    final = ("c", "function", ("final_answer", {"answer": "1"}))
    data = [(1, [("assistant", None, None, [final])]), (2, [("user", "x", None, None)]), (3, [("assistant", "x", None, None)])]
    df = spark.createDataFrame(data, f"k int, messages array<{model.MESSAGE}>")
    assert {r.k: r.f for r in df.select("k", rows.has_final_answer(F.col("messages")).alias("f")).collect()} == {1: True, 2: False, 3: False}


def test_catalogue_of_paraphrases(spark):
    old = spark.createDataFrame([("b", ["x y"]), ("a", ["z"])], "id string, paraphrase array<string>")
    new = spark.createDataFrame([("b", ["one two three"])], "id string, paraphrase array<string>")
    merged = rows.merge_paraphrases(old, new)
    assert [(r.id, r.paraphrase) for r in merged.collect()] == [("a", ["z"]), ("b", ["one two three"])]
    assert rows.mean_words(merged).first().mean_words == 2.0


def test_counts_and_samples(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None), (4, [])], "k int, tags array<string>")
    assert [(r.tags, r.n) for r in rows.count_exploded(df, "tags").collect()] == [("a", 2), ("unknown", 2), ("b", 1)]
    drawn = [r.k for r in rows.sample(df, 2, "k", 7).collect()]
    assert len(drawn) == 2 and drawn == [r.k for r in rows.sample(df.repartition(3), 2, "k", 7).collect()]
    assert df.select(rows.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("j")).first().j == 0.5


def test_rounding_modes(spark):
    df = spark.createDataFrame([(2.675,), (0.000025,), (None,)], "x double").select("x", round_exact_binary(F.col("x")).alias("p"), rounded(F.col("x")).alias("r"))
    for r in df.collect():
        assert r.p == (None if r.x is None else round(r.x, 5))


def test_checkpoint_dir_is_the_named_one(spark):
    assert spark.conf.get("spark.checkpoint.dir").split("/")[-1] in ensure_checkpoint_dir(spark)
