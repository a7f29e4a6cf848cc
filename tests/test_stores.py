"""The engine's own data sources: pruning, commits, failures and replays."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from karst import model
from karst.sources import files, sinks, stores


def wide(folder):
    folder.mkdir()
    (folder / "A.B.csv").write_text("country_code,2003,2004,2005\nAAA,1.5,,x\nBBB,,2,-1e3\n")
    (folder / "C.csv").write_text('country_code,2018\nAAA,-7.25\n"D,E",.5\n')
    (folder / "R.csv").write_text("country_code,2003,2004\nAAA,1\nBBB,2,3\n")
    (folder / "E.csv").write_text("country_code\nAAA\n")
    return str(folder)


def test_wide_files_equal_the_line_reader(spark, tmp_path):
    path = wide(tmp_path / "w")
    key = lambda r: tuple(map(str, r))
    both = [sorted(map(tuple, df.where("indicator_code <> 'C'").collect()), key=key) for df in (stores.read_wide(spark, path), files.wide_csv(spark, path).where("year IS NOT NULL"))]
    assert both[0] == both[1] and len(both[0]) == 10
    assert {(r.country_code, r.value) for r in stores.read_wide(spark, path).where("indicator_code = 'C'").collect()} == {("AAA", -7.25), ("D,E", 0.5)}
    assert stores.read_wide(spark, str(tmp_path / "none")).collect() == []


def test_only_asked_files_and_years(spark, tmp_path):
    path = wide(tmp_path / "w")
    (tmp_path / "w" / "BAD.csv").mkdir()  # would fail if it were opened
    os.rename(tmp_path / "w" / "C.csv", tmp_path / "w" / "UTF.csv")
    (tmp_path / "w" / "UTF.csv").write_bytes(b"country_code,2003\nA\xff\xfe,1\n")
    got = stores.read_wide(spark, path).where("indicator_code IN ('A.B', 'MISSING') AND year >= 2004 AND year < 2005")
    assert {tuple(r) for r in got.collect()} == {("A.B", "AAA", 2004, None), ("A.B", "BBB", 2004, 2.0)}
    assert got.rdd.getNumPartitions() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "BatchScan wide_indicators" in plan
    asked = stores.read_wide(spark, path, ["A.B", "R"], [2003])
    assert asked.rdd.getNumPartitions() == 2 and {r.year for r in asked.collect()} == {2003}
    assert stores.read_wide(spark, path).where("indicator_code = 'A.B' AND indicator_code = 'R'").collect() == []


def test_columns_not_asked_are_not_parsed(tmp_path):
    path = wide(tmp_path / "w")
    reader = stores.WideReader({"path": path})
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("indicator_code",), "A.B"), EqualTo(("year",), 2004), StringStartsWith(("country_code",), "A")]))
    assert len(left) == 1
    (part,) = reader.partitions()
    (batch,) = reader.read(part)
    assert batch.column("year").to_pylist() == [2004, 2004]


def test_wide_round_trip(spark, tmp_path):
    rows = [("I1", "AAA", 2003, 0.1 + 0.2), ("I1", "BBB", 2004, None), ("I1", 'q"x,', 2004, 1e-300), ("I 2", "AAA", 1999, -5.0), (None, "AAA", 2003, 1.0), ("I1", "CCC", None, 1.0)]
    df = spark.createDataFrame(rows, model.OBSERVATIONS).repartition(4)
    path = str(tmp_path / "w")
    stores.write_wide(df, path)
    got = {(r.indicator_code, r.country_code, r.year): r.value for r in stores.read_wide(spark, path).where("value IS NOT NULL").collect()}
    assert got == {r[:3]: r[3] for r in rows if None not in r}
    assert sorted(os.listdir(path)) == ["I 2.csv", "I1.csv", "_staged"]
    stores.write_wide(df.where("indicator_code = 'I1'"), path)
    assert sorted(x for x in os.listdir(path) if x.endswith(".csv")) == ["I1.csv"]
    # a failing job leaves what was there
    bad = df.where("indicator_code = 'I 2'").withColumn("value", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        stores.write_wide(bad, path)
    assert os.listdir(f"{path}/_staged") == [] and {r.indicator_code for r in stores.read_wide(spark, path).collect()} == {"I1"}


def test_an_epoch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda a, b: spark.range(a, b).select("id", F.array(F.col("id").cast("string")).alias("v")).repartition(3)
    assert stores.append_epoch(rows(0, 10), path, "one") == 10
    assert stores.append_epoch(rows(0, 99), path, "one") == 10  # the replay is not even written
    assert stores.append_epoch(rows(10, 15), path, "two") == 5
    assert stores.append_epoch(rows(0, 0), path, "none") == 0
    assert [r.id for r in stores.read_log(spark, path).orderBy("id").collect()] == list(range(15))
    assert stores.read_log(spark, path).select("v").first().v[0].isdigit()
    assert stores.vacuum(path) == 0
    with pytest.raises(Exception, match="no epoch was committed"):
        stores.read_log(spark, str(tmp_path / "empty")).collect()
    assert stores.read_log(spark, str(tmp_path / "empty"), "id long").collect() == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    stores.append_epoch(spark.range(5), path, "a")
    broken = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        stores.append_epoch(broken, path, "b")
    assert stores.read_log(spark, path).count() == 5 and os.listdir(f"{path}/epochs") == ["a.json"]
    stores.vacuum(path)
    assert len(os.listdir(f"{path}/data")) == len(json.loads((tmp_path / "log/epochs/a.json").read_text())["files"])
    assert stores.append_epoch(spark.range(5, 9), path, "b") == 4 and stores.read_log(spark, path).count() == 9


def test_a_run_taken_up_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    computed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    rows = spark.range(20).mapInArrow(seen, "id long")
    assert sinks.append_new(rows.where("id < 7"), path) == 7
    before = computed.value
    assert sinks.append_new(rows, path, epoch="second") == 13
    assert computed.value - before == 20  # once, and counted without another pass
    assert sinks.append_new(rows, path, epoch="second") == 13
    assert sorted(r.id for r in stores.read_log(spark, path).collect()) == list(range(20))


def test_a_replayed_batch_of_a_stream(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    stores.register(spark)

    def run(checkpoint):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.format("epoch_log").option("path", path).option("stream", "s").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    spark.range(0, 10).coalesce(1).write.mode("append").parquet(source)
    run(state)
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(source)
    run(state)
    assert sorted(r.id for r in stores.read_log(spark, path).collect()) == list(range(20))
    # the last commit is lost: the batch comes again under its number and adds nothing
    os.remove(f"{state}/commits/1")
    os.remove(f"{state}/commits/.1.crc")
    run(state)
    assert sorted(r.id for r in stores.read_log(spark, path).collect()) == list(range(20))
    assert stores.vacuum(path) == 0
