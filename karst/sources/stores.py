"""Data sources of the engine's own: wide indicator files, and an append log with commits by epoch.

Both reach their files through ``pyarrow.fs`` on the executors, so the path must be one that pyarrow can open from every machine (a mounted
folder, ``file://``, ``s3://``, ``gs://``, ``hdfs://`` where libhdfs is there).  ``register`` makes them known to a session by value, as the workers
that plan a scan run beside the driver's JVM and need no installation of this package then, and turns on filters for Python sources in that session.
"""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Filters reach a Python source only where this is set, and one that takes filters cannot be read without.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_LONG = "indicator_code string, country_code string, year int, value double"


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set(PUSHDOWN, "true")  # read when a plan is made, which is after this returns, so it stays set
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        for source in (WideIndicators, EpochLog):
            spark.dataSource.register(source)
    finally:
        cloudpickle.unregister_pickle_by_value(module)
    return spark


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop writes file:/a, pyarrow reads file:///a
    return pafs.FileSystem.from_uri(path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _listed(fs: pafs.FileSystem, folder: str, ending: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith("."))


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write whole or not at all: the name appears when the bytes are there."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(data)
    fs.move(aside, path)


# ---------------------------------------------------------------- wide indicator files


@dataclass
class WideFile(InputPartition):
    """One file, the columns asked of it."""

    path: str
    low: int | None
    high: int | None
    years: tuple[int, ...] | None


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task that wait for the job's commit: (name, staged path, rows)."""

    files: list[tuple[str, str, int]]


class WideIndicators(DataSource):
    """``<indicator>.csv`` with a row a country and a column a year, headers ragged, read and written as (indicator_code, country_code, year, value).

    A scan has a partition a file.  Filters on indicator_code (``=``, ``IN``) choose the files, which are then not even listed; filters on year
    choose the columns, and cells of others are not parsed.  A cell that is empty, missing or no number is null.
    The options ``indicators`` and ``years`` (JSON lists) do the same.  Writing needs an indicator's rows in one task and in
    order (``write_wide``); files appear together when the job commits, and nothing is left of a job that fails.
    """

    @classmethod
    def name(cls) -> str:
        return "wide_indicators"

    def schema(self) -> str:
        return _LONG

    def reader(self, schema: StructType) -> DataSourceReader:
        return WideReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WideWriter(self.options["path"], overwrite)


class WideReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        listed = lambda k: set(json.loads(options[k])) if k in options else None
        self.indicators, self.years = listed("indicators"), listed("years")
        self.low = self.high = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        meet = lambda have, new: new if have is None else have & new
        least = lambda have, new: new if have is None else max(have, new)
        most = lambda have, new: new if have is None else min(have, new)
        for f in filters:
            match f:
                case EqualTo(("indicator_code",), value) if value is not None:
                    self.indicators = meet(self.indicators, {value})
                case In(("indicator_code",), values):
                    self.indicators = meet(self.indicators, set(values))
                case EqualTo(("year",), value) if value is not None:
                    self.years = meet(self.years, {value})
                case In(("year",), values):
                    self.years = meet(self.years, set(values))
                case GreaterThanOrEqual(("year",), value):
                    self.low = least(self.low, value)
                case GreaterThan(("year",), value):
                    self.low = least(self.low, value + 1)
                case LessThanOrEqual(("year",), value):
                    self.high = most(self.high, value)
                case LessThan(("year",), value):
                    self.high = most(self.high, value - 1)
                case IsNotNull(("indicator_code" | "year",)):
                    pass  # they never are
                case _:
                    yield f

    def partitions(self) -> list[WideFile]:
        fs, folder = _store(self.path)
        if self.indicators is None:
            paths = _listed(fs, folder, ".csv")
        else:
            asked = sorted(f"{folder}/{i}.csv" for i in self.indicators if i is not None)
            paths = [f.path for f in (fs.get_file_info(asked) if asked else []) if f.type == pafs.FileType.File]
        years = None if self.years is None else tuple(sorted(y for y in self.years if y is not None))
        return [WideFile(p, self.low, self.high, years) for p in paths] or [WideFile("", None, None, None)]

    def read(self, partition: WideFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _long(_store(self.path)[0], partition)


def _long(fs: pafs.FileSystem, part: WideFile) -> Iterator[pa.RecordBatch]:
    """A wide file's wanted columns, one batch a year; its rows are the countries, so it fits into memory."""
    from pyarrow import csv as pacsv

    code = part.path.rpartition("/")[2].removesuffix(".csv")
    with fs.open_input_stream(part.path) as file:
        data = file.read()
    header = next(csv.reader(io.StringIO(data.split(b"\n", 1)[0].decode())), [])
    wanted = []
    for at, name in enumerate(header[1:], 1):
        if name.strip().lstrip("-").isdigit():
            y = int(name)
            if (part.low is None or y >= part.low) and (part.high is None or y <= part.high) and (part.years is None or y in part.years):
                wanted.append((at, y))
    if not wanted:
        return
    names = [str(i) for i in range(len(header))]
    asked = ["0", *(str(at) for at, _ in wanted)]
    try:
        got = pacsv.read_csv(
            io.BytesIO(data), pacsv.ReadOptions(column_names=names, skip_rows=1), convert_options=pacsv.ConvertOptions(include_columns=asked, column_types=dict.fromkeys(asked, pa.string()))
        )
    except pa.ArrowInvalid:  # rows of another length than the header
        rows = [r for r in csv.reader(io.StringIO(data.decode())) if r][1:]
        got = pa.table({k: pa.array([r[int(k)] if int(k) < len(r) else None for r in rows], pa.string()) for k in asked})
    number = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
    for at, year in wanted:
        text = got.column(str(at)).combine_chunks()
        good = pc.fill_null(pc.match_substring_regex(text, number), False)
        value = pc.utf8_trim_whitespace(pc.if_else(good, text, pa.scalar(None, pa.string()))).cast(pa.float64())
        n = len(text)
        yield pa.RecordBatch.from_arrays([pa.array([code] * n, pa.string()), got.column("0").combine_chunks(), pa.array([year] * n, pa.int32()), value], ["indicator_code", "country_code", "year", "value"])


class WideWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, folder = _store(self.path)
        aside = f"{folder}/_staged/{self.job}/{uuid.uuid4().hex}"
        done: list[tuple[str, str, int]] = []
        code, countries, years = None, {}, set()

        def close() -> None:
            if code is not None:
                order = sorted(years)
                out = io.StringIO()
                lines = csv.writer(out, lineterminator="\n")
                lines.writerow(["country_code", *order])
                for c, cells in countries.items():
                    lines.writerow([c, *("" if cells.get(y) is None else repr(cells[y]) for y in order)])
                target = f"{aside}/{code}.csv"
                _put(fs, target, out.getvalue().encode())
                done.append((code, target, len(countries)))

        for batch in iterator:
            for i, c, y, v in zip(*(batch.column(k).to_pylist() for k in ("indicator_code", "country_code", "year", "value")), strict=True):
                if i != code:
                    close()
                    code, countries, years = i, {}, set()
                countries.setdefault(c, {})[y] = v
                years.add(y)
        close()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, folder = _store(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [code for code, _, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an indicator's rows were in several tasks: use write_wide")
        for code, staged, _ in files:
            fs.move(staged, f"{folder}/{code}.csv")
        if self.overwrite:
            for path in set(_listed(fs, folder, ".csv")) - {f"{folder}/{code}.csv" for code in names}:
                fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, folder = _store(self.path)
        if fs.get_file_info(f"{folder}/_staged/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/_staged/{self.job}")


def write_wide(observations: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Observations (indicator_code, country_code, year, value) as wide files, one an indicator; the mean of repeated cells is the caller's to take."""
    rows = observations.select("indicator_code", "country_code", "year", "value").where("indicator_code IS NOT NULL AND year IS NOT NULL")
    spread = rows.repartition("indicator_code").sortWithinPartitions("indicator_code", "country_code", "year")
    register(rows.sparkSession)
    spread.write.format("wide_indicators").mode(mode).save(path)


def read_wide(spark: SparkSession, path: str, indicators: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """Observations of wide files; ``indicators`` and ``years`` do what filters on the two columns do."""
    reader = register(spark).read.format("wide_indicators")
    for k, v in (("indicators", indicators), ("years", years)):
        reader = reader.option(k, json.dumps(v)) if v is not None else reader
    return reader.load(path)


# ---------------------------------------------------------------- an append log with epochs


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (file name, rows), none where it had no rows or the epoch was there already."""

    files: list[tuple[str, int]]


class EpochLog(DataSource):
    """Parquet files that count once a manifest names them: ``data/`` holds what tasks wrote, ``epochs/<epoch>.json`` what jobs committed.

    Each attempt of a task writes a file of its own and reports it only at its end, so neither failed nor repeated attempts are
    seen.  A job's commit puts the manifest in place at once; its abort deletes what its tasks report.  An epoch (option ``epoch``, or a stream's batch number after the
    option ``stream``) is written once: where its manifest is there, nothing is written, so a run that is taken up again, or a replayed batch, adds nothing twice.
    One job at a time may write an epoch.  Files that no manifest names are removed by ``vacuum``.
    """

    @classmethod
    def name(cls) -> str:
        return "epoch_log"

    def schema(self) -> StructType:
        fs, folder = _store(self.options["path"])
        files = _files(fs, folder)
        if not files:
            raise ValueError(f"no epoch was committed to {self.options['path']}: give a schema")
        with fs.open_input_file(files[0][0]) as f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a log is appended to")
        return LogWriter(self.options["path"], self.options["epoch"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return LogStreamWriter(self.options["path"], self.options.get("stream", "batch"), schema)


def _manifest(folder: str, epoch: str) -> str:
    if not epoch or "/" in epoch or epoch.startswith("."):
        raise ValueError(f"no name for an epoch: {epoch!r}")
    return f"{folder}/epochs/{epoch}.json"


def _files(fs: pafs.FileSystem, folder: str) -> list[tuple[str, int]]:
    """(path, rows) of all committed files, epoch by epoch."""
    out = []
    for m in _listed(fs, f"{folder}/epochs", ".json"):
        with fs.open_input_stream(m) as f:
            out += [(f"{folder}/data/{name}", n) for name, n in json.loads(f.read())["files"]]
    return out


@dataclass
class LogFile(InputPartition):
    path: str


class LogReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[LogFile]:
        fs, folder = _store(self.path)
        return [LogFile(p) for p, _ in _files(fs, folder)] or [LogFile("")]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with _store(self.path)[0].open_input_file(partition.path) as f:
                yield from pq.ParquetFile(f).iter_batches(columns=self.schema.names)


def _write_file(path: str, epoch: str, schema: StructType, iterator: Iterator[pa.RecordBatch]) -> Written:
    """A task's rows as one file, batch by batch; a file that breaks off is deleted."""
    fs, folder = _store(path)
    name, rows, out = f"{epoch}-{uuid.uuid4().hex}.parquet", 0, None
    arrow = to_arrow_schema(schema)
    try:
        for batch in iterator:
            if out is None:
                fs.create_dir(f"{folder}/data", recursive=True)
                out = pq.ParquetWriter(f"{folder}/data/{name}", arrow, filesystem=fs)
            out.write_table(pa.Table.from_batches([batch]).cast(arrow))
            rows += batch.num_rows
    except BaseException:
        if out is not None:
            out.close()
            fs.delete_file(f"{folder}/data/{name}")
        raise
    if out is None:
        return Written([])
    out.close()
    return Written([(name, rows)])


def _drop(path: str, messages: list[Written | None]) -> None:
    fs, folder = _store(path)
    for m in messages:
        for name, _ in m.files if m else []:
            if fs.get_file_info(f"{folder}/data/{name}").type == pafs.FileType.File:
                fs.delete_file(f"{folder}/data/{name}")


def _commit(path: str, epoch: str, messages: list[Written | None]) -> None:
    """The epoch's manifest, unless it is there: then what was written is dropped."""
    fs, folder = _store(path)
    target = _manifest(folder, epoch)
    if fs.get_file_info(target).type == pafs.FileType.File:
        _drop(path, messages)
        return
    _put(fs, target, json.dumps({"epoch": epoch, "files": [f for m in messages if m for f in m.files]}).encode())


class LogWriter(DataSourceArrowWriter):
    def __init__(self, path: str, epoch: str, schema: StructType):
        self.path, self.epoch, self.schema = path, epoch, schema
        fs, folder = _store(path)
        self.there = fs.get_file_info(_manifest(folder, epoch)).type == pafs.FileType.File

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written([]) if self.there else _write_file(self.path, self.epoch, self.schema, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        if not self.there:
            _commit(self.path, self.epoch, messages)

    def abort(self, messages: list[Written | None]) -> None:
        _drop(self.path, messages)


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, stream: str, schema: StructType):
        self.path, self.stream, self.schema = path, stream, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write_file(self.path, self.stream, self.schema, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        _commit(self.path, f"{self.stream}-{batchId:012d}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        _drop(self.path, messages)


def append_epoch(rows: DataFrame, path: str, epoch: str) -> int:
    """Append ``rows`` as an epoch, once; returns how many rows the epoch has, from its manifest."""
    register(rows.sparkSession)
    rows.write.format("epoch_log").mode("append").option("epoch", epoch).save(path)
    fs, folder = _store(path)
    with fs.open_input_stream(_manifest(folder, epoch)) as f:
        return sum(n for _, n in json.loads(f.read())["files"])


def read_log(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """All committed rows; an empty or missing log needs a schema."""
    reader = register(spark).read.format("epoch_log")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def vacuum(path: str) -> int:
    """Remove files that no manifest names (of attempts that were lost); no job may be writing.  Returns how many."""
    fs, folder = _store(path)
    named = {p for p, _ in _files(fs, folder)}
    lost = [p for p in _listed(fs, f"{folder}/data", ".parquet") if p not in named]
    for p in lost:
        fs.delete_file(p)
    return len(lost)
