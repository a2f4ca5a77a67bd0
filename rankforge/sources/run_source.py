"""A Spark data source of run files: split reading with pushed filters, writing with commit and abort.

``spark.dataSource.register(RunSource)`` names it ``rankforge_run``. Files are
reached through ``pyarrow.fs``, so on any file system that it knows (local and
shared folders, S3, GCS, HDFS). Byte offsets of lines stand for line numbers:
no split has to know what lies before it.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

SCHEMA = "qid string, docid string, rank int, score double, tag string, path string, start bigint"
_ARROW = pa.schema([("qid", pa.string()), ("docid", pa.string()), ("rank", pa.int32()), ("score", pa.float64()), ("tag", pa.string()), ("path", pa.string()), ("start", pa.int64())])
_READ, _ROWS = 1 << 23, 1 << 15


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.strict = options["path"], int(options.get("splitbytes", 1 << 27)), options.get("strict", "true") == "true"
        self.qids: set[str] | None = None
        self.depth: int | None = None

    def pushFilters(self, filters):
        """Takes equality of and membership in ``qid``, and upper bounds of ``rank``; gives back the others."""
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("qid",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.qids = wanted if self.qids is None else self.qids & wanted
            elif at == ("rank",) and isinstance(f, (LessThan, LessThanOrEqual)):
                most = value - isinstance(f, LessThan)
                self.depth = most if self.depth is None else min(self.depth, most)
            elif not isinstance(f, IsNotNull):  # no column ever is
                yield f

    def partitions(self):
        fs, at = _open(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=False))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Split(path, at, min(at + self.size, size)) for path, size in files for at in range(0, size, self.size)] or [Split("", 0, 0)]

    def _lines(self, split: Split) -> Iterator[tuple[int, bytes]]:
        """Lines that begin within the split, with their offsets."""
        fs, _ = _open(self.path)
        with fs.open_input_file(split.path) as f:
            at = max(split.start - 1, 0)
            f.seek(at)
            rest, skip = b"", split.start > 0
            while at < split.end:
                more = f.read(_READ)
                data = rest + more
                last = not more
                lines = data.split(b"\n")
                rest = b"" if last else lines.pop()
                for line in lines:
                    if not skip and at < split.end:
                        yield at, line
                    skip = False
                    at += len(line) + 1
                if last:
                    return

    def read(self, partition: Split):
        got: list[tuple] = []
        if not partition.path:
            return
        for start, line in self._lines(partition):
            f = line.decode("utf-8").split()
            if not f or (self.qids is not None and f[0] not in self.qids):
                continue
            try:
                qid, _, docid, rank, score, tag = f
                row = (qid, docid, int(rank), float(score), tag, partition.path, start)
            except ValueError:
                if self.strict:
                    raise ValueError(f"malformed run line at {partition.path}, byte {start}") from None
                continue
            if self.depth is None or row[2] <= self.depth:
                got.append(row)
            if len(got) == _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                got = []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class Writer(DataSourceArrowWriter):
    """Tasks write below ``_temporary``; the commit moves the files of the attempts that succeeded, an abort removes all."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.tag, self.overwrite, self.job = options["path"], options.get("tag", "rankforge"), overwrite, uuid.uuid4().hex
        self.columns = [f.name for f in schema.fields]
        if missing := {"qid", "docid", "rank", "score"} - set(self.columns):
            raise ValueError(f"a run needs {', '.join(sorted(missing))}")
        fs, path = _open(self.path)  # by the driver, so that a task that outlives an abort finds no folder to write to
        fs.create_dir(f"{path}/_temporary/{self.job}", recursive=True)

    def write(self, iterator):
        fs, path = _open(self.path)
        temporary = f"{path}/_temporary/{self.job}"
        part, rows = TaskContext.get().partitionId(), 0
        name = f"part-{part:05d}-{self.job}-{uuid.uuid4().hex[:8]}.run"
        with fs.open_output_stream(f"{temporary}/{name}") as out:
            for batch in iterator:
                columns = {c: batch.column(self.columns.index(c)).to_pylist() for c in self.columns}
                tags = columns.get("tag") or [self.tag] * batch.num_rows
                lines = [f"{q}\tQ0\t{d}\t{r}\t{s!r}\t{t}\n" for q, d, r, s, t in zip(*(columns[c] for c in ("qid", "docid", "rank", "score")), tags, strict=True)]
                out.write("".join(lines).encode())
                rows += batch.num_rows
        return Part(name, rows)

    def commit(self, messages):
        fs, path = _open(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file] if self.overwrite else []
        for part in messages:
            if part and part.rows:
                fs.move(f"{path}/_temporary/{self.job}/{part.name}", f"{path}/{part.name}")
        for file in old:
            fs.delete_file(file)
        with fs.open_output_stream(f"{path}/_SUCCESS"):
            pass
        self._clear(fs, path)

    def abort(self, messages):
        fs, path = _open(self.path)
        self._clear(fs, path)
        if fs.get_file_info(path).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(path)):
            fs.delete_dir(path)

    def _clear(self, fs: pafs.FileSystem, path: str) -> None:
        """Removes this job's files, and the folder of temporary files once no other job has any."""
        own, top = f"{path}/_temporary/{self.job}", f"{path}/_temporary"
        for _ in range(20):
            if fs.get_file_info(own).type != pafs.FileType.Directory:
                break
            with contextlib.suppress(OSError):  # a task that is being stopped may add a file meanwhile
                fs.delete_dir(own)
                break
            time.sleep(0.1)
        if fs.get_file_info(top).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(top)):
            fs.delete_dir(top)


class RunSource(DataSource):
    """Options: ``splitBytes``, ``strict`` (a malformed line is an error, else dropped), ``tag``."""

    @classmethod
    def name(cls):
        return "rankforge_run"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return Writer({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def use_run_source(spark: SparkSession) -> str:
    """Registers the source in a session, lets filters go down to it, and gives its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunSource)
    return RunSource.name()


def in_file_order(run: DataFrame) -> DataFrame:
    """Rows of the source with ``pos``, their order within their query in the files."""
    return run.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("path", "start")).cast("long"))
