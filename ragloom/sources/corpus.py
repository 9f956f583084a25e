"""A corpus folder as a Spark data source, batch and stream, with its own listing.

Spark's file sources leave zero-length files out and stop at a file that cannot be read.  This source lists a
folder itself, so every file is a row: ``status`` is ``ok``, or says why ``content`` is null.  Files are dealt to
partitions by size.  Paths are URIs that ``pyarrow.fs`` knows (local, hdfs, s3, gs).

``spark.dataSource.register(CorpusSource)``, then ``spark.read.format("corpus").load(path)`` or ``readStream``;
``read_corpus_files`` and ``stream_corpus_files`` do both.  Options: ``glob`` (of the base name),
``partitionBytes``, ``maxFilesPerTrigger`` and ``settleSeconds`` (streams).
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PARTITION_BYTES = 64 * 1024 * 1024
PARTITION_FILES = 1000
FILE_BYTES = 4096               # a file counts as so many bytes more than it has
MAX_FILES = 1000                # files of one micro-batch
SETTLE_SECONDS = 2.0            # a stream takes files that are at least so old
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary, status string"


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, int]]):
        self.files = files


def list_files(uri: str, glob: str | None = None) -> list[tuple[int, str, int]]:
    """(modification time in ns, path, length) of every file below ``uri`` (or of the file itself), in this order.
    Names that start with ``_`` or ``.`` are no data, as for Spark's own sources."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    top = system.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    inside = [i for i in found if i.type == fs.FileType.File and not any(
        p.startswith(("_", ".")) for p in i.path[len(root):].split("/") if p)]
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in inside if glob is None or fnmatch.fnmatch(i.base_name, glob))


def deal(files: list[tuple[int, str, int]], partition_bytes: int = PARTITION_BYTES) -> list[Files]:
    """Files dealt to partitions of about ``partition_bytes`` (a larger file is one of its own)."""
    out: list[list] = []
    size = 0
    for f in files:
        n = f[2] + FILE_BYTES
        if not out or size + n > partition_bytes or len(out[-1]) >= PARTITION_FILES:
            out.append([])
            size = 0
        out[-1].append(f)
        size += n
    return [Files(part) for part in out]


def read_file_rows(uri: str, part: Files) -> Iterator[tuple]:
    """One row per file; a file that cannot be read has its error and no content."""
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    scheme = uri.split(":", 1)[0] if "://" in uri or uri.startswith("file:") else "file"
    for mtime, path, length in part.files:
        when = datetime.fromtimestamp(mtime / 1e9, timezone.utc)
        name = f"{scheme}:{path}" if scheme == "file" else f"{scheme}://{path}"
        try:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            yield name, when, len(content), content, "ok"
        except (OSError, ValueError) as error:
            yield name, when, length, None, f"{type(error).__name__}: {error}"


class CorpusReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.glob = options["path"], options.get("glob")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self):
        return deal(list_files(self.uri, self.glob), self.partition_bytes) or [Files([])]

    def read(self, partition):
        return read_file_rows(self.uri, partition)


class CorpusStreamReader(DataSourceStreamReader):
    """A place in the stream is the last (modification time, path) taken.  Only files that have not changed for
    ``settleSeconds`` are taken, so that no file appears behind a place that has been passed; a file that is written
    again comes again, with its new time."""

    def __init__(self, options):
        self.uri, self.glob = options["path"], options.get("glob")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.most = int(options.get("maxFilesPerTrigger", MAX_FILES))
        self.settle = float(options.get("settleSeconds", SETTLE_SECONDS))
        self.place = None

    def initialOffset(self):
        return {"time": "0", "path": ""}

    @staticmethod
    def _key(offset) -> tuple[int, str]:
        return int(offset["time"]), offset["path"]

    def latestOffset(self):
        start = self._key(self.place or self.initialOffset())
        until = time.time_ns() - int(self.settle * 1e9)
        new = [f for f in list_files(self.uri, self.glob) if start < f[:2] and f[0] <= until][:self.most]
        if new:
            self.place = {"time": str(new[-1][0]), "path": new[-1][1]}
        return self.place or self.initialOffset()

    def partitions(self, start, end):
        if self.place is None or self._key(self.place) < self._key(end):
            self.place = end            # after a restart: go on where the checkpoint stands
        low, high = self._key(start), self._key(end)
        return deal([f for f in list_files(self.uri, self.glob) if low < f[:2] <= high], self.partition_bytes)

    def read(self, partition):
        return read_file_rows(self.uri, partition)

    def commit(self, end):
        pass


class CorpusSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CorpusReader(self.options)

    def streamReader(self, schema):
        return CorpusStreamReader(self.options)


def read_corpus_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every file below ``path``, zero-length ones too: path, modificationTime, length, content, status."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus").options(**options).load(path)


def stream_corpus_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream of files as they arrive."""
    spark.dataSource.register(CorpusSource)
    return spark.readStream.format("corpus").options(**options).load(path)
