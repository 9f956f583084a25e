"""The corpus source lists every file, reports each one, and goes on after a restart."""

import os

import pytest

from ragloom.sources import corpus
from ragloom.sources.files import extract_files


def _write(folder, files, age=10):
    import time

    for name, body in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body)
        os.utime(path, (time.time() - age, time.time() - age))


@pytest.fixture
def folder(tmp_path):
    _write(str(tmp_path), {"a.txt": b"one\r\ntwo", "empty.txt": b"", "sub/empty.md": b"", "sub/b.json": b'{"k": [1]}',
                           "_SUCCESS": b"", ".hidden/x.txt": b"no", "big.txt": b"z" * 5000})
    return str(tmp_path)


def test_every_file_is_a_row(spark, folder):
    rows = {os.path.basename(r.path) + "@" + r.path.count("/sub/") * "sub": r for r in corpus.read_corpus_files(spark, folder).collect()}
    assert set(rows) == {"a.txt@", "empty.txt@", "empty.md@sub", "b.json@sub", "big.txt@"}
    assert {r.status for r in rows.values()} == {"ok"}
    assert (bytes(rows["empty.txt@"].content), rows["empty.txt@"].length, rows["big.txt@"].length) == (b"", 0, 5000)
    assert {r.path for r in corpus.read_corpus_files(spark, "file://" + folder, glob="*.md").collect()} == {
        "file:" + os.path.join(folder, "sub/empty.md")}


def test_zero_length_files_get_their_placeholder(spark, folder):
    got = {r["name"]: r.text for r in extract_files(corpus.read_corpus_files(spark, folder)).collect()}
    assert got["empty.txt"] == "This is an empty text file."
    assert got["empty.md"].startswith("This document (empty.md) appears to be empty") and got["a.txt"] == "one\ntwo"


def test_unreadable_file_is_reported(folder):
    files = corpus.list_files(folder)
    os.remove(os.path.join(folder, "a.txt"))                # gone between the listing and the read
    rows = {os.path.basename(r[0]): r for r in corpus.read_file_rows(folder, corpus.Files(files))}
    assert rows["a.txt"][3] is None and rows["a.txt"][4].startswith("FileNotFoundError") and rows["big.txt"][4] == "ok"


def test_files_are_dealt_by_size(folder):
    parts = corpus.deal(corpus.list_files(folder), partition_bytes=3 * corpus.FILE_BYTES)
    assert [len(p.files) for p in parts] in ([3, 1, 1], [2, 2, 1], [2, 1, 2], [1, 2, 2], [1, 3, 1], [1, 1, 3])
    assert sorted(f for p in parts for f in p.files) == corpus.list_files(folder)
    assert corpus.deal([]) == []


def test_empty_and_missing_folder(spark, tmp_path):
    assert corpus.read_corpus_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        corpus.list_files(str(tmp_path / "none"))


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    out, progress = str(tmp_path / "_out"), str(tmp_path / "_progress")

    def run():
        stream = corpus.stream_corpus_files(spark, folder, maxFilesPerTrigger="2")
        query = (stream.select("path", "length").writeStream.format("parquet").option("checkpointLocation", progress)
                 .trigger(processingTime="0 seconds").start(out))
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(out).collect())

    first = ["a.txt", "b.json", "big.txt", "empty.md", "empty.txt"]
    assert run() == first
    assert run() == first                                   # nothing new, nothing twice
    _write(folder, {"later.txt": b"", "sub/last.txt": b"x"}, age=5)
    _write(folder, {"young.txt": b"still being written"}, age=-60)
    assert run() == sorted([*first, "later.txt", "last.txt"])
