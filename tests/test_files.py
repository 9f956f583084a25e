import json
import os

from ragloom.sources.files import (chunk_files, clear_extractors, extract_files, ingest_receipts,
                                   read_files, register_extractor)


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_file_formats(spark, tmpdir_path):
    d = tmpdir_path
    _write(d, "utf8.txt", "héllo wörld 😀".encode())
    _write(d, "latin.txt", "caf\xe9 cr\xe8me".encode("latin-1"))
    _write(d, "blank.txt", b"  \n\t ")
    _write(d, "crlf.txt", b"para one\r\n\r\npara two\rline")
    _write(d, "notes.MD", b"# Title\n\n*keep* markup")
    _write(d, "data.json", json.dumps({"b": [1, {"c": "naïve"}], "a": None}).encode())
    _write(d, "doc.xml", b"<r>head<a> x </a>tail<b/><c>y<d>z</d></c></r>")
    _write(d, "blob.bin", b"raw bytes")
    _write(d, "empty.bin", b"")
    _write(d, "a/x.txt", b"first")
    _write(d, "b/x.txt", b"second")
    ex = {os.path.relpath(r.path.replace("file:", ""), d): r
          for r in extract_files(read_files(spark, d)).collect()}
    assert ex["utf8.txt"].text == "héllo wörld 😀"
    assert ex["latin.txt"].text == "café crème"
    assert ex["blank.txt"].text == "This is an empty text file."
    assert ex["crlf.txt"].text == "para one\n\npara two\nline"
    assert ex["notes.MD"].text == "# Title\n\n*keep* markup" and ex["notes.MD"].ext == ".md"
    assert ex["data.json"].text == json.dumps({"b": [1, {"c": "naïve"}], "a": None}, indent=2)
    assert "\\u00ef" in ex["data.json"].text
    assert ex["doc.xml"].text == "head x  y z"  # tail text dropped, empty element leaves a double space
    assert ex["blob.bin"].text == "raw bytes"
    assert "empty.bin" not in ex  # Spark's file sources do not list zero-length files
    rows = spark.createDataFrame([("file:/x/empty.bin", bytearray(b""))], "path string, content binary")
    assert extract_files(rows).first().text == \
        "This document (empty.bin) appears to be empty or could not be processed."
    extracted = extract_files(read_files(spark, d))
    chunks = chunk_files(extracted, "user_a_docs", {"folder_name": "F"})
    ids = sorted(r.chunk_id for r in chunks.collect())
    assert ids.count("x_txt_doc_0") == 2  # same base name, same id (kept as in the reference)
    crlf = [r.text for r in chunks.where("doc_key = 'crlf_txt'").orderBy("chunk_index").collect()]
    assert crlf == ["para one\n\npara two\nline"]
    assert {r.folder_name for r in chunks.collect()} == {"F"}
    rec = {os.path.basename(r.path): r for r in ingest_receipts(extracted, chunks).collect()}
    assert rec["utf8.txt"].status == "success" and rec["utf8.txt"].chunks == 1


def test_strict_mode_and_registered_extractor(spark, tmpdir_path):
    d = tmpdir_path
    _write(d, "x.weird", b"abc")
    _write(d, "y.up", b"shout")
    _write(d, "bad.json", b"{not json")
    register_extractor("up", lambda b: b.decode().upper())
    try:
        ex = {os.path.basename(r.path): r for r in extract_files(read_files(spark, d), strict=True).collect()}
    finally:
        clear_extractors()
    assert ex["y.up"].text == "SHOUT"
    assert ex["x.weird"].extract_status.startswith("Unsupported file format")
    assert ex["bad.json"].extract_status.startswith("JSONDecodeError")


def test_element_extractor_joins_elements(spark, tmpdir_path):
    from ragloom.sources.files import register_element_extractor
    _write(tmpdir_path, "a.parts", b"one|two|three")
    register_element_extractor(".parts", lambda b: b.decode().split("|"), sep="\n\n")
    try:
        ex = extract_files(read_files(spark, tmpdir_path)).first()
    finally:
        clear_extractors()
    assert ex.text == "one\n\ntwo\n\nthree"


def test_native_xml_mode(spark, tmpdir_path):
    _write(tmpdir_path, "a.xml", "<r>head<a> x </a>tail<c>y<d>z</d></c><e>é</e></r>".encode())
    _write(tmpdir_path, "b.xml", b"<r>h<a/><d>y</d></r>")
    files = read_files(spark, tmpdir_path)
    py = {os.path.basename(r.path): r.text for r in extract_files(files).collect()}
    native = {os.path.basename(r.path): r.text for r in extract_files(files, xml_mode="native").collect()}
    assert native["a.xml"] == py["a.xml"] == "head x y z é"
    assert py["b.xml"] == "h  y" and native["b.xml"] == "h y"  # the documented difference


def test_survey_named_entry_points(spark, tmpdir_path):
    from ragloom.operators.web import extract_links, url_domain
    from ragloom.sources.files import chunk_file, read_corpus
    _write(tmpdir_path, "n.txt", b"one\n\ntwo")
    assert read_corpus(spark, tmpdir_path).first().text == "one\n\ntwo"
    assert [r.text for r in chunk_file(spark, tmpdir_path, chunk_size=3).orderBy("chunk_index").collect()] == \
        ["one", "two"]
    assert url_domain is not None and extract_links is not None


def test_expected_paths_bring_back_empty_files(spark, tmpdir_path):
    from ragloom.sources.files import extract_files, read_files

    for name, body in (("a.txt", "text"), ("b.txt", "")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    listing = spark.createDataFrame([(f"file:{os.path.join(tmpdir_path, n)}",) for n in ("a.txt", "b.txt")], "path string")
    got = {r["name"]: r["text"] for r in extract_files(read_files(spark, tmpdir_path, expected=listing)).collect()}
    assert got == {"a.txt": "text", "b.txt": "This is an empty text file."}
