import json
import os
import shutil

from ragloom.operators.store import ChunkStore
from ragloom.session import scratch_path
from ragloom.streaming.ingest import start_file_ingest, start_question_stream


def test_file_stream_replay_and_restart(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for name, body in [("a.txt", "one\n\ntwo"), ("b.txt", "three")]:
        with open(os.path.join(src, name), "w") as f:
            f.write(body)
    st = ChunkStore(spark, scratch_path(spark, "stream-store"))
    ckpt = scratch_path(spark, "stream-ckpt")
    q = start_file_ingest(spark, src, st, collection="user_t_docs", checkpoint=ckpt)
    q.awaitTermination()
    assert st.read().count() == 2
    # second drop: a new file plus a repeat of a.txt under another folder
    os.makedirs(os.path.join(src, "again"))
    shutil.copy(os.path.join(src, "a.txt"), os.path.join(src, "again", "a.txt"))
    with open(os.path.join(src, "c.txt"), "w") as f:
        f.write("four")
    q = start_file_ingest(spark, src, st, collection="user_t_docs", checkpoint=ckpt)
    q.awaitTermination()
    ids = sorted(r.chunk_id for r in st.read().collect())
    assert ids == ["a_txt_doc_0", "b_txt_doc_0", "c_txt_doc_0"]
    # restart from the same checkpoint with nothing new: no change
    q = start_file_ingest(spark, src, st, collection="user_t_docs", checkpoint=ckpt)
    q.awaitTermination()
    assert st.read().count() == 3

    qdir = os.path.join(tmpdir_path, "questions")
    os.makedirs(qdir)
    with open(os.path.join(qdir, "q1.json"), "w") as f:
        for rec in [{"query_id": "q1", "username": "t", "query": "what?"},
                    {"query_id": "q2", "username": "nobody", "query": "hm?"}]:
            f.write(json.dumps(rec) + "\n")
    out = scratch_path(spark, "prompts")
    q = start_question_stream(spark, qdir, st, out, scratch_path(spark, "questions-ckpt"), budget=8000)
    q.awaitTermination()
    got = {r.query_id: r for r in spark.read.parquet(out).collect()}
    assert got["q1"].prompt.startswith("one\n\ntwo\n\nthree\n\nfour\n\nAnswer concisely")
    assert got["q2"].response.startswith("⚠️ No relevant documents found in your documents")


def test_batch_ingest_with_embeddings(spark, tmpdir_path):
    import numpy as np

    from ragloom.operators.embedding import hashing_provider
    from ragloom.sources.files import read_files
    from ragloom.streaming.ingest import ingest_files

    src = os.path.join(tmpdir_path, "docs")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("alpha beta\n\ngamma")
    with open(os.path.join(src, "b.md"), "w") as f:
        f.write("# delta")
    st = ChunkStore(spark, scratch_path(spark, "ingest-store"))
    rec = {os.path.basename(r.path): r for r in
           ingest_files(read_files(spark, src), st, "user_e_docs", {"folder_name": "F"},
                        provider=hashing_provider(16), dim=16).collect()}
    assert rec["a.txt"].status == "success" and rec["a.txt"].chunks == 1
    rows = st.read().collect()
    assert {r.chunk_id for r in rows} == {"a_txt_doc_0", "b_md_doc_0"}
    for r in rows:
        assert len(r.embedding) == 16 and np.isclose(np.linalg.norm(r.embedding), 1.0)
        assert r.folder_name == "F" and r.collection == "user_e_docs"
