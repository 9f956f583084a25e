import json
import os

from pyspark.sql import functions as F

from ragloom import workflows
from ragloom.operators import registry
from ragloom.operators.prompts import assemble_prompts
from ragloom.operators.store import ChunkStore
from ragloom.session import scratch_path
from ragloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_pages_then_chat_and_ask(spark, tmpdir_path):
    st = ChunkStore(spark, scratch_path(spark, "wf-store"))
    pages = tables.pages(spark, SF)
    receipts = workflows.ingest_pages(pages, st, collection="user_web_docs", metadata={"folder_name": "crawl"})
    assert receipts.where("status = 'success'").count() == pages.count()
    stored = st.read()
    assert stored.count() == pages.count()  # no blank lines in page text: one chunk per page
    assert stored.where("folder_name = 'crawl' AND source_type = 'web'").count() == pages.count()

    first = stored.orderBy("chunk_id").first()
    reqs = spark.createDataFrame(
        [("q1", "web", "hello?", None, None), ("q2", "web", "doc?", None, first.document_name),
         ("q3", "web", "none?", "nowhere", None)],
        "query_id string, username string, query string, folder_name string, document_name string")
    parts = workflows.chat(stored, reqs)
    context = parts.where((F.col("kind") == "context") & F.col("scope").startswith('["U",')).orderBy("pos").collect()
    assert [r.text for r in context] == [r.text for r in stored.orderBy("doc_key", "chunk_index", "chunk_id").collect()]
    out = {r.query_id: r for r in assemble_prompts(parts, 10_000_000).collect()}
    assert out["q1"].prompt.endswith("Query: hello?") and out["q1"].response is None
    assert out["q1"].prompt.startswith("\n\n".join(r.text for r in context))
    assert out["q2"].prompt.startswith(first.text[:50])
    assert out["q3"].response == ("⚠️ No relevant documents found in folder 'nowhere'. "
                                  "Please ensure data is uploaded.")
    answered = {r.query_id: r for r in workflows.answer(
        stored, reqs, lambda texts: [f"{len(t)} characters" for t in texts], 4000).collect()}
    assert answered["q1"].response == f"{len(answered['q1'].prompt)} characters" and answered["q3"].prompt is None

    qs = spark.createDataFrame([(1, first.text.split("\n")[0]), (2, "qqqqzzzz")], "query_id long, query string")
    asked = {r.query_id: r for r in workflows.ask(stored, qs, 8000, selector="ALL").collect()}
    assert asked[1].prompt.startswith("Here are relevant documents:\n\n")
    assert asked[2].prompt is None and asked[2].response.startswith("⚠️ No relevant documents found")
    # no chunk fits: the question keeps its prompt, with an empty context
    tight = {r.query_id: r for r in workflows.ask(stored, qs, 1).collect()}
    assert tight[1].prompt.startswith("Here are relevant documents:\n\n\n\nNow answer")
    top = workflows.top_chunks(stored, qs, 3).orderBy("rank").collect()
    assert len(top) == 3 and top[0].score >= top[-1].score


def test_new_chunks_are_embedded_once(spark, tmpdir_path):
    seen = spark.sparkContext.accumulator(0)
    docs = os.path.join(tmpdir_path, "once")
    os.makedirs(docs)
    for name in "abc":
        with open(os.path.join(docs, f"{name}.txt"), "w") as f:
            f.write(f"text {name}")

    def provider(texts):
        seen.add(len(texts))
        return [[1.0, 2.0] for _ in texts]

    st = ChunkStore(spark, scratch_path(spark, "wf-once"))
    for _ in range(2):
        workflows.ingest_path(spark, docs, st, username="u", metadata={"team": "x", "folder_name": "f"}, provider=provider, dim=2)
        assert seen.value == 3
    rows = st.read().collect()
    assert len(rows) == 3 and all(r.metadata == {"team": "x", "folder_name": "f"} and r.embedding for r in rows)


def test_ask_by_stored_vectors(spark, tmpdir_path):
    from ragloom.operators.embedding import hashing_provider

    docs = os.path.join(tmpdir_path, "vec")
    os.makedirs(docs)
    for name, text in (("a", "apples and pears"), ("b", "ships and trains"), ("c", "pears only")):
        with open(os.path.join(docs, f"{name}.txt"), "w") as f:
            f.write(text)
    st, provider = ChunkStore(spark, scratch_path(spark, "wf-vec")), hashing_provider(64)
    workflows.ingest_path(spark, docs, st, username="ann", provider=provider, dim=64)
    qs = spark.createDataFrame([("x", "apples and pears"), ("y", "trains and ships")], "query_id string, query string")
    out = {r.query_id: r.prompt for r in workflows.ask(st.read(), qs, 500, provider=provider, k=1, dim=64).collect()}
    assert "apples and pears" in out["x"].split("Now answer")[0] and "ships and trains" in out["y"].split("Now answer")[0]


def test_curate_and_clear(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "d.json")
    with open(p, "w") as f:
        json.dump([{"text": "a? || b."}, {"text": " a? || b.\n"}, {"text": "plain"}], f)
    distinct, pairs, rejects = workflows.curate_training(spark, p)
    assert distinct.count() == 2 and pairs.count() == 1 and rejects.count() == 1

    st = ChunkStore(spark, scratch_path(spark, "wf-clear"))
    docs = os.path.join(tmpdir_path, "docs")
    os.makedirs(docs)
    with open(os.path.join(docs, "n.txt"), "w") as f:
        f.write("note")
    rec = workflows.ingest_path(spark, docs, st, username="ann", metadata={"folder_name": "f"})
    assert rec.first().status == "success"
    users = registry.users_from_documents(
        spark.createDataFrame([("ann", "f"), ("bob", "g")], "lang string, source string"))
    result, after = workflows.clear_user(st, users, ["ann", "bob"])
    res = {r.username: r.status for r in result.collect()}
    assert after.folders.count() == 0 and {r.username for r in after.users.collect()} == {"ann", "bob"}
    assert res == {"ann": True, "bob": False}
    assert st.read().where(F.col("collection") == "user_ann_docs").count() == 0
