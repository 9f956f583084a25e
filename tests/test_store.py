from ragloom.operators import registry, store
from ragloom.operators.retrieval import scope_filter
from ragloom.session import scratch_path

COLS = "collection string, chunk_id string, doc_key string, chunk_index long, text string, " \
       "document_name string, folder_name string, source string, source_type string, content_type string"


def _rows(coll, key, n, tag="v1", folder=None):
    return [(coll, f"{key}_doc_{i}", key, i, f"{tag}-{key}-{i}", f"{key}.txt", folder, key, "file", "txt")
            for i in range(n)]


def test_add_if_absent_first_write_wins(spark):
    a = spark.createDataFrame(_rows("c1", "x", 3), COLS)
    b = spark.createDataFrame(_rows("c1", "x", 5, "v2") + _rows("c2", "y", 2), COLS)
    out = {r.chunk_id + "@" + r.collection: r.text for r in store.add_if_absent(a, b).collect()}
    assert len(out) == 7
    assert out["x_doc_0@c1"] == "v1-x-0" and out["x_doc_4@c1"] == "v2-x-4"


def test_first_write_wins_inside_batch(spark):
    rows = [("c", "k", "second", 2), ("c", "k", "first", 1), ("c", "k", "third", 3)]
    df = spark.createDataFrame(rows, "collection string, chunk_id string, text string, ingest_seq long")
    assert store.first_write_wins(df).first().text == "first"


def test_one_delivery_wins_whole_on_any_layout(spark):
    rows = [("c", f"k_doc_{i}", "k", i, f"{path}{i}", path) for path, n in (("b/x", 5), ("a/x", 3), ("z/x", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "collection string, chunk_id string, doc_key string, chunk_index long, text string, source string")
    for parts in (1, 3, 5, 7):
        got = store.first_write_wins(df.repartition(parts))
        assert sorted(r.text for r in got.collect()) == ["a/x0", "a/x1", "a/x2"]


def test_cleared_collection_still_exists(spark):
    st = store.ChunkStore(spark, scratch_path(spark, "store-empty"))
    st.add(spark.createDataFrame(_rows("user_a_docs", "x", 3), COLS))
    assert [(r.status, r.deleted) for r in st.clear(["user_a_docs"]).collect()] == [(True, 3)]
    assert [(r.status, r.existed, r.deleted) for r in st.clear(["user_a_docs"]).collect()] == [(True, True, 0)]
    assert st.add(spark.createDataFrame(_rows("user_a_docs", "x", 2), COLS)) == 2
    assert st.read().count() == 2


def test_chunk_store_replay_delete_clear(spark):
    st = store.ChunkStore(spark, scratch_path(spark, "store-test"))
    assert st.read().count() == 0
    batch = spark.createDataFrame(_rows("user_a_docs", "x", 3, folder="f1") + _rows("user_b_docs", "y", 2), COLS)
    assert st.add(batch) == 5
    assert st.add(batch) == 0  # replayed delivery adds nothing
    ids = spark.createDataFrame([("user_a_docs", "x_doc_1")], "collection string, chunk_id string")
    st.delete_ids(ids)
    assert st.read().count() == 4
    res = {r.collection: r for r in st.clear(["user_b_docs", "user_zz_docs"]).collect()}
    assert res["user_b_docs"].status and res["user_b_docs"].deleted == 2
    assert not res["user_zz_docs"].status and not res["user_zz_docs"].existed
    assert sorted(r.chunk_id for r in st.read().collect()) == ["x_doc_0", "x_doc_2"]
    assert len(st.versions()) == 3  # the replay published nothing
    assert st.read(st.versions()[0]).count() == 5  # older versions stay readable
    st.compact()
    assert sorted(r.chunk_id for r in st.read().collect()) == ["x_doc_0", "x_doc_2"]


def test_scope_filter_prunes_partitions(spark):
    st = store.ChunkStore(spark, scratch_path(spark, "store-prune"))
    st.add(spark.createDataFrame(_rows("user_a_docs", "x", 3, folder="f1") + _rows("user_b_docs", "y", 2), COLS))
    scoped = scope_filter(st.read_collection("user_a_docs"), "a", folder="f1")
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(collection,user_a_docs)" in pushed and "EqualTo(folder_n" in pushed, pushed
    assert scoped.count() == 3
    assert scope_filter(st.read(), "a", folder="f1").count() == 3


def test_inventory_and_counts(spark):
    df = spark.createDataFrame(_rows("c1", "x", 2) + [("c2", "z_doc_0", "z", 0, "t", None, None, "z", "web", "html")], COLS)
    inv = {r.chunk_id: r for r in store.inventory(df).collect()}
    assert inv["z_doc_0"].document_name == "Unknown" and inv["z_doc_0"].folder_name == "No folder"
    counts = {r.collection: (r.n, r.result_limit) for r in store.collection_counts(df).collect()}
    assert counts == {"c1": (2, 2), "c2": (1, 1)}


def _folders(reg, user):
    rows = reg.folders.where(f"username = '{user}'").collect()
    return [r.folder for r in sorted(rows, key=lambda r: (r.pos, r.folder))]


def test_registry_flows(spark):
    docs = spark.createDataFrame([("en", "s1"), ("en", "s2"), ("fr", "s1")], "lang string, source string")
    users = registry.users_from_documents(docs)
    req = spark.createDataFrame([("en", "s1"), ("en", "new"), ("xx", "s1"), ("en", "new")],
                                "username string, folder string")
    st = {(r.username, r.folder): r.status for r in registry.add_folders(users, req).collect()}
    assert st == {("en", "s1"): "exists", ("en", "new"): "added", ("xx", "s1"): "unknown_user"}
    updated = registry.apply_folder_adds(users, registry.add_folders(users, req))
    assert _folders(updated, "en") == ["s1", "s2", "new"]  # appended behind the known folders
    # several at once keep their order of arrival, whatever their names, also behind a later batch
    more = spark.createDataFrame([("en", "z", 4), ("en", "b", 5), ("en", "z", 9), ("en", "s2", 1), ("fr", "y", 8)],
                                 "username string, folder string, seq long")
    twice = registry.apply_folder_adds(updated, registry.add_folders(updated, more))
    assert _folders(twice, "en") == ["s1", "s2", "new", "z", "b"] and _folders(twice, "fr") == ["s1", "y"]
    assert _folders(registry.apply_folder_clears(twice, more.where("folder = 'y'")), "fr") == []
    arrived = spark.createDataFrame([("en", "b", 2), ("en", "a", 3), ("en", "c", 1), ("en", None, 0), ("it", None, 5)],
                                    "lang string, source string, doc_id long")
    first = registry.users_from_documents(arrived)
    assert _folders(first, "en") == ["c", "b", "a"] and _folders(first, "it") == []
    assert {(r.username, r.found, r.folder_count) for r in registry.lookup(first, spark.createDataFrame(
        [("it",), ("en",), ("xx",)], "username string")).collect()} == {("it", True, 0), ("en", True, 3), ("xx", False, 0)}
    folders = registry.user_folders(users, req.select("username")).collect()
    assert sorted((r.username, r.folder) for r in folders if r.username == "xx") == [("xx", None)]
    cleared = {r.username: (r.folder_count, r.status) for r in registry.clear_folders(users, req).collect()}
    assert cleared == {"en": (2, True), "xx": (0, False)}
    chunks = spark.createDataFrame(_rows("user_en_docs", "x", 1), COLS)
    k8 = store.clear_collections(chunks, users.users.select("collection"))
    both = {r.username: r.status for r in registry.clear_all(users, k8, users.users.select("username")).collect()}
    assert both == {"en": True, "fr": False}


def test_failed_version_is_skipped(spark):
    import os

    path = scratch_path(spark, "store-fail")
    st = store.ChunkStore(spark, path)
    st.add(spark.createDataFrame(_rows("c", "x", 2), COLS))
    local = path.replace("file:", "")
    os.makedirs(os.path.join(local, "data", "b000002"))  # a write that died: no manifest
    assert st.versions() == [1]
    assert st.add(spark.createDataFrame(_rows("c", "y", 1), COLS)) == 1
    assert st.versions() == [1, 3] and st.read().count() == 3


def test_add_writes_only_new_rows(spark):
    path = scratch_path(spark, "store-append")
    st = store.ChunkStore(spark, path)
    st.add(spark.createDataFrame(_rows("c", "x", 3), COLS))
    assert st.add(spark.createDataFrame(_rows("c", "x", 4), COLS)) == 1  # only x_doc_3 is new
    m = [e for e in st._manifest() if "folder" in e]
    assert [(e["folder"], e["rows"]) for e in m] == [("b000001", 3), ("b000002", 1)]
    assert spark.read.parquet(f"{path}/data/b000002").count() == 1


def test_replace_drops_stale_tail_chunks(spark):
    st = store.ChunkStore(spark, scratch_path(spark, "store-replace"))
    st.add(spark.createDataFrame(_rows("c", "x", 4) + _rows("c", "y", 1), COLS))
    st.add(spark.createDataFrame(_rows("c", "x", 2, "v2"), COLS), replace=True)
    got = {r.chunk_id: r.text for r in st.read().collect()}
    assert got == {"x_doc_0": "v2-x-0", "x_doc_1": "v2-x-1", "y_doc_0": "v1-y-0"}


def _ids(spark, rows):
    return spark.createDataFrame(rows, "collection string, chunk_id string")


def _seen(st):
    return sorted(((r.collection, r.chunk_id, r.text) for r in st.read().collect()), key=repr)


def test_null_collection_is_a_collection(spark):
    """A replay, a delete and a clear of another collection leave it alone; its own work on it."""
    st = store.ChunkStore(spark, scratch_path(spark, "store-null"), buckets=2, shards=2)
    rows = _rows("a", "x", 1) + _rows("b", "y", 1) + _rows(None, "z", 2)
    batch = spark.createDataFrame(rows, COLS)
    assert st.add(batch) == 4 and st.add(batch) == 0
    st.delete_ids(_ids(spark, [("a", "x_doc_0"), ("b", "z_doc_0"), (None, "y_doc_0")]))
    assert [k[1] for k in _seen(st)] == ["y_doc_0", "z_doc_0", "z_doc_1"]
    assert {(r.collection, r.status, r.deleted) for r in st.clear(["a", "b"]).collect()} == {("a", False, 0), ("b", True, 1)}
    assert [k[1] for k in _seen(st)] == ["z_doc_0", "z_doc_1"]
    st.delete_ids(_ids(spark, [(None, "z_doc_0")]))
    assert [k[:2] for k in _seen(st)] == [(None, "z_doc_1")]
    assert [r.chunk_id for r in st.read_collection(None).collect()] == ["z_doc_1"]
    assert st.add(spark.createDataFrame(_rows(None, "z", 1, "v2"), COLS), replace=True) == 1
    assert _seen(st) == [(None, "z_doc_0", "v2-z-0")]
    assert [(r.status, r.deleted) for r in st.clear([None]).collect()] == [(True, 1)] and _seen(st) == []
    assert sorted((r[0] for r in st.emptied().collect()), key=repr) == sorted(["b", None], key=repr)


def test_deliveries_are_told_apart_by_sequence(spark):
    """Two deliveries of one document with one source: the lower ingest_seq is stored whole, on any layout."""
    cols = COLS + ", ingest_seq long"
    rows = [(*r, seq) for seq, n, tag in ((7, 4, "late"), (2, 6, "first")) for r in _rows("c", "u", n, tag)]
    for parts in (1, 2, 5):
        st = store.ChunkStore(spark, scratch_path(spark, "store-seq"))
        assert st.add(spark.createDataFrame(rows, cols).repartition(parts)) == 6
        assert [t for _, _, t in _seen(st)] == [f"first-u-{i}" for i in range(6)]
    alike = spark.createDataFrame([r[:-1] for r in rows], COLS)
    got = {tuple(sorted(map(tuple, store.first_write_wins(alike.repartition(p)).select("chunk_id", "text").collect())))
           for p in (1, 2, 3, 5, 7)}
    assert len(got) == 1


def test_deletes_rewrite_only_touched_parts(spark):
    path = scratch_path(spark, "store-parts")
    st = store.ChunkStore(spark, path, buckets=4, shards=4)
    rows = [r for k in range(40) for r in _rows(f"c{k % 7}", f"k{k}", 3)]
    st.add(spark.createDataFrame(rows, COLS))
    st.delete_ids(_ids(spark, [("c1", "k1_doc_0"), ("c1", "k8_doc_2"), ("c9", "k1_doc_0")]))
    entries = [e for e in st._manifest() if "folder" in e]
    assert 1 <= len(entries[0]["hidden"]) <= 2 and entries[1]["rows"] < 60
    gone = {("c1", "k1_doc_0"), ("c1", "k8_doc_2")}
    assert {k[:2] for k in _seen(st)} == {r[:2] for r in rows} - gone
    again = store.ChunkStore(spark, path)           # the layout is the table's, not the caller's
    assert (again.buckets, again.shards) == (4, 4)
    before = again.versions()
    again.delete_ids(_ids(spark, [("c1", "not there")]))
    assert {k[:2] for k in _seen(again)} == {r[:2] for r in rows} - gone and len(again.versions()) == len(before) + 1


def test_small_folders_are_merged(spark, monkeypatch):
    monkeypatch.setattr(store, "MERGE_AFTER", 3)
    st = store.ChunkStore(spark, scratch_path(spark, "store-merge"))
    st.add(spark.createDataFrame(_rows("c", "big", 30), COLS))
    for i in range(6):
        assert st.add(spark.createDataFrame(_rows("c", f"s{i}", 2), COLS)) == 2
        assert len([e for e in st._manifest() if "folder" in e]) <= 3
    assert st.read().count() == 42 and st.read(st.versions()[0]).count() == 30


def test_a_version_is_published_once(spark):
    import pytest

    st = store.ChunkStore(spark, scratch_path(spark, "store-claim"))
    st.add(spark.createDataFrame(_rows("c", "x", 1), COLS))
    with pytest.raises(RuntimeError):
        st._publish(1, [])
    assert st.read().count() == 1


def test_texts_of_a_batch_are_shuffled_only_for_the_layout(spark, monkeypatch):
    plans, write = [], store.ChunkStore._write_batch

    def seen(self, df, n, embed=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, n, embed)

    monkeypatch.setattr(store.ChunkStore, "_write_batch", seen)
    rows = _rows("c", "x", 4) + _rows("c", "y", 4) + _rows(None, "x", 2)
    twice = rows[:2] + [(*_rows("c", "y", 1)[0][:4], "other text", *_rows("c", "y", 1)[0][5:])]
    late = [(*r[:7], "z/late", *r[8:]) for r in _rows("c", "x", 6, "late")]
    batch = spark.createDataFrame(rows + twice + late, COLS)
    want = sorted(map(repr, store.first_write_wins(store.conform(batch)).collect()))
    st = store.ChunkStore(spark, scratch_path(spark, "store-layout"))
    assert st.add(batch) == 10
    assert sorted(map(repr, st.read().collect())) == want
    assert st.add(batch.where("doc_key = 'x'")) == 0
    more = spark.createDataFrame(_rows("c", "x", 9), COLS)
    assert st.add(more) == 5
    assert st.read().count() == 15
    assert len(plans) == 3 and not any("Exchange hashpartitioning" in p or "SortMergeJoin" in p for p in plans)
