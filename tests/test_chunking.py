import random

from pyspark.sql import functions as F

from ragloom.operators.chunking import chunk_text, explode_chunks, file_key


def check_packing(text, size, sep, chunks):
    """The properties of a packing: the non-blank paragraphs in order, each chunk within the size or one
    paragraph, and no chunk with room for the paragraph that opens the next one."""
    paras = [p for p in text.split(sep) if p.strip()]
    if not paras:
        assert chunks == [text]
        return
    at = 0
    for chunk in chunks:
        taken = next(k for k in range(1, len(paras) - at + 1) if sep.join(paras[at:at + k]) == chunk)
        chars = sum(map(len, paras[at:at + taken]))
        at += taken
        assert chars <= size or taken == 1
        assert at == len(paras) or chars + len(paras[at]) > size
    assert at == len(paras)


ALPHABET = ["a", "bc", " ", "\n", "\n\n", "\n\n\n", "\t", " ", " ", "é", "😀", "\x1c", "\r\n"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice(ALPHABET) * rnd.randint(1, 15) for _ in range(rnd.randint(0, 40))))
            for i in range(n)]


def test_chunk_text_matches_rule(spark):
    rows = random_texts(300, 7) + [(1000, ""), (1001, "   "), (1002, "x" * 2500), (1003, "a\n\n" + "b" * 1200 + "\n\nc")]
    df = spark.createDataFrame(rows, "id long, text string")
    for size, sep in [(20, "\n\n"), (60, "\n"), (1000, "\n\n"), (7, "bc")]:
        got = {r.id: list(r.c) for r in df.select("id", chunk_text(F.col("text"), size, sep).alias("c")).collect()}
        for i, t in rows:
            check_packing(t, size, sep, got[i])


def test_chunk_text_worked_examples(spark):
    cases = [("aa\n\nbb\n\ncc", 4, ["aa\n\nbb", "cc"]), ("aa\n\nbbb\n\nc", 4, ["aa", "bbb\n\nc"]),
             ("a\n\n \n\nb", 9, ["a\n\nb"]), ("", 5, [""]), (" \n\n\t", 5, [" \n\n\t"]),
             ("longer\n\nx\n\ny", 3, ["longer", "x\n\ny"])]
    for text, size, want in cases:
        df = spark.createDataFrame([(text,)], "text string")
        assert list(df.select(chunk_text(F.col("text"), size).alias("c")).first().c) == want


def test_lone_oversize_paragraph_stays_whole(spark):
    df = spark.createDataFrame([("p" * 1500 + "\n\nq",)], "text string")
    assert df.select(chunk_text(F.col("text")).alias("c")).first().c == ["p" * 1500, "q"]


def test_chunk_ids_and_file_key(spark):
    df = spark.createDataFrame([("/data/a/x.v1.txt", "one\n\ntwo")], "path string, text string")
    df = df.withColumn("k", file_key(F.col("path")))
    rows = explode_chunks(df, "k", "text", chunk_size=3).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == ["x_v1_txt_doc_0", "x_v1_txt_doc_1"]
    assert [r.text for r in rows] == ["one", "two"]
