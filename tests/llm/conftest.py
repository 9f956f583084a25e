import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows(seed=5, n=60):
    """Mixed documents: prose of two invented languages, copies, repeats, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = {"aa": ["the", "and", "thend", "ofer", "ating", "hest", "tion", "wher", "inor", "ble"],
             "bb": ["le", "queré", "éaux", "ment", "dans", "çoi", "tre", "eau", "sur", "élle"]}

    def line(lang, k):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "er", "on"]) for _ in range(k)).capitalize() + "."

    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        text = "\n".join(line(lang, rng.randint(4, 30)) for _ in range(rng.randint(1, 5)))
        rows.append([i, text, lang, f"s{i % 4}" if i % 7 else "s0", len(text)])
    for i in range(n, n + 12):      # near copies and exact copies
        base = rows[i % 5]
        w = base[1].split(" ")
        if i % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w), base[2], "s1", base[4]])
    shared = "a line that very many documents of every source hold in common."
    for i in (3, 9, 12, 20, 33):
        rows[i][1] += "\n" + shared
    rows += [[n + 20, None, "aa", None, None], [n + 21, "", "bb", "s2", 0], [n + 22, " \n\t ", None, None, 4],
             [None, rows[2][1], "aa", "s1", 1], [n + 23, "word " * 30_000, "aa", "s2", 150_000],
             [n + 24, "12 34 !!", "aa", "s3", 8], rows[4][:], rows[4][:]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use for their own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "size", "n", "pos", "start", "words", "target", "a", "b", "row", "id", "kept"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3).checkpoint()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
