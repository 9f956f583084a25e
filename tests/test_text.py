import random

from pyspark.sql import functions as F

from ragloom.functions.text import (display_name, empty_placeholder, is_blank, py_strip,
                                    squash_lines)


def check_squash(text, squashed):
    """No piece is blank, padded or holds two spaces in a row, and every visible character stays in order."""
    if squashed:
        for piece in squashed.split("\n"):
            assert piece and piece == piece.strip() and "  " not in piece and piece.splitlines() == [piece]
    assert "".join(squashed.split()) == "".join(text.split())


def test_py_strip_matches_python_whitespace(spark):
    # every BMP code point that Python calls whitespace, plus some that it does not
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    others = ["​", "﻿", "x", "᠎"]
    rows = [(i, f"{ch}a{ch}b{ch}") for i, ch in enumerate(spaces + others)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = dict(df.select("id", py_strip(F.col("s")).alias("t")).collect())
    for i, s in rows:
        assert got[i] == s.strip(), (i, repr(s))


def test_is_blank(spark):
    df = spark.createDataFrame([("",), (" \t　",), (" a ",)], "s string")
    assert [r.b for r in df.select(is_blank(F.col("s")).alias("b")).collect()] == [True, True, False]


def test_squash_lines_matches_rule(spark):
    rnd = random.Random(3)
    parts = ["a", "b c", "  ", "   ", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "\t", "é"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = dict(df.select("id", squash_lines(F.col("s")).alias("t")).collect())
    for i, s in rows:
        check_squash(s, got[i])


def test_squash_lines_worked_examples(spark):
    cases = [("a b", "a b"), ("a  b", "a\nb"), (" a \r\n\n b   c ", "a\nb\nc"), ("", ""), (" \n\t", ""),
             ("x\x0by\x85z", "x\ny\nz"), ("one two  three", "one two\nthree"), ("a \t b", "a \t b")]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "id long, s string")
    got = dict(df.select("id", squash_lines(F.col("s")).alias("t")).collect())
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_display_name_keeps_rest_of_word(spark):
    df = spark.createDataFrame([("user_alice_docs",), ("user_McDonald_docs",), ("a-b_c9x",)], "c string")
    got = [r.d for r in df.select(display_name(F.col("c")).alias("d")).collect()]
    assert got == ["User Alice Docs", "User McDonald Docs", "A-B C9x"]


def test_empty_placeholders(spark):
    df = spark.createDataFrame([("  \n", "a.txt"), ("", "b.bin"), ("x", "c.txt")], "t string, n string")
    txt = [r.p for r in df.select(empty_placeholder(F.col("t"), F.col("n")).alias("p")).collect()]
    assert txt[0] == "This is an empty text file." and txt[2] == "x"
    other = df.select(empty_placeholder(F.col("t"), F.col("n"), ext=F.lit("bin")).alias("p")).collect()
    assert other[1].p == "This document (b.bin) appears to be empty or could not be processed."
    url = df.select(empty_placeholder(F.col("t"), F.col("n"), kind="url").alias("p")).collect()
    assert url[1].p == "This URL (b.bin) appears to be empty or could not be processed."
