"""Native text expressions (JVM-side, no Python per row).

The character classes below reproduce Python's ``str.isspace`` and
``str.splitlines`` so that stripping and line breaking agree with the
reference's Python string handling.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace set (str.isspace) as a Java regex class:
# \t \n \x0B \f \r space, \x1C-\x1F, \x85 and every Unicode space separator.
WS_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x85\p{Z}]"
NON_WS_CLASS = r"[^\t\n\x0B\f\r \x1C-\x1F\x85\p{Z}]"
# Line boundaries of Python's str.splitlines.
LINE_BREAK_CLASS = r"[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"

# Placeholder texts for empty inputs.
EMPTY_TXT_TEXT = "This is an empty text file."
EMPTY_DOC_TEXT = "This document ({name}) appears to be empty or could not be processed."
EMPTY_URL_TEXT = "This URL ({name}) appears to be empty or could not be processed."


def fill_template(template: str, name) -> Column:
    """``template`` with ``{name}`` replaced by the column value."""
    head, tail = template.split("{name}")
    return F.concat(F.lit(head), col_of(name), F.lit(tail))


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` with no argument."""
    return F.regexp_replace(col_of(c), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_blank(c) -> Column:
    """True when the string is empty or whitespace only (``not s.strip()``)."""
    return ~col_of(c).rlike(NON_WS_CLASS)


def squash_lines(c) -> Column:
    """Strip each line, split it on double spaces, strip the pieces, drop empty
    pieces and join the rest with newlines."""
    pieces = F.split(col_of(c), f"{LINE_BREAK_CLASS}|  ", -1)
    stripped = F.transform(pieces, lambda p: py_strip(p))
    return F.array_join(F.filter(stripped, lambda p: p != F.lit("")), "\n")


def normalize_newlines(c) -> Column:
    """Text-mode read: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(col_of(c), "\r\n?", "\n")


def empty_placeholder(text, name, kind: str = "file", ext=None) -> Column:
    """Placeholder text for documents that extracted to nothing.

    ``kind='file'``: blank ``.txt`` content (whitespace only) gets the text-file
    placeholder; any other empty text gets the document placeholder.
    ``kind='url'``: empty page text gets the URL placeholder.
    """
    t = col_of(text)
    n = col_of(name)
    if kind == "url":
        return F.when(t.isNull() | (t == ""), fill_template(EMPTY_URL_TEXT, n)).otherwise(t)
    doc_msg = fill_template(EMPTY_DOC_TEXT, n)
    is_txt = F.lit(True) if ext is None else (col_of(ext) == F.lit("txt"))
    return (F.when(is_txt & t.isNotNull() & is_blank(t), F.lit(EMPTY_TXT_TEXT))
            .when(t.isNull() | (t == ""), doc_msg)
            .otherwise(t))


def collection_name(username) -> Column:
    """Per-user collection ``user_{username}_docs``."""
    return F.concat(F.lit("user_"), col_of(username), F.lit("_docs"))


def display_name(c) -> Column:
    """``_`` becomes a space and the first character of each word run
    (letters, digits, underscore) is upper-cased; the rest is left as is."""
    spaced = F.replace(col_of(c), F.lit("_"), F.lit(" "))
    # Split before every word start, upper-case the first char of each piece.
    parts = F.split(spaced, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", -1)
    return F.array_join(
        F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                              F.substring(w, 2, 1 << 30))),
        "")


def clean_training_text(c) -> Column:
    """Strip, then newlines become spaces."""
    return F.replace(py_strip(c), F.lit("\n"), F.lit(" "))


def pair_parts(c) -> Column:
    """``question || answer`` split at the first mark (array of 1 or 2)."""
    return F.split(col_of(c), r"\s*\|\|\s*", 2)


def java_literal(sep: str) -> str:
    """Regex that matches ``sep`` literally (for ``split``)."""
    return "".join("\\" + ch if re.match(r"[\\.^$|?*+()\[\]{}]", ch) else ch for ch in sep)


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    An expression referenced inside a higher-order function's lambda is
    evaluated again for every element; binding it first keeps one
    evaluation per row."""
    return F.element_at(F.transform(F.array(col_of(value)), body), 1)
