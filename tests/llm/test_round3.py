"""Filter audit, byte-level BPE and vector codes against plain versions and the library."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ragloom.llm import byte_bpe, filter_audit, vector_codes

from .brute import sql
from .conftest import rows_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- operators of earlier rounds ----------------------------------------------------------------------------------


def test_columns_with_the_operators_own_names(docs):
    """Extra columns keep their values, whatever they are called."""
    from ragloom.llm.jaccard_join import one_per_component
    from ragloom.llm.line_dedup import dedup_lines
    from ragloom.llm.mixing import repeated_documents

    names = ["__c", "__new", "__hash", "__id", "__content", "__row", "__copy", "__copies", "at", "c", "new", "row", "content",
             "copies", "keys", "parity", "set_of", "taken"]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id", "text"])
    clash = plain.select("*", *(F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")).alias(n) for n in names)).checkpoint()
    for run in (lambda d: dedup_lines(d, short=True), one_per_component, repeated_documents):
        got = run(clash)
        assert got.columns == clash.columns
        assert rows_of(got, "doc_id", "text") == rows_of(run(plain), "doc_id", "text")
        assert all(r[n] == (None if r.doc_id is None else f"{n} of {r.doc_id}") for r in got.collect() for n in names)


def test_language_with_long_documents_only(spark):
    """A language whose documents are all longer than a fitting piece is learned."""
    from ragloom.llm.language_id import FIT_BYTES, identify_language

    rng = random.Random(4)
    words = {"en": ["the", "house", "with", "thing", "other", "which"], "de": ["das", "haus", "mit", "nicht", "andere", "welche"]}
    rows = [(i, " ".join(rng.choice(words["en"]) for _ in range(40)), "en") for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(words["de"]) for _ in range(FIT_BYTES // 4)), "de") for i in range(6)]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), ["doc_id", "lang"])
    assert all(r.lang == r.lang_pred for r in got.collect())


# ---- filter audit -------------------------------------------------------------------------------------------------


def fails_of(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    same = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
    if same and (row[0] is None or min(same) < row[0]):
        out.add("E")
    return out


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = [(r[3] or "", fails_of(r, rows), r[0] in good, r[0] in toxic) for r in rows]
    out, lost = {}, {}
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                hit = [s for s in left if x in s[1]]
                left = [s for s in left if x not in s[1]]
                out[part, order, step] = [len(left), len(hit), sum(x in s[1] for s in own) - len(hit),
                                          sum(s[1] == {x} for s in own), sum(s[2] for s in hit),
                                          sum(s[3] for s in hit)]
                lost[part, x] = lost.get((part, x), 0) + len(hit)
    return sorted((p, o, s, *v, lost[p, o[s - 1]]) for (p, o, s), v in out.items())


def test_filter_audit(spark, docs, no_docs, rows):
    more = [(200, "Repeat me " * 40, None, "s0", 1), (201, "Repeat me " * 40, None, "hot", 1),
            (None, "Repeat me " * 40, None, "hot", 1), (None, "only under no id", None, "hot", 1),
            (None, "only under no id", None, "hot", 1), (202, "A # B", None, "hot", 1), (203, "", None, "", 0)]
    rows = [tuple(r) for r in rows] + more
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = table.withColumn("part", F.lit("x")).withColumn("digest", F.lit("x")).withColumn("good", F.lit(1)).repartition(3)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (201, None, None)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(0))
    got = filter_audit.filter_audit(table, marked)
    measures = ["part", "filter_order", "step", *filter_audit.MEASURES]
    want = audit_by_hand(rows, labels)
    assert sorted(map(tuple, got.select(measures).collect())) == want
    columns, found = sql(filter_audit.ORACLE, documents=pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n"])
                         .astype({"doc_id": "Int64"}),
                         labels=pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    at = [columns.index(m) for m in measures]
    assert sorted(tuple(r[i] for i in at) for r in found) == want
    assert filter_audit.filter_audit(no_docs, marked).count() == 0
    empty = filter_audit.filter_audit(table, marked.limit(0)).agg(F.sum("good_lost"), F.sum("removed")).first()
    assert empty[0] == 0 < empty[1]


# ---- byte-level BPE -----------------------------------------------------------------------------------------------


def hostile_texts(n=4000):
    rng = random.Random(7)
    alphabet = "aabstrevldmAZ''''   \n\n\t\r9Ⅷ.!#é日　 　́😀​\x85\x1c\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    texts += ["we'll they're I've it's don't I'm he'd", "'S 'LL x'sx 'll'll ''s '' 's", " 's  's\n's", "   ", "a   ",
              "\n\n a", "x" * 5000, "ab" * 3000 + " " * 2000 + "'" * 700, "日本" * 900, "#" * 400 + "\t" * 300 + "z"]
    return texts


def test_ids_and_decoding_equal_the_library(reference):
    bpe = byte_bpe.ByteBPE(RANKS)
    texts = hostile_texts()
    for part in (texts, texts[::7], [""], []):
        ids, ends = bpe.encode(part)
        cut = [0, *ends.tolist()]
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(cut)] == [reference.encode_ordinary(t) for t in part]
        assert bpe.decode(ids, ends) == [t.encode() for t in part]


def test_every_code_point_is_split_as_by_the_library(reference):
    bpe = byte_bpe.ByteBPE(RANKS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c} {c}'s{c}" if i % 64 == 0 else c for i, c in enumerate(points))
    ids, _ = bpe.encode([text])
    assert ids.tolist() == reference.encode_ordinary(text)


def test_pretokens_of_the_scan():
    bpe = byte_bpe.ByteBPE(RANKS)
    words, ends = bpe.pretokens(["it's  a 12\n\nday", "", "''ll \t"])
    assert words == [b"it", b"'s", b" ", b" a", b" 12", b"\n", b"\n", b"day", b"''", b"ll", b" \t"]
    assert ends.tolist() == [8, 8, 11]
    # rows of the scan: a contraction and a run of blanks over the edge of a row
    text = "x" * (byte_bpe.ROW - 1) + "'re" + "." * (byte_bpe.ROW - 3) + " " * byte_bpe.ROW + "y"
    assert [len(w) for w in bpe.pretokens([text])[0]] == [byte_bpe.ROW - 1, 3, byte_bpe.ROW - 3, byte_bpe.ROW - 1, 2]


def test_memo_keeps_frequent_words(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_WORDS", 50)
    bpe = byte_bpe.ByteBPE(RANKS)
    rng = random.Random(3)
    for _ in range(20):
        text = " ".join(["qzqzcommon"] * 30 + ["".join(rng.choice("bdgkzq") for _ in range(9)) for _ in range(40)])
        assert bpe.encode([text])[0].tolist() == reference.encode_ordinary(text)
        assert len(bpe.memo.row) <= 50 and b" qzqzcommon" in bpe.memo.row


def test_encode_documents(spark, docs, no_docs, rows, reference):
    got = byte_bpe.encoding_digests(docs, RANKS, ["doc_id"])
    want = []
    for i, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    encoded = byte_bpe.encode_documents(docs, RANKS, ["doc_id", "text"])
    for _, text, ids, starts in encoded.collect():
        text = text or ""
        assert ids == reference.encode_ordinary(text)
        assert starts == np.cumsum([0, *(len(reference.decode_single_token_bytes(t)) for t in ids)])[:-1].tolist()
    back = byte_bpe.decode_documents(encoded, RANKS, ["text"])
    assert all(bytes(b) == (t or "").encode() for t, b in back.collect())
    assert byte_bpe.encoding_digests(no_docs, RANKS, ["doc_id"]).count() == 0
    assert byte_bpe.decode_documents(encoded.limit(0), RANKS, []).count() == 0


# ---- vector codes -------------------------------------------------------------------------------------------------


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the digest, in Python integers."""
    kept = [(i, [int(np.floor(np.float64(4096) * v)) for v in vec], label) for i, vec, label in rows
            if vec is not None and all(v is not None and np.isfinite(v) for v in vec)]
    wide = max((len(v) for _, v, _ in kept), default=0)
    wide = -(-wide // parts) * parts
    kept = [(i, v + [0] * (wide - len(v)), label) for i, v, label in kept]
    step = wide // parts
    first = {}
    for i, v, _ in sorted((k for k in kept if k[0] is not None), key=lambda k: k[:2]):
        first.setdefault(i, v)
    start = [first[i] for i in sorted(first)[:entries]] or [[0] * wide]
    books = [[v[p * step:(p + 1) * step] for v in start] for p in range(parts)]

    def nearest(x, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return gaps.index(min(gaps)), min(gaps)

    for turn in range(rounds + 1):
        found = [[nearest(v[p * step:(p + 1) * step], books[p]) for p in range(parts)] for _, v, _ in kept]
        if turn < rounds:
            for p, book in enumerate(books):
                for e in range(len(book)):
                    own = [v[p * step:(p + 1) * step] for (_, v, _), f in zip(kept, found, strict=True) if f[p][0] == e]
                    if own:
                        book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    error = [sum(g for _, g in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c, _ in f), e, total[label], sha)
            for (i, _, label), f, e in zip(kept, found, error, strict=True)]


def vectors_of(n, width, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, width)) * scale).astype(np.float32)
    x[n // 2:n // 2 + 20] = x[3]                    # ties and repeated vectors
    return [(int(i), [float(v) for v in row], int(i) % 3 if i % 7 else None) for i, row in zip(rng.permutation(n), x, strict=True)]


SCHEMA = "vec_id long, embedding array<{}>, label int"
OUT = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("kind, width, scale", [("float", 16, 1.0), ("double", 24, 1e5), ("double", 8, 1e12), ("double", 8, 1e300)])
def test_vector_codes(spark, kind, width, scale):
    rows = vectors_of(150, width, scale=scale if scale < 1e30 else 1e20)
    if scale > 1e30:
        rows = [(i, [v * (1e280 if i == 100 else 1.0) for v in vec], label) for i, vec, label in rows]
    rows += [(900, None, 1), (901, [1.0] * (width - 1) + [None], 1), (902, [float("nan")] * width, 1),
             (903, [float("inf")] * width, 1), (None, rows[4][1], 1), rows[9], rows[9]]
    table = spark.createDataFrame(rows, SCHEMA.format(kind)).withColumn("code", F.lit("x")).withColumn("g", F.lit("x"))
    got = rows_of(vector_codes.vector_codes(table.repartition(4), ["vec_id"], "label"), *OUT)
    want = codes_by_hand(rows)
    most = vector_codes.LARGE
    assert got == sorted(((i, c, min(e, most), min(t, most), s) for i, c, e, t, s in want), key=repr)


def test_vector_codes_edges(spark):
    schema = SCHEMA.format("float")
    assert vector_codes.vector_codes(spark.createDataFrame([], schema), ["vec_id"], "label").count() == 0
    ragged = [(1, [0.5] * 5, None), (2, [], 1), (3, [-0.25] * 11, 1), (3, [0.75] * 3, 1)]
    got = vector_codes.vector_codes(spark.createDataFrame(ragged, schema), ["vec_id"], "label")
    assert rows_of(got, *OUT) == sorted(codes_by_hand(ragged), key=repr)
    only = [(None, [1.0] * 8, 1), (None, [2.0] * 8, 1)]
    got = vector_codes.vector_codes(spark.createDataFrame(only, schema), ["vec_id"], "label")
    assert rows_of(got, *OUT) == sorted(codes_by_hand(only), key=repr)
    few = vectors_of(40, 8)
    got = vector_codes.vector_codes(spark.createDataFrame(few, schema), ["label", "vec_id"], parts=2, entries=3, rounds=2)
    assert rows_of(got, "vec_id", "code", "error") == sorted(
        ((i, c, e) for i, c, e, *_ in codes_by_hand(few, 2, 3, 2)), key=repr)


def test_vector_codes_sql(spark):
    rows = vectors_of(120, 16) + [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 2)]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "Int64"})
    columns, found = sql(vector_codes.ORACLE, embeddings=frame)
    at = [columns.index(c) for c in OUT]
    assert sorted(tuple(r[i] for i in at) for r in found) == sorted(codes_by_hand(rows))


def test_limbs_are_exact():
    rng = np.random.default_rng(0)
    for peak, width in ((1 << 12, 64), (1 << 27, 8), (1 << 29, 16), (1 << 30, 3)):
        x, c = rng.integers(-peak, peak, (50, width)), rng.integers(-peak, peak, (16, width))
        assert (vector_codes.inner_products(x, c) == x @ c.T).all()
        bits = vector_codes.limb_bits(width)
        parts = vector_codes.limbs(x, bits)
        assert (sum(p.astype(np.int64) << (bits * i) for i, p in enumerate(parts)) == x).all()
        assert max(np.abs(p).max() for p in parts) ** 2 * width < 2.0 ** 53
