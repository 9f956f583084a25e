"""Language id, token counts, packing, personal data and quality against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ragloom.llm import pii
from ragloom.llm.common import fold
from ragloom.llm.language_id import ContextTrees, encode_texts, identify_language, language_id
from ragloom.llm.packing import OnlinePacker, WordEncoder, pack_documents
from ragloom.llm.quality import BoostedTrees, quality_scores
from ragloom.llm.token_counts import TokenCounter, token_counts

from .conftest import rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_code_lengths_against_brute_force():
    samples = {"x": ["the cat sat on the mat " * 6, "that hat"], "y": ["le chat est sur la table " * 6]}
    trees = ContextTrees.fit(samples, order=4, min_count=1)
    counts = {}
    for lang, texts in samples.items():
        c = counts[lang] = defaultdict(Counter)
        for t in texts:
            d = bytes(encode_texts([t])[0][1:])
            for i in range(len(d)):
                for k in range(min(i, 4) + 1):
                    c[d[i - k:i]][d[i]] += 1

    def bits(lang, text):
        d, total = bytes(encode_texts([text])[0][1:]), 0.0
        for i in range(len(d)):
            for k in range(min(i, 4), -2, -1):
                if k < 0:
                    total += 8
                    break
                seen = counts[lang].get(d[i - k:i])
                if not seen:
                    continue
                n = sum(seen.values()) + len(seen)
                if seen[d[i]]:
                    total -= np.log2(seen[d[i]] / n)
                    break
                total -= np.log2(len(seen) / n)
        return total

    texts = ["the cat", "la table est", "zzz that", "", "chat hat"]
    got, _ = trees.code_lengths(texts)
    want = np.array([[bits(x, t) for x in trees.langs] for t in texts])
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-3)


def test_language_id(docs, no_docs, rows):
    got = rows_of(language_id(docs), "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    for i, text, lang, *_ in rows:
        if i is None:
            continue
        assert by_id[i][1] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not text or not re.search(r"[^\W\d_]", text):
            assert by_id[i][2:] == ("und", 0.0)
        elif lang and len(text) < 10_000:
            assert by_id[i][2] == lang and 0 <= by_id[i][3] <= 1
    assert language_id(no_docs).count() == 0
    unlabelled = identify_language(docs.withColumn("lang", F.lit(None).cast("string")), fold(F.col("doc_id"), 3) != 1, ["doc_id"])
    assert {r[0] for r in unlabelled.select("lang_pred").collect()} == {"und"}


def test_token_counter_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(2)
    texts = ["", " ", "  a", "a  b\n\n c", "▁▁a", "<s> x </s>", "日本 語", "😀", "a" * 3000, " " * 100, "x" + " " * 37, "\x00\t"]
    texts += ["".join(rng.choice("abcdeé  \n\t.,-=01▁日😀") for _ in range(rng.randint(1, 200))) for _ in range(1500)]
    lib = SentencePieceProcessor(model_file=PIECES)
    assert TokenCounter(PIECES)(texts).tolist() == [len(x) for x in lib.encode(texts)]


def test_token_counts(docs, no_docs, rows):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=PIECES)
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert rows_of(token_counts(docs, PIECES, ["doc_id"]), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts(no_docs, PIECES, ["doc_id"]).count() == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["", " ", "don't I'll", "İstanbul cİ,", "ΟΔΟΣ", "a<|endoftext|>b", "x́ ́y", "b c\x1cd", "'s", "é क़"]
    texts += ["".join(rng.choice("abcdeéÑ  \n\t.,-'st日😀ΣİÉ́|") for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    lib = Tokenizer.from_file(WORDS)
    want = [e.ids + [1] for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in WordEncoder(WORDS)(texts)] == want


def test_packer_keeps_every_id_once():
    rng = random.Random(4)
    packer, docs = OnlinePacker(window=64, limit=4), {}
    for key in range(300):
        docs[key] = np.arange(rng.randint(1, 200), dtype=np.uint32) + key * 1000
        packer.add(key, docs[key])
    packer.finish()
    windows = defaultdict(list)
    for key, start, ids, total, window, offset in packer.out:
        assert total == len(docs[key])
        windows[window].append((offset, len(ids)))
    for key, ids in docs.items():
        parts = sorted((s, p.tolist()) for k, s, p, *_ in packer.out if k == key)
        assert [x for _, p in parts for x in p] == ids.tolist()
    sizes = []
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 64 and sum(s < 64 for s in sizes) <= 1


def test_pack_documents(docs, no_docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    got = pack_documents(docs, WORDS, payload="ids").collect()
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        per_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], list(np.frombuffer(r["ids"], "<u4"))))
        per_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t, *_ in {r[0]: r for r in rows if r[0] not in (4,)}.values():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for _, p in sorted(per_doc[i, len(ids)]) for x in p] == ids
    for pieces in per_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
        total += 2048 - at
    assert total <= 3 * 2048        # one unfinished window per task before merging
    assert pack_documents(no_docs, WORDS).count() == 0


def brute_patterns(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    found = [(m.start(), 0, m.end()) for m in email.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        check = sum(int(c) if j % 2 == 0 else sum(map(int, str(2 * int(c)))) for j, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and check % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(found)


@pytest.mark.parametrize("letters", ["ab1290@@..+- ()é\n", "1290.. -+", "4111 1111-", "a@b.c@"])
def test_patterns_against_brute_force(letters):
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert pii.pattern_spans(t) == brute_patterns(t), t


def test_patterns_are_linear_on_long_runs():
    for t in ("a" * 300_000, "1" * 300_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 100_000):
        pii.pattern_spans(t)


def test_reconcile_takes_the_heaviest_set():
    rng = random.Random(7)
    for _ in range(200):
        spans = [(a := rng.randint(0, 20), rng.randint(0, 3), a + rng.randint(1, 8), float(rng.randint(1, 9)))
                 for _ in range(rng.randint(0, 7))]
        best = 0.0
        for mask in range(1 << len(spans)):
            s = sorted(x for i, x in enumerate(spans) if mask >> i & 1)
            if all(x[2] <= y[0] for x, y in zip(s, s[1:], strict=False)):
                best = max(best, sum(x[3] for x in s))
        weight = {}
        for a, k, b, w in spans:
            weight[a, k, b] = max(w, weight.get((a, k, b), 0))
        assert sum(weight[s] for s in pii.reconcile(spans)) == best


def test_gradients_and_tagger():
    rng = np.random.default_rng(0)
    model = pii.BiLstmCrf(hidden=3)
    sym, tag = rng.integers(0, pii.N_SYMBOL, (2, 5)), np.array([[0, 1, 2, 0, 3], [5, 6, 0, 0, 7]])
    _, grad = model.gradients(sym, tag)
    for name in ("o", "t", "hf", "cb", "xf"):
        at = tuple(int(rng.integers(s)) for s in model.p[name].shape)
        if name == "xf":
            at = (int(sym[0, 0]), 1)
        keep, eps = model.p[name][at], 1e-5
        loss = []
        for d in (eps, -eps):
            model.p[name][at] = keep + d
            loss.append(model.gradients(sym, tag)[0])
        model.p[name][at] = keep
        assert abs((loss[0] - loss[1]) / (2 * eps) - grad[name][at]) < 1e-4, name
    texts = ["some quiet words that run on and on for a good long while so that cuts can be taken of them " * 3]
    tagger = pii.fit_tagger(texts)
    held_sym, held_tag = pii.labelled_windows(texts, 200, seed=77)
    decoded, _ = tagger.decode(held_sym)
    assert (decoded == held_tag)[held_sym > 0].mean() > 0.97


def test_personal_data(spark, docs, no_docs, rows):
    planted = [(1000, "Mail a.b+c@mail.example.org, call +1 (532) 555-7857 or 10.0.0.255; 4111 1111 1111 1111!"),
               (1001, None), (1002, "call (532) 555-7857 now")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for i, t, *_ in [*rows, *planted]:
        base = brute_patterns(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got[i]["spans"].split(",")) | {""}
    assert got[1000]["n_email"] == got[1000]["n_phone"] == got[1000]["n_ip"] == got[1000]["n_card"] == 1
    assert got[1002]["n_added"] == 1
    assert pii.personal_data(no_docs).count() == 0


def test_trees_learn_and_flat_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees.fit(x[:500], y[:500])
    assert ((model.score(x[500:]) > 0.5) == y[500:]).mean() > 0.9
    binned = model._bin(x[:20], model.edges)
    for r in range(20):     # walk every tree by hand
        raw = model.base
        for t in range(len(model.value)):
            p = 0
            while p < model.feature.shape[1]:
                p = 2 * p + 1 + int(binned[r, model.feature[t, p]] > model.cut[t, p])
            raw += model.value[t, p - model.feature.shape[1]]
        assert abs(1 / (1 + np.exp(-raw)) - model.score(x[r:r + 1])[0]) < 1e-9


def test_quality(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(72)] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = rows_of(quality_scores(docs, labels), "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(rows)
    for i, held, score, predicted in got:
        assert 0 <= score <= 1 and predicted == int(score >= 0.7)
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    assert quality_scores(no_docs, labels).count() == 0
    assert {r[0] for r in quality_scores(docs, labels.limit(0)).select("score").collect()} == {0.5}


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    good = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out")
    assert good.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.93
