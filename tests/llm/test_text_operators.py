"""Operators on single texts against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from recon.llm import packing, pii, spotsigs, substring_dedup, token_counts, toxicity
from recon.llm.common import table
from recon.llm.queries import PIECE_MODEL, WORD_MODEL, vocabulary
from recon.llm.words import Words, windows


def key(row):
    return (row[0] is not None, row)


def test_words_and_windows():
    array = pa.array(["a b  c", None, "", "  x\ny ", "abcd ABCD", "é b"])
    words = Words(array, fold=True)
    assert [bytes(words.raw[a:b]).decode() for a, b in zip(words.starts, words.ends)] == ["a", "b", "c", "x", "y", "abcd", "abcd", "é", "b"]
    assert words.bounds.tolist() == [0, 3, 3, 3, 5, 7, 9]
    h = words.hashes()
    assert h[1] == h[-1] and h[5] == h[6] and len(set(h.tolist())) == 7
    assert windows(h, words.bounds, 2)[1].tolist() == [0, 1, 3, 5, 7]


def test_word_hashes_across_blocks():
    text = " ".join(str(i % 977) for i in range(700_000))
    h = Words(pa.array([text])).hashes()
    assert len(set(h.tolist())) == 977 and (h[:977] == h[977 * 700: 977 * 701]).all()


# toxicity

def auc(truth, score):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    truth = np.asarray(truth, bool)
    return (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()
    truth = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == 1000
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    assert auc(*zip(*held)) > 0.85
    clean = [r.predicted for r in got if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean(clean) < 0.05


def test_toxicity_edges(edge, empty, labels, edge_rows):
    got = toxicity.classify(edge, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(edge, labels.limit(0)).collect()} == {0}
    kept = toxicity.keep_clean(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_learner_keeps_few_coordinates():
    pick = np.random.default_rng(1)
    rows = [np.unique(np.append(pick.integers(10, 1000, 40), 5 if i % 4 == 0 else 6)) for i in range(400)]
    bias, at, w = toxicity.ftrl(rows, np.array([float(i % 4 == 0) for i in range(400)]), toxicity.Settings(bits=10))
    assert len(at) < 300 and dict(zip(at.tolist(), w))[5] > 1


# substring dedup

def dedup_by_hand(rows, window=20):
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=key):
        w = (text or "").encode().split()
        for k in range(len(w) - window + 1):
            at = (doc_id is not None, doc_id or 0, k)
            g = tuple(w[k: k + window])
            seen[g] = min(seen.get(g, at), at)
    for doc_id, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k: k + window])] < (doc_id is not None, doc_id or 0, k):
                gone[k: k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window, shortest", [(20, 5), (8, 3)])
def test_substring_dedup(edge, empty, edge_rows, window, shortest):
    got = substring_dedup.remove_repeats(edge, window, shortest).collect()
    assert sorted([tuple(r) for r in got], key=key) == dedup_by_hand(edge_rows, window)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_lengths_double():
    assert substring_dedup.lengths(20, 5) == [5, 10, 20] and substring_dedup.lengths(50, 5) == [25, 50]


def test_filter_denies_nothing_put_in(spark):
    from pyspark.sql import functions as F

    hashes = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    made = substring_dedup.filter_of(hashes)
    inside = np.array([r.hash for r in hashes.collect()]).view(np.uint64)
    assert made.has(inside).all() and made.has(inside ^ np.uint64(12345)).mean() < 0.02
    assert substring_dedup.filter_of(hashes.limit(0)) is None


# token counts

def test_token_counts(edge, empty, edge_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    want = sorted([(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 50) for i, t in edge_rows], key=key)
    for head in (20, 200_000):
        got = token_counts.count_tokens(edge, vocabulary(PIECE_MODEL), limit=50, head=head).collect()
        assert sorted([tuple(r) for r in got], key=key) == want
    assert token_counts.count_tokens(empty, vocabulary(PIECE_MODEL)).count() == 0


def test_pieces_of_pre_tokens_add_up():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    count, pick = token_counts.PieceCounter(vocabulary(PIECE_MODEL)), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "▁", "日本", "<s>", "12", "　", "!", "\x00", "ﬁ", "😀"]
    for _ in range(2000):
        text = "".join(pick.choices(parts, k=pick.randint(0, 10)))
        assert sum(count(token_counts.pre_tokens(text))) == len(model.encode(text)), repr(text)


# fingerprints

def marks_by_hand(text):
    common, out = set(spotsigs.ANCHORS.split()), set()
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [w for w in words if w not in common]
    seen = 0
    for w in words:
        if w in common:
            if seen < len(content):
                out.add(":".join([w, *content[seen: seen + spotsigs.CHAIN]]))
        else:
            seen += 1
    return out or ({" ".join(words)} if words else set())


def test_fingerprints(edge, empty, edge_rows):
    got = spotsigs.fingerprints(edge).collect()
    assert len(got) == len(edge_rows)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = {(r.doc_id, r.edited_sha256): r for r in got}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[doc_id, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(text) and (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
        a, b, c = marks_by_hand(text), marks_by_hand(edited), marks_by_hand(after)
        for value, other in ((r.near_edited, b), (r.near_next, c)):
            want = len(a & other) / len(a | other) if a | other else 1.0
            assert value == pytest.approx(want, abs=0.01), doc_id
    assert len({r.fingerprint for r in got if r.doc_id in (0, 1, 14)}) == 1
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(edge.where("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_near_fingerprints(edge, edge_rows):
    members, pairs = spotsigs.near_pairs(edge, 0.8)
    classes = {}
    for doc_id, text in edge_rows:
        if doc_id is not None:
            classes.setdefault(frozenset(marks_by_hand(text or "")), []).append(doc_id)
    names = {s: min(ids) for s, ids in classes.items()}
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(i, names[s]) for s, ids in classes.items() for i in ids}
    sets = [s for s in names if s]
    want = {(min(names[a], names[b]), max(names[a], names[b])) for a in sets for b in sets
            if names[a] < names[b] and len(a & b) >= 0.8 * len(a | b)}
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == want


# personal data

def spans_by_hand(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15))
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


@pytest.fixture(scope="module")
def personal(spark, tmp_path_factory):
    from tests.llm.conftest import write_docs

    pick = random.Random(3)
    parts = ["1", "2.3", "4111 1111-1111 1111", "0", "@", "a", "b.c", "%", "-", " ", ".", "+1", "(234) 567", "é", "😀", "192.168.0.1",
             "x@y.z", "\n", "4111111111111111", "card ", "GB82WEST12345698765432", "378282246310005", " 300.1.1.1", "+49 30.123-456"]
    rows = [(i, "".join(pick.choices(parts, k=pick.randint(0, 14)))) for i in range(1500)]
    rows += [(2000, "1.2.3.4 " * 700), (2001, "a" * 300_000), (2002, "+1" + "(" * 50_000), (2003, "1 " * 50_000)]
    return rows, spark.read.parquet(write_docs(tmp_path_factory.mktemp("pii") / "d.parquet", rows))


def test_personal_data(personal):
    rows, docs = personal
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for doc_id, text in rows:
        if doc_id <= 2000:
            want = spans_by_hand(text)
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            r = got[doc_id]
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined), repr(text)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
    assert any("iban:" in r.spans for r in got.values()) and any("pan:" in r.spans for r in got.values())
    assert [got[i].spans for i in (2001, 2002, 2003)] == ["", "", ""]


def test_redaction(personal, edge, empty, edge_rows):
    rows, docs = personal
    small = docs.where("doc_id < 300")
    found = {r.doc_id: r.spans for r in pii.personal_data(small).collect()}
    for r in pii.redact(small).collect():
        spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in found[r.doc_id].split(",") if x))
        text, out, upto = dict(rows)[r.doc_id], "", 0
        for a, b, k in spans:
            if a >= upto:
                out += text[upto:a] + f"[{k}]"
            upto = max(upto, -b)
        assert r.text == out + text[upto:]
    clean = pii.redact(edge)
    assert clean.columns == edge.columns and clean.count() == len(edge_rows)
    by = {r.doc_id: r.text for r in clean.collect()}
    assert by[15] == "mail me: [email] or [phone], card [card], [ip] and 10.0.0.256" and by[3] is None and by[4] == ""
    assert pii.personal_data(empty).count() == 0 and pii.redact(empty).count() == 0


# packing

def test_closest_fill():
    pick = random.Random(5)
    for _ in range(200):
        lengths = [pick.randint(1, 50) for _ in range(pick.randint(1, 12))]
        reach = {0}
        for x in lengths:
            reach |= {r + x for r in reach if r + x <= 60}
        counts = {x: lengths.count(x) for x in lengths}
        chosen = packing.closest_fill(counts, 60)
        assert sum(chosen) == max(reach) and all(chosen.count(k) <= n for k, n in counts.items())
        assert sorted(i for w in packing.fill(lengths, 60) for i in w) == list(range(len(lengths)))


def test_packing(edge, empty, edge_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(WORD_MODEL))
    got = packing.pack(edge, vocabulary(WORD_MODEL), capacity=128, pool=20).collect()
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for i, t in edge_rows]
    want = sorted([(i, a, len(x[a: a + 128]), zlib.crc32(np.array(x[a: a + 128], "<u4").tobytes()), len(x))
                   for i, x in ids for a in range(0, len(x), 128)], key=key)
    assert sorted([tuple(r)[:5] for r in got], key=key) == want
    windows_ = {}
    for r in got:
        windows_.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows_.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(empty, vocabulary(WORD_MODEL)).count() == 0


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encode, pick = Tokenizer.from_file(vocabulary(WORD_MODEL)), packing.WordEncoder(vocabulary(WORD_MODEL)), random.Random(2)
    parts = [".", "Then.", ")", "A,", "?!", "<|EndOfText|>", "<|startoftext|>", "İ", "x", "5;", "\x1c", "\x0b", "\x85", "É", "ß", "ª", "ǅ",
             "word&&&", "A<|", "ſ", " ", "  ", "\n", "Idiot's", "'ll", "<|endoftext|>", "　", "ﬁ", "日本", "́", "Σ", "\x00", "😀"]
    for _ in range(3000):
        text = "".join(pick.choices(parts, k=pick.randint(0, 12)))
        assert encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_encoder_learns_each_part_once(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(vocabulary(WORD_MODEL)), packing.WordEncoder(vocabulary(WORD_MODEL))
    text = "Wort wort, (wort) WORT. été Été, 4.0. wort"
    assert encode([text, ""])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(encode._parts.to_pylist()) == sorted(["", "wort", ",", "(wort)", ".", "été", "Été", "4.0."])
    pick = random.Random(5)
    texts_ = [" ".join(f"{'abcdefgh'[k % 8]}{'xyz'[k % 3]}{'!' * (k % 4)}{k % 7}"[: 1 + k % 5] for k in pick.choices(range(999), k=40)) for _ in range(50)]
    monkeypatch.setattr(packing, "REMEMBERED", 60)  # starts anew again and again
    for i in range(0, 50, 5):
        assert [x.tolist() for x in encode(texts_[i: i + 5])] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts_[i: i + 5]]
