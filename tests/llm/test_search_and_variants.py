"""Spelling variants, fingerprints and ranked search against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import cases

from fieldspark.llm import fingerprints, lexical, packing, spelling
from fieldspark.llm.ngram_jaccard import shingle_sets

# ---- spelling variants


def plain_counts(rows, least=5, often=3, planted=True):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if planted and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def variant_rows():
    r = random.Random(6)
    base = ["".join(r.choice("abcdéÐ÷") for _ in range(r.randint(4, 9))) for _ in range(60)] + ["x" * 70, "y" * 69, "aaaaa", "aaaaaa", "aaaaaaa"]

    def typo(w):
        k = r.randrange(len(w))
        return r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÀz") + w[k:], w[:k] + r.choice("abÿ") + w[k + 1 :]])

    words = base + [typo(w) for w in base] + [typo(typo(w)) for w in base]
    rows = [(i, " ".join(r.choice([str.upper, str, str.title])(r.choice(words)) + r.choice([" ", "1", "-", "ß ", "Ā "]) for _ in range(r.randint(0, 300)))) for i in range(40)]
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (50, None), (51, ""), (52, "123 .."), (53, "x" * 70 + " " + "y" * 69)]


def test_variants_equal_plain_version(spark):
    rows = variant_rows()
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs.repartition(3), planted=True).collect()}
    want = plain_variants(plain_counts(rows))
    assert got == want and sum(v[0] is not None for v in want.values()) > 20 and any(v[0] is not None and v[1] != v[0] for v in want.values())


def test_near_words_of_a_small_alphabet(spark):
    words = ["".join(x) for k in (4, 5, 6) for x in __import__("itertools").product("ab", repeat=k)] + ["abcdefgh", "abcdefg", "bcdefgh", "abcxefgh", "aabcdefgh", "abcdefghh", "hgfedcba"]
    table = spelling.written(spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3), "test-words")
    got = {(r["word"], r["other"]) for r in spelling.near_words(table).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_chunks_of_a_long_text_cut_no_run(monkeypatch):
    text = ("abc défg " * 50 + "z" * 400 + " end" + "q" * 30).encode()
    for most in (7, 64, 333):
        parts = list(spelling.pieces(text, most))
        assert b"".join(parts) == text and Counter(w for p in parts for w in re.findall("[a-zÀ-ÿ]+", p.decode())) == Counter(re.findall("[a-zÀ-ÿ]+", text.decode()))
    ids, texts = [b"7", b"8"], [text, b"abc d\xc3\xa9fg long"]
    words, n = spelling.count_chunk(texts, ids, True, 5)
    want = plain_counts([(7, texts[0].decode()), (8, texts[1].decode())], often=1)
    got = Counter()
    for w, k in zip(words, n, strict=True):
        got[w.decode()] += k
    assert dict(got) == want


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="four"):
        spelling.spelling_variants(cases.empty(spark), min_length=3)


# ---- fingerprints


def jaccard(a, b):
    x, y = (set(s.tolist()) for s in shingle_sets([(a or "").encode(), (b or "").encode()]))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_in_the_order_of_ids(spark):
    texts = cases.texts() + ["ab", "é" * 9, "w " * 20000]
    ids = [(i * 37) % 101 for i in range(len(texts))]
    rows = [*zip(ids, texts, strict=True), (ids[4], "a second text of this id")]
    docs = spark.createDataFrame([(*r, "x", 3, True) for r in rows], "doc_id long, text string, range string, class_id int, copy boolean")
    out = fingerprints.fingerprints(docs.unionByName(docs.where(f"doc_id = {ids[0]}").withColumn("doc_id", F.lit(None).cast("long"))).repartition(4)).toPandas()
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    assert sorted(out.doc_id) == [i for i, _ in order]
    by = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q] if q else t
        row = out[(out.doc_id == i) & (out.n_chars == len(t))].iloc[0]
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert by.setdefault(t, row.fingerprint) == row.fingerprint
        assert row.near_edited == pytest.approx(jaccard(t, changed), abs=0.2) and row.near_next == pytest.approx(jaccard(t, after), abs=0.2)
        assert (row.near_edited == 1) == (row.fingerprint == row.edited_fingerprint)


def test_one_document_follows_itself(spark):
    row = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["class_id"] == 5
    assert fingerprints.fingerprints(cases.empty(spark)).count() == 0


def test_near_copies_have_a_class(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts, want = [], {}
    for g in range(30):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        for k in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(len(base) // 120 if k else 0):
                own[r.randrange(len(own))] = r.choice(words)
            want[len(texts)] = g
            texts.append(" ".join(own))
    texts += ["", None, "short", "short", "SHORT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in fingerprints.near_copies(docs.repartition(3)).collect()}
    first = {}
    for i, g in want.items():
        first.setdefault(g, i)
    many = {g for g, n in Counter(want.values()).items() if n > 1}
    assert {i: c for i, c in got.items() if i in want} == {i: first[g] for i, g in want.items() if g in many}
    k = len(want)
    assert {i: c for i, c in got.items() if i >= k} == {k + 2: k + 2, k + 3: k + 2, k + 4: k + 2}


def test_likeness_of_sets_with_a_known_overlap():
    r = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.75, 1.0):
        n = 400
        words = [f"v{x}" for x in r.integers(0, 10**9, 2 * n)]
        same = round(share * n)
        a, b = words[:n], words[:same] + words[n : 2 * n - same]
        rows, size = fingerprints.signatures([" ".join(a).encode(), " ".join(b).encode()])
        got = fingerprints.likeness(rows[:1], size[:1], rows[1:], size[1:])[0]
        assert got == pytest.approx(jaccard(" ".join(a), " ".join(b)), abs=0.13)


# ---- ranked search


def plain_search(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs if i is not None and cut(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        if item is None:
            continue
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def search_rows():
    r = random.Random(12)
    words = [f"t{int(r.expovariate(0.02))}" for _ in range(2000)] + ["É世", "x_y", "A1b"]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 40, 200])))) for i in range(160)]
    docs += [(200 + i, docs[3][1] or "t1 t2") for i in range(40)] + [(5, "t1 t1 t1"), (None, "t1"), (300, None), (301, "\t.\n"), (302, "t9 " * 5000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(30)] + [(40, docs[3][1]), (41, ""), (42, None), (43, "absent"), (None, "t1"), (7, "t1 t1 T2"), (7, "t1 t1 T2")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ITEMS": 7, "CHUNK_ROWS": 50, "LEAF_ROWS": 4}, {"BLOCK_TERMS": 9, "LEAF_ROWS": 1, "CHUNK_TERMS": 300}])
def test_search_equals_plain_version(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = search_rows()
    if "BLOCK_TERMS" in limits:
        items = items[:3] + items[-8:]
    d = spark.createDataFrame([(*x, 1.0, 2) for x in docs], "doc_id long, text string, score double, rank int").repartition(3)
    q = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, query int")
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.lexical_search(d, q).collect())
    assert got == plain_search(docs, items)


def test_bounds_hold_for_every_node():
    r = np.random.default_rng(5)
    n, terms = 500, 60
    sizes = r.integers(1, 12, n)
    at = np.concatenate([np.sort(r.choice(terms, s, replace=False)) for s in sizes])
    start = np.concatenate([[0], np.cumsum(sizes)])
    weight, scale, group = r.integers(1, 10**6, len(at)), r.integers(0, 9000, terms), r.integers(0, 9, terms)
    tree = lexical.build_tree(np.arange(n), start, at, weight, scale, group)
    assert sorted(tree.ids) == list(range(n)) and len(tree.lo) > 20
    dense = np.zeros((n, terms), np.int64)
    dense[np.repeat(np.arange(n), sizes), at] = weight
    for _ in range(20):
        own = r.choice(terms, 6, replace=False)
        mask, pull = np.zeros(terms, bool), np.zeros(9)
        mask[own] = True
        some, k = np.unique(group[own], return_counts=True)
        pull[some] = np.sqrt(k)
        exact = (dense[:, own] * scale[own]).sum(axis=1)
        for node in range(len(tree.lo)):
            assert lexical.bound(tree, node, mask, pull) >= exact[tree.ids[tree.lo[node] : tree.hi[node]]].max()


def test_weights_beyond_64_bits():
    tf, n = np.array([1, 3]), np.array([5, 10**9])
    want = [(10**9 * t) // (1000 * t + 8 * (10 + 90 * m * 10**12 // 10**14)) for t, m in zip(tf.tolist(), n.tolist(), strict=True)]
    assert lexical.weights_of(tf, n, 10**12, 10**14).tolist() == want


def test_search_in_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.lexical_search(cases.empty(spark), items).count() == 0
    assert lexical.lexical_search(cases.table(spark), items.where("false")).count() == 0


# ---- tokenizer files


def test_other_tokenizer_files_encode_whole_texts():
    import public_tokenizers

    text = "Hello  wörld's <|endoftext|> 12\n\n x"
    for name, by_words in ((packing.TOKENIZER, True), ("byte_bpe_50k.json", False)):
        e = packing.WordEncoder(public_tokenizers.path(name))
        assert e.by_words == by_words
        assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
