"""Each operator against a plain version, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldspark.llm import byte_bpe, components, line_dedup, lm_scoring, ngram_jaccard, packing, quality_lm, quality_rules, substring_dedup, topk, toxicity
from tests.llm import cases


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def own_texts():
    return dict(enumerate(cases.texts()))


# ---- near copies


def test_jaccard_equals_all_pairs(spark):
    got = by_id(ngram_jaccard.near_duplicates(cases.table(spark, extra=True)), "n_shingles", "component_id")
    assert got == cases.components(own_texts())


def test_jaccard_chain_and_hot_group(spark):
    base = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(60):  # a chain: each differs from the next a little, the ends share nothing
        rows.append(" ".join(base[k * 3 : k * 3 + 120] + [f"u{j}" for j in range(max(0, k * 3 - 80))]))
    rows += [" ".join([*base[:100], f"z{k}", *base[100:]]) for k in range(300)]
    got = by_id(ngram_jaccard.near_duplicates(cases.table(spark, rows)), "n_shingles", "component_id")
    assert got == cases.components(dict(enumerate(rows)))


def test_jaccard_keeps_one_of_each(spark):
    docs = cases.table(spark)
    kept = {r["doc_id"] for r in ngram_jaccard.keep_one_each(docs).collect()}
    assert kept == {i for i, (_, c) in cases.components(own_texts()).items() if i == c}
    assert ngram_jaccard.keep_one_each(docs).columns == docs.columns


def test_jaccard_null_and_repeated_ids(spark):
    docs = cases.table(spark, ["a b c d e f g", "a b c d e f g"]).withColumn("doc_id", F.lit(None).cast("long")).unionByName(cases.table(spark, ["a b c d e f g"] * 2)).unionByName(cases.table(spark, ["a b c d e f g"] * 2))
    rows = ngram_jaccard.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["doc_id"] is not None) == [(False, 0)] * 4
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]


def test_jaccard_near_copies_cost_about_one_pair_each(spark, monkeypatch):
    import random

    r = random.Random(4)
    base = [f"t{i}" for i in range(400)]
    counts = {}
    for m, changes in ((100, 4), (400, 4), (200, 6)):  # with six changes many pairs are just below the bound
        rows = []
        for k in range(m):
            w = list(base)
            for p in r.sample(range(400), changes):
                w[p] = f"m{k}.{p}"
            rows.append(" ".join(w))
        seen = []
        whole = ngram_jaccard.bitmaps_allow
        monkeypatch.setattr(ngram_jaccard, "bitmaps_allow", lambda pairs, heads, seen=seen, whole=whole: seen.append(pairs.count()) or whole(pairs, heads))
        got = by_id(ngram_jaccard.near_duplicates(cases.table(spark, rows)), "component_id")
        monkeypatch.undo()
        assert set(got.values()) == {0}
        counts[m, changes] = sum(seen)
    assert counts[100, 4] <= 110 and counts[400, 4] <= 440 and counts[200, 6] <= 20 * 200, counts


def test_jaccard_a_repeated_id_keeps_the_links_of_all_its_texts(spark):
    a, b, c = ("a b c d e f g", "p q r s t u v w x y z", "p q r s t u v w x y z2")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, c)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.near_duplicates(docs).collect()}
    assert got == {3: 3, 5: 3, 9: 3}


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 400, r.integers(0, 20)).astype(np.uint64)]))
        if ngram_jaccard.linked(a, b):
            f = ngram_jaccard.folded([ngram_jaccard.bitmap(a), ngram_jaccard.bitmap(b)])
            assert ngram_jaccard.links_possible(f[:1], np.array([len(a)]), f[1:], np.array([len(b)]))[0, 0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_equal_union_find(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


# ---- byte-level BPE


def reference_encoding():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_documents(spark):
    e = reference_encoding()
    got = by_id(byte_bpe.encode_decode_digests(cases.table(spark, extra=True)), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in own_texts().items():
        ids = e.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_round_trip(spark):
    coded = byte_bpe.encode_documents(cases.table(spark))
    assert {i: bytes(b).decode() for i, b in by_id(byte_bpe.decode_documents(coded), "bytes").items()} == {i: t or "" for i, t in own_texts().items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=30), max_size=30))
def test_bpe_equals_library(texts):
    test_bpe_equals_library.e = getattr(test_bpe_equals_library, "e", None) or reference_encoding()
    test_bpe_equals_library.own = getattr(test_bpe_equals_library, "own", None) or byte_bpe.Encoder(public_tokenizers.path(byte_bpe.VOCABULARY))
    got = test_bpe_equals_library.own.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [test_bpe_equals_library.e.encode_ordinary(t) for t in texts]


# ---- top-k


def brute_top_k(vectors, k=10):
    ok = {i: [math.floor(1024.0 * float(x)) for x in v] for i, v in vectors if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(2)
    vectors = [(i, np.float32(r.normal(size=8).round(1)).tolist()) for i in range(350)]
    vectors[7] = (7, None)
    vectors[100] = (100, [1.0, None, *[0.0] * 6])
    vectors[150] = (150, [float("nan")] * 8)
    vectors[151] = (151, [float("inf")] * 8)
    vectors[152] = (152, [])
    for i in range(200, 230):  # many ties
        vectors[i] = (i, [0.5] * 8)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, chunk string, score int").repartition(3)
    assert {tuple(x) for x in topk.top_k(df).collect()} == brute_top_k(vectors)


def test_top_k_repeated_rows_are_queries_of_their_own(spark):
    r = np.random.default_rng(3)
    vectors = [(i, np.float32(r.normal(size=6)).tolist()) for i in range(60)]
    want = sorted(brute_top_k(vectors) | {(q, k, v, s) for q, k, v, s in brute_top_k(vectors)})
    rows = [*vectors, vectors[0]]
    got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == sorted([*want, *want])


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert {tuple(x) for x in topk.top_k(df).collect()} == brute_top_k([(0, [1.0, 2.0]), (1, [0.5, 0.25])])
    assert topk.top_k(df.limit(0)).count() == 0


# ---- substring dedup


def test_substrings_equal_plain_version(spark):
    docs = cases.table(spark, extra=True)
    kept = cases.substring_kept(own_texts())
    out = by_id(substring_dedup._apply(docs, [], 50, digest=True), "n_words", "n_removed", "kept")
    for i, t in own_texts().items():
        n = len(cases.words(t))
        assert out[i] == (n, n - len(kept[i]), hashlib.sha256(b" ".join(kept[i])).hexdigest())


def test_substring_texts_and_columns(spark):
    docs = cases.table(spark, extra=True)
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == docs.columns
    kept = cases.substring_kept(own_texts())
    for i, t in by_id(out, "text").items():
        whole = own_texts()[i]
        assert t == whole if len(kept[i]) == len(cases.words(whole)) else t.encode() == b" ".join(kept[i])


def test_substring_overlapping_self_repeats(spark):
    rows = ["a b " * 60, "a b " * 60 + "c", "b a " * 40]
    out = by_id(substring_dedup._apply(cases.table(spark, rows), [], 50, digest=True), "n_removed")
    assert out == {i: len(cases.words(t)) - len(cases.substring_kept(dict(enumerate(rows)))[i]) for i, t in enumerate(rows)}


# ---- line dedup


def test_lines_equal_plain_version(spark):
    docs = cases.table(spark, extra=True)
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns
    want = cases.lines_kept(own_texts())
    got = by_id(out, "text", "n_chars")
    assert {i: g[0] for i, g in got.items()} == want
    assert all(n == (None if t is None else len(t)) for t, n in got.values())


def test_lines_shared_run_goes_from_the_later_text(spark):
    run = "\n".join(f"line number {i} of the shared run" for i in range(6))
    rows = ["first\n" + run + "\nend of one", "other start\n" + run + "\nend of two", run]
    got = by_id(line_dedup.line_dedup(cases.table(spark, rows)), "text")
    assert got[0] == rows[0] and "shared run" not in got[1] and got[1].startswith("other start") and got[2] == ""


def line_rows():
    import random

    r = random.Random(2)
    rows = ["X x\nY y", "head\nX x\n Y y \nZ z", "X x\nY y\nZ z\nown", "one line", "one line", None, "", "a\n\na\n \nb", "hot\n" * 3000]
    return rows + ["\n".join(r.choice([f"s{r.randrange(40)}", f"t{r.randrange(5000)}", "hot", " "]) for _ in range(r.randint(1, 9))) for _ in range(120)]


@pytest.mark.parametrize("min_run", [1, 2, 3])
def test_lines_only_the_first_of_equal_runs_stays(spark, min_run):
    """Brute force over runs that start in different texts, single lines, one-line texts and null ids."""
    rows = line_rows()
    want = cases.lines_kept(dict(enumerate(rows)), min_run)
    docs = cases.table(spark, rows)
    twice = docs.where("doc_id in (2, 20)").unionByName(docs).repartition(3)
    out = line_dedup.line_dedup(twice.unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long"))), min_run).collect()
    assert len(out) == len(rows) + 3
    assert all(x["text"] == (rows[2] if x["doc_id"] is None else want[x["doc_id"]]) for x in out)


# ---- packing


def test_packing_covers_every_id_once(spark):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.packing(cases.table(spark, extra=True)).toPandas()
    for i, text in own_texts().items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    ordered = rows.sort_values(["sequence_id", "offset"])
    sums = ordered.groupby("sequence_id").length.cumsum()
    assert (sums - ordered.length == ordered.offset).all() and sums.max() <= 2048


def test_packing_special_tokens_and_full_windows(spark):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = ["a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "x<|endoftext|>\u0301y \ud55c\uad6d<|endoftext|>", "w " * 9000, "v " * 4095]
    got = packing.packing(cases.table(spark, rows * 2)).toPandas()
    for i, text in enumerate(rows * 2):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    full = got[got.length == 2048]
    assert len(full) == 2 * (4 + 2) and full.sequence_id.is_unique and (full.offset == 0).all()
    assert not set(full.sequence_id) & set(got[got.length < 2048].sequence_id)


def test_differencing_balances():
    sizes = np.random.default_rng(4).integers(1, 512, 700)
    out = packing.windows(sizes, 2048)
    sums = np.bincount(out, weights=sizes)
    assert sums.max() <= 2048 and sizes.sum() / (len(sums) * 2048) > 0.97
    assert packing.windows(np.array([2048, 2048, 1]), 2048).max() == 2


# ---- LM scoring


def test_lm_base_score_and_counts(spark):
    docs = cases.table(spark, extra=True)
    got = by_id(lm_scoring.score_documents(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = {i: [*[w.lower() for w in cases.words(t)], None] for i, t in own_texts().items()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert got[i][:4] == (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i][4] == pytest.approx(base) and math.isfinite(got[i][5]) and got[i][5] < 0


def test_lm_model_beats_the_base(spark):
    import random

    r = random.Random(1)
    rows = [" ".join(x for _ in range(40) for x in (lambda k: (f"a{k}", f"b{k}"))(min(int(r.expovariate(0.3)), 30))) for _ in range(300)]
    docs = cases.table(spark, rows)
    out = lm_scoring.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_lm_counts_every_pair_of_a_large_vocabulary(spark, monkeypatch):
    """Against a plain version: no pair of rare words shares a class, whatever the vocabulary."""
    import random

    r = random.Random(5)
    rows = [" ".join(f"w{int(10 ** r.uniform(0, 3.9))}" for _ in range(60)) for _ in range(400)]
    rows += [" ".join(f"u{k} v{k}" for k in r.sample(range(2500), 25)) for _ in range(600)]
    rows += [None, "", "w1 unseen-in-training"]
    docs = cases.table(spark, rows).repartition(3)
    monkeypatch.setattr(lm_scoring, "UNIT_BYTES", 20_000)
    got = by_id(lm_scoring.score_documents(docs), "score")
    texts = {i: ["", *[w.lower() for w in (t or "").split()], ""] for i, t in enumerate(rows)}
    rest = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}

    def counts(ids):
        c, p = Counter(), Counter()
        for i in ids:
            c.update(texts[i][1:])
            p.update(zip(texts[i], texts[i][1:]))
        return c, p, sum(c.values()), len(c)

    c, p, n, v = counts([i for i in texts if rest[i] not in (0, 1)])
    held = [x for i in texts if rest[i] == 0 for x in zip(texts[i], texts[i][1:])]
    l1 = 0.9
    for _ in range(lm_scoring.ROUNDS):
        l1 = sum(l1 * c[w] / n / (l1 * c[w] / n + (1 - l1) / (v + 1)) for _, w in held) / len(held)
    bucket = lambda k: int(math.log2(k + 1))
    l2 = dict.fromkeys(range(48), 0.5)
    odds = [(bucket(c[a]), p[a, b] / c[a] / (l1 * c[b] / n + (1 - l1) / (v + 1))) for a, b in held if c[a]]
    for _ in range(lm_scoring.ROUNDS):
        sums, mass = Counter(), Counter()
        for b, x in odds:
            sums[b] += l2[b] * x / (l2[b] * x + 1 - l2[b])
            mass[b] += 1
        l2 |= {b: min(max(sums[b] / mass[b], 1e-6), 1 - 1e-6) for b in mass}
    c, p, n, v = counts([i for i in texts if rest[i] != 1])
    assert v > 6000
    for i, t in texts.items():
        want = 0.0
        for a, b in zip(t, t[1:]):
            w = l2[bucket(c[a])] if c[a] else 0
            want += math.log10(w * p[a, b] / max(c[a], 1) + (1 - w) * (l1 * c[b] / n + (1 - l1) / (v + 1)))
        assert got[i] == pytest.approx(want, rel=1e-3), i


# ---- toxicity


def toxic_table(spark, n=600):
    import random

    r = random.Random(7)
    good = [f"g{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(good) for _ in range(r.randint(5, 80))]
        bad = r.random() < 0.25
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["Vile,", "nasty.", "awfulone", "awfultwo"]))
        rows.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    rows[5], rows[6] = None, ""
    return cases.table(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_table(spark)
    out = by_id(toxicity.score(docs, toxicity.fit(docs, labels)), "score", "predicted")
    held = [(i, y) for i, _, y in truth if zlib.crc32(str(i).encode()) % 4 == 2 and i not in (5, 6)]
    assert np.mean([out[i][1] == y for i, y in held]) > 0.9
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in out.values()) and len(out) == 600
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and 350 < kept.count() < 560


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_table(spark, 20)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert set(by_id(toxicity.score(docs, None), "score").values()) == {0.0}


# ---- quality rules and quality model


def test_rule_order_does_not_change_verdicts(spark):
    docs = cases.table(spark)
    a = by_id(quality_rules.apply_rules(docs, quality_rules.RULES), "rejected_by")
    b = by_id(quality_rules.apply_rules(docs, quality_rules.RULES[::-1]), "rejected_by")
    assert {i for i, x in a.items() if x is None} == {i for i, x in b.items() if x is None}


def test_repeat_words(spark):
    rows = ["a b c d e " * 2, "a b c d e f", "x " * 9, None, "a b c d e a b c d e z a b c d e"]

    def plain(t):
        w = cases.words(t)
        g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len({p for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)})

    got = by_id(quality_rules.quality_rules(cases.table(spark, rows, extra=True)), "n_repeat_words")
    assert got == {i: plain(t) for i, t in enumerate(rows)}


def test_quality_model_prefers_trusted_text(spark):
    good = ["the cat sat on the mat and the dog ran " * 5 + f"number{i}" for i in range(60)]
    bad = ["x#q$ z%%v &&& ||| kq*j wq<> " * 8 + f"n{i}" for i in range(10)]
    docs = cases.table(spark, [*good, *bad, None, ""], extra=True)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = by_id(quality_lm.classify(docs, labels), "kept")
    assert all(got[i] for i in range(50)) and not any(got[i] for i in range(60, 70))
    assert all(by_id(quality_lm.classify(docs, labels.limit(0)), "kept").values())


def plain_kneser_ney(texts, order):
    """Log probability of a text's tokens under interpolated modified Kneser-Ney, with dictionaries of tuples."""
    ends = [[x.lower() for x in cases.words(t)] + ["END"] for t in texts]
    padded = [["START"] * (order - 1) + w for w in ends]
    level = {order: Counter(tuple(w[i - order + 1 : i + 1]) for w in padded for i in range(order - 1, len(w)))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    types = len(level[1])
    cuts = {}
    for k, counts in level.items():
        n = [sum(c == j for c in counts.values()) for j in (1, 2, 3, 4)]
        if all(n[:3]):
            y = n[0] / (n[0] + 2 * n[1])
            cuts[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]
        else:
            cuts[k] = [0.5, 0.75, 0.9]
    seen = {k: {} for k in level}
    for k, counts in level.items():
        for g, n in counts.items():
            total = seen[k].setdefault(g[:-1], [0, 0.0])
            total[0] += n
            total[1] += cuts[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / (types + 1)
        k, lower = len(g), p(g[1:])
        if g[:-1] not in seen[k]:
            return lower
        n, (total, spare) = level[k][g], seen[k][g[:-1]]
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total + spare / total * lower

    vocabulary = [*{w for ws in ends for w in ws}, "UNKNOWN"]

    def logs(text):
        w = ["START"] * (order - 1) + [x.lower() for x in cases.words(text)] + ["END"]
        return [np.log10(p(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w))]

    return logs, lambda context: sum(p((*context, w)) for w in vocabulary)


@pytest.mark.parametrize("order", [2, 3])
def test_perplexities_equal_plain_kneser_ney(spark, order, monkeypatch):
    monkeypatch.setattr(quality_lm, "UNIT_BYTES", 20_000)
    texts = own_texts()
    trained = [t for i, t in texts.items() if i % 2]
    logs, mass = plain_kneser_ney(trained, order)
    assert np.isclose(mass(("END",) * (order - 1)), 1) and np.isclose(mass((*["START"] * (order - 2), b"w1")), 1)
    counts = quality_lm.written(quality_lm.count_grams(cases.table(spark, trained), order), "test-counts")
    docs = quality_lm.written(cases.table(spark, extra=True).repartition(3), "test-docs")
    got = {r["doc_id"]: r for r in quality_lm.perplexities(docs, *quality_lm.model_of(counts, order), order).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = logs(t)
        assert got[i]["n_tokens"] == len(want)
        assert np.isclose(np.log10(got[i]["perplexity"]), -np.mean(want), atol=0.01)


def test_hot_contexts_are_dealt_over_tasks(spark):
    big = spark.range(30_000).selectExpr("id AS g2", "IF(id % 3 = 0, id, -1) AS c2")
    small = big.groupBy("c2").count().selectExpr("c2", "c2 * 2 AS v", "count AS rows")
    out = quality_lm.spread_join(big, small, "c2", "rows")
    assert out.count() == 30_000 and out.where("v <> c2 * 2").count() == 0


def test_quality_of_odd_rows(spark):
    rows = [(1, "a b c", "en"), (1, "a b c", "en"), (None, "a b d", None), (2, None, "en"), (3, "", "fr"), ((1 << 60) + 1, "a b c", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, (1 << 60) + 1, None)], "doc_id long, quality int, toxic int")
    out = quality_lm.classify(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    assert all(r["perplexity"] > 0 and r["kept"] is not None for r in out)


# ---- empty tables


@pytest.mark.parametrize(
    "operator",
    [
        ngram_jaccard.near_duplicates, byte_bpe.encode_decode_digests, substring_dedup.substring_dedup, line_dedup.line_dedup,
        packing.packing, lm_scoring.score_documents, quality_rules.quality_rules,
    ],
)
def test_empty_table(spark, operator):
    assert operator(cases.empty(spark)).count() == 0


def test_empty_table_with_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(cases.empty(spark), labels).count() == 0
    assert quality_lm.classify(cases.empty(spark), labels).count() == 0
