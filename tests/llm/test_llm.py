"""Operators of the training-data pipeline: brute force, round trips, planted cases and odd input."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from shiftwise.llm import ann, bpe, chat, decontaminate, jaccard, langid, lm, manifest, maxscore, mixing, pii, queries, sharding, spelling, words
from shiftwise.llm.components import components

SF = f"{oracle.TESTDATA}/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, _x int"
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, 0),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, 0),  # a repeated row
    (2, "Alpha  BETA gamma\ndelta epsilon zeta eta theta", "en", "b", 1, 0),
    (3, None, None, None, None, None), (4, "", "fr", "a", 0, 1), (5, " \t\n", "fr", "a", 3, 1), (None, "lone words here", "en", None, 2, 2),
    (6, "short one", "de", "b", 9, 3), (7, "123 -- 456", "de", "b", 9, 3), (8, "word " * 30_000, "en", "c", 150_000, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    problem, n = oracle.compare(oracle.duck(SF), queries.QUERIES[name](spark, SF), queries.SQL[name])
    assert not problem and n


def test_words_against_regex():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choices("aB \t\n\x0b\x0c\r\x1c\x85\xa0Éé", k=rng.randint(0, 30))) for _ in range(500)] + [None, "", " "]
    code, offsets, distinct = words.tokenise(pa.array(texts))
    known = distinct.to_pylist()
    assert [[known[c] for c in code[a:b]] for a, b in zip(offsets, offsets[1:])] == [plain_words(t) for t in texts]
    code, offsets, distinct = words.tokenise(pa.array(texts).slice(100, 300))
    known = distinct.to_pylist()
    assert [[known[c] for c in code[a:b]] for a, b in zip(offsets, offsets[1:])] == [plain_words(t) for t in texts[100:400]]


# 1: chat formatting


def test_chat_comes_back(spark):
    rng = random.Random(2)
    bits = ["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "<|", "<\\|", "<|nl|>", "é", "user", "ok "]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "a\nb", "<|im_end|>", None]), "".join(rng.choices(bits, k=rng.randint(0, 8)))))
    rows += [(None, 1, "user", None), (None, None, "assistant", "x"), (99, 0, "user", "same"), (99, 0, "user", "same"), (100, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = chat.format_chat(df).collect()
    assert len(out) == len(by)
    for r in out:
        want = [(role, text) for _, _, role, text in sorted(by[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want)
        spoken = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        assert spoken == [t for role, t in want if role == "assistant"]
    assert chat.format_chat(df.limit(0)).count() == 0


# 2: language model


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (200_000, 10**9), (70_000, 2**45)):
        v = np.sort(rng.integers(0, top, n))
        e = lm.EliasFano(v, lambda a: a)
        assert (e.all() == v).all()
        if n:
            asked = np.sort(np.concatenate([v[:50], rng.integers(0, top + 5, 300)]))
            place, value = e.successors(asked)
            want = np.searchsorted(v, asked)
            inside = want < n
            assert (place == want).all() and (value[inside] == v[want[inside]]).all() and (value[~inside] == -1).all()


def brute_scores(rows, trained, prior):
    c, bi, n = collections.Counter(), collections.Counter(), 0
    for r in rows:
        if trained(r[0]):
            s = [*plain_words(r[1]), None]
            c.update(s)
            bi.update(zip(["<s>", *s[:-1]], s))
            n += 1
    total, types = sum(c.values()), len(c)
    c["<s>"] = n
    out = []
    for r in rows:
        s = [*plain_words(r[1]), None]
        p = lambda w: (c[w] + 0.5) / (total + 0.5 * (types + 1))
        model = sum(math.log10((bi[h, w] + prior * p(w)) / (c[h] + prior)) for h, w in zip(["<s>", *s[:-1]], s))
        out.append((r[0], len(s), sum(c[w] > 0 for w in s), total, sum(math.log10(p(w)) for w in s), model))
    return out


@pytest.mark.parametrize("pairs", [3, 3_000_000])
def test_scores_against_brute_force(spark, odd, monkeypatch, pairs):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1000)
    rows = [tuple(r)[:2] for r in odd.collect()] + [(i, " ".join(random.Random(i).choices("abcdefgh", k=40)), ) for i in range(20, 60)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    trained = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    got = lm.score_texts(df, ~langid.fold("doc_id", 5, 1) & F.col("doc_id").isNotNull(), words_per_shard=pairs, pairs_per_shard=pairs).collect()
    want = brute_scores(rows, trained, lm.PRIOR)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and abs(g[5] - w[5]) <= 0.03 * w[1]


@pytest.mark.parametrize("order, pairs", [(3, 3_000_000), (4, 5)])
def test_scores_of_longer_orders(spark, odd, monkeypatch, order, pairs):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1000)
    rows = [tuple(r)[:2] for r in odd.collect()] + [(i, " ".join(random.Random(i).choices("abcd", k=40))) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trained = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    train = ~langid.fold("doc_id", 5, 1) & F.col("doc_id").isNotNull()
    got = lm.score_texts(df, train, words_per_shard=pairs, pairs_per_shard=pairs * 100, order=order).collect()
    grams = collections.Counter()  # (context, word), contexts of every length
    padded = lambda t: ["<s>"] * (order - 1) + [*plain_words(t), None]
    for i, t in rows:
        s = padded(t)
        grams.update((tuple(s[at - k : at]), s[at]) for at in range(order - 1, len(s)) if trained(i) for k in range(order))
    above = collections.Counter()
    for (h, _), n in grams.items():
        above[h] += n
    types = sum(h == () for h, _ in grams)

    def p(h, w):
        if not h:
            return (grams[h, w] + 0.5) / (above[()] + 0.5 * (types + 1))
        return (grams[h, w] + lm.PRIOR * p(h[1:], w)) / (above[h] + lm.PRIOR)

    want = [(i, sum(math.log10(p(tuple(s[at - order + 1 : at]), s[at])) for at in range(order - 1, len(s)))) for i, t in rows for s in [padded(t)]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for (i, n, g), (j, w) in zip(sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=lambda r: key((r[0], r[2]))), sorted(want, key=key)):
        assert i == j and abs(g - w) <= 0.03 * n


def test_query_scores_with_trigrams():
    assert lm.ORDER >= 3


def test_scores_of_nothing(none):
    assert lm.score_texts(none, F.lit(True)).count() == 0
    assert none.count() == 0


# 3: mixing


def test_targets_and_copies(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), f"s{rng.randint(0, 6)}" if i % 9 else None) for i in range(900)] + [(1, "again", "s1")] * 3
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(plain_words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, budget = set(), 1.5 * sum(size.values())
    while True:  # hand the excess on until nobody is above the cap
        left = budget - sum(2 * size[s] for s in fixed)
        w = sum(weight[s] for s in names if s not in fixed)
        target = {s: 2.0 * size[s] if s in fixed else left * weight[s] / w for s in names}
        over = {s for s in names if s not in fixed and target[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    assert fixed and len(fixed) < len(names)
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r._target, target[r.source]) and r._source_size == size[r.source] and 0 <= r._copies <= 2
        taken[r.source] += r._copies * r._size
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.repeated(mixing.mix_sources(df)).count() == sum(r._copies for r in got)
    assert mixing.mix_sources(none.drop("_x")).count() == 0
    assert mixing.mix_sources(odd.drop("_x")).count() == len(ODD)


# 4 and 7: vector search

VECS = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)]) for i in range(300)]
VECS += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [0.0] * 8), (304, VECS[5][1]), (305, VECS[5][1]), (5, VECS[5][1]), (None, VECS[6][1])]


def test_maxscore_against_brute_force(spark):
    whole = [(i, v if v is None else [None if x is None else float(math.floor(16 * x)) if x == x else x for x in v]) for i, v in VECS]
    df = spark.createDataFrame([(i, v, 1) for i, v in whole], "vec_id long, v array<double>, score int")
    usable = [(i, np.array(v)) for i, v in whole if i is not None and v is not None and None not in v and np.isfinite(np.array(v)).all()]
    for k, block in ((10, 64), (3, 10_000), (400, 64)):
        got = collections.defaultdict(list)
        for r in maxscore.top_k(df, "vec_id", "v", F.col("vec_id") % 5 == 0, k, block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((-r.score, r.vec_id))
        want = {q: sorted((-int(v @ x), i) for i, x in usable if i != q)[:k] for q, v in usable if q % 5 == 0}
        assert got == want
    assert maxscore.top_k(df.limit(0), "vec_id", "v", F.lit(True), 5).count() == 0


def test_maxscore_of_huge_components(spark):
    rows = [(i, [float(10 ** (i % 19)), -(10.0 ** (i % 7)), 3.0]) for i in range(60)] + [(60, [1e300, 1.0, 0.0]), (61, [-1e300, 2.0, 0.0])]
    got = collections.defaultdict(list)
    for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v", F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 61, 10):
        exact = {i: sum(int(a) * int(b) for a, b in zip(rows[q][1], v)) for i, v in rows if i != q}
        want = sorted(exact, key=lambda i: (-exact[i], i))[:5]
        assert got[q] == [(i, max(-(2**63), min(2**63 - 1, exact[i]))) for i in want]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = ann.nearest(df, "vec_id", "v", F.col("vec_id") % 20 == 0, 20, rows_per_block=1500).collect()
    hits, scores = 0, x @ x.T
    for r in got:
        assert math.isclose(r.score, scores[r.query_id, r.vec_id], rel_tol=1e-12)
        others = np.delete(scores[r.query_id], r.query_id)
        hits += r.score >= np.sort(others)[-20] - 1e-12
    assert len(got) == 150 * 20 and hits / len(got) >= 0.9


@pytest.mark.parametrize("lengths", ["one long row", "log-normal"])
def test_neighbours_recall_of_other_lengths(spark, lengths):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(3000) == 1501, 10, 1)[:, None] if lengths == "one long row" else np.exp(rng.normal(0, 0.5, (3000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = ann.nearest(df, "vec_id", "v", F.col("vec_id") % 20 == 0, 20).collect()
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    last = np.sort(scores, axis=1)[:, -20]
    assert len(got) == 150 * 20 and np.mean([r.score >= last[r.query_id] - 1e-12 for r in got]) >= 0.95


def test_neighbours_of_odd_vectors(spark):
    df = spark.createDataFrame(VECS, "vec_id long, v array<double>")
    got = ann.nearest(df, "vec_id", "v", F.col("vec_id") % 5 == 0, 20, probe=1.0).collect()
    assert not {r.vec_id for r in got} & {300, 301, 302, 303} and all(r.query_id != r.vec_id for r in got)
    five = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 5]
    assert len(five) == 20 and five.index(304) + 1 == five.index(305)
    assert ann.nearest(df.limit(0), "vec_id", "v", F.lit(True), 5).count() == 0


# 5: language


def test_languages(spark, odd, none):
    rng = random.Random(5)
    stems = {"xx": "kala mita sonu peri", "yy": "strof grunt blick dwarg", "zz": "ñao éiu óea üie"}
    rows = [(i, " ".join(rng.choices(stems[l].split(), k=rng.randint(3, 60))), l, 1) for i, l in enumerate(list(stems) * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    got = langid.identify(df.where("doc_id % 4 = 2"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and not any(r.lang_rejected for r in got)
    strange = {r.doc_id: r for r in langid.identify(odd.withColumn("lang_score", F.lit(1)).drop("lang_score"), model).collect()}
    assert all(strange[i].lang_pred == "und" and strange[i].lang_rejected and strange[i].lang_score == 0 for i in (3, 4, 5, 7))
    assert all(0 <= r.lang_score <= 1 for r in strange.values()) and strange[8].lang_pred in stems
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_rare_languages_do_not_end_calibration(spark):
    rng = random.Random(6)
    stems = {"xx": "kala mita sonu peri", "yy": "strof grunt blick dwarg"}
    rows = [(i, " ".join(rng.choices(stems[l].split(), k=rng.randint(3, 60))), l) for i, l in enumerate(list(stems) * 150)]
    rows += [(1000 + i, f"zu{chr(97 + i)}{chr(98 + i)} vo{chr(99 + i)}x " * 4, f"r{i}") for i in range(12)]  # one document each
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert {f"r{i}" for i in range(12)} <= set(model.langs) and model.threshold > 0
    two = langid.fit(df.where("doc_id < 1000"))
    assert two.threshold > 0.5  # below, nothing could be rejected


def test_many_languages(spark):
    """Every language is learned, and only learned languages are predicted."""
    rng = random.Random(7)
    pool = "abcdefghijklmnopqrstuvwxyzäöüßñçéèàøåæœłżščřž"
    stems = {f"l{i}": ["".join(rng.choices(pool, k=5)) for _ in range(4)] for i in range(210)}
    rows = [(i, " ".join(rng.choices(stems[f"l{i % 210}"], k=20)), f"l{i % 210}") for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, docs_in_all=1500)
    assert set(model.langs) == {*stems, langid.NOISE}
    got = langid.identify(df, model).collect()
    assert {r.lang_pred for r in got} <= set(stems) and sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
def test_language_scores_mean_something(spark):
    """Held-out reliability, a temperature found inside its range, right texts kept, unlearned scripts rejected."""
    docs = spark.read.parquet(f"{oracle.TESTDATA}/sf0.1/documents.parquet").select("doc_id", "text", "lang", F.lit(True).alias("lang_rejected"))
    held = langid.fold("doc_id", 4, 2)
    model = langid.fit(docs.where(~held))
    assert 1e-6 < model.temperature < 1e6 and 0 < model.threshold < 1
    found = langid.identify(docs.where(held), model, keep=["lang", "lang_rejected"], names=("p", "s", "r")).where("lang IS NOT NULL AND p <> 'und'").toPandas()
    right = found.lang == found.p
    assert right.mean() > 0.995 and found.r[right].mean() <= 0.002
    bins = np.minimum((found.s * 10).astype(int), 9)
    assert sum(abs(right[bins == b].mean() - found.s[bins == b].mean()) * (bins == b).mean() for b in set(bins)) < 0.02
    strange = ["Это русский текст о погоде и природе", "これは日本語の文章です", "αυτό είναι ένα ελληνικό κείμενο", "هذا نص عربي عن الطقس"]
    odd = spark.createDataFrame([(t,) for t in strange], "text string")
    assert all(r.lang_rejected for r in langid.identify(odd, model).collect())


def test_ngrams_at_seams(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choices("abc de. ñü", k=500))
    whole = langid.subwords(text)
    for piece in (1, 7, 100, 502):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.allclose(langid.subwords(text), whole)


# 6: Jaccard join


def brute_components(rows, width, percent):
    sets = [set() for _ in rows]
    for k, (_, text) in enumerate(rows):
        w = plain_words(text)
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = {i for i, _ in rows if i is not None}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = root(rows[a][0]), root(rows[b][0])
                    up[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("width, percent, group", [(4, 85, 4096), (5, 80, 2), (1, 60, 4096)])
def test_components_against_brute_force(spark, monkeypatch, width, percent, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 5000)
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [tuple(r[:2]) for r in ODD if r[0] != 8]
    for k in range(60):
        base = rng.choices(vocabulary, k=rng.choice([2, 5, 8, 12, 30, 90, 200]))
        for j in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 20) if j else 0):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(copy)))
    passage = " ".join(rng.choices(vocabulary, k=55))
    rows += [(1000 + i, passage + " " + " ".join(rng.choices(vocabulary, k=40 + i))) for i in range(12)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int")
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, width=width, percent=percent).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1])) == brute_components(rows, width, percent)


def test_components_of_nothing(none):
    assert jaccard.jaccard_components(none).count() == 0


def test_bands_hold_every_pair():
    """With D + 1 pieces a pair at the threshold has an equal piece, in a band that both documents go to."""
    for percent in (60, 80, 85, 100):
        b = jaccard.Bands(percent)
        for size in range(1, 400):
            for partner in range(size, size * 100 // percent + 1):
                band = b.band(partner)
                assert band in b.bands(size) and band in b.bands(partner)
                assert b.pieces(band) > (size + partner) * (100 - percent) // (100 + percent)


def test_component_rounds(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(30)] + [(200, 300)]
    up = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == up and len(got) == len(up)


# 8: BPE


def test_bpe_like_the_library(spark, odd, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(7)
    bits = ["a", "b", "ing", "the", "'s", "'re", "1", "²", "Σ", "İ", "é", "é", "ß", " ", "\n", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "<|", "|>",
            "好", "한", "😀", "ﬁ", "_", "--", "aaaaaa", "​", "\x00", "Ⅷ", "THE "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)] + [None, "", "a" * 20_000, "word " * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(bpe.encode_texts(df, path, decoded="back").collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids, ascii((t or "")[:80])
        assert r.back == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(odd, path).count() == len(ODD) and bpe.encode_texts(none, path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_texts(odd.withColumn("ids", F.lit(1)), path)


def test_merges_that_make_lower_ranks():
    """A symbol that two merges can make may form a pair of a lower rank; the word's own order decides then."""
    b = bpe.Bpe.__new__(bpe.Bpe)
    names = ["a", "b", "c", "ab", "abc", "bc", "ca", "aa", "a|", "b|", "c|"]
    b.vocab, b.end, b.size = {n: i for i, n in enumerate(names)}, "|", len(names)
    pairs = [("abc", "a"), ("ab", "ca"), ("a", "bc"), ("a", "a"), ("b", "c"), ("ab", "c"), ("a", "b"), ("c", "a")]
    b.vocab |= {x + y: len(b.vocab) + k for k, (x, y) in enumerate(pairs) if x + y not in b.vocab}
    b.size = len(b.vocab) + 9
    b.merges = [(b.vocab[x], b.vocab[y], b.vocab[x + y]) for x, y in pairs]
    b.rank = {x * b.size + y: r for r, (x, y, _) in reversed(list(enumerate(b.merges)))}

    def alone(word):
        s = [b.vocab[c] for c in word[:-1]] + [b.vocab[word[-1] + "|"]]
        while True:
            found = [(b.rank[x * b.size + y], i) for i, (x, y) in enumerate(zip(s, s[1:])) if x * b.size + y in b.rank]
            if not found:
                return s
            r, i = min(found)
            s[i : i + 2] = [b.merges[r][2]]

    rng = random.Random(8)
    many = sorted({"".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(800)})
    assert b.merge(many) == [alone(w) for w in many]


# 9: personal data


def test_rules_against_regex():
    def slow(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            out += [(m.start(), 1, m.end())] * all(int(x) <= 255 for x in m[0].split("."))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = pii.digits_of(m[0])
            out += [(m.start(), 2, m.end())] * (12 <= len(d) <= 19 and pii.luhn(d))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(pii.digits_of(m[0])) <= 15]
        return sorted(out)

    rng = random.Random(10)
    for _ in range(20_000):
        t = "".join(rng.choices("01234567890123456789..@@+ -()ab%_é\n", k=rng.randint(0, 50)))
        assert pii.accepted(t) == slow(t), t


def test_learned_spans(spark, odd, none):
    rng = random.Random(11)
    phone = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"please call +1 {phone()} now or lot {rng.randint(1000, 9999)}-{rng.randint(10, 99)}-{rng.randint(10, 99)} b") for i in range(400)]
    rows += [(1000, "please call (415) 555-2133 now"), (1001, "nothing personal, section 12.4 of 2019-05-06"), (1002, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kind int")
    model = pii.fit(df.where("doc_id <> 1000"))
    got = {r.doc_id: r for r in pii.find_spans(df, model, redact=True).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1000].pii_spans] == [("phone", 12, 26)] and got[1000].pii_base == []
    assert got[1000].pii_text == "please call [PHONE] now"
    assert got[1001].pii_spans == [] and got[1002].pii_spans == [] and got[1002].pii_text is None
    assert all(set(r.pii_base) <= set(r.pii_spans) and len(r.pii_base) == 1 for i, r in got.items() if i < 400)
    assert pii.find_spans(none, pii.fit(none)).count() == 0 and pii.find_spans(odd, pii.fit(odd)).count() == len(ODD)


def test_unproven_spans_do_not_count_as_wrong(spark):
    rng = random.Random(12)
    phone = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"please call +1 {phone()} now or lot {rng.randint(1000, 9999)}-{rng.randint(10, 99)}-{rng.randint(10, 99)} b") for i in range(1200)]
    rows += [(i, f"please call {phone()} now") for i in range(1200, 2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    kind, right, wrong, precision, threshold = model.report[3]
    assert kind == "phone" and right >= 200 and wrong >= 200 and precision >= 0.99 and threshold <= 1
    got = pii.find_spans(df.where("doc_id >= 1200"), model, keep=["doc_id"]).collect()
    assert all([(s.kind, s.start, s.end) for s in r.pii_spans] == [("phone", 12, 26)] for r in got)


def test_every_labelled_proposal_is_learned_from(spark, monkeypatch):
    """Counts of all proposals, not of 10,000 a label; tasks, order and copies of rows don't change trees, calibration or thresholds."""
    monkeypatch.setattr(pii.Boosted.__init__, "__defaults__", (4, 10, 0.3, 32))  # ten trees: scores are stored anew once
    rng = random.Random(14)
    phone = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    lot = lambda: "-".join(str(rng.randint(0, 10 ** rng.randint(2, 4))) for _ in range(3))
    rows = [(i, f"please call +1 {phone()} now or lot {lot()} b, ask me at home") for i in range(6000)]
    want = collections.Counter((kind, int(y)) for _, t in rows for (_, kind, _), y in pii.labelled_proposals(t))
    assert want[3, 1] > 10_500 and want[3, 0] > 1000 and want[0, 0] == 6000
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(right, wrong) for _, right, wrong, *_ in model.report] == [(want[k, 1], want[k, 0]) for k in range(4)]

    few = rows[:80]
    monkeypatch.setattr(pii, "FAN", 2)  # arrays of three tasks are added in tasks first
    distinct = pii.evidence(spark.createDataFrame(few, "doc_id long, text string")).count()
    two = [pii.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), task_rows=size) for r, n, size in ((few, 1, 10**6), (few[::-1], 7, distinct // 3 + 1))]
    plain = lambda m: repr((m.trees.base, [c.tolist() for c in m.trees.cuts], m.trees.grown, m.thresholds, m.slope, m.shift, m.report))
    assert plain(two[0]) == plain(two[1])


def test_trees_against_rows_in_memory(spark, monkeypatch):
    """The distributed trees score like trees grown on all rows in one place."""
    monkeypatch.setattr(pii.Boosted.__init__, "__defaults__", (4, 10, 0.3, 32))
    rng = random.Random(15)
    lot = lambda n: "-".join(str(rng.randint(10**k, 10 ** (k + 1))) for k in range(n))
    rows = [(i, f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or lot {lot(rng.randint(2, 4))} {lot(2)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df, task_rows=500).trees
    every = [r for r in pii.evidence(df).collect() for _ in range(r.n)]
    x, y, w = np.array([r.x for r in every], float), np.array([r.y for r in every]), np.array([r.w for r in every])
    w /= w.mean()
    slow = pii.Boosted()
    slow.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, slow.bins + 1)[1:-1])) for c in x.T]
    assert all(np.allclose(a, b) for a, b in zip(slow.cuts, model.cuts))
    share = np.average(y, weights=w)
    score, b = np.full(len(y), np.log(share / (1 - share))), slow.binned(x)
    assert math.isclose(model.base, score[0])
    for inner, value in model.grown:  # each tree: its gains and values from the rows themselves
        p = 1 / (1 + np.exp(-score))
        grad, hess, place = w * (p - y), w * p * (1 - p), np.zeros(len(y), int)
        for feature, cut in inner:
            for node in range(len(feature)):
                at = place == node
                gain = lambda low: sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in (at & low, at & ~low))  # noqa: B023, E731
                best = max(gain(b[:, j] <= c) for j in range(pii.FEATURES) for c in np.unique(b[at, j])) if at.any() else 0
                assert gain(b[:, feature[node]] <= cut[node]) >= best - 1e-6
            place = place * 2 + (b[np.arange(len(b)), feature[place]] > cut[place])
        low = np.array([-0.3 * grad[place == k].sum() / (hess[place == k].sum() + 1) for k in range(16)])
        assert np.allclose(low, value, atol=1e-6)
        score += low[place]
    assert np.abs(model.predict(x) / pii.SCORE_STEPS - score).max() < 1e-2


# 10: sharding


@pytest.mark.parametrize("bucket_bytes", [50, 1 << 20])
def test_shards(spark, tmp_path, bucket_bytes):
    rows = [(i, "x" * (i % 50)) for i in range(1000)] + [(3, None), (3, None), (None, "n")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, slots int").withColumn("size", sharding.text_bytes(F.col("text")))
    out = sharding.shard_rows(df, 8, ["doc_id", "text"], "size", bucket_bytes=bucket_bytes)
    got = out.collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(str, df.collect())) == sorted(str(r) for r in out.select(*df.columns).collect())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15
    assert sorted(map(str, sharding.shard_rows(df, 8, ["doc_id", "text"], "size", bucket_bytes=bucket_bytes).collect())) == sorted(map(str, got))
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.shard_rows(df.limit(0), 8, ["doc_id"], "size").count() == 0


# 11: manifest


def plain_manifest(rows):
    """``{(doc_id, leaf): (subroot, root, proof, folded)}`` of rows (doc_id, source, leaf, other), levels built one by one."""
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at - at % 3 : at - at % 3 + 3]
            out.append((run[: at % 3], run[at % 3 + 1 :]))
            at //= 3
        return out

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = tree([r[2] for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = collections.Counter()
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            node = r[3] or r[2]
            for before, after in steps:
                node = h("".join(before) + node + "".join(after))
            out[r[0], g, r[2], trees[g][-1][0], top[-1][0], "".join("".join(b + a) for b, a in steps), node] += 1
    return out


@pytest.mark.parametrize("levels", [2, 6])
def test_manifest_against_brute_force(spark, levels):
    rng, hexes = random.Random(3), lambda: f"{rng.getrandbits(256):064x}"
    rows = [(rng.choice([-1, 1]) * rng.randrange(10**rng.randint(1, 18)), rng.choice(["a", "a", "a", "ä", "b", "", None]), hexes(), rng.choice([None, hexes()])) for _ in range(150)]
    rows += [(i, "a", hexes(), None) for i in range(-70, 200)] + [(7, "one", hexes(), hexes())]
    rows += [rows[-2]] * 5 + [(None, "a", hexes(), None) for _ in range(4)] + [(5, "a", hexes(), None) for _ in range(3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, leaf string, other string, place int, g string").repartition(5)
    got = manifest.merkle_proofs(df, "source", "doc_id", "leaf", "other", levels).collect()
    assert collections.Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got) == plain_manifest(rows)
    assert manifest.merkle_proofs(df.limit(0), "source", "doc_id", "leaf", "other").count() == 0


def test_leaves_of_odd_rows(odd):
    import hashlib

    got = {(r.doc_id, r.h) for r in odd.select("doc_id", manifest.leaf_hash({c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}).alias("h")).collect()}
    for i, text, lang, source, n, _ in ODD:
        whole = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text))
        assert (i, hashlib.sha256(whole.encode()).hexdigest()) in got


# 12: spelling


def plain_forms(vocabulary):
    """``{word: (n_near, form, root)}`` by comparing all words that share a pattern with one letter open."""
    words_of = collections.defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            words_of[w[:i] + "\0" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in vocabulary:
                words_of[w, "gone"].add(w[:i] + w[i + 1 :])
                words_of[w[:i] + w[i + 1 :], "more"].add(w)
    near = {w: (set().union(*(words_of[w[:i] + "\0" + w[i + 1 :]] for i in range(len(w))), words_of[w, "gone"], words_of[w, "more"]) - {w}) for w in list(vocabulary)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-vocabulary[o], o), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 5 * vocabulary[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (len(near[w]), form[w], root(w)) for w in vocabulary}


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 40, "round_bytes": 1500}])
def test_forms_against_brute_force(spark, sizes):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcéÿz", k=rng.randint(6, 9))) for _ in range(60)] + ["x" * 70, "aàaàaà" * 15]
    vocabulary = {}
    for w in base:
        vocabulary[w] = rng.choice([1000, 5000, 700])
        for _ in range(5):
            i, c = rng.randrange(len(w)), rng.choice("abcéÿz")
            vocabulary.setdefault(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]), rng.choice([5, 20, 200, 200]))
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form, r.root) for r in spelling.spelling_forms(df, **sizes).collect()}
    assert got == plain_forms(vocabulary)
    assert spelling.spelling_forms(df.limit(0)).count() == 0


def test_typed_words_of_odd_texts(spark, odd):
    rows = [(i, t) for i, t, *_ in ODD] + [(9, "Éclair ÉCLAIR éclair naïve-naïveté x\u0131stanbul Ω" * 50)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    want = collections.Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 3 == 0 else run
            want[word] += len(word) >= 6
    assert collections.Counter(r.word for r in spelling.typed_words(df, every=3).collect()) == +want


# 13: decontamination


def plain_hits(docs, items, width):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    known = collections.defaultdict(set)
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            known[tuple(w[i : i + width])].add(item)
    out = collections.Counter()
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in known}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in known:
                    hit |= set(range(at, at + n))
                    found |= {str(x) for x in known[tuple(w[at : at + n])] if x is not None}
        out[i, len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("passes", [{}, {"windows_a_pass": 7, "shingles_a_pass": 11}])
def test_contamination_against_brute_force(spark, passes):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Straße", "x9", "of", "ÉTÉ", "q"] + [f"w{i}" for i in range(30)])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 30])))) for i in range(40)]
    items += [(3, items[7][1]), (None, items[9][1] + " null item"), (50, None), (51, " -- "), (52, items[8][1])]
    docs = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for _, t in rng.sample(items, rng.randint(0, 3)):
            at = rng.randint(0, len(parts))
            w = (t or "").split()
            parts[at:at] = w[rng.choice([0, 0, 1]) : len(w) - rng.choice([0, 0, 1])]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    docs += [docs[3]] * 3 + [(3, docs[5][1]), (None, items[9][1]), (None, None), (90, ""), (91, items[30][1] + " filler" * 20_000)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, mark int").repartition(3)
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, win string")
    got = decontaminate.contamination(d, b, **passes).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == plain_hits(docs, items, 10)
    assert {(r.n_hit, len(r["items"])) for r in decontaminate.contamination(d, b.limit(0)).collect()} == {(0, 0)}
    assert decontaminate.contamination(d.limit(0), b).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(12)
    en, fr = "the of and with river stone morning light walker".split(), "le la les avec été rivière pierre matin lumière".split()
    text = lambda w: " ".join(rng.choice(w) + rng.choice(["", "s", "x"]) + str(i) * 0 for i in range(rng.randint(60, 90)))
    docs = [(i, text(en if i % 2 else fr), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(120)]
    long = docs[7][1] + " mail me at jo.doe@example.com please"
    docs += [(200, long, "en", "s0", 0), (201, long, "en", "s1", 0), (202, long + " again", "en", "s1", 0), (203, None, "en", "s1", 0), (204, "12 34", "en", "s1", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {203, 204}
    one = corpus_pipeline.near_duplicates(spark, kept, "")
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)}
    assert {r.doc_id for r in one.collect()} == want and one.count() == len(want)
    clean = corpus_pipeline.personal_data(spark, one, "")
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert not any("@" in t for t in texts.values()) and set(texts) == want
    mix = corpus_pipeline.source_mix(spark, clean, "")
    assert mix.columns == df.columns and set(collections.Counter(r.doc_id for r in mix.collect()).values()) <= {1, 2}
    out = corpus_pipeline.tokens(spark, mix, "")
    assert out.count() == mix.count() and all(len(r.ids) == r.n_tokens for r in out.collect())


def test_pipeline_keeps_columns_of_any_name(spark):
    """Columns named like those the stages add, one of them a map, come out as they went in."""
    import corpus_pipeline

    rng = random.Random(13)
    words_of = {"en": "the of and with river stone morning light".split(), "fr": "le la les avec été rivière pierre matin".split()}
    extra = ["lang_rejected", "LANG_PRED", "pii_spans", "pii_text", "_place", "place", "_copies", "_size", "shard", "c0", "_k1"]
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "fr"
        body = " ".join(rng.choice(words_of[lang]) for _ in range(40)) + (f" a{i}@b.example.com" if i % 5 == 0 else "")
        rows.append((i, body, lang, f"s{i % 3}", len(body), *[f"{c}{i}" for c in extra], {"k": i}))
    fields = ", ".join(f"`{c}` string" for c in extra)
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {fields}, m map<string,int>")
    at = df
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, "")
        assert at.columns == df.columns, name
        at = spark.createDataFrame(at.collect(), df.schema)
    got = at.collect()
    assert got and all(r.m == {"k": r.doc_id} and all(r[c] == f"{c}{r.doc_id}" for c in extra) for r in got)
    assert not any("@" in r.text for r in got)
