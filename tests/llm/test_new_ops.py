"""Spelling variants, Merkle manifests and the Pitman-Yor model against brute-force versions and exact enumeration."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import hpylm, merkle, partenum

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, texts, lang=lambda i: "en", ids=None):
    rows = [(i if ids is None else ids[i], t, lang(i), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- spelling variants


def plain_counts(rows, every, least=6):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if every and doc_id is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return n


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, ratio=5):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def test_spelling_variants_match_brute_force(spark):
    rnd = random.Random(5)
    alphabet = "abcdeé×ÿ"
    stems = ["".join(rnd.choices(alphabet, k=rnd.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "éaaaaa", "abcdef", "fedcba"]
    words = []
    for s in stems:
        words += [s] * rnd.choice([5, 30, 200])
        for _ in range(6):
            i, c = rnd.randrange(len(s)), rnd.choice(alphabet)
            words += [rnd.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :]])] * rnd.choice([1, 5, 6, 40])
    rnd.shuffle(words)
    texts = [" ".join(w.upper() if rnd.random() < 0.1 else w for w in words[k : k + 60]) + " 12-x" for k in range(0, len(words), 60)] + [None, "", "short 漢字 words", "Ab" * 40_000, "word " * 50_000]
    ids = [None if i == 0 else i // 2 for i in range(len(texts))]
    df = frame(spark, texts, ids=ids).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    for every in (None, 7):
        want = plain_forms({w: n for w, n in plain_counts(list(zip(ids, texts, strict=True)), every).items() if n >= 5})
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in partenum.spelling_variants(df, typo_every=every).collect()}
        assert got == want and sum(v[0] is not None for v in want.values()) > 10
    assert partenum.spelling_variants(df.where("false")).count() == 0


def test_spelling_pairs_of_other_partitions(spark):
    words = sorted({"".join(p) for p in product("ab", repeat=5)} | {"", "a", "b", "ab", "ba", "aab"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) for a in words for b in words if a and b and a != b and one_edit(a, b))
    for first, second in ((1, 4), (1, 3), (2, 3)):
        got = sorted((r.word, r.other) for r in partenum.near_pairs(df, first, second).collect())
        assert got == want
    with pytest.raises(ValueError):
        partenum.kept_parts(2, 1, 2)


def test_signatures_are_not_broadcast_however_small_the_words_look(spark, monkeypatch):
    words = partenum.staged(spark.createDataFrame([("abcdef", 60), ("abcdeg", 9), ("abcdefg", 7)], "word string, n long"), "words")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(partenum.near_pairs(words)) and "Broadcast" not in plan(partenum.near_pairs(words))
    monkeypatch.setattr(partenum, "BROADCAST_FORMS", 0)
    forms = partenum.spelling_forms(words)
    assert "Broadcast" not in plan(forms) and {r.word: r.form for r in forms.collect()} == {"abcdef": None, "abcdeg": "abcdef", "abcdefg": "abcdef"}


# ---- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """leaf, subroot, root and proof levels of each (doc_id, source, lang, n_chars, text), in leaf order of its language."""
    leaf = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    levels = lambda xs: [xs] if len(xs) == 1 else [xs, *levels([H(*xs[i : i + 8]) for i in range(0, len(xs), 8)])]

    def proof(tree, i):
        out = []
        for level in tree[:-1]:
            lo = i // 8 * 8
            out.append((level[lo:i], level[i + 1 : lo + 8]))
            i //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        trees[x] = levels([d for _, d in sorted(((r[0] is not None, r[0] or 0), leaf(r)) for r in rows if r[2] == x)])
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, d in enumerate(trees[x][0]):
            out.append((d, trees[x][-1][0], top[-1][0], proof(trees[x], i) + proof(top, k)))
    return out


@pytest.mark.parametrize("n,langs", [(1, 1), (9, 1), (600, 3), (40, 20)])
def test_manifest_matches_brute_force(spark, n, langs):
    rnd = random.Random(n)
    texts = [rnd.choice([None, "", "Ab c", "é漢字", "Y" * 3000]) for _ in range(n)]
    names = [None, "en", "de", "Zz", "é", *(f"l{k}" for k in range(20))][: langs + 1]
    rows = [(None if i == 5 else i // 2, f"s{i % 3}", rnd.choice(names[1:] if langs == 1 else names), None if texts[i] is None else len(texts[i]), texts[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("root", F.lit("x")).withColumn("n", F.lit(0)).withColumn("rank", F.lit(0))
    got = merkle.verify(merkle.manifest(df), F.col("leaf")).collect()
    want = plain_manifest(rows)
    assert sorted((r.leaf, r.subroot, r.root, str([(p.left, p.right) for p in r.proof])) for r in got) == sorted((a, b, c, str(p)) for a, b, c, p in want)
    assert all(r.verified for r in got) and {r.root for r in got} == {want[0][2]}


def test_manifest_finds_tampering_and_takes_hot_groups(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, ["Same Text"] * 500 + [f"Text {i}" for i in range(200)], ids=[7] * 500 + list(range(200)))
        low = merkle.leaf_hash(*[F.col(c) for c in merkle.COLUMNS[:-1]], merkle.lower_ascii(F.col("text")))
        rows = merkle.manifest(df, extra={"changed": F.when(F.col("doc_id") % 2 == 0, low)})
        got = merkle.verify(rows, F.coalesce("changed", "leaf")).collect()
        assert len(got) == 700 and all(r.verified == (r.doc_id % 2 == 1) for r in got)
        assert sorted(r.rank for r in got) == list(range(700))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert merkle.manifest(df.where("false")).count() == 0


# ---- Pitman-Yor model


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_seats_follow_the_exact_distribution():
    """Tables of dishes of 3 customers against enumeration of their seatings, and sums over larger ones."""
    d, theta, p, rest = 0.6, 1.0, 0.3, 4
    weight = lambda t: math.prod((theta + d * (rest + j)) * p for j in range(t))
    one, two, three = weight(1) * (1 - d) * (2 - d), 3 * weight(2) * (1 - d), weight(3)
    n = 40_000
    t = hpylm.seats(np.full(n, 3), np.full(n, p), np.full(n, rest), theta, d, np.random.default_rng(1))
    share = np.bincount(t, minlength=4)[1:] / n
    assert share == pytest.approx(np.array([one, two, three]) / (one + two + three), abs=0.015)
    mixed = np.array([1, 2, 5, 64, 65, 5000])
    t = hpylm.seats(mixed, np.full(6, 1e-3), np.zeros(6, int), theta, d, np.random.default_rng(2))
    assert (t >= 1).all() and (t <= mixed).all() and t[0] == 1


def test_scores_count_exactly(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(vocabulary[: rnd.choice([3, 30])], k=rnd.choice([1, 5, 40]))) for _ in range(60)] + [None, "", " \t\n", "W1  w1 x", "w2 " * 30_000]
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    probes = [*vocabulary, "unseen", "w1 unseen"]
    df = frame(spark, texts + probes, ids=ids + [1000 + i for i in range(len(probes))])
    df = df.withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit(1)).withColumn("chunk", F.lit(1))
    learn = (F.col("doc_id") < 1000) & (F.col("doc_id") % 5 != 0)
    got = hpylm.score(df, learn).collect()
    c = Counter(x for i, t in zip(ids, texts, strict=True) if i is not None and i % 5 for x in tokens(t))
    total, size = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[x] + 1) / (total + size + 1)) for x in tokens(t))
    plain = sorted((str(i), str(not (i is not None and i < 1000 and i % 5)), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), total, round(base(t), 6)) for i, t in zip(ids + [1000 + k for k in range(len(probes))], texts + probes, strict=True))
    assert sorted((str(r.doc_id), str(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain
    assert all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_predictive_probabilities_of_a_restaurant_sum_to_one():
    gen = np.random.default_rng(4)
    t = gen.integers(0, 9, 50)
    top = np.minimum(t, gen.integers(1, 4, 50))
    sums = type("Sums", (), {"v": 50, "tables": int(t.sum()), "top": int(top.sum())})
    p = hpylm.parent(t, top, sums, 0.4)
    unseen = hpylm.parent(np.zeros(1), np.zeros(1), sums, 0.4)[0]
    assert p.sum() + unseen == pytest.approx(1)
    c = gen.integers(0, 12, 51)  # the last for the unseen word, which has no customers
    c[-1] = 0
    tables = np.minimum(c, 2)
    d, theta = 0.7, hpylm.STRENGTH
    whole = (c - d * tables + (theta + d * tables.sum()) * np.r_[p, unseen]) / (theta + c.sum())
    assert whole.sum() == pytest.approx(1) and (whole > 0).all()


def test_model_learns_word_pairs(spark):
    """In planted texts each word has one successor; held-out texts of the same kind are far likelier than their counts say."""
    rnd = random.Random(7)
    follow = {i: rnd.randrange(200) for i in range(200)}

    def text():
        x, out = rnd.randrange(200), []
        for _ in range(30):
            out.append(f"w{x}")
            x = follow[x] if rnd.random() < 0.9 else rnd.randrange(200)
        return " ".join(out)

    df = frame(spark, [text() for _ in range(400)])
    held = hpylm.score(df, F.col("doc_id") % 4 != 0).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-held.s / held.n) < 0.35 * 10 ** (-held.b / held.n)
    assert hpylm.score(df.where("false"), F.lit(True)).count() == 0
    alone = hpylm.score(df.limit(3), F.lit(False)).collect()
    assert len(alone) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(0) for r in alone)


def test_chunks_and_blocks_change_no_count(spark, monkeypatch):
    rnd = random.Random(9)
    df = frame(spark, [" ".join(f"v{int(rnd.expovariate(0.05))}" for _ in range(50)) for _ in range(80)])
    cols = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
    whole = sorted(hpylm.score(df, F.col("doc_id") % 3 != 0).select(*cols).collect())
    monkeypatch.setattr(hpylm, "CHUNK", 120)
    monkeypatch.setattr(hpylm, "BLOCK_CHARS", 1500)
    parts = sorted(hpylm.score(df, F.col("doc_id") % 3 != 0).select(*cols).collect())
    assert [r[:4] for r in whole] == [r[:4] for r in parts] and [r[4] for r in whole] == pytest.approx([r[4] for r in parts])
