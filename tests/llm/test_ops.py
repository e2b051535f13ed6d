"""The training-data operators on small cases, against brute-force versions and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import chat, decontam, htmlwrap, knn, langid, license, neardup, packing, quality, queries, tokenbin

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=None):
    rows = [(i, t, "en", (source or "s") if source is None else source[i % len(source)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    words = [rnd.choice("abcdef") * rnd.randint(1, 4) + str(rnd.randint(0, 50)) for _ in range(400)]
    base = " ".join(words[:120])
    near = [" ".join(w if i not in hit else "zz" for i, w in enumerate(words[:120])) for hit in ({3}, {3, 70}, {5, 50, 100}, set(range(0, 120, 7)))]
    long = " ".join(rnd.choices(words, k=30_000))
    return [None, "", "   \n\t", "one", "one", "ONE", "one two three", "é 漢字 ß", base, base, base.upper(), *near, long, long + " x", "dup " * 40, "dup " * 80]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, odd, width):
    df = docs(spark, odd).withColumn("rep", F.lit("x")).withColumn("cluster", F.lit(1))
    got = {r.doc_id: r for r in neardup.near_duplicates(df, width=width).collect()}
    sets = [shingles(t, width) for t in odd]
    comp = list(range(len(odd)))
    for _ in odd:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert [got[i].component_id for i in range(len(odd))] == comp
    assert [got[i].n_shingles for i in range(len(odd))] == [len(s) for s in sets]
    assert all(got[i].kept == (comp[i] == i) for i in got)


def test_near_duplicates_of_no_rows_and_null_ids(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(rows).orderBy("doc_id").collect()]
    assert got == [(None, None, True), (None, None, True), (3, 3, True), (3, 3, True)]


def test_large_buckets_and_clusters_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 1000)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in rnd.sample(range(150), rnd.randint(0, 5)):
            w[i] = f"x{rnd.random()}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts), width=4).collect()}
    sets, comp = [shingles(t, 4) for t in texts], list(range(60))
    for _ in texts:
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert [got[i] for i in range(60)] == comp


def test_signature_estimates(spark):
    make, sign = neardup.Shingler(4), neardup.Signer()
    a = [f"w{i}" for i in range(400)]
    b = a[:300] + [f"v{i}" for i in range(100)]
    x, y = make(" ".join(a).encode()), make(" ".join(b).encode())
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(float(neardup.estimate(sign(x)[1], sign(y)[1])) - true) < 0.15
    assert float(neardup.estimate(sign(x)[1], sign(x)[1])) == 1


def test_top_k_matches_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    v = np.r_[rnd.normal(size=(120, 6)), np.zeros((3, 6)), np.ones((5, 6))].astype(float)
    more = [(7, [float(x) for x in v[7]]), (7, [3.0] * 6), (20, [2.0] * 6), (3, [1.0, 2.0]), (4, [5.0, 1.0]), (10, [1.0, 1.0]), (10, [0.0, 4.0])]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, []), (204, [1.0]), (None, [1.0] * 6), *more]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)).withColumn("q", F.lit("x"))
    valid = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x)]
    want = {}
    for q, a in valid:
        if q % 10 == 0:
            want.setdefault(q, []).extend((-int(a @ b), i) for i, b in valid if i != q and len(a) == len(b))
    want = {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(x)[:5])] for q, x in want.items() if x}
    for group, chunk in ((8192, 32768), (3, 7)):
        monkeypatch.setattr(knn, "QUERY_GROUP", group)
        monkeypatch.setattr(knn, "CHUNK", chunk)
        got = {}
        for r in knn.top_k(df, F.col("vec_id") % 10 == 0, 5).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: sorted(x) for q, x in got.items()} == want
    few = df.where("vec_id in (0, 1, 2)")
    assert knn.top_k(few, F.col("vec_id") == 0, 5).count() == 2
    assert knn.top_k(df.where("false"), F.col("vec_id") == 0, 5).count() == 0
    assert knn.top_k(df, F.col("vec_id") == -1, 5).count() == 0


def test_top_k_sends_clustered_vectors_only_where_they_can_matter(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(20, 8)) * 4
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[np.arange(2000) % 20] + rnd.normal(size=(2000, 8)) * 0.01
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    sent = []
    real = type(df).mapInArrow

    def counted(self, f, schema, *rest):
        out = real(self, f, schema, *rest)
        if f.__name__ == "send":
            sent.append(out.count() / 2000)
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(knn, "QUERY_GROUP", 10)
        m.setattr(type(df), "mapInArrow", counted)
        got = knn.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    e = np.floor(256 * v).astype(int)
    for r in got:
        s = e @ e[r.query_id]
        s[r.query_id] = -(10**9)
        assert np.lexsort((np.arange(2000), -s))[r["rank"] - 1] == r.vec_id
    assert len(got) == 200 and sent and sent[0] < 2


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", r"a<\|end|> <|end|> <<SYS>> [\[INST] \<s>\\<|<||", "", None, "line\n" * 3, "漢字 😀", "<|turn|>user<|text|>x"]
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<|turn|>"]), rnd.choice(texts)) for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(99, None, "assistant", "null turn"), (99, 1, "user", "x"), (99, 1, "user", "x"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.expand(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[1]}\n{x[2]}\n" for x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    n = sum(max(1, sum(x[1] == "assistant" for x in t)) if t[-1][1] == "assistant" or not any(x[1] == "assistant" for x in t) else 1 + sum(x[1] == "assistant" for x in t) for t in by.values())
    assert chat.expand(df).count() == n
    assert chat.digests(chat.expand(df.where("false"))).count() == 0
    lone = df.withColumn("conv_id", F.lit(None).cast("long"))
    assert chat.digests(chat.expand(lone)).where("n_turns = 1").count() == len(rows)
    long = spark.createDataFrame([(1, 1, "user", "a [INST] " * 40_000), (1, 2, "assistant", "漢 </s>" * 40_000)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.expand(long)).first().loss_chars == 6 * 40_000


def test_decontamination(spark):
    item = "A train goes 60 km in 2 hours and then John rides home with 60 km left over."
    texts = [f"Before it. {item} After it", item.replace("60", "75").replace("2", "3").replace("John", "Mary"), item.replace("with 60", "with 61"), None, "", "clean words only and nothing else to be found here", item.upper(), "short words here now go"]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "tiny item"), (10, "short words here now go"), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert {(0, 7), (1, 7), (2, 7), (6, 7), (7, 10)} == set(got)  # 2: one of two equal numbers changed, all else verbatim
    assert got[(1, 7)].n_changed > 0 and got[(0, 7)].n_changed == 0
    kept = decontam.decontaminate(docs(spark, texts), bench)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontam.contaminated(docs(spark, texts), bench.where("false")).count() == 0


def test_decontamination_tests_slots_per_window(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    item = f"{' '.join(words)} has 3 {' '.join(words[::-1])} or 3 {' '.join(words[2:])}"
    fruit, units = "one boy buys 3 apples and 5 pears then leaves", "first it runs 7 km and then just 9 m back"
    texts = [item.replace("or 3", "or 4"), fruit.replace("3", "4").replace("5", "4"), units.replace("7 km", "7 m"), item.replace("3", "8"), "one boy buys apples and pears then leaves"]
    bench = spark.createDataFrame([(1, item), (2, fruit), (3, units)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert {(0, 1), (1, 2), (2, 3), (3, 1)} == set(got)
    assert all(r.coverage == 1 for r in got.values())
    assert [got[k].n_changed for k in sorted(got)] == [1, 2, 1, 1]


def test_decontamination_reads_names_with_and_without_marks(spark):
    items = ["we saw Paris in the", "Alice and who else left the small old house", "he ran 60 Km/h past London with Bob, and Bob fell down there"]
    texts = ["yes we saw Paris\nin the rain", "they saw  Paris, and then Alice and who else left the small\told house", "and we saw\u00a0 Rome\nin the rain", "he ran\n75 Km/h past\nParis with  Tom and\nTom, fell down there"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert {(0, 0), (1, 1), (2, 0), (3, 2)} == set(got)
    assert all(r.coverage == 1 for r in got.values())
    assert [got[k].n_changed for k in sorted(got)] == [0, 0, 1, 3]


def plain_tokens(text, names):
    """Tokens as (mark, value): 1 number, 2 unit, 3 name, 0 word; by one scan from left to right."""
    import regex

    text = regex.sub(r"[\s\p{Z}\x01-\x03\x85]+", " ", text or "")
    number = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
    unit = rf"(?<u>{number})\s?(?<n>(?i:{decontam.UNITS})|%|€|\$|£)(?![\p{{L}}\p{{Nd}}])"
    plain = rf"(?<![\p{{L}}\p{{Nd}}])(?<p>{number})(?![\p{{L}}\p{{Nd}}])"
    out = []
    for m in regex.finditer(rf"{unit}|{plain}|(?<w>[\p{{L}}\p{{Nd}}]+)", text):
        if m["u"]:
            out += [(1, m["u"].lower()), (2, m["n"].lower())]
        elif m["p"]:
            out.append((1, m["p"]))
        else:
            before = text[max(0, m.start() - 2) : m.start()]
            marked = names and regex.fullmatch(r"\p{Lu}\p{Ll}+", m["w"]) and regex.fullmatch(r"[\p{L}\p{Nd},;:] ", before)
            out.append((3 if marked else 0, m["w"].lower()))
    return out


def plain_contamination(text, item, window=8, shortest=4, literals=4, coverage=0.5, least=13):
    covered, n_item = set(), 0
    for bn in (True, False):
        b = plain_tokens(item, bn)
        if not b:
            continue
        n_item = len(b)
        width = min(window, len(b))
        for dn in (True, False):
            d = plain_tokens(text, dn)
            if len(b) < shortest and len(d) != len(b):
                continue
            for i in range(len(b) - width + 1):
                for j in range(len(d) - width + 1):
                    x, y = b[i : i + width], d[j : j + width]
                    if all(p[0] == q[0] and (p[0] or p[1] == q[1]) for p, q in zip(x, y, strict=True)):
                        changed = {(p[1], q[1]) for p, q in zip(x, y, strict=True) if p[0] and p[1] != q[1]}
                        if len({p for p, _ in changed}) == len(changed) and (not changed or sum(not p[0] for p in x) >= literals):
                            covered.update(range(i, i + width))
    return n_item and (len(covered) / n_item >= coverage or len(covered) >= least)


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(12)
    words, names, units = "the train and a boat went over hills with long rivers near old towns".split(), ["Paris", "Anna", "Bob", "Rome"], ["km", "kg", "hours", "m", "%"]

    def piece():
        x = rnd.random()
        return str(rnd.randint(1, 9)) if x < 0.1 else f"{rnd.randint(1, 9)} {rnd.choice(units)}" if x < 0.2 else rnd.choice(names) if x < 0.32 else rnd.choice(words)

    def changed(parts):
        out = []
        for w in parts:
            x = rnd.random()
            if w[0].isdigit() and x < 0.5:
                w = str(rnd.randint(1, 9)) + w[1:]
            elif w in names and x < 0.4:
                w = rnd.choice(names)
            elif x < 0.06:
                w = rnd.choice(words)
            out.append(w + rnd.choice([" "] * 8 + [", ", "\n"]))
        return "".join(out)

    items = [[piece() for _ in range(rnd.choice([4, 5, 7, 9, 14, 25, 40]))] for _ in range(14)]
    texts = [" ".join(rnd.choices(words, k=6)) + " " + changed(x) + " ".join(rnd.choices(words, k=6)) for x in items for _ in range(4)]
    texts += [changed(x[: len(x) // 2]) + changed(rnd.choice(items)[3:]) for x in items]
    long_item = " ".join(f"plain{i}" for i in range(33)) + " and 5 of them then 5 more"
    items.append(long_item.split(" "))
    texts += [long_item.replace("5 more", "6 more"), " ".join(long_item.split()[:33]), ("filler " * 300_000) + long_item]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    df = docs(spark, texts).withColumn("item_id", F.lit(1)).withColumn("h", F.lit(2))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df.union(df), bench.union(bench)).collect()}
    want = {(i, j) for i, t in enumerate(texts[:-1]) for j, x in enumerate(items) if plain_contamination(t, " ".join(x))} | {(len(texts) - 1, len(items) - 1)}
    assert len(want) > 30 and got == want
    assert {(len(texts) - k, len(items) - 1) for k in (1, 2, 3)} <= got


def test_decontamination_needs_words_in_a_template(spark):
    items = [" ".join(str(n) for n in range(12, 54, 3)), "what is photosynthesis exactly", "Yes, indeed", "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida Jan Kai Leo"]
    texts = ["Sales by month were " + " ".join(str(n) for n in range(900, 1000, 7)) + " in total", "so what is photosynthesis exactly then", "yes indeed", "well yes indeed it is", "list: " + items[0], "with Kim Lea Max Nina Olaf Paul Quinn Rosa Sven Tom Ulf Vera and", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(1, 1): 0, (2, 2): 0, (4, 0): 0}


def test_decontamination_of_number_tables_stays_small(spark):
    rnd = random.Random(4)
    numbers = lambda n: " ".join(str(rnd.randint(0, 10**6)) for _ in range(n))
    bench = spark.createDataFrame([(i, numbers(60)) for i in range(20)], "item_id long, text string")
    assert decontam.contaminated(docs(spark, [numbers(3000)]), bench).count() == 0


def test_packing_keeps_every_token_and_every_constraint(spark):
    rnd = random.Random(6)
    texts = [" ".join(["w"] * rnd.choice([0, 1, 5, 40, 99, 100, 101, 350])) for _ in range(300)] + [None]
    df = docs(spark, texts, source=["hot", "hot", "a", None])
    rows = packing.pack(df, packing.count_words(F.col("text")), F.col("doc_id") % 5, capacity=100, shard_rows=80).collect()
    assert {r.doc_id for r in rows} == set(range(301))
    by_doc, bins = {}, {}
    for r in rows:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.size
        if r.bin is not None:
            bins.setdefault((r.shard, r.bin), []).append(r)
    assert all(by_doc[i] == len((t or "").split()) for i, t in enumerate(texts))
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        assert sum(r.size for r in b) == b[0].bin_used <= 100
        assert all(x.bin_offset + x.size == y.bin_offset for x, y in zip(b, b[1:], strict=False))
        sources = [["hot", "hot", "a", None][r.doc_id % 4] for r in b if r.doc_id < 300]
        named = [s for s in sources if s]
        assert len(named) == len(set(named)) and len({r.doc_id % 5 for r in b}) == len(b)


def test_packing_deals_repeated_rows_over_all_shards(spark):
    df = docs(spark, ["w " * 60] * 400).withColumn("doc_id", F.lit(None).cast("long")).withColumn("shard", F.lit("x")).withColumn("size", F.lit("y"))
    rows = packing.pack(df, packing.count_words(F.col("text")), packing.same_text(F.col("text")), capacity=100, shard_rows=50).collect()
    shards = {}
    for r in rows:
        shards[r.shard] = shards.get(r.shard, 0) + 1
    assert len(rows) == 400 and len(shards) == 8 and max(shards.values()) < 90
    one = packing.pack(df, packing.count_words(F.col("text")), packing.same_text(F.col("text")), capacity=100, shards=1).collect()
    assert {r.shard for r in one} == {0} and len({r.bin for r in one}) == 400
    assert packing.pack(df.where("false"), F.lit(1), F.lit(1)).count() == 0


def test_best_fit_is_the_tightest_compatible_bin():
    rnd = random.Random(8)
    items = [(rnd.randint(1, 60), rnd.randint(-1, 3), rnd.randint(-1, 9)) for _ in range(200)]
    got = packing.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 100)
    rooms, held = [], []
    for (size, s, c), (b, offset) in zip(items, got, strict=True):
        ok = [k for k, room in enumerate(rooms) if room >= size and (s < 0 or s not in held[k][0]) and (c < 0 or c not in held[k][1])]
        want = min(ok, key=lambda k: (rooms[k], k)) if ok else len(rooms)
        if want == len(rooms):
            rooms.append(100)
            held.append((set(), set()))
        assert (b, offset) == (want, 100 - rooms[want])
        rooms[want] -= size
        held[want][0].add(s)
        held[want][1].add(c)


def plain_licences(texts):
    """labels, score and base places of each text, by trying every template at every start."""
    split = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    held = {}
    for w in split:
        for x in set(w):
            held[x] = held.get(x, 0) + 1
    idf = lambda w: np.log((1 + len(texts)) / (1 + held.get(w, 0))) + 1
    out = []
    for w in split:
        places = sorted((k, label) for k in range(len(w)) for p, label in license.BASE_PHRASES.items() if w[k : k + len(p.split())] == p.encode().split())
        labels, best = {p[1] for p in places}, 0.5 if places else 0.0
        for name, (text, phrases) in license.TEMPLATES.items():
            text, phrases = text.encode().split(), [p.encode().split() for p in phrases]
            voters = sorted(set(text) & set(w), key=lambda x: (-idf(x), x))[: license.VOTERS]
            weight = sum(idf(x) for x in text)
            for start in range(-len(text), len(w)):
                here = [j for j, x in enumerate(text) if 0 <= start + j < len(w) and w[start + j] == x]
                share = sum(idf(text[j]) for j in here) / weight
                near = w[max(0, start - 4) : max(0, start + len(text) + 8)]
                agree = [idf(x) for x in voters if any(text[j] == x for j in here)]
                if share >= 0.4 and len(agree) >= 2 and sum(agree) >= 0.5 * sum(map(idf, voters)) - 1e-9 and all(any(near[j : j + len(p)] == p for j in range(len(near))) for p in phrases):
                    labels.add(name)
                    best = max(best, share)
        out.append((len(w), places, ",".join(sorted(labels)), best))
    return out


def test_license_scan_matches_brute_force(spark, odd):
    rnd = random.Random(11)
    full = [t for t, _ in license.TEMPLATES.values()]
    texts = [x for x in odd if len(x or "") < 5000]
    texts += ["All Rights Reserved. all rights\nreserved", "CC BY-NC 4.0 cc-by", "GNU General Public License, version 3 general public license version 3 all rights reserved", "Licensed under the Apache License, Version 2.0.", "apache pie version 2.0", "Released under the MIT License."]
    n = len(texts) - 6
    for t in full:
        texts += ["x y " + t + " z", t.upper(), " ".join(x if rnd.random() < 0.8 else "zz" for x in t.split()), " ".join(t.split()[: rnd.randint(3, len(t.split()))]), " ".join(rnd.choices(t.split(), k=40)), t[: len(t) // 2] + " and " + rnd.choice(full)]
    df = docs(spark, texts).withColumn("labels", F.lit("x")).withColumn("score", F.lit(1)).withColumn("w", F.lit(2))
    got = {r.doc_id: r for r in license.scan(df.union(df)).collect()}
    want = plain_licences(texts + texts)
    for i in range(len(texts)):
        r, (size, places, labels, best) = got[i], want[i]
        assert (r.n_words, r.n_base, r.labels) == (size, len(places), labels)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert r.score == pytest.approx(best)
    assert got[n + 3].labels == "apache-2.0" and got[n + 4].labels == "" and got[n + 5].labels == "mit"
    assert "cc-by-nc-4.0" in got[n + 1].labels and "gpl-3.0" in got[n + 2].labels
    assert license.scan(df.where("false")).count() == 0


def test_licence_labels_rest_on_votes_that_agree():
    index = license.Index(license.TEMPLATES, {}, 10)
    text = license.words(b"x " + license.TEMPLATES["mit-text"][0].encode())
    assert "mit-text" in index.scan(text)[1]
    alone = license.Index(license.TEMPLATES, {}, 10)  # each template keeps the postings of its rarest word only
    for k, words in enumerate(alone.texts):
        for w in sorted(set(words), key=alone.order.__getitem__)[1:]:
            alone.postings[w].pop(k, None)
    assert "mit-text" not in alone.scan(text)[1]
    shuffled = list(text)
    random.Random(1).shuffle(shuffled)
    assert index.starts(shuffled) == [] or not index.scan(shuffled)[1]


def test_language_and_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op7_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 60").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    q = queries.op10_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((q.predicted == 1) == (q.quality == 1)).mean() > 0.8


def test_classifiers_on_odd_rows(spark, odd):
    df = docs(spark, [*odd, "123 !!! ..."])
    p = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    assert all(p[i].lang_pred == "und" and p[i].score == 0 for i in (0, 1, 2, len(odd)))
    assert all(0 <= r.score <= 1 for r in p.values())
    assert langid.predict(df, {}).where("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(3, 1), (3, 0), (8, 1), (17, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    s = quality.score(df, quality.fit(df, labels)).collect()
    assert len(s) == len(odd) + 1 and all(0 <= r.score <= 1 for r in s)
    assert quality.score(df, quality.fit(df, labels.where("false"))).first().score == 0.5
    assert quality.keep_good(df, quality.fit(df, labels)).columns == df.columns
    wide = df.union(df).withColumn("score", F.lit("x")).withColumn("rank", F.lit("y")).withColumn("label", F.lit(3)).withColumn("lang_pred", F.lit("z"))
    assert (quality.fit(wide, labels) == quality.fit(df, labels)).all()
    again = quality.score(wide, quality.fit(df, labels)).collect()
    assert len(again) == 2 * len(s) and {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in s}
    assert len(langid.predict(wide, langid.fit(df)).collect()) == 2 * len(p)
    empty = df.where("false")
    assert quality.score(empty, quality.fit(empty, labels)).count() == langid.predict(empty, langid.fit(empty)).count() == 0
    odd_ids = spark.createDataFrame([(1, "good words here"), (1, "other words there"), (None, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert (quality.fit(odd_ids, one) == quality.fit(odd_ids.orderBy(F.desc("text")), one)).all()


def test_languages_of_every_script_and_equal_cosines(spark):
    texts = ["ꀀꀁꀂꀃ ꀄꀅꀆ", "ㄅㄆㄇ ㄈㄉㄊ", "𝐚𝐛𝐜 𝐝𝐞𝐟", "ꙀꙁꙂꙃ ꙄꙅꙆ", "Даже бы", "даже БЫ", "12 !?", "x" * 3_000_000]
    df = spark.createDataFrame([(i, t, f"l{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    made = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, made).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["l0", "l1", "l2", "l3", "l4", "l4", "und", "l7"]
    assert (langid.Profiles._vector(ord("ꀀ")) != langid.Profiles._vector(ord("ꀁ"))).any()
    tie = {"b": made["l0"], "a": made["l0"]}
    assert langid.predict(df.where("doc_id = 0"), tie).first().lang_pred == "a"


def test_token_files_round_trip(spark, odd, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    rnd = random.Random(9)
    bits = ["a", "Word", " ", "  ", "\n", "\t", "é", "1", "'s", ".", ",", ".\n", "<|endoftext|>", "\x85", "\0", "_", "!", "漢", "\u2003", "\u2019", "\u201c", "\u00d7", "\u00f1", " the", "\r\n"]
    texts = [*odd, *["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(500)]]
    out = tokenbin.write(docs(spark, texts), path, path=f"file://{tmp_path}/t")
    got = sorted(tokenbin.read(spark, out).collect(), key=lambda r: r.doc_id)
    t = tokenizers.Tokenizer.from_file(path)
    at = 0
    for r, e in zip(got, t.encode_batch([x or "" for x in texts], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens


def test_token_blocks():
    r = np.random.default_rng(1).integers(0, 1 << 26, 1001)
    ids, counts, ranks = tokenbin.read_block(tokenbin.block_bytes([5, 6], [1000, 1], r))
    assert list(ids) == [5, 6] and list(counts) == [1000, 1] and (ranks == r).all()
    with pytest.raises(ValueError):
        tokenbin.read_block(b"nope")


def test_html_extraction(spark):
    page = """<html><head><title>t</title><script>var x="<p>no</p>"</script></head><body><header><h1>Site</h1></header><div class="menu"><a>m</a></div><div id="content"><h2>A &amp; B</h2><p>One<br>two <b>three</b>
 four</p><ul><li>x<li>y</ul><div class="comments"><p>nice</p></div><form><p>f</p></form></div><aside>s</aside><div class="cookie-notice">c</div><footer>f</footer></body></html>"""
    art = "<body><nav>n</nav><article><h1>T&eacute;</h1><p><b>a<br><p>b &lt; c</p><!-- no --><aside>z</aside></article><p>after</p></body>"
    rows = [(1, "http://a.example/x", page), (2, "http://a.example/y", page.replace("One", "Uno")), (3, "http://b.example/", art), (4, None, None), (5, "not a url", ""), (None, "http://a.example/z", "plain"), (3, "http://b.example/", art)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit(1)).withColumn("host", F.lit(2))
    got = [(r.page_id, r.text, r.n_chars) for r in htmlwrap.extract(df).collect()]
    want = {1: "A & B\nOne two three four\nx\ny", 2: "A & B\nUno two three four\nx\ny", 3: "Té\na\nb < c", 4: "", 5: "", None: "plain"}
    assert len(got) == 7 and all(t == want[i] and n == len(t) for i, t, n in got)


def test_html_attributes_and_names_that_only_look_like_boilerplate(spark):
    pages = [
        '<body><article><div class="article-header"><h1>Title</h1></div><div class="comment-on-law"><p>Body</p></div><p>rest</p></article></body>',
        "<body><p title=it's>One</p><p data-x=a/b'c\">two</p></body>",
        '<body><main><header><h1>T</h1></header><p hidden>no</p><p title="a > b" class=x>yes</p><div id="comments"><p>no</p></div><div class="user-comments list"><p>no</p></div><div class="adverse">ok</div></main></body>',
        "<p>1 < 2 & 3 &gt; 2</p><p>unclosed <b>bold<p>next",
        "<p>" + "long words " * 200_000 + "</p>",
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmlwrap.extract(df).collect()}
    assert [got[i] for i in range(4)] == ["Title\nBody\nrest", "One\ntwo", "T\nyes\nok", "1 < 2 & 3 > 2\nunclosed bold\nnext"]
    assert got[4] == ("long words " * 200_000).strip()
    assert htmlwrap.extract(df.where("false")).count() == 0


def test_html_of_a_host_that_only_its_wrapper_explains(spark):
    def page(i, n, extra=""):
        body = "".join(f"<div>Sentence {i} {k} of the text.</div>" for k in range(n))
        return f"<html><body><div><div>My Site</div><div><a href=/a>Home</a> <a href=/b>About</a></div></div><div><h2>Head {i}</h2>{body}<h4>Tell your friends</h4>{extra}</div><div>All rights ours</div></body></html>"

    rows = [(i, "http://plain.example/p", page(i, 2 + i % 4)) for i in range(12)]
    rows.append((99, "http://plain.example/p", page(99, 3, "<table><tr><td>new form</td></tr></table>")))
    got = {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == "\n".join([f"Head {i}", *(f"Sentence {i} {k} of the text." for k in range(2 + i % 4))])
    assert got[99].split("\n")[0] == "Head 99" and "new form" in got[99]  # a page of another form
    made = htmlwrap.wrappers(spark.createDataFrame(rows[:12], "page_id long, url string, html string")).first()
    assert "My Site" in made.wrapper and "#" in made.wrapper and made.n_sample == 8


def test_wrappers_are_shared_out_when_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(htmlwrap, "BROADCAST_CHARS", 0)
    rows = [(i, f"http://h{i % 3}.example/", f"<body><nav>n</nav><div><p>text {i}</p></div></body>") for i in range(30)]
    got = {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" for i in range(30)}


def test_wrappers_repeat_and_option():
    w = htmlwrap.align(htmlwrap.fold(["<p>", ["#", "a"], "</p>"] * 3), ["<h1>", ["#", "t"], "</h1>"] + ["<p>", ["#", "b"], "</p>"] * 4)
    assert htmlwrap.shown(w) == "(<h1>#</h1>)?(<p>#</p>)+"
    nav = lambda n, x: ["<ul>", *["<li>", ["#", x], "</li>"] * n, "</ul>", ["#", "same"]]
    w = htmlwrap.align(htmlwrap.fold(nav(1, "a")), nav(4, "b"))
    assert htmlwrap.shown(w) == "<ul>(<li>#</li>)+</ul>same" and htmlwrap.align(w, nav(2, "c")) == w
