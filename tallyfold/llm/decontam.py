"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers and capitalised words inside a sentence become typed placeholders; what
remains is lower-cased and cut into windows of tokens. Window hashes of the documents are joined with
those of the benchmark, so a passage is found also when its numbers, names or units were changed. For
windows with placeholders the values are compared, each window by itself: a benchmark value that was
changed must meet one document value in it. Values that stayed, and different values that became equal,
break nothing, and a window that fails takes no other one with it.

A template says something only by its words: windows with fewer than four literal words are hashed with the
values in place, so lists of numbers or names match lists of the same ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import staged

WINDOW = 8
SHORTEST = 4  # tokens of an item that is searched for inside texts; a shorter one is looked for as a whole text
LITERALS = 4  # words of a window that is matched as a template
STRETCH = 256  # tokens of a document in which a window's values are looked up
BROADCAST_WINDOWS = 400_000  # of about 40 bytes; a larger benchmark is joined by a shuffle
BROADCAST_STRETCHES = 100_000  # of 16 bytes; more are joined by a shuffle

# Units recognised after a number.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|mph|km/h|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|metres?|meters?|feet|ft|inches|inch|litres?|liters?|grams?|dollars?|euros?|pounds?|cents?|percent|usd|eur|gbp|degrees?"

_NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
# Marks put before a value: 1 number, 2 unit, 3 name.
_MARK_UNIT = rf"({_NUMBER})\s?((?i:{UNITS})|%|€|\$|£)(?![\p{{L}}\p{{Nd}}])"
_MARK_NUMBER = rf"(?<![\p{{L}}\p{{Nd}}])({_NUMBER})(?![\p{{L}}\p{{Nd}}])"
_MARK_NAME = r"(?<=[\p{L}\p{Nd},;:] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{Nd}])"
_TOKEN = r"\x01[^ ]+|\x02[^ ]+|\x03?[\p{L}\p{Nd}]+"
# White space and stray marks that are no single blank; numbers and units are marked before names.
_GAP = r"(?:[\s\p{Z}\x01-\x03\x85&&[^ ]]| (?=[\s\p{Z}\x01-\x03\x85]))[\s\p{Z}\x01-\x03\x85]*"


def with_tokens(df: DataFrame, text: Column, names: bool = True) -> DataFrame:
    """Adds `toks`: lower-cased words, and \\x01number, \\x02unit and \\x03name values with their marks."""
    df = df.withColumn("toks", F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _GAP, " "))
    t = F.col("toks")
    numbers = F.regexp_replace(F.regexp_replace(t, _MARK_UNIT, " \x01$1 \x02$2 "), _MARK_NUMBER, " \x01$1 ")
    numbers = F.regexp_replace(F.regexp_replace(numbers, "\x01 +\x01", "\x01"), " {2,}", " ")
    df = df.withColumn("toks", F.when(t.rlike(r"\p{Nd}"), numbers).otherwise(t))
    df = df.withColumn("toks", F.lower(F.regexp_replace(t, _MARK_NAME, "\x03$1") if names else t))
    return df.withColumn("toks", F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)))


def _hashes(toks: Column, names: bool, values: bool) -> Column:
    """Hash of each token: odd for words, even for placeholders, of the mark alone or, with `values`, of all.

    Without `names`, marked names count as words.
    """
    slot = lambda t: t < F.lit("\x04" if names else "\x03")
    word = lambda t: t if names else F.ltrim(t, F.lit("\x03"))
    return F.transform(toks, lambda t: F.when(slot(t), F.xxhash64(t if values else F.substring(t, 1, 1)).bitwiseAND(F.lit(-2))).otherwise(F.xxhash64(word(t)).bitwiseOR(F.lit(1))))


def _windows(marks: Column, values: Column, slots: Column, width: int) -> Column:
    """Hash of each run of `width` tokens; none for shorter texts, nor, of short runs, for longer ones.

    `marks` and `values` are hashes of the tokens without and with the placeholders' values; `slots` says
    whether there are placeholders at all.
    """
    at = F.sequence(F.lit(0), F.size(marks) - width)
    one = lambda c, i: F.xxhash64(F.lit(width), *[F.get(c, i + k) for k in range(width)])
    words = lambda i: sum(F.get(marks, i + k).bitwiseAND(F.lit(1)) for k in range(width))
    some = F.transform(at, lambda i: F.when(words(i) >= LITERALS, one(marks, i)).otherwise(one(values, i)))
    fits = F.size(marks) >= width if width >= SHORTEST else F.size(marks) == width
    return F.when(fits, F.when(slots, some).otherwise(F.transform(at, lambda i: one(marks, i)))).otherwise(F.array().cast("array<bigint>"))


def _with_hashes(df: DataFrame, names: bool) -> DataFrame:
    """Adds marks, values and slots, from `toks`."""
    last = "\x04" if names else "\x03"
    df = df.withColumn("slots", F.exists("toks", lambda t: t < F.lit(last)))
    return df.withColumn("marks", _hashes(F.col("toks"), names, False)).withColumn("values", F.when(F.col("slots"), _hashes(F.col("toks"), names, True)).otherwise(F.col("marks")))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """h, item_id, n_tokens, width, bpos, held, template of each window, with names marked and unmarked.

    held (offset, value) are its placeholders; template says whether it is matched without their values.
    """
    out = None
    for names in (True, False):
        items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
        items = _with_hashes(with_tokens(items, F.col("text"), names).drop("text"), True).withColumn("n_tokens", F.size("toks"))
        items = items.where("n_tokens > 0").withColumn("width", F.least("n_tokens", F.lit(window)))
        # nulls leave a hash as it is, so that a shorter item's one window is hashed like a run of its length
        one = lambda c, i: F.xxhash64("width", *[F.when(F.col("width") > k, F.get(c, i + k)) for k in range(window)])
        inside = lambda i: F.filter(F.transform(F.slice("toks", i + 1, F.col("width")), lambda t, k: F.struct(k.alias("k"), t.alias("value"))), lambda s: s["value"] < F.lit("\x04"))
        part = items.withColumn("bpos", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("width")))).withColumn("held", inside(F.col("bpos")))
        part = part.withColumn("template", (F.size("held") > 0) & (F.col("width") - F.size("held") >= LITERALS))
        h = F.when((F.size("held") == 0) | F.col("template"), one(F.col("marks"), F.col("bpos"))).otherwise(one(F.col("values"), F.col("bpos")))
        part = part.select(h.alias("h"), "item_id", "n_tokens", "width", "bpos", "held", "template")
        out = part if out is None else out.union(part)
    return out.distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_coverage: float = 0.5,
    min_tokens: int = 13,
) -> DataFrame:
    """doc_id, item_id, n_tokens, n_covered, coverage, n_slots, n_changed of each contaminated pair.

    A pair is contaminated if consistent windows cover at least `min_coverage` of the item's tokens or
    `min_tokens` of them. n_slots counts the item's placeholder values met in them, n_changed those that
    differ in the document somewhere: n_changed > 0 is a re-parameterised question. Items shorter than a window
    are matched as a whole; items of one to three tokens are found only where a document is nothing else.
    Null or empty texts and items match nothing; rows with null ids take no part; repeated rows count once.
    Other columns are ignored.
    """
    bench = staged(benchmark_windows(benchmark, item_col, item_text_col, window), "bench")
    widths = [r[0] for r in bench.groupBy("width").count().collect()]
    if not widths:
        widths = [window]
    small = bench.count() <= BROADCAST_WINDOWS
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("of"), F.col(text_col).alias("text"))
    # Names are read both as placeholders and as words, since what stands before a name decides its mark.
    marked = _with_hashes(with_tokens(texts, F.col("text")), True).withColumnsRenamed({"marks": "m1", "values": "v1", "slots": "s1"})
    named = F.exists("toks", lambda t: t.startswith("\x03"))
    hashed = _with_hashes(marked, False).select("doc_id", "of", "m1", "v1", "s1", F.when(named, F.col("marks")).alias("m2"), F.when(named, F.col("values")).alias("v2"), F.col("slots").alias("s2"))
    both = lambda w: F.array(*[F.struct(F.lit(w).alias("w"), _windows(F.col(f"m{k}"), F.col(f"v{k}"), F.col(f"s{k}"), w).alias("hs")) for k in (1, 2)])
    spots = hashed.select("doc_id", "of", F.explode(F.concat(*[both(w) for w in sorted(widths)])).alias("x")).select("doc_id", "of", F.posexplode("x.hs").alias("pos", "h"))
    hits = spots.join(F.broadcast(bench) if small else bench, "h").select("doc_id", "of", "pos", "item_id", "bpos", "width", "n_tokens", "held", "template").distinct()
    hits = staged(hits, "hits")
    cols = ["doc_id", "item_id", "n_tokens", "bpos", "width", "held"]
    plain = hits.where("not template").select(*cols, F.lit(0).alias("changed"))
    slotted = hits.where("template").withColumn("stretch", F.expr(f"pos div {STRETCH}").cast("int"))
    # Only stretches in which a template was met are cut into tokens again.
    wanted = staged(slotted.select("doc_id", "of", "stretch").distinct(), "stretches")
    few = wanted.count() <= BROADCAST_STRETCHES
    ids = wanted.select("doc_id", "of").distinct()
    read = with_tokens(texts.join(F.broadcast(ids) if few else ids, ["doc_id", "of"]), F.col("text"))
    ends = F.sequence(F.lit(0), F.expr(f"(size(toks) - 1) div {STRETCH}").cast("int"))
    pieces = F.transform(ends, lambda k: F.struct(k.alias("stretch"), F.slice("toks", k * STRETCH + 1, STRETCH + window).alias("toks")))
    read = read.where("size(toks) > 0").select("doc_id", "of", F.explode(pieces).alias("p")).select("doc_id", "of", "p.stretch", "p.toks")
    read = read.join(F.broadcast(wanted) if few else wanted, ["doc_id", "of", "stretch"], "left_semi").distinct()
    read = read.join(slotted, ["doc_id", "of", "stretch"])
    meets = F.transform("held", lambda s: F.struct(s["k"].alias("k"), s["value"].alias("b"), F.coalesce(F.get("toks", F.col("pos") - F.col("stretch") * STRETCH + s["k"]), F.lit("")).alias("d")))
    differ = F.filter(meets, lambda p: p["b"] != p["d"])
    read = read.withColumn("differ", differ)
    pairs = F.array_distinct(F.transform("differ", lambda p: F.struct(p["b"].alias("b"), p["d"].alias("d"))))
    consistent = F.size(F.array_distinct(F.transform("differ", lambda p: p["b"]))) == F.size(pairs)
    bits = F.aggregate("differ", F.lit(0), lambda m, p: m + F.pow(F.lit(2), p["k"]).cast("int"))
    # One row for each place of an item, whatever the number of alignments; an item's places are as many as its tokens.
    places = plain.union(read.where(consistent).select(*cols, bits.alias("changed"))).groupBy(*cols).agg(F.bit_or("changed").alias("changed"))
    found = places.groupBy("doc_id", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.collect_list(F.struct("bpos", "width", "held", "changed")).alias("at"))
    values = lambda some: F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.transform(F.filter(a["held"], lambda s: some(a, s)), lambda s: s["value"])))))
    slots, differing = values(lambda a, s: F.lit(True)), values(lambda a, s: a["changed"].bitwiseAND(F.pow(F.lit(2), s["k"]).cast("int")) > 0)
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["bpos"], a["bpos"] + a["width"] - 1)))))
    found = found.select("doc_id", "item_id", "n_tokens", covered.alias("n_covered"), slots.alias("n_slots"), differing.alias("n_changed"))
    found = found.withColumn("coverage", F.round(F.col("n_covered") / F.col("n_tokens"), 6))
    return found.where((F.col("coverage") >= min_coverage) | (F.col("n_covered") >= min_tokens)).select("doc_id", "item_id", "n_tokens", "n_covered", "coverage", "n_slots", "n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that share no passage with the benchmark; columns and repeated rows stay."""
    key = options.get("id_col", "doc_id")
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, key, "left_anti").select(*docs.columns)
