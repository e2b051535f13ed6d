"""Merkle manifest of a dataset by nested-interval labels.

Every row is a leaf. Within its group (a language) a leaf has a rank, and each node of the group's tree the
interval [lo, hi) of leaf ranks that it covers. A node's level and the bucket lo div 8**level name its place,
so ancestors are attached level by level with equality joins on the bucket, confirmed by containment of the
intervals. Of the nodes that a parent covers, those outside a node's own interval are its siblings. The
groups' roots are the leaves of one more tree.

Ranks come from one range sort and per-partition offsets, so no group is sorted or numbered in one task, and
an ancestor join never has more than 8 rows for a key: a group may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import staged

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:array<string>,right:array<string>>>"


def leaf_hash(*values: Column) -> Column:
    """sha256 of the values one after another: - for null, else the UTF-8 byte count, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in values]), 256)


def joined_hash(parts: Column) -> Column:
    """sha256 of an array of digests as hex text, one after another; of nothing, the digest of no bytes."""
    return F.sha2(F.concat_ws("", parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds rank (from 0) and n (the group's rows) in the order of `order` within each value of `group`.

    One range sort by group, order and row number: equal rows are no single key, so they are dealt out too.
    A row's number within its sorted partition is the low half of its id; each partition's rows of a group are
    counted, and the counts before it give the offset.
    """
    dealt = staged(rows.withColumn("__row", F.monotonically_increasing_id()), f"{name}-rows")
    cols = [F.col(c).asc_nulls_first() for c in (group, *order, "__row")]
    sorted_rows = dealt.repartitionByRange(*cols).sortWithinPartitions(*cols).drop("__row").withColumn("__at", F.monotonically_increasing_id())
    sorted_rows = staged(sorted_rows, f"{name}-sorted")
    part = F.shiftright("__at", 33).alias("__part")
    counts = sorted_rows.groupBy(part, F.col(group).alias("__g")).agg(F.min("__at").alias("__first"), F.count("*").alias("__k"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("__part", "__g", (F.coalesce(F.sum("__k").over(before), F.lit(0)) - F.col("__first")).alias("__off"), F.sum("__k").over(Window.partitionBy("__g")).alias("n"))
    spans = staged(spans, f"{name}-spans")
    few = spans.count() <= 100_000  # of about 50 bytes
    same = (F.shiftright("__at", 33) == F.col("__part")) & F.col(group).eqNullSafe(F.col("__g"))
    out = sorted_rows.join(F.broadcast(spans) if few else spans, same)
    return out.withColumn("rank", F.col("__at") + F.col("__off")).drop("__part", "__g", "__at", "__off")


def levels(leaves: DataFrame, group: str, name: str) -> list[DataFrame]:
    """Nodes above `leaves` (group, rank, n, digest and others), a table for each level, from below.

    Rows: group, n, lo, hi, digest, kids. kids are the nodes (the leaves with all their columns) that it
    covers, in order. A group of one leaf has one row, of that leaf's digest, which is no node of its own.
    """
    carried = [c for c in leaves.columns if c not in (group, "rank", "n")]
    kids = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), *carried)))
    first = leaves.groupBy(group, F.expr(f"rank div {FANOUT}").alias("bucket")).agg(F.max("n").alias("n"), kids.alias("kids"))
    out = [staged(_covering(first, group, alone=True), f"{name}-level1")]
    while True:
        rest = out[-1].where("hi - lo < n")
        if rest.isEmpty():
            return out
        size = FANOUT ** (len(out) + 1)
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        above = rest.groupBy(group, F.expr(f"lo div {size}").alias("bucket")).agg(F.max("n").alias("n"), kids.alias("kids"))
        out.append(staged(_covering(above, group), f"{name}-level{len(out) + 1}"))


def _covering(nodes: DataFrame, group: str, alone: bool = False) -> DataFrame:
    digest = joined_hash(F.col("kids.digest"))
    if alone:
        digest = F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(digest)
    return nodes.select(group, "n", F.array_min("kids.lo").alias("lo"), F.array_max("kids.hi").alias("hi"), digest.alias("digest"), "kids")


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """What a parent covers less the interval [lo, hi): the digests to its left and to its right."""
    return F.struct(F.transform(F.filter(kids, lambda k: k["hi"] <= lo), lambda k: k["digest"]).alias("left"), F.transform(F.filter(kids, lambda k: k["lo"] >= hi), lambda k: k["digest"]).alias("right"))


def descend(tree: list[DataFrame], group: str, seeds: DataFrame, name: str) -> DataFrame:
    """The lowest nodes of `tree` with `path`: the siblings of each ancestor-or-self from there to the top.

    `seeds` (group, path, others) hold what stands above each group's root, with columns to bring along.
    """
    brought = [c for c in seeds.columns if c not in (group, "path")]
    seeds = seeds.withColumnRenamed(group, "__g")
    above = None
    for k in range(len(tree) - 1, -1, -1):
        roots = tree[k].where("hi - lo = n").join(seeds, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
        here = roots
        if above is not None:
            up = above.select(F.col(group).alias("__g"), F.expr(f"lo div {FANOUT ** (k + 2)}").alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("kids").alias("__kids"), F.col("path").alias("__path"), *brought)
            inside = F.col(group).eqNullSafe(F.col("__g")) & (F.expr(f"lo div {FANOUT ** (k + 2)}") == F.col("__bucket")) & (F.col("lo") >= F.col("__lo")) & (F.col("hi") <= F.col("__hi"))
            met = tree[k].where("hi - lo < n").join(up, inside)
            met = met.withColumn("path", F.concat(F.array(_siblings(F.col("__kids"), F.col("lo"), F.col("hi"))), F.col("__path")))
            here = met.select(*tree[k].columns, "path", *brought).unionByName(roots.select(*tree[k].columns, "path", *brought))
        above = staged(here, f"{name}-paths{k + 1}") if k else here
    return above


def fold_up(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its proof."""
    return F.aggregate(path, leaf, lambda acc, s: joined_hash(F.concat(s["left"], F.array(acc), s["right"])))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """order, leaf, `extra`, rank, group_size, subroot, root, proof of every row of `docs`.

    `leaf` digests `columns`; within a group leaves ascend by `order`, equal ones (and null ones, which come
    first) by leaf. `proof` holds for each node from the leaf to the root of all groups the digests of its
    siblings to the left and to the right; folded into the leaf they give the root. A group of one row has
    that leaf as subroot, and with a single group its subroot is the root. Repeated rows are leaves of their
    own, in any order, as their digests are equal. Null groups form a group that comes first. Null, empty and
    long texts are digested whole; an empty table gives no rows; other columns are ignored.
    """
    leaf = leaf_hash(*[F.col(c) for c in columns])
    leaves = docs.select(F.col(group).alias("__group"), F.col(order).alias("__order"), leaf.alias("digest"), *[c.alias(n) for n, c in (extra or {}).items()])
    tree = levels(ranked(leaves, "__group", ["__order", "digest"], "merkle"), "__group", "merkle")
    subroots = None
    for nodes in tree:
        roots = nodes.where("hi - lo = n").select(F.lit(0).alias("all"), "__group", "digest")
        subroots = roots if subroots is None else subroots.union(roots)
    top = levels(ranked(subroots, "all", ["__group"], "merkle-top"), "all", "merkle-top")
    root = top[-1].where("hi - lo = n").select(F.col("all"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    paths = descend(top, "all", root, "merkle-top")
    subs = paths.select("n", "path", "root", F.col("kids").alias("__kids"), F.explode("kids").alias("s"))
    own = F.concat(F.array(_siblings(F.col("__kids"), F.col("s.lo"), F.col("s.hi"))), F.col("path"))
    seeds = staged(subs.select(F.col("s.__group").alias("__group"), F.when(F.col("n") > 1, own).otherwise(F.col("path")).alias("path"), F.col("s.digest").alias("subroot"), "root"), "merkle-seeds")
    rows = descend(tree, "__group", seeds, "merkle").select("n", "path", "subroot", "root", F.col("kids").alias("__kids"), F.explode("kids").alias("s"))
    own = F.concat(F.array(_siblings(F.col("__kids"), F.col("s.lo"), F.col("s.hi"))), F.col("path"))
    proof = F.when(F.col("n") > 1, own).otherwise(F.col("path"))
    return rows.select(F.col("s.__order").alias(order), F.col("s.digest").alias("leaf"), *[F.col(f"s.{n}").alias(n) for n in extra or {}], F.col("s.lo").alias("rank"), F.col("n").alias("group_size"), "subroot", "root", proof.alias("proof"))


def verify(rows: DataFrame, seen: Column) -> DataFrame:
    """Adds folded_root, from the digest `seen` and the row's proof, and verified: whether it is the root."""
    rows = rows.withColumn("folded_root", fold_up(seen, F.col("proof")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level to the root, left to right."""
    return joined_hash(F.flatten(F.transform(proof, lambda s: F.concat(s["left"], s["right"]))))
