"""Volatility-regime features, labels, splits and evaluation, per symbol and leakage-safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.stats import DAYS, by, full, ratio
from tallyfold.operators.scan import percentiles, prefix
from tallyfold.sources.shared import shared_dir

FEATURES = ["ret_1", "ret_5", "ret_21", "vol_10", "vol_21", "vol_63", "mom_10", "mom_21", "ma_20", "ma_50", "price_ma_20", "price_ma_50", "volume_z_21", "drawdown_60"]


TREE_ROWS = 100_000  # training rows of a partition


def features(prices: DataFrame, key: str = "symbol") -> DataFrame:
    """All columns over one partitioning and order; null until each window is full."""
    w = by(key)
    back = lambda n: w.rowsBetween(-(n - 1), 0)
    lagged = lambda n: ratio(F.col("close"), F.lag("close", n).over(w)) - 1
    p = prices.withColumn("ret_1", lagged(1)).withColumn("ret_5", lagged(5)).withColumn("ret_21", lagged(21))
    for n in (10, 21, 63):
        p = p.withColumn(f"vol_{n}", full(F.stddev_samp("ret_1").over(back(n)) * DAYS**0.5, back(n), n, "ret_1"))
    p = p.withColumn("mom_10", lagged(10)).withColumn("mom_21", lagged(21))
    for n in (20, 50):
        p = p.withColumn(f"ma_{n}", full(F.avg("close").over(back(n)), back(n), n, "close"))
        p = p.withColumn(f"price_ma_{n}", ratio(F.col("close"), F.col(f"ma_{n}")))
    z = ratio(F.col("volume") - F.avg("volume").over(back(21)), F.stddev_samp("volume").over(back(21)))
    p = p.withColumn("volume_z_21", full(z, back(21), 21, "volume"))
    top = F.max("close").over(back(60))
    return p.withColumn("drawdown_60", full(ratio(F.col("close") - top, top), back(60), 60, "close"))


def forward_vol(feats: DataFrame, n: int = 21, key: str = "symbol") -> DataFrame:
    """Volatility of the next n returns; null if there are fewer."""
    w = by(key).rowsBetween(1, n)
    return feats.withColumn("vol_forward", full(F.stddev_samp("ret_1").over(w), w, n, "ret_1") * DAYS**0.5)


def date_ranks(rows: DataFrame) -> DataFrame:
    """Distinct dates with rank from 0 and their count; a calendar's few thousand rows."""
    d = rows.select("date").distinct()
    return d.withColumn("rank", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))


def splits(rows: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Date, split by rank of the distinct date; training ends before int(n * train), validation before int(n * (train + val))."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + val))
    return date_ranks(rows).select("date", F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "val").otherwise("test").alias("split"))


def folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """Fold, date, part: expanding training blocks and the block after each as test.

    Block j of k + 1 ends before the date of rank int(n * j / (k + 1)).
    """
    r = date_ranks(rows).where(F.col("n") >= k + 1)
    ends = F.transform(F.sequence(F.lit(1), F.lit(k + 1)), lambda j: F.floor(F.col("n") * j / (k + 1)))
    r = r.withColumn("block", F.size(F.filter(ends, lambda e: e <= F.col("rank")))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return r.where("block <= fold").select(F.col("fold"), "date", F.when(F.col("block") < F.col("fold"), "train").otherwise("test").alias("part"))


def thresholds(feats: DataFrame, cutoff: DataFrame, q: float = 0.75, key: str = "symbol") -> DataFrame:
    """Percentile of trailing volatility up to the cutoff date, per symbol."""
    known = feats.select(key, "vol_21", "date").join(F.broadcast(cutoff), F.col("date") <= F.col("cutoff"))
    return percentiles(known, [key], "vol_21", {"threshold": q})


def cutoff_date(rows: DataFrame, train: float = 0.7) -> DataFrame:
    """One row, the last training date."""
    return date_ranks(rows).where(F.col("rank") == F.floor(F.col("n") * train) - 1).select(F.col("date").alias("cutoff"))


def labelled(prices: DataFrame, train: float = 0.7, key: str = "symbol") -> DataFrame:
    """Features with forward volatility, threshold, label and the persistence baseline."""
    f = forward_vol(features(prices, key), key=key)
    t = thresholds(f, cutoff_date(prices, train), key=key)
    above = lambda c: F.when(F.col(c).isNotNull(), (F.col(c) > F.col("threshold")).cast("int"))
    return f.join(t, key).withColumn("label", above("vol_forward")).withColumn("baseline", above("vol_21"))


def dataset(prices: DataFrame, train: float = 0.7) -> DataFrame:
    """Labelled rows without nulls."""
    return labelled(prices, train).dropna(subset=[*FEATURES, "label"])


def binary_metrics(rows: DataFrame, keys: list[str], label: str = "label", predicted: str = "predicted", score: str | None = None) -> DataFrame:
    """Precision, recall, F1 (0 on zero division); with `score` also ROC-AUC and average precision.

    Scores are first counted by value, so ties are one row; running counts go over ranges of scores, so a
    split's scores are shared out over tasks. Null AUCs with one class.
    """
    tp, pp, ap = (F.sum((c).cast("int")) for c in ((F.col(label) == 1) & (F.col(predicted) == 1), F.col(predicted) == 1, F.col(label) == 1))
    m = rows.groupBy(*keys).agg(tp.alias("tp"), pp.alias("pp"), ap.alias("pos"), F.count("*").alias("n"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    m = m.withColumn("precision", zero(F.col("tp"), F.col("pp"))).withColumn("recall", zero(F.col("tp"), F.col("pos")))
    m = m.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if score is None:
        return m.select(*keys, "precision", "recall", "f1")
    s = rows.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.count("*").alias("c"))
    s = prefix(s, keys, [F.desc(score)], {"cp": "p", "cc": "c"}, name="scores")
    neg = F.col("c") - F.col("p")
    a = s.groupBy(*keys).agg(F.sum(neg * (F.col("cp") - F.col("p") / 2)).alias("wins"), F.sum(F.col("p") * F.col("cp") / F.col("cc")).alias("ap"))
    j = m.join(a, keys) if keys else m.crossJoin(a)
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return j.select(*keys, "precision", "recall", "f1", F.when(both, F.col("wins") / F.when(both, F.col("pos") * (F.col("n") - F.col("pos")))).alias("roc_auc"), F.when(both, F.col("ap") / F.when(both, F.col("pos"))).alias("pr_auc"))


def against_baseline(model: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """The model's metrics less the baseline's, and whether it beats it on both F1 and PR-AUC."""
    j = model.join(baseline.select(*keys, F.col("f1").alias("__f1"), F.col("pr_auc").alias("__pr")), keys)
    d_f1, d_pr = F.col("f1") - F.col("__f1"), F.col("pr_auc") - F.col("__pr")
    return j.select(*model.columns, d_f1.alias("delta_f1"), d_pr.alias("delta_pr_auc"), F.coalesce((d_f1 > 0) & (d_pr > 0), F.lit(False)).alias("better"))


def promotion(metrics: DataFrame, least: float = 0.05) -> DataFrame:
    """Of (model, version, delta_f1): whether each version is promoted, and why or why not."""
    ok = F.coalesce(F.col("delta_f1") >= least, F.lit(False))
    gain = F.format_string("%.4f", F.col("delta_f1"))
    why = F.when(ok, F.concat(F.lit("promoted: F1 beats the baseline by "), gain, F.lit(f", at least {least:.4f}"))).otherwise(F.concat(F.lit("rejected: F1 beats the baseline by only "), gain, F.lit(f", under {least:.4f}; the version in production stays")))
    return metrics.select("model", "version", ok.alias("promoted"), why.alias("reason"))


def dataset_version(prices: DataFrame) -> DataFrame:
    """Order-independent content hash (sum of row digests), rows, symbols and date range."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", "symbol", F.date_format("date", "yyyy-MM-dd"), F.round("close", 9).cast("decimal(20,9)").cast("string"), F.col("volume").cast("string"))), 1, 12), 16, 10).cast("decimal(38,0)")
    return prices.agg(F.sum(row).cast("string").alias("version"), F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first"), F.max("date").alias("last"))


def leakage(prices: DataFrame, cut: str) -> DataFrame:
    """Rows whose features change when every price after `cut` is taken away; must be empty."""
    return changed_without_future(prices, cut, features, FEATURES)


def changed_without_future(prices: DataFrame, cut: str, make, columns: list[str]) -> DataFrame:
    """symbol, date of rows up to `cut` for which `make` gives other `columns` once later prices are gone."""
    cols = ["symbol", "date", *[F.round(c, 9).alias(c) for c in columns]]
    day = F.lit(cut).cast("date")
    whole = make(prices).where(F.col("date") <= day).select(*cols)
    part = make(prices.where(F.col("date") <= day)).select(*cols)
    return whole.exceptAll(part).select("symbol", "date")


def changed_by_past(prices: DataFrame, cut: str, make, columns: list[str]) -> DataFrame:
    """symbol, date of rows from `cut` on for which `make` gives other `columns` once earlier closes are half as high again."""
    cols = ["symbol", "date", *[F.round(c, 9).alias(c) for c in columns]]
    day = F.lit(cut).cast("date")
    after = make(prices).where(F.col("date") >= day).select(*cols)
    moved = prices.withColumn("close", F.when(F.col("date") < day, F.col("close") * 1.5).otherwise(F.col("close")))
    return after.exceptAll(make(moved).where(F.col("date") >= day).select(*cols)).select("symbol", "date")


def train_trees(rows: DataFrame, max_iter: int = 200, label: str = "label", seed: int = 42):
    """Boosted trees with the classes weighted by their training ratio; returns (assembler, model)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():  # each tree adds to the lineage, which the model's checkpoints cut
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    c = rows.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
    weight = (c["n"] - c["p"]) / c["p"] if c["p"] else 1.0
    made = VectorAssembler(inputCols=FEATURES, outputCol="features")
    x = made.transform(rows).withColumn("w", F.when(F.col(label) == 1, float(weight)).otherwise(1.0)).select("features", "w", label)
    x = x.repartition(max(1, -(-c["n"] // TREE_ROWS))).persist()  # a tree is some jobs over all parts, so small tables get few
    gbt = GBTClassifier(labelCol=label, weightCol="w", maxIter=max_iter, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", checkpointInterval=10, seed=seed)
    model = gbt.fit(x)
    x.unpersist()
    return made, model
