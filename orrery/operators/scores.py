"""Labels, scores and distances. Empty inputs give empty results or null scores; null labels never match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dominant(df: DataFrame, by: list[str], label: str, weight: str) -> DataFrame:
    """The label of the largest weight in each group (ties by label) with its share."""
    g = df.groupBy(*by, label).agg(F.sum(weight).alias("a"))
    best = g.groupBy(*by).agg(F.min(F.struct((-F.col("a")).alias("m"), F.col(label).alias("l"))).alias("x"), F.sum("a").alias("total"))
    return best.select(*by, F.col("x.l").alias(label), F.round(F.when(F.col("total") != 0, -F.col("x.m") / F.col("total")), 6).alias("confidence"))


def f1_by_label(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Support and F1 of each true label, from one confusion count."""
    c = df.groupBy(truth, pred).count()
    t = c.groupBy(F.col(truth).alias("label")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col(pred) == F.col(truth), F.col("count"))).alias("hit"))
    p = c.groupBy(F.col(pred).alias("label")).agg(F.sum("count").alias("predicted"))
    f1 = F.coalesce(2.0 * F.col("hit") / (F.col("support") + F.coalesce("predicted", F.lit(0))), F.lit(0.0))
    return t.join(p, "label", "left").select("label", "support", F.round(f1, 6).alias("f1"), f1.alias("_exact")).drop("_exact")


def weighted_f1(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """F1 weighted by support, over all labels."""
    c = df.groupBy(truth, pred).count()
    t = c.groupBy(F.col(truth).alias("label")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col(pred) == F.col(truth), F.col("count"))).alias("hit"))
    p = c.groupBy(F.col(pred).alias("label")).agg(F.sum("count").alias("predicted"))
    f1 = F.coalesce(2.0 * F.col("hit") / (F.col("support") + F.coalesce("predicted", F.lit(0))), F.lit(0.0))
    return t.join(p, "label", "left").agg(F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"), F.sum("support").alias("n"))


def wasserstein(df: DataFrame, by: list[str], side: str, value: str, a: str, b: str, parts: int = 64) -> DataFrame:
    """1-D Wasserstein distance of two samples per group over all their values: the integral of |F_a - F_b|; groups without one of the samples are left out.

    Counts per distinct value are summed up within `parts` ranges of about equal weight, what the ranges before hold is added from one row a range: a hot group is
    spread over its ranges. The ranges' bounds are approximate, the result is exact.
    """
    n = lambda x: F.count_if(F.col(side) == x)
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n(a).alias("na"), n(b).alias("nb")).where("na + nb > 0")
    cuts = c.groupBy(*by).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 1000).alias("_cuts"))
    x = c.join(cuts, by).withColumn("_k", F.size(F.filter("_cuts", lambda q: q < F.col(value)))).drop("_cuts")
    r = x.groupBy(*by, "_k").agg(F.sum("na").alias("_a"), F.sum("nb").alias("_b"), F.min(value).alias("_low"))
    o, all_ = W.partitionBy(*by).orderBy("_k"), W.partitionBy(*by)
    r = r.select(*by, "_k", (F.sum("_a").over(o) - F.col("_a")).alias("_a0"), (F.sum("_b").over(o) - F.col("_b")).alias("_b0"), F.lead("_low").over(o).alias("_next"), F.sum("_a").over(all_).alias("ta"), F.sum("_b").over(all_).alias("tb"))  # `parts` rows a group
    w = W.partitionBy(*by, "_k").orderBy(value)
    x = x.join(r, [*by, "_k"]).where("ta > 0 and tb > 0")
    gap = F.coalesce(F.lead(value).over(w), "_next") - F.col(value)
    x = x.select(*by, ((F.sum("na").over(w) + F.col("_a0")) / F.col("ta")).alias("fa"), ((F.sum("nb").over(w) + F.col("_b0")) / F.col("tb")).alias("fb"), gap.alias("gap"))
    return x.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("fa") - F.col("fb")) * F.coalesce("gap", F.lit(0.0))), 6).alias("wasserstein"))


def composite(pairs: DataFrame) -> DataFrame:
    """0.4 pattern + 0.6 participant: the two parts of a label, each as a share of hits."""
    part = lambda c, i: F.split(c, "_")[i]
    hit = lambda i: F.avg((part("pred", i) == part("truth", i)).cast("int"))
    return pairs.groupBy("symbol").agg(F.round(F.lit(0.4) * hit(0) + F.lit(0.6) * hit(1), 6).alias("score"))


def moving(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Daily score over the last three calendar days, weights 3, 2, 1; a day without a row scores 0."""
    cal = events.where("ts is not null").select(F.to_date("ts").alias("date")).distinct()
    s = pairs.groupBy("symbol", "date").agg(F.avg((F.col("pred") == F.col("truth")).cast("int")).alias("s"))
    days = pairs.select("symbol").distinct().withColumn("k", F.lit(1)).join(cal.withColumn("k", F.lit(1)), "k").drop("k")  # symbols x calendar days: the output's own size
    g = days.join(s, ["symbol", "date"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    w = W.partitionBy("symbol").orderBy("date")
    return g.select("symbol", "date", F.round((3 * F.col("s") + 2 * F.coalesce(F.lag("s").over(w), F.lit(0.0)) + F.coalesce(F.lag("s", 2).over(w), F.lit(0.0))) / 6.0, 6).alias("moving"))


def eligible(pairs: DataFrame, least: int = 8) -> DataFrame:
    return pairs.groupBy("symbol").agg(F.count_distinct("date").alias("n_days")).where(F.col("n_days") >= least)


def dtw(df: DataFrame, key: str, order: str, value: str, band: int = 12) -> DataFrame:
    """Dynamic time warping distance of neighbouring days' series of a key, in a Sakoe-Chiba band (Arrow-batched)."""
    day = df.withColumn("day", F.to_date(order)).groupBy(key, "day").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("s"))
    pairs = day.withColumn("before", F.lag("s").over(W.partitionBy(key).orderBy("day"))).where("before is not null")

    @F.pandas_udf("double")
    def dist(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            inf = float("inf")
            prev = [0.0] + [inf] * len(y)
            for i, u in enumerate(x, 1):
                cur = [inf] * (len(y) + 1)
                for j in range(max(1, i - band), min(len(y), i + band) + 1):
                    cur[j] = abs(u - y[j - 1]) + min(prev[j], cur[j - 1], prev[j - 1])
                prev = cur
            return prev[-1]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return pairs.select(key, "day", F.round(dist("before", "s"), 6).alias("dtw"))


PATTERN_COLUMNS = ["ap_active_buy_pct", "ap_unilateral_intensity", "order_count", "deal_count"]


def clustered(features: DataFrame, k: int = 4) -> DataFrame:
    """Window features with their pattern by k-means over the scaled features (`x`)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = VectorAssembler(inputCols=PATTERN_COLUMNS, outputCol="raw").transform(features.select(*PATTERN_COLUMNS).fillna(0))
    f = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(f).transform(f)
    m = KMeans(k=k, seed=1, maxIter=10).fit(f)
    return m.transform(f).select(*PATTERN_COLUMNS, F.col("prediction").alias("pattern"), vector_to_array("features").alias("x"))


def patterns(features: DataFrame, k: int = 4) -> DataFrame:
    """K-means patterns over window features, with size and mean features of each."""
    return clustered(features, k).groupBy("pattern").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in PATTERN_COLUMNS])


def separation(df: DataFrame, pattern: str = "pattern", x: str = "x") -> DataFrame:
    """(n, within, between, score): mean distance of the rows to their pattern's centre, weighted mean distance of the centres to the centre of all, and between / (between +
    within): near 1 where patterns are close in themselves and far from each other. Null if there are no rows."""
    long = df.select(F.monotonically_increasing_id().alias("_i"), pattern, F.posexplode(x).alias("d", "v"))
    centre = long.groupBy(pattern, "d").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    total = centre.groupBy("d").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("t"))
    within = df.join(centre.groupBy(pattern).agg(F.map_from_entries(F.collect_list(F.struct("d", "m"))).alias("c")), pattern)  # one row a pattern
    dist = F.sqrt(F.aggregate(F.transform(x, lambda v, i: F.pow(v - F.element_at("c", i), 2.0)), F.lit(0.0), lambda s, v: s + v))
    w = within.agg(F.count("*").alias("n"), F.avg(dist).alias("within"))
    b = centre.join(total, "d").groupBy(pattern).agg(F.sqrt(F.sum(F.pow(F.col("m") - F.col("t"), 2.0))).alias("far"), F.max("n").alias("k")).agg((F.sum(F.col("far") * F.col("k")) / F.sum("k")).alias("between"))
    r = w.join(F.broadcast(b), F.lit(True))  # single rows
    return r.select("n", F.round("within", 6).alias("within"), F.round("between", 6).alias("between"), F.round(F.when(F.col("within") + F.col("between") > 0, F.col("between") / (F.col("between") + F.col("within"))), 6).alias("score"))
