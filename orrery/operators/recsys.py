"""Interaction sequences, popularity, co-visitation, ranking and their profile.

A sequence is a user's items in the order (o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice); its last item is the target, the rest the
history. Histories are cut to their last `window` distinct items before pairs are formed, so pairs per user are bounded by window squared, whatever the history's length.
Popularity counts targets. Users with one item have an empty history; null users or items are left out. Ties go to the smaller item id unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ["o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
WINDOW, TOP, HEAD = 10, 10, 50


def interactions(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(uid, iid, pos, n): pos rises from 1 in the user's order."""
    x = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).where("o_custkey is not null and l_partkey is not null")
    w = W.partitionBy("o_custkey")
    return x.select(F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("iid"), F.row_number().over(w.orderBy(*ORDER)).alias("pos"), F.count("*").over(w).alias("n"))


def split(inter: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, target) of each user."""
    return inter.where("pos < n"), inter.where("pos = n").select("uid", F.col("iid").alias("target"), (F.col("n") - 1).alias("len"))


def item_counts(history: DataFrame) -> DataFrame:
    """(uid, iid, cnt, first): how often and at which first position."""
    return history.groupBy("uid", "iid").agg(F.count("*").alias("cnt"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def recent(history: DataFrame, window: int = WINDOW) -> DataFrame:
    """The last `window` distinct items of each user, by their first occurrence as in a de-duplicated sequence."""
    r = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("first")))
    return item_counts(history).withColumn("r", r).where(F.col("r") <= window).select("uid", "iid")


def covisits(history: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, cnt) over ordered pairs of distinct recent items of one user."""
    r = recent(history, window)
    return r.select("uid", F.col("iid").alias("a")).join(r.select("uid", F.col("iid").alias("b")), "uid").where("a != b").groupBy("a", "b").agg(F.count("*").alias("cnt"))


def popularity(targets: DataFrame) -> DataFrame:
    """(iid, pop): how often an item is a target."""
    return targets.groupBy(F.col("target").alias("iid")).agg(F.count("*").alias("pop"))


def top_popular(targets: DataFrame, k: int = TOP) -> DataFrame:
    return popularity(targets).orderBy(F.desc("pop"), "iid").limit(k)


def bucket(n: str = "len") -> Column:
    c = F.col(n)
    return F.when(c == 0, "0").when(c <= 2, "1-2").when(c <= 10, "3-10").otherwise(">10")


def rank(history: DataFrame, targets: DataFrame, users: DataFrame, own: DataFrame, weights: tuple[float, float, float] = (2.0, 1.0, 0.2), k: int = TOP) -> DataFrame:
    """(uid, iid, score, rank) for the users: weighted sum of max-normalised repeats (of their own histories `own`), co-visits and popularity (of the histories and
    targets fitted to) over all items.

    Items without repeats or co-visits can only enter by popularity, so the HEAD most popular items stand for all of them: HEAD exceeds k by more than a
    user's recent items can take away. Scores are rounded to 6 decimals before ranking; ties go to the smaller item.
    """
    wr, wc, wp = weights
    hist = item_counts(own).join(users.select("uid"), "uid", "left_semi").select("uid", "iid", "cnt")
    maxed = hist.withColumn("h", F.col("cnt") / F.max("cnt").over(W.partitionBy("uid")))
    co = maxed.select("uid", F.col("iid").alias("a"), "cnt").join(covisits(history).withColumnRenamed("cnt", "c"), "a").groupBy("uid", F.col("b").alias("iid")).agg(F.sum(F.col("cnt") * F.col("c")).alias("co"))
    co = co.withColumn("c", F.col("co") / F.max("co").over(W.partitionBy("uid")))
    pop = popularity(targets)
    top = pop.agg(F.max("pop").alias("top"))
    norm = pop.join(F.broadcast(top), F.lit(True)).select("iid", (F.col("pop") / F.col("top")).alias("p"))  # one row
    head = norm.orderBy(F.desc("p"), "iid").limit(HEAD)  # HEAD rows
    cand = maxed.select("uid", "iid", "h", F.lit(None).cast("double").alias("c")).unionByName(co.select("uid", "iid", F.lit(None).cast("double").alias("h"), "c"))
    cand = cand.unionByName(users.select("uid").join(F.broadcast(head.select("iid")), F.lit(True)).select("uid", "iid", F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("c")))
    cand = cand.groupBy("uid", "iid").agg(F.max("h").alias("h"), F.max("c").alias("c")).join(norm, "iid", "left")
    score = F.round(wr * F.coalesce("h", F.lit(0.0)) + wc * F.coalesce("c", F.lit(0.0)) + wp * F.coalesce("p", F.lit(0.0)), 6)
    r = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "iid"))
    return cand.withColumn("score", score).withColumn("rank", r).where(F.col("rank") <= k).select("uid", "iid", "score", "rank")


def ndcg(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """(uid, len, ndcg): 1 / log2(rank + 1) of the one relevant item, else 0."""
    hit = ranked.join(targets, "uid").where("iid = target").select("uid", (1 / F.log2(F.col("rank") + 1.0)).alias("g"))
    return targets.join(hit, "uid", "left").select("uid", "target", "len", F.round(F.coalesce("g", F.lit(0.0)), 6).alias("ndcg"))


def profile(history: DataFrame, targets: DataFrame, k: int = TOP) -> DataFrame:
    """One row: sequence lengths, cold and empty shares, repeats, and how the target relates to the history."""
    c = item_counts(history)
    best = c.groupBy("uid").agg(F.min(F.struct((-F.col("cnt")).alias("m"), "first", "iid")).alias("x")).select("uid", F.col("x.iid").alias("often"))
    last = history.groupBy("uid").agg(F.max_by("iid", "pos").alias("last"))
    rep = c.select("uid", F.col("iid").alias("target"), F.lit(1).alias("seen"))
    top = targets.groupBy(F.col("target").alias("iid")).count().orderBy(F.desc("count"), "iid").limit(k).select(F.col("iid").alias("target"), F.lit(1).alias("top"))
    t = targets.join(best, "uid", "left").join(last, "uid", "left").join(rep, ["uid", "target"], "left").join(F.broadcast(top), "target", "left")  # k rows
    pct = lambda x: F.round(F.avg(F.coalesce(x.cast("int"), F.lit(0))), 4)
    return t.agg(
        F.count("*").alias("n_users"), F.round(F.avg("len"), 4).alias("mean_len"), F.expr("percentile(len, 0.5)").cast("int").alias("median_len"), F.expr("percentile(len, 0.9)").cast("int").alias("p90_len"), F.max("len").alias("max_len"),
        pct(F.col("len") <= 2).alias("cold_share"), pct(F.col("len") == 0).alias("empty_share"), pct(F.col("seen") == 1).alias("repeat_rate"), pct(F.col("target") == F.col("last")).alias("target_is_last"),
        pct(F.col("target") == F.col("often")).alias("target_is_most_frequent"), pct(F.col("top") == 1).alias("target_in_top10"),
    )


def tokens(c: str) -> Column:
    """A comma-separated list parsed: null or blank gives an empty list; items trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def counts(c: str) -> Column:
    """`id:n` pairs parsed to structs; pairs without a number are dropped."""
    pair = F.filter(tokens(c), lambda x: x.rlike("^[^:]+:[0-9]+$"))
    return F.transform(pair, lambda x: F.struct(F.split(x, ":")[0].alias("iid"), F.split(x, ":")[1].cast("int").alias("cnt")))


def holdout(df: DataFrame, key: str, fifth: int = 0) -> tuple[DataFrame, DataFrame]:
    """(held out, rest) by the md5 of the key, the rest by anti join."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 5
    out = df.where(h == fifth)
    return out, df.join(out.select(key), key, "left_anti")


def align(template: DataFrame, rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows in the template's order; keys without a row stay with nulls."""
    return template.join(rows, key, "left").orderBy(pos)
