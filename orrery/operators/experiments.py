"""Trial logs, graded answers, scores of documents and resumable results.

A trial is (id, config map, metric, slices map, status). Failed trials never win; nulls in metrics are left out of means; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trials(docs: DataFrame) -> DataFrame:
    """A trial per source: its configuration from the source's spread, its metric a share, failed where labels are mostly missing."""
    known = F.col("lang").isin("zh", "en", "de", "fr", "es", "pt")
    g = docs.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(known, F.lit(False)).cast("int")), 6).alias("metric"), F.count_distinct("domain").alias("domains"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    r = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("source"))  # one row a source: a log, not the corpus
    return g.withColumn("id", r).select("id", "source", F.create_map(F.lit("domains"), F.col("domains").cast("string"), F.lit("size"), F.when(F.col("n") >= 40, "large").otherwise("small")).alias("config"), "metric", F.create_map(F.lit("chars"), F.col("mean_chars"), F.lit("rows"), F.col("n").cast("double")).alias("slices"), F.when(F.col("metric") < 0.7, "failed").otherwise("ok").alias("status"))


def best(t: DataFrame) -> DataFrame:
    return t.where("status = 'ok' and metric is not null").orderBy(F.desc("metric"), "id").limit(1)


def coverage(t: DataFrame) -> DataFrame:
    """How many trials tried each (key, value)."""
    return t.select(F.explode("config").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


def leaderboard(t: DataFrame, k: int = 5) -> DataFrame:
    r = F.row_number().over(W.partitionBy("status").orderBy(F.desc("metric"), "id"))
    return t.where("status = 'ok'").withColumn("rank", r).where(F.col("rank") <= k).select("rank", "id", "metric")


def recent_deltas(t: DataFrame, k: int = 5) -> DataFrame:
    """The last k trials with their distance to the best before them."""
    w = W.partitionBy(F.lit(1)).orderBy("id")  # the log
    x = t.withColumn("m", F.when(F.col("status") == "ok", F.col("metric")))
    x = x.withColumn("best", F.max("m").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("back", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("id"))))
    return x.where(F.col("back") <= k).select("id", "status", "metric", F.round(F.col("metric") - F.col("best"), 6).alias("delta"))


def failures(t: DataFrame, k: int = 3) -> DataFrame:
    return t.where("status = 'failed'").orderBy(F.desc("id")).limit(k).select("id", "metric")


def weakest_slices(t: DataFrame, k: int = 4) -> DataFrame:
    return t.select("id", F.explode("slices").alias("slice", "value")).withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("value", "slice"))).where(F.col("r") <= k).select("id", "slice", "value", "r")


def trajectory(t: DataFrame) -> DataFrame:
    return t.select("id", F.to_json(F.struct("id", "metric", "status")).alias("record"))


def graded(df: DataFrame, by: str, pred: str, gold: str, flag: str) -> DataFrame:
    """(by, n, right, accuracy, high_n, high_accuracy): per group and in total (null group); `flag` high marks the sure items, defective ones are left out."""
    ok = (F.col(pred) == F.col(gold)).cast("int")
    high = F.col(flag) == "high"
    x = df.where(F.coalesce(F.col(flag), F.lit("")) != "defective").withColumn("ok", F.coalesce(ok, F.lit(0)))
    return x.rollup(by).agg(F.count("*").alias("n"), F.sum("ok").alias("right"), F.round(F.avg("ok"), 4).alias("accuracy"), F.count_if(high).alias("high_n"), F.round(F.avg(F.when(high, F.col("ok"))), 4).alias("high_accuracy"))


def token_factor(tokens: Column, budget: float, clamped: bool = True) -> Column:
    """0.7 + 0.3 * (budget - tokens) / budget, the share clamped to 0..1 unless told otherwise."""
    share = (F.lit(budget) - tokens) / F.lit(budget)
    return F.lit(0.7) + F.lit(0.3) * (F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) if clamped else share)


def edit_loss(pred: Column, gold: Column) -> Column:
    """Edit distance by the gold's length, at most 1; an empty gold gives 0 or 1."""
    return F.when(F.length(gold) == 0, F.when(F.length(pred) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(pred, gold) / F.length(gold)))


def order_loss(pred: Column, gold: Column) -> Column:
    """Edit distance by the longer length of the texts without white space."""
    a, b = F.regexp_replace(pred, "\\s", ""), F.regexp_replace(gold, "\\s", "")
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / n)


def composite(text_loss: Column, table_score: Column, order: Column) -> tuple[Column, Column]:
    """(three-term score with a missing table score as 100, two-term score), in percent."""
    t, o = (1 - text_loss) * 100, (1 - order) * 100
    return (t + F.coalesce(table_score * 100, F.lit(100.0)) + o) / 3, (t + o) / 2


def batch_means(df: DataFrame, score: str, table_score: str) -> DataFrame:
    has = F.col(table_score).isNotNull()
    return df.agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.avg(table_score), 6).alias("table_mean"), F.round(F.avg(F.when(has, F.col(score))), 6).alias("with_table"), F.round(F.avg(F.when(~has, F.col(score))), 6).alias("without_table"))


def ordinal_scores(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Mean over a document's gold tables of the score of the prediction with the same ordinal; missing predictions score 0."""
    w = W.partitionBy(key).orderBy("id")
    g, p = gold.withColumn("k", F.row_number().over(w)), pred.withColumn("k", F.row_number().over(w)).select(key, "k", F.col("score").alias("got"))
    return g.join(p, [key, "k"], "left").groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("got", F.lit(0.0))), 6).alias("score"))


def resume(done: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """What is still to do: keys without a successful record."""
    return todo.join(done.where("ok").select(key), key, "left_anti")


def last_per_key(log: DataFrame, key: str, order: str) -> DataFrame:
    return log.groupBy(key).agg(F.max(F.struct(order, *[c for c in log.columns if c not in (key, order)])).alias("x")).select(key, "x.*")


def merged(keys: DataFrame, a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two partial results by a list of keys, the first's value before the second's; `missing` and `blank` tell what is wrong."""
    x = keys.join(a.select(key, F.col(value).alias("_a")), key, "left").join(b.select(key, F.col(value).alias("_b")), key, "left")
    v = F.coalesce("_a", "_b")
    return x.select(key, v.alias(value), v.isNull().alias("missing"), (v == "").alias("blank"))


def decide(profile: DataFrame, task: str) -> DataFrame:
    """(no, model, priority, signal, hint): first decisions for a one-row profile, by priority and then in the order of the rules; null signals count 0 (imbalance 1).

    Every decision names the profile's value that it rests on; a rule whose condition fails gives none.
    """
    v = lambda c, other=0.0: F.coalesce(F.col(c).cast("double"), F.lit(other))
    always = F.lit(True)
    if task == "classification":
        weight = F.when(v("imbalance", 1.0) >= 3, "balanced")
        rules = [
            ("lightgbm", F.lit(1), "isolated_share", weight, always),
            ("feature_mlp", F.lit(2), "mean_degree", weight, always),
            ("correct_and_smooth", F.lit(1), "homophily", None, v("homophily") >= 0.6),
            ("feature_propagation", F.lit(3), "isolated_share", None, v("isolated_share") >= 0.1),
            ("gcn", F.when(v("mean_degree") >= 5, 3).otherwise(4), "mean_degree", None, always),
        ]
    else:
        rules = [
            ("popularity", F.lit(1), "cold_share", None, always),
            ("repeat_freq", F.lit(1), "repeat_rate", None, v("repeat_rate") >= 0.3),
            ("covisitation", F.lit(2), "repeat_rate", None, always),
            ("blend", F.lit(1), "repeat_rate", None, always),
            ("item_content_knn", F.lit(2), "n_items", None, v("n_items") >= 5000),
            ("sasrec", F.when(v("cold_share") >= 0.3, 4).otherwise(3), "cold_share", None, always),
        ]
    one = lambda i, m, p, s, h: F.struct(p.cast("int").alias("priority"), F.lit(i).alias("rule"), F.lit(m).alias("model"), F.concat(F.lit(s + "="), F.round(v(s), 4).cast("string")).alias("signal"), (F.lit(None).cast("string") if h is None else h).alias("hint"))
    made = F.array_compact(F.array(*[F.when(ok, one(i, m, p, s, h)) for i, (m, p, s, h, ok) in enumerate(rules)]))
    return profile.select(F.posexplode(F.array_sort(made)).alias("no", "x")).select("no", "x.model", "x.priority", "x.signal", "x.hint")


def first_trial(profile: DataFrame, task: str) -> DataFrame:
    """(first_trial): what is tried first."""
    if task == "classification":
        return profile.select(F.when(F.coalesce("homophily", F.lit(0.0)) >= 0.6, "lightgbm(class_weight=balanced) + correct_and_smooth").otherwise("lightgbm(class_weight=balanced)").alias("first_trial"))
    return profile.select(F.lit("blend(repeat_freq + covisitation + popularity)").alias("first_trial"))


def append_trial(log: DataFrame, row: DataFrame) -> DataFrame:
    """A log with one more trial, whose id is the number of trials so far."""
    n = log.agg(F.count("*").cast("int").alias("id"))
    return log.unionByName(row.drop("id").join(F.broadcast(n), F.lit(True)), allowMissingColumns=True)  # one row


def calibrated(df: DataFrame, by: str, pred: str, gold: str, flag: str, tokens: str, budget: float) -> DataFrame:
    """`graded` with each group's tokens, token factor and the score both give."""
    t = df.rollup(by).agg(F.sum(tokens).alias("tokens"))
    g = graded(df, by, pred, gold, flag)
    x = g.join(t.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return x.withColumn("score", F.round(100 * F.col("accuracy") * token_factor(F.col("tokens"), budget), 4))
