"""Graph profile, symmetric normalisation, label propagation and slice metrics.

Edges are (src, dst); the graph is made undirected and unweighted by a union and a distinct (self loops stay one edge). Nodes carry a label (null if
unknown) and a split (train or test). Empty denominators give null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.blocks import ENDS, Blocks


def symmetric(edges: DataFrame) -> DataFrame:
    e = edges.where("src is not null and dst is not null").select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


def from_parts(lineitem: DataFrame, part: DataFrame, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): with `pairs` any two distinct parts bought in one order are linked; without, each is linked with the order's next one only. Label is the brand's
    number; a fifth of the nodes, by md5, is the test split."""
    x = lineitem.where("l_orderkey is not null and l_partkey is not null").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()  # one shuffle, by order
    if pairs:
        e = x.select("l_orderkey", F.col("l_partkey").alias("src")).join(x.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").where("src < dst").select("src", "dst").distinct()
    else:
        e = x.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_partkey")).alias("dst")).where("dst is not null").distinct()
    h = F.conv(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8), 16, 10).cast("bigint") % 5
    n = part.select(F.col("p_partkey").alias("node"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 5).alias("label"), F.when(h == 0, "test").otherwise("train").alias("split"))
    return e, n


def stratified(nodes: DataFrame, share: float = 0.2, bits: int = 12) -> DataFrame:
    """Nodes with a split anew: of each label's nodes the share (rounded) with the smallest md5 (ties by node) is the test split.

    The hashes are counted in 2**bits buckets a label; only the nodes of the one bucket where a label's share ends are ranked, so no label gathers in one task.
    """
    h = F.conv(F.substring(F.md5(F.col("node").cast("string")), 1, 8), 16, 10).cast("bigint")
    x = nodes.drop("split").withColumn("_h", h).withColumn("_b", F.shiftright("_h", 32 - bits))
    n = x.groupBy("label", "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy("label")
    n = n.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).withColumn("_take", F.floor(F.sum("_n").over(w) * F.lit(share) + F.lit(0.5)))  # 2**bits rows a label at most
    n = n.withColumn("_left", F.col("_take") - F.col("_before")).select(F.col("label").alias("_l"), F.col("_b").alias("_k"), "_n", "_left")
    y = x.join(n, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_k")))
    sure = y.where("_left >= _n or _left <= 0").withColumn("split", F.when(F.col("_left") > 0, "test").otherwise("train"))
    r = F.row_number().over(W.partitionBy("label", "_b").orderBy("_h", "node"))
    edge = y.where("_left < _n and _left > 0").withColumn("_r", r).withColumn("split", F.when(F.col("_r") <= F.col("_left"), "test").otherwise("train")).drop("_r")
    return sure.unionByName(edge).drop("_h", "_b", "_l", "_k", "_n", "_left")


def degrees(sym: DataFrame, nodes: DataFrame) -> DataFrame:
    d = sym.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(d, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def profile(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: sizes, degrees, isolated share, class imbalance, homophily of train-train edges, share of test nodes with a train neighbour."""
    sym = symmetric(edges)
    d = degrees(sym, nodes)
    shape = d.agg(F.count("*").alias("n_nodes"), F.round(F.avg("degree"), 4).alias("mean_degree"), F.expr("percentile(degree, 0.5)").alias("median_degree"), F.round(F.avg((F.col("degree") == 0).cast("int")), 4).alias("isolated_share"))
    classes = nodes.where("split = 'train'").groupBy("label").count().agg(F.count("*").alias("n_classes"), F.round(F.max("count") / F.greatest(F.min("count"), F.lit(1)), 4).alias("imbalance"))
    tr = nodes.where("split = 'train'").select("node", "label")
    tt = sym.where("src < dst").join(tr.withColumnsRenamed({"node": "src", "label": "a"}), "src").join(tr.withColumnsRenamed({"node": "dst", "label": "b"}), "dst")
    hom = tt.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 4).alias("homophily"), F.count("*").alias("train_edges"))
    near = sym.join(tr.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().withColumn("near", F.lit(1))
    cover = nodes.where("split = 'test'").join(near, "node", "left").agg(F.round(F.avg(F.coalesce("near", F.lit(0))), 4).alias("test_with_train_neighbour"))
    edge = sym.agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(0)).alias("n_edges"))
    one = F.lit(True)  # single rows
    return shape.join(classes, one).join(hom, one).join(cover, one).join(edge, one)


def normalised(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w) of D^-1/2 (A + I) D^-1/2, the diagonal set to one before."""
    e = symmetric(edges).where("src != dst").unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    d = e.groupBy("src").agg((1 / F.sqrt(F.count("*").cast("double"))).alias("s"))
    return e.join(d, "src").join(d.withColumnsRenamed({"src": "dst", "s": "t"}), "dst").select("src", "dst", (F.col("s") * F.col("t")).alias("w"))


def correct_and_smooth(edges: DataFrame, nodes: DataFrame, prior: DataFrame, a1: float = 0.8, a2: float = 0.8, n1: int = 50, n2: int = 50, scale: float = 1.0, ends: int = ENDS) -> DataFrame:
    """(node, label, v): residuals of the train nodes are propagated and added to the prior, train rows are reset to their labels, and the result is smoothed.

    `prior` is (node, label, v) for all nodes and classes; a class missing at a node counts 0. All steps run over blocks of about `ends` edge ends (see `blocks`); nodes are whole numbers.
    """
    known = nodes.where("split = 'train' and label is not null").select("node", F.col("label").alias("own"))
    classes = sorted(r[0] for r in prior.select("label").where("label is not null").distinct().union(known.select("own").distinct()).distinct().collect())  # one row a class
    if not classes:
        return prior.select("node", "label", F.col("v").cast("double").alias("v")).limit(0)
    cols = [f"c{k}" for k in range(len(classes))]
    wide = prior.groupBy("node").agg(*[F.coalesce(F.sum(F.when(F.col("label") == y, F.col("v"))), F.lit(0.0)).cast("double").alias(c) for c, y in zip(cols, classes, strict=True)])
    own = F.coalesce(*[F.when(F.col("own") == y, k) for k, y in enumerate(classes)], F.lit(-1))
    base = nodes.select("node").distinct().join(wide, "node", "left").join(known, "node", "left").select("node", own.alias("own"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])
    g = Blocks(edges, base, len(classes), ends)
    hot = lambda own: np.arange(len(cols))[:, None] == own
    g.start(lambda own, p, _: np.where(own >= 0, hot(own) - p, 0.0), "residual")
    res = g.propagate("residual", a1, n1)
    g.start(lambda own, p, r: np.where(own >= 0, hot(own), np.maximum(0.0, p + scale * r)), "smooth", res)
    x = g.rows(g.propagate("smooth", a2, n2, clip=True))
    return x.select("node", F.element_at(F.array(*map(F.lit, classes)), F.col("k") + 1).alias("label"), "v")


def backbone(features: DataFrame, columns: list[str], rounds: int = 20) -> DataFrame:
    """(node, label, v): class probabilities of every node by a logistic regression on its scaled features, fitted to the train nodes with the weights n / (classes * count)
    of their classes. features: node, label, split and the columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = features.where("split = 'train' and label is not null").groupBy("label").count()
    one = n.agg(F.sum("count").alias("all"), F.count("*").alias("k"))
    weight = n.join(F.broadcast(one), F.lit(True)).select("label", (F.col("all") / (F.col("k") * F.col("count"))).alias("weight"))  # one row a class
    x = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep").transform(features.fillna(0.0, columns))
    x = MaxAbsScaler(inputCol="_raw", outputCol="_features").fit(x).transform(x)
    fit = x.where("split = 'train' and label is not null").join(F.broadcast(weight), "label")
    model = LogisticRegression(featuresCol="_features", weightCol="weight", maxIter=rounds).fit(fit)
    p = model.transform(x).select("node", F.posexplode(vector_to_array("probability")).alias("label", "v"))
    return p.select("node", F.col("label").cast("int").alias("label"), "v")


def uniform_prior(nodes: DataFrame) -> DataFrame:
    """Class shares of the train nodes for every node: (node, label, v)."""
    c = nodes.where("split = 'train' and label is not null").groupBy("label").count()
    p = c.withColumn("v", F.col("count") / F.sum("count").over(W.partitionBy(F.lit(1)))).select("label", "v")  # one row a class
    return nodes.select("node").join(F.broadcast(p), F.lit(True))


def predicted(x: DataFrame) -> DataFrame:
    """The label of the largest value (rounded to 9 decimals; ties to the smaller label)."""
    return x.groupBy("node").agg(F.min(F.struct((-F.round("v", 9)).alias("m"), "label")).alias("b")).select("node", F.col("b.label").alias("pred"))


def slices(pred: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slice, n, accuracy) per class, by isolation and by a labelled neighbour; empty slices are absent."""
    e = edges.where("src is not null and dst is not null")
    ends = e.select(F.col("src").alias("node"), "dst").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("dst")))  # repeated ends change nothing here
    tr = nodes.where("split = 'train'").select(F.col("node").alias("dst"), F.lit(1).alias("near")).distinct()
    near = ends.join(tr.hint("shuffle_hash"), "dst", "left").groupBy("node").agg(F.max("near").alias("near"), F.lit(1).alias("linked"))
    x = nodes.where("split = 'test'").join(pred, "node").join(near, "node", "left").withColumn("ok", (F.col("pred") == F.col("label")).cast("int"))
    s = F.array(F.concat(F.lit("class_"), "label"), F.when(F.col("linked").isNull(), "isolated").otherwise("connected"), F.when(F.col("near") == 1, "has_labelled_neighbour").otherwise("no_labelled_neighbour"), F.lit("all"))
    return x.withColumn("slice", F.explode(s)).groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 4).alias("accuracy"))


def confusions(pred: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent confusions (ties by labels)."""
    x = nodes.where("split = 'test'").join(pred, "node").where("pred != label")
    return x.groupBy("label", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "pred").limit(k)


def majority(nodes: DataFrame) -> DataFrame:
    """Accuracy on the test nodes of always saying the most frequent train label (ties to the smaller)."""
    m = nodes.where("split = 'train'").groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(F.col("label").alias("pred"))
    return nodes.where("split = 'test'").join(F.broadcast(m), F.lit(True)).groupBy("pred").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 4).alias("accuracy"))
