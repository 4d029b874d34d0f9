"""Queries over the graph of parts and its labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import graph as g
from orrery.session import released, written
from orrery.tables import table


_BUILT: dict = {}


def parts(s, d, pairs=False):
    """(edges, nodes), written once a session."""
    key = (s.sparkContext.applicationId, d, pairs)
    if key not in _BUILT:
        e, n = g.from_parts(table(s, d, "lineitem"), table(s, d, "part"), pairs)
        _BUILT[key] = written(e, "src"), written(n, "node")
        del e, n
        released(s)
    return _BUILT[key]


def smoothed(s, d, **graph):
    """All 50 + 50 steps, written once a session."""
    key = (s.sparkContext.applicationId, d, "smoothed", *graph.items())
    if key not in _BUILT:
        e, n = parts(s, d, **graph)
        _BUILT[key] = written(g.correct_and_smooth(e, n, g.uniform_prior(n)))
        released(s)
    return _BUILT[key]


def pred(s, d, **graph):
    return g.predicted(smoothed(s, d, **graph))


def features(s, d, nodes):
    e, _ = parts(s, d)
    x = g.degrees(g.symmetric(e), nodes).join(table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price")).dropDuplicates(["node"]), "node", "left")
    return x.withColumn("degree", F.col("degree").cast("double"))


def accuracy(pred, nodes):
    return pred.join(nodes.where("split='test'"), "node").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 4).alias("accuracy"))


def stages(s, d):
    """Accuracy of the feature backbone on the test split, alone and with its probabilities corrected and smoothed."""
    e, n = parts(s, d)
    x = written(features(s, d, n))  # the fit reads them again and again
    released(s)
    prior = written(g.backbone(x, ["degree", "size", "price"]))
    released(s)
    alone = accuracy(g.predicted(prior), n).withColumn("stage", F.lit("backbone"))
    both = accuracy(g.predicted(g.correct_and_smooth(e, n, prior)), n).withColumn("stage", F.lit("backbone+cs"))
    return alone.unionByName(both)


def logistic(s, d):
    """Accuracy of the regression on a stratified split."""
    n = g.stratified(parts(s, d)[1])
    return accuracy(g.predicted(g.backbone(features(s, d, n), ["degree", "size", "price"])), n)


QUERIES = {
    "c3_graph_edges": lambda s, d: g.symmetric(parts(s, d)[0]),
    "c3_graph_degrees": lambda s, d: g.degrees(g.symmetric(parts(s, d)[0]), parts(s, d)[1]),
    "c3_graph_profile": lambda s, d: g.profile(*parts(s, d)),
    "c3_graph_normalised": lambda s, d: g.normalised(*parts(s, d)).withColumn("w", F.round("w", 9)),
    "c3_correct_smooth": lambda s, d: smoothed(s, d).withColumn("v", F.round("v", 6)),
    "c3_predictions": pred,
    "c3_slices": lambda s, d: g.slices(pred(s, d), parts(s, d)[1], parts(s, d)[0]),
    "c3_confusions": lambda s, d: g.confusions(pred(s, d), parts(s, d)[1]),
    "c3_accuracy": lambda s, d: accuracy(pred(s, d, pairs=True), parts(s, d, pairs=True)[1]),
    "c3_backbone_stages": stages,
    "c3_stratified": lambda s, d: g.stratified(parts(s, d)[1]),
    "c3_logistic": logistic,
    "c3_majority_stratified": lambda s, d: g.majority(g.stratified(parts(s, d)[1])),
    "c3_majority": lambda s, d: g.majority(parts(s, d)[1]),
}

BASE = """
with x as (select distinct l_orderkey, l_partkey from lineitem), e as (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_partkey) as dst from x) where dst is not null),
sym as materialized (select src, dst from e union select dst, src from e),
n as (select p_partkey as node, regexp_extract(p_brand, '(\\d+)', 1)::int % 5 as label, case when ('0x' || substr(md5(p_partkey::varchar), 1, 8))::bigint % 5 = 0 then 'test' else 'train' end as split from part),
dg as (select n.*, coalesce(c, 0) as degree from n left join (select src as node, count(*) as c from sym group by src) using (node)),
ai as (select src, dst from sym where src != dst union all select node, node from n), ds as (select src, 1 / sqrt(count(*)::double) as s from ai group by src),
adj as materialized (select ai.src, ai.dst, a.s * b.s as w from ai join ds a on a.src = ai.src join ds b on b.src = ai.dst)
"""


def step(name: str, x: str, x0: str, clip: bool = False) -> str:
    """One step: node and class sums over a row's neighbours (the diagonal is among them)."""
    v = "0.2 * any_value(o.v) + 0.8 * sum(a.w * x.v)"
    v = f"greatest({v}, 0)" if clip else v
    return f", {name} as materialized (select a.src as node, x.label, {v} as v from adj a join {x} x on x.node = a.dst join {x0} o on o.node = a.src and o.label = x.label group by all)"


def steps(name: str, x0: str, n: int, clip: bool = False) -> str:
    return "".join(step(f"{name}{k}", f"{name}{k - 1}" if k > 1 else x0, x0, clip) for k in range(1, n + 1))


CS = (
    BASE
    + """, pc as (select label, count(*) as c from n where split = 'train' group by label), pr as (select node, pc.label, c / (select sum(c) from pc) as v from n cross join pc),
bs as materialized (select pr.node, pr.label, pr.v, (n.split = 'train')::int as t, (n.split = 'train' and n.label = pr.label)::int::double as y from pr join n using (node)),
e0 as materialized (select node, label, case when t = 1 then y - v else 0 end as v from bs)"""
    + steps("e", "e0", 50)
    + ", f0 as materialized (select bs.node, bs.label, case when t = 1 then y else greatest(0, bs.v + coalesce(e50.v, 0)) end as v from bs left join e50 using (node, label))"
    + steps("f", "f0", 50, True)
    + ", pd as (select node, arg_min(label, (-round(v, 9), label)) as pred from f50 group by node)"
)
NEXT = "(select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_partkey) as dst from x) where dst is not null"
PAIRS = "(select a.l_partkey as src, b.l_partkey as dst from x a join x b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)"
STRATIFIED = BASE + """, st as (select node, label, case when row_number() over (partition by label order by ('0x' || substr(md5(node::varchar), 1, 8))::bigint, node) <= floor(count(*) over (partition by label) * 0.2 + 0.5) then 'test' else 'train' end as split from n)"""
ORACLE = {
    "c3_graph_edges": BASE + " select * from sym",
    "c3_graph_degrees": BASE + " select * from dg",
    "c3_graph_profile": BASE
    + """, tr as (select node, label from n where split = 'train'), tt as (select a.label as a, b.label as b from sym join tr a on a.node = src join tr b on b.node = dst where src < dst)
select (select count(*) from n) as n_nodes, (select round(avg(degree), 4) from dg) as mean_degree, (select quantile_cont(degree, 0.5) from dg) as median_degree, (select round(avg((degree = 0)::int), 4) from dg) as isolated_share,
  (select count(distinct label) from tr) as n_classes, (select round(max(c) / greatest(min(c), 1), 4) from (select count(*) as c from tr group by label)) as imbalance, (select round(avg((a = b)::int), 4) from tt) as homophily, (select count(*) from tt) as train_edges,
  (select round(avg((node in (select src from sym where dst in (select node from tr)))::int), 4) from n where split = 'test') as test_with_train_neighbour, (select count(*) from sym where src < dst) as n_edges""",
    "c3_graph_normalised": BASE + " select src, dst, round(w, 9) as w from adj",
    "c3_correct_smooth": CS + " select node, label, round(v, 6) as v from f50",
    "c3_predictions": CS + " select * from pd",
    "c3_slices": CS
    + """, s as (select (pred = label)::int as ok, unnest(['class_' || label, case when degree = 0 then 'isolated' else 'connected' end, case when node in (select src from sym where dst in (select node from n where split = 'train')) then 'has_labelled_neighbour' else 'no_labelled_neighbour' end, 'all']) as slice from dg join pd using (node) where split = 'test')
select slice, count(*) as n, round(avg(ok), 4) as accuracy from s group by slice""",
    "c3_confusions": CS + " select label, pred, count(*) as n from n join pd using (node) where split = 'test' and pred != label group by all order by n desc, label, pred limit 5",
    "c3_accuracy": CS.replace(NEXT, PAIRS) + " select count(*) as n, round(avg((pred = label)::int), 4) as accuracy from n join pd using (node) where split = 'test'",
    "c3_stratified": STRATIFIED + " select node, label, split from st",
    "c3_majority_stratified": STRATIFIED + ", m as (select label as pred from st where split = 'train' group by label order by count(*) desc, label limit 1) select pred, count(*) as n, round(avg((pred = label)::int), 4) as accuracy from st, m where split = 'test' group by pred",
    "c3_majority": BASE + ", m as (select label as pred from n where split = 'train' group by label order by count(*) desc, label limit 1) select pred, count(*) as n, round(avg((pred = label)::int), 4) as accuracy from n, m where split = 'test' group by pred",
}
