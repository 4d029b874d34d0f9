"""Propagation over blocks of a graph against numpy, and what it keeps on disk."""

import os

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import graph
from orrery.session import shared_folder


def example(spark, n=200):
    rng = np.random.default_rng(1)
    e = [(int(a) * 3, int(b) * 3) for a, b in rng.integers(0, n, (900, 2))] + [(3, 3), (0, 100_000), (0, 100_000), (100_000, 0)]
    label = rng.integers(0, 3, n).tolist()
    nodes = [(i * 3, y, "test" if i % 5 == 0 else "train") for i, y in enumerate(label)]
    a = np.zeros((n + 1, n + 1))
    for i, j in e:
        i, j = min(i // 3, n), min(j // 3, n)  # the last is an end of edges that is no node
        a[i, j] = a[j, i] = 1
    np.fill_diagonal(a, 1)
    a[n, n] = 0
    a = (a / np.sqrt(np.outer(a.sum(1), a.sum(1))))[:n, :n]
    return spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame(nodes, "node long, label int, split string"), a, np.eye(3)[label], np.array([x[2] == "train" for x in nodes])[:, None]


def kept(spark):
    """Bytes in the folders of blocks."""
    top = shared_folder(spark).removeprefix("file:")
    return {d: sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(f"{top}/{d}") for f in files) for d in os.listdir(top) if d.startswith("blocks-")}


def test_blocks_equal_one_matrix(spark):
    e, n, a, hot, train = example(spark)
    prior = hot[train[:, 0]].mean(0)[None]
    x0 = x = np.where(train, hot - prior, 0)
    for _ in range(5):
        x = 0.2 * x0 + 0.8 * a @ x
    x0 = x = np.where(train, hot, np.maximum(0, prior + x))
    for _ in range(4):
        x = np.maximum(0, 0.2 * x0 + 0.8 * a @ x)
    for ends in (1 << 21, 100):  # one block, many
        got = {(r["node"] // 3, r["label"]): r["v"] for r in graph.correct_and_smooth(e, n, graph.uniform_prior(n), n1=5, n2=4, ends=ends).collect()}
        assert len(got) == 600 and all(abs(v - x[k]) < 1e-12 for k, v in got.items())


def test_disk_does_not_grow_with_the_steps(spark):
    e, n, *_ = example(spark)
    size = []
    for steps in (2, 7):
        before = set(kept(spark))
        graph.correct_and_smooth(e, n, graph.uniform_prior(n), n1=steps, n2=steps, ends=100).count()
        size.append(sum(v for k, v in kept(spark).items() if k not in before))
    assert size[0] == size[1] > 0


def test_slices_shuffle_edges_once(spark):
    """By one join and one sum over the edges' ends, with no distinct of them; the rows as before."""
    e, n, a, *_ = example(spark)
    pred = n.select("node", (F.col("node") % 3).cast("int").alias("pred"))
    x = graph.slices(pred, n.unionByName(spark.createDataFrame([(70_001, 1, "test")], n.schema)), e)
    got = {r["slice"]: r["n"] for r in x.collect()}
    test = np.arange(200) % 5 == 0
    near = ((a > 0) & ~np.eye(200, dtype=bool))[:, ~test].any(axis=1)
    assert got.get("isolated", 0) == 0 and got["all"] == test.sum() and got["has_labelled_neighbour"] == (near & test).sum()
    got = {r["slice"]: r["n"] for r in graph.slices(pred.unionByName(spark.createDataFrame([(70_001, 1)], pred.schema)), n.unionByName(spark.createDataFrame([(70_001, 1, "test")], n.schema)), e).collect()}
    assert got["isolated"] == 1 and got["all"] == test.sum() + 1
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 7  # 9 when the ends were read for the degrees and again for the neighbours


def test_accuracy_links_all_parts_of_an_order(spark, tmp_path):
    import duckdb

    from orrery.plans import c3_graph

    rng = np.random.default_rng(2)
    orders = [(int(o), int(p)) for o, p in rng.integers(0, 40, (160, 2))] + [(1, 7), (1, 7), (None, 3), (2, None)]
    spark.createDataFrame(orders, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f"Brand#{i % 3 + 11}") for i in range(40)], "p_partkey long, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    want = {(p, q) for o, p in orders for k, q in orders if None not in (o, p, q) and o == k and p < q}
    assert {tuple(r) for r in c3_graph.parts(spark, str(tmp_path), pairs=True)[0].collect()} == want and c3_graph.parts(spark, str(tmp_path))[0].count() < len(want)
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("c3_accuracy", "c3_predictions"):
        assert sorted(tuple(r) for r in c3_graph.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(con.execute(c3_graph.ORACLE[name]).fetchall())


def test_backbone_stages_make_the_features_once(spark, monkeypatch, tmp_path):
    """The fit and the predictions read them from a table, so the edges are counted into degrees once."""
    from orrery.plans import c3_graph

    rng = np.random.default_rng(3)
    spark.createDataFrame([(int(o), int(p)) for o, p in rng.integers(0, 60, (200, 2))], "l_orderkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f"Brand#{i % 3 + 11}", i % 3, float(i)) for i in range(60)], "p_partkey long, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plans, fit = [], graph.backbone
    monkeypatch.setattr(graph, "backbone", lambda x, columns: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or fit(x, columns))
    got = {r["stage"]: r["n"] for r in c3_graph.stages(spark, str(tmp_path)).collect()}
    assert got["backbone"] == got["backbone+cs"] > 0 and len(plans) == 1 and "Join" not in plans[0] and "Aggregate" not in plans[0]
