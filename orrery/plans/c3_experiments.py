"""Queries over trials, graded answers and document scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import experiments as x
from orrery.plans import c3_graph, c3_recsys
from orrery.operators import graph
from orrery.tables import table


def log(s, d):
    return x.trials(table(s, d, "documents"))


def answers(s, d):
    q = table(s, d, "questions")
    n = F.length("question")
    letter = lambda v: F.element_at(F.array(*map(F.lit, "ABCD")), (v % 4 + 1).cast("int"))
    return q.select("qid", "domain", letter(n).alias("pred"), letter(n + F.when(n % 3 == 0, 1).otherwise(0)).alias("gold"), F.when(n % 7 == 0, "defective").when(n % 2 == 0, "high").otherwise("low").alias("confidence"), (n * 37).alias("tokens"))


def pairs(s, d):
    """Part names against each other as prediction and gold; a table score where the size is even."""
    p = table(s, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("pred"), F.concat_ws(" ", "p_type", "p_brand").alias("gold"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 50).alias("table_score"))


def composed(s, d):
    three, two = x.composite(x.edit_loss(F.col("pred"), F.col("gold")), F.col("table_score"), x.order_loss(F.col("pred"), F.col("gold")))
    return pairs(s, d).select("p_partkey", F.round(three, 6).alias("overall3"), F.round(two, 6).alias("overall2"), F.col("table_score").alias("table_score"))


def table_rows(s, d, kind):
    t = table(s, d, "doc_tables").groupBy("table_id").agg(F.min("doc_id").alias("doc_id"), F.min(F.length("markdown")).alias("n"))
    t = t.where("n is not null").select("doc_id", F.col("table_id").alias("id"), F.round(F.col("n") / 1000, 6).alias("score"))
    return t if kind == "gold" else t.where(F.col("score") > 0.25)


def calls(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), "value")


QUERIES = {
    "ex_trials": lambda s, d: log(s, d).select("id", "source", "metric", "status", F.element_at("config", "size").alias("size")),
    "ex_best": lambda s, d: x.best(log(s, d)).select("id", "metric"),
    "ex_coverage": lambda s, d: x.coverage(log(s, d)),
    "ex_leaderboard": lambda s, d: x.leaderboard(log(s, d)),
    "ex_recent_deltas": lambda s, d: x.recent_deltas(log(s, d)),
    "ex_failures": lambda s, d: x.failures(log(s, d)),
    "ex_weakest_slices": lambda s, d: x.weakest_slices(log(s, d)),
    "ex_trajectory": lambda s, d: x.trajectory(log(s, d)).select("id", F.get_json_object("record", "$.status").alias("status"), F.get_json_object("record", "$.id").cast("int").alias("again")),
    "ex_graded_rollup": lambda s, d: x.graded(answers(s, d), "domain", "pred", "gold", "confidence"),
    "ex_token_factor": lambda s, d: answers(s, d).select("qid", F.round(x.token_factor(F.col("tokens"), 3000.0), 6).alias("factor"), F.round(x.token_factor(F.col("tokens"), 3000.0, False), 6).alias("unclamped")),
    "ex_token_totals": lambda s, d: answers(s, d).withColumn("running", F.sum("tokens").over(W.partitionBy("domain").orderBy("qid"))).select("qid", "domain", "running"),
    "ex_edit_loss": lambda s, d: pairs(s, d).select("p_partkey", F.round(x.edit_loss(F.col("pred"), F.col("gold")), 6).alias("loss")),
    "ex_order_loss": lambda s, d: pairs(s, d).select("p_partkey", F.round(x.order_loss(F.col("pred"), F.col("gold")), 6).alias("loss")),
    "ex_composite": composed,
    "ex_batch_means": lambda s, d: x.batch_means(composed(s, d), "overall3", "table_score"),
    "ex_means_by_kind": lambda s, d: composed(s, d).join(table(s, d, "part"), "p_partkey").groupBy("p_brand").agg(F.round(F.avg("overall2"), 6).alias("mean"), F.round(F.avg("table_score"), 6).alias("table_mean")),
    "ex_ordinal_scores": lambda s, d: x.ordinal_scores(table_rows(s, d, "gold"), table_rows(s, d, "pred"), "doc_id"),
    "ex_resume": lambda s, d: x.resume(calls(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("key")), "key"),
    "ex_last_per_key": lambda s, d: x.last_per_key(calls(s, d), "key", "seq"),
    "ex_merge_parts": lambda s, d: x.merged(table(s, d, "doc_blocks").select("block_id").distinct(), table(s, d, "doc_blocks").where("page is null or page % 2 = 0").groupBy("block_id").agg(F.min("text").alias("text")), table(s, d, "doc_blocks").where("page % 2 = 1").groupBy("block_id").agg(F.min("text").alias("text")), "block_id", "text"),
    "ex_summary_split": lambda s, d: answers(s, d).select("qid", "tokens").unionByName(answers(s, d).agg(F.lit("summary").alias("qid"), F.sum("tokens").alias("tokens"))).where("qid = 'summary'"),
    "ex_domain_tallies": lambda s, d: table(s, d, "questions").groupBy("domain", "type").agg(F.count("*").alias("n")),
    "ex_plan_graph": lambda s, d: x.decide(graph.profile(*c3_graph.parts(s, d)), "classification"),
    "ex_first_trial": lambda s, d: x.first_trial(graph.profile(*c3_graph.parts(s, d)), "classification"),
    "ex_append_trial": lambda s, d: x.append_trial(log(s, d).select("id", "source", "metric"), log(s, d).agg(F.lit("new").alias("source"), F.max("metric").alias("metric"))),
    "ex_calibrated": lambda s, d: x.calibrated(answers(s, d), "domain", "pred", "gold", "confidence", "tokens", 5_000_000.0),
    "ex_plan_rec": lambda s, d: x.decide(c3_recsys.profile(s, d), "recommendation"),
}

T = """with g as (select source, count(*) as n, round(avg(coalesce(lang in ('zh','en','de','fr','es','pt'), false)::int), 6) as metric, count(distinct domain) as domains, round(avg(n_chars), 4) as chars from documents where source is not null group by source),
t as (select row_number() over (order by source)::int as id, source, domains, case when n >= 40 then 'large' else 'small' end as size, metric, chars, n::double as rows, case when metric < 0.7 then 'failed' else 'ok' end as status from g)"""
A = """with a as (select qid, domain, length(question) as n from questions), an as (select qid, domain, substring('ABCD', (n % 4 + 1)::int, 1) as pred, substring('ABCD', ((n + case when n % 3 = 0 then 1 else 0 end) % 4 + 1)::int, 1) as gold,
  case when n % 7 = 0 then 'defective' when n % 2 = 0 then 'high' else 'low' end as confidence, n * 37 as tokens from a)"""
P = """with p as (select p_partkey, p_brand, p_name as pred, concat_ws(' ', p_type, p_brand) as gold, case when p_size % 2 = 0 then p_size / 50.0 end as table_score from part),
l as (select *, case when length(gold) = 0 then case when length(pred) = 0 then 0.0 else 1.0 end else least(1.0, levenshtein(pred, gold) / length(gold)) end as el, levenshtein(regexp_replace(pred, '\\s', '', 'g'), regexp_replace(gold, '\\s', '', 'g')) / greatest(length(regexp_replace(pred, '\\s', '', 'g')), length(regexp_replace(gold, '\\s', '', 'g'))) as ol from p),
co as (select p_partkey, p_brand, round(((1 - el) * 100 + coalesce(table_score * 100, 100) + (1 - ol) * 100) / 3, 6) as overall3, round(((1 - el) * 100 + (1 - ol) * 100) / 2, 6) as overall2, table_score::double as table_score from l)"""


def rules(profile_sql: str, rows: list[tuple[str, str, str, str, str]]) -> str:
    """One branch a rule: model, priority, signal, hint, condition."""
    v = " union all ".join(f"select {i} as rule, '{m}' as model, ({p})::int as priority, '{s}=' || round(coalesce({s}, 0)::double, 4)::varchar as signal, {h} as hint from pf where {c}" for i, (m, p, s, h, c) in enumerate(rows))
    return f"with pf as ({profile_sql}), ru as ({v}) select (row_number() over (order by priority, rule) - 1)::int as no, model, priority, signal, hint from ru"


BALANCED = "case when coalesce(imbalance, 1) >= 3 then 'balanced' end"
GRAPH = [("lightgbm", "1", "isolated_share", BALANCED, "true"), ("feature_mlp", "2", "mean_degree", BALANCED, "true"), ("correct_and_smooth", "1", "homophily", "null", "homophily >= 0.6"), ("feature_propagation", "3", "isolated_share", "null", "isolated_share >= 0.1"), ("gcn", "case when mean_degree >= 5 then 3 else 4 end", "mean_degree", "null", "true")]
REC = [("popularity", "1", "cold_share", "null", "true"), ("repeat_freq", "1", "repeat_rate", "null", "repeat_rate >= 0.3"), ("covisitation", "2", "repeat_rate", "null", "true"), ("blend", "1", "repeat_rate", "null", "true"), ("item_content_knn", "2", "n_items", "null", "n_items >= 5000"), ("sasrec", "case when cold_share >= 0.3 then 4 else 3 end", "cold_share", "null", "true")]
ORACLE = {
    "ex_trials": T + " select id, source, metric, status, size from t",
    "ex_best": T + " select id, metric from t where status = 'ok' order by metric desc, id limit 1",
    "ex_coverage": T + " select 'domains' as key, domains::varchar as value, count(*) as n from t group by all union all select 'size', size, count(*) from t group by all",
    "ex_leaderboard": T + " select row_number() over (order by metric desc, id) as rank, id, metric from t where status = 'ok' order by rank limit 5",
    "ex_recent_deltas": T + ", r as (select *, max(case when status = 'ok' then metric end) over (order by id rows between unbounded preceding and 1 preceding) as best from t) select id, status, metric, round(metric - best, 6) as delta from r order by id desc limit 5",
    "ex_failures": T + " select id, metric from t where status = 'failed' order by id desc limit 3",
    "ex_weakest_slices": T + ", s as (select id, 'chars' as slice, chars as value from t union all select id, 'rows', rows from t) select id, slice, value, row_number() over (partition by id order by value, slice) as r from s",
    "ex_trajectory": T + " select id, status, id as again from t",
    "ex_graded_rollup": A
    + ", f as (select *, (pred = gold)::int as ok from an where confidence != 'defective') select domain, count(*) as n, sum(ok)::bigint as right, round(avg(ok), 4) as accuracy, count(*) filter (confidence = 'high') as high_n, round(avg(ok) filter (confidence = 'high'), 4) as high_accuracy from f group by rollup (domain)".replace(" as right", ' as "right"'),
    "ex_token_factor": A + " select qid, round(0.7 + 0.3 * greatest(0.0, least(1.0, (3000.0 - tokens) / 3000.0)), 6) as factor, round(0.7 + 0.3 * (3000.0 - tokens) / 3000.0, 6) as unclamped from an",
    "ex_token_totals": A + " select qid, domain, sum(tokens) over (partition by domain order by qid)::bigint as running from an",
    "ex_edit_loss": P + " select p_partkey, round(el, 6) as loss from l",
    "ex_order_loss": P + " select p_partkey, round(ol, 6) as loss from l",
    "ex_composite": P + " select p_partkey, overall3, overall2, table_score from co",
    "ex_batch_means": P + " select count(*) as n, round(avg(overall3), 6) as mean, round(avg(table_score), 6) as table_mean, round(avg(overall3) filter (table_score is not null), 6) as with_table, round(avg(overall3) filter (table_score is null), 6) as without_table from co",
    "ex_means_by_kind": P + " select p_brand, round(avg(overall2), 6) as mean, round(avg(table_score), 6) as table_mean from co group by p_brand",
    "ex_ordinal_scores": """with t as (select table_id as id, min(doc_id) as doc_id, round(min(length(markdown)) / 1000.0, 6) as score from doc_tables group by table_id), g as (select *, row_number() over (partition by doc_id order by id) as k from t where score is not null),
p as (select *, row_number() over (partition by doc_id order by id) as k from t where score > 0.25) select g.doc_id, count(*) as n, round(avg(coalesce(p.score, 0)), 6) as score from g left join p on p.doc_id = g.doc_id and p.k = g.k group by g.doc_id""",
    "ex_resume": "select c_custkey as key from customer where c_custkey not in (select user_id from events where event_type != 'error')",
    "ex_last_per_key": "select user_id as key, max(event_id) as seq, arg_max(event_type != 'error', event_id) as ok, arg_max(value, event_id) as value from events group by user_id",
    "ex_merge_parts": "with k as (select distinct block_id from doc_blocks), a as (select block_id, min(text) as text from doc_blocks where page is null or page % 2 = 0 group by 1), b as (select block_id, min(text) as text from doc_blocks where page % 2 = 1 group by 1) select k.block_id, coalesce(a.text, b.text) as text, coalesce(a.text, b.text) is null as missing, coalesce(a.text, b.text) = '' as blank from k left join a using (block_id) left join b using (block_id)",
    "ex_summary_split": A + " select 'summary' as qid, sum(tokens)::bigint as tokens from an",
    "ex_domain_tallies": "select domain, type, count(*) as n from questions group by all",
    "ex_plan_graph": rules(c3_graph.ORACLE["c3_graph_profile"], GRAPH),
    "ex_plan_rec": rules(c3_recsys.ORACLE["c3_rec_profile"], REC),
    "ex_first_trial": f"select case when homophily >= 0.6 then 'lightgbm(class_weight=balanced) + correct_and_smooth' else 'lightgbm(class_weight=balanced)' end as first_trial from ({c3_graph.ORACLE['c3_graph_profile']})",
    "ex_append_trial": T + " select id, source, metric from t union all select count(*)::int, 'new', max(metric) from t",
    "ex_calibrated": A + """, f as (select *, (pred = gold)::int as ok from an where confidence != 'defective'), gr as (select domain, count(*) as n, sum(ok)::bigint as "right", round(avg(ok), 4) as accuracy, count(*) filter (confidence = 'high') as high_n, round(avg(ok) filter (confidence = 'high'), 4) as high_accuracy from f group by rollup (domain)),
tt as (select domain, sum(tokens)::bigint as tokens from an group by rollup (domain)) select gr.*, tokens, round(100 * accuracy * (0.7 + 0.3 * greatest(0.0, least(1.0, (5000000.0 - tokens) / 5000000.0))), 4) as score from gr join tt on gr.domain is not distinct from tt.domain""",
}
