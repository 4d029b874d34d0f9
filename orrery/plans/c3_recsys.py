"""Queries over sequences and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import recsys as r
from orrery.session import written
from orrery.tables import table


_BUILT: dict = {}


def interactions(s, d):
    """All interactions in order, written once a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = written(r.interactions(table(s, d, "orders"), table(s, d, "lineitem")), "uid", "pos")
    return _BUILT[key]


def parts(s, d):
    return r.split(interactions(s, d))


def sequences(s, d):
    hist, tgt = parts(s, d)
    c = r.item_counts(hist).groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "iid", "cnt"))), lambda x: F.concat_ws(":", x.iid, x.cnt)), ",").alias("item_seq_counts"))  # one user's items
    raw = hist.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "iid"))), lambda x: x.iid.cast("string")), ", ").alias("item_seq_raw"))
    return tgt.join(raw, "uid", "left").join(c, "uid", "left").select("uid", "target", "item_seq_raw", "item_seq_counts")


def ranked(s, d, fifth=0):
    """Ranking of the held-out users, fitted to the others."""
    hist, tgt = parts(s, d)
    out, rest = r.holdout(tgt, "uid", fifth)
    return r.rank(hist.join(rest.select("uid"), "uid", "left_semi"), rest, out, hist), out


def profile(s, d):
    one = interactions(s, d).agg(F.count_distinct("iid").alias("n_items"))
    return r.profile(*parts(s, d)).join(F.broadcast(one), F.lit(True))  # single rows


def scores(s, d):
    x, out = ranked(s, d)
    return r.ndcg(x, out)


def by_slice(s, d):
    hist, _ = parts(s, d)
    n = scores(s, d)
    seen = r.item_counts(hist).select("uid", F.col("iid").alias("target"), F.lit(1).alias("seen"))
    n = n.join(seen, ["uid", "target"], "left").withColumn("slice", F.explode(F.array(r.bucket(), F.when(F.col("seen") == 1, "repeat").otherwise("new"), F.lit("all"))))
    return n.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def holdout_sizes(s, d):
    a, b = r.holdout(parts(s, d)[1], "uid")
    return a.agg(F.count("*").alias("n"), F.sum("target").alias("checksum")).withColumn("part", F.lit("held_out")).unionByName(b.agg(F.count("*").alias("n"), F.sum("target").alias("checksum")).withColumn("part", F.lit("rest")))


def aligned(s, d):
    x, _ = ranked(s, d)
    one = x.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "iid"))), lambda y: y.iid.cast("string")), ",").alias("prediction"))  # ten items
    t = table(s, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_custkey").alias("pos"))
    return r.align(t, one, "uid", "pos").select("uid", "prediction")


QUERIES = {
    "c3_sequences": sequences,
    "c3_parse_tokens": lambda s, d: sequences(s, d).select("uid", F.size(r.tokens("item_seq_raw")).alias("n"), F.try_element_at(r.tokens("item_seq_raw"), F.lit(-1)).alias("last")),
    "c3_parse_counts": lambda s, d: sequences(s, d).select("uid", F.explode(r.counts("item_seq_counts")).alias("x")).select("uid", "x.iid", "x.cnt"),
    "c3_rec_profile": profile,
    "c3_popular": lambda s, d: r.top_popular(parts(s, d)[1]),
    "c3_covisits": lambda s, d: r.covisits(parts(s, d)[0]),
    "c3_holdout": holdout_sizes,
    "c3_rank": lambda s, d: ranked(s, d)[0],
    "c3_ndcg": scores,
    "c3_ndcg_by_slice": by_slice,
    "c3_template_align": aligned,
    "c3_mean_ndcg": lambda s, d: scores(s, d).agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg")),
}

SEQ = """
with i as (select o_custkey as uid, l_partkey as iid, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, count(*) over (partition by o_custkey) as n
  from lineitem join orders on l_orderkey = o_orderkey where o_custkey is not null and l_partkey is not null),
h as (select * from i where pos < n), t as (select uid, iid as target, n - 1 as len from i where pos = n),
c as (select uid, iid, count(*) as cnt, min(pos) as first from h group by all)
"""
HELD = SEQ + """, o as (select * from t where ('0x' || substr(md5(uid::varchar), 1, 8))::bigint % 5 = 0)"""
def co(src: str) -> str:
    """Co-visits of the users in `src`."""
    return f""", rc as (select uid, iid from (select uid, iid, row_number() over (partition by uid order by first desc) as r from c where uid in (select uid from {src})) where r <= 10),
cv as (select a.iid as a, b.iid as b, count(*) as cnt from rc a join rc b using (uid) where a.iid != b.iid group by all)"""


RANK = HELD + ", rs as (select * from t where uid not in (select uid from o))" + co("rs") + """, m as (select c.uid, c.iid, c.cnt, c.cnt / max(c.cnt) over (partition by c.uid) as h from c join o using (uid)),
co0 as (select m.uid, cv.b as iid, sum(m.cnt * cv.cnt) as co from m join cv on m.iid = cv.a group by all), co as (select uid, iid, co / max(co) over (partition by uid) as c from co0),
pp as (select target as iid, count(*) as pop from rs group by target), np as (select iid, pop / (select max(pop) from pp) as p from pp), hd as (select iid from np order by p desc, iid limit 50),
cd as (select uid, iid, max(h) as h, max(c) as c from (select uid, iid, h, null as c from m union all select uid, iid, null, c from co union all select uid, iid, null, null from o cross join hd) group by all),
sc as (select uid, iid, round(2.0 * coalesce(h, 0) + 1.0 * coalesce(c, 0) + 0.2 * coalesce(p, 0), 6) as score from cd left join np using (iid)),
rk as (select * from (select *, row_number() over (partition by uid order by score desc, iid) as rank from sc) where rank <= 10)"""
ND = RANK + """, nd as (select o.uid, o.target, o.len, round(coalesce(1 / log2(rk.rank + 1.0), 0), 6) as ndcg from o left join rk on rk.uid = o.uid and rk.iid = o.target)"""
SEQS = SEQ + """, s as (select t.uid, target, (select string_agg(iid::varchar, ', ' order by pos) from h where h.uid = t.uid) as item_seq_raw from t),
cs as (select uid, string_agg(iid || ':' || cnt, ',' order by first) as item_seq_counts from c group by uid)"""

ORACLE = {
    "c3_sequences": SEQS + " select s.uid, target, item_seq_raw, item_seq_counts from s left join cs using (uid)",
    "c3_parse_tokens": SEQ + " select t.uid, len::int as n, (select arg_max(iid, pos)::varchar from h where h.uid = t.uid) as last from t",
    "c3_parse_counts": SEQ + " select uid, iid::varchar as iid, cnt::int as cnt from c",
    "c3_rec_profile": SEQ
    + """, b as (select uid, arg_min(iid, (-cnt, first)) as often from c group by uid), l as (select uid, arg_max(iid, pos) as last from h group by uid), tp as (select target from t group by target order by count(*) desc, target limit 10)
select count(*) as n_users, round(avg(len), 4) as mean_len, trunc(quantile_cont(len, 0.5))::int as median_len, trunc(quantile_cont(len, 0.9))::int as p90_len, max(len) as max_len, round(avg((len <= 2)::int), 4) as cold_share, round(avg((len = 0)::int), 4) as empty_share,
  round(avg((c.iid is not null)::int), 4) as repeat_rate, round(avg(coalesce((target = last)::int, 0)), 4) as target_is_last, round(avg(coalesce((target = often)::int, 0)), 4) as target_is_most_frequent, round(avg((target in (from tp))::int), 4) as target_in_top10, (select count(distinct iid) from i) as n_items
from t left join b using (uid) left join l using (uid) left join c on c.uid = t.uid and c.iid = t.target""",
    "c3_popular": SEQ + " select target as iid, count(*) as pop from t group by target order by pop desc, iid limit 10",
    "c3_covisits": SEQ + co("t") + " select * from cv",
    "c3_holdout": HELD + " select count(*) as n, sum(target)::bigint as checksum, 'held_out' as part from o union all select count(*), sum(target)::bigint, 'rest' from t where uid not in (select uid from o)",
    "c3_rank": RANK + " select uid, iid, score, rank from rk",
    "c3_ndcg": ND + " select uid, target, len, round(ndcg, 6) as ndcg from nd",
    "c3_ndcg_by_slice": ND
    + """, sl as (select ndcg, unnest([case when len = 0 then '0' when len <= 2 then '1-2' when len <= 10 then '3-10' else '>10' end, case when c.iid is not null then 'repeat' else 'new' end, 'all']) as slice from nd left join c on c.uid = nd.uid and c.iid = nd.target)
select slice, count(*) as n, round(avg(ndcg), 6) as ndcg from sl group by slice""",
    "c3_template_align": RANK + ", p as (select uid, string_agg(iid::varchar, ',' order by rank) as prediction from rk group by uid) select c_custkey as uid, prediction from customer left join p on uid = c_custkey",
    "c3_mean_ndcg": ND + " select count(*) as n, round(avg(ndcg), 6) as ndcg from nd",
}
