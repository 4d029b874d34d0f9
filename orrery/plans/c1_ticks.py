"""Queries over event-window features, participant labels and scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import scores, ticks
from orrery.tables import table


def t(spark, d):
    return ticks.ticks(table(spark, d, "events"))


QUERIES = {
    "c1_window_core": lambda s, d: ticks.core(t(s, d)),
    "c1_order_size": lambda s, d: ticks.order_size(t(s, d)),
    "c1_rhythm": lambda s, d: ticks.rhythm(t(s, d)),
    "c1_cancel": lambda s, d: ticks.cancels(t(s, d)),
    "c1_active": lambda s, d: ticks.active(t(s, d)),
    "c1_quote_relative": lambda s, d: ticks.quotes(t(s, d)),
    "c1_distribution": lambda s, d: ticks.distribution(t(s, d)),
    "c1_price_impact": lambda s, d: ticks.impact(t(s, d)),
}

TICKS = """
with t as (select ts::date as date, user_id % 5 as symbol, time_bucket(interval '6 hours', ts) as window_start, time_bucket(interval '6 hours', ts) + interval '6 hours' as window_end, ts, event_id as id,
  case when event_type in ('view','click') then 'order' when event_type in ('purchase','signup') then 'trade' else 'cancel' end as act,
  case when event_type in ('view','purchase') then 'buy' when event_type in ('click','signup') then 'sell' when (props->>'$.k')::int % 2 = 0 then 'buy' else 'sell' end as side,
  value as price, (props->>'$.k')::int as qty, value * (props->>'$.k')::int as amt from events where ts is not null and user_id is not null),
k as (select date, symbol, window_start, window_end from t group by all)
"""
K = "date, symbol, window_start, window_end"
W6 = f"(partition by {K} order by ts, id)"
R = "round({}, 6)".format
DIV = "round(({a}) / nullif(({b})::double, 0), 6)".format
SUM = "coalesce(sum({v}) filter ({c}), 0)".format


def share(v: str, cond: str, of: str) -> str:
    return DIV(a=SUM(v=v, c=cond), b=of)


ORACLE = {
    "c1_window_core": TICKS
    + f""", g as (select {K}, count(*) filter (act='order') as order_count, count(*) filter (act in ('order','cancel')) as order_count_all, count(*) filter (act='cancel') as cancel_count_all,
  count(*) filter (act='trade') as deal_count, {SUM(v='amt', c="act='trade'")} as a, {SUM(v='amt', c="act='trade' and side='buy'")} as b, {SUM(v='amt', c="act='trade' and side='sell'")} as s from t group by all)
select {K}, strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start_dt, strftime(window_end, '%Y-%m-%d %H:%M:%S') as window_end_dt, order_count, order_count_all, cancel_count_all, deal_count, round(a, 6) as deal_amount, round(b, 6) as signal_deal_buy_amount, round(s, 6) as signal_deal_sell_amount,
  round(sum(a) over (partition by date, symbol), 6) as total_deal_amount_all from g""",
    "c1_order_size": TICKS
    + f""", d as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by date, symbol order by ts, id) as gap from t where act='trade'),
p as (select date, symbol, quantile_cont(amt, [0.5, 0.8, 0.95]) as p from d group by all),
b as (select d.*, case when amt > p[3] then 'mega' when amt > p[2] then 'large' when amt > p[1] then 'medium' else 'small' end as bucket from d join p using (date, symbol))
select {K}, """
    + ", ".join(f"{share('amt', f'''bucket='{x}' ''', 'sum(amt)')} as oss_{x}_amount_pct, {DIV(a=f'''count(*) filter (bucket='{x}')''', b='count(*)')} as oss_{x}_count_pct" for x in ("mega", "large", "medium", "small"))
    + f""", {DIV(a="count(*) filter (bucket='mega' and gap < 600000000)", b="count(*)")} as oss_hot_money_count_pct, {share('amt', "side='buy'", 'sum(amt)')} as oss_buy_amount_pct,
  {share('amt', "side='sell'", 'sum(amt)')} as oss_sell_amount_pct, {share('amt', "bucket='mega' and side='buy'", SUM(v='amt', c="bucket='mega'"))} as oss_mega_buy_pct from b group by {K}""",
    "c1_rhythm": TICKS
    + f""", a as (select *, epoch_us(ts) / 1000.0 as ms, lag(qty) over {W6} as q0 from t),
x as (select *, ms - lag(ms) over {W6} as gap, ms - lag(ms) over (partition by {K}, side order by ts, id) as side_gap, case when q0 > 0 then (abs(qty / q0 - 1) <= 0.1)::int end as alike from a),
y as (select *, sum(case when alike = 1 then 0 else 1 end) over {W6} as island, avg(gap) over (partition by {K}) as mean_gap from x),
z as (select *, count(*) over (partition by {K}, island) as run from y)
select {K}, {R('avg(gap)')} as rs_interval_mean_ms, {R('quantile_cont(gap, 0.5)')} as rs_interval_median_ms, {DIV(a='stddev_samp(gap)', b='avg(gap)')} as rs_interval_cv,
  {DIV(a='count(*) filter (gap < 0.1 * mean_gap)', b='count(gap)')} as rs_burst_ratio, {DIV(a="stddev_samp(side_gap) filter (side='buy')", b="avg(side_gap) filter (side='buy')")} as rs_buy_interval_cv,
  {DIV(a="stddev_samp(side_gap) filter (side='sell')", b="avg(side_gap) filter (side='sell')")} as rs_sell_interval_cv, {DIV(a='sum(alike)', b='count(alike)')} as rs_split_similarity,
  {DIV(a='count(*) filter (run >= 3)', b='count(*)')} as rs_split_run_ratio from z group by {K}""",
    "c1_cancel": TICKS
    + f""", x as (select *, epoch_us(ts) as us from t),
y as (select *, last_value(case when act='order' then us end ignore nulls) over (partition by symbol, side order by ts, id rows between unbounded preceding and 1 preceding) as last_order,
  case when act='cancel' then us - lag(us) over (partition by {K}, act order by ts, id) end as gap from x)
select {K}, count(*) filter (act='cancel') as cb_cancel_order_count, {DIV(a="count(*) filter (act='cancel')", b="count(*) filter (act='order')")} as cb_cancel_order_ratio,
  {share('qty', "act='cancel'", SUM(v='qty', c="act='order'"))} as cb_cancel_volume_ratio, {share('amt', "act='cancel'", SUM(v='amt', c="act='order'"))} as cb_cancel_amount_ratio,
  {DIV(a="count(*) filter (act='cancel' and us - last_order < 1800000000)", b="count(*) filter (act='cancel')")} as cb_fast_cancel_ratio, {DIV(a='stddev_samp(gap)', b='avg(gap)')} as cb_cancel_interval_cv,
  {DIV(a="count(*) filter (act='cancel' and side='buy')", b="count(*) filter (act='order' and side='buy')")} as cb_buy_cancel_ratio,
  {DIV(a="count(*) filter (act='cancel' and side='sell')", b="count(*) filter (act='order' and side='sell')")} as cb_sell_cancel_ratio from y group by {K}""",
    "c1_active": TICKS
    + f""", d as (select *, row_number() over {W6} - row_number() over (partition by {K}, side order by ts, id) as island from t where act='trade'),
r as (select *, count(*) over (partition by {K}, side, island) as run from d),
g as (select {K}, {SUM(v='amt', c="side='buy'")} as b, {SUM(v='amt', c="side='sell'")} as s, sum(amt) as a, {SUM(v='qty', c="side='buy'")} as bq, sum(qty) as q,
  coalesce(max(run) filter (side='buy'), 0) as ap_active_buy_run_max, coalesce(max(run) filter (side='sell'), 0) as ap_active_sell_run_max from r group by {K})
select {K}, {DIV(a='b', b='a')} as ap_active_buy_pct, {DIV(a='s', b='a')} as ap_active_sell_pct, {DIV(a='b - s', b='b + s')} as ap_active_net_direction, {DIV(a='abs(b - s)', b='b + s')} as ap_unilateral_intensity,
  case when (b - s) / nullif(b + s, 0) > 0.2 then 'buy' when (b - s) / nullif(b + s, 0) < -0.2 then 'sell' else 'none' end as ap_dominant_direction, {DIV(a='bq', b='q')} as ap_active_volume_pct,
  ap_active_buy_run_max, ap_active_sell_run_max from g""",
    "c1_quote_relative": TICKS
    + f""", m as (select *, last_value(case when act='order' and side='buy' then price end ignore nulls) over (partition by symbol order by ts, id rows between unbounded preceding and 1 preceding) as mid from t),
q as (select *, mid - 1 as bid, mid + 1 as ask from m where act='order' and mid is not null)
select {K}, {DIV(a="count(*) filter (side='buy' and abs(price-bid)<=0.5)", b="count(*) filter (side='buy')")} as obp_at_best_bid_ratio, {DIV(a="count(*) filter (side='buy' and abs(price-bid)<=5)", b="count(*) filter (side='buy')")} as obp_near_best_bid_ratio,
  count(*) filter (side='buy' and price>=ask) as obp_cross_spread_buy, {R("avg(bid-price) filter (side='buy')")} as obp_avg_bid_offset,
  {DIV(a="count(*) filter (side='sell' and abs(price-ask)<=0.5)", b="count(*) filter (side='sell')")} as obp_at_best_ask_ratio, {DIV(a="count(*) filter (side='sell' and abs(price-ask)<=5)", b="count(*) filter (side='sell')")} as obp_near_best_ask_ratio,
  count(*) filter (side='sell' and price<=bid) as obp_cross_spread_sell, {R("avg(price-ask) filter (side='sell')")} as obp_avg_ask_offset from q group by {K}""",
    "c1_distribution": TICKS
    + f""", o as (select * from t where act='order'), p as (select date, symbol, quantile_cont(amt, [0.25, 0.5, 0.75]) as p from o group by all),
oq as (select o.*, case when amt <= p[1] then 1 when amt <= p[2] then 2 when amt <= p[3] then 3 else 4 end as q, ts < window_start + interval '30 minutes' as fast from o join p using (date, symbol)),
a0 as (select {K}, {SUM(v='qty', c="side='buy'")} as b, {SUM(v='qty', c="side='sell'")} as s, {SUM(v='qty', c="side='buy' and fast")} as fb, {SUM(v='qty', c="side='sell' and fast")} as fs,
  count(*) filter (q=2) as n2, count(*) as n, stddev_samp(amt) filter (q=3) as sd, avg(amt) filter (q=3) as av, count(*) filter (q=3) as n3, count(*) filter (q=4 and side='buy') as n4b, count(*) filter (q=4 and side='sell') as n4s, count(*) filter (q=4) as n4 from oq group by {K}),
a as (select {K}, {DIV(a='b - s', b='b + s')} as "pd_Q1_ratio", {DIV(a='fb - fs', b='fb + fs')} as "pd_Q1_fast_ratio", {DIV(a='n2', b='n')} as "pd_Q2_ratio", n2 as "pd_Q2_order_count", {DIV(a='sd', b='av')} as "pd_Q3_cv", n3 as "pd_Q3_order_count",
  {DIV(a='n4b', b='n4')} as "pd_Q4_bid_ratio", {DIV(a='n4s', b='n4')} as "pd_Q4_ask_ratio" from a0),
m as (select *, last_value(case when act='order' and side='buy' then price end ignore nulls) over (partition by symbol order by ts, id rows between unbounded preceding and 1 preceding) as mid from t),
dd as (select *, mid - 1 as bid, mid + 1 as ask from m where act='trade'), h as (select date, symbol, quantile_cont(amt, [0.5, 0.8, 0.99]) as h from dd group by all), d as (select * from dd join h using (date, symbol)),
b0 as (select {K}, {SUM(v='amt', c='amt >= h[2]')} as big, max(price) - min(price) as spread, arg_min(price, (ts, id)) as f, arg_max(price, (ts, id)) as l, avg(price) filter (amt >= h[2]) as mp, max(h[1]) as h1, max(h[2]) as h2, max(h[3]) as h3,
  {SUM(v='amt', c="amt >= h[2] and side='buy'")} as hb, {SUM(v='amt', c="amt >= h[2] and side='sell'")} as hs, count(*) filter (side='buy' and price>=ask) as cb, count(*) filter (side='sell' and price<=bid) as cs, {SUM(v='amt', c='price>=ask or price<=bid')} as ca from d group by {K}),
b as (select {K}, round(big, 6) as "pd_Q5_deal_amount", {DIV(a='spread', b='f')} as "pd_Q5_impact", round(mp, 6) as "pd_Q5_mean_price", round(h1, 6) as "pd_Q5_effective_threshold", round(h2, 6) as "pd_Q5_large_threshold", {DIV(a='hb', b='hb + hs')} as "pd_H1_buy_pct",
  {DIV(a='hs', b='hb + hs')} as "pd_H1_sell_pct", {DIV(a='abs(hb - hs)', b='hb + hs')} as "pd_H1_uni", round(hb + hs, 6) as "pd_H1_deal_amount", round(h3, 6) as "pd_H1_mega_threshold", round(l / nullif(f, 0) - 1, 6) as "pd_H2_price_chg", cb as "pd_H3_cross_buy", cs as "pd_H3_cross_sell", round(ca, 6) as "pd_H3_deal_amount", round(h3, 6) as "pd_H3_mega_threshold" from b0)
select * from a full join b using ({K})""",
    "c1_price_impact": TICKS
    + f""", d as (select *, abs(price / nullif(lag(price) over {W6}, 0) - 1) as move from t where act='trade'),
b5 as (select {K}, time_bucket(interval '5 minutes', ts) as b, sum(amt) as a from d group by all), h5 as (select {K}, {DIV(a='sum(a*a)', b='sum(a)*sum(a)')} as pi_herfindahl_5min from b5 group by {K}),
b30 as (select {K}, time_bucket(interval '30 minutes', ts) as b, sum(amt) as a from d group by all), h30 as (select {K}, {DIV(a='sum(a*a)', b='sum(a)*sum(a)')} as pi_herfindahl_30min, {DIV(a='max(a)', b='avg(a)')} as pi_peak_amount_ratio from b30 group by {K}),
x as (select {K}, round(max(move) * 100, 6) as pi_max_price_impact_pct, round(stddev_samp(price) / nullif(avg(price), 0) * 100, 6) as pi_price_std_pct, round(avg(price) / nullif(sum(amt) / nullif(sum(qty), 0), 0) - 1, 6) as pi_vwap_deviation,
  {share('amt', "ts < window_start + interval '30 minutes'", 'sum(amt)')} as pi_open_30min_amount_pct, {share('amt', "ts >= window_end - interval '10 minutes'", 'sum(amt)')} as pi_close_10min_amount_pct from d group by {K})
select * from x join h5 using ({K}) join h30 using ({K})""",
}


# ---- labels and scores ----


def daily(spark, d):
    """Per day and symbol the label of the largest amount (ties by name) with its share."""
    return scores.dominant(t(spark, d).withColumn("label", F.concat_ws("_", "act", "side")), ["date", "symbol"], "label", "amt")


def label_pairs(spark, d):
    """Dominant label of a day against the day's before: a prediction and its truth."""
    w = W.partitionBy("symbol").orderBy("date")
    return daily(spark, d).withColumn("pred", F.lag("label").over(w)).where("pred is not null").select("date", "symbol", "pred", F.col("label").alias("truth"))


def two_samples(spark, d):
    v = t(spark, d).where("side='buy'").select("symbol", F.col("act").alias("g"), F.col("price").alias("v"))
    return v.where("g in ('order', 'trade')")


DAILY = TICKS + """, l as (select date, symbol, act || '_' || side as label, sum(amt) as a from t group by all),
dd as (select date, symbol, label, a, row_number() over (partition by date, symbol order by a desc, label) as r, sum(a) over (partition by date, symbol) as total from l),
dm as (select date, symbol, label, round(a / nullif(total, 0), 6) as confidence from dd where r = 1)"""
PAIRS = DAILY + ", pr as (select * from (select date, symbol, lag(label) over (partition by symbol order by date) as pred, label as truth from dm) where pred is not null)"
F1 = """, c as (select truth as label, count(*) as n from pr group by 1), p as (select pred as label, count(*) as n from pr group by 1), h as (select truth as label, count(*) as n from pr where pred = truth group by 1),
f as (select c.label, c.n as support, coalesce(2.0 * h.n / (c.n + coalesce(p.n, 0)), 0) as f1 from c left join p using (label) left join h using (label))"""

QUERIES |= {
    "c1_daily_dominant": daily,
    "c1_weighted_f1": lambda s, d: scores.weighted_f1(label_pairs(s, d), "pred", "truth"),
    "c1_f1_by_label": lambda s, d: scores.f1_by_label(label_pairs(s, d), "pred", "truth"),
    "c1_wasserstein": lambda s, d: scores.wasserstein(two_samples(s, d), ["symbol"], "g", "v", "order", "trade"),
    "c1_composite_score": lambda s, d: scores.composite(label_pairs(s, d)),
    "c1_moving_score": lambda s, d: scores.moving(label_pairs(s, d), table(s, d, "events")),
    "c1_eligible": lambda s, d: scores.eligible(label_pairs(s, d)),
    "c1_output_pattern": lambda s, d: daily(s, d).select(F.col("symbol").alias("stock_code"), F.col("date").alias("transaction_date"), F.col("label").alias("pattern_type"), F.col("confidence").cast("string").alias("pattern_explanation")),
    "c1_output_capital": lambda s, d: daily(s, d).select(F.col("symbol").alias("stock_code"), F.col("date").alias("transaction_date"), F.split("label", "_")[0].alias("capital_type"), F.split("label", "_")[1].alias("capital_intention")),
    "c1_dtw": lambda s, d: scores.dtw(ticks.core(t(s, d)).select("symbol", "window_start", F.col("deal_amount").alias("v")), "symbol", "window_start", "v"),
    "c1_kmeans_patterns": lambda s, d: scores.patterns(ticks.active(t(s, d)).join(ticks.core(t(s, d)), ticks.KEY)),
    "c1_asof_quote": lambda s, d: ticks.asof(t(s, d).where("act='trade'").select("symbol", "ts", "id", "price"), t(s, d).where("act='order'").groupBy("symbol", "ts").agg(F.max("price").alias("quote")), ["symbol"], "ts", "quote", F.to_date("ts")),
    "c1_pattern_separation": lambda s, d: scores.separation(scores.clustered(ticks.active(t(s, d)).join(ticks.core(t(s, d)), ticks.KEY))),
    "c1_label_separation": lambda s, d: scores.separation(t(s, d).where("price is not null and qty is not null").select(F.concat_ws("_", "act", "side").alias("pattern"), F.array("price", F.col("qty").cast("double")).alias("x"))),
}
ORACLE |= {
    "c1_daily_dominant": DAILY + " select * from dm",
    "c1_weighted_f1": PAIRS + F1 + " select round(sum(f1 * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as n from f",
    "c1_f1_by_label": PAIRS + F1 + " select label, support, round(f1, 6) as f1 from f",
    "c1_wasserstein": TICKS
    + """, v as (select symbol, price as x, count(*) filter (act = 'order') as o, count(*) filter (act = 'trade') as d from t where side = 'buy' and act in ('order', 'trade') and price is not null group by all),
c as (select symbol, x, sum(o) over w as co, sum(d) over w as cd, sum(o) over (partition by symbol) as no, sum(d) over (partition by symbol) as nd, lead(x) over w as nx from v window w as (partition by symbol order by x))
select symbol, round(sum(coalesce(abs(co / no - cd / nd) * (nx - x), 0)), 6) as wasserstein from c where no > 0 and nd > 0 group by symbol""",
    "c1_composite_score": PAIRS + " select symbol, round(0.4 * avg((split_part(pred, '_', 1) = split_part(truth, '_', 1))::int) + 0.6 * avg((split_part(pred, '_', 2) = split_part(truth, '_', 2))::int), 6) as score from pr group by symbol",
    "c1_moving_score": PAIRS
    + """, cal as (select distinct ts::date as date from events where ts is not null), sy as (select distinct symbol from pr), ds as (select symbol, date, avg((pred = truth)::int) as s from pr group by all),
g as (select symbol, date, coalesce(s, 0) as s from cal cross join sy left join ds using (symbol, date))
select symbol, date, round((3 * s + 2 * coalesce(lag(s) over w, 0) + coalesce(lag(s, 2) over w, 0)) / 6.0, 6) as moving from g window w as (partition by symbol order by date)""",
    "c1_eligible": PAIRS + " select symbol, count(distinct date) as n_days from pr group by symbol having count(distinct date) >= 8",
    "c1_output_pattern": DAILY + " select symbol as stock_code, date as transaction_date, label as pattern_type, confidence::varchar as pattern_explanation from dm",
    "c1_output_capital": DAILY + " select symbol as stock_code, date as transaction_date, split_part(label, '_', 1) as capital_type, split_part(label, '_', 2) as capital_intention from dm",
    "c1_label_separation": TICKS + """, x as (select act || '_' || side as p, price as a, qty::double as b from t where price is not null and qty is not null), c as (select p, avg(a) as ma, avg(b) as mb, count(*) as n from x group by p), z as (select sum(ma * n) / sum(n) as ta, sum(mb * n) / sum(n) as tb from c),
w as (select count(*) as n, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2)) as w from x join c using (p)), bt as (select sum(sqrt((ma - ta) ** 2 + (mb - tb) ** 2) * n) / sum(n) as b from c, z) select w.n as n, round(w, 6) as within, round(b, 6) as between_, round(b / (b + w), 6) as score from w, bt""".replace(" as between_", ' as "between"'),
    "c1_asof_quote": TICKS + ", q as (select symbol, ts, max(price) as quote from t where act='order' group by all) select a.symbol, a.ts, a.id, a.price, q.quote from (select * from t where act='trade') a asof left join q on a.symbol = q.symbol and a.ts >= q.ts",
}
