"""Event-window features keyed by date, symbol and window.

The field list names quantities without formulas; the definitions here are ours, each stated in its function. A tick has
symbol, ts, id, act (order, trade, cancel), side (buy, sell), price, qty and amt = price * qty.

Rows with a null symbol or ts are left out; null amounts count as absent in sums; ratios with a zero or null denominator are null. Every
function shuffles once by (symbol, window) or (symbol, date); windows bound the groups, so a hot symbol is spread over its windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["date", "symbol", "window_start", "window_end"]


def r6(c):
    """Six decimals: sums in another order then agree."""
    return F.round(c, 6)


def ratio(a, b):
    return F.when(b != 0, a / b)


def ticks(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Ticks of the event table: view and click are orders, purchase and signup trades, error a cancel."""
    e = events.where("ts is not null and user_id is not null").withColumn("qty", F.get_json_object("props", "$.k").cast("int"))
    act = F.when(F.col("event_type").isin("view", "click"), "order").when(F.col("event_type").isin("purchase", "signup"), "trade").otherwise("cancel")
    side = F.when(F.col("event_type").isin("view", "purchase"), "buy").when(F.col("event_type").isin("click", "signup"), "sell").otherwise(F.when(F.col("qty") % 2 == 0, "buy").otherwise("sell"))
    w = F.window("ts", width)
    return e.select(F.to_date("ts").alias("date"), (F.col("user_id") % 5).alias("symbol"), w.start.alias("window_start"), w.end.alias("window_end"), "ts", F.col("event_id").alias("id"), act.alias("act"), side.alias("side"), F.col("value").alias("price"), "qty", (F.col("value") * F.col("qty")).alias("amt"))


def n(cond: str):
    return F.count_if(F.expr(cond))


def total(col: str, cond: str):
    return F.coalesce(F.sum(F.expr(f"case when {cond} then {col} end")), F.lit(0.0))


def carried(df: DataFrame, by: list[str], bucket: str, order: list[str], value, out: str, own: bool = False) -> DataFrame:
    """`df` with the last non-null `value` of the rows before (with `own` also the row's) of its keys, in order.

    Rows are looked at within buckets of time (`bucket`, rising with the order); what earlier buckets end with is carried over one row a bucket, so a hot key is spread
    over its buckets.
    """
    w = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    ends = df.select(*by, bucket, *order, value.alias("_v")).groupBy(*by, bucket).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    carry = ends.select(*[F.col(c).alias("_k" + c) for c in by], F.col(bucket).alias("_b"), before.alias("_carry"))
    x = df.withColumn("_v", value).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    on = F.col(bucket) == F.col("_b")
    for c in by:
        on = on & (F.col(c) == F.col("_k" + c))
    return x.join(carry, on, "left").withColumn(out, F.coalesce(out, "_carry")).drop("_v", "_b", "_carry", *["_k" + c for c in by])


def core(t: DataFrame) -> DataFrame:
    """Counts and amounts of a window and its exact bounds; total_deal_amount_all is the day's."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    g = t.groupBy(*KEY).agg(
        F.first(stamp("window_start")).alias("window_start_dt"), F.first(stamp("window_end")).alias("window_end_dt"),
        n("act='order'").alias("order_count"), n("act in ('order','cancel')").alias("order_count_all"), n("act='cancel'").alias("cancel_count_all"), n("act='trade'").alias("deal_count"),
        total("amt", "act='trade'").alias("deal_amount"), total("amt", "act='trade' and side='buy'").alias("signal_deal_buy_amount"), total("amt", "act='trade' and side='sell'").alias("signal_deal_sell_amount"),
    )
    day = F.sum("deal_amount").over(W.partitionBy("date", "symbol"))
    return g.withColumn("total_deal_amount_all", r6(day)).withColumns({c: r6(F.col(c)) for c in ("deal_amount", "signal_deal_buy_amount", "signal_deal_sell_amount")})


def size_buckets(t: DataFrame) -> DataFrame:
    """Trades with their size bucket: by the day's 50th, 80th and 95th percentile of trade amounts."""
    d = t.where("act='trade'")
    p = d.groupBy("date", "symbol").agg(F.expr("percentile(amt, array(0.5, 0.8, 0.95))").alias("p"))
    bucket = F.when(F.col("amt") > F.col("p")[2], "mega").when(F.col("amt") > F.col("p")[1], "large").when(F.col("amt") > F.col("p")[0], "medium").otherwise("small")
    return d.join(p, ["date", "symbol"]).withColumn("bucket", bucket)


def order_size(t: DataFrame) -> DataFrame:
    """Shares of the size buckets in trade amount and count; hot money is a mega trade within 10 minutes of the trade before."""
    b = size_buckets(t).withColumn("gap", F.expr("unix_micros(cast(ts as timestamp))") - F.lag(F.expr("unix_micros(cast(ts as timestamp))")).over(W.partitionBy("date", "symbol").orderBy("ts", "id")))
    amt, cnt = F.sum("amt"), F.count("*")
    cols = []
    for x in ("mega", "large", "medium", "small"):
        cols += [r6(ratio(total("amt", f"bucket='{x}'"), amt)).alias(f"oss_{x}_amount_pct"), r6(ratio(n(f"bucket='{x}'"), cnt)).alias(f"oss_{x}_count_pct")]
    return b.groupBy(*KEY).agg(
        *cols, r6(ratio(n("bucket='mega' and gap < 600000000"), cnt)).alias("oss_hot_money_count_pct"), r6(ratio(total("amt", "side='buy'"), amt)).alias("oss_buy_amount_pct"),
        r6(ratio(total("amt", "side='sell'"), amt)).alias("oss_sell_amount_pct"), r6(ratio(total("amt", "bucket='mega' and side='buy'"), total("amt", "bucket='mega'"))).alias("oss_mega_buy_pct"),
    )


def rhythm(t: DataFrame) -> DataFrame:
    """Gaps between a window's events in ms; a burst is a gap below a tenth of the mean; similar sizes differ by at most a tenth from the row before, a run has three or more."""
    ms = F.expr("cast(unix_micros(cast(ts as timestamp)) as double) / 1000")
    w = W.partitionBy(*KEY).orderBy("ts", "id")
    x = t.withColumn("ms", ms).withColumn("gap", F.col("ms") - F.lag("ms").over(w))
    x = x.withColumn("side_gap", F.col("ms") - F.lag("ms").over(W.partitionBy(*KEY, "side").orderBy("ts", "id")))
    before = F.lag("qty").over(w)
    x = x.withColumn("similar", F.when(before > 0, (F.abs(F.col("qty") / before - 1) <= 0.1).cast("int")))
    x = x.withColumn("island", F.sum(F.when(F.col("similar") == 1, 0).otherwise(1)).over(w)).withColumn("run", F.count("*").over(W.partitionBy(*KEY, "island")))
    x = x.withColumn("mean_gap", F.avg("gap").over(W.partitionBy(*KEY)))
    return x.groupBy(*KEY).agg(
        r6(F.avg("gap")).alias("rs_interval_mean_ms"), r6(F.expr("percentile(gap, 0.5)")).alias("rs_interval_median_ms"), r6(ratio(F.stddev_samp("gap"), F.avg("gap"))).alias("rs_interval_cv"),
        r6(ratio(n("gap < 0.1 * mean_gap"), F.count("gap"))).alias("rs_burst_ratio"),
        r6(ratio(F.stddev_samp(F.expr("case when side='buy' then side_gap end")), F.avg(F.expr("case when side='buy' then side_gap end")))).alias("rs_buy_interval_cv"),
        r6(ratio(F.stddev_samp(F.expr("case when side='sell' then side_gap end")), F.avg(F.expr("case when side='sell' then side_gap end")))).alias("rs_sell_interval_cv"),
        r6(ratio(F.sum("similar"), F.count("similar"))).alias("rs_split_similarity"), r6(ratio(n("run >= 3"), F.count("*"))).alias("rs_split_run_ratio"),
    )


def cancels(t: DataFrame) -> DataFrame:
    """Cancel behaviour; a fast cancel follows the last order of its symbol and side within 30 minutes (as-of)."""
    us = F.expr("unix_micros(cast(ts as timestamp))")
    x = carried(t.withColumn("us", us), ["symbol", "side"], "window_start", ["ts", "id"], F.expr("case when act='order' then us end"), "last_order")
    x = x.withColumn("gap", F.expr("case when act='cancel' then us end") - F.lag("us").over(W.partitionBy(*KEY, "act").orderBy("ts", "id")))
    return x.groupBy(*KEY).agg(
        n("act='cancel'").alias("cb_cancel_order_count"), r6(ratio(n("act='cancel'"), n("act='order'"))).alias("cb_cancel_order_ratio"),
        r6(ratio(total("qty", "act='cancel'"), total("qty", "act='order'"))).alias("cb_cancel_volume_ratio"), r6(ratio(total("amt", "act='cancel'"), total("amt", "act='order'"))).alias("cb_cancel_amount_ratio"),
        r6(ratio(n("act='cancel' and us - last_order < 1800000000"), n("act='cancel'"))).alias("cb_fast_cancel_ratio"), r6(ratio(F.stddev_samp("gap"), F.avg("gap"))).alias("cb_cancel_interval_cv"),
        r6(ratio(n("act='cancel' and side='buy'"), n("act='order' and side='buy'"))).alias("cb_buy_cancel_ratio"), r6(ratio(n("act='cancel' and side='sell'"), n("act='order' and side='sell'"))).alias("cb_sell_cancel_ratio"),
    )


def active(t: DataFrame) -> DataFrame:
    """Active side of the trades; dominant beyond +-0.2; runs of one side by gaps and islands."""
    d = t.where("act='trade'")
    w = W.partitionBy(*KEY).orderBy("ts", "id")
    d = d.withColumn("island", F.row_number().over(w) - F.row_number().over(W.partitionBy(*KEY, "side").orderBy("ts", "id")))
    d = d.withColumn("run", F.count("*").over(W.partitionBy(*KEY, "side", "island")))
    buy, sell, all_ = total("amt", "side='buy'"), total("amt", "side='sell'"), F.sum("amt")
    net = ratio(buy - sell, buy + sell)
    return d.groupBy(*KEY).agg(
        r6(ratio(buy, all_)).alias("ap_active_buy_pct"), r6(ratio(sell, all_)).alias("ap_active_sell_pct"), r6(net).alias("ap_active_net_direction"), r6(F.abs(net)).alias("ap_unilateral_intensity"),
        F.when(net > 0.2, "buy").when(net < -0.2, "sell").otherwise("none").alias("ap_dominant_direction"), r6(ratio(total("qty", "side='buy'"), F.sum("qty"))).alias("ap_active_volume_pct"),
        F.coalesce(F.max(F.expr("case when side='buy' then run end")), F.lit(0)).alias("ap_active_buy_run_max"), F.coalesce(F.max(F.expr("case when side='sell' then run end")), F.lit(0)).alias("ap_active_sell_run_max"),
    )


def quoted(t: DataFrame) -> DataFrame:
    """Ticks with the quote in force: the last buy order's price -+ 1 of the symbol, an as-of join by windows (no theta join)."""
    x = carried(t, ["symbol"], "window_start", ["ts", "id"], F.expr("case when act='order' and side='buy' then price end"), "mid")
    return x.withColumn("bid", F.col("mid") - 1).withColumn("ask", F.col("mid") + 1).drop("mid")


def quotes(t: DataFrame) -> DataFrame:
    """Orders against the quote: at the best within 0.5, near within 5, crossing at or beyond the other side."""
    q = quoted(t).where("act='order' and bid is not null")
    buys, sells = n("side='buy'"), n("side='sell'")
    return q.groupBy(*KEY).agg(
        r6(ratio(n("side='buy' and abs(price-bid)<=0.5"), buys)).alias("obp_at_best_bid_ratio"), r6(ratio(n("side='buy' and abs(price-bid)<=5"), buys)).alias("obp_near_best_bid_ratio"),
        n("side='buy' and price>=ask").alias("obp_cross_spread_buy"), r6(F.avg(F.expr("case when side='buy' then bid-price end"))).alias("obp_avg_bid_offset"),
        r6(ratio(n("side='sell' and abs(price-ask)<=0.5"), sells)).alias("obp_at_best_ask_ratio"), r6(ratio(n("side='sell' and abs(price-ask)<=5"), sells)).alias("obp_near_best_ask_ratio"),
        n("side='sell' and price<=bid").alias("obp_cross_spread_sell"), r6(F.avg(F.expr("case when side='sell' then price-ask end"))).alias("obp_avg_ask_offset"),
    )


def distribution(t: DataFrame) -> DataFrame:
    """Q1: buy against sell quantity of orders, also of the half hour that opens the window; Q2-Q4: orders by the day's quartiles of amount; Q5, H1-H3: trades by the day's thresholds."""
    o = t.where("act='order'")
    p = o.groupBy("date", "symbol").agg(F.expr("percentile(amt, array(0.25, 0.5, 0.75))").alias("p"))
    o = o.join(p, ["date", "symbol"]).withColumn("q", F.expr("case when amt <= p[0] then 1 when amt <= p[1] then 2 when amt <= p[2] then 3 else 4 end"))
    fast = "ts < window_start + interval 30 minutes"
    buy, sell = total("qty", "side='buy'"), total("qty", "side='sell'")
    fb, fs = total("qty", f"side='buy' and {fast}"), total("qty", f"side='sell' and {fast}")
    q3 = F.expr("case when q=3 then amt end")
    a = o.groupBy(*KEY).agg(
        r6(ratio(buy - sell, buy + sell)).alias("pd_Q1_ratio"), r6(ratio(fb - fs, fb + fs)).alias("pd_Q1_fast_ratio"), r6(ratio(n("q=2"), F.count("*"))).alias("pd_Q2_ratio"), n("q=2").alias("pd_Q2_order_count"),
        r6(ratio(F.stddev_samp(q3), F.avg(q3))).alias("pd_Q3_cv"), n("q=3").alias("pd_Q3_order_count"), r6(ratio(n("q=4 and side='buy'"), n("q=4"))).alias("pd_Q4_bid_ratio"), r6(ratio(n("q=4 and side='sell'"), n("q=4"))).alias("pd_Q4_ask_ratio"),
    )
    d = quoted(t).where("act='trade'")
    th = d.groupBy("date", "symbol").agg(F.expr("percentile(amt, array(0.5, 0.8, 0.99))").alias("h"))
    d = d.join(th, ["date", "symbol"])
    big = "amt >= h[1]"
    first, last = F.min_by("price", F.struct("ts", "id")), F.max_by("price", F.struct("ts", "id"))
    hb, hs = total("amt", f"{big} and side='buy'"), total("amt", f"{big} and side='sell'")
    b = d.groupBy(*KEY).agg(
        r6(total("amt", big)).alias("pd_Q5_deal_amount"), r6(ratio(F.max("price") - F.min("price"), first)).alias("pd_Q5_impact"), r6(F.avg(F.expr(f"case when {big} then price end"))).alias("pd_Q5_mean_price"),
        r6(F.max(F.expr("h[0]"))).alias("pd_Q5_effective_threshold"), r6(F.max(F.expr("h[1]"))).alias("pd_Q5_large_threshold"), r6(ratio(hb, hb + hs)).alias("pd_H1_buy_pct"), r6(ratio(hs, hb + hs)).alias("pd_H1_sell_pct"),
        r6(ratio(F.abs(hb - hs), hb + hs)).alias("pd_H1_uni"), r6(hb + hs).alias("pd_H1_deal_amount"), r6(F.max(F.expr("h[2]"))).alias("pd_H1_mega_threshold"), r6(ratio(last, first) - 1).alias("pd_H2_price_chg"),
        n("side='buy' and price>=ask").alias("pd_H3_cross_buy"), n("side='sell' and price<=bid").alias("pd_H3_cross_sell"), r6(total("amt", "price>=ask or price<=bid")).alias("pd_H3_deal_amount"), r6(F.max(F.expr("h[2]"))).alias("pd_H3_mega_threshold"),
    )
    return a.join(b, KEY, "full_outer")


def impact(t: DataFrame) -> DataFrame:
    """Price moves between trades, concentration of amounts over 5- and 30-minute buckets, and the shares of the first 30 and last 10 minutes."""
    d = t.where("act='trade'")
    w = W.partitionBy(*KEY).orderBy("ts", "id")
    d = d.withColumn("move", F.abs(ratio(F.col("price"), F.lag("price").over(w)) - 1))
    def herfindahl(minutes, name):
        b = d.groupBy(*KEY, F.window("ts", f"{minutes} minutes").start.alias("b")).agg(F.sum("amt").alias("a"))
        return b.groupBy(*KEY).agg(r6(ratio(F.sum(F.col("a") * F.col("a")), F.sum("a") * F.sum("a"))).alias(name), r6(ratio(F.max("a"), F.avg("a"))).alias("peak_" + name))
    h5, h30 = herfindahl(5, "pi_herfindahl_5min"), herfindahl(30, "pi_herfindahl_30min")
    x = d.groupBy(*KEY).agg(
        r6(F.max("move") * 100).alias("pi_max_price_impact_pct"), r6(ratio(F.stddev_samp("price"), F.avg("price")) * 100).alias("pi_price_std_pct"), r6(ratio(F.avg("price"), ratio(F.sum("amt"), F.sum("qty"))) - 1).alias("pi_vwap_deviation"),
        r6(ratio(total("amt", "ts < window_start + interval 30 minutes"), F.sum("amt"))).alias("pi_open_30min_amount_pct"), r6(ratio(total("amt", "ts >= window_end - interval 10 minutes"), F.sum("amt"))).alias("pi_close_10min_amount_pct"),
    )
    return x.join(h5.drop("peak_pi_herfindahl_5min"), KEY).join(h30.withColumnRenamed("peak_pi_herfindahl_30min", "pi_peak_amount_ratio"), KEY)


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, bucket=None) -> DataFrame:
    """Each left row with the last `value` of right at or before it: union and last value, one shuffle by the keys.

    `bucket` (a column rising with `on`, such as its day) spreads a hot key over its buckets.
    """
    a = left.withColumn("_r", F.lit(1)).withColumn("_q", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, on, F.col(value).alias("_q")).withColumn("_r", F.lit(0))
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_t", F.lit(0) if bucket is None else bucket)
    return carried(u, by, "_t", [on, "_r"], F.col("_q"), value, own=True).where("_r = 1").drop("_r", "_q", "_t")
