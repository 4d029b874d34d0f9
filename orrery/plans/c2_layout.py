"""Queries over profiles, intervals, headings and grids."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import sequences as q
from orrery.plans import c2_text
from orrery.tables import table


def pixels(s, d):
    """Images of 50 rows: a row per embedding, ink where a value is above 0."""
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select(F.floor(F.col("vec_id") / 50).alias("img"), (F.col("vec_id") % 50).alias("y"), "x", (F.col("v") > 0).cast("int").alias("ink"))


def profile(s, d):
    return pixels(s, d).groupBy("img", "x").agg(F.avg("ink").alias("v"))


def rows(s, d):
    return pixels(s, d).groupBy("img", "y").agg(F.sum("ink").alias("ink"))


def spans(s, d):
    """Intervals from tables' line items: ship day of the year over the quantity's days, per supplier."""
    l = table(s, d, "lineitem")
    return l.select(F.col("l_suppkey").alias("k"), F.dayofyear("l_shipdate").alias("start"), (F.dayofyear("l_shipdate") + F.col("l_quantity").cast("int") % 5).alias("end"))


def headings(s, d):
    """Numbered lines from chunks: every third a heading; kinds and levels from seq."""
    c = table(s, d, "doc_chunks").groupBy("doc_id", "seq").agg(F.min("text").alias("text"))
    h = (F.col("seq") * 7 + F.length("doc_id")) % 3 == 0
    return c.select("doc_id", F.col("seq").alias("line_no"), (F.col("seq") % 2 + 1).alias("level"), F.when(F.col("seq") % 5 < 3, "int").otherwise("par").alias("kind"), (F.col("seq") % 17 + F.floor(F.col("seq") / 17)).cast("int").alias("num"), h.alias("is_heading"), F.substring("text", 1, 40).alias("text"))


def tiles(s, d):
    """Parts as the cells of tiles, some tiles narrower or higher than the rest."""
    p = table(s, d, "part")
    k = F.col("p_partkey")
    t = p.select(F.floor(k / 240).alias("img"), F.floor(k % 240 / 60).alias("tr"), F.floor(k % 60 / 20).alias("tc"), F.floor(k % 20 / 5).alias("r"), (k % 5).alias("c"), F.col("p_brand").alias("cell"))
    return t.where("not (tr = 1 and tc = 1 and c = 4) and not (tr = 2 and tc = 0 and r > 2)")


def doubled(s, d):
    """Tables beside themselves, with the column numbers in their third row."""
    c = c2_text.cells(s, d)
    return q.side_by_side(c, c).withColumn("cell", F.when(F.col("r") == 2, (F.col("c") + 1).cast("string")).otherwise(F.col("cell")))


def cuts(s, d):
    return pixels(s, d).select("img").distinct().withColumn("cut", F.explode(F.array(F.lit(16), F.lit(32), F.lit(48))))


def html(s, d):
    return q.to_html(c2_text.cells(s, d))


QUERIES = {
    "wn_islands": lambda s, d: q.islands(pixels(s, d).where("ink = 1").select("img", "y", "x"), ["img", "y"], "x", 2),
    "wn_longest_runs": lambda s, d: q.longest_runs(pixels(s, d).where("ink = 1"), ["img"], "x", "y", 5),
    "wn_gap_centres": lambda s, d: q.gap_centres(profile(s, d), ["img"], "x", "v", 0.46),
    "wn_row_profile": rows,
    "wn_boundaries": lambda s, d: q.longest_runs(pixels(s, d).where("ink = 1"), ["img"], "x", "y", 5).groupBy("img").agg(F.collect_list("centre").alias("c")).select("img", F.array_join(F.transform(q.boundaries(F.col("c"), F.lit(64)), lambda x: x.cast("int").cast("string")), ",").alias("bounds")),
    "wn_even_chunks": lambda s, d: table(s, d, "orders").groupBy("o_custkey").count().select("o_custkey", F.explode(q.even_chunks(F.col("count"), 4)).alias("b")).select("o_custkey", "b.start", "b.size"),
    "wn_nearest_gap": lambda s, d: q.nearest_gap(profile(s, d).withColumn("v", F.floor(F.col("v") * 2.2)), cuts(s, d).withColumnRenamed("cut", "target"), ["img"], "x", "v", 8),
    "wn_snap": lambda s, d: q.snap(pixels(s, d).groupBy("img", "x").agg(F.sum("ink").alias("v")), cuts(s, d), ["img"], "x", "v", 6),
    "wn_interval_union": lambda s, d: q.union_intervals(spans(s, d), ["k"]),
    "wn_points_in_bands": lambda s, d: q.points_in(table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.dayofyear("l_shipdate").alias("p")).distinct(), q.union_intervals(spans(s, d).where("end - start >= 3"), ["k"]), ["k"], "p"),
    "wn_demote_pseudo": lambda s, d: q.demote_pseudo(headings(s, d)).select("doc_id", "line_no", "is_heading"),
    "wn_title_prefix": lambda s, d: q.prefix(headings(s, d), F.col("is_heading") | ~F.col("text").rlike("[0-9]{4}年|[0-9]{4} ")).select("doc_id", "line_no"),
    "wn_fill_gaps": lambda s, d: q.fill_gaps(headings(s, d)),
    "wn_majority_chains": lambda s, d: q.majority_chains(headings(s, d)).select("doc_id", "line_no", "is_heading"),
    "wn_complete_sequence": lambda s, d: q.complete(headings(s, d).withColumn("v", F.when(F.col("is_heading"), F.col("num"))), ["doc_id"], "line_no", "v").select("doc_id", "line_no", "filled"),
    "wn_first_title": lambda s, d: table(s, d, "doc_blocks").where("type = 'heading' and coalesce(page, 0) <= 3").groupBy("doc_id").agg(F.min_by("text", "block_id").alias("title")),
    "wn_blocks": lambda s, d: c2_text.lines(s, d).withColumn("kind", F.when(F.col("line").startswith("|"), "table").when(F.col("line").rlike("^#{1,6} "), "head").when(F.trim("line") == "", "blank").otherwise("para")).groupBy("kind").agg(F.count("*").alias("n")),
    "wn_table_rows": lambda s, d: c2_text.cells(s, d).groupBy("table_id").agg(F.count_distinct("r").alias("n_rows")),
    "wn_column_number_rows": lambda s, d: q.column_number_rows(doubled(s, d)),
    "wn_mode_width": lambda s, d: q.mode_width(c2_text.cells(s, d)),
    "wn_banners": lambda s, d: q.banners(c2_text.cells(s, d).withColumn("cell", F.when((F.col("r") % 3 == 0) & (F.col("c") > 0), "").otherwise(F.col("cell")))),
    "gr_to_html": html,
    "gr_html_roundtrip": lambda s, d: q.from_html(html(s, d)),
    "gr_parse_html": lambda s, d: q.from_html(c2_text.tables(s, d).where(F.col("markdown").rlike("(?i)<table")).select("table_id", F.col("markdown").alias("html"))),
    "gr_reassemble": lambda s, d: q.reassemble(tiles(s, d)),
    "gr_panels": lambda s, d: q.panels(c2_text.cells(s, d), 2),
    "gr_side_by_side": lambda s, d: q.side_by_side(c2_text.cells(s, d), c2_text.cells(s, d).where("r > 2")),
    "gr_integral": lambda s, d: q.integral(pixels(s, d), ["img"], "y", "x", "ink").select("img", "y", "x", "integral"),
    "gr_number_formats": lambda s, d: q.number_format_votes(c2_text.cells(s, d)),
    "gr_tighten": lambda s, d: q.tighten(pixels(s, d).where("x between 5 and 50 and ink = 1"), ["img"]),
    "gr_dimensions": lambda s, d: c2_text.cells(s, d).groupBy("table_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols")),
}

PX = "with e as (select vec_id, unnest(range(64))::int as x, unnest(embedding) as v from embeddings), px as (select vec_id // 50 as img, vec_id % 50 as y, x, (v > 0)::int as ink from e), pf as (select img, x, avg(ink) as v from px group by all)"


def isl(name: str, src: str, by: str, pos: str, gap: int) -> str:
    return f""", {name}_0 as (select distinct {by}, {pos} as p from {src}), {name}_1 as (select *, case when p - lag(p) over (partition by {by} order by p) <= {gap} then 0 else 1 end as nw from {name}_0),
{name}_2 as (select *, sum(nw) over (partition by {by} order by p) as i from {name}_1), {name} as (select {by}, min(p) as start, max(p) as "end", count(*) as n from {name}_2 group by {by}, i)"""


RUNS = PX + isl("vr", "(select * from px where ink = 1)", "img, x", "y", 1) + ", lr as (select img, x, max(n) as run from vr group by all having max(n) >= 5)" + isl("lc", "lr", "img", "x", 1) + ', ce as (select img, (start + "end") / 2 as centre, n as width from lc)'
BD = RUNS + ", bo as (select img, list_sort(list_distinct(list_concat([0.0], list(centre::double), [64.0]))) as b from ce group by img)"
SP = """with sp as (select l_suppkey as k, dayofyear(l_shipdate) as start, dayofyear(l_shipdate) + trunc(l_quantity)::int % 5 as "end" from lineitem)"""


def uni(src: str) -> str:
    return f""", u1 as (select *, max("end") over (partition by k order by start, "end" rows between unbounded preceding and 1 preceding) as bf from {src}), u2 as (select *, sum(case when start <= bf then 0 else 1 end) over (partition by k order by start, "end" rows unbounded preceding) as i from u1),
un as (select k, min(start) as start, max("end") as "end", count(*) as n from u2 group by k, i)"""


HD = """with c as (select doc_id, seq, min(text) as text from doc_chunks group by all), h as (select doc_id, seq as line_no, seq % 2 + 1 as level, case when seq % 5 < 3 then 'int' else 'par' end as kind, (seq % 17 + seq // 17)::int as num, (seq * 7 + length(doc_id)) % 3 = 0 as is_heading, substring(text, 1, 40) as text from c)"""
TL = """with t as (select p_partkey // 240 as img, p_partkey % 240 // 60 as tr, p_partkey % 60 // 20 as tc, p_partkey % 20 // 5 as r, p_partkey % 5 as c, p_brand as cell from part), tl as (select * from t where not (tr = 1 and tc = 1 and c = 4) and not (tr = 2 and tc = 0 and r > 2))"""
C = c2_text.C
HT = C + """, hr as (select table_id, r, string_agg('<td>' || replace(replace(replace(cell, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>', '' order by c) as x from ce group by all), ht as (select table_id, '<table>' || string_agg('<tr>' || x || '</tr>', '' order by r) || '</table>' as html from hr group by table_id)"""
MW = ", rw_ as (select table_id, r, count(*) as width from {0} group by all), mw as (select table_id, arg_min(width, (-n, first)) as width from (select table_id, width, count(*) as n, min(r) as first from rw_ group by all) group by table_id)"
ORACLE = {
    "wn_islands": PX + isl("i", "(select * from px where ink = 1)", "img, y", "x", 2) + " select * from i",
    "wn_longest_runs": RUNS + " select * from ce",
    "wn_gap_centres": PX + isl("i", "(select * from pf where v <= 0.46)", "img", "x", 3) + ' select img, (start + "end") / 2 as centre, n from i',
    "wn_row_profile": PX + " select img, y, sum(ink)::bigint as ink from px group by all",
    "wn_boundaries": BD + " select img, array_to_string(list_transform(b, lambda x: trunc(x)::int), ',') as bounds from bo",
    "wn_even_chunks": "with n as (select o_custkey, count(*) as c from orders group by all), k as (select *, greatest(ceil(c / 4.0), 1)::int as k from n), x as (select *, unnest(range(k)) as i from k) select o_custkey, floor(i * c / k)::int as start, (floor((i + 1) * c / k) - floor(i * c / k))::int as size from x",
    "wn_nearest_gap": PX
    + ", w as (select img, x, floor(v * 2.2) as v from pf), t as (select distinct img, unnest([16, 32, 48]) as target from px), j as (select t.img, target, x, v from t join w on w.img = t.img and x between target - 8 and target + 8) select img, target, arg_min(x, (v != 0, v, case when v = 0 then abs(x - target) else 0 end, x)) as cut from j group by all",
    "wn_snap": PX + ", w as (select img, x, sum(ink) as v from px group by all), t as (select distinct img, unnest([16, 32, 48]) as cut from px) select distinct img, c as cut from (select t.img, t.cut, arg_min(x, (v, x)) as c from t join w on w.img = t.img and x between cut - 6 and cut + 6 group by all)",
    "wn_interval_union": SP + uni("sp") + " select * from un",
    "wn_points_in_bands": SP + uni('(select * from sp where "end" - start >= 3)') + ', p as (select distinct l_suppkey as k, dayofyear(l_shipdate) as p from lineitem) select p.k, p.p, un.start, un."end" from p join un on un.k = p.k and p.p between un.start and un."end"',
    "wn_demote_pseudo": HD + ", n as (select *, lead(case when is_heading then level end) over (partition by doc_id order by line_no) as nx from h) select doc_id, line_no, is_heading and not (regexp_matches(text, '[。；;，,.]$') and is_heading and not coalesce(nx > level, false)) as is_heading from n",
    "wn_title_prefix": HD + ", n as (select *, sum(case when is_heading or not regexp_matches(text, '[0-9]{4}年|[0-9]{4} ') then 0 else 1 end) over (partition by doc_id order by line_no) as st from h) select doc_id, line_no from n where st = 0",
    "wn_fill_gaps": HD
    + """, pr as (select *, lead(num) over w as to_num, lead(line_no) over w as to_line from h where is_heading window w as (partition by doc_id, level, kind order by line_no)),
wt as (select doc_id, kind, level, line_no as a, to_line as b, unnest(range(num + 1, to_num)) as num from pr where to_num - num between 2 and 20), g as (select wt.*, h.line_no from wt join h on h.doc_id = wt.doc_id and h.kind = wt.kind and h.num = wt.num and not h.is_heading and h.line_no > a and h.line_no < b),
o as (select *, lag(line_no) over (partition by doc_id, kind, level, a order by num) as bf from (select *, count(*) over (partition by doc_id, kind, level, a, num) as c from g) where c = 1),
o2 as (select *, lag(line_no) over (partition by doc_id, kind, level, a order by num) as b2 from o)
select doc_id, line_no, level, num::int as num from o where (doc_id, kind, level, a) not in (select (doc_id, kind, level, a) from o2 where b2 > line_no)""",
    "wn_majority_chains": HD
    + """, d as (select *, num - lag(num) over (partition by doc_id, kind order by line_no) as d from h), k as (select *, sum(case when d between 1 and 5 then 0 else 1 end) over (partition by doc_id, kind order by line_no) as ch from d)
select doc_id, line_no, case when count(*) over w >= 3 then sum(is_heading::int) over w * 2 >= count(*) over w else is_heading end as is_heading from k window w as (partition by doc_id, kind, ch)""",
    "wn_complete_sequence": HD
    + """, x as (select *, case when is_heading then num end as v, case when is_heading then line_no end as vp from h), y as (select *, last_value(v ignore nulls) over b as pv, last_value(vp ignore nulls) over b as pp, first_value(v ignore nulls) over f as nv, first_value(vp ignore nulls) over f as np from x
  window b as (partition by doc_id order by line_no rows between unbounded preceding and current row), f as (partition by doc_id order by line_no rows between current row and unbounded following)) select doc_id, line_no, coalesce(v, case when nv - pv = np - pp then pv + line_no - pp end) as filled from y""",
    "wn_first_title": "select doc_id, arg_min(text, block_id) as title from doc_blocks where type = 'heading' and coalesce(page, 0) <= 3 group by doc_id",
    "wn_blocks": c2_text.L + " select case when starts_with(line, '|') then 'table' when regexp_matches(line, '^#{1,6} ') then 'head' when trim(line) = '' then 'blank' when line is not null then 'para' end as kind, count(*) as n from ln group by 1",
    "wn_table_rows": C + " select table_id, count(distinct r) as n_rows from ce group by all",
    "wn_column_number_rows": C
    + """, w2 as (select table_id, r, count(*) as w from ce group by all), c2 as (select table_id, r, c, cell from ce union all select table_id, r, c + w, cell from ce join w2 using (table_id, r)), x as (select table_id, r, c, trim(case when r = 2 then (c + 1)::varchar else cell end) as cell from c2),
y as (select *, case when regexp_full_match(cell, '[0-9]{1,9}') then try_cast(cell as int) end as n from x where cell != ''), z as (select *, case when n = lag(n) over (partition by table_id, r order by c) + 1 then 0 else 1 end as st from y where n is not null),
v as (select *, sum(st) over (partition by table_id, r order by c) as p from z), k as (select table_id, r, max(k) as k from (select table_id, r, p, count(*) as k from v group by all) group by all),
g as (select table_id, r, count(*) as filled, count(n) as ints, min(case when n is not null then c end) as first from y group by all) select table_id, r, first from g join k using (table_id, r) where filled >= 5 and ints * 5 >= filled * 4 and k >= 5""",
    "wn_mode_width": C + MW.format("ce") + " select * from mw",
    "wn_banners": C + ", x as (select table_id, r, c, case when r % 3 = 0 and c > 0 then '' else cell end as cell from ce)" + MW.format("x") + " select table_id, r, text, width as colspan from (select table_id, r, min(cell) as text from x where cell != '' group by all having count(*) = 1) join mw using (table_id)",
    "gr_to_html": HT + " select * from ht",
    "gr_html_roundtrip": C + ", rn as (select table_id, r, dense_rank() over (partition by table_id order by r) - 1 as rr, c, cell from ce) select table_id, rr::int as r, c, cell from rn",
    "gr_parse_html": c2_text.T
    + """, hr as (select table_id, unnest(range(len(x)))::int as r, unnest(x) as row from (select table_id, regexp_extract_all(markdown, '(?is)<tr[^>]*>(.*?)</tr>', 1) as x from t where regexp_matches(markdown, '(?i)<table'))),
hc as (select table_id, r, unnest(range(len(x)))::int as c, unnest(x) as cell from (select table_id, r, regexp_extract_all(row, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1) as x from hr)) select table_id, r, c, trim(replace(replace(replace(regexp_replace(cell, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as cell from hc""",
    "gr_reassemble": TL
    + """, sz as (select img, tr, tc, max(c) + 1 as w, max(r) + 1 as h from tl group by all), md as (select img, tr, quantile_cont(h, 0.5) as med, max(h) as height from sz group by all), vt as (select img, tc, w, count(*) as n from sz join md using (img, tr) where h <= 1.8 * med and h >= 0.4 * med group by all),
wd as (select img, tc, arg_min(w, (-n, w)) as width from vt group by all), wx as (select *, sum(width) over (partition by img order by tc) - width as x0 from wd), bx as (select img, tr, height, sum(height) over (partition by img order by tr) - height as y0 from md),
fr as (select img, tr, tc, x0, y0, c, unnest(range(height)) as r from (select *, unnest(range(width)) as c from wx join bx using (img)))
select img, (y0 + r)::bigint as row, (x0 + c)::bigint as col, coalesce(cell, '') as cell from fr left join tl using (img, tr, tc, r, c)""",
    "gr_panels": C + ", w as (select table_id, max(c) + 1 as width from ce group by all) select table_id, floor(c / ceil(width / 2.0))::bigint as panel, r, (c % ceil(width / 2.0))::bigint as c, cell from ce join w using (table_id)",
    "gr_side_by_side": C + ", wa as (select table_id, r, count(*) as w from ce group by all) select table_id, r, c::bigint as c, cell from ce union all select table_id, r, c + coalesce(w, 0), cell from (select * from ce where r > 2) left join wa using (table_id, r)",
    "gr_integral": PX + ", a as (select *, sum(ink) over (partition by img, y order by x) as rs from px) select img, y, x, (sum(rs) over (partition by img, x order by y))::bigint as integral from a",
    "gr_number_formats": C + ", v as (select table_id, c, regexp_replace(cell, '[0-9]+', '0', 'g') as template, count(*) as n from ce where r > 0 and regexp_matches(cell, '^[0-9][0-9,.]*%?$') group by all) select table_id, c, arg_min(template, (-n, template)) as template, max(n) as n from v group by all having max(n) >= 3",
    "gr_tighten": PX + " select img, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1, avg(ink) as mean from px where x between 5 and 50 and ink = 1 group by img",
    "gr_dimensions": C + " select table_id, max(r) + 1 as rows, max(c) + 1 as cols from ce group by all",
}
