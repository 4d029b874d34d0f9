"""Queries over table and strip repair, and the learned baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import sequences as q
from orrery.operators import tables as t
from orrery.plans import c2_layout, c2_text
from orrery.tables import table


def cells(s, d):
    return c2_text.cells(s, d)


def sparse(s, d):
    """Cells with dashes emptied, every fifth row kept only in its first cell, and row numbers that restart in the first column."""
    c = cells(s, d)
    x = F.when(F.col("cell") == "-", "").when((F.col("r") % 5 == 0) & (F.col("c") > 0), "").when((F.col("c") == 0) & (F.col("r") % 5 > 0), F.concat((F.col("r") % 5).cast("string"), F.lit(" "), F.col("cell"))).otherwise(F.col("cell"))
    return c.withColumn("cell", x)


def sizes(s, d):
    x = cells(s, d).groupBy("table_id").agg(F.count("*").alias("cells"), (F.max("c") + 1).alias("cols"))
    x = x.withColumn("cells", F.when(F.crc32("table_id") % 3 == 0, F.col("cols")).otherwise(F.col("cells")))
    return x.select(F.split("table_id", "#")[0].alias("doc_id"), "table_id", "cells", "cols")


def estimates(s, d):
    g = c2_layout.QUERIES["gr_dimensions"](s, d)
    return g.select("table_id", F.when(F.col("rows") % 4 == 0, F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"), F.when(F.col("rows") % 3 == 0, F.col("cols") - 1).otherwise(F.col("cols")).alias("cols")), g


def spacing(s, d):
    p = c2_layout.profile(s, d)
    x = p.withColumn("floor", F.explode(F.array(*[F.lit(v) for v in (0.40, 0.44, 0.48)]))).where("v <= floor")
    return x.select("img", F.round("floor", 2).alias("floor"), "x")


def seam_pairs(s, d):
    x = c2_text.tables(s, d).where("markdown like '|%'").select("table_id", F.split("markdown", "\n").alias("l"))
    return x.select("table_id", F.slice("l", 1, 5).alias("a"), F.expr("slice(l, 4, 100)").alias("b")).where("size(a) > 0 and size(b) > 0")


def runs(s, d):
    x = q.islands(c2_layout.pixels(s, d).where("ink = 1").select("img", "y", "x"), ["img", "y"], "x", 1)
    return x.where("n >= 3").select("img", "start", "end")


QUERIES = {
    "tx_clean_caption": lambda s, d: table(s, d, "doc_tables").groupBy("table_id").agg(F.min("caption").alias("caption")).select("table_id", t.clean_caption(F.concat(F.lit("<b>## "), F.col("caption"), F.lit("</b><br/> **note**"))).alias("caption")),
    "tx_merge_paragraphs": lambda s, d: c2_text.blocks(s, d).select("block_id", t.merge_paragraphs(F.concat(F.col("text"), F.lit("\n<table><tr></tr></table>\n"), F.col("text"))).alias("text")),
    "tx_harmonise_numbers": lambda s, d: t.harmonise(cells(s, d).withColumn("cell", F.when(F.col("r") % 4 == 3, F.regexp_replace("cell", ",", "")).otherwise(F.col("cell")))),
    "qa_tile_reason": lambda s, d: c2_text.tables(s, d).select("table_id", t.tile_reason(F.col("markdown"), F.regexp_count("markdown", F.lit("\n")), F.lit(6), F.regexp_count("markdown", F.lit("(?i)<td|\\|"))).alias("reason")),
    "qa_occupancy": lambda s, d: t.occupancy(sparse(s, d), cells(s, d).select("table_id", "r", "c", (F.col("cell") != "-").alias("ink"))),
    "qa_grid_accuracy": lambda s, d: t.grid_accuracy(*estimates(s, d)),
    "gr_fold_spans": lambda s, d: t.fold_spans(sparse(s, d)),
    "gr_header_strips": lambda s, d: t.header_strips(sizes(s, d)),
    "gr_calibration_votes": lambda s, d: t.calibration_votes(c2_layout.tiles(s, d)),
    "gr_even_spacing": lambda s, d: t.even_spacing(spacing(s, d)),
    "gr_panel_seams": lambda s, d: t.seams(runs(s, d), 64),
    "gr_misaligned": lambda s, d: t.misaligned(sparse(s, d)),
    "gr_header_islands": lambda s, d: t.header_islands(cells(s, d).withColumn("cell", F.when(F.col("c") % 3 == 2, "").otherwise(F.col("cell")))),
    "gr_banner_rows": lambda s, d: t.banner_html(sparse(s, d)),
    "wn_slice_points": lambda s, d: table(s, d, "documents").where("doc_id is not null").select("doc_id", F.array_join(F.transform(t.slice_points(F.coalesce("n_chars", F.lit(0)), 500, 80), lambda x: x.cast("string")), ",").alias("cuts")),
    "wn_seam_overlap": lambda s, d: seam_pairs(s, d).select("table_id", t.seam_overlap(F.col("a"), F.col("b")).alias("overlap")),
    "wn_split_at_banners": lambda s, d: t.split_at_banners(sparse(s, d)),
    "wn_width_regimes": lambda s, d: t.width_regimes(cells(s, d).withColumn("cell", F.when((F.col("r") > 4) & (F.col("c") > 0), "").otherwise(F.col("cell")))),
}

C = c2_text.C
SPARSE = C + """, sx as (select table_id, r, c, case when cell = '-' then '' when r % 5 = 0 and c > 0 then '' when c = 0 and r % 5 > 0 then (r % 5) || ' ' || cell else cell end as cell from ce)"""
MW = c2_layout.MW
ORACLE = {
    "tx_clean_caption": """with k as (select table_id, min(caption) as caption from doc_tables group by table_id), a as (select table_id, regexp_replace(regexp_replace('<b>## ' || caption || '</b><br/> **note**', '(?i)</?p>|<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g') as x from k)
select table_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^#{1,6}\\s+', '', 'g'), '\\*\\*', '', 'g'), '[ \\t]*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as caption from a""",
    "tx_merge_paragraphs": c2_text.B
    + """, p as (select block_id, string_split(regexp_replace(text || chr(10) || '<table><tr></tr></table>' || chr(10) || text, '(?is)(<table.*?</table>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as x from b)
select block_id, array_to_string(list_filter(list_transform(x, lambda y: case when starts_with(lower(y), '<table') then y else regexp_replace(regexp_replace(y, '\\s*\\n+\\s*', ' ', 'g'), '^\\s+|\\s+$', '', 'g') end), lambda y: y != ''), chr(10) || chr(10)) as text from p""",
    "tx_harmonise_numbers": C
    + r""", x as (select table_id, r, c, case when r % 4 = 3 then replace(cell, ',', '') else cell end as cell from ce), v as (select table_id, c, regexp_replace(cell, '[0-9]+', '0', 'g') as template, count(*) as n from x where r > 0 and regexp_matches(cell, '^[0-9][0-9,.]*%?$') group by all),
w as (select table_id, c, arg_min(template, (-n, template)) as template from v group by all having max(n) >= 3) select table_id, r, c, case when regexp_matches(cell, '^[0-9]{4,6}\.[0-9]{2}$') and template like '%,%' then regexp_replace(cell, '^([0-9]{1,3})([0-9]{3})(\.[0-9]{2})$', '\1,\2\3') else cell end as cell from x left join w using (table_id, c)""",
    "qa_tile_reason": c2_text.T
    + """ select table_id, case when not contains(lower(coalesce(markdown, '')), '<t') then 'flat' when len(regexp_extract_all(markdown, '(?i)<td|\\|')) > 40 then 'too_wide' when contains(lower(markdown), '<table') and not contains(lower(markdown), '</table>') then 'truncated' when len(string_split(markdown, chr(10))) - 1 < 6 * 0.8 then 'row_under' end as reason from t""",
    "qa_occupancy": SPARSE + " select table_id, count(*) filter ((sx.cell != '') != (ce.cell != '-')) = 0 as identical, count(*) filter ((sx.cell != '') != (ce.cell != '-')) as differing from sx join ce using (table_id, r, c) group by table_id",
    "qa_grid_accuracy": C
    + """, g as (select table_id, max(r) + 1 as gr, max(c) + 1 as gc from ce group by all), e as (select *, case when gr % 4 = 0 then gr + 1 else gr end as rows, case when gr % 3 = 0 then gc - 1 else gc end as cols from g)
select count(*) as n, round(avg((rows = gr)::int), 4) as row_hits, round(avg((cols = gc)::int), 4) as col_hits, quantile_disc(rows * cols / (gr * gc), 0.5) as median_ratio, round(avg(rows * cols / (gr * gc)), 6) as mean_ratio from e""",
    "gr_fold_spans": SPARSE + ", n as (select *, case when cell = lag(cell) over (partition by table_id, r order by c) then 0 else 1 end as nw from sx), g as (select *, sum(nw) over (partition by table_id, r order by c) as g from n) select table_id, r, min(c) as c, min(cell) as cell, count(*) as colspan from g group by table_id, r, g",
    "gr_calibration_votes": c2_layout.TL + ", v as (select img, tc, w, count(*) as votes from (select img, tr, tc, max(c) + 1 as w from tl group by all) group by all) select * from (select *, row_number() over (partition by img, tc order by votes desc, w) as top from v) where votes >= 2",
    "gr_even_spacing": c2_layout.PX
    + """, f as (select img, unnest([0.40, 0.44, 0.48])::double as floor, x, v from pf), c as (select * from f where v <= floor), g as (select img, floor, x - lag(x) over (partition by img, floor order by x) as gap from c), m as (select img, floor, quantile_cont(gap, 0.5) as med from g where gap is not null group by all),
s as (select img, floor, round(avg((abs(gap - med) <= 0.3 * med)::int), 6) as even from g join m using (img, floor) where gap is not null group by all) select img, arg_min(floor, (-even, floor)) as floor, max(even) as even from s group by img""",
    "gr_panel_seams": c2_layout.PX
    + c2_layout.isl("hr", "(select * from px where ink = 1)", "img, y", "x", 1)
    + ', rr as (select img as k, start, "end" from hr where n >= 3)'
    + c2_layout.uni("rr")
    + ', gp as (select k as img, "end" + 1 as start, lead(start) over (partition by k order by start) - 1 as e from un) select img, start, e as "end" from gp where e >= start and e < 64',
    "gr_misaligned": SPARSE + ", f as (select table_id, count(distinct r) as full_ from sx where cell != '' group by all), b as (select table_id, max(n) as best from (select table_id, c, count(*) as n from sx where cell != '' group by all) group by all) select table_id, full_ as \"full\", best, full_ > 1.4 * best as misaligned from f join b using (table_id)",
    "gr_header_islands": C + ", hx as (select table_id, c from ce where r = (select min(r) from ce z where z.table_id = ce.table_id) and c % 3 != 2 and cell != '')" + c2_layout.isl("hi", "hx", "table_id", "c", 1) + " select * from hi",
    "gr_banner_rows": SPARSE + MW.format("sx") + " select table_id, r, '<tr><td colspan=\"' || width || '\">' || cell || '</td></tr>' as html from (select table_id, r, min(cell) as cell from sx where cell != '' group by all having count(*) = 1) join mw using (table_id)",
    "wn_slice_points": "select doc_id, array_to_string(list_filter(list_transform(range(1, coalesce(n_chars, 0) // 500 + 1), lambda i: i * 500), lambda x: coalesce(n_chars, 0) - x >= 80), ',') as cuts from documents",
    "wn_split_at_banners": SPARSE
    + r""", x as (select table_id, r, count(*) filter (cell != '') as filled, try_cast(nullif(max(case when c = 0 then regexp_extract(cell, '^([0-9]{1,3})\b', 1) end), '') as int) as num from sx group by all),
y as (select *, last_value(num ignore nulls) over (partition by table_id order by r rows between unbounded preceding and 1 preceding) as bf, lead(num) over (partition by table_id order by r) as nx from x)
select table_id, (sum(case when filled = 1 and nx is not null and bf is not null and nx <= bf then 1 else 0 end) over (partition by table_id order by r))::bigint as part, r from y""",
    "wn_width_regimes": C
    + """, x as (select table_id, r, count(*) filter (cell != '' and not (r > 4 and c > 0)) as w from ce group by all), y as (select *, lag(w, 2) over o as a, lag(w) over o as b, lead(w) over o as d from x window o as (partition by table_id order by r))
select table_id, r from y where a = b and w = d and greatest(b, w) >= 1.6 * least(b, w)""",
}
