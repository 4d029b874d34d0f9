"""Queries over tables as grids: reading, assembling, headers, numbers, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import grids as g
from orrery.operators import tables as t
from orrery.plans import c2_layout, c2_text
from orrery.tables import table


def html(s, d):
    return c2_text.tables(s, d).where(F.col("markdown").rlike("(?i)<table")).select("table_id", F.col("markdown").alias("html"))


def wide(s, d):
    """Grids of tables beside themselves, their third row the column numbers."""
    return g.grids(c2_layout.doubled(s, d))


def over(fn):
    """Query of a grid function over the wide grids, as cells."""
    return lambda s, d: g.cells_of(wide(s, d).select("table_id", g.grid_function(fn)(F.col("grid")).alias("grid")))


def holed(s, d):
    """Wide grids whose number rows miss every fourth number."""
    c = c2_layout.doubled(s, d)
    return g.grids(c.withColumn("cell", F.when((F.col("r") == 2) & (F.col("c") % 4 == 3), "").otherwise(F.col("cell"))))


def marked(s, d):
    """Cells of every third row without their separators, and where they are."""
    c = c2_text.cells(s, d)
    return g.grids(c.withColumn("cell", F.when(F.col("r") % 3 == 2, F.regexp_replace("cell", "[,]", "")).otherwise(F.col("cell"))))


def harmonised(s, d):
    fn = lambda x: g.harmonised(x, [(i, j) for i, r in enumerate(x) if i % 3 == 1 for j in range(len(r))])
    return g.cells_of(marked(s, d).select("table_id", g.grid_function(fn)(F.col("grid")).alias("grid")))


def tile_rows(s, d):
    """(img, tiles): an image's tiles as HTML, bands of columns."""
    c = c2_layout.tiles(s, d).withColumn("table_id", F.concat_ws("/", "img", "tr", "tc"))
    from orrery.operators import sequences as q

    one = q.to_html(c.select("table_id", "r", "c", "cell")).withColumn("p", F.split("table_id", "/"))
    band = one.groupBy(F.col("p")[0].cast("bigint").alias("img"), F.col("p")[1].cast("int").alias("tr")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p")[2].cast("int").alias("tc"), "html"))), lambda x: x.html).alias("band"))
    return band.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("tr", "band"))), lambda x: x.band).alias("tiles"))


def assembled(s, d):
    fn = lambda tiles: g.assembled(tiles, [400] * len(tiles), [400] * max(map(len, tiles), default=0))[1]
    x = tile_rows(s, d).select(F.col("img").cast("string").alias("table_id"), F.pandas_udf(lambda y: y.map(lambda z: fn([list(r) for r in z])), g.GRID)("tiles").alias("grid"))
    return g.cells_of(x)


def items(s, d):
    """(doc_id, grids): a document's tables in order."""
    x = g.grids(c2_text.cells(s, d)).join(table(s, d, "doc_tables").select("table_id", "doc_id").where("doc_id is not null").groupBy("table_id").agg(F.min("doc_id").alias("doc_id")), "table_id")
    return x.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_id", "grid"))), lambda y: y.grid).alias("grids"))  # a document's tables


def merged(s, d):
    fn = F.pandas_udf(lambda x: x.map(lambda gs: len(g.merge_header_strips([("table", g.plain(y)) for y in gs]))), "int")
    return items(s, d).select("doc_id", F.size("grids").alias("before"), fn("grids").alias("after"))


def ink(s, d):
    return c2_text.cells(s, d).select("table_id", "r", "c", (F.col("cell") != "-").alias("ink"))


def widths(s, d):
    return c2_text.cells(s, d).groupBy("table_id").agg((F.max("c") + 1).alias("cols"))


def lossy(s, d):
    """The cells without those of every seventh row and with a cell more in every fifth."""
    c = c2_text.cells(s, d)
    more = c.where("r % 5 = 0").groupBy("table_id", "r").agg((F.max("c") + 1).alias("c")).withColumn("cell", F.lit("x"))
    return c.where("r % 7 != 3").withColumn("cell", F.when(F.col("cell") == "-", "").otherwise(F.col("cell"))).unionByName(more.select("table_id", "r", "c", "cell"))


QUERIES = {
    "gr_first_grid": lambda s, d: g.cells_of(html(s, d).select("table_id", g.grid_of(F.col("html")).alias("grid"))),
    "gr_sizes": lambda s, d: html(s, d).select("table_id", g.size_of(F.col("html")).alias("x")).select("table_id", "x.*"),
    "gr_assembled": assembled,
    "gr_rebuild_header": over(g.rebuild_header),
    "gr_header_spans": over(g.header_spans),
    "gr_axis_splits": lambda s, d: wide(s, d).select("table_id", F.pandas_udf(lambda x: x.map(lambda y: g.axis_splits(g.plain(y), [(0, len(y))], 3)), "array<int>")("grid").alias("rows")).where("size(rows) > 0"),
    "gr_number_completion": lambda s, d: g.cells_of(holed(s, d).select("table_id", g.grid_function(g.complete_numbers)(F.col("grid")).alias("grid"))),
    "gr_harmonised": harmonised,
    "gr_rebuilt_html": lambda s, d: wide(s, d).select("table_id", g.html_of(g.grid_function(g.rebuild_header)(F.col("grid"))).alias("html")),
    "gr_merge_header_strips": merged,
    "qa_strict_audit": lambda s, d: t.strict_audit(lossy(s, d), ink(s, d), widths(s, d)),
    "qa_cell_agreement": lambda s, d: t.cell_agreement(lossy(s, d), c2_text.cells(s, d)),
    "qa_blank_bands": lambda s, d: c2_layout.rows(s, d).groupBy("img", F.floor(F.col("y") / 5).alias("band")).agg(F.collect_list(F.col("ink").cast("double")).alias("rows")).select("img", "band", t.blank_band(F.col("rows"), 28.0).alias("blank")),
    "gr_upsample": lambda s, d: table(s, d, "part").select("p_partkey", t.upsample(F.col("p_size").cast("double")).alias("factor")),
    "gr_narrow_columns": lambda s, d: c2_layout.profile(s, d).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("v") < 0.45, F.struct("x", "v")))), lambda y: y).alias("k")).select("img", F.transform("k", lambda y: y.x.cast("double")).alias("b"), F.transform("k", lambda y: y.v * 10).alias("i")).select("img", F.array_join(F.transform(t.narrow_columns(F.col("b"), F.col("i"), 0.5, 4.2), lambda y: y.cast("int").cast("string")), ",").alias("bounds")),
}

C = c2_text.C
PX = c2_layout.PX
LOSSY = C + """, mr as (select table_id, r, (max(c) + 1)::int as c, 'x' as cell from ce where r % 5 = 0 group by all), ly as (select table_id, r, c, case when cell = '-' then '' else cell end as cell from ce where r % 7 != 3 union all select * from mr)"""
ORACLE = {
    "gr_sizes": c2_text.T
    + """, hr as (select table_id, unnest(range(len(x)))::int as r, unnest(x) as row from (select table_id, regexp_extract_all(markdown, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1) as x from t where regexp_matches(markdown, '(?i)<table'))),
hc as (select table_id, r, unnest(regexp_extract_all(row, '(?is)<t[dh]\\b([^>]*)>', 1)) as a from hr), w as (select table_id, r, count(*) as n, sum(greatest(1, coalesce(try_cast(nullif(regexp_extract(a, '(?i)colspan\\s*=\\s*["'']?(\\d+)', 1), '') as int), 1))) as w, max(greatest(1, coalesce(try_cast(nullif(regexp_extract(a, '(?i)rowspan\\s*=\\s*["'']?(\\d+)', 1), '') as int), 1))) as rs from hc group by all),
m as (select table_id, arg_min(w, (-k, first)) as mode from (select table_id, w, count(*) as k, min(r) as first from w where n > 1 and rs = 1 group by all) group by table_id), tb as (select table_id from t where regexp_matches(markdown, '(?i)<table')),
z as (select table_id, (select count(*) from hr where hr.table_id = tb.table_id) as rows, (select max(w) from w where w.table_id = tb.table_id) as cols from tb) select z.table_id, rows::int as rows, coalesce(cols, 0)::int as cols, coalesce(mode, cols, 1)::int as mode from z left join m using (table_id)""",
    "gr_assembled": c2_layout.TL
    + """, sz as (select img, tr, tc, max(c) + 1 as w, max(r) + 1 as h from tl group by all), md as (select img, tr, list_sort(list(h))[len(list(h)) // 2 + 1] as med, max(h) as height from sz group by all), vt as (select img, tc, w, count(*) as n, min(tr) as first from sz join md using (img, tr) where h <= 1.8 * med and h >= 0.4 * med group by all),
wd as (select img, tc, arg_min(w, (-n, first)) as width from vt group by all), wx as (select *, sum(width) over (partition by img order by tc) - width as x0 from wd), bx as (select img, tr, height, sum(height) over (partition by img order by tr) - height as y0 from md),
fr as (select img, tr, tc, x0, y0, c, unnest(range(height)) as r from (select *, unnest(range(width)) as c from wx join bx using (img)))
select img::bigint::varchar as table_id, (y0 + r)::int as r, (x0 + c)::int as c, coalesce(cell, '') as cell from fr left join tl using (img, tr, tc, r, c)""",
    "qa_strict_audit": LOSSY
    + """, a as (select table_id, max(c) + 1 as w, row_number() over (partition by table_id order by r) as k from ly where trim(cell) != '' group by table_id, r), b as (select table_id, max(c) + 1 as iw, row_number() over (partition by table_id order by r) as k from ce where cell != '-' group by table_id, r),
cl as (select table_id, max(c) + 1 as cols from ce group by table_id), x as (select * from (select coalesce(a.table_id, b.table_id) as table_id, w, iw from a full join b on a.table_id = b.table_id and a.k = b.k) join cl using (table_id)),
y as (select table_id, count(w) as rows, count(iw) as inked, count(*) filter (w > cols) as too_wide, count(*) filter (w < coalesce(iw, 0)) as too_narrow from x group by table_id)
select *, case when rows != inked and too_wide + too_narrow > 0 then 'rows+width' when rows != inked then 'rows' when too_wide + too_narrow > 0 then 'width' end as reason from y""",
    "qa_cell_agreement": LOSSY + """, x as (select coalesce(a.table_id, b.table_id) as table_id, regexp_replace(coalesce(a.cell, ''), '[^0-9]', '', 'g') as p, regexp_replace(coalesce(b.cell, ''), '[^0-9]', '', 'g') as q from ly a full join ce b on a.table_id = b.table_id and a.r = b.r and a.c = b.c)
select table_id, count(*) as cells, count(*) filter (p = q) as agree from x where p != '' or q != '' group by table_id""",
    "qa_blank_bands": PX + ", rw as (select img, y, sum(ink) as ink from px group by all) select img, y // 5 as band, max(ink) < 28 as blank from rw group by all",
    "gr_upsample": "select p_partkey, case when p_size < 40 then round(least(3.0, 55.0 / p_size), 2) else 1.0 end as factor from part",
}
