"""Queries over images (the rows of the embeddings, 50 to an image of 64 columns; dark where positive) and over page texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import pixels as p
from orrery.plans import c2_headings, c2_layout, c2_text
from orrery.operators import sequences as q

HEIGHT, WIDTH = 50, 64


def dark(s, d):
    return c2_layout.pixels(s, d).where("ink = 1").select("img", "y", "x")


def cuts(s, d):
    ink = c2_layout.rows(s, d).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "ink"))), lambda r: r.ink.cast("double")).alias("ink"))
    return ink.select("img", F.array_join(F.transform(p.image_function(lambda v: p.slice_cuts([float(x) for x in v], [(14, 22)], 15, 4, 5), T.ArrayType(T.IntegerType()))("ink"), lambda x: x.cast("string")), ",").alias("cuts"))


def bounds(s, d):
    c = q.longest_runs(dark(s, d), ["img"], "x", "y", 5).groupBy("img").agg(F.collect_list("centre").alias("c")).select("img", q.boundaries(F.col("c"), F.lit(64)).alias("b"))
    fn = p.image_function(lambda v: p.grouped_boundaries([float(x) for x in v], 12.0, 3), T.ArrayType(T.DoubleType()))
    return c.select("img", F.array_join(F.transform(fn("b"), lambda x: (x * 2).cast("int").cast("string")), ",").alias("bounds"))


def isolated(s, d):
    fn = p.image_function(lambda v: list(p.isolated_ink([tuple(x) for x in v], 20, 44)), T.ArrayType(T.IntegerType()))
    return p.points_of(dark(s, d).where("(x + y) % 3 != 0")).select("img", fn("points").alias("n")).select("img", F.col("n")[0].alias("isolated"), F.col("n")[1].alias("total"))


def blocks(s, d):
    fn = p.image_function(lambda v: [list(b) for b in (lambda r: [r[0], *r[1]] if r[0] else [])(p.split_blocks([tuple(x) for x in v], HEIGHT, WIDTH, 0.2, 0.4))], p.BOX)
    thin = dark(s, d).where("y % 10 < 5 and x % 16 < 9")
    return p.points_of(thin).select("img", F.posexplode(fn("points")).alias("n", "b")).select("img", "n", *[F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def ordered_blocks(s, d):
    """A text's stretches and tables in order."""
    x = c2_text.blocks(s, d).select("block_id", F.split(F.regexp_replace("text", "(?is)(<table.*?</table>)", "\x01$1\x01"), "\x01").alias("x"))
    x = x.select("block_id", F.posexplode(F.filter(F.transform("x", lambda y: F.trim(y)), lambda y: y != "")).alias("n", "text"))
    return x.select("block_id", "n", F.when(F.lower("text").startswith("<table"), "table").otherwise("text").alias("kind"), "text")


def around(s, d, radius: int = 300):
    """The text before and after each text's first table, `radius` characters each."""
    at = F.regexp_instr("text", F.lit("(?i)<table"))
    end = F.length(F.regexp_extract("text", "(?is)^(.*?</table>)", 1))
    x = c2_text.blocks(s, d).where(at > 0).withColumn("at", at).withColumn("end", F.when(end > 0, end).otherwise(F.length("text")))
    return x.select("block_id", F.expr(f"substring(text, greatest(1, at - {radius}), least({radius}, at - 1))").alias("before"), F.expr(f"substring(text, end + 1, {radius})").alias("after"))


def heads(s, d, pages: int = 2, cap: int = 2400):
    """The first pages of a document, at most `cap` characters."""
    x = c2_headings.strips(s, d).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "text"))), 1, pages).alias("p"))  # a document's pages
    return x.select("doc_id", F.substring(F.array_join(F.transform("p", lambda y: y.text), "\n"), 1, cap).alias("head"))


QUERIES = {
    "wn_rule_count": lambda s, d: p.rule_count(dark(s, d).where("y = 0"), ["img"], "x"),
    "wn_text_ink": lambda s, d: p.text_ink(dark(s, d), HEIGHT),
    "wn_table_bands": lambda s, d: p.table_bands(dark(s, d), HEIGHT, 10, 0.75, 5),
    "wn_rule_breaks": lambda s, d: p.rule_breaks(dark(s, d), HEIGHT, 6, 0.35, 1),
    "wn_slice_cuts": cuts,
    "wn_group_boundaries": bounds,
    "gr_isolated_ink": isolated,
    "gr_text_blocks": blocks,
    "c2_ordered_blocks": ordered_blocks,
    "c2_table_context": around,
    "c4_document_heads": heads,
}

PX, isl = c2_layout.PX, c2_layout.isl
DARK = PX + ", dk as (select img, y, x from px where ink = 1)"
ORACLE = {
    "wn_rule_count": DARK + isl("i", "(select * from dk where y = 0)", "img", "x", 2) + " select img, count(*) as n from i group by img",
    "wn_text_ink": DARK + isl("i", "dk", "img, x", "y", 1) + " select img, x, sum(n) / 50.0 as ink from i where n < 7.5 group by all",
    "wn_table_bands": DARK
    + """, wk as (select img, x, y, unnest([y // 5, y // 5 - 1]) as k from dk), fd as (select distinct img, x from (select img, k, x, count(*) as n from wk where k >= 0 and 50 - k * 5 >= 5 group by all) where n > 0.75 * least(10, 50 - k * 5))"""
    + isl("fl", "fd", "img", "x", 2)
    + ", ok as (select img from fl group by img having count(*) >= 3), fk as (select dk.* from dk semi join fd using (img, x) semi join ok using (img))"
    + isl("rn", "fk", "img, x", "y", 1)
    + """, rr as (select img as k, x, start, "end" from rn where "end" - start >= 5), u1 as (select *, max("end") over (partition by k order by start, "end", x rows between unbounded preceding and 1 preceding) as bf from rr), u2 as (select *, sum(case when start <= bf then 0 else 1 end) over (partition by k order by start, "end", x rows unbounded preceding) as i from u1),
bd as (select k as img, i, min(start) as s, max("end") as e from u2 group by k, i), ln as (select distinct u2.k as img, bd.s, bd.e, u2.x from u2 join bd on bd.img = u2.k and bd.i = u2.i)"""
    + isl("lc2", "ln", "img, s, e", "x", 2)
    + ' select img, s as start, e as "end", count(*) as rules from lc2 group by img, s, e having count(*) >= 3',
    "c2_ordered_blocks": c2_text.B
    + """, x as (select block_id, list_filter(list_transform(string_split(regexp_replace(text, '(?is)(<table.*?</table>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y != '') as x from b),
y as (select block_id, unnest(range(len(x)))::int as n, unnest(x) as text from x) select block_id, n, case when starts_with(lower(text), '<table') then 'table' else 'text' end as kind, text from y""",
    "c4_document_heads": c2_headings.STRIPS + ", r as (select *, row_number() over (partition by doc_id order by pos, text) as k from st) select doc_id, substring(string_agg(text, chr(10) order by pos, text), 1, 2400) as head from r where k <= 2 group by doc_id",
}
