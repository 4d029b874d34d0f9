"""Queries over documents read page by page: heading levels, titles, seams. A page's strip is its blocks in order, headings with a mark a section level."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import headings as h
from orrery.operators import seams
from orrery.operators import tables as t
from orrery.tables import table


def strips(s, d):
    """(doc_id, pos, text): pages; blocks without a page come before the first."""
    b = table(s, d, "doc_blocks").where("block_id is not null and doc_id is not null").groupBy("block_id").agg(F.max(F.struct("ingested_at", "doc_id", "page", "type", "text", F.size("section_path").alias("level"))).alias("x")).select("block_id", "x.*")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    line = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    x = b.select("doc_id", F.coalesce("page", F.lit(0)).cast("bigint").alias("pos"), "block_id", line.alias("line"))
    return x.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "line"))), lambda y: y.line), "\n").alias("text"))  # a page's blocks


def levels(s, d):
    x = h.heading_lines(strips(s, d))
    return h.heading_levels(x)


def stats(s, d):
    """Headings as read against those at their levels."""
    def of(x):
        return h.heading_lines(x).select("doc_id", (F.col("pos") * 100000 + F.col("line")).alias("place"), F.col("raw").alias("level"), F.trim("text").alias("text"))

    return h.heading_stats(of(strips(s, d)), of(h.relevel(strips(s, d))))


def long_documents(s, d):
    """All stages: contents, levels, strips merged, strays and formats put right."""
    x = h.relevel(strips(s, d).withColumn("text", h.row_function(h.contents_to_headings)(F.col("text"))))
    return seams.merge_strips(x).select("doc_id", "n_strips", h.row_function(lambda y: h.part_formats(h.demote_strays(y)))(F.col("text")).alias("text"))


def per_strip(fn):
    return lambda s, d: strips(s, d).select("doc_id", "pos", h.row_function(fn)(F.col("text")).alias("text"))


def lines(s, d):
    x = strips(s, d)
    return x.select(F.concat_ws("#", "doc_id", F.col("pos").cast("string")).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


QUERIES = {
    "c2_strips": strips,
    "c2_heading_levels": levels,
    "c2_heading_anchors": lambda s, d: h.heading_lines(strips(s, d)).groupBy("doc_id").agg(F.min_by("text", F.struct("pos", "line")).alias("text")).select("doc_id", F.pandas_udf(lambda x: x.map(h.anchor), "int")(F.col("text")).alias("level")),
    "c2_relevel": lambda s, d: h.relevel(strips(s, d)),
    "c2_heading_stats": stats,
    "c2_promoted_titles": per_strip(h.promote_title),
    "c2_wrapped_titles": per_strip(h.join_wrapped_title),
    "c2_contents_headings": per_strip(h.contents_to_headings),
    "c2_demoted_sentences": per_strip(h.demote_sentences),
    "c2_stray_headings": per_strip(h.demote_strays),
    "c2_format_clash": per_strip(h.part_formats),
    "c2_merge_strips": lambda s, d: seams.merge_strips(strips(s, d)),
    "c2_long_documents": long_documents,
    "c2_near_tables": lambda s, d: t.near_tables(lines(s, d)),
}

STRIPS = """with b as (select * from (select *, row_number() over (partition by block_id order by ingested_at desc nulls last, doc_id desc, page desc nulls last, type desc, text desc nulls last) as rn from doc_blocks where block_id is not null and doc_id is not null) where rn = 1),
st as (select doc_id, coalesce(page, 0)::bigint as pos, string_agg(case when type = 'heading' then repeat('#', greatest(1, least(6, coalesce(len(section_path), 1)))) || ' ' || coalesce(text, '') else coalesce(text, '') end, chr(10) order by block_id) as text from b group by all)"""
ORACLE = {
    "c2_strips": STRIPS + " select * from st",
    "c2_near_tables": STRIPS
    + """, ln as (select doc_id || '#' || pos as doc_id, unnest(range(len(string_split(text, chr(10)))))::int as line_no, unnest(string_split(text, chr(10))) as line from st),
x as (select *, sum(regexp_matches(line, '(?i)<table\\b')::int) over w - coalesce(sum(regexp_matches(line, '(?i)</table>')::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as depth from ln window w as (partition by doc_id order by line_no)),
y as (select *, max((depth > 0)::int) over (partition by doc_id order by line_no rows between 4 preceding and 4 following) as near, max((depth > 0)::int) over (partition by doc_id) as anyone from x),
z as (select *, coalesce(line_no > lag(line_no) over (partition by doc_id order by line_no) + 1, false) as gap from y where near = 1 or anyone = 0) select doc_id, line_no, case when gap then '⋯⋯' || chr(10) || line else line end as line from z""",
}
