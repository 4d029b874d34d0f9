"""Queries over document-level programs and table clean-up."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import text as t
from orrery.operators import documents as o
from orrery.operators import sequences as q
from orrery.plans import c2_text
from orrery.tables import table


def blocks(s, d):
    b = table(s, d, "doc_blocks").where("block_id is not null").groupBy("block_id").agg(*[F.min(c).alias(c) for c in ("doc_id", "type", "text")], F.min(F.size("section_path")).alias("level"))
    return b.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("block_id")))


def html_pairs(s, d):
    """Each table's HTML against that of the table with its first data row gone."""
    c = c2_text.cells(s, d)
    return q.to_html(c).withColumnRenamed("html", "gold").join(q.to_html(c.where("r != 2")).withColumnRenamed("html", "pred"), "table_id", "left")


def header_md(s, d):
    """HTML tables as Markdown, short rows padded, pipes escaped; tables with spans stay HTML."""
    x = c2_text.tables(s, d).where(F.col("markdown").rlike("(?i)<table")).select("table_id", F.col("markdown").alias("html"))
    plain = x.where(~F.col("html").rlike("(?i)(col|row)span\\s*="))
    c = q.from_html(plain).withColumn("cell", F.replace(F.col("cell"), F.lit("|"), F.lit("\\|")))
    row = c.groupBy("table_id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda y: y.cell).alias("cells"))  # one row's cells
    row = row.withColumn("w", F.max(F.size("cells")).over(W.partitionBy("table_id")))
    return row.select("table_id", "r", F.concat(F.lit("| "), F.array_join(F.concat("cells", F.array_repeat(F.lit(""), F.col("w") - F.size("cells"))), " | "), F.lit(" |")).alias("line"))


QUERIES = {
    "c4_chunk_documents": lambda s, d: o.chunk_documents(blocks(s, d).select("doc_id", "pos", "type", "level", "text")),
    "c2_diff_marks": lambda s, d: blocks(s, d).select("block_id", F.array_join(o.diff_marks(F.col("text"), t.strip_html(F.col("text"))), ",").alias("marks")),
    "c2_aligned_headings": lambda s, d: blocks(s, d).select("block_id", o.aligned_headings(F.col("text"), t.strip_html(F.col("text"))).alias("n")),
    "c2_table_similarity": lambda s, d: html_pairs(s, d).select("table_id", F.round(o.table_similarity("pred", "gold"), 6).alias("teds")),
    "c2_html_to_markdown": header_md,
    "c2_page_cleanup": lambda s, d: blocks(s, d).select("block_id", t.sub(t.drop_adjacent(t.strip_latex(t.sub(F.col("text"), "<([A-Za-z0-9]+)[ \\t][^>]*>", "<$1>"))), "\\n{3,}", "\n\n").alias("text")),
    "c2_split_blocks": lambda s, d: blocks(s, d).select("block_id", F.regexp_count("text", F.lit("(?is)<table.*?</table>")).alias("tables"), F.length(t.sub(F.col("text"), "(?is)<table.*?</table>", "")).alias("text_chars")),
    "c2_doc_index": lambda s, d: table(s, d, "fin_docs").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct((~F.col("source_path").contains("attach")).alias("own"), "ingested_at", "source_path", "ext")).alias("x")).select("doc_id", "x.source_path", "x.ext"),
}

B = "with b0 as (select block_id, min(doc_id) as doc_id, min(type) as type, min(text) as text from doc_blocks where block_id is not null group by block_id)"
ORACLE = {
    "c2_html_to_markdown": c2_text.T
    + r""", hr as (select table_id, unnest(range(len(x)))::int as r, unnest(x) as row from (select table_id, regexp_extract_all(markdown, '(?is)<tr[^>]*>(.*?)</tr>', 1) as x from t where regexp_matches(markdown, '(?i)<table') and not regexp_matches(markdown, '(?i)(col|row)span\s*='))),
hc as (select table_id, r, list_transform(regexp_extract_all(row, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: replace(trim(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '|', '\|')) as cells from hr),
w as (select *, max(len(cells)) over (partition by table_id) as w from hc where len(cells) > 0) select table_id, r, '| ' || array_to_string(list_concat(cells, list_transform(range(w - len(cells)), lambda i: '')), ' | ') || ' |' as line from w""",
    "c2_split_blocks": B + " select block_id, len(regexp_extract_all(text, '(?is)<table.*?</table>'))::int as tables, length(regexp_replace(text, '(?is)<table.*?</table>', '', 'g'))::int as text_chars from b0",
    "c2_doc_index": "with x as (select *, row_number() over (partition by doc_id order by (not contains(source_path, 'attach')) desc, ingested_at desc, source_path desc, ext desc) as r from fin_docs where doc_id is not null) select doc_id, source_path, ext from x where r = 1",
}
