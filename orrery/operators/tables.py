"""Table and strip repair: captions, number formats, tiles, header rows, seams, panels and cuts.

Cells are (table_id, r, c, cell) with '' for empty ones. Nulls count as empty; groups are bounded by their table or image; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.sequences import islands, mode_width, number_format_votes, union_intervals

#: Edge length of a cell in pixels below which it is enlarged, the length aimed at, and how much at most.
UP_EDGE, UP_TARGET, UP_CAP = 40.0, 55.0, 3.0


def clean_caption(c: Column) -> Column:
    """Tags, emphasis and heading marks go; paragraphs stay."""
    x = F.regexp_replace(F.regexp_replace(c, "(?i)</?p>|<br\\s*/?>", "\n"), "<[^>]*>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?m)^#{1,6}\s+", ""), r"\*\*", "")
    return F.regexp_replace(F.regexp_replace(x, "[ \\t]*\\n\\s*", "\n"), r"^\s+|\s+$", "")


def merge_paragraphs(c: Column) -> Column:
    """Paragraphs between tables as one block each; tables stay as they are."""
    parts = F.split(F.regexp_replace(c, "(?is)(<table.*?</table>)", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.filter(F.transform(parts, lambda x: F.when(F.lower(x).startswith("<table"), x).otherwise(F.regexp_replace(F.regexp_replace(x, "\\s*\\n+\\s*", " "), r"^\s+|\s+$", ""))), lambda x: x != ""), "\n\n")


def harmonise(cells: DataFrame) -> DataFrame:
    """Numbers of a column whose majority template groups thousands are rewritten to it, digits kept; others stay."""
    v = number_format_votes(cells).where("template like '%,%'").select("table_id", "c", "template")
    x = cells.join(v, ["table_id", "c"], "left")
    plain = F.col("cell").rlike(r"^[0-9]{4,6}\.[0-9]{2}$") & F.col("template").isNotNull()
    return x.select("table_id", "r", "c", F.when(plain, F.regexp_replace("cell", r"^([0-9]{1,3})([0-9]{3})(\.[0-9]{2})$", "$1,$2$3")).otherwise(F.col("cell")).alias("cell"))


def tile_reason(html: Column, rows: Column, expected: Column, width: Column, most: int = 40) -> Column:
    """Why a tile is bad, in this order: flat (no table), too_wide, truncated, row_under; null if good."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return F.when(~low.contains("<t"), "flat").when(width > most, "too_wide").when(low.contains("<table") & ~low.contains("</table>"), "truncated").when(rows < expected * 0.8, "row_under")


def occupancy(cells: DataFrame, ink: DataFrame) -> DataFrame:
    """(table_id, identical, differing): whether each cell is filled just where there is ink, both with the same rows."""
    a = cells.select("table_id", "r", "c", (F.col("cell") != "").alias("filled"))
    x = a.join(ink, ["table_id", "r", "c"], "full_outer")
    bad = F.coalesce(F.col("filled"), F.lit(False)) != F.coalesce(F.col("ink"), F.lit(False))
    return x.groupBy("table_id").agg((F.count_if(bad) == 0).alias("identical"), F.count_if(bad).alias("differing"))


def grid_accuracy(est: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: share of tables whose rows, and whose columns, are hit, upper median and mean of the cell ratio; est and gold: table_id, rows, cols."""
    x = gold.withColumnsRenamed({"rows": "gr", "cols": "gc"}).join(est, "table_id", "left").withColumn("ratio", F.coalesce(F.col("rows") * F.col("cols") / (F.col("gr") * F.col("gc")), F.lit(0.0)))
    hit = lambda a, b: F.round(F.avg(F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))), 4)
    return x.agg(F.count("*").alias("n"), hit("rows", "gr").alias("row_hits"), hit("cols", "gc").alias("col_hits"), F.expr("percentile_disc(0.5) within group (order by ratio)").alias("median_ratio"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))


def fold_spans(cells: DataFrame) -> DataFrame:
    """(table_id, r, c, cell, colspan): runs of equal neighbouring cells of a row as one cell with its span."""
    w = W.partitionBy("table_id", "r").orderBy("c")
    x = cells.withColumn("new", F.when(F.col("cell") == F.lag("cell").over(w), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return x.groupBy("table_id", "r", "g").agg(F.min("c").alias("c"), F.min("cell").alias("cell"), F.count("*").alias("colspan")).drop("g")


def header_strips(sizes: DataFrame) -> DataFrame:
    """Tables whose predecessor in the document is its header strip: less than an eighth of the cells, columns within 6; sizes: doc_id, table_id, cells, cols."""
    w = W.partitionBy("doc_id").orderBy("table_id")
    x = sizes.withColumn("pc", F.lag("cells").over(w)).withColumn("pw", F.lag("cols").over(w)).withColumn("strip", F.lag("table_id").over(w))
    return x.where((F.col("pc") < F.col("cells") / 8) & (F.abs(F.col("pw") - F.col("cols")) <= 6)).select("doc_id", "table_id", "strip")


def calibration_votes(tiles: DataFrame, least: int = 2) -> DataFrame:
    """(img, tc, w, votes): tile widths that differ from their column's most frequent one and have at least `least` votes."""
    v = tiles.groupBy("img", "tr", "tc").agg((F.max("c") + 1).alias("w")).groupBy("img", "tc", "w").agg(F.count("*").alias("votes"))
    top = F.row_number().over(W.partitionBy("img", "tc").orderBy(F.desc("votes"), "w"))
    return v.withColumn("top", top).where((F.col("votes") >= least)).select("img", "tc", "w", "votes", "top")


def even_spacing(cuts: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """(img, floor, even): the floor whose cuts are spaced most evenly: share of gaps within the tolerance of their median; ties to the smaller floor."""
    w = W.partitionBy("img", "floor").orderBy("x")
    g = cuts.withColumn("gap", F.col("x") - F.lag("x").over(w)).where("gap is not null")
    m = g.groupBy("img", "floor").agg(F.expr("percentile(gap, 0.5)").alias("med"))
    s = g.join(m, ["img", "floor"]).groupBy("img", "floor").agg(F.round(F.avg((F.abs(F.col("gap") - F.col("med")) <= tolerance * F.col("med")).cast("int")), 6).alias("even"))
    return s.groupBy("img").agg(F.min(F.struct((-F.col("even")).alias("m"), "floor")).alias("b")).select("img", F.col("b.floor").alias("floor"), (-F.col("b.m")).alias("even"))


def seams(runs: DataFrame, width: int) -> DataFrame:
    """(img, start, end): stretches that no horizontal run covers, inside the width; runs: img, start, end."""
    u = union_intervals(runs, ["img"])
    w = W.partitionBy("img").orderBy("start")
    gap = u.select("img", (F.col("end") + 1).alias("start"), (F.lead("start").over(w) - 1).alias("end")).where("end is not null and end >= start")
    return gap.where(F.col("end") < width)


def misaligned(cells: DataFrame, ratio: float = 1.4) -> DataFrame:
    """(table_id, full, best, misaligned): rows with any cell against the rows of the fullest column."""
    full = cells.where("cell != ''").groupBy("table_id").agg(F.count_distinct("r").alias("full"))
    best = cells.where("cell != ''").groupBy("table_id", "c").agg(F.count("*").alias("n")).groupBy("table_id").agg(F.max("n").alias("best"))
    return full.join(best, "table_id").select("table_id", "full", "best", (F.col("full") > ratio * F.col("best")).alias("misaligned"))


def slice_points(length: Column, target: int, least: int) -> Column:
    """Cuts near each multiple of the target; a last piece below `least` joins the one before."""
    n = F.floor(length / target)
    pts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: i * target)).otherwise(F.array().cast("array<int>"))
    return F.filter(pts, lambda x: length - x >= least)


def seam_overlap(a: Column, b: Column, most: int = 8, similarity: float = 0.85) -> Column:
    """The largest k for which the last k lines of a are like the first k of b on average; 0 if none."""

    def like(x, y):
        n = F.greatest(F.length(x), F.length(y))
        return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / n)

    k_most = F.least(F.lit(most), F.size(a), F.size(b))
    ok = F.filter(F.sequence(F.lit(1), F.greatest(k_most, F.lit(1))), lambda k: (k <= k_most) & (F.aggregate(F.zip_with(F.slice(a, F.size(a) - k + 1, k), F.slice(b, F.lit(1), k), like), F.lit(0.0), lambda s, v: s + v) >= similarity * k))
    return F.coalesce(F.array_max(ok), F.lit(0))


def split_at_banners(cells: DataFrame) -> DataFrame:
    """(table_id, part, r): rows of a table with the number of the part they are in; a row with one filled cell before a row whose number starts again begins a part."""
    x = cells.groupBy("table_id", "r").agg(F.count_if(F.col("cell") != "").alias("filled"), F.max(F.when(F.col("c") == 0, F.regexp_extract("cell", r"^([0-9]{1,3})\b", 1))).alias("lead"))
    w = W.partitionBy("table_id").orderBy("r")
    x = x.withColumn("num", F.when(F.col("lead") != "", F.col("lead").cast("int"))).withColumn("before", F.last("num", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("next", F.lead("num").over(w))
    cut = (F.col("filled") == 1) & F.col("next").isNotNull() & F.col("before").isNotNull() & (F.col("next") <= F.col("before"))
    return x.withColumn("part", F.sum(F.when(cut, 1).otherwise(0)).over(w)).select("table_id", "part", "r")


def width_regimes(cells: DataFrame, ratio: float = 1.6) -> DataFrame:
    """(table_id, r): rows where the filled width changes by the ratio and keeps to it: two rows alike before, two alike from here on."""
    x = cells.groupBy("table_id", "r").agg(F.count_if(F.col("cell") != "").alias("w"))
    o = W.partitionBy("table_id").orderBy("r")
    x = x.withColumn("a", F.lag("w", 2).over(o)).withColumn("b", F.lag("w", 1).over(o)).withColumn("d", F.lead("w", 1).over(o))
    big, small = F.greatest("b", "w"), F.least("b", "w")
    return x.where((F.col("a") == F.col("b")) & (F.col("w") == F.col("d")) & (big >= ratio * small)).select("table_id", "r")


def header_islands(cells: DataFrame) -> DataFrame:
    """(table_id, start, end, n): stretches of filled cells in the first row: the spans of a two-row header."""
    first = cells.groupBy("table_id").agg(F.min("r").alias("r"))
    return islands(cells.join(first, ["table_id", "r"], "left_semi").where("cell != ''"), ["table_id"], "c")


def banner_html(cells: DataFrame) -> DataFrame:
    """(table_id, r, html): rows with one filled cell as a cell spanning the table's mode width."""
    b = cells.where("cell != ''").groupBy("table_id", "r").agg(F.count("*").alias("n"), F.min("cell").alias("cell")).where("n = 1")
    return b.join(mode_width(cells), "table_id").select("table_id", "r", F.concat(F.lit('<tr><td colspan="'), F.col("width"), F.lit('">'), "cell", F.lit("</td></tr>")).alias("html"))


def strict_audit(cells: DataFrame, ink: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, rows, inked, too_wide, too_narrow, reason): every table's non-blank rows against the rows with ink, without tolerance.

    Both are paired by their order; a row's effective width (place of its last filled cell) must lie between its ink's and the table's columns (table_id, cols). `reason` is rows,
    width, rows+width or null.
    """
    w = W.partitionBy("table_id").orderBy("r")
    a = cells.where("trim(cell) != ''").groupBy("table_id", "r").agg((F.max("c") + 1).alias("w")).withColumn("k", F.row_number().over(w)).drop("r")
    b = ink.where("ink").groupBy("table_id", "r").agg((F.max("c") + 1).alias("iw")).withColumn("k", F.row_number().over(w)).drop("r")
    x = a.join(b, ["table_id", "k"], "full_outer").join(columns, "table_id")
    g = x.groupBy("table_id").agg(F.count("w").alias("rows"), F.count("iw").alias("inked"), F.count_if(F.col("w") > F.col("cols")).alias("too_wide"), F.count_if(F.col("w") < F.coalesce("iw", F.lit(0))).alias("too_narrow"))
    rows, wide = F.col("rows") != F.col("inked"), F.col("too_wide") + F.col("too_narrow") > 0
    return g.withColumn("reason", F.when(rows & wide, "rows+width").when(rows, "rows").when(wide, "width"))


def cell_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(table_id, cells, agree): cells of two readings with digits in either, and those with the same digits."""
    digits = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")
    x = a.select("table_id", "r", "c", digits(F.col("cell")).alias("a")).join(b.select("table_id", "r", "c", digits(F.col("cell")).alias("b")), ["table_id", "r", "c"], "full_outer").fillna("", ["a", "b"])
    return x.where("a != '' or b != ''").groupBy("table_id").agg(F.count("*").alias("cells"), F.count_if(F.col("a") == F.col("b")).alias("agree"))


def near_tables(lines: DataFrame, context: int = 4) -> DataFrame:
    """(doc_id, line_no, line): lines within `context` of a table's lines, a mark before each gap; documents without tables whole. Lines are (doc_id, line_no, line)."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    x = lines.withColumn("o", F.col("line").rlike("(?i)<table\\b").cast("int")).withColumn("e", F.col("line").rlike("(?i)</table>").cast("int"))
    x = x.withColumn("depth", F.sum("o").over(w) - F.coalesce(F.sum("e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("inside", (F.col("depth") > 0).cast("int")).withColumn("near", F.max("inside").over(w.rowsBetween(-context, context)))
    x = x.withColumn("any", F.max("inside").over(W.partitionBy("doc_id")))
    x = x.where("near = 1 or any = 0").withColumn("gap", F.coalesce(F.col("line_no") > F.lag("line_no").over(w) + 1, F.lit(False)))
    return x.select("doc_id", "line_no", F.when(F.col("gap"), F.concat(F.lit("⋯⋯\n"), "line")).otherwise(F.col("line")).alias("line"))


def upsample(edge: Column, target: float = UP_TARGET, least: float = UP_EDGE, cap: float = UP_CAP) -> Column:
    """How much to enlarge cells of an edge length: up to the target, at most `cap` times; not at all from `least` on."""
    return F.when(edge < least, F.round(F.least(F.lit(cap), F.lit(target) / edge), 2)).otherwise(F.lit(1.0))


def blank_band(rows: Column, least: float = 3.0) -> Column:
    """Whether no row of a band (ink per row, rule rows taken out) has `least` ink."""
    return F.coalesce(F.array_max(rows), F.lit(0.0)) < least


def narrow_columns(bounds: Column, ink: Column, share: float = 0.5, least: float = 3.0) -> Column:
    """Boundaries without those of phantom columns: narrower than `share` of the median width and with less than `least` ink of their own (`ink` holds each column's)."""
    widths = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.element_at(bounds, i + 1) - F.element_at(bounds, i))
    mid = F.element_at(F.array_sort(widths), (F.size(widths) / 2).cast("int") + 1)
    phantom = lambda i: (F.element_at(bounds, i + 1) - F.element_at(bounds, i) < share * mid) & (F.element_at(ink, i) < least)
    return F.when(F.size(bounds) < 3, bounds).otherwise(F.filter(bounds, lambda b, i: (i == 0) | (i == F.size(bounds) - 1) | ~phantom(F.greatest(i, F.lit(1)))))
