"""Ordered rows: islands, runs, gaps, cuts, intervals, numbered headings, table rows and grids.

Rows come long, with the columns that order them named; every group is bounded by its own image, document or table. Null values end a run; empty groups give no
rows. Folds that need the whole order of one group run as `aggregate` inside a row or as grouped Arrow batches over one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], pos: str, gap: int = 1) -> DataFrame:
    """(by, start, end, n): positions merged while they are at most `gap` apart."""
    w = W.partitionBy(*by).orderBy(pos)
    x = df.select(*by, pos).distinct().withColumn("new", F.when(F.col(pos) - F.lag(pos).over(w) <= gap, 0).otherwise(1))
    x = x.withColumn("island", F.sum("new").over(w))
    return x.groupBy(*by, "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n")).drop("island")


def longest_runs(df: DataFrame, by: list[str], line: str, pos: str, least: int) -> DataFrame:
    """(by, centre, run): columns whose longest run is at least `least`, neighbours merged to their centre."""
    r = islands(df, [*by, line], pos).groupBy(*by, line).agg(F.max("n").alias("run")).where(F.col("run") >= least)
    m = islands(r, by, line)
    return m.select(*by, ((F.col("start") + F.col("end")) / 2).alias("centre"), F.col("n").alias("width"))


def gap_centres(profile: DataFrame, by: list[str], pos: str, value: str, low: float, bridge: int = 2) -> DataFrame:
    """(by, centre, n): mean centres of stretches at or below `low`, breaks up to `bridge` tolerated."""
    g = islands(profile.where(F.col(value) <= low), by, pos, bridge + 1)
    return g.select(*by, ((F.col("start") + F.col("end")) / 2).alias("centre"), "n")


def boundaries(cuts: Column, total: Column) -> Column:
    """Sorted distinct cuts with 0 and the total."""
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("double")), cuts, F.array(total.cast("double")))))


def group_boundaries(bounds: Column, most: float) -> Column:
    """Greedy groups of neighbouring boundaries no wider than `most` (a single wider cell stays alone): the kept boundaries."""
    start = F.struct(F.array(F.element_at(bounds, 1)).alias("kept"), F.element_at(bounds, 1).alias("last"))
    done = F.aggregate(F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0))), start, lambda s, x: F.struct(
        F.when((x - F.element_at(s.kept, -1) > most) & (s.last > F.element_at(s.kept, -1)), F.array_append(s.kept, s.last)).otherwise(s.kept).alias("kept"), x.alias("last")))
    return F.array_distinct(F.array_append(done.kept, done["last"]))


def even_chunks(n: Column, most: int) -> Column:
    """Starts and sizes of the fewest even bands of at most `most` of n cells."""
    k = F.greatest(F.ceil(n / most), F.lit(1))
    return F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: F.struct(F.floor(i * n / k).cast("int").alias("start"), (F.floor((i + 1) * n / k) - F.floor(i * n / k)).cast("int").alias("size")))


def nearest_gap(profile: DataFrame, targets: DataFrame, by: list[str], pos: str, value: str, search: int) -> DataFrame:
    """(by, target, cut): the zero position nearest to the target within the search range, else the first minimum."""
    x = targets.withColumn("p", F.explode(F.expr(f"sequence(target - {search}, target + {search})"))).join(profile.select(*by, F.col(pos).alias("p"), F.col(value).alias("v")), [*by, "p"])
    key = F.struct((F.col("v") != 0).alias("ink"), F.when(F.col("v") != 0, F.col("v")).otherwise(0.0).alias("v"), F.when(F.col("v") == 0, F.abs(F.col("p") - F.col("target"))).otherwise(F.lit(0)).alias("d"), "p")
    return x.groupBy(*by, "target").agg(F.min(key).alias("k")).select(*by, "target", F.col("k.p").alias("cut"))


def snap(profile: DataFrame, cuts: DataFrame, by: list[str], pos: str, value: str, reach: int = 25) -> DataFrame:
    """(by, cut): each cut moved to the first position of least ink within reach; distinct."""
    x = cuts.withColumn("p", F.explode(F.expr(f"sequence(cut - {reach}, cut + {reach})"))).join(profile.select(*by, F.col(pos).alias("p"), F.col(value).alias("v")), [*by, "p"])
    return x.groupBy(*by, "cut").agg(F.min(F.struct("v", "p")).alias("m")).select(*by, F.col("m.p").alias("cut")).distinct()


def union_intervals(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end, n): overlapping or touching intervals merged."""
    w = W.partitionBy(*by).orderBy("start", "end")
    x = df.withColumn("before", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("island", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w))
    return x.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Points with the disjoint interval that holds them: an as-of by start, then a test of the end."""
    i = intervals.select(*by, F.col("start").alias("_k"), "start", "end").withColumn("_t", F.lit(0))
    p = points.withColumn("_k", F.col(pos)).withColumn("_t", F.lit(1))
    w = W.partitionBy(*by).orderBy("_k", "_t").rowsBetween(W.unboundedPreceding, 0)
    u = i.unionByName(p, allowMissingColumns=True).withColumn("s", F.last("start", ignorenulls=True).over(w)).withColumn("e", F.last("end", ignorenulls=True).over(w))
    return u.where((F.col("_t") == 1) & (F.col(pos) <= F.col("e"))).select(*points.columns, F.col("s").alias("start"), F.col("e").alias("end"))


# ---- numbered headings: rows (doc_id, line_no, level, kind, num, is_heading, text) ----


def demote_pseudo(h: DataFrame) -> DataFrame:
    """Headings that end like a sentence become text, unless the next heading is deeper."""
    nxt = F.lead(F.when(F.col("is_heading"), F.col("level")), 1).over(W.partitionBy("doc_id").orderBy("line_no"))
    pseudo = F.col("text").rlike("[。；;，,.]$") & F.col("is_heading") & ~(F.coalesce(nxt > F.col("level"), F.lit(False)))
    return h.withColumn("is_heading", F.col("is_heading") & ~pseudo)


def prefix(h: DataFrame, cond: Column) -> DataFrame:
    """Rows of each document before the first that fails the condition."""
    stop = F.sum(F.when(cond, 0).otherwise(1)).over(W.partitionBy("doc_id").orderBy("line_no"))
    return h.withColumn("_s", stop).where("_s = 0").drop("_s")


def fill_gaps(h: DataFrame) -> DataFrame:
    """(doc_id, line_no, num): text lines whose number is missing between two neighbouring headings of one level and kind, each found exactly once between them and in order."""
    hd = h.where("is_heading")
    w = W.partitionBy("doc_id", "level", "kind").orderBy("line_no")
    pair = hd.withColumn("to_num", F.lead("num").over(w)).withColumn("to_line", F.lead("line_no").over(w)).where("to_num - num between 2 and 20")
    want = pair.select("doc_id", "kind", "level", F.col("line_no").alias("a"), F.col("to_line").alias("b"), F.explode(F.sequence(F.col("num") + 1, F.col("to_num") - 1)).alias("num"))
    got = want.join(h.where("not is_heading").select("doc_id", "kind", "num", "line_no"), ["doc_id", "kind", "num"]).where("line_no > a and line_no < b")
    once = got.withColumn("c", F.count("*").over(W.partitionBy("doc_id", "kind", "level", "a", "num"))).where("c = 1")
    o = once.withColumn("before", F.lag("line_no").over(W.partitionBy("doc_id", "kind", "level", "a").orderBy("num")))
    bad = o.where("before > line_no").select("doc_id", "kind", "level", "a").distinct()
    return o.join(bad, ["doc_id", "kind", "level", "a"], "left_anti").select("doc_id", "line_no", "level", "num")


def majority_chains(h: DataFrame, gap: int = 5, least: int = 3) -> DataFrame:
    """Chains of rising numbers of a kind (each at most `gap` above the one before): members get the majority of their heading flags (ties: heading); shorter chains keep theirs."""
    w = W.partitionBy("doc_id", "kind").orderBy("line_no")
    x = h.withColumn("d", F.col("num") - F.lag("num").over(w)).withColumn("chain", F.sum(F.when(F.col("d").between(1, gap), 0).otherwise(1)).over(w))
    c = W.partitionBy("doc_id", "kind", "chain")
    votes = F.sum(F.col("is_heading").cast("int")).over(c) * 2 >= F.count("*").over(c)
    return x.withColumn("is_heading", F.when(F.count("*").over(c) >= least, votes).otherwise(F.col("is_heading"))).drop("d", "chain")


def complete(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """Missing values between two anchors whose difference is their distance are filled."""
    back, ahead = (W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(pos), F.desc(pos)))  # both grow row by row; a frame to the last row is read anew for each row
    pv, pp = F.last(value, ignorenulls=True).over(back), F.last(F.when(F.col(value).isNotNull(), F.col(pos)), ignorenulls=True).over(back)
    nv, np_ = F.last(value, ignorenulls=True).over(ahead), F.last(F.when(F.col(value).isNotNull(), F.col(pos)), ignorenulls=True).over(ahead)
    fits = (nv - pv) == (np_ - pp)
    return df.withColumn("filled", F.coalesce(F.col(value), F.when(fits, pv + F.col(pos) - pp)))


# ---- tables: rows (table_id, r, c, cell) ----


def column_number_rows(cells: DataFrame, least: int = 5, run: int = 5) -> DataFrame:
    """(table_id, r, first): rows of at least `least` filled cells, four fifths of them whole numbers, `run` of which count up one by one; first is their first number's column."""
    x = cells.withColumn("cell", F.trim("cell")).where("cell != ''").withColumn("n", F.when(F.col("cell").rlike("^[0-9]{1,9}$"), F.col("cell").cast("int")))
    g = x.groupBy("table_id", "r").agg(F.count("*").alias("filled"), F.count("n").alias("ints"), F.min(F.when(F.col("n").isNotNull(), F.col("c"))).alias("first"))
    w = W.partitionBy("table_id", "r").orderBy("c")
    i = _runs(x.where("n is not null"), w)
    longest = i.groupBy("table_id", "r", "part").agg(F.count("*").alias("k")).groupBy("table_id", "r").agg(F.max("k").alias("k"))
    return g.join(longest, ["table_id", "r"]).where((F.col("filled") >= least) & (F.col("ints") * 5 >= F.col("filled") * 4) & (F.col("k") >= run)).select("table_id", "r", "first")


def _runs(x: DataFrame, w) -> DataFrame:
    """Rows with the number of the counting-up run that they are in."""
    return x.withColumn("step", F.when(F.col("n") == F.lag("n").over(w) + 1, 0).otherwise(1)).withColumn("part", F.sum("step").over(w))


def mode_width(cells: DataFrame) -> DataFrame:
    """(table_id, width): the most frequent row width, the first seen on ties."""
    w = cells.groupBy("table_id", "r").agg(F.count("*").alias("width"))
    g = w.groupBy("table_id", "width").agg(F.count("*").alias("n"), F.min("r").alias("first"))
    return g.groupBy("table_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "width")).alias("b")).select("table_id", F.col("b.width").alias("width"))


def banners(cells: DataFrame) -> DataFrame:
    """(table_id, r, text, colspan): rows with exactly one filled cell, spanning the table's width."""
    one = cells.where("cell != ''").groupBy("table_id", "r").agg(F.count("*").alias("n"), F.min("cell").alias("text")).where("n = 1").drop("n")
    return one.join(mode_width(cells), "table_id").select("table_id", "r", "text", F.col("width").alias("colspan"))


def to_html(cells: DataFrame) -> DataFrame:
    """(table_id, html) of each table; cells escaped."""
    esc = F.replace(F.replace(F.replace(F.col("cell"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = cells.withColumn("cell", esc).groupBy("table_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda x: F.concat(F.lit("<td>"), x.cell, F.lit("</td>"))), "").alias("x"))  # one row's cells
    return row.groupBy("table_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda x: F.concat(F.lit("<tr>"), x.x, F.lit("</tr>"))), ""), F.lit("</table>")).alias("html"))


def from_html(df: DataFrame) -> DataFrame:
    """(table_id, r, c, cell) of HTML tables."""
    rows = df.select("table_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r", "row"))
    cells = rows.select("table_id", "r", F.posexplode(F.regexp_extract_all("row", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("c", "cell"))
    c = F.replace(F.replace(F.replace(F.regexp_replace("cell", "<[^>]*>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return cells.withColumn("cell", F.trim(c))


def reassemble(tiles: DataFrame) -> DataFrame:
    """(img, row, col, cell) of tiles (img, tr, tc, r, c, cell) put together.

    A tile column's width is the most frequent width of its tiles (smaller on ties), those whose row count is over 1.8 or under 0.4 of their band's median not counting; a band is as high
    as its highest tile; cells beyond the width are cut, missing ones are ''.
    """
    size = tiles.groupBy("img", "tr", "tc").agg((F.max("c") + 1).alias("w"), (F.max("r") + 1).alias("h"))
    med = size.groupBy("img", "tr").agg(F.expr("percentile(h, 0.5)").alias("med"), F.max("h").alias("height"))
    votes = size.join(med, ["img", "tr"]).where("h <= 1.8 * med and h >= 0.4 * med").groupBy("img", "tc", "w").count()
    width = votes.groupBy("img", "tc").agg(F.min(F.struct((-F.col("count")).alias("m"), "w")).alias("b")).select("img", "tc", F.col("b.w").alias("width"))
    x0 = F.sum("width").over(W.partitionBy("img").orderBy("tc")) - F.col("width")
    y0 = F.sum("height").over(W.partitionBy("img").orderBy("tr")) - F.col("height")
    width, bands = width.withColumn("x0", x0), med.select("img", "tr", "height").withColumn("y0", y0)
    frame = width.join(bands, "img").withColumn("c", F.explode(F.expr("sequence(0, int(width) - 1)"))).withColumn("r", F.explode(F.expr("sequence(0, int(height) - 1)")))
    return frame.join(tiles, ["img", "tr", "tc", "r", "c"], "left").select("img", (F.col("y0") + F.col("r")).alias("row"), (F.col("x0") + F.col("c")).alias("col"), F.coalesce("cell", F.lit("")).alias("cell"))


def panels(cells: DataFrame, n: int) -> DataFrame:
    """Side-by-side panels of a table one under the other: (table_id, panel, r, c, cell)."""
    k = F.ceil(F.col("width") / n)
    return cells.join(cells.groupBy("table_id").agg((F.max("c") + 1).alias("width")), "table_id").select("table_id", F.floor(F.col("c") / k).alias("panel"), "r", (F.col("c") % k).alias("c"), "cell")


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables joined by number, the second's cells after the first's; the short side adds no padding."""
    wa = a.groupBy("table_id", "r").agg(F.count("*").alias("w"))
    moved = b.join(wa, ["table_id", "r"], "left").select("table_id", "r", (F.col("c") + F.coalesce("w", F.lit(0))).alias("c"), "cell")
    return a.select("table_id", "r", F.col("c").cast("bigint").alias("c"), "cell").unionByName(moved)


def integral(df: DataFrame, by: list[str], y: str, x: str, value: str) -> DataFrame:
    """Two-dimensional prefix sums."""
    rows = F.sum(value).over(W.partitionBy(*by, y).orderBy(x))
    return df.withColumn("_r", rows).withColumn("integral", F.sum("_r").over(W.partitionBy(*by, x).orderBy(y))).drop("_r")


def number_format_votes(cells: DataFrame, least: int = 3) -> DataFrame:
    """(table_id, c, template, n): the most frequent shape of a column's numbers (digits as 0; smaller shape on ties) with at least `least` votes."""
    v = cells.where(F.col("r") > 0).where(F.col("cell").rlike(r"^[0-9][0-9,.]*%?$")).withColumn("template", F.regexp_replace("cell", "[0-9]+", "0"))
    g = v.groupBy("table_id", "c", "template").count()
    return g.groupBy("table_id", "c").agg(F.min(F.struct((-F.col("count")).alias("m"), "template")).alias("b")).select("table_id", "c", F.col("b.template").alias("template"), (-F.col("b.m")).alias("n")).where(F.col("n") >= least)


def tighten(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("ink").alias("mean"))
