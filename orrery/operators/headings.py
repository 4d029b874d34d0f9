"""Heading levels of documents that were read strip by strip: each strip's `#` counts are relative, the numbering tells the levels.

`relevel` runs in three steps: the first strip with text gets its title put together (a row function), the headings of all strips go through the level program, grouped
by document (only heading lines, not the texts, enter a group), and the levels go back into the strips by a join. The level program keeps a stack of open headings, the
last level of every numbering series and the scope of a table of contents; its rules are tried in order, the first that applies decides.

Strips come as (doc_id, pos, text). Null texts count as empty and come out empty; documents without headings come out as they are; repeated strips must be
removed before; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = re.compile(r"^([#＃]{1,6})\s+(.*)$")
#: The same for the JVM: lines with their mark and text.
HEAD_JVM = r"^([#＃]{1,6})\s+(.*)$"
NUMBERS = "一二三四五六七八九十百零两〇"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
CODE = re.compile(r"[A-Za-z0-9]{8,}")  # a registration number, as in lines that describe the file
NAMES_A_DOCUMENT = re.compile("条款|保险|公司|合同|附加|目录")
LONGEST_TITLE, TITLE_LINES, WRAPPED, WRAPPED_LINES = 40, 5, 44, 3


class Marker(NamedTuple):
    """What a heading begins with: its kind of number and the number's parts."""

    kind: str
    path: tuple[int, ...]

    @property
    def series(self):
        """Numbers of one series follow each other; a dotted number's series is that of its parent."""
        return None if not self.path else (self.kind, self.path[:-1] if self.kind == "dec" else ())

    def follows(self, other: Marker) -> bool:
        return bool(self.path) and self.kind == other.kind and len(self.path) == len(other.path) and self.path[:-1] == other.path[:-1] and self.path[-1] == other.path[-1] + 1

    def is_below(self, other: Marker) -> bool:
        """1.2 below 1, 1.2.3 below 1.2."""
        return self.kind == "dec" and other.kind in ("dec", "int") and len(self.path) == len(other.path) + 1 and self.path[:-1] == other.path and (other.kind == "dec" or len(other.path) == 1)


UNTITLED = Marker("title", ())


def han_value(s: str) -> int | None:
    """Value of a Han numeral below a thousand; a missing hundreds or tens figure counts as one."""
    digits = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
    total, rest = 0, s
    for sign, value in (("百", 100), ("十", 10)):
        if sign in rest:
            before, rest = rest.split(sign, 1)
            total += value * (digits.get(before) or 1)
    return total + sum(digits.get(c, 0) for c in rest) or None


_HAN = f"([{NUMBERS}]+)"
_SHAPES = [(re.compile(p), kind) for p, kind in ((rf"第\s*{_HAN}\s*章", "chap"), (rf"第\s*{_HAN}\s*条", "art"), (rf"{_HAN}\s*[、.]", "cndun"), (rf"[（(]\s*{_HAN}\s*[)）]", "cnpar"), (rf"{_HAN}\s*[)）]", "cnpar"), (r"[（(]\s*(\d+)\s*[)）]", "numpar"), (r"(\d+(?:\.\d+)+)", "dec"), (r"(\d+)\s*[.、\s]", "int"))]


def marker(text: str | None) -> Marker:
    s = (text or "").strip()
    if s[:1] and s[0] in CIRCLED:  # before the compatibility forms, which would make it a plain number
        return Marker("circ", (CIRCLED.index(s[0]) + 1,))
    s = unicodedata.normalize("NFKC", s)
    for shape, kind in _SHAPES:
        m = shape.match(s)
        if m:
            path = tuple(int(x) for x in m[1].split(".")) if m[1][0].isdigit() else (han_value(m[1]),)
            if path[0] is not None:
                return Marker(kind, path)
    return UNTITLED


def clamp(level: int) -> int:
    return max(1, min(6, level))


def anchor(text: str) -> int:
    """Level of a document's first heading."""
    m = marker(text)
    return clamp(len(m.path)) if m.kind == "dec" else 1 if m.kind in ("title", "int", "art", "chap") else 2


@dataclass
class Levels:
    """The state of the level program."""

    top: int
    open: list[tuple[Marker, int]] = field(default_factory=list)
    series: dict = field(default_factory=dict)  # series -> (last marker, its level)
    last: tuple[Marker, int] | None = None
    last_heading: tuple[str, int, int] | None = None  # text, mark and strip of the heading before
    numbered: bool = False
    contents: int | None = None
    contents_began: bool = False

    def forget(self) -> None:
        self.open.clear()
        self.series.clear()
        self.last = None

    def level(self, text: str, raw: int, strip: int, first: bool) -> int:
        m = marker(text)
        if self.contents is not None:
            again = m == Marker("int", (1,)) and self.contents_began
            if again or (m.kind == "title" and "目录" not in text):  # the text itself begins
                self.contents, self.contents_began = None, False
                self.forget()
            elif m.kind != "title":
                self.contents_began |= m == Marker("int", (1,))
                self.last_heading = (text, raw, strip)
                return clamp(self.contents + (len(m.path) if m.kind == "dec" else 1))
        level = self.top if first else self.proposed(m, raw, strip)
        if m.kind == "art":  # a clause lies below its chapter
            chapter = self.chapter()
            level = max(level, chapter + 1) if chapter is not None else level
        level = clamp(level)
        while self.open and self.open[-1][1] >= level:
            self.open.pop()
        self.open.append((m, level))
        if m.series is not None:
            self.series[m.series] = (m, level)
        if m.kind != "title":
            self.numbered = True
        self.last, self.last_heading = (m, level), (text, raw, strip)
        if m.kind == "title" and "目录" in text:
            self.contents, self.contents_began = level, False
            self.forget()
            self.last = (m, level)
        return level

    def proposed(self, m: Marker, raw: int, strip: int) -> int:
        if m.kind == "title":
            near = self.numbered and self.last and self.last_heading and self.last_heading[2] == strip
            return self.last[1] + raw - self.last_heading[1] if near else self.top
        for rule in (self.sibling, self.resumed, self.child, getattr(self, "of_" + m.kind)):
            level = rule(m)
            if level is not None:
                return level
        return self.last[1] if self.last else self.top

    def chapter(self) -> int | None:
        return next((v for x, v in reversed(self.open) if x.kind == "int" and len(x.path) == 1), None)

    def known(self, m: Marker) -> int | None:
        return self.series[m.series][1] if m.series in self.series else None

    def after(self, *kinds: str) -> bool:
        return self.last is not None and self.last[0].kind in kinds

    def sibling(self, m: Marker) -> int | None:
        """Next to the deepest open heading of its series, if it is that one's successor."""
        for x, v in reversed(self.open):
            if x.series == m.series:
                return v if x.path[-1] == m.path[-1] - 1 else None
        return None

    def resumed(self, m: Marker) -> int | None:
        return self.known(m) if m.series in self.series and m.follows(self.series[m.series][0]) else None

    def child(self, m: Marker) -> int | None:
        return self.last[1] + 1 if self.last and m.is_below(self.last[0]) else None

    def of_dec(self, m: Marker) -> int:
        parents = [Marker("dec", m.path[:-1])] + ([Marker("int", m.path[:1])] if len(m.path) == 2 else [])
        for p in parents:
            level = next((v for x, v in reversed(self.open) if x == p), None)
            if level is not None:
                return level + 1
        seen = self.known(m)
        return seen if seen is not None else self.top + max(0, len(m.path) - 1)

    def of_int(self, m: Marker) -> int:
        if m.path[0] == 1 and self.after("cndun", "cnpar", "numpar", "circ", "dec"):  # a list begins inside
            return self.last[1] + 1
        seen = self.known(m)
        return seen if seen is not None else self.top

    def of_art(self, m: Marker) -> int:
        seen, chapter = self.known(m), self.chapter()
        if chapter is not None and (seen is None or seen <= chapter):
            return chapter + 1
        if seen is not None:
            return seen
        if self.after("int", "dec"):
            return self.last[1] + 1
        if self.last and self.last_heading and marker(self.last_heading[0]).kind == "title" and not NAMES_A_DOCUMENT.search(unicodedata.normalize("NFKC", self.last_heading[0])):
            return self.last[1] + 1
        return self.top

    def of_cndun(self, m: Marker) -> int:
        if m.path[0] == 1 and self.after("int", "dec", "art"):
            return self.last[1] + 1
        if self.after("cnpar", "numpar", "circ"):
            return max(self.top, self.last[1] - 1)
        seen = self.known(m)
        return seen if seen is not None else self.top

    def of_cnpar(self, m: Marker) -> int | None:
        if m.path[0] == 1 and self.after("cndun", "dec", "int", "art"):
            return self.last[1] + 1
        seen = self.known(m)
        return seen if seen is not None else self.last[1] + 1 if self.last else self.top

    of_numpar = of_circ = of_cnpar

    def of_chap(self, m: Marker) -> int | None:
        return None


def levels(headings: list[tuple[int, str, int]], top: int | None = None) -> list[int]:
    """Levels of a document's headings (mark count, text, strip) in order; `top` is the first one's, by default what its text says."""
    if not headings:
        return []
    state = Levels(anchor(headings[0][1]) if top is None else top)
    return [state.level(text, raw, strip, k == 0) for k, (raw, text, strip) in enumerate(headings)]


# ---- lines of one strip ----


def plain_title(s: str, longest: int) -> bool:
    """Whether a line may be part of a title: no number, no code, short, no sentence."""
    return not CODE.search(s) and marker(s).kind == "title" and len(s) <= longest and "。" not in s


def promote_title(text: str) -> str:
    """A title in front of the first heading, written as plain lines, becomes one heading."""
    lines = text.split("\n")
    found = []
    for i, line in enumerate(lines):
        s = line.strip()
        if HEAD.match(line) or len(found) == TITLE_LINES or s and not plain_title(s, LONGEST_TITLE):
            break
        if s:
            found.append(i)
    if not found:
        return text
    head = "# " + " ".join(lines[i].strip() for i in found)
    return "\n".join(head if i == found[0] else x for i, x in enumerate(lines) if i not in found[1:])


def join_wrapped_title(text: str) -> str:
    """Plain lines after an unnumbered first heading that go on with it are joined to it."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if HEAD.match(x)), None)
    if at is None or marker(HEAD.match(lines[at])[2]).kind != "title":
        return text
    more = []
    for i in range(at + 1, len(lines)):
        s = lines[i].strip()
        if s and (HEAD.match(s) or not plain_title(s, WRAPPED) or len(more) == WRAPPED_LINES):
            break
        if s:
            more.append(i)
    if not more:
        return text
    m = HEAD.match(lines[at])
    lines[at] = " ".join([m[1], m[2].strip(), *(lines[i].strip() for i in more)])
    return "\n".join(x for i, x in enumerate(lines) if i not in more)


def is_sentence(text: str) -> bool:
    """Whether a heading's text ends like a statement: in a semicolon, or without a number in a colon or full stop."""
    s = text.strip()
    return s.endswith(("；", ";")) or s.endswith(("：", ":", "。")) and marker(s).kind == "title"


def demote_sentences(text: str) -> str:
    """Headings that are statements become text, unless the strip's next heading is deeper."""
    lines = text.split("\n")
    heads = [(i, HEAD.match(x)) for i, x in enumerate(lines) if HEAD.match(x)]
    for k, (i, m) in enumerate(heads):
        nxt = heads[k + 1] if k + 1 < len(heads) else None
        if is_sentence(m[2]) and not (nxt and len(nxt[1][1]) > len(m[1])):
            lines[i] = m[2].strip()
    return "\n".join(lines)


def contents_to_headings(text: str) -> str:
    """Numbered list items after a contents heading become headings, up to the first line that is none."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if HEAD.match(x) and "目录" in x), None)
    for i in range(at + 1, len(lines)) if at is not None else ():
        s = lines[i].strip()
        if not s or HEAD.match(lines[i]):
            continue
        m = re.match(r"\s*[*+-]\s+(.*)$", lines[i])
        if not m or marker(m[1]).kind == "title":
            break
        lines[i] = "# " + m[1].strip()
    return "\n".join(lines)


def demote_strays(text: str) -> str:
    """A numbered heading right after the two numbers before it, both text, whose neighbours in number are no headings, becomes text."""
    lines = text.split("\n")
    seen = [(i, HEAD.match(x), x) for i, x in enumerate(lines) if x.strip()]
    single = {marker(m[2]) for _, m, _ in seen if m}
    for (_, a, x), (_, b, y), (i, m, _) in zip(seen, seen[1:], seen[2:], strict=False):
        if m and not a and not b:
            k = marker(m[2])
            if len(k.path) == 1 and k.path[0] >= 3:
                at = lambda d, k=k: Marker(k.kind, (k.path[0] + d,))
                if marker(y) == at(-1) and marker(x) == at(-2) and at(-1) not in single and at(1) not in single:
                    lines[i] = m[2]
    return "\n".join(lines)


def part_formats(text: str) -> str:
    """Where at the highest level of a region (from one unnumbered first-level heading to the next) dotted numbers and single ones, three of each, stand side by side, the
    single ones go one level down."""
    lines = text.split("\n")
    regions: list[list[tuple[int, int, str]]] = []
    for i, x in enumerate(lines):
        m = HEAD.match(x)
        if m and m[2]:
            if not regions or len(m[1]) == 1 and marker(m[2]).kind == "title":
                regions.append([])
            regions[-1].append((i, len(m[1]), m[2]))
    for region in regions:
        high = min(v for _, v, _ in region)
        dotted = [i for i, v, s in region if v == high and marker(s).kind == "dec"]
        single = [(i, s) for i, v, s in region if v == high and len(marker(s).path) == 1 and marker(s).kind != "dec"]
        if len(dotted) >= 3 and len(single) >= 3 and high < 6:
            for i, s in single:
                lines[i] = "#" * (high + 1) + " " + s
    return "\n".join(lines)


def row_function(fn):
    """A text function of whole rows as a column function (Arrow)."""
    return F.pandas_udf(lambda s: s.map(lambda x: fn(x) if isinstance(x, str) else None), T.StringType())


# ---- documents ----


def _levels_of_document(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf.sort_values(["pos", "line"])
    first = marker(x["text"].iloc[0])
    keep = first.kind == "cnpar" and first.path[0] != 1  # from the middle of a list on: nothing tells the levels
    x = x.assign(level=list(x["raw"]) if keep else levels(list(zip(x["raw"].tolist(), x["text"].tolist(), x["pos"].tolist(), strict=True))))
    return x[["doc_id", "pos", "line", "level"]]


def heading_lines(strips: DataFrame) -> DataFrame:
    """(doc_id, pos, line, raw, text) of the heading lines."""
    x = strips.select("doc_id", "pos", F.posexplode(F.split("text", "\n")).alias("line", "x")).where(F.col("x").rlike(HEAD_JVM))
    return x.select("doc_id", "pos", "line", F.length(F.regexp_extract("x", HEAD_JVM, 1)).alias("raw"), F.regexp_extract("x", HEAD_JVM, 2).alias("text"))


def heading_levels(heads: DataFrame) -> DataFrame:
    """(doc_id, pos, line, level) of heading lines (doc_id, pos, line, raw, text)."""
    return heads.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("line").cast("int").alias("line"), F.col("raw").cast("int").alias("raw"), "text").groupBy("doc_id").applyInPandas(_levels_of_document, "doc_id string, pos bigint, line int, level int")


def relevel(strips: DataFrame) -> DataFrame:
    """(doc_id, pos, text) with the titles put together, statements demoted and every heading at its level."""
    x = strips.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    first = x.where(F.trim("text") != "").groupBy("doc_id").agg(F.min("pos").alias("first"))
    titled = row_function(lambda s: join_wrapped_title(promote_title(s)))
    x = x.join(first, "doc_id", "left")
    x = x.select("doc_id", "pos", row_function(demote_sentences)(F.when(F.col("pos") == F.col("first"), titled("text")).otherwise(F.col("text"))).alias("text"))
    got = heading_levels(heading_lines(x)).groupBy("doc_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("line", "level"))).alias("levels"))  # a strip's headings
    level = lambda i: F.element_at("levels", i)
    lines = F.transform(F.split("text", "\n"), lambda y, i: F.when(F.col("levels").isNotNull() & level(i).isNotNull(), F.concat(F.repeat(F.lit("#"), level(i)), F.lit(" "), F.regexp_extract(y, HEAD_JVM, 2))).otherwise(y))
    return x.join(got, ["doc_id", "pos"], "left").select("doc_id", "pos", F.array_join(lines, "\n").alias("text"))


def heading_stats(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, n_pred, n_gold, level_accuracy, recall): headings (doc_id, place, level, text) matched in order by equal text; pairs whose levels agree over the larger number
    of headings, and the share of gold headings matched. Repeated texts match by their occurrence."""
    nth = lambda x: x.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "text").orderBy("place")))
    a, b = nth(pred), nth(gold)
    n = a.groupBy("doc_id").agg(F.count("*").alias("n_pred")).join(b.groupBy("doc_id").agg(F.count("*").alias("n_gold")), "doc_id", "full_outer").fillna(0, ["n_pred", "n_gold"])
    hit = a.join(b.select("doc_id", "text", "k", F.col("level").alias("gold_level")), ["doc_id", "text", "k"]).groupBy("doc_id").agg(F.count("*").alias("hits"), F.count_if(F.col("level") == F.col("gold_level")).alias("same"))
    x = n.join(hit, "doc_id", "left").fillna(0, ["hits", "same"])
    return x.select("doc_id", "n_pred", "n_gold", F.round(F.col("same") / F.greatest("n_pred", "n_gold"), 6).alias("level_accuracy"), F.round(F.when(F.col("n_gold") > 0, F.col("hits") / F.col("n_gold")), 6).alias("recall"))
