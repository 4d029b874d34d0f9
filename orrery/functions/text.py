"""Text columns: markers, cleaning, predicates, answers. All are built-in expressions unless they say Arrow.

Null gives null (predicates: false) unless stated; patterns name their character classes outright, as dialects differ on \\w.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAN = "一-鿿"
#: Han characters, their marks and full-width forms; horizontal white space.
WIDE, BLANK = "一-鿿\u3000-〿\uff00-\uffef", r"[ \t\r\x0B\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Han numerals, raised and lowered digits, circled numbers, letters of Roman figures.
NUMERALS, ORDINALS = "零一二三四五六七八九", "一二三四五六七八九十百零〇"
NUMBERS = "一二三四五六七八九十百零两〇"
RAISED, LOWERED, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()n"
LOWERED_LETTERS, PLAIN_LETTERS = "ₐₑₒₓₕₖₗₘₙₚₛₜ", "aeoxhklmnpst"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
ROMAN = dict(zip("I II III IV V VI VII VIII IX X XI XII".split(), "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", strict=True))


def sub(c, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(c: Column) -> Column:
    """Spaces between wide characters, and between them and digits, go; blanks are squeezed and the ends trimmed."""
    x = sub(c, f"(?<=[{WIDE}]){BLANK}+(?=[{WIDE}])")
    x = sub(x, f"(?<=[0-9]){BLANK}+(?=[{WIDE}])|(?<=[{WIDE}]){BLANK}+(?=[0-9])")
    return stripped(sub(x, "[ \\t]{2,}", " "))


def stripped(c: Column) -> Column:
    """Without white space at the ends."""
    return sub(c, f"^(?:{BLANK}|\n)+|(?:{BLANK}|\n)+$")


TITLE = "[一-龥][^。；：，%\\n]{1,21}"
#: What a heading begins with, the ranks of the families, in the order they are tried; dotted numbers get one more than their dots.
FAMILIES = [
    (f"^[0-9]{{1,2}}(?:\\.[0-9]{{1,3}})+[.、．]?[ \\t]*{TITLE}$", None),
    (f"^[一二三四五六七八九十]{{1,3}}[、．.][ \\t]*{TITLE}$", 3),
    (f"^[（(][一二三四五六七八九十]{{1,3}}[)）][ \\t]*{TITLE}$", 4),
    (f"^[0-9]{{1,2}}[、．.][ \\t]*{TITLE}$", 5),
    (f"^[（(][0-9]{{1,2}}[)）][ \\t]*{TITLE}$", 6),
]


def heading_rank(c: Column) -> Column:
    """Rank of a heading line by its marker family (1 the highest), else null; `heading` gives its text too."""
    x = stripped(c)
    top = F.substring(x, 1, 6)
    out = F.when(x.rlike(f"^第[{ORDINALS}0-9]+[章节编]") & (F.length(x) <= 40), F.when(top.contains("章") | top.contains("编"), 1).otherwise(2))
    for pattern, rank in FAMILIES:
        out = out.when(x.rlike(pattern), F.regexp_count(F.regexp_extract(x, "^[0-9.]*[0-9]", 0), F.lit("\\.")) + 1 if rank is None else F.lit(rank))
    return out


def heading(c: Column) -> Column:
    """(rank, text) of a heading line, else null."""
    r = heading_rank(c)
    return F.when(r.isNotNull(), F.struct(r.alias("rank"), stripped(c).alias("text")))


def article_no(c: Column) -> Column:
    """The clause number a line begins with, else ''."""
    return F.regexp_extract(stripped(c), f"^第[{ORDINALS}0-9]+条", 0)


def strip_latex(c: Column) -> Column:
    """Commands and raised braces go, their content stays; three levels; dollars go."""
    x = c
    for _ in range(3):
        x = sub(x, r"\\[A-Za-z]+\{([^{}]*)\}", "$1")
        x = sub(x, r"[\^_]\{([^{}]*)\}", "$1")
    return sub(x, r"\$", "")


def sentences(c: Column) -> Column:
    """Sentences with their terminators."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[^。！？!?\\n]+[。！？!?]?"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def strip_fences(c: Column) -> Column:
    return F.trim(sub(sub(F.trim(c), "^```[A-Za-z]*\\n", ""), "\\n?```$", ""))


def strip_html(c: Column) -> Column:
    """Tags go; rows and breaks become paragraphs."""
    x = sub(c, "(?i)<br\\s*/?>|</tr>|</p>", "\n")
    return sub(sub(sub(sub(x, "<[^>]*>", ""), "[ \\t]+", " "), "\\n{2,}", "\n"), "^\\s+|\\s+$")


def html_text(c: Column) -> Column:
    """Text of a page: script, style, head and comments go, block tags break lines, blank lines are squeezed."""
    x = sub(c, "(?is)<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->", "")
    x = sub(x, "(?i)</?(p|div|li|ul|ol|tr|table|h[1-6]|br|section|article)\\b[^>]*>", "\n")
    return sub(sub(sub(x, "<[^>]*>", ""), "\\n\\s*\\n+", "\n"), "^\\s+|\\s+$")


def evaluation_form(c: Column) -> Column:
    """Line ends unified, blanks of each line squeezed, three or more line feeds cut to two (after compatibility normalisation where wanted: `nfkc`)."""
    x = sub(sub(c, "\\r\\n?", "\n"), "[ \\t]+", " ")
    return F.trim(sub(sub(sub(x, " ?\\n ?", "\n"), "\\n{3,}", "\n\n"), "^ +| +$", ""))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation (Arrow: no built-in)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def caption_like(c: Column) -> Column:
    han, digits = F.length(sub(c, f"[^{HAN}]", "")), F.length(sub(c, "[^0-9]", ""))
    return F.coalesce((han >= 4) & (han > digits), F.lit(False))


def han_number(c: Column) -> Column:
    """Value of a Han numeral below a thousand, null if it has none: a missing hundreds or tens figure counts as one."""
    digit = lambda x: F.coalesce(F.nullif(F.instr(F.lit("一二三四五六七八九"), x), F.lit(0)), F.when(x == "两", 2))
    one = lambda x: F.when(F.length(x) == 1, F.coalesce(digit(x), F.lit(1))).otherwise(F.lit(1))

    def below(x, sign, value, rest):
        """The figure before a sign times its value, and what `rest` makes of what follows the sign."""
        return F.when(x.contains(sign), value * one(F.substring_index(x, sign, 1)) + let(F.substring(x, F.instr(x, F.lit(sign)) + 1, F.length(x)), rest)).otherwise(rest(x))

    units = lambda x: F.aggregate(F.split(x, ""), F.lit(0), lambda s, y: s + F.coalesce(F.when(F.length(y) == 1, digit(y)), F.lit(0)))
    return F.nullif(let(F.trim(c), lambda x: below(x, "百", 100, lambda y: below(y, "十", 10, units))), F.lit(0)).cast("int")


def marker(c: Column) -> Column:
    """(kind, path) of the number a line begins with: circ, chap, art, cndun, cnpar, numpar, dec or int; kind title without one.

    Circled numbers are looked at first: as compatibility forms they would be read as plain ones. Of the other forms the full-width ones
    are made plain before.
    """
    han = f"([{NUMBERS}]+)"
    by_han = [("chap", f"^第\\s*{han}\\s*章"), ("art", f"^第\\s*{han}\\s*条"), ("cndun", f"^{han}\\s*[、.]"), ("cnpar", f"^[（(]\\s*{han}\\s*[)）]"), ("cnpar", f"^{han}\\s*[)）]")]
    by_digit = [("numpar", "^[（(]\\s*([0-9]+)\\s*[)）]"), ("dec", "^([0-9]+(?:\\.[0-9]+)+)"), ("int", "^([0-9]+)\\s*[.、\\s]")]
    none = F.array().cast("array<int>")
    found = lambda kind, path: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), path.alias("path"))

    def numbered(x):
        number = han_number(F.regexp_extract(x, f"^(?:第|[（(])?\\s*{han}\\s*[章条、.)）]", 1))
        out = None
        for k, p in by_han:
            hit = x.rlike(p) & number.isNotNull()
            out = F.when(hit, found(k, F.array(number))) if out is None else out.when(hit, found(k, F.array(number)))
        for k, p in by_digit:
            path = F.transform(F.split(F.regexp_extract(x, p, 1), "\\."), lambda y: y.try_cast("int"))
            out = out.when(x.rlike(p) & F.element_at(path, 1).isNotNull(), found(k, path))
        return out.otherwise(found("title", none))

    def read(raw):
        at = F.instr(F.lit(CIRCLED), F.substring(raw, 1, 1))
        plain = F.translate(raw, "０１２３４５６７８９（）．\u3000\u00a0", "0123456789().  ")
        return F.when((F.length(raw) > 0) & (at > 0), found("circ", F.array(at))).otherwise(F.when(plain.rlike(f"^[第（(0-9{NUMBERS}]"), let(plain, numbered)).otherwise(found("title", none)))

    return F.when(c.isNotNull(), let(stripped(c), read))


def flatten_scripts(c: Column) -> Column:
    """Raised and lowered digits, signs and letters as plain ones."""
    return F.translate(F.translate(F.translate(c, RAISED, PLAIN), LOWERED, PLAIN[:15]), LOWERED_LETTERS, PLAIN_LETTERS)


def roman_grades(c: Column) -> Column:
    """ASCII Roman figures as single characters where they count grades: before a grading word or a mark that lists them, or after 素; X before a grading word only."""
    x = c
    for text, mark in sorted(ROMAN.items(), key=lambda p: -len(p[0])):
        grade = "[级期型度区]" if text == "X" else "[级期型度区,，、和或]"
        x = sub(x, f"(?<![A-Za-z]){text}(?={grade})" + ("" if text == "X" else f"|(?<=素){text}(?![A-Za-z])"), mark)
    return x


def flatten_math(c: Column) -> Column:
    """Fractions as a/b, text and operators plain, blanks squeezed."""
    x = sub(c, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    x = sub(x, r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}", "$1")
    for a, b in ((r"\\times", "×"), (r"\\leq", "≤"), (r"\\geq", "≥"), (r"\\cdot", "·"), (r"\\%", "%")):
        x = sub(x, a, b)
    return F.trim(sub(x, r"\s+", " "))


def fix_multi_dots(c: Column) -> Column:
    """d.ddd.dd as d,ddd.dd, only where the whole cell has that shape."""
    x = F.trim(c)
    return F.when(x.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+\.[0-9]{2}$"), F.concat(sub(F.substring(x, F.lit(1), F.length(x) - 3), r"\.", ","), F.substring(x, -3, 3))).otherwise(c)


def letters(c: Column) -> Column:
    """Answer letters of the first explicit conclusion line, in order of first occurrence; empty without one."""
    got = F.regexp_extract(c, r"(?i)(?:最终答案|正确答案|答案|answer)\s*[:：]?\s*[<*（(【「#\s]*([A-D][A-D，,、\s]*)", 1)
    return F.array_distinct(F.regexp_extract_all(F.upper(got), F.lit("[A-D]"), F.lit(0)))


# Words of a verdict, those that say no before those they hold, and those that say yes.
VERDICT, YES = "不正确|不成立|不符合|错误|假|正确|成立|符合|真", ("真", "正确", "成立", "符合")


def verdicts(c: Column, kind: Column) -> Column:
    """Options judged right: the last verdict after the last arrow of an option's part (or of its last 300 characters), the option's first part counting.

    All sorted letters for multiple answers, else the first.
    """
    parts = F.filter(F.split(c, r"(?=选项\s*[A-D])"), lambda x: x.rlike(r"^选项\s*[A-D]"))

    def read(p):
        body = sub(p, r"^选项\s*[A-D][:：.、\s]*")
        tail = F.when(body.contains("→"), F.element_at(F.split(sub(F.substring_index(body, "→", -1), r"\s+$"), "\n"), -1)).otherwise(body)
        last = lambda t: F.try_element_at(F.regexp_extract_all(t, F.lit(f"({VERDICT})"), F.lit(1)), F.lit(-1))
        return F.struct(F.regexp_extract(p, "([A-D])", 1).alias("option"), F.coalesce(last(tail), last(F.right(body, F.lit(300)))).isin(*YES).alias("right"))

    seen = F.filter(F.transform(parts, read), lambda v: v.right.isNotNull())
    first = F.aggregate(seen, F.array().cast("array<struct<option:string,right:boolean>>"), lambda s, v: F.when(F.exists(s, lambda y: y.option == v.option), s).otherwise(F.array_append(s, v)))
    good = F.array_sort(F.transform(F.filter(first, lambda v: v.right), lambda v: v.option))
    return F.when(kind == "multi", F.array_join(good, "")).otherwise(F.coalesce(F.try_element_at(good, F.lit(1)), F.lit("")))


def canonical_answer(c: Column, kind: Column) -> Column:
    """First letter for single answers, sorted distinct letters for multiple ones."""
    all_ = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit("[A-D]"), F.lit(0))
    return F.when(kind == "multi", F.array_join(F.array_sort(F.array_distinct(all_)), "")).otherwise(F.coalesce(F.try_element_at(all_, F.lit(1)), F.lit("")))


def valid_answer(c: Column, kind: Column) -> Column:
    return F.coalesce(F.when(kind == "multi", c.rlike("^A?B?C?D?$") & (c != "")).when(kind == "tf", c.rlike("^[AB]$")).otherwise(c.rlike("^[A-D]$")), F.lit(False))


def last_json(c: Column, field: str) -> Column:
    """A field of the last flat JSON object in a reply."""
    return F.get_json_object(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), F.lit(0)), F.lit(-1)), "$." + field)


def line_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of trimmed lines; two blanks give 1."""
    x, y = F.trim(a), F.trim(b)
    n = F.greatest(F.length(x), F.length(y))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / n)


def continues(a: Column, b: Column) -> Column:
    """Whether line b goes on with line a: a has no terminator, b starts neither a heading nor a list."""
    return F.coalesce(~F.trim(a).rlike("[。！？!?.；;：:]$") & ~F.trim(b).rlike(r"^(?:#|[-*•] |[0-9]+[.、]|[（(])") & (F.trim(a) != "") & (F.trim(b) != ""), F.lit(False))


def pseudo_heading(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("[。；;，,！!？?]$"), F.lit(False))


def chapter_title(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(f"^第[0-9{NUMERALS}十百千]+[章编篇]"), F.lit(False))


# ---- quality ----


def looks_like_error(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 300).rlike(r'(?i)"error"\s*:|error code|traceback|internal server error'), F.lit(False))


def truncated(c: Column) -> Column:
    x = F.lower(c)
    return F.coalesce(x.contains("<table") & ~x.contains("</table>"), F.lit(False))


def degenerate(c: Column, min_lines: int = 40, ratio: float = 0.5) -> Column:
    """At least min_lines non-empty lines without tags, more than the ratio of them repeats."""
    x = F.filter(F.transform(F.split(sub(F.coalesce(c, F.lit("")), "<[^>]*>", ""), "\n"), lambda y: F.trim(y)), lambda y: y != "")
    n = F.size(x)
    return (n >= min_lines) & ((n - F.size(F.array_distinct(x))) / n > ratio)


def collapse_repeats(c: Column) -> Column:
    """Each non-blank line (trimmed) once, at its first place; blank lines stay. Lines are sorted, not searched: n log n in a text's lines."""
    marked = F.array_sort(F.transform(F.split(c, "\n"), lambda x, i: F.struct(F.trim(x).alias("k"), i.alias("i"), x.alias("x"))))

    def kept(rows):
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(rows, lambda r: r.k))
        return F.array_sort(F.transform(F.filter(F.zip_with(rows, F.slice(before, 1, F.size(rows)), lambda r, k: F.when((r.k == "") | k.isNull() | (r.k != k), F.struct(r.i.alias("i"), r.x.alias("x")))), lambda r: r.isNotNull()), lambda r: r))

    return F.when(c.isNotNull(), F.array_join(F.transform(let(marked, kept), lambda r: r.x), "\n"))


def drop_adjacent(c: Column) -> Column:
    """Lines equal to the last non-blank line before go; blank lines don't reset the comparison."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"))
    done = F.aggregate(F.split(c, "\n"), start, lambda s, x: F.struct(F.when((F.trim(x) != "") & (F.trim(x) == s.last), s.out).otherwise(F.array_append(s.out, x)).alias("out"), F.when(F.trim(x) == "", s.last).otherwise(F.trim(x)).alias("last")))
    return F.array_join(done.out, "\n")


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays as multisets; null if both are empty."""
    both = F.array_distinct(F.concat(a, b))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    low = F.aggregate(both, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    high = F.aggregate(both, F.lit(0), lambda s, x: s + F.greatest(count(a, x), count(b, x)))
    return F.when(high > 0, low / high)
