"""Queries over text columns: cleaning, markers, quality, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as t
from orrery.tables import table


def blocks(s, d):
    return table(s, d, "doc_blocks").where("block_id is not null").groupBy("block_id").agg(F.min("text").alias("text"))


def lines(s, d):
    return blocks(s, d).select("block_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def tables(s, d):
    return table(s, d, "doc_tables").where("table_id is not null").groupBy("table_id").agg(F.min("markdown").alias("markdown"))


def cells(s, d):
    m = tables(s, d).where(F.col("markdown").startswith("|"))
    rows = m.select("table_id", F.posexplode(F.split("markdown", "\n")).alias("r", "row")).where("row like '|%' and not regexp_like(row, '^[| :-]+$')")
    return rows.select("table_id", "r", F.posexplode(F.expr("slice(split(row, '[|]'), 2, greatest(size(split(row, '[|]')) - 2, 0))")).alias("c", "cell")).withColumn("cell", F.trim("cell"))


def replies(s, d):
    """Replies to questions with a part for each option, a conclusion line and a JSON object, derived from the options."""
    q = table(s, d, "questions")
    keys = F.array_sort(F.map_keys("options"))
    good = lambda k: F.length(F.element_at(F.col("options"), k)) % 2 == 0
    verdict = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("选项"), k, F.lit("：初看不符合 → "), F.when(good(k), "符合").otherwise("不成立"))), "\n")
    right = F.array_join(F.filter(keys, good), "、")
    return q.select("qid", "answer_format", F.concat(F.lit('{"draft": 1}\n'), verdict, F.lit("\n\n答案：**"), right, F.lit('**\n{"answer": "'), right, F.lit('", "n": '), F.size(keys), F.lit("}")).alias("reply"))


def of(fn, name, keep=None):
    """Query of one text function over all blocks."""
    return lambda s, d: blocks(s, d).select("block_id", fn(F.col("text")).alias(name))


QUERIES = {
    "tx_normalize": of(t.normalize, "text"),
    "tx_heading_rank": lambda s, d: lines(s, d).select("block_id", "line_no", t.heading(F.col("line")).alias("h")).select("block_id", "line_no", "h.rank", "h.text"),
    "tx_article_no": lambda s, d: lines(s, d).select("block_id", "line_no", t.article_no(F.col("line")).alias("article")),
    "tx_strip_latex": of(t.strip_latex, "text"),
    "tx_sentences": lambda s, d: blocks(s, d).select("block_id", F.posexplode(t.sentences(F.col("text"))).alias("n", "sentence")),
    "tx_strip_fences": of(lambda c: t.strip_fences(F.concat(F.lit("```md\n"), c, F.lit("\n```"))), "text"),
    "tx_strip_html": of(t.strip_html, "text"),
    "tx_html_text": of(t.html_text, "text"),
    "tx_evaluation_form": of(t.evaluation_form, "text"),
    "tx_evaluation_form_nfkc": of(lambda c: t.evaluation_form(t.nfkc(c)), "text"),
    "tx_nfkc": of(t.nfkc, "text"),
    "tx_caption_like": lambda s, d: lines(s, d).select("block_id", "line_no", t.caption_like(F.col("line")).alias("caption_like")),
    "tx_han_number": lambda s, d: lines(s, d).select("block_id", "line_no", t.han_number(F.regexp_extract("line", f"([{t.NUMBERS}]+)", 1)).alias("n")).where("n is not null"),
    "tx_marker": lambda s, d: lines(s, d).select("block_id", "line_no", t.marker(F.col("line")).alias("m")).select("block_id", "line_no", "m.kind", F.array_join(F.transform("m.path", lambda x: x.cast("string")), ".").alias("path")),
    "tx_flatten_scripts": of(t.flatten_scripts, "text"),
    "tx_roman_grades": of(lambda c: t.roman_grades(F.concat(F.lit("III级 "), c)), "text"),
    "tx_flatten_math": of(t.flatten_math, "text"),
    "tx_fix_multi_dots": lambda s, d: cells(s, d).select("table_id", "r", "c", t.fix_multi_dots(F.translate("cell", ",", ".")).alias("cell")),
    "tx_letters": lambda s, d: replies(s, d).select("qid", F.array_join(t.letters(F.col("reply")), "").alias("letters")),
    "tx_verdicts": lambda s, d: replies(s, d).select("qid", t.verdicts(F.col("reply"), F.col("answer_format")).alias("letters")),
    "tx_canonical_answer": lambda s, d: replies(s, d).select("qid", t.canonical_answer(t.last_json(F.col("reply"), "answer"), F.col("answer_format")).alias("answer")),
    "tx_valid_answer": lambda s, d: replies(s, d).select("qid", t.valid_answer(t.canonical_answer(t.last_json(F.col("reply"), "answer"), F.col("answer_format")), F.col("answer_format")).alias("valid")),
    "tx_last_json": lambda s, d: replies(s, d).select("qid", t.last_json(F.col("reply"), "n").alias("n")),
    "tx_line_similarity": lambda s, d: table(s, d, "part").select("p_partkey", F.round(t.line_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")),
    "tx_continues": lambda s, d: lines(s, d).withColumn("next", F.expr("lead(line) over (partition by block_id order by line_no)")).where("next is not null").select("block_id", "line_no", t.continues(F.col("line"), F.col("next")).alias("continues")),
    "tx_pseudo_heading": lambda s, d: lines(s, d).select("block_id", "line_no", t.pseudo_heading(F.col("line")).alias("pseudo")),
    "tx_chapter_title": lambda s, d: lines(s, d).select("block_id", "line_no", t.chapter_title(F.concat(F.lit("第一章 "), F.col("line"))).alias("chapter")),
    "qa_error": of(t.looks_like_error, "error"),
    "qa_truncated": lambda s, d: tables(s, d).select("table_id", t.truncated(F.col("markdown")).alias("truncated")),
    "qa_degenerate": lambda s, d: table(s, d, "documents").select("doc_id", t.degenerate(F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("\nthe same line"), F.lit(45)))).alias("degenerate"), t.degenerate(F.col("text")).alias("as_stored")),
    "qa_collapse_repeats": of(lambda c: t.collapse_repeats(F.concat(c, F.lit("\n\n"), c)), "text"),
    "qa_drop_adjacent": of(lambda c: t.drop_adjacent(F.concat_ws("\n\n", c, F.element_at(F.split(c, "\n"), -1))), "text"),
    "qa_token_jaccard": lambda s, d: table(s, d, "questions").select("qid", F.round(t.multiset_jaccard(F.regexp_extract_all("question", F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all(F.coalesce("passage", F.lit("")), F.lit("[0-9]+"), F.lit(0))), 6).alias("jaccard")),
    "io_json_field": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.text"), F.get_json_object("props", "$.k")).alias("content")),
    "io_json_rows": lambda s, d: table(s, d, "doc_tables").where("records is not null").groupBy("table_id").agg(F.min("records").alias("records")).select("table_id", F.json_array_length("records").alias("n_rows")),
}

B = "with b as (select block_id, min(text) as text from doc_blocks where block_id is not null group by block_id)"
L = B + ", ln as (select block_id, unnest(range(len(string_split(text, chr(10)))))::int as line_no, unnest(string_split(text, chr(10))) as line from b)"
T = "with t as (select table_id, min(markdown) as markdown from doc_tables where table_id is not null group by table_id)"
C = (
    T
    + """, rw as (select table_id, unnest(range(len(string_split(markdown, chr(10)))))::int as r, unnest(string_split(markdown, chr(10))) as row from t where starts_with(markdown, '|')),
r2 as (select table_id, r, string_split(row, '|')[2:len(string_split(row, '|')) - 1] as x from rw where row like '|%' and not regexp_full_match(row, '[| :-]+')),
ce as (select table_id, r, unnest(range(len(x)))::int as c, trim(unnest(x)) as cell from r2)"""
)
RP = """with k as (select qid, answer_format, options, list_sort(map_keys(options)) as ks from questions),
v as (select *, list_filter(ks, lambda x: length(options[x]) % 2 = 0) as ok from k),
rp as (select qid, answer_format, ok, '{"draft": 1}' || chr(10) || array_to_string(list_transform(ks, lambda x: '选项' || x || '：初看不符合 → ' || case when length(options[x]) % 2 = 0 then '符合' else '不成立' end), chr(10)) || chr(10) || '答案：**' || array_to_string(ok, '、') || chr(10) || '{"answer": "' || array_to_string(ok, ', ') || '", "n": ' || len(ks) || '}' as reply from v),
an as (select qid, answer_format, case when answer_format = 'multi' then array_to_string(ok, '') else coalesce(ok[1], '') end as answer from rp)"""


def rx(x: str, *pairs: tuple[str, str], flags: str = "g") -> str:
    for a, b in pairs:
        x = f"regexp_replace({x}, '{a}', '{b}', '{flags}')"
    return x


H = "[\\x{4e00}-\\x{9fff}]"
NUM = "零一二三四五六七八九十百千"
GAP = (f"({H})[ \\t]+([\\x{{4e00}}-\\x{{9fff}}0-9])", "\\1\\2"), (f"([0-9])[ \\t]+({H})", "\\1\\2")
LATEX = (r"\\[A-Za-z]+\{([^{}]*)\}", r"\1"), (r"[\^_]\{([^{}]*)\}", r"\1")
TRIM = "^ +| +$"
W = "[ \\t\\r\\x{0B}\\f\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
Z = "\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}"
ENDS = (f"^(?:{W}|\\n)+|(?:{W}|\\n)+$", "")
CLOSE = [(f"([{Z}]){W}+([{Z}])", "\\1\\2")] * 2 + [(f"([0-9]){W}+([{Z}])", "\\1\\2"), (f"([{Z}]){W}+([0-9])", "\\1\\2")] * 2 + [("[ \\t]{2,}", " "), ENDS]
ORD = "一二三四五六七八九十百零〇0-9"
NAME = "[\\x{4e00}-\\x{9fa5}][^。；：，%\\n]{1,21}"
N10 = "一二三四五六七八九十"


def han_sql(x: str) -> str:
    """Value of a Han numeral, by hundreds, tens and units; null for none."""
    digit = lambda c: f"case {c} when '两' then 2 else nullif(instr('一二三四五六七八九', {c}), 0) end"
    one = lambda a: f"case when length({a}) = 1 then coalesce({digit(a)}, 1) else 1 end"
    rest = f"case when contains({x}, '百') then substring({x}, instr({x}, '百') + 1) else {x} end"
    unit = f"case when contains({rest}, '十') then substring({rest}, instr({rest}, '十') + 1) else {rest} end"
    hundreds = f"case when contains({x}, '百') then 100 * ({one(f"split_part({x}, '百', 1)")}) else 0 end"
    tens = f"case when contains({rest}, '十') then 10 * ({one(f"split_part({rest}, '十', 1)")}) else 0 end"
    units = f"coalesce(list_sum(list_transform(range(1, length({unit}) + 1), lambda i: coalesce({digit(f'substring({unit}, i, 1)')}, 0))), 0)"
    return f"nullif({hundreds} + {tens} + {units}, 0)::int"


def marker_sql() -> str:
    han, out = "([一二三四五六七八九十百零两〇]+)", []
    for kind, p in [("chap", f"^第\\s*{han}\\s*章"), ("art", f"^第\\s*{han}\\s*条"), ("cndun", f"^{han}\\s*[、.]"), ("cnpar", f"^[（(]\\s*{han}\\s*[)）]"), ("cnpar", f"^{han}\\s*[)）]"), ("numpar", "^[（(]\\s*([0-9]+)\\s*[)）]"), ("dec", "^([0-9]+(?:\\.[0-9]+)+)"), ("int", "^([0-9]+)\\s*[.、\\s]")]:
        v = f"regexp_extract(x, '{p}', 1)"
        path = han_sql(v) + "::varchar" if han in p else f"array_to_string(list_transform(string_split({v}, '.'), lambda z: try_cast(z as int)::varchar), '.')"
        ok = f"{han_sql(v)} is not null" if han in p else f"try_cast(string_split({v}, '.')[1] as int) is not null"
        out.append(f"when regexp_matches(x, '{p}') and {ok} then '{kind} ' || {path}")
    return " ".join(out)


ORACLE = {
    "tx_normalize": B + f" select block_id, {rx('text', *CLOSE)} as text from b",
    "tx_heading_rank": L
    + f""", x as (select block_id, line_no, {rx('line', ENDS)} as x from ln), y as (select block_id, line_no, x, case when regexp_matches(x, '^第[{ORD}]+[章节编]') and length(x) <= 40 then case when regexp_matches(substring(x, 1, 6), '[章编]') then 1 else 2 end
when regexp_full_match(x, '[0-9]{{1,2}}(?:\\.[0-9]{{1,3}})+[.、．]?[ \\t]*{NAME}') then len(string_split(regexp_extract(x, '^[0-9.]*[0-9]'), '.')) when regexp_full_match(x, '[{N10}]{{1,3}}[、．.][ \\t]*{NAME}') then 3 when regexp_full_match(x, '[（(][{N10}]{{1,3}}[)）][ \\t]*{NAME}') then 4
when regexp_full_match(x, '[0-9]{{1,2}}[、．.][ \\t]*{NAME}') then 5 when regexp_full_match(x, '[（(][0-9]{{1,2}}[)）][ \\t]*{NAME}') then 6 end::int as rank from x) select block_id, line_no, rank, case when rank is not null then x end as text from y""",
    "tx_article_no": L + f" select block_id, line_no, regexp_extract({rx('line', ENDS)}, '^第[{ORD}]+条') as article from ln",
    "tx_strip_latex": B + f" select block_id, {rx('text', *LATEX, *LATEX, *LATEX, (r'\\$', ''))} as text from b".replace("\\\\$", "\\$"),
    "tx_sentences": B + ", s as (select block_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?\\n]+[。！？!?]?'), lambda x: trim(x)), lambda x: x != '') as s from b) select block_id, unnest(range(len(s)))::int as n, unnest(s) as sentence from s",
    "tx_strip_fences": B + " select block_id, trim(text) as text from (select block_id, text from b)" if False else B + f""" select block_id, trim({rx(rx("trim('```md' || chr(10) || text || chr(10) || '```')", ('^```[A-Za-z]*\\n', ''), flags=''), ('\\n?```$', ''), flags='')}) as text from b""",
    "tx_strip_html": B + f" select block_id, trim({rx('text', ('(?i)<br\\s*/?>|</tr>|</p>', chr(10)), ('<[^>]*>', ''), ('[ \\t]+', ' '), ('\\n{2,}', chr(10)), ('^\\s+|\\s+$', ''))}) as text from b",
    "tx_html_text": B
    + f" select block_id, trim({rx('text', ('(?is)<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->', ''), ('(?i)</?(p|div|li|ul|ol|tr|table|h[1-6]|br|section|article)\\b[^>]*>', chr(10)), ('<[^>]*>', ''), ('\\n\\s*\\n+', chr(10)), ('^\\s+|\\s+$', ''))}) as text from b",
    "tx_evaluation_form": B + f" select block_id, {rx('text', ('\\r\\n?', chr(10)), ('[ \\t]+', ' '), (' ?\\n ?', chr(10)), ('\\n{3,}', chr(10) * 2), ('^ +| +$', ''))} as text from b",
    "tx_caption_like": L + f" select block_id, line_no, length({rx('line', ('[^\\x{4e00}-\\x{9fff}]', ''))}) >= 4 and length({rx('line', ('[^\\x{4e00}-\\x{9fff}]', ''))}) > length({rx('line', ('[^0-9]', ''))}) as caption_like from ln",
    "tx_han_number": L + f", x as (select block_id, line_no, regexp_extract(line, '([一二三四五六七八九十百零两〇]+)', 1) as v from ln), y as (select block_id, line_no, {han_sql('v')} as n from x) select * from y where n is not null",
    "tx_marker": L
    + f""", w as (select block_id, line_no, {rx('line', ENDS)} as raw from ln), x as (select *, translate(raw, '０１２３４５６７８９（）．' || chr(12288) || chr(160), '0123456789().  ') as x from w),
y as (select block_id, line_no, case when raw is null then null when length(raw) > 0 and instr('{t.CIRCLED}', substring(raw, 1, 1)) > 0 then 'circ ' || instr('{t.CIRCLED}', substring(raw, 1, 1)) {marker_sql()} else 'title ' end as m from x) select block_id, line_no, split_part(m, ' ', 1) as kind, split_part(m, ' ', 2) as path from y""",
    "tx_flatten_scripts": B + " select block_id, translate(translate(translate(text, '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ', '0123456789+-=()n'), '₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎', '0123456789+-=()'), 'ₐₑₒₓₕₖₗₘₙₚₛₜ', 'aeoxhklmnpst') as text from b",
    "tx_flatten_math": B
    + f" select block_id, trim({rx('text', (r'\\frac\{([^{}]*)\}\{([^{}]*)\}', r'\1/\2'), (r'\\(?:text|mathrm|mathbf)\{([^{}]*)\}', r'\1'), (r'\\times', '×'), (r'\\leq', '≤'), (r'\\geq', '≥'), (r'\\cdot', '·'), (r'\\%', '%'), (r'\s+', ' '))}) as text from b",
    "tx_fix_multi_dots": C
    + r""", f as (select table_id, r, c, translate(cell, ',', '.') as x from ce) select table_id, r, c, case when regexp_full_match(trim(x), '[0-9]{1,3}(?:\.[0-9]{3})+\.[0-9]{2}') then replace(trim(x)[:-4], '.', ',') || trim(x)[-3:] else x end as cell from f""",
    "tx_letters": RP + " select qid, array_to_string(ok, '') as letters from rp",
    "tx_verdicts": RP + " select qid, case when answer_format = 'multi' then array_to_string(ok, '') else coalesce(ok[1], '') end as letters from rp",
    "tx_canonical_answer": RP + " select qid, answer from an",
    "tx_valid_answer": RP + " select qid, case when answer_format = 'multi' then regexp_full_match(answer, 'A?B?C?D?') and answer != '' when answer_format = 'tf' then regexp_full_match(answer, '[AB]') else regexp_full_match(answer, '[A-D]') end as valid from an",
    "tx_last_json": RP + " select qid, len(map_keys(options))::varchar as n from questions",
    "tx_line_similarity": "select p_partkey, round(case when greatest(length(trim(p_name)), length(trim(p_type))) = 0 then 1.0 else 1 - levenshtein(trim(p_name), trim(p_type)) / greatest(length(trim(p_name)), length(trim(p_type))) end, 6) as similarity from part",
    "tx_continues": L
    + r""", x as (select *, lead(line) over (partition by block_id order by line_no) as nx from ln)
select block_id, line_no, not regexp_matches(trim(line), '[。！？!?.；;：:]$') and not regexp_matches(trim(nx), '^(?:#|[-*•] |[0-9]+[.、]|[（(])') and trim(line) != '' and trim(nx) != '' as continues from x where nx is not null""",
    "tx_pseudo_heading": L + " select block_id, line_no, regexp_matches(trim(line), '[。；;，,！!？?]$') as pseudo from ln",
    "tx_chapter_title": L + f" select block_id, line_no, regexp_matches(trim('第一章 ' || line), '^第[0-9{NUM}]+[章编篇]') as chapter from ln",
    "qa_error": B + """ select block_id, coalesce(regexp_matches(substring(text, 1, 300), '(?i)"error"\\s*:|error code|traceback|internal server error'), false) as error from b""",
    "qa_truncated": T + " select table_id, coalesce(contains(lower(markdown), '<table') and not contains(lower(markdown), '</table>'), false) as truncated from t",
    "qa_degenerate": """with x as (select doc_id, coalesce(text, '') || repeat(chr(10) || 'the same line', 45) as a, coalesce(text, '') as b from documents),
f as (select doc_id, list_filter(list_transform(string_split(regexp_replace(a, '<[^>]*>', '', 'g'), chr(10)), lambda y: trim(y, ' ')), lambda y: y != '') as a, list_filter(list_transform(string_split(regexp_replace(b, '<[^>]*>', '', 'g'), chr(10)), lambda y: trim(y, ' ')), lambda y: y != '') as b from x)
select doc_id, len(a) >= 40 and (len(a) - len(list_distinct(a))) / greatest(len(a), 1) > 0.5 as degenerate, len(b) >= 40 and (len(b) - len(list_distinct(b))) / greatest(len(b), 1) > 0.5 as as_stored from f""",
    "qa_collapse_repeats": B
    + """, x as (select block_id, string_split(text || chr(10) || chr(10) || text, chr(10)) as l from b), y as (select block_id, unnest(range(len(l))) as i, unnest(l) as s from x),
z as (select *, row_number() over (partition by block_id, trim(s) order by i) as r from y) select b.block_id, string_agg(s, chr(10) order by i) filter (r = 1 or trim(s) = '') as text from b left join z using (block_id) group by b.block_id""",
    "qa_drop_adjacent": B
    + """, x as (select block_id, string_split(text || chr(10) || chr(10) || string_split(text, chr(10))[-1], chr(10)) as l from b), y as (select block_id, unnest(range(len(l))) as i, unnest(l) as s from x),
z as (select *, last_value(case when trim(s) != '' then trim(s) end ignore nulls) over (partition by block_id order by i rows between unbounded preceding and 1 preceding) as p from y)
select b.block_id, coalesce(string_agg(s, chr(10) order by i) filter (trim(s) = '' or p is null or trim(s) != p), '') as text from b left join z using (block_id) group by b.block_id""",
    "qa_token_jaccard": """with a as (select qid, unnest(regexp_extract_all(question, '[0-9]+')) as t from questions), b as (select qid, unnest(regexp_extract_all(coalesce(passage, ''), '[0-9]+')) as t from questions),
ca as (select qid, t, count(*) as n from a group by all), cb as (select qid, t, count(*) as n from b group by all), j as (select coalesce(ca.qid, cb.qid) as qid, least(coalesce(ca.n, 0), coalesce(cb.n, 0)) as lo, greatest(coalesce(ca.n, 0), coalesce(cb.n, 0)) as hi from ca full join cb on ca.qid = cb.qid and ca.t = cb.t)
select q.qid, round(sum(lo) / sum(hi), 6) as jaccard from questions q left join j using (qid) group by q.qid""",
    "io_json_field": "select event_id, (props->>'$.k')::int as k, coalesce(props->>'$.text', props->>'$.k') as content from events",
    "io_json_rows": "with r as (select table_id, min(records) as records from doc_tables where records is not null group by table_id) select table_id, json_array_length(records)::int as n_rows from r",
}
