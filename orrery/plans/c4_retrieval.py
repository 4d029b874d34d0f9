"""Queries over chunks and questions: the index, searches, evidence, routing and facts.

The index of a folder's chunks is built once a session and read by all queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import retrieval as r
from orrery.session import cut_lineage
from orrery.tables import table

_BUILT: dict = {}


def index(s, d) -> r.Index:
    key = (s.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = r.build(table(s, d, "doc_chunks"))
    return _BUILT[key]


def ch(s, d):
    return index(s, d).chunks


def qs(s, d):
    return table(s, d, "questions")


def q(s, d):
    return r.queries(qs(s, d), "qid", "question")


def cand(s, d):
    return qs(s, d).select("qid", F.explode("doc_ids").alias("doc_id")).where("qid is not null and doc_id is not null").distinct()


def local(s, d, k=8):
    return r.search_local(q(s, d), cand(s, d), index(s, d), k)


def doc_scores(s, d):
    return r.score_all(q(s, d), index(s, d), cand(s, d))


def names(s, d):
    """(doc_id, name): the title of the last ingested row that has one."""
    x = table(s, d, "fin_docs").where("doc_id is not null and title is not null and title != ''")
    return x.groupBy("doc_id").agg(F.max(F.struct("ingested_at", "title")).alias("x")).select("doc_id", F.col("x.title").alias("name"))


def asks(s, d):
    return qs(s, d).where("qid is not null").dropDuplicates(["qid"]).select("qid", F.col("question").alias("ask"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("cand"))


def facts(s, d):
    return cut_lineage(r.decompose(qs(s, d), index(s, d), names(s, d)))  # of the stated questions; read by several plans


def gathered(s, d):
    f = facts(s, d)
    return f, cut_lineage(r.evidence(f, qs(s, d).select("qid", "domain").distinct(), index(s, d)))


def evidence_pool(s, d):
    f, e = gathered(s, d)
    return r.evidence_pool(f, e, index(s, d), names(s, d))


def runs(s, d):
    """Each question against the names of its candidates."""
    x = asks(s, d).select("qid", "ask", F.explode("cand").alias("doc_id")).join(names(s, d), "doc_id")
    return x.select("qid", "doc_id", r.shared_run(F.col("ask"), F.col("name")).alias("run"))


WORDS = [("revenue", 1), ("income", 1), ("premium", 1), ("counterparty", 1), ("营业收入", 1), ("募集资金", 1), ("现金价值", 1)]


def windows(s, d):
    t = s.createDataFrame(WORDS, "term string, one int")
    df = ch(s, d).select(F.col("chunk_id").alias("id"), "text")
    return r.best_window(df, df.select("id").withColumn("one", F.lit(1)).join(F.broadcast(t), "one").select("id", "term"))  # the stated words


def refs(s, d):
    x = table(s, d, "fin_docs").select("doc_id").where("doc_id is not null").distinct()
    a = x.select(F.concat(F.lit("file no. 00"), F.regexp_extract("doc_id", r"(\d+)$", 1), F.lit(" (copy)")).alias("ref"))
    return r.match_reference(a.unionByName(x.select(F.col("doc_id").alias("ref"))), x)


QUERIES = {
    "c4_tokens": lambda s, d: ch(s, d).select("chunk_id", F.size(r.tokens("text")).alias("n"), F.array_join(r.tokens("text"), " ").alias("tokens")),
    "c4_tokens_char": lambda s, d: ch(s, d).select("chunk_id", F.array_join(r.tokens("text", mode="char"), " ").alias("tokens")),
    "c4_index_text": lambda s, d: ch(s, d).select("chunk_id", r.index_text().alias("index_text")),
    "c4_postings": lambda s, d: index(s, d).postings,
    "c4_bm25_stats": lambda s, d: index(s, d).terms.withColumn("idf", F.round("idf", 6)),
    "c4_bm25_global": lambda s, d: r.search(q(s, d), index(s, d)),
    "c4_bm25_doc_filter": lambda s, d: r.search_docs(q(s, d), cand(s, d), index(s, d)),
    "c4_bm25_local": local,
    "c4_bm25_each": lambda s, d: r.search_each(q(s, d), cand(s, d), index(s, d), 8),
    "c4_hits_by_id": lambda s, d: r.hits_from_ids(local(s, d).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x.chunk_id).alias("ids")), ch(s, d)),
    "c4_neighbours": lambda s, d: r.neighbours(local(s, d), ch(s, d)),
    "c4_backfill": lambda s, d: r.backfill(local(s, d), ch(s, d)),
    "c4_pool": lambda s, d: r.pool(r.backfill(local(s, d), ch(s, d)), ch(s, d)),
    "c4_round_robin": lambda s, d: r.round_robin(local(s, d)),
    "c4_cover": lambda s, d: r.cover(ch(s, d)),
    "c4_doc_rank": lambda s, d: r.doc_rank(doc_scores(s, d)),
    "c4_doc_rank_best3": lambda s, d: r.doc_rank(doc_scores(s, d), r.BEST),
    "c4_route": lambda s, d: r.route(asks(s, d), index(s, d), names(s, d)),
    "c4_route_fact": lambda s, d: r.route_fact(asks(s, d), index(s, d)).select("qid", F.array_join("docs", ",").alias("docs")),
    "c4_named_in": lambda s, d: asks(s, d).withColumn("ask", F.concat("ask", F.lit(" 第二份与 text 0007"))).select("qid", F.array_join(r.named_in(F.col("ask"), F.col("cand")), ",").alias("docs")),
    "c4_shared_run": runs,
    "c4_identity_route": lambda s, d: r.identity_route(asks(s, d), names(s, d)),
    "c4_match_reference": refs,
    "c4_decompose": lambda s, d: facts(s, d).withColumn("docs", F.array_join("docs", ",")),
    "c4_evidence": lambda s, d: gathered(s, d)[1],
    "c4_evidence_pool": evidence_pool,
    "c4_outline": lambda s, d: r.outline(table(s, d, "doc_chunks")),
    "c4_synonyms": lambda s, d: qs(s, d).select("qid", r.expand("question").alias("expanded")),
    "c4_best_window": windows,
    "c4_grep": lambda s, d: r.grep(ch(s, d), "应收账款"),
}

# ---- the same in SQL, from the rules ----

HAN = "[\\x{4e00}-\\x{9fff}]"
LATIN = "[a-z0-9_%\\x{df}-\\x{f6}\\x{f8}-\\x{ff}]+"
STOPS = ", ".join(f"'{w}'" for w in r.STOP)
TERMS = "|".join(sorted(r.TERMS, key=lambda x: (-len(x), x)))


def tok(c: str) -> str:
    """Token list of a text in lower case: Latin runs, domain terms, pairs of neighbouring Han characters, single ones."""
    at = f"range(1, length({c}) + 1)"
    pairs = f"list_filter(list_transform({at}, lambda i: substring({c}, i, 2)), lambda x: regexp_full_match(x, '{HAN}{HAN}'))"
    ones = f"list_transform(list_filter({at}, lambda i: regexp_full_match(substring({c}, i, 1), '{HAN}') and (i = 1 or not regexp_full_match(substring({c}, i - 1, 1), '{HAN}')) and not regexp_full_match(substring({c}, i + 1, 1), '{HAN}')), lambda i: substring({c}, i, 1))"
    return f"list_filter(list_concat(list_concat(regexp_extract_all({c}, '{LATIN}'), regexp_extract_all({c}, '{TERMS}')), list_concat({pairs}, {ones})), lambda x: x not in ({STOPS}))"


CH = f"""
with ch as (select chunk_id, doc_id, domain, type, breadcrumb, text, seq from (select *, row_number() over (partition by chunk_id order by indexed_at desc nulls last, doc_id desc, text desc) as rn from doc_chunks where chunk_id is not null) where rn = 1),
it as (select *, case when coalesce(breadcrumb, '') != '' then breadcrumb || ' ' || coalesce(text, '') else coalesce(text, '') end as index_text from ch),
lw as (select chunk_id, doc_id, lower(index_text) as c from it), tk as materialized (select chunk_id, doc_id, {tok("c")} as t from lw),
ps as materialized (select chunk_id, doc_id, token, count(*) as tf, max(dl) as dl from (select chunk_id, doc_id, len(t) as dl, unnest(t) as token from tk) group by all),
tot as (select count(*) as n, avg(len(t)) as avgdl from tk),
s0 as (select token, count(*) as df, ln(((select n from tot) - count(*) + 0.5) / (count(*) + 0.5)) as raw from ps group by token),
st as materialized (select token, df, case when raw < 0 then 0.25 * (select avg(raw) from s0) else raw end as idf from s0),
ql as (select qid, lower(coalesce(question, '')) as c from questions where qid is not null), q as (select distinct qid, unnest({tok("c")}) as token from ql),
cd as (select distinct qid, unnest(doc_ids) as doc_id from questions where qid is not null)"""
ALL = CH + ", sa as (select qid, chunk_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avgdl from tot)))), 6) as score from ps join q using (token) join st using (token) group by all)"
LOCAL = CH + """, ow as (select qid, chunk_id, doc_id, len(t) as dl from cd join tk using (doc_id)), lp as (select qid, chunk_id, doc_id, token, tf, dl from cd join ps using (doc_id)),
lt as (select qid, count(*) as n, avg(dl) as avgdl from ow group by qid), l0 as (select qid, token, count(*) as df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as raw from lp join lt using (qid) group by qid, token),
lm as (select qid, avg(raw) as mean from l0 group by qid), ls as (select qid, token, case when raw < 0 then 0.25 * mean else raw end as idf from l0 join lm using (qid)),
lsc as (select qid, chunk_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lp.dl / avgdl))) as s from lp join q using (qid, token) join ls using (qid, token) join lt using (qid) group by all),
la as (select qid, chunk_id, doc_id, round(coalesce(s, 0), 6) as score from ow left join lsc using (qid, chunk_id, doc_id)),
lr as (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from la), lk as materialized (select * from lr where rank <= 8)"""
NEAR = LOCAL + """, nb as (select lk.qid, lk.chunk_id, b.chunk_id as neighbour from lk join ch a using (chunk_id) join ch b on b.doc_id = lk.doc_id and abs(b.seq - a.seq) = 1)"""
FILL = NEAR + """, bf0 as (select qid, c, min((rank, seq)) as ats from (select qid, chunk_id, neighbour as c from nb union all select qid, chunk_id, chunk_id from lk) x join lk using (qid, chunk_id) join (select chunk_id as c, seq from ch) using (c) group by qid, c),
bf as (select qid, c as chunk_id, row_number() over (partition by qid order by ats, c) as place from bf0)"""
ONCE = "select qid, any_value(question) as question, any_value(options) as options, any_value(answer_format) as fmt, any_value(domain) as domain, coalesce(any_value(doc_ids), []) as cand from questions where qid is not null group by qid"
NAMES = "nm as (select doc_id, title as name from (select *, row_number() over (partition by doc_id order by ingested_at desc nulls last, title desc) as rn from fin_docs where doc_id is not null and title is not null and title != '') where rn = 1)"
NUMBER = "try_cast(nullif(regexp_extract({0}, '([0-9]+)[^0-9]*$', 1), '') as hugeint)"
POS = "第([一二三四五六七八九十0-9]+)[份篇]|前者|后者|前一[份篇]|后一[份篇]"


def named_sql(ask: str) -> str:
    """List of the candidates an ask points at."""
    nth = "regexp_extract(w, '第([一二三四五六七八九十0-9]+)', 1)"
    at = f"case when contains(w, '前') then 1 when contains(w, '后') then 2 when length({nth}) = 1 and instr('一二三四五六七八九十', {nth}) > 0 then instr('一二三四五六七八九十', {nth}) else try_cast({nth} as int) end"
    place = f"list_transform(list_filter(list_transform(regexp_extract_all({ask}, '{POS}'), lambda w: {at}), lambda i: i >= 1 and i <= len(cand)), lambda i: cand[i])"
    same = f"list_filter(cand, lambda c: {NUMBER.format('c')} = {NUMBER.format('nm_')})"
    name = f"list_transform(regexp_extract_all({ask}, '(?i)(?:fc_)?text[_ ]?0*[0-9]+'), lambda nm_: case when list_contains(cand, nm_) then nm_ when len({same}) = 1 then {same}[1] end)"
    ids = f"list_filter(cand, lambda c: length(c) >= 4 and contains({ask}, c))"
    return f"list_concat(list_concat({place}, list_filter({name}, lambda x: x is not null)), {ids})"


def first2(x: str) -> str:
    """The first two different entries of a list, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)[1:2]"


def run5(a: str, b: str) -> str:
    return f"(length({b}) >= 5 and len(list_filter(range(1, greatest(length({b}) - 3, 2)), lambda i: contains({a}, substring({b}, i, 5)))) > 0)"


def ranks(best: int, src: str = "sa semi join cd using (qid, doc_id)") -> str:
    return f", dr0 as (select *, row_number() over (partition by qid, doc_id order by score desc, chunk_id) as r from (select sa.* from {src})), d1 as (select qid, doc_id, round(sum(score), 6) as score from dr0 where r <= {best} group by all), dr as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from d1)"


ASKS = f", nq as ({ONCE}), {NAMES}"


def fact_scores(src: str) -> str:
    """Routing of asks (fid, ask, cand) in `src`: rt (fid, docs)."""
    return f""", rn0 as (select *, {first2(named_sql('ask'))} as named from {src}), rq as (select distinct fid, unnest({tok('c')}) as token from (select fid, lower(coalesce(ask, '')) as c from rn0)), rc as (select distinct fid, unnest(cand) as doc_id from rn0),
rs as (select fid, chunk_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avgdl from tot)))), 6) as score from ps join rq using (token) join st using (token) semi join rc using (fid, doc_id) group by all),
rd as (select fid, doc_id, max(score) as score from rs group by all having max(score) > 0), rr as (select *, row_number() over (partition by fid order by score desc, doc_id) as rank, max(score) over (partition by fid) as best from rd),
rf as (select fid, list(doc_id order by rank) as two, list(doc_id order by rank) filter (score >= 0.4 * best) as near from rr where rank <= 2 group by fid),
rt as (select fid, case when len(named) > 0 then named when two is null then cand[1:2] when regexp_matches(ask, '均|都|两份|两者|双方|各|分别') then two else near end as docs from rn0 left join rf using (fid))"""


W = "[ \\t\\r\\x{0B}\\f\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
Z = "\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}"


def norm_sql(x: str) -> str:
    for a, b in [(f"([{Z}]){W}+([{Z}])", "\\1\\2")] * 2 + [(f"([0-9]){W}+([{Z}])", "\\1\\2"), (f"([{Z}]){W}+([0-9])", "\\1\\2")] * 2 + [("[ \\t]{2,}", " "), (f"^(?:{W}|\\n)+|(?:{W}|\\n)+$", "")]:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


FACTS = ALL + ASKS + f""", ks as (select *, list_filter(list_sort(map_keys(options)), lambda k: k in ('A', 'B', 'C', 'D')) as ks from nq),
f1 as (select qid, question, cand, unnest(case when coalesce(fmt = 'tf', false) or ks is null or len(ks) < 2 then [{{'n': 0, 'o': 'shared', 'a': question}}] else list_transform(ks, lambda k, i: {{'n': i - 1, 'o': k, 'a': options[k]}}) end) as e from ks),
f2 as materialized (select qid || '/' || e.o as fid, qid, e.n as n, e.o as option_id, {norm_sql("coalesce(e.a, '')")} as ask, cand from f1)""" + fact_scores("f2") + f""",
bl as (select qid, question, concat_ws(' ', question, array_to_string(map_values(options), ' ')) as blob, unnest(cand) as doc_id, unnest(range(len(cand))) as n from nq),
f3 as (select f2.qid, n, option_id, ask, docs from f2 join rt using (fid) union all select qid, n + 100, 'shared', {norm_sql("coalesce(question, '')")}, [doc_id] from bl join nm using (doc_id) where {run5('blob', 'name')}),
f4 as (select *, row_number() over (partition by qid, ask, docs order by n) as r from f3 where ask != ''),
fa as materialized (select qid || '/f' || nn as fact, qid, nn as n, option_id, ask, docs from (select *, row_number() over (partition by qid order by n) as nn from f4 where r = 1))"""
COVERED = ", cv as (select doc_id, chunk_id, r from (select doc_id, chunk_id, row_number() over (partition by doc_id order by seq, chunk_id) as r from ch where length(trim(text)) >= 3 and not contains(text, 'img_in_') and not starts_with(trim(text), '<div><img')) where r <= 8)"
EACH = """, dn as (select doc_id, count(*) as n, avg(len(t)) as avgdl from tk group by doc_id), dt0 as (select doc_id, token, count(*) as df from ps group by all), dt as (select *, ln((n - df + 0.5) / (df + 0.5)) as raw from dt0 join dn using (doc_id)), dm as (select doc_id, avg(raw) as mean from dt group by doc_id),
es as (select fid, ps.doc_id, ps.chunk_id, sum((case when raw < 0 then 0.25 * mean else raw end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from eq join ec using (fid) join dt using (doc_id, token) join dm using (doc_id) join ps using (doc_id, token) group by all),
er as (select *, row_number() over (partition by fid, doc_id order by score desc, chunk_id) as rank from (select ec.fid, ec.doc_id, tk.chunk_id, round(coalesce(s, 0), 6) as score from ec join tk using (doc_id) left join es on es.fid = ec.fid and es.doc_id = ec.doc_id and es.chunk_id = tk.chunk_id))"""
EVIDENCE = FACTS + COVERED + f""", eq as (select distinct fact as fid, unnest({tok('c')}) as token from (select fact, lower(ask) as c from fa)), ec as (select distinct fact as fid, unnest(docs) as doc_id from fa)""" + EACH + """,
fc as (select fact as fid, coalesce(domain = 'financial_contracts', false) as fc from fa join nq using (qid)),
ev as materialized (select fid as fact, doc_id, chunk_id, place from (select fid, er.doc_id, er.chunk_id, row_number() over (partition by fid, er.doc_id order by case when fc and cv.chunk_id is not null and score > 0 then 0 else 1 end, rank) as place from er join fc using (fid) left join cv on cv.chunk_id = er.chunk_id where rank <= case when fc then 24 else 8 end) where place <= 8)"""
POOLED = EVIDENCE + """, da as (select fact, qid, n, unnest(docs) as doc_id, unnest(range(len(docs))) as d from fa), h as (select qid, n, d, place, ev.doc_id, ev.chunk_id, seq from ev join da using (fact, doc_id) join (select chunk_id, seq from ch) using (chunk_id)),
e1 as (select qid, n, d, place, b.seq as s_, b.chunk_id as c from h join ch b on b.doc_id = h.doc_id and abs(b.seq - h.seq) <= 1 and (b.seq != h.seq or b.chunk_id = h.chunk_id) union all select qid, n, d, place, seq, chunk_id from h),
e2 as (select qid, c, min((n, d, place, s_)) as ats from e1 group by all),
e3 as (select qid, c, ats, length(substring(coalesce(nullif(name, ''), ch.doc_id), 1, 40)) + length(coalesce(nullif(breadcrumb, ''), type, '')) + length(text) + 6 as n_chars from e2 join ch on ch.chunk_id = c left join nm using (doc_id)),
e4 as (select qid, c as chunk_id, row_number() over w as place, coalesce(sum(n_chars) over (partition by qid order by ats, c rows between unbounded preceding and 1 preceding), 0)::bigint as before from e3 where n_chars is not null window w as (partition by qid order by ats, c))"""
LONGEST = "coalesce(list_max(list_transform(range(1, length(name) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(name) - i + 2), lambda n: contains(question, substring(name, i, n)))), 0))), 0)"
ORACLE = {
    "c4_tokens": CH + f", x as (select chunk_id, {tok('c')} as t from (select chunk_id, lower(coalesce(text, '')) as c from ch)) select chunk_id, len(t)::int as n, array_to_string(t, ' ') as tokens from x",
    "c4_tokens_char": CH + f", x as (select chunk_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_%\\x{{df}}-\\x{{f6}}\\x{{f8}}-\\x{{ff}}\\x{{4e00}}-\\x{{9fff}}]'), lambda x: x not in ({STOPS})) as t from ch) select chunk_id, array_to_string(t, ' ') as tokens from x",
    "c4_index_text": CH + " select chunk_id, index_text from it",
    "c4_postings": CH + " select chunk_id, doc_id, token, tf, dl::int as dl from ps",
    "c4_bm25_stats": CH + " select token, df, round(idf, 6) as idf from st",
    "c4_bm25_global": ALL + " select * from (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from sa) where rank <= 8",
    "c4_bm25_doc_filter": ALL + " select * from (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from (select * from sa semi join cd using (qid, doc_id))) where rank <= 8",
    "c4_bm25_local": LOCAL + " select qid, chunk_id, doc_id, score, rank from lk",
    "c4_bm25_each": CH + ", eq as (select qid as fid, token from q), ec as (select qid as fid, doc_id from cd)" + EACH + " select fid as qid, doc_id, chunk_id, score, rank from er where rank <= 8",
    "c4_hits_by_id": LOCAL + " select qid, (rank - 1)::int as pos, chunk_id, doc_id, 0.0::double as score from lk",
    "c4_neighbours": NEAR + " select qid, chunk_id, neighbour from nb",
    "c4_backfill": FILL + " select * from bf",
    "c4_pool": FILL + ", pl as (select qid, place, chunk_id, coalesce(sum(length(text)) over (partition by qid order by place rows between unbounded preceding and 1 preceding), 0)::bigint as before from bf join ch using (chunk_id)) select * from pl where before < 18000",
    "c4_round_robin": LOCAL + ", rr as (select qid, chunk_id, doc_id, row_number() over (partition by qid, doc_id order by score desc, chunk_id) as in_doc from lk) select *, row_number() over (partition by qid order by in_doc, doc_id, chunk_id) as place from rr",
    "c4_cover": CH + COVERED + " select * from cv",
    "c4_doc_rank": ALL + ranks(1) + " select * from dr",
    "c4_doc_rank_best3": ALL + ranks(3) + " select * from dr",
    "c4_route": ALL + ASKS + f""", wd as (select *, case when regexp_matches(question, '第一份|第1份|第一篇|前者|首份') and len(cand) >= 1 then 1 when regexp_matches(question, '第二份|第2份|第二篇|后者') and len(cand) >= 2 then 2 when regexp_matches(question, '第三份|第3份|第三篇') and len(cand) >= 3 then 3 when regexp_matches(question, '第四份|第4份|第四篇') and len(cand) >= 4 then 4 end as word from nq),
o1 as (select qid, cand[coalesce(word, 1)] as doc_id, 1 as place from wd where len(cand) = 1 or (word is not null and len(cand) > 0)), re as (select * from wd where len(cand) > 1 and word is null),
idr as (select qid, any_value(case when hit then doc_id end) as doc_id from (select qid, doc_id, {run5('question', 'name')} as hit from (select qid, question, unnest(cand) as doc_id from re) join nm using (doc_id)) group by qid having count(distinct doc_id) >= 2 and count(distinct case when hit then doc_id end) = 1),
r2 as (select * from re where qid not in (select qid from idr)), rc2 as (select distinct qid, unnest(cand) as doc_id from r2)""" + ranks(3, "sa semi join rc2 using (qid, doc_id)") + """,
nx as (select dr.*, lead(score) over w as nx, lead(doc_id) over w as second, question from dr join r2 using (qid) where score > 0 window w as (partition by qid order by rank)),
yr as (select *, list_filter(regexp_extract_all(question, '20[0-9]{2}'), lambda y: contains(doc_id, y) != contains(second, y)) as ys from nx where rank = 1),
fd as (select qid, case when nx is null or score >= 1.3 * nx then [doc_id] when regexp_replace(doc_id, '20[0-9]{2}', '', 'g') = regexp_replace(second, '20[0-9]{2}', '', 'g') and len(ys) > 0 then [case when contains(doc_id, ys[1]) then doc_id else second end] else [doc_id, second] end as docs from yr)
select * from o1 union all select qid, doc_id, 1 from idr union all select qid, unnest(docs), unnest(range(1, len(docs) + 1)) from fd union all select qid, unnest(cand), unnest(range(1, len(cand) + 1)) from r2 where qid not in (select qid from fd)""",
    "c4_route_fact": ALL + ASKS + ", aq as (select qid as fid, question as ask, cand from nq)" + fact_scores("aq") + " select fid as qid, array_to_string(docs, ',') as docs from rt",
    "c4_named_in": f"with nq as ({ONCE}), x as (select qid, cand, question || ' 第二份与 text 0007' as ask from nq), y as (select qid, {named_sql('ask')} as l from x) select qid, array_to_string({first2('l')}, ',') as docs from y",
    "c4_shared_run": f"with nq as ({ONCE}), {NAMES} select qid, doc_id, {LONGEST}::int as run from (select qid, question, unnest(cand) as doc_id from nq) join nm using (doc_id)",
    "c4_identity_route": f"with nq as ({ONCE}), {NAMES}, x as (select qid, doc_id, {run5('question', 'name')} as hit from (select qid, question, unnest(cand) as doc_id from nq) join nm using (doc_id)) select qid, min(case when hit then doc_id end) as doc_id from x group by qid having count(distinct doc_id) >= 2 and count(distinct case when hit then doc_id end) = 1",
    "c4_match_reference": f"""with x as (select distinct doc_id from fin_docs where doc_id is not null), rf as (select 'file no. 00' || regexp_extract(doc_id, '(\\d+)$', 1) || ' (copy)' as ref from x union all select doc_id from x), ex as (select ref, doc_id from rf join x on ref = doc_id),
u as (select {NUMBER.format('doc_id')} as k, min(doc_id) as doc_id from x group by 1 having count(*) = 1 and k is not null) select * from ex union all select ref, u.doc_id from rf join u on k = {NUMBER.format('ref')} where ref not in (select ref from ex)""",
    "c4_decompose": FACTS + " select fact, qid, n, option_id, ask, array_to_string(docs, ',') as docs from fa",
    "c4_evidence": EVIDENCE + " select * from ev",
    "c4_evidence_pool": POOLED + " select qid, place, chunk_id, before from e4 where before < 18000",
    "c4_outline": """with h as (select doc_id, seq, unnest(section_path) as heading, unnest(range(len(section_path))) as level from doc_chunks), f as (select doc_id, heading, min((seq, level)) as ats from h where heading != '' group by all)
select doc_id, heading, row_number() over (partition by doc_id order by ats, heading) as place from f""",
    "c4_best_window": CH
    + f""", w(term) as (values {', '.join(f"('{w}')" for w, _ in WORDS)}), hi as (select chunk_id as id, length(text) as len, term, unnest(list_filter(range(1, length(text) + 1), lambda i: substring(text, i, length(term)) = term)) as ats from ch, w where contains(text, term)), wi as (select distinct id, greatest(1, least(ats - 250, len - 499)) as start from hi),
x as (select wi.id, start, count(distinct term) as covered from wi join hi on hi.id = wi.id and ats >= start and ats < start + 500 group by all) select id, arg_max(start, (covered, -start))::int as start, max(covered) as covered from x group by id""",
    "c4_grep": CH + ", x as (select *, coalesce(contains(text, '应收账款'), false)::int as hit from ch), y as (select *, max(hit) over (partition by doc_id order by seq, chunk_id rows between 1 preceding and 1 following) as near from x) select doc_id, seq, chunk_id, hit from y where near = 1",
}


def _synonyms() -> str:
    """One branch a term, longest terms first; the list's distinct entries in order."""
    terms = sorted(((w, [x for x in g if x != w]) for g in r.SYNONYMS for w in g), key=lambda x: -len(x[0]))
    all_ = "flatten([" + ", ".join(f"case when contains(question, '{w}') then [" + ", ".join(f"'{x}'" for x in o) + "] else [] end" for w, o in terms) + "])"
    return f"with a as (select qid, question, list_filter({all_}, lambda x: not contains(question, x)) as z from questions), b as (select qid, question, list_filter(z, lambda v, i: list_position(z, v) = i) as z from a) select qid, case when len(z) > 0 then question || ' ' || array_to_string(z, ' ') else question end as expanded from b"


ORACLE["c4_synonyms"] = _synonyms()
