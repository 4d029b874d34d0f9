"""Lexical retrieval: tokens, a built index, ranked search, neighbours, evidence pools, document routing and the facts of a question.

An index is built once for a chunk table and read by every search: postings with the chunk's length, statistics of the collection, of each document and of each
token in a document. Search runs for all queries in one join; top-k keeps the last key unique, so ties are settled by chunk id. Query tokens count
once, document tokens as often as they occur. Null texts have no tokens; queries without known tokens have no hits; empty tables give empty results. Hot tokens and
documents are split by AQE's skew join, as the postings joins are shuffled ones; per-token and per-chunk sums are partial before their shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import text as t
from orrery.session import written

K1, B, EPSILON, TOPK = 1.5, 0.75, 0.25, 8
POOL, COVER, NAMED, BEST, LEAD, RELATIVE, ROUTES = 18_000, 8, 5, 3, 1.3, 0.4, 2
LATIN = r"[a-z0-9_%\x{df}-\x{f6}\x{f8}-\x{ff}]+"
HAN = r"[\x{4e00}-\x{9fff}]"
# Terms of the domain that stay whole, words that carry no content, and groups of words that mean the same.
TERMS = "营业收入 营业总收入 归母净利润 归属于上市公司股东的净利润 经营活动产生的现金流量净额 研发投入 研发费用 现金分红 受益所有人 尽职调查 特别决议 普通决议 资产负债率 身故保险金 退保金额 现金价值 保单账户价值 复合增速 银保渠道 募集资金 受托管理人 主体信用评级".split()
STOP = "的 了 和 与 及 或 在 是 对 为 以 上 下 中 等 之 其 该 本 个 我 会 并 并且 以及 根据 关于 下列 哪些 正确 说法 描述 选项".split()
SYNONYMS = [
    ["保单贷款", "保单借款", "借款", "质押贷款", "保险单借款"],
    ["现金价值", "退保金", "退保价值"],
    ["现金分红", "派息", "分红", "股息", "现金红利"],
    ["研发投入", "研发费用", "研发支出"],
    ["营业收入", "营业总收入", "营收"],
    ["净利润", "归母净利润"],
    ["资产负债率", "负债率"],
    ["发行规模", "发行总额", "发行金额", "募集规模"],
    ["信用评级", "主体信用评级", "信用等级"],
    ["revenue", "income", "turnover"],
    ["premium", "contribution"],
]
ORDINALS = "一二三四五六七八九十"
BOTH = "均|都|两份|两者|双方|各|分别"
POSITION = f"第([{ORDINALS}0-9]+)[份篇]|前者|后者|前一[份篇]|后一[份篇]"
NAME = "(?i)(?:fc_)?text[_ ]?0*[0-9]+"
CONTRACTS = "financial_contracts"


def tokens(text: str | Column, drop_stop: bool = True, mode: str = "word") -> Column:
    """Tokens of a text in lower case: runs of Latin letters, digits and percent signs, terms of the domain, and of Han text every pair of neighbours (a
    character without one stays alone), so that a phrase is found wherever it stands; in the mode `char` every single character."""
    c = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    if mode == "char":
        out = F.regexp_extract_all(c, F.lit(r"[a-z0-9_%\x{df}-\x{f6}\x{f8}-\x{ff}\x{4e00}-\x{9fff}]"), F.lit(0))
    else:
        patterns = [(LATIN, 0), ("|".join(sorted(TERMS, key=lambda x: (-len(x), x))), 0), (f"(?=({HAN}{HAN}))", 1), (f"(?<!{HAN}){HAN}(?!{HAN})", 0)]
        out = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(g)) for p, g in patterns])
    return F.filter(out, lambda x: ~x.isin(*STOP)) if drop_stop else out


def chunks(df: DataFrame) -> DataFrame:
    """One row per chunk id: the one indexed last, whole."""
    cols = ["doc_id", "domain", "type", "breadcrumb", "text", "seq"]
    x = df.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("indexed_at", *cols)).alias("x"))
    return x.select("chunk_id", *[F.col("x." + c).alias(c) for c in cols])


def index_text() -> Column:
    """What of a chunk is indexed: its breadcrumb before its text."""
    return F.when(F.coalesce(F.col("breadcrumb"), F.lit("")) != "", F.concat("breadcrumb", F.lit(" "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))


def raw_idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def floored(raw: Column, mean: Column) -> Column:
    """A negative idf becomes EPSILON times the mean."""
    return F.when(raw < 0, EPSILON * mean).otherwise(raw)


@dataclass
class Index:
    """Tables of a built index.

    chunks (chunk_id, doc_id, domain, type, breadcrumb, text, seq), sizes (chunk_id, doc_id, dl), postings (chunk_id, doc_id, token, tf, dl), terms (token, df,
    idf), total (n, avgdl), doc_terms (doc_id, token, df), docs (doc_id, n, avgdl, mean).
    """

    chunks: DataFrame
    sizes: DataFrame
    postings: DataFrame
    terms: DataFrame
    total: DataFrame
    doc_terms: DataFrame
    docs: DataFrame


def build(df: DataFrame) -> Index:
    """The index of a chunk table, written to the shared folder: the chunk table is read once, later searches read only what they need."""
    ch = written(chunks(df), "doc_id")
    x = ch.repartition("chunk_id").select("chunk_id", "doc_id", tokens(index_text()).alias("t"))  # so that a chunk's tokens are counted where they are made
    x = x.select("chunk_id", "doc_id", F.size("t").alias("dl"), F.explode_outer("t").alias("token"))
    post = written(x.groupBy("chunk_id", "doc_id", "token").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")))  # a chunk without tokens keeps a row
    sizes = post.groupBy("chunk_id", "doc_id").agg(F.max("dl").alias("dl"))
    post = post.where("token is not null")
    total = written(sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    doc_terms = written(post.groupBy("doc_id", "token").agg(F.count("*").alias("df")), "doc_id")
    df_ = doc_terms.groupBy("token").agg(F.sum("df").alias("df")).join(F.broadcast(total), F.lit(True)).withColumn("raw", raw_idf(F.col("df"), F.col("n")))  # one row
    mean = df_.agg(F.avg("raw").alias("mean"))
    terms = written(df_.join(F.broadcast(mean), F.lit(True)).select("token", "df", floored(F.col("raw"), F.col("mean")).alias("idf")))  # one row
    docs = sizes.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    means = doc_terms.join(docs, "doc_id").groupBy("doc_id").agg(F.avg(raw_idf(F.col("df"), F.col("n"))).alias("mean"))
    return Index(ch, sizes, post, terms, total, doc_terms, written(docs.join(means, "doc_id", "left")))


def queries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(qid, token): distinct tokens of each query."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("qid"), F.explode(F.array_distinct(tokens(text))).alias("token")).distinct()


def gain(avgdl: str = "avgdl") -> Column:
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col(avgdl)))


def topk(scored: DataFrame, by: str = "qid", k: int = TOPK) -> DataFrame:
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", r).where(F.col("rank") <= k)


def score_all(q: DataFrame, ix: Index, cand: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, doc_id, score) with collection-wide statistics, of all chunks that share a token; with `cand` only those of each query's documents (qid, doc_id),
    which are looked up by (document, token) before anything is scored."""
    want = q.join(ix.terms.select("token", "idf"), "token")
    hits = ix.postings.join(want, "token") if cand is None else ix.postings.join(want.join(cand, "qid"), ["doc_id", "token"])
    hits = hits.join(F.broadcast(ix.total), F.lit(True))  # one row
    return hits.groupBy("qid", "chunk_id", "doc_id").agg(F.round(F.sum(gain()), 6).alias("score"))


def search(q: DataFrame, ix: Index, k: int = TOPK) -> DataFrame:
    return topk(score_all(q, ix), k=k)


def search_docs(q: DataFrame, cand: DataFrame, ix: Index, k: int = TOPK) -> DataFrame:
    """As `search`, among the chunks of each query's candidate documents (qid, doc_id)."""
    return topk(score_all(q, ix, cand), k=k)


def search_local(q: DataFrame, cand: DataFrame, ix: Index, k: int = TOPK) -> DataFrame:
    """Statistics made anew from each query's candidate documents; chunks that share no token score 0 and fill up the k."""
    own = cand.join(ix.docs, "doc_id").groupBy("qid").agg(F.sum("n").alias("n"), (F.sum(F.col("avgdl") * F.col("n")) / F.sum("n")).alias("avgdl"))
    df = cand.join(ix.doc_terms, "doc_id").groupBy("qid", "token").agg(F.sum("df").alias("df")).join(own, "qid").withColumn("raw", raw_idf(F.col("df"), F.col("n")))
    mean = df.groupBy("qid").agg(F.avg("raw").alias("mean"))
    idf = df.join(q, ["qid", "token"]).join(mean, "qid").select("qid", "token", "avgdl", floored(F.col("raw"), F.col("mean")).alias("idf"))
    hits = ix.postings.join(idf.join(cand, "qid"), ["doc_id", "token"])
    s = hits.groupBy("qid", "chunk_id", "doc_id").agg(F.sum(gain()).alias("s"))
    every = cand.join(ix.sizes.select("chunk_id", "doc_id"), "doc_id")
    return topk(every.join(s, ["qid", "chunk_id", "doc_id"], "left").select("qid", "chunk_id", "doc_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score")), k=k)


def search_each(q: DataFrame, cand: DataFrame, ix: Index, k: int) -> DataFrame:
    """(qid, doc_id, chunk_id, score, rank): the k best chunks in each of a query's documents, by the document's own statistics; chunks that share no token score 0."""
    df = q.join(cand, "qid").join(ix.doc_terms, ["doc_id", "token"]).join(ix.docs, "doc_id")
    idf = df.select("qid", "doc_id", "token", "avgdl", floored(raw_idf(F.col("df"), F.col("n")), F.col("mean")).alias("idf"))
    s = ix.postings.join(idf, ["doc_id", "token"]).groupBy("qid", "doc_id", "chunk_id").agg(F.sum(gain()).alias("s"))
    every = cand.join(ix.sizes.select("chunk_id", "doc_id"), "doc_id")
    x = every.join(s, ["qid", "doc_id", "chunk_id"], "left").select("qid", "doc_id", "chunk_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))
    r = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "chunk_id"))
    return x.withColumn("rank", r).where(F.col("rank") <= k)


def hits_from_ids(ids: DataFrame, ch: DataFrame) -> DataFrame:
    """Chunks for (qid, ids) in the given order with score 0; unknown ids are dropped."""
    x = ids.select("qid", F.posexplode("ids").alias("pos", "chunk_id"))
    return x.join(ch.select("chunk_id", "doc_id"), "chunk_id").select("qid", "pos", "chunk_id", "doc_id", F.lit(0.0).alias("score"))


def neighbours(hits: DataFrame, ch: DataFrame, width: int = 1) -> DataFrame:
    """Chunks of the same document with 0 < |difference of seq| <= width: equi-joins on the shifted seq."""
    at = hits.join(ch.select("chunk_id", "seq"), "chunk_id").select(*hits.columns, "seq")
    near = at.withColumn("to", F.explode(F.array(*[F.col("seq") + d for d in range(-width, width + 1) if d])))
    return near.join(ch.select("doc_id", F.col("seq").alias("to"), F.col("chunk_id").alias("neighbour")), ["doc_id", "to"]).select("qid", "chunk_id", "neighbour")


def backfill(hits: DataFrame, ch: DataFrame) -> DataFrame:
    """Hits with their neighbours in groups sorted by seq, in hit order; each chunk stays at its first place: (qid, chunk_id, place)."""
    near = neighbours(hits, ch).select("qid", "chunk_id", F.col("neighbour").alias("c")).unionByName(hits.select("qid", "chunk_id", F.col("chunk_id").alias("c")))
    x = near.join(hits.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"]).join(ch.select(F.col("chunk_id").alias("c"), "seq"), "c")
    first = x.groupBy("qid", "c").agg(F.min(F.struct("rank", "seq")).alias("at"))
    return first.select("qid", F.col("c").alias("chunk_id"), F.row_number().over(W.partitionBy("qid").orderBy("at", "c")).alias("place"))


def pool(placed: DataFrame, ch: DataFrame, cap: int = POOL) -> DataFrame:
    """Chunks in place order until their lengths reach the cap; the one that crosses it is in."""
    x = placed.join(ch.select("chunk_id", F.length("text").alias("n")), "chunk_id")
    before = F.coalesce(F.sum("n").over(W.partitionBy("qid").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("before", before).where(F.col("before") < cap).select("qid", "place", "chunk_id", "before")


def round_robin(local: DataFrame) -> DataFrame:
    """Per-document rankings merged in turn: by rank within the document, then the document."""
    r = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "chunk_id"))
    x = local.withColumn("in_doc", r)
    return x.select("qid", "chunk_id", "doc_id", "in_doc", F.row_number().over(W.partitionBy("qid").orderBy("in_doc", "doc_id", "chunk_id")).alias("place"))


def cover(ch: DataFrame, first: int = COVER) -> DataFrame:
    """The first chunks of each document that are neither image marks nor shorter than 3."""
    x = t.stripped(F.col("text"))
    x = ch.where((F.length(x) >= 3) & ~x.contains("img_in_") & ~x.startswith("<div><img"))
    r = F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "chunk_id"))
    return x.withColumn("r", r).where(F.col("r") <= first).select("doc_id", "chunk_id", "r")


def doc_rank(scored: DataFrame, best: int = 1) -> DataFrame:
    """Documents by the sum of their best chunk scores (1: max pooling): (qid, doc_id, score, rank)."""
    r = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "chunk_id"))
    x = scored.withColumn("r", r).where(F.col("r") <= best).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


# ---- routing: a query with its candidates in order (qid, ask, cand) goes to the documents likely to hold the answer ----


def has_run(text: Column, name: Column, n: int = NAMED) -> Column:
    """Whether two short texts share a substring of n characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - (n - 1), F.lit(1)))
    return F.coalesce((F.length(name) >= n) & F.exists(starts, lambda i: F.contains(text, F.substring(name, i, F.lit(n)))), F.lit(False))


def shared_run(text: Column, name: Column) -> Column:
    """Length of the longest substring that a text shares with a short name, found by halving: a substring of n characters has one of n - 1."""
    span = F.struct(F.lit(0).alias("lo"), F.coalesce(F.least(F.length(text), F.length(name)), F.lit(0)).alias("hi"))

    def shares(n):
        starts = F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1)))
        return (n <= F.length(name)) & F.exists(starts, lambda i: F.contains(text, F.substring(name, i, n)))

    def halve(s, _):
        mid = ((s.lo + s.hi + 1) / 2).cast("int")
        ok = shares(mid)
        return F.when(s.lo >= s.hi, s).otherwise(F.struct(F.when(ok, mid).otherwise(s.lo).alias("lo"), F.when(ok, s.hi).otherwise(mid - 1).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), span, halve).lo


def identity_route(asks: DataFrame, names: DataFrame, n: int = NAMED) -> DataFrame:
    """(qid, doc_id): the one candidate whose name the ask shares n characters with, where at least two candidates have a name and no other is named."""
    x = asks.select("qid", "ask", F.explode("cand").alias("doc_id")).join(names.where("name != ''"), "doc_id")
    x = x.withColumn("hit", has_run(F.col("ask"), F.col("name"), n))
    return x.groupBy("qid").agg(F.count_distinct("doc_id").alias("k"), F.count_distinct(F.when(F.col("hit"), F.col("doc_id"))).alias("h"), F.min(F.when(F.col("hit"), F.col("doc_id"))).alias("doc_id")).where("k >= 2 and h = 1").select("qid", "doc_id")


def trailing_number(c: Column) -> Column:
    """Value of the last run of digits in a text."""
    return F.regexp_extract(c, "([0-9]+)[^0-9]*$", 1).try_cast("decimal(38,0)")


def match_reference(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref, doc_id) by exact id, else by the value of the last number, if only one document has it."""
    exact = refs.join(docs.select("doc_id"), refs.ref == F.col("doc_id")).select("ref", "doc_id")
    u = docs.select("doc_id", trailing_number(F.col("doc_id")).alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    rest = refs.join(exact.select("ref"), "ref", "left_anti").withColumn("k", trailing_number(F.col("ref"))).where("k is not null").join(u, "k").select("ref", "doc_id")
    return exact.unionByName(rest)


def named_in(ask: Column, cand: Column) -> Column:
    """Candidates that an ask points at by position words, document names or ids: at most ROUTES, in that order."""
    words = F.regexp_extract_all(ask, F.lit(POSITION), F.lit(0))
    nth = lambda w: F.regexp_extract(w, f"第([{ORDINALS}0-9]+)", 1)
    at = F.transform(words, lambda w: F.when(w.contains("前"), 1).when(w.contains("后"), 2).otherwise(F.coalesce(F.nullif(F.when(F.length(nth(w)) == 1, F.instr(F.lit(ORDINALS), nth(w))).otherwise(0), F.lit(0)), nth(w).try_cast("int"))))
    by_place = F.transform(F.filter(at, lambda i: (i >= 1) & (i <= F.size(cand))), lambda i: F.element_at(cand, i))
    names = F.regexp_extract_all(ask, F.lit(NAME), F.lit(0))

    def one(name):
        same = F.filter(cand, lambda c: trailing_number(c) == trailing_number(name))
        return F.when(F.array_contains(cand, name), name).when(F.size(same) == 1, F.element_at(same, 1))

    by_id = F.filter(cand, lambda c: (F.length(c) >= 4) & F.contains(ask, c))
    return F.slice(F.array_distinct(F.concat(by_place, F.array_compact(F.transform(names, one)), by_id)), 1, ROUTES)


def route_fact(facts: DataFrame, ix: Index) -> DataFrame:
    """(qid, docs) for facts (qid, ask, cand): what the ask names, else the documents by their best chunk with collection-wide statistics: two for words that span
    documents, else those of at least RELATIVE of the best score; the first candidates where nothing scores."""
    x = facts.withColumn("named", named_in(F.col("ask"), F.col("cand")))
    cand = x.select("qid", F.explode("cand").alias("doc_id")).distinct()
    ranked = doc_rank(score_all(queries(x, "qid", "ask"), ix, cand)).where("score > 0")
    top = ranked.withColumn("best", F.max("score").over(W.partitionBy("qid"))).where(F.col("rank") <= ROUTES)
    got = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", (F.col("score") >= RELATIVE * F.col("best")).alias("near")))), lambda r: F.struct(r.doc_id.alias("doc_id"), r.near.alias("near"))).alias("found"))  # ROUTES rows
    y = x.join(got, "qid", "left")
    found = F.transform(F.filter("found", lambda r: r.near | F.col("ask").rlike(BOTH)), lambda r: r.doc_id)
    return y.select("qid", F.when(F.size("named") > 0, F.col("named")).when(F.col("found").isNotNull(), found).otherwise(F.slice("cand", 1, ROUTES)).alias("docs"))


def route(asks: DataFrame, ix: Index, names: DataFrame) -> DataFrame:
    """(qid, doc_id, place): ordinal words, else the named document, else the best documents by the sum of their BEST chunks: the first alone if it leads by
    LEAD; of two that differ by the year only, the one whose year is asked for."""
    pats = [("第一份|第1份|第一篇|前者|首份", 1), ("第二份|第2份|第二篇|后者", 2), ("第三份|第3份|第三篇", 3), ("第四份|第4份|第四篇", 4)]
    by_word = None
    for p, i in pats:
        hit = F.col("ask").rlike(p) & (F.size("cand") >= i)
        by_word = F.when(hit, F.lit(i)) if by_word is None else by_word.when(hit, F.lit(i))
    x = asks.withColumn("word", by_word)
    one = x.where("size(cand) = 1 or word is not null").select("qid", F.element_at("cand", F.coalesce("word", F.lit(1))).alias("doc_id"), F.lit(1).alias("place"))
    rest = x.where("size(cand) > 1 and word is null")
    ident = identity_route(rest, names).withColumn("place", F.lit(1))
    rest = rest.join(ident.select("qid"), "qid", "left_anti")
    cand = rest.select("qid", F.explode("cand").alias("doc_id")).distinct()
    ranked = doc_rank(score_all(queries(rest, "qid", "ask"), ix, cand), BEST).where("score > 0")
    w = W.partitionBy("qid").orderBy("rank")
    r = ranked.withColumn("next", F.lead("score").over(w)).withColumn("second", F.lead("doc_id").over(w)).join(rest.select("qid", "ask"), "qid")
    stem = lambda c: F.regexp_replace(c, "20[0-9]{2}", "")
    years = F.array_distinct(F.regexp_extract_all("ask", F.lit("20[0-9]{2}"), F.lit(0)))
    decides = F.filter(years, lambda y: F.contains(F.col("doc_id"), y) != F.contains(F.col("second"), y))
    first = r.where("rank = 1").select("qid", "doc_id", "second", F.when(F.col("next").isNull() | (F.col("score") >= LEAD * F.col("next")), F.array("doc_id")).when((stem(F.col("doc_id")) == stem(F.col("second"))) & (F.size(decides) > 0), F.array(F.when(F.contains(F.col("doc_id"), F.element_at(decides, 1)), F.col("doc_id")).otherwise(F.col("second")))).otherwise(F.array("doc_id", "second")).alias("docs"))
    got = first.select("qid", F.posexplode("docs").alias("p", "doc_id")).select("qid", "doc_id", (F.col("p") + 1).alias("place"))
    none = rest.join(first.select("qid"), "qid", "left_anti").select("qid", F.posexplode("cand").alias("p", "doc_id")).select("qid", "doc_id", (F.col("p") + 1).alias("place"))
    return one.unionByName(ident).unionByName(got).unionByName(none)


def decompose(q: DataFrame, ix: Index, names: DataFrame) -> DataFrame:
    """(fact, qid, n, option_id, ask, docs): one fact per option A to D with the documents its text leads to (one for the question itself if it is a true-false one or
    has fewer than two options), and one of the question per candidate that question or options name; the first of equal (ask, docs) stays."""
    keys = F.filter(F.array_sort(F.map_keys(F.coalesce("options", F.create_map().cast("map<string,string>")))), lambda k: k.isin("A", "B", "C", "D"))
    x = q.where("qid is not null").dropDuplicates(["qid"]).select("qid", "question", "options", F.coalesce("doc_ids", F.array().cast("array<string>")).alias("cand"), keys.alias("keys"), F.coalesce(F.col("answer_format") == "tf", F.lit(False)).alias("tf"))
    whole = F.col("tf") | (F.size("keys") < 2)
    asked = F.when(whole, F.array(F.struct(F.lit("shared").alias("option_id"), F.col("question").alias("ask")))).otherwise(F.transform("keys", lambda k: F.struct(k.alias("option_id"), F.element_at("options", k).alias("ask"))))
    one = x.select("qid", "cand", F.posexplode(asked).alias("n", "f")).select("qid", "cand", "n", "f.option_id", t.normalize(F.coalesce("f.ask", F.lit(""))).alias("ask"))
    one = one.withColumn("fact", F.concat_ws("/", "qid", "option_id"))
    routed = route_fact(one.select(F.col("fact").alias("qid"), "ask", "cand"), ix).withColumnRenamed("qid", "fact")
    one = one.join(routed, "fact").select("qid", "n", "option_id", "ask", "docs")
    blob = F.concat_ws(" ", "question", F.array_join(F.map_values("options"), " "))
    said = x.select("qid", "question", blob.alias("blob"), F.posexplode("cand").alias("n", "doc_id")).join(names.where("name != ''"), "doc_id").where(has_run(F.col("blob"), F.col("name")))
    said = said.select("qid", (F.col("n") + 100).alias("n"), F.lit("shared").alias("option_id"), t.normalize(F.coalesce("question", F.lit(""))).alias("ask"), F.array("doc_id").alias("docs"))
    r = F.row_number().over(W.partitionBy("qid", "ask", "docs").orderBy("n"))
    y = one.unionByName(said).where("ask != ''").withColumn("r", r).where("r = 1")
    y = y.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("n")))
    return y.select(F.concat(F.col("qid"), F.lit("/f"), F.col("n").cast("string")).alias("fact"), "qid", "n", "option_id", "ask", "docs")


def evidence(facts: DataFrame, domains: DataFrame, ix: Index, k: int = TOPK) -> DataFrame:
    """(fact, doc_id, chunk_id, place): the k best chunks of each of a fact's documents; of contracts three times as many are ranked and scoring cover chunks come first."""
    asks = facts.select(F.col("fact").alias("qid"), "ask")
    cand = facts.select(F.col("fact").alias("qid"), F.explode("docs").alias("doc_id")).distinct()
    fc = facts.select(F.col("fact").alias("qid"), F.col("qid").alias("q")).join(domains.select(F.col("qid").alias("q"), "domain"), "q").where(F.col("domain") == CONTRACTS).select("qid", F.lit(True).alias("fc"))
    hits = search_each(queries(asks, "qid", "ask"), cand, ix, 3 * k).join(fc, "qid", "left").where(F.coalesce("fc", F.lit(False)) | (F.col("rank") <= k))
    covers = cover(ix.chunks.join(cand.select("doc_id").distinct(), "doc_id", "left_semi")).select("chunk_id", F.lit(True).alias("cover"))
    first = F.when(F.coalesce(F.col("fc") & F.col("cover") & (F.col("score") > 0), F.lit(False)), 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(first, "rank"))
    return hits.join(covers, "chunk_id", "left").withColumn("place", place).where(F.col("place") <= k).select(F.col("qid").alias("fact"), "doc_id", "chunk_id", "place")


def evidence_pool(facts: DataFrame, ev: DataFrame, ix: Index, names: DataFrame, cap: int = POOL) -> DataFrame:
    """(qid, place, chunk_id, before): evidence of a question's facts in order with its neighbours, each chunk at its first place, with the length of the labelled blocks
    before it; it ends with the block that reaches the cap."""
    doc_at = facts.select("fact", "qid", "n", F.posexplode("docs").alias("d", "doc_id"))
    h = ev.join(doc_at, ["fact", "doc_id"]).select("qid", "n", "d", "place", "doc_id", "chunk_id").join(ix.chunks.select("chunk_id", "seq"), "chunk_id")
    to = h.withColumn("to", F.explode(F.array(F.col("seq") - 1, F.col("seq"), F.col("seq") + 1)))
    near = to.where("to != seq").join(ix.chunks.select("doc_id", F.col("seq").alias("to"), F.col("chunk_id").alias("c")), ["doc_id", "to"]).select("qid", "n", "d", "place", "to", "c")
    every = near.unionByName(h.select("qid", "n", "d", "place", F.col("seq").alias("to"), F.col("chunk_id").alias("c")))
    first = every.groupBy("qid", "c").agg(F.min(F.struct("n", "d", "place", "to")).alias("at"))
    info = ix.chunks.join(names, "doc_id", "left").select(F.col("chunk_id").alias("c"), (F.length(F.substring(F.coalesce(F.nullif("name", F.lit("")), "doc_id"), 1, 40)) + F.length(F.coalesce(F.nullif("breadcrumb", F.lit("")), "type", F.lit(""))) + F.length("text") + 6).alias("n_chars")).where("n_chars is not null")
    w = W.partitionBy("qid").orderBy("at", "c")
    x = first.join(info, "c").withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("n_chars").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return x.where(F.col("before") < cap).select("qid", "place", F.col("c").alias("chunk_id"), "before")


def outline(ch: DataFrame) -> DataFrame:
    """(doc_id, place, heading): distinct headings of a document in order of first occurrence."""
    h = ch.select("doc_id", "seq", F.posexplode("section_path").alias("level", "heading")).where("heading != ''")
    first = h.groupBy("doc_id", "heading").agg(F.min(F.struct("seq", "level")).alias("at"))
    return first.select("doc_id", "heading", F.row_number().over(W.partitionBy("doc_id").orderBy("at", "heading")).alias("place"))


def expand(text: str) -> Column:
    """A query with the synonyms of its terms that it lacks: terms from the longest on (in the order of the groups), each synonym once."""
    c = F.col(text)
    terms = sorted(((w, [x for x in g if x != w]) for g in SYNONYMS for w in g), key=lambda x: -len(x[0]))
    add = F.array_distinct(F.concat(*[F.when(c.contains(w), F.array(*[F.lit(x) for x in others])).otherwise(F.array().cast("array<string>")) for w, others in terms]))
    add = F.filter(add, lambda x: ~F.contains(c, x))
    return F.when(F.size(add) > 0, F.concat(c, F.lit(" "), F.array_join(add, " "))).otherwise(c)


def best_window(df: DataFrame, terms: DataFrame, width: int = 500) -> DataFrame:
    """(id, start, covered): the window centred on a hit of a term that covers most distinct terms, the first on ties; start counts from 1."""
    x = _hits(df, terms)
    w = x.select("id", "len", F.greatest(F.lit(1), F.least(F.col("at") - width // 2, F.col("len") - width + 1)).alias("start")).distinct()
    y = w.join(x, "id").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + width)).groupBy("id", "start").agg(F.count_distinct("term").alias("covered"))
    return y.groupBy("id").agg(F.max(F.struct("covered", (-F.col("start")).alias("s"))).alias("b")).select("id", (-F.col("b.s")).alias("start"), F.col("b.covered").alias("covered"))


def _hits(df: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, len, term, at): every place of every term."""
    x = df.join(terms, "id").where(F.contains("text", F.col("term")))
    parts = F.split("text", F.concat(F.lit("\\Q"), F.col("term"), F.lit("\\E")), F.lit(-1))
    x = x.select("id", F.length("text").alias("len"), "term", F.length("term").alias("n"), F.transform(parts, lambda p: F.length(p)).alias("gaps"))
    x = x.select("id", "len", "term", "n", F.posexplode(F.slice("gaps", 1, F.size("gaps") - 1)).alias("k", "gap"))
    at = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy("id", "term").orderBy("k")) - F.col("n") + 1
    return x.select("id", "len", "term", at.alias("at"))


def grep(ch: DataFrame, word: str, context: int = 1) -> DataFrame:
    """Chunks within `context` of one that holds the word, with the hit marked."""
    x = ch.withColumn("hit", F.coalesce(F.col("text").contains(word), F.lit(False)).cast("int"))
    near = F.max("hit").over(W.partitionBy("doc_id").orderBy("seq", "chunk_id").rowsBetween(-context, context))
    return x.withColumn("near", near).where("near = 1").select("doc_id", "seq", "chunk_id", "hit")
