"""How distinctive a term is per document: residual inverse document frequency times record frequency.

score = tf * (idf - E[idf]) with idf = -log2(df / N) and, under a Poisson model of cf occurrences spread over N documents,
E[idf] = -log2(1 - exp(-cf / N)). Terms scattered evenly get about 0, terms gathered in few documents get much.

Null or empty texts and null document ids give no terms; a repeated row (same chunk id) counts once; an empty table gives an
empty result; columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import latest
from orrery.tables import table

#: Latin run with single hyphens inside, and the marked title, as TESTDATA.md states a term.
LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ0-9]"
RUN = f"{LATIN}+(?:-{LATIN}+)*"
TITLE = "《([^《》]+)》"


def terms(text: str):
    """Array of all term occurrences of a text column."""
    c = F.col(text)
    latin = F.regexp_extract_all(F.regexp_replace(c, F.lit("《[^《》]*》"), F.lit(" ")), F.lit(RUN), F.lit(0))
    kept = F.filter(F.transform(latin, F.lower), lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9-]+$"))
    return F.concat(F.regexp_extract_all(c, F.lit(TITLE), F.lit(1)), kept)


def term_counts(chunks: DataFrame, chunk: str = "chunk_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, n_chunks) of all documents.

    The shuffle by chunk id spreads a hot document, and (chunk, term) counts are made inside it; the one by (document, term)
    moves partial sums only.
    """
    rows = chunks.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(chunk).alias("chunk_id"), F.col(doc).alias("doc_id"), terms(text).alias("terms"))
    rows = latest(rows.where(F.size("terms") > 0), "chunk_id", "doc_id", "terms")
    per_chunk = rows.select("chunk_id", "doc_id", F.explode("terms").alias("term")).groupBy("chunk_id", "doc_id", "term").agg(F.count("*").alias("n"))
    return per_chunk.groupBy("doc_id", "term").agg(F.sum("n").alias("tf"), F.count("*").alias("n_chunks"))


def residual_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """Adds df, cf and score to (doc_id, term, tf, n_chunks).

    The join on term is a shuffled one with AQE's split of hot terms; term statistics are made by partial sums.
    """
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    n = F.lit(float(max(n_docs, 1)))
    ridf = -F.log2(F.col("df") / n) + F.log2(F.lit(1.0) - F.exp(-F.col("cf") / n))
    return counts.join(stats, "term").select("doc_id", "term", "tf", "n_chunks", "df", "cf", (F.col("tf") * ridf).alias("score"))


def scored(spark, sf_dir) -> DataFrame:
    chunks = table(spark, sf_dir, "doc_chunks")
    n = chunks.select("doc_id").where("doc_id is not null").distinct().count()
    return residual_idf(term_counts(chunks), n)


def p3_found(spark, sf_dir):
    """Scored terms of at least 3 chunks of a document and of at most 5 documents."""
    return scored(spark, sf_dir).where("n_chunks >= 3 and df <= 5 and score is not null").select("doc_id", "term")


def p3_scores(spark, sf_dir):
    """The score of every term of every document."""
    return scored(spark, sf_dir).withColumn("score", F.round("score", 6))


def p3_top_terms(spark, sf_dir):
    """Each document's ten terms of the highest score (ties by term)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored(spark, sf_dir).where("score > 0").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("doc_id", "term", "rank", "tf", "df", F.round("score", 6).alias("score"))


QUERIES = {"p3_found": p3_found, "p3_scores": p3_scores, "p3_top_terms": p3_top_terms}

TERMS = """
with c as (select distinct chunk_id, doc_id, text from doc_chunks where text is not null and doc_id is not null),
t as (
  select chunk_id, doc_id, unnest(regexp_extract_all(text, '《([^《》]+)》', 1)) as term from c
  union all
  select chunk_id, doc_id, lower(x) from (select chunk_id, doc_id, unnest(regexp_extract_all(regexp_replace(text, '《[^《》]*》', ' ', 'g'),
    '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+(?:-[A-Za-zÀ-ÖØ-öø-ÿ0-9]+)*')) as x from c) where length(x) >= 3 and not regexp_full_match(x, '[0-9-]+')),
n as (select doc_id, term, count(*) as tf, count(distinct chunk_id) as n_chunks from t group by all),
d as (select term, count(*) as df, sum(tf)::bigint as cf from n group by term),
z as (select count(distinct doc_id)::double as n_docs from doc_chunks),
s as (select doc_id, term, tf, n_chunks, df, cf, tf * (-log2(df / n_docs) + log2(1 - exp(-cf / n_docs))) as score from n join d using (term), z)"""
ORACLE = {
    "p3_found": TERMS + " select doc_id, term from s where n_chunks >= 3 and df <= 5",
    "p3_scores": TERMS + " select doc_id, term, tf, n_chunks, df, cf, round(score, 6) as score from s",
    "p3_top_terms": TERMS + " select * from (select doc_id, term, row_number() over (partition by doc_id order by score desc, term) as rank, tf, df, round(score, 6) as score from s where score > 0) where rank <= 10",
}
