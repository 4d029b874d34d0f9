"""Sources and sinks: page folders, text and binary files, CSV and JSON results, index tables, graph archives."""

from __future__ import annotations

import io
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = ("pdf", "html", "htm", "txt", "md")


def documents_index(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, domain, ext) of the files below a root's domain folders; on a name clash the one that is no attachment wins, then the larger path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    x = f.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.element_at(F.split("path", "/"), -2).alias("domain"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext")).where(F.col("ext").isin(*WHITE))
    best = F.max(F.struct((~F.col("path").contains("attach")).alias("own"), "path", "domain", "ext")).alias("b")
    return x.groupBy("doc_id").agg(best).select("doc_id", "b.path", "b.domain", "b.ext")


def text_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, page, text): whole text files, form feeds part pages."""
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\f")).alias("page", "text"))
    return t.withColumn("page", F.col("page") + 1)


def write_quoted(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(detail, summary) rows of an answers CSV."""
    a = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return a.where("qid != 'summary'"), a.where("qid = 'summary'")


def parsed_pages(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, page_no, n_pages, markdown) of parsed documents: folders with a manifest.json and a file p<number>.md a page; pages beyond the manifest's number are left out."""
    folder = lambda c: F.regexp_extract(c, "([^/]+)/[^/]+$", 1)
    man = spark.read.option("multiLine", True).schema("n_pages int").json(f"{root}/*/manifest.json").select(folder(F.input_file_name()).alias("doc_id"), "n_pages")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "p*.md").load(f"{root}/*/")
    pages = raw.select(folder("path").alias("doc_id"), F.regexp_extract("path", r"p([0-9]+)\.md$", 1).try_cast("int").alias("page_no"), F.decode("content", "UTF-8").alias("markdown"))
    return pages.join(man, "doc_id").where("page_no between 1 and n_pages").select("doc_id", "page_no", "n_pages", "markdown")


#: Columns of the four recommendation files.
RECOMMENDATION = {
    "train": "uid string, item_seq_raw string, item_seq_dedup string, item_seq_counts string, target_iid string",
    "test": "uid string, item_seq_raw string, item_seq_dedup string, item_seq_counts string",
    "user": "uid string",
    "item": "iid string",
}


def recommendation(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four recommendation files by name; train and test with their de-duplicated sequence as a list in `seq`. Further columns of the files are kept as strings."""
    from orrery.operators.recsys import tokens

    out = {}
    for name, schema in RECOMMENDATION.items():
        df = spark.read.option("header", True).option("escape", '"').csv(f"{root}/{name}.csv")
        missing = [c for c in (x.split()[0] for x in schema.split(", ")) if c not in df.columns]
        df = df.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])
        out[name] = df.withColumn("seq", tokens("item_seq_dedup")) if name in ("train", "test") else df
    return out


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of HTML files, one page a file: what lies in main or article elements where there are any, else the whole page, as text."""
    from orrery.functions.text import html_text

    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))
    main = F.array_join(F.regexp_extract_all("html", F.lit("(?is)<(main|article)\\b[^>]*>(.*?)</\\1>"), F.lit(2)), "\n")
    return raw.select("path", F.lit(1).alias("page"), html_text(F.when(F.trim(main) != "", main).otherwise(F.regexp_replace("html", "(?is)<(nav|footer|aside)\\b.*?</\\1>", ""))).alias("text"))


def write_trials(log: DataFrame, path: str) -> None:
    """Trials appended as JSON lines."""
    log.write.mode("append").json(path)


def write_index(postings: DataFrame, path: str, parts: int = 8) -> None:
    """Postings spread by token, sorted, so that a query's tokens prune by their statistics."""
    postings.repartition(parts, "token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def graph_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of NPZ archives with a CSR adjacency, labels and the train rows (test labels are null). Read on an executor, not on the driver."""
    import pandas as pd

    def read(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                z = np.load(io.BytesIO(raw))
                n = len(z["adj_indptr"]) - 1
                src = np.repeat(np.arange(n), np.diff(z["adj_indptr"]))
                yield pd.DataFrame({"kind": "edge", "a": src.astype("int64"), "b": z["adj_indices"].astype("int64"), "split": ""})
                train = np.isin(np.arange(n), z["train_idx"])
                yield pd.DataFrame({"kind": "node", "a": np.arange(n), "b": z["labels"].astype("int64"), "split": np.where(train, "train", "test")})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "kind string, a bigint, b bigint, split string")
    return raw.where("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst")), raw.where("kind = 'node'").select(F.col("a").alias("node"), F.when(F.col("b") >= 0, F.col("b")).alias("label"), "split")


def safe_name(x: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "_", x)
