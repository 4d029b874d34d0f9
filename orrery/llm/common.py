"""Pieces that the text operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that one numpy pass takes at most (a longer text goes alone): bounds a worker's memory.
PASS_CHARS = 1_000_000


def passes(texts: list[str], limit: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of `texts` with at most `limit` characters each, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def codes(text: str) -> np.ndarray:
    """Code points of a text; lone surrogates stay as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow over plain Python lists: `fn` takes and returns columns by name."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out.values(), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per id: a repeated row has the same id and content, so any of them serves.

    The id, spread by its hash, is the shuffle key: no hot document or source can gather in one task.
    """
    return df.where(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])


#: Groups of at most so many members are written as all their pairs; larger ones in the compact form (see `pairs_in_groups`).
FULL_PAIRS = 64


def pairs_in_groups(df: DataFrame, group: list[str], cls: str, id_: str) -> DataFrame:
    """Pairs of ids of one group whose class differs, smaller id first.

    A group of more than FULL_PAIRS members is written compactly: each member of another class with the group's
    smallest id, and each further member of the smallest id's class with the smallest id of another class. As being in one
    group is an equivalence, that keeps every link between different classes without all pairs of a hot group.
    """
    g = df.groupBy(*group).agg(F.count("*").alias("_n"), F.min(F.struct(F.col(id_), F.col(cls))).alias("_root"), F.min(cls).alias("_lo"), F.max(cls).alias("_hi")).where("_lo < _hi")
    m = df.join(g.drop("_lo", "_hi"), group)
    small = m.where(F.col("_n") <= FULL_PAIRS).select(*group, F.col(cls), F.col(id_))
    a, b = small.withColumnsRenamed({cls: "_ca", id_: "_ia"}), small.withColumnsRenamed({cls: "_cb", id_: "_ib"})
    full = a.join(b, group).where("_ia < _ib and _ca != _cb").select(*group, F.col("_ia").alias("id_a"), F.col("_ib").alias("id_b"))
    big = m.where(F.col("_n") > FULL_PAIRS)
    other = big.where(F.col(cls) != F.col("_root." + cls))
    star = other.select(*group, F.col("_root." + id_).alias("id_a"), F.col(id_).alias("id_b"))
    second = other.groupBy(*group).agg(F.min(id_).alias("_second"))
    rest = big.where((F.col(cls) == F.col("_root." + cls)) & (F.col(id_) != F.col("_root." + id_))).join(second, group).select(*group, F.least(id_, "_second").alias("id_a"), F.greatest(id_, "_second").alias("id_b"))
    return full.unionByName(star).unionByName(rest)


#: Equal copies that one row holds, and rows of a group that one cell of the pairing takes (see `all_pairs`).
COPIES, CELL = 256, 32


def all_pairs(df: DataFrame, group: list[str], cls: str, id_: str) -> DataFrame:
    """Every pair of ids of one group whose class differs, smaller id first, whatever the group's size.

    Members of one class fold into rows of about COPIES ids, so pairs inside a class are never looked at; a group's rows meet in
    salted cells of about CELL x CELL rows, so a hot group is spread over tasks. `df` holds distinct rows.
    """
    n = df.groupBy(*group, cls).agg(F.ceil(F.count("*") / F.lit(COPIES)).cast("int").alias("_n"))
    g = n.groupBy(*group).agg(F.count("*").alias("_classes"), F.ceil(F.sum("_n") / F.lit(CELL)).cast("int").alias("_cells")).where("_classes > 1").drop("_classes")
    m = df.join(n.join(g, group), [*group, cls]).withColumn("_i", F.pmod(F.xxhash64(id_), F.col("_n")).cast("int"))
    folded = m.groupBy(*group, cls, "_i", "_cells").agg(F.collect_list(id_).alias("_ids"))  # about COPIES ids a row
    folded = folded.withColumn("_own", F.pmod(F.xxhash64(cls, "_i"), F.col("_cells")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    a = folded.select(*group, F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col(cls).alias("_ca"), F.col("_ids").alias("_a"))
    b = folded.select(*group, F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col(cls).alias("_cb"), F.col("_ids").alias("_b"))
    met = a.join(b, [*group, "_x", "_y"]).where("_ca < _cb")
    met = met.select(*group, F.explode("_a").alias("_ia"), "_b").select(*group, "_ia", F.explode("_b").alias("_ib")).where("_ia != _ib")
    return met.select(*group, F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b"))


def or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
