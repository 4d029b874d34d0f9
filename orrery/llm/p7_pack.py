"""Filling sequences of fixed token capacity with documents: bulk-synchronous best fit.

Documents enter as runs of equal size (a distributed count by size, at most `capacity` rows, whatever the corpus). Rounds follow: runs and gaps are
sorted by range and swept downwards, so that each document run meets its successor, the smallest gap that still takes it; documents that want the same gap are
resolved by rank; gaps are updated; the next round begins. When a round places nothing, as many sequences open as the rest of the tokens needs,
seeded with the largest documents. The rounds give assignments of rank intervals, which the executors then apply to the documents: these are ranked
within their size by salted counts, so no document leaves the executors and no size, however common, gathers in one task.

Only texts longer than the capacity are divided, into full sequences and a rest. Null and empty texts have no tokens and get no row.
An empty table gives an empty result. Repeated texts under other ids are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import map_arrow
from orrery.tables import table

CAPACITY = 8192
#: Documents of one size and salt that are ranked in one task, about.
RANKED_AT_ONCE = 100_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, bins, copies a bin, first bin, offset): documents first rank .. of that size go, `copies` to each, into the bins."""
    left = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    done = dict.fromkeys(left, 0)
    gaps: list[tuple[int, int, int]] = []
    events, bins = [], 0

    def place(size: int, n_bins: int, copies: int, first_bin: int, gap: int) -> tuple[int, int, int]:
        events.append((size, done[size], n_bins, copies, first_bin, capacity - gap))
        done[size] += n_bins * copies
        left[size] -= n_bins * copies
        if not left[size]:
            del left[size]
        return gap - size * copies, first_bin, n_bins

    while left:
        after, stack, ahead = [], [], sorted(gaps)
        free, matched = 0, False
        for size in sorted(left, reverse=True):
            while ahead and ahead[-1][0] >= size:
                stack.append(ahead.pop())
                free += stack[-1][2]
            while stack and size in left:
                gap, first, n = stack.pop()
                copies = max(1, min(gap // size, -(-left[size] // max(free, 1))))
                free -= n
                fill = min(n, left[size] // copies)
                if not fill:
                    copies, fill = left[size], 1
                after.append(place(size, fill, copies, first, gap))
                matched = True
                if fill < n:
                    stack.append((gap, first + fill, n - fill))
                    free += n - fill
        gaps = [g for g in after + stack + ahead if g[0] > 0]
        if not matched and left:
            need = -(-sum(s * n for s, n in left.items()) // capacity)
            for size in sorted(left, reverse=True):
                n = min(need, left[size])
                gaps.append(place(size, n, 1, bins, capacity))
                bins, need = bins + n, need - n
                if not need:
                    break
            gaps = [g for g in gaps if g[0] > 0]
        merged: list[tuple[int, int, int]] = []
        for g in sorted(gaps, key=lambda g: (g[1],)):
            if merged and merged[-1][0] == g[0] and merged[-1][1] + merged[-1][2] == g[1]:
                merged[-1] = (g[0], merged[-1][1], merged[-1][2] + g[2])
            else:
                merged.append(g)
        gaps = merged
    return events


OUT = "doc_id bigint, part int, n_tokens int, bin bigint, offset int, divided boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("bin", pa.int64()), ("offset", pa.int32()), ("divided", pa.bool_())])


def pack(docs: DataFrame, tokens: Column, id_: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, n_tokens, bin, offset, divided) of every document with tokens; `tokens` counts them."""
    sized = docs.select(F.col(id_).cast("bigint").alias("doc_id"), tokens.cast("bigint").alias("n")).where("doc_id is not null and n > 0")
    parts = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("part"))
    parts = parts.select("doc_id", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("size"), (F.col("n") > capacity).alias("divided"))
    hist = {r["size"]: r["count"] for r in parts.groupBy("size").count().collect()}  # at most `capacity` rows
    events = np.array(sorted(plan(hist, capacity)), dtype=np.int64).reshape(-1, 6)
    salts = max(1, -(-max(hist.values(), default=0) // RANKED_AT_ONCE))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    w = W.partitionBy("size", "salt").orderBy("doc_id", "part")
    ranked = parts.withColumn("r", F.row_number().over(w) - 1)
    if salts > 1:
        n = parts.groupBy("size", "salt").count()
        before = n.withColumn("before", F.sum("count").over(W.partitionBy("size").orderBy("salt")) - F.col("count")).drop("count")
        ranked = ranked.join(before, ["size", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    plan_ = docs.sparkSession.sparkContext.broadcast(events)  # bounded by the capacity, not by the corpus

    def fn(cols):
        e = plan_.value
        size, r = np.array(cols["size"], dtype=np.int64), np.array(cols["r"], dtype=np.int64)
        key = e[:, 0] * (1 << 44) + e[:, 1]
        x = e[np.searchsorted(key, size * (1 << 44) + r, side="right") - 1]
        step = r - x[:, 1]
        return {"doc_id": cols["doc_id"], "part": cols["part"], "n_tokens": pa.array(size.astype(np.int32)), "bin": pa.array(x[:, 4] + step // x[:, 3]), "offset": pa.array((x[:, 5] + step % x[:, 3] * size).astype(np.int32)), "divided": cols["divided"]}

    return map_arrow(ranked.select("doc_id", "part", "size", "divided", F.col("r").cast("bigint").alias("r")), fn, OUT, ARROW)


def token_counts(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n) by a public byte-level vocabulary in the tiktoken format at `path`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])
    state: dict = {}

    def fn(cols):
        if "enc" not in state:
            import base64

            import tiktoken

            lines = open(path, "rb").read().splitlines()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            state["enc"] = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s", mergeable_ranks=ranks, special_tokens={})
        return {"doc_id": cols["doc_id"], "n": [len(state["enc"].encode_ordinary(t)) for t in cols["text"]]}

    return map_arrow(docs.select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"), fn, "doc_id bigint, n bigint", schema)


def packed(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), F.octet_length("text"))


def p7_found(spark, sf_dir):
    """Documents that the packing had to divide."""
    return packed(spark, sf_dir).where("divided").select("doc_id").distinct()


def p7_sequences(spark, sf_dir):
    """Every document's place in the training sequences."""
    return packed(spark, sf_dir)


def p7_use(spark, sf_dir):
    """How full the sequences are: their number, tokens, and the share used."""
    b = packed(spark, sf_dir).groupBy("bin").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return b.agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.sum("n").alias("n_parts"), (F.sum("used") / (F.count("*") * F.lit(CAPACITY))).alias("share_used"))


QUERIES = {"p7_found": p7_found, "p7_sequences": p7_sequences, "p7_use": p7_use}

ORACLE = {"p7_found": "select distinct doc_id from documents where strlen(text) > 8192"}
