"""Evaluation texts leaking into training text: greedy string tiling with running Karp-Rabin seeds.

Texts are reduced to letters and digits in lower case. The windows of SEED characters of all test questions and passages are hashed; a rolling hash
over each document, made for the whole of it, gives the shared seeds. Seeds of a document and an item are extended to maximal matches; the longest that overlaps no
tile yet becomes a tile, again and again, until none of SEED characters is left. A document leaks an item if a tile is long enough or the tiles together
cover enough of the question or the passage, which also catches reordered passages.

The test set is the stated query set: it is taken in blocks of at most BLOCK_CHARS characters, each broadcast and held against all documents. Null and empty texts
leak nothing; items without text are never leaked; repeated items give one row; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import codes, map_arrow, passes
from orrery.tables import table

SEED, LONGEST, COVERAGE, BLOCK_CHARS = 30, 50, 0.6, 5_000_000
BASE = 0x9E3779B97F4A7C15 | 1
TABLE_BITS = 22


@functools.cache
def lower_table() -> np.ndarray:
    """Code point -> code point of its lower case if a letter or digit, else 0."""
    t = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalnum():
            low = ch.lower()
            t[cp] = ord(low) if len(low) == 1 else cp
    return t


@functools.cache
def random_table() -> np.ndarray:
    x = np.arange(0x110000, dtype=np.uint64) + np.uint64(0x1234567)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, dtype=np.uint64))
        down = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64))
    return up, down


def rolling(c: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` codes."""
    n = len(c)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(1 << max(20, int(n).bit_length()))
    with np.errstate(over="ignore"):
        h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(random_table()[c] * up[:n])])
        return (h[width:] - h[:-width]) * down[: n - width + 1]


def reduced(text: str) -> np.ndarray:
    c = lower_table()[codes(text)]
    return c[c != 0]


def tiles(doc: str, item: str, seeds: list[tuple[int, int]], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length) from shared seeds (positions in doc and item)."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for i, j in seeds:
        by_diagonal[i - j].append(i)
    found = []
    for d, starts in by_diagonal.items():
        reach = -1
        for i in sorted(starts):
            if i < reach or doc[i : i + least] != item[i - d : i - d + least]:
                continue
            j = i - d
            lo = 0
            while i - lo > 0 and j - lo > 0 and doc[i - lo - 1] == item[j - lo - 1]:
                lo += 1
            hi = least
            while i + hi < len(doc) and j + hi < len(item) and doc[i + hi] == item[j + hi]:
                hi += 1
            found.append((lo + hi, i - lo, j - lo))
            reach = i + hi
    out: list[tuple[int, int, int]] = []
    in_doc, in_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    heap = [(-n, i, j) for n, i, j in found]
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = in_doc[i : i + n] | in_item[j : j + n]
        if taken.any():  # what is left of it competes again by its length
            edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.view(np.int8), [1]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= least:
                    heapq.heappush(heap, (a - b, i + a, j + a))
            continue
        in_doc[i : i + n], in_item[j : j + n] = True, True
        out.append((i, j, n))
    return out


class Items:
    """Seed windows of a block of test texts."""

    def __init__(self, texts: list[tuple[str, str, str]]):
        self.keys = [(q, part) for q, part, _ in texts]
        self.text = [reduced(t) for _, _, t in texts]
        h = [rolling(c, SEED) for c in self.text]
        self.item = np.repeat(np.arange(len(h)), np.array([len(x) for x in h], dtype=int))
        self.at = np.concatenate([np.arange(len(x)) for x in h] or [np.zeros(0, int)])
        all_ = np.concatenate(h or [np.zeros(0, np.uint64)])
        order = np.argsort(all_, kind="stable")
        self.hash, self.item, self.at = all_[order], self.item[order], self.at[order]
        self.text = [c.tobytes().decode("utf-32-le", "surrogatepass") for c in self.text]


ARROW = pa.schema([("doc_id", pa.int64()), ("qid", pa.string()), ("part", pa.string()), ("n_tiles", pa.int32()), ("longest", pa.int32()), ("coverage", pa.float64())])


def leaks(docs: DataFrame, items: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, qid, part, n_tiles, longest, coverage) of every document and test text that share a seed; items: qid, part, text."""
    items = items.where("qid is not null and length(text) > 0").select("qid", "part", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    sc = docs.sparkSession.sparkContext
    docs = docs.where(F.col(id_).isNotNull() & (F.length(text) >= SEED)).select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).orderBy("qid", "part", "text").collect()  # a block of the test set, of bounded size
        block = sc.broadcast([(r["qid"], r["part"], r["text"]) for r in rows])
        part = map_arrow(docs, _tile(block), "doc_id bigint, qid string, part string, n_tiles int, longest int, coverage double", ARROW)
        out = part if out is None else out.unionByName(part)
    return out


def _by_item(hit, doc, lo, hi, starts, it: Items):
    """(document, item, diagonal runs' first seeds) of the hits; hit k stands in the items' windows lo[k] to hi[k].

    Seeds that go on one diagonal step by step are one match, so only the first of each run is kept: a passage that many items share costs its runs,
    not its characters. Documents are taken one after another.
    """
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        n = hi[part] - lo[part]
        at = np.repeat(lo[part], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        d = int(doc[part[0]])
        pos, item, j = np.repeat(hit[part] - starts[d], n), it.item[at], it.at[at]
        o = np.lexsort((pos, pos - j, item))
        pos, item, j = pos[o], item[o], j[o]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (pos[1:] - j[1:] != pos[:-1] - j[:-1]) | (pos[1:] != pos[:-1] + 1)])
        pos, item, j = pos[new], item[new], j[new]
        for run in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(item)) + 1):
            yield d, int(item[run[0]]), list(zip(pos[run].tolist(), j[run].tolist(), strict=True))


def _tile(block):
    state: dict = {}

    def fn(cols):
        if "items" not in state:
            it = state["items"] = Items(block.value)
            state["bits"] = np.zeros(1 << TABLE_BITS, dtype=bool)
            state["bits"][it.hash >> np.uint64(64 - TABLE_BITS)] = True
        it, bits = state["items"], state["bits"]
        out = {f.name: [] for f in ARROW}
        texts, low = cols["text"], lower_table()
        for a, b in passes(texts):
            c = low[codes("".join(texts[a:b]))]
            ends = np.cumsum([len(x) for x in texts[a:b]])
            kept = c != 0
            ends = np.concatenate([[0], np.cumsum(kept)])[ends]
            c = c[kept]
            h = rolling(c, SEED)
            hit = np.flatnonzero(bits[h >> np.uint64(64 - TABLE_BITS)])
            lo, hi = np.searchsorted(it.hash, h[hit], "left"), np.searchsorted(it.hash, h[hit], "right")
            hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(ends, hit, side="right")
            inside = hit + SEED <= ends[doc]
            starts = np.concatenate([[0], ends[:-1]])
            for d, i, s in _by_item(hit[inside], doc[inside], lo[inside], hi[inside], starts, it):
                t = tiles(c[starts[d] : ends[d]].tobytes().decode("utf-32-le", "surrogatepass"), it.text[i], s)
                if t:
                    q, part = it.keys[i]
                    for name, v in zip(out, (cols["doc_id"][a + d], q, part, len(t), max(x[2] for x in t), sum(x[2] for x in t) / len(it.text[i])), strict=True):
                        out[name].append(v)
        return out

    return fn


def test_items(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    one = lambda c: q.select("qid", F.lit(c).alias("part"), F.col(c).alias("text"))
    return one("question").unionByName(one("passage"))


def p8_found(spark, sf_dir):
    """Documents with an item of which a tile has at least 50 characters."""
    return leaks(table(spark, sf_dir, "documents"), test_items(spark, sf_dir)).where(F.col("longest") >= LONGEST).select("doc_id", "qid").distinct()


def p8_leaks(spark, sf_dir):
    """Leaked items with the tiles' longest and coverage; also reordered passages, by coverage alone."""
    x = leaks(table(spark, sf_dir, "documents"), test_items(spark, sf_dir))
    return x.where((F.col("longest") >= LONGEST) | (F.col("coverage") >= COVERAGE)).withColumn("coverage", F.round("coverage", 4)).distinct()


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}

ORACLE = {
    "p8_found": r"""
with i as (select qid, unnest([question, passage]) as text from questions),
ri as (select distinct qid, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') as t from i where text is not null),
wi as (select distinct qid, substring(t, k, 50) as w from ri, lateral (select unnest(range(1, length(t) - 48)) as k)),
rd as (select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') as t from documents where text is not null),
wd as (select doc_id, substring(t, k, 50) as w from rd, lateral (select unnest(range(1, length(t) - 48)) as k))
select distinct doc_id, qid from wd join wi using (w)
"""
}
