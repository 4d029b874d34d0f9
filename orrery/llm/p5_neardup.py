"""Near-duplicate chunks with small edits: bit-sliced comparison of sketches inside buckets, then the exact similarity.

A text's set holds the SHINGLE-character substrings of the text without white space in lower case. Stages:

1. Copies (equal text but for white space) fold into one representative by partial aggregation, so a hot group of copies is one row from here on.
2. Each representative gets BANDS x ROWS minimum hashes of its whole set (one-permutation hashing with rotation) and, from 128 of them, a sketch of one bit each.
3. Representatives that share a band's ROWS values meet in a bucket. Sorted by bucket, their sketches are stored as vertical bit planes; the distances of
   all rows to their d-th neighbour are counted together by carry-save adders, 64 rows a word, and blocks of words all of whose rows exceed RADIUS are abandoned.
   A bucket of more than HOT rows is cut into blocks, and pairs of blocks are spread over tasks.
4. The pairs left get the exact Jaccard similarity from their whole texts. Texts that no pair needs are kept out of that shuffle by a bitmap of fixed size.

A pair of similarity J is missed with probability (1 - J**ROWS)**BANDS plus that of its distance exceeding RADIUS: 0.7 % at J = 0.70, 0.03 % at 0.75, 2e-5 at 0.8.
Everything after that is exact. There is no cap on bucket sizes or partners.

Null texts, ids or types and texts below the least length take no part; repeated rows count once; empty tables give an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import FULL_PAIRS, codes, map_arrow, passes
from orrery.session import cut_lineage
from orrery.tables import table

SHINGLE, LEAST, SIMILARITY = 5, 300, 0.7
BANDS, ROWS, BINS, PERMUTATIONS, RADIUS, HOT, PROBE = 40, 6, 120, 2, 36, 8192, 64
BITMAP_BITS = 1 << 25
U = np.uint64


@functools.cache
def fold_table() -> np.ndarray:
    """Code point -> code point in lower case; 0 for white space."""
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x20000):
        ch = chr(cp)
        if ch.isspace():
            t[cp] = 0
        elif len(low := ch.lower()) == 1:
            t[cp] = ord(low)
    t[0] = 1
    return t


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of every text."""
    c = fold_table()[codes("".join(texts))]
    kept = c != 0
    ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum([len(t) for t in texts])]
    c = c[kept].astype(np.uint64)
    n = len(c) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            h = h * U(0x9E3779B97F4A7C15) + c[k : k + n]
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
    inside = doc[:n] == doc[width - 1 :]
    return mixed(h[inside]), doc[:n][inside]


def minima(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x (BINS * PERMUTATIONS) minimum hashes; an empty bin takes the next full one's value."""
    out = []
    for p in range(PERMUTATIONS):
        x = mixed(h + U(0x5851F42D4C957F2D + 2 * p)) if p else h
        bin_ = (x >> U(40)) * U(BINS) >> U(24)
        cell = doc.astype(np.uint64) * U(BINS) + bin_
        s = np.sort(cell << U(40) | x & U((1 << 40) - 1))
        first = np.ones(len(s), dtype=bool)
        first[1:] = s[1:] >> U(40) != s[:-1] >> U(40)
        s = s[first]
        v = np.zeros(n * BINS, dtype=np.uint64)
        full = np.zeros(n * BINS, dtype=bool)
        v[s >> U(40)], full[s >> U(40)] = s & U((1 << 40) - 1), True
        v, full = v.reshape(n, BINS), full.reshape(n, BINS)
        if not full.all():
            at = np.where(full, np.arange(BINS), 2 * BINS)
            at = np.concatenate([at, np.where(full, np.arange(BINS) + BINS, 2 * BINS)], axis=1)
            nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BINS]
            step = (nxt - np.arange(BINS)).astype(np.uint64)
            v = np.take_along_axis(v, np.minimum(nxt, 2 * BINS - 1) % BINS, axis=1) + (step << U(41))
        out.append(mixed(v + U(p + 1)))
    return np.concatenate(out, axis=1)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (n x BANDS) and sketches (n x 2 words)."""
    h, doc = shingles(texts)
    m = minima(h, doc, len(texts))
    bands = m[:, : BANDS * ROWS].reshape(len(texts), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(texts), BANDS)).copy()
        for r in range(ROWS):
            key = mixed(key * U(31) + bands[:, :, r])
    bits = (m[:, :128] & U(1)).astype(np.uint8)
    return key, np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def planes(sketch: np.ndarray) -> np.ndarray:
    """Bit planes: 128 rows of words, bit i of the plane k is bit k of row i's sketch."""
    bits = np.unpackbits(sketch.view(np.uint8).reshape(len(sketch), -1), axis=1, bitorder="little")
    pad = -len(bits) % 64 + 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, pad), (0, 0))).T, axis=1, bitorder="little")).view(np.uint64)


def shifted(p: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """The chosen words of a plane, moved down by d rows; beyond the end 0."""
    q, r = divmod(d, 64)
    a = words + q
    last = len(p) - 1
    lo = np.where(a <= last, p[np.minimum(a, last)], U(0))
    if not r:
        return lo
    hi = np.where(a + 1 <= last, p[np.minimum(a + 1, last)], U(0))
    return lo >> U(r) | hi << U(64 - r)


def close_pairs(run: np.ndarray, sketch: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of one run number whose sketches differ in at most `radius` bits; rows are sorted by run."""
    n = len(run)
    p = planes(sketch)
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    length = np.diff(np.append(starts, n))
    end = np.repeat(starts + length, length)
    left = end - np.arange(n) - 1  # partners further down
    out_i, out_j = [], []
    for d in range(1, int(length.max(initial=1))):
        valid = left >= d
        if not valid.any():
            break
        alive = np.packbits(np.pad(valid, (0, p.shape[1] * 64 - n)), bitorder="little").view(np.uint64)
        words = np.flatnonzero(alive)
        alive = alive[words]
        count = [np.zeros(len(words), np.uint64) for _ in range(8)]
        for k in range(0, len(p), 16):
            x = [p[q][words] ^ shifted(p[q], words, d) for q in range(k, k + 16)]
            weight = 0
            while x:  # carry-save: three planes of a weight become one of it and one of the next
                nxt = []
                while len(x) > 1:
                    b, c = x.pop(), x.pop()
                    a = count[weight]
                    u = a ^ b
                    count[weight] = u ^ c
                    nxt.append(a & b | u & c)
                if x:
                    b = x.pop()
                    nxt.append(count[weight] & b)
                    count[weight] = count[weight] ^ b
                x = nxt if weight < 7 else []
                weight += 1
            over, equal = np.zeros(len(words), np.uint64), np.full(len(words), ~U(0))
            for w in range(7, -1, -1):
                if radius >> w & 1:
                    equal = equal & count[w]
                else:
                    over |= equal & count[w]
                    equal = equal & ~count[w]
            alive = alive & ~over
            keep = alive != 0
            if not keep.all():  # abandon
                words, alive = words[keep], alive[keep]
                count = [c[keep] for c in count]
                if not len(words):
                    break
        if len(words):
            lanes = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
            w, b = np.nonzero(lanes)
            i = words[w] * 64 + b
            out_i.append(i)
            out_j.append(i + d)
    e = np.zeros(0, np.int64)
    return np.concatenate([e, *out_i]), np.concatenate([e, *out_j])


CANDIDATE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
CANDIDATES = "a bigint, b bigint, bucket bigint, s1 bigint, s2 bigint"


def _compare(defer: bool):
    """Over rows (bucket, node, s1, s2, block) sorted by bucket: close pairs, and, where `defer`, the rows of hot buckets with b null."""

    def emit(bucket, node, sketch):
        single = np.ones(len(bucket), dtype=bool)
        same = bucket[1:] == bucket[:-1]
        single[1:][same], single[:-1][same] = False, False
        bucket, node, sketch = bucket[~single], node[~single], sketch[~single]
        if not len(bucket):
            return
        a, n = 0, len(bucket)
        while a < n:  # whole buckets, about so many rows at once
            b = n
            if n - a > 1 << 17:
                at = bucket[a + (1 << 17)]
                b = int(np.searchsorted(bucket, at))
                if b <= a:
                    b = int(np.searchsorted(bucket, at, side="right"))
            i, j = close_pairs(bucket[a:b], sketch[a:b])
            x, y = node[a:b][i], node[a:b][j]
            ok = x != y
            pair = np.unique(np.stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok]], axis=1), axis=0)
            if len(pair):
                none = pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, none, none], schema=CANDIDATE)
            a = b

    def run(batches):
        held = None  # the last bucket's rows so far
        deferring = None
        for b in batches:
            bucket, node, s1, s2 = (b.column(k).to_numpy() for k in range(4))
            rows = (bucket, node, np.stack([s1, s2], axis=1))
            if held is not None:
                rows = tuple(np.concatenate([h, r]) for h, r in zip(held, rows, strict=True))
            bucket, node, sketch = rows
            if not len(bucket):
                continue
            if defer:
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                size = np.diff(np.append(starts, len(bucket)))
                hot = size > HOT
                if deferring is not None:  # an earlier bucket's held rows may stand before it
                    hot |= bucket[starts] == deferring
                mask = np.repeat(hot, size)
                deferring = bucket[-1] if hot[-1] else None
                if mask.any():
                    k = int(mask.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(node[mask]), pa.nulls(k, pa.int64()), pa.array(bucket[mask]), pa.array(sketch[mask][:, 0]), pa.array(sketch[mask][:, 1])], schema=CANDIDATE)
                    bucket, node, sketch = bucket[~mask], node[~mask], sketch[~mask]
                    if not len(bucket):
                        held = None
                        continue
            last = int(np.searchsorted(bucket, bucket[-1]))
            yield from emit(bucket[:last], node[:last], sketch[:last])
            held = bucket[last:], node[last:], sketch[last:]
        if held is not None and len(held[0]):
            yield from emit(*held)

    return run


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct node pairs (a < b) whose sketches are close in some bucket; reps: node, keys, s1, s2."""
    reps = cut_lineage(reps)  # read twice
    rows = reps.select(F.explode("keys").alias("bucket"), "node", "s1", "s2")
    # buckets that one node in PROBE shows to be large never gather in a task; the others' sizes are seen where they meet
    probe = reps.where(F.pmod("node", F.lit(PROBE)) == 0).select(F.explode("keys").alias("bucket")).groupBy("bucket").count()
    large = cut_lineage(probe.where(F.col("count") >= max(2, HOT // PROBE)).select("bucket", F.lit(True).alias("large")))
    if large.isEmpty():
        small, spread_first = rows, None
    else:
        small, spread_first = rows.join(large, "bucket", "left_anti"), rows.join(large, "bucket", "left_semi")
    out = cut_lineage(small.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_compare(True), CANDIDATES))
    pairs = out.where("b is not null").select("a", "b")
    hot = out.where("b is null").select("bucket", F.col("a").alias("node"), "s1", "s2")
    if spread_first is not None:
        hot = hot.unionByName(spread_first.select("bucket", "node", "s1", "s2"))
    if not hot.isEmpty():
        blocks = hot.groupBy("bucket").agg(F.ceil(F.count("*") * 2 / F.lit(HOT)).cast("int").alias("n"))
        hot = hot.join(blocks, "bucket").withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int"))
        spread = hot.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        spread = spread.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), "node", "s1", "s2")
        pairs = pairs.unionByName(spread.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_compare(False), CANDIDATES).select("a", "b"))
    return pairs.distinct()


def eligible(chunks: DataFrame, types: tuple[str, ...] = ("text", "clause"), least: int = LEAST) -> DataFrame:
    return chunks.where(F.col("type").isin(*types) & (F.length("text") >= least) & F.col("chunk_id").isNotNull()).select("chunk_id", "text")


REP = pa.schema([("id", pa.string()), ("copy", pa.binary()), ("keys", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64())])


def copies(rows: DataFrame) -> DataFrame:
    """(chunk_id, copy): copies, equal but for plain white space, have one digest."""
    return rows.select("chunk_id", F.unhex(F.md5(F.regexp_replace("text", "[ \\n\\t\\r]", ""))).alias("copy"), "text")


def representatives(rows: DataFrame) -> DataFrame:
    """(rep, node, keys, s1, s2) of each group of copies."""

    def fn(cols):
        keys, sk = [], []
        for a, b in passes(cols["text"], 500_000):
            k, s = signatures(cols["text"][a:b])
            keys.append(k)
            sk.append(s)
        k, s = np.concatenate(keys), np.concatenate(sk).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, BANDS, dtype=np.int32)), pa.array(k.view(np.int64).ravel()))
        return {"id": cols["chunk_id"], "copy": cols["copy"], "keys": lists, "s1": pa.array(s[:, 0].copy()), "s2": pa.array(s[:, 1].copy())}

    sig = map_arrow(copies(rows), fn, "id string, copy binary, keys array<bigint>, s1 bigint, s2 bigint", REP)
    one = sig.groupBy("copy").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    return one.select("rep", F.xxhash64("rep").alias("node"), "keys", "s1", "s2")


def needed_bits(pairs: DataFrame) -> np.ndarray:
    """Bitmap of fixed size over the nodes that take part in a pair."""
    x = F.pmod(F.col("node"), F.lit(BITMAP_BITS))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    parts = nodes.groupBy((x / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(x, F.lit(32768))).alias("bits")).collect()  # at most BITMAP_BITS / 32768 rows of 4 KB
    out = np.zeros(BITMAP_BITS, dtype=np.uint8)
    for r in parts:
        out[r["bucket"] * 32768 : (r["bucket"] + 1) * 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return np.packbits(out, bitorder="little")


def exact(pairs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(rep_a, rep_b) of the node pairs whose sets have the similarity."""
    bits = pairs.sparkSession.sparkContext.broadcast(needed_bits(pairs))  # BITMAP_BITS / 8 bytes, whatever the corpus

    @F.pandas_udf("boolean")
    def wanted(node):
        at = np.mod(node.to_numpy(), BITMAP_BITS)
        return node.__class__((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    texts = rows.select(F.xxhash64("chunk_id").alias("node"), "chunk_id", "text").where(wanted("node")).dropDuplicates(["chunk_id"])
    with_a = pairs.join(texts.withColumnsRenamed({"node": "a", "chunk_id": "rep_a", "text": "text_a"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"node": "b", "chunk_id": "rep_b", "text": "text_b"}), "b")

    def fn(cols):
        out_a, out_b = [], []
        n = len(cols["rep_a"])
        for lo in range(0, n, 500):
            ta, tb = cols["text_a"][lo : lo + 500], cols["text_b"][lo : lo + 500]
            h, doc = shingles(ta + tb)
            k = len(ta)
            side = (doc >= k).astype(np.int64)
            pair = doc - side * k
            order = np.lexsort((side, h, pair))
            h, pair, side = h[order], pair[order], side[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (pair[1:] != pair[:-1]) | (side[1:] != side[:-1])]) if len(h) else np.zeros(0, bool)
            h, pair = h[new], pair[new]
            both_ = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
            shared = np.bincount(pair[1:][both_], minlength=k)
            total = np.bincount(pair, minlength=k) - shared
            for i in np.flatnonzero(shared >= similarity * total - 1e-9):
                if total[i]:
                    out_a.append(cols["rep_a"][lo + i])
                    out_b.append(cols["rep_b"][lo + i])
        return {"a": out_a, "b": out_b}

    schema = pa.schema([("rep_a", pa.string()), ("rep_b", pa.string())])
    return map_arrow(both.select("rep_a", "rep_b", "text_a", "text_b"), fn, "rep_a string, rep_b string", schema)


def similar(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives (rep_a, rep_b), members (chunk_id, rep, n_copies)) of all chunks that take part."""
    rows = eligible(chunks)
    pairs = candidates(representatives(rows))
    links = cut_lineage(exact(cut_lineage(pairs), rows))
    c = copies(rows).select("chunk_id", "copy").distinct()
    members = c.join(c.groupBy("copy").agg(F.min("chunk_id").alias("rep"), F.count("*").alias("n_copies")), "copy").select("chunk_id", "rep", "n_copies")
    return links, members


def p5_found(spark, sf_dir):
    """Pairs of nearly equal chunks.

    Copies are written out pair by pair up to FULL_PAIRS copies of a text; in larger groups of copies each is paired with the group's
    smallest id, and links of such a group to other texts are written for the smallest id (compact form).
    """
    links, members = similar(table(spark, sf_dir, "doc_chunks"))
    many = members.where("n_copies > 1")
    small = many.where(F.col("n_copies") <= FULL_PAIRS)
    alias = small.select(F.col("rep").alias("rep_a"), F.col("chunk_id").alias("id_a"))
    inner = alias.join(small.select(F.col("rep").alias("rep_a"), F.col("chunk_id").alias("id_b")), "rep_a").where("id_a < id_b").select("id_a", "id_b")
    star = many.where((F.col("n_copies") > FULL_PAIRS) & (F.col("chunk_id") != F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("chunk_id").alias("id_b"))
    x = links.join(alias, "rep_a", "left").select("rep_b", F.coalesce("id_a", "rep_a").alias("id_a"))
    x = x.join(alias.withColumnsRenamed({"rep_a": "rep_b", "id_a": "id_b"}), "rep_b", "left").select("id_a", F.coalesce("id_b", "rep_b").alias("id_b"))
    all_ = x.unionByName(inner).unionByName(star)
    return all_.select(F.least("id_a", "id_b").alias("chunk_id_a"), F.greatest("id_a", "id_b").alias("chunk_id_b")).distinct()


def components(links: DataFrame, a: str = "rep_a", b: str = "rep_b") -> DataFrame:
    """(node, root) of all nodes in a link; alternating large and small stars, whose rounds grow with the logarithm of the longest chain."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        nxt = cut_lineage(j.select("u", F.col("m").alias("v")).unionByName(j.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        if nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty():
            break
        e = nxt
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def p5_groups(spark, sf_dir):
    """One row per chunk that has a near copy or a copy: its group's smallest id, its copies' smallest id and their text's number of links to other texts.

    With `p5_links`, the links between those, every pair of near copies can be told.
    """
    links, members = similar(table(spark, sf_dir, "doc_chunks"))
    comp = components(links)
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    m = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return m.where("root is not null or n_copies > 1").select("chunk_id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", F.col("rep").alias("copy_id"))


def p5_links(spark, sf_dir):
    """Links between different texts, each by its copies' smallest id."""
    return similar(table(spark, sf_dir, "doc_chunks"))[0].select(F.least("rep_a", "rep_b").alias("copy_a"), F.greatest("rep_a", "rep_b").alias("copy_b"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups, "p5_links": p5_links}

ORACLE = {
    "p5_found": r"""
with e as (select chunk_id, any_value(lower(regexp_replace(text, '\s|[\x{3000}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{85}\x{0B}\x{1C}-\x{1F}]', '', 'g'))) as t from doc_chunks
  where type in ('text', 'clause') and length(text) >= 300 group by chunk_id),
s as (select distinct chunk_id, substring(t, k, 5) as w from e, lateral (select unnest(range(1, length(t) - 3)) as k)),
n as (select chunk_id, count(*) as n from s group by chunk_id),
o as (select a.chunk_id as x, b.chunk_id as y, count(*) as c from s a join s b on a.w = b.w and a.chunk_id < b.chunk_id group by 1, 2)
select x as chunk_id_a, y as chunk_id_b from o join n na on na.chunk_id = x join n nb on nb.chunk_id = y where c >= 0.7 * (na.n + nb.n - c)
"""
}
