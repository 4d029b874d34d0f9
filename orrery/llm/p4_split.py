"""Splitting oversized texts at natural boundaries by lexical cohesion.

Boundaries lie after the sentence marks, line feeds and full stops TESTDATA.md names. At each, the texts of up to three sentences on
either side are compared (cosine of hashed character pairs); a low value between higher neighbours is a valley. Each piece after the first repeats `overlap` characters of
the one before, so it has room for limit - overlap new ones. It ends at the deepest valley inside its size window (the second half of that room); where the window has
none, at the last boundary before; where there is no boundary within the room at all, after the last comma of the window, else between words, else at its end. That
cut is called forced if the stretch between the boundaries is longer than the limit itself. An overlap that would begin inside a word begins with the word, as far as
the limit lets it; it is never shorter than asked.

Null and short texts give no pieces (they need none); repeated rows give one set of pieces; empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import codes, map_arrow, passes
from orrery.tables import table

LIMIT, OVERLAP, SIDE, BINS, BLOCK = 400, 40, 3, 64, 20_000
MARKS = re.compile(r"[。！？；!?;\n]|\.(?=[ \n])")


def boundaries(text: str) -> np.ndarray:
    """Positions after the marks, with the text's start and end, rising."""
    ends = [m.end() for m in MARKS.finditer(text)]
    return np.array([0, *ends] + ([len(text)] if not ends or ends[-1] < len(text) else []), dtype=np.int64)


def cohesion(c: np.ndarray, lens: np.ndarray, first: np.ndarray, n_sent: np.ndarray) -> np.ndarray:
    """Similarity of the SIDE sentences before and after each sentence's start, a block of BLOCK sentences at a time."""
    n = len(lens)
    at = np.concatenate([[0], np.cumsum(lens)])
    lo, hi = np.repeat(first[:-1], n_sent), np.repeat(first[1:], n_sent)
    sim = np.zeros(n)
    for x in range(0, n, BLOCK):
        y = min(n, x + BLOCK)
        p, q = max(0, x - SIDE), min(n, y + SIDE)
        t = c[at[p] : at[q]]
        if len(t) < 2:
            continue
        sent = np.repeat(np.arange(q - p), lens[p:q])
        pair = ((t[:-1] * 1_000_003 + t[1:]) * 2_654_435_761 >> 20) & (BINS - 1)
        same = sent[:-1] == sent[1:]
        m = np.bincount(sent[:-1][same] * BINS + pair[same], minlength=(q - p) * BINS).reshape(-1, BINS)
        cs = np.concatenate([np.zeros((1, BINS), np.int64), np.cumsum(m, axis=0)])
        k = np.arange(x, y)
        left = (cs[k - p] - cs[np.maximum(lo[x:y], k - SIDE) - p]).astype(np.float32)
        right = (cs[np.minimum(hi[x:y], k + SIDE) - p] - cs[k - p]).astype(np.float32)
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        sim[x:y] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0.0)
    return sim


def valley_depths(texts: list[str], bounds: list[np.ndarray]) -> list[np.ndarray]:
    """Depth of the cohesion valley at each boundary of each text (0 at its ends)."""
    n_sent = np.array([len(b) - 1 for b in bounds])
    first = np.concatenate([[0], np.cumsum(n_sent)])
    sim = cohesion(codes("".join(texts)).astype(np.int64), np.concatenate([np.diff(b) for b in bounds]), first, n_sent)
    out = []
    for k in range(len(bounds)):
        s = sim[first[k] : first[k + 1]].copy()
        if len(s):
            s[0] = s[1] if len(s) > 1 else 0.0
        p = np.pad(s, 2, mode="edge") if len(s) else s
        n = len(s)
        peak_l, peak_r = np.maximum(p[:n], p[1 : n + 1]), np.maximum(p[3 : n + 3], p[4 : n + 4])
        depth = np.maximum(peak_l - s, 0) + np.maximum(peak_r - s, 0)
        out.append(np.append(depth, 0.0))
    return out


COMMA = re.compile(r".*(?:[，、：,:](?!\d)|—)", re.S)
INSIDE = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ɏ'’.,-]")
LETTER = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ɏ]")


def between_words(text: str, at: int) -> bool:
    """Whether no word or figure of an alphabet goes on over the position."""
    return not (0 < at < len(text)) or not (INSIDE.match(text[at - 1]) and LETTER.match(text[at]))


def word_break(text: str, lo: int, hi: int) -> int:
    """The best place in (lo, hi] where no boundary is: after the last comma, between words, or hi."""
    m = COMMA.match(text, lo, hi)
    if m and m.end() > lo and between_words(text, m.end()):
        return m.end()
    return next((p for p in range(hi, lo, -1) if between_words(text, p)), hi)


def overlap_start(text: str, pos: int, asked: int, most: int) -> int:
    """Where the overlap of a piece from `pos` begins: `asked` characters before, or at the start of the word there if at most `most` are."""
    at = max(0, pos - asked)
    return next((p for p in range(at, max(-1, pos - most - 1), -1) if between_words(text, p)), at)


def cut_points(bounds: list[int], depth: list[float], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start of the overlap, start, end, forced) of the pieces; end - start of the overlap never exceeds the limit."""
    out, pos, k, length = [], 0, 1, len(text)
    while pos < length:
        room = limit if pos == 0 else limit - overlap
        end, forced = length, False
        if length - pos > room:
            while k < len(bounds) and bounds[k] <= pos:
                k += 1
            j, best, best_depth, last = k, 0, -1.0, 0
            while j < len(bounds) and bounds[j] <= pos + room:
                last = bounds[j]
                if last >= pos + room // 2 and depth[j] >= best_depth:
                    best, best_depth = last, depth[j]
                j += 1
            if best or last:
                end = best or last
            else:
                end, forced = word_break(text, pos + room // 2, pos + room), bounds[k] - bounds[k - 1] > limit
        out.append((overlap_start(text, pos, overlap, limit - (end - pos)) if pos else 0, pos, end, forced))
        pos = end
    return out


PIECE = "item_table string, item_id string, doc_id string, seq int, section_path array<string>, piece int, start int, end int, overlap int, forced boolean, text string"
ARROW = pa.schema([("item_table", pa.string()), ("item_id", pa.string()), ("doc_id", pa.string()), ("seq", pa.int32()), ("section_path", pa.list_(pa.string())), ("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("overlap", pa.int32()), ("forced", pa.bool_()), ("text", pa.string())])


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of every item (item_table, item_id, doc_id, seq, section_path, text) longer than `limit` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")

    def fn(cols):
        out = {f.name: [] for f in ARROW}
        texts = cols["text"]
        for a, b in passes(texts):
            part = texts[a:b]
            bounds = [boundaries(t) for t in part]
            depths = valley_depths(part, bounds)
            for i, t, bd, d in zip(range(a, b), part, bounds, depths, strict=True):
                for p, (o, s, e, forced) in enumerate(cut_points(bd.tolist(), d.tolist(), t, limit, overlap)):
                    for name, v in zip(out, (cols["item_table"][i], cols["item_id"][i], cols["doc_id"][i], cols["seq"][i], cols["section_path"][i], p, s, e, s - o, forced, t[o:e]), strict=True):
                        out[name].append(v)
        return out

    big = items.where(F.length("text") > limit).select("item_table", "item_id", "doc_id", "seq", "section_path", "text")
    return map_arrow(big, fn, PIECE, ARROW)


def items(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "doc_blocks").select(F.lit("doc_blocks").alias("item_table"), F.col("block_id").alias("item_id"), "doc_id", F.lit(None).cast("int").alias("seq"), "section_path", "text")
    c = table(spark, sf_dir, "doc_chunks").select(F.lit("doc_chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), "doc_id", "seq", "section_path", "text")
    return b.unionByName(c)


def p4_found(spark, sf_dir):
    """Oversized items with the kind of cut their pieces needed."""
    p = split_oversized(items(spark, sf_dir)).groupBy("item_table", "item_id").agg(F.max("forced").alias("f"))
    return p.select("item_table", "item_id", F.when(F.col("f"), "forced").otherwise("natural").alias("cut"))


def p4_pieces(spark, sf_dir):
    """All pieces, in order by (item_table, item_id, piece)."""
    return split_oversized(items(spark, sf_dir)).dropDuplicates(["item_table", "item_id", "piece"])


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}

ORACLE = {
    "p4_found": r"""
with i as (
  select 'doc_blocks' as item_table, block_id as item_id, text from doc_blocks
  union select 'doc_chunks', chunk_id, text from doc_chunks),
s as (select item_table, item_id, regexp_replace(text, '([。！？；!?;\n])|(\.)([ \n])', '\1\2' || chr(1) || '\3', 'g') as t from i where length(text) > 400),
m as (select item_table, item_id, max(length(x)) as longest from (select item_table, item_id, unnest(string_split(t, chr(1))) as x from s) group by all)
select item_table, item_id, case when longest > 400 then 'forced' else 'natural' end as cut from m
"""
}
