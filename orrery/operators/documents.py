"""Document-level programs that need a whole document's order: chunking, alignment and table distances.

Each runs over Arrow batches of one document (or pair) at a time, input sorted inside the group; a document is bounded by its pages, and no group spans
documents. Null texts count as empty; empty documents give no rows.
"""

from __future__ import annotations

import difflib
import functools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = re.compile(r"^(#{1,6})\s+(.*)")
TARGET, MOST = 300, 400


CLEAN = re.compile("[。，；：、？！]")
ARTICLE = re.compile(r"第[一二三四五六七八九十百零〇\d]+条")


def breadcrumb(path: list[str], article: str | None, levels: int = 2, longest: int = 24) -> str:
    """The last `levels` section names that are short and no sentences, and the clause number."""
    parts = [x for x in path if len(x) <= longest and not CLEAN.search(x)][-levels:] + ([article] if article else [])
    return "[" + " › ".join(parts) + "]" if parts else ""


def chunk_documents(blocks: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """(doc_id, seq, section_path, breadcrumb, article_no, kind, text) from blocks (doc_id, pos, type, level, text).

    Headings set a stack of sections; each table row carries its header; a paragraph of more than `most` characters is cut at its sentences, packed to about `target`.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, stack = [], []

        def add(kind, text, article=None):
            path = [x for _, x in stack]
            rows.append((kind, " > ".join(path), breadcrumb(path, article), article, text))

        for r in pdf.sort_values("pos").itertuples():
            text = (r.text or "").strip()
            if r.type == "heading":
                level = int(r.level or 1)
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, text))
            elif r.type == "table" and text.startswith("|"):
                lines = [x for x in text.split("\n") if x.startswith("|") and not re.fullmatch(r"[| :-]+", x)]
                for x in lines[1:]:
                    add("table_row", lines[0] + "\n" + x)
            elif text:
                m = ARTICLE.match(text)
                kind, article = ("clause", m[0]) if m else ("text", None)
                if len(text) <= most:
                    add(kind, text, article)
                    continue
                buf = ""
                for x in re.findall(r"[^。！？!?\n]+[。！？!?]?|\n", text):
                    if buf.strip() and len(buf) + len(x) > target:
                        add(kind, buf.strip(), article)
                        buf = ""
                    buf += x
                if buf.strip():
                    add(kind, buf.strip(), article)
        out = pd.DataFrame(rows, columns=["kind", "section_path", "breadcrumb", "article_no", "text"])
        return out.assign(doc_id=pdf["doc_id"].iloc[0], seq=range(len(out)))[["doc_id", "seq", "section_path", "breadcrumb", "article_no", "kind", "text"]]

    return blocks.where("doc_id is not null").groupBy("doc_id").applyInPandas(one, "doc_id string, seq int, section_path string, breadcrumb string, article_no string, kind string, text string")


@F.pandas_udf(T.ArrayType(T.StringType()))
def diff_marks(old: pd.Series, new: pd.Series) -> pd.Series:
    """Marks of the new text's lines against the old one's: same, add, chg, and del for lines that went."""

    def one(a, b):
        x, y = (a or "").split("\n"), (b or "").split("\n")
        out = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            out += {"equal": ["same"] * (j2 - j1), "insert": ["add"] * (j2 - j1), "delete": ["del"] * (i2 - i1), "replace": ["chg"] * max(i2 - i1, j2 - j1)}[op]
        return out

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(T.DoubleType())
def heading_recall(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Share of gold headings (lines with #) that the prediction has, by text, in order; null without gold headings."""

    def one(a, b):
        x, y = ([m[2].strip() for m in map(HEAD.match, (s or "").split("\n")) if m] for s in (a, b))
        if not y:
            return None
        return sum(n for _, _, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) / len(y)

    return pd.Series([one(a, b) for a, b in zip(pred, gold, strict=True)], dtype="float64")


def monotone_alignment(a: list[str], b: list[str], least: float = 0.6) -> list[tuple[int, int]]:
    """Index pairs of the best monotone alignment by similarity, pairs below `least` apart."""
    n, m = len(a), len(b)
    if a == b:
        return [(i, i) for i in range(n)]

    def ratio(x: str, y: str) -> float:
        if x == y:
            return 1.0
        m_ = difflib.SequenceMatcher(None, x, y, autojunk=False)
        if min(m_.real_quick_ratio(), m_.quick_ratio()) < least:  # upper bounds
            return 0.0
        return m_.ratio()

    sim = [[ratio(x, y) for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            take = best[i + 1][j + 1] + sim[i][j] if sim[i][j] >= least else -1.0
            best[i][j] = max(best[i + 1][j], best[i][j + 1], take)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if sim[i][j] >= least and abs(best[i][j] - best[i + 1][j + 1] - sim[i][j]) < 1e-12:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@F.pandas_udf(T.IntegerType())
def aligned_headings(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of aligned lines of two texts."""
    return pd.Series([len(monotone_alignment((x or "").split("\n"), (y or "").split("\n"))) for x, y in zip(a, b, strict=True)])


def levenshtein(a: list, b: list, cost=lambda x, y: float(x != y), size=lambda x: 1.0) -> float:
    while a and b and a[-1] == b[-1]:  # equal ends match at no cost
        a, b = a[:-1], b[:-1]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    prev = [0.0]
    for y in b:
        prev.append(prev[-1] + size(y))
    for x in a:
        cur = [prev[0] + size(x)]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + size(x), cur[-1] + size(y), prev[j - 1] + cost(x, y)))
        prev = cur
    return prev[-1]


def grid(html: str) -> list[list[str]]:
    return [[re.sub(r"<[^>]*>", "", c).strip() for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html or "")]


@functools.lru_cache(100_000)
def cell_cost(x: str, y: str) -> float:
    return 0.0 if x == y else levenshtein(list(x), list(y)) / max(len(x), len(y), 1)


def grid_similarity(a: list[list[str]], b: list[list[str]]) -> float:
    """1 - row-wise edit distance of two grids by the larger one's nodes (1 + rows + cells): a row costs 1 + its cells, a changed row its cells' edit distance."""
    nodes = max(1 + len(g) + sum(map(len, g)) for g in (a, b))
    d = levenshtein(a, b, lambda x, y: levenshtein(x, y, cell_cost), lambda r: 1.0 + len(r))
    return max(0.0, 1.0 - d / nodes)


def tree_distance(a: tuple, b: tuple) -> float:
    """Edit distance of two ordered trees (label, children) by Zhang and Shasha; labels cost `cell_cost` to change."""

    def post(t):
        labels, left, keys = [], [], {}

        def walk(n):
            first = None
            for c in n[1]:
                f = walk(c)
                first = f if first is None else first
            labels.append(n[0])
            i = len(labels) - 1
            left.append(i if first is None else first)
            keys[left[-1]] = i
            return left[-1]

        walk(t)
        return labels, left, sorted(keys.values())

    (la, fa, ka), (lb, fb, kb) = post(a), post(b)
    dist = [[0.0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            oi, oj = fa[i], fb[j]
            f = [[0.0] * (j - oj + 2) for _ in range(i - oi + 2)]
            for x in range(1, i - oi + 2):
                f[x][0] = f[x - 1][0] + 1
            for y in range(1, j - oj + 2):
                f[0][y] = f[0][y - 1] + 1
            for x in range(1, i - oi + 2):
                for y in range(1, j - oj + 2):
                    p, q = x + oi - 1, y + oj - 1
                    if fa[p] == oi and fb[q] == oj:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[x - 1][y - 1] + cell_cost(la[p], lb[q]))
                        dist[p][q] = f[x][y]
                    else:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[fa[p] - oi][fb[q] - oj] + dist[p][q])
    return dist[-1][-1]


def teds(pred: str | None, gold: str | None) -> float | None:
    """Table similarity: null without a gold table, 0 without a predicted one; the exact tree distance where cells span and the trees are small, else row by row."""
    g = grid(gold or "")
    if not g:
        return None
    p = grid(pred or "")
    if not p:
        return 0.0
    n = max(1 + len(x) + sum(map(len, x)) for x in (p, g))
    if n <= 1200 and re.search(r"(?:col|row)span\s*=\s*[\"']?[2-9]", (pred or "") + (gold or "")):
        t = lambda x: ("table", [("tr", [(c, []) for c in r]) for r in x])
        return max(0.0, 1.0 - tree_distance(t(p), t(g)) / n)
    return grid_similarity(p, g)


@F.pandas_udf(T.DoubleType())
def table_similarity(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([teds(a, b) for a, b in zip(pred, gold, strict=True)], dtype="float64")
