"""Markup residue to clean text, with a site style tree.

Each block or table is a page; its host is the folder that its document's source path names. A page's markup, whatever the dialect, is read as one tree: HTML elements
nest by their tags, Markdown, wiki and LaTeX constructs by their extent. The pages' trees are merged by host: a style-tree node is a path of tags, each with its place among
its like, below the host, with the presentation styles seen there (the sequences of its children, tags with their classes) and the clauses that its own text holds
there (its content). A node's importance is

    (1 - G**l) * entropy of its styles + G**l * (1 - mean entropy of its clauses' spread over the pages),   entropies to the base of its number of pages,

with l its mean number of children: what looks alike and says the same on all pages gets 0. A node on at least MIN_PAGES pages whose importance is below LOW is noise. A
page's branch is removed if its node and all nodes below it are noise and all its clauses there are ones that at least half of the node's pages repeat, so no word
of its own is lost; branches with headings, code, formulas or cells stay. All else becomes clean text that keeps headings, list items, code, formulas and cells on
lines of their own.

Null texts come out null without kinds, empty ones empty; texts without markup come out as they are; repeated rows give one row; null ids are left out; empty
tables give an empty result. A table's own pipe frame and plain signs are not markup.
"""

from __future__ import annotations

import hashlib
import html

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_arrow
from orrery.session import cut_lineage
from orrery.tables import table

G, LOW, MIN_PAGES = 0.9, 0.2, 4
# HTML element names that occur as residue, and the LaTeX commands that stand without an argument.
TAGS = "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav nobr ol option p pre q s samp script section select small span strike strong style sub sup table tbody td tfoot th thead title tr tt u ul var"
BARE = "item|hline|leq|geq|neq|times|cdot|sum|prod|int|infty|alpha|beta|gamma|delta|sigma|lambda|mu|pi|newline|newpage|noindent|par|centering|quad|qquad|ldots|dots|left|right|pm|approx|toprule|midrule|bottomrule|maketitle"
VOID = {"br", "hr", "img", "input", "meta", "link", "col"}
BLOCK = {"p", "div", "tr", "li", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "pre", "blockquote", "section", "article", "dd", "dt", "dl", "caption", "header", "footer", "nav"}

TAG = rf"<(?P<close>/?)(?P<tag>{'|'.join(sorted(TAGS.split(), key=len, reverse=True))})(?=[\s/>])(?P<attrs>[^<>]*)>"
FENCE = r"^[ \t]*```[^\n`]*\n(?P<code>.*?)^[ \t]*```[ \t]*$"
# The kinds' constructs, each with its name in the tree; flags: multi-line, case ignored for tags.
HTML = regex.compile(rf"(?P<comment><!--.*?-->)|(?i:{TAG})|(?P<entity>&(?:[A-Za-z]{{2,8}}|\#\d{{1,6}}|\#[xX][0-9A-Fa-f]{{1,6}});)", regex.M | regex.S)
MARKDOWN = regex.compile(
    rf"(?P<fence>{FENCE})|(?P<tick>`[^`\n]+`)|(?P<atx>^\#{{1,6}}[ \t]+\S[^\n]*)|(?P<setext>^[^\s=|][^\n]*\n={{3,}}[ \t]*$)|(?P<image>!\[[^\]\n]*\]\([^()\s]*\))|(?P<link>(?<!\[)\[[^\[\]\n]+\]\([^()\s]*\))"
    r"|(?P<strong>\*\*[^*\n]+\*\*|(?<![\w_])__[^_\n]+__(?![\w_]))|(?P<strike>~~[^~\n]+~~)|(?P<quote>^>[ \t]?(?=[^\n]*$))|(?P<items>(?:^[ \t]*[-+*][ \t]+(?!\[\[)\S[^\n]*(?:\n|\Z)){2,})|(?P<em>(?<![\w*\\])\*[^*\s|](?:[^*\n|]*[^*\s|])?\*(?![\w*])|(?<![\w_\\{])_[^_\s|](?:[^_\n|]*[^_\s|])?_(?![\w_]))"
    r"|(?P<rule>^(?:-{3,}|\*{3,}|_{3,})[ \t]*$)|(?P<frame>^\|[^\n]*\|[ \t]*\n\|[ \t:|-]*-[ \t:|-]*\|[ \t]*$)",
    regex.M | regex.S,
)
WIKI = regex.compile(r"(?P<wtable>^\{\|.*?^\|\})|(?P<whead>^(?P<eq>={2,6})[ \t]*[^=\n]+?[ \t]*(?P=eq)[ \t]*$)|(?P<wlink>\[\[[^\[\]\n]+\]\])|(?P<template>\{\{[^{}\n]+\}\})|(?P<quotes>'{2,5}[^'\n]+'{2,5})|(?P<witems>^\*+[ \t]*(?=\[\[))", regex.M | regex.S)
LATEX = regex.compile(
    rf"(?P<env>\\(?:begin|end)\{{[A-Za-z*]+\}})|(?P<display>\\\[.*?\\\]|\\\(.*?\\\))|(?P<math>\$[^$\n。，；]*(?:\^|_\{{|\\|=)[^$\n。，；]*\$)|(?P<command>\\[A-Za-z]{{2,}}\*?(?=[\[{{])|\\(?:{BARE})(?![A-Za-z]))|(?P<escape>\\[%$&\#_{{}}])|(?P<newline>\\\\(?:\[[^\]\n]{{1,8}}\])?)",
    regex.M | regex.S,
)
KINDS = (("html", HTML), ("markdown", MARKDOWN), ("wiki", WIKI), ("latex", LATEX))
#: Without one of these a text holds no markup.
SIGNS = r"[<&*#`_~\[{\\$=>+]|''|(?:^|\n)\s*-\s|---"


def tokens(text: str, is_table: bool) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, tag) of every construct; what lies inside code is code."""
    out, code = [], []
    for m in MARKDOWN.finditer(text):
        name = m.lastgroup if m.lastgroup != "code" else "fence"
        if name == "items" and all(regex.match(r"\s*[-+*]\s+\S{1,4}\s+-\s*$", x) or not x.strip() for x in m.group().split("\n")):
            continue  # page figures between strokes
        if is_table and name in ("frame", "rule", "items"):
            continue
        if name in ("fence", "tick"):
            code.append((m.start(), m.end()))
        out.append((m.start(), m.end(), "markdown", name, name))
        if name == "items":  # what the items hold
            out += [(m.start() + x.start(), m.start() + x.end(), "markdown", x.lastgroup, x.lastgroup) for x in INLINE.finditer(m.group())]
    for kind, rx in KINDS:
        if kind != "markdown":
            for m in rx.finditer(text):
                if any(a <= m.start() < b for a, b in code):
                    continue
                name = m.lastgroup
                if kind == "html" and m["tag"]:
                    name = ("/" if m["close"] else "") + m["tag"].lower()
                elif kind == "html" and m["entity"] and html.unescape(m.group()) == m.group():
                    continue
                elif kind == "wiki" and name == "eq":
                    name = "whead"
                out.append((m.start(), m.end(), kind, name, name))
    return sorted(out, key=lambda t: (t[0], -t[1]))


INLINE = regex.compile(r"(?P<tick>`[^`\n]+`)|(?P<link>(?<!\[)\[[^\[\]\n]+\]\([^()\s]*\))|(?P<strong>\*\*[^*\n]+\*\*)|(?P<strike>~~[^~\n]+~~)")


CLASS = regex.compile(r"""(?i)\b(?:class|id|role)\s*=\s*["']?([^"'\s>]+)""")
#: Names of branches that are structure to keep: they are never noise. Of the rest only elements and comments are removed.
KEPT = {"li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "table", "tr", "td", "th", "caption", "fence", "tick", "atx", "setext", "whead", "wtable", "env", "display", "math", "command", "escape", "newline", "entity"}


class Node:
    """A branch of a page."""

    __slots__ = ("path", "name", "start", "end", "parent", "style", "children", "names", "element")

    def __init__(self, path: str, name: str, start: int, end: int | None, parent: int):
        self.path, self.name, self.start, self.end, self.parent = path, name, start, end, parent
        self.style: list[str] = []
        self.children: list[int] = []
        self.names: dict[str, int] = {}
        self.element = False


def tree(text: str, toks: list[tuple[int, int, str, str, str]]) -> list[Node]:
    """The branches of a page, parents first; the page itself comes first with the path ''."""
    nodes = [Node("", "", 0, len(text), -1)]
    open_ = [0]
    for start, end, kind, name, _ in toks:
        while len(open_) > 1 and nodes[open_[-1]].end is not None and nodes[open_[-1]].end <= start:
            open_.pop()
        if kind == "html" and name.startswith("/"):
            for k in range(len(open_) - 1, 0, -1):
                n = nodes[open_[k]]
                if n.end is None and (n.name == name[1:] or name[1] == "h" and n.name[:1] == "h"):
                    for x in open_[k:]:
                        nodes[x].end = nodes[x].end or end
                    del open_[k:]
                    break
            continue
        leaf = kind == "html" and (name in VOID or name in ("comment", "entity"))
        parent = nodes[open_[-1]]
        look = CLASS.search(text, start, end) if kind == "html" and not leaf else None
        parent.children.append(len(nodes))
        parent.style.append(f"{name}.{regex.sub(r'[0-9]+', '', look[1])}" if look else name)
        seen = parent.names[name] = parent.names.get(name, 0) + 1
        nodes.append(Node(f"{parent.path}/{name}{seen}", name, start, end if kind != "html" or leaf else None, open_[-1]))
        nodes[-1].element = kind == "html"
        if not leaf:
            open_.append(len(nodes) - 1)
    for n in nodes:
        n.end = len(text) if n.end is None else n.end
    return nodes


CLAUSE = regex.compile(r"[。！？；!?;\n]+|\.(?=\s)|[，,](?=\D)")


def clauses(nodes: list[Node], i: int, text: str) -> set[int]:
    """Hashes of the clauses of a branch's own text, without its children's; a comment says what stands in it."""
    n, at, own = nodes[i], nodes[i].start, []
    for c in n.children:
        own.append(text[at : nodes[c].start])
        at = max(at, nodes[c].end)
    own.append(text[at : n.end])
    bare = "\n".join(own).strip("<>!-") if n.name == "comment" else regex.sub(r"<[^<>]*>", " ", "\n".join(own))
    return {int.from_bytes(hashlib.blake2b(x.strip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in CLAUSE.split(bare) if x.strip()}


def noise(nodes: list[Node], text: str, low: dict[str, set[int]]) -> list[tuple[int, int]]:
    """Extents, apart from each other, of the branches to remove; `low` holds the noisy paths with their repeated clauses."""
    bad = [n.path in low and n.name not in KEPT and clauses(nodes, i, text) <= low[n.path] for i, n in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):  # children before their parents
        if not bad[i] and nodes[i].name not in VOID - {"img"}:
            bad[nodes[i].parent] = False
    out: list[tuple[int, int]] = []
    for i in range(1, len(nodes)):
        if bad[i] and nodes[i].element and (not out or nodes[i].start >= out[-1][1]):
            out.append((nodes[i].start, nodes[i].end))
    return out


def page_text(s: str) -> str:
    """Clean text of a page, its constructs resolved from the inside out."""
    held: list[str] = []

    def hold(x: str) -> str:
        held.append(x)
        return f"\x00{len(held) - 1}\x00"

    s = s.replace("\x00", "")
    s = regex.sub(FENCE, lambda m: hold(m["code"].rstrip("\n")), s, flags=regex.M | regex.S)
    s = regex.sub(r"`([^`\n]+)`", lambda m: hold(m[1]), s)
    for _ in range(3):  # escaped tags may be escaped again
        t = regex.sub(r"&(?:[A-Za-z]{2,8}|#\d{1,6}|#[xX][0-9A-Fa-f]{1,6});", lambda m: html.unescape(m.group()), s)
        if t == s:
            break
        s = t
    s = regex.sub(r"<!--.*?-->", "", s, flags=regex.S)
    s = regex.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", "", s)
    if regex.search(r"(?i)<tr\b", s):
        s = regex.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", s)
        s = regex.sub(r"(?i)<tr\b[^<>]*>\s*<t[dh]\b[^<>]*>", "\n| ", s)
        s = regex.sub(r"(?i)</t[dh]>\s*</tr>", " |", s)
    s = regex.sub(r"(?i)<li\b[^<>]*>", "\n- ", s)
    s = regex.sub(rf"(?i){TAG}", lambda m: ("\n" if m["tag"].lower() in BLOCK and m["tag"].lower() not in ("ul", "ol", "table") else ""), s)
    # wiki
    s = regex.sub(r"^\{\|.*?^\|\}", lambda m: "\n".join("| " + " | ".join(y.strip() for y in regex.split(r"!!|\|\|", x[1:])) + " |" for x in m.group().split("\n")[1:-1] if x[:1] in "!|" and not x.startswith("|-")), s, flags=regex.M | regex.S)
    s = regex.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", r"\2", s, flags=regex.M)
    s = regex.sub(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]", r"\1", s)
    s = regex.sub(r"\{\{([^{}\n]+)\}\}", lambda m: " ".join(x for x in m[1].split("|")[1:] if "=" not in x), s)
    s = regex.sub(r"'{2,5}([^'\n]+)'{2,5}", r"\1", s)
    s = regex.sub(r"^\*+[ \t]+", "- ", s, flags=regex.M)
    # LaTeX; formulas stay as they are written, without their delimiters
    s = regex.sub(r"\\begin\{(?:equation|align|displaymath|math)\*?\}\n?(.*?)\n?\\end\{(?:equation|align|displaymath|math)\*?\}", lambda m: hold(m[1].strip()), s, flags=regex.S)
    s = regex.sub(r"\\\[(.*?)\\\]|\\\((.*?)\\\)", lambda m: hold((m[1] or m[2] or "").strip()), s, flags=regex.S)
    s = regex.sub(r"\$([^$\n。，；]*(?:\^|_\{|\\|=)[^$\n。，；]*)\$", lambda m: hold(m[1].strip()), s)
    s = regex.sub(r"\\(?:begin|end)\{[A-Za-z*]+\}\n?", "", s)
    s = regex.sub(r"\\item[ \t]*", "- ", s)
    s = regex.sub(r"~?\\(?:cite|ref|label|eqref|footnotemark)\{[^{}]*\}", "", s)
    for _ in range(3):
        s, n = regex.subn(r"\\[A-Za-z]{2,}\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", s)
        if not n:
            break
    s = regex.sub(r"\\\\(?:\[[^\]\n]{1,8}\])?", "\n", s)
    s = regex.sub(r"\\([%$&#_{}])", r"\1", s)
    # Markdown
    s = regex.sub(r"^#{1,6}[ \t]+", "", s, flags=regex.M)
    s = regex.sub(r"^([^\s=|][^\n]*)\n={3,}[ \t]*$", r"\1", s, flags=regex.M)
    s = regex.sub(r"!?(?<!\[)\[([^\[\]\n]*)\]\([^()\s]*\)", r"\1", s)
    s = regex.sub(r"\*\*([^*\n]+)\*\*|(?<![\w_])__([^_\n]+)__(?![\w_])|~~([^~\n]+)~~", lambda m: m[1] or m[2] or m[3], s)
    s = regex.sub(r"(?<![\w*\\])\*([^*\s|](?:[^*\n|]*[^*\s|])?)\*(?![\w*])", r"\1", s)
    s = regex.sub(r"^>[ \t]?", "", s, flags=regex.M)
    s = regex.sub(r"^(?:\*{3,}|_{3,})[ \t]*$", "", s, flags=regex.M)
    while "\x00" in s:
        t = regex.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], s)
        if t == s:
            break
        s = t
    return regex.sub(r"\n{3,}", "\n\n", regex.sub(r"[ \t]+\n", "\n", s)).strip("\n")


def branches(pages: DataFrame) -> DataFrame:
    """(item_table, item_id, host, kinds, nodes) of the pages with markup: one row per page, its branches as an array."""
    schema = pa.schema([("item_table", pa.string()), ("item_id", pa.string()), ("host", pa.string()), ("kinds", pa.list_(pa.string())), ("nodes", pa.list_(pa.struct([("path", pa.string()), ("style", pa.string()), ("n", pa.int32()), ("clauses", pa.list_(pa.int64()))])))])

    def fn(cols):
        out = {f.name: [] for f in schema}
        for t, i, h, s in zip(cols["item_table"], cols["item_id"], cols["host"], cols["text"], strict=True):
            toks = tokens(s, t == "doc_tables")
            if toks:
                kinds = sorted({k for _, _, k, _, _ in toks})
                tree_ = tree(s, toks)
                nodes = [{"path": n.path, "style": " ".join(n.style), "n": len(n.style), "clauses": sorted(clauses(tree_, k, s))} for k, n in enumerate(tree_) if k]
                for name, v in zip(out, (t, i, h, kinds, nodes), strict=True):
                    out[name].append(v)
        return out

    return map_arrow(pages, fn, "item_table string, item_id string, host string, kinds array<string>, nodes array<struct<path: string, style: string, n: int, clauses: array<bigint>>>", schema)


def said(b: DataFrame) -> DataFrame:
    """(host, path, c, df): on how many pages of the host a branch of that path says a clause."""
    n = b.select("host", "item_table", "item_id", F.explode("nodes").alias("x")).select("host", "item_table", "item_id", "x.path", F.explode("x.clauses").alias("c"))
    return n.distinct().groupBy("host", "path", "c").agg(F.count("*").alias("df"))


def style_tree(b: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the merged trees; by counts only, so a host of any size is spread."""
    n = b.select("host", "item_table", "item_id", F.explode("nodes").alias("x")).select("host", "item_table", "item_id", "x.*")
    pages = n.select("host", "path", "item_table", "item_id").distinct().groupBy("host", "path").agg(F.count("*").alias("pages"))
    styles = n.groupBy("host", "path", "style").agg(F.count("*").alias("k"), F.sum("n").alias("children"))
    styles = styles.groupBy("host", "path").agg(F.sum("k").alias("total"), F.sum(F.col("k") * F.log("k")).alias("klogk"), F.sum("children").alias("children"))
    spread = said(b).groupBy("host", "path").agg(F.avg(F.log("df")).alias("spread"))
    x = pages.join(styles, ["host", "path"]).join(spread, ["host", "path"], "left")
    base = F.when(F.col("pages") > 1, F.log("pages"))
    style = F.coalesce((F.log("total") - F.col("klogk") / F.col("total")) / base, F.lit(1.0))
    bare = F.when(F.col("children") > 0, F.lit(0.0)).otherwise(F.lit(1.0))  # without words of its own: its children decide
    content = F.when(F.col("spread").isNull(), bare).otherwise(1 - F.coalesce(F.col("spread") / base, F.lit(0.0)))
    g = F.pow(F.lit(G), F.col("children") / F.col("total"))
    return x.select("host", "path", "pages", ((1 - g) * F.least(style, F.lit(1.0)) + g * content).alias("importance"))


def at_sites(b: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Branches with their document's site as the host; a document without one stays its own host."""
    if sites is None:
        return b
    return b.join(sites, b["host"] == sites["doc"], "left").withColumn("host", F.coalesce("site", "host")).drop("doc", "site")


def parsed(pages: DataFrame, sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with markup: item_table, item_id, kinds, low; all pages): `low` are the noisy paths on the page with what their pages repeat."""
    p = pages.where("item_id is not null")
    marked = p.where(F.col("text").rlike(SIGNS)).select("item_table", "item_id", F.coalesce("host", F.lit("")).alias("host"), "text")
    b = cut_lineage(at_sites(branches(marked), sites))  # read by five plans, parsed once
    low = style_tree(b).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW)).select("host", "path", "pages")
    often = said(b).join(low, ["host", "path"]).where(F.col("df") * 2 >= F.col("pages"))
    often = often.groupBy("host", "path").agg(F.collect_set("c").alias("repeated"))  # at most twice what a page says there on average
    low = low.join(often, ["host", "path"], "left").select("host", "path", F.coalesce("repeated", F.array().cast("array<bigint>")).alias("repeated"))
    at = b.select("item_table", "item_id", "host", F.explode("nodes.path").alias("path")).distinct()
    dropped = at.join(low, ["host", "path"]).groupBy("item_table", "item_id").agg(F.collect_list(F.struct("path", "repeated")).alias("low"))  # at most a page's own paths
    kinds = b.groupBy("item_table", "item_id").agg(F.first("kinds").alias("kinds"))
    return kinds.join(dropped, ["item_table", "item_id"], "left"), p


def clean(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(item_table, item_id, kinds, clean_text, n_dropped) of every page; `sites` gives the hosts' sites, where there are any."""
    found, p = parsed(pages, sites)
    all_ = p.select("item_table", "item_id", "text").dropDuplicates(["item_table", "item_id"]).join(found, ["item_table", "item_id"], "left")
    schema = pa.schema([("item_table", pa.string()), ("item_id", pa.string()), ("kinds", pa.list_(pa.string())), ("clean_text", pa.string()), ("n_dropped", pa.int32())])

    def fn(cols):
        texts, n = [], []
        for t, s, k, low in zip(cols["item_table"], cols["text"], cols["kinds"], cols["low"], strict=True):
            gone: list[tuple[int, int]] = []
            if k and low:
                gone = noise(tree(s, tokens(s, t == "doc_tables")), s, {x["path"]: set(x["repeated"]) for x in low})
                kept, at = [], 0
                for a, b in gone:
                    kept.append(s[at:a])
                    at = b
                s = "".join([*kept, s[at:]])
            texts.append(page_text(s) if k else s)
            n.append(len(gone))
        return {"item_table": cols["item_table"], "item_id": cols["item_id"], "kinds": [k or [] for k in cols["kinds"]], "clean_text": texts, "n_dropped": n}

    return map_arrow(all_, fn, "item_table string, item_id string, kinds array<string>, clean_text string, n_dropped int", schema)


def pages(spark, sf_dir) -> DataFrame:
    """(item_table, item_id, host, text) of all blocks and tables; the host is the document's."""
    b = table(spark, sf_dir, "doc_blocks").select(F.lit("doc_blocks").alias("item_table"), F.col("block_id").alias("item_id"), F.col("doc_id").alias("host"), "text")
    t = table(spark, sf_dir, "doc_tables").select(F.lit("doc_tables").alias("item_table"), F.col("table_id").alias("item_id"), F.col("doc_id").alias("host"), F.col("markdown").alias("text"))
    return b.unionByName(t)


def sites(spark, sf_dir) -> DataFrame:
    """(doc, site) of the documents: the folder of the source path."""
    d = table(spark, sf_dir, "fin_docs").where("doc_id is not null")
    return d.groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.regexp_extract("source_path", "^(.*)/[^/]*$", 1)).alias("site"))


def p1_found(spark, sf_dir):
    """Pages with markup, one row per kind that their tree holds; the rows come out of `clean`, so trees are merged and texts cleaned for them."""
    return clean(pages(spark, sf_dir), sites(spark, sf_dir)).select("item_table", "item_id", F.explode("kinds").alias("markup"))


def p1_clean(spark, sf_dir):
    """Clean text of every block and table."""
    return clean(pages(spark, sf_dir), sites(spark, sf_dir))


def p1_style_tree(spark, sf_dir):
    """Merged style tree of every site."""
    p = pages(spark, sf_dir).where(F.col("item_id").isNotNull() & F.col("text").rlike(SIGNS))
    b = at_sites(branches(p.withColumn("host", F.coalesce("host", F.lit("")))), sites(spark, sf_dir))
    return style_tree(b).withColumn("importance", F.round("importance", 6))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p1_style_tree": p1_style_tree}
