"""Repair of text from scanned pages: running strips, page figures, divided words and misread characters.

Misread characters are decoded by a noisy channel: a word as seen is some word as written times the chance of confusing their characters, which is estimated from the
misreadings that single words show in all scanned items (with PRIOR observations of CONFUSE before any); the written words of a line
are those of the greatest product of confusion probabilities and corpus n-gram likelihood, found by Viterbi over each word's candidates (for Han text, over the
characters that may be confused, with trigrams). The n-grams of words, word pairs and Han trigrams of the whole corpus are counted in tables of fixed size (hashed,
TABLE_BITS), so what is broadcast doesn't grow with the data. Where a corpus fills a table, the median cell, all collisions, is taken off every count and a word
must stand clear of it to be known; the rarest words are then unknown, none becomes known by collisions.

A running strip is a short line that a document repeats in at least STRIP blocks, up to case, misread characters and a page figure at its end; captions and
headings are none. Divided words are joined where the corpus knows the whole rather than both parts.

Only documents whose parser is the scanner's, or unknown, are looked at. Null texts come out null, empty ones empty; null pages only weaken the page figure's test;
repeated rows give one row; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import codes, map_arrow, passes
from orrery.tables import table

SCANNER, STRIP, TABLE_BITS, SLICE_BITS = "paddleocr-vl", 3, 22, 16
KNOWN, RATIO, CONFUSE, BACKOFF, PRIOR = 5, 30, 0.01, 50, 500
# What is seen and what may have been written.
SEEN_LATIN = [("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("l", "i"), ("i", "l"), ("I", "l"), ("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "n"), ("n", "u"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("q", "g"), ("a", "o"), ("o", "a"), ("ri", "n"), ("nn", "m")]
SEEN_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "!": "1", "|": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "D": "0", "g": "9", "q": "9", "b": "6", "G": "6"}
SEEN_HAN = "入人 人入 全金 金全 末未 未末 干于 于干 千干 偾债 债偾 凤风 风凤 胀账 帐账 账胀 曰日 日曰 己已 已己 巳已 土士 士土 太大 大太 天夫 夫天 本木 木本 自白 白自 目日 贝见 见贝 刀力 力刀 间问 问间 侯候 候侯 折拆 拆折 治冶 冶治 准淮 住往 往住 赔陪 陪赔 费贵 贵费 限恨 任仕 仕任 保堡 王玉 玉主 主王 公么 厂广 开升 午牛 甲申 由田 田由 因困 困因 团因 今令 令今 名各 各名 若苦 苦若 券卷 卷券 股胶 失矢 末来 拨拔 项顶 顶项 率牵 币市 市币 息恩 货贷 贷货 收攻 期斯 额颔".split()
HAN = {}
for _p in SEEN_HAN:
    HAN.setdefault(_p[0], []).append(_p[1])
MASK = (1 << TABLE_BITS) - 1
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = re.compile(rf"[{LETTER}]+")
ROUGH = re.compile(rf"[{LETTER}0-9!]+")
ROUGH_FIGURE = re.compile(r"\d[,.]?[OolISBZ!]|[OolISBZ!][,.]?\d")
SEEN = regex.compile(rf"(?<![\w\\#=&/.@-])(?=[^\s]*[{LETTER}])[{LETTER}](?:[{LETTER}0-9]|!(?=[{LETTER}]))+(?![\w=(/@])|(?<![\w\\#=&/.@-])[01!](?:[{LETTER}]|[01!](?=[{LETTER}]))*[{LETTER}]{{2,}}(?![\w=(/@])")
FIGURE = regex.compile(r"(?<![A-Za-z0-9_#=.,\\{/-])(?=[0-9A-Za-z!,.|]*\d)(?=[0-9,.]*[OolISBZ!])[0-9OolISBZ!]+(?:[,.][0-9OolISBZ!]+)*(?![A-Za-z0-9_=({])")
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
HAN_RUN = re.compile(f"[{''.join(sorted(HAN))}]")
MARKS = "-‐‑¬\xad"
DIVIDED = regex.compile(rf"([{LETTER}]+)([{MARKS}])[ \t]*\r?\n[ \t]*([{LETTER}]+)")
D = r"[0-9OolISBZ!]"
PAGE = regex.compile(rf"[-–—·•~]\s*(?P<a>{D}{{1,4}})\s*[-–—·•~]|(?P<b>{D}{{1,4}})\s*/\s*{D}{{1,4}}|(?i:page|p\.)\s*(?P<c>{D}{{1,4}})(?:\s*(?i:[o0]f|/)\s*{D}{{1,4}})?|第\s*(?P<d>{D}{{1,4}})\s*页(?:[，,\s]*共\s*{D}{{1,4}}\s*页)?|(?P<bare>{D}{{1,4}})|(?P<roman>[ivxlcIVXLC]+)")
ROMAN = regex.compile(r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


#: Quick test for a line that may give the page.
PAGE_LIKE = re.compile(r"[-–—·•~\s0-9OolISBZ!pPaAgGeEfF./第页共，,ivxlcVXLC]+$")


def digits(s: str) -> str:
    return "".join(SEEN_DIGIT.get(x, x) for x in s)


def roman(s: str) -> int:
    """Value of a Roman figure below 100."""
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))


def is_page(line: str, page: int | None) -> bool:
    """Whether a line only gives the page."""
    m = PAGE.fullmatch(" ".join(line.split()))
    if not m:
        return False
    if m["roman"]:  # of the front matter; l may be a misread i
        low = m["roman"].lower()
        return bool(ROMAN.fullmatch(low)) if page is None else any(ROMAN.fullmatch(r) and roman(r) == page for r in (low, low.replace("l", "i")))
    if not regex.search(r"\d", line):  # a figure misread throughout
        return page is not None and digits(m["a"] or m["b"] or m["c"] or m["d"] or m["bare"]) == str(page) and not m["bare"]
    n = digits(m["a"] or m["b"] or m["c"] or m["d"] or m["bare"])
    if not n.isdigit():
        return False
    if m["bare"]:
        return int(n) == page if page is not None else int(n) < 1900 and len(n) < 4
    return True


# ---- strips, on the JVM side ----

FOLD_FROM = "0o1il!|5s8b2z6g9qec入全末干千偾凤胀帐曰己已"


def folded(line: Column) -> Column:
    """A line up to case, white space and misread characters."""
    x = F.translate(F.lower(line), FOLD_FROM, _fold_to())
    return F.regexp_replace(F.regexp_replace(x, "rn", "m"), r"[\s　]+", "")


def _fold_to() -> str:
    to = {"0": "o", "o": "o", **dict.fromkeys("1il!|", "l"), **dict.fromkeys("5s", "s"), **dict.fromkeys("8b", "b"), **dict.fromkeys("2z", "z"), **dict.fromkeys("6g9q", "g"), **dict.fromkeys("ec", "c")}
    to |= dict(zip("入全末干千偾凤胀帐曰己已", "人金未于于债风账账日已已", strict=True))
    return "".join(to[x] for x in FOLD_FROM)


def py_folded(line: str) -> str:
    return regex.sub(r"\s+", "", line.lower().translate(str.maketrans(FOLD_FROM, _fold_to())).replace("rn", "m"))


TAIL = r"[\s　]+[0-9OolISBZ!]{1,4}$"


def strip_lines(items: DataFrame) -> DataFrame:
    """(item_table, item_id, strips): folded strips of the items that hold any."""
    x = items.where(~F.col("type").isin("heading", "table") | F.col("type").isNull()).select("item_table", "item_id", "doc_id", F.explode(F.filter(F.split("text", "\n"), lambda y: F.length(y) >= 4)).alias("line"))
    x = x.withColumn("line", F.regexp_replace(F.regexp_replace("line", "<[^<>]*>", ""), r"^[\s　]+|[\s　]+$", "")).where((F.length("line") >= 4) & ~F.col("line").rlike(r"^[|!<=#\\{\[*>&`~+-]|[。，；：,;:|}\]>]$|[.](?:$|\s)|^[\d\s.,%·/-]+$|^Page \d|^第\s*\d+\s*页"))
    cut = F.when(F.col("line").rlike(TAIL), F.regexp_replace("line", TAIL, ""))
    lines = x.select("item_table", "item_id", "doc_id", F.explode(F.array_compact(F.array(F.col("line"), cut))).alias("line"))
    lines = lines.select("item_table", "item_id", "doc_id", folded(F.col("line")).alias("key")).distinct().where(F.length("key") >= 4)
    often = lines.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= STRIP).select("doc_id", "key")
    return lines.join(often, ["doc_id", "key"]).groupBy("item_table", "item_id").agg(F.collect_set("key").alias("strips"))  # at most an item's own lines


# ---- the language model ----


def word_at(w: str) -> int:
    return zlib.crc32(w.encode("utf-8", "surrogatepass")) & MASK


def pair_at(a: str, b: str) -> int:
    return zlib.crc32(b.encode("utf-8", "surrogatepass"), zlib.crc32(a.encode("utf-8", "surrogatepass"))) & MASK


K = 0x9E3779B97F4A7C15


def han_at(x: int, y: int, z: int) -> int:
    return (((((x * K + y) & M64) * K + z) & M64) * K & M64) >> (64 - TABLE_BITS)


M64 = (1 << 64) - 1
MODEL_SCHEMA = "kind int, slice int, counts binary"
FAN_IN = 64
MODEL = pa.schema([("kind", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary())])


def _count(batches):
    """Per task: word, word pair and Han trigram counts, cut into compressed slices."""
    t = [np.zeros(1 << TABLE_BITS, np.uint32) for _ in range(3)]
    for b in batches:
        texts = [x for x in b.column(0).to_pylist() if x]
        for lo, hi in passes(texts):
            joined = "\n\n".join(texts[lo:hi])
            uni, bi = Counter(), Counter()
            for line in joined.split("\n"):
                w = [x.lower() for x in WORD.findall(line)]
                uni.update(w)
                bi.update(zip(w, w[1:], strict=False))
            for table_, at, c in ((t[0], [word_at(w) for w in uni], uni), (t[1], [pair_at(x, y) for x, y in bi], bi)):
                if at:
                    np.add.at(table_, at, np.fromiter(c.values(), np.uint32, len(c)))
            c = codes(joined).astype(np.uint64)
            if len(c) > 2:
                with np.errstate(over="ignore"):
                    k = np.uint64(K)
                    h = (((c[:-2] * k + c[1:-1]) * k + c[2:]) * k >> np.uint64(64 - TABLE_BITS)).astype(np.uint32)
                han = (c >= 0x4E00) & (c < 0xA000)
                u, n = np.unique(h[han[:-2] & han[1:-1] & han[2:]], return_counts=True)
                t[2][u] += n.astype(np.uint32)
    rows = [(k, s, zlib.compress(x.tobytes(), 1)) for k in range(3) for s, x in enumerate(t[k].reshape(-1, 1 << SLICE_BITS)) if x.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MODEL, strict=True)], schema=MODEL)


def language_model(texts: DataFrame) -> list[np.ndarray]:
    """Count tables over all of a text column; 3 x 2**TABLE_BITS counts, whatever the corpus."""

    def add(pdf):  # a group holds what FAN_IN tasks counted, or fewer
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in pdf["counts"])
        total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pdf[["kind", "slice", "counts"]].head(1).assign(counts=[zlib.compress(total.tobytes(), 1)])

    rows = texts.mapInArrow(_count, MODEL_SCHEMA)
    tasks = texts.rdd.getNumPartitions()
    while tasks > FAN_IN:  # levels of partial sums: no task reads more than FAN_IN slices' worth
        groups = -(-tasks // FAN_IN)
        rows = rows.groupBy("kind", "slice", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g")).applyInPandas(add, MODEL_SCHEMA)
        tasks = groups
    parts = rows.groupBy("kind", "slice").applyInPandas(add, MODEL_SCHEMA).collect()  # 192 rows at most
    out = [np.zeros(1 << TABLE_BITS, np.uint32) for _ in range(3)]
    for r in parts:
        out[r["kind"]][r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return out


def han_around(cs, i: int) -> tuple[int, int]:
    """Extent of the Han characters next to the one at i that its trigrams need."""
    lo, hi = i, i + 1
    while lo > 0 and i - lo < 2 and "一" <= cs[lo - 1] <= "鿿":
        lo -= 1
    while hi < len(cs) and hi - i < 3 and "一" <= cs[hi] <= "鿿":
        hi += 1
    return lo, hi


LOG_CONFUSE = math.log(CONFUSE)


class Channel:
    """Decodes lines by the noisy channel; `confusion` holds the chances of seeing a for b, CONFUSE where none was estimated."""

    def __init__(self, tables: list[np.ndarray], confusion: dict[tuple[str, str], float] | None = None):
        self.words, self.pairs, self.han = tables
        self.confusion = {k: math.log(p) for k, p in (confusion or {}).items()}
        # a full table: what its median cell holds by collisions is nobody's count
        self.floor, self.pair_floor, self.han_floor = (int(np.median(t)) for t in tables)
        self.known, self.han_known = (max(KNOWN, math.ceil(6 * math.sqrt(x))) for x in (self.floor, self.han_floor))
        self.total = float(max(1, int(self.words.sum(dtype=np.uint64))))
        self.count = functools.lru_cache(300_000)(lambda w: max(0, int(self.words[word_at(w)]) - self.floor))
        self.candidates = functools.lru_cache(100_000)(self._candidates)
        self.suspicious = functools.lru_cache(300_000)(self._suspicious)
        self.doubtful = functools.lru_cache(300_000)(self._doubtful)

    def log_confusion(self, seen: str, written: str) -> float:
        return self.confusion.get((seen, written), LOG_CONFUSE)

    def _candidates(self, seen: str) -> tuple[tuple[str, float, tuple[tuple[str, str], ...]], ...]:
        """Written forms of a word with the log probability of seeing it so and the confusions it takes; the word itself first.

        Up to three confusions are tried, more of them only where fewer explain nothing.
        """
        low = seen.lower()
        own = self.count(low) if low.isalpha() else 0
        out = {low: (math.log(1 - CONFUSE), ())}
        if len(low) >= 3:
            front: dict[str, tuple[tuple[str, str], ...]] = {low: ()}
            for depth in (1, 2, 3):
                grown: dict[str, tuple[tuple[str, str], ...]] = {}
                for w, used in front.items():
                    for a, b in SEEN_LATIN:
                        at = w.find(a.lower())
                        while at >= 0:
                            grown.setdefault(w[:at] + b + w[at + len(a) :], (*used, (a, b)))
                            at = w.find(a.lower(), at + 1)
                for w, used in grown.items():
                    if w not in out and w.isalpha() and self.count(w) >= max(self.known, RATIO * own):
                        out[w] = sum(self.log_confusion(*p) for p in used), used
                if len(out) > 1 or depth == 2 and low.isalpha():
                    break
                front = grown if not low.isalpha() or len(low) >= 5 else {}
        return tuple((w, p, used) for w, (p, used) in out.items())

    def word_score(self, w: str, before: str | None) -> float:
        """Log probability of a written word after another; a word that is likely misread counts as never seen."""
        known = len(self.candidates(w)) == 1 and w.isalpha()
        uni = ((self.count(w) if known else 0) + 0.01) / self.total
        if before is None:
            return math.log(uni)
        seen = max(0, int(self.pairs[pair_at(before, w)]) - self.pair_floor - 1) if known else 0  # a pair seen once says nothing
        return math.log((seen + BACKOFF * uni) / (max(self.count(before), BACKOFF) + BACKOFF))

    def decode_words(self, seen: list[str]) -> list[str]:
        """The line's words as written, by Viterbi."""
        best: dict[str | None, tuple[float, list[str]]] = {None: (0.0, [])}
        for s in seen:
            nxt: dict[str | None, tuple[float, list[str]]] = {}
            for w, channel, _ in self.candidates(s):
                nxt[w] = max(((p + channel + self.word_score(w, b), [*path, w]) for b, (p, path) in best.items()), key=lambda x: x[0])
            best = nxt
        return max(best.values(), key=lambda x: x[0])[1]

    def trigram(self, x: int, y: int, z: int) -> int:
        return max(0, int(self.han[han_at(x, y, z)]) - self.han_floor)

    def decode_han(self, run: str) -> str:
        """A short Han stretch as written: trigrams over the characters that may be confused, by Viterbi."""
        best: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for c in run:
            nxt: dict[str, tuple[float, str]] = {}
            for to in (c, *HAN.get(c, ())):
                for path_p, path in best.values():
                    p = path_p + (self.log_confusion(c, to) if to != c else 0.0)
                    if len(path) >= 2:
                        p += math.log(self.trigram(ord(path[-2]), ord(path[-1]), ord(to)) + 0.02)
                    key = (path + to)[-2:]
                    if key not in nxt or p > nxt[key][0]:
                        nxt[key] = p, path + to
            best = nxt
        return max(best.values(), key=lambda x: x[0])[1]

    def repair_line(self, line: str) -> str:
        """The line as written."""
        out = line
        if ROUGH_FIGURE.search(out):
            def figure(m):
                s = m.group()
                n = sum(x.isdigit() for x in s)
                letters = sum(x.isalpha() or x == "!" for x in s)
                if s.endswith("!") and out[m.end() : m.end() + 1] in ("", " "):
                    return s
                after = out[m.end() : m.end() + 12]
                dated = regex.match(rf"\s(?:{MONTH})|[年月日]|页", after) or regex.search(rf"(?:{MONTH})\s$", out[max(0, m.start() - 11) : m.start()])
                if n >= 2 and (n >= letters) and len(s) >= 3 or n and dated:
                    return digits(s)
                return s

            out = FIGURE.sub(figure, out)
        seen = [(m.start(), m.end(), m.group()) for m in SEEN.finditer(out)] if any(map(self.suspicious, ROUGH.findall(out))) else []
        if any(not s.isalpha() or (len(self.candidates(s)) > 1) for _, _, s in seen):
            for (a, b, s), w in reversed(list(zip(seen, self.decode_words([s for _, _, s in seen]), strict=True))):
                if w != s.lower():
                    w = w.upper() if s.isupper() and len(s) > 2 else w.capitalize() if s[0].isupper() else w
                    out = out[:a] + w + out[b:]
        marks = [m.start() for m in HAN_RUN.finditer(out)]
        if marks:
            cs = list(out)
            for i in marks:
                lo, hi = han_around(cs, i)
                if hi - lo >= 3 and self.doubtful("".join(cs[lo:hi]), i - lo):
                    cs[lo:hi] = list(self.decode_han("".join(cs[lo:hi])))
            out = "".join(cs)
        return out

    def _suspicious(self, seen: str) -> bool:
        """Whether a rough token may be a misread word."""
        if seen.isalpha():
            return len(self.candidates(seen)) > 1
        return any(c.isalpha() for c in seen)

    def _doubtful(self, run: str, i: int) -> bool:
        """Whether some confusion of the Han character at i is far better known in its place."""

        def known(c):
            x = run[:i] + c + run[i + 1 :]
            return sum(self.trigram(*map(ord, x[a : a + 3])) for a in range(max(0, i - 2), i + 1) if a + 2 < len(x))

        own = known(run[i])
        return any(known(c) >= max(self.han_known, RATIO * own) for c in HAN[run[i]])

    def evident(self, text: str) -> Counter:
        """Confusions that single words and Han characters of a text show by themselves."""
        out: Counter = Counter()
        for w in ROUGH.findall(text):
            if self.suspicious(w):
                for _, _, used in self.candidates(w)[1:2]:
                    out.update(used)
        for m in HAN_RUN.finditer(text):
            lo, hi = han_around(text, m.start())
            if hi - lo >= 3 and self.doubtful(text[lo:hi], m.start() - lo):
                to = self.decode_han(text[lo:hi])
                out.update((a, b) for a, b in zip(text[lo:hi], to, strict=True) if a != b)
        return out

    def join_divided(self, text: str) -> tuple[str, bool]:
        """The text with words divided over a line end joined, and whether there were any."""
        found = False

        def join(m):
            nonlocal found
            left, mark, right = m.groups()
            whole = self.count((left + right).lower())
            parts = self.count(left.lower()) >= self.known and self.count(right.lower()) >= self.known
            if right[0].isupper() and not left.isupper():
                return m.group()
            if mark in "¬\xad" or whole >= self.known or not parts:
                if mark == "-" and whole < self.known and len(left) == 1 and left.isupper():
                    return m.group()
                found = True
                return left + right + "\n"
            return m.group()

        return DIVIDED.sub(join, text), found


def repair(text: str, page: int | None, strips: set[str], channel: Channel, is_table: bool) -> tuple[str, set[str]]:
    """(continuous text, kinds of noise found)."""
    kinds, kept = set(), []
    for line in text.split("\n"):
        bare = re.sub(r"<[^<>]*>", "", line).strip() if "<" in line else line.strip()
        if bare and PAGE_LIKE.match(bare) and is_page(bare, page):
            kinds.add("page_number")
            continue
        if strips and len(bare) >= 4:
            if py_folded(bare) in strips or py_folded(regex.sub(TAIL, "", bare)) in strips:
                kinds.add("running_header")
                continue
        kept.append(line)
    s = "\n".join(kept)
    if "\n" in s and any(x in s for x in MARKS):
        s, divided = channel.join_divided(s)
        if divided:
            kinds.add("hyphenation")
    lines = s.split("\n")
    fixed = [channel.repair_line(x) for x in lines]
    if fixed != lines:
        kinds.add("misread")
    if is_table or len(fixed) == 1 or "|" in s or "```" in s:
        return "\n".join(fixed), kinds
    out: list[str] = []
    for x in fixed:
        x = x.strip("\r")
        if out and out[-1] and x and not regex.search(r"[.。！？!?；;：:>}\]]\s*$", out[-1]) and not regex.match(r"\s*(?:[-*#>|<\\{\[]|\d+[.)、]|[（(]\S{1,4}[）)])", x):
            glue = "" if regex.search(rf"[{MARKS}⺀-鿿，、]\s*$", out[-1]) or regex.match(r"[⺀-鿿]", x) else " "
            out[-1] = out[-1].rstrip() + glue + x.lstrip()
        else:
            out.append(x)
    return "\n".join(out).strip("\n"), kinds


def items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(items of scanned documents, texts of the whole corpus)."""
    docs = table(spark, sf_dir, "fin_docs").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("parser"), F.lit(SCANNER)) == SCANNER).alias("scanned")).where("scanned").select("doc_id")
    b = table(spark, sf_dir, "doc_blocks").select(F.lit("doc_blocks").alias("item_table"), F.col("block_id").alias("item_id"), "doc_id", "page", "type", "text")
    t = table(spark, sf_dir, "doc_tables").select(F.lit("doc_tables").alias("item_table"), F.col("table_id").alias("item_id"), "doc_id", "page", F.lit(None).cast("string").alias("type"), F.col("markdown").alias("text"))
    all_ = b.unionByName(t)
    return all_.where("item_id is not null").join(docs, "doc_id", "left_semi"), all_.select("text")


def confusions(scanned: DataFrame, model) -> dict[tuple[str, str], float]:
    """Chance of seeing a for b in an item that is misread at all, of each pair of the confusion lists, from all scanned items."""
    state: dict = {}
    schema = pa.schema([("seen", pa.string()), ("written", pa.string()), ("n", pa.int64()), ("of", pa.int64())])
    pairs = [(a, b) for a, b in SEEN_LATIN] + [(p[0], p[1]) for p in SEEN_HAN]

    def run(batches):
        ch = state.get("channel") or state.setdefault("channel", Channel(model.value))
        n, of = Counter(), Counter()
        for b in batches:
            for s in b.column(0).to_pylist():
                e = ch.evident(s)
                if e:
                    n.update(e)
                    low = s.lower()
                    of.update({w: k for w in {w for _, w in pairs} if (k := low.count(w))})
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(a, b, n[a, b], of[b]) for a, b in pairs], strict=True), schema, strict=True)], schema=schema)

    rows = scanned.where("text is not null").select("text").mapInArrow(run, "seen string, written string, n bigint, of bigint")
    got = rows.groupBy("seen", "written").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).collect()  # the pairs of the lists
    return {(r["seen"], r["written"]): min(0.5, (r["n"] + PRIOR * CONFUSE) / (r["of"] + r["n"] + PRIOR)) for r in got}


def repaired(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_table, item_id, kinds, text) of every item of a scanned document."""
    sc = scanned.sparkSession.sparkContext
    counts = language_model(texts)
    first = sc.broadcast(counts)  # fixed size
    model = sc.broadcast((counts, confusions(scanned, first)))  # fixed size
    first.unpersist()
    state: dict = {}
    schema = pa.schema([("item_table", pa.string()), ("item_id", pa.string()), ("kinds", pa.list_(pa.string())), ("text", pa.string())])

    def fn(cols):
        ch = state.get("channel") or state.setdefault("channel", Channel(*model.value))
        kinds, out = [], []
        for t, s, page, strips in zip(cols["item_table"], cols["text"], cols["page"], cols["strips"], strict=True):
            r, k = (s, set()) if s is None else repair(s, page, set(strips or ()), ch, t == "doc_tables")
            out.append(r)
            kinds.append(sorted(k))
        return {"item_table": cols["item_table"], "item_id": cols["item_id"], "kinds": kinds, "text": out}

    rows = scanned.dropDuplicates(["item_table", "item_id"]).join(strip_lines(scanned), ["item_table", "item_id"], "left")
    return map_arrow(rows.select("item_table", "item_id", "page", "text", "strips"), fn, "item_table string, item_id string, kinds array<string>, text string", schema)


def p2_found(spark, sf_dir):
    """Items with scan noise, one row per kind."""
    return repaired(*items(spark, sf_dir)).select("item_table", "item_id", F.explode("kinds").alias("noise"))


def p2_repaired(spark, sf_dir):
    """Repaired texts of all items of scanned documents."""
    return repaired(*items(spark, sf_dir)).select("item_table", "item_id", F.array_join("kinds", ",").alias("noise"), "text")


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
