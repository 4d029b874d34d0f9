"""Languages of documents and of their segments: a linear-chain conditional random field over words.

Words are runs of Latin letters, of Han characters or of another script's letters, marks included; what lies between belongs to the word before. A word's features are
itself in lower case (lexicon), its affixes and its inner n-grams, hashed; a capital halves their weight and more, as names tell little; a Han run has the features
of its characters' kind. Transitions between languages are learned with them, on at most MAX_SAMPLES labelled rows cut and joined into mixed sequences, once for
the same samples. Letters of other scripts are none of the languages': they are `other`, a further state of the chain, and so are Han characters among them. Forward-backward
runs over windows of WINDOW words with CONTEXT words on either side, all windows of a batch at once, and gives each word's language with its
probability; every word of every document is labelled. Texts in a further language of Latin script get the nearest of the six: none is trained for them.

A document's language is the one most of its characters are in. Null, empty and letterless texts get no language (null, confidence 0); labels are read
whatever their spelling. Repeated rows of an id give one row; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import codes, map_arrow, passes
from orrery.tables import table

LANGS = ("zh", "en", "de", "fr", "es", "pt")
MAX_SAMPLES, FEATURES, WINDOW, CONTEXT, LEAST, SURE, CAPITAL, STAY = 3000, 1 << 15, 64, 24, 100, 0.8, 0.3, 0.8
HAN, OTHER = "一", "other"
#: Scores of the state `other`: for a letter of another script, and for a Han run against Chinese.
FOREIGN, AMONG = 12.0, 3.0
# Codes and names by which a label means one of the languages.
NAMES = {
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語",
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
}
NONE = ("", "und", "unknown")
MEANS = {x: k for k, v in NAMES.items() for x in v.split()}
WORD = regex.compile(r"[\p{Latin}\p{M}]+|\p{Han}+")
HANS = regex.compile(r"\p{Han}")
U = np.uint64


def meaning(label: str):
    """Column: the language a label column means; '' for none, '?' for one not among LANGS."""
    c = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    base = F.element_at(F.split(c, "[-_ (]"), 1)
    m = F.create_map(*[F.lit(x) for kv in MEANS.items() for x in kv])
    return F.when(c.isin(*NONE) | base.isin(*NONE), "").otherwise(F.coalesce(m[c], m[base], F.lit("?")))


@functools.lru_cache(200_000)
def features(word: str) -> tuple[int, ...]:
    w = f"<{unicodedata.normalize('NFC', word.lower())}>"
    out = {"=" + w}
    out |= {f"p{w[:k]}" for k in (2, 3, 4)} | {f"s{w[-k:]}" for k in (2, 3, 4, 5)}
    out |= {w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)}
    out |= {c for c in w if c > "z"}
    return tuple(sorted({zlib.crc32(x.encode()) % FEATURES for x in out}))


def forward_backward(e: np.ndarray, a: np.ndarray, start: np.ndarray, mask: np.ndarray, pairs: bool = False):
    """Word posteriors of sequences (n x t x k scores `e`, transitions `a`, first-word scores `start`); with `pairs` also the summed transition posteriors and the log likelihood's normaliser."""
    n, t, k = e.shape
    top = e.max(2, keepdims=True)
    x = np.exp(e - top)
    tr, st = np.exp(a), np.exp(start)
    alpha, scale = np.empty_like(x), np.empty((n, t), x.dtype)
    for i in range(t):
        cur = x[:, i] * (alpha[:, i - 1] @ tr if i else st)
        if i:
            cur = np.where(mask[:, i, None], cur, alpha[:, i - 1])
        scale[:, i] = cur.sum(1)
        alpha[:, i] = cur / scale[:, i, None]
    beta = np.ones_like(x)
    for i in range(t - 2, -1, -1):
        b = (x[:, i + 1] * beta[:, i + 1]) @ tr.T
        b /= b.sum(1, keepdims=True)
        beta[:, i] = np.where(mask[:, i + 1, None], b, beta[:, i])
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    if not pairs:
        return gamma
    xi = np.zeros((k, k))
    for i in range(1, t):
        m = mask[:, i]
        if m.any():
            y = alpha[m, i - 1, :, None] * tr[None] * (x[m, i] * beta[m, i])[:, None, :]
            xi += (y / y.sum((1, 2), keepdims=True)).sum(0)
    return gamma, xi


def weight(word: str) -> float:
    return CAPITAL if word[0].isupper() else 1.0


def words(text: str) -> list[str]:
    return [HAN if HANS.match(m) else m for m in WORD.findall(text) if HANS.match(m) or any(map(str.isalpha, m))]


def train(samples: list[tuple[str, str]], rounds: int = 60, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of the field from (language, text) rows; the mixed sequences are made from a fixed seed."""
    rng = np.random.default_rng(seed)
    rows = [(LANGS.index(lang), w) for lang, text in samples if lang in LANGS and text and (w := words(text))]
    if not rows:
        return {"w": np.zeros((FEATURES, len(LANGS)), np.float32), "a": np.zeros((len(LANGS),) * 2), "s": np.zeros(len(LANGS))}
    pools = {k: [r for r in rows if r[0] == k] for k in range(len(LANGS))}
    seqs = []
    for _ in range(max(300, min(2 * len(rows), 2000))):
        seq: list[tuple[str, int]] = []
        lang = -1
        for _ in range(rng.integers(2, 6)):
            lang, w = pools[lang][rng.integers(len(pools[lang]))] if lang >= 0 and rng.random() < STAY else rows[rng.integers(len(rows))]
            a = int(rng.integers(0, max(1, len(w) // 2)))
            b = a + int(rng.integers(max(1, min(6, len(w) - a)), len(w) - a + 1))
            seq += [(x, lang) for x in (w if rng.random() < 0.8 else w[a:b])]
        seqs.append(seq)
    vocab = {x: i for i, x in enumerate(sorted({x for s in seqs for x, _ in s}))}
    t = max(map(len, seqs))
    ids, y, mask = np.zeros((len(seqs), t), int), np.zeros((len(seqs), t), int), np.zeros((len(seqs), t), bool)
    for i, s in enumerate(seqs):
        ids[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = [vocab[x] for x, _ in s], [z for _, z in s], True
    f, scale = [features(x) for x in vocab], np.array([weight(x) for x in vocab])[:, None]
    of, at = np.repeat(np.arange(len(f)), [len(x) for x in f]), np.concatenate([np.array(x) for x in f])
    k, n = len(LANGS), mask.sum()
    p = {"w": np.zeros((FEATURES, k)), "a": np.eye(k), "s": np.zeros(k)}
    mom, var = {q: np.zeros_like(v) for q, v in p.items()}, {q: np.zeros_like(v) for q, v in p.items()}
    hot = np.eye(k)[y] * mask[..., None]
    seen = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    for r in range(1, rounds + 1):
        e_word = np.zeros((len(f), k))
        np.add.at(e_word, of, p["w"][at])
        e_word *= scale
        gamma, xi = forward_backward(e_word[ids], p["a"], p["s"], mask, pairs=True)
        d = np.zeros((len(f), k))
        np.add.at(d, ids.ravel(), (gamma * mask[..., None] - hot).reshape(-1, k))
        d *= scale
        g = {"w": np.zeros_like(p["w"]), "a": (xi - seen) / n + 1e-4 * p["a"], "s": (gamma[:, 0] - hot[:, 0]).sum(0) / n}
        np.add.at(g["w"], at, d[of] / n)
        g["w"] += 1e-6 * p["w"]
        for q in p:
            mom[q] = 0.9 * mom[q] + 0.1 * g[q]
            var[q] = 0.99 * var[q] + 0.01 * g[q] ** 2
            p[q] = p[q] - 0.1 * (mom[q] / (1 - 0.9**r)) / (np.sqrt(var[q] / (1 - 0.99**r)) + 1e-8)
    return {"w": p["w"].astype(np.float32), "a": p["a"], "s": p["s"]}


_FITTED: dict[str, dict[str, np.ndarray]] = {}


def fitted(samples: tuple[tuple[str, str], ...]) -> dict[str, np.ndarray]:
    """The field of these samples, trained once a process."""
    key = hashlib.blake2b(repr(samples).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = train(list(samples))
    return _FITTED[key]


@functools.cache
def classes() -> np.ndarray:
    """Of a code point: 1 Latin letter, 2 Han, 3 another script's letter, 4 mark, else 0."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for k, of in ((3, r"\p{L}"), (1, r"(?=\p{L})\p{Latin}"), (2, r"(?=\p{L})\p{Han}"), (4, r"\p{M}")):
        kind[codes("".join(regex.findall(of, every)))] = k
    return kind


def kinds(c: np.ndarray) -> np.ndarray:
    """Classes of a text's characters: a mark goes with what it stands on, a foreign letter or two inside a Latin word with the word."""
    kind = classes()[c]
    marks = np.flatnonzero(kind == 4)
    if len(marks):
        base = np.where(kind == 4, 0, np.arange(len(c)))
        kind[marks] = kind[np.maximum.accumulate(base)[marks]]
        kind[kind == 4] = 0
    strange = np.flatnonzero(kind == 3)
    if len(strange):
        start = strange[np.concatenate([[True], np.diff(strange) > 1])]
        stop = strange[np.concatenate([np.diff(strange) > 1, [True]])] + 1
        padded = np.concatenate([[0], kind, [0]])
        inside = (stop - start <= 2) & ((padded[start] == 1) | (padded[stop + 1] == 1))
        for a, b in zip(start[inside].tolist(), stop[inside].tolist(), strict=True):
            kind[a:b] = 1
    return kind


def with_other(model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Transition and start scores with the state `other`, which changes as the languages do on average."""
    k = len(LANGS)
    a, s = np.zeros((k + 1, k + 1), np.float32), np.zeros(k + 1, np.float32)
    a[:k, :k], s[:k] = model["a"], model["s"]
    off = (model["a"].sum() - np.trace(model["a"])) / max(1, k * k - k)
    a[k, :], a[:, k], a[k, k], s[k] = off, off, np.trace(model["a"]) / k, model["s"].mean()
    return a, s


class Labeller:
    """Labels the words of a batch of texts at once."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.known = np.zeros(0, np.uint64)
        self.score = np.zeros((0, len(LANGS)), np.float32)
        self.a, self.s = with_other(model)
        han = model["w"][list(features(HAN))].sum(0)
        self.han = np.append(han, han[0] - AMONG).astype(np.float32)
        self.foreign = np.array([-FOREIGN] * len(LANGS) + [FOREIGN], np.float32)

    def scores(self, h: np.ndarray, first: np.ndarray, length: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Emission scores of words by hash; new ones are scored from their features."""
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.known, u)
        new = (pos >= len(self.known)) | (self.known[np.minimum(pos, max(len(self.known) - 1, 0))] != u) if len(self.known) else np.ones(len(u), bool)
        if new.any():
            fresh = []
            for i in at[new].tolist():
                w = c[first[i] : first[i] + length[i]].tobytes().decode("utf-32-le")
                fresh.append(self.model["w"][list(features(w))].sum(0) * weight(w))
            if len(self.known) > 500_000:  # the table is a cache; it starts again
                self.known, self.score = self.known[:0], self.score[:0]
                return self.scores(h, first, length, c)
            known = np.concatenate([self.known, u[new]])
            order = np.argsort(known)
            self.known, self.score = known[order], np.concatenate([self.score, np.array(fresh, np.float32).reshape(-1, len(LANGS))])[order]
            pos = np.searchsorted(self.known, u)
        return self.score[pos][back]

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end, language, probability) of every word, its end being the next one's start."""
        c = codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        begin = ends - [len(t) for t in texts]
        kind = kinds(c)
        edge = np.zeros(len(c) + 1, bool)
        edge[begin[begin < len(c)]] = True
        first = np.flatnonzero((kind != 0) & (edge[:-1] | (kind != np.concatenate([[0], kind[:-1]]))))
        stop_at = np.flatnonzero((kind != 0) & (edge[1:] | (kind != np.concatenate([kind[1:], [0]])))) + 1
        none = np.zeros(0, np.int64)
        if not len(first):
            return none, none, none, none, np.zeros(0)
        length = stop_at - first
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
            x = c.astype(np.uint64) * U(0xBF58476D1CE4E5B9)
            x ^= x >> U(29)
            where = np.arange(len(c)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(c)]])))
            x = x * power[where & 255]
            cs = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
            h = cs[stop_at] - cs[first]
        e = np.tile(self.han, (len(first), 1))
        e[kind[first] == 3] = self.foreign
        latin = kind[first] == 1
        if latin.any():
            e[latin] = np.pad(self.scores(h[latin], first[latin], length[latin], c), ((0, 0), (0, 1)), constant_values=-FOREIGN)
        text = np.searchsorted(ends, first, side="right")
        # windows: WINDOW words of one text each, with context
        n = np.bincount(text, minlength=len(texts))
        tstart = np.concatenate([[0], np.cumsum(n)])[:-1]
        nth = np.arange(len(first)) - tstart[text]
        core = np.flatnonzero(nth % WINDOW == 0)
        lo = np.maximum(tstart[text[core]], core - CONTEXT)
        hi = np.minimum((tstart + n)[text[core]], core + WINDOW + CONTEXT)
        gamma = np.empty((len(first), len(LANGS) + 1), np.float32)
        size = WINDOW + 2 * CONTEXT
        order = np.argsort(hi - lo, kind="stable")
        for s in range(0, len(core), 2048):
            o = order[s : s + 2048]
            t = int((hi[o] - lo[o]).max())
            idx = lo[o, None] + np.arange(min(size, t))
            mask = idx < hi[o, None]
            g = forward_backward(e[np.minimum(idx, len(first) - 1)], self.a, self.s, mask)
            own = mask & (idx >= core[o, None]) & (idx < core[o, None] + WINDOW)
            gamma[idx[own]] = g[own]
        lang = gamma.argmax(1)
        last = np.append(text[1:] != text[:-1], True)
        end = np.where(last, ends[text], np.append(first[1:], 0))
        start = np.where(nth == 0, begin[text], first)
        return text, start - begin[text], end - begin[text], lang, gamma[np.arange(len(first)), lang]


SEGMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def segments(docs: DataFrame, samples: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, lang, confidence): each text cut into its stretches of one language, in characters."""
    rows = samples.where("lang is not null and text is not null").orderBy(F.xxhash64("sample_id"), "sample_id").limit(MAX_SAMPLES).select("lang", "text").collect()
    model = docs.sparkSession.sparkContext.broadcast(fitted(tuple(sorted({(r["lang"], r["text"]) for r in rows}))))
    state: dict = {}

    def fn(cols):
        lab = state.setdefault("labeller", None) or state.setdefault("made", Labeller(model.value))
        state["labeller"] = lab
        out: list[list] = [[], [], [], [], []]
        for a, b in passes(cols["text"], 500_000):
            doc, start, end, lang, p = lab.label(cols["text"][a:b])
            if not len(doc):
                continue
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])]))
            stop = np.append(new[1:], len(doc))
            w = (end - start).astype(float)
            conf = np.add.reduceat(w * p, new) / np.add.reduceat(w, new)
            out[0] += [cols["doc_id"][a + d] for d in doc[new].tolist()]
            out[1] += start[new].tolist()
            out[2] += end[stop - 1].tolist()
            out[3] += [(*LANGS, OTHER)[x] for x in lang[new].tolist()]
            out[4] += conf.tolist()
        return dict(zip(SEGMENT.names, out, strict=True))

    d = docs.where(F.col(id_).isNotNull() & (F.length(text) > 0)).select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(d, fn, "doc_id bigint, start int, end int, lang string, confidence double", SEGMENT)


def shares(seg: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, confidence): characters of a document in each language."""
    n = F.col("end") - F.col("start")
    return seg.distinct().groupBy("doc_id", "lang").agg(F.sum(n).alias("n_chars"), (F.sum(n * F.col("confidence")) / F.sum(n)).alias("confidence"))


def found_segments(spark, sf_dir) -> DataFrame:
    return segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p9_found(spark, sf_dir):
    """Languages of at least LEAST characters of a document that its label doesn't mean."""
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), meaning("lang").alias("means")).distinct()
    s = shares(found_segments(spark, sf_dir).where(F.col("confidence") >= SURE)).where(F.col("n_chars") >= LEAST)
    return s.join(labels, "doc_id").where(F.col("lang").isin(*LANGS) & (F.col("lang") != F.col("means"))).select("doc_id", "lang").distinct()


def p9_documents(spark, sf_dir):
    """Each document's language with its confidence and the meaning of its label ('' none, '?' another language)."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), meaning("lang").alias("label")).distinct()
    best = shares(found_segments(spark, sf_dir)).groupBy("doc_id").agg(F.max(F.struct("n_chars", "lang", "confidence")).alias("m"), F.sum("n_chars").alias("all"))
    conf = F.coalesce(F.col("m.confidence") * F.col("m.n_chars") / F.col("all"), F.lit(0.0))
    return docs.join(best, "doc_id", "left").select("doc_id", "label", F.col("m.lang").alias("lang"), F.round(conf, 4).alias("confidence"))


def p9_segments(spark, sf_dir):
    """Segments in another language than the document's own."""
    s = found_segments(spark, sf_dir).distinct()
    main = shares(s).groupBy("doc_id").agg(F.max(F.struct("n_chars", "lang")).alias("m")).select("doc_id", F.col("m.lang").alias("main"))
    return s.join(main, "doc_id").where("lang != main").select("doc_id", "start", "end", "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments}
