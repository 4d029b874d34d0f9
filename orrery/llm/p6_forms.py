"""One consistent form for texts that look the same.

A transducer over grapheme clusters is compiled once from rules over Unicode's own data and handed to the workers. A cluster is decomposed, its characters are mapped,
and it is composed again, so a composed and a decomposed spelling have one form: compatibility forms of width, ligature, radical and font become plain characters; all
kinds of space become the plain space; invisible characters vanish; letters of another script drawn like a Latin letter become Latin. Which letters those are is taken
from Unicode's confusables, as Spark's own Unicode library holds them, and from a short list that must hold whatever they say; confusables that cannot be read are an
error, as the short list alone would miss letters. Raised, lowered and circled characters, case, true accents and traditional characters stay, as they make another reading.

Compiling gives a table of all code points and a dictionary of the clusters that have a composed character; a cluster the dictionary lacks is made by the same rule and
kept. `check_conflicts` holds that each character's form is a fixed point and that no two spellings of a character have two forms. Texts run through the table in
one vectorised pass; only those with marks or expanding characters go cluster by cluster, longest match first.

Null texts have the null form and take part in no pair; empty texts have the empty form. All pairs of a reading's different stored
texts are written, however many records it has (see `all_pairs`); empty tables give an empty result.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import all_pairs, codes, digest, map_arrow, passes
from orrery.session import cut_lineage
from orrery.tables import table

# Letters of Greek and Cyrillic that are drawn like a Latin letter, and those letters.
LOOK_ALIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοАВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝ"
LATIN = "ABEZHIKMNOPTYXoABEKMHOPCTYXIJSaeopcyxijshdqw"
# Scripts whose letters are told apart from Latin ones by their names' first word, and format characters that are drawn, so they are not invisible.
OTHER_SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
DRAWN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
KEPT_TAGS = ("<super>", "<sub>", "<circle>")
EVERY = range(0x80, sys.maxunicode + 1)
#: A base with what belongs to it, or a run of conjoining letters; the longest match is one cluster.
CLUSTER = regex.compile(r"[\u1100-\u11FF\uA960-\uA97F\uD7B0-\uD7FF]+|[^\p{M}](?:[\p{M}\p{Cf}\u115F\u1160\u3164\uFFA0]+)|\p{M}+|[^\x00-\x7F]", regex.V1)
GONE, SLOW = 0xFFFFFFFF, 0xFFFFFFFE


def confusables(spark: SparkSession) -> dict[int, str]:
    """Letters of another script that Unicode's confusables take for one Latin letter of their case; an error where they cannot be read."""
    letters = [c for c in EVERY if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and unicodedata.name(chr(c), "").split(" ")[0] in OTHER_SCRIPTS and not unicodedata.decomposition(chr(c))]
    plain = [c for c in range(0x41, 0x7B) if chr(c).isalpha()]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        bones = checker.getSkeleton(0, "\n".join(chr(c) for c in plain + letters)).split("\n")
    except Exception as e:  # py4j has another type for each way of missing the library
        raise RuntimeError("Unicode's confusables cannot be read from Spark's own library (com.ibm.icu)") from e
    if len(bones) != len(plain) + len(letters):
        raise RuntimeError(f"Unicode's confusables: {len(bones)} skeletons of {len(plain) + len(letters)} letters")
    of: dict[str, list[int]] = {}
    for c, bone in zip(plain, bones, strict=False):
        of.setdefault(bone, []).append(c)
    out = {}
    for c, bone in zip(letters, bones[len(plain) :], strict=True):
        same = [x for x in of.get(bone, ()) if chr(x).isupper() == chr(c).isupper()]
        if len(same) == 1:
            out[c] = chr(same[0])
    if not out:
        raise RuntimeError(f"Unicode's confusables: none of {len(letters)} letters is drawn like a Latin one")
    return out


def letters_alike(more: dict[int, str] | None = None) -> dict[int, str]:
    return {**(more or {}), **dict(zip(map(ord, LOOK_ALIKE), LATIN, strict=True))}


def mapping(look: dict[int, str]) -> dict[int, str]:
    """Code point -> its form before composition, for all characters without a canonical decomposition that change."""
    out: dict[int, str] = {}
    for cp in EVERY:
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        how = unicodedata.decomposition(ch)
        if kind == "Zs":
            to = " "
        elif (kind == "Cf" and cp not in DRAWN_FORMAT) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            to = ""
        elif cp in look:
            to = look[cp]
        elif not how.startswith("<") or how.startswith(KEPT_TAGS):  # canonical ones are taken apart before
            continue
        else:
            to = unicodedata.normalize("NFKD", ch)
            if to[:1] == " " and len(to) > 1:  # a spacing accent has no plain form
                continue
            to = "".join(look.get(ord(x), x) for x in to)
        if to != ch:
            out[cp] = to
    for cp, to in out.items():  # a target may itself hold a mapped character
        out[cp] = "".join(out.get(ord(x), x) for x in to)
    return out


class Transducer:
    """The compiled mapping: `form` of one text, `forms` of many."""

    def __init__(self, look: dict[int, str] | None = None):
        self.mapping = mapping(letters_alike(look))
        self.table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        self.clusters: dict[str, str] = {}
        for cp in EVERY:
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind in ("Cn", "Co", "Cs") or 0xAC00 <= cp < 0xD7A4 and kind == "Lo":
                continue
            apart = unicodedata.decomposition(ch)
            if cp in self.mapping or apart and apart[0] != "<":
                to = self.rule(ch)
                self.table[cp] = GONE if not to else ord(to) if len(to) == 1 else SLOW
                if len(to) > 1:
                    self.clusters[ch] = to
                if apart and apart[0] != "<":
                    self.clusters[unicodedata.normalize("NFD", ch)] = to
            if kind[0] == "M" or 0x1100 <= cp < 0x1200 or 0xA960 <= cp < 0xA980 or 0xD7B0 <= cp < 0xD800:
                self.table[cp] = SLOW

    def rule(self, cluster: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", cluster).translate(self.mapping))

    def check_conflicts(self) -> None:
        """Raises where a form is not a fixed point, or two spellings of a character have two forms."""
        for cp in EVERY:
            ch = chr(cp)
            if unicodedata.category(ch) in ("Cn", "Co", "Cs"):
                continue
            to = self.form(ch)
            if self.form(to) != to:
                raise ValueError(f"U+{cp:04X} maps to {to!r}, which maps on to {self.form(to)!r}")
            apart = unicodedata.normalize("NFD", ch)
            if apart != ch and self.form(apart) != to:
                raise ValueError(f"U+{cp:04X} maps to {to!r}, its decomposition to {self.form(apart)!r}")

    def cluster(self, m) -> str:
        c = m.group()
        to = self.clusters.get(c)
        if to is None:
            to = self.rule(c)
            if len(self.clusters) < 200_000:
                self.clusters[c] = to
        return to

    def form(self, text: str) -> str:
        """The consistent form of one text, cluster by cluster."""
        s = CLUSTER.sub(self.cluster, text)
        return s if s == text or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)

    def forms(self, texts: list[str]) -> list[str]:
        """`form` of each text; texts without marks or expanding characters go through the table together."""
        out: list[str] = []
        for a, b in passes(texts):
            part = texts[a:b]
            c = codes("".join(part))
            mapped = self.table[c]
            ends = np.cumsum([len(x) for x in part])
            slow = np.zeros(len(part), dtype=bool)
            slow[np.searchsorted(ends, np.nonzero(mapped == SLOW)[0], side="right")] = True
            kept = mapped != GONE
            end = np.concatenate([[0], np.cumsum(kept)])[ends]
            mapped[mapped == SLOW] = 0x20
            whole = mapped[kept].tobytes().decode("utf-32-le", "surrogatepass")
            start = 0
            for x, is_slow, e in zip(part, slow.tolist(), end.tolist(), strict=True):
                out.append(self.form(x) if is_slow else whole[start:e])
                start = e
        return out


@functools.cache
def plain() -> Transducer:
    """The transducer of the short list alone."""
    return Transducer()


def compiled(spark: SparkSession):
    """The whole transducer as a broadcast of fixed size, compiled and checked once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_orrery_forms", None) is None:
        t = Transducer(confusables(spark))
        t.check_conflicts()
        sc._orrery_forms = sc.broadcast(t)
    return sc._orrery_forms


def with_forms(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """`df` with the consistent form of a text column."""
    t = compiled(df.sparkSession)
    fn = F.pandas_udf(lambda s: s.__class__([None if x is None else y for x, y in zip(s, t.value.forms([x or "" for x in s]), strict=True)], dtype=object), "string")
    return df.withColumn(out, fn(F.col(text)))


ARROW = pa.schema([("item_table", pa.string()), ("id", pa.string()), ("reading", pa.binary()), ("stored", pa.binary())])


def keys(items: DataFrame) -> DataFrame:
    """(item_table, id, reading, stored): 128-bit digests of the form and of the stored text."""

    t = compiled(items.sparkSession)

    def fn(cols):
        texts = cols["text"]
        done = t.value.forms(texts)
        raw = [digest(x) for x in texts]
        return {"item_table": cols["item_table"], "id": cols["id"], "reading": [r if f is x or f == x else digest(f) for x, f, r in zip(texts, done, raw, strict=True)], "stored": raw}

    return map_arrow(items.where("text is not null and id is not null").select("item_table", "id", "text"), fn, "item_table string, id string, reading binary, stored binary", ARROW)


def items(spark, sf_dir) -> DataFrame:
    def of(name, id_, text, least):
        return table(spark, sf_dir, name).where(F.length(text) >= least).select(F.lit(name).alias("item_table"), F.col(id_).alias("id"), F.col(text).alias("text"))

    return of("doc_blocks", "block_id", "text", 20).unionByName(of("doc_chunks", "chunk_id", "text", 20)).unionByName(of("fin_docs", "doc_id", "title", 1))


def p6_found(spark, sf_dir):
    """Pairs of one table's records that differ as stored and read the same."""
    k = cut_lineage(keys(items(spark, sf_dir)).distinct())  # read by three plans, made once
    return all_pairs(k, ["item_table", "reading"], "stored", "id").select("item_table", "id_a", "id_b").distinct()


def p6_forms(spark, sf_dir):
    """Every record's reading: records with the same `reading` read the same, those with the same `stored` are copies; `changed` tells those not stored in the form."""
    k = keys(items(spark, sf_dir)).distinct()
    return k.select("item_table", "id", F.hex("reading").alias("reading"), F.hex("stored").alias("stored"), (F.col("reading") != F.col("stored")).alias("changed"))


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms}
