"""Small cases of each operator: nulls, empty and long texts, repeats, ties, empty tables, extra columns, and brute-force or round-trip checks."""

import random
import unicodedata
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import common, p1_markup, p2_scans, p3_terms, p4_split, p5_neardup, p6_forms, p7_pack, p8_leaks, p9_language

TEXTS = [None, "", " ", "\n\n", "a", "x" * 5000, "\x00", "甲" * 3000 + "。", "\u200b\u200b", "<", "$", "\\", "|", "--", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- 1 markup ----


def pages(spark, texts, host="d"):
    data = [("doc_blocks", f"b{i}", host, t, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "item_table string, item_id string, host string, text string, kinds int")


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("<p>one</p>", {"html"}), ("&lt;b&gt;x&lt;/b&gt;", {"html"}), ("a &nbsp; b", {"html"}), ("<!-- note -->x", {"html"}), ("**bold** x", {"markdown"}), ("# Head\n\ntext", {"markdown"}), ("Head\n=====\ntext", {"markdown"}),
        ("see [a](#b)", {"markdown"}), ("~~no~~", {"markdown"}), ("> said\n> so", {"markdown"}), ("== Head ==\ntext", {"wiki"}), ("[[a|b]] c", {"wiki"}), ("{{note|x|1}}", {"wiki"}), ("'''b''' c", {"wiki"}), ("* [[x]] y", {"wiki"}),
        ("\\section{A}\nb", {"latex"}), ("$V_{t} = 1$", {"latex"}), ("5\\% of", {"latex"}), ("\\[ a \\]", {"latex"}), ("<b>\\textbf{x}</b>", {"html", "latex"}),
        ("Rates <5% and >2%", set()), ("Fees of $300 and $1,250", set()), ("note*: see [3] and plan #2", set()), ("A_B_C", set()), ("- 12 -", set()), ("A|B", set()), ("a ~ b", set()),
    ],
)
def test_markup_kinds(text, kinds):
    assert {k for _, _, k, _, _ in p1_markup.tokens(text, False)} == kinds


def test_markup_text_keeps_structure():
    s = "# Title\n\n<ul><li>one</li><li>two</li></ul>\n```\na < b ** 2\n```\n$x^{2}=1$ <table><tr><td>p</td><td>q</td></tr></table>"
    out = p1_markup.page_text(s)
    assert "Title" in out and "- one" in out and "a < b ** 2" in out and "x^{2}=1" in out and "| p | q |" in out and "<" not in out.replace("a < b", "")


def test_markup_edges_and_style_tree(spark):
    df = pages(spark, [*TEXTS, *[f"<div><nav>menu of the site</nav><p>text {i} of its own, {i * 7}</p></div>" for i in range(6)]])
    out = {r["item_id"]: r for r in p1_markup.clean(df.unionByName(df)).collect()}
    n = len(TEXTS)
    assert len(out) == n + 6 and out["b0"]["clean_text"] is None and out["b1"]["clean_text"] == ""
    assert "menu" not in out[f"b{n}"]["clean_text"] and "text 0 of its own" in out[f"b{n}"]["clean_text"]
    assert p1_markup.clean(df.limit(0)).count() == 0


def test_style_tree_removes_only_what_pages_repeat(spark):
    data = [f"<nav><a>Home page</a> <a>About us</a></nav><p>Unique body {i} zq{i}.</p><div class=foot{i}><p>All rights reserved</p><p>Contact</p></div><h2>Same head</h2><!-- page break -->end{i}" for i in range(6)]
    data += ["<nav><a>Home page</a> <a>Only here</a></nav><p>More.</p>", "<ul><li>x</li></ul>"]
    df = pages(spark, data)
    out = {r["item_id"]: (r["clean_text"], r["n_dropped"]) for r in p1_markup.clean(df.unionByName(df)).collect()}
    for i in range(6):
        text, n = out[f"b{i}"]
        assert n == 3 and f"Unique body {i} zq{i}." in text and f"end{i}" in text and "Same head" in text and "Home" not in text and "reserved" not in text and "break" not in text
    assert "Only here" in out["b6"][0] and "Home page" not in out["b6"][0]
    sites = spark.createDataFrame([(f"d{i}", "s") for i in range(6)], "doc string, site string")
    own = spark.createDataFrame([("doc_blocks", f"b{i}", f"d{i}", data[i]) for i in range(6)], "item_table string, item_id string, host string, text string")
    assert all(r["n_dropped"] == 0 for r in p1_markup.clean(own).collect()) and all(r["n_dropped"] == 3 for r in p1_markup.clean(own, sites).collect())


def test_markup_found_runs_the_style_tree(spark, monkeypatch):
    df = pages(spark, [None, "", "plain", "&lt;b&gt;x &amp; y", *[f"<div><nav>menu</nav><p>text {i}, \\textbf{{x}}</p></div>" for i in range(5)]])
    monkeypatch.setattr(p1_markup, "pages", lambda *_: df.unionByName(df))
    monkeypatch.setattr(p1_markup, "sites", lambda *_: None)
    found = p1_markup.p1_found(spark, "")
    assert rows(found) == sorted([("doc_blocks", "b3", "html"), *[("doc_blocks", f"b{i}", k) for i in range(4, 9) for k in ("html", "latex")]], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "klogk" in plan and "spread" in plan and "MapInArrow" in plan  # the trees merged by host, and the cleaning


# ---- 2 scans ----


@pytest.fixture(scope="module")
def channel():
    words = "the trustee must convene a meeting and publish a correction for the government office after the turnover of the reserve".split()
    text = "\n".join(" ".join(words) + " 发行人应当支付基金的现金" for _ in range(60)) + "\nthe cross-border offer" * 6
    t = [np.zeros(1 << p2_scans.TABLE_BITS, np.uint32) for _ in range(3)]
    import pyarrow as pa

    for b in p2_scans._count([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])]):
        import zlib

        for k, s, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            t[k][s << p2_scans.SLICE_BITS : (s + 1) << p2_scans.SLICE_BITS] = np.frombuffer(zlib.decompress(c), np.uint32)
    return p2_scans.Channel(t)


def test_channel(channel):
    assert channel.repair_line("the trustce must convcne a meeting") == "the trustee must convene a meeting"
    assert channel.repair_line("the govemment office") == "the government office"
    assert channel.repair_line("8o,049.78 and 2l June and 39,S63.54") == "80,049.78 and 21 June and 39,563.54"
    assert channel.repair_line("发行入应当支付基全的现金") == "发行人应当支付基金的现金"
    assert channel.repair_line("A16 and B2B and note6") == "A16 and B2B and note6"


def test_repair_kinds(channel):
    text, kinds = p2_scans.repair("- 7 -\nthe gov-\nernment office and the cross-\nborder offer\nPova Filings 7", 7, {p2_scans.py_folded("Pova Filings")}, channel, False)
    assert kinds == {"page_number", "hyphenation", "running_header"} and "government" in text and "cross-border" in text and "Filings" not in text
    assert p2_scans.repair("2031", 7, set(), channel, False)[1] == set()
    assert p2_scans.repair("", None, set(), channel, False) == ("", set())


def test_page_figures():
    yes = [("iv", 4), ("xii", 12), ("XL", 40), ("vii", None), ("lv", 4), ("- 7 -", 7), ("Page 7 of 20", None), ("- S -", 5), ("7", 7), ("第  3  页", 3)]
    no = [("iv", 5), ("mix", 9), ("ill", None), ("2031", 7), ("- S -", 6), ("a", None), ("", None), ("i i", 1)]
    assert all(p2_scans.is_page(*x) for x in yes) and not any(p2_scans.is_page(*x) for x in no)


def test_long_strips_and_lines(channel):
    strip = "Kova Filings of the supervisory board " * 8
    kinds = p2_scans.repair(f"text before\n{strip.strip()}\nand after", 1, {p2_scans.py_folded(strip)}, channel, False)[1]
    assert kinds == {"running_header"}


def test_model_of_many_tasks_and_full_tables(spark, monkeypatch):
    df = spark.createDataFrame([(f"the trustee must convene {i % 5} meetings 发行人应当",) for i in range(60)], "text string").repartition(7)
    whole = p2_scans.language_model(df)
    monkeypatch.setattr(p2_scans, "FAN_IN", 2)
    assert all(np.array_equal(a, b) for a, b in zip(whole, p2_scans.language_model(df), strict=True)) and whole[0].sum() == 60 * 5
    full = [x + np.uint32(1000) for x in whole]
    assert p2_scans.Channel(full).count("trustee") == 60 and p2_scans.Channel(full).count("trustce") == 0 and p2_scans.Channel(full).known > 5


def test_confusions_are_estimated(spark, channel):
    class Model:
        value = [channel.words, channel.pairs, channel.han]

    df = spark.createDataFrame([("the trustce must convcne a meeting",)] * 30 + [(None,), ("",)], "text string")
    c = p2_scans.confusions(df, Model)
    assert c["c", "e"] > p2_scans.CONFUSE > c["o", "a"] and p2_scans.confusions(df.limit(0), Model) == {}
    assert p2_scans.Channel(Model.value, c).repair_line("the trustce") == "the trustee"


def test_scan_edges(spark):
    data = [("doc_blocks", f"b{i}", "d", None if i % 2 else i, "text", t) for i, t in enumerate(TEXTS)] + [("doc_blocks", f"h{i}", "d", i, "text", "KOVA Filings 12" if i == 1 else "Kova Filings 12") for i in range(3)]
    df = spark.createDataFrame(data, "item_table string, item_id string, doc_id string, page int, type string, text string")
    out = {r["item_id"]: r for r in p2_scans.repaired(df.unionByName(df), df.select("text")).collect()}
    assert len(out) == len(data) and out["b0"]["text"] is None and all("running_header" in out[f"h{i}"]["kinds"] for i in range(3))
    assert p2_scans.repaired(df.limit(0), df.limit(0).select("text")).count() == 0


# ---- 3 terms ----


def test_terms(spark):
    data = [(f"c{i}", f"d{i % 3}", t) for i, t in enumerate(TEXTS)] + [("k1", "d9", "《办法》 Mid-Term plan 12-3 x《a《b》"), ("k1", "d9", "《办法》 Mid-Term plan 12-3 x《a《b》"), ("k2", "d9", "mid-term Mid-term 《办法》"), ("k3", None, "lost")]
    df = spark.createDataFrame(data, "chunk_id string, doc_id string, text string").withColumn("term", F.lit(1))
    got = {(r["doc_id"], r["term"]): (r["tf"], r["n_chunks"]) for r in p3_terms.term_counts(df).collect()}
    assert got["d9", "mid-term"] == (3, 2) and got["d9", "办法"] == (2, 2) and got["d9", "b"] == (1, 1) and ("d9", "12-3") not in got and ("d9", "plan") in got
    s = {r["term"]: r["score"] for r in p3_terms.residual_idf(p3_terms.term_counts(df), 4).collect() if r["doc_id"] == "d9"}
    df_, cf, n = 1, 3, 4
    assert abs(s["mid-term"] - 3 * (-np.log2(df_ / n) + np.log2(1 - np.exp(-cf / n)))) < 1e-9
    assert p3_terms.term_counts(df.limit(0)).count() == 0


# ---- 4 split ----


def test_split_invariants():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["word ", "字", "，", "。", ". ", "\n", "3,141.5 ", "x" * rnd.randint(1, 80)]) for _ in range(rnd.randint(1, 300)))
        if len(text) <= 100:
            continue
        b = p4_split.boundaries(text)
        d = p4_split.valley_depths([text], [b])[0]
        out = p4_split.cut_points(b.tolist(), d.tolist(), text, 100, 10)
        assert "".join(text[s:e] for _, s, e, _ in out) == text and all(e - o <= 100 for o, _, e, _ in out)
        assert any(f for *_, f in out) == (np.diff(b).max() > 100)
        assert all(s - o >= min(10, s) for o, s, e, _ in out)
        for o, s_, e, _ in out[:-1]:
            if e not in set(b.tolist()):  # off the boundaries: none was in the room, and no word is cut that could be spared
                assert not any(s_ < x <= s_ + (100 if s_ == 0 else 90) for x in b.tolist())
                assert p4_split.between_words(text, e) or not any(p4_split.between_words(text, p) for p in range(s_ + 50, e))


def test_split_keeps_overlap_and_words():
    for text in (". ".join(["ab cd efg " * 38] * 4), "lorem ipsum dolor sit amet, consectetur " * 40):
        b = p4_split.boundaries(text)
        out = p4_split.cut_points(b.tolist(), p4_split.valley_depths([text], [b])[0].tolist(), text)
        assert all(s - o >= 40 and e - o <= 400 for o, s, e, _ in out[1:])
        assert all(p4_split.between_words(text, e) and (s - o == 400 - (e - s) or p4_split.between_words(text, o)) for o, s, e, _ in out)


def test_cohesion_in_blocks_equals_whole(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["word ", "字符。", ". ", "\n"]) for _ in range(n)) for n in (300, 5, 1, 700)]
    bounds = [p4_split.boundaries(t) for t in texts]
    whole = p4_split.valley_depths(texts, bounds)
    monkeypatch.setattr(p4_split, "BLOCK", 7)
    assert all(np.allclose(a, b) for a, b in zip(whole, p4_split.valley_depths(texts, bounds), strict=True))


def test_split_edges(spark):
    data = [("t", f"i{i}", "d", i, None if i % 2 else ["a"], t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(data, "item_table string, item_id string, doc_id string, seq int, section_path array<string>, text string").withColumn("piece", F.lit(0))
    out = p4_split.split_oversized(df).collect()
    assert {r["item_id"] for r in out} == {"i5", "i7"} and all(len(r["text"]) <= 400 for r in out) and all(r["forced"] for r in out if r["piece"] == 0)
    assert p4_split.split_oversized(df.limit(0)).count() == 0


# ---- 5 near duplicates ----


def jaccard(a, b):
    s = [frozenset("".join(t.split()).lower()[i : i + 5] for i in range(len("".join(t.split())) - 4)) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_close_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.int64).view(np.uint64)
    sk = base[rng.integers(0, 40, 500)] ^ (rng.integers(0, 1 << 63, (500, 2), dtype=np.int64).view(np.uint64) & rng.integers(0, 1 << 63, (500, 2), dtype=np.int64).view(np.uint64) & rng.integers(0, 1 << 63, (500, 2), dtype=np.int64).view(np.uint64))
    run = np.sort(rng.integers(0, 30, 500))
    i, j = p5_neardup.close_pairs(run, sk.view(np.int64))
    want = {(a, b) for a in range(500) for b in range(a + 1, 500) if run[a] == run[b] and int(np.bitwise_count(sk[a] ^ sk[b]).sum()) <= p5_neardup.RADIUS}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_neardup_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7)))
    data = []
    for g in range(12):
        w = [word() for _ in range(90)]
        for k in range(4):
            v = [word() if rnd.random() < 0.012 * k else x for x in w]
            data.append((f"g{g}-{k}", "text", " ".join(v)))
    data += [("dup", "text", data[0][2]), ("dup2", "clause", data[0][2]), ("other", "table_row", data[0][2]), ("blank", "text", " " * 400), ("blank2", "text", "\u3000" * 400)] + [(f"e{i}", "text", t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(data + data[:9], "chunk_id string, type string, text string").withColumn("rep", F.lit(1))
    links, members = p5_neardup.similar(df)
    rep = {r["chunk_id"]: r["rep"] for r in members.collect()}
    t = {i: x for i, k, x in data if k in ("text", "clause") and x and len(x) >= 300}
    ids = sorted({rep[i] for i in t})
    want = {(a, b) for a in ids for b in ids if a < b and len(t[a].split()) and len(t[b].split()) and jaccard(t[a], t[b]) >= 0.7}
    got = {tuple(sorted((r["rep_a"], r["rep_b"]))) for r in links.collect()}
    assert got == want and len(want) > 12 and rep["dup"] == rep["dup2"] == rep["g0-0"] == "dup"
    comp = {r["node"]: r["root"] for r in p5_neardup.components(links).collect()}
    assert all(comp[a] == comp[b] for a, b in want) and len({comp[a] for a, _ in want}) == len({frozenset(x for x in comp if comp[x] == comp[a]) for a, _ in want})
    monkeypatch.setattr(p5_neardup, "HOT", 4)  # hot buckets go through blocks and give the same
    again = {tuple(sorted((r["rep_a"], r["rep_b"]))) for r in p5_neardup.similar(df)[0].collect()}
    assert again == want
    monkeypatch.setattr(p5_neardup, "PROBE", 1)  # and so do buckets known to be large before they meet
    assert {tuple(sorted((r["rep_a"], r["rep_b"]))) for r in p5_neardup.similar(df)[0].collect()} == want


def test_hot_bucket_is_deferred_over_batch_borders():
    import pyarrow as pa

    n = [5, 12_000, 4]
    bucket = np.repeat(np.array([-7, 3, 9]), n)
    node = np.arange(len(bucket))
    sketch = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, (len(bucket), 2))
    sketch[:5], sketch[-4:] = 1, 2
    rows_ = pa.record_batch([pa.array(bucket), pa.array(node), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], names=["bucket", "node", "s1", "s2"])
    for size in (10_000, 9_000, 20_000):
        out = [r for b in p5_neardup._compare(True)(rows_.slice(a, size) for a in range(0, len(bucket), size)) for r in b.to_pylist()]
        assert sorted(r["a"] for r in out if r["b"] is None) == list(range(5, 12_005)) and {r["bucket"] for r in out if r["b"] is None} == {3}
        pairs = [(r["a"], r["b"]) for r in out if r["b"] is not None]
        assert sorted(pairs) == [(a, b) for lo, hi in ((0, 5), (12_005, 12_009)) for a in range(lo, hi) for b in range(a + 1, hi)]


def test_neardup_empty(spark):
    df = spark.createDataFrame([], "chunk_id string, type string, text string")
    links, members = p5_neardup.similar(df)
    assert links.count() == 0 and members.count() == 0 and p5_neardup.components(links).count() == 0


# ---- 6 forms ----


def test_forms():
    pairs = [("Ｒｅｐｏｒｔ", "Report"), ("Mare\u0301na", "Maréna"), ("an\u200cnu\u0430l", "annual"), ("a\u00a0b\u3000c", "a b c"), ("ﬁne", "fine"), ("⽇⼈", "日人"), ("，％", ",%"), ("\u00adx\ufeff", "x"), ("Ｍａｒｅ\u0301ｎａ", "Maréna")]
    t = p6_forms.plain()
    t.check_conflicts()  # all code points: fixed points, and composed as decomposed
    assert [t.form(a) for a, _ in pairs] == [t.form(b) for _, b in pairs]
    for x in ["Ёлка, й ї ў", "Άέ ὕ", "Việt Nam", "각", "क़"]:
        assert t.form(unicodedata.normalize("NFC", x)) == t.form(unicodedata.normalize("NFD", x))
    for a, b in [("2²", "22"), ("①", "1"), ("é", "e"), ("A", "a"), ("國", "国")]:
        assert t.form(a) != t.form(b)
    texts = [x for p in pairs for x in p] + [t for t in TEXTS if t is not None] + ["한글", "\u1112\u1161\u11ab"]
    assert t.forms(texts) == [t.form(x) for x in texts] and [t.form(x) for x in t.forms(texts)] == t.forms(texts)
    assert all(unicodedata.normalize("NFC", x) == x for x in t.forms(["e\u0301", "u\u0308", "o\u0302"]))


def test_confusables_of_other_scripts(spark):
    more = p6_forms.confusables(spark)
    t = p6_forms.compiled(spark).value
    assert len(more) > 60 and all(chr(k).isupper() == v.isupper() for k, v in more.items())
    for a, b in [("\u03bf", "o"), ("\u0555", "O"), ("\u04cf", "i"), ("\u13aa", "A"), ("\u03bd", "v"), ("a\U000e0101b", "ab"), ("\U000e0041x", "x")]:
        assert t.form(a) == t.form(b), (a, b)
    for a, b in [("l", "I"), ("1", "l"), ("O", "0"), ("я", "R"), ("漢", "汉")]:
        assert t.form(a) != t.form(b)


def test_confusables_that_cannot_be_read_are_an_error(spark, monkeypatch):
    jvm, sc = spark._jvm, spark.sparkContext
    data = [("t", "a", "\u13aannual report"), ("t", "b", "Annual report")]
    monkeypatch.setattr(p6_forms, "items", lambda *_: spark.createDataFrame(data, "item_table string, id string, text string"))
    monkeypatch.setattr(sc, "_orrery_forms", None, raising=False)

    class Jvm:
        def __init__(self, com):
            self.com = com

        def __getattr__(self, name):
            return getattr(jvm, name)

    def answering(skeleton):
        checker = SimpleNamespace(getSkeleton=lambda _, text: skeleton(text))
        return SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: SimpleNamespace(build=lambda: checker))))))

    # no library; a line lost; nothing mapped
    for com in (jvm.com.ibm, answering(lambda x: x.rpartition("\n")[0]), answering(lambda x: x)):
        with monkeypatch.context() as m:
            m.setattr(spark, "_jvm", Jvm(com))
            with pytest.raises(RuntimeError, match="confusables"):
                p6_forms.p6_found(spark, "")
        assert sc._orrery_forms is None
    assert rows(p6_forms.p6_found(spark, "")) == [("t", "a", "b")]


def test_pairs_of_composed_and_decomposed(spark, monkeypatch):
    text = "Ёжик в тумане идёт домой"
    data = [("t", "a", unicodedata.normalize("NFC", text)), ("t", "b", unicodedata.normalize("NFD", text)), ("t", "c", text.upper())]
    monkeypatch.setattr(p6_forms, "items", lambda *_: spark.createDataFrame(data, "item_table string, id string, text string"))
    assert rows(p6_forms.p6_found(spark, "")) == [("t", "a", "b")]


def test_form_pairs_and_hot_groups(spark, monkeypatch):
    data = [("t", f"i{k:03d}", "Report" if k % 3 else "Rep\u043ert") for k in range(12)] + [("t", "x", None), ("t", "y", ""), ("u", "z", "Ｒeport"), ("t", "i000", "Rep\u043ert")]
    df = spark.createDataFrame(data, "item_table string, id string, text string").withColumn("form", F.lit(0))
    k = p6_forms.keys(df).distinct()
    full = {(r["id_a"], r["id_b"]) for r in common.pairs_in_groups(k, ["item_table", "reading"], "stored", "id").collect()}
    assert full == {(f"i{a:03d}", f"i{b:03d}") for a in range(12) for b in range(a + 1, 12) if (a % 3 == 0) != (b % 3 == 0)}
    monkeypatch.setattr(common, "FULL_PAIRS", 4)
    star = {(r["id_a"], r["id_b"]) for r in common.pairs_in_groups(k, ["item_table", "reading"], "stored", "id").collect()}
    assert star <= full and {x for p in star for x in p} == {x for p in full for x in p} and len(star) == 11
    assert p6_forms.keys(df.limit(0)).count() == 0


def test_form_pairs_of_large_readings(spark, monkeypatch):
    stored = ["Report", "Rep\u043ert", "\uff32eport"]
    data = [("t", f"i{k:03d}", stored[min(k % 7, 2)]) for k in range(90)] + [("u", f"j{k}", "same") for k in range(80)] + [("u", "z", "Report"), ("t", "x", None)]
    monkeypatch.setattr(p6_forms, "items", lambda *_: spark.createDataFrame(data + data[:5], "item_table string, id string, text string"))
    want = {("t", f"i{a:03d}", f"i{b:03d}") for a in range(90) for b in range(a + 1, 90) if min(a % 7, 2) != min(b % 7, 2)}
    for copies, cell in ((256, 32), (4, 2)):  # one cell, and many
        monkeypatch.setattr(common, "COPIES", copies, raising=False)
        monkeypatch.setattr(common, "CELL", cell, raising=False)
        got = [tuple(r) for r in p6_forms.p6_found(spark, "").collect()]
        assert len(got) == len(want) and set(got) == want


# ---- 7 pack ----


def test_plan_invariants():
    rnd = random.Random(2)
    for _ in range(60):
        cap = rnd.choice([10, 100, 8192])
        counts = {s: rnd.randint(1, 30) for s in {rnd.randint(1, cap) for _ in range(rnd.randint(1, 40))}}
        if rnd.random() < 0.3:
            counts[max(1, cap // 7)] = 5000
        used, seen = {}, {}
        for size, r0, n, copies, b0, off in p7_pack.plan(counts, cap):
            assert seen.get(size, 0) == r0
            seen[size] = r0 + n * copies
            for b in range(b0, b0 + n):
                assert used.get(b, 0) == off
                used[b] = off + size * copies
        assert seen == counts and max(used.values()) <= cap
        total = sum(s * c for s, c in counts.items())
        assert len(used) <= 11 / 9 * -(-total // cap) + 2 or any(s > cap // 3 for s in counts)


def test_pack_edges(spark, monkeypatch):
    monkeypatch.setattr(p7_pack, "RANKED_AT_ONCE", 7)
    texts = [t for t in TEXTS if not t or "\ud83d" not in t] + ["y" * 20000, "z" * 8192] + ["same"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("bin", F.lit(1))
    out = p7_pack.pack(df, F.octet_length("text")).collect()
    size = {i: len(t.encode()) for i, t in enumerate(texts) if t}
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == size and {r["doc_id"] for r in out if r["divided"]} == {i for i, n in size.items() if n > 8192}
    at = sorted((r["bin"], r["offset"], r["n_tokens"]) for r in out)
    assert all(a[0] != b[0] or a[1] + a[2] <= b[1] for a, b in zip(at, at[1:], strict=False)) and all(o + n <= 8192 for _, o, n in at)
    assert p7_pack.pack(df.limit(0), F.octet_length("text")).count() == 0


# ---- 8 leaks ----


def test_tiles_and_leaks(spark):
    item = "Only Qufonu Water may waive the surrender value owed by Qubako Logistics, capped at 89,769.77 or 6.19% since 7 February 2028."
    half, cut = item[:60], len(item) // 2
    docs = [(1, "before " + item.upper() + " after"), (2, half + " zz"), (3, item[cut:] + " --- " + item[:cut]), (4, "nothing of it"), (5, None), (6, ""), (7, item[:20]), (1, "before " + item.upper() + " after"), (8, "w" * 200_000 + item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("qid", F.lit("x"))
    items = spark.createDataFrame([("q1", "passage", item), ("q1", "passage", item), ("q2", "question", None), ("q3", "question", "short")], "qid string, part string, text string")
    got = {r["doc_id"]: r for r in p8_leaks.leaks(d, items).distinct().collect()}
    assert set(got) == {1, 2, 3, 8} and got[1]["coverage"] == got[8]["coverage"] == 1.0 and got[3]["n_tiles"] == 2 and got[3]["coverage"] > 0.95 and got[2]["coverage"] < 0.6
    assert p8_leaks.leaks(d.limit(0), items).count() == 0 and p8_leaks.leaks(d, items.limit(0)).count() == 0


def test_shared_boilerplate_and_many_tiles(spark):
    same = "the reserve of the company falls short of the agreed value in this year and the next"
    items = spark.createDataFrame([(f"q{i}", "passage", f"{same} item {i} " + "xyz" * i) for i in range(200)], "qid string, part string, text string")
    docs = spark.createDataFrame([(1, f"before {same} after"), (2, same * 30)], "doc_id long, text string")
    got = p8_leaks.leaks(docs, items).where("longest >= 50").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 200, 2: 200}
    doc = "".join(random.Random(3).choice("abcd") for _ in range(3000))
    seeds = [(i, i) for i in range(0, 2971, 7)]
    assert p8_leaks.tiles(doc, doc, seeds) == [(0, 0, 3000)]


def test_rolling_hash_equals_itself():
    c = np.array([ord(x) for x in "abcdefgh" * 20], dtype=np.uint32)
    h = p8_leaks.rolling(c, 10)
    assert h[0] == h[8] == h[16] and h[0] != h[1] and len(h) == len(c) - 9


# ---- 9 languages ----

SAMPLES = [
    ("en", "The trustee must convene a meeting because the reserve of the company falls short of the agreed value in this year."), ("de", "Der Treuhänder muss eine Versammlung einberufen, weil die Rückstellung der Gesellschaft unter dem vereinbarten Wert liegt."),
    ("fr", "Le fiduciaire doit convoquer une assemblée parce que la réserve de la société est inférieure à la valeur convenue."), ("es", "El fiduciario debe convocar una reunión porque la reserva de la sociedad no alcanza el valor acordado en el año."),
    ("pt", "O agente fiduciário deve convocar uma reunião porque a reserva da sociedade não atinge o valor acordado neste ano."), ("zh", "受托管理人应当召开会议，因为公司的准备金低于约定的金额。"),
]


def test_forward_backward_equals_brute_force():
    rng = np.random.default_rng(0)
    e, a, s = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.ones((2, 4), bool)
    mask[1, 3] = False
    g = p9_language.forward_backward(e, a, s, mask)
    import itertools

    for n in range(2):
        t = int(mask[n].sum())
        want = np.zeros((t, 3))
        for path in itertools.product(range(3), repeat=t):
            p = np.exp(s[path[0]] + sum(e[n, i, path[i]] for i in range(t)) + sum(a[path[i], path[i + 1]] for i in range(t - 1)))
            for i in range(t):
                want[i, path[i]] += p
        assert np.allclose(g[n, :t], want / want.sum(1, keepdims=True))


def test_languages(spark):
    lang = dict(SAMPLES)
    docs = [(1, lang["de"] * 3, "de-AT"), (2, lang["en"] * 3, None), (3, lang["fr"] * 2 + "\n" + lang["zh"] * 6, "French"), (4, None, "en"), (5, "", "und"), (6, "12 34 --", "en"), (7, lang["es"] * 400, "ja"), (2, lang["en"] * 3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("start", F.lit(1))
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SAMPLES * 3)], "sample_id int, lang string, text string")
    seg = p9_language.segments(d, s)
    got = {}
    for r in p9_language.shares(seg).where("n_chars >= 100").collect():
        got.setdefault(r["doc_id"], set()).add(r["lang"])
    assert got == {1: {"de"}, 2: {"en"}, 3: {"fr", "zh"}, 7: {"es"}}
    for r in seg.where("doc_id = 3").groupBy("doc_id").agg(F.min("start").alias("a"), F.max("end").alias("b")).collect():
        assert r["a"] == 0 and r["b"] == len(docs[2][1])
    assert p9_language.segments(d.limit(0), s).count() == 0
    m = spark.createDataFrame([(x,) for x in ["zh-CN", "Chinese", "EN", "deu", "und", None, "", "ja", "pt_BR", "unknown"]], "lang string").select(p9_language.meaning("lang")).collect()
    assert [r[0] for r in m] == ["zh", "zh", "en", "de", "", "", "", "?", "pt", ""]


def test_other_scripts_marks_and_letters(spark):
    import pyarrow.parquet as pq

    rows_ = tuple(sorted({(r["lang"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/lang_samples.parquet").to_pylist()}))
    lab = p9_language.Labeller(p9_language.fitted(rows_))
    assert p9_language.fitted(rows_) is p9_language.fitted(rows_)

    def langs(text):
        _, a, b, lang, _ = lab.label([text])
        out = {}
        for x, y, k in zip(a.tolist(), b.tolist(), lang.tolist(), strict=True):
            name = (*p9_language.LANGS, p9_language.OTHER)[k]
            out[name] = out.get(name, 0) + y - x
        return out

    ru = "Доверительный управляющий обязан созвать собрание. " * 6
    got = langs(ru + "The trustee must convene a meeting of the holders this year.")
    assert got["other"] == len(ru) and got["en"] > 50
    assert set(langs("受託者は会議を招集しなければならない。これは日本語の文章です。")) == {"other"}
    assert set(langs("受托管理人应当召开会议，因为公司的准备金低于约定的金额。")) == {"zh"}
    assert p9_language.words("cœur Œuvre") == ["cœur", "Œuvre"] and p9_language.features("re\u0301serve") == p9_language.features("r\u00e9serve")
    k = p9_language.kinds(common.codes("annu\u0430l \u0430\u0431\u0432\u0433 e\u0301"))
    assert k.tolist() == [1] * 6 + [0] + [3] * 4 + [0, 1, 1]
    docs = spark.createDataFrame([(1, ru, None)], "doc_id long, text string, lang string")
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SAMPLES * 3)], "sample_id int, lang string, text string")
    assert {r["lang"] for r in p9_language.segments(docs, s).collect()} == {"other"}


def test_heldout_accuracy(spark):
    import pyarrow.parquet as pq

    rows_ = [(r["lang"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/lang_samples.parquet").to_pylist()]
    random.Random(1).shuffle(rows_)
    lab = p9_language.Labeller(p9_language.train(rows_[:240]))
    doc, _, _, got, _ = lab.label([t for _, t in rows_[240:]])
    want = np.array([p9_language.LANGS.index(rows_[240 + i][0]) for i in doc])
    assert (got == want).mean() > 0.98
