"""Documents read in strips and tables as grids: levels, seams, headers, numbers, audits, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import grids as g
from orrery.operators import headings as h
from orrery.operators import seams as m
from orrery.operators import tables as t
from orrery.sources import files


@pytest.mark.parametrize(
    ("text", "want"),
    [("第十二条 x", ("art", (12,))), ("第一章", ("chap", (1,))), ("三、x", ("cndun", (3,))), ("（四）x", ("cnpar", (4,))), ("四) x", ("cnpar", (4,))), ("(5) x", ("numpar", (5,))), ("１．２ x", ("dec", (1, 2))), ("7 x", ("int", (7,))), ("③ x", ("circ", (3,))), ("零、x", ("title", ())), ("百零二、x", ("cndun", (102,))), ("", ("title", ())), (None, ("title", ()))],
)
def test_marker(text, want):
    assert tuple(h.marker(text)) == want


def test_levels():
    def of(*lines, top=None):
        return h.levels([(raw, s, strip) for raw, s, strip in lines], top)

    # a series read at another level in a later strip goes on where it was
    assert of((1, "某保险条款", 0), (2, "1 总则", 0), (3, "1.1 范围", 0), (2, "1.2 定义", 1), (1, "2 责任", 1), (2, "2.1 给付", 2)) == [1, 1, 2, 2, 1, 2]
    assert of((1, "某保险条款", 0), (2, "1 总则", 0), (2, "第一条 范围", 0), (2, "一、甲", 0), (2, "（一）乙", 0), (2, "（二）丙", 1), (2, "二、丁", 1), (2, "第二条 费用", 2)) == [1, 1, 2, 3, 4, 4, 3, 2]
    # a contents list has numbers of its own
    assert of((1, "目录", 0), (2, "1 总则", 0), (2, "1.1 范围", 0), (2, "2 责任", 0), (2, "1 总则", 1), (2, "2 责任", 1)) == [1, 2, 3, 2, 1, 1]
    # unnumbered ones keep their distance to the one before in the same strip only
    assert of((1, "某条款", 0), (2, "1 总则", 0), (3, "说明", 0), (4, "说明", 1)) == [1, 1, 2, 1]
    assert of((2, "(四十八) 病", 0), top=None) == [2] and of() == [] and of((6, "1.2.3.4.5.6.7 x", 0)) == [6] and h.anchor("8.1.1 x") == 3


def test_titles_and_lines():
    assert h.promote_title("某保险公司\n\n医疗保险条款\n1 总则\n# x") == "# 某保险公司 医疗保险条款\n\n1 总则\n# x"
    assert h.promote_title("注册号 AB12345678\n# x") == "注册号 AB12345678\n# x" and h.promote_title("这是一句话。") == "这是一句话。"
    assert h.join_wrapped_title("# 某公司\n附加医疗保险\n（互联网）条款\n\n1 总则") == "# 某公司 附加医疗保险 （互联网）条款\n\n1 总则" and h.join_wrapped_title("# (三) x\ny") == "# (三) x\ny"
    assert h.demote_sentences("# 下列情形：\n# 甲；\n## 乙\n# 1 丙：") == "下列情形：\n# 甲；\n## 乙\n# 1 丙："
    assert h.contents_to_headings("# 目录\n* 1 总则\n- 1.1 范围\n正文\n* 2 x") == "# 目录\n# 1 总则\n# 1.1 范围\n正文\n* 2 x"
    assert h.demote_strays("1、a\n2、b\n# 3、c") == "1、a\n2、b\n3、c" and h.demote_strays("1、a\n2、b\n# 3、c\n# 4、d") == "1、a\n2、b\n# 3、c\n# 4、d"
    lines = [f"## ({i}) x" for i in (1, 2, 3)] + [f"## 9.{i} y" for i in (1, 2, 3)]
    assert h.part_formats("\n".join(lines)) == "\n".join(["#" + x for x in lines[:3]] + lines[3:])
    for fn in (h.promote_title, h.join_wrapped_title, h.demote_sentences, h.contents_to_headings, h.demote_strays, h.part_formats):
        assert fn("") == "" and fn("\n\n") == "\n\n" and fn("plain。") == "plain。"


def test_relevel_documents(spark):
    strips = [("d", 1, "某保险条款\n# 1 总则\n### 1.1 范围\ntext"), ("d", 2, "# 1.2 定义\n## 2 责任"), ("e", 1, None), ("e", 2, "no heading"), ("f", 5, "## (四十八) 甲\n### (四十九) 乙")]
    df = spark.createDataFrame(strips, "doc_id string, pos int, text string").withColumn("level", F.lit(9))
    got = {(r["doc_id"], r["pos"]): r["text"] for r in h.relevel(df).collect()}
    assert got == {("d", 1): "# 某保险条款\n# 1 总则\n## 1.1 范围\ntext", ("d", 2): "## 1.2 定义\n# 2 责任", ("e", 1): "", ("e", 2): "# no heading", ("f", 5): "## (四十八) 甲\n### (四十九) 乙"}
    assert h.relevel(df.limit(0)).count() == 0
    heads = h.heading_lines(df).select("doc_id", F.col("pos").alias("place"), F.col("raw").alias("level"), "text")
    s = {r["doc_id"]: r for r in h.heading_stats(heads, heads.where("text != '2 责任'")).collect()}
    assert s["d"]["level_accuracy"] == 0.75 and s["d"]["recall"] == 1.0 and s["f"]["level_accuracy"] == 1.0


def test_seams():
    top, rest = "<table><tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>", "<table>\n<tr><td>1</td><td>2</td></tr>\n<tr><td>3</td><td>4</td></tr></table>\nend。"
    assert m.merged([top, rest]) == "<table><tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>\n<tr><td>3</td><td>4</td></tr></table>\nend。"
    assert m.merged([top, "stray head\n" + rest]).count("<table>") == 1 and "<tr><td>stray head</td></tr>" in m.merged([top, "stray head\n" + rest])
    assert m.merged([top, "# Head\n" + rest]).count("<table>") == 2 and m.merged([top, "one\ntwo\nthree\n" + rest]).count("<table>") == 2
    cell = m.merged(["<table><tbody><tr><td>x</td><td>y</td></tr></tbody></table>\n基本部分、", "<table><tbody><tr><td>z</td><td>可选</td></tr></table>"])
    assert cell == "<table><tbody><tr><td>x</td><td>y</td></tr>\n<tr><td>z</td><td>基本部分、可选</td></tr></tbody></table>"
    assert m.merged(["这一句", "没有完"]) == "这一句没有完" and m.merged(["说完。", "下句"]) == "说完。\n下句" and m.merged(["甲", "1. 乙"]) == "甲\n1. 乙" and m.merged([None, "", "\n"]) == "" and m.merged([]) == ""


def test_merge_strips(spark):
    df = spark.createDataFrame([("d", 2, "没有完"), ("d", 1, "这一句"), ("e", 1, None), (None, 1, "x")], "doc_id string, pos int, text string").withColumn("n_strips", F.lit(0))
    assert sorted(map(tuple, m.merge_strips(df).collect())) == [("d", "这一句没有完", 2), ("e", "", 1)] and m.merge_strips(df.limit(0)).count() == 0


def test_reading_grids():
    x = 'cap <b>one</b><br>two<table><tr><td>a<td colspan="2">b</tr><tr><td rowspan=2>c</td><td>d</td><td>e</td></tr></table>tail<table><tr><td>x'
    assert g.segments(x) == [("cap one\n\ntwo", [["a", "b"], ["c", "d", "e"]]), ("tail", [["x"]])] and g.dimensions(x.split("tail")[0]) == (2, 3)
    assert g.segments("70\n71") == [("", [["70"], ["71"]])] and g.segments("one") == [] and g.segments(None) == [] and g.first_grid("") == []
    rnd = random.Random(1)
    for _ in range(20):
        grid = [[rnd.choice(["a", "1", "", "x y"]) for _ in range(4)] for _ in range(rnd.randint(1, 5))]
        assert g.read_grid(g.write_html(grid)) == grid


def test_headers_and_numbers():
    numbers = [str(i) for i in range(1, 10)]
    grid = [["Title"] + [""] * 10, ["age", "", "year"] + [""] * 8, ["age", "sex", *numbers], ["30", "m", *["1.5"] * 9]]
    out = g.rebuild_header(grid)
    assert out[0] == ["Title"] + [g.SPAN] * 10 and out[1] == ["age", "sex", "year"] + [g.SPAN] * 8 and out[2][:2] == [g.BELOW, g.BELOW] and out[3] == grid[3]
    assert '<td colspan="9">year</td>' in g.write_html(out) and '<td rowspan="2">age</td>' in g.write_html(out) and '<td colspan="11">Title</td>' in g.write_html(out)
    assert g.rebuild_header([["year", "", "", "", "", ""], ["age", *numbers[:5]]]) == [["age\\year", *numbers[:5]]] and g.rebuild_header([]) == [] and g.rebuild_header([["a", "", "b"], ["1", "2", "3"]])[0] == ["a", g.SPAN, "b"]
    two = g.header_spans([["n", "", "over", "", "", ""], ["", "1", "2", "3", "4", ""], ["a"] * 6])
    assert two[0] == ["n", "over", g.SPAN, g.SPAN, g.SPAN, ""] and two[1][0] == g.BELOW
    assert g.number_row(["x", *numbers]) == 1 and g.number_row(["1.5"] * 6) is None and g.axis_splits([["a"], [str(i) for i in range(12)], ["b"]], [(0, 3)]) == [1]
    holes = g.complete_numbers([["", "1", "2", "3", "4", "5", "6", "", "8", "9", "10", "11", "1.2", ""]])[0]
    assert holes == ["0", *map(str, range(1, 13)), ""] and g.complete_numbers([]) == []
    assert g.harmonised([["1,234.50"], ["2,345.60"], ["9,999.00"], ["123450"], ["x"]], [(3, 0), (4, 0)])[3:] == [["1,234.50"], ["x"]]


def test_assembling():
    tile = lambda r, c, v: "<table>" + "".join("<tr>" + f"<td>{v}</td>" * c + "</tr>" for _ in range(r)) + "</table>"
    cap, grid = g.assembled([["男性三年交费表" + tile(2, 2, "a"), tile(2, 3, "b")], [tile(1, 2, "c"), None], [tile(1, 90, "no"), tile(2, 3, "d")]], [100] * 3, [100, 100])
    assert cap == "男性三年交费表" and grid == [["a", "a", "b", "b", "b"]] * 2 + [["c", "c", "", "", ""]] + [["", "", "d", "d", "d"]] * 2
    left, right = [["男性"], ["", "18"], ["1", "2"]], [["19"], ["3"]]
    assert g.peel_top([left, right]) == "" and left == [["男性", "18"], ["1", "2"]]
    left = [["男性 3年交", ""], ["age", "18"], ["1", "2"]]
    assert g.peel_top([left, right]) == "男性 3年交" and len(left) == 2
    bands = [[[["x"] * (9 if r < 4 else 27)]] for r in range(8)]
    assert g.regime_cut(bands) == 4 and [len(r) for r in g.reassembled(bands)] == [9] * 4 + [27] * 4
    small, big = [["h"] * 10], [["v"] * 10 for _ in range(9)]
    assert g.merge_header_strips([("table", small), ("text", "mid"), ("table", big)]) == [("table", small + [["mid"] + [""] * 9] + big)]
    assert g.merge_header_strips([("rows", [["r"]]), ("table", big)])[0][1][0] == ["r"] + [""] * 9 and g.merge_header_strips([("rows", [["a", "b"]]), ("text", "x")]) == [("text", "a b"), ("text", "x")]


def test_audits(spark):
    cells = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "1,2"), ("a", 1, 0, "y"), ("b", 0, 0, ""), ("b", 0, 2, "z")], "table_id string, r int, c int, cell string")
    ink = spark.createDataFrame([("a", 0, 0, True), ("a", 0, 1, True), ("a", 1, 1, True), ("b", 0, 0, True), ("b", 1, 0, True)], "table_id string, r int, c int, ink boolean")
    cols = spark.createDataFrame([("a", 2), ("b", 2)], "table_id string, cols int")
    assert {r["table_id"]: (r["too_wide"], r["too_narrow"], r["reason"]) for r in t.strict_audit(cells, ink, cols).collect()} == {"a": (0, 1, "width"), "b": (1, 0, "rows+width")}
    other = cells.withColumn("cell", F.translate("cell", ",", "."))
    assert [tuple(r) for r in t.cell_agreement(cells, other).collect()] == [("a", 1, 1)]
    b = spark.createDataFrame([([0.0, 10.0, 12.0, 22.0], [9.0, 1.0, 9.0])], "b array<double>, i array<double>")
    assert b.select(t.narrow_columns(F.col("b"), F.col("i"))).first()[0] == [0.0, 10.0, 22.0]


def test_parsed_pages_and_csv(spark, tmp_path):
    d = tmp_path / "doc1"
    d.mkdir()
    (d / "manifest.json").write_text(json.dumps({"n_pages": 2, "title": "x"}))
    for n in (1, 2, 3):
        (d / f"p{n}.md").write_text(f"页 {n}", encoding="utf-8")
    assert sorted((r["page_no"], r["markdown"]) for r in files.parsed_pages(spark, str(tmp_path)).collect()) == [(1, "页 1"), (2, "页 2")]
    r = tmp_path / "rec"
    r.mkdir()
    (r / "train.csv").write_text('uid,item_seq_dedup,target_iid\nu1,"a, b,,c",d\nu2,,e\n')
    (r / "test.csv").write_text("uid,item_seq_dedup\nu3,x\n")
    (r / "user.csv").write_text("uid\nu1\n")
    (r / "item.csv").write_text("iid\na\n")
    got = files.recommendation(spark, str(r))
    assert {x["uid"]: x["seq"] for x in got["train"].collect()} == {"u1": ["a", "b", "c"], "u2": []} and got["item"].count() == 1
    (tmp_path / "x.html").write_text("<nav>menu</nav><main><p>body</p></main><footer>foot</footer>")
    assert [x["text"] for x in files.html_pages(spark, str(tmp_path / "x.html")).collect()] == ["body"]


def test_pixels(spark):
    from orrery.operators import pixels as p

    rules = [("a", y, x) for x in (3, 4, 20, 40) for y in range(5, 45)] + [("a", 10, 30), ("b", 1, 1)]
    d = spark.createDataFrame(rules, "img string, y int, x int")
    assert [tuple(r) for r in p.table_bands(d, 50, 20, 0.9, 10).collect()] == [("a", 5, 44, 3)] and p.table_bands(d.limit(0), 50).count() == 0
    assert {(r["img"], r["n"]) for r in p.rule_count(d.where("y = 10"), ["img"], "x").collect()} == {("a", 4)}
    assert {(r["img"], r["x"]) for r in p.text_ink(d, 50).collect()} == {("a", 30), ("b", 1)}
    broken = d.where("y not between 20 and 24")
    assert [tuple(r) for r in p.rule_breaks(broken, 50, 10).orderBy("y").collect()] == [("a", 20), ("a", 45)]
    ink = [1.0] * 100
    ink[38] = ink[61] = 0.0
    assert p.slice_cuts(ink, [], 40, 5, 10) == [0, 38, 73, 100] and p.slice_cuts(ink, [(30, 45)], 40, 5, 10)[1] < 30 and p.slice_cuts([1.0] * 5, []) == [0, 5]
    assert p.grouped_boundaries([0.0, 4.0, 9.0, 12.0, 50.0], 10, 5) == [0.0, 9.0, 12.0, 22.0, 32.0, 42.0, 50.0] and p.grouped_boundaries([0.0, 1.0, 2.0, 3.0], 10, 2) == [0.0, 2.0, 3.0] and p.grouped_boundaries([], 1, 1) == []
    assert p.isolated_ink([(0, 5), (1, 6), (5, 1), (5, 2), (5, 3)], 2, 10) == (2, 4) and p.isolated_ink([], 0, 1) == (0, 0)
    table = [(y, x) for y in range(0, 60) for x in range(0, 90)]
    box, text = p.split_blocks(table + [(95, x) for x in range(40, 50)], 100, 100)
    assert box == (0, 0, 90, 60) and text == [(40, 95, 50, 96)] and p.split_blocks([], 9, 9) == (None, [])
