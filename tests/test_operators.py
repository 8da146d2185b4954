"""Operators without an oracle, against plain versions or literal cases."""

import json
import os

import pytest
from pyspark.sql import functions as F
from support import DATA

from quire import sinks
from quire.operators import layout, pages, render, spatial
from quire.sources import derived, files


def test_layout_cases(spark):
    text = (
        "<|box_start|>100 200 50 300<|box_end|><|ref_start|>text<|ref_end|><|rotate_right|> a txt_contd_tgt <|box_start|>0 0 1000 10<|box_end|><|ref_start|>title<|ref_end|>"
        "<|box_start|>0 0 1000 1001<|box_end|><|ref_start|>table<|ref_end|><|box_start|>5 5 5 9<|box_end|><|ref_start|>table<|ref_end|><|box_start|>1 1 2 2<|box_end|><|ref_start|>unknown<|ref_end|>"
    )
    got = layout.parse(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "words")], "page int, layout string")).collect()
    assert [(r.page, r.kind, round(r.left, 3), round(r.right, 3), r.angle, r.merge_prev) for r in got] == [(1, "text", 0.05, 0.1, 90, True), (1, "title", 0.0, 1.0, None, False)]


def _parent(child, bodies, blocks):
    """The nearest body by the rules, straight from their text."""
    role = "caption" if child["kind"].endswith("_caption") else "footnote"
    box = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
    over = lambda a, b: a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]
    side = lambda b: "caption" if b["kind"].endswith("_caption") else "footnote" if b["kind"].endswith("_footnote") else ""
    found = []
    for p in bodies:
        if role == "footnote" and child["block_idx"] < p["block_idx"]:
            continue
        low, high = sorted((child["block_idx"], p["block_idx"]))
        between = [b for b in blocks if low < b["block_idx"] < high]
        c, q = box(child), box(p)
        gap = (c[3], q[1]) if c[3] <= q[1] else (q[3], c[1]) if q[3] <= c[1] else None
        free = lambda b: side(b) == "caption" or role == "footnote" and side(b) == "footnote" or gap is not None and not over(box(b), c) and not over(box(b), q) and (b["y0"] >= gap[1] or b["y1"] <= gap[0])  # noqa: E731, B023
        if all(free(b) for b in between):
            dx, dy = max(q[0] - c[2], c[0] - q[2], 0), max(q[1] - c[3], c[1] - q[3], 0)
            centre = ((c[0] + c[2] - q[0] - q[2]) ** 2 + (c[1] + c[3] - q[1] - q[3]) ** 2) ** 0.5
            found.append((high - low - sum(side(b) == role for b in between), (dx * dx + dy * dy) ** 0.5, centre, p))
    if not found:
        return None
    least = min(f[0] for f in found)
    close = [f for f in found if f[0] == least]
    far = [f[1] for f in close]
    if max(far) - min(far) > 2:
        return min(close, key=lambda f: (f[1], f[3]["block_idx"]))[3]["block_idx"]
    if role == "caption" and all(f[3]["kind"] == "table" for f in close):
        return max(f[3]["block_idx"] for f in close)
    if role == "footnote":
        return min(f[3]["block_idx"] for f in close)
    return min(close, key=lambda f: (f[2], f[3]["block_idx"]))[3]["block_idx"]


def test_visual_parents(spark):
    blocks = derived.load(spark, DATA, "blocks").cache()
    got = {(r.doc_id, r.page_idx, r.block_idx): r.parent_idx for r in spatial.visual_parents(blocks).collect()}
    by_page = {}
    for r in blocks.collect():
        by_page.setdefault((r.doc_id, r.page_idx), []).append(r.asDict())
    wanted = {}
    for (d, p), rows in by_page.items():
        bodies = [b for b in rows if b["kind"] in ("table", "image", "chart", "code")]
        for b in rows:
            if b["kind"] in ("image_caption", "table_caption", "image_footnote") and (parent := _parent(b, bodies, rows)) is not None:
                wanted[d, p, b["block_idx"]] = parent
    assert got == wanted and len(got) > 100


CAPTIONS = [
    # beside a caption and right above a body
    ([("caption", 0, 20, "a"), ("text", 10, 30, "b"), ("image_body", 32, 90, "")], ["caption", "caption", "image_body"]),
    ([("caption", 0, 10, "a"), ("text", 10, 30, "b"), ("image_body", 32, 90, "")], ["caption", "text", "image_body"]),
    # the first block says that the table continues
    ([("header", 0, 5, ""), ("text", 10, 20, "Results, CONTINUED"), ("table_body", 25, 90, "")], ["header", "caption", "table_body"]),
    ([("text", 0, 20, "continued"), ("table_body", 80, 90, "")], ["text", "table_body"]),
    ([("text", 0, 5, "x"), ("text", 10, 20, "continued"), ("table_body", 25, 90, "")], ["text", "text", "table_body"]),
    # one line above a caption of a table
    ([("text", 0, 20, "line"), ("caption", 15, 28, "Table 1"), ("table_body", 30, 90, "")], ["caption", "caption", "table_body"]),
    ([("text", 0, 20, "two\nlines"), ("caption", 15, 28, "Table 1"), ("table_body", 30, 90, "")], ["text", "caption", "table_body"]),
    ([("footnote", 0, 20, "line"), ("title", 15, 16, "far"), ("caption", 15, 28, ""), ("table_body", 30, 90, "")], ["footnote", "title", "caption", "table_body"]),
]


def test_caption_rules(spark):
    rows = [(d, 0, i, kind, 0, y0, 100, y1, text) for d, (page, _) in enumerate(CAPTIONS) for i, (kind, y0, y1, text) in enumerate(page)]
    got = pages.with_captions(spark.createDataFrame(rows, "doc_id long, page_idx int, block_idx int, kind string, x0 int, y0 int, x1 int, y1 int, content string")).collect()
    found = {(r.doc_id, r.block_idx): r.kind for r in got}
    assert [[found[d, i] for i in range(len(page))] for d, (page, _) in enumerate(CAPTIONS)] == [kinds for _, kinds in CAPTIONS]


def test_containers():
    gone, texts = pages.containers_resolved(["equation_block", "equation", "equation"], [(0, 0, 100, 100), (0, 0, 100, 40), (0, 50, 100, 90)], [None, "a", "b"])
    assert gone == [False, True, True] and texts[0] == "\\begin{array}{l} a \\\\ b \\end{array}"
    assert pages.containers_resolved(["list", "text"], [(0, 0, 9, 9), (0, 0, 9, 9)], [None, "x"])[0] == [True, False]
    assert pages.containers_resolved(["list", "text"], [(0, 0, 9, 9), (20, 0, 29, 9)], [None, "x"])[0] == [False, False]


def test_publish(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# one", "[]"), ("b", None, "[1]")], "stem string, markdown string, content_list string")
    for _ in range(2):  # the second time replaces the first
        assert sinks.publish(docs, str(tmp_path)) == 2
    assert (tmp_path / "a/vlm/a.md").read_text() == "# one" and json.loads((tmp_path / "b/vlm/b_content_list.json").read_text()) == [1]
    assert sorted(os.listdir(tmp_path / "a")) == ["vlm"]
    with pytest.raises(ValueError):
        sinks.publish(docs.union(docs), str(tmp_path))
    blocks = spark.createDataFrame([(1, p, b, k, 0, 0, 9, 9, c) for p, b, k, c in ((0, 0, "title", "T"), (0, 1, "header", "h"), (1, 0, "text", "words"))], "doc_id long, page_idx int, block_idx int, kind string, x0 int, y0 int, x1 int, y1 int, content string")
    whole = render.published(blocks).withColumn("stem", F.lit("d"))
    assert sinks.publish(whole, str(tmp_path)) == 1 and len(os.listdir(tmp_path / "d/vlm")) == 4
    v2, tree = (json.loads((tmp_path / f"d/vlm/d_{n}.json").read_text()) for n in ("content_list_v2", "middle"))
    assert [[b["type"] for b in page] for page in v2] == [["title", "page_header"], ["paragraph"]]
    assert [(p["page_idx"], len(p["para_blocks"]), len(p["discarded_blocks"])) for p in tree["pdf_info"]] == [(0, 1, 1), (1, 1, 0)]
    have = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page_idx int")
    want = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1)], "doc_id long, page_idx int")
    assert [r[0] for r in sinks.complete(have, want).collect()] == [1]


def test_files(spark, tmp_path):
    for name in ("b.PDF", "a.csv", "c.htm", "d"):
        (tmp_path / name).write_text("x" * 10)
    (tmp_path / "big.pdf").write_text("x" * 100)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.pdf").write_text("x")
    inputs, skipped = files.discover(spark, str(tmp_path), most_bytes=50)
    names = lambda f: [r.path.rsplit("/", 1)[1] for r in f.collect()]
    assert names(inputs) == ["a.csv", "b.PDF"] and names(skipped) == ["big.pdf", "c.htm", "d"]

    def render(content):
        if content.startswith(b"x" * 50):
            raise ValueError("too big")
        yield 10, 20, content

    rows = files.rendered(files.contents(spark, str(tmp_path)), render).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.page_idx, r.error) for r in rows) == [("a.csv", 0, None), ("b.PDF", 0, None), ("big.pdf", None, "ValueError: too big")]


def test_model_endpoint(spark):
    import urllib.error

    tries = []

    def send(body):
        tries.append(body)
        if len(tries) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", None, None)
        return {"ok": body["model"]}

    assert files.ChatModel("http://x", "m", factor=0.0, send=send)({"a": 1}) == {"ok": "m"} and len(tries) == 3
    requests = spark.range(5).select("id", F.to_json(F.struct("id")).alias("body"))
    got = files.predicted(requests, ["id"], "body", lambda: lambda b: {"twice": 2 * b["id"]})
    assert {r.id: json.loads(r.reply)["twice"] for r in got.collect()} == {i: 2 * i for i in range(5)}


@pytest.mark.parametrize("text", ["", "x"])
def test_document_markdown(spark, text):
    page = "<|box_start|>0 0 500 100<|box_end|><|ref_start|>title<|ref_end|>" + text + "<|box_start|>0 100 900 900<|box_end|><|ref_start|>table<|ref_end|><|box_start|>10 200 800 300<|box_end|><|ref_start|>text<|ref_end|>"
    got = pages.document_markdown(spark.createDataFrame([(1, 0, page), (1, 1, page)], "doc_id long, page_idx int, layout string")).collect()
    assert [r.markdown for r in got] == ["# block 0\n\ntable 1\n\n# block 0\n\ntable 1"]


def _stand_in():
    """A stand-in model: a layout for the page's name, and replies that are bad until the temperature has gone up."""

    def answer(body):
        image, prompt = body["messages"][0]["content"][0]["image_url"]["url"], body["messages"][0]["content"][1]["text"]
        box = lambda a, kind: f"<|box_start|>{a} {a} {a + 200} {a + 200}<|box_end|><|ref_start|>{kind}<|ref_end|>\n"
        if "Layout" in prompt:
            said = {"p0": box(0, "title") + box(300, "table") + box(350, "text") + box(600, "list_item"), "p1": "", "p2": box(0, "text") * 3}[image]
        elif "Table" in prompt:
            said = "<fcel>a<fcel>b<nl>"
        else:
            said = "" if image.startswith("p2") and body["temperature"] < 0.4 else f"- {image}<|im_end|>"
        return {"choices": [{"message": {"content": said}, "finish_reason": "stop"}]}

    return answer


def test_pages_in_two_steps(spark, tmp_path):
    from quire.operators import recognition

    answer = _stand_in()
    model = lambda: answer  # noqa: E731  a closure goes to the workers by value
    rows = spark.createDataFrame([(1, i, f"p{i}") for i in range(3)], "doc_id long, page_idx int, image string")
    blocks, warnings = recognition.two_step(rows, model, str(tmp_path / "a"), most_requests=2)
    got = {(r.page_idx, r.block_idx): (r.kind, r.content) for r in blocks.collect()}
    assert got == {
        (0, 0): ("title", "- p0#0,0,200,200"), (0, 1): ("table", "<table><tr><td>a</td><td>b</td></tr></table>"), (0, 2): ("text", None), (0, 3): ("text", None),
        (2, 0): ("text", "- p2#0,0,200,200"), (2, 1): ("text", "- p2#0,0,200,200"), (2, 2): ("text", None),
    }
    told = sorted((r.page_idx, r.warning) for r in warnings.collect())
    assert told == [(0, "semantic requests exceed the per-page cap of 2")] + sorted([(2, "semantic requests exceed the per-page cap of 2")] + [(2, f"content: temperature retry: temperature={t} quality=blank") for t in ("0.2", "0.4")] * 2)
    blocks, _ = recognition.two_step(rows, model, str(tmp_path / "b"), most_blocks=3, tables_on=False)
    assert {r.page_idx for r in blocks.collect()} == {2}


def test_retries_of_a_reply():
    from quire.operators import recognition

    seen = []

    def ask(body):
        seen.append((body["temperature"], body.get("top_k"), body.get("top_p")))
        return {"choices": [{"message": {"content": "same words " * 40}, "finish_reason": "length"}]}

    got = recognition.Careful(ask)({"temperature": 0.5, "top_k": 1, "top_p": 0.01})
    assert seen == [(0.5, 1, 0.01), (0.7, 40, 0.9), (0.9, 40, 0.9), (1.0, 40, 0.9)] and len(got["warnings"]) == 3
    assert recognition.failure("", "layout") is None and recognition.failure("a\x01") == "control-character" and recognition.failure("fine") is None
    assert recognition.Careful(lambda b: {"error": {"message": "x"}})({})["warnings"] == ["content: error object: x"]


def test_joined_cells():
    from quire.functions import tables

    flat = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    head = ("h", "i")
    assert tables.merge(flat(head, ("a", "b")), flat(head, ("c", "d"), ("e", "f")), 10, 10, [1, 0]) == flat(head, ("ac", "b"), ("", "d"), ("e", "f"))
    assert tables.merge(flat(head, ("a", "b")), flat(head, ("c", "d"), ("e", "f")), 10, 10, [True, 1]) == flat(head, ("ac", "bd"), ("e", "f"))
    # A lower row that goes leaves its empty cell, which reaches below, to the next one.
    tall = '<table><tr><td>h</td><td>i</td></tr><tr><td>c</td><td rowspan="2"></td></tr><tr><td>e</td></tr></table>'
    assert tables.merge(flat(head, ("a", "b")), tall, 10, 10, [1, 0]) == flat(head, ("ac", "b"), ("e", ""))


def test_paragraphs(spark):
    def text(lines, kind="text", item=False, **more):
        frame = spark.createDataFrame([([[{"type": t, "content": c} for t, c in line] for line in lines], kind, item)], "lines array<array<struct<type:string,content:string>>>, kind string, item boolean")
        return frame.select(render.paragraph_text(F.col("lines"), F.col("kind"), F.col("item"), **more)).first()[0]

    t, m, d = "text", "inline_equation", "interline_equation"
    assert text([[(t, "one inter-")], [(t, "national")], [(t, "law")]]) == "one international law"
    assert text([[(t, "one inter-")], [(t, "National")]]) == "one inter-National"
    assert text([[(t, "a "), (m, "x"), (t, " b")], [(t, "  ")]]) == "a $x$ b"
    assert text([[(t, "中文")], [(t, "继续"), (m, "x")], [(t, "完")]]) == "中文继续 $x$ 完"
    assert text([[(t, "- item")]]) == "\\- item" and text([[(t, "- item")]], item=True) == "- item"
    assert text([[(t, "a*b")]]) == "a\\*b" and text([[(t, "a*b")]], kind="code_body") == "a*b"
    assert text([[(t, "see"), (d, "y")]]) == "see$$\ny\n$$" and text([[(t, "see"), (d, "y")]], formulas=False) == "see"
    assert text([]) == ""
