import pytest
from pyspark.sql import functions as F

from quire.functions import formulas, tables, text
from quire.operators import planning, render
from quire.streaming import tasks


def value(spark, f, s):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("plain", "plain"),
        ("<fcel>a<fcel>b<nl><fcel>c<ecel><nl>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table>"),
        ("<fcel>a<lcel><nl><fcel>b<fcel>c<nl>", '<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr></table>'),
        ("<fcel>a<fcel>b<nl><ucel><fcel>c<nl>", '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>'),
        ("<fcel>a<lcel><nl><ucel><xcel><nl>", '<table><tr><td colspan="2" rowspan="2">a</td></tr><tr></tr></table>'),
        ("<fcel>x & <b>\"<nl>", "<table><tr><td>x &amp; &lt;b>&quot;</td></tr></table>"),
    ],
)
def test_otsl(given, wanted):
    assert tables.otsl_html(given) == wanted


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_merge_drops_the_repeated_header():
    a, b = table("hk", "12"), table("hk", "34")
    assert tables.merge(a, b, 100, 105) == table("hk", "12", "34")
    assert tables.merge(a, b, 100, 110) is None  # too different in width
    assert tables.merge(a, "<table><tr><td>x</td></tr>", 100, 100) is None  # unbalanced


def test_merge_widens_the_narrower_table():
    a = table("hk", "12")
    b = '<table><tr><td>h</td><td>k</td></tr><tr><td colspan="2">3</td><td>4</td></tr></table>'
    assert tables.merge(a, b, 100, 100) is not None


def test_header_reaches_below():
    head = '<tr><td rowspan="2">a</td><td>b</td></tr><tr><td>{}</td></tr>'
    a = tables.Grid(tables.parse("<table>" + head.format("c") + "<tr><td>1</td><td>2</td></tr></table>"))
    b = tables.Grid(tables.parse("<table>" + head.format("d") + "<tr><td>3</td><td>4</td></tr></table>"))
    assert tables.header_rows(a, b) == 2


def test_bad_tables_are_refused():
    for bad in ("", "text", "<table><table></table></table>", '<table><tr><td colspan="0">x</td></tr></table>', "<table></table><table></table>"):
        assert tables.parse(bad) is None


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (formulas.balance_sides, r"\left( a \right) \right]", r"\left( a \right) \left.\right]"),
        (formulas.balance_sides, r"\left( a", r"\left( a\right."),
        (formulas.balance_sides, r"\begin{a} \left( x", r"\begin{a} \left( x"),
        (formulas.drop_unmatched_braces, r"{a} } \{ {", r"{a}  \{ "),
        (formulas.normalise, r"$$ \[ x} \] $$", "x"),
        (formulas.move_blanks, r"\(a ___ b\)", r"\(a\) ___ \(b\)"),
        (formulas.move_blanks, r"\(___ b\)", r"\(___ b\)"),
    ],
)
def test_formulas(f, given, wanted):
    assert f(given) == wanted


def test_period():
    assert formulas.period("abcdefgh" * 3) and formulas.period("abcdefgh" * 3 + "abc")
    assert not formulas.period("abcdefgh" * 2) and not formulas.period("abc" * 20 + "x" * 3) and not formulas.period("")


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.display_to_inline, r"a \[ x \] b", r"a \(x\) b"),
        (text.display_to_inline, r"a \[1, 2-3\] b", r"a \[1, 2-3\] b"),
        (text.display_to_inline, "a \\[ x \\] \\[ y \\]", "a \\[ x \\] \\[ y \\]"),
        (text.fix_macro_spacing, r"\( a\timesb \top \)", r"\( a\times b \top \)"),
        (text.escape_markdown, r"a*b \* \\_", r"a\*b \* \\\_"),
        (text.escape_marker, "  ## x", "  \\## x"),
        (text.escape_marker, "    - x", "    - x"),
        (text.wrap_formulas, r"\( x \) and \[y\]", "<eq>x</eq> and <eq>y</eq>"),
        (text.canonical_stem, "a/b. ", "a_b"),
        (text.canonical_stem, "CON.txt", None),
        (text.canonical_stem, "..", "document"),
        (text.redact, "Authorization: Bearer abc; x", "Authorization: [REDACTED]; x"),
        (lambda c: text.truncate_bytes(c, 5), "aéé€x", "aéé"),
        (text.is_continued, "Table 1 (continued)", True),
        (text.is_continued, "discontinued", False),
        (text.is_continued, "（续）", True),
    ],
)
def test_text(spark, f, given, wanted):
    assert value(spark, f, given) == wanted


def test_spans(spark):
    got = value(spark, render.spans, r"a \(x\) \[b\] c")
    assert [tuple(s) for s in got] == [("text", "a "), ("inline_equation", "x"), ("text", " [b] c")]


def test_unique_names(spark):
    long = "é" * 100
    cases = [["r", "R", "r_3", "r", "r_2_x", "R_2", "r", "r_2"], ["", "x", "X", "x"], [long, long + "y", long], ["n"] * 12 + ["n_11", "n_2"]]
    rows = [(b, i, s) for b, stems in enumerate(cases) for i, s in enumerate(stems)]
    got = {(r.b, r.i): r.s for r in planning.unique_names(spark.createDataFrame(rows, "b int, i int, s string"), "b", "i", "s").collect()}
    assert [got[0, i] for i in range(8)] == ["r", "R_4", "r_3", "r_5", "r_2_x", "R_2", "r_6", "r_2_2"]
    assert [got[1, i] for i in range(4)] == ["", "x", "X_2", "x_3"]
    assert [got[2, i] for i in range(3)] == [long, "é" * 99 + "_2", "é" * 99 + "_3"]
    assert [got[3, i] for i in range(14)] == ["n", *(f"n_{k}" for k in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14)), "n_11", "n_2"]


def test_bins():
    assert planning.pack_bins([10, 70, 30, 20, 40], 64) == [1, 0, 2, 2, 1]  # 70 alone; 40; 30 apart; 20 and 10 to the least loaded


def test_limits():
    with pytest.raises(ValueError):
        planning.Limits(max_output_bytes=3)


def test_stream_of_task_states(spark, tmp_path):
    """The streamed changes end in the states of the batch replay."""
    rows = [(1, 1, "2024-01-01 00:00:00", "pending"), (1, 2, "2024-01-01 00:01:00", "processing"), (1, 3, "2024-01-01 00:02:00", "completed"), (1, 4, "2024-01-01 00:03:00", "failed"), (2, 5, "2024-01-01 00:00:00", "pending")]
    events = spark.createDataFrame(rows, "task_id long, seq long, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = tasks.stream_states(stream).writeStream.format("memory").queryName("states").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.task_id, r.state) for r in spark.table("states").collect()}
    assert got == {(1, "pending"), (1, "processing"), (1, "completed"), (2, "pending")}
    assert {(r.task_id, r.state) for r in tasks.current(events).collect()} == {(1, "completed"), (2, "pending")}


@pytest.mark.parametrize("tag, n, wanted", [('<td colspan="2" a="b">', 1, '<td a="b">'), ("<td>", 3, '<td colspan="3">'), ('<td a="b" colspan="2">', 4, '<td a="b" colspan="4">')])
def test_spans_of_tags(spark, tag, n, wanted):
    assert value(spark, lambda c: text.with_span(c, "colspan", F.lit(n)), tag) == wanted


def test_images_held_in_html(spark):
    import hashlib

    good, vector, bad = "data:image/jpeg;base64,e%HV%h", "data:image/x-emf;base64,eHh4", "data:image/png;base64,e"
    html = f'<img src="{good}"/><img src="{good}"/><img src="{vector}"/><img src="{bad}"/><img src="a.png"/>'
    name = hashlib.sha256(good.encode()).hexdigest() + ".jpg"
    row = spark.range(1).select(text.inline_images(F.lit(html)).alias("i")).select("i", text.with_image_names(F.lit(html), F.col("i")).alias("h")).first()
    assert [(x.uri, x.name, bytes(x.data)) for x in row.i] == [(good, name, b"xua")]
    assert row.h == html.replace(good, name)
