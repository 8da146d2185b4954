import io
import zipfile

from quire.sources import archives


def package(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


RELS = b'<Relationships xmlns="r"><Relationship Type="http://x/officeDocument" Target="word/document.xml"/></Relationships>'
TYPES = b'<Types xmlns="t"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'


def test_office_kinds():
    assert archives.office_kind(package(**{"_rels__.rels": RELS, "[Content_Types].xml": TYPES, "word__document.xml": b"<d/>"})) == "docx"
    assert archives.office_kind(package(**{"_rels__.rels": RELS, "[Content_Types].xml": b"<Types/>"})) is None
    assert archives.office_kind(b"PK") is None and archives.office_kind(package(a=b"x")) is None


def test_listing():
    assert archives.listing(package(a=b"x", b__c=b"yy")) == ([("a", 1, 3), ("b/c", 2, 4)], None)
    assert archives.listing(package(**{"..__x": b""}))[1] == "unsafe path"
    assert archives.listing(package(a=b"", A=b""))[1] == "duplicate names"
    assert archives.listing(package(a=b"0" * 5_000_000))[1] == "expands too much"
    assert archives.listing(b"")[1] == "not an archive"


def test_xml():
    assert archives.events(b"<a><b x='1'/></a>") == [("a", {}), ("b", {"x": "1"})]
    for bad in (b"", b"<a>", b"<!DOCTYPE a><a/>", b"<a>" * 300 + b"</a>" * 300):
        assert archives.events(bad) is None


def test_csv_and_events(spark):
    assert archives.csv_markdown("\ufeffa,b\n1,x|y\n2".encode()) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n| 2 |  |"
    assert archives.csv_markdown(b"") is None and archives.csv_markdown(b"\xff\xfe") is None
    part = 'data: {"choices":[{"delta":{"content":"%s"}}]}\n\n'
    assert archives.streamed_text(part % "a" + part % "b" + "data: [DONE]\n\n") == "ab"
    assert archives.streamed_text(part % "a") is None and archives.streamed_text("data: x\ndata: [DONE]") is None
    files = spark.createDataFrame([("p", package(a=b"x")), ("q", b"bad")], "path string, content binary")
    assert sorted((r.path, r.name, r.fault) for r in archives.entries(files).collect()) == [("p", "a", None), ("q", None, "not an archive")]
    assert [r[0] for r in files.select(archives.office_kind_udf("content")).collect()] == [None, None]
