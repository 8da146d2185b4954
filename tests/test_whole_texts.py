import pytest

from quire import plans

QUERIES = plans.queries()
LINE, TOKEN = "a line of text", "repeated"
CASES = [
    ("w6_repeated_lines_whole", "repeated", f"{LINE}\n" * 4, True),
    ("w6_repeated_tokens_whole", "repeated", f"{TOKEN} " * 6, True),
    ("f42_quality_failure_whole", "failure", "\x01", "control-character"),
    ("a19_document_quality", "out", "\x01", "garbled_markdown"),
    ("f42_quality_failure_whole", "failure", "�", "replacement-character"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sixteen documents, of every remainder of ids, for each case: the telling part comes after 400 characters."""
    at = str(tmp_path_factory.mktemp("whole"))
    start = "\n".join(f"word{i} other{i}" for i in range(40)) + "\n"
    rows = [(16 * k + i, start + end) for k, (_, _, end, _) in enumerate(CASES) for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("k", range(len(CASES)))
def test_the_end_of_every_document_is_seen(spark, folder, k):
    name, column, _, value = CASES[k]
    got = {r.doc_id: r[column] for r in QUERIES[name](spark, folder).collect()}
    assert [got[16 * k + i] for i in range(16)] == [value] * 16


def test_completions_are_whole(spark, folder):
    got = {r.doc_id: r.text for r in QUERIES["a23_completion_reader_whole"](spark, folder).collect()}
    assert len(got[1]) > 400


def test_every_query_over_cut_texts_has_one_over_whole_texts():
    names = [n for n in QUERIES if n.endswith("_whole")]
    assert {"w6_repeated_lines_whole", "f42_whole_text_period_whole", "a19_markdown_quality_whole", "f55_text_cleaner_whole", "a23_completion_reader_whole"} <= set(names)
    assert all(n.removesuffix("_whole") in QUERIES for n in names)
