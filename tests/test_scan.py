import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scriptoria.operators.report import parse_report, read_report, report_blocks, write_report
from scriptoria.operators.term_scan import page_rows, paged, term_scan
from scriptoria.plans.jobs import scan_tree
from scriptoria.sources.documents import extract_pages, list_documents

SCHEMA = "path string, pages array<string>"


def brute(pages, terms, cap):
    return [(i, t, *next(((k + 1, " ".join(p.split(" "))) for k, p in enumerate(pages[:cap]) if t in p), (None, None))) for i, t in enumerate(terms)]


def scanned(spark, docs, terms, **how):
    return [(r.path, r.term_ord, r.term, r.page_no, r.snippet) for r in term_scan(spark.createDataFrame(docs, SCHEMA), "path", terms, **how).orderBy("path", "term_ord").collect()]


def test_cap_is_24_pages(spark):
    docs = [("a", ["x"] * 23 + ["hit"]), ("b", ["x"] * 24 + ["hit"])]
    assert [(r[0], r[3]) for r in scanned(spark, docs, ["hit"])] == [("a", 24), ("b", None)]
    assert [r[3] for r in scanned(spark, docs, ["hit"], cap=None)] == [24, 25]


def test_terms_are_literal_keep_order_and_repeat(spark):
    got = scanned(spark, [("a", ["what??", "a.b [x"])], ["??", "a.b", "??", "[x", "A.B", "a+b"])
    assert [r[3] for r in got] == [1, 2, 1, 2, None, None]
    assert scanned(spark, [("a", ["x A.B y"])], ["a.b"], case_sensitive=False, snippet="match")[0][4] == "A.B y"


def test_nulls_empty_and_one_line(spark):
    got = scanned(spark, [("a", [None, "", "t\n\n  u"]), ("b", []), ("c", [""])], ["t", "u"])
    assert [r[3:] for r in got] == [(3, "t u"), (3, "t u"), (None, None), (None, None), (None, None), (None, None)]
    docs = spark.createDataFrame([("a", None)], "path string, text string")
    assert page_rows(paged(docs), "path").count() == 0


def test_unknown_snippet(spark):
    with pytest.raises(ValueError):
        term_scan(spark.createDataFrame([], SCHEMA), "path", [], snippet="none")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab ", max_size=5), max_size=5), min_size=1, max_size=4), st.lists(st.text("ab?", min_size=1, max_size=2), min_size=1, max_size=3))
def test_scan_equals_a_loop(spark, docs, terms):
    got = scanned(spark, [(str(i), p) for i, p in enumerate(docs)], terms, cap=3)
    assert [(r[1], r[2], r[3]) for r in got] == [x[:3] for p in docs for x in brute(p, terms, 3)]


def test_report_round_trip_and_grammar(spark, tmp_path):
    pages = spark.createDataFrame([("一.pdf", ["x", "Abstract here"]), ("王\\b.pdf", ["x"])], SCHEMA)
    scan = term_scan(pages, "path", ["??", "Abstract", "??"])
    assert report_blocks(scan, "path").orderBy("path").first().block.split("\n") == ["=== 一.pdf ===", "pages 2", "[??] not found in first24", "[Abstract] page 2: Abstract here", "[??] not found in first24", ""]
    write_report(scan, "path", str(tmp_path / "report"))
    back = parse_report(read_report(spark, str(tmp_path / "report")))
    assert sorted(map(str, back.collect())) == sorted(map(str, scan.collect()))


def test_scan_of_a_tree(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a 1.txt").write_text("first\fsecond term")
    (tmp_path / "docs/sub/b.txt").write_text("none")
    got = scan_tree(spark, str(tmp_path / "docs"), ["term"], str(tmp_path / "out"))
    assert [(r.path, r.pages, r.page_no) for r in got.orderBy("path").collect()] == [("a 1.txt", 2, 2), ("sub/b.txt", 1, None)]


def test_report_names_the_cap_and_keeps_its_lines(spark):
    pages = spark.createDataFrame([("a\nb", ["x"] * 9)], SCHEMA)
    for cap, label in ((5, "first5"), (None, "all")):
        blocks = report_blocks(term_scan(pages, "path", ["t\nu"], cap=cap), "path")
        assert blocks.first().block == f"=== a b ===\npages 9\n[t u] not found in {label}\n"
        assert [tuple(r) for r in parse_report(blocks).collect()] == [("a b", 9, 0, "t u", None, None)]


def test_report_without_terms(spark):
    blocks = report_blocks(term_scan(spark.createDataFrame([("a", ["x", "y"])], SCHEMA), "path", []), "path")
    assert blocks.first().block == "=== a ===\npages 2\n"
    assert [tuple(r) for r in parse_report(blocks).collect()] == [("a", 2, None, None, None, None)]


def test_a_broken_file_does_not_end_the_job(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.txt").write_text("one\ftwo")
    (tmp_path / "sub/bad.txt").write_bytes(b"\xff")
    got = extract_pages(spark, str(tmp_path), lambda content: content.decode().split("\f")).orderBy("path").collect()
    assert [(r.path, r.pages, r.error and r.error.split(":")[0]) for r in got] == [("good.txt", ["one", "two"], None), ("sub/bad.txt", [], "UnicodeDecodeError")]
    assert [tuple(r) for r in list_documents(spark, str(tmp_path)).orderBy("path").collect()] == [("good.txt", 7), ("sub/bad.txt", 1)]
