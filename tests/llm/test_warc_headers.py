"""Records whose headers are longer than one read, and gaps in archives that must be whole."""

import pytest
from feltmill.llm import warc
from feltmill.llm.queries import QUERIES


@pytest.mark.parametrize("packed", [True, False])
def test_long_urls(spark, packed):
    urls = {1: "data:text/html," + "x" * 100_000, 2: "http://short", 3: "data:," + "é" * 400_000}
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    found = warc.read_archives(spark, warc.write_archives(pages.coalesce(1), compressed=packed)).collect()
    assert {(warc.page_of(r.record_id), r.trouble, r.url, bytes(r.payload).decode()) for r in found} == {(i, None, u, f"page {i}") for i, u in urls.items()}


def test_query_keeps_pages_of_long_urls(spark, tmp_path):
    spark.createDataFrame([(1, "u" * 100_000, "a"), (2, "v", "b")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id for r in QUERIES["op6_warc"](spark, str(tmp_path)).collect()} == {1, 2}


def test_gaps_fail_a_job_that_needs_all(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 9, "member is cut off")], "archive string, at long, trouble string")
    assert warc.without_gaps(rows.filter("at = 0")).count() == 1
    with pytest.raises(Exception, match="gap in a at byte 9: member is cut off"):
        warc.without_gaps(rows).select("archive").collect()
