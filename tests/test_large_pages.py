"""Pages of a million characters and more."""

from loomtext.plans import catalog


def test_sizes_of_large_pages(spark, tmp_path):
    sizes = [(1, 10), (2, 999_999), (3, 1_000_000), (4, 3 * 1024 * 1024)]
    spark.createDataFrame([(i, f"http://x/{i}?page=2", "x" * n) for i, n in sizes], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["size"] for r in catalog.QUERIES["count_and_size_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "10 B", 2: "976.6 KB", 3: "976.6 KB", 4: "3.0 MB"}


def test_sizes_between_two_tenths(spark, tmp_path):
    sizes = [1280, 1792, 2304, 2816, 1310720, 1048575]
    spark.createDataFrame([(n, "http://x/1", "x" * n) for n in sizes], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["size"] for r in catalog.QUERIES["count_and_size_text"](spark, str(tmp_path)).collect()}
    assert got == {n: f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB" for n in sizes}
    assert got[1280] == "1.2 KB" and got[1792] == "1.8 KB"
