"""Listings, caches, contracts and exports on temporary folders."""

import json

import pytest

from factloom.operators import checks
from factloom.sources import files


def test_discovery_skips_hidden_series_and_reports_names_without_year(spark, tmp_path):
    for name in ("yearly/1999.pdf", "yearly/2005.pdf", "yearly/x.pdf", "_drafts/1999.pdf", "yearly/note.txt", "package/relief_2001.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found, odd = files.discovered(files.listing(spark, str(tmp_path)), 1999, 2004)
    assert sorted((r.series, r.stem, r.year) for r in found.collect()) == [("package", "relief_2001", 2001), ("yearly", "1999", 1999)]
    assert [r.stem for r in odd.collect()] == ["x"]


def test_stale_cache_rows_are_read_again(spark):
    manifest = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "pdf_url string")
    cache = spark.createDataFrame([("a", 0), ("b", None)], "u string, n_pages_ocr int").selectExpr("md5(u) AS url_md5", "n_pages_ocr")
    assert sorted(r[0] for r in files.to_extract(manifest, cache).collect()) == ["b", "c"]


def test_contracts(spark):
    a = spark.createDataFrame([("s2", 1), ("s1", 2)], "shock_id string, x int")
    assert sorted((r.shock_id, r.cluster_id) for r in files.bound([a], ["shock_id", "x"], "shock_id").collect()) == [("s1", 1), ("s2", 2)]
    with pytest.raises(ValueError, match="missing columns: y"):
        files.bound([a], ["shock_id", "y"], "shock_id")
    with pytest.raises(ValueError, match="repeated shock_id: s"):
        files.bound([a, a], ["shock_id"], "shock_id")


def test_freeze_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "id int, tags array<string>")
    files.freeze(df, str(tmp_path / "t"), "shocks", "abc")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert json.loads(spark.read.text(str(tmp_path / "t.meta")).first()[0])["revision"] == "abc"
    files.export(df, str(tmp_path / "out"), {"id": "identifier"})
    assert [r.label for r in spark.read.csv(str(tmp_path / "out/dictionary"), header=True).orderBy("variable").collect()] == ["identifier", None]
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True).first()["tags"] == '["a"]'


def test_paths_decide_the_status(spark):
    m = files.with_defaults(spark.createDataFrame([("p1", "/a"), ("p2", "/b"), ("p3", None)], "package_id string, local_path string"))
    here = spark.createDataFrame([("/a",)], "path string")
    assert sorted((r.package_id, r.access_status) for r in files.resolved(m, here).collect()) == [("p1", "manual_ready"), ("p2", "manual_pending"), ("p3", "auto")]


def test_costs_by_price(spark):
    log = spark.createDataFrame([("m", 1_000_000, None, 0, 500_000), ("z", 1, 1, 1, 1)], "model string, input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long")
    prices = spark.createDataFrame([("m", 3.0, 15.0, 4.0, 0.3)], "model string, input double, output double, cache_write double, cache_read double")
    assert sorted((r.model, r.cost_usd) for r in files.call_costs(log, prices).collect()) == [("m", pytest.approx(3.15)), ("z", None)]


def test_worst_of_no_checks_is_pass(spark):
    assert checks.worst_status(spark.createDataFrame([], "status string")).first()["overall"] == "PASS"
    assert checks.worst_status(spark.createDataFrame([("PASS",), ("WARN",)], "status string")).first()["overall"] == "WARN"
