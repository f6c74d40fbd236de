import zipfile

import pytest

from dossierflow.plans import steps
from dossierflow.sources import sinks


def test_lines_are_pruned_and_bad_ones_stay(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.append_lines(spark.createDataFrame([("w1", "g1", None), ("w2", "g2", "A"), ("w3", "g3", "B")], "window string, `group` string, type string"), path)
    lines = spark.read.text(path).unionByName(spark.createDataFrame([("{oops",)], "value string"))
    left = sinks.prune_lines(lines, spark.createDataFrame([("w1",)], "window string"), spark.createDataFrame([("g3",)], "`group` string"))
    assert sorted(r["value"] for r in left.collect()) == ['{"window":"w2","group":"g2","type":"A"}', "{oops"]


def test_files_and_blocks(tmp_path):
    path = str(tmp_path / "a.md")
    assert sinks.write_if_changed(path, "made 2024-01-01T10:00:00\nx") and not sinks.write_if_changed(path, "made 2025-01-01T10:00:00\nx") and sinks.write_if_changed(path, "y")
    first = sinks.merge_managed("mine", "one")
    second = sinks.merge_managed(first + "after", "two")
    assert "mine" in second and "two" in second and "one" not in second and second.endswith("after")
    assert sinks.replace_user_part(first, "other").startswith("other\n\n<!-- managed:start -->")


def test_packages(tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_LIMIT", 10)
    assert sinks.write_package(str(tmp_path / "p.zip"), {"b.md": "b", "a.md": "a", "big.md": "x" * 11}) == ["a.md", "b.md"]
    assert zipfile.ZipFile(tmp_path / "p.zip").namelist() == ["a.md", "b.md"]
    assert sinks.package_plan([("a", 9)] * 2)[1:] == (6, "ok")
    assert sinks.combined({"p": {"a.md": "see `b.md` and [x](b.md), b.md"}} | {"q": {"b.md": ""}})["p-a.md"] == "see `b.md` and [x](b.md), b.md"
    assert sinks.combined({"p": {"a.md": "see `b.md` and [x](b.md), b.md", "b.md": ""}})["p-a.md"] == "see `p-b.md` and [x](p-b.md), b.md"


def test_reports(spark):
    items = spark.createDataFrame([("2020", "g", 2, 3, None, " ", 1), ("2019-05", "g", 1, 1, "A", "x", 2), (None, "g", 9, 9, "A", "x", 3)], "date string, group_key string, start_order long, end_order long, type string, author string, line long")
    assert [r["value"] for r in sinks.timeline_lines(items).collect()] == ["| 2019-05 | g | 1 | 1 | A | x |", "| 2020 | g | 2 | 3 | — | — |"]
    assert sinks.review_report({"Types": items.groupBy("group_key").count(), "None": items.limit(0)}) == "## Types\n\n| group_key | count |\n|-|-|\n| g | 3 |\n\n## None\n\nNothing.\n"


def test_steps_are_logged(spark, tmp_path):
    log = str(tmp_path / "log")
    pages = spark.createDataFrame([("g", k) for k in range(20)], "group_key string, number int")
    assert steps.run(spark, {"page": pages}, ["windows"], log)["window"].count() == 2
    with pytest.raises(KeyError):
        steps.run(spark, {}, ["windows"], log)
    assert sorted((r["step"], r["ok"]) for r in spark.read.parquet(log).collect()) == [("windows", False), ("windows", True)]
