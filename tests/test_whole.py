"""Queries over whole texts and all rows against plain versions."""

import hashlib

import pytest

from dossierflow.plans import QUERIES

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(7, "a | b \n c " + "x" * 400 + " end", "en"), (14, " \n ", "de"), (2, "é" * 600 + "ß", "fr"), (3, "Été 2024 Straße été", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_postings_of_all_languages(spark, folder):
    got = {(x["doc_id"], x["term"]): x["tf"] for x in QUERIES["x1_postings_all"](spark, folder).collect()}
    assert {k: n for k, n in got.items() if k[0] == 3} == {(3, "ete"): 2, (3, "2024"): 1, (3, "straße"): 1}
    assert (2, "e" * 600 + "ß") in got


def test_whole_texts(spark, folder):
    cells = {x["doc_id"]: x["cell"] for x in QUERIES["f33_markdown_cell_whole"](spark, folder).collect()}
    assert cells[7] == "a \\| b c " + "x" * 400 + " end" and cells[14] == "—"
    plain = {x["doc_id"]: x["plain"] for x in QUERIES["f3_upper_fold_whole"](spark, folder).collect()}
    assert plain[2] == hashlib.md5(b"E" * 600).hexdigest()


def test_all_pieces(spark):
    from dossierflow.plans.piece_queries import _key_and_rest
    from dossierflow.sources import collection

    items = collection.items(spark, SMOKE)
    key, index = _key_and_rest(spark, SMOKE)
    assert key.count() + index.count() == items.select("line").distinct().count()
    report = QUERIES["x14_accuracy_report"](spark, SMOKE).first()
    assert report["key_pieces"] + report["index_pieces"] == items.select("line").distinct().count()
    assert QUERIES["j11_interval_containment_all"](spark, SMOKE).count() == items.select("group_key", "start_order", "end_order").distinct().count()
