import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=folder, capture_output=True, text=True, check=True)
    queries, oracle = (set(x.split()) for x in out.stdout.strip().split("\n")[-2:])
    assert oracle <= queries
    return queries


def test_entry_works_with_and_without_the_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", "spark-warehouse"))
    without = names(copy)
    assert without == {n for n in names(ROOT) if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"} and len(without) > 100


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_works_without_a_library_that_only_the_text_operators_need():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout.strip().split("\n")[-1]) > 100
