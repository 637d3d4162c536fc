import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 45


def test_imports_without_the_corpus_folders(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text(open(os.path.join(root, name)).read())
    import shutil

    shutil.copytree(os.path.join(root, "ledgerine"), tmp_path / "ledgerine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; print(len(e.queries()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_titles_keep_references_without_a_semicolon(spark, tmp_path):
    from ledgerine.plans.queries import html_titles

    pages = [(1, "<title> a&amp\n&amp;lt; &copy;&quot</title>"), (2, "<title>x</title><p>y"), (3, "<p>z"), (4, "<title>one</title><title>two</title>")]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, html_titles(spark, str(tmp_path)).collect())) == [(1, "a&amp &lt; &copy;&quot"), (2, "x"), (4, "one")]
