"""Staged tables: where they go, and that they go away."""

import os
import subprocess
import sys

import pytest

from skein import stage


def held(spark):
    folder = stage.shared_dir(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith("stage-")}


def test_owned_and_settled_tables_are_dropped(spark):
    before, names = held(spark), {t.name for t in spark.catalog.listTables()}
    with stage.owned():
        a = stage.stage(spark.range(5))
        b = stage.stage_bucketed(spark.range(5), "id")
        assert a.join(b, "id").count() == 5 and len(held(spark)) == len(before) + 2
    assert held(spark) == before and {t.name for t in spark.catalog.listTables()} == names
    out = stage.settled(lambda: stage.stage(spark.range(7)).where("id > 2"))
    assert out.count() == 4 and len(held(spark)) == len(before) + 1
    stage.discard(out)
    assert held(spark) == before


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        stage.shared_dir(Session())


def test_entry_without_the_corpus_modules():
    """Whatever keeps the corpus queries from being imported, the others are there."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pr_csr' in q and 'pipeline' not in q and len(e.oracle_sql()) > 90"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
