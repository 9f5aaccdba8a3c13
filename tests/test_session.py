import zipfile
from types import SimpleNamespace

import corpus_pipeline
import pytest

from tripquarry import session


class Context:
    def __init__(self, master):
        self.master, self.sent = master, []

    def addPyFile(self, path):  # noqa: N802
        self.sent.append(zipfile.ZipFile(path).namelist())


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,3000]", "k8s://host", "yarn"])
def test_a_cluster_gets_the_package_whatever_the_drivers_own_path(monkeypatch, master):
    home = str(session.ROOT.parent)
    monkeypatch.chdir(home)
    monkeypatch.setenv("PYTHONPATH", home)
    context = Context(master)
    for _ in range(2):
        session.ship(SimpleNamespace(sparkContext=context))
    assert len(context.sent) == 1 and "tripquarry/llm/quality_knn.py" in context.sent[0]


def test_one_machine_with_the_package_on_its_path_gets_nothing(monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    for path, sent in ((str(session.ROOT.parent), 0), ("", 1)):
        monkeypatch.setenv("PYTHONPATH", path)
        context = Context("local[4]")
        session.ship(SimpleNamespace(sparkContext=context))
        assert len(context.sent) == sent


def test_every_stage_of_the_pipeline_sends_the_package_itself(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        seen = []
        monkeypatch.setattr(session, "ship", seen.append)
        stage(spark, docs, str(tmp_path))
        assert seen == [spark], name
