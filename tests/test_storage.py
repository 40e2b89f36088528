"""Scratch tables: where they lie, and that they go."""

import importlib
import sys
from types import SimpleNamespace

import pytest

from scriptorium import storage


def fake(master, setting=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(fake(master))
    assert storage.shared_dir(fake(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_scratch_tables_go(spark):
    one, two = storage.saved(spark.range(5), "one"), storage.saved(spark.range(3), "two")
    assert one.count() == 5 and storage.exists(spark, one.scratch)
    storage.discard(one)
    assert not storage.exists(spark, one.scratch) and two.count() == 3
    storage.clear(spark)
    assert not storage.exists(spark, two.scratch)
    assert storage.saved(spark.range(2), "three").count() == 2


def test_only_an_absent_package_is_let_pass(monkeypatch, tmp_path):
    import __spark_entry__ as e

    (tmp_path / "needs_more.py").write_text("import surely_not_installed")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert e.optional("no_such_module") is None
    with pytest.raises(ModuleNotFoundError, match="surely_not_installed"):
        e.optional("needs_more")


def test_the_rest_works_without_the_optional_parts(monkeypatch):
    import __spark_entry__ as e

    real = importlib.import_module

    def without(name, *rest):
        if name.startswith(("scriptorium.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name="scriptorium.llm" if "llm" in name else name)
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    again = real("__spark_entry__")
    assert again.llm is None and again.pipeline is None and len(again.queries()) > 190
    assert not any(name.startswith("op") and name[2].isdigit() for name in again.queries())
    monkeypatch.setitem(sys.modules, "__spark_entry__", e)
