import importlib
import os

import pytest

import __spark_entry__
from nlimorph.plans import registry


def test_registered_names_and_sql_match():
    names = set(__spark_entry__.queries())
    assert set(registry.queries()) <= names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_library_stands_without_the_training_data_part(monkeypatch):
    whole = importlib.import_module

    def lacking(name):
        if name in ("nlimorph.llm.queries", "corpus_pipeline"):
            raise ImportError(name)
        return whole(name)

    monkeypatch.setattr(importlib, "import_module", lacking)
    assert set(__spark_entry__.queries()) == set(registry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not here")
def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["dataset", "mr", "total", "errors", "level", "error_rate"]
    assert got.where("level = 'all'").count() == 1
