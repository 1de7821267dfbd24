import sys

import pyarrow as pa
import pytest
from conftest import ROOT

sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402

from gridtrace.llm import workers  # noqa: E402
from gridtrace.session import BATCHES  # noqa: E402


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_on_its_own_bounds_its_batches(spark, name):
    sf = "/root/testdata/sf0.001"
    for key in BATCHES:
        spark.conf.unset(key)
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf)
    assert {key: spark.conf.get(key) for key in BATCHES} == BATCHES


def test_arrows_pool_is_given_back(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert list(workers.tidy(iter)([1, 2])) == [1, 2]
    assert calls == [1]
