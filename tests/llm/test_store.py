from __future__ import annotations

from lodestar.llm import _worker
from lodestar.sources import shared


def test_a_worker_keeps_one_cache():
    made = []
    get = lambda key: _worker.keep(key, lambda: made.append(key) or [key])
    a = get("a")
    assert get("a") is a and made == ["a"]
    assert get("b") == ["b"] and get("a") is not a and made == ["a", "b", "a"]
    _worker.release()
    assert get("a") == ["a"] and len(made) == 4


def test_settled_tables_lie_in_the_shared_folder(spark):
    df = shared.settle(spark.range(5).withColumnRenamed("id", "odd name"), "t")
    assert sorted(r[0] for r in df.collect()) == [0, 1, 2, 3, 4]
    assert all(f.startswith(shared.shared_dir(spark)) for f in df.inputFiles())
    assert shared.settle(spark.range(0)).count() == 0
    assert "Scan" in df._jdf.queryExecution().toString() and "Range" not in df._jdf.queryExecution().toString()
