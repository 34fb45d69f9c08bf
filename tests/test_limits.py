"""Limits of scripts, and inputs that would end a job."""

import time

import pytest
from lorebase.operators import filters, sqlsurface


def test_a_script_ends_at_its_limit(spark):
    spark.range(100).createOrReplaceTempView("numbers")
    began = time.time()
    with pytest.raises(TimeoutError):
        sqlsurface.run_script(lambda s: time.sleep(6), spark, timeout_s=1)
    assert time.time() - began < 3
    began = time.time()
    with pytest.raises(TimeoutError):  # a join of a hundred billion rows
        sqlsurface.run_script(lambda s: s.sql("select count(*) n from range(0, 400000) a, range(0, 400000) b where a.id % 7 = b.id % 11"), spark, timeout_s=2)
    assert time.time() - began < 5
    assert sqlsurface.run_script(lambda s: s.sql("select count(*) n from numbers"), spark, timeout_s=8) == [{"n": 100}]
    with pytest.raises(ZeroDivisionError):
        sqlsurface.run_script(lambda s: 1 / 0, spark)


def test_sanitizing_what_is_not_json(spark):
    rows = [("{",), (None,), ("",), ('{"name": "secret", "n": 1}',), ('["10.1.2.3"]',)]
    out = [r["doc"] for r in filters.sanitize(spark.createDataFrame(rows, "doc string")).collect()]
    assert out[:3] == ["", None, ""] and "secret" not in out[3] and '"n":1' in out[3].replace(" ", "") and "10.1.2.3" not in out[4]
