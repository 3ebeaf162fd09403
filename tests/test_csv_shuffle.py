"""CSV records: the text is shuffled once, in splits of any size, also behind a quote that never ends."""

import re

import pytest

from sparkveil.sources import records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 29)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_text_is_shuffled_once(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,a\n" + "".join(f'{i},"one\ntwo {i}"\n' for i in range(50)))
    rows = records.read_csv(spark, f"{tmp_path}/x.csv").rows
    plan = rows._jdf.queryExecution().sparkPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) == 1
    assert "SortMergeJoin" not in plan
    assert sorted(int(r.id) for r in rows.collect()) == list(range(50))


def test_an_open_quote_over_many_splits(spark, tmp_path, small_splits):
    good = "".join(f'{i},"one\n\ntwo {i}"\n' for i in range(8))
    lost = ['8,"open'] + [f"{i}, a line behind the open quote" for i in range(30)]
    (tmp_path / "0.csv").write_text("id,a\n" + good + "\n".join(lost) + "\n")
    (tmp_path / "1.csv").write_text("id,a\n" + good.replace("two", "three") + '9,"' + "long\n" * 30 + '"\n')
    found = records.read_csv(spark, f"{tmp_path}/*.csv", include_original=True).rows.collect()
    fine = sorted((r.id, r.a) for r in found if not r.row_errors)
    want = [(str(i), f"one\n\n{w} {i}") for i in range(8) for w in ("two", "three")] + [("9", "long\n" * 30)]
    assert fine == sorted(want)
    bad = [(e.reason, e.original) for r in found for e in r.row_errors]
    assert sorted(bad) == sorted((records.UNFINISHED, x) for x in lost)
