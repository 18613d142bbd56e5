import pytest

from tidemark import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


# ensembles, which SQL can't express; test_trees.py and test_ordered_trees.py hold the learners against brute force
NO_SQL = {f"{k}_by_fold" for k in ("ordered_boosting", "leafwise_boosting", "newton_boosting", "extra_trees")}


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) - NO_SQL == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_ensembles_score_every_fold(name, spark, data):
    rows = catalog.queries()[name](spark, data).collect()
    assert {r["__fold__"] for r in rows} == {0, 1} and all(0 <= r["average_precision"] <= 1 for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
