"""Queries work out and carry what they are asked for, with the same results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from veldspar.operators import funding, lab
from veldspar.plans import funding as calls
from veldspar.plans import lab as orders


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rule", list(funding.RULES))
def test_one_rule_is_worked_out_alone(spark, sf, rule):
    people, listed = calls.people(spark, sf), calls.calls(spark)
    every = funding.reasons(people, listed, calls.TODAY).select("person", "id", F.explode("reasons").alias("r")).select("person", "id", "r.*").where(F.col("rule") == rule)
    query = calls.QUERIES[next(n for n in calls.QUERIES if n.startswith("fel") and n[6:] == rule)][0](spark, sf)
    assert sorted(map(tuple, query.collect())) == sorted(map(tuple, every.collect()))
    assert "explode" not in plan(query) and "named_struct(rule" not in plan(query)


def test_attention_joins_nothing(spark, sf):
    own = orders.orders(spark, sf)
    found = lab.find(own, "attention", "", orders.TODAY)
    assert plan(found).count("Join") == plan(own).count("Join")
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in own.join(lab.attention(own, orders.TODAY).select("id"), "id", "left_semi").collect())


def test_the_catalogue_carries_only_what_is_asked_for(spark):
    row = dict(item="A b", vendor="v", catalog="c", requested=date(2020, 1, 1), seq=1)
    rows = [row, row | dict(item=" a B", vendor="w", seq=2), row | dict(item="a b", vendor="x", requested=None, seq=9), row | dict(item=" ")]
    own = spark.createDataFrame([tuple(r.values()) for r in rows], "item string, vendor string, catalog string, requested date, seq long").repartition(2)
    assert [(r.key, r.item, r.vendor) for r in lab.catalogue(own).collect()] == [("a b", " a B", "w")]
    assert "catalog#" not in plan(lab.catalogue(own).select("key", "vendor")).split("LogicalRDD")[0]
