"""Joins on a key that holds a third of all rows, with thresholds lowered to test size."""

import re

import pytest
from pyspark.sql import functions as F

from runledger.operators import checks as c
from runledger.plans import commerce
from runledger.session import isolated_session, scratch_path
from runledger.sources.tables import materialize

ROWS = 300_000


@pytest.fixture
def session(spark):
    session = isolated_session(spark)
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.files.maxPartitionBytes": "256KB",
        "spark.sql.files.openCostInBytes": "1KB",
    }.items():
        session.conf.set(key, value)
    return session


def hot(session, name="k"):
    """A third of the rows have key 0 and a sixth no key."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 6 != 1, F.col("id"))
    return materialize(
        session.range(0, ROWS, 1, 8).select(
            key.alias(name), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("text")
        ),
        scratch_path(session, "hot"),
    )


def written(df):
    return materialize(df, scratch_path(df.sparkSession, "side"))


def run_plan(df):
    """Run the query whole and return its final plan."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def splits_in(plan):
    return len(re.findall(r"SortMergeJoin\(skew=true\)", plan))


def test_orphans_split_a_hot_key(session):
    df = hot(session)
    reference = session.range(0, ROWS, 2).select(F.col("id").alias("k"))
    found = c.orphans(df, reference.unionAll(reference), ["k"])
    assert splits_in(run_plan(found))
    assert found.count() == df.where("k IS NULL OR k % 2 = 1").count()


def test_late_rows_split_a_hot_key(session):
    df = hot(session).withColumn("day", F.expr("date_add(DATE '2026-01-01', cast(n % 40 AS int))"))
    reference = session.range(ROWS).select(F.col("id").alias("k"), F.lit("2026-01-01").alias("d"))
    late = c.late_rows(written(df), reference.unionAll(reference), ["k"], "day", "d", 14)
    assert splits_in(run_plan(late))
    assert late.count() == df.where("k IS NOT NULL AND n % 40 > 14").count()


def test_lookups_of_the_analyssplits_in_hot_keys(session):
    items = hot(session, "product_id").withColumnRenamed("text", "item_id")
    costs = written(session.range(ROWS).selectExpr("id AS product_id", "id AS unit_cost_cents", "'USD' AS currency"))
    costed = commerce.costed_items({"order_items": items, "product_costs": costs})
    assert splits_in(run_plan(costed))
    assert costed.count() == ROWS and costed.where("product_id = 0 AND unit_cost_cents = 0").count() == ROWS // 3

    orders = hot(session, "customer_id").withColumnRenamed("n", "order_id")
    frames = {
        "clean_orders": orders,
        "customers": written(session.range(ROWS).selectExpr("id AS customer_id")),
        "attribution": written(session.range(0, ROWS, 2).selectExpr("id AS customer_id", "'web' AS channel")),
        "order_margin": written(session.range(ROWS).selectExpr("id AS order_id", "2L AS revenue_cents", "1L AS cost_cents")),
        "refund_totals": written(session.range(0, ROWS, 4).selectExpr("id AS order_id", "1L AS refund_cents")),
    }
    attributed = commerce.attributed_orders(frames)
    assert splits_in(run_plan(attributed)) >= 2
    assert attributed.count() == ROWS
    known = orders.where("customer_id % 2 = 0").count()
    assert attributed.where("channel = 'web'").count() == known
    assert attributed.agg(F.sum("refund_cents")).first()[0] == ROWS // 4
