"""The commerce inputs, in two batches, taken from TPC-H-like tables.

The second batch repeats its pending orders exactly, renames and moves the spend column,
spends more on one channel, loses the attribution of one nation and brings credit notes for
orders that do not exist. Amounts are rounded to whole cents per row, before any sum.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .definition import Frames

# The channel that a supplier of each region advertises in, and the nations
# and amounts that set the second batch apart.
REGION_CHANNELS = {0: "AUTOMOBILE", 1: "BUILDING", 2: "FURNITURE", 3: "MACHINERY", 4: "HOUSEHOLD"}
AFFILIATE_NATION, AFFILIATES = 24, "AFFILIATES"
LOST_NATION = 24
DEARER_CHANNEL, DEARER_CENTS = "BUILDING", 4000

LINE_KEY = (
    "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', "
    "date_format(l_shipdate, 'yyyyMMdd'))"
)
Table = Callable[[str], DataFrame]


def load(spark: SparkSession, folder: str, *names: str) -> Frames:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def _cents(amount: str) -> str:
    return f"cast(round({amount} * 100) AS bigint)"


def _orders(table: Table, batch: int) -> DataFrame:
    columns = [
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "cast(o_orderdate AS date) AS ordered_at",
        "'USD' AS currency",
    ]
    orders = table("orders").selectExpr(*columns)
    if batch == 2:
        orders = orders.unionAll(table("orders").where("o_orderstatus = 'P'").selectExpr(*columns))
    return orders


def _order_items(table: Table, batch: int) -> DataFrame:
    return table("lineitem").selectExpr(
        f"{LINE_KEY} AS item_id",
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "cast(l_quantity AS bigint) AS quantity",
        f"{_cents('l_extendedprice')} AS unit_price_cents",
    )


def _customers(table: Table, batch: int) -> DataFrame:
    return table("customer").selectExpr("c_custkey AS customer_id", "cast(c_nationkey AS string) AS region")


def _attribution(table: Table, batch: int) -> DataFrame:
    customers = table("customer")
    if batch == 2:
        customers = customers.where(F.col("c_nationkey") != LOST_NATION)
    return customers.selectExpr("c_custkey AS customer_id", "c_mktsegment AS channel")


def _ad_spend(table: Table, batch: int) -> DataFrame:
    regions = " ".join(f"WHEN n_regionkey = {key} THEN '{name}'" for key, name in REGION_CHANNELS.items())
    channel = f"CASE WHEN n_nationkey = {AFFILIATE_NATION} THEN '{AFFILIATES}' {regions} END"
    spend = table("supplier").join(table("nation"), F.expr("s_nationkey = n_nationkey")).selectExpr(
        "concat('S', s_suppkey) AS spend_id",
        f"{channel} AS channel",
        f"abs({_cents('s_acctbal')}) AS amount_cents",
        "'USD' AS currency",
    )
    if batch == 2:
        raised = f"amount_cents + CASE WHEN channel = '{DEARER_CHANNEL}' THEN {DEARER_CENTS} ELSE 0 END"
        spend = spend.selectExpr("spend_id", "channel", "currency", f"{raised} AS spend_cents")
    return spend


def _product_costs(table: Table, batch: int) -> DataFrame:
    return table("part").selectExpr(
        "p_partkey AS product_id", f"{_cents('p_retailprice')} AS unit_cost_cents", "'USD' AS currency"
    )


def _refunds(table: Table, batch: int) -> DataFrame:
    refunds = table("lineitem").where("l_returnflag = 'R'").selectExpr(
        f"{LINE_KEY} AS refund_id",
        "l_orderkey AS order_id",
        f"{_cents('l_extendedprice')} AS amount_cents",
        "'USD' AS currency",
        "cast(l_shipdate AS date) AS received_at",
    )
    if batch == 2:
        refunds = refunds.unionAll(
            table("supplier").selectExpr(
                "concat('credit-', s_suppkey) AS refund_id",
                "-s_suppkey AS order_id",
                f"abs({_cents('s_acctbal')}) AS amount_cents",
                "'USD' AS currency",
                "DATE '2001-01-01' AS received_at",
            )
        )
    return refunds


BUILDERS: dict[str, Callable[[Table, int], DataFrame]] = {
    "orders": _orders,
    "order_items": _order_items,
    "customers": _customers,
    "attribution": _attribution,
    "ad_spend": _ad_spend,
    "product_costs": _product_costs,
    "refunds": _refunds,
}


def retail_inputs(spark: SparkSession, folder: str, batch: int = 1, *names: str) -> Frames:
    """The named inputs of a batch, or all of them."""
    table = functools.cache(lambda name: load(spark, folder, name)[name])
    return {name: BUILDERS[name](table, batch) for name in names or BUILDERS}
