"""Registered queries over the driver tables, and the SQL that must agree with them."""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from runledger.functions.hashing import fingerprint, md5_fingerprint  # noqa: E402
from runledger.functions.text import SECRET_PATTERN, redact  # noqa: E402
from runledger.operators import checks as c  # noqa: E402
from runledger.operators.compare import (  # noqa: E402
    compare_outputs,
    input_diff,
    key_guard,
    numeric_guard,
    pipeline_diff,
    unit_guard,
)
from runledger.operators.contracts import (  # noqa: E402
    bad_columns,
    capture_contract,
    check_contract,
    column_rows,
    contract_rows,
    schema_diff,
)
from runledger.operators.findings import evidence_row, top_finding  # noqa: E402
from runledger.operators.intervals import range_join, top_matches  # noqa: E402
from runledger.operators.lineage import on_cycles, reachable  # noqa: E402
from runledger.operators.multisets import all_subsets, grouping_totals, multiset_diff  # noqa: E402
from runledger.operators.ordered import as_of_join, exact_percentiles, running_totals  # noqa: E402
from runledger.operators.profile import numeric_stats, preview, profile, sample_rows, value_counts  # noqa: E402
from runledger.operators.sketches import DISTINCT_ERROR, RANK_ERROR, merged_sketches, sketch_answers  # noqa: E402
from runledger.operators.status import run_status  # noqa: E402
from runledger.plans import commerce, retail  # noqa: E402
from runledger.plans.definition import Check, Pipeline, Step, row_check  # noqa: E402
from runledger.plans.runs import (  # noqa: E402
    artifact,
    compare_runs,
    explore,
    record_evidence,
    run_pipeline,
    run_report,
    run_table,
    step_report,
)
from runledger.plans.steps import check_summary, sql_step  # noqa: E402
from runledger.session import isolated_session, scratch_path, small_frame  # noqa: E402
from runledger.sources.ledger_format import FORMAT, register_format  # noqa: E402
from runledger.sources.readers import read_source  # noqa: E402
from runledger.sources.tables import export, materialize, page  # noqa: E402
from runledger.sources.versions import (  # noqa: E402
    Workspace,
    append_frame,
    append_frames,
    append_version,
    bind_versions,
    latest_rows,
    latest_versions,
    list_versions,
    version_sample,
    version_sketches,
    versions,
)
from runledger.streaming.registration import Arrivals, arrived_version, commits, late_arrivals, register_stream  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Channel contribution profit on the smallest tables."""
    return channel_profit(spark, "/root/testdata/sf0.001")


# --- the worked analysis ----------------------------------------------------------------


def _composed(spark: SparkSession, folder: str, batch: int) -> dict[str, DataFrame]:
    return commerce.compose(retail.retail_inputs(spark, folder, batch), distinct_orders=batch == 2)


def _cents(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    frames = _composed(spark, folder, batch)
    spend = commerce.SPEND_COLUMN if batch == 1 else commerce.REVISED_SPEND_COLUMN
    return commerce.channel_cents(frames["attributed_orders"], frames["ad_spend"], spend)


def channel_profit(spark: SparkSession, folder: str) -> DataFrame:
    return _cents(spark, folder, 1)


def channel_profit_recovered(spark: SparkSession, folder: str) -> DataFrame:
    return _cents(spark, folder, 2)


def channel_profit_money(spark: SparkSession, folder: str) -> DataFrame:
    profit = commerce.channel_profit(_composed(spark, folder, 1), commerce.SPEND_COLUMN)
    money = ["revenue", "product_costs", "refunds", "ad_spend", "contribution_profit"]
    return profit.select("channel", "currency", "orders", *[F.col(m).cast("string").alias(m) for m in money])


def clean_orders_distinct(spark: SparkSession, folder: str) -> DataFrame:
    orders = commerce.orders_without_copies(retail.retail_inputs(spark, folder, 2, "orders"))
    return orders.withColumn("ordered_at", F.col("ordered_at").cast("string"))


def costed_items(spark: SparkSession, folder: str) -> DataFrame:
    return commerce.costed_items(retail.retail_inputs(spark, folder, 1, "order_items", "product_costs"))


def order_margin(spark: SparkSession, folder: str) -> DataFrame:
    frames = retail.retail_inputs(spark, folder, 1, "order_items", "product_costs")
    return commerce.order_margin({"costed_items": commerce.costed_items(frames)})


def refund_totals(spark: SparkSession, folder: str) -> DataFrame:
    return commerce.refund_totals(retail.retail_inputs(spark, folder, 2, "refunds"))


def attributed_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _composed(spark, folder, 2)["attributed_orders"]


# --- checks -----------------------------------------------------------------------------


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return retail.load(spark, folder, name)[name]


def check_unique_key(spark: SparkSession, folder: str) -> DataFrame:
    return c.unique_key(_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def check_duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    copies = c.duplicate_rows(retail.retail_inputs(spark, folder, 2, "orders")["orders"])
    return copies.withColumn("ordered_at", F.col("ordered_at").cast("string"))


def check_accepted_values(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "lineitem")
    bad = c.accepted_values(items, "l_returnflag", ["A", "N"], required=["l_orderkey", "l_partkey"])
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


def check_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return c.not_null(_composed(spark, folder, 1)["attributed_orders"], ["revenue_cents", "cost_cents"])


def check_range(spark: SparkSession, folder: str) -> DataFrame:
    bad = c.value_range(_table(spark, folder, "customer"), "c_acctbal", minimum=0)
    suppliers = c.value_range(_table(spark, folder, "supplier"), "s_acctbal", minimum=0)
    return bad.select(F.lit("customer").alias("party"), F.col("c_custkey").alias("party_id"), "c_nationkey").unionAll(
        suppliers.select(F.lit("supplier"), "s_suppkey", "s_nationkey")
    )


def check_join_grain(spark: SparkSession, folder: str) -> DataFrame:
    frames = retail.retail_inputs(spark, folder, 2, "order_items", "orders")
    return c.join_grain(frames["order_items"], frames["orders"], ["order_id"])


def check_step_grain(spark: SparkSession, folder: str) -> DataFrame:
    frames = _composed(spark, folder, 2)
    rows = [frames[t].agg(F.count("*").alias("n")) for t in ("attributed_orders", "orders")]
    return c.grain(*rows)


def check_orphans(spark: SparkSession, folder: str) -> DataFrame:
    t = retail.load(spark, folder, "orders", "lineitem")
    lines = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"))
    return c.orphans(t["orders"], lines, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


def check_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    frames = retail.retail_inputs(spark, folder, 2, "orders", "refunds")
    frames["clean_orders"] = commerce.orders_without_copies(frames)
    late = commerce.late_refunds(frames)
    return late.withColumn("received_at", F.col("received_at").cast("string"))


def check_missing_lookup(spark: SparkSession, folder: str) -> DataFrame:
    t = retail.load(spark, folder, "documents", "labels")
    joined = t["documents"].drop("text").join(t["labels"], "doc_id", "left")
    return c.missing_lookup(joined, "quality").select("doc_id", "lang", "source", "n_chars")


def check_defaulted_category(spark: SparkSession, folder: str) -> DataFrame:
    attributed = _composed(spark, folder, 2)["attributed_orders"]
    return c.defaulted_category(attributed, "channel", commerce.NO_CHANNEL).select("order_id", "channel")


def _pipelines(frames1: dict[str, DataFrame], frames2: dict[str, DataFrame]):
    v1 = commerce.commerce_pipeline(capture_contract(frames1))
    return v1, commerce.revised_pipeline(v1, capture_contract(frames2))


def _step_checks(pipeline) -> dict:
    return {s.name: s.checks for s in pipeline.steps}


def _with_profit(frames: dict[str, DataFrame], spend: str) -> dict[str, DataFrame]:
    return frames | {"channel_profit": commerce.channel_profit(frames, spend)}


def _written(spark: SparkSession, inputs: dict[str, DataFrame], pipeline, shared: list | None = None) -> dict[str, DataFrame]:
    """The output of every step, each written once and read by all checks and later steps.

    ``shared`` holds what other runs have written: a step with the same plan is not written again.
    """
    frames, folder, shared = dict(inputs), scratch_path(spark, "steps"), [] if shared is None else shared
    for step in pipeline.steps:
        made = step.build(frames)
        known = next((table for plan, table in shared if made.sameSemantics(plan)), None)
        frames[step.name] = known or materialize(made, f"{folder}/{step.name}")
        shared.append((made, frames[step.name]))
    return frames


def _check_runs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Check results of three runs: the first batch, its recipe on new orders, the repair."""
    inputs1, inputs2 = (retail.retail_inputs(spark, folder, batch) for batch in (1, 2))
    v1, v2 = _pipelines(inputs1, inputs2)
    mixed, shared = inputs2 | {"ad_spend": inputs1["ad_spend"]}, []
    return {
        "first": check_summary(_step_checks(v1), _written(spark, inputs1, v1, shared)),
        "blocked": check_summary(_step_checks(v1), _written(spark, mixed, v1, shared)),
        "repaired": check_summary(_step_checks(v2), _written(spark, inputs2, v2, shared)),
    }


def check_summary_repaired(spark: SparkSession, folder: str) -> DataFrame:
    inputs1, inputs2 = (retail.retail_inputs(spark, folder, batch) for batch in (1, 2))
    _, v2 = _pipelines(inputs1, inputs2)
    return check_summary(_step_checks(v2), _written(spark, inputs2, v2))


# --- profiles, samples, text ------------------------------------------------------------


def profile_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = profile(_table(spark, folder, "lineitem"))
    return counted.select("column", "rows", "missing", "nans", "distinct")


def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "lineitem")
    stats = numeric_stats(items).where("mean is not null")
    bounds = [F.col(b).cast("double").alias(b) for b in ("min", "max")]
    return stats.select("position", *bounds, F.round("mean", 4).alias("mean"))


def profile_nested(spark: SparkSession, folder: str) -> DataFrame:
    return value_counts(_table(spark, folder, "embeddings"))


def profile_text(spark: SparkSession, folder: str) -> DataFrame:
    return value_counts(_table(spark, folder, "documents"))


def first_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = sample_rows(_table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"], 20)
    return rows.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


def preview_bounded(spark: SparkSession, folder: str) -> DataFrame:
    return preview(_table(spark, folder, "documents"))


def preview_lists(spark: SparkSession, folder: str) -> DataFrame:
    cut = preview(_table(spark, folder, "embeddings"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return cut.select("vec_id", F.size("embedding").alias("items"), F.round(total, 4).alias("total"), "label")


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = page(_table(spark, folder, "orders"), "o_orderkey", offset=700, limit=100)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus")


def page_deep(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = page(items, keys, offset=30_000, limit=100)
    return rows.select(*keys[:-1], F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))


def redact_text(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, to which a secret of the built-in form is added that differs by row."""
    patterns = (SECRET_PATTERN, oracles.TOKEN_PATTERN)
    keyed = F.concat("text", F.lit(" sk-"), F.md5(F.col("doc_id").cast("string")), F.lit(" end"))
    return _table(spark, folder, "documents").select(
        "doc_id",
        redact(keyed, patterns=patterns).alias("redacted"),
        F.regexp_count("text", F.lit(oracles.TOKEN_PATTERN)).cast("bigint").alias("secrets"),
    )


# --- steps, exploration, results --------------------------------------------------------


def param_scale(spark: SparkSession, folder: str) -> DataFrame:
    frames = retail.retail_inputs(isolated_session(spark), folder, 1, "order_items")
    sql = """
        SELECT order_id, count(*) AS items, sum(quantity * :factor) AS scaled
        FROM order_items WHERE unit_price_cents >= :least GROUP BY order_id
    """
    values = {"factor": 3, "least": 100_000, "unused": None}
    return sql_step(sql, frames, values)


def _version_ids(rows: dict) -> dict[str, str]:
    return {name: row["version_id"] for name, row in rows.items()}


def _workspace(spark: SparkSession) -> Workspace:
    return Workspace(spark, scratch_path(spark, "workspace"), "retail")


def explore_group_count(spark: SparkSession, folder: str) -> DataFrame:
    ws = _workspace(spark)
    append_frames(ws, retail.load(spark, folder, "documents", "labels"))
    return explore(
        ws,
        """
        SELECT d.source, d.lang, l.quality, count(*) AS documents, sum(d.n_chars) AS chars
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        GROUP BY d.source, d.lang, l.quality
        """,
    )


def run_status_of_checks(spark: SparkSession, folder: str) -> DataFrame:
    runs = _check_runs(spark, folder)
    results = functools.reduce(
        DataFrame.unionAll, [df.withColumn("run_id", F.lit(run)) for run, df in runs.items()]
    )
    names = [s.name for s in commerce.commerce_pipeline({n: {} for n in oracles.SOURCES}).steps]
    steps = small_frame(
        spark, [(r, i, n) for r in runs for i, n in enumerate(names)], "run_id string, position int, step string"
    )
    return run_status(steps, results)


def top_finding_profit(spark: SparkSession, folder: str) -> DataFrame:
    profit = commerce.channel_profit(_composed(spark, folder, 1), commerce.SPEND_COLUMN)
    return top_finding(profit, "channel", "contribution_profit", "currency")


def top_finding_order(spark: SparkSession, folder: str) -> DataFrame:
    margin = order_margin(spark, folder)
    earned = F.col("revenue_cents") - F.col("cost_cents")
    gross = margin.select("order_id", F.lit("USD").alias("unit"), earned.alias("margin_cents"))
    return top_finding(gross, "order_id", "margin_cents", "unit")


def evidence_channel(spark: SparkSession, folder: str) -> DataFrame:
    return evidence_row(_cents(spark, folder, 1), {"channel": "BUILDING"})


# --- comparison -------------------------------------------------------------------------


def _compared(rows: DataFrame) -> DataFrame:
    return rows.select("key", *[F.col(m).cast("bigint").alias(m) for m in ("before", "after", "delta")])


def compare_channels(spark: SparkSession, folder: str) -> DataFrame:
    rows = compare_outputs(_cents(spark, folder, 1), _cents(spark, folder, 2), "channel", "profit_cents")
    return rows.select(
        "key",
        *[F.col(m).cast("bigint").alias(m) for m in ("before", "after", "delta")],
        F.col("before_row.orders").alias("before_orders"),
        F.col("after_row.orders").alias("after_orders"),
    )


def compare_orders(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (commerce.refund_totals(retail.retail_inputs(spark, folder, batch, "refunds")) for batch in (1, 2))
    return _compared(compare_outputs(a, b, "order_id", "refund_cents"))


def compare_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Large decimals on one side, doubles on the other."""
    orders = _table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)")
    before = orders.select("o_orderkey", cents.alias("amount"))
    after = orders.select("o_orderkey", F.col("o_custkey").cast("double").alias("amount"))
    return _compared(compare_outputs(before, after, "o_orderkey", "amount"))


def compare_key_guard(spark: SparkSession, folder: str) -> DataFrame:
    before, after = (retail.retail_inputs(spark, folder, batch, "orders")["orders"] for batch in (1, 2))
    return key_guard(before, after, "order_id")


def compare_unit_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of one nation change currency between two batches."""
    orders = retail.retail_inputs(spark, folder, 1, "orders")["orders"]
    nation = _table(spark, folder, "customer").where("c_nationkey = 24")
    moved = nation.select(F.col("c_custkey").alias("customer_id"), F.lit("EUR").alias("moved_to"))
    after = orders.join(moved, "customer_id", "left").withColumn("currency", F.coalesce("moved_to", "currency"))
    return unit_guard(orders, after, "order_id")


def compare_numeric_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Order texts as metrics: the leading digit of a priority is a number, its name is not."""
    orders = _table(spark, folder, "orders")
    before = orders.select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("rank"))
    rank = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("1")
    after = orders.select("o_orderkey", rank.alias("rank"))
    return numeric_guard(before, after, "o_orderkey", "rank")


def _bound_inputs(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The inputs of a batch as bound versions, identified by their content."""
    parts = []
    for name, df in retail.retail_inputs(spark, folder, batch).items():
        schema = ",".join(f"{col}:{kind}" for col, kind in df.dtypes)
        parts.append(
            md5_fingerprint(df, df.columns).select(
                F.lit(name).alias("source"),
                F.col("hash_sum").alias("version_id"),
                F.concat_ws("/", "rows", "hash_sum").alias("digest"),
                F.lit(schema).alias("schema_json"),
            )
        )
    return functools.reduce(DataFrame.unionAll, parts)


def input_diff_batches(spark: SparkSession, folder: str) -> DataFrame:
    changed = input_diff(_bound_inputs(spark, folder, 1), _bound_inputs(spark, folder, 2))
    flags = [F.col(f).cast("int").alias(f) for f in ("content_changed", "schema_changed")]
    return changed.select("source", "before_version_id", "after_version_id", *flags)


def _row_counts(frames: dict[str, DataFrame], kind: str, names: list[str]) -> list[DataFrame]:
    return [
        frames[n].agg(F.lit(kind).alias("kind"), F.lit(n).alias("name"), F.count("*").alias("n")) for n in names
    ]


def definition_diff_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Changed sources and steps of the two versions, with the rows each has in its batch."""
    inputs1, inputs2 = (retail.retail_inputs(spark, folder, batch) for batch in (1, 2))
    v1, v2 = _pipelines(inputs1, inputs2)
    schema = "kind string, name string, position int, value string"
    changed = pipeline_diff(small_frame(spark, v1.rows(), schema), small_frame(spark, v2.rows(), schema))
    parts = [(r["kind"], r["name"]) for r in changed.select("kind", "name").collect()]  # of the definition
    made1 = _with_profit(commerce.compose(inputs1), commerce.SPEND_COLUMN)
    made2 = _with_profit(commerce.compose(inputs2, distinct_orders=True), commerce.REVISED_SPEND_COLUMN)
    for side, made in (("before", made1), ("after", made2)):
        counts = [_row_counts(made, kind, [name])[0] for kind, name in parts if name in made]
        counted = functools.reduce(DataFrame.unionAll, counts).withColumnRenamed("n", f"{side}_rows")
        changed = changed.join(counted, ["kind", "name"], "left")
    return changed.select("kind", "name", "change", "before_rows", "after_rows")


def schema_diff_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Changed columns of the two batches, with the number of values each holds."""
    batches = [retail.retail_inputs(spark, folder, batch) for batch in (1, 2)]
    changed = schema_diff(*[column_rows(spark, frames) for frames in batches])
    names: dict[str, list[str]] = {}
    for r in changed.select("source", "column").collect():  # of the schemas
        names.setdefault(r["source"], []).append(r["column"])
    for side, frames in zip(("before", "after"), batches):
        parts = []
        for source, columns in names.items():
            there = [c for c in columns if c in frames[source].columns]
            counts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n")) for c in there]
            held = frames[source].agg(F.array(*counts).alias("held")).select(F.inline("held"))
            parts.append(held.select(F.lit(source).alias("source"), "column", F.col("n").alias(f"{side}_values")))
        changed = changed.join(functools.reduce(DataFrame.unionAll, parts), ["source", "column"], "left")
    return changed.select("source", "column", "change", "before_type", "after_type", "before_values", "after_values")


def schema_contract(spark: SparkSession, folder: str) -> DataFrame:
    """A contract that asks for a renamed, an absent and a retyped column, with the rows concerned."""
    frames = retail.retail_inputs(spark, folder, 2)
    wanted = capture_contract(retail.retail_inputs(spark, folder, 1))
    wanted["orders"] |= {"ordered_at": "string", "shipped_at": "date"}
    broken = check_contract(contract_rows(spark, wanted), column_rows(spark, frames))
    concerned = {r["source"] for r in broken.select("source").collect()}
    rows = functools.reduce(
        DataFrame.unionAll, [frames[n].agg(F.lit(n).alias("source"), F.count("*").alias("rows")) for n in sorted(concerned)]
    )
    return broken.join(rows, "source")


def bad_column_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that a pivot of events by year and type would give, and those of the table itself."""
    events = _table(spark, folder, "events")
    kind = F.concat(F.date_format("ts", "yyyy"), F.lit("-"), F.col("event_type"))
    by_year = events.groupBy(kind.alias("column")).agg(F.count("*").alias("events"))
    columns = column_rows(spark, {"events": events}).select("source", "column").unionAll(
        by_year.select(F.lit("by_year"), "column")
    )
    return bad_columns(columns).join(by_year, "column", "left")


# --- sources and versions ---------------------------------------------------------------


def latest_event(spark: SparkSession, folder: str) -> DataFrame:
    newest = latest_rows(_table(spark, folder, "events"), ["user_id"], ["ts", "event_id"])
    return newest.select("user_id", "event_id", "event_type", "props")


def append_twice(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV export registered twice: known content gives back its one version."""
    ws = _workspace(spark)
    path = f"{scratch_path(spark, 'upload')}/orders.csv"
    export(_table(spark, folder, "orders"), path, "csv")
    first, second = (append_version(ws, "orders", path) for _ in range(2))
    same = F.lit(int(first["version_id"] == second["version_id"]))
    return list_versions(ws).select("source", "rows", "seq", same.alias("same"))


def newest_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Rows served from the profile of the newest version of a source, and its size."""
    ws = _workspace(spark)
    append_frames(ws, retail.load(spark, folder, "nation", "customer"))
    shown = version_sample(ws, "nation", 20).agg(F.count("*").alias("shown"))
    sizes = latest_versions(ws).select("source", "rows", F.size("sample").alias("kept"))
    return sizes.join(shown.withColumn("source", F.lit("nation")), "source", "left")


def version_history(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of three sources, one of them appended again: it stays the first version."""
    ws = _workspace(spark)
    names = ("orders", "attribution", "ad_spend")
    batches = [retail.retail_inputs(spark, folder, batch, *names) for batch in (1, 2)]
    for frames in (*batches, batches[0]):
        append_frames(ws, frames)
    newest = latest_versions(ws).select("version_id", F.lit(1).alias("latest"))
    history = list_versions(ws).join(newest, "version_id", "left")
    width, latest = F.size("profile").alias("width"), F.coalesce("latest", F.lit(0)).alias("latest")
    return history.select("source", "seq", "rows", width, latest)


def bind_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """A mapping with a missing, an extra and a foreign input."""
    ws = _workspace(spark)
    own = _version_ids(append_frames(ws, retail.retail_inputs(spark, folder, 1, "orders", "customers")))
    other = Workspace(spark, ws.root, "elsewhere")
    spend = retail.retail_inputs(spark, folder, 1, "ad_spend")["ad_spend"]
    foreign = append_frame(other, "ad_spend", spend)["version_id"]
    mapping = {"orders": own["orders"], "clients": own["customers"], "ad_spend": foreign}
    declared = small_frame(spark, [(n,) for n in ("orders", "customers", "ad_spend")], "input string")
    given = small_frame(spark, list(mapping.items()), "input string, version_id string")
    bound = bind_versions(declared, given, versions(ws))
    problem = F.coalesce("problem", F.lit("none")).alias("problem")
    return bound.select("input", problem, F.coalesce("rows", F.lit(0)).alias("rows"))


def fingerprint_tables(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, columns in oracles.FINGERPRINTED.items():
        content = md5_fingerprint(_table(spark, folder, name), columns)
        parts.append(content.select(F.lit(name).alias("table"), "rows", "hash_sum"))
    return functools.reduce(DataFrame.unionAll, parts)


def replay_equality(spark: SparkSession, folder: str) -> DataFrame:
    """The same step, computed under two partitionings, has one fingerprint."""
    items = costed_items(spark, folder)
    again = costed_items(spark, folder).repartition(5, "product_id")
    a, b = fingerprint(items), fingerprint(again)
    return a.join(b.withColumnRenamed("rows", "again"), "fingerprint", "left").select(
        "rows", (F.col("rows") == F.col("again")).cast("int").alias("same")
    )


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_path(spark, 'export')}/orders.csv"
    export(_table(spark, folder, "orders"), path, "csv")
    orders = read_source(spark, path)
    return orders.withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))


def csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line breaks and quotes, written as CSV and read back whole."""
    path = f"{scratch_path(spark, 'export')}/documents.csv"
    documents = _table(spark, folder, "documents")
    export(documents, path, "csv")
    again = read_source(spark, path, schema=documents.schema, multi_line=True)
    return again.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


# --- whole runs -------------------------------------------------------------------------


def _story(spark: SparkSession, folder: str):
    ws = _workspace(spark)
    inputs1, inputs2 = (retail.retail_inputs(spark, folder, batch) for batch in (1, 2))
    v1, v2 = _pipelines(inputs1, inputs2)
    first = _version_ids(append_frames(ws, inputs1))
    return ws, v1, v2, first, inputs2


def _tolerant(pipeline):
    """A copy in which an order without items only warns: some driver orders have none."""
    step = next(s for s in pipeline.steps if s.name == "attributed_orders")
    missing = "attributed_orders without revenue"
    checks = tuple(replace(k, severity="warning") if k.name == missing else k for k in step.checks)
    return pipeline.revise(replace(step, checks=checks))


def _report(ws: Workspace, run_id: str) -> DataFrame:
    numbers = ["rows", "checks", "blocking_failed", "warnings_failed"]
    return step_report(ws, run_id).select(
        "position", "step", "status", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers]
    )


def run_successful(spark: SparkSession, folder: str) -> DataFrame:
    ws, v1, _, first, _ = _story(spark, folder)
    return _report(ws, run_pipeline(ws, _tolerant(v1), first))


def run_failed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without items block the fifth step; its output and the earlier ones are kept."""
    ws, v1, _, first, _ = _story(spark, folder)
    return _report(ws, run_pipeline(ws, v1, first, profile_artifacts=False))


def run_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """The first recipe on the orders of the second batch: repeated order ids end the run."""
    ws, v1, _, first, inputs2 = _story(spark, folder)
    repeated = append_frame(ws, "orders", inputs2["orders"])["version_id"]
    return _report(ws, run_pipeline(ws, v1, first | {"orders": repeated}, profile_artifacts=False))


def run_report_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The check results of a blocked run, from its report."""
    ws, v1, _, first, inputs2 = _story(spark, folder)
    repeated = append_frame(ws, "orders", inputs2["orders"])["version_id"]
    run_id = run_pipeline(ws, v1, first | {"orders": repeated}, profile_artifacts=False)
    report = run_report(ws, run_id).select(F.col("status").alias("run_status"), F.explode("checks").alias("c"))
    return report.select(
        "run_status", "c.step", "c.name", "c.severity", "c.status", "c.violations", F.size("c.sample").alias("shown")
    )


def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Two successful runs, the second with the repaired recipe on new versions, compared."""
    ws, v1, v2, first, inputs2 = _story(spark, folder)
    second = _version_ids(append_frames(ws, inputs2))
    before = run_pipeline(ws, _tolerant(v1), first, profile_artifacts=False)
    after = run_pipeline(ws, _tolerant(v2), second, profile_artifacts=False)
    rows = compare_runs(ws, before, after, "channel", "contribution_profit").outputs
    return rows.select("key", *[(F.col(m) * 100).cast("bigint").alias(f"{m}_cents") for m in ("before", "after", "delta")])


def _sql_pipeline(checks: tuple = (), order_id: str = "bigint") -> Pipeline:
    """Steps of SQL text with parameters, over one source."""
    totals = "SELECT customer_id, count(*) * :factor AS scaled FROM orders GROUP BY customer_id"
    return Pipeline(
        "busy_customers",
        "Customers with many orders",
        sources={"orders": {"order_id": order_id, "customer_id": "bigint", "ordered_at": "date", "currency": "string"}},
        steps=(
            Step("totals", "Orders of each customer", ("orders",), sql=totals, checks=checks),
            Step("busy", "Customers with enough orders", ("totals",), sql="SELECT * FROM totals WHERE scaled >= :least"),
        ),
        output="busy",
        parameters={"factor": 1, "least": 10},
    )


def _sql_run(spark: SparkSession, folder: str, pipeline: Pipeline, parameters: dict | None = None) -> tuple[Workspace, str]:
    ws = _workspace(spark)
    bound = _version_ids(append_frames(ws, retail.retail_inputs(spark, folder, 1, "orders")))
    return ws, run_pipeline(ws, pipeline, bound, parameters, profile_artifacts=False)


def run_sql_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """The output of a run of SQL steps in which one parameter is given and one has its default."""
    return artifact(*_sql_run(spark, folder, _sql_pipeline(), {"factor": 3}), "busy")


def run_check_error(spark: SparkSession, folder: str) -> DataFrame:
    """A check that cannot run fails the run, although it only warns; the output is kept."""
    checks = (
        Check("Needs a column that is not there", sql="SELECT nothing FROM totals", severity="warning"),
        row_check("Customers with one order", "totals", "scaled = 1", severity="warning"),
    )
    ws, run_id = _sql_run(spark, folder, _sql_pipeline(checks))
    state = run_report(ws, run_id).first()["status"]
    made = artifact(ws, run_id, "totals").agg(F.count("*").alias("made"))
    found = run_table(ws, "checks", run_id).select(
        "step", "name", "severity", "status", F.coalesce("violations", F.lit(-1)).alias("violations"), F.lit(state).alias("run_status")
    )
    return found.withColumn("made", F.lit(made.first()["made"]))


def run_contract_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """A source of another type than its contract says: every step is skipped."""
    ws, run_id = _sql_run(spark, folder, _sql_pipeline(order_id="string"))
    bound = run_table(ws, "inputs", run_id).agg(F.sum("rows").alias("bound")).first()["bound"]
    return _report(ws, run_id).select("position", "step", "status", "rows", F.lit(bound).alias("bound"))


def run_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """A row recorded as evidence of a run; a run that did not succeed takes none."""
    ws, run_id = _sql_run(spark, folder, _sql_pipeline(), {"factor": 3})
    first = artifact(ws, run_id, "busy").agg(F.min("customer_id").alias("id")).first()["id"]
    record_evidence(ws, run_id, "busy", {"customer_id": first})
    _, failed = _sql_run(spark, folder, _sql_pipeline(order_id="string"))
    refused = 0
    try:
        record_evidence(ws, failed, "busy", {"customer_id": first})
    except ValueError:
        refused = 1
    row = F.from_json("evidence", "customer_id bigint, scaled bigint")
    told = run_table(ws, "findings", run_id).where("title = 'Selected evidence row'").select(row.alias("row"))
    return told.select("row.*", F.lit(refused).alias("refused"))


# --- growing sources and sketches -------------------------------------------------------


def stream_registration(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrive in four parts, some a part too late; the stream stops and goes on between them.

    ``same`` tells that the version of all parts is that of the rows in time, registered in one piece.
    """
    ws = _workspace(spark)
    events = _table(spark, folder, "events")
    part = F.floor((F.day("ts") - 1) / 8) + F.when(F.col("event_id") % 7 == 3, 1).otherwise(0)
    arriving = events.withColumn("part", F.least(part, F.lit(3)))
    landing = scratch_path(spark, "landing")
    arrivals = Arrivals(ws, "events", "ts", delay_seconds=2 * 86_400)
    for k in range(4):
        arriving.where(F.col("part") == k).drop("part").write.mode("append").parquet(landing)
        register_stream(arrivals, spark.readStream.schema(events.schema).parquet(landing)).awaitTermination()
    version = arrived_version(arrivals)
    missed = late_arrivals(arrivals).select("event_id").distinct()
    whole = append_frame(ws, "in_time", events.join(missed, "event_id", "left_anti").select(events.columns))
    same = F.lit(int(whole["digest"] == version["digest"] and whole["rows"] == version["rows"]))
    return commits(arrivals).select("batch_id", "rows", "late", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("watermark"), same.alias("same"))


def sketch_union(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct counts and medians of two versions together, from their sketches, beside exact ones."""
    ws = _workspace(spark)
    orders = _table(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date")).drop("o_orderdate")
    for kept in ("o_orderkey % 3 = 0", "o_orderkey % 3 <> 0"):
        append_frame(ws, "orders", orders.where(kept))
    answers = sketch_answers(merged_sketches(version_sketches(ws, "orders")), (0.5,))
    exact = value_counts(orders).join(small_frame(spark, list(enumerate(orders.columns)), "position int, column string"), "position")
    medians = {r["column"]: r["quantiles"][0] for r in answers.where("quantiles IS NOT NULL").select("column", "quantiles").collect()}
    places = {"day": F.unix_date("day").cast("double")}
    below = [F.struct(F.lit(c).alias("column"), (F.count_if(places.get(c, F.col(c)) <= m) / F.count(c)).alias("rank")) for c, m in sorted(medians.items())]
    ranks = orders.agg(F.array(*below).alias("r")).select(F.inline("r"))
    found = answers.withColumnRenamed("distinct", "estimate").join(exact.select("column", "distinct"), "column").join(ranks, "column", "left")
    return found.select(
        "column", "rows", "missing", "distinct",
        (F.abs(F.col("estimate") - F.col("distinct")) <= DISTINCT_ERROR * F.col("distinct")).cast("int").alias("distinct_within"),
        (F.abs(F.col("rank") - 0.5) <= RANK_ERROR + 0.02).cast("int").alias("median_within"),
    )


def nested_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Nested timestamps count by microsecond, and rows that differ by one are a new version."""
    ws = _workspace(spark)
    events = _table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    nested = lambda t: events.select(F.struct(t.alias("t")).alias("one"), F.array(t, t).alias("two"), F.create_map(F.lit("k"), t).alias("three"))
    later = F.col("ts") + F.expr("INTERVAL 0.000001 SECONDS")
    stored = {append_frame(ws, "nested", nested(t))["version_id"] for t in (F.col("ts"), later, F.col("ts"))}
    return value_counts(nested(F.col("ts"))).select("position", "rows", "distinct", F.lit(len(stored)).alias("versions"))


def ledger_format(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of orders, the first read by name through the data source: some columns, some rows."""
    ws = _workspace(spark)
    register_format(spark)
    orders = _table(spark, folder, "orders")
    first = append_frame(ws, "orders", orders)
    append_frame(ws, "orders", orders.where("o_orderkey % 2 = 0"))
    named = {"root": ws.root, "workspace": ws.workspace_id, "source": "orders"}
    reader = spark.read.format(FORMAT).options(**named)
    some = reader.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string").option("version", first["version_id"]).load()
    newest = spark.read.format(FORMAT).options(**named).load().where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(1).alias("newest"))
    held = some.where("o_orderstatus = 'O' AND o_custkey > 100")
    return held.join(newest, "o_orderkey", "left").withColumn("newest", F.coalesce("newest", F.lit(0)))


# --- joins and aggregates along an order ------------------------------------------------


def _crowded(key: str):
    """A third of the keys become one."""
    return F.when(F.col(key) % 3 == 0, 0).otherwise(F.col(key))


def as_of_price(spark: SparkSession, folder: str) -> DataFrame:
    """For each ordered item, the price that its part was last shipped for by the day of the order."""
    t = retail.load(spark, folder, "lineitem", "orders")
    items = t["lineitem"].withColumn("part", _crowded("l_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    known = items.select("part", F.col("l_shipdate").cast("date").alias("shipped"), cents.alias("cents"))
    asked = items.join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "part", F.col("o_orderdate").cast("date").alias("ordered")
    )
    found = as_of_join(asked, known, ["part"], ("ordered", "shipped"))
    return found.select("l_orderkey", "l_linenumber", "part", F.col("match.shipped").cast("string").alias("shipped"), "match.cents")


def range_join_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of orders of one customer, the second 1 to 30 days after the first."""
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    pairs = range_join(orders, orders, ["o_custkey"], ("day", "day"), before=-1, after=30)
    return pairs.select("left.o_custkey", "left.o_orderkey", F.col("right.o_orderkey").alias("next_orderkey"))


def running_revenue(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = orders.select("o_orderkey", _crowded("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"), cents.alias("cents"))
    return running_totals(rows, ["customer"], ["day", "o_orderkey"], "cents").select("o_orderkey", "customer", "running")


def percentiles_by_flag(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    items = _table(spark, folder, "lineitem").select("l_returnflag", cents.alias("cents"), F.col("l_quantity").cast("bigint").alias("quantity"))
    return exact_percentiles(items, ["l_returnflag"], ["cents", "quantity"], (0.1, 0.5, 0.95))


def grouping_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Every subset of three groups, one of which has nulls of its own."""
    items = _table(spark, folder, "lineitem").select(
        "l_returnflag", F.nullif("l_linestatus", F.lit("F")).alias("status"), F.year("l_shipdate").alias("year"),
        "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    by = ["l_returnflag", "status", "year"]
    return grouping_totals(items, by, all_subsets(by), ["quantity"], "l_partkey")


def multiset_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without a key, some dropped and some repeated on the other side, as nested rows."""
    items = _table(spark, folder, "lineitem")
    line = [F.col("l_returnflag").alias("flag"), F.array("l_partkey", F.col("l_quantity").cast("bigint")).alias("item")]
    after = items.where("l_linenumber <> 3").unionAll(items.where("l_linenumber = 5 AND l_returnflag = 'R'"))
    return multiset_diff(items.select(*line), after.select(*line))


def lineage_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that follow from orders: the next of the same customer, and for some the first again."""
    orders = _table(spark, folder, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    following = orders.select("o_custkey", F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(by).alias("next"), F.row_number().over(by).alias("n"))
    first = following.where("n = 1").select("o_custkey", F.col("source").alias("first"))
    again = F.when(F.col("o_custkey") % 10 == 0, F.col("first"))
    edges = following.join(first, "o_custkey").select("source", F.coalesce("next", again).alias("target"))
    pairs = reachable(edges)
    cycles = on_cycles(pairs).select(F.col("node").alias("source"), F.col("group").alias("cycle"))
    return pairs.join(cycles, "source", "left")


def top_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The three dearest orders of each customer, customers without one included."""
    t = retail.load(spark, folder, "customer", "orders")
    customers = t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    best = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    found = top_matches(customers, t["orders"].select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], best, 3)
    return found.select(F.col("o_custkey").alias("c_custkey"), "c_mktsegment", "rank", "match.o_orderkey")


_REGISTERED: dict[str, Query] = {
    "channel_profit": channel_profit,
    "channel_profit_recovered": channel_profit_recovered,
    "channel_profit_money": channel_profit_money,
    "clean_orders_distinct": clean_orders_distinct,
    "costed_items": costed_items,
    "order_margin": order_margin,
    "refund_totals": refund_totals,
    "attributed_orders": attributed_orders,
    "check_unique_key": check_unique_key,
    "check_duplicate_rows": check_duplicate_rows,
    "check_accepted_values": check_accepted_values,
    "check_not_null": check_not_null,
    "check_range": check_range,
    "check_join_grain": check_join_grain,
    "check_step_grain": check_step_grain,
    "check_orphans": check_orphans,
    "check_late_rows": check_late_rows,
    "check_missing_lookup": check_missing_lookup,
    "check_defaulted_category": check_defaulted_category,
    "check_summary": check_summary_repaired,
    "profile_counts": profile_counts,
    "profile_numeric": profile_numeric,
    "profile_nested": profile_nested,
    "profile_text": profile_text,
    "sample_rows": first_orders,
    "version_sample": newest_sample,
    "preview_bounded": preview_bounded,
    "preview_lists": preview_lists,
    "page_rows": page_rows,
    "page_deep": page_deep,
    "redact_text": redact_text,
    "param_scale": param_scale,
    "explore_group_count": explore_group_count,
    "run_status": run_status_of_checks,
    "top_finding": top_finding_profit,
    "top_finding_order": top_finding_order,
    "evidence_row": evidence_channel,
    "compare_outputs": compare_channels,
    "compare_orders": compare_orders,
    "compare_key_guard": compare_key_guard,
    "compare_unit_guard": compare_unit_guard,
    "compare_numeric_guard": compare_numeric_guard,
    "input_diff": input_diff_batches,
    "definition_diff": definition_diff_rows,
    "schema_diff": schema_diff_batches,
    "schema_contract": schema_contract,
    "bad_column_names": bad_column_names,
    "latest_rows": latest_event,
    "append_version": append_twice,
    "latest_versions": version_history,
    "bind_versions": bind_inputs,
    "fingerprint": fingerprint_tables,
    "replay_equality": replay_equality,
    "csv_round_trip": csv_round_trip,
    "csv_documents": csv_documents,
    "compare_exact": compare_exact,
    "run_sql_parameters": run_sql_parameters,
    "run_check_error": run_check_error,
    "run_contract_blocked": run_contract_blocked,
    "run_evidence": run_evidence,
    "run_successful": run_successful,
    "run_failed": run_failed,
    "run_blocked": run_blocked,
    "run_report": run_report_checks,
    "run_comparison": run_comparison,
    "stream_registration": stream_registration,
    "sketch_union": sketch_union,
    "nested_versions": nested_versions,
    "ledger_format": ledger_format,
    "as_of_price": as_of_price,
    "range_join_orders": range_join_orders,
    "running_revenue": running_revenue,
    "percentiles_by_flag": percentiles_by_flag,
    "grouping_cube": grouping_cube,
    "multiset_difference": multiset_difference,
    "lineage_closure": lineage_closure,
    "top_orders": top_orders,
}


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators, if that subpackage is there."""
    try:
        import corpus_pipeline
        from runledger.llm import queries as extra
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "runledger.llm", "runledger.llm.queries"):
            raise
        return {}, {}
    sql = dict(extra.ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**extra.QUERIES, "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Query]:
    """Every registered query by name; each takes (spark, folder of the tables)."""
    return {**_REGISTERED, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    """The SQL that gives the same rows, for each registered query that SQL can express."""
    return {**oracles.oracle_sql(), **_training_data()[1]}
