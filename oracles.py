"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

TOKEN_PATTERN = '"[0-9a-f]{40}"'
SOURCES = ("orders", "order_items", "customers", "attribution", "ad_spend", "product_costs", "refunds")
FINGERPRINTED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

_ITEM_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"
)


def _cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def _attributed(orders: str, attribution: str, refunds: str) -> str:
    return f"""
    SELECT o.order_id, coalesce(a.channel, 'Unattributed') AS channel, m.revenue_cents, m.cost_cents,
           coalesce(r.refund_cents, 0) AS refund_cents
    FROM {orders} o LEFT JOIN customers c ON o.customer_id = c.customer_id
    LEFT JOIN {attribution} a ON a.customer_id = c.customer_id
    LEFT JOIN margin m ON m.order_id = o.order_id
    LEFT JOIN {refunds} r ON r.order_id = o.order_id"""


def _channels(attributed: str, spend: str, column: str) -> str:
    return f"""
    SELECT channel, orders, revenue_cents, cost_cents, refund_cents, ad_spend_cents,
           revenue_cents - cost_cents - refund_cents - ad_spend_cents AS profit_cents
    FROM (SELECT coalesce(s.channel, p.channel) AS channel, coalesce(orders, 0) AS orders,
                 coalesce(rev, 0)::BIGINT AS revenue_cents, coalesce(cost, 0)::BIGINT AS cost_cents,
                 coalesce(ref, 0)::BIGINT AS refund_cents, coalesce(spent, 0)::BIGINT AS ad_spend_cents
          FROM (SELECT channel, count(*) AS orders, sum(revenue_cents) AS rev, sum(cost_cents) AS cost,
                       sum(refund_cents) AS ref FROM {attributed} GROUP BY channel) s
          FULL JOIN (SELECT channel, sum({column}) AS spent FROM {spend} GROUP BY channel) p
          ON s.channel = p.channel)"""


_BASE = f"""
WITH orders1 AS (
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate::DATE AS ordered_at, 'USD' AS currency
    FROM orders),
orders2 AS (
    SELECT * FROM orders1 UNION ALL
    SELECT o_orderkey, o_custkey, o_orderdate::DATE, 'USD' FROM orders WHERE o_orderstatus = 'P'),
clean2 AS (SELECT DISTINCT * FROM orders2),
order_items AS (
    SELECT {_ITEM_ID} AS item_id, l_orderkey AS order_id, l_partkey AS product_id,
           l_quantity::BIGINT AS quantity, {_cents('l_extendedprice')} AS unit_price_cents FROM lineitem),
product_costs AS (
    SELECT p_partkey AS product_id, {_cents('p_retailprice')} AS unit_cost_cents, 'USD' AS currency FROM part),
customers AS (SELECT c_custkey AS customer_id, c_nationkey::VARCHAR AS region FROM customer),
attribution1 AS (SELECT c_custkey AS customer_id, c_mktsegment AS channel FROM customer),
attribution2 AS (SELECT c_custkey AS customer_id, c_mktsegment AS channel FROM customer WHERE c_nationkey <> 24),
spend1 AS (
    SELECT 'S' || s_suppkey AS spend_id,
           CASE WHEN n_nationkey = 24 THEN 'AFFILIATES' WHEN n_regionkey = 0 THEN 'AUTOMOBILE'
                WHEN n_regionkey = 1 THEN 'BUILDING' WHEN n_regionkey = 2 THEN 'FURNITURE'
                WHEN n_regionkey = 3 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS channel,
           abs({_cents('s_acctbal')}) AS amount_cents, 'USD' AS currency
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
spend2 AS (
    SELECT spend_id, channel, currency,
           amount_cents + CASE WHEN channel = 'BUILDING' THEN 4000 ELSE 0 END AS spend_cents FROM spend1),
refunds1 AS (
    SELECT {_ITEM_ID} AS refund_id, l_orderkey AS order_id, {_cents('l_extendedprice')} AS amount_cents,
           'USD' AS currency, l_shipdate::DATE AS received_at FROM lineitem WHERE l_returnflag = 'R'),
refunds2 AS (
    SELECT * FROM refunds1 UNION ALL
    SELECT 'credit-' || s_suppkey, -s_suppkey, abs({_cents('s_acctbal')}), 'USD', DATE '2001-01-01' FROM supplier),
costed AS (
    SELECT i.*, c.unit_cost_cents, c.currency AS cost_currency
    FROM order_items i LEFT JOIN product_costs c ON i.product_id = c.product_id),
margin AS (
    SELECT order_id, sum(quantity * unit_price_cents)::BIGINT AS revenue_cents,
           sum(quantity * unit_cost_cents)::BIGINT AS cost_cents FROM costed GROUP BY order_id),
totals1 AS (SELECT order_id, sum(amount_cents)::BIGINT AS refund_cents FROM refunds1 GROUP BY order_id),
totals2 AS (SELECT order_id, sum(amount_cents)::BIGINT AS refund_cents FROM refunds2 GROUP BY order_id),
attributed1 AS ({_attributed('orders1', 'attribution1', 'totals1')}),
attributed2 AS ({_attributed('clean2', 'attribution2', 'totals2')}),
mixed AS ({_attributed('orders2', 'attribution2', 'totals2')}),
channels1 AS ({_channels('attributed1', 'spend1', 'amount_cents')}),
channels2 AS ({_channels('attributed2', 'spend2', 'spend_cents')}),
late2 AS (
    SELECT r.* FROM refunds2 r JOIN clean2 o ON r.order_id = o.order_id
    WHERE r.received_at > o.ordered_at + INTERVAL 14 DAY)
"""


def _copies(table: str, key: str, rule: str = "<> 1") -> str:
    return f"SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) {rule})"


def _bad(table: str, condition: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {condition}"


def _grain(table: str, source: str) -> str:
    return f"SELECT CASE WHEN (SELECT count(*) FROM {table}) <> (SELECT count(*) FROM {source}) THEN 1 ELSE 0 END"


_STEPS = ("clean_orders", "costed_items", "order_margin", "refund_totals", "attributed_orders", "channel_profit")
_PRICES = "(quantity > 0 AND unit_price_cents >= 0 AND unit_cost_cents >= 0 AND cost_currency = 'USD') IS NOT TRUE"


def _checks(orders: str, clean: str, refunds: str, attribution: str, attributed: str, spend: str, amount: str):
    """The 18 checks as (step, name, severity, count of violations)."""
    late = (
        f"SELECT count(*) FROM {refunds} r JOIN (SELECT order_id, min(ordered_at) AS d FROM {clean} GROUP BY order_id) o "
        "ON r.order_id = o.order_id WHERE r.received_at > o.d + INTERVAL 14 DAY"
    )
    return [
        ("clean_orders", "clean_orders repeats no order_id", "blocking", _copies(clean, "order_id")),
        ("clean_orders", "clean_orders has ids and USD", "blocking", _bad(clean, "(currency = 'USD' AND order_id IS NOT NULL AND customer_id IS NOT NULL) IS NOT TRUE")),
        ("clean_orders", "orders repeats some order_id", "warning", _copies(orders, "order_id", "> 1")),
        ("costed_items", "product_costs repeats no product_id", "blocking", _copies("product_costs", "product_id")),
        ("costed_items", "costed_items has the rows of order_items", "blocking", _grain("costed", "order_items")),
        ("costed_items", "costed_items repeats no item_id", "blocking", _copies("costed", "item_id")),
        ("costed_items", "costed_items has amounts and USD costs", "blocking", _bad("costed", _PRICES)),
        ("refund_totals", "refunds whose order_id is not in clean_orders", "warning", _bad(refunds, f"order_id NOT IN (SELECT order_id FROM {clean})")),
        ("refund_totals", "refunds dated after the due date", "warning", late),
        ("refund_totals", "refunds repeats no refund_id", "blocking", _copies(refunds, "refund_id")),
        ("refund_totals", "refunds is in USD and not below zero", "blocking", _bad(refunds, "(amount_cents >= 0 AND currency = 'USD') IS NOT TRUE")),
        ("attributed_orders", "attributed_orders has the rows of clean_orders", "blocking", _grain(attributed, clean)),
        ("attributed_orders", "customers repeats no customer_id", "blocking", _copies("customers", "customer_id")),
        ("attributed_orders", "attribution repeats no customer_id", "blocking", _copies(attribution, "customer_id")),
        ("attributed_orders", "attributed_orders without revenue", "blocking", _bad(attributed, "revenue_cents IS NULL")),
        ("attributed_orders", "attributed_orders without a channel", "warning", _bad(attributed, "channel = 'Unattributed'")),
        ("channel_profit", "ad_spend is in USD and not below zero", "blocking", _bad(spend, f"({amount} >= 0 AND currency = 'USD') IS NOT TRUE")),
        ("channel_profit", "ad_spend repeats no spend_id", "blocking", _copies(spend, "spend_id")),
    ]


_FIRST = _checks("orders1", "orders1", "refunds1", "attribution1", "attributed1", "spend1", "amount_cents")
_BLOCKED = _checks("orders2", "orders2", "refunds2", "attribution2", "mixed", "spend1", "amount_cents")
_REPAIRED = _checks("orders2", "clean2", "refunds2", "attribution2", "attributed2", "spend2", "spend_cents")


def _tolerant(checks):
    return [
        (step, name, "warning" if name == "attributed_orders without revenue" else severity, count)
        for step, name, severity, count in checks
    ]


def _check_rows(checks) -> str:
    rows = [
        f"SELECT '{step}' AS step, '{name}' AS \"check\", '{severity}' AS severity, ({count}) AS violations"
        for step, name, severity, count in checks
    ]
    return f"""SELECT *, CASE WHEN violations = 0 THEN 'passed' ELSE 'failed' END AS status
               FROM ({' UNION ALL '.join(rows)})"""


def _run_states() -> str:
    parts = []
    for run, checks in (("first", _FIRST), ("blocked", _BLOCKED), ("repaired", _REPAIRED)):
        for position, step in enumerate(_STEPS):
            blocking = [count for s, _, severity, count in checks if s == step and severity == "blocking"]
            total = " + ".join(f"({count})" for count in blocking) or "0"
            parts.append(f"SELECT '{run}' AS run_id, {position} AS position, '{step}' AS step, {total} AS bad")
    return f"""
    , judged AS (SELECT *, sum(bad) OVER (PARTITION BY run_id ORDER BY position
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
                 sum(bad) OVER (PARTITION BY run_id) AS overall FROM ({' UNION ALL '.join(parts)}))
    SELECT run_id, position, step,
           CASE WHEN earlier > 0 THEN 'skipped' WHEN bad > 0 THEN 'failed' ELSE 'successful' END AS status,
           CASE WHEN overall > 0 THEN 'failed' ELSE 'successful' END AS run_status FROM judged"""


def _run_checks() -> str:
    """Check results of a run that ends at its first step."""
    contracts = " UNION ALL ".join(
        f"SELECT '__inputs__' AS step, 'Source contract: {source}' AS \"check\", 'blocking' AS severity, "
        "0 AS violations, 'passed' AS status"
        for source in SOURCES
    )
    return f"""SELECT 'failed' AS run_status, step, "check" AS name, severity, status, violations,
               least(violations, 20) AS shown FROM (({_check_rows(_BLOCKED[:3])}) UNION ALL {contracts})"""


def _hash_sum(columns: list[str]) -> str:
    texts = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"sum(('0x' || substr(md5({texts}), 1, 15))::BIGINT)::VARCHAR"


_INPUT_COLUMNS = {
    "orders": ("orders1", "orders2", ["order_id", "customer_id", "ordered_at", "currency"]),
    "attribution": ("attribution1", "attribution2", ["customer_id", "channel"]),
    "refunds": ("refunds1", "refunds2", ["refund_id", "order_id", "amount_cents", "currency", "received_at"]),
}


def _input_diff() -> str:
    parts = [
        f"SELECT '{name}' AS source, (SELECT {_hash_sum(columns)} FROM {a}) AS before_version_id, "
        f"(SELECT {_hash_sum(columns)} FROM {b}) AS after_version_id, 1 AS content_changed, 0 AS schema_changed"
        for name, (a, b, columns) in _INPUT_COLUMNS.items()
    ]
    before = _hash_sum(["spend_id", "channel", "amount_cents", "currency"])
    after = _hash_sum(["spend_id", "channel", "currency", "spend_cents"])
    parts.append(f"SELECT 'ad_spend', (SELECT {before} FROM spend1), (SELECT {after} FROM spend2), 1, 1")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE before_version_id <> after_version_id"


def _counts(columns: dict[str, str], table: str, label: str = "column") -> str:
    parts = [
        f"SELECT {name} AS \"{label}\", count(*) AS \"rows\", count(*) - count({c}) AS missing, "
        f"count(DISTINCT {c}) AS \"distinct\" FROM {table}"
        for c, name in columns.items()
    ]
    return " UNION ALL ".join(parts)


def _profile_counts() -> str:
    columns = [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    return f"SELECT *, 0 AS nans FROM ({_counts({c: repr(c) for c in columns}, 'lineitem')})"


def _by_position(table: str, columns: list[str]) -> str:
    return _counts({c: str(i) for i, c in enumerate(columns)}, table, "position")


def _numeric() -> str:
    columns = [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    ]
    parts = [
        f"SELECT {i} AS position, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", "
        f"round(avg({c}), 4) AS mean FROM lineitem"
        for i, c in enumerate(columns)
    ]
    return " UNION ALL ".join(parts)


def _redacted() -> str:
    keyed = "text || ' sk-' || md5(doc_id::VARCHAR) || ' end'"
    secrets = f"regexp_replace({keyed}, 'sk-[A-Za-z0-9_-]+', '[redacted]', 'g')"
    whole = f"regexp_replace({secrets}, '{TOKEN_PATTERN}', '[redacted]', 'g')"
    return f"""SELECT doc_id, {whole} AS redacted, len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS secrets FROM documents"""


def _finding(table: str, label: str, metric: str, unit: str, words: str, shown: str) -> str:
    return f"""
    SELECT label || ' has the highest {words}' AS title,
           {unit} || ' ' || format('{{:,.2f}}', value::DOUBLE) || ', the maximum of all ' ||
           format('{{:,}}', n) || ' rows.' AS detail,
           label, {shown} AS metric, {unit} AS unit, n AS "rows"
    FROM (SELECT {label}::VARCHAR AS label, {metric} AS value, (SELECT count(*) FROM {table}) AS n
          FROM {table} ORDER BY {metric} DESC, {label} LIMIT 1)"""


def _definition_diff() -> str:
    rows = [
        ("source", "ad_spend", "spend1", "spend2"),
        ("step", "clean_orders", "orders1", "clean2"),
        ("step", "channel_profit", "channels1", "channels2"),
    ]
    parts = [
        f"SELECT '{kind}' AS kind, '{name}' AS name, 'changed' AS change, "
        f"(SELECT count(*) FROM {a}) AS before_rows, (SELECT count(*) FROM {b}) AS after_rows"
        for kind, name, a, b in rows
    ]
    parts.append("SELECT 'assumption', '6', 'changed', NULL, NULL")
    return " UNION ALL ".join(parts)


def _schema_diff() -> str:
    return """
    SELECT 'ad_spend' AS source, 'amount_cents' AS "column", 'removed' AS change, 'bigint' AS before_type,
           NULL AS after_type, (SELECT count(amount_cents) FROM spend1) AS before_values, NULL AS after_values
    UNION ALL SELECT 'ad_spend', 'spend_cents', 'added', NULL, 'bigint', NULL, (SELECT count(spend_cents) FROM spend2)
    UNION ALL SELECT 'ad_spend', 'currency', 'moved', 'string', 'string',
           (SELECT count(currency) FROM spend1), (SELECT count(currency) FROM spend2)"""


def _schema_contract() -> str:
    return """
    SELECT 'ad_spend' AS source, 'amount_cents' AS "column", 'bigint' AS expected, NULL AS actual,
           (SELECT count(*) FROM spend2) AS "rows"
    UNION ALL SELECT 'orders', 'ordered_at', 'string', 'date', (SELECT count(*) FROM orders2)
    UNION ALL SELECT 'orders', 'shipped_at', 'date', NULL, (SELECT count(*) FROM orders2)"""


def _version_history() -> str:
    parts = [
        f"SELECT '{name}' AS source, {seq} AS seq, (SELECT count(*) FROM {name if name != 'ad_spend' else 'spend'}{seq}) "
        f"AS \"rows\", {width} AS width, {seq - 1} AS latest"
        for name, width in (("orders", 4), ("attribution", 2), ("ad_spend", 4))
        for seq in (1, 2)
    ]
    return " UNION ALL ".join(parts)


def _fingerprints() -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", count(*) AS \"rows\", {_hash_sum(columns)} AS hash_sum FROM {table}"
        for table, columns in FINGERPRINTED.items()
    )


_STEP_TABLES = {
    "clean_orders": "orders1",
    "costed_items": "costed",
    "order_margin": "margin",
    "refund_totals": "totals1",
    "attributed_orders": "attributed1",
    "channel_profit": "channels1",
}


def _run_report(checks, first_table: str) -> str:
    """Steps of a run that ends at its first step with a blocking failure."""
    parts = []
    for position, step in enumerate(_STEPS):
        own = [(severity, count) for s, _, severity, count in checks if s == step]
        failed = {
            kind: " + ".join(f"(({count}) > 0)::BIGINT" for severity, count in own if severity == kind) or "0"
            for kind in ("blocking", "warning")
        }
        table = first_table if step == "clean_orders" else _STEP_TABLES[step]
        parts.append(
            f"SELECT {position} AS position, '{step}' AS step, (SELECT count(*) FROM {table}) AS made, "
            f"{len(own)} AS checks, {failed['blocking']} AS blocking_failed, {failed['warning']} AS warnings_failed"
        )
    return f"""
    , reported AS (SELECT *, coalesce(sum(blocking_failed) OVER (ORDER BY position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM ({' UNION ALL '.join(parts)}))
    SELECT position, step,
           CASE WHEN earlier > 0 THEN 'skipped' WHEN blocking_failed > 0 THEN 'failed' ELSE 'successful' END AS status,
           CASE WHEN earlier > 0 THEN 0 ELSE made END AS "rows", CASE WHEN earlier > 0 THEN 0 ELSE checks END AS checks,
           (CASE WHEN earlier > 0 THEN 0 ELSE blocking_failed END)::BIGINT AS blocking_failed,
           (CASE WHEN earlier > 0 THEN 0 ELSE warnings_failed END)::BIGINT AS warnings_failed
    FROM reported"""


def _money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(20,0)) / 100 AS DECIMAL(18,2))::VARCHAR"


_MARKER = "… [preview truncated]"

# Queries over the commerce inputs; the common tables are put in front.
_COMMERCE = {
    "channel_profit": "SELECT * FROM channels1",
    "channel_profit_recovered": "SELECT * FROM channels2",
    "channel_profit_money": f"""SELECT channel, 'USD' AS currency, orders, {_money('revenue_cents')} AS revenue,
        {_money('cost_cents')} AS product_costs, {_money('refund_cents')} AS refunds,
        {_money('ad_spend_cents')} AS ad_spend, {_money('profit_cents')} AS contribution_profit FROM channels1""",
    "clean_orders_distinct": "SELECT order_id, customer_id, ordered_at::VARCHAR AS ordered_at, currency FROM clean2",
    "costed_items": "SELECT * FROM costed",
    "order_margin": "SELECT * FROM margin",
    "refund_totals": "SELECT * FROM totals2",
    "attributed_orders": "SELECT * FROM attributed2",
    "check_duplicate_rows": """SELECT order_id, customer_id, ordered_at::VARCHAR AS ordered_at, currency,
        count(*) AS copies FROM orders2 GROUP BY ALL HAVING count(*) > 1""",
    "check_not_null": "SELECT * FROM attributed1 WHERE revenue_cents IS NULL OR cost_cents IS NULL",
    "check_join_grain": """SELECT * FROM (SELECT
        (SELECT count(*) FROM order_items i LEFT JOIN orders2 o ON i.order_id = o.order_id) AS actual,
        (SELECT count(*) FROM order_items) AS expected) WHERE actual <> expected""",
    "check_step_grain": """SELECT * FROM (SELECT (SELECT count(*) FROM attributed2) AS actual,
        (SELECT count(*) FROM orders2) AS expected) WHERE actual <> expected""",
    "check_late_rows": """SELECT refund_id, order_id, amount_cents, currency, received_at::VARCHAR AS received_at
        FROM late2""",
    "check_defaulted_category": "SELECT order_id, channel FROM attributed2 WHERE channel = 'Unattributed'",
    "check_summary": _check_rows(_REPAIRED),
    "param_scale": """SELECT order_id, count(*) AS items, sum(quantity * 3)::BIGINT AS scaled FROM order_items
        WHERE unit_price_cents >= 100000 GROUP BY order_id""",
    "run_status": _run_states(),
    "top_finding": _finding(
        "channels1", "channel", "profit_cents", "'USD'", "contribution profit", _money("value")
    ).replace("format('{:,.2f}', value::DOUBLE)", "format('{:,.2f}', value::DOUBLE / 100)"),
    "top_finding_order": _finding(
        "(SELECT order_id, revenue_cents - cost_cents AS margin_cents FROM margin)",
        "order_id", "margin_cents", "'USD'", "margin cents", "value::VARCHAR",
    ),
    "evidence_row": "SELECT * FROM channels1 WHERE channel = 'BUILDING'",
    "compare_outputs": """SELECT coalesce(a.channel, b.channel) AS key, coalesce(a.profit_cents, 0) AS before,
        coalesce(b.profit_cents, 0) AS after, coalesce(b.profit_cents, 0) - coalesce(a.profit_cents, 0) AS delta,
        a.orders AS before_orders, b.orders AS after_orders
        FROM channels1 a FULL JOIN channels2 b ON a.channel = b.channel""",
    "compare_orders": """SELECT coalesce(a.order_id, b.order_id) AS key, coalesce(a.refund_cents, 0) AS before,
        coalesce(b.refund_cents, 0) AS after, coalesce(b.refund_cents, 0) - coalesce(a.refund_cents, 0) AS delta
        FROM totals1 a FULL JOIN totals2 b ON a.order_id = b.order_id""",
    "compare_key_guard": """SELECT 'after' AS side, order_id AS key, count(*) AS copies FROM orders2
        GROUP BY order_id HAVING count(*) > 1""",
    "compare_unit_guard": """SELECT order_id AS key, 'USD' AS before_unit, 'EUR' AS after_unit
        FROM orders1 JOIN customer ON customer_id = c_custkey WHERE c_nationkey = 24""",
    "input_diff": _input_diff(),
    "definition_diff": _definition_diff(),
    "schema_diff": _schema_diff(),
    "schema_contract": _schema_contract(),
    "latest_versions": _version_history(),
    "bind_versions": """SELECT 'orders' AS input, 'none' AS problem, (SELECT count(*) FROM orders1) AS "rows"
        UNION ALL SELECT 'customers', 'missing', 0
        UNION ALL SELECT 'clients', 'extra', (SELECT count(*) FROM customers)
        UNION ALL SELECT 'ad_spend', 'foreign', 0""",
    "replay_equality": 'SELECT count(*) AS "rows", 1 AS same FROM costed',
    "run_successful": _run_report(_tolerant(_FIRST), "orders1"),
    "run_failed": _run_report(_FIRST, "orders1"),
    "run_report": _run_checks(),
    "run_blocked": _run_report(_BLOCKED, "orders2"),
    "run_comparison": """SELECT coalesce(a.channel, b.channel) AS key, coalesce(a.profit_cents, 0) AS before_cents,
        coalesce(b.profit_cents, 0) AS after_cents,
        coalesce(b.profit_cents, 0) - coalesce(a.profit_cents, 0) AS delta_cents
        FROM channels1 a FULL JOIN channels2 b ON a.channel = b.channel""",
}

_BUSY = "SELECT customer_id, count(*) * 3 AS scaled FROM orders1 GROUP BY customer_id HAVING count(*) * 3 >= 10"
_MADE = "(SELECT count(DISTINCT customer_id) FROM orders1)"
_BOUND = "(SELECT count(*) FROM orders1)"
_COMMERCE |= {
    "run_sql_parameters": _BUSY,
    "run_evidence": f"SELECT *, 1 AS refused FROM ({_BUSY}) ORDER BY customer_id LIMIT 1",
    "run_contract_blocked": f"""SELECT 0 AS position, 'totals' AS step, 'skipped' AS status, 0 AS "rows", {_BOUND} AS bound
        UNION ALL SELECT 1, 'busy', 'skipped', 0, {_BOUND}""",
    "run_check_error": f"""SELECT '__inputs__' AS step, 'Source contract: orders' AS name, 'blocking' AS severity,
        'passed' AS status, 0 AS violations, 'failed' AS run_status, {_MADE} AS made
        UNION ALL SELECT 'totals', 'Needs a column that is not there', 'warning', 'error', -1, 'failed', {_MADE}
        UNION ALL SELECT 'totals', 'Customers with one order', 'warning',
            CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END, n, 'failed', {_MADE}
        FROM (SELECT count(*) AS n FROM (SELECT customer_id FROM orders1 GROUP BY customer_id HAVING count(*) = 1))""",
}

# Queries over the driver tables as they are.
_DIRECT = {
    "check_unique_key": """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) <> 1""",
    "check_accepted_values": """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem
        WHERE l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N') OR l_orderkey IS NULL OR l_partkey IS NULL""",
    "check_range": """SELECT 'customer' AS party, c_custkey AS party_id, c_nationkey FROM customer
        WHERE c_acctbal IS NULL OR c_acctbal < 0
        UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier WHERE s_acctbal IS NULL OR s_acctbal < 0""",
    "check_orphans": """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
        LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL""",
    "check_missing_lookup": """SELECT d.doc_id, lang, source, n_chars FROM documents d
        LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL""",
    "profile_counts": _profile_counts(),
    "profile_numeric": _numeric(),
    "profile_nested": _by_position("embeddings", ["vec_id", "embedding", "label"]),
    "profile_text": _by_position("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
    "sample_rows": """SELECT o_orderkey, o_custkey, o_orderdate::DATE::VARCHAR AS day FROM orders
        ORDER BY o_orderdate, o_orderkey LIMIT 20""",
    "version_sample": """SELECT 'nation' AS source, count(*) AS "rows", least(count(*), 30) AS kept,
        least(count(*), 20) AS shown FROM nation
        UNION ALL SELECT 'customer', count(*), least(count(*), 30), NULL FROM customer""",
    "preview_bounded": f"""SELECT doc_id, CASE WHEN length(text) > 2000
        THEN substring(text, 1, 2000) || '{_MARKER}' ELSE text END AS text, lang, source, n_chars FROM documents""",
    "preview_lists": """SELECT vec_id, len(embedding[1:50]) AS items,
        round(list_sum([x::DOUBLE for x in embedding[1:50]]), 4) AS total, label FROM embeddings""",
    "page_rows": """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
        ORDER BY o_orderkey LIMIT 100 OFFSET 700""",
    "page_deep": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS shipped
        FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 100 OFFSET 30000""",
    "redact_text": _redacted(),
    "explore_group_count": """SELECT d.source, d.lang, l.quality, count(*) AS documents, sum(d.n_chars)::BIGINT AS chars
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source, d.lang, l.quality""",
    "compare_exact": """SELECT o_orderkey AS key, round(o_totalprice * 100)::BIGINT AS before, o_custkey AS after,
        o_custkey - round(o_totalprice * 100)::BIGINT AS delta FROM orders""",
    "csv_documents": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents",
    "compare_numeric_guard": """SELECT 'after' AS side, o_orderkey AS key, o_orderpriority AS value FROM orders
        WHERE o_orderstatus = 'P'""",
    "bad_column_names": """SELECT 'by_year' AS source, "column", 'not an identifier' AS problem, count(*) AS events
        FROM (SELECT strftime(ts, '%Y') || '-' || event_type AS "column" FROM events) GROUP BY "column" """,
    "latest_rows": """SELECT user_id, event_id, event_type, props FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
        WHERE n = 1""",
    "append_version": "SELECT 'orders' AS source, count(*) AS \"rows\", 1 AS seq, 1 AS same FROM orders",
    "fingerprint": _fingerprints(),
    "csv_round_trip": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        o_orderdate::DATE::VARCHAR AS o_orderdate, o_orderpriority FROM orders""",
}

_LINES = "SELECT l_returnflag AS flag, l_partkey AS part, l_quantity::BIGINT AS quantity"
_CROWDED = "CASE WHEN {0} % 3 = 0 THEN 0 ELSE {0} END"

_ORDERED = {
    "stream_registration": """WITH arrived AS (
            SELECT ts, least(3, (day(ts) - 1) // 8 + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END) AS batch_id FROM events),
        newest AS (SELECT batch_id, max(ts) AS newest FROM arrived GROUP BY batch_id),
        marks AS (SELECT batch_id, max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            - INTERVAL 2 DAY AS w FROM newest)
        SELECT batch_id, count(*) FILTER (WHERE w IS NULL OR ts >= w) AS "rows", count(*) FILTER (WHERE ts < w) AS late,
            strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS watermark, 1 AS same
        FROM arrived JOIN marks USING (batch_id) GROUP BY batch_id, w""",
    "sketch_union": " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(*) AS "rows", count(*) - count({value}) AS missing, count(DISTINCT {value}) AS "distinct",
            1 AS distinct_within, {median} AS median_within FROM orders"""
        for name, value, median in (
            ("o_orderkey", "o_orderkey", "1"), ("o_custkey", "o_custkey", "1"), ("o_orderstatus", "o_orderstatus", "NULL"),
            ("o_totalprice", "o_totalprice", "1"), ("o_orderpriority", "o_orderpriority", "NULL"), ("day", "o_orderdate::DATE", "1"),
        )
    ),
    "nested_versions": """SELECT unnest([0, 1, 2]) AS position, count(*) AS "rows", count(DISTINCT ts) AS "distinct", 2 AS versions FROM events""",
    "ledger_format": """SELECT o_orderkey, o_custkey, o_orderstatus,
        CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS newest
        FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 100""",
    "as_of_price": f"""WITH known AS (
            SELECT {_CROWDED.format('l_partkey')} AS part, l_shipdate::DATE AS shipped, max({_cents('l_extendedprice')}) AS cents FROM lineitem GROUP BY ALL),
        asked AS (SELECT l_orderkey, l_linenumber, {_CROWDED.format('l_partkey')} AS part, o_orderdate::DATE AS ordered
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT l_orderkey, l_linenumber, a.part, shipped::VARCHAR AS shipped, cents
        FROM asked a ASOF LEFT JOIN known k ON a.part = k.part AND a.ordered >= k.shipped""",
    "range_join_orders": """SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS next_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
        AND b.o_orderdate::DATE BETWEEN a.o_orderdate::DATE + 1 AND a.o_orderdate::DATE + 30""",
    "running_revenue": f"""SELECT o_orderkey, {_CROWDED.format('o_custkey')} AS customer,
        (sum({_cents('o_totalprice')}) OVER (PARTITION BY {_CROWDED.format('o_custkey')} ORDER BY o_orderdate::DATE, o_orderkey
         ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM orders""",
    "percentiles_by_flag": " UNION ALL ".join(
        f"""SELECT l_returnflag, '{name}' AS "column", unnest([0.1, 0.5, 0.95])::DOUBLE AS share, count(*) AS n,
            unnest(quantile_disc({value}, [0.1, 0.5, 0.95])) AS value FROM lineitem GROUP BY l_returnflag"""
        for name, value in (("cents", _cents("l_extendedprice")), ("quantity", "l_quantity::BIGINT"))
    ),
    "grouping_cube": """SELECT l_returnflag, status, year, grouping(l_returnflag, status, year) AS "grouping", count(*) AS "rows",
        sum(quantity)::BIGINT AS sum_quantity, count(DISTINCT l_partkey) AS distinct_l_partkey
        FROM (SELECT l_returnflag, nullif(l_linestatus, 'F') AS status, year(l_shipdate) AS year, l_partkey, l_quantity::BIGINT AS quantity FROM lineitem)
        GROUP BY CUBE (l_returnflag, status, year)""",
    "multiset_difference": f"""WITH a AS (SELECT flag, part, quantity, count(*) AS n FROM ({_LINES} FROM lineitem) GROUP BY ALL),
        b AS (SELECT flag, part, quantity, count(*) AS n FROM ({_LINES} FROM lineitem WHERE l_linenumber <> 3
            UNION ALL {_LINES} FROM lineitem WHERE l_linenumber = 5 AND l_returnflag = 'R') GROUP BY ALL)
        SELECT CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'before' ELSE 'after' END AS side,
            abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS copies, '{{"flag":"' || flag || '","item":[' || part || ',' || quantity || ']}}' AS "row"
        FROM a FULL JOIN b USING (flag, part, quantity) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "lineage_closure": """WITH RECURSIVE following AS (
            SELECT o_custkey, o_orderkey AS source, lead(o_orderkey) OVER w AS next, first_value(o_orderkey) OVER w AS first
            FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        edges AS (SELECT source, coalesce(next, CASE WHEN o_custkey % 10 = 0 THEN first END) AS target FROM following),
        pairs AS (SELECT source, target FROM edges WHERE target IS NOT NULL
            UNION SELECT p.source, e.target FROM pairs p JOIN edges e ON p.target = e.source WHERE e.target IS NOT NULL),
        placed AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
            count(*) OVER (PARTITION BY o_custkey) AS size, min(o_orderkey) OVER (PARTITION BY o_custkey) AS least FROM orders)
        SELECT p.source, p.target, CASE WHEN b.n > a.n THEN b.n - a.n ELSE a.size + b.n - a.n END::INTEGER AS steps,
            CASE WHEN a.o_custkey % 10 = 0 THEN a.least END AS cycle
        FROM pairs p JOIN placed a ON p.source = a.o_orderkey JOIN placed b ON p.target = b.o_orderkey""",
    "top_orders": """SELECT c_custkey, c_mktsegment, n::INTEGER AS rank, o_orderkey FROM customer LEFT JOIN LATERAL (
        SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders
        WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) ON true""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _BASE + sql for name, sql in _COMMERCE.items()} | _DIRECT | _ORDERED
