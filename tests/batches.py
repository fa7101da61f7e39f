"""Two small commerce batches and an expectation computed without Spark."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

# The published example data, from which the published profits follow.
CHANNELS = ["Paid search", "Organic", "Email", "Paid social"]
SPEND = {"Paid search": 26000, "Paid social": 22000, "Email": 3500, "Organic": 0, "Affiliates": 4000}
COSTS = {"P1": 2200, "P2": 900, "P3": 1500}
REFUNDS = [("R1", "O002", 2500, "2026-08-20"), ("R2", "O004", 4500, "2026-08-21")]
MORE_REFUNDS = [("R3", "O003", 9000, "2026-09-03"), ("R4", "O999", 1700, "2026-09-04")]
GOLDEN = {
    1: {"Email": 577, "Organic": 527, "Paid search": 232, "Paid social": 167, "Affiliates": -40},
    2: {"Email": 487, "Organic": 527, "Paid search": 192, "Paid social": 51, "Affiliates": -40, "Unattributed": 116},
}


def tables(batch: int) -> dict[str, tuple[list[str], list[tuple]]]:
    """Header and rows of each input."""
    days = range(1, 25)
    customers = [f"C{n:03}" for n in range(1, 13)]
    orders = [(f"O{d:03}", customers[(d - 1) % 12], f"2026-08-{d:02}", "USD") for d in days]
    items = []
    for d in days:
        items.append((f"I{d:03}a", f"O{d:03}", "P1", 1, 8000 + d % 4 * 1000))
        if d % 3 == 0:
            items.append((f"I{d:03}b", f"O{d:03}", "P2", 2, 3000))
    attribution = [(c, CHANNELS[i % 4]) for i, c in enumerate(customers)]
    refunds = list(REFUNDS)
    spend_header = ["spend_id", "channel", "amount_cents", "currency"]
    spend = [(f"S{i}", c, a, "USD") for i, (c, a) in enumerate(SPEND.items())]
    if batch == 2:
        orders.append(orders[0])
        attribution = [row for row in attribution if row[0] != "C008"]
        refunds += MORE_REFUNDS
        spend_header = ["spend_id", "channel", "currency", "spend_cents"]
        spend = [(i, c, u, 30000 if c == "Paid search" else a) for i, c, a, u in spend]
    return {
        "orders": (["order_id", "customer_id", "ordered_at", "currency"], orders),
        "order_items": (["item_id", "order_id", "product_id", "quantity", "unit_price_cents"], items),
        "customers": (["customer_id", "region"], [(c, "East") for c in customers]),
        "attribution": (["customer_id", "channel"], attribution),
        "ad_spend": (spend_header, spend),
        "product_costs": (
            ["product_id", "unit_cost_cents", "currency"],
            [(p, c, "USD") for p, c in COSTS.items()],
        ),
        "refunds": (
            ["refund_id", "order_id", "amount_cents", "currency", "received_at"],
            [(r, o, a, "USD", day) for r, o, a, day in refunds],
        ),
    }


def csv_text(header: list[str], rows: list[tuple]) -> str:
    return "\n".join(",".join(str(v) for v in row) for row in [header, *rows]) + "\n"


def expected_profit(batch: int) -> dict[str, Decimal]:
    """Profit per channel in dollars, one amount at a time."""
    data = tables(batch)
    customer_of = {o: c for o, c, _, _ in data["orders"][1]}
    channel_of = dict(data["attribution"][1])
    cents = Counter()

    def book(order: str, amount: int) -> None:
        if order in customer_of:
            cents[channel_of.get(customer_of[order], "Unattributed")] += amount

    for _, order, product, quantity, price in data["order_items"][1]:
        book(order, quantity * (price - COSTS[product]))
    for _, order, amount, *_ in data["refunds"][1]:
        book(order, -amount)
    for row in data["ad_spend"][1]:
        cents[row[1]] -= next(v for v in row[2:] if isinstance(v, int))
    return {channel: Decimal(c) / 100 for channel, c in cents.items()}
