"""Relational building blocks shared by the metrics."""

from cartpulse.operators.audience import day_order, first_seen, new_per_day, running_sum
from cartpulse.operators.campaign import campaign_dim, campaign_label, members_from_ids, members_side, with_campaign
from cartpulse.operators.joins import flag_join, left_join_known
from cartpulse.operators.orders import (
    cancelled_orders,
    delivered_orders,
    not_cancelled,
    not_in,
    order_lines,
    order_totals,
    paid_flag,
    priced_lines,
    sales,
    units_sold,
    with_cancel_flag,
)
from cartpulse.operators.prefilter import id_filter, maybe_among

__all__ = [
    "campaign_dim",
    "campaign_label",
    "cancelled_orders",
    "day_order",
    "delivered_orders",
    "first_seen",
    "flag_join",
    "id_filter",
    "left_join_known",
    "maybe_among",
    "members_from_ids",
    "members_side",
    "new_per_day",
    "not_cancelled",
    "not_in",
    "order_lines",
    "order_totals",
    "paid_flag",
    "priced_lines",
    "running_sum",
    "sales",
    "units_sold",
    "with_campaign",
    "with_cancel_flag",
]
