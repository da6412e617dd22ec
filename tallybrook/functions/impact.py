"""Impact models as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybrook.functions.scalars import num


def repeat_rate_uplift(new_customers, repeat_rate, relative_uplift, orders_per_repeater, repeat_aov) -> Column:
    """Annual revenue from a relative rise of the repeat purchase rate."""
    per_customer = num(repeat_rate) * relative_uplift * (num(orders_per_repeater) - 1.0) * num(repeat_aov)
    return num(new_customers) * per_customer


def repeat_share_shift(annual_revenue, share_gain, new_aov, acquisition_cost, retention_cost=0.0) -> dict[str, Column]:
    """What it means if repeat buyers bring a larger share of the revenue.

    Revenue moves from first orders to repeat orders; each first order that is no longer
    needed saves its acquisition cost less the cost of keeping a customer.
    """
    moved = share_gain * num(annual_revenue)
    first_orders = F.try_divide(moved, num(new_aov))
    margin_per_order = acquisition_cost - retention_cost
    return {"delta_repeat_revenue": moved, "fewer_new_orders": first_orders, "net_savings": margin_per_order * first_orders}


def discount_recovery(list_price, unit_cost, discount_rate, reduction, elasticity, annual_orders) -> dict[str, Column]:
    """Change of revenue and gross profit when discounts shrink by ``reduction``.

    The net price grows by the factor p = 1 + reduction / (1 - discount), the volume by
    v = 1 + elasticity (p - 1); revenue changes by pv - 1 of itself, cost by v - 1.
    """
    net = (1 - num(discount_rate)) * num(list_price)
    price_growth = F.try_divide(F.lit(float(reduction)), 1 - num(discount_rate))
    volume_growth = elasticity * price_growth
    revenue_now, cost_now = net * num(annual_orders), num(unit_cost) * num(annual_orders)
    more_revenue = revenue_now * (price_growth + volume_growth + price_growth * volume_growth)
    return {"delta_revenue": more_revenue, "delta_gross_profit": more_revenue - cost_now * volume_growth}


def constant_volume_recovery(revenue, discount_rate, reduction) -> Column:
    """Revenue gained at unchanged volume: R ÷ (1 − d) × Δd."""
    return F.try_divide(num(revenue), 1 - num(discount_rate)) * reduction
