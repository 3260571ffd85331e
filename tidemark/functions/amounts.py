"""Columns over impressions by price category, prices, errors and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The price categories' impression columns, cheapest first.
H = ["h0", "h1", "h2", "h3"]
# Upper ends of the two lower price categories by price model.
PRICE_STEPS = {"CPM": (12.0, 25.0), "CPC": (0.7, 2.0), "CPD": (3.0, 5.0), "CPT": (60000.0, 400000.0)}
# Percent of a day's traffic in each hour.
HOUR_PERCENT = [2.905931696, 1.792490513, 1.592770122, 1.447972838, 1.657679249, 2.716197324, 5.117835031, 6.5308568, 6.570800879, 5.302576393, 4.423806671, 4.43379269, 4.858198522, 4.338925504, 4.219093269, 4.224086279, 4.613541043, 5.412422608, 5.60714999, 5.327541442, 5.167765129, 4.828240463, 4.009386858, 2.900938686]


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0).cast("double")), F.lit(0.0))


def relative_error(actual: Column, predicted: Column) -> Column:
    """|a - p| / a to three places, -1 where a is 0."""
    return F.when(actual == 0, F.lit(-1.0)).otherwise(F.round(F.abs(actual - predicted) / F.nullif(actual, F.lit(0.0)), 3))


def smape_term(actual: Column, predicted: Column) -> Column:
    both = F.abs(actual) + F.abs(predicted)
    return F.when(both < 0.01, F.lit(0.0)).otherwise(2 * F.abs(predicted - actual) / both)


def price_category(price: Column, model: Column) -> Column:
    """0 for a negative price, else 1 to 3 by the model's steps; 3 for a model without steps."""
    out = F.lit(3)
    for name, (low, high) in PRICE_STEPS.items():
        out = F.when(model == name, F.when(price <= low, 1).when(price <= high, 2).otherwise(3)).otherwise(out)
    return F.when(price < 0, F.lit(0)).otherwise(out)


def total_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def up_to_category(columns: list[Column], category: Column) -> Column:
    """Sum of the categories through `category`."""
    return total_of([F.when(category >= i, c).otherwise(F.lit(0)) for i, c in enumerate(columns)])


def after_booked(columns: list[Column], booked: Column) -> list[Column]:
    """What each category keeps when `booked` impressions are taken, cheapest category first."""
    kept, before = [], F.lit(0)
    for c in columns:
        kept.append(c - F.greatest(F.least(c, booked - before), F.lit(0)))
        before = before + c
    return kept


def hour_share(hours: Column) -> Column:
    """Share of a day's traffic in an array of hours; 1 for all 24."""
    table = F.array(*[F.lit(p) for p in HOUR_PERCENT])
    return F.when(F.size(hours) >= 24, F.lit(1.0)).otherwise(F.aggregate(hours, F.lit(0.0), lambda s, h: s + F.element_at(table, h + 1)) / 100)


def behaviour_ratio(matching: Column, base: Column) -> Column:
    """1 where both are alike, 0 without a match, else their ratio."""
    return F.when(F.abs(matching - base) <= 0.001, F.lit(1.0)).when(matching == 0, F.lit(0.0)).otherwise(matching / F.nullif(base, F.lit(0.0)))
