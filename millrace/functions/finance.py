"""Small guarded formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.metrics import ratio


def change_rate(old: Column, new: Column) -> Column:
    """Change in percent; NULL unless the old value is positive and the new one not negative."""
    return F.when((old > 0) & (new >= 0), 100 * ratio(new - old, old))


def price_earnings(market_value: Column, net_income: Column) -> Column:
    """NULL unless both are positive."""
    return F.when((market_value > 0) & (net_income > 0), ratio(market_value, net_income))


def pair_volatility(weight: Column, a: Column, b: Column, correlation: Column) -> Column:
    """Volatility of two assets with weights w and 1 - w; NULL for values out of range."""
    rest = 1 - weight
    v = F.pow(weight * a, 2) + F.pow(rest * b, 2) + 2 * weight * rest * a * b * correlation
    return F.when(weight.between(0, 1) & (a >= 0) & (b >= 0) & correlation.between(-1, 1), F.sqrt(F.greatest(v, F.lit(0.0))))


def proportion_difference(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Difference of two proportions and its normal 95 % bounds."""
    p, q = ratio(k1, n1), ratio(k2, n2)
    half = 1.96 * F.sqrt(ratio(p * (1 - p), n1) + ratio(q * (1 - q), n2))
    return p - q, p - q - half, p - q + half


def token_cost(prompt: Column, completion: Column, prompt_price: float, completion_price: float) -> Column:
    """Cost of a call at prices per million tokens."""
    return (prompt * prompt_price + completion * completion_price) / 1_000_000


def mock_tokens(text: Column) -> Column:
    """Prompt tokens of a mock provider: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4.0)
