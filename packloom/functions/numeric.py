"""Numerically safe column expressions in log space.

Spark's ``ln(0)`` is NULL, so nothing here takes the logarithm of a probability that may have underflowed:
every sum of exponentials is shifted by its maximum first and therefore contains a one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sum_exp(values: Column) -> Column:
    """``ln(sum(exp(x)))`` over an array column; NULL entries take no part."""
    top = F.array_max(values)
    shifted = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.exp(x - top), F.lit(0.0)))
    return top + F.log(shifted)


def log_sum_exp_columns(terms: Sequence[Column]) -> Column:
    """``ln(sum(exp(x)))`` over several columns of one row; NULL terms take no part."""
    if len(terms) == 1:
        return terms[0]
    top = F.greatest(*terms)
    total = sum((F.coalesce(F.exp(t - top), F.lit(0.0)) for t in terms), F.lit(0.0))
    return top + F.log(total)


def log_softmax(values: Column) -> Column:
    """Array minus its log-sum-exp."""
    norm = log_sum_exp(values)
    return F.transform(values, lambda x: x - norm)


def log_add_exp(left: Column, right: Column) -> Column:
    """``ln(exp(a) + exp(b))``."""
    return F.greatest(left, right) + F.log1p(F.exp(-F.abs(left - right)))


def whole_div(left: Column, right: Column) -> Column:
    """Whole-number division of two BIGINT columns, without a detour over DOUBLE."""
    return F.call_function("div", left.cast("bigint"), right.cast("bigint"))
