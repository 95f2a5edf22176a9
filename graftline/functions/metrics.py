"""Agreement measures as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_EPS, LOG_EPS = 1e-6, 1e-8


def step_f1(tp: Column, n_gold: Column, n_pred: Column) -> Column:
    """F1 of a step with 1e-6 in each denominator; 0 where either side is empty."""
    p, r = tp / (n_pred + STEP_EPS), tp / (n_gold + STEP_EPS)
    return F.when((n_gold == 0) | (n_pred == 0), 0.0).otherwise(2 * p * r / (p + r + STEP_EPS))


def failed_as_minus_one(status: Column, f1: Column) -> Column:
    """The reward of a step: -1 where its output could not be parsed, else its F1."""
    return F.when(F.coalesce(status.startswith("parse_fail"), F.lit(False)), -1.0).otherwise(f1)


def turn_f1(tp: Column, n_gold: Column, n_pred: Column) -> Column:
    """F1 of a turn; 1 where both sides are empty, 0 where one is or nothing is shared."""
    p, r = F.try_divide(tp, n_pred), F.try_divide(tp, n_gold)
    return F.when((n_gold == 0) & (n_pred == 0), 1.0).when((n_gold == 0) | (n_pred == 0) | (tp == 0), 0.0).otherwise(2 * p * r / (p + r))


def micro(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1 with 1e-8 in the denominators."""
    p, r = tp / (tp + fp + LOG_EPS), tp / (tp + fn + LOG_EPS)
    return p, r, 2 * p * r / (p + r + LOG_EPS)


def bag_f1(shared: Column, n_gold: Column, n_pred: Column) -> Column:
    """F1 of multisets; shared is the sum of the smaller counts."""
    p, r = shared / (n_pred + LOG_EPS), shared / (n_gold + LOG_EPS)
    return F.when((n_gold == 0) | (n_pred == 0), 0.0).otherwise(2 * p * r / (p + r + LOG_EPS))


def percent(part: Column, whole: Column) -> Column:
    """Text like 12.50%; 0.00% where the whole is not positive."""
    return F.when(whole <= 0, F.lit("0.00%")).otherwise(F.format_string("%.2f%%", F.try_divide(part * 100.0, whole)))


def spread_reward(reward: Column, mask: Column) -> Column:
    """The reward in equal shares over the valid tokens, 0 elsewhere."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    return F.transform(mask, lambda m: F.when(m > 0, F.coalesce(F.try_divide(reward, n), F.lit(0.0))).otherwise(0.0))


def positions(mask: Column) -> Column:
    """Running count of the mask minus one, at least 0."""
    return F.transform(mask, lambda _, i: F.greatest(F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda a, m: a + m) - 1, F.lit(0)))


def pad(ids: Column, length: int, filler: int) -> Column:
    """The ids cut or filled at the right to the length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(filler), length)), 1, length)


def first_best(scores: Column) -> Column:
    """Index from 0 of the greatest score, the first of ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
