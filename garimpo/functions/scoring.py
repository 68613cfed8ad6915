"""Relevance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency; 0 for an empty collection or an unknown term."""
    n, df = n.cast("double"), df.cast("double")
    return F.when((n <= 0) | (df <= 0), F.lit(0.0)).otherwise(F.ln(1 + (n - df + 0.5) / (df + 0.5)))


def tf_weight(tf: Column, length: Column, mean_length: Column, k1: float = K1, b: float = B) -> Column:
    """Saturated term frequency; without a mean length only the constant part of the length term is left."""
    ratio = F.when(mean_length > 0, length.cast("double") / mean_length).otherwise(F.lit(0.0))
    bottom = tf + k1 * (1 - b + b * ratio)
    return F.when((tf <= 0) | (bottom <= 0), F.lit(0.0)).otherwise(tf * (k1 + 1) / bottom)
