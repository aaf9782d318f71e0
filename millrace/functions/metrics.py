"""Measures of ranked results over arrays of relevance (0 or 1 by rank), and recall of expected words, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit_at_k(relevances: Column, k: int) -> Column:
    return F.exists(F.slice(relevances, 1, k), lambda x: x > 0).cast("double")


def mrr_at_k(relevances: Column, k: int) -> Column:
    """1 / rank of the first relevant result; 0 without one."""
    at = F.array_position(F.transform(F.slice(relevances, 1, k), lambda x: x > 0), True)
    return F.when(at > 0, 1 / at).otherwise(0.0)


def _gain(relevances: Column) -> Column:
    return F.aggregate(F.transform(relevances, lambda x, i: x / F.log2((i + 2).cast("double"))), F.lit(0.0), lambda s, x: s + x)


def ndcg_at_k(relevances: Column, k: int) -> Column:
    """Against the best order of the same k results; 0 if none is relevant."""
    cut = F.slice(relevances, 1, k)
    ideal = _gain(F.sort_array(cut, asc=False))
    return F.when(ideal > 0, _gain(cut) / ideal).otherwise(0.0)


def keyword_recall(text: Column, keywords: Column) -> Column:
    """Share of the keywords found in the text, case aside; 1 without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(F.filter(keywords, lambda w: F.contains(low, F.lower(w)))) / F.size(keywords))
