"""Similarity measures: text ratio (Python, pairs only), vectors, trait sets."""

from __future__ import annotations

import html
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def text_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings; argument order matters. Use on candidate pairs."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(left, right, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = SequenceMatcher(None, *pair).ratio()
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def text_ratio_from(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """`text_ratio` of the pairs that may reach `least`, null for others.

    Matching blocks hold no more characters than both texts share, whatever their order. Characters are counted
    in 64 classes of their codes; two in one class make the bound larger, never smaller.
    """
    import numpy as np

    out = np.full(len(left), np.nan)
    given = np.nonzero((left.notna() & right.notna() & least.notna()).to_numpy())[0]
    if not len(given):
        return pd.Series(out, dtype="float64")
    names, codes = np.unique(
        np.concatenate([left.to_numpy(object)[given], right.to_numpy(object)[given]]).astype(str), return_inverse=True
    )
    names = names.tolist()
    counts, lengths = np.zeros((len(names), 64), np.int32), np.array([len(n) for n in names], np.int64)
    letters = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32) % 64
    np.add.at(counts, (np.repeat(np.arange(len(names)), lengths), letters), 1)
    one, two = codes[: len(given)], codes[len(given) :]
    shared = np.minimum(counts[one], counts[two]).sum(axis=1)
    both = lengths[one] + lengths[two]
    most = np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0)
    seen: dict[tuple[int, int], float] = {}
    for i in np.nonzero(most >= least.to_numpy()[given])[0].tolist():
        pair = (int(one[i]), int(two[i]))
        if pair not in seen:
            seen[pair] = SequenceMatcher(None, names[pair[0]], names[pair[1]]).ratio()
        out[given[i]] = seen[pair]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Every HTML entity decoded."""
    return text.map(html.unescape, na_action="ignore")


def dot(left: Column, right: Column) -> Column:
    """Inner product; vectors of different length are an error."""
    total = F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b),
        F.lit(0.0),
        lambda state, value: state + value,
    )
    wrong = F.raise_error(F.lit("vectors have different dimensions")).cast("double")
    return F.when(F.size(left) == F.size(right), total).otherwise(wrong)


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda state, value: state + value * value)
    return F.sqrt(squares)


def cosine(left: Column, right: Column, left_norm: Column | None = None, right_norm: Column | None = None) -> Column:
    """Cosine of two double vectors; 0 when one has no length. Known lengths may be given."""
    size = (norm(left) if left_norm is None else left_norm) * (norm(right) if right_norm is None else right_norm)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(left, right) / size)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all members of two sets; 0 when both are empty."""
    either = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(either == 0, F.lit(0.0)).otherwise(shared / either)
