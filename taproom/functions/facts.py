"""Three-valued facts. Unknown (null) meets neither a requirement nor an exclusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taproom import vocab as V


def is_true(fact: Column) -> Column:
    return fact.eqNullSafe(F.lit(True))


def is_false(fact: Column) -> Column:
    return fact.eqNullSafe(F.lit(False))


def feature_column(feature: str, prefix: str = "") -> Column:
    """Fact behind a feature name; the two atmosphere features read the noise level."""
    if feature in V.NOISE_FEATURES:
        return F.col(f"{prefix}noiseLevel") == V.NOISE_FEATURES[feature]
    if feature in V.FEATURE_FACTS:
        return F.col(f"{prefix}{V.FEATURE_FACTS[feature]}")
    return F.lit(None).cast("boolean")


def feature_map(prefix: str = "") -> Column:
    """feature name -> fact, for lookups by a feature named in data."""
    names = (*V.FEATURES, *V.NOISE_FEATURES)
    pairs = ", ".join(f"'{name}', {feature_sql(name, prefix)}" for name in names)
    return F.expr(f"map({pairs})")


def fact_map(prefix: str = "") -> Column:
    """fact column name -> value."""
    pairs = ", ".join(f"'{fact}', {prefix}{fact}" for fact in V.FACTS)
    return F.expr(f"map({pairs})")


def facts_where(value: bool | None, names: dict[str, str], prefix: str = "") -> Column:
    """Labels (in the order of `names`: feature -> label) whose fact is true, false or unknown."""
    wanted = "null" if value is None else str(value).lower()
    shown = ", ".join(
        f"IF({feature_sql(feature, prefix)} <=> {wanted}, '{label}', null)"
        for feature, label in names.items()
    )
    return F.expr(f"array_compact(array({shown}))")


def bits_sql(tests: list[str]) -> str:
    """Integer with one bit per test, as expression text."""
    return " + ".join(f"IF({test}, {1 << i}L, 0L)" for i, test in enumerate(tests))


def feature_sql(feature: str, prefix: str = "") -> str:
    """Expression text of the fact behind a feature name."""
    if feature in V.NOISE_FEATURES:
        return f"({prefix}noiseLevel = '{V.NOISE_FEATURES[feature]}')"
    return f"{prefix}{V.FEATURE_FACTS[feature]}"


def trait_bits(prefix: str = "") -> Column:
    """Known-true facts as one integer, one bit per fact."""
    return F.expr(bits_sql([f"{prefix}{fact} <=> true" for fact in V.FACTS]))
