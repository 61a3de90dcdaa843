"""Small column and name helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.schema import DISPLAY_NAMES, METADATA_COLUMNS


def rnd(col: Column | str, places: int) -> Column:
    """Round half away from zero; adding 0.0 turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, places) + F.lit(0.0)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num/den as double, ``empty`` when the denominator is 0."""
    d = den.cast("double")
    return F.when(d != 0, num.cast("double") / d).otherwise(F.lit(empty).cast("double"))


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: Mapping[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), default)


def double(value: float | None) -> str:
    """A DOUBLE literal for SQL expressions, exact to the last bit."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"{float(value)!r}D"


def array_sql(values: Iterable[float | int]) -> str:
    """A literal array; one parsed expression instead of one call per element."""
    return "array(" + ", ".join(double(v) if isinstance(v, float) else str(v) for v in values) + ")"


def display_name(model: Column | str = "model_name") -> Column:
    c = F.col(model) if isinstance(model, str) else model
    return lookup(DISPLAY_NAMES, c, c)


def title_name(model: Column | str = "model_name") -> Column:
    """dp_random_forest -> Dp Random Forest."""
    c = F.col(model) if isinstance(model, str) else model
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def normalize_name(name: str) -> str:
    s = re.sub(r"\s+", "_", name.strip().lower())
    s = re.sub(r"_+", "_", re.sub(r"[^\w]", "_", s))
    return s.strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns to lower snake case; refuse names that would collide."""
    names = [normalize_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after normalisation: {clashes}")
    return df.toDF(*names)


def feature_columns(columns: Iterable[str], metadata: Iterable[str] = METADATA_COLUMNS) -> list[str]:
    skip = set(metadata)
    return [c for c in columns if c not in skip]


def l2_norm(features: Column | str) -> Column:
    x = F.col(features) if isinstance(features, str) else features
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda e: e / total)
