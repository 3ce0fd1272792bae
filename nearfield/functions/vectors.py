"""Checks of vector columns and of query vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ID = 2**63 - 1


def checked(vector: Column, dim: int) -> Column:
    """The vector if it has dim values, none of them null or non-finite; else the query fails.

    Arrays of another length would otherwise yield a null distance, and null sorts first.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (
        F.when(vector.isNull(), F.raise_error(F.lit("vector is null")))
        .when(F.size(vector) != dim, F.raise_error(F.concat(F.lit(f"vector has another dimension than {dim}: "), F.size(vector).cast("string"))))
        .when(bad, F.raise_error(F.lit("vector has a null or non-finite value")))
        .otherwise(vector)
    )


def query_vector(query: Sequence[float], dim: int | None = None) -> np.ndarray:
    """One query as float32; ValueError unless it is one-dimensional, finite and of that dimension."""
    q = np.asarray(query, dtype=np.float32)
    if q.ndim != 1:
        raise ValueError("a query is one vector")
    if dim is not None and q.size != dim:
        raise ValueError(f"query has {q.size} values, the collection has {dim} dimensions")
    if not np.isfinite(q).all():
        raise ValueError("query has non-finite values")
    return q


def literal(query: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in query]).cast(T.ArrayType(T.DoubleType()))


def check_ids(ids: Sequence[int]) -> None:
    for i in ids:
        if not 0 <= int(i) <= MAX_ID:
            raise ValueError(f"id {i} lies outside 0..2^63-1")
