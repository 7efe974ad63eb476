"""Vector similarity on array columns, in the JVM and as an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is null, has another size or no length."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def cosine_to(vector: list[float], column: Column) -> Column:
    """Cosine similarity to one query vector, over whole Arrow batches."""
    query = np.asarray(vector, np.float64)
    norm = float(np.linalg.norm(query))

    @F.pandas_udf("double")
    def similarity(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        good = np.array([v is not None and len(v) == len(query) for v in vectors], bool)
        if good.any() and norm:
            m = np.stack(vectors[good].to_numpy()).astype(np.float64)
            n = np.linalg.norm(m, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[good] = np.where(n > 0, m @ query / (n * norm), np.nan)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return similarity(column)


def right_size(vector: Column, dims: int) -> Column:
    return F.size(vector) == dims


def half_precision(vector: Column) -> Column:
    """Each number rounded to 16-bit floating point, as a half-precision store would keep it."""

    @F.pandas_udf("array<float>")
    def rounded(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))

    return rounded(vector)
