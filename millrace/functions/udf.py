"""Arrow UDFs that are made when first used: making one needs a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF of a return type, by its type hints."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
