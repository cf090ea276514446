"""Arrow functions that are made when they are called, so that importing needs no session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str):
    """Makes a function of pandas series a function of columns with results of this type."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__, call.__name__, call.plain = f.__doc__, f.__name__, f
        return call

    return wrap
