"""Arrow UDFs whose types are parsed at the first call, so that modules import without a session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(ddl: str):
    """Decorator: a function of pandas Series becomes a function of columns."""

    def made(f):
        @wraps(f)
        def call(*cols) -> Column:
            return F.pandas_udf(f, ddl)(*cols)

        return call

    return made
