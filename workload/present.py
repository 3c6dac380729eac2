"""One textual and numeric form for results that two engines must agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, places: int | None = 6, **own: int) -> DataFrame:
    """Round doubles half away from zero (per-column places in `own`), print dates, widen integers."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            digits = own.get(f.name, places)
            if digits is not None:
                scale = 10.0**digits
                whole = F.floor(F.abs(c) * scale + 0.5).cast("double")
                rounded = F.signum(c) * whole / scale + F.lit(0.0)
                c = F.when(F.abs(c) == float("inf"), c).otherwise(rounded)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)
