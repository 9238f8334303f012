"""Camera names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def camera_name(make: Column, model: Column) -> Column:
    """make and model as one name: the model alone where it starts with the make as a whole word."""
    blank = F.lit("")
    m, n = F.trim(F.coalesce(make, blank)), F.trim(F.coalesce(model, blank))
    rest = F.substring(n, F.length(m) + 1, F.lit(1))
    starts = F.lower(F.substring(n, F.lit(1), F.length(m))) == F.lower(m)
    told = starts & ((rest == "") | ~rest.rlike(r"^[\p{L}\p{N}]"))
    return F.when(n == "", F.nullif(m, blank)).when(m == "", n).when(told, n).otherwise(F.concat(m, F.lit(" "), n))
