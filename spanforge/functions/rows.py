"""Arrays and maps as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: Column | str, *keep: Column | str, name: str = "s") -> DataFrame:
    """The kept columns with a row an element of an array, null elements left out.

    For a plain ``explode`` the optimizer adds a filter on the array's size, pushes it below whatever makes the array, and so
    has the array made twice; for an outer one it does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def entries(df: DataFrame, map_col: Column | str, *keep: Column | str, key: str = "key", value: str = "value") -> DataFrame:
    """The same for the entries of a map."""
    return df.select(*keep, F.explode_outer(map_col).alias(key, value)).where(F.col(key).isNotNull())


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all tasks, for steps that take much longer for a row than reading it does.

    Spark cuts a table into tasks by its bytes, so that a million short rows are one task. A number of tasks that is named is
    not lowered again for small data, as that of other shuffles is: it is the session's, or one for each core if that is more.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
