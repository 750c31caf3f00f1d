"""Dealing rows out to all tasks before work that is long for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, by a hash of the keys in as many parts as keep every core busy.

    A small file is read by one task, whatever is done with its rows then; a stated number of parts also keeps adaptive
    execution from joining them again because they are small.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def merged(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input, so that it is never gathered at the driver to be broadcast.

    Sizes are guessed from files, and neither their compression nor an explode is seen there: millions of rows look small.
    """
    return df.hint("merge")
