"""Telling rows apart where doc_id may be null or repeated, and running sums that no large group slows down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fixed


def keyed(documents: DataFrame) -> DataFrame:
    """documents with __key, a hash of all columns, and __copy, 1 on for rows that share it; unique together.

    Texts are moved only for keys that occur more than once. Equal rows are counted before they are moved, so a row that
    makes up a third of the table costs no more than any other. Rows whose hashes clash without being equal are told apart.
    """
    all_columns = fixed(*documents.columns)
    rows = documents.withColumn("__key", F.xxhash64(*all_columns))
    again = rows.groupBy("__key").count().where("count > 1").select(F.col("__key").alias("__again"))
    if again.isEmpty():
        return rows.withColumn("__copy", F.lit(1))
    again = checkpointed(again)
    met = F.col("__key") == F.col("__again")
    equal = rows.join(again, met, "left_semi").groupBy("__key", *all_columns).agg(F.count("*").cast("int").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy(*all_columns).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    copies = equal.withColumn("__before", before.cast("int")).select(*all_columns, "__key", F.explode(F.sequence(F.col("__before") + 1, F.col("__before") + F.col("__n"))).alias("__copy"))
    return rows.join(again, met, "left_anti").withColumn("__copy", F.lit(1)).unionByName(copies)


def running_sum(df: DataFrame, group: str, order: list[str], value: Column, name: str, hashed: str) -> DataFrame:
    """df with the sum of `value` over its group's rows up to and including this one, in the order of `order`.

    `hashed` is the first column of `order`, a string of hexadecimal digits of a hash. Its first two split each group into 256
    parts, which are summed before they are sorted: a group with a third of all rows is spread over 256 tasks. `group` has
    no nulls.
    """
    parts = df.withColumns({"__part": F.substring(hashed, 1, 2), "__value": value})
    sums = parts.groupBy(group, "__part").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select(group, "__part", before.alias("__before"))
    own = F.sum("__value").over(Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("__own", own).join(before, [group, "__part"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__value", "__own", "__before")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its place, from 1 on, among all rows sorted by `order`, which tells all rows apart; range-partitioned."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    total, before = 0, []
    for part, count in sorted(map(tuple, ranged.groupBy("__part").count().collect())):  # a row for each of n partitions
        before.append(f"({part}, {total}L)")
        total += count
    if not before:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("__part")
    offsets = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(before)} AS t(__part, __before)")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")
