"""First rows per group and positions within a group, both safe for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Parts a group is split into when its first rows are found in two steps.
SPREAD = 32


def first_per_group(df: DataFrame, keys, order, n: int = 1, rank: str | None = None, spread_by=()) -> DataFrame:
    """First ``n`` rows of each group.

    Catalyst puts a WindowGroupLimit below the exchange, so every task sends at most ``n`` rows per key; a hot key
    costs ``tasks * n`` rows, not its full size. Where even that is much for one task (few keys, very many tasks),
    ``spread_by`` names columns whose hash splits each group: the first ``n`` of every part are found first.
    """
    if spread_by:
        part = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD))
        df = first_per_group(df.withColumn("__part", part), [*keys, "__part"], order, n).drop("__part")
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def positions(df: DataFrame, keys, coarse, order, name: str = "position") -> DataFrame:
    """1-based position of every row within its group, without putting a whole group in one task.

    ``coarse`` are columns the order starts with. Rows are numbered per (key, coarse) cell and moved by the
    number of rows in earlier cells of the key; only the cell counts are ever ordered per key. NULL is a key and a
    value like any other (first in the order), so every row gets a position.
    """
    cell = [*keys, *coarse]
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__at_{i}" for i, c in enumerate(cell)}
    offsets = counts.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = Window.partitionBy(*cell).orderBy(*order)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return (
        df.withColumn("__local", F.row_number().over(local))
        .join(offsets, same)
        .withColumn(name, (F.col("__before") + F.col("__local")).cast("bigint"))
        .drop("__before", "__local", *names.values())
    )
