"""Statistics of libraries, alignments and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flag bits of alignments.
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024, "supplementary": 2048}


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAGS[name])) != 0


def insert_stats(df: DataFrame, column: str, spread: float = 10.0) -> DataFrame:
    """median, upper_mad, kept, mean and stdev (population) of values below median + spread * median upper deviation."""
    med = df.agg(F.median(column).alias("med"))
    above = df.join(F.broadcast(med), F.col(column) > F.col("med"))
    mad = above.agg(F.median(F.col(column) - F.col("med")).alias("mad"))
    limits = med.withColumn("one", F.lit(1)).join(mad.withColumn("one", F.lit(1)), "one")
    kept = df.join(F.broadcast(limits), F.col(column) < F.col("med") + F.lit(spread) * F.col("mad"))
    return kept.agg(F.max("med").alias("median"), F.max("mad").alias("upper_mad"), F.count("*").alias("kept"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("stdev"))


def insert_histogram(df: DataFrame, column: str, start: int, stop: int) -> DataFrame:
    """(bin, freq) for start .. stop - 1, as shares of all values in start .. stop; bins count from 0."""
    own = df.where((F.col(column) >= start) & (F.col(column) <= stop)).groupBy((F.col(column) - start).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total")).withColumn("k", F.lit(1))
    bins = df.sparkSession.range(0, stop - start).select(F.col("id").alias("bin"), F.lit(1).alias("k"))
    return bins.join(own, "bin", "left").join(F.broadcast(total), "k", "left").select("bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("freq"))


def survival(histogram: DataFrame) -> DataFrame:
    """(bin, freq, survival): the share at or beyond each bin. A histogram has as many rows as insert sizes."""
    return histogram.withColumn("survival", F.sum("freq").over(Window.orderBy(F.desc("bin"))))


def flag_stats(df: DataFrame, flag: str = "flag", isize: str = "isize") -> DataFrame:
    """One pass: counts of what flags say, mean and median size of first mates' inserts."""
    f = F.col(flag)
    counts = {n: F.count_if(has(f, n)) for n in ("paired", "proper", "reverse", "first", "second", "failed", "duplicate")}
    counts |= {"mapped": F.count_if(~has(f, "unmapped")), "both_mapped": F.count_if(has(f, "paired") & ~has(f, "unmapped") & ~has(f, "mate_unmapped")), "single": F.count_if(has(f, "paired") & ~has(f, "unmapped") & has(f, "mate_unmapped"))}
    size = F.when(has(f, "paired") & has(f, "first") & (F.col(isize) != 0), F.abs(F.col(isize)))
    return df.agg(F.count("*").alias("total"), *[c.alias(n) for n, c in counts.items()], F.avg(size).alias("mean_insert"), F.median(size).alias("median_insert"))


def orientation(flag: Column, pos: Column, mate_pos: Column) -> Column:
    """1 to 8: which mate comes first, and on which strands the first and the second lie."""
    first = F.when(pos <= mate_pos, has(flag, "first")).otherwise(~has(flag, "first"))
    one = F.when(pos <= mate_pos, has(flag, "reverse")).otherwise(has(flag, "mate_reverse"))
    two = F.when(pos <= mate_pos, has(flag, "mate_reverse")).otherwise(has(flag, "reverse"))
    return (F.when(first, 0).otherwise(4) + 2 * one.cast("int") + two.cast("int") + 1).cast("long")


def library_model(df: DataFrame, group: str, model: str, size: str, share: float = 0.9973) -> DataFrame:
    """(group, models, ambiguity, n, low, median, high): the two commonest orientations, what share others have, and the
    middle `share` of the fragment sizes of those two."""
    counts = df.groupBy(group, model).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), model))
    ranked = counts.withColumn("rank", rank).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    top = ranked.where("rank <= 2")
    own = df.join(F.broadcast(top.select(group, model)), [group, model])
    tail = (1 - share) / 2
    sizes = own.groupBy(group).agg(F.count("*").alias("n"), F.percentile(size, F.lit(tail)).alias("low"), F.median(size).alias("median"), F.percentile(size, F.lit(1 - tail)).alias("high"))
    models = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", model))), lambda x: x[model].cast("string")), ",").alias("models"), (1 - F.sum("n") / F.max("all")).alias("ambiguity"))
    return models.join(sizes, group)


def column_summary(df: DataFrame, group: str, column: str) -> DataFrame:
    """sum, mean, deviations, median, extremes, mode, antimode (ties: the smaller), counts and the sorted distinct values."""
    freq = df.groupBy(group, column).agg(F.count("*").alias("n"))
    by_value = freq.groupBy(group).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))["v"].alias("mode"),
        F.min(F.struct("n", F.col(column).alias("v")))["v"].alias("antimode"),
        F.count("*").alias("n_distinct"),
        F.array_join(F.array_sort(F.collect_list(column)).cast("array<string>"), ",").alias("distinct_values"),
    )
    plain = df.groupBy(group).agg(
        F.sum(column).alias("total"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("stdev"), F.stddev_samp(column).alias("sstdev"),
        F.median(column).alias("median"), F.min(column).alias("least"), F.max(column).alias("most"), F.count("*").alias("n"),
    )
    return plain.join(by_value, group)


def frequencies(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, falling, rising): `value:n` lists, by count and then value."""
    freq = df.groupBy(group, column).agg(F.count("*").alias("n"))
    text = F.concat(F.col(column).cast("string"), F.lit(":"), F.col("n").cast("string"))
    item = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(column).alias("v"), text.alias("t")))), lambda x: x["t"]), ",")
    return freq.groupBy(group).agg(item(-F.col("n")).alias("falling"), item(F.col("n")).alias("rising"))


def unsorted(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """(keys, n_breaks, first_break): rows that stand before a row of smaller `column` in the given order."""
    lag = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    marked = df.withColumn("__bad", lag > F.col(column))
    return marked.groupBy(*keys).agg(F.count_if("__bad").alias("n_breaks"), F.min(F.when(F.col("__bad"), F.col(order[0]))).alias("first_break"))
