"""Word spans inside requirements: overlap, merging, gaps, order, runs of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def words_with_positions(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.col(text), " ")).alias("pos", "word"))


def islands(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Runs of consecutive positions: key, start, end, n."""
    run = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return df.withColumn("run", run).groupBy(key, "run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n")).drop("run")


def overlaps_left(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """b begins before a and ends inside it."""
    return (b_start < a_start) & (b_end >= a_start) & (b_end <= a_end)


def overlaps_right(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """b begins inside a and ends after it."""
    return (b_start >= a_start) & (b_start <= a_end) & (b_end > a_end)


def merge_spans(df: DataFrame, key: str) -> DataFrame:
    """Union of overlapping spans (start, end, label) of each key, with the labels of all in order.

    A running maximum of ends tells where a new group begins, so no state passes between rows.
    """
    before = F.max("end").over(Window.partitionBy(key).orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    group = F.sum("first").over(Window.partitionBy(key).orderBy("start", "end", "label"))
    grouped = df.withColumn("first", first).withColumn("grp", group)
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "label"))), lambda x: x["label"]), " ")
    return grouped.groupBy(key, "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), labels.alias("labels")).drop("grp")


def dedupe_spans(df: DataFrame, key: str) -> DataFrame:
    """One row per distinct span, with the label that sorts first."""
    return df.groupBy(key, "start", "end").agg(F.min("label").alias("label"))


def order_spans(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "label")))


#: Ranges of keys that are numbered apart from each other; only as many rows as this meet in one task.
RANGES = 256


def offsets(sizes: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """_key, before: for every key of ``sizes`` (key, n) the sum of n of the keys before it.

    Keys fall into ranges between some of ``keys`` that a hash picks; a range's offset and a key's within it make up the
    result, so no task orders all keys."""
    kind = sizes.schema[key].dataType
    cuts = sorted(r[0] for r in keys.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(RANGES - 1).collect())
    bounds = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(f"array<{kind.simpleString()}>")
    ranged = sizes.withColumn("range", F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(key))), F.lit(-1)))
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total"))
    totals = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("start"))
    within = ranged.withColumn("before", F.sum("n").over(Window.partitionBy("range").orderBy(key)) - F.col("n"))
    return within.join(F.broadcast(totals), "range").select(F.col(key).alias("_key"), (F.col("start") + F.col("before")).alias("before"))


def segment_counters(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A counter over all segments, by key, and one within each key."""
    inner = df.withColumn("in_req", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    offset = offsets(df.groupBy(key).agg(F.count("*").alias("n")), key, df)
    return inner.join(offset, F.col(key).eqNullSafe(F.col("_key"))).withColumn("overall", F.col("before") + F.col("in_req")).drop("before", "_key")


def clause_span(words: Column, clause: Column) -> Column:
    """The struct start, end (inclusive) of the last run of ``words`` that holds the words of ``clause`` one by one, in
    any case and as parts of words; null where there is none or the clause is empty."""
    low = lambda a: F.transform(a, F.lower)
    w, c = low(words), F.filter(low(F.split(F.trim(clause), " +")), lambda x: x != "")
    n = F.size(c)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.forall(F.transform(c, lambda x, k: F.coalesce(F.get(w, i + k).contains(x), F.lit(False))), lambda ok: ok))
    last = F.array_max(starts)
    return F.when((n > 0) & last.isNotNull(), F.struct(last.alias("start"), (last + n - 1).alias("end")))


def previous(value: str, key: str, order: list[str]) -> Column:
    """The value of the segment before, null for a key's first."""
    return F.lag(value).over(Window.partitionBy(key).orderBy(*order))


def least_position(*positions: Column) -> Column:
    """The smallest of positions that are not negative, -1 if there is none."""
    return F.coalesce(F.array_min(F.filter(F.array(*positions), lambda p: p >= 0)), F.lit(-1))
