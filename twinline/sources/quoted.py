"""Quoted tables whose fields may hold line breaks, read in as many tasks as the files have splits.

A line break ends a record only outside of quotes, which a task that starts inside a file can't see. So every block of
lines of a split says how it ends for either state that it may begin in, and how many records begin in it; composing
these over the blocks of a file (one row each) fixes the state that each begins in. Then every block cuts its own records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.position import span_places, stored_scan

QUOTE = '"'
# Lines that are ranked together; a split is as many blocks as it needs.
BLOCK = 8192


def _ends_open(line: Column, sep: str, opened: bool) -> Column:
    """Whether a line that begins inside (or outside) of quotes ends inside of them.

    A field is quoted if it begins with a quote; quotes elsewhere in a field without are plain characters. Inside of
    quotes an odd number up to the next separator closes the field, as doubled ones stand for themselves.
    """
    pieces = F.split(line, "\\Q" + sep + "\\E")

    def odd(piece: Column) -> Column:
        return (F.length(piece) - F.length(F.replace(piece, F.lit(QUOTE), F.lit("")))) % 2 == 1

    end = F.aggregate(pieces, F.lit(opened), lambda inside, piece: F.when(inside, ~odd(piece)).otherwise(F.startswith(piece, F.lit(QUOTE)) & odd(piece)))
    return F.when(F.contains(line, F.lit(QUOTE)), end).otherwise(F.lit(opened))


def _state(begin: Column | int, within) -> Column:
    """The state after a row, 1 inside of quotes, for the state that its rows begin in.

    A row either keeps the state, turns it, or sets it. After the last row that sets it only the turns count. A row says so
    by its ends for either state, the columns ``from0, from1``; ``turns`` counts the turns up to it.
    """
    sets = F.last(F.when(F.col("from0") == F.col("from1"), F.col("from0") + F.col("turns")), ignorenulls=True)
    return (F.coalesce(sets.over(within), F.lit(begin) if isinstance(begin, int) else begin) + F.col("turns")) % 2


def _turned(rows: DataFrame, within) -> DataFrame:
    return rows.withColumn("turns", F.sum((F.col("from0") > F.col("from1")).cast("int")).over(within))


def _div_rows(row: Column) -> Column:
    return F.call_function("div", row, F.lit(BLOCK))


def quoted_records(spark: SparkSession, path: str, sep: str, header: bool = False, name: str = "row_id") -> DataFrame:
    """``value``, a record's whole text, and its number over all files in the order of their names.

    Blank lines between records are no records. With ``header`` the first record of every file is left out. A quote that
    is never closed makes the rest of its file one record. ``\\r`` before a record's end is dropped.
    """
    scan = stored_scan(spark.read.option("lineSep", "\n").text(path))
    # A row per split: files and splits by number, so that no path goes with a line. Numbers grow in the order of lines.
    names = scan.select("__file", "__start", "__part").distinct()
    folder, size, file, start = span_places()
    numbered = Window.orderBy(folder, size, file, start, F.length("__part"), "__part")
    in_files = Window.orderBy(folder, size, file)
    names = names.select("*", F.dense_rank().over(in_files).alias("__in"), F.row_number().over(numbered).alias("__split"))
    lines = scan.join(F.broadcast(names), ["__file", "__start", "__part"]).select(
        F.col("__in").alias("__file"), "__split", _div_rows(F.col("__row")).alias("__block"), "__row", "value"
    )
    span = ["__file", "__split", "__block"]
    steps = lines.select(
        *span, "__row", "value",
        _ends_open(F.col("value"), sep, False).cast("int").alias("from0"),
        _ends_open(F.col("value"), sep, True).cast("int").alias("from1"),
        F.col("value").isin("", "\r").alias("blank"),
    )
    by_span = Window.partitionBy(*span).orderBy("__row")
    seen = by_span.rowsBetween(Window.unboundedPreceding, 0)

    # How each block of a split ends, and how many records begin in it, for both states. Only keys are shuffled.
    keys = _turned(steps.select(*span, "__row", "from0", "from1", "blank"), seen)
    keys = keys.select("*", *[_state(s, seen).alias(f"after{s}") for s in (0, 1)])
    keys = keys.select("*", *[F.lag(f"after{s}", 1, s).over(by_span).alias(f"before{s}") for s in (0, 1)])
    spans = keys.groupBy(*span).agg(
        *[F.max_by(f"after{s}", "__row").alias(f"from{s}") for s in (0, 1)],
        *[F.sum(((F.col(f"before{s}") == 0) & ~F.col("blank")).cast("long")).alias(f"records{s}") for s in (0, 1)],
    )

    # From here to the join a row per block.
    in_file = Window.partitionBy("__file").orderBy("__split", "__block")
    up_to = in_file.rowsBetween(Window.unboundedPreceding, 0)
    spans = _turned(spans, up_to)
    spans = spans.withColumn("after", _state(0, up_to))
    spans = spans.withColumn("begin", F.lag("after", 1, 0).over(in_file))
    spans = spans.withColumn("records", F.when(F.col("begin") == 0, F.col("records0")).otherwise(F.col("records1")))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("in_file", F.coalesce(F.sum("records").over(earlier), F.lit(0)))
    heads = (F.sum("records").over(Window.partitionBy("__file")) > 0) & (F.row_number().over(in_file) == 1)
    spans = spans.withColumn("heads", heads.cast("long") if header else F.lit(0).cast("long"))
    everywhere = Window.orderBy("__split", "__block")
    before = everywhere.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("records").over(before), F.lit(0)) - F.sum("heads").over(everywhere.rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in span], "begin", "in_file", base.alias("base"))

    own = (F.col("__file") == F.col("___file")) & (F.col("__split") == F.col("___split")) & (F.col("__block") == F.col("___block"))
    cut = _turned(steps.join(spans, own), seen)
    cut = cut.withColumn("after", _state(F.col("begin"), seen))
    cut = cut.withColumn("before", F.coalesce(F.lag("after").over(by_span), F.col("begin")))
    cut = cut.withColumn("starts", ((F.col("before") == 0) & ~F.col("blank")).cast("long"))
    cut = cut.withColumn("nth", F.sum("starts").over(seen) - 1)
    cut = cut.select(
        (F.col("base") + F.col("nth")).alias(name), (F.col("in_file") + F.col("nth")).alias("place"), "value", "__split", "__row",
        "before", "after", "starts",
    ).filter("starts = 1 or before = 1")
    if header:
        cut = cut.filter("place > 0")
    alone = cut.filter("before = 0 and after = 0").select(name, "value")
    # Only the lines of records with several meet.
    pieces = F.array_sort(F.collect_list(F.struct("__split", "__row", "value")))
    joined = cut.filter("before = 1 or after = 1").groupBy(name).agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
    return alone.unionByName(joined).withColumn("value", F.regexp_replace("value", "\r\\z", ""))


def read_quoted(spark: SparkSession, path: str, schema: T.StructType, sep: str, header: bool = False, name: str = "row_id") -> DataFrame:
    """The columns of ``schema`` and the record's number."""
    records = quoted_records(spark, path, sep, header, name)
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE}
    parsed = records.select(name, F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), options).alias("row"))
    return parsed.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields], name)
