"""Global positions and prefix sums without a single-task window.

Rows are put into order-preserving buckets whose bounds are quantiles of a numeric score, so a bucket
holds about ``1/buckets`` of the rows. Each bucket is summed, the (at most ``buckets`` rows per group)
sums are accumulated, and every bucket is then ranked on its own. Bounds are literals in the plan, so
a recomputed task puts its rows into the same buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Rows looked at per bucket when choosing bounds.
SAMPLE = 1000
_BUCKET, _SCORE, _WEIGHT, _SUM, _BEFORE = "__bucket", "__score", "__weight", "__sum", "__before"


def squash(col: Column) -> Column:
    """A long as a fraction below one; a monotone tie-breaker for scores."""
    return col.cast("double") / F.lit(float(2**62))


def text_score(col: Column) -> Column:
    """The first six bytes of a text as a fraction below one; monotone in byte order."""
    head = F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**48))


def _bounds(df: DataFrame, score: Column, buckets: int) -> list[float]:
    """Quantiles of the score as bucket bounds.

    From about ``SAMPLE`` rows per bucket, so the summaries that meet in one task stay small. A sample
    only evens out the buckets; every row is then placed and ranked.
    """
    points = [i / buckets for i in range(1, buckets)]
    if not points:
        return []
    scores = df.select(score.alias(_SCORE))
    rows, wanted = scores.count(), SAMPLE * buckets
    if rows > wanted:
        scores = scores.sample(wanted / rows, seed=1)
    row = scores.agg(F.percentile_approx(_SCORE, points, 10 * buckets + 1000).alias("q")).first()
    return sorted(set(row["q"] or []))


def prefix_sum(
    df: DataFrame,
    order: list[str],
    score: Column,
    weight: Column | None = None,
    by: list[str] | None = None,
    name: str = "offset",
    total: str | None = None,
    buckets: int | None = None,
    peek: DataFrame | None = None,
    store: bool = False,
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows (of the same ``by`` group).

    ``order`` must order the rows of a group totally and ``score`` must not decrease along it.
    ``total`` names an optional column for the sum over the whole group. ``peek`` may be a cheaper
    table with the same scores, used only to choose bucket bounds. ``store`` writes ``df`` out first: the
    rows are read three times, which only a plain scan can afford.
    """
    by = by or []
    if store:
        df = written(df, "ranked")
    weight = F.lit(1) if weight is None else weight
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = df.withColumn(_SCORE, score.cast("double"))
    bounds = _bounds(df if peek is None else peek, score.cast("double"), buckets)
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        scored = Bucketizer(splits=splits, inputCol=_SCORE, outputCol=_BUCKET).transform(scored)
    else:
        scored = scored.withColumn(_BUCKET, F.lit(0.0))
    scored = scored.withColumn(_BUCKET, F.col(_BUCKET).cast("int")).withColumn(_WEIGHT, weight.cast("long"))

    keys = [*by, _BUCKET]
    sums = scored.groupBy(*keys).agg(F.sum(_WEIGHT).alias(_SUM))
    # At most `buckets` rows per group reach one task here.
    running = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    starts = sums.select(
        *keys,
        F.coalesce(F.sum(_SUM).over(running), F.lit(0)).alias(_BEFORE),
        *([F.sum(_SUM).over(group).alias(total)] if total else []),
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = scored.withColumn(name, F.coalesce(F.sum(_WEIGHT).over(within), F.lit(0)))
    # The ranked side is already hash-partitioned and sorted on the keys: only `starts` moves.
    return (
        ranked.join(starts, keys)
        .withColumn(name, F.col(name) + F.col(_BEFORE))
        .drop(_BUCKET, _SCORE, _WEIGHT, _BEFORE)
    )


def total_order(df: DataFrame, order: list[str], name: str = "rank", by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Add the place 0, 1, 2, ... of each row in the order of the columns ``order``, within its ``by`` group.

    Range partitioning samples whole keys, so rows with one count, score or beginning are still dealt to many
    tasks; wholly equal keys are told apart by their place in the input. The sorted parts are written, and a row's
    place is its place in its file plus the rows of its group in earlier files: no row meets a window. ``total``
    names an optional column for the number of rows of the group. Nulls come first.
    """
    by = by or []
    keys = [*by, *order, "__tie"]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    # Parts come from one shuffle and are written in its order; more files of one part are numbered as well.
    ordered = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie"), "ordered")
    placed = ordered.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    spans = placed.groupBy("__file", *by).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # A row per file and group. Part numbers grow in length: part-100000 follows part-99999.
    earlier = Window.partitionBy(*by).orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(
        F.col("__file").alias("__in"),
        *[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)],
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
        *([F.sum("__rows").over(Window.partitionBy(*by)).alias(total)] if total else []),
    )
    same = F.col("__file") == F.col("__in")
    for i, c in enumerate(by):
        same = same & placed[c].eqNullSafe(F.col(f"__by_{i}"))
    numbered = placed.join(starts, same).withColumn(name, F.col("__shift") + F.col("__row"))
    return numbered.select(*df.columns, name, *([total] if total else []))


def stored_scan(scan: DataFrame) -> DataFrame:
    """The rows of a file scan, written, with their input split ``__file, __start`` and their place ``__part, __row``.

    A split's rows are written by one task in order. The places are those in the written files, so every later reader
    sees the same ones however its own scan is cut.
    """
    kept = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    placed = F.col("_metadata.file_name").alias("__part"), F.col("_metadata.row_index").alias("__row")
    return written(kept, "lines").select("*", *placed)


def span_places() -> list[Column | str]:
    """The order of input splits. Part numbers grow in length: part-100000 follows part-99999."""
    part = F.regexp_extract("__file", "[^/]*$", 0)
    return [F.regexp_extract("__file", "^.*/", 0), F.length(part), part, "__start"]


def number_scan(scan: DataFrame, name: str = "row_id", file: str | None = None) -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, ... in file and line order, without a shuffle of rows.

    With ``file`` numbers start again in every file and that column holds the file's path.

    The rows are written once with the input split they came from; a row's number is its place among the split's
    written rows plus the rows of earlier splits. Counts and rows come from the same written table, so they agree
    even if the two scans of it are cut differently.
    """
    placed = stored_scan(scan)
    spans = placed.groupBy("__file", "__start", "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # A row per input split and part; a part only ends inside of a split where a writer limits its files.
    order = [*span_places(), F.length("__part"), "__part"]
    within = Window.partitionBy("__file").orderBy(*order[-3:]) if file else Window.orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")
    starts = spans.select("__file", "__start", "__part", shift.alias("__shift"))
    numbered = placed.join(starts, ["__file", "__start", "__part"]).withColumn(name, F.col("__shift") + F.col("__row"))
    if file:
        numbered = numbered.withColumn(file, F.col("__file"))
    return numbered.select(*scan.columns, name, *([file] if file else []))
