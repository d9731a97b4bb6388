"""Chart data as rows, and the numbers of an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.numbers import axis_ticks, format_tick, parse_float

#: Series colours in order.
PALETTE = ("#4472C4", "#ED7D31", "#A5A5A5", "#FFC000", "#5B9BD5", "#70AD47", "#264478", "#9E480E")
#: Chart kinds, the first that a chart has decides.
MODES = ("doughnut", "pie", "bar", "scatter", "column")


def value_range(value: Column) -> tuple[Column, Column]:
    """Low and high of an axis over values: low at most 0, one apart at least; null without values."""
    low = F.least(F.min(value), F.lit(0.0))
    high = F.max(value)
    return F.when(F.max(value).isNotNull(), low), F.when(F.abs(high - low) < 1e-9, low + 1.0).otherwise(high)


def x_range(value: Column) -> tuple[Column, Column]:
    low, high = F.min(value), F.max(value)
    return low, F.when(F.abs(high - low) < 1e-9, low + 1.0).otherwise(high)


def axes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Range and tick labels of a value axis for each group."""
    low, high = value_range(F.col(value).cast("double"))
    ranged = df.groupBy(*by).agg(low.alias("low"), high.alias("high"))
    return ranged.withColumn("ticks", F.when(F.col("low").isNotNull(), F.transform(axis_ticks(F.col("low"), F.col("high")), format_tick)))


def points(series: DataFrame) -> DataFrame:
    """One row for each point of series (series, categories, values as parallel arrays of text), in order;
    what is no number is left out."""
    rows = series.select("series", F.posexplode("values").alias("pt_idx", "raw"), "categories")
    return rows.select("series", "pt_idx", F.get("categories", F.col("pt_idx")).alias("category"), parse_float(F.col("raw")).alias("y")).where(F.col("y").isNotNull())


def colour(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int"))


def mode(kinds: Column) -> Column:
    """The kind of a chart out of the kinds of its plots."""
    out = F.lit(None).cast("string")
    for kind in reversed(MODES):
        out = F.when(F.array_contains(kinds, kind), kind).otherwise(out)
    return out


#: Parts of a format code that make it one of dates.
DATE_PARTS = ("yy", "mmm", "dd", "/yy", "h:mm", "d-m")


def is_date_format(code: Column) -> Column:
    """Whether a cache's format code shows dates or times; a null one does not."""
    low = F.lower(code)
    out = F.lit(False)
    for part in DATE_PARTS:
        out = out | low.contains(part)
    return F.coalesce(out, F.lit(False))


def types(points: DataFrame, by: list[str]) -> DataFrame:
    """Of each chart its type, the kind of its first series or 'combo' where others differ, and its mode.

    ``points`` has series_no and kind besides the columns ``by`` that name a chart.
    """
    return points.groupBy(*by).agg(
        F.when(F.count_distinct("kind") > 1, "combo").otherwise(F.min_by("kind", "series_no")).alias("type"),
        F.coalesce(mode(F.collect_set("kind")), F.lit("column")).alias("mode"),
    )


def family_means(rows: DataFrame, family: str, own: str, other: str) -> DataFrame:
    """Means of two metrics by family, and the ratio of their sums (``other`` to ``own``; null where own adds up to 0)."""
    return rows.groupBy(family).agg(F.avg(own).alias("own"), F.avg(other).alias("other"), F.try_divide(F.sum(other), F.sum(own)).alias("ratio"))
