"""Windows over long series, cut into bounded blocks.

A window keyed by the series alone puts one whole series into one task. Everything here instead keys its windows by
(series, block of days):

* ``windowed``   for features that look back a known number of days. Rows are also copied into the later blocks that
  need them as history, windows run inside a block, and only the rows a block owns are kept.
* ``carried``    for features that look back without limit (fill, running sum, position). Each block is reduced to one
  summary row, the summaries are accumulated, and every block receives what came before it.

Both give the same rows as an unblocked window; a task never holds more than one block and its history.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
OWN = "_own"
DEFAULT_BLOCK_DAYS = 360
SMALL_ROWS = 50_000  # a table of at most so many rows is joined without shuffling the long side

Stage = Callable[[WindowSpec], dict[str, Column]]


def block_number(date: str | Column, block_days: int, shift_days: int = 0) -> Column:
    return F.floor((F.unix_date(date) + shift_days) / F.lit(block_days)).cast("int")


def with_history(df: DataFrame, date: str, lookback_days: int, block_days: int | None = None) -> DataFrame:
    """Copy every row into its own block and into the later blocks whose history reaches back to it."""
    block_days = block_days or max(DEFAULT_BLOCK_DAYS, 4 * lookback_days)
    day = F.col(date).cast("date")
    home = block_number(day, block_days)
    if lookback_days <= 0:
        return df.withColumns({BLOCK: home, OWN: F.lit(True)})
    last = block_number(day, block_days, lookback_days)
    return (df.withColumn(BLOCK, F.explode(F.sequence(home, last)))
            .withColumn(OWN, F.col(BLOCK) == home))


def windowed(df: DataFrame, lookback_days: int, *stages: Stage, keys: Sequence[str] = ("zone",),
             order: Sequence[str] = ("local_date", "hour"), block_days: int | None = None,
             co_locate: bool = False) -> DataFrame:
    """Add window columns stage by stage; a later stage may use the columns of an earlier one.

    ``order[0]`` is the date (or timestamp) that places a row in a block. ``lookback_days`` is the total reach of all
    stages together. ``co_locate`` partitions once by (series, block), for stages that also use ``day_window``: those
    then need neither another shuffle nor another sort.
    """
    framed = with_history(df, order[0], lookback_days, block_days)
    if co_locate:
        framed = framed.repartition(*keys, BLOCK)
    window = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    for stage in stages:
        framed = framed.withColumns(stage(window))
    return framed.filter(OWN).drop(BLOCK, OWN)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition by ``keys`` for work that is heavy per row, such as a fit per group.

    Adaptive execution merges shuffle partitions by their bytes and would put all the fits of a small table into one
    task; a stated number of partitions is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def day_window(keys: Sequence[str], date: str, hour: str) -> WindowSpec:
    """Window over one day of a series, inside its block."""
    return Window.partitionBy(*keys, BLOCK, date).orderBy(hour)


def whole_day(keys: Sequence[str], date: str) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK, date)


def beside(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of statistics to a long series; null keys match.

    The statistics are worked out first. If they turn out to have at most ``SMALL_ROWS`` rows, they are sent to the tasks
    and the series stays where it is; a shuffle by a key like the zone would bring whole series together. With more
    rows it is an ordinary join.
    """
    rows = small.limit(SMALL_ROWS + 1).collect()
    if len(rows) <= SMALL_ROWS:
        small = F.broadcast(df.sparkSession.createDataFrame(rows, small.schema))
    small = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    matches = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(small, matches, how).drop(*[f"_on_{c}" for c in on])


def carried(df: DataFrame, summary: dict[str, Column], before: Callable[[WindowSpec], dict[str, Column]],
            keys: Sequence[str], date: str, block_days: int | None = None) -> DataFrame:
    """Attach to every row a block number and the accumulated ``summary`` of all earlier blocks of its series.

    ``before`` receives the window over the earlier block summaries and returns the carried columns. The summary has
    one row per series and block, so its windows stay small however long the raw series is. ``df`` is read twice, the
    first time only for the columns of the summary.
    """
    block_days = block_days or DEFAULT_BLOCK_DAYS
    placed = df.withColumn(BLOCK, block_number(F.col(date).cast("date"), block_days))
    summaries = placed.groupBy(*keys, BLOCK).agg(*[c.alias(name) for name, c in summary.items()])
    earlier = (Window.partitionBy(*keys).orderBy(BLOCK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = before(earlier)
    summaries = summaries.select(*keys, BLOCK, *[c.alias(name) for name, c in carry.items()])
    return beside(placed, summaries, [*keys, BLOCK])  # a null key is a series like any other


def inside(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    """Window from the start of a block to the current row."""
    return (Window.partitionBy(*keys, BLOCK).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def forward_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("zone",), order: str = "time_utc",
                 block_days: int | None = None) -> DataFrame:
    """Last known value per series in time order, whatever the row order of the input."""
    summary = {f"_last_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) for c in columns}
    out = carried(df, summary,
                  lambda w: {f"_carry_{c}": F.last(f"_last_{c}", ignorenulls=True).over(w) for c in columns},
                  keys, order, block_days)
    w = inside(keys, [order])
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_carry_{c}")) for c in columns}
    return out.withColumns(filled).select(*df.columns)


def position(df: DataFrame, keys: Sequence[str] = ("zone",), order: Sequence[str] = ("local_date", "hour"),
             name: str = "position", block_days: int | None = None) -> DataFrame:
    """1-based row position in each series plus its length (``<name>_count``)."""
    out = carried(df, {"_rows": F.count(F.lit(1))},
                  lambda w: {"_before": F.coalesce(F.sum("_rows").over(w), F.lit(0)),
                             f"{name}_count": F.sum("_rows").over(Window.partitionBy(*keys))},
                  keys, order[0], block_days)
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return (out.withColumn(name, F.col("_before") + F.row_number().over(w))
            .select(*df.columns, name, f"{name}_count"))
