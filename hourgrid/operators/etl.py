"""From long market facts to the hourly modelling table."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.clock import day_hour, seconds_of
from hourgrid.functions.numeric import null_safe_total
from hourgrid.operators import blocks
from hourgrid.session import computed_once

# Names and columns of the market data model.
PRODUCTION_TYPES = ["Hydro Water Reservoir", "Hydro Run-of-river and poundage", "Hydro Pumped Storage",
                    "Wind Onshore", "Wind Offshore", "Solar", "DC Link", "AC Link"]
TYPE_SUFFIX = {"Actual": "A", "DayAhead": "DA"}
UNAVAILABILITY = {"Consumption": "Cons_Unavailability", "Generation": "Gen_Unavailability",
                  "Production": "Prod_Unavailability", "Transmission": "Tran_Unavailability"}
QUOTES = ["coal_fM_01", "gas_fM_01", "oil_fM_01", "EUA_fM_01", "USD_EUR"]
DOLLAR_QUOTES = ["oil_fM_01", "coal_fM_01"]
FILL_COLUMNS = ["EUA_fM_01", "USD_EUR", "coal_fM_01", "gas_fM_01", "oil_fM_01", "oil_fM_01_EUR", "coal_fM_01_EUR"]
MODEL_NAMES = {"Wind_Onshore_DA": "WindOn_DA", "Wind_Offshore_DA": "WindOff_DA", "coal_fM_01_EUR": "Coal",
               "gas_fM_01": "NGas", "oil_fM_01_EUR": "Oil", "EUA_fM_01": "EUA"}
MODEL_COLUMNS = ["zone", "time_utc", "Price", "Load_A", "Load_DA", "WindOn_DA", "WindOff_DA", "Solar_DA",
                 "Coal", "NGas", "Oil", "EUA"]
ZONE_HOUR = ["MapCode", "time_utc"]


# ---- catalogue ------------------------------------------------------------------------------------------------------

def select_series(spec: DataFrame, name: str, types: Sequence[str] | None = None,
                  products: Sequence[str] | None = None, map_codes: Sequence[str] | None = None,
                  map_type: str | None = "BZN") -> DataFrame:
    """Rows of the series catalogue that meet every given condition."""
    checks = [F.col("Name") == name]
    if types is not None:
        checks.append(F.col("Type").isin(*types))
    if products is not None:
        checks.append(F.col("ProductionType").isin(*products))
    if map_codes is not None:
        checks.append(F.col("MapCode").isin(*map_codes))
    if map_type is not None:
        checks.append(F.col("MapTypeCode") == map_type)
    return spec.filter(reduce(lambda a, b: a & b, checks))


def distinct_values(spec: DataFrame, column: str) -> DataFrame:
    return spec.select(column).distinct()


def codes_with_prefix(spec: DataFrame, prefix: str, column: str = "MapCode") -> DataFrame:
    """Distinct codes that start with ``prefix``; a null code counts as ''."""
    return spec.filter(F.coalesce(F.col(column), F.lit("")).startswith(prefix)).select(column).distinct()


# ---- facts ----------------------------------------------------------------------------------------------------------

def in_years(values: DataFrame, start_year: int | None, end_year: int | None, ts: str = "DateTime") -> DataFrame:
    """Half-open year range as plain comparisons, so that the scan can skip row groups; None leaves an end open."""
    if start_year is not None:
        values = values.filter(F.col(ts) >= F.make_timestamp_ntz(*map(F.lit, (start_year, 1, 1, 0, 0, 0))))
    if end_year is not None:
        values = values.filter(F.col(ts) < F.make_timestamp_ntz(*map(F.lit, (end_year, 1, 1, 0, 0, 0))))
    return values


def with_ids(values: DataFrame, ids: DataFrame, key: str = "TimeSeriesID") -> DataFrame:
    """Rows whose id is in the list; an empty list gives no rows."""
    return values.join(ids.select(key), key, "left_semi")


def fetch_values(values: DataFrame, targets: DataFrame, start_year: int | None, end_year: int | None,
                 key: str = "TimeSeriesID") -> DataFrame:
    """Facts of the chosen series in the year range, with the catalogue columns.

    The catalogue side is filtered first, so Catalyst broadcasts it whenever its size allows; above that size the
    adaptive skew join splits ids that hold many facts.
    """
    return in_years(values, start_year, end_year).join(targets, key)


def roll_up_hourly(df: DataFrame, keys: Sequence[str], values: Sequence[str], how: str = "sum",
                   ts: str = "time_utc") -> DataFrame:
    """Floor to the hour and aggregate; an all-null group stays null."""
    fn = {"sum": F.sum, "mean": F.avg}[how]
    return by_hour(df, [k for k in keys if k != ts], ts, {c: fn(c) for c in values})


def by_hour(df: DataFrame, keys: Sequence[str], ts: str, values: Mapping[str, Column]) -> DataFrame:
    """Aggregate by key and hour; rows without a time stamp do not count.

    Date and hour number are the cheap key of the many input rows; the stamp is put together for the few result rows.
    It is marked as never null, because a later join would otherwise infer a null check on it and Catalyst would push
    that check, with the whole expression, down to every input row.
    """
    out = df.filter(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).cast("date").alias("_day"), F.hour(ts).alias("_hour"))
    hours = out.agg(*[c.alias(name) for name, c in values.items()])
    never_null = F.coalesce(day_hour("_day", "_hour"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return hours.select(*keys, never_null.alias(ts), *values)


def pivot_mean(df: DataFrame, index: Sequence[str], columns: Mapping[str, Column], value: str) -> DataFrame:
    """Pivot to one column per condition; duplicates are averaged.

    Conditional averages need one shuffle, where ``pivot`` plans two.
    """
    return df.groupBy(*index).agg(*[F.avg(F.when(cond, F.col(value))).alias(name) for name, cond in columns.items()])


def pivot_strict(df: DataFrame, index: str, names: Sequence[str], name: str = "name",
                 value: str = "Value") -> DataFrame:
    """Pivot that fails when an (index, name) pair occurs twice."""
    def cell(n: str) -> Column:
        hit = F.col(name) == n
        message = F.concat(F.lit(f"duplicate entry for {n} at "), F.col(index).cast("string"))
        return F.when(F.count_if(hit) > 1, F.raise_error(message).cast("double")).otherwise(
            F.max(F.when(hit, F.col(value)))).alias(n)
    return df.filter(F.col(name).isin(*names)).groupBy(index).agg(*[cell(n) for n in names])


def _column_name(product: str) -> str:
    return product.replace(" ", "_")


def prepare_generation(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                       map_codes: Sequence[str] | None = None,
                       products: Sequence[str] = tuple(PRODUCTION_TYPES)) -> DataFrame:
    """Hourly generation per zone, one column per production type and kind (``Solar_DA``, ``Wind_Onshore_A`` ...)."""
    targets = select_series(spec, "Generation", list(TYPE_SUFFIX), products, map_codes)
    facts = fetch_values(values, targets, start_year, end_year).withColumnRenamed("DateTime", "time_utc")
    columns = {f"{_column_name(p)}_{suffix}": (F.col("Type") == kind) & (F.col("ProductionType") == p)
               for kind, suffix in TYPE_SUFFIX.items() for p in products}
    return roll_up_hourly(pivot_mean(facts, ZONE_HOUR, columns, "Value"), ZONE_HOUR, list(columns))


def prepare_load(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                 map_codes: Sequence[str] | None = None) -> DataFrame:
    targets = select_series(spec, "Load", list(TYPE_SUFFIX), None, map_codes)
    facts = fetch_values(values, targets, start_year, end_year).withColumnRenamed("DateTime", "time_utc")
    columns = {f"Load_{suffix}": F.col("Type") == kind for kind, suffix in TYPE_SUFFIX.items()}
    return roll_up_hourly(pivot_mean(facts, ZONE_HOUR, columns, "Value"), ZONE_HOUR, list(columns))


def prepare_price(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                  map_codes: Sequence[str] | None = None, kind: str = "DayAhead") -> DataFrame:
    """Hourly mean price of one kind."""
    targets = select_series(spec, "Price", [kind], None, map_codes)
    facts = fetch_values(values, targets, start_year, end_year).withColumnRenamed("DateTime", "time_utc")
    return roll_up_hourly(pivot_mean(facts, ZONE_HOUR, {"Price": F.lit(True)}, "Value"), ZONE_HOUR, ["Price"], "mean")


def prepare_filling_rate(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                         map_codes: Sequence[str] | None = None) -> DataFrame:
    targets = select_series(spec, "FillingRateHydro", None, None, map_codes)
    return fetch_values(values, targets, start_year, end_year).select(
        F.col("DateTime").alias("time_utc"), F.col("Value").alias("FillingRateHydro"), "MapCode")


def prepare_physical_flow(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                          map_codes: Sequence[str] | None = None) -> DataFrame:
    targets = select_series(spec, "PhysicalFlow", None, None, map_codes)
    facts = fetch_values(values, targets, start_year, end_year).select(
        "MapCode", F.col("DateTime").alias("time_utc"), F.col("Value").alias("PhysicalFlow"))
    return roll_up_hourly(facts, ZONE_HOUR, ["PhysicalFlow"])


def prepare_installed_capacity(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                               products: Sequence[str], by_zone: bool = False) -> DataFrame:
    """Capacity by production type; averaged over the zones unless ``by_zone``."""
    facts = fetch_values(values, select_series(spec, "InstalledCapacity"), start_year, end_year)
    facts = facts.withColumnRenamed("DateTime", "time_utc")
    columns = {f"{_column_name(p)}_InstCapac": F.col("ProductionType") == p for p in products}
    return pivot_mean(facts, ZONE_HOUR if by_zone else ["time_utc"], columns, "Value")


def prepare_unavailability(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                           map_codes: Sequence[str] | None = None) -> DataFrame:
    """Unavailable capacity by kind with a row total, summed to hours."""
    targets = select_series(spec, "Unavailability", None, None, map_codes)
    facts = fetch_values(values, targets, start_year, end_year).withColumnRenamed("DateTime", "time_utc")
    columns = {name: F.col("Type") == kind for kind, name in UNAVAILABILITY.items()}
    wide = pivot_mean(facts, ZONE_HOUR, columns, "Value")
    wide = wide.withColumn("Total_Unavailability", null_safe_total(
        [c for c in wide.columns if c.endswith("_Unavailability")]))
    return roll_up_hourly(wide, ZONE_HOUR, [*columns, "Total_Unavailability"])


def prepare_market(spec: DataFrame, values: DataFrame, start_year: int | None, end_year: int | None,
                   map_codes: Sequence[str] | None = None, products: Sequence[str] = tuple(PRODUCTION_TYPES),
                   price_kind: str = "DayAhead", how: str = "left") -> DataFrame:
    """Price, load and generation by (zone, hour) in one pass over the facts.

    Equal to ``prepare_price`` joined with ``prepare_load`` and ``prepare_generation`` the way ``how`` says (left: hours with
    a price, inner: hours with all three), but the facts are scanned once instead of three times and nothing is
    joined afterwards. As in a join, a null zone has a price but meets neither load nor generation.
    """
    kinds = list(TYPE_SUFFIX)
    targets = (select_series(spec, "Price", [price_kind], None, map_codes)
               .unionAll(select_series(spec, "Load", kinds, None, map_codes))
               .unionAll(select_series(spec, "Generation", kinds, products, map_codes)))
    facts = fetch_values(values, targets, start_year, end_year).withColumnRenamed("DateTime", "time_utc")
    name, kind = F.col("Name"), F.col("Type")
    columns = {"Price": name == "Price"}
    columns.update({f"Load_{suffix}": (name == "Load") & (kind == k) for k, suffix in TYPE_SUFFIX.items()})
    columns.update({f"{_column_name(p)}_{suffix}": (name == "Generation") & (kind == k) & (F.col("ProductionType") == p)
                    for k, suffix in TYPE_SUFFIX.items() for p in products})
    needed = {"left": ["Price"], "inner": ["Price", "Load", "Generation"]}[how]
    seen = {f"_{n}": F.count_if(name == n) for n in needed}
    cells = facts.groupBy(*ZONE_HOUR).agg(*[c.alias(n) for n, c in seen.items()], *[
        F.avg(F.when(cond, F.col("Value"))).alias(c) for c, cond in columns.items()])
    others = [c for c in columns if c != "Price"]
    hours = by_hour(cells, ["MapCode"], "time_utc", {
        **{n: F.sum(n) for n in seen}, "Price": F.avg("Price"), **{c: F.sum(c) for c in others}})
    hours = hours.withColumns({c: F.when(F.col("MapCode").isNotNull(), F.col(c)) for c in others})
    if how == "inner":
        hours = hours.filter(F.col("MapCode").isNotNull())
    for n in seen:
        hours = hours.filter(F.col(n) > 0)
    return hours.drop(*seen)


# ---- daily quotes ---------------------------------------------------------------------------------------------------

# Fixed value: what counts as a date in text.
DATE_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?Z?)?$"


def coerce_date(value: str | Column) -> Column:
    """Dates, time stamps and their usual texts to a date; text that is neither becomes null (and then fails every range
    check). A text is year, month and day, with a time of day after a space or ``T`` or without."""
    value = F.col(value) if isinstance(value, str) else value
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(DATE_TEXT), F.substring_index(F.substring_index(text, " ", 1), "T", 1).try_cast("date"))


def in_dates(df: DataFrame, start: str | None, end: str | None, date: str = "Date") -> DataFrame:
    """Inclusive start, exclusive end; None leaves an end open. Rows without a date go."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) < F.lit(end).cast("date"))
    return df.filter(F.col(date).isNotNull())


def convert_currency(df: DataFrame, columns: Sequence[str] = tuple(DOLLAR_QUOTES), rate: str = "USD_EUR",
                     divide: bool = True) -> DataFrame:
    """Add ``<column>_EUR`` for every column present when the rate is present too."""
    if rate not in df.columns:
        return df
    def convert(c: str) -> Column:
        return F.try_divide(F.col(c), F.col(rate)) if divide else F.col(c) * F.col(rate)
    return df.withColumns({f"{c}_EUR": convert(c) for c in columns if c in df.columns})


def prepare_quotes(raw: DataFrame, start: str | None = None, end: str | None = None, names: Sequence[str] = tuple(QUOTES)) -> DataFrame:
    """Daily quotes (Date, name, Value[, RIC]) to one wide row per day with converted currencies."""
    clean = in_dates(raw.drop("RIC").withColumn("Date", coerce_date("Date")), start, end)
    return convert_currency(pivot_strict(clean, "Date", names))


def upsample_daily(df: DataFrame, date: str = "Date", ts: str = "time_utc") -> DataFrame:
    """Repeat every daily row for its 24 hours."""
    others = [c for c in df.columns if c != date]
    hours = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_hour"))
    return hours.select((F.col(date).cast("timestamp_ntz")
                         + F.make_dt_interval(hours=F.col("_hour"))).alias(ts), *others)


# ---- modelling table ------------------------------------------------------------------------------------------------

def join_quotes(hourly: DataFrame, quotes: DataFrame, how: str = "left", ts: str = "time_utc",
                date: str = "Date") -> DataFrame:
    """Quotes of the day for every zone and hour: joined on the day, so the small side is not repeated 24 times."""
    daily = quotes.withColumnRenamed(date, "_day")
    return hourly.withColumn("_day", F.col(ts).cast("date")).join(daily, "_day", how).drop("_day")


def join_series(left: DataFrame, right: DataFrame, on: Sequence[str] = ("time_utc",), how: str = "left") -> DataFrame:
    """Put two series next to each other by time; the right one has a row per time stamp."""
    return left.join(right, list(on), how)


def merge_datasets(price: DataFrame, load: DataFrame, generation: DataFrame, quotes: DataFrame,
                   how: str = "left") -> DataFrame:
    """Price, load and generation by (zone, hour), then the quotes of the day.

    The three hourly inputs hold one row per (zone, hour), so no key is hot, and the joins share one partitioning.
    """
    merged = price.join(load, ZONE_HOUR, how).join(generation, ZONE_HOUR, how)
    return join_quotes(merged, quotes, how)


def build_training_table(merged: DataFrame, zone: str | None = None, fill: bool = True,
                         fill_columns: Sequence[str] = tuple(FILL_COLUMNS)) -> DataFrame:
    """Fill weekend gaps of the quotes inside each zone, rename, and keep the modelling columns and the zone."""
    if zone is not None:
        merged = merged.filter(F.col("MapCode") == zone)
    if fill:
        present = [c for c in fill_columns if c in merged.columns]
        merged = blocks.forward_fill(merged, present, ["MapCode"], "time_utc")
    return merged.withColumnsRenamed({**MODEL_NAMES, "MapCode": "zone"}).select(*MODEL_COLUMNS)


# ---- general row operators ------------------------------------------------------------------------------------------

def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; partial minimum on the map side, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, *[f"_row.{c}" for c in (*order, *rest)])


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "variable", "value")


def complete_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of the groups in which ``value`` is never missing. Groups are days or cells, that is a few dozen rows."""
    whole = F.count_if(F.col(value).isNull()).over(Window.partitionBy(*keys)) == 0
    return df.withColumn("_whole", whole).filter("_whole").drop("_whole")


def distinct_gate(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("zone",),
                  minimum: int = 5) -> DataFrame:
    """Per key and column: the number of different values and whether a smooth term is allowed."""
    counts = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return (counts.unpivot(list(keys), list(columns), "feature", "distinct_values")
            .withColumn("smooth", F.col("distinct_values") >= minimum))


# ---- reports on the hourly table ------------------------------------------------------------------------------------

def coverage(df: DataFrame, keys: Sequence[str] = ("zone",), ts: str = "time_utc") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def missing_by_hour(df: DataFrame, value: str, keys: Sequence[str] = ("zone",), date: str = "local_date",
                    hour: str = "hour") -> DataFrame:
    """Missing cells per hour and their dates (bounded by the number of days)."""
    gap = F.col(value).isNull()
    dates = F.array_sort(F.collect_set(F.when(gap, F.col(date).cast("string"))))
    return df.groupBy(*keys, hour).agg(F.count_if(gap).alias("missing"),
                                       F.concat_ws(",", dates).alias("missing_dates"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str], bins: int = 1024,
                    small: int = 10_000) -> DataFrame:
    """``keys, share, quantile``: exact quantiles with linear interpolation, without all values of a key in one task.

    The ranks a quantile needs are located by counting: values of an interval are counted in equal bins on the map
    side, and a bin that holds a wanted rank becomes the next interval, between the least and greatest value in it,
    until it has at most ``small`` rows or one value. Only those rows are ever gathered. A round reads the rows once; their number
    grows with the logarithm of the spread of the values. Nulls do not count; a key without values has no rows.
    """
    rows = computed_once(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = computed_once(total.select(*keys, "_c", "_lo", "_hi", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share"))
                           .withColumn("_at", F.col("share") * (F.col("_c") - 1)))
    ranks = F.array_distinct(F.flatten(F.collect_set(F.array(F.floor("_at"), F.ceil("_at")))))
    open_ = computed_once(wanted.groupBy(*keys, "_lo", "_hi", "_c").agg(ranks.alias("_ranks")).withColumn("_below", F.lit(0).cast("long")))
    done = open_.filter((F.col("_c") <= small) | (F.col("_lo") == F.col("_hi")))
    interval = [*keys, "_lo", "_hi"]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    inside = F.col("r._v").between(F.col("i._lo"), F.col("i._hi"))

    def rows_in(intervals: DataFrame) -> DataFrame:
        """Rows beside the interval they are in: intervals are few, some for each key."""
        return rows.alias("r").join(intervals.alias("i"), [*same, inside]).select("i.*", "r._v")
    while True:
        open_ = open_.filter((F.col("_c") > small) & (F.col("_lo") < F.col("_hi")))
        if open_.isEmpty():
            break
        width = F.col("_hi") / 2 - F.col("_lo") / 2  # halves, since the difference may overflow
        cell = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * bins), F.lit(bins - 1))
        counted = (rows_in(open_).groupBy(*interval, "_below", "_ranks", cell.alias("_cell"))
                   .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_l"), F.max("_v").alias("_h")))
        before = F.sum("_n").over(Window.partitionBy(*interval).orderBy("_cell")) - F.col("_n") + F.col("_below")
        cut = counted.withColumn("_b", before)
        cut = cut.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_b")) & (r < F.col("_b") + F.col("_n"))))
        open_ = computed_once(cut.filter(F.size("_ranks") > 0).select(
            *keys, F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_n").alias("_c"), "_ranks", F.col("_b").alias("_below")))
        done = done.unionByName(open_.filter((F.col("_c") <= small) | (F.col("_lo") == F.col("_hi"))))
    done = computed_once(done)
    flat = done.filter(F.col("_lo") == F.col("_hi")).select(*keys, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
    sorted_ = (rows_in(done.filter(F.col("_lo") < F.col("_hi"))).groupBy(*interval, "_below", "_ranks")
               .agg(F.sort_array(F.collect_list("_v")).alias("_values")))
    named = sorted_.select(*keys, "_values", "_below", F.explode("_ranks").alias("_rank")).select(
        *keys, "_rank", F.get("_values", (F.col("_rank") - F.col("_below")).cast("int")).alias("_v"))
    values = flat.unionByName(named)

    def at(end: str) -> DataFrame:
        return values.select(*[F.col(k).alias(f"_{end}_{k}") for k in keys], F.col("_rank").alias(f"_{end}"), F.col("_v").alias(f"_{end}_value"))
    out = wanted.withColumns({"_low_rank": F.floor("_at"), "_high_rank": F.ceil("_at")})
    for end in ("low", "high"):
        out = out.join(at(end), [*[F.col(k).eqNullSafe(F.col(f"_{end}_{k}")) for k in keys], F.col(f"_{end}_rank") == F.col(f"_{end}")])
    share = F.col("_at") - F.col("_low_rank")
    return out.select(*keys, "share", (F.col("_low_value") * (1 - share) + F.col("_high_value") * share).alias("quantile"))


def hour_profile(df: DataFrame, value: str, keys: Sequence[str] = ("zone",), hour: str = "hour", small: int = 1_000_000) -> DataFrame:
    """Median and quartiles by hour, linear interpolation.

    Groups of at most ``small`` values (a century of one hour of the day is 36,500) are sorted as they are; if there is a larger one,
    the ranks are located by counting (``exact_quantiles``). Both give the same rows.
    """
    most = df.groupBy(*keys, hour).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    named = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    if most <= small:
        q = df.groupBy(*keys, hour).agg(F.percentile(value, F.array(*map(F.lit, named.values()))).alias("_q"))
        return q.select(*keys, hour, *[F.col("_q")[k].alias(n) for k, n in enumerate(named)])
    found = exact_quantiles(df, value, list(named.values()), [*keys, hour])
    wide = found.groupBy(*keys, hour).agg(*[F.max(F.when(F.col("share") == q, F.col("quantile"))).alias(n) for n, q in named.items()])
    every = df.select(*keys, hour).distinct().alias("e")  # hours without a value have nulls
    match = [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*keys, hour)]
    return every.join(wide.alias("w"), match, "left").select("e.*", *[F.col(f"w.{n}") for n in named])


def modal_step(df: DataFrame, keys: Sequence[str] = ("zone",), ts: str = "time_utc") -> DataFrame:
    """Most frequent distance between neighbouring time stamps in seconds; the smallest wins a tie."""
    rows = blocks.carried(df.select(*keys, ts, seconds_of(ts).alias("_s")), {"_top": F.max("_s")},
                          lambda w: {"_carry": F.max("_top").over(w)}, keys, ts)
    before = F.lag("_s").over(Window.partitionBy(*keys, blocks.BLOCK).orderBy(ts))
    steps = rows.select(*keys, (F.col("_s") - F.coalesce(before, F.col("_carry"))).alias("step"))
    counts = steps.filter("step is not null").groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("step", F.struct("n", -F.col("step"))).alias("step_seconds"))
