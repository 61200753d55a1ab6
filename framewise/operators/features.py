"""Weekly demand features for the forecaster.

Sales are summed per (sku, week) with map-side combine and gathered into one
array per SKU, so a SKU holding a third of all lines is still one small row.
Rolling frames, EWM and the feature matrix work on these arrays: numpy takes
some hundred SKUs at once, whose weeks lie behind each other in flat arrays,
and one explode makes the rows.  The other operators (lags, encodings) are
windows over the exploded grid, which shares one partitioning by ``sku_id``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.expr import week_monday

LAGS = [1, 2, 3, 4, 8, 13, 26, 52]
ROLL_MEANS = [4, 8, 13, 26]
EWM_SPANS = [4, 13]
# Fixed values: (month, day) pairs whose week is flagged as a holiday week.
HOLIDAYS = [(1, 1), (1, 26), (5, 27), (7, 4), (8, 15), (10, 2), (11, 25), (11, 26), (12, 25), (12, 31)]
CAT_COLS = ["price_point", "frame_shape", "material", "category", "gender"]
SLICE_WEEKS = 1 << 16           # weeks that numpy takes at once

FEATURE_COLUMNS = (
    ["month", "quarter", "week_of_year", "year", "month_sin", "month_cos", "woy_sin", "woy_cos",
     "q_sin", "q_cos", "has_holiday_week", "weeks_since_launch"]
    + [f"lag_{n}w" for n in LAGS]
    + [f"rolling_mean_{w}w" for w in ROLL_MEANS]
    + ["rolling_std_13w", "rolling_max_13w", "rolling_median_13w"]
    + [f"ewm_{s}w" for s in EWM_SPANS]
    + ["sku_mean_demand", "sku_log_mean", "sku_cv", "sku_month_mean", "sku_woy_mean"]
    + ["sku_mean_x_month_sin", "sku_mean_x_woy_sin", "sku_log_x_lag4w", "prior_x_ewm4", "prior_x_ewm13"]
    + ["trend_index_lag1w", "sentiment_lag1w", "mention_lag1w"]
    + [f"{c}_enc" for c in CAT_COLS]
    + ["days_of_supply", "stockout_risk_flag"]
)


def _w(order: str = "date") -> Window:
    return Window.partitionBy("sku_id").orderBy(order)


def _dense(entries: Column, n: int, empty: Column, value: str) -> Column:
    """An array with one cell per week 0 .. n - 1 from ``entries`` (structs
    with week ``w`` and ``value``, sorted, one a week); gaps hold ``empty``."""
    after = lambda i: F.when(i > 0, F.try_element_at(entries, i)["w"] + 1).otherwise(F.lit(0))
    return F.flatten(F.concat(
        F.transform(entries, lambda x, i: F.concat(F.array_repeat(empty, x["w"] - after(i)), F.array(x[value]))),
        F.array(F.array_repeat(empty, F.lit(n - 1) - F.element_at(entries, -1)["w"]))))


def demand_series(sales: DataFrame) -> tuple[DataFrame, date | None, int]:
    """``sku_id`` and ``q``, the units of every week as one array, with the
    first Monday and the number of weeks (None, 0 without sales).

    Lines are summed per (sku, week) with map-side combine, then gathered per
    SKU (at most one entry per calendar week, so a SKU holding a third of all
    lines is still one small row) and spread over the weeks."""
    wk = week_monday("date")
    bounds = sales.agg(F.min(wk).alias("lo"), F.max(wk).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    raw = (sales.select("sku_id", wk.alias("date"), "quantity_sold")
                .groupBy("sku_id", "date").agg(F.sum("quantity_sold").cast("bigint").alias("demand")))
    # as many partitions as the session has: the few bytes here become many rows later
    raw = raw.repartition(int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sku_id")
    if lo is None:
        return raw.select("sku_id", F.array("demand").alias("q")).limit(0), None, 0
    n = (hi - lo).days // 7 + 1
    series = raw.where("date is not null").groupBy("sku_id").agg(F.array_sort(F.collect_list(F.struct(
        (F.datediff("date", F.lit(lo)) / 7).cast("int").alias("w"), F.col("demand").alias("q")))).alias("_s"))
    return series.select("sku_id", _dense(F.col("_s"), n, F.lit(0).cast("bigint"), "q").alias("q")), lo, n


def weekly_demand(sales: DataFrame | DemandSeries) -> DataFrame:
    """Dense SKU x week grid of demand (A07): Monday of each sale, units
    summed per (sku, week); every Monday between the global first and last
    week for every SKU that sold, missing weeks 0.  The series of
    :func:`demand_series`, exploded by position; the result is hash-partitioned
    by ``sku_id``, which every later per-SKU window and SKU-grain join reuses."""
    series, lo = (sales.frame, sales.lo) if isinstance(sales, DemandSeries) else demand_series(sales)[:2]
    return (series.select("sku_id", F.posexplode("q").alias("_w", "demand"))
                  .select("sku_id", F.date_add(F.lit(lo).cast("date"), F.col("_w") * 7).alias("date"), "demand"))


def calendar_features(weekly: DataFrame) -> DataFrame:
    """month, quarter, ISO week, calendar year of the Monday and their
    sin/cos encodings (week divisor stays 52 in ISO week 53) (A08)."""
    two_pi = F.lit(2.0 * math.pi)
    return (weekly.withColumn("month", F.month("date"))
                  .withColumn("quarter", F.quarter("date"))
                  .withColumn("week_of_year", F.weekofyear("date"))
                  .withColumn("year", F.year("date"))
                  .withColumn("month_sin", F.sin(two_pi * F.col("month") / F.lit(12.0)))
                  .withColumn("month_cos", F.cos(two_pi * F.col("month") / F.lit(12.0)))
                  .withColumn("woy_sin", F.sin(two_pi * F.col("week_of_year") / F.lit(52.0)))
                  .withColumn("woy_cos", F.cos(two_pi * F.col("week_of_year") / F.lit(52.0)))
                  .withColumn("q_sin", F.sin(two_pi * F.col("quarter") / F.lit(4.0)))
                  .withColumn("q_cos", F.cos(two_pi * F.col("quarter") / F.lit(4.0))))


def calendar_weeks(weekly: DataFrame) -> DataFrame:
    """Every Monday of the grid once, from its two bounds."""
    b = weekly.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return b.where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAYS"))).alias("date"))


def holiday_week_flag(weekly: DataFrame) -> DataFrame:
    """1 when any of the 7 days from the Monday is a fixed holiday."""
    code = lambda d: F.month(d) * 32 + F.dayofmonth(d)
    # how many holidays lie up to each day of the year; a week may end in the next one
    upto = np.cumsum(np.bincount([32 * m + d for m, d in HOLIDAYS], minlength=13 * 32)).tolist()
    first, last, table = code(F.col("date")), code(F.date_add("date", 6)), F.lit(upto).cast("array<int>")
    hits = F.get(table, last) - F.get(table, first - 1) + F.when(last < first, upto[-1]).otherwise(0)
    return weekly.withColumn("has_holiday_week", (hits > 0).cast("int"))


def weeks_since_launch(weekly: DataFrame, products: DataFrame) -> DataFrame:
    """(week - launch date) days / 7, NULL -> 52, floored at 0 (A10)."""
    if "launch_date" not in products.columns:
        return weekly.withColumn("weeks_since_launch", F.lit(52.0))
    launch = products.select("sku_id", "launch_date")
    w = F.datediff(F.col("date"), F.col("launch_date")) / F.lit(7.0)
    return (weekly.join(launch, "sku_id", "left")
                  .withColumn("weeks_since_launch", F.greatest(F.coalesce(w, F.lit(52.0)), F.lit(0.0)))
                  .drop("launch_date"))


def lag_features(weekly: DataFrame | DemandSeries, lags: Sequence[int] = tuple(LAGS)) -> DataFrame:
    """lag_{1,2,3,4,8,13,26,52}w per SKU, missing -> 0."""
    if isinstance(weekly, DemandSeries):
        return _on_series(weekly, ", ".join(f"lag_{n}w bigint" for n in lags), lambda s: {
            f"lag_{n}w": pa.array(s.back(s.q, n), pa.int64(), mask=s.back(s.null, n)) for n in lags})
    out = weekly
    for n in lags:
        out = out.withColumn(f"lag_{n}w", F.lag("demand", n, 0).over(_w()))
    return out


@dataclass(frozen=True)
class DemandSeries:
    """The weekly grid before it becomes rows: what :func:`weekly_demand`
    explodes, for operators that work on a SKU's whole array."""

    frame: DataFrame            # sku_id, q
    lo: date | None
    n: int

    @classmethod
    def of(cls, sales: DataFrame) -> DemandSeries:
        return cls(*demand_series(sales))

    @property
    def last(self) -> date | None:
        return self.lo and self.lo + timedelta(days=7 * (self.n - 1))


class Weeks:
    """The weeks of some SKUs, one SKU behind the other, as flat arrays: ``x``
    the demand (NULL: 0), ``null`` where it is NULL, ``pos`` the place of the
    week in its SKU.  Sums are differences of running sums, exact for whole
    units below 2**53."""

    def __init__(self, q: pa.ListArray):
        values, ends = q.flatten(), np.asarray(q.offsets)
        self.sizes = np.diff(ends)
        self.null = np.asarray(values.is_null())
        self.q = values.fill_null(0).to_numpy(zero_copy_only=False)
        self.x = self.q.astype(np.float64)
        self.at = np.arange(len(self.x))
        self.pos = self.at - np.repeat(ends[:-1] - ends[0], self.sizes)
        self.sum, self.nulls = (np.concatenate([[0], np.cumsum(v)]) for v in (self.x, self.null))

    def back(self, v: np.ndarray, k: int) -> np.ndarray:
        """The value ``k`` weeks before, 0 ahead of the SKU's first week."""
        out = np.zeros_like(v)
        out[k:] = v[:max(len(v) - k, 0)]
        out[self.pos < k] = 0
        return out

    def earlier(self, running: np.ndarray, w: int | None = None) -> np.ndarray:
        """What the ``w`` weeks before hold (None: all of the SKU)."""
        return running[self.at] - running[self.at - (self.pos if w is None else np.minimum(self.pos, w))]

    def mean(self, w: int) -> np.ndarray:
        """Mean of the last ``w`` rows of the shifted series (first row 0),
        NULLs left out; NaN of none."""
        with np.errstate(invalid="ignore"):
            return self.earlier(self.sum, w) / (np.minimum(self.pos + 1, w) - self.earlier(self.nulls, w))

    def last(self, w: int, nulls: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sample deviation, maximum and median of the last ``w`` rows of the
        shifted series.  NULLs sort as ``nulls``: inf leaves them out, -inf
        counts them as the least, and whatever meets one is NaN."""
        shifted = np.where(self.back(self.null, 1), nulls, self.back(self.x, 1))
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(w - 1, np.inf), shifted]), w).copy()
        rows[self.pos[:, None] < np.arange(w - 1, -1, -1)] = np.inf
        rows.sort(axis=1)
        k = np.minimum(self.pos + 1, w)
        if nulls > 0:
            k = k - self.earlier(self.nulls, w)
        pick = lambda i: rows[self.at, np.maximum(i, 1) - 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            middle, most = (pick((k + 1) // 2) + pick(k // 2 + 1)) / 2.0, pick(k)
            held = np.arange(w) < k[:, None]
            mean = np.where(held, rows, 0.0).sum(axis=1) / k
            spread = np.sqrt((np.where(held, rows - mean[:, None], 0.0) ** 2).sum(axis=1) / (k - 1))
        spread[k <= 1] = 0.0
        return spread, *(np.where(np.isfinite(v) & (k > 0), v, np.nan) for v in (most, middle))

    def ewm(self, span: float) -> np.ndarray:
        """y_t = (1 - a) y_{t-1} + a x_t of the shifted series, a = 2 / (span + 1).
        Sums over 1, 2, 4, ... weeks are doubled, each decayed over the weeks
        between, so no term is dropped for any span."""
        a = 2.0 / (span + 1.0)
        y = a * self.back(self.x, 1)
        d = 1
        while d < self.sizes.max(initial=0) and (decay := (1.0 - a) ** d) > 0.0:
            y = y + decay * self.back(y, d)
            d *= 2
        return y

    def demand(self) -> dict[str, pa.Array]:
        return {"_w": pa.array(self.pos, pa.int32()), "demand": pa.array(self.q, pa.int64(), mask=self.null)}


def _doubles(v: np.ndarray) -> pa.Array:
    return pa.array(v, pa.float64(), from_pandas=True)          # NaN is NULL


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Weeks]]:
    """As many SKUs as fit into a slice, one at least, with their weeks."""
    for batch in batches:
        q = batch.column(batch.schema.get_field_index("q"))
        ends, first = np.asarray(q.offsets), 0
        while first < len(q):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_WEEKS, "right")) - 1)
            yield batch.slice(first, last - first), Weeks(q.slice(first, last - first))
            first = last


def week_rows(series: DataFrame, fields: str, make: Callable[[Weeks], dict[str, pa.Array]], spread: Sequence[str] = ()) -> DataFrame:
    """One row for each week of ``q``: the other columns of ``series``, repeated
    (an array in ``spread`` gives each week its own entry), and the ``fields``
    that ``make`` computes for some hundred SKUs at once.  Each SKU's work
    touches its own row alone, so nothing is shuffled."""
    kept = [f for f in series.schema.fields if f.name != "q"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, weeks in _slices(batches):
            own, columns = np.repeat(np.arange(len(part)), weeks.sizes), {}
            for c in (part.column(f.name) for f in kept):
                name = kept[len(columns)].name
                if name in spread:
                    none = np.asarray(c.is_null())[own]
                    columns[name] = c.values.take(pa.array(np.where(none, 0, np.asarray(c.offsets)[:-1][own] + weeks.pos), mask=none))
                else:
                    columns[name] = c.take(pa.array(own))
            columns |= make(weeks)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = [T.StructField(f.name, f.dataType.elementType if f.name in spread else f.dataType) for f in kept]
    return series.mapInArrow(mapped, T.StructType(schema + T.StructType.fromDDL(fields).fields))


def _on_series(weekly: DataFrame | DemandSeries, fields: str, make: Callable[[Weeks], dict[str, pa.Array]]) -> DataFrame:
    """The weekly rows with the ``fields`` that ``make`` computes.  Rows are
    first gathered per SKU in the order of their dates (one entry a week)."""
    if isinstance(weekly, DemandSeries):
        rows = week_rows(weekly.frame, f"_w int, demand bigint, {fields}", lambda s: s.demand() | make(s))
        return rows.withColumn("_w", F.date_add(F.lit(weekly.lo).cast("date"), F.col("_w") * 7)).withColumnRenamed("_w", "date")
    others = [c for c in weekly.columns if c not in ("sku_id", "date", "demand")]
    held = weekly.groupBy("sku_id").agg(F.sort_array(F.collect_list(F.struct("date", "demand", *others))).alias("_e"))
    rows = week_rows(held.select("sku_id", "_e", F.col("_e.demand").alias("q")), fields, make, spread=["_e"])
    return rows.select(*[F.col(c) if c == "sku_id" else F.col("_e")[c].alias(c) for c in weekly.columns],
                       *[c for c in rows.columns if c not in ("sku_id", "_e")])


def rolling_stats(weekly: DataFrame | DemandSeries) -> DataFrame:
    """On demand shifted one week (first week 0): trailing means over 4, 8,
    13, 26 rows, and sample std / max / exact median over 13 rows, with
    ``min_periods=1`` semantics; the std of a single row is 0 (A12)."""
    names = [*[f"rolling_mean_{w}w" for w in ROLL_MEANS], "rolling_std_13w", "rolling_max_13w", "rolling_median_13w"]
    return _on_series(weekly, ", ".join(f"{c} double" for c in names), lambda s: dict(zip(
        names, map(_doubles, [*[s.mean(w) for w in ROLL_MEANS], *s.last(13, np.inf)]))))


def ewm_features(weekly: DataFrame | DemandSeries, spans=EWM_SPANS) -> DataFrame:
    """Recursive EWM (``adjust=False``) of the shifted series (A13):
    y_t = (1 - a) y_{t-1} + a x_t, a = 2 / (span + 1), y_0 = x_0 = 0; NULLs
    count as 0."""
    return _on_series(weekly, ", ".join(f"ewm_{s}w double" for s in spans),
                      lambda weeks: {f"ewm_{s}w": _doubles(weeks.ewm(s)) for s in spans})


def sku_demand_encoding(weekly: DataFrame) -> DataFrame:
    """Per SKU over all weeks: mean, log1p(mean), and mean / (median + 1e-6)
    (a mean/median ratio named ``sku_cv``) (A14)."""
    w = Window.partitionBy("sku_id")
    mean = F.avg("demand").over(w)
    med = F.percentile("demand", 0.5).over(w)
    return (weekly.withColumn("sku_mean_demand", mean)
                  .withColumn("sku_log_mean", F.log1p("sku_mean_demand"))
                  .withColumn("sku_cv", F.coalesce(F.col("sku_mean_demand") / (med + F.lit(1e-6)), F.lit(1.0))))


def sku_month_prior(weekly: DataFrame) -> DataFrame:
    """Mean demand per (sku, month) on every row."""
    return weekly.withColumn("sku_month_mean", F.avg("demand").over(Window.partitionBy("sku_id", "month")))


def sku_woy_prior(weekly: DataFrame) -> DataFrame:
    """Mean demand per (sku, ISO week) on every row."""
    return weekly.withColumn("sku_woy_mean", F.avg("demand").over(Window.partitionBy("sku_id", "week_of_year")))


# what the products of interaction_features are made of
INTERACTIONS = {
    "sku_mean_x_month_sin": ("sku_mean_demand", "month_sin"), "sku_mean_x_woy_sin": ("sku_mean_demand", "woy_sin"),
    "sku_log_x_lag4w": ("sku_log_mean", "lag_4w"), "prior_x_ewm4": ("sku_month_mean", "ewm_4w"),
    "prior_x_ewm13": ("sku_woy_mean", "ewm_13w"),
}


def interaction_features(df: DataFrame) -> DataFrame:
    """Five products of encodings and recent signals."""
    return df.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in INTERACTIONS.items()})


def social_weekly_lag(df: DataFrame, social: DataFrame | None) -> DataFrame:
    """Social rows moved to their Monday, averaged / summed per (sku, week),
    keyed one week later and left-joined; gaps 50 / 0.6 / 100 (A18).

    The weekly social values are gathered per SKU into a week -> values map
    (bounded by the calendar) and joined on ``sku_id`` alone, so the join
    keeps the frame's SKU partitioning instead of re-shuffling it by
    (sku, week)."""
    if social is None:
        return (df.withColumn("trend_index_lag1w", F.lit(50.0)).withColumn("sentiment_lag1w", F.lit(0.6))
                  .withColumn("mention_lag1w", F.lit(100.0)))
    agg = (social.select("sku_id", week_monday("week_start").alias("_wk"), "trend_index", "sentiment_score",
                         "mention_count")
                 .groupBy("sku_id", "_wk")
                 .agg(F.avg("trend_index").alias("t"), F.avg("sentiment_score").alias("s"),
                      F.sum("mention_count").cast("double").alias("m"))
                 .groupBy("sku_id")
                 .agg(F.map_from_entries(F.collect_list(F.struct(F.date_add("_wk", 7), F.struct("t", "s", "m"))))
                      .alias("_soc")))
    v = F.col("_soc")[F.col("date")]
    return (df.join(agg, "sku_id", "left")
              .withColumn("trend_index_lag1w", F.coalesce(v["t"], F.lit(50.0)))
              .withColumn("sentiment_lag1w", F.coalesce(v["s"], F.lit(0.6)))
              .withColumn("mention_lag1w", F.coalesce(v["m"], F.lit(100.0)))
              .drop("_soc"))


@dataclass(frozen=True)
class CategoryEncoder:
    """Label codes of the categorical columns, fitted once and applied to any
    catalogue (A19): code = place of the label among the sorted labels met at
    fitting, NULL counts as ``unknown``, a label not met becomes -1."""

    codes: DataFrame            # column, label, code: one row per distinct label
    columns: tuple[str, ...]

    @classmethod
    def fit(cls, products: DataFrame, columns: Sequence[str] = tuple(CAT_COLS)) -> CategoryEncoder:
        """All columns in one pass over ``products``: distinct (column, label)
        pairs, numbered within the column."""
        pairs = products.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("unknown")).alias("label")) for c in columns]))).distinct()
        code = F.row_number().over(Window.partitionBy("column").orderBy("label")) - 1
        return cls(pairs.select("column", "label", code.cast("int").alias("code")), tuple(columns))

    def transform(self, df: DataFrame) -> DataFrame:
        """Each categorical column ``c`` of ``df`` replaced by ``c_enc``; the
        joins carry no hint, so a code table is broadcast only if it proves
        small at run time."""
        for c in self.columns:
            own = self.codes.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            df = (df.join(own, F.coalesce(F.col(c), F.lit("unknown")) == F.col("_label"), "left")
                    .withColumn(f"{c}_enc", F.coalesce("_code", F.lit(-1))).drop(c, "_label", "_code"))
        return df

    def save(self, path: str) -> None:
        self.codes.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CategoryEncoder:
        codes = spark.read.schema("column string, label string, code int").parquet(path)
        return cls(codes, tuple(sorted(r["column"] for r in codes.select("column").distinct().collect())))


def category_codes(df: DataFrame, products: DataFrame, skus: DataFrame | None = None, encoder: CategoryEncoder | None = None) -> DataFrame:
    """The five label codes for each row (A19), by ``encoder`` or by one fitted
    on the SKUs of the weekly frame; SKUs without a product are ``unknown``."""
    skus = skus if skus is not None else df.select("sku_id").distinct()
    own = skus.join(products.select("sku_id", *CAT_COLS), "sku_id", "left")
    encoder = encoder or CategoryEncoder.fit(own)
    return df.join(encoder.transform(own), "sku_id", "left")


def inventory_features(df: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """Mean days of supply and a flag for any store below 7 days; SKUs
    without inventory get 60 / 0 (A20)."""
    if inventory is None:
        return df.withColumn("days_of_supply", F.lit(60.0)).withColumn("stockout_risk_flag", F.lit(0))
    inv = inventory.groupBy("sku_id").agg(
        F.avg("days_of_supply").alias("days_of_supply"),
        F.max((F.col("days_of_supply") < 7).cast("int")).alias("stockout_risk_flag"))
    return (df.join(inv, "sku_id", "left")
              .withColumn("days_of_supply", F.coalesce("days_of_supply", F.lit(60.0)))
              .withColumn("stockout_risk_flag", F.coalesce("stockout_risk_flag", F.lit(0))))


def _calendar(lo: date, n: int) -> tuple[list[int], list[int], list[list[int]], list[list[int]]]:
    """Month and ISO week of each week from ``lo``, and the weeks that each
    month (1 - 12) and ISO week (1 - 53) holds."""
    days = [lo + timedelta(days=7 * i) for i in range(n)]
    months, woys = [d.month for d in days], [d.isocalendar().week for d in days]
    return (months, woys, [[i for i, m in enumerate(months) if m == k] for k in range(1, 13)],
            [[i for i, w in enumerate(woys) if w == k] for k in range(1, 54)])


def _weekly_fields(lo: date, n: int, columns: Sequence[str]) -> tuple[str, Callable[[Weeks], dict[str, pa.Array]]]:
    """The fields of :func:`series_features` (those of ``columns``) and what
    computes them.  A NULL week makes the running values after it NULL."""
    months, woys, in_month, in_woy = _calendar(lo, n)
    lags = [k for k in LAGS if f"lag_{k}w" in columns]
    means = [w for w in ROLL_MEANS if f"rolling_mean_{w}w" in columns]
    spans = [s for s in EWM_SPANS if f"ewm_{s}w" in columns]
    last13 = [c for c in ("rolling_std_13w", "rolling_max_13w", "rolling_median_13w") if c in columns]
    priors = [p for p in (("sku_month_mean", in_month, months), ("sku_woy_mean", in_woy, woys)) if p[0] in columns]
    fields = ["_w int", "demand bigint", *[f"lag_{k}w bigint" for k in lags], *[f"rolling_mean_{w}w double" for w in means],
              *([f"_last13 struct<{', '.join(f'{c}: double' for c in last13)}>"] if last13 else []),
              *[f"ewm_{s}w double" for s in spans], *[f"{p[0]} double" for p in priors]]

    def make(s: Weeks) -> dict[str, pa.Array]:
        known = lambda v: _doubles(np.where(s.earlier(s.nulls) > 0, np.nan, v))
        out = s.demand() | {f"lag_{k}w": pa.array(s.back(s.q, k), pa.int64()) for k in lags}
        out |= {f"rolling_mean_{w}w": known(s.mean(w)) for w in means}
        if last13:
            made = dict(zip(("rolling_std_13w", "rolling_max_13w", "rolling_median_13w"), s.last(13, -np.inf)))
            out["_last13"] = pa.StructArray.from_arrays([_doubles(made[c]) for c in last13], names=last13)
        out |= {f"ewm_{w}w": known(s.ewm(w)) for w in spans}
        grid = np.where(s.null, np.nan, s.x).reshape(-1, n)
        for name, held, own in priors:
            of = np.column_stack([grid[:, weeks].sum(axis=1) / len(weeks) if weeks else np.full(len(grid), np.nan) for weeks in held])
            out[name] = _doubles(of[:, np.array(own) - 1].ravel())
        return out

    return ", ".join(fields), make


def _sku_encoding(series: DataFrame, n: int) -> DataFrame:
    """The SKU encoding (A14) of one row a SKU."""
    q = F.col("q")
    ordered = F.sort_array(q.cast("array<double>"))
    middle = (F.element_at(ordered, (n + 1) // 2) + F.element_at(ordered, n // 2 + 1)) / F.lit(2.0)
    mean = F.aggregate(q, F.lit(0).cast("bigint"), lambda s, v: s + v) / F.lit(float(n))
    return series.select("*", mean.alias("sku_mean_demand"), F.log1p(mean).alias("sku_log_mean"),
                         F.coalesce(mean / (middle + F.lit(1e-6)), F.lit(1.0)).alias("sku_cv"))


def series_features(series: DataFrame, lo: date, n: int) -> DataFrame:
    """Lags, rolling statistics, EWM, SKU encoding and priors (A11 - A16) of
    every week from the array of the SKU, without a window: ``sku_id``, the SKU
    encoding and ``_rows``, an array with one struct per week."""
    fields, make = _weekly_fields(lo, n, FEATURE_COLUMNS)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, weeks in _slices(batches):
            made = make(weeks)
            rows = pa.StructArray.from_arrays(list(made.values()), names=list(made))
            ends = pa.array(np.concatenate([[0], np.cumsum(weeks.sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.ListArray.from_arrays(ends, rows)], names=[*names, "_rows"])

    frame = _sku_encoding(series.select("sku_id", "q"), n)
    names = [c for c in frame.columns if c != "q"]
    kept = [f for f in frame.schema.fields if f.name != "q"]
    return frame.mapInArrow(mapped, T.StructType([*kept, T.StructField("_rows", T.ArrayType(T.StructType.fromDDL(fields)))]))


def social_series(social: DataFrame, lo: date, n: int) -> DataFrame:
    """``sku_id`` and ``_soc``, the social values (A18) of the week before each
    week as one array."""
    values = (social.select("sku_id", week_monday("week_start").alias("_wk"), "trend_index", "sentiment_score", "mention_count")
              .groupBy("sku_id", "_wk").agg(F.avg("trend_index").alias("t"), F.avg("sentiment_score").alias("s"),
                                            F.sum("mention_count").cast("double").alias("m"))
              .select("sku_id", (F.datediff(F.date_add("_wk", 7), F.lit(lo)) / 7).cast("int").alias("w"), F.struct("t", "s", "m").alias("v"))
              .where(F.col("w").between(0, n - 1)))
    kept = values.groupBy("sku_id").agg(F.array_sort(F.collect_list(F.struct("w", "v")), lambda x, y: x["w"] - y["w"]).alias("_s"))
    return kept.select("sku_id", _dense(F.col("_s"), n, F.lit(None).cast("struct<t:double,s:double,m:double>"), "v").alias("_soc"))


def feature_matrix(sales: DataFrame, products: DataFrame, social: DataFrame | None, inventory: DataFrame | None,
                   encoder: CategoryEncoder | None = None, columns: Sequence[str] = tuple(FEATURE_COLUMNS)) -> DataFrame:
    """The 49-feature weekly matrix (A21): ``sku_id, date, demand`` and
    ``columns``, all of :data:`FEATURE_COLUMNS` or some, remaining NULLs -> 0.

    Everything per SKU is joined to the SKU's one row while that is small, then
    the weeks come from its array as finished rows, to which only the products
    are added.  No weekly row is shuffled, sorted or joined."""
    series, lo, n = demand_series(sales)
    if lo is None:
        types = {**dict.fromkeys(FEATURE_COLUMNS, "double"), **dict.fromkeys([f"lag_{k}w" for k in LAGS], "bigint"),
                 **dict.fromkeys(["month", "quarter", "week_of_year", "year", "has_holiday_week", "stockout_risk_flag",
                                  *[f"{c}_enc" for c in CAT_COLS]], "int")}
        return series.select("sku_id", F.lit(None).cast("date").alias("date"), F.lit(0).cast("bigint").alias("demand"),
                             *[F.lit(0).cast(types[c]).alias(c) for c in columns])
    w = category_codes(series, products, skus=series.select("sku_id"), encoder=encoder)
    w = inventory_features(w, inventory)
    if "launch_date" in products.columns:
        w = w.join(products.select("sku_id", "launch_date"), "sku_id", "left")
    else:
        w = w.withColumn("launch_date", F.lit(None).cast("date"))
    if social is not None:
        w = w.join(social_series(social, lo, n), "sku_id", "left")
    else:
        w = w.withColumn("_soc", F.lit(None).cast("array<struct<t:double,s:double,m:double>>"))
    signals = [c for c in SIGNALS if c in columns]
    mixed = bool({*columns} & {*INTERACTIONS})
    factors = {c for of in INTERACTIONS.values() for c in of} if mixed else set()
    if not signals:
        w = w.drop("_soc")
    weeks = holiday_week_flag(calendar_features(
        w.sparkSession.range(n).select("id", F.date_add(F.lit(lo), F.col("id").cast("int") * 7).alias("date"))))
    w = _matrix_rows(_sku_encoding(w, n), lo, n, [c for c in FEATURE_COLUMNS if c in {*columns} | factors], weeks, signals, factors)
    if not mixed:
        return w.select("sku_id", "date", "demand", *columns)
    return interaction_features(w).select("sku_id", "date", "demand", *columns).fillna(0, [c for c in columns if c in INTERACTIONS or c in factors])


# the social columns: the value they take and what fills their gaps
SIGNALS = {"trend_index_lag1w": ("t", 50.0), "sentiment_lag1w": ("s", 0.6), "mention_lag1w": ("m", 100.0)}


def _known(a: pa.Array) -> pa.Array:
    """NULL and NaN become 0."""
    if not pa.types.is_floating(a.type):
        return a.fill_null(0)
    v = a.to_numpy(zero_copy_only=False)
    return pa.array(np.where(np.isnan(v), 0.0, v))


def _matrix_rows(series: DataFrame, lo: date, n: int, columns: Sequence[str], calendar: DataFrame, signals: Sequence[str],
                 factors: set[str]) -> DataFrame:
    """The weeks of every SKU of ``series`` as finished rows: ``sku_id, date,
    demand`` and those of ``columns`` that are no product, NULL and NaN as 0
    but in the ``factors`` of the products.  What depends on the week alone is
    one array for all SKUs (some thousands of weeks at the very most)."""
    of_week = [f for f in calendar.schema.fields if f.name in columns]
    held = calendar.select("id", *[f.name for f in of_week]).orderBy("id").collect()
    week_values = {f.name: np.array([r[f.name] for r in held], np.float64 if f.dataType == T.DoubleType() else np.int32) for f in of_week}
    of_sku = [f for f in series.schema.fields if f.name in columns]
    fields, make = _weekly_fields(lo, n, columns)
    made = [f for f in T.StructType.fromDDL(fields).fields if f.name not in ("_w", "_last13")]
    last13 = [c for c in ("rolling_std_13w", "rolling_max_13w", "rolling_median_13w") if c in columns]
    doubles = [T.StructField(c, T.DoubleType()) for c in [*last13, *(["weeks_since_launch"] if "weeks_since_launch" in columns else []), *signals]]
    schema = T.StructType([series.schema["sku_id"], T.StructField("date", T.DateType()), *made, *of_week, *of_sku, *doubles])
    first = (lo - date(1970, 1, 1)).days

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, weeks in _slices(batches):
            own, day = pa.array(np.repeat(np.arange(len(part)), weeks.sizes)), first + 7 * weeks.pos
            out = make(weeks)
            out |= {c: out["_last13"].field(i) for i, c in enumerate(last13)}
            out = {c: v if c in factors else _known(v) for c, v in out.items() if c != "_last13"}
            out |= {c: pa.array(v[weeks.pos]) for c, v in week_values.items()}
            out |= {f.name: (part.column(f.name) if f.name in factors else _known(part.column(f.name))).take(own) for f in of_sku}
            out |= {"sku_id": part.column("sku_id").take(own), "date": pa.array(day.astype(np.int32)).cast(pa.date32())}
            if "weeks_since_launch" in columns:
                launch = part.column("launch_date").cast(pa.int32())
                since = (day - np.asarray(launch.fill_null(0))[own]) / 7.0
                out["weeks_since_launch"] = pa.array(np.maximum(np.where(np.asarray(launch.is_null())[own], 52.0, since), 0.0))
            if signals:
                soc = part.column("_soc")
                none = np.asarray(soc.is_null())[own]
                at = pa.array(np.where(none, 0, np.asarray(soc.offsets)[:-1][own] + weeks.pos), mask=none)
                values = dict(zip(("t", "s", "m"), soc.values.flatten()))
                for c in signals:
                    field, gap = SIGNALS[c]
                    out[c] = _known(values[field].take(at).fill_null(gap))
            yield pa.RecordBatch.from_arrays([out[c] for c in schema.names], names=schema.names)

    return series.mapInArrow(mapped, schema)
