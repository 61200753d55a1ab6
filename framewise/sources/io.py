"""Loading, checking and writing datasets.

Plain DataFrame reads and writes: the schema is given to the reader, date
filters go into ``where`` (pushed into the parquet scan), and every check is
one aggregation over the data, not a driver-side loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.expr import round_half_even


class DataValidationError(ValueError):
    """A dataset lacks required columns."""


def require_columns(df: DataFrame, expected: Iterable[str], name: str) -> DataFrame:
    """Raise when columns are absent, telling which and what there is."""
    found = set(df.columns)
    absent = sorted(set(expected) - found)
    if absent:
        raise DataValidationError(f"dataset {name}: no column {', '.join(absent)} among {', '.join(sorted(found))}")
    return df


@dataclass(frozen=True)
class Dataset:
    """A named input: its columns (the required ones first) and date column."""
    columns: str
    required: tuple[str, ...]
    date_col: str | None = None


# The six inputs and the columns each must have.
DATASETS: dict[str, Dataset] = {
    "products": Dataset(
        "sku_id string, name string, frame_shape string, material string, color string, price_point string, gender string, "
        "season_launched string, is_active boolean, supplier_id string, cost_price double, retail_price double, category string, launch_date date",
        ("sku_id", "name", "frame_shape", "material", "color", "price_point", "gender", "season_launched", "is_active")),
    "sales": Dataset(
        "transaction_id string, sku_id string, date date, store_id string, quantity_sold bigint, unit_price double, channel string, "
        "customer_age_group string, customer_gender string, region string, stockout_risk int",
        ("transaction_id", "sku_id", "date", "store_id", "quantity_sold", "unit_price", "channel"), "date"),
    "inventory": Dataset(
        "sku_id string, store_id string, quantity_on_hand bigint, reorder_point bigint, quantity_on_order bigint, days_of_supply double, "
        "last_restocked_date date, warehouse_location string",
        ("sku_id", "store_id", "quantity_on_hand", "reorder_point", "quantity_on_order", "days_of_supply")),
    "suppliers": Dataset(
        "supplier_id string, name string, country string, lead_time_days int, reliability_score double, capacity_utilization double, "
        "avg_unit_cost_multiplier double, on_time_delivery_rate double, min_order_qty int, payment_terms_days int",
        ("supplier_id", "name", "country", "lead_time_days", "reliability_score", "capacity_utilization")),
    "returns": Dataset(
        "return_id string, sku_id string, transaction_id string, return_date date, return_reason string, refund_amount double, restocked boolean",
        ("return_id", "sku_id", "return_date", "return_reason"), "return_date"),
    "social_signals": Dataset(
        "sku_id string, week_start date, platform string, mention_count bigint, sentiment_score double, trend_index int, hashtag_reach bigint, "
        "influencer_mentions int",
        ("sku_id", "week_start", "platform", "mention_count", "sentiment_score", "trend_index"), "week_start"),
}


def load_named(spark: SparkSession, name: str, path: str, fmt: str | None = None,
               start: str | None = None, end: str | None = None) -> DataFrame:
    """One of the six inputs with its types; columns the files lack are
    reported if required, else left out; dates inclusive at both ends (A01)."""
    spec = DATASETS[name]
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    reader = spark.read.format(fmt)
    files = reader.option("header", "true").load(path) if fmt == "csv" else reader.load(path)
    require_columns(files, spec.required, name)
    typed = [x.strip().rsplit(" ", 1) for x in spec.columns.split(",")]
    df = files.select(*[F.col(c).cast(t).alias(c) for c, t in typed if c in files.columns])
    if spec.date_col and start is not None:
        df = df.where(F.col(spec.date_col) >= F.lit(start).cast("date"))
    if spec.date_col and end is not None:
        df = df.where(F.col(spec.date_col) <= F.lit(end).cast("date"))
    return df


def load_report(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Quality summary of the named inputs with an ``error`` column: an input
    that cannot be loaded is a row with its error, the others are summarised
    as usual (A02)."""
    good, bad = {}, []
    for name, path in paths.items():
        try:
            good[name] = load_named(spark, name, path)
        except (DataValidationError, AnalysisException) as e:
            bad.append((name, str(e).splitlines()[0]))
    columns = "dataset string, row_count bigint, duplicate_count bigint, date_column string, date_min date, date_max date, error string"
    out = spark.createDataFrame([(n, None, None, None, None, None, e) for n, e in bad], columns)
    return data_quality_summary(good).withColumn("error", F.lit(None).cast("string")).unionByName(out) if good else out


def load_dataset(spark: SparkSession, path: str, name: str, required: Iterable[str] = (),
                 schema: T.StructType | None = None, fmt: str | None = None,
                 date_col: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Read one dataset (parquet or CSV with a header), check its required
    columns and keep ``start <= date_col <= end`` (both ends inclusive; the
    filter reaches the scan as a pushed predicate) (A01)."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    elif schema is not None:
        reader = reader.schema(schema)
    df = require_columns(reader.load(path), required, name)
    if date_col is not None:
        d = F.col(date_col).cast("date")
        if start is not None:
            df = df.where(d >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(d <= F.lit(end).cast("date"))
    return df


def _date_column(df: DataFrame) -> str | None:
    """First column whose name contains ``date`` or ``week``, if it is a
    date / timestamp column (a string column gives no range)."""
    for f in df.schema.fields:
        if "date" in f.name.lower() or "week" in f.name.lower():
            return f.name if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None
    return None


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MASK_BITS = 63


def _profile(name: str, df: DataFrame) -> DataFrame:
    """One row of ``df``'s profile from one scan and one shuffle.

    Rows travel as two 64-bit hashes; only equal rows agree in both (a NULL
    leaves a hash as it is, so whether a column is NULL is hashed as well).
    Equal rows share their date and their NULLs, so a fingerprint carries one
    date and one bit a column, its count weighs them, and every figure is a
    sum over fingerprints."""
    dcol = _date_column(df)
    is_null = [F.col(f"`{c}`").isNull() for c in df.columns]
    fields = [x for c, e in zip(df.columns, is_null) for x in (F.col(f"`{c}`"), e)]
    masks = []
    for at in range(0, len(is_null), MASK_BITS):
        bits = [F.shiftleft(e.cast("bigint"), i) for i, e in enumerate(is_null[at:at + MASK_BITS])]
        masks.append(sum(bits[1:], bits[0]).alias(f"_m{at // MASK_BITS}"))
    prints = df.select(
        F.xxhash64(*fields).alias("_h"), F.xxhash64(F.lit("again"), *fields).alias("_g"),
        (F.col(f"`{dcol}`").cast("date") if dcol else F.lit(None).cast("date")).alias("_d"), *masks)
    seen = prints.groupBy("_h", "_g").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_d"), *[F.max(f"_m{k}").alias(f"_m{k}") for k in range(len(masks))])
    nulls = [F.coalesce(F.sum(F.when(F.col(f"_m{i // MASK_BITS}").bitwiseAND(F.lit(1 << i % MASK_BITS)) != 0, F.col("_n"))), F.lit(0))
             for i in range(len(is_null))]
    return seen.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"),
        F.min("_d").alias("date_min"), F.max("_d").alias("date_max"),
        F.array(*[F.struct(F.lit(c).alias("column"), n.alias("null_count")) for c, n in zip(df.columns, nulls)]).alias("columns"),
    ).select(F.lit(name).alias("dataset"), "row_count", "duplicate_count", F.lit(dcol).cast("string").alias("date_column"),
             "date_min", "date_max", "columns")


def data_quality_summary(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Per dataset: rows, duplicate rows (equal to an earlier row in every
    column), and the range of the first date-like column (A02)."""
    return _union([_profile(n, df).drop("columns") for n, df in datasets.items()])


def data_quality_profile(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """The whole quality report in long form, one row per dataset and column:
    the figures of :func:`data_quality_summary` with the column's NULL share
    (percent, 2 dp; NULL for a dataset without rows), each dataset read once
    (A02)."""
    whole = _union([_profile(n, df) for n, df in datasets.items()])
    share = F.try_divide(F.col("c.null_count") * F.lit(100.0), F.col("row_count"))
    return whole.select("*", F.explode("columns").alias("c")).select(
        "dataset", "row_count", "duplicate_count", "date_column", "date_min", "date_max",
        F.col("c.column").alias("column"), round_half_even(share, 2).alias("null_pct"))


def data_quality_nulls(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Long form (dataset, column, null %) rounded to 2 dp, one aggregation
    per dataset (A02)."""
    parts = []
    for name, df in datasets.items():
        n = F.count(F.lit(1))
        wide = df.agg(*[(F.sum(F.col(f"`{c}`").isNull().cast("long")) * F.lit(100.0) / n).alias(c)
                        for c in df.columns])
        entries = [F.struct(F.lit(c).alias("column"), round_half_even(F.col(f"`{c}`"), 2).alias("null_pct"))
                   for c in df.columns]
        parts.append(wide.select(F.lit(name).alias("dataset"), F.explode(F.array(*entries)).alias("e"))
                         .select("dataset", "e.column", "e.null_pct"))
    return _union(parts)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row (A05): dates as ``yyyy-MM-dd``, NaN and
    +-infinity as null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))


def write_outputs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result (A04).  CSV cannot hold arrays, maps or structs, so
    those columns become JSON text first.  Parallel writers, one file per
    partition, overwrite."""
    if fmt == "csv":
        cols = [F.to_json(F.col(f"`{f.name}`")).alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`")
                for f in df.schema.fields]
        df.select(*cols).write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
