"""Global order without a single task: row numbers, average-tie percent ranks
and exact quantiles of frames of any size.

Every order column becomes one or more 64-bit words that never decrease along
the order.  A histogram over the leading bits of the words finds the cells that
hold too many rows, only those are split by their following bits, and so on.
The driver sees a cell only if it is too full, at most one for each bucket
wanted; rows learn their cell from bit shifts and from small tables of full
cells, so the plan stays the same size whatever the number of partitions.
Inside a cell a window sorts by the order columns themselves, and a column
decides only where the one before it has a single value, so words that collide
cost evenness, never correctness.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.session import checkpoint_dir

CELL_ROWS = 1 << 16             # a cell of no more rows is never split
FIRST_BITS, NEXT_BITS = 12, 8   # cells a level: 4096, then 256 of each full cell
STRING_WORDS = 4                # of seven bytes each
LEAST = -(1 << 63)


def _words(name: str, dtype: T.DataType) -> list[Column]:
    """Longs that never decrease as the column grows."""
    c = F.col(name)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return [c.cast("int").cast("long") if isinstance(dtype, T.BooleanType) else c.cast("long")]
    if isinstance(dtype, T.DateType):
        return [F.unix_date(c).cast("long")]
    if isinstance(dtype, T.TimestampType):
        return [F.unix_micros(c)]
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        x = c.cast("double")
        # log1p is monotone on the JVM by specification; 2**53 keeps its digits
        size = F.least(F.log1p(F.abs(x) * F.lit(2.0 ** 64)), F.lit(800.0)) * F.lit(2.0 ** 53)
        return [F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise((F.signum(x) * size).cast("long"))]
    if isinstance(dtype, T.StringType):
        digits = [F.hex(F.substring(F.encode(c, "UTF-8"), 7 * i + 1, 7)) for i in range(STRING_WORDS)]
        return [F.conv(F.rpad(d, 14, "0"), 16, 10).cast("long") for d in digits]
    raise TypeError(f"no global order for column {name} of type {dtype.simpleString()}")


@dataclass
class Placed:
    rows: DataFrame             # staged rows with their cell columns
    cells: list[str]            # empty: one cell holds all rows


def _shift(low: int, high: int, bits: int) -> int:
    return max((low ^ high).bit_length() - bits, 0)


def place(df: DataFrame, order: Sequence[str], buckets: int | None = None, cell_rows: int = CELL_ROWS) -> Placed:
    """Stage ``df`` and give every row a cell; cells sort as ``order`` does
    (names, ``-name`` descends, NULLs as Spark sorts them)."""
    spark = df.sparkSession
    wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    types, words, owner = {f.name: f.dataType for f in df.schema.fields}, [], []
    for o in order:
        for w in _words(o.lstrip("-"), types[o.lstrip("-")]):
            w = F.coalesce(w, F.lit(LEAST))
            words.append(F.bitwise_not(w) if o.startswith("-") else w)
            owner.append(o.lstrip("-"))
    names = [f"_w{i}" for i in range(len(words))]
    checkpoint_dir(spark)
    rows = df.select("*", *[w.alias(n) for w, n in zip(words, names)]).checkpoint()
    total = rows.count()
    limit = max(cell_rows, -(-total // wanted))
    if total <= limit:
        return Placed(rows.drop(*names), [])

    def level(word: int, shift: int) -> list[Column]:
        """Where a row lies at a level: the words before exactly, the leading
        bits of ``word``, and the least long for what follows."""
        cut = F.shiftleft(F.shiftright(F.col(names[word]), shift), shift)
        return [F.col(n) for n in names[:word]] + [cut] + [F.lit(LEAST)] * (len(names) - word - 1)

    cells = [f"_cell{i}" for i in range(len(names))]
    cell: list[Column] = [F.lit(LEAST)] * len(names)
    inside, word, placed = rows, 0, rows
    while word < len(names):
        ends = inside.agg(F.min(names[word]), F.max(names[word])).first()
        shift = _shift(ends[0], ends[1], FIRST_BITS if inside is rows else NEXT_BITS)
        while True:
            at = level(word, shift)
            flag = f"_full{word}_{shift}"
            first = placed is rows
            cell = at if first else [F.when(F.col(previous), a).otherwise(b) for a, b in zip(at, cell)]
            own = F.col(owner[word])
            counted = inside.groupBy(*[a.alias(c) for a, c in zip(at, cells)]).agg(
                F.count(F.lit(1)).alias("n"), F.min(names[word]).alias("lo"), F.max(names[word]).alias("hi"),
                (F.count(own).isin(0, F.count(F.lit(1))) & F.min(own).eqNullSafe(F.max(own))).alias("same"))
            full = counted.where(F.col("n") > limit).collect()          # at most total / limit rows
            if shift == 0 and owner[word] != owner[min(word + 1, len(owner) - 1)]:
                full = [r for r in full if r["same"]]       # words that collide: the next column may not decide
            if not full:
                return _cells_of(placed, cell, cells, names)
            table = F.broadcast(spark.createDataFrame([tuple(r[c] for c in cells) for r in full], ", ".join(f"`{c}` long" for c in cells)))
            mark = table.select(*[F.col(c).alias(f"{flag}{c}") for c in cells], F.lit(True).alias(flag))
            on = lambda own: [F.col(f"{flag}{c}") == o for c, o in zip(cells, own)]
            placed = placed.join(mark, on(at), "left").drop(*[f"{flag}{c}" for c in cells])
            inside = rows.join(mark, on(at), "left_semi")
            previous = flag
            if shift == 0:
                break
            shift = min(max(_shift(r["lo"], r["hi"], NEXT_BITS) for r in full), shift - 1)
        word += 1
    return _cells_of(placed, cell, cells, names)


def _cells_of(placed: DataFrame, cell: list[Column], cells: list[str], names: list[str]) -> Placed:
    flags = [c for c in placed.columns if c.startswith("_full")]
    return Placed(placed.select("*", *[c.alias(n) for c, n in zip(cell, cells)]).drop(*names, *flags), cells)


def _before(placed: Placed, weight: Column, out: str) -> DataFrame:
    """``out``: the weight of all cells before the row's own (a row per cell
    meets in one task: 4096 and 256 for each full one at most)."""
    if not placed.cells:
        return placed.rows.withColumn(out, F.lit(0).cast("long"))
    so_far = Window.orderBy(*placed.cells).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.rows.groupBy(*placed.cells).agg(F.sum(weight).alias("_m"))
                     .select(*placed.cells, F.coalesce(F.sum("_m").over(so_far), F.lit(0)).alias(out)))
    return placed.rows.join(offsets, placed.cells)


def _sorted(order: Sequence[str]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _in_cell(placed: Placed):
    return Window.partitionBy(*(placed.cells or [F.lit(1)]))


def global_row_number(df: DataFrame, order: Sequence[str], out: str, buckets: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``row_number()`` over a global order: rows of earlier cells plus the row
    number inside the cell.  ``order`` must be a total order (end it with a
    unique key) for the numbers to be deterministic."""
    placed = place(df, order, buckets, cell_rows)
    return (_before(placed, F.lit(1), "_gr_off")
            .withColumn(out, F.col("_gr_off") + F.row_number().over(_in_cell(placed).orderBy(*_sorted(order))))
            .drop("_gr_off", *placed.cells))


def avg_tie_pct_rank(df: DataFrame, value: str, out: str, buckets: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """pandas ``rank(pct=True)`` (ties get the mean of their ranks) as a
    distributed computation.

    ``percent_rank``/``cume_dist`` differ from pandas on ties, and a window
    without ``partitionBy`` moves every row to one task.  Instead the rows are
    counted per distinct value (so a value held by many rows is one row), the
    counts are staged and summed below each value cell by cell, and the rank
    joins back on the value:

        pct = (rows below + (ties + 1) / 2) / n

    NULL values get a NULL rank (pandas leaves NaN unranked) and do not count
    in ``n``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_rk_v")).agg(F.count(F.lit(1)).alias("_rk_n"))
    placed = place(counts, ["_rk_v"], buckets, cell_rows)
    total = placed.rows.agg(F.sum("_rk_n")).first()[0]
    within = _in_cell(placed).orderBy("_rk_v").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_rk_off") + F.coalesce(F.sum("_rk_n").over(within), F.lit(0))
    ranks = _before(placed, F.col("_rk_n"), "_rk_off").select(
        "_rk_v", ((below + (F.col("_rk_n") + F.lit(1)) / F.lit(2.0)) / F.lit(total)).alias(out))
    return df.join(ranks, F.col(value) == F.col("_rk_v"), "left").drop("_rk_v")


def _at(p: float, n: Column) -> tuple[Column, Column, Column]:
    """The two ranks between which quantile ``p`` of ``n`` values lies, and
    how far (numpy / pandas default)."""
    pos = (n - 1) * F.lit(float(p))
    return F.floor(pos) + 1, F.ceil(pos) + 1, pos - F.floor(pos)


def exact_quantiles_by(df: DataFrame, by: str, value: str, probs: Sequence[float], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` for each ``by`` (few of
    them), one row each with ``q_<p*100>``: all groups share one bucketing over
    (``by``, ``value``), with equal values counted once.  NULLs are ignored."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_q_by"), F.col(value).alias("_q_v")).agg(F.count(F.lit(1)).alias("_q_k"))
    placed = place(counts, ["_q_by", "_q_v"], cell_rows=cell_rows)
    within = _in_cell(placed).orderBy("_q_by", "_q_v").rowsBetween(Window.unboundedPreceding, 0)
    running = _before(placed, F.col("_q_k"), "_q_off").withColumn("_q_end", F.col("_q_off") + F.sum("_q_k").over(within))
    sizes = placed.rows.groupBy("_q_by").agg(F.sum("_q_k").alias("_q_n"))
    starts = sizes.withColumn("_q_start", F.sum("_q_n").over(Window.orderBy("_q_by")) - F.col("_q_n"))      # a row per group
    own = running.join(F.broadcast(starts), "_q_by").withColumn("_q_end", F.col("_q_end") - F.col("_q_start"))
    holds = lambda r: (F.col("_q_end") >= r) & (F.col("_q_end") - F.col("_q_k") < r)
    cols, needed = [], F.lit(False)
    for p in probs:
        lo, hi, part = _at(p, F.col("_q_n"))
        needed |= holds(lo) | holds(hi)
        v_lo, v_hi = (F.max(F.when(holds(r), F.col("_q_v"))) for r in (lo, hi))
        cols.append((v_lo + (v_hi - v_lo) * F.max(part)).cast("double").alias(f"q_{int(round(p * 100))}"))
    return own.where(needed).groupBy(F.col("_q_by").alias(by)).agg(*cols)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], cell_rows: int = CELL_ROWS) -> DataFrame:
    """The same for a whole frame: one row (none for a frame without values)."""
    return exact_quantiles_by(df.select(F.lit(0).alias("_q_all"), value), "_q_all", value, probs, cell_rows).drop("_q_all")
