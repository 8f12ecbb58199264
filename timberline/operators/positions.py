"""Consecutive positions and running counts without a single-task window.

Rows are put into small ordered cells.  Cell counts (pre-aggregated before the shuffle) give
each cell its offset, and a window inside the cell gives the rest.  No cell can hold more than
``CELL_SPAN`` rows, whatever key or second is hot, because a cell covers that many unique ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CELL_SPAN = 1 << 20


def cell_of(col: Column | str, span: int = CELL_SPAN) -> Column:
    """Cell number of a unique integer id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(span)) if span & (span - 1) else F.shiftright(c, span.bit_length() - 1)


def id_cells(col: str, span: int = CELL_SPAN) -> tuple[Column, list[Column]]:
    """Coarse and fine cells of rows ordered by a unique integer id."""
    fine = cell_of(col, span)
    return cell_of(fine, span), [fine]


def time_cells(ts: str, line_id: str, span: int = CELL_SPAN) -> tuple[Column, list[Column]]:
    """Cells of rows ordered by whole second, then id: day, then second and id cell."""
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.floor(second / 86400), [second, cell_of(line_id, span)]


def cell_offsets(
    df: DataFrame, coarse: Column, fine: Sequence[Column], partition: Sequence[str] = ()
) -> DataFrame:
    """``(partition…, _c, _f0…, _n, _offset)``: rows per cell and rows before the cell."""
    part = list(partition)
    f_names = [f"_f{i}" for i in range(len(fine))]
    cells = (
        df.select(*part, coarse.alias("_c"), *[c.alias(n) for c, n in zip(fine, f_names)])
        .groupBy(*part, "_c", *f_names)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    in_coarse = (
        Window.partitionBy(*part, "_c").orderBy(*map(F.asc_nulls_last, f_names))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per coarse cell (a day, or 2**40 ids): few rows by construction
    over_coarse = (
        Window.partitionBy(*(part or [F.lit(0)])).orderBy(F.asc_nulls_last("_c"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    coarse_offsets = (
        cells.groupBy(*part, "_c").agg(F.sum("_n").alias("_cn"))
        .withColumn("_coff", F.coalesce(F.sum("_cn").over(over_coarse), F.lit(0)))
        .drop("_cn")
    )
    return (
        _null_safe(cells.withColumn("_foff", F.coalesce(F.sum("_n").over(in_coarse), F.lit(0))),
                   coarse_offsets, [*part, "_c"])
        .select(*part, "_c", *f_names, "_n", (F.col("_foff") + F.col("_coff")).alias("_offset"))
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet; the key columns of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def dense_position(
    df: DataFrame,
    coarse: Column,
    fine: Sequence[Column],
    order: Sequence[Column | str],
    partition: Sequence[str] = (),
    out: str = "position",
) -> DataFrame:
    """Add a 1-based consecutive position, restarting per ``partition``; nulls come last."""
    part = list(partition)
    f_names = [f"_f{i}" for i in range(len(fine))]
    keys = [*part, "_c", *f_names]
    offsets = cell_offsets(df, coarse, fine, part).drop("_n")
    tagged = df.withColumns({"_c": coarse, **dict(zip(f_names, fine))})
    in_cell = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(o) if isinstance(o, str) else o for o in order])
    return (
        _null_safe(tagged, offsets, keys)
        .withColumn(out, F.col("_offset") + F.row_number().over(in_cell))
        .select(*df.columns, out)
    )


def cell_starts(ids: DataFrame, order: str, rows: int = CELL_SPAN, most: int = 256) -> list[int]:
    """First ``cell_of`` of consecutive cells joined until they hold about ``rows`` rows, at most ``most`` of them.

    ``ids`` has a row per id. Where ids are far apart, a cell of an id range holds few rows, and there would be
    about as many cells as rows.
    """
    coarse, fine = id_cells(order)
    cells = cell_offsets(ids, coarse, fine)
    total = ids.count()
    size = max(rows, -(-total // most))
    starts = cells.groupBy(F.floor(F.col("_offset") / size).alias("_s")).agg(F.min("_f0").alias("_f0"))
    return sorted(r["_f0"] for r in starts.collect())


def running_count(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = CELL_SPAN,
    starts: Sequence[int] | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` per key by a unique integer ``order``, current row included.

    ``df`` holds at most one row per key and order value.
    """
    return running_counts(df, keys, order, {out: value}, span, starts)


def running_counts(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], span: int = CELL_SPAN,
    starts: Sequence[int] | None = None,
) -> DataFrame:
    """``running_count`` of several columns at once: ``sums`` maps new columns to summed ones.

    ``starts`` as ``cell_starts`` gives them take the place of cells of ``span`` ids.
    """
    keys, values = list(keys), list(sums.values())
    if starts is not None and len(starts) < 2:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(v).over(whole).alias(out) for out, v in sums.items()])
    cell = cell_of(order, span)
    if starts is not None:
        cell = sum(((cell_of(order) >= s).cast("int") for s in starts), F.lit(0))
    cells = (
        df.withColumn("_cell", cell)
        .groupBy(*keys, "_cell").agg(*[F.sum(v).alias(v) for v in values])
    )
    before = (
        Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    # the sum before a cell enters the cell's window as a leading row, which saves a join
    leading = cells.select(
        *keys, "_cell", F.lit(None).cast(df.schema[order].dataType).alias(order),
        *[F.sum(v).over(before).alias(v) for v in values],
    ).dropna(subset=values, how="all")  # nothing comes before a key's first cell
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(F.asc_nulls_first(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = df.withColumn("_cell", cell)
    return (
        rows.unionByName(leading, allowMissingColumns=True)
        .select("*", *[F.sum(v).over(inside).alias(out) for out, v in sums.items()])
        .filter(F.col(order).isNotNull())
        .select(*df.columns, *sums)
    )


def assign_line_id(
    df: DataFrame,
    file: str | None = "file",
    block: str = "block",
    row: str = "row",
    out: str = "line_id",
) -> DataFrame:
    """Consecutive 1-based id in file order.

    With ``file`` the order is (file, block offset, row inside the block), the columns of
    ``read_raw_log``; without it, the unique integer column ``row``.
    """
    if file is None:
        coarse, fine = id_cells(row)
        return dense_position(df, coarse, fine, [row], out=out)
    # a block is one input split, so its rows are bounded by the split size
    return dense_position(df, F.col(file), [F.col(block)], [row], out=out)


def chronological_split(
    df: DataFrame,
    frac: float,
    ts: str | None = "ts",
    line_id: str = "line_id",
    out: str = "split",
) -> DataFrame:
    """Mark the first ``int(n * frac)`` rows in time order as train, the rest as test.

    Only the boundary row is looked up (from cell counts and one cell), so the rows are not
    sorted or shuffled: the mark is a plain comparison that can reach the scan.
    """
    coarse, fine = time_cells(ts, line_id) if ts else id_cells(line_id)
    cells = cell_offsets(df, coarse, fine)
    n_train = int(df.count() * frac)
    cell = cells.filter(
        (F.col("_offset") <= n_train) & (F.col("_offset") + F.col("_n") > n_train)
    ).head()
    if cell is None:
        return df.withColumn(out, F.lit("train"))
    in_cell = F.lit(True)
    for i, column in enumerate(fine):
        in_cell = in_cell & (column == cell[f"_f{i}"])
    first_test = (
        df.filter(in_cell).select(line_id).orderBy(line_id)
        .offset(n_train - cell["_offset"]).limit(1).head()[0]
    )
    is_test = F.col(line_id) >= first_test
    if ts:
        second = fine[0]
        is_test = (second > cell["_f0"]) | ((second == cell["_f0"]) & is_test)
    return df.withColumn(out, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
