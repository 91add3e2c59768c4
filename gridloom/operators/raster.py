"""Raster operators: bands to cells, masking, means per key and per cell, stacking, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.index import idiv
from gridloom.functions.scalars import mask_range
from gridloom.operators.grid import PACK_CELLS
from gridloom.session import broadcast_if_small

#: Memory a task may hold in partial images before it hands them on.
STATE_BYTES = 128 * 1024 * 1024


def bands_long(bands: DataFrame, nx: int) -> DataFrame:
    """``year, [band,] cell, y, x, value``: one row per pixel, value widened to DOUBLE before any sum.

    ``band`` is carried when the input has it; per-cell sums do not need it.
    """
    keys = [c for c in ("year", "band") if c in bands.columns]
    cells = bands.select(*keys, F.posexplode("pixels").alias("cell", "value"))
    return cells.select(
        *keys,
        "cell",
        idiv(F.col("cell"), nx).cast("int").alias("y"),
        (F.col("cell") % nx).alias("x"),
        F.col("value").cast("double").alias("value"),
    )


def years_of(bands: DataFrame) -> DataFrame:
    """The distinct years, from a scan of that one column."""
    return bands.select("year").distinct()


def file_names(years: DataFrame, prefix: str = "tasmax_day_") -> DataFrame:
    return years.select(*years.columns, F.concat(F.lit(prefix), F.col("year").cast("string"), F.lit(".tif")).alias("name"))


def worklist(files: DataFrame, days: int | str = "days") -> DataFrame:
    """One row per (file, day ordinal): the day list is generated from each file row, ``days`` long (a number or the
    name of a column, which goes). No days give no rows."""
    length = F.col(days) if isinstance(days, str) else F.lit(days)
    ordinals = F.when(length > 0, F.sequence(F.lit(0), length - 1))
    rows = files.withColumn("band", F.explode(ordinals))
    return rows.drop(days) if isinstance(days, str) else rows


def with_mask(cells: DataFrame, lo: float, hi: float) -> DataFrame:
    return cells.withColumn("value", mask_range(F.col("value"), lo, hi))


def mean_by(df: DataFrame, keys: list[str], hi: float) -> DataFrame:
    """Drop values from ``hi`` on, then sum, count and mean per key. The filter sits below a
    partial aggregation, so a key with most of the rows still shuffles one row per task."""
    return (
        df.where(F.col("value") < hi)
        .groupBy(*keys)
        .agg(F.sum(F.col("value").cast("double")).alias("total"), F.count("value").alias("n"))
        .withColumn("mean", F.col("total") / F.col("n"))
    )


def mean_by_inline(df: DataFrame, keys: list[str], hi: float) -> DataFrame:
    """The same with the test inside the aggregation: keys without valid values keep a row."""
    valid = F.when(F.col("value") < hi, F.col("value").cast("double"))
    return (
        df.groupBy(*keys)
        .agg(F.sum(valid).alias("total"), F.count(valid).alias("n"))
        .withColumn("mean", F.try_divide("total", "n"))
    )


def cell_sum(cells: DataFrame, keys: tuple[str, ...] = ("year", "cell")) -> DataFrame:
    """Per-cell sum over bands; null when the cell is masked in any band.

    ``n_bands`` is the number of bands of the cell, masked or not.
    """
    complete = F.count("value") == F.count(F.lit(1))
    return cells.groupBy(*keys).agg(
        F.when(complete, F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n_bands")
    )


def _sum_bands(lo: float, hi: float, state_bytes: int):
    """Adds up whole bands as arrays, one image per (year, length), while they stream by."""

    def emit(held: dict) -> pa.RecordBatch:
        sizes = [total.size for total, _, _ in held.values()]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        totals = np.concatenate([total for total, _, _ in held.values()])
        masked = np.concatenate([mask for _, mask, _ in held.values()])
        images = pa.ListArray.from_arrays(offsets, pa.array(totals, mask=masked))
        years = pa.array([year for year, _ in held], pa.int32())
        counts = pa.array([n for _, _, n in held.values()], pa.int64())
        return pa.RecordBatch.from_arrays([years, counts, images], names=["year", "n", "pixels"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        for rb in batches:
            lists = rb.column("pixels")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            years = rb.column("year").to_numpy(zero_copy_only=False)
            for year, size in {(int(y), int(n)) for y, n in zip(years, sizes) if n > 0}:
                rows = starts[(years == year) & (sizes == size)]
                images = flat[rows[:, None] + np.arange(size)]
                valid = (images >= lo) & (images <= hi)  # a missing value fails both tests
                total = np.where(valid, images, 0.0).sum(axis=0)
                mask, n = ~valid.all(axis=0), rows.size
                if (year, size) in held:
                    before = held[year, size]
                    total, mask, n = total + before[0], mask | before[1], n + before[2]
                held[year, size] = (total, mask, n)
            if sum(size for _, size in held) * 9 > state_bytes:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    return kernel


def band_sums(bands: DataFrame, lo: float = -np.inf, hi: float = np.inf, state_bytes: int = STATE_BYTES) -> DataFrame:
    """Per-cell sums of array bands ``year, pixels``: ``year, cell, total, n_bands`` as in ``cell_sum``.

    For bands of many pixels. ``cell_sum`` makes a row per pixel and day and looks each one up in a
    hash table; here a task adds the bands it reads as whole arrays, and only these partial
    images (one per task and year) are exploded and shuffled. A partial image is null where
    any of its days was outside ``[lo, hi]``.
    """
    partial = bands.select("year", "pixels").mapInArrow(
        _sum_bands(lo, hi, state_bytes), "year INT, n BIGINT, pixels ARRAY<DOUBLE>"
    )
    cells = partial.select("year", "n", F.posexplode("pixels").alias("cell", "value"))
    complete = F.count("value") == F.count(F.lit(1))
    return cells.groupBy("year", "cell").agg(
        F.when(complete, F.sum("value")).alias("total"), F.sum("n").alias("n_bands")
    )


def mean_image(sums: DataFrame, divisor: int | None = None) -> DataFrame:
    """Annual mean image ``year, cell, value`` from per-cell sums: over all bands of the year, or
    over a fixed ``divisor``."""
    by = F.col("n_bands") if divisor is None else F.lit(divisor)
    return sums.select("year", "cell", (F.col("total") / by).alias("value"))


def cell_mean(cells: DataFrame, divisor: int | None = None) -> DataFrame:
    """Annual mean image of pixel rows."""
    return mean_image(cell_sum(cells), divisor)


def raster_stats(image: DataFrame) -> DataFrame:
    """Per year: total, unmasked cells, min, max and mean of an annual image."""
    return image.groupBy("year").agg(
        F.sum("value").alias("total"),
        F.count("value").alias("n_valid"),
        F.min("value").alias("min_cell"),
        F.max("value").alias("max_cell"),
        F.avg("value").alias("mean_cell"),
    )


def flip_rows(df: DataFrame, ny: int) -> DataFrame:
    """Turn an image upside down: row 0 becomes the last row."""
    return df.withColumn("y", (F.lit(ny - 1) - F.col("y")).cast("int"))


def slice_ordinals(years: DataFrame) -> DataFrame:
    """``year, z``: ordinal of each year in sorted order. The window spans one row per year."""
    return years.select("year", (F.row_number().over(W.orderBy("year")) - 1).cast("int").alias("z"))


def with_slice(df: DataFrame, years: DataFrame, n_years: int) -> DataFrame:
    """Attach the slice ordinal; ``n_years`` is the counted number of years."""
    return df.join(broadcast_if_small(slice_ordinals(years), n_years, 16), "year")


def stack(image: DataFrame, years: DataFrame, n_years: int, nx: int, ny: int, flip: bool = True) -> DataFrame:
    """Yearly images ``year, cell, value`` to one volume ``index, x, y, z, value``, z = year ordinal.

    Image rows are stored top first, so they are flipped on the way unless told otherwise.
    """
    cells = image.select(
        "year", (F.col("cell") % nx).alias("x"), idiv(F.col("cell"), nx).cast("int").alias("y"), "value"
    )
    if flip:
        cells = flip_rows(cells, ny)
    index = F.col("x") + F.col("y") * nx + F.col("z").cast("bigint") * (nx * ny)
    return with_slice(cells, years, n_years).select("year", index.alias("index"), "x", "y", "z", "value")


def chunks(bands: DataFrame, size: int) -> DataFrame:
    """Split each band into chunks of ``size`` pixels, the last one short, keyed ``year-chunk``.

    A chunk is a slice of its band's array, so nothing is shuffled.
    """
    n = F.size("pixels")
    last = idiv(n - 1, size).cast("int")
    return (
        bands.where(n > 0)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "year",
            "band",
            "chunk",
            F.concat_ws("-", F.col("year").cast("string"), F.col("chunk").cast("string")).alias("key"),
            F.slice("pixels", F.col("chunk") * size + 1, F.lit(size)).alias("pixels"),
        )
    )


def chunk_lookup(bands: DataFrame, size: int, key: str, head: int = 10) -> DataFrame:
    """Size and first values of the chunks with a key (one per band).

    The key names its year and chunk, so the year is a filter on the scan and the chunk one slice
    of the array; no other chunk is built.
    """
    year, chunk = (int(part) for part in key.split("-"))
    part = F.slice("pixels", chunk * size + 1, size)
    return (
        bands.where((F.col("year") == year) & (F.size("pixels") > chunk * size))
        .select("band", part.alias("pixels"))
        .select(F.lit(key).alias("key"), "band", F.size("pixels").alias("n"), F.slice("pixels", 1, head).alias("head"))
    )


def pack(image: DataFrame, tile: int = PACK_CELLS) -> DataFrame:
    """Cell values back to arrays ``year, tile, values``, in cell order; an image larger than a
    tile becomes several rows, so that no row outgrows a task."""
    return (
        image.groupBy("year", idiv(F.col("cell"), tile).cast("int").alias("tile"))
        .agg(F.sort_array(F.collect_list(F.struct("cell", "value"))).alias("cells"))
        .select("year", "tile", F.col("cells.value").alias("values"))
    )


def frames(bands: DataFrame, nx: int) -> DataFrame:
    """Export form of a band: rows flipped, values truncated to int32, flattened again.

    Works on the array of each row, so a frame never meets another row.
    """
    ny = idiv(F.size("pixels"), nx)

    def flipped(at: Column) -> Column:
        source = (ny - 1 - idiv(at, nx)) * nx + at % nx
        return F.get("pixels", source.cast("int")).cast("double").cast("int")

    places = F.when(F.size("pixels") > 0, F.sequence(F.lit(0), F.size("pixels") - 1)).otherwise(F.array().cast("array<int>"))
    return bands.select("year", "band", F.transform(places, flipped).alias("daily_max"))


def multi_frames(frames_: DataFrame, band_ids: list[int]) -> DataFrame:
    """One row per year with a named array per selected band (``Daily Max (n)``, 1-based n)."""
    picked = frames_.where(F.col("band").isin(band_ids))
    return picked.groupBy("year").agg(
        *[
            F.max(F.when(F.col("band") == b, F.col("daily_max"))).alias(f"Daily Max ({b + 1})")
            for b in band_ids
        ]
    )
