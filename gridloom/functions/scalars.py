"""Scalar rules of the raster, tilt and stream families."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the results depend on.
TILT_STEP_DEG = 2.0        # degrees between projections of a tilt series
TILT_PI = 3.141592654      # pi as the point clouds use it
PIXEL_SIZE = 10            # constant stored with every projection
THRESHOLD = 2.0            # reconstructed values below this become 0
DAYS_PER_YEAR = 365        # divisor of the fixed-length annual mean
CHUNK_SIZE = 10000         # pixels per chunk of a flattened band
VALID_RANGE = (0, 50000)   # kelvin-scaled raster values outside are invalid
VALID_UPPER = 5000         # stream and per-value jobs drop values from here on
MASK_OWNED = 1             # cell present in this partition
MASK_HIDDEN = 32           # cell of another partition
Z_BINS_PER_PARTITION = 4   # bins of the z histogram per partition
NUMBER_LINE = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"
EPS_DIRECTION = 1e-10      # ray directions and midpoints below this are 0
EPS_ORIGIN = 1e-8          # ray origins below this are 0
EPS_SAME_POINT = 1e-8      # crossings closer than this are one point
EPS_BOUNDARY = 1e-15       # distance at which a ray lies on the grid edge


def snap_zero(value: Column, eps: float) -> Column:
    return F.when(F.abs(value) < eps, F.lit(0.0)).otherwise(value)


def truncate_int(value: Column) -> Column:
    """Truncating cast; Spark's cast already cuts towards zero."""
    return value.cast("int")


def threshold(value: Column, floor: float = THRESHOLD) -> Column:
    return F.when(value < floor, F.lit(0.0)).otherwise(value)


def mask_range(value: Column, lo: float, hi: float) -> Column:
    """Keep the row, null the value outside ``[lo, hi]``."""
    return F.when(value.between(lo, hi), value)


def kelvin_to_f(kelvin: Column) -> Column:
    return (kelvin - 273.15) * 9 / 5 + 32


def year_from_name(name: Column) -> Column:
    """``..._2006.tif`` -> 2006."""
    return F.regexp_extract(name, r"_(\d{4})\.tif$", 1).cast("int")


def year_from_tail(name: Column) -> Column:
    """The same year cut by position: the four characters before the extension."""
    return F.substring(name, -8, 4).cast("int")


def parse_number(line: Column) -> Column:
    """A number line, or null where the line is not a number; a cast alone would take "1.5f" and "2d" too."""
    text = F.trim(line)
    return F.when(text.rlike(NUMBER_LINE), text.try_cast("double"))


def z_bin(z: Column, max_z: Column, parts: int) -> Column:
    return F.call_function("div", z * (Z_BINS_PER_PARTITION * parts), max_z + 1).cast("int")


def tilt_angle_deg(proj: Column, n_proj: int) -> Column:
    """Angles -(n-1), -(n-3) .. n-1 by projection ordinal."""
    return (proj * 2 - (n_proj - 1)).cast("int")


def tilt_radians(ordinal: Column) -> Column:
    return ordinal.cast("double") * TILT_STEP_DEG / 180.0 * TILT_PI


def radians(angle_deg: Column) -> Column:
    return angle_deg * math.pi / 180.0
