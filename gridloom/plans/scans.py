"""Scans, sources and stored forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.index import idiv
from gridloom.operators import raster
from gridloom.operators.grid import PACK_CELLS
from gridloom.plans import sqltext as Q
from gridloom.plans.registry import ints_text, micros_text, query
from gridloom.session import scratch_path
from gridloom.sources import archive, etl
from gridloom.sources import fixtures as fx

NX = fx.BAND_SIDE
PLANE = NX * NX
SCALE = 100.0        # band values are fractions: widened before they are cut to int32
CHUNK = 10           # chunk size for 64-pixel bands: six full chunks and a short one
PICKED = [0, 9, 19, 29]
MASK = (-0.4, 0.4)


@query("scan_voxels", "SELECT event_id AS index, CAST(floor(value) AS INTEGER) AS value FROM events")
def scan_voxels(spark, sf):
    columns = {"index": F.col("event_id"), "value": F.floor("value").cast("int")}
    return etl.scan_voxels(spark, f"{sf}/events.parquet", fx.SCHEMAS["events"], columns)


@query(
    "grid_from_values",
    "SELECT vec_id, CAST(c AS INTEGER) AS pos, CAST(embedding[c + 1] AS DOUBLE) AS value "
    "FROM (SELECT vec_id, embedding, unnest(range(64)) AS c FROM embeddings)",
)
def grid_from_values(spark, sf):
    arrays = fx.table(spark, sf, "embeddings")
    return arrays.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", "pos", F.col("v").cast("double").alias("value")
    )


@query(
    "param_rows",
    "SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) AS cx, CAST(0 AS DOUBLE) AS cy, CAST(0 AS DOUBLE) AS cz, "
    "CAST((s_suppkey % 4 + 1) * 6 AS INTEGER) AS resolution FROM supplier",
)
def param_rows(spark, sf):
    rows = fx.param_rows(spark, sf).repartition("id")
    c = F.col("center")
    return rows.select("id", c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), "resolution")


@query("band_scan_long", f"WITH {Q.CELLS} SELECT year, band, y, x, value FROM cells")
def band_scan_long(spark, sf):
    stored = archive.read(spark, fx.archived_bands(spark, sf))
    return raster.bands_long(stored, NX).select("year", "band", "y", "x", "value")


@query(
    "band_worklist_scan",
    f"""WITH {Q.CELLS}, {Q.DAY_LIST},
work AS (SELECT year, CAST(unnest(range(days)) AS INTEGER) AS band FROM day_list)
SELECT year, band, string_agg(CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY cell) AS pixels
FROM cells JOIN work USING (year, band) GROUP BY year, band""",
)
def band_worklist_scan(spark, sf):
    work = raster.worklist(fx.day_lists(spark, sf))
    found = archive.read_listed(spark, fx.archived_bands(spark, sf), work)
    return found.select("year", "band", micros_text(F.col("pixels")).alias("pixels"))


@query(
    "band_chunks",
    f"""WITH {Q.CELLS}
SELECT year, band, CAST(cell // {CHUNK} AS INTEGER) AS chunk, concat(year, '-', cell // {CHUNK}) AS key,
       CAST(count(*) AS INTEGER) AS n, {Q.micros('value', 'cell')} AS pixels
FROM cells GROUP BY year, band, cell // {CHUNK}""",
)
def band_chunks(spark, sf):
    return raster.chunks(fx.bands(spark, sf), CHUNK).select(
        "year", "band", "chunk", "key", F.size("pixels").alias("n"), micros_text(F.col("pixels")).alias("pixels")
    )


@query(
    "volume_scan",
    f"""WITH {Q.CELLS}
SELECT year, CAST(band AS BIGINT) * 64 + cell AS index, CAST(trunc(value * 100.0) AS INTEGER) AS value_int,
       round(value * 100.0, 6) AS value FROM cells""",
)
def volume_scan(spark, sf):
    stacked = etl.stack_pages(archive.read(spark, fx.archived_bands(spark, sf)), PLANE, SCALE)
    return stacked.select(
        "year", "index", F.col("value").cast("int").alias("value_int"), F.round("value", 6).alias("value")
    )


@query(
    "etl_index_value",
    f"""WITH {Q.CELLS}
SELECT year, CAST(band AS BIGINT) * 64 + cell AS index, CAST(trunc(value * 100.0) AS INTEGER) AS value FROM cells""",
)
def etl_index_value(spark, sf):
    return etl.save(etl.index_value(fx.bands(spark, sf), PLANE, SCALE), scratch_path(spark, "iv"))


@query("etl_value_only", f"WITH {Q.VOX} SELECT index, value FROM vox")
def etl_value_only(spark, sf):
    # the position is kept as a column: row order of a file is no position
    voxels = fx.vox(spark, sf).repartitionByRange("index").sortWithinPartitions("index")
    return etl.save(voxels, scratch_path(spark, "values"))


@query("etl_xyzv", f"WITH {Q.VOX} SELECT x, y, z, value FROM ijk")
def etl_xyzv(spark, sf):
    return etl.save(etl.xyzv(fx.vox(spark, sf), fx.vox_dims(spark, sf)), scratch_path(spark, "xyzv"))


@query(
    "etl_xyav",
    f"""WITH {Q.TILT}
SELECT CAST(slice - 0.5 * sx AS DOUBLE) AS x, CAST(ray_in_proj - 0.5 * nray AS DOUBLE) AS y, proj AS angle,
       CAST(floor(value) AS INTEGER) AS value
FROM tilt, geo""",
)
def etl_xyav(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    return etl.save(etl.xyav(fx.vox(spark, sf), fx.tilt_dims(geometry, slices)), scratch_path(spark, "xyav"))


@query(
    "etl_tilt_wide",
    f"""WITH {Q.TILT}
SELECT t.proj AS projection, CAST(index % (sx * nray) // {PACK_CELLS} AS INTEGER) AS tile,
       {Q.ints('CAST(floor(value) AS INTEGER)', 'index')} AS pixels, t.proj AS tiltangles, concat(any_value(nproj), ',', any_value(nray), ',', any_value(sx)) AS dimensions,
       CAST(10 AS INTEGER) AS pixelsize
FROM tilt t, geo GROUP BY t.proj, index % (sx * nray) // {PACK_CELLS}""",
)
def etl_tilt_wide(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    wide = etl.save(etl.tilt_wide(fx.vox(spark, sf), fx.tilt_dims(geometry, slices)), scratch_path(spark, "wide"))
    return wide.select(
        "projection",
        "tile",
        ints_text(F.col("pixels")).alias("pixels"),
        "tiltangles",
        ints_text(F.col("dimensions")).alias("dimensions"),
        "pixelsize",
    )


@query("etl_upload", f"WITH {Q.VOX} SELECT index, value FROM vox")
def etl_upload(spark, sf):
    return etl.save(fx.vox(spark, sf), scratch_path(spark, "upload"))


def _frames(bands):
    scaled = bands.withColumn("pixels", F.transform("pixels", lambda v: v.cast("double") * SCALE))
    return raster.frames(scaled, NX)


FLIPPED = "(7 - cell // 8) * 8 + cell % 8"
CENTI = "CAST(trunc(value * 100.0) AS INTEGER)"


@query(
    "frame_export_single",
    f"WITH {Q.CELLS} SELECT year, band, {Q.ints(CENTI, FLIPPED)} AS daily_max FROM cells GROUP BY year, band",
)
def frame_export_single(spark, sf):
    # one row per frame; folders per year only, a folder per frame would be millions of tiny files
    stored = etl.save(_frames(fx.bands(spark, sf)), scratch_path(spark, "frames"), partition_by=["year"], order_by=["band"])
    return stored.select("year", "band", ints_text(F.col("daily_max")).alias("daily_max"))


@query(
    "frame_export_multi",
    "WITH "
    + Q.CELLS
    + " SELECT year, "
    + ", ".join(
        f"string_agg(CAST({CENTI} AS VARCHAR), ',' ORDER BY {FLIPPED}) FILTER (WHERE band = {b}) AS \"Daily Max ({b + 1})\""
        for b in PICKED
    )
    + " FROM cells GROUP BY year",
)
def frame_export_multi(spark, sf):
    ids = fx.band_ids(spark, sf).where(F.col("band").isin(PICKED))
    picked = fx.picked_bands(spark, sf, ids, len(PICKED) * fx.common_bands(spark, sf)[1])
    picked = raster.multi_frames(_frames(picked), PICKED)
    names = [f"Daily Max ({b + 1})" for b in PICKED]
    path = scratch_path(spark, "multi")
    # array names are data of the file, so they are stored under plain column names
    plain = picked.toDF("year", *[f"band_{b}" for b in PICKED])
    stored = etl.save(plain, path, partition_by=["year"])
    return stored.select("year", *[ints_text(F.col(f"band_{b}")).alias(n) for b, n in zip(PICKED, names)])


def _annual(spark, sf):
    return raster.mean_image(raster.band_sums(fx.band_arrays(spark, sf), *MASK))


@query(
    "frame_export_annual",
    f"WITH {Q.MASKED} SELECT year, CAST(7 - cell // 8 AS INTEGER) AS y, CAST(cell % 8 AS INTEGER) AS x, "
    "round(value, 6) AS value FROM image",
)
def frame_export_annual(spark, sf):
    image = raster.flip_rows(
        _annual(spark, sf).select(
            "year", idiv(F.col("cell"), NX).cast("int").alias("y"), (F.col("cell") % NX).alias("x"), "value"
        ),
        NX,
    )
    stored = etl.save(image, scratch_path(spark, "annual"), partition_by=["year"], order_by=["y", "x"])
    return stored.withColumn("value", F.round("value", 6))


@query("frame_export_stack", f"WITH {Q.STACK} SELECT index, x, y, z, round(value, 6) AS value FROM stacked")
def frame_export_stack(spark, sf):
    years = raster.years_of(fx.band_arrays(spark, sf))
    volume = raster.stack(_annual(spark, sf), years, years.count(), NX, NX)
    stored = etl.save(volume.drop("year"), scratch_path(spark, "stack"))
    return stored.withColumn("value", F.round("value", 6))
