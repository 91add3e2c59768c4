"""Shared SQL fragments (common table expressions) of the checks, in DuckDB's dialect."""

from __future__ import annotations

DIMS = """dims AS (SELECT m AS nx, m AS ny, m * m AS plane, (n + m * m - 1) // (m * m) AS nz
         FROM (SELECT CAST(floor(sqrt(floor(sqrt(count(*))))) AS BIGINT) AS m, count(*) AS n FROM events))"""

VOX = f"""{DIMS},
vox AS (SELECT event_id AS index, CAST(floor(value) AS INTEGER) AS value FROM events),
ijk AS (SELECT index, value, CAST(index % nx AS INTEGER) AS x, CAST((index // nx) % ny AS INTEGER) AS y,
               CAST(index // plane AS INTEGER) AS z, nx, ny, nz, plane FROM vox, dims)"""

SPARSE = f"""{DIMS},
sparse AS (SELECT event_id AS index, CAST(floor(value) AS INTEGER) AS value FROM events WHERE event_type <> 'error'),
full_grid AS (SELECT g.i AS index, s.value, CAST(g.i % nx AS INTEGER) AS x, CAST((g.i // nx) % nx AS INTEGER) AS y,
                CAST(g.i // plane AS INTEGER) AS z, nx, plane
         FROM (SELECT unnest(range(nz * plane)) AS i, nx, plane FROM dims) g LEFT JOIN sparse s ON s.index = g.i)"""

GEO = """geo AS (SELECT 2 * m AS nside, m AS nproj, 2 * m AS nray, (n + 2 * m * m - 1) // (2 * m * m) AS sx
        FROM (SELECT CAST(floor(sqrt(floor(sqrt(count(*))))) AS BIGINT) AS m, count(*) AS n FROM events))"""

def tilt_of(source: str) -> str:
    """The tilt series of a table ``event_id, value``."""
    return f"""{GEO},
tilt AS (SELECT event_id AS index, value, CAST(event_id % sx AS INTEGER) AS slice,
                CAST((event_id // sx) % nray AS INTEGER) AS ray_in_proj, CAST(event_id // (sx * nray) AS INTEGER) AS proj
         FROM {source}, geo),
measured AS (SELECT slice, CAST(proj * nray + ray_in_proj AS INTEGER) AS ray, value FROM tilt, geo)"""


TILT = tilt_of("events")
#: The series without the measurements of the ``error`` events.
HOLED = tilt_of("(SELECT * FROM events WHERE event_type <> 'error')")

BANDS = """bands AS (SELECT 2006 + label AS year,
                 CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS band,
                 vec_id, embedding AS pixels FROM embeddings)"""

#: The number of bands that every year has.
CAP = "cap AS (SELECT min(n) AS days FROM (SELECT count(*) AS n FROM bands GROUP BY year))"

#: The day list of a file: its bands up to the length of a year, so that a leap day goes.
DAY_LIST = "day_list AS (SELECT year, least(count(*), 365) AS days FROM bands GROUP BY year)"

CELLS = f"""{BANDS},
cells AS (SELECT year, band, CAST(c AS INTEGER) AS cell, CAST(c // 8 AS INTEGER) AS y, CAST(c % 8 AS INTEGER) AS x,
                 CAST(pixels[c + 1] AS DOUBLE) AS value
          FROM (SELECT year, band, pixels, unnest(range(64)) AS c FROM bands))"""

MASKED = f"""{CELLS},
masked AS (SELECT year, band, cell, y, x, CASE WHEN value BETWEEN -0.4 AND 0.4 THEN value END AS value FROM cells),
cell_sums AS (SELECT year, cell, CASE WHEN count(value) = count(*) THEN sum(value) END AS total,
                     count(*) AS n_bands FROM masked GROUP BY year, cell),
image AS (SELECT year, cell, total / n_bands AS value FROM cell_sums),
ordinals AS (SELECT year, CAST(row_number() OVER (ORDER BY year) - 1 AS INTEGER) AS z
             FROM (SELECT DISTINCT year FROM bands))"""

STACK = f"""{MASKED},
stacked AS (SELECT i.year, CAST(i.cell % 8 AS INTEGER) AS x, CAST(7 - i.cell // 8 AS INTEGER) AS y, o.z, i.value,
                   i.cell % 8 + (7 - i.cell // 8) * 8 + CAST(o.z AS BIGINT) * 64 AS index
            FROM image i JOIN ordinals o USING (year)),
nyears AS (SELECT count(*) AS ny_ FROM ordinals)"""

OBS = """obs AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(dayofyear(l_shipdate) AS INTEGER) AS day,
                CAST(l_partkey % 16 AS INTEGER) AS x, CAST(l_suppkey % 8 AS INTEGER) AS y, l_quantity AS value
         FROM lineitem)"""

EVT = """lines AS (SELECT CAST(event_id // ((n + 9) // 10) AS INTEGER) AS f, ts,
                  CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 0 THEN concat(event_id, 'd') ELSE CAST(value AS VARCHAR) END AS value
           FROM events, (SELECT count(*) AS n FROM events)),
parsed AS (SELECT f, ts, value, try_cast(value AS DOUBLE) AS number FROM lines)"""


def slabs(n: str, source: str, parts: int, rule: str, name: str = "slabs") -> str:
    """Slab table ``pid, lo, hi`` built by accumulating sizes; ``n`` is an expression over ``source``."""
    size = {
        "threshold": f"((p + 1) * ({n})) // {parts} - (p * ({n})) // {parts}",
        "balanced": f"({n}) // {parts} + CASE WHEN p < ({n}) % {parts} THEN 1 ELSE 0 END",
        "even": f"((p + 1) * ({n}) + {parts - 1}) // {parts} - (p * ({n}) + {parts - 1}) // {parts}",
    }[rule]
    return f"""{name} AS (SELECT CAST(p AS INTEGER) AS pid, CAST(sum(size) OVER (ORDER BY p) - size AS BIGINT) AS lo,
       CAST(sum(size) OVER (ORDER BY p) AS BIGINT) AS hi
  FROM (SELECT p, {size} AS size FROM range({parts}) t(p), {source}))"""


def micros(value: str, order: str) -> str:
    """Text of an ordered group of doubles in millionths."""
    return (
        f"string_agg(coalesce(CAST(CAST(round(({value}) * 1000000) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY {order})"
    )


def ints(value: str, order: str) -> str:
    return f"string_agg(CAST({value} AS VARCHAR), ',' ORDER BY {order})"


RAY_MATRIX = """rays AS (
  SELECT ray, proj, j,
         CASE WHEN abs(cos(t) * o) < 1e-8 THEN 0 ELSE cos(t) * o END AS ox,
         CASE WHEN abs(sin(t) * o) < 1e-8 THEN 0 ELSE sin(t) * o END AS oy,
         CASE WHEN abs(sin(t)) < 1e-10 THEN 0 ELSE -sin(t) END AS a,
         CASE WHEN abs(cos(t)) < 1e-10 THEN 0 ELSE cos(t) END AS b, n
  FROM (SELECT CAST(p * nray + j AS INTEGER) AS ray, CAST(p AS INTEGER) AS proj, CAST(j AS INTEGER) AS j,
               (2 * p - (nproj - 1)) * pi() / 180.0 AS t, (j - (nray - 1) / 2.0) AS o, nside AS n
        FROM ray_ids, matrix_geo)),
lines_ AS (SELECT *, k - n / 2.0 AS g FROM (SELECT *, unnest(range(n + 1)) AS k FROM rays)),
points AS (
  SELECT * FROM (
    SELECT ray, n, (g - ox) / nullif(a, 0) AS s, g AS x, b * ((g - ox) / nullif(a, 0)) + oy AS y, ox, oy, a, b FROM lines_
    UNION ALL
    SELECT ray, n, (g - oy) / nullif(b, 0) AS s, a * ((g - oy) / nullif(b, 0)) + ox AS x, g AS y, ox, oy, a, b FROM lines_)
  WHERE s IS NOT NULL AND abs(x) <= n / 2.0 AND abs(y) <= n / 2.0),
once AS (
  SELECT * FROM (SELECT *, lead(x) OVER (PARTITION BY ray ORDER BY s) AS nx, lead(y) OVER (PARTITION BY ray ORDER BY s) AS ny
                 FROM points)
  WHERE NOT coalesce(abs(nx - x) <= 1e-8 AND abs(ny - y) <= 1e-8, false)),
cuts AS (
  SELECT ray, n, ox, oy, a, b, s, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len,
         CASE WHEN abs(0.5 * (x + x2)) < 1e-10 THEN 0 ELSE 0.5 * (x + x2) END AS mx,
         CASE WHEN abs(0.5 * (y + y2)) < 1e-10 THEN 0 ELSE 0.5 * (y + y2) END AS my
  FROM (SELECT ray, n, ox, oy, a, b, s, x, y, lead(x) OVER (PARTITION BY ray ORDER BY s) AS x2,
               lead(y) OVER (PARTITION BY ray ORDER BY s) AS y2 FROM once)
  WHERE x2 IS NOT NULL),
triples AS (
  SELECT ray, CAST(floor(n / 2.0 - my) * n + floor(mx + n / 2.0) AS INTEGER) AS pix, len, n FROM cuts
  WHERE NOT (b = 0 AND abs(oy - n / 2.0) < 1e-15) AND NOT (a = 0 AND abs(ox - n / 2.0) < 1e-15)),
matrix AS (SELECT ray, pix, sum(len) AS len FROM triples WHERE pix >= 0 AND pix < n * n GROUP BY ray, pix)"""

MATRIX = f"""{TILT},
matrix_geo AS (SELECT nside, nproj, nray FROM geo),
ray_ids AS (SELECT DISTINCT proj AS p, ray_in_proj AS j FROM tilt),
{RAY_MATRIX}"""

ART = f"""{MATRIX},
dense AS (SELECT r.ray, list(coalesce(m.len, 0.0) ORDER BY p.pix) AS row_
          FROM (SELECT DISTINCT ray FROM matrix) r
          CROSS JOIN (SELECT unnest(range(nside * nside)) AS pix FROM geo) p
          LEFT JOIN matrix m ON m.ray = r.ray AND m.pix = p.pix GROUP BY r.ray),
steps AS (SELECT row_number() OVER (ORDER BY ray) AS step, ray, row_, list_dot_product(row_, row_) AS norm FROM dense),
b AS (SELECT s.slice, st.step, coalesce(m.value, 0.0) AS value
      FROM (SELECT DISTINCT slice FROM measured) s CROSS JOIN steps st
      LEFT JOIN measured m ON m.slice = s.slice AND m.ray = st.ray),
art(slice, step, f) AS (
  SELECT slice, CAST(0 AS BIGINT), (SELECT list(CAST(0.0 AS DOUBLE)) FROM geo, range(geo.nside * geo.nside))
  FROM (SELECT DISTINCT slice FROM measured)
  UNION ALL
  SELECT u.slice, u.step,
         list_transform(list_zip(u.f, u.row_), lambda q: q[1] + q[2] * u.c)
  FROM (SELECT a.slice, st.step, a.f, st.row_, (b.value - list_dot_product(st.row_, a.f)) / st.norm AS c
        FROM art a JOIN steps st ON st.step = a.step + 1 JOIN b ON b.slice = a.slice AND b.step = st.step) u),
recon AS (SELECT slice, CAST(c AS INTEGER) AS pix, f[c + 1] AS value
          FROM (SELECT slice, f, unnest(range(len(f))) AS c FROM art WHERE step = (SELECT max(step) FROM steps)))"""
