"""The registered raster queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from ..functions.rules import CHANGE_RULES, INDEX_RULES, Rule, midpoint


def _case(value: str, rules: tuple[Rule, ...]) -> str:
    parts = []
    for r in rules:
        tests = []
        if r.lower is not None:
            tests.append(f"{value} {'>=' if r.lower_closed else '>'} ({r.lower})::FLOAT")
        if r.upper is not None:
            tests.append(f"{value} {'<=' if r.upper_closed else '<'} ({r.upper})::FLOAT")
        parts.append(f"WHEN {' AND '.join(tests)} THEN {r.class_id}")
    return f"CASE {' '.join(parts)} ELSE 0 END"


def _rows(rules: tuple[Rule, ...]) -> str:
    return "(VALUES " + ", ".join(f"({r.class_id}, '{r.label}')" for r in rules) + ") AS r(class_id, label)"


def _targets(falling: bool) -> str:
    return "CASE to_class " + " ".join(f"WHEN {r.class_id} THEN {midpoint(r, falling)!r}::DOUBLE" for r in INDEX_RULES) + " END"


def _index(date: str) -> str:
    total = f"(nir_{date} + red_{date})"
    ratio = f"least(greatest((nir_{date} - red_{date}) / {total}, (-1)::FLOAT), 1::FLOAT)"
    return f"CASE WHEN abs({total}) > 1e-10::FLOAT THEN {ratio} END AS ndvi_{date}"


CTES = f"""
cells AS (
  SELECT CAST(e.vec_id // 2 AS INT) AS row, CAST(t.i - 1 AS INT) AS col,
         0.4::DOUBLE + 1.5::DOUBLE * e.embedding[t.i]::DOUBLE AS xb,
         0.4::DOUBLE + 1.5::DOUBLE * e.embedding[t.i]::DOUBLE + o.embedding[t.i]::DOUBLE AS xt
  FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1 CROSS JOIN range(1, 65) t(i) WHERE e.vec_id % 2 = 0
), bands AS (
  SELECT row, col, ((1.0::DOUBLE - xb) / 2.0::DOUBLE)::FLOAT AS red_base, ((1.0::DOUBLE + xb) / 2.0::DOUBLE)::FLOAT AS nir_base,
         ((1.0::DOUBLE - xt) / 2.0::DOUBLE)::FLOAT AS red_target, ((1.0::DOUBLE + xt) / 2.0::DOUBLE)::FLOAT AS nir_target
  FROM cells WHERE (row * 64 + col) % 97 <> 0
), indexed AS (
  SELECT row, col, {_index('base')}, {_index('target')} FROM bands
), pixels AS (
  SELECT row, col, ndvi_base, ndvi_target, (ndvi_target - ndvi_base)::FLOAT AS delta FROM indexed
  WHERE ndvi_base BETWEEN (-1)::FLOAT AND 1::FLOAT AND ndvi_target BETWEEN (-1)::FLOAT AND 1::FLOAT
), classed AS MATERIALIZED (
  SELECT *, {_case('ndvi_base', INDEX_RULES)} AS class_base, {_case('ndvi_target', INDEX_RULES)} AS class_target,
         {_case('delta', CHANGE_RULES)} AS delta_class
  FROM pixels
), size AS (
  SELECT CAST(max(vec_id) // 2 + 1 AS INT) AS height, 64 AS width FROM embeddings
), grid AS (
  SELECT CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col FROM size, range(0, height) r(i), range(0, 64) c(i)
), matrix AS (
  SELECT a.class_id AS from_class, a.label AS from_label, b.class_id AS to_class, b.label AS to_label,
         count(p.row) AS n
  FROM {_rows(INDEX_RULES).replace(' AS r(', ' AS a(')} CROSS JOIN {_rows(INDEX_RULES).replace(' AS r(', ' AS b(')}
  LEFT JOIN classed p ON p.class_base = a.class_id AND p.class_target = b.class_id
  GROUP BY ALL
), chances AS (
  SELECT from_class, to_class, CASE WHEN sum(n) OVER w = 0 THEN (from_class = to_class)::INT::DOUBLE
         ELSE n::DOUBLE / nullif(sum(n) OVER w, 0) END AS probability
  FROM matrix WINDOW w AS (PARTITION BY from_class)
), runs AS MATERIALIZED (
  SELECT row::BIGINT * 4294967296 + min(col) AS run_id, row, min(col) AS first_col, max(col) AS last_col, delta_class
  FROM (SELECT row, col, delta_class, col - row_number() OVER (PARTITION BY row, delta_class ORDER BY col) AS island
        FROM classed WHERE delta_class IN (1, 2, 4, 5))
  GROUP BY row, delta_class, island
), links AS MATERIALIZED (
  SELECT a.run_id AS upper, b.run_id AS lower FROM runs a JOIN runs b ON a.delta_class = b.delta_class AND a.row + 1 = b.row
    AND a.first_col <= b.last_col AND b.first_col <= a.last_col
), reach(a, b) AS (
  SELECT run_id, run_id FROM runs
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT upper AS a, lower AS b FROM links UNION ALL SELECT lower, upper FROM links) l ON r.b = l.a
), run_regions AS MATERIALIZED (
  SELECT runs.*, region_id FROM runs JOIN (SELECT a, min(b) AS region_id FROM reach GROUP BY a) m ON runs.run_id = m.a
), regions AS (
  SELECT region_id, CASE WHEN delta_class IN (1, 2) THEN 'degradation' ELSE 'improvement' END AS change_type, delta_class,
         sum(last_col - first_col + 1)::BIGINT AS pixel_count, min(row) AS min_row, max(row) AS max_row,
         min(first_col) AS min_col, max(last_col) AS max_col,
         500000 + (sum((last_col - first_col + 1) * (first_col + last_col) / 2.0::DOUBLE) / sum(last_col - first_col + 1) + 0.5) * 10 AS centre_x,
         6650000 - (sum((last_col - first_col + 1) * row)::DOUBLE / sum(last_col - first_col + 1) + 0.5) * 10 AS centre_y
  FROM run_regions GROUP BY region_id, delta_class
), top AS MATERIALIZED (
  SELECT * FROM (SELECT *, pixel_count * 100.0::DOUBLE AS area_m2,
    row_number() OVER (PARTITION BY change_type ORDER BY pixel_count DESC, delta_class, min_row, min_col) AS rank FROM regions) WHERE rank <= 20
), rcells AS MATERIALIZED (
  SELECT region_id, row, CAST(unnest(range(first_col, last_col + 1)) AS INT) AS col FROM run_regions SEMI JOIN top USING (region_id)
), sides AS (
  SELECT a.region_id, 10.0::DOUBLE * sum(4 - (SELECT count(*) FROM rcells b WHERE b.region_id = a.region_id
         AND abs(a.row - b.row) + abs(a.col - b.col) = 1)) AS perimeter_m
  FROM rcells a GROUP BY a.region_id
), gaps AS (
  SELECT a.region_id, sqrt((a.centre_x - b.centre_x) ** 2 + (a.centre_y - b.centre_y) ** 2) AS distance
  FROM top a JOIN top b ON a.region_id <> b.region_id
), nearest AS (
  SELECT region_id, coalesce(min(distance), 0) AS nearest FROM top LEFT JOIN gaps USING (region_id) GROUP BY region_id
), context AS (
  SELECT median(v) AS context_distance
  FROM (SELECT sqrt(area_m2 / pi()) AS v FROM top UNION ALL SELECT nearest FROM nearest WHERE nearest > 0)
), shapes AS MATERIALIZED (
  SELECT region_id, area_m2, perimeter_m, 4 * pi() * area_m2 / perimeter_m ** 2 AS compactness, nearest,
         (SELECT count(*) FROM gaps g WHERE g.region_id = top.region_id AND g.distance <= context_distance)::DOUBLE AS neighbours,
         greatest(sqrt(area_m2 / pi()) / sqrt(4 * pi() * area_m2 / perimeter_m ** 2), context_distance) AS reach
  FROM top JOIN sides USING (region_id) JOIN nearest USING (region_id) CROSS JOIN context
), near AS MATERIALIZED (
  SELECT s.region_id, g.row, g.col, reach,
         min(sqrt(greatest((abs(g.col - c.col) - 0.5::DOUBLE) * 10, 0) ** 2 + greatest((abs(g.row - c.row) - 0.5::DOUBLE) * 10, 0) ** 2)) AS square_gap,
         min(10 * sqrt((g.col - c.col) ** 2 + (g.row - c.row) ** 2)) AS centre_gap
  FROM shapes s JOIN rcells c USING (region_id) JOIN grid g
    ON g.row BETWEEN c.row - CAST(ceil(reach / 10) AS INT) - 1 AND c.row + CAST(ceil(reach / 10) AS INT) + 1
   AND g.col BETWEEN c.col - CAST(ceil(reach / 10) AS INT) - 1 AND c.col + CAST(ceil(reach / 10) AS INT) + 1
  GROUP BY ALL HAVING square_gap <= reach
), zones AS (
  SELECT region_id, count(*) AS valid_pixel_count, avg(ndvi_base::DOUBLE) AS mean_ndvi_base, median(ndvi_target::DOUBLE) AS median_ndvi_target,
         CASE WHEN count(*) > 1 THEN stddev_samp(delta::DOUBLE) END AS std_delta_ndvi, min(delta::DOUBLE) AS min_delta_ndvi,
         max(delta::DOUBLE) AS max_delta_ndvi, avg(delta::DOUBLE) AS mean_delta_ndvi, avg((class_target = 1)::INT::DOUBLE) AS class_1_share,
         avg((class_target = 3)::INT::DOUBLE) AS class_3_share
  FROM rcells JOIN classed USING (row, col) GROUP BY region_id
), ring AS (
  SELECT region_id, avg(ndvi_target::DOUBLE) AS surrounding_mean_ndvi, avg(delta::DOUBLE) AS surrounding_mean_delta_ndvi,
         sum((ndvi_target::DOUBLE >= (SELECT median(ndvi_target::DOUBLE) FROM classed))::INT) AS green
  FROM near JOIN classed USING (row, col) WHERE centre_gap > 0 GROUP BY region_id
), weights AS MATERIALIZED (
  SELECT region_id,
         0.35 * area_m2 / max(area_m2) OVER () + 0.30 * abs(mean_delta_ndvi) / max(abs(mean_delta_ndvi)) OVER ()
         + CASE WHEN max(neighbours) OVER () > 0 THEN 0.15 * neighbours / max(neighbours) OVER () ELSE 0 END
         + 0.10 * compactness / max(compactness) OVER ()
         + 0.10 * abs(surrounding_mean_delta_ndvi) / max(abs(surrounding_mean_delta_ndvi)) OVER () AS forecast_weight
  FROM shapes JOIN zones USING (region_id) JOIN ring USING (region_id)
), influence AS MATERIALIZED (
  SELECT row, col, coalesce(max(forecast_weight * least(1, greatest(0, 1 - centre_gap / 10 / greatest(reach / 10, 1)))), 0) AS influence
  FROM classed LEFT JOIN near USING (row, col) LEFT JOIN weights USING (region_id) GROUP BY row, col
), steps AS (
  SELECT CAST(unnest(range(-2, 3)) AS INT) AS d
), windowed AS MATERIALIZED (
  SELECT g.row, g.col, count(p.row) AS n, sum(abs(least(p.delta::DOUBLE, 0))) AS loss, sum(p.ndvi_target::DOUBLE) AS s,
         sum(p.ndvi_target::DOUBLE ** 2) AS q
  FROM grid g CROSS JOIN size CROSS JOIN steps a CROSS JOIN steps b
  LEFT JOIN classed p ON p.row = least(greatest(g.row + a.d, 0), height - 1) AND p.col = least(greatest(g.col + b.d, 0), width - 1)
  GROUP BY g.row, g.col
), focal AS MATERIALIZED (
  SELECT row, col, CASE WHEN n > 0 THEN loss / n ELSE 0 END AS loss_around, CASE WHEN n > 0 THEN s / n ELSE 0 END AS local_mean,
         CASE WHEN n > 0 THEN sqrt(greatest(q / n - (s / n) ** 2, 0)) ELSE 0 END AS local_std
  FROM windowed
), staged AS MATERIALIZED (
  SELECT *, CASE WHEN delta < (-0.2)::FLOAT AND ndvi_base >= 0.45::FLOAT THEN 'new_development' WHEN delta < (-0.05)::FLOAT THEN 'degradation'
         WHEN ndvi_target < 0.25::FLOAT THEN 'stable_urban' WHEN ndvi_target >= 0.45::FLOAT THEN 'stable_green' ELSE 'other' END AS scenario
  FROM classed
), refs AS MATERIALIZED (
  SELECT urban, green, (urban + green) / 2 AS ceiling FROM (
    SELECT coalesce(median(ndvi_target::DOUBLE) FILTER (scenario = 'stable_urban'), median(ndvi_target::DOUBLE)) AS urban,
           coalesce(median(ndvi_target::DOUBLE) FILTER (scenario = 'stable_green'), median(ndvi_target::DOUBLE)) AS green FROM staged)
), able AS MATERIALIZED (
  SELECT staged.*, least(greatest(least(ndvi_base::DOUBLE, ceiling) - ndvi_target::DOUBLE, 0), abs(least(delta::DOUBLE, 0))) AS capacity
  FROM staged CROSS JOIN refs
), tops AS (
  SELECT (SELECT max(influence) FROM influence) AS mi, (SELECT max(loss_around) FROM focal) AS ml, (SELECT max(local_std) FROM focal) AS ms,
         (SELECT max(capacity) FROM able) AS mc, 9999.0::DOUBLE AS leak
), scored AS MATERIALIZED (
  SELECT a.*, influence, loss_around * influence / mi AS base_loss,
         0.45 * influence / mi + 0.25 * (1 - abs(delta::DOUBLE) / leak) + 0.20 * loss_around / ml + 0.10 * local_std / ms AS score,
         capacity / mc + abs(least(delta::DOUBLE, 0)) / leak AS gain_score
  FROM able a JOIN influence USING (row, col) JOIN focal USING (row, col) CROSS JOIN tops
), losing AS MATERIALIZED (
  SELECT * FROM scored WHERE scenario = 'degradation' AND influence > 0 AND (row, col) IN (SELECT (row, col) FROM near)
), loss_quota AS MATERIALIZED (
  SELECT *, sum(requested) OVER (PARTITION BY from_class ORDER BY to_class) AS high FROM (
    SELECT from_class, to_class, probability, CAST(round_even(n * probability, 0) AS BIGINT) AS requested
    FROM chances JOIN (SELECT class_target AS from_class, count(*) AS n FROM losing GROUP BY class_target) USING (from_class)
    WHERE to_class < from_class) WHERE requested > 0
), lost AS MATERIALIZED (
  SELECT row, col, to_class, greatest(base_loss, greatest(ndvi_target::DOUBLE - {_targets(True)}, 0)) AS applied
  FROM (SELECT *, row_number() OVER (PARTITION BY class_target ORDER BY score DESC, row * 64 + col DESC) AS r FROM losing
        WHERE NOT (abs(delta) > 0.35::FLOAT AND ndvi_target < 0.18::FLOAT)) x
  JOIN loss_quota q ON q.from_class = x.class_target AND r > high - requested AND r <= high
), gaining AS (
  SELECT * FROM scored WHERE scenario = 'new_development' AND capacity > 0
), gain_quota AS MATERIALIZED (
  SELECT *, sum(requested) OVER (PARTITION BY from_class ORDER BY to_class) AS high FROM (
    SELECT from_class, to_class, probability, CAST(round_even(n * probability, 0) AS BIGINT) AS requested
    FROM chances JOIN (SELECT class_target AS from_class, count(*) AS n FROM gaining GROUP BY class_target) USING (from_class)
    WHERE to_class > from_class) WHERE requested > 0
), gained AS MATERIALIZED (
  SELECT row, col, to_class, least(capacity, greatest(greatest({_targets(False)} - ndvi_target::DOUBLE, 0), 2.0::DOUBLE ** -23)) AS applied
  FROM (SELECT *, row_number() OVER (PARTITION BY class_target ORDER BY gain_score DESC, row * 64 + col DESC) AS r FROM gaining) x
  JOIN gain_quota q ON q.from_class = x.class_target AND r > high - requested AND r <= high
), density AS MATERIALIZED (
  SELECT g.row, g.col, coalesce(avg((scenario = 'stable_green' OR ndvi_target::DOUBLE >= refs.green)::INT::DOUBLE) FILTER (p.row IS NOT NULL), 0) AS density
  FROM grid g CROSS JOIN size CROSS JOIN refs CROSS JOIN steps a CROSS JOIN steps b
  LEFT JOIN staged p ON p.row = least(greatest(g.row + a.d, 0), height - 1) AND p.col = least(greatest(g.col + b.d, 0), width - 1)
  GROUP BY g.row, g.col
), greened AS (
  SELECT * FROM (
    SELECT row, col, least(0.03 + 0.05 * density / (SELECT max(density) FROM density), greatest(ceiling - ndvi_target::DOUBLE, 0)) AS applied
    FROM staged JOIN density USING (row, col) CROSS JOIN refs
    WHERE scenario = 'stable_urban' AND ndvi_target::DOUBLE <= urban AND density > 0) WHERE applied > 0
), forecast AS (
  SELECT row, col, scenario, least(greatest((ndvi_target::DOUBLE - coalesce(l.applied, 0) + coalesce(g.applied, 0) + coalesce(u.applied, 0))::FLOAT,
         (-1)::FLOAT), 1::FLOAT) AS forecast
  FROM staged LEFT JOIN lost l USING (row, col) LEFT JOIN gained g USING (row, col) LEFT JOIN greened u USING (row, col)
)
"""


def _sql(select: str) -> str:
    """``select`` over the shared tables; it may begin with further ones."""
    return f"WITH RECURSIVE {CTES} {select}"


def _lonlat() -> str:
    """Inverse transverse Mercator by two series in the third flattening: to conformal, then to geographic latitude."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    number = lambda v: f"({v:.20e})::DOUBLE"
    sinh, cosh = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
    xi = "xi0" + "".join(f" - {number(b)} * sin({2 * j} * xi0) * {cosh.format(f'{2 * j} * eta0')}" for j, b in enumerate(beta, 1))
    eta = "eta0" + "".join(f" - {number(b)} * cos({2 * j} * xi0) * {sinh.format(f'{2 * j} * eta0')}" for j, b in enumerate(beta, 1))
    latitude = "chi" + "".join(f" + {number(d)} * sin({2 * j} * chi)" for j, d in enumerate(delta, 1))
    return f""", flat AS (SELECT change_type, rank, centre_y / {number(0.9996 * radius)} AS xi0, (centre_x - 500000) / {number(0.9996 * radius)} AS eta0 FROM top),
      bent AS (SELECT change_type, rank, {xi} AS xi, {eta} AS eta FROM flat),
      round_ AS (SELECT change_type, rank, asin(sin(xi) / {cosh.format('eta')}) AS chi, atan2({sinh.format('eta')}, cos(xi)) AS lam FROM bent)
      SELECT change_type, rank::INT AS rank, round(33 + degrees(lam), 7) AS centroid_lon, round(degrees({latitude}), 7) AS centroid_lat FROM round_"""


_LONLAT = _lonlat()


def _areas(column: str, rules: tuple[Rule, ...], source: str = "classed", area: str = "100.0::DOUBLE") -> str:
    return f"""
      SELECT class_id, label, count(p.{column}) AS pixel_count, round(coalesce(sum(CASE WHEN p.{column} IS NOT NULL THEN {area} END), 0), 4) AS area_m2,
             round(coalesce(sum(CASE WHEN p.{column} IS NOT NULL THEN {area} END), 0) / 10000, 6) AS area_ha,
             round(100.0::DOUBLE * coalesce(sum(CASE WHEN p.{column} IS NOT NULL THEN {area} END), 0)
                   / sum(sum(CASE WHEN p.{column} IS NOT NULL THEN {area} END)) OVER (), 6) AS percent
      FROM {_rows(rules)} LEFT JOIN {source} p ON p.{column} = r.class_id GROUP BY class_id, label"""


def _spread(low: float, high: float, values: str, zero: bool) -> str:
    ends = f"SELECT quantile_cont(x, {low}) AS lo, quantile_cont(x, {high}) AS hi FROM ({values})"
    if zero:
        ends = f"""SELECT lo1 AS lo, CASE WHEN hi <= 0 THEN greatest(abs(lo1) * 0.05, 0.01) ELSE hi END AS hi
                   FROM (SELECT CASE WHEN lo >= 0 THEN -greatest(hi * 0.05, 0.01) ELSE lo END AS lo1, hi FROM ({ends}))"""
    return f"""SELECT round(CASE WHEN hi > lo THEN lo ELSE lo - greatest(abs(lo) * 0.05, 0.01) END, 6) AS vmin,
               round(CASE WHEN hi > lo THEN hi ELSE hi + greatest(abs(lo) * 0.05, 0.01) END, 6) AS vmax FROM ({ends})"""


#: The 80 m band area closed form on the ellipsoid, for rows of 0.001 degrees from 60 N down.
_Q = "(sin(radians({0})) / (1 - 0.0066943799901413165 * sin(radians({0})) ** 2) + ln((1 + 0.08181919084262149 * sin(radians({0}))) / (1 - 0.08181919084262149 * sin(radians({0})))) / (2 * 0.08181919084262149))"

LINES = f"""
WITH sums AS (
  SELECT l_orderkey AS row, l_linenumber AS col, count(*) AS n, sum(round(l_quantity)::BIGINT) AS q,
         sum(round(l_discount * 100)::BIGINT) AS d, sum(round(l_tax * 100)::BIGINT) AS x
  FROM lineitem GROUP BY ALL
), bands AS (
  SELECT row, col, ((5.0::DOUBLE * n + 18.0::DOUBLE * q::DOUBLE / 10.0::DOUBLE) / (100.0::DOUBLE * n))::FLOAT AS nir_base,
         ((5.0::DOUBLE * n + 18.0::DOUBLE * q::DOUBLE / 10.0::DOUBLE) / (100.0::DOUBLE * n))::FLOAT AS nir_target,
         ((10.0::DOUBLE * n + 3.0::DOUBLE * d::DOUBLE) / (100.0::DOUBLE * n))::FLOAT AS red_base,
         ((10.0::DOUBLE * n + 3.0::DOUBLE * x::DOUBLE) / (100.0::DOUBLE * n))::FLOAT AS red_target
  FROM sums
), indexed AS (SELECT row, col, {_index('base')}, {_index('target')} FROM bands
), classed AS (
  SELECT *, {_case('ndvi_base', INDEX_RULES)} AS class_base, {_case('ndvi_target', INDEX_RULES)} AS class_target,
         {_case('(ndvi_target - ndvi_base)', CHANGE_RULES)} AS delta_class
  FROM indexed WHERE ndvi_base IS NOT NULL AND ndvi_target IS NOT NULL
)"""

_STATS = "count(*) AS pixel_count, round(avg(x), 6) AS mean, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std"

#: A triangle with a corner off the lattice, in the dense raster's coordinates, and its even-odd test.
TRIANGLE = [(500_003.0, 6_649_997.0), (500_551.0, 6_649_702.0), (500_104.0, 6_648_903.0)]


def _crosses(a: tuple[float, float], b: tuple[float, float]) -> str:
    (x1, y1), (x2, y2) = a, b
    lo, hi = min(y1, y2), max(y1, y2)
    return f"CASE WHEN {lo} <= y AND y < {hi} AND x >= {x1} + (y - ({y1})) * ({x2 - x1}) / ({y2 - y1}) THEN 1 ELSE 0 END"


_TRIANGLE_HITS = " + ".join(_crosses(a, b) for a, b in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]]))

ORACLES = {
    "ndvi_raw": _sql("SELECT row, col, round(ndvi_base::DOUBLE, 6) AS ndvi_base, round(ndvi_target::DOUBLE, 6) AS ndvi_target FROM indexed"),
    "ndvi_class_areas": _sql(_areas("class_base", INDEX_RULES)),
    "ndvi_target_class_areas": _sql(_areas("class_target", INDEX_RULES)),
    "common_mask": _sql("SELECT row, col FROM pixels"),
    "masked_ndvi": _sql("SELECT row, col, round(ndvi_base::DOUBLE, 6) AS ndvi FROM pixels"),
    "delta_ndvi": _sql("SELECT row, col, round(delta::DOUBLE, 6) AS delta FROM pixels"),
    "ndvi_classes": _sql("SELECT row, col, class_base, class_target FROM classed"),
    "delta_classes": _sql("SELECT row, col, delta_class FROM classed"),
    "ndvi_ready_float": _sql("SELECT row, col, round(ndvi_base::DOUBLE, 6) AS ndvi FROM indexed WHERE ndvi_base IS NOT NULL"),
    "ndvi_ready_int16": _sql(
        "SELECT row, col, round((CAST(round(ndvi_base::DOUBLE * 10000) AS FLOAT) / 10000::FLOAT)::DOUBLE, 6) AS ndvi FROM indexed WHERE ndvi_base IS NOT NULL"
    ),
    "scaled_band": _sql(
        "SELECT row, col, round((CASE WHEN abs(v - (-9999)::FLOAT) > 1e-8 + 0.09999::DOUBLE THEN (v * 0.5::FLOAT + 0.25::FLOAT)::FLOAT END)::DOUBLE, 6) AS value "
        "FROM (SELECT row, col, CASE WHEN (row + col) % 7 = 0 THEN (-9999.05)::FLOAT ELSE red_base END AS v FROM bands)"
    ),
    "classify_boundaries": f"""
      WITH v AS (SELECT unnest([-1, 0.0999, 0.10, 0.25, 0.45, 0.65, 0.6501, 1, -0.2, -0.2001, -0.05, -0.0501, 0.05, 0.0499, 0.2, 0.1999]::FLOAT[]) AS value)
      SELECT round(value::DOUBLE, 6) AS value, {_case('value', INDEX_RULES)} AS ndvi_class, {_case('value', CHANGE_RULES)} AS delta_class FROM v""",
    "value_stats": _sql(
        f"SELECT metric, {_STATS} FROM (SELECT unnest(['ndvi_base', 'ndvi_target', 'delta']) AS metric, unnest([ndvi_base, ndvi_target, delta])::DOUBLE AS x FROM pixels) GROUP BY metric"
    ),
    "delta_class_areas": _sql(_areas("delta_class", CHANGE_RULES)),
    "transition_matrix": _sql(
        """SELECT from_class, from_label, to_class, to_label, from_class || ' -> ' || to_class AS transition, n AS pixel_count,
           n * 100.0::DOUBLE AS area_m2, round(n * 100.0::DOUBLE / 10000, 6) AS area_ha, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS percent,
           round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pixel_percent FROM matrix"""
    ),
    "transition_probabilities": _sql("SELECT from_class, to_class, round(probability, 6) AS probability FROM chances"),
    "display_range": _sql(_spread(0.05, 0.99, "SELECT unnest([ndvi_base, ndvi_target])::DOUBLE AS x FROM pixels", False)),
    "delta_display_range": _sql(_spread(0.02, 0.98, "SELECT delta::DOUBLE AS x FROM pixels", True)),
    "row_area_model": _sql(
        f"""SELECT row, round(abs({_Q.format('(60 - row * 0.001)')} - {_Q.format('(60 - (row + 1) * 0.001)')})
            * 6378137.0::DOUBLE ** 2 * (1 - 0.0066943799901413165) / 2 * radians(0.001), 3) AS cell_area, count(*) AS pixel_count FROM pixels GROUP BY row"""
    ),
    "change_runs": _sql("SELECT run_id, row, first_col, last_col, delta_class FROM runs"),
    "change_run_links": _sql("SELECT upper, lower FROM links"),
    "change_components": _sql("SELECT run_id, region_id FROM run_regions"),
    "largest_changes": _sql(
        """SELECT change_type, delta_class, area_m2, round(area_m2 / 10000, 6) AS area_ha, 500000.0::DOUBLE + min_col * 10 AS bbox_min_x,
           6650000.0::DOUBLE - (max_row + 1) * 10 AS bbox_min_y, 500000.0::DOUBLE + (max_col + 1) * 10 AS bbox_max_x,
           6650000.0::DOUBLE - min_row * 10 AS bbox_max_y, rank FROM top"""
    ),
    "component_perimeter": _sql("SELECT region_id, perimeter_m FROM sides"),
    "nearest_component": _sql("SELECT region_id, round(nearest, 4) AS nearest FROM nearest"),
    "context_distance": _sql("SELECT round(context_distance, 4) AS context_distance FROM context"),
    "region_geometry": _sql(
        """SELECT region_id, round(compactness, 6) AS compactness, round(area_m2 / perimeter_m, 6) AS area_perimeter_ratio,
           round(sqrt(area_m2 / pi()), 6) AS equivalent_radius, neighbours AS neighbour_polygon_count, round(reach, 4) AS reach FROM shapes"""
    ),
    "buffer_footprint": _sql("SELECT DISTINCT row, col FROM near"),
    "zonal_stats": _sql(
        """SELECT region_id, valid_pixel_count, round(mean_ndvi_base, 6) AS mean_ndvi_base, round(median_ndvi_target, 6) AS median_ndvi_target,
           round(std_delta_ndvi, 6) AS std_delta_ndvi, round(min_delta_ndvi, 6) AS min_delta_ndvi, round(max_delta_ndvi, 6) AS max_delta_ndvi,
           round(class_1_share, 6) AS class_1_share, round(class_3_share, 6) AS class_3_share FROM zones"""
    ),
    "zonal_more": _sql(
        """SELECT region_id, round(median(ndvi_base::DOUBLE), 6) AS median_ndvi_base, round(median(delta::DOUBLE), 6) AS median_delta_ndvi,
           round(avg(ndvi_target::DOUBLE), 6) AS mean_ndvi_target, round(avg(delta::DOUBLE), 6) AS mean_delta_ndvi,
           round(stddev_samp(ndvi_base::DOUBLE), 6) AS std_ndvi_base, round(stddev_samp(ndvi_target::DOUBLE), 6) AS std_ndvi_target,
           round(min(ndvi_base)::DOUBLE, 6) AS min_ndvi_base, round(max(ndvi_base)::DOUBLE, 6) AS max_ndvi_base,
           round(min(ndvi_target)::DOUBLE, 6) AS min_ndvi_target, round(max(ndvi_target)::DOUBLE, 6) AS max_ndvi_target,
           round(avg((class_target = 2)::INT::DOUBLE), 6) AS class_2_share, round(avg((class_target = 4)::INT::DOUBLE), 6) AS class_4_share,
           round(avg((class_target = 5)::INT::DOUBLE), 6) AS class_5_share FROM rcells JOIN classed USING (row, col) GROUP BY region_id"""
    ),
    "filled_features": _sql(
        """, spread AS (SELECT region_id, stddev_samp(ndvi_base::DOUBLE) AS b, stddev_samp(ndvi_target::DOUBLE) AS t, stddev_samp(delta::DOUBLE) AS d
           FROM rcells JOIN classed USING (row, col) GROUP BY region_id)
           SELECT region_id, round(coalesce(b, (SELECT median(b) FROM spread), 0), 6) AS std_ndvi_base,
           round(coalesce(t, (SELECT median(t) FROM spread), 0), 6) AS std_ndvi_target, round(coalesce(d, (SELECT median(d) FROM spread), 0), 6) AS std_delta_ndvi
           FROM spread"""
    ),
    "context_ring": _sql(
        """SELECT region_id, round(surrounding_mean_ndvi, 6) AS surrounding_mean_ndvi, round(surrounding_mean_delta_ndvi, 6) AS surrounding_mean_delta_ndvi,
           round(area_m2 / greatest(green * 100.0, 100.0), 6) AS surrounding_green_area_ratio FROM top JOIN ring USING (region_id)"""
    ),
    "forecast_weights": _sql("SELECT region_id, round(forecast_weight, 6) AS forecast_weight FROM weights"),
    "influence_surface": _sql("SELECT row, col, round(influence, 6) AS influence FROM influence"),
    "mean_loss": _sql(
        "SELECT round(abs(coalesce(avg(delta::DOUBLE) FILTER (delta < 0), 0)), 6) AS mean_loss FROM classed SEMI JOIN rcells USING (row, col)"
    ),
    "local_mean_5x5": _sql("SELECT row, col, round(local_mean, 6) AS local_mean FROM focal"),
    "local_std_5x5": _sql("SELECT row, col, round(local_std, 4) AS local_std FROM focal"),
    "scenario_references": _sql("SELECT round(urban, 6) AS urban, round(green, 6) AS green, round(ceiling, 6) AS ceiling FROM refs"),
    "recovery_capacity": _sql("SELECT row, col, round(capacity, 6) AS capacity FROM able"),
    "degradation_quota": _sql("SELECT row, col, to_class, round(applied, 6) AS applied FROM lost"),
    "degradation_requests": _sql("SELECT from_class, to_class, round(probability, 6) AS probability, requested FROM loss_quota"),
    "recovery_quota": _sql("SELECT row, col, to_class, round(applied, 6) AS applied FROM gained"),
    "urban_greening": _sql("SELECT row, col, round(applied, 6) AS applied FROM greened"),
    "scenario_summary": _sql("SELECT scenario, count(*) AS pixel_count, round(count(*) * 100.0::DOUBLE / 10000, 6) AS area_ha FROM staged GROUP BY scenario"),
    "staged_forecast": _sql("SELECT row, col, scenario, round(forecast::DOUBLE, 5) AS forecast FROM forecast"),
    "changed_pixels": _sql(
        """SELECT count(*) FILTER (abs(s.ndvi_target - f.forecast) > 1e-8 + 1e-5 * abs(f.forecast)) AS changed
           FROM staged s JOIN forecast f USING (row, col)"""
    ),
    "band_metadata": _sql(
        """SELECT 'EPSG:32636' AS crs, any_value(width)::INT AS width, any_value(height)::INT AS height, 10.0::DOUBLE AS pixel_size_x, 10.0::DOUBLE AS pixel_size_y,
           (-9999.0)::DOUBLE AS nodata, count(red_base) AS valid_count, round(min(red_base)::DOUBLE, 6) AS valid_min, round(max(red_base)::DOUBLE, 6) AS valid_max
           FROM bands, size"""
    ),
    "lonlat_centroid": _sql(_LONLAT),
    "kmeans_predict": _sql(
        """SELECT row, col, list_position(d, list_min(d)) - 1 AS cluster FROM (SELECT row, col, [((ndvi_base::DOUBLE - 0.4) / 0.2 + 1) ** 2 + ((ndvi_target::DOUBLE - 0.4) / 0.2 + 1) ** 2,
           ((ndvi_base::DOUBLE - 0.4) / 0.2) ** 2 + ((ndvi_target::DOUBLE - 0.4) / 0.2 - 0.5) ** 2,
           ((ndvi_base::DOUBLE - 0.4) / 0.2 - 1) ** 2 + ((ndvi_target::DOUBLE - 0.4) / 0.2 - 1) ** 2] AS d FROM pixels)"""
    ),
    "snap_grid": "SELECT vec_id, floor((vec_id * 3.7::DOUBLE) / 10) * 10 AS snapped_down, ceil((vec_id * 3.7::DOUBLE) / 10) * 10 AS snapped_up FROM embeddings",
    "clip_polygon": _sql(
        f"SELECT row, col FROM (SELECT row, col, 500000 + (col + 0.5::DOUBLE) * 10 AS x, 6650000 - (row + 0.5::DOUBLE) * 10 AS y FROM pixels) WHERE ({_TRIANGLE_HITS}) % 2 = 1"
    ),
    "bilinear_resample": _sql(
        """, target AS (SELECT CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, (c.i + 0.5::DOUBLE) * 0.7::DOUBLE + 0.3::DOUBLE - 0.5::DOUBLE AS fx,
                  (r.i + 0.5::DOUBLE) * 0.7::DOUBLE + 0.4::DOUBLE - 0.5::DOUBLE AS fy FROM range(0, 90) r(i), range(0, 80) c(i)),
           corner AS (SELECT row, col, floor(fy)::INT + a.i AS sr, floor(fx)::INT + b.i AS sc,
                  (CASE WHEN a.i = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN b.i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
                  FROM target, range(0, 2) a(i), range(0, 2) b(i))
           SELECT k.row, k.col, round((sum(w * ndvi_base::DOUBLE) / sum(w))::FLOAT::DOUBLE, 5) AS value FROM corner k JOIN pixels p ON p.row = k.sr AND p.col = k.sc
           WHERE w > 0 GROUP BY k.row, k.col"""
    ),
    "quality_report": """SELECT unnest(['ndvi_range', 'target_ndvi_range', 'delta_range', 'forecast_range', 'spatial_grid', 'nodata_masks', 'statistics',
                         'transition_matrix', 'change_polygons']) AS "check", TRUE AS passed""",
    "line_class_areas": LINES + _areas("class_base", INDEX_RULES),
    "line_transition_matrix": LINES + """
      SELECT class_base AS from_class, class_target AS to_class, count(*) AS pixel_count FROM classed GROUP BY ALL""",
    "line_value_stats": LINES + f"""
      SELECT metric, {_STATS} FROM (SELECT unnest(['ndvi_base', 'ndvi_target']) AS metric, unnest([ndvi_base, ndvi_target])::DOUBLE AS x FROM classed) GROUP BY metric""",
    "line_change_runs": LINES + """
      SELECT delta_class, count(*) AS runs, sum(n)::BIGINT AS cells FROM (
        SELECT row, delta_class, island, count(*) AS n FROM (SELECT row, delta_class, col - row_number() OVER (PARTITION BY row, delta_class ORDER BY col) AS island
        FROM classed WHERE delta_class IN (1, 2, 4, 5)) GROUP BY ALL) GROUP BY delta_class""",
}
