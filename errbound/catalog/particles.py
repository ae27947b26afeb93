"""Particle sets: grid blocks, delta streams, inverse, output order, block-size search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.catalog.tables import (ORDERS_PARTICLES_SQL, PARTICLES_SQL, orders_particles, particles)
from errbound.operators import kdtree
from errbound.operators import particles as pt
from errbound.operators.ordering import ordered_prefix
from errbound.operators.stats import distortion

EB = 0.5
EDGE = 4
VOLUME = EDGE ** 3
# Small buckets, so that the test tables already span several.
BLOCK_WIDTH, CELL_WIDTH = 16, 64


def _blocked(df: DataFrame, eb: float = EB, edge: int = EDGE) -> DataFrame:
    return pt.with_block_ids(pt.with_grid(df, [], eb), eb, pt.constant_edge(edge))


def _cells(spark, sf_dir) -> DataFrame:
    return pt.occupied_cells(_blocked(particles(spark, sf_dir)), [])


def _blocked_sql(points: str = PARTICLES_SQL, eb: float = EB, edge: int = EDGE, extra: str = "") -> str:
    ids = "pid, " if "pid" in points else ""
    return f"""{points}, bx AS (SELECT min(x) px, min(y) py, min(z) pz, max(x)-min(x) rx, max(y)-min(y) ry,
  max(z)-min(z) rz FROM pts),
g AS (SELECT {ids}x, y, z, px, py, pz, CAST(floor((x - px) / {eb!r}::DOUBLE) AS BIGINT) // 2 AS qx,
  CAST(floor((y - py) / {eb!r}::DOUBLE) AS BIGINT) // 2 AS qy,
  CAST(floor((z - pz) / {eb!r}::DOUBLE) AS BIGINT) // 2 AS qz,
  (CAST(ceil(rx / (2.0::DOUBLE * {edge} * {eb!r}::DOUBLE)) AS BIGINT) + 2) // 2 AS nx,
  (CAST(ceil(ry / (2.0::DOUBLE * {edge} * {eb!r}::DOUBLE)) AS BIGINT) + 2) // 2 AS ny FROM pts, bx),
b AS (SELECT *, qx // {edge} // 2 + (qy // {edge} // 2) * nx + (qz // {edge} // 2) * nx * ny AS block,
  (qx // {edge}) % 2 + ((qy // {edge}) % 2) * 2 + ((qz // {edge}) % 2) * 4 AS oct,
  qx % {edge} + (qy % {edge}) * {edge} + (qz % {edge}) * {edge * edge} AS pos FROM g)"""


def bounding_box(spark, sf_dir):
    return pt.bounding_box(particles(spark, sf_dir), [])


BOX_SQL = f"""WITH {PARTICLES_SQL} SELECT min(x) AS px, min(y) AS py, min(z) AS pz, max(x) - min(x) AS rx,
  max(y) - min(y) AS ry, max(z) - min(z) AS rz FROM pts"""


def particle_blocks(spark, sf_dir):
    """Occupied blocks with id deltas: the flagship grouping."""
    return pt.block_table(_cells(spark, sf_dir), [], BLOCK_WIDTH)


BLOCKS_SQL = f"""WITH {_blocked_sql()}, t AS (
  SELECT block, count(*) AS count, count(DISTINCT (oct, pos)) AS cells FROM b GROUP BY block)
SELECT block, block - coalesce(lag(block) OVER (ORDER BY block), 0) AS delta, count, cells FROM t"""


def particle_deltas(spark, sf_dir):
    """Octant and position deltas of every occupied cell."""
    d = pt.cell_deltas(_cells(spark, sf_dir), [], VOLUME, CELL_WIDTH)
    return d.select("block", "oct", "pos", "n", "oct_delta", "pos_delta")


_DELTA_SQL = f"""WITH {_blocked_sql()}, c AS (SELECT block, oct, pos, count(*) AS n FROM b GROUP BY block, oct, pos),
d AS (SELECT *, oct - coalesce(lag(oct) OVER (PARTITION BY block ORDER BY oct, pos), 0) AS oct_delta,
  pos - coalesce(lag(pos) OVER (PARTITION BY block, oct ORDER BY pos), 0) AS pos_delta FROM c)"""
DELTAS_SQL = _DELTA_SQL + " SELECT block, oct, pos, n, oct_delta, pos_delta FROM d"


def particle_octants(spark, sf_dir):
    """Particles per octant."""
    return _cells(spark, sf_dir).groupBy("oct").agg(F.sum("n").alias("n"))


OCTANTS_SQL = f"WITH {_blocked_sql()} SELECT oct, count(*) AS n FROM b GROUP BY oct"


def particle_inverse(spark, sf_dir):
    """Decode the delta streams back to cell centres; counts per centre must match the input."""
    pts = particles(spark, sf_dir)
    cells = pt.occupied_cells(_blocked(pts), [])
    # Block ids come back from their own delta stream.
    blocks = pt.block_table(cells, [], BLOCK_WIDTH)
    ids = ordered_prefix(blocks, [], ["block"], None, {"delta": "restored"}, width=BLOCK_WIDTH).select("block", "restored")
    placed = pt.placed_deltas(pt.cell_deltas(cells, [], VOLUME), [])
    back = pt.restore_cells(placed, []).join(ids, "block").withColumn("block", F.col("restored"))
    grid = pt.restore_grid(back.select("block", "oct", "pos", "n"), pt.bounding_box(pts, []), [], EB, (EDGE,) * 3)
    return grid.select(*[F.round(a, 6).alias(a) for a in "xyz"], "n")


INVERSE_SQL = f"""WITH {_blocked_sql()} SELECT round((2 * qx + 1)::DOUBLE * {EB!r}::DOUBLE + px, 6) AS x,
  round((2 * qy + 1)::DOUBLE * {EB!r}::DOUBLE + py, 6) AS y,
  round((2 * qz + 1)::DOUBLE * {EB!r}::DOUBLE + pz, 6) AS z, count(*) AS n FROM b GROUP BY qx, qy, qz, px, py, pz"""


REPAIR_EB = 0.05


def particle_repair(spark, sf_dir):
    """Particles whose centre misses the bound by rounding, as position codes."""
    return pt.repair_list(orders_particles(spark, sf_dir), [], REPAIR_EB)


def _repair_sql() -> str:
    parts = []
    for a in "xyz":
        c = f"((2 * q{a} + 1)::DOUBLE * {REPAIR_EB!r}::DOUBLE + p{a})"
        parts.append(f"SELECT '{a}' AS axis, pid * 2 + CASE WHEN {c} > {a} THEN 1 ELSE 0 END AS code "
                     f"FROM b WHERE abs({c} - {a}) > {REPAIR_EB!r}::DOUBLE")
    return f"WITH {_blocked_sql(ORDERS_PARTICLES_SQL, REPAIR_EB)} " + " UNION ALL ".join(parts)


def particle_order(spark, sf_dir):
    """The permutation from input to output order."""
    blocked = _blocked(orders_particles(spark, sf_dir), EB, EDGE)
    return pt.output_order(blocked, [], VOLUME, 4096)


ORDER_SQL = f"""WITH {_blocked_sql(ORDERS_PARTICLES_SQL)}
SELECT pid, row_number() OVER (ORDER BY block, oct, pos, pid) - 1 AS position FROM b"""


def particle_verify(spark, sf_dir):
    """Original against decoded, matched by particle id through the permutation."""
    pts = orders_particles(spark, sf_dir)
    grid = pt.with_grid(pts, [], REPAIR_EB)
    dec = grid.select("pid", *[pt.decoded(a, REPAIR_EB, pt.repair_sign(a, REPAIR_EB)).alias(f"d{a}") for a in "xyz"])
    both = pts.join(dec, "pid")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("o"), F.col(f"d{a}").alias("d"))
                                           for a in "xyz"])).alias("e")).select("e.*")
    rep = distortion(long, ["axis"], "o", "d")
    return rep.select("axis", "n", F.round("v_range", 6).alias("v_range"), F.round("mse", 8).alias("mse"),
                      F.round("psnr", 6).alias("psnr"),
                      (F.col("max_abs_err") <= REPAIR_EB * (1 + 1e-9)).alias("bound_ok"))


def _verify_sql() -> str:
    parts = []
    for a in "xyz":
        c = f"((2 * q{a} + 1)::DOUBLE * {REPAIR_EB!r}::DOUBLE + p{a})"
        d = f"CASE WHEN abs({c} - {a}) > {REPAIR_EB!r}::DOUBLE THEN {c} + CASE WHEN {c} > {a} THEN -1 ELSE 1 END * {REPAIR_EB!r}::DOUBLE ELSE {c} END"
        parts.append(f"SELECT '{a}' AS axis, {a} AS o, {d} AS d FROM b")
    return f"""WITH {_blocked_sql(ORDERS_PARTICLES_SQL, REPAIR_EB)}, l AS ({' UNION ALL '.join(parts)})
SELECT axis, count(*) AS n, round(max(o) - min(o), 6) AS v_range, round(sum((d-o)*(d-o)) / count(*), 8) AS mse,
  round(20 * log10(max(o) - min(o)) - 10 * log10(sum((d-o)*(d-o)) / count(*)), 6) AS psnr, true AS bound_ok
FROM l GROUP BY axis"""


def stream_sizes(spark, sf_dir):
    """Coded size and method of the four streams."""
    hist = pt.stream_histograms(_cells(spark, sf_dir), [], VOLUME)
    s = pt.stream_sizes(hist, [])
    return s.select("stream", "n", F.round("entropy_bits", 3).alias("entropy_bits"), "fixed_bits", "method")


def _sizes_tail(src: str = "d") -> str:
    return f"""hb AS (SELECT 'block' AS stream, block - coalesce(lag(block) OVER (ORDER BY block), 0) AS symbol, 1 AS w
  FROM (SELECT DISTINCT block FROM c)),
hc AS (SELECT 'count' AS stream, sum(n) AS symbol, 1 AS w FROM c GROUP BY block),
hs AS (SELECT * FROM hb UNION ALL SELECT * FROM hc
  UNION ALL SELECT 'octant', oct_delta, 1 FROM {src} UNION ALL SELECT 'octant', 0, n - 1 FROM {src}
  UNION ALL SELECT 'position', pos_delta, 1 FROM {src} UNION ALL SELECT 'position', 0, n - 1 FROM {src}),
h AS (SELECT stream, symbol, sum(w) AS f FROM hs WHERE w > 0 GROUP BY stream, symbol),
z AS (SELECT stream, sum(f) AS n, sum(f) * log2(sum(f)) - sum(f * log2(f)) AS e,
  CAST(sum(f) * greatest(1, ceil(log2(max(symbol) - min(symbol) + 1))) AS DOUBLE) AS fx FROM h GROUP BY stream)"""


STREAM_SIZES_SQL = f"""{_DELTA_SQL}, {_sizes_tail()}
SELECT stream, CAST(n AS BIGINT) AS n, round(e, 3) AS entropy_bits, fx AS fixed_bits,
  CASE WHEN e < fx THEN 'huffman' ELSE 'fixed' END AS method FROM z"""


def _ranges(df: DataFrame) -> list[float]:
    """Three numbers from a one-row aggregate; they decide which candidates exist."""
    return [float(v) for v in pt.bounding_box(df, []).select("rx", "ry", "rz").first()]


def blocksize_formula(spark, sf_dir):
    """Block edge of the formula mode over several bounds, with the search span, from the data's box."""
    pts = particles(spark, sf_dir)
    ranges = _ranges(pts)
    rows = []
    for eb in (0.5, 0.1, 0.01, 0.001):
        low, high = pt.search_span(ranges, eb)
        fallback = pt.blocking_fallback(ranges, eb)
        rows.append(F.struct(F.lit(eb).alias("eb"), F.lit(low).alias("low"), F.lit(high).alias("high"),
                             F.lit(-1 if fallback is None else fallback).alias("fallback"),
                             F.lit(pt.formula_edge(ranges, eb)).alias("edge")))
    return pt.bounding_box(pts, []).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


FORMULA_SQL = f"""WITH {PARTICLES_SQL}, r AS (
  SELECT max(x)-min(x) AS rx, max(y)-min(y) AS ry, max(z)-min(z) AS rz FROM pts),
e AS (SELECT unnest([0.5::DOUBLE, 0.1, 0.01, 0.001]) AS eb),
s AS (SELECT eb, greatest(0, CAST(ceil(log2(greatest(rx, ry, rz) / (2 * eb) / 2e5)) AS INT)) AS low,
  CAST(ceil(log2(least(rx, ry, rz) / eb)) AS INT) AS high, greatest(rx, ry, rz) AS mx,
  CAST(floor(1 + -14.75::DOUBLE * -log10(eb) + 27.9583333333333333::DOUBLE * pow(-log10(eb), 2)
    - 16.25::DOUBLE * pow(-log10(eb), 3) + 3.04166666666666667::DOUBLE * pow(-log10(eb), 4) + 0.1) AS BIGINT) AS f
  FROM e, r)
SELECT eb, low, high, CASE WHEN mx > 1e6 OR mx / eb >= 4294967296 THEN 0 WHEN mx / eb <= 16 THEN 1 ELSE -1 END AS fallback,
  CAST(least(greatest(f, CAST(pow(2, low) AS BIGINT)), CAST(pow(2, high) AS BIGINT)) AS INT) AS edge FROM s"""


SEARCH_EB = 0.1


def blocksize_entropy(spark, sf_dir):
    """Estimated bits per particle of every candidate edge."""
    pts = particles(spark, sf_dir)
    c = pt.entropy_candidates(pts, _ranges(pts), SEARCH_EB)
    return c.select("a", "n", F.round("bits_per_particle", 6).alias("bits_per_particle"))


ENTROPY_SQL = f"""WITH {PARTICLES_SQL}, r AS (
  SELECT max(x)-min(x) AS rx, max(y)-min(y) AS ry, max(z)-min(z) AS rz FROM pts),
t AS (SELECT a, 2.0::DOUBLE * {SEARCH_EB!r}::DOUBLE * pow(2, a) AS w,
  CAST(ceil(rx / (2.0::DOUBLE * pow(2, a) * {SEARCH_EB!r}::DOUBLE)) AS BIGINT) // 7 + 1 AS nx,
  CAST(ceil(ry / (2.0::DOUBLE * pow(2, a) * {SEARCH_EB!r}::DOUBLE)) AS BIGINT) // 7 + 1 AS ny
  FROM r, unnest(range(17)) AS k(a) WHERE a <= ceil(log2(least(rx, ry, rz) / {SEARCH_EB!r}::DOUBLE))),
i AS (SELECT a, CAST(floor(x / w + (y / w + (z / w) * ny) * nx) AS BIGINT) AS id FROM pts, t),
d AS (SELECT a, id - coalesce(lag(id) OVER (PARTITION BY a ORDER BY id), 0) AS s FROM i),
h AS (SELECT a, s, count(*) AS f FROM d GROUP BY a, s)
SELECT a, CAST(sum(f) AS BIGINT) AS n, round((sum(f) * log2(sum(f)) - sum(f * log2(f))) / sum(f) + 3 * a, 6) AS bits_per_particle
FROM h GROUP BY a"""


def blocksize_trial(spark, sf_dir):
    """Trial-encoded size of every cubic edge."""
    pts = particles(spark, sf_dir)
    s = pt.trial_sizes(pts, _ranges(pts), SEARCH_EB)
    return s.select("bx", "by", "bz", F.round("bits", 2).alias("bits"))


def _trial_sql() -> str:
    eb = SEARCH_EB
    return f"""WITH {PARTICLES_SQL}, r AS (
  SELECT min(x) px, min(y) py, min(z) pz, max(x)-min(x) AS rx, max(y)-min(y) AS ry, max(z)-min(z) AS rz FROM pts),
t AS (SELECT CAST(pow(2, a) AS BIGINT) AS e, px, py, pz,
  (CAST(ceil(rx / (2.0::DOUBLE * pow(2, a) * {eb!r}::DOUBLE)) AS BIGINT) + 2) // 2 AS nx,
  (CAST(ceil(ry / (2.0::DOUBLE * pow(2, a) * {eb!r}::DOUBLE)) AS BIGINT) + 2) // 2 AS ny
  FROM r, unnest(range(17)) AS k(a) WHERE a <= ceil(log2(least(rx, ry, rz) / {eb!r}::DOUBLE))),
q AS (SELECT e, nx, ny, CAST(floor((x - px) / {eb!r}::DOUBLE) AS BIGINT) // 2 AS qx,
  CAST(floor((y - py) / {eb!r}::DOUBLE) AS BIGINT) // 2 AS qy, CAST(floor((z - pz) / {eb!r}::DOUBLE) AS BIGINT) // 2 AS qz FROM pts, t),
c AS (SELECT e, qx // e // 2 + (qy // e // 2) * nx + (qz // e // 2) * nx * ny AS block,
  (qx // e) % 2 + ((qy // e) % 2) * 2 + ((qz // e) % 2) * 4 AS oct,
  qx % e + (qy % e) * e + (qz % e) * e * e AS pos, count(*) AS n FROM q GROUP BY 1, 2, 3, 4),
d AS (SELECT *, oct - coalesce(lag(oct) OVER (PARTITION BY e, block ORDER BY oct, pos), 0) AS od,
  pos - coalesce(lag(pos) OVER (PARTITION BY e, block, oct ORDER BY pos), 0) AS pd FROM c),
hs AS (SELECT e, 'block' AS stream, block - coalesce(lag(block) OVER (PARTITION BY e ORDER BY block), 0) AS symbol, 1 AS w
    FROM (SELECT DISTINCT e, block FROM c)
  UNION ALL SELECT e, 'count', sum(n), 1 FROM c GROUP BY e, block
  UNION ALL SELECT e, 'octant', od, 1 FROM d UNION ALL SELECT e, 'octant', 0, n - 1 FROM d
  UNION ALL SELECT e, 'position', pd, 1 FROM d UNION ALL SELECT e, 'position', 0, n - 1 FROM d),
h AS (SELECT e, stream, symbol, sum(w) AS f FROM hs WHERE w > 0 GROUP BY 1, 2, 3),
z AS (SELECT e, stream, least(sum(f) * log2(sum(f)) - sum(f * log2(f)),
  sum(f) * greatest(1, ceil(log2(max(symbol) - min(symbol) + 1)))) AS bits FROM h GROUP BY e, stream)
SELECT e AS bx, e AS "by", e AS bz, round(sum(bits), 2) AS bits FROM z GROUP BY e"""


def blocksize_best(spark, sf_dir):
    """The edge that the trial mode picks."""
    pts = particles(spark, sf_dir)
    return pt.best_edge(pt.trial_sizes(pts, _ranges(pts), SEARCH_EB)).select("bx", "by", "bz")


BEST_SQL = f"SELECT bx, \"by\", bz FROM ({_trial_sql()}) ORDER BY bits, bx LIMIT 1"


KD_LEVELS = 8


def kd_boxes(spark, sf_dir):
    """Boxes of every node of an eight-level median tree."""
    return kdtree.merge_boxes(kdtree.kd_boxes(kdtree.kd_nodes(orders_particles(spark, sf_dir), KD_LEVELS)))


def _kd_sql() -> str:
    ctes, last = [ORDERS_PARTICLES_SQL, "k0 AS (SELECT *, 1 AS node FROM pts)"], "k0"
    for level in range(KD_LEVELS):
        a, new = "xyz"[level % 3], f"k{level + 1}"
        ctes.append(f"m{level} AS (SELECT node, quantile_disc({a}, 0.5) AS m FROM {last} GROUP BY node)")
        ctes.append(f"{new} AS (SELECT pid, x, y, z, node * 2 + CASE WHEN {a} > m THEN 1 ELSE 0 END AS node "
                    f"FROM {last} JOIN m{level} USING (node))")
        last = new
    return f"""WITH {', '.join(ctes)}
SELECT node // CAST(pow(2, k) AS BIGINT) AS node, count(*) AS n, min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z,
  max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z FROM {last}, unnest(range({KD_LEVELS + 1})) AS t(k) GROUP BY 1"""


def kd_blocks(spark, sf_dir):
    """The topmost nodes that fit a block."""
    boxes = kdtree.merge_boxes(kdtree.kd_boxes(kdtree.kd_nodes(orders_particles(spark, sf_dir), KD_LEVELS)))
    return kdtree.blocks_below(boxes, (400.0, 1e6, 2000.0)).select("node", "n")


KD_BLOCKS_SQL = f"""WITH b AS ({_kd_sql()}), g AS (SELECT * FROM b WHERE hi_x - lo_x < 400 AND hi_y - lo_y < 1e6 AND hi_z - lo_z < 2000)
SELECT node, n FROM g WHERE node // 2 NOT IN (SELECT node FROM g)"""


QUERIES = {
    "kd_boxes": (kd_boxes, _kd_sql()),
    "kd_blocks": (kd_blocks, KD_BLOCKS_SQL),
    "bounding_box": (bounding_box, BOX_SQL),
    "particle_blocks": (particle_blocks, BLOCKS_SQL),
    "particle_deltas": (particle_deltas, DELTAS_SQL),
    "particle_octants": (particle_octants, OCTANTS_SQL),
    "particle_inverse": (particle_inverse, INVERSE_SQL),
    "particle_repair": (particle_repair, _repair_sql()),
    "particle_order": (particle_order, ORDER_SQL),
    "particle_verify": (particle_verify, _verify_sql()),
    "particle_stream_sizes": (stream_sizes, STREAM_SIZES_SQL),
    "blocksize_formula": (blocksize_formula, FORMULA_SQL),
    "blocksize_entropy": (blocksize_entropy, ENTROPY_SQL),
    "blocksize_trial": (blocksize_trial, _trial_sql()),
    "blocksize_best": (blocksize_best, BEST_SQL),
}
