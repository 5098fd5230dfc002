"""Queries of image operators: the 64 values of each embedding are an 8 x 8 image in [0, 1]."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import pixels as P
from platewise.operators import quality as Q
from platewise.operators.sampling import exploration_set
from platewise.plans.registry import query, table

#: Pixels in SQL, and the sum by which queries report an image.
PX = """WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  px AS (SELECT vec_id AS image_id, (i // 8)::INT AS r, (i % 8)::INT AS c, (x + 1) / 2 AS v FROM e)"""
SUM = "SELECT image_id, round(sum(v * (r * 8 + c + 1)), 6) AS total FROM {px} GROUP BY 1"
SUMS = "SELECT image_id, level, round(sum(v * (r * 8 + c + 1)), 6) AS total FROM {px} GROUP BY 1, 2"


def images(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("pixels"))


def pixels(spark, d):
    # Arrays are dealt out, one row for each image; its pixels then are where the windows need them.
    return P.explode_pixels(images(spark, d).repartition("image_id"), 8)


def summed(px, *by):
    return px.groupBy("image_id", *by).agg(F.round(F.sum(F.col("v") * (F.col("r") * 8 + F.col("c") + 1)), 6).alias("total"))


def pairs(spark, d):
    """Each image with a blunted copy of itself."""
    px = pixels(spark, d)
    return px.select("image_id", "r", "c", (F.floor(F.col("v") * 16) / 16).alias("x"), F.col("v").alias("y"))


PAIRS = PX + ", pairs AS (SELECT image_id, r, c, floor(v * 16) / 16 AS x, v AS y FROM px)"


@query("explode_pixels", f"{PX} {SUM.format(px='px')}")
def explode_pixels(spark, d):
    return summed(P.explode_pixels(P.collect_pixels(pixels(spark, d)), 8))


@query("bitdepth_normalize", """SELECT vec_id AS image_id, 'scale' AS strategy, bits AS bit_depth, warning, round(list_sum(v) / (pow(2, bits) - 1), 6) AS total FROM (
  SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 16 END::INT AS bits, CASE WHEN vec_id % 3 = 1 THEN 'below type' ELSE 'inferred' END AS warning,
    list_transform(embedding, lambda x: floor((x::DOUBLE + 1) / 2 * 200)) AS v FROM embeddings)""")  # fmt: skip
def bitdepth_normalize(spark, d):
    """Images of small values: their type or a given depth says the scale, not their largest pixel."""
    kind = F.when(F.col("image_id") % 3 == 0, "uint8").otherwise("uint16")
    raw = images(spark, d).withColumn("raw", F.transform("pixels", lambda v: F.floor(v * 200).cast("double")))
    n = raw.select("image_id", P.normalized(F.col("raw"), kind, F.when(F.col("image_id") % 3 == 1, 12)).alias("n"))
    return n.select("image_id", "n.strategy", "n.bit_depth", "n.warning", F.round(F.aggregate("n.pixels", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("bitdepth_denormalize", f"{PX} SELECT image_id, sum(round_even(least(greatest(v * 255, 0), 150), 0))::DOUBLE AS total FROM px GROUP BY 1")
def bitdepth_denormalize(spark, d):
    return pixels(spark, d).groupBy("image_id").agg(F.sum(P.denormalized(F.col("v"), F.lit(255.0), F.lit(150.0))).alias("total"))


_U = "((('0x' || substr(md5(concat_ws('|', 'n{k}', image_id, r, c)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


_NOISE = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)


@query("noise_sweep", f"""{PX} SELECT image_id, level, round(sum(v + level * sqrt(-2 * ln({_U.format(k='a')})) * cos(2 * pi() * {_U.format(k='b')})), 6) AS total
  FROM px, (SELECT unnest({list(_NOISE)})::DOUBLE AS level) GROUP BY 1, 2""")  # fmt: skip
def noise_sweep(spark, d):
    px = pixels(spark, d).withColumn("level", F.explode(F.array(*map(F.lit, _NOISE))))
    return P.gaussian_noise(px, F.col("level"), "n").groupBy("image_id", "level").agg(F.round(F.sum("v"), 6).alias("total"))


_SIGMA = "0.8::DOUBLE * sqrt(level)"


@query("blur_sweep", f"""{PX}, l AS (SELECT unnest(range(1, 7)) AS level), near AS (SELECT unnest(range(-6, 7)) AS k),
  w AS (SELECT level, k, exp(-(k * k) / (2 * pow({_SIGMA}, 2))) AS w FROM l, near WHERE abs(k) <= ceil(3 * {_SIGMA})),
  h AS (SELECT image_id, level, r, c + k AS c, sum(w * v) / sum(w) AS v FROM px, w WHERE c + k BETWEEN 0 AND 7 GROUP BY ALL),
  b AS (SELECT image_id, level, r + k AS r, c, sum(w * v) / sum(w) AS v FROM h JOIN w USING (level) WHERE r + k BETWEEN 0 AND 7 GROUP BY ALL) {SUMS.format(px='b')}""")  # fmt: skip
def blur_sweep(spark, d):
    return summed(P.blur_sweep(pixels(spark, d), {it: 0.8 * it**0.5 for it in range(1, 7)}), "level")


def _extreme_sql(f: str) -> str:
    """Six levels of a 3 x 3 filter; each pass sees one pixel further."""
    w = lambda h: f"RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING"
    across = ", ".join(f"{f}(v) OVER (PARTITION BY image_id, r ORDER BY c {w(h)}) AS v{h}" for h in range(1, 7))
    down = ", ".join(f"{f}(v{h}) OVER (PARTITION BY image_id, c ORDER BY r {w(h)}) AS v{h}" for h in range(1, 7))
    levels = " UNION ALL ".join(f"SELECT image_id, {h} AS level, r, c, v{h} AS v FROM b" for h in range(1, 7))
    return f"{PX}, h AS (SELECT image_id, r, c, {across} FROM px), b AS (SELECT image_id, r, c, {down} FROM h), s AS ({levels}) {SUMS.format(px='s')}"


@query("erode_sweep", _extreme_sql("min"))
def erode_sweep(spark, d):
    return summed(P.erode_sweep(pixels(spark, d), 2, list(range(1, 7))), "level")


@query("dilate_sweep", _extreme_sql("max"))
def dilate_sweep(spark, d):
    return summed(P.dilate_sweep(pixels(spark, d), 3, list(range(1, 7))), "level")


_GAMMA = (40, 60, 80, 125, 150, 200)


@query("gamma_sweep", f"{PX} SELECT image_id, g AS level, round(sum(pow(v, g / 100.0::DOUBLE)), 6) AS total FROM px, (SELECT unnest({list(_GAMMA)}) AS g) GROUP BY 1, 2")
def gamma_sweep(spark, d):
    px = P.gamma(pixels(spark, d).withColumn("level", F.explode(F.array(*map(F.lit, _GAMMA)))), F.col("level"))
    return px.groupBy("image_id", "level").agg(F.round(F.sum("v"), 6).alias("total"))


_LIMITS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)


def _source_sql(axis: str) -> str:
    u = lambda k: f"(1 + level * (2 * (('0x' || substr(md5(concat_ws('|', 'g{axis}', image_id, {k})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE - 1))"
    cells = "[" + ", ".join(u(k) for k in range(4)) + "]"
    cell = f"floor({axis} / 2.0)::INT"
    return f"least(greatest(floor((coalesce(list_sum(list_slice({cells}, 1, {cell})), 0) + ({axis} / 2.0::DOUBLE - {cell}) * {cells}[{cell} + 1]) / list_sum({cells}) * 8 + 0.5::DOUBLE), 0), 7)::INT"


@query("grid_distort_sweep", f"""{PX}, q AS (SELECT image_id, level, r, c, {_source_sql('r')} AS sr, {_source_sql('c')} AS sc FROM px, (SELECT unnest({list(_LIMITS)})::DOUBLE AS level)),
  b AS (SELECT q.image_id, q.level, q.r, q.c, px.v FROM q JOIN px ON q.image_id = px.image_id AND q.sr = px.r AND q.sc = px.c) {SUMS.format(px='b')}""")  # fmt: skip
def grid_distort_sweep(spark, d):
    levels = images(spark, d).withColumn("level", F.explode(F.array(*map(F.lit, _LIMITS))))
    warped = levels.withColumn("pixels", P.grid_distort(F.col("pixels"), F.col("image_id"), 8, 8, 4, F.col("level"), "g"))
    return summed(P.explode_pixels(warped, 8, keep=("level",)), "level")


@query("shift_sweep", f"{PX}, b AS (SELECT image_id, (r + 2) % 8 AS r, (c + 7) % 8 AS c, v FROM px) {SUM.format(px='b')}")
def shift_sweep(spark, d):
    return summed(P.shift(pixels(spark, d), 8, 8, 2, -1))


@query("crop_patches", f"{PX} SELECT image_id, count(*) AS n, round(sum(v * ((r - image_id % 8 + 2) * 4 + (c - 3))), 6) AS total FROM px WHERE image_id % 8 BETWEEN 2 AND 6 AND r BETWEEN image_id % 8 - 2 AND image_id % 8 + 1 AND c BETWEEN 3 AND 6 GROUP BY 1")
def crop_patches(spark, d):
    centres = images(spark, d).select("image_id", F.lit(0).alias("patch_idx"), (F.col("image_id") % 8).alias("cy"), F.lit(5).alias("cx"))
    patches = P.crop_patches(pixels(spark, d), centres, 4, 8, 8)
    return patches.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * (F.col("r") * 4 + F.col("c"))), 6).alias("total"))


@query("center_crop", f"{PX}, b AS (SELECT * FROM px WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5) {SUM.format(px='b')}")
def center_crop(spark, d):
    return summed(P.center_crop(pixels(spark, d), 8, 8, 4))


@query("metric_mae", f"{PAIRS} SELECT image_id, round(avg(abs(x - y)), 8) AS mae FROM pairs GROUP BY 1")
def metric_mae(spark, d):
    return Q.mae(pairs(spark, d)).withColumn("mae", F.round("mae", 8))


@query("metric_psnr", f"{PAIRS} SELECT image_id, round(-10 * log10(avg((x - y) * (x - y))), 6) AS psnr FROM pairs GROUP BY 1")
def metric_psnr(spark, d):
    return Q.psnr(pairs(spark, d)).withColumn("psnr", F.round("psnr", 6))


def _ssim_sql(size: int, source: str, fg: str = "1.0") -> str:
    h, cols = size // 2, ("n", "sx", "sy", "sxx", "syy", "sxy", "f")
    w = f"RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING"
    sums = ", ".join(f"sum({c}) OVER w AS {c}" for c in cols)
    return f"""m0 AS (SELECT image_id, r, c, 1.0::DOUBLE AS n, x AS sx, y AS sy, x * x AS sxx, y * y AS syy, x * y AS sxy, {fg}::DOUBLE AS f FROM {source}),
  m1 AS (SELECT image_id, r, c, {sums} FROM m0 WINDOW w AS (PARTITION BY image_id, r ORDER BY c {w})), m2 AS (SELECT image_id, r, c, {sums} FROM m1 WINDOW w AS (PARTITION BY image_id, c ORDER BY r {w})),
  m AS (SELECT image_id, f, (2 * sx / n * sy / n + 0.0001) * (2 * (sxy / n - sx / n * sy / n) + 0.0009) / ((sx / n * sx / n + sy / n * sy / n + 0.0001) * (sxx / n - sx / n * sx / n + syy / n - sy / n * sy / n + 0.0009)) AS ssim FROM m2)"""


#: Gaussian weights over all pairs of pixels at most five apart along each axis.
_GAUSS = """g AS (SELECT a.image_id, a.r, a.c, sum(w) AS w, sum(w * b.x) / sum(w) AS mx, sum(w * b.y) / sum(w) AS my, sum(w * b.x * b.x) / sum(w) AS xx,
    sum(w * b.y * b.y) / sum(w) AS yy, sum(w * b.x * b.y) / sum(w) AS xy
    FROM (SELECT a.*, b.r AS br, b.c AS bc, exp(-((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) / 4.5::DOUBLE) AS w FROM pairs a
      JOIN (SELECT DISTINCT r, c FROM pairs) b ON abs(a.r - b.r) <= 5 AND abs(a.c - b.c) <= 5) a
    JOIN pairs b ON b.image_id = a.image_id AND b.r = a.br AND b.c = a.bc GROUP BY 1, 2, 3),
  gm AS (SELECT image_id, (2 * mx * my + 0.0001) * (2 * (xy - mx * my) + 0.0009) / ((mx * mx + my * my + 0.0001) * (xx - mx * mx + yy - my * my + 0.0009)) AS ssim FROM g)"""


@query("metric_ssim", f"""{PAIRS}, {_ssim_sql(7, 'pairs')}, {_GAUSS} SELECT image_id, round(avg(m.ssim), 6) AS ssim_uniform, min(gs.ssim) AS ssim FROM m
  JOIN (SELECT image_id, round(avg(ssim), 6) AS ssim FROM gm GROUP BY 1) gs USING (image_id) GROUP BY 1""")  # fmt: skip
def metric_ssim(spark, d):
    """With Gaussian weights (11, sigma 1.5), and with uniform ones."""
    both = Q.measured(pairs(spark, d), {"ssim": Q.gaussian_ssim_metric(), "ssim_uniform": Q.ssim_metric()})
    return both.select("image_id", F.round("ssim", 6).alias("ssim"), F.round("ssim_uniform", 6).alias("ssim_uniform"))


_OTSU = """h AS (SELECT image_id, least(floor(y * 64), 63)::INT AS b, count(*)::DOUBLE AS n FROM pairs GROUP BY 1, 2),
  o AS (SELECT *, sum(n) OVER u AS w0, sum(n * (b + 0.5::DOUBLE)) OVER u AS s0, sum(n) OVER a AS w, sum(n * (b + 0.5::DOUBLE)) OVER a AS s FROM h
    WINDOW u AS (PARTITION BY image_id ORDER BY b ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id)),
  t AS (SELECT image_id, (b + 1) / 64.0::DOUBLE AS threshold FROM o QUALIFY row_number() OVER (PARTITION BY image_id
    ORDER BY round(coalesce(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), -1), 6) DESC, b) = 1),
  masked AS (SELECT pairs.*, y >= threshold AS fg FROM pairs JOIN t USING (image_id))"""


@query("otsu_mask", f"{PAIRS}, {_OTSU} SELECT image_id, sum(fg::INT)::BIGINT AS foreground FROM masked GROUP BY 1")
def otsu_mask(spark, d):
    return Q.with_mask(pairs(spark, d)).groupBy("image_id").agg(F.sum(F.col("fg").cast("int")).alias("foreground"))


_FG_PSNR = "-10 * log10(greatest(sum(CASE WHEN fg THEN (x - y) * (x - y) ELSE 0 END) / greatest(sum(fg::INT), 1e-12::DOUBLE), 1e-12::DOUBLE))"


@query("metric_fg_psnr", f"{PAIRS}, {_OTSU} SELECT image_id, round({_FG_PSNR}, 6) AS fg_psnr FROM masked GROUP BY 1")
def metric_fg_psnr(spark, d):
    return Q.fg_psnr(pairs(spark, d)).withColumn("fg_psnr", F.round("fg_psnr", 6))


_FG_SSIM = "coalesce(avg(ssim) FILTER (f = 121), 0)"

#: Sixteen embeddings as one image of 32 x 32, its right half brighter, and a blunted copy.
MOSAICS = """WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  px AS (SELECT vec_id // 16 AS image_id, ((vec_id % 16) // 4 * 8 + i // 8)::INT AS r, (vec_id % 4 * 8 + i % 8)::INT AS c, 0.2 * (x + 1) + CASE WHEN vec_id % 4 > 1 THEN 0.6 ELSE 0 END AS v FROM e),
  pairs AS (SELECT image_id, r, c, floor(v * 16) / 16 AS x, v AS y FROM px)"""


def mosaics(spark, d):
    """The pixels of an array travel as they are; they are dealt to tiles once."""
    each = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    place = F.floor(F.col("vec_id") / 16).alias("image_id"), (F.floor(F.col("vec_id") % 16 / 4) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("r"), (F.col("vec_id") % 4 * 8 + F.col("i") % 8).cast("int").alias("c")
    px = each.select(*place, (0.2 * (F.col("e").cast("double") + 1) + F.when(F.col("vec_id") % 4 > 1, 0.6).otherwise(0.0)).alias("v"))
    return px.select("image_id", "r", "c", (F.floor(F.col("v") * 16) / 16).alias("x"), F.col("v").alias("y"))


@query("metric_fg_ssim", f"{MOSAICS}, {_OTSU}, {_ssim_sql(11, 'masked', 'fg')} SELECT image_id, round({_FG_SSIM}, 6) AS fg_ssim FROM m GROUP BY 1")
def metric_fg_ssim(spark, d):
    return Q.fg_ssim(mosaics(spark, d)).withColumn("fg_ssim", F.round("fg_ssim", 6))


def _named_ssim_sql(size: int, source: str, prefix: str, fg: str = "1.0") -> str:
    """The layers of a similarity map under names of their own."""
    sql = _ssim_sql(size, source, fg)
    for name in ("m0", "m1", "m2"):
        sql = sql.replace(f"{name} ", f"{prefix}{name} ").replace(f"FROM {name})", f"FROM {prefix}{name})")
    return sql.replace("  m AS (", f"  {prefix}m AS (")


@query("metric_table", f"""{MOSAICS}, {_OTSU}, {_GAUSS}, {_named_ssim_sql(11, 'masked', 'b', 'fg')}
  SELECT image_id, 'mae' AS metric_name, round(avg(abs(x - y)), 6) AS metric_value FROM pairs GROUP BY 1
  UNION ALL SELECT image_id, 'psnr', round(-10 * log10(avg((x - y) * (x - y))), 6) FROM pairs GROUP BY 1
  UNION ALL SELECT image_id, 'ssim', round(avg(ssim), 6) FROM gm GROUP BY 1
  UNION ALL SELECT image_id, 'fg_psnr', round({_FG_PSNR}, 6) FROM masked GROUP BY 1
  UNION ALL SELECT image_id, 'fg_ssim', round({_FG_SSIM}, 6) FROM bm GROUP BY 1""")  # fmt: skip
def metric_table(spark, d):
    return Q.metric_table(mosaics(spark, d)).withColumn("metric_value", F.round("metric_value", 6))


@query("replicate_channels", "SELECT vec_id AS image_id, 3::INT AS channels, round(3 * list_sum(list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2)), 6) AS total FROM embeddings")
def replicate_channels(spark, d):
    rows = images(spark, d).select("image_id", P.replicate_channels(F.array("pixels")).alias("channels"))
    total = F.aggregate(F.flatten("channels"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("image_id", F.size("channels").alias("channels"), F.round(total, 6).alias("total"))


@query("explore_random_set", """WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events WHERE event_type = 'click'),
  o AS (SELECT user_id FROM e WHERE k IS NOT NULL GROUP BY 1 ORDER BY md5('3|' || user_id), user_id LIMIT 1),
  l AS (SELECT user_id, k, min(value) AS low, max(value) AS high, row_number() OVER (ORDER BY k) - 1 AS pos FROM e JOIN o USING (user_id) WHERE k IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT max(pos) AS top FROM l)
  SELECT user_id, k, low, high FROM l, s WHERE top < 4 OR pos IN (0, round_even(top / 3.0::DOUBLE, 0), round_even(2 * top / 3.0::DOUBLE, 0), top)""")  # fmt: skip
def explore_random_set(spark, d):
    """One original, drawn by hash, with at most four of its levels, evenly spaced, and their gray limits."""
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return exploration_set(rows, {"event_type": "click"}, "user_id", "k", "value", 4, "3")
