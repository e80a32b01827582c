"""Queries over pictures and videos made from the tables, written as files and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges, framing, grid, sheets, signal, surface
from ..sources import blobs, readers
from .catalogue import query, table
from .further import shared

#: A vector as an 8 x 8 grey picture, 128 + floor(256 x) cut to a byte.
_PICTURE = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255, greatest(0, 128 + floor(256 * x::DOUBLE)))::BIGINT) AS v FROM embeddings)"


def drawn(spark, sf_dir):
    """vec_id, label, data: the bytes of each vector's picture."""
    level = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), 128 + F.floor(256 * x.cast("double"))))
    text = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(level(x)), 2, "0")), "")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.unhex(text).alias("data"))


@query(f"""
    WITH {_PICTURE}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM e),
    p AS (SELECT label, n // 12 AS page, n % 12 AS cell, v[i + 1] AS level, (n % 12) // 4 * 10 + 1 + i // 8 AS y, (n % 12) % 4 * 10 + 1 + i % 8 AS x FROM n, unnest(range(0, 64)) u(i))
    SELECT label, page::INTEGER AS page, count(DISTINCT cell)::BIGINT AS pictures, sum(level)::BIGINT + 255 * (1200 - count(*)) AS level, sum(level * (40 * y + x))::BIGINT + 255 * (719400 - sum(40 * y + x))::BIGINT AS placed FROM p GROUP BY ALL""")
def q127_review_sheets(spark, sf_dir):
    """Sheets of twelve pictures a page, written as PNG files and read back to their pixels."""
    rows = drawn(spark, sf_dir)
    image = F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.col("data"))
    made = sheets.sheets(rows.select("label", "vec_id", image.alias("image")), "label", "vec_id", ["image"], 4, 3, (10, 10), (8, 8), [(1, 1)])
    blobs.register(spark)
    path = shared(spark, "sheets")
    made.select("name", "content").write.format("blobs").mode("append").save(path)
    pages = readers.decoded(readers.files(spark, path)).select("name", "image")
    flat = readers.pixels(pages, "name").groupBy("name").agg(F.sum("r").alias("level"), F.sum(F.col("r").cast("long") * (40 * F.col("y") + F.col("x"))).alias("placed"))
    part = F.split(F.regexp_replace("name", r"\.png$", ""), "-")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    out = flat.select(part[0].cast("int").alias("label"), part[1].cast("int").alias("page"), "level", "placed").join(counts, "label")
    return out.select("label", "page", F.least(F.lit(12), F.col("n") - 12 * F.col("page")).alias("pictures"), "level", "placed")


@query(f"""
    WITH {_PICTURE}, n AS (SELECT *, label || '-' || vec_id // 1000 || '.y4m' AS video FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY vec_id) - 1 AS frame, count(*) OVER (PARTITION BY video) AS frames FROM n)
    SELECT video, frame, frame / 8.0::DOUBLE AS time, frames, list_sum(v)::BIGINT AS level, list_sum(list_transform(range(0, 64), lambda i: i * v[i + 1]))::BIGINT AS placed FROM f WHERE (frame + 1) % 3 = 0 AND frame + 1 > 6 AND frame + 1 <= 39""")
def q128_video_frames(spark, sf_dir):
    """Every third frame of a range of videos (8 frames a second, a thousand ids and a label each), written and read as files."""
    rows = drawn(spark, sf_dir).withColumn("video", F.concat(F.col("label").cast("string"), F.lit("-"), F.floor(F.col("vec_id") / 1000).cast("string"), F.lit(".y4m")))
    frames = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "data"))), lambda x: F.concat(F.hex(F.lit("FRAME\n")), F.hex(x["data"]))), "")  # a thousand at most
    content = rows.groupBy("video").agg(F.unhex(F.concat(F.hex(F.lit("YUV4MPEG2 W8 H8 F8:1 Ip A1:1 Cmono\n")), frames)).alias("content"))
    blobs.register(spark)
    path = shared(spark, "videos")
    content.select(F.col("video").alias("name"), "content").write.format("blobs").mode("append").save(path)
    read = spark.read.format("frames").option("framesPerPartition", 100).load(path).filter("frame >= 6 AND frame < 39")
    levels = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substring(F.col("image.data"), i, F.lit(1))), 16, 10).cast("long"))
    told = signal.sampled_frames(read, "frame", 3, 6, 39).select("video", "frame", "time", "frames", levels.alias("v"))
    add = lambda a, b: a + b
    zero = F.lit(0).cast("long")
    return told.select("video", "frame", "time", "frames", F.aggregate("v", zero, add).alias("level"), F.aggregate(F.transform("v", lambda x, i: x * i), zero, add).alias("placed"))


# ---------------------------------------------------------------- edges, thresholds, masks, the index of a curvature map

#: The same pictures as rows of pixels.
_PIXELS = f"{_PICTURE}, g AS (SELECT vec_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, v[i + 1] AS v FROM e, unnest(range(0, 64)) u(i))"


def dots(spark, sf_dir):
    level = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), 128 + F.floor(256 * x.cast("double"))))
    e = table(spark, sf_dir, "embeddings").withColumn("p", F.transform("embedding", level))
    return grid.from_array(e, "vec_id", "p", 8).withColumn("v", F.col("v").cast("long"))


@query(f"""
    WITH RECURSIVE {_PIXELS}, w AS (SELECT vec_id, y, x, v, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS q FROM g WINDOW r AS (PARTITION BY vec_id, y ORDER BY x)),
    s AS (SELECT vec_id, y, x, q - l AS d, l + 2 * v + q AS t FROM w),
    gr AS (SELECT vec_id, y, x, coalesce(lag(d) OVER c, d) + 2 * d + coalesce(lead(d) OVER c, d) AS gx, coalesce(lead(t) OVER c, t) - coalesce(lag(t) OVER c, t) AS gy FROM s WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)),
    m AS (SELECT *, abs(gx) + abs(gy) AS m FROM gr),
    n AS (SELECT m.*, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN 0 WHEN abs(gy) * 32768 > abs(gx) * (13573 + 65536) THEN 1 WHEN (gx < 0) <> (gy < 0) THEN 2 ELSE 3 END AS way FROM m),
    k AS (SELECT n.*, coalesce(a.m, 0) AS before, coalesce(b.m, 0) AS behind FROM n
        LEFT JOIN m a ON a.vec_id = n.vec_id AND a.y = n.y - CASE WHEN way = 0 THEN 0 ELSE 1 END AND a.x = n.x + CASE way WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END
        LEFT JOIN m b ON b.vec_id = n.vec_id AND b.y = n.y + CASE WHEN way = 0 THEN 0 ELSE 1 END AND b.x = n.x - CASE way WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END),
    h AS (SELECT vec_id, median(v) AS v FROM g GROUP BY vec_id),
    thin AS (SELECT k.vec_id, y, x, gx, gy, m > floor(least(255.0, 1.33::DOUBLE * h.v)) AS strong FROM k JOIN h USING (vec_id) WHERE m > before AND CASE WHEN way < 2 THEN m >= behind ELSE m > behind END AND m > floor(greatest(0.0, (1 - 0.33::DOUBLE) * h.v))),
    grown(vec_id, y, x) AS (SELECT vec_id, y, x FROM thin WHERE strong UNION SELECT t.vec_id, t.y, t.x FROM grown o JOIN thin t ON t.vec_id = o.vec_id AND abs(t.y - o.y) <= 1 AND abs(t.x - o.x) <= 1)
    SELECT vec_id, y, x, gx, gy FROM grown JOIN thin USING (vec_id, y, x)""")
def q129_canny(spark, sf_dir):
    return edges.canny(dots(spark, sf_dir), "vec_id").select("vec_id", "y", "x", "gx", "gy")


@query(f"""
    WITH {_PIXELS}, c AS (SELECT vec_id, v, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT vec_id, v, sum(n) OVER u AS c, sum(n * v) OVER u AS s, sum(n) OVER w AS ca, sum(n * v) OVER w AS sa FROM c WINDOW u AS (PARTITION BY vec_id ORDER BY v), w AS (PARTITION BY vec_id)),
    b AS (SELECT vec_id, v, (sa::DOUBLE * c - s::DOUBLE * ca) ** 2 / (c::DOUBLE * (ca - c)) AS b FROM s WHERE c < ca)
    SELECT vec_id, arg_min(v, {{'b': -b, 'v': v}})::INTEGER AS threshold FROM b GROUP BY vec_id""")
def q130_otsu(spark, sf_dir):
    return edges.otsu(dots(spark, sf_dir), "vec_id")


@query(f"""
    WITH {_PIXELS}, p AS (SELECT vec_id, y, x, v >= 120 AS s FROM g), n AS (SELECT p.vec_id, p.y, p.x, bool_or(q.s) AS wide, bool_and(q.s) AS thin FROM p JOIN p q ON q.vec_id = p.vec_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL)
    SELECT vec_id, count(*) FILTER (wide) AS dilated, sum(8 * y + x) FILTER (wide)::BIGINT AS dilated_at, count(*) FILTER (thin) AS eroded, coalesce(sum(8 * y + x) FILTER (thin), 0)::BIGINT AS eroded_at FROM n GROUP BY vec_id HAVING bool_or(wide)""")
def q131_morphology(spark, sf_dir):
    side, mask = F.lit(8), dots(spark, sf_dir).filter("v >= 120").select("vec_id", "y", "x")
    told = lambda df, n: df.groupBy("vec_id").agg(F.count("*").alias(n), F.sum(8 * F.col("y") + F.col("x")).cast("long").alias(f"{n}_at"))
    wide, thin = told(edges.dilated(mask, "vec_id", side, side), "dilated"), told(edges.eroded(mask, "vec_id", side, side), "eroded")
    return wide.join(thin, "vec_id", "left").select("vec_id", "dilated", "dilated_at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("eroded", "eroded_at")))


@query(f"""
    WITH {_PIXELS}, k AS (SELECT vec_id, y, x, v / 1000.0::DOUBLE AS k FROM g), o AS (SELECT vec_id, 3 + vec_id % 2 AS cx, 4 AS cy, 1 + vec_id % 3 AS r, 1 + vec_id % 5 AS ast FROM e),
    ring AS (SELECT m, a, (0.4 + m * 0.15) * cos(radians(a::DOUBLE)) AS x, (0.4 + m * 0.15) * sin(radians(a::DOUBLE)) AS y FROM unnest([0, 1, 2, 15]) t(m), range(0, 360) u(a)),
    p AS (SELECT o.vec_id, m, a, k FROM o, ring JOIN k ON k.vec_id = o.vec_id AND k.y = trunc(ring.y + o.cy) AND k.x = trunc(ring.x + o.cx)),
    s AS (SELECT vec_id, avg(k) FILTER (m < 3) AS c, arg_min(a, {{'k': -k, 'a': a, 'm': m}}) FILTER (m IN (2, 15) AND a BETWEEN 10 AND 170) AS lo, arg_min(a, {{'k': -k, 'a': a, 'm': m}}) FILTER (m IN (2, 15) AND a BETWEEN 190 AND 350) AS hi FROM p GROUP BY vec_id),
    h AS (SELECT o.vec_id, avg(k) FILTER (a < 180) AS s, avg(k) FILTER (a > 180) AS i FROM o, unnest([30, 60, 90, 120, 150, 210, 240, 270, 300, 300]) t(a) JOIN k ON k.vec_id = o.vec_id AND k.x = trunc(o.cx + o.r * cos(radians(a::DOUBLE))) AND k.y = trunc(o.cy + o.r * sin(radians(a::DOUBLE))) GROUP BY o.vec_id),
    f AS (SELECT vec_id, greatest(1.0, 337.5 * c - 47.2) AS central_k, greatest(180 - least(hi - lo, 360 - (hi - lo)), 1)::DOUBLE AS srax, greatest(1.0, 337.5 * abs(i - s)) AS i_s, ast FROM s JOIN h USING (vec_id) JOIN o USING (vec_id))
    SELECT vec_id, round(central_k, 8) AS central_k, srax, round(i_s, 6) AS i_s, round(central_k * i_s * ast * srax * 0.33, 1) AS kisa FROM f""")
def q132_kisa_of_map(spark, sf_dir):
    """Vectors as curvature maps, with rings of 0.4 + 0.15 m pixels about a centre that moves with the id."""
    i = F.col("vec_id")
    maps = dots(spark, sf_dir).withColumn("k", F.col("v") / 1000.0)
    eyes = table(spark, sf_dir, "embeddings").select(i, (3 + i % 2).alias("cx"), F.lit(4).alias("cy"), (1 + i % 3).alias("r_3"), (1 + i % 5).cast("double").alias("astigmatism"))
    turn, far = F.radians(F.col("angle").cast("double")), 0.4 + F.col("mire_num") * 0.15
    rings = eyes.select("vec_id", F.explode(F.array(*map(F.lit, (0, 1, 2, 15)))).alias("mire_num")).select("*", F.explode(F.sequence(F.lit(0), F.lit(359))).alias("angle")).withColumn("x", far * F.cos(turn)).withColumn("y", far * F.sin(turn))
    out = surface.kisa_of_map(maps, rings, eyes, "vec_id")
    return out.select("vec_id", F.round("central_k", 8).alias("central_k"), "srax", F.round("i_s", 6).alias("i_s"), F.round(F.col("central_k") * F.col("i_s") * (1 + i % 5) * F.col("srax") * 0.33, 1).alias("kisa"))


# ---------------------------------------------------------------- centring, windows of photos and frames, whole surfaces


@query(f"""
    WITH {_PIXELS}, w AS (SELECT vec_id, y, x, v, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS q FROM g WINDOW r AS (PARTITION BY vec_id, y ORDER BY x)),
    s AS (SELECT vec_id, y, x, q - l AS d, l + 2 * v + q AS t FROM w),
    gr AS (SELECT vec_id, y, x, coalesce(lag(d) OVER c, d) + 2 * d + coalesce(lead(d) OVER c, d) AS gx, coalesce(lead(t) OVER c, t) - coalesce(lag(t) OVER c, t) AS gy FROM s WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)),
    u AS (SELECT vec_id, y, x, gx / sqrt((gx * gx + gy * gy)::DOUBLE) AS ux, gy / sqrt((gx * gx + gy * gy)::DOUBLE) AS uy FROM gr WHERE gx <> 0 OR gy <> 0),
    p AS (SELECT vec_id, r, (round(x + way * r * ux) + dx)::INTEGER AS cx, (round(y + way * r * uy) + dy)::INTEGER AS cy FROM u, unnest([1, 2, 3, 4]) a(r), unnest([1, -1]) b(way), unnest([-1, 0, 1]) c(dx), unnest([-1, 0, 1]) d(dy)),
    n AS (SELECT vec_id, cx, cy, r, count(*) AS votes FROM p GROUP BY vec_id, cx, cy, r), h AS (SELECT *, votes / r::DOUBLE AS score FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, (r - 1) // 2 ORDER BY score DESC, cy, cx, r) AS rank FROM h),
    f AS (SELECT vec_id, avg(cx) AS cx, avg(cy) AS cy, count(*) AS circles FROM k WHERE rank = 1 AND score >= 10 GROUP BY vec_id),
    o AS (SELECT *, sqrt((cx - 3.5) * (cx - 3.5) + (cy - 3.5) * (cy - 3.5)) / (3.0 / (1 + vec_id % 3)::DOUBLE) AS away FROM f)
    SELECT vec_id, round(cx, 6) AS cx, round(cy, 6) AS cy, circles, round(away, 6) AS "offset", away <= 1 AS centred FROM o""")
def q133_centring_gate(spark, sf_dir):
    """The mean of the best circles of two bands of radii, and whether it is near the picture's middle."""
    found = framing.circle_centre(edges.gradient(dots(spark, sf_dir), "vec_id"), "vec_id", 1, 4, 2, 10.0)
    judged = framing.centred(found, "vec_id", (F.lit(3.5), F.lit(3.5)), 3.0, 1.0, (1 + F.col("vec_id") % 3).cast("double"))
    return judged.select("vec_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "offset")), "circles", "centred")


def framed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"))


def totals(df, side):
    place = F.col("v").cast("long") * (side * F.col("y") + F.col("x"))
    return df.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("level"), F.sum(place).alias("placed"))


@query(f"""
    WITH {_PIXELS}, small AS (SELECT vec_id, y // 2 + 1 AS y, x // 2 + 1 AS x, floor(sum(v) / 4.0::DOUBLE + 0.5)::BIGINT AS v FROM g GROUP BY vec_id, y // 2, x // 2),
    m AS (SELECT vec_id, y, x, CASE WHEN v >= 140 THEN 2 WHEN v >= 128 THEN 1 ELSE 0 END AS label FROM small), l AS (SELECT vec_id, min(label) FILTER (label > 0) AS first FROM m GROUP BY vec_id),
    d AS (SELECT vec_id, floor(avg(x - 1) FILTER (label = first)) + 1 AS cx, floor(avg(y - 1) FILTER (label = first)) + 1 AS cy FROM m JOIN l USING (vec_id) GROUP BY vec_id),
    c AS (SELECT vec_id, CASE WHEN vec_id % 3 < 2 THEN (vec_id % 5 + 2) // 2 + 1 ELSE cx END::INTEGER AS cx, CASE WHEN vec_id % 3 < 2 THEN (vec_id % 4 + 2) // 2 + 1 ELSE cy END::INTEGER AS cy FROM d)
    SELECT vec_id, cx, cy, count(*) AS n, sum(v)::BIGINT AS level, sum(v * (4 * (y - greatest(0, cy - 2)) + x - greatest(0, cx - 2)))::BIGINT AS placed
    FROM c JOIN small USING (vec_id) WHERE x >= cx - 2 AND x < cx + 2 AND y >= cy - 2 AND y < cy + 2 GROUP BY vec_id, cx, cy""")
def q134_photo_windows(spark, sf_dir):
    """Photos unzoomed, cut to a square of 6, then to 4 about a marked centre, or one found in a mask where there is no mark."""
    sizes, i = framed(spark, sf_dir), F.col("vec_id")
    outer = framing.photo_windows(dots(spark, sf_dir), sizes, "vec_id", 2, 6)
    about = sizes.select(i, F.lit(3).alias("cx"), F.lit(3).alias("cy"))
    mask = framing.window(outer, about, "vec_id", 4).select(i, "y", "x", F.when(F.col("v") >= 140, 2).when(F.col("v") >= 128, 1).otherwise(0).alias("label"))
    marks = sizes.filter(i % 3 < 2).select(i, ((i % 5 + 2) / 8.0).alias("fx"), ((i % 4 + 2) / 8.0).alias("fy"))
    centres = framing.photo_centres(sizes, "vec_id", 2, 6, 4, marks, mask)
    return centres.join(totals(framing.window(outer, centres, "vec_id", 4), 4), "vec_id").select("vec_id", "cx", "cy", "n", "level", "placed")


@query(f"""
    WITH {_PIXELS}, m AS (SELECT vec_id, y - 1 AS y, x - 1 AS x, CASE WHEN v >= 150 THEN 2 WHEN v >= 135 THEN 1 ELSE 0 END AS label FROM g WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6), l AS (SELECT vec_id, min(label) FILTER (label > 0) AS first FROM m GROUP BY vec_id),
    c AS (SELECT vec_id, (floor(avg(x) FILTER (label = first)) + 1)::INTEGER AS cx, (floor(avg(y) FILTER (label = first)) + 1)::INTEGER AS cy FROM m JOIN l USING (vec_id) GROUP BY vec_id),
    w AS (SELECT vec_id, cx, cy, v, x - greatest(0, cx - 2) AS x, y - greatest(0, cy - 2) AS y FROM c JOIN g USING (vec_id) WHERE x >= cx - 2 AND x < cx + 2 AND y >= cy - 2 AND y < cy + 2)
    SELECT vec_id, cx, cy, count(*) AS n, sum(v)::BIGINT AS level, sum(v * (4 * y + x))::BIGINT AS placed, sum(CASE WHEN v >= 125 THEN 0 ELSE 255 END)::BIGINT AS mire FROM w GROUP BY vec_id, cx, cy""")
def q135_frame_windows(spark, sf_dir):
    """Frames cut to a square of 4 about the centre that the mask of the square of 6 about their middle shows, and their masks."""
    sizes, whole = framed(spark, sf_dir), dots(spark, sf_dir)
    outer = framing.window(whole, framing.middles(sizes, "vec_id"), "vec_id", 6)
    mask = outer.select("vec_id", "y", "x", F.when(F.col("v") >= 150, 2).when(F.col("v") >= 135, 1).otherwise(0).alias("label"))
    inner, centres = framing.frame_window(whole, sizes, mask, "vec_id", 6, 4)
    told = framing.frame_mask(inner, inner.select("vec_id", "y", "x", (F.col("v") >= 125).cast("int").alias("label")), "vec_id")
    return centres.join(totals(inner, 4), "vec_id").join(told.groupBy("vec_id").agg(F.sum("mire").alias("mire")), "vec_id")


#: Six rings of a sphere of radius r (7.4 to 8.2 mm by the customer's id) 75 mm before the camera.
_SPHERES = "e AS (SELECT c_custkey, 7.4::DOUBLE + (c_custkey % 9) * 0.1::DOUBLE AS r FROM customer), q AS (SELECT c_custkey, r, m, 0.5::DOUBLE + m * 0.3::DOUBLE AS y FROM e, range(0, 6) t(m))"


@query(f"""
    WITH {_SPHERES} SELECT c_custkey, count(*) * 4 + 1 AS points, count(*) * 4 + 1 AS fitting, round(min(r), 1) AS radius, round(max(y), 2) AS norm, (floor(max(y / (r - sqrt(r * r - y * y) + 75.0)) * 2975.0::DOUBLE / 2) * 2)::INTEGER AS max_radius FROM q GROUP BY c_custkey""")
def q136_spheres(spark, sf_dir):
    """The spheres' radii out of the pixels of the rings they mirror."""
    r, y = F.col("r"), F.col("up")
    eyes = table(spark, sf_dir, "customer").select("c_custkey", (7.4 + F.col("c_custkey") % 9 * 0.1).alias("r"), F.lit(2000.0).alias("cx"), F.lit(1500.0).alias("cy"), F.lit(74.0).alias("distance"), F.lit(1.0).alias("gap"))
    rings = eyes.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("mire_num")).withColumn("up", 0.5 + F.col("mire_num") * 0.3)
    rings = rings.withColumn("z", r - F.sqrt(r * r - y * y)).withColumn("lean", y / F.sqrt(r * r - y * y)).withColumn("away", F.hypot(75.0 + F.col("z"), y))
    back = 2 * ((75.0 + F.col("z")) - y * F.col("lean")) / (1 + F.col("lean") ** 2) / F.col("away")  # the ray's part along the normal, twice
    out_z, out_y = -back + (75.0 + F.col("z")) / F.col("away"), back * F.col("lean") + y / F.col("away")
    rings = rings.withColumn("object_height", F.col("z") + 40 * out_z + 74.0).withColumn("object_radius", y + 40 * out_y)
    scale, turn = y / (75.0 + F.col("z")) * 2975.0, F.radians(F.col("angle").cast("double"))
    points = rings.select("*", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("angle")).select("c_custkey", "mire_num", "angle", (2000 + scale * F.cos(turn)).alias("x"), (1500 + scale * F.sin(turn)).alias("y"))
    found = surface.reconstructed(points, eyes.drop("r"), rings.select("c_custkey", "mire_num", "object_radius", "object_height"), "c_custkey", (6.4, 4.8), (4000, 3000), 4.76)
    wide = F.hypot("x", "y") * F.col("norm")
    fits = F.abs(r - F.sqrt(r * r - wide * wide) - F.col("z")) < 1e-3
    told = found.join(eyes.select("c_custkey", "r"), "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("points"), F.count_if(fits).alias("fitting"), F.round(F.avg("roc"), 1).alias("radius"), F.round(F.max("norm"), 2).alias("norm"), F.max("max_radius").alias("max_radius"))
    return told
