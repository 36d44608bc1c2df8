"""Regions and frames: embeddings play 8 x 8 images; a region is where an image exceeds 0.1, a label's mask that of its first image."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.jobs.registry import query, r6, rounded, table
from tracemill.operators import roi

SIDE = 8
PIXELS = """first AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1), pix AS (SELECT f.label, (i - 1) // 8 + 1 AS "row", (i - 1) % 8 + 1 AS col, i FROM first f JOIN embeddings e USING (vec_id), range(1, 65) t(i) WHERE e.embedding[i]::DOUBLE > 0.1)"""
EVERY = """pix AS (SELECT vec_id, (i - 1) // 8 + 1 AS "row", (i - 1) % 8 + 1 AS col FROM embeddings, range(1, 65) t(i) WHERE embedding[i]::DOUBLE > 0.1)"""
OUTLINE = EVERY + """, edge AS (SELECT vec_id, min("row") AS "row", col FROM pix GROUP BY vec_id, col UNION SELECT vec_id, max("row"), col FROM pix GROUP BY vec_id, col UNION SELECT vec_id, "row", min(col) FROM pix GROUP BY vec_id, "row" UNION SELECT vec_id, "row", max(col) FROM pix GROUP BY vec_id, "row")"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("px"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min_by("px", "vec_id").alias("px"))
    on = first.select("label", F.posexplode("px").alias("at", "v")).where("v > 0.1")
    return on.select("label", (F.floor(F.col("at") / SIDE) + 1).alias("row"), (F.col("at") % SIDE + 1).cast("long").alias("col"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, row, col): the region of every image."""
    on = images(spark, sf_dir).select("vec_id", F.posexplode("px").alias("at", "v")).where("v > 0.1")
    return on.select("vec_id", (F.floor(F.col("at") / SIDE) + 1).alias("row"), (F.col("at") % SIDE + 1).cast("long").alias("col"))


@query(f'WITH {OUTLINE} SELECT vec_id, "row", col FROM edge')
def roi_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline points of every region."""
    return roi.outline(regions(spark, sf_dir), ["vec_id"])


@query(
    f"""WITH {OUTLINE}, c AS (SELECT vec_id, avg("row") AS r0, avg(col) AS c0 FROM edge GROUP BY 1), o AS (SELECT e.vec_id, "row" || ':' || col AS p, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(atan2(col - c0, "row" - r0), 9), "row", col) AS k FROM edge e JOIN c USING (vec_id))
SELECT vec_id, count(*) AS n, string_agg(p, ' ' ORDER BY k) || ' ' || min(p) FILTER (k = 1) AS ring FROM o GROUP BY vec_id"""
)
def roi_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as closed rings by angle."""
    return roi.on_curve(roi.outline(regions(spark, sf_dir), ["vec_id"]), ["vec_id"])


@query(f'WITH {EVERY}, k AS (SELECT vec_id, (vec_id + col) % 4 AS part, "row", col FROM pix), b AS (SELECT vec_id, part FROM k GROUP BY ALL HAVING min("row") >= 2 AND max("row") <= 7) SELECT vec_id, part, "row" - 1 AS "row", col FROM k SEMI JOIN b USING (vec_id, part)')
def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions wholly inside a centred crop (rows 2 to 7), in its coordinates."""
    rows = regions(spark, sf_dir).select("vec_id", ((F.col("vec_id") + F.col("col")) % 4).alias("part"), "row", "col")
    return roi.cropped(rows, ["vec_id", "part"], 2, 7)


@query(f"WITH {PIXELS} SELECT e.vec_id, e.label, round(avg(e.embedding[i]::DOUBLE) FILTER (p.label <> 9), 6) + 0.0 AS f FROM embeddings e JOIN pix p USING (label) GROUP BY ALL")
def mask_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every frame under its region's mask; the deleted region 9 keeps its rows with NULL."""
    masks = pixels(spark, sf_dir).withColumn("deleted", F.col("label") == 9)
    found = roi.masked_means(images(spark, sf_dir), masks, ["vec_id"], ["label"], SIDE)
    return rounded(found, "f")


@query('SELECT label, ((i - 1) // 8 + 1)::INT AS "row", ((i - 1) % 8 + 1)::INT AS col, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS f FROM embeddings, range(1, 65) t(i) GROUP BY ALL')
def mean_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean image of each stack."""
    return rounded(roi.mean_image(images(spark, sf_dir), ["label"], SIDE), "f")


@query("WITH p AS (SELECT vec_id, label, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), m AS (SELECT label, min(v) AS lo FROM p GROUP BY 1) SELECT vec_id, label, round(min(v - lo), 6) + 0.0 AS low, round(avg(v - lo), 6) + 0.0 AS mean FROM p JOIN m USING (label) GROUP BY ALL")
def min_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks lifted so that nothing is negative."""
    from tracemill.functions.arrays import strict_mean

    rows = roi.lifted(images(spark, sf_dir), ["label"])
    return rows.select("vec_id", "label", r6(F.array_min("px")).alias("low"), r6(strict_mean(F.col("px"))).alias("mean"))


@query("WITH p AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)) SELECT vec_id, label, round(avg(v), 6) + 0.0 AS f FROM p WHERE (i - 1) // 8 + 1 BETWEEN 3 AND 6 AND (i - 1) % 8 + 1 BETWEEN 2 AND 5 GROUP BY ALL")
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean inside a rectangle of each frame."""
    from tracemill.functions.arrays import strict_mean

    inside = F.filter("px", lambda v, i: roi.boxed(i, (3, 6), (2, 5), SIDE))
    return images(spark, sf_dir).select("vec_id", "label", r6(strict_mean(inside)).alias("f"))


@query("WITH p AS (SELECT label, vec_id, (i - 1) % 2 + 1 AS chan, (i - 1) // 2 + 1 AS frame, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)) SELECT label, chan::INT AS chan, count(*) AS n, max(frame)::INT AS frames, round(avg(v), 6) + 0.0 AS f FROM p GROUP BY ALL")
def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved channels of each stack taken apart."""
    from tracemill.sources.tiff import channel_of

    long = images(spark, sf_dir).select("label", F.posexplode("px").alias("at", "v"))
    chan, frame = channel_of(F.col("at") + 1, 2)
    split = long.select("label", chan.alias("chan"), frame.alias("frame"), "v")
    return split.groupBy("label", "chan").agg(F.count("*").alias("n"), F.max("frame").alias("frames"), r6(F.avg("v")).alias("f"))


@query(
    """WITH p AS (SELECT label, vec_id, (i - 1) // 8 + 1 AS r, (i - 1) % 8 + 1 AS c FROM embeddings, range(1, 65) t(i) WHERE embedding[i]::DOUBLE > 0.1 AND (vec_id % 4 = 0 OR (i - 1) // 8 + 1 BETWEEN 2 + vec_id % 4 AND 7 - vec_id % 4)),
b AS (SELECT label, vec_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM p GROUP BY ALL),
t AS (SELECT * FROM (VALUES ('low', 2, 0, 4, 8, true), ('mid', 1, 0, 6, 8, true), ('box', 1, 1, 6, 6, false)) t(name, up, lft, h, w, named))
SELECT label::INT AS label, name || '_' || CASE WHEN named THEN 'pre' ELSE 'x' END AS condition, 'pre' AS source, vec_id, (r - up)::INT AS "row", (c - lft)::INT AS col FROM p JOIN b USING (label, vec_id), t WHERE r0 > up AND r1 <= up + h AND c0 > lft AND c1 <= lft + w"""
)
def remap_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions drawn on each label's full field carried over to all its cropped conditions; another full field lies further off or has another pitch."""
    long = images(spark, sf_dir).select("label", "vec_id", F.posexplode("px").alias("at", "v"))
    row, odd = (F.floor(F.col("at") / SIDE) + 1).cast("int"), F.col("vec_id") % 4
    held = long.where((F.col("v") > 0.1) & ((odd == 0) | row.between(2 + odd, 7 - odd)))
    pixels = held.select("label", F.lit("pre").alias("condition"), "vec_id", row.alias("row"), (F.col("at") % SIDE + 1).cast("int").alias("col"), F.lit(False).alias("deleted"))
    fields = [("pre", True, 8, 8, 1.0), ("wide", True, 12, 8, 1.0), ("fine", True, 8, 8, 0.5), ("low_pre", False, 4, 8, 1.0), ("mid_pre", False, 6, 8, 1.0), ("box_x", False, 6, 6, 1.0)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(has).alias("has_rois"), F.lit(h).alias("rows"), F.lit(w).alias("cols"), F.lit(pitch).alias("pitch_x"), F.lit(pitch).alias("pitch_y")) for n, has, h, w, pitch in fields]))
    same = {"zoom": 1.0, "fast": 1.0, "shift_x": 0.0, "shift_y": 0.0, "rotation": 0.0}
    acquisitions = long.select("label").distinct().select("label", each.alias("x")).select("label", "x.*", *[F.lit(v).alias(k) for k, v in same.items()])
    return roi.remapped_everywhere(pixels, acquisitions, ["label"], "vec_id")


@query(
    """WITH f AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS image FROM embeddings),
p AS (SELECT label, image, i, floor(embedding[i]::DOUBLE * 1000)::BIGINT AS v FROM f, range(1, 65) t(i))
SELECT label::BIGINT AS label, image::INT AS image, 8 AS h, 8 AS w, sum(v)::BIGINT AS total, sum(v * i)::BIGINT AS moment, 'splitTif_channel_' || label AS note, max(image) OVER (PARTITION BY label)::INT AS images FROM p GROUP BY label, image"""
)
def stack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames streamed to a stack for each label and read again in ranges, with their files' headers and numbers of images."""
    from tracemill.jobs.registry import delete, shared_dir
    from tracemill.sources.stacks import stacks, write_stacks
    from tracemill.sources.tiff import split_note

    folder = f"{shared_dir(spark)}/stacks-{uuid.uuid4().hex}"
    shorts = images(spark, sf_dir).select("label", "vec_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.transform("px", lambda v: F.floor(v * 1000).cast("short")).alias("px"))
    write_stacks(shorts, folder, F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit(".tif")), "vec_id", split_note(F.col("label")))
    number = F.regexp_extract("path", r"label_(\d+)\.tif$", 1).cast("long").alias("label")
    sums = [F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.aggregate(F.transform("px", lambda v, i: v * (i + F.lit(1).cast("long"))), F.lit(0).cast("long"), lambda a, v: a + v).alias("moment")]
    read = stacks(spark, folder, split=1 << 16).select(number, "image", "h", "w", *sums)
    told = stacks(spark, folder, "headers").select(number, F.col("copyright").alias("note")).join(stacks(spark, folder, "counts").select(number, "images"), "label")
    read.join(told, "label").write.parquet(f"{folder}-read")
    delete(spark, folder)
    return spark.read.parquet(f"{folder}-read")


@query(
    """WITH v AS (SELECT label, vec_id, n, 4.5 + (2 + 2 * abs(embedding[n]::DOUBLE)) * cos(n * pi() / 4) AS x, 4.5 + (2 + 2 * abs(embedding[n]::DOUBLE)) * sin(n * pi() / 4) AS y FROM embeddings, range(1, 9) t(n)),
e AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
pix AS (SELECT e.label, e.vec_id, r, c FROM e, range(1, 9) a(r), range(1, 9) b(c) WHERE (y <= r) <> (y2 <= r) AND x + (r - y) * (x2 - x) / (y2 - y) < c GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT p.label, p.vec_id, count(*)::BIGINT AS n, round(avg(f.embedding[(r - 1) * 8 + c]::DOUBLE), 6) + 0.0 AS f FROM pix p JOIN embeddings f USING (vec_id) GROUP BY ALL"""
)
def polygon_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of images inside of a polygon each, filled row by row."""
    rows = images(spark, sf_dir)
    corner = F.explode(F.transform(F.slice("px", 1, SIDE), lambda v, i: F.struct((i + 1).alias("n"), (2 + 2 * F.abs(v)).alias("r"))))
    turned = rows.select("label", "vec_id", corner.alias("c")).select("label", "vec_id", "c.*")
    angle = F.col("n") * math.pi / 4
    spans = roi.filled(turned.select("label", "vec_id", "n", (4.5 + F.col("r") * F.cos(angle)).alias("x"), (4.5 + F.col("r") * F.sin(angle)).alias("y")), ["label", "vec_id"])
    sizes = spans.where("row BETWEEN 1 AND 8").groupBy("label", "vec_id").agg(F.sum(F.least("last", F.lit(SIDE)) - F.greatest("first", F.lit(1)) + 1).alias("n"))
    found = roi.interval_means(rows, spans, ["label", "vec_id"], ["label", "vec_id"], SIDE)
    return rounded(found.join(sizes, ["label", "vec_id"]), "f")
