"""Recordings, conditions, stimulus tables and cohorts, over orders, line items, parts, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.jobs.grid_jobs import GRID
from tracemill.jobs.registry import query, r6, rounded, table
from tracemill.jobs.roi_jobs import SIDE, images, regions
from tracemill.jobs.stimulus_jobs import FAMILY, SETS, pulse_sets
from tracemill.operators import cohorts, recordings, roi, stimuli
from tracemill.operators.filters import low_pass, steady_state
from tracemill.sources import tables, tiff


@query(
    """SELECT p_partkey AS id, (5 + p_size % 25)::DOUBLE AS rate, (1 + p_partkey % 4)::DOUBLE AS zoom, CASE WHEN p_partkey % 2 = 0 THEN 256 ELSE 128 END::DOUBLE AS rows, 256::DOUBLE AS cols,
CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS channels, (100 + p_size)::DOUBLE AS n_frames FROM part"""
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recordings' headers say, of either dialect: every part writes a header, odd ones in the older form."""
    key, size = F.col("p_partkey"), F.col("p_size")
    values = {"rate": 5 + size % 25, "zoom": 1 + key % 4, "rows": F.when(key % 2 == 0, 256).otherwise(128), "cols": F.lit(256), "n_frames": 100 + size}
    saved = F.when(key % 3 == 0, F.lit("[1;2]")).otherwise(F.lit("[2]"))
    newer = F.concat_ws("\n", *[F.concat(F.lit(f"{tiff.NEWER[k]} = "), v.cast("string")) for k, v in values.items()], F.concat(F.lit("SI.hChannels.channelSave = "), saved))
    older = F.concat_ws("\r", *[F.concat(F.lit(f"{tiff.OLDER[k]}="), v.cast("string")) for k, v in values.items()], F.concat(F.lit("state.acq.numberOfChannelsSave="), F.when(key % 3 == 0, "2").otherwise("1")))
    rows = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 2 == 0, newer).alias("software"), F.when(key % 2 == 1, older).alias("description"))
    found = tiff.with_header_fields(rows, F.col("description"), F.col("software"))
    return found.select("id", "rate", "zoom", "rows", "cols", "channels", "n_frames")


@query(
    """WITH r AS (SELECT p_partkey AS id, p_size % 3 AS zoom, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'ZX' || (p_partkey % 2) END AS drug, p_partkey % 7 = 0 AS is_map, 128 + 128 * (p_partkey % 2) AS h FROM part),
m AS (SELECT zoom AS main FROM r GROUP BY 1 ORDER BY count(*) DESC, zoom LIMIT 1)
SELECT id, CASE WHEN drug = '' THEN 'none' WHEN id >= 50 THEN 'post' || drug ELSE 'pre' || drug END || CASE WHEN is_map THEN ' FRAmap' ELSE '' END AS label,
CASE WHEN drug = '' THEN 'none' WHEN id >= 50 THEN 'post' || drug ELSE 'pre' || drug END || '_' || h || 'x256' || CASE WHEN zoom = main THEN '' ELSE '_z' || zoom END AS name FROM r, m"""
)
def condition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and valid names of conditions by drug, phase, frame and zoom."""
    from tracemill.operators.relations import most_common

    key = F.col("p_partkey")
    drug = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("ZX"), key % 2))
    rows = table(spark, sf_dir, "part").select(key.alias("id"), (F.col("p_size") % 3).alias("zoom"), drug.alias("drug"), (key % 7 == 0).alias("is_map"), (128 + 128 * (key % 2)).alias("h"))
    main = most_common(rows, "zoom").select(F.col("zoom").alias("main"))
    label = lambda of_map: recordings.condition_label(F.col("id"), F.lit(50), F.col("drug"), of_map)
    name = recordings.condition_name(label(F.lit(False)), F.col("h"), F.lit(256), F.col("zoom"), F.col("main"))
    return rows.join(F.broadcast(main)).select("id", label(F.col("is_map")).alias("label"), name.alias("name"))


@query(
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN 2 ELSE 1 END AS zoom FROM part), m AS (SELECT zoom AS main FROM r GROUP BY 1 ORDER BY count(*) DESC, zoom LIMIT 1) SELECT id FROM r, m WHERE zoom = main"""
)
def main_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings at the most common zoom."""
    key = F.col("p_partkey")
    return recordings.kept_zooms(table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 40 == 0, 2).otherwise(1).alias("zoom")), "zoom").select("id")


TONE = "'25msDRC_5-52kHz_50-60dB_8s_stim_' || (4000 + 10 * l_linenumber) || 'Hz_' || (20 + l_linenumber) || 'dB_' || (100 + l_linenumber) || 'ms_at_1pt5s_' || l_linenumber"
BURST = "'BPN_5-' || (10 + l_linenumber) || 'kHz_x_' || (30 + l_linenumber) || 'dB_x_100msPulse_' || (500 + l_linenumber) || 'msTotal_1sOnset_' || l_linenumber"
QUIET = "'spont_' || (1000 + l_linenumber) || 'msTotal_' || l_linenumber"
CHANGE = "'25msDRC_5-52kHz_50-60dB_to_40-70dB_' || l_linenumber || 's_sEach_' || l_linenumber"


@query(
    f"""WITH s AS (SELECT o_custkey AS animal, o_orderkey AS tif, {SETS} AS pulseset, CASE WHEN o_orderkey % 2 = 0 THEN 'pre' ELSE 'post' END AS treatment FROM orders), f AS (SELECT *, {FAMILY} AS family FROM s),
c AS (SELECT animal, family, count(*) > 1 AS several FROM f GROUP BY ALL), heard AS (SELECT * FROM lineitem WHERE l_orderkey % 13 <> 0), n AS (SELECT l_orderkey AS tif, count(*) AS total FROM heard GROUP BY 1),
p AS (SELECT f.animal, f.tif, treatment, f.family, several AND f.family <> 'pupil' AS processed, coalesce(total, 0)::INT AS total_pulses, l_linenumber AS k, CASE f.family WHEN 'CGC' THEN {TONE} WHEN 'BPN' THEN {BURST} WHEN 'Spont' THEN {QUIET} WHEN 'dContrast' THEN {CHANGE} ELSE 'led_' || l_linenumber END AS raw, CASE WHEN l_linenumber IS NULL THEN '' ELSE f.family END AS told
FROM f JOIN c ON c.animal = f.animal AND c.family = f.family LEFT JOIN n ON n.tif = f.tif LEFT JOIN heard ON l_orderkey = f.tif)
SELECT animal, tif, treatment, family, processed, 0.5 * (tif % 3)::DOUBLE AS trig_delay, 1.0 + (tif % 4)::DOUBLE AS isi, total_pulses, CASE WHEN k IS NOT NULL THEN row_number() OVER (PARTITION BY tif ORDER BY k) END::INT AS pulse, raw AS raw_pulse,
CASE told WHEN 'CGC' THEN 4000 + 10 * k END::DOUBLE AS freq_hz, CASE told WHEN 'CGC' THEN 20 + k WHEN 'BPN' THEN 30 + k END::DOUBLE AS db, CASE told WHEN 'CGC' THEN 1.5 WHEN 'BPN' THEN 1 END::DOUBLE AS onset_s,
CASE told WHEN 'BPN' THEN 500 + k WHEN 'Spont' THEN 1000 + k END::DOUBLE AS stim_ms, CASE told WHEN 'BPN' THEN '5-' || (10 + k) WHEN 'CGC' THEN '5-52' WHEN 'dContrast' THEN '5-52' END AS band_khz, CASE told WHEN 'CGC' THEN 8 WHEN 'dContrast' THEN 2 * k END::DOUBLE AS total_s,
CASE told WHEN 'dContrast' THEN true END AS increase FROM p WHERE family IS NOT NULL"""
)
def stim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses of every recording with the parameters that its family's names tell; one in thirteen has none and keeps a row."""
    k = F.col("l_linenumber")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    names = {
        "CGC": text("25msDRC_5-52kHz_50-60dB_8s_stim_", 4000 + 10 * k, "Hz_", 20 + k, "dB_", 100 + k, "ms_at_1pt5s_", k),
        "BPN": text("BPN_5-", 10 + k, "kHz_x_", 30 + k, "dB_x_100msPulse_", 500 + k, "msTotal_1sOnset_", k),
        "Spont": text("spont_", 1000 + k, "msTotal_", k),
        "dContrast": text("25msDRC_5-52kHz_50-60dB_to_40-70dB_", k, "s_sEach_", k),
    }
    sets = pulse_sets(spark, sf_dir).withColumn("family", stimuli.stimnames.family(F.col("pulseset")))
    name = text("led_", k)
    for family, v in names.items():
        name = F.when(F.col("family") == family, v).otherwise(name)
    pulses = table(spark, sf_dir, "lineitem").where("l_orderkey % 13 <> 0").select(F.col("l_orderkey").alias("tif"), "l_linenumber").join(sets.select("tif", "family"), "tif")
    listed = pulses.groupBy("tif").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("name")))), lambda x: x["name"]).alias("pulses"))
    rows = sets.join(listed, "tif", "left").select("animal", "tif", F.when(F.col("tif") % 2 == 0, "pre").otherwise("post").alias("treatment"), F.col("pulseset").alias("pulse_set"), (F.col("tif") % 3 * 0.5).alias("trig_delay"), (F.col("tif") % 4 + 1.0).alias("isi"), "pulses")
    return stimuli.stimulus_table(rows).select("animal", "tif", "treatment", "family", "processed", "trig_delay", "isi", "total_pulses", "pulse", "raw_pulse", "freq_hz", "db", "onset_s", "stim_ms", "band_khz", "total_s", "increase")


SOURCE = {"rows": 8, "cols": 8, "zoom": 2.0, "fast": 1.0, "shift_x": 0.0, "shift_y": 0.0, "rotation": 0.0, "pitch_x": 0.5, "pitch_y": 0.5}


@query(
    """WITH pix AS (SELECT vec_id, (i - 1) // 8 + 1 AS r, (i - 1) % 8 + 1 AS c FROM embeddings, range(1, 65) t(i) WHERE embedding[i]::DOUBLE > 0.1), k AS (SELECT vec_id, (r + c + vec_id) % 8 AS roi, r, c FROM pix), b AS (SELECT vec_id, roi FROM k GROUP BY ALL HAVING min(r) > 2 AND max(r) <= 6 AND min(c) > 1 AND max(c) <= 7)
SELECT vec_id, roi, r - 2 AS "row", c - 1 AS col FROM k SEMI JOIN b USING (vec_id, roi) WHERE roi <> 7"""
)
def roi_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of full frames in the coordinates of a centred crop of both axes; deleted ones (7) left out, numbers kept."""
    rows = regions(spark, sf_dir).select("vec_id", ((F.col("row") + F.col("col") + F.col("vec_id")) % 8).alias("roi"), "row", "col").withColumn("deleted", F.col("roi") == 7)
    return roi.remapped(rows, ["vec_id", "roi"], SOURCE, SOURCE | {"rows": 4, "cols": 6})


@query(
    """WITH rec AS (SELECT label AS grp, vec_id AS tif, 1 + vec_id % 3 AS n FROM embeddings WHERE vec_id % 1 = 0), ranges AS (SELECT grp, tif, n, sum(n) OVER (PARTITION BY grp ORDER BY tif) AS last FROM rec),
st AS (SELECT label AS grp, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame, embedding AS px FROM embeddings), mask AS (SELECT label AS grp, i FROM (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) JOIN embeddings e USING (vec_id, label), range(1, 65) t(i) WHERE e.embedding[i]::DOUBLE > 0.1)
SELECT st.grp, r.tif, (st.frame - (r.last - r.n))::BIGINT AS frame, r.n AS n_frames, round(avg(px[i]::DOUBLE) FILTER (st.grp <> 9), 6) + 0.0 AS f_px, round(avg(1 + px[i]::DOUBLE) FILTER (st.grp <> 9), 6) + 0.0 AS f_raw
FROM st JOIN ranges r ON r.grp = st.grp AND st.frame BETWEEN r.last - r.n + 1 AND r.last JOIN mask ON mask.grp = st.grp GROUP BY ALL""".replace(" WHERE vec_id % 1 = 0", "")
)
def trace_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked means of joined stacks, corrected and raw, frame by frame and by recording; the deleted region's are NULL."""
    from pyspark.sql import Window

    from tracemill.jobs.roi_jobs import pixels

    rows = images(spark, sf_dir).withColumnRenamed("label", "grp")
    own = F.row_number().over(Window.partitionBy("grp").orderBy("vec_id"))
    stack = rows.select("grp", own.alias("frame"), "px", F.transform("px", lambda v: v + 1).alias("raw"))
    recorded = rows.select("grp", F.col("vec_id").alias("tif"), (1 + F.col("vec_id") % 3).alias("n_frames"), F.lit(5.0).alias("rate"))
    masks = pixels(spark, sf_dir).withColumnRenamed("label", "grp").withColumn("deleted", F.col("grp") == 9).withColumn("roi", F.lit(1))
    found = recordings.extracted_traces(stack, recorded, masks, "grp", "tif", SIDE, ("px", "raw"))
    return rounded(found.select("grp", "tif", "frame", "n_frames", "f_px", "f_raw"), "f_px", "f_raw")


@query(
    """WITH e AS (SELECT vec_id AS tif, label AS grp, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS trial FROM embeddings)
SELECT a.tif, b.cell, b.frame, round(x.embedding[b.i]::DOUBLE - 0.8 * (x.embedding[b.i]::DOUBLE - x.embedding[65 - b.i]::DOUBLE), 6) + 0.0 AS f FROM e a JOIN embeddings x ON x.vec_id = a.tif, (SELECT 1 + (i - 1) // 4 AS cell, 1 + (i - 1) % 4 AS frame, i FROM range(1, 65) t(i)) b"""
)
def group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separated traces merged with raw ones by name through the manifest, sixteen cells of four frames; cell10 comes after cell9."""
    from pyspark.sql import Window

    rows = images(spark, sf_dir)
    numbered = rows.select(F.col("vec_id").alias("tif"), F.col("label").alias("group"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("trial"), "px")
    at = numbered.select("tif", "group", "trial", F.posexplode("px").alias("at", "v"), "px")
    cell, frame = F.floor(F.col("at") / 4), F.col("at") % 4 + 1
    raw = at.select("tif", (cell + 1).alias("cell"), frame.cast("long").alias("frame"), F.col("v").alias("raw"))
    separated = at.select("group", F.concat(F.lit("cell"), cell).alias("cell"), F.concat(F.lit("trial"), F.col("trial") - 1).alias("trial"), frame.cast("long").alias("frame"), F.element_at("px", (64 - F.col("at")).cast("int")).alias("sep"))
    return rounded(recordings.merged_groups(raw, numbered.select("tif", "group", "trial"), separated), "f")


@query("SELECT o_custkey AS grp, o_orderkey AS tif, o_orderstatus = 'F' AS is_map, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey)::INT AS trial FROM orders")
def trial_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of maps and of stimuli apart, each numbered anew."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("tif"), "o_orderstatus")
    return recordings.split_trials(rows, ["grp"], "tif", F.col("o_orderstatus") == "F").select("grp", "tif", "is_map", "trial")


@query("WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS source FROM part), p AS (SELECT name, source FROM a JOIN b ON contains(name, source) OR contains(source, name)) SELECT a.name, count(p.source) AS n, CASE WHEN count(p.source) = 1 THEN min(p.source) END AS source FROM a LEFT JOIN p USING (name) GROUP BY a.name")
def name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one source whose name is part of a condition's, or the other way round, without trying pairs."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("source"))
    return recordings.containing_matches(part.select("name"), part.select("source"), "name", "source")


@query(
    f"""WITH {GRID}, ax AS (SELECT cell, sig_pk AS v, dense_rank() OVER (PARTITION BY cell ORDER BY db) AS i, dense_rank() OVER (PARTITION BY cell ORDER BY freq) AS j FROM grid),
top AS (SELECT cell, i AS ti, j AS tj FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC NULLS LAST, j, i) AS k FROM ax WHERE v IS NOT NULL) WHERE k = 1), dp AS (SELECT a.cell, avg(v) FILTER (abs(i - ti) + abs(j - tj) <= 1) - avg(v) AS dprime FROM ax a LEFT JOIN top USING (cell) GROUP BY a.cell),
curve AS (SELECT cell, freq, avg(sig_pk) AS r FROM grid GROUP BY ALL), bf AS (SELECT cell, coalesce(arg_max(freq, r), min(freq)) AS bf FROM (SELECT * FROM curve ORDER BY cell, freq) GROUP BY cell),
r AS (SELECT s_nationkey::VARCHAR AS animal, s_suppkey::DOUBLE AS roi, s_acctbal AS f, bf FROM supplier JOIN dp ON dp.cell = s_suppkey JOIN bf ON bf.cell = s_suppkey WHERE dprime > 0)
SELECT animal, roi, f, bf::INT AS bf, dense_rank() OVER (ORDER BY animal)::INT AS animal_no, dense_rank() OVER (PARTITION BY animal ORDER BY roi)::INT AS roi_no FROM r"""
)
def cohort_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animals' tables stacked and pruned, joined to the tuning of selective cells, and numbered."""
    from tracemill.jobs.grid_jobs import trials

    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("animal"), F.col("s_suppkey").alias("roi"), F.col("s_acctbal").alias("scaled"), F.col("s_acctbal").alias("rawFroi"), F.col("s_name").alias("tifName"))
    stacked = cohorts.compiled([s.where("animal < 10"), s.where("animal >= 10").select("tifName", "rawFroi", "scaled", "roi", "animal")])
    of = trials(spark, sf_dir).join(s.select(F.col("roi").alias("cell"), "animal"), "cell").withColumns({"animal": F.col("animal").cast("string"), "roi": F.col("cell").cast("double")})
    found = cohorts.cohort(stacked, cohorts.tuning(of, ["animal", "roi"]))
    return found.select("animal", "roi", "f", "bf", F.col("outer_no").alias("animal_no"), F.col("inner_no").alias("roi_no"))


@query("SELECT s_nationkey AS animal, count(DISTINCT l_suppkey) AS cells FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each animal has."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("roi")).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").alias("animal")), "roi")
    return cohorts.cells_by_animal(rows)


@query(
    """WITH r AS (SELECT l_orderkey AS image, count(*) AS n_roi, 1 + l_orderkey % 3 AS n_tifs FROM lineitem GROUP BY ALL), f AS (SELECT o_orderkey AS image, 1 + o_custkey % 3 AS found FROM orders), g AS (SELECT n_roi, row_number() OVER (ORDER BY n_roi DESC) AS run FROM (SELECT DISTINCT n_roi FROM r))
SELECT image, n_roi, CASE WHEN (SELECT count(*) FROM g) > 1 THEN 'g' || run END AS run, n_tifs IS DISTINCT FROM found AS warn FROM r JOIN g USING (n_roi) LEFT JOIN f USING (image)"""
)
def separation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images dealt to separation runs by their number of regions, largest first, with a mark where files are missing."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.count("*").alias("n_roi")).withColumn("n_tifs", 1 + F.col("image") % 3)
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), (1 + F.col("o_custkey") % 3).alias("found"))
    return recordings.filled_runs(rows, files, "image")


NUM, DEN = low_pass(2, 0.25)
STEADY = steady_state(NUM, DEN)


def recurrence(name: str, rows: str) -> str:
    """SQL of a filter of second order as its recurrence over rows(label, i, p, x), p from 0: the table ``name``(label, i, p, y, z1, z2)."""
    y = f"({float(NUM[0])!r}::DOUBLE * x + z1)"
    step = f"{y}, {float(NUM[1])!r}::DOUBLE * x - {float(DEN[1])!r}::DOUBLE * {y} + z2, {float(NUM[2])!r}::DOUBLE * x - {float(DEN[2])!r}::DOUBLE * {y}"
    start = f"SELECT label, i, p, x, {float(STEADY[0])!r}::DOUBLE * x AS z1, {float(STEADY[1])!r}::DOUBLE * x AS z2 FROM {rows} WHERE p = 0"
    return f"{name}(label, i, p, y, z1, z2) AS (SELECT label, i, p, {step} FROM ({start}) UNION ALL SELECT r.label, r.i, r.p, {step} FROM {name} l JOIN {rows} r ON r.label = l.label AND r.i = l.i AND r.p = l.p + 1)"


@query(
    f"""WITH RECURSIVE f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame, count(*) OVER (PARTITION BY label) AS n, embedding AS px FROM embeddings), l AS (SELECT label, frame, n, i, 2 + px[i]::DOUBLE AS v FROM f, range(1, 65) t(i)),
f0 AS (SELECT label, i, avg(v) AS f0 FROM l WHERE frame BETWEEN 1 AND 3 GROUP BY ALL),
d AS (SELECT label, i, frame, n, least(6, n - 1) AS pad, (v - f0) / f0 AS x, first((v - f0) / f0) OVER w AS head, last((v - f0) / f0) OVER w AS tail FROM l JOIN f0 USING (label, i) WINDOW w AS (PARTITION BY label, i ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
long AS MATERIALIZED (SELECT label, i, n, pad, frame - 1 + pad AS p, x FROM d UNION ALL SELECT label, i, n, pad, pad - frame + 1, 2 * head - x FROM d WHERE frame BETWEEN 2 AND pad + 1 UNION ALL SELECT label, i, n, pad, n - 1 + pad + n - frame, 2 * tail - x FROM d WHERE n - frame BETWEEN 1 AND pad),
{recurrence("one", "long")},
back AS MATERIALIZED (SELECT one.label, one.i, n + 2 * pad - 1 - one.p AS p, y AS x FROM one JOIN long USING (label, i, p)),
{recurrence("two", "back")}
SELECT label, ((i - 1) // 8 + 1)::INT AS "row", ((i - 1) % 8 + 1)::INT AS col, round(avg(y), 6) + 0.0 AS change FROM two JOIN (SELECT DISTINCT label, n, pad FROM long) USING (label) WHERE n + 2 * pad - 1 - p - pad + 1 BETWEEN 4 AND 6 GROUP BY ALL"""
)
def change_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a movie changes: each pixel's dF/F, filtered both ways over time, after the stimulus."""
    from pyspark.sql import Window

    rows = images(spark, sf_dir).withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).withColumn("px", F.transform("px", lambda v: v + 2))
    return rounded(recordings.change_map(rows, ["label"], SIDE, (1, 3), (4, 6)), "change")


@query(
    """WITH t AS (SELECT label AS cell, vec_id AS tif, i AS frame, 1 + embedding[i]::DOUBLE AS f FROM embeddings, range(1, 65) t(i)), b AS (SELECT tif, avg(f) AS f0 FROM t WHERE frame BETWEEN 3 AND 5 GROUP BY 1), d AS (SELECT cell, frame - 2 AS frame, avg((f - f0) / f0) AS m FROM t JOIN b USING (tif) WHERE frame >= 3 GROUP BY ALL)
SELECT frame::INT AS frame, count(m) AS n, round(avg(m), 6) + 0.0 AS mean FROM d GROUP BY 1"""
)
def adhoc_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dF/F of single recordings, averaged over recordings and then over cells."""
    from tracemill.functions import arrays
    from tracemill.operators.traces import exploded

    rows = images(spark, sf_dir).select(F.col("label").alias("cell"), F.col("vec_id").alias("tif"), arrays.dff(F.transform("px", lambda v: v + 1), 3, 5).alias("dff"))
    found = recordings.mean_of_recordings(exploded(rows, ["cell", "tif"], "dff"), ["cell"], "tif", "f")
    return found.select("frame", "n", r6(F.col("mean")).alias("mean"))


@query("SELECT 'g' || n_regionkey AS matfile, count(*)::INT AS n_roi, string_agg(n_name, ',' ORDER BY n_name) AS tifs FROM nation GROUP BY ALL")
def manifest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's groups with their recordings in order."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey")).alias("grp"), F.col("n_name").alias("tif"))
    sizes = nations.groupBy("grp").agg(F.count("*").cast("int").alias("n_roi"))
    groups = tables.grouped_manifest(nations.join(sizes, "grp"), "grp", "n_roi", "tif")
    return tables.manifest_rows(groups).groupBy("matfile", "n_roi").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trial", "tif"))), lambda x: x["tif"]), ",").alias("tifs"))


@query(
    """SELECT n_name AS nation, count(*)::DOUBLE AS n, round(sum(c_acctbal), 4) + 0.0 AS total, round(max(c_acctbal) - min(c_acctbal), 4) + 0.0 AS spread, count(DISTINCT c_mktsegment)::INT AS segments, [1, count(*)]::INT[] AS shape, min(c_mktsegment) AS first FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"""
)
def container_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers saved as a container, of which some variables are loaded again."""
    import uuid

    from tracemill.jobs.registry import delete, shared_dir
    from tracemill.sources.containers import variables, write_containers

    folder = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a row a nation
    saved = rows.groupBy(F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(".mat")).alias("file"), F.col("n_name").alias("nation")).agg(F.struct(F.collect_list("c_acctbal").alias("balance"), F.count("*").cast("double").alias("n")).alias("params"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"), F.collect_list("c_custkey").alias("unused"))
    write_containers(saved, folder)
    found = variables(spark, folder, {"nation": ("nation", "string"), "n": ("params.n", "double"), "balance": ("params.balance", "array<double>"), "shape": ("params.balance", "array<int>"), "own": ("segments", "array<string>")})
    total = F.aggregate("balance", F.lit(0.0), lambda a, v: a + v)
    out = found.select("nation", "n", (F.round(total, 4) + 0.0).alias("total"), (F.round(F.array_max("balance") - F.array_min("balance"), 4) + 0.0).alias("spread"), F.size("own").alias("segments"), "shape", F.element_at("own", 1).alias("first"))
    out.write.parquet(f"{folder}-read")
    delete(spark, folder)
    return spark.read.parquet(f"{folder}-read")
