"""Tables of a cohort: manifests, partitioned stage tables, and names of older files."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

FAMILIES = ("CGC", "BPN", "Spont", "dContrast", "FRA")
MANIFEST = "matfile string, nROI int, tifNames array<string>"
#: Columns of older stimulus tables and what they are called now.
RENAMED = {"onset": "onset_s", "dBAmpl": "db", "msPulseLen": "pulse_ms", "msStimLen": "stim_ms", "kHzFreqCutoff": "band_khz"}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(matfile, n_roi, trial, tif): groups of recordings, trials numbered from 1 as listed."""
    return manifest_rows(spark.read.schema(MANIFEST).option("multiLine", "true").json(path))


def manifest_rows(groups: DataFrame) -> DataFrame:
    names = groups.select("matfile", F.col("nROI").alias("n_roi"), F.posexplode("tifNames").alias("at", "tif"))
    return names.select("matfile", "n_roi", (F.col("at") + 1).alias("trial"), "tif")


def grouped_manifest(recordings: DataFrame, group: str, roi_count: str, name: str) -> DataFrame:
    """One row per group with its recordings' names in order, as a manifest holds them."""
    return recordings.groupBy(F.col(group).alias("matfile"), F.col(roi_count).alias("nROI")).agg(F.array_sort(F.collect_list(name)).alias("tifNames"))


def write_cohort(rows: DataFrame, path: str) -> None:
    """A stage table by animal and family; a family written again replaces its own partitions alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("animal", "family").parquet(path)


def read_cohort(spark: SparkSession, path: str, family: str, animals: list[str] | None = None) -> DataFrame:
    """One family's rows of all animals or some; other partitions are not read."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}; one of {', '.join(FAMILIES)}")
    rows = spark.read.parquet(path).where(F.col("family") == family)
    return rows.where(F.col("animal").isin(*animals)) if animals else rows


def cohort_notices(spark: SparkSession, path: str, family: str, animals: list[str]) -> DataFrame:
    """(animal, notice) of the wanted animals that a cohort does not have, or not of this family; those are what ``read_cohort`` passes over.

    Names that are not two letters and four digits are no animals. Partition names alone are read.
    """
    names = spark.createDataFrame([(x,) for x in dict.fromkeys(animals)], "animal string")
    there = spark.read.parquet(path).select(F.col("animal").cast("string"), "family").groupBy("animal").agg(F.bool_or(F.col("family") == family).alias("has"))
    notice = F.when(~F.col("animal").rlike("^[A-Z]{2}[0-9]{4}$"), "no animal's name").when(F.col("has").isNull(), "no folder").when(~F.col("has"), F.lit(f"no {family}"))
    return names.join(there, "animal", "left").select("animal", notice.alias("notice")).where("notice IS NOT NULL")


def columns_by_shape(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the columns that hold one value a row, and of those that hold lists."""
    lists = [f.name for f in rows.schema if isinstance(f.dataType, ArrayType)]
    return [c for c in rows.columns if c not in lists], lists


def renamed(rows: DataFrame) -> DataFrame:
    """Older column names brought up to date; a table that has the new ones is returned as it is."""
    return rows.withColumnsRenamed(RENAMED)


def without(rows: DataFrame, *parts: str) -> DataFrame:
    """Columns whose name contains one of ``parts`` left out."""
    return rows.select(*[c for c in rows.columns if not any(p in c for p in parts)])


def write_manifest(groups: DataFrame, path: str) -> None:
    """Groups as JSON lines that ``manifest`` reads back."""
    groups.write.mode("overwrite").json(path)


def roi_sets(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_tifs, tif_names, n_roi) of region files in JSON (nTifs, tifNames, roi: a list), one per file."""
    files = spark.read.schema("nTifs int, tifNames array<string>, roi array<string>").option("multiLine", "true").json(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("nTifs").alias("n_tifs"), F.col("tifNames").alias("tif_names"), F.size("roi").alias("n_roi"))


def created(spark: SparkSession, store: JavaObject, path: JavaObject) -> bool:
    """Create an empty file; False if it is there already. One of many callers gets True."""
    if store.getScheme() == "file":  # whose other way to create files looks first and creates then
        return spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        store.create(path, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def claimed_version(spark: SparkSession, path: str) -> int:
    """The next number of an output, which no other writer gets: a marker that the store creates only if it is not there yet.

    Two writers that come to the same number try to create one marker; the one that
    fails goes on with the next. A number whose rows were never written stays unused.
    """
    markers = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    store = markers.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(markers)
    taken = [int(x.getPath().getName()) for x in store.listStatus(markers) if x.getPath().getName().isdigit()]
    n = max(taken, default=0) + 1
    while not created(spark, store, spark._jvm.org.apache.hadoop.fs.Path(markers, str(n))):
        n += 1
    return n


def append_version(rows: DataFrame, path: str) -> int:
    """Rows written as the next version of an output, which is returned; earlier ones stay, and readers find it as the column version."""
    n = claimed_version(rows.sparkSession, path)
    rows.write.mode("errorifexists").parquet(f"{path}/version={n}")
    return n
