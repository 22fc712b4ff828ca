"""Corpus files: papers as JSON or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexivane import schema
from lexivane.sources.generations import conform
from lexivane.sources.snapshot import POSITION, positioned


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def check_output(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Refuses an existing output; called before anything is read."""
    if not overwrite and path_exists(spark, path):
        raise FileExistsError(f"{path} exists; pass overwrite=True to replace it")


def read_papers(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Papers with their position. ``json``: one per line; ``json-array``: one
    array per file, read whole by one task, for small files; ``parquet``, of any generation
    (see ``generations``). JSON that does not fit the schema stops the job."""
    if form == "parquet":
        rows = positioned(spark.read.option("mergeSchema", True).parquet(path))
        return conform(rows, schema.PAPER_IN, path, POSITION)
    reader = spark.read.schema(schema.PAPER_IN).option("mode", "FAILFAST").option("multiLine", form == "json-array")
    return positioned(reader.json(path))


def write_papers(
    papers: DataFrame, path: str, form: str = "json", overwrite: bool = False, compression: str | None = None
) -> int:
    """Writes the papers and returns how many there were. ``compression`` is the codec of the
    files, by default that of their form; JSON then takes a third, but a file is read by one task."""
    check_output(papers.sparkSession, path, overwrite)
    written = Observation()
    (
        papers.select(*schema.PAPER_COLUMNS)
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite" if overwrite else "errorifexists")
        .format(form)
        .options(**({"compression": compression} if compression else {}))
        .save(path)
    )
    return written.get["rows"]
