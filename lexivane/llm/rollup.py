"""Token counts kept current by signed changes.

A change inserts a document's count (+1 document, +tokens), deletes it (-1, -tokens) or
revises it (0, new - old). A batch of changes becomes one small table of sums by source,
language and tokenizer version; totals are the sum of all committed batches. A batch is
committed under its id once: it counts when its folder is complete, a repeated commit
changes nothing, and a broken one is written anew. ``fold`` adds up committed batches
into a base that names them, so totals stay quick to read however many batches there were.

Sums are built in each task before the shuffle, so a source with a third of all
documents sends one row a task.

Defined results: null source, language and version are groups of their own; a null
count is 0; changes of an unknown kind raise; a batch without changes is committed and
changes nothing; without batches the totals are empty; groups whose documents have all
been deleted stay with zeros. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm.pieces import joined_batches, piece_encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


def bpe_counts(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in joined_batches(batches, 3):
            numbers = [len(ids) for ids in encoder.encode([t or "" for t in batch.column(3).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(numbers, pa.int64())], names=["doc_id", "source", "lang", "tokens"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.withColumn("tokenizer", F.lit(tokenizer))


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The same with words between white space as tokens, without leaving the JVM."""
    split = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")
    return docs.select("doc_id", "source", "lang", F.size(split).cast("long").alias("tokens"), F.lit(tokenizer).alias("tokenizer"))


def changes(counts: DataFrame, kind: str, before: str = "0L") -> DataFrame:
    """Changes of one kind; ``before`` is the expression of the count to be revised."""
    return counts.select(*KEYS, F.lit(kind).alias("kind"), "tokens", F.expr(before).alias("before"))


class CountRollup:
    """Totals below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [s.getPath().getName() for s in system.listStatus(hadoop)] if system.exists(hadoop) else []

    def _complete(self, path: str) -> bool:
        return "_SUCCESS" in self._files(path)

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        names = self._files(f"{self.folder}/batches")
        return sorted(n for n in names if self._complete(f"{self.folder}/batches/{n}"))

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Adds a batch of ``changes`` rows; False if this id was committed before."""
        path = f"{self.folder}/batches/{batch_id}"
        if self._complete(path):
            return False
        tokens, before = F.coalesce("tokens", F.lit(0)), F.coalesce("before", F.lit(0))
        kind, wrong = F.col("kind"), F.raise_error(F.lit("unknown kind of change"))
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong.cast("int"))
        signed = F.when(kind == "insert", tokens).when(kind == "delete", -tokens).otherwise(tokens - before)
        sums = batch.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(signed).cast("long").alias("tokens"))
        sums.write.mode("overwrite").parquet(path)
        return True

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest complete base and the batches it holds."""
        names = sorted(n for n in self._files(f"{self.folder}/bases") if self._complete(f"{self.folder}/bases/{n}/totals"))
        if not names:
            return None, set()
        path = f"{self.folder}/bases/{names[-1]}"
        held = self.spark.read.schema("id string").parquet(f"{path}/batches").collect()
        return f"{path}/totals", {r.id for r in held}

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches."""
        base, held = self._base()
        paths = [base] if base else []
        paths += [f"{self.folder}/batches/{n}" for n in self.committed() if n not in held]
        if not paths:
            return self.spark.createDataFrame([], SUMS)
        sums = self.spark.read.schema(SUMS).parquet(*paths).groupBy(*KEYS)
        return sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def fold(self) -> None:
        """Writes a base of all batches committed so far; its totals come last and make it count."""
        ids = self.committed()
        path = f"{self.folder}/bases/{len(ids):012d}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([(i,) for i in ids], "id string").write.parquet(f"{path}/batches")
        base, held = self._base()
        own = [f"{self.folder}/batches/{n}" for n in ids if n not in held]
        paths = ([base] if base else []) + own
        if paths:
            sums = self.spark.read.schema(SUMS).parquet(*paths).groupBy(*KEYS)
            sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/totals")
