"""The stored corpus: one folder per version, and a pointer that names the live one.

A version is whole: papers as Parquet, bucketed by id, and next to them the banded
codes where there is an index. A write makes the folder of the next version by one join
of the live rows with the batch, which by their bucketing moves the batch only, and
then, as its last act, the pointer. A job that dies before that leaves the version before
in place, and readers of an older version keep their folder.

Every upsert writes the corpus once, so batches should be large; a table format with
row-level writes is the better choice where they cannot be.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane import schema
from lexivane.operators import ann
from lexivane.operators.embed import dimension_fault
from lexivane.operators.planning import keys_for_join
from lexivane.operators.search import bucket_of
from lexivane.operators.upsert import ADDRESS, CODEC, addressed, fetched, last_addresses, merge
from lexivane.options import Options
from lexivane.session import configure
from lexivane.sources.generations import conform


@dataclass(frozen=True)
class Pointer:
    """The state of a store; ``folder`` is the live version's, empty while there are no papers."""

    version: int = 0
    folder: str = ""
    buckets: int = 16
    dim: int = 384
    index: dict | None = None
    streams: dict[str, int] = field(default_factory=dict)
    rows: int = 0
    model: str = ""  # name of the embedder that wrote last
    missed: int = 0  # rows of the corpus when an index last missed its target


BUCKETED = T.StructType([*schema.PAPER.fields, T.StructField("bucket", T.IntegerType())])
# An exact search looks at one file in this many first, where there are as many.
SAMPLED_SHARE = 64
NOTHING = {"folder": "", "index": None, "rows": 0}


class PaperStore:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.options = options or Options()

    # --- pointer -------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> Pointer | None:
        """The newest state, or None where no store exists."""
        folder = self._path("pointers")
        if not self._files().exists(folder):
            return None
        names = [f.getPath().getName() for f in self._files().listStatus(folder)]
        for name in sorted((n for n in names if n.endswith(".json")), reverse=True):
            try:
                return Pointer(**json.loads(self._text(self._path("pointers", name))))
            except ValueError:  # its writer has not finished, so its version is not there yet
                continue
        return None

    def _text(self, path) -> str:
        source = self._files().open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _commit(self, state: Pointer) -> None:
        """Writes the next pointer. Two writers of one version: the second fails, as the
        file is created only where there is none."""
        target = self._path("pointers", f"{state.version:012d}.json")
        try:
            out = self._files().create(target, False)
        except Py4JJavaError as error:
            raise RuntimeError(
                f"version {state.version} of {self.root} was written by another job"
            ) from error
        out.write(bytearray(json.dumps(asdict(state)).encode()))
        out.close()

    def _next(self, state: Pointer, **changes) -> Pointer:
        return replace(state, **changes, version=state.version + 1)

    def remove(self, path: str) -> None:
        """Deletes a work folder below the store."""
        self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def _require(self) -> Pointer:
        state = self.pointer()
        if state is None:
            raise FileNotFoundError(f"no corpus at {self.root}")
        return state

    # --- tables --------------------------------------------------------------

    def exists(self) -> bool:
        return self.pointer() is not None

    def create(self, force: bool = False) -> None:
        """An empty store where none is; ``force`` empties an existing one, index too."""
        state = self.pointer()
        if state is None:
            self._commit(Pointer(buckets=self.options.buckets, dim=self.options.embedding_dim))
        elif force:
            self._commit(self._next(state, **NOTHING, dim=self.options.embedding_dim))

    def _papers_path(self, state: Pointer) -> str:
        return f"{self.root}/{state.folder}/papers"

    def papers(self, state: Pointer | None = None) -> DataFrame:
        """The live papers and the bucket of each; folders written before a column existed stay readable."""
        state = state or self._require()
        if not state.folder:
            return self.spark.createDataFrame([], BUCKETED)
        path = self._papers_path(state)
        return conform(self.spark.read.parquet(path), BUCKETED, path)

    def bucketed(self, state: Pointer) -> DataFrame:
        """The same rows as a bucketed table: joins on the id do not shuffle them."""
        if not state.folder:
            return self.papers(state)
        path = self._papers_path(state)
        name = f"lexivane_{hashlib.sha1(path.encode()).hexdigest()[:20]}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BUCKETED.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (bucket) "
                f"CLUSTERED BY (paper_id) INTO {state.buckets} BUCKETS LOCATION '{path}'"
            )
            self.spark.catalog.recoverPartitions(name)
        return self.spark.table(name)

    def codes(self, state: Pointer | None = None) -> DataFrame:
        """The banded codes of the index."""
        state = state or self._require()
        if not state.index:
            raise ValueError(f"{self.root} has no index")
        return self.spark.read.parquet(f"{self.root}/{state.index['folder']}")

    def tier(self, state: Pointer) -> ann.Tier:
        return ann.Tier(**{k: v for k, v in state.index.items() if k != "folder"})

    def index(self) -> ann.Tier | None:
        state = self.pointer()
        return self.tier(state) if state and state.index else None

    def sample(self, state: Pointer | None = None) -> DataFrame | None:
        """The papers of a few files of a store with many: a fixed, even part of the corpus."""
        papers = self.papers(state)
        files = sorted(papers.inputFiles())
        few = files[: len(files) // SAMPLED_SHARE]
        if not few:
            return None
        path = self._papers_path(state or self._require())
        return conform(self.spark.read.option("basePath", path).parquet(*few), BUCKETED, path)

    def count(self) -> int:
        """0 where no store exists."""
        state = self.pointer()
        return 0 if state is None else self.papers(state).count()

    # --- writes --------------------------------------------------------------

    def _new_folder(self, state: Pointer) -> str:
        return f"versions/{state.version + 1}-{uuid.uuid4().hex[:8]}"

    def _write_papers(self, rows: DataFrame, folder: str, buckets: int) -> None:
        name = f"lexivane_{uuid.uuid4().hex}"
        path = f"{self.root}/{folder}/papers"
        columns = BUCKETED.fieldNames()
        written = rows.select(*columns).write.partitionBy("bucket").bucketBy(buckets, "paper_id")
        # Named in the session only while it is written.
        written.sortBy("paper_id").option("path", path).option("compression", CODEC).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def upsert(
        self,
        batch: DataFrame,
        written_at,
        order: list[str],
        prepare: Callable[[DataFrame], DataFrame] | None = None,
        replace_all: bool = False,
        stream: tuple[str, int] | None = None,
        allow_empty: bool = False,
        model: str | None = None,
    ) -> dict:
        """Merges a batch of papers and reports what it did.

        Of several rows of one id the last in ``order`` counts; ``prepare`` then
        makes the remaining rows ready to store (it embeds them), as they are written: what
        it adds is neither staged nor dealt. The codes of an index
        follow in the same version. ``replace_all`` drops all stored papers and the index.
        ``stream`` names a source and its batch number: a batch already written
        is skipped. An empty batch is an error unless ``allow_empty``. ``model`` names
        the embedder, for the profile of the store.
        """
        self.create()
        state = self._require()
        if stream and state.streams.get(stream[0], -1) >= stream[1]:
            return {"skipped": True, "version": state.version}
        if replace_all:
            state = replace(state, **NOTHING)
        staging = f"staging/{uuid.uuid4().hex}"
        try:
            rows, ids = self._stage(batch, order, f"{self.root}/{staging}")
            return self._merge(rows, ids, written_at, state, stream, allow_empty, model, prepare)
        finally:
            self._files().delete(self._path(staging), True)

    def _stage(self, batch: DataFrame, order: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
        """The batch without its order, written once, and per id the address of its last row."""
        rows = addressed(batch, f"{folder}/rows")
        last_addresses(rows, order).write.option("compression", CODEC).parquet(f"{folder}/ids")
        return rows.drop(*order), self.spark.read.parquet(f"{folder}/ids")

    def _merge(self, rows: DataFrame, ids: DataFrame, written_at, state: Pointer, stream, allow_empty, model, prepare) -> dict:
        # All counts come from written files, so that repeated tasks cannot distort them.
        counts = ids.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
            F.count(F.lit(1)).alias("distinct_ids"),
            F.coalesce(F.sum(F.when(F.col("paper_id") == "unknown", F.col("copies"))), F.lit(0)).alias("unknown_ids"),
        ).first()
        report = {"rows_in": counts.rows_in, "distinct_ids": counts.distinct_ids, "without_vector": 0, "unknown_ids": counts.unknown_ids}
        number = counts.distinct_ids
        if not number:
            if not allow_empty:
                raise ValueError("empty batch")
            return {**report, "inserted": 0, "updated": 0, "skipped": True, "version": state.version}

        # A paper without a vector is stored, so that it replaces what it updates; it is not searchable.
        folder = self._new_folder(state)
        unique = fetched(rows, [], ids.select(ADDRESS), number).withColumn("bucket", bucket_of(F.col("paper_id"), state.buckets))
        kept, new = merge(self.bucketed(state), unique, written_at, number, ids)
        columns = BUCKETED.fieldNames()
        dealt = new.select(*[c for c in columns if c in new.columns]).repartition(state.buckets, "paper_id")
        dealt = (prepare(dealt) if prepare else dealt).select(*columns)
        after = kept.select(*columns).unionByName(dealt) if state.folder else dealt
        self._write_papers(after, folder, state.buckets)
        following = replace(state, folder=folder, model=model or state.model)
        written = self.papers(following)
        batch = written.join(keys_for_join(ids.select("paper_id"), number), "paper_id", "left_semi") if state.folder else written
        fault = dimension_fault(F.col("embedding"), state.dim)
        faults = batch.select(fault.alias("fault")).agg(
            F.count_if(F.col("fault") == "missing").alias("missing"), F.count_if(F.col("fault") != "missing").alias("unfit")
        ).first()
        if faults.unfit:
            self._files().delete(self._path(folder), True)
            raise ValueError(f"{faults.unfit} vectors do not have {state.dim} numbers, as the store's have")
        after = written.count()
        index = self._follow(batch, ids, number, state, folder) if state.index else None
        streams = state.streams | ({stream[0]: stream[1]} if stream else {})
        self._commit(self._next(following, rows=after, index=index, streams=streams))
        counts = {"inserted": after - state.rows, "updated": number - (after - state.rows)}
        return {**report, "without_vector": faults.missing, **counts, "skipped": False, "version": state.version + 1}

    def _follow(self, batch: DataFrame, ids: DataFrame, rows: int, state: Pointer, folder: str) -> dict:
        """The index after a batch: codes are computed for the batch's papers only."""
        tier, path = self.tier(state), f"{folder}/codes"
        old = self.codes(state).join(keys_for_join(ids.select("paper_id"), rows), "paper_id", "left_anti")
        fresh = ann.code_table(batch, tier.bits, state.dim, tier.bands)
        ann.write_index(old.unionByName(fresh), f"{self.root}/{path}")
        return {**state.index, "folder": path}

    def build_index(
        self,
        queries: DataFrame | None = None,
        skip: bool = False,
        rebuild: bool = False,
        own: bool = False,
        tier: ann.Tier | None = None,
    ) -> bool:
        """Writes the code table; True when the store has an index at the end.

        Nothing happens when there is one already, the store is empty, ``skip``
        is set or no tier fits the budget. The share a search aims at is
        calibrated with sample ``queries``, by default papers of the corpus (``own``
        says that given ones are, too); an index that misses its target however strict
        is not kept, and searches stay exact. It is tried again when the corpus
        has doubled, or with ``rebuild``. A ``tier`` given by the caller is taken as it is.
        """
        state = self.pointer()
        if state is None:
            return False
        if rebuild and state.index:
            self.drop_index()
            state = self._require()
        if state.index:
            return True
        if state.rows == 0 or skip or (state.rows < 2 * state.missed and not rebuild):
            return False
        chosen = ann.choose_tier(state.rows, self.options.index_budget_bytes)
        if tier is None and chosen is None:
            return False
        fixed, papers = tier, self.papers(state)
        tier = fixed or chosen.for_rows(state.rows)
        folder = f"{self._new_folder(state)}/codes"
        ann.write_index(ann.code_table(papers, tier.bits, state.dim, tier.bands), f"{self.root}/{folder}")
        if queries is None:
            queries, own = ann.sample_papers(self.sample(state) or papers, "embedding"), True
        codes = self.spark.read.parquet(f"{self.root}/{folder}")
        tier = fixed or ann.calibrated(codes, queries, tier, self.options, own)
        if tier is None:
            self._commit(self._next(state, missed=state.rows))
            self._files().delete(self._path(folder), True)
            return False
        self._commit(self._next(state, index={**asdict(tier), "folder": folder}, missed=0))
        return True

    def drop_index(self) -> None:
        state = self._require()
        if state.index:
            self._commit(self._next(state, index=None))
