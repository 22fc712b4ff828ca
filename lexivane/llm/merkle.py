"""Merkle manifest of a dataset: a root over all rows, and for every row the proof that it is in.

Rows are leaves, hashed field by field. The leaves of a source, in ascending id, are joined
in runs of ``ARITY`` until one node, the source's subroot, is left; subroots, in order of
their source, are joined likewise into the root.

Trees are evaluated by time-forward processing. Nodes are labelled so that a parent comes
after its children, a priority queue ordered by label delivers each node's digest to its
parent, and no node looks for its children. Then the same nodes are swept in reverse:
parents deliver to their children what a proof holds from there to the root, until it
arrives at the leaves. The queue is external in two parts: messages between blocks of
``ARITY ** block_levels`` leaves are rows that a Spark shuffle sorts by label (it spills), messages inside
a block are a heap in the task. A block is cut from its source by position, so a source that
holds most rows is as many blocks, and each round of blocks is one job: a source of n leaves
takes one round for every ``block_levels`` of its levels. All rounds are written; a lost executor costs a task.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``; rows of one source
and id are ordered by their leaf, so repeated rows are neighbours and have proofs of their own;
null ids come first, as do rows of the null source, which is a source like any other; a
source of one row has its leaf as subroot, a table of one source that subroot as root; an
empty table gives an empty result and no root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivane.llm.common import maybe_broadcast, staged

ARITY = 3
BLOCK_LEVELS = 6  # a block has 729 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows a task holds before it hands them on; bytes of a row of offsets.
OUT_ROWS = 1000
OFFSET_BYTES = 200

SUFFIX = "array<struct<left: string, right: string>>"
MESSAGE = f"suffix {SUFFIX}, subroot string, root string"


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """How often runs are joined until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


# --- leaves ----------------------------------------------------------------------


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row whose fields have these values."""
    return F.sha2(F.concat(*[field(values[name]) for name in FIELDS]), 256)


def leaves(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``tree, doc_id, leaf, tampered, uid``: a row per row of ``docs``.

    ``changed`` gives fields other values in the rows of ``where``: ``tampered`` is the
    leaf such a row would have, null elsewhere.
    """
    own = {name: F.col(name) for name in FIELDS}
    other = F.lit(None).cast("string") if where is None else F.when(where, leaf(own | (changed or {})))
    # Null before all sources, these by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(own).alias("digest"),
        other.alias("tampered"),
        F.monotonically_increasing_id().alias("uid"),
    )


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Written rows with their ``rank`` within their tree and the tree's ``total``.

    Rows are sorted over all partitions; places within a partition and counts of those
    before give the rank, so no tree is gathered in one task.
    """
    running = F.monotonically_increasing_id()
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = staged(spread.withColumns({"part": F.spark_partition_id(), "place": running.bitwiseAND((1 << 33) - 1)}), name)
    each = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select(
        "tree", "part", (before - F.col("first")).alias("start"), F.sum("held").over(tree).alias("total")
    )
    starts = staged(starts, f"{name}-starts")
    located = placed.join(maybe_broadcast(starts, starts.count(), OFFSET_BYTES), ["tree", "part"])
    return located.withColumn("rank", F.col("place") + F.col("start")).drop("part", "place", "start", "uid")


# --- sweeps inside a block ---------------------------------------------------------


def forward(digests: list[str], levels: int) -> tuple[str, list[tuple[tuple[int, int], list[str]]]]:
    """The digest a block of leaves comes to after ``levels``, and its inner nodes in the
    order of their labels, each with the digests its children delivered.

    A label is (last leaf below the node, level): children are before their parent, and the
    queue never holds more than the open runs of each level.
    """
    queue: list[tuple[int, int, int, str]] = []
    nodes, top = [], digests[0]

    def deliver(digest: str, level: int, place: int) -> None:
        last = min((place // ARITY + 1) * ARITY ** (level + 1), len(digests)) - 1
        heappush(queue, (last, level + 1, place, digest))

    for at, digest in enumerate(digests if levels else []):
        deliver(digest, 0, at)
        while queue and queue[0][0] <= at:
            label, place, children = queue[0][:2], queue[0][2], []
            while queue and queue[0][:2] == label:
                children.append(heappop(queue)[3])
            nodes.append((label, children))
            top = digest_of(*children)
            if label[1] < levels:
                deliver(top, label[1], place // ARITY)
    return top, nodes


def backward(digests: list[str], levels: int, suffix: tuple) -> Iterator[tuple]:
    """What completes the proof of each leaf of a block, from the last leaf to the first.

    ``suffix`` is that of the block: nested pairs ((left, right), what follows). Labels
    come in falling order; a node's message waits in the queue until its turn.
    """
    if not levels:
        yield suffix
        return
    queue = [((-len(digests) + 1, -levels), suffix)]
    for label, children in reversed(forward(digests, levels)[1]):
        key, own = heappop(queue)
        assert key == (-label[0], -label[1])
        # Runs are complete but for the last: children end at steps of their size.
        size = ARITY ** (label[1] - 1)
        first = label[0] // (size * ARITY) * ARITY
        for place in range(len(children) - 1, -1, -1):
            below = (("".join(children[:place]), "".join(children[place + 1 :])), own)
            if label[1] == 1:
                yield below
            else:
                last = min((first + place + 1) * size, len(digests)) - 1
                heappush(queue, ((-last, -(label[1] - 1)), below))


def levels_of(total: int, block_levels: int) -> int:
    """Levels of a block in a tree of ``total`` nodes: as many as all blocks have, unless it is alone."""
    return min(block_levels, height(total))


def listed(suffix: tuple) -> list[dict[str, str]]:
    out = []
    while suffix:
        (left, right), suffix = suffix
        out.append({"left": left, "right": right})
    return out


def nested(suffix: list[dict[str, str]]) -> tuple:
    out: tuple = ()
    for pair in reversed(suffix):
        out = ((pair["left"], pair["right"]), out)
    return out


def folded(digest: str, suffix: tuple) -> str:
    """The root that a leaf and its proof come to."""
    while suffix:
        (left, right), suffix = suffix
        digest = digest_of(left, digest, right)
    return digest


def proof_digest(suffix: tuple) -> str:
    parts = []
    while suffix:
        pair, suffix = suffix
        parts += pair
    return digest_of(*parts)


# --- rounds ------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block; they come sorted."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, block in groupby(rows, lambda r: (r["tree"], r["block"])):
        yield list(block)


def _handed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")


UP = "tree string, rank long, total long, digest string"
UP_ARROW = pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])


def _up(block_levels: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for block in _blocks(batches):
                total = block[0]["total"]
                top, _ = forward([r["digest"] for r in block], levels_of(total, block_levels))
                left = -(-total // ARITY**block_levels)
                yield {"tree": block[0]["tree"], "rank": block[0]["block"], "total": left, "digest": top}

        return _handed(rows(), UP_ARROW)

    return run


def in_blocks(nodes: DataFrame, block_levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {ARITY**block_levels}"))


def upward(nodes: DataFrame, block_levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of a forest: the nodes each round starts from, and ``tree, round, digest``
    of the trees' roots.
    """
    rounds, roots = [nodes], None
    while True:
        folded_once = _sorted_blocks(in_blocks(rounds[-1], block_levels).select("tree", "block", "rank", "total", "digest"))
        made = staged(folded_once.mapInArrow(_up(block_levels), UP), f"{name}-up")
        done = made.filter("total = 1").select("tree", F.lit(len(rounds) - 1).alias("round"), "digest")
        roots = done if roots is None else roots.unionByName(done)
        more = made.filter("total > 1")
        if more.isEmpty():
            return rounds, roots
        rounds.append(more)


def _down(finish: Callable[[dict, dict, tuple], dict], schema: pa.Schema, block_levels: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for block in _blocks(batches):
                # The message to the block has rank -1 and so arrives first.
                message, own = block[0], block[1:]
                digests = [r["digest"] for r in own]
                suffixes = backward(digests, levels_of(own[0]["total"], block_levels), nested(message["suffix"]))
                for row, suffix in zip(reversed(own), suffixes, strict=True):
                    yield finish(message, row, suffix)

        return _handed(rows(), schema)

    return run


PASSED = f"tree string, block long, {MESSAGE}"
PAIRS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
ENDS = [("subroot", pa.string()), ("root", pa.string())]
PASSED_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("suffix", PAIRS), *ENDS])


def _pass_on(message: dict, row: dict, suffix: tuple) -> dict:
    ends = {"subroot": message["subroot"], "root": message["root"]}
    return {"tree": row["tree"], "block": row["rank"], "suffix": listed(suffix), **ends}


def downward(
    rounds: list[DataFrame], to_roots: DataFrame, block_levels: int, finish: Callable, schema: pa.Schema, ddl: str, name: str
) -> DataFrame:
    """Messages from the roots of a forest (``tree, round, suffix, subroot, root``) to its leaves.

    ``finish`` makes the row of a leaf from the message its block got, its own row and the
    rest of its proof.
    """
    passed = None
    for number in reversed(range(len(rounds))):
        # A tree that was done in this round is one block.
        starting = to_roots.filter(F.col("round") == number).select("tree", F.lit(0).cast("long").alias("block"), "suffix", "subroot", "root")
        sent = starting if passed is None else starting.unionByName(passed)
        messages = sent.withColumn("rank", F.lit(-1).cast("long"))
        nodes = in_blocks(rounds[number], block_levels)
        both = _sorted_blocks(nodes.unionByName(messages, allowMissingColumns=True))
        if number == 0:
            return both.mapInArrow(_down(finish, schema, block_levels), ddl)
        passed = staged(both.mapInArrow(_down(_pass_on, PASSED_ARROW, block_levels), PASSED), f"{name}-down")


PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    f"verified boolean, proof {SUFFIX}"
)
PROOFS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("leaf", pa.string()),
        *ENDS,
        ("proof_sha256", pa.string()),
        ("folded_root", pa.string()),
        ("verified", pa.bool_()),
        ("proof", PAIRS),
    ]
)


def _checked(keep_proof: bool) -> Callable:
    def finish(message: dict, row: dict, suffix: tuple) -> dict:
        reached = folded(row["tampered"] or row["digest"], suffix)
        return {
            "doc_id": row["doc_id"],
            "leaf": row["digest"],
            "subroot": message["subroot"],
            "root": message["root"],
            "proof_sha256": proof_digest(suffix),
            "folded_root": reached,
            "verified": reached == message["root"],
            "proof": listed(suffix) if keep_proof else None,
        }

    return finish


def manifest(
    docs: DataFrame,
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
    keep_proof: bool = False,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """A row per row of ``docs``: its leaf, subroot and root, and its proof checked.

    ``folded_root`` is what the proof comes to from the leaf, or, in the rows of ``where``,
    from the leaf with the ``changed`` fields; ``verified`` tells whether that is the root.
    ``proof`` lists the siblings left and right of the path, level by level, with
    ``keep_proof``.
    """
    hashed = staged(leaves(docs, changed, where), "merkle-leaves")
    nodes = ranked(hashed, ["doc_id", "digest", "uid"], "merkle-ranked")
    rounds, subroots = upward(nodes, block_levels, "merkle")
    subroots = staged(subroots, "merkle-subroots")

    # Sources are the leaves of the top tree.
    own_tree = subroots.select(F.lit("top").alias("tree"), F.col("tree").alias("source"), "digest", "round", F.lit(0).alias("uid"))
    top, roots = upward(ranked(own_tree, ["source"], "merkle-top"), block_levels, "merkle-top")
    start = roots.withColumns({"suffix": F.array().cast(SUFFIX), "subroot": F.lit(None).cast("string"), "root": F.col("digest")})

    def to_source(message: dict, row: dict, suffix: tuple) -> dict:
        return {"tree": row["source"], "round": row["round"], "suffix": listed(suffix), "subroot": row["digest"], "root": message["root"]}

    schema = pa.schema([("tree", pa.string()), ("round", pa.int32()), ("suffix", PAIRS), *ENDS])
    to_roots = staged(downward(top, start, block_levels, to_source, schema, f"tree string, round int, {MESSAGE}", "merkle-top"), "merkle-sources")
    proofs = downward(rounds, to_roots, block_levels, _checked(keep_proof), PROOFS_ARROW, PROOFS, "merkle")
    return proofs if keep_proof else proofs.drop("proof")
