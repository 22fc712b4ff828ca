"""Connected components of a link table, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import discard, fits_broadcast, staged
from lexivane.llm.exact import GROUP_BYTES, attach_groups

# What a label takes that is broadcast three times a round.
LABEL_BYTES = 600


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``links`` (columns ``a, b``).

    Each round takes the smallest label among a node's neighbours and then the label
    of that label, so long chains shorten fast. Every round is written, so nothing
    is computed twice and a lost executor costs one round. Nodes with many links are
    joined by broadcast, see ``attach_groups``. Links to oneself and repeated links
    change nothing; an empty table gives an empty result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(both.filter("a <> b").distinct(), "links")
    total = edges.count()
    degrees = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"))
    labels = staged(degrees.select(F.col("a").alias("node"), "n", F.least("a", "least").alias("component")), "labels")
    held, small = labels, fits_broadcast(labels.count(), LABEL_BYTES)
    while total:
        far = labels.select(F.col("node").alias("b"), "n", F.col("component").alias("near"))
        met = edges.join(F.broadcast(far), "b") if small else attach_groups(edges, far, "b", total)
        least = met.groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        lower = least.join(F.broadcast(labels) if small else labels, "node").select(
            "node", F.col("n").alias("links"), "component", F.least("component", "near").alias("low")
        )
        if small:
            above = labels.select(F.col("node").alias("low"), "n", F.col("component").alias("next"))
            known = lower.join(F.broadcast(above), "low")
        else:
            # Read five times below: a plan that held it as often would take much of the driver's memory.
            lower = staged(lower, "lower")
            if lower.filter("low < component").isEmpty():
                discard(lower)
                break
            # A label may stand for a great share of all nodes; its own row is looked up.
            sizes = lower.groupBy("low").agg(F.count(F.lit(1)).alias("held"))
            jump = sizes.join(labels.select(F.col("node").alias("low"), F.col("component").alias("next")), "low").select(
                "low", "next", F.col("held").alias("n")
            )
            known = attach_groups(lower, jump, "low", total)
        jumped = known.select(
            "node",
            F.col("links").alias("n"),
            F.least("low", "next").alias("component"),
            F.col("component").alias("before"),
        )
        written = staged(jumped, "labels")
        discard(held, *([] if small else [lower]))
        held, labels = written, written.drop("before")
        if written.filter("component <> before").isEmpty():
            break
    discard(edges)
    return labels.select("node", "component")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (as ``components`` returns them) after further, written ``links``.

    Each component is one node here, its label, so a round costs what the new links are
    and not what all links are. Both tables may have nodes that the other has not.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ends = staged(
        ends.join(labels, "node", "left").select(
            "node", "n", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("new")
        ),
        "ends",
    )
    small, total = fits_broadcast(ends.count(), GROUP_BYTES), links.count()

    def named(rows: DataFrame, end: str) -> DataFrame:
        own = ends.select(F.col("node").alias(end), "n", F.col("component").alias(f"{end}_label"))
        return (rows.join(F.broadcast(own), end) if small else attach_groups(rows, own, end, total)).drop("n")

    moved = components(named(named(links.select("a", "b"), "a"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    moved = moved.select(F.col("node").alias("component"), F.col("component").alias("low"))
    known = labels.select("node", "component").unionByName(ends.filter("new").select("node", "component"))
    if fits_broadcast(moved.count(), GROUP_BYTES):
        relabelled = known.join(F.broadcast(moved), "component", "left")
    else:
        sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        relabelled = attach_groups(known, sizes.join(moved, "component"), "component", known.count())
    out = staged(relabelled.select("node", F.coalesce("low", "component").alias("component")), "labels")
    discard(ends)
    return out
