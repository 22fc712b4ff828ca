"""URL filters against dated lists: what was listed when a page was fetched.

List entries carry a date and an action. Per list and value they become intervals
without overlap, from an ``add`` to the next entry of any kind. A capture is judged by
the intervals that hold its fetch time (from inclusive, to exclusive). A value is a
domain, which covers its subdomains, or an address without query and fragment.

Captures of one host and time are judged once: the as-of join runs over distinct keys
and times, of listed values only. It lays the moments of a list's value in one order with
the starts of its intervals and takes for each the last start before it, so its rows are
those of both sides and not their product. The verdicts are attached to the captures with
frequent keys broadcast (see ``exact.attach_groups``), so a host with a third of all
captures costs no more than others. Everything is a DataFrame expression.

Defined results: a null or empty address and a null fetch time match nothing; entries
with a null list, value or date or another action than add and remove are left out; of
an add and a remove of the same moment the remove counts; repeated captures are judged
each; empty tables give empty results, and an empty list blocks nothing. ``verdicts``
reads the named columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import staged
from lexivane.llm.exact import attach_groups


def host(url: Column) -> Column:
    """Lower-case host without user and port; null where there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(plain, r"\.+$", ""), F.lit(""))


def address(url: Column) -> Column:
    """The URL without query and fragment, host in lower case."""
    body = F.regexp_extract(url, r"^([^?#]*)", 1)
    rest = F.regexp_extract(body, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1)
    return F.concat(F.lit("//"), host(url), F.regexp_replace(rest, "/+$", ""))


def keys(url: Column) -> Column:
    """The values that cover a URL: its host, each parent domain, its address."""
    labels = F.split(host(url), r"\.")
    size = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(labels, i, size - i + 1), ".")
    )
    return F.when(host(url).isNotNull(), F.array_union(domains, F.array(address(url))))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, value, valid_from, valid_to`` of entries ``list, value, dated, action``.

    Entries of one moment collapse before the window, so a value has at most as many
    rows there as there are moments.
    """
    kept = entries.filter("list is not null and value is not null and dated is not null")
    added = F.min(F.col("action") == "add").alias("added")
    moments = kept.filter("action in ('add', 'remove')").groupBy("list", "value", "dated").agg(added)
    following = F.lead("dated").over(Window.partitionBy("list", "value").orderBy("dated"))
    return (
        moments.withColumn("valid_to", following)
        .filter("added")
        .select("list", "value", F.col("dated").alias("valid_from"), "valid_to")
    )


def active_at(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``asked`` (``value, fetched`` and others) with every ``list`` whose interval
    of the value holds the moment: an as-of join.
    """
    listed = spans.select("list", "value").distinct()
    moments = asked.join(listed, "value").withColumns({"at": F.col("fetched"), "asks": F.lit(1)})
    starts = spans.select("list", "value", F.col("valid_from").alias("at"), F.struct("valid_to").alias("span"), F.lit(0).alias("asks"))
    order = Window.partitionBy("list", "value").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    both = moments.unionByName(starts, allowMissingColumns=True)
    latest = both.withColumn("latest", F.last("span", ignorenulls=True).over(order)).filter("asks = 1")
    holds = F.col("latest").isNotNull() & (F.col("latest.valid_to").isNull() | (F.col("fetched") < F.col("latest.valid_to")))
    return latest.filter(holds).select(*asked.columns, "list")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched, lists, blocked``, one row per capture ``page_id, url, fetched``."""
    numbered = staged(
        captures.select("page_id", "url", "fetched", F.monotonically_increasing_id().alias("capture")), "url-captures"
    )
    wide = numbered.select("capture", "fetched", F.explode(keys(F.col("url"))).alias("value")).filter("fetched is not null")
    asked = wide.groupBy("value", "fetched").agg(F.count(F.lit(1)).alias("n"))
    found = active_at(asked, intervals(entries)).groupBy("value", "fetched").agg(F.first("n").alias("n"), F.collect_set("list").alias("found"))
    found = staged(found.select(F.struct("value", "fetched").alias("key"), "n", "found"), "url-found")
    rows = wide.select("capture", F.struct("value", "fetched").alias("key"))
    hits = attach_groups(rows, found, "key", numbered.count()).filter("found is not null")
    per_capture = hits.groupBy("capture").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("lists"))
    judged = numbered.join(per_capture, "capture", "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    return judged.select("page_id", "url", "fetched", lists.alias("lists"), (F.size(lists) > 0).alias("blocked"))
