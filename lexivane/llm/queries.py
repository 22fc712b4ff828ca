"""The queries of this package, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lexivane.llm import (
    bpe,
    common,
    exact,
    jaccard,
    merkle,
    packing,
    quality,
    rollup,
    secret_scan,
    simhash,
    sketch,
    tokenfile,
    urllists,
    veccode,
)
from lexivane.session import work_dir

BPE_50K = "byte_bpe_50k.json"
BPE_MULTI = "byte_bpe_multi_50k.tiktoken"
END_ID = 2
SEQUENCE_TOKENS = 1024


def op1_quality(spark, folder):
    docs = common.table(spark, folder, "documents")
    model = quality.fit(docs, common.table(spark, folder, "labels"))
    scored = quality.score(docs, model)
    good = (F.col("score") >= model.settings.threshold).cast("int")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", good.alias("predicted"))


def op2_byte_bpe(spark, folder):
    docs = common.table(spark, folder, "documents")
    path = public_tokenizers.path(BPE_MULTI)
    coded = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, digests=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.lower(F.hex("ids")).alias("ids_sha256"),
        F.lower(F.hex("decoded")).alias("decoded_sha256"),
    )


def op3_token_files(spark, folder):
    docs = common.table(spark, folder, "documents")
    path = public_tokenizers.path(BPE_50K)
    manifest = tokenfile.write_token_files(docs, path, END_ID, work_dir(spark, "token-files"))
    return tokenfile.read_token_files(spark, manifest)


def list_entries(pages):
    """Dated entries from the pages themselves: hosts are listed, some taken off again, some
    return; some domains are listed with all below them (the last three labels of a host, or
    all it has), and some addresses."""
    def numbered(value):
        rows = pages.select(value.alias("value")).filter("value is not null").distinct()
        number = F.conv(F.substring(F.md5("value"), 1, 7), 16, 10).cast("long")
        start = F.date_add(F.lit("2024-01-01").cast("date"), (number % 300).cast("int"))
        return rows.withColumn("number", number).withColumn("start", start)

    hosts, addresses = numbered(urllists.host(F.col("url"))), numbered(urllists.address(F.col("url")))

    def entry(name, value, days, action, wanted, rows=hosts):
        listed = F.lit(name).alias("list"), F.expr(value).alias("value"), F.date_add("start", days).alias("dated")
        return rows.filter(wanted).select(*listed, F.lit(action).alias("action"))

    domain = r"coalesce(nullif(regexp_extract(value, '([^.]+\\.[^.]+\\.[^.]+)$', 1), ''), value)"
    parts = [
        entry("spam", "value", 0, "add", "number % 2 = 0"),
        entry("spam", "value", 40, "remove", "number % 4 = 0"),
        entry("spam", "value", 90, "add", "number % 8 = 0"),
        entry("malware", domain, 10, "add", "number % 5 = 0"),
        entry("malware", domain, 70, "remove", "number % 10 = 0"),
        entry("pages", "value", 5, "add", "number % 3 = 0", addresses),
        entry("pages", "value", 65, "remove", "number % 6 = 0", addresses),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def op4_url_lists(spark, folder):
    pages = common.table(spark, folder, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetched"))
    judged = urllists.verdicts(captures, common.staged(list_entries(pages), "url-entries"))
    return judged.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), F.array_join("lists", ",").alias("lists"), "blocked")


def op5_fingerprints(spark, folder):
    return sketch.edited_fingerprints(common.table(spark, folder, "documents"))


def op6_token_rollup(spark, folder):
    """Everything inserted, a seventh revised (an end id added), an eleventh deleted, the deletion sent twice."""
    docs = common.table(spark, folder, "documents")
    bpe_count = rollup.bpe_counts(docs, public_tokenizers.path(BPE_50K), "byte_bpe_50k")
    counts = common.staged(bpe_count.unionByName(rollup.word_counts(docs, "words")), "rollup-counts")
    totals = rollup.CountRollup(spark, work_dir(spark, "rollup"))
    totals.commit("load", rollup.changes(counts, "insert"))
    longer = counts.filter("tokenizer = 'byte_bpe_50k' and doc_id % 7 = 0").withColumn("tokens", F.col("tokens") + 1)
    totals.commit("revise", rollup.changes(longer, "revise", "tokens - 1"))
    ended = F.expr("tokens + if(tokenizer = 'byte_bpe_50k' and doc_id % 7 = 0, 1, 0)")
    gone = rollup.changes(counts.filter("doc_id % 11 = 0").withColumn("tokens", ended), "delete")
    totals.commit("delete", gone)
    totals.fold()
    totals.commit("delete", gone)
    return totals.totals()


def op7_best_two_fit(spark, folder):
    docs = common.table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path(BPE_50K), END_ID, SEQUENCE_TOKENS)


def op8_secret_scan(spark, folder):
    spans = secret_scan.secret_spans(common.table(spark, folder, "documents"))
    zipped = F.arrays_zip("kinds", "starts", "ends")
    base = [k.name for k in secret_scan.KINDS[: secret_scan.BASE_KINDS]]

    def number(kind):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")

    return spans.select(
        "doc_id",
        *map(number, base),
        F.sha2(listed(F.filter(zipped, lambda s: s["kinds"].isin(base))), 256).alias("base_sha256"),
        listed(zipped).alias("spans"),
    )


def op9_jaccard_join(spark, folder):
    return jaccard.similar_documents(common.table(spark, folder, "documents"))


def op10_exact_dedup(spark, folder):
    return exact.exact_duplicates(common.table(spark, folder, "documents"))


def op11_simhash(spark, folder):
    return simhash.similar_documents(common.table(spark, folder, "documents"))


def op12_merkle(spark, folder):
    """Proofs of all rows; every second document, by a hash of its id, is checked without its line ends."""
    docs = common.table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(docs, {"text": F.translate("text", "\n", "")}, tampered)


def op13_vector_codes(spark, folder):
    return veccode.vector_codes(common.table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_byte_bpe,
        op3_token_files,
        op4_url_lists,
        op5_fingerprints,
        op6_token_rollup,
        op7_best_two_fit,
        op8_secret_scan,
        op9_jaccard_join,
        op10_exact_dedup,
        op11_simhash,
        op12_merkle,
        op13_vector_codes,
    )
}
