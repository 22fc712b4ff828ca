"""SQL counterparts of this package's queries, where SQL can express them."""

NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

HOST = (
    "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url),"
    " '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', ''), '')"
)

ADDRESS = (
    f"'//' || {HOST} || regexp_replace(regexp_extract(regexp_extract(url, '^([^?#]*)', 1),"
    " '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1), '/+$', '')"
)

SQL = {
    "op4_url_lists": f"""
        WITH c AS (
            SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched, {HOST} AS host, {ADDRESS} AS address FROM pages
        ), a AS (
            SELECT address, number, DATE '2024-01-01' + (number % 300)::INTEGER AS start
            FROM (SELECT address, ('0x' || substr(md5(address), 1, 7))::BIGINT AS number FROM (SELECT DISTINCT address FROM c) WHERE address IS NOT NULL)
        ), n AS (
            SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS number FROM (SELECT DISTINCT host FROM c) WHERE host IS NOT NULL
        ), s AS (
            SELECT host, number, DATE '2024-01-01' + (number % 300)::INTEGER AS start,
                   coalesce(nullif(regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1), ''), host) AS domain FROM n
        ), e AS (
            SELECT 'spam' AS list, host AS value, start AS dated, true AS added FROM s WHERE number % 2 = 0
            UNION ALL SELECT 'spam', host, start + 40, false FROM s WHERE number % 4 = 0
            UNION ALL SELECT 'spam', host, start + 90, true FROM s WHERE number % 8 = 0
            UNION ALL SELECT 'malware', domain, start + 10, true FROM s WHERE number % 5 = 0
            UNION ALL SELECT 'malware', domain, start + 70, false FROM s WHERE number % 10 = 0
            UNION ALL SELECT 'pages', address, start + 5, true FROM a WHERE number % 3 = 0
            UNION ALL SELECT 'pages', address, start + 65, false FROM a WHERE number % 6 = 0
        ), m AS (
            SELECT list, value, dated, bool_and(added) AS added FROM e GROUP BY ALL
        ), i AS (
            SELECT list, value, dated AS valid_from, added,
                   lead(dated) OVER (PARTITION BY list, value ORDER BY dated) AS valid_to FROM m
        ), hits AS (
            SELECT c.page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
            FROM c JOIN i ON (c.host = i.value OR ends_with(c.host, '.' || i.value) OR c.address = i.value)
                AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
            WHERE added GROUP BY c.page_id
        )
        SELECT page_id, url, strftime(fetched, '%Y-%m-%d') AS fetched, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked
        FROM c LEFT JOIN hits USING (page_id)
    """,
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {NORMAL} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
}
