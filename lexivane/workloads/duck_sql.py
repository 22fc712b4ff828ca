"""For each registered query the same result as DuckDB SQL over the tables."""

from __future__ import annotations

from lexivane.functions import text as X
from lexivane.operators import ann as A
from lexivane.options import DEFAULT_CATEGORIES
from lexivane.plans.search import ENGINE
from lexivane.sources.snapshot import OUTCOMES
from lexivane.workloads.fixtures import DIM, VECTOR_DIM
from lexivane.workloads.spark_queries import CAP, CODE_BITS, RECALL_SHARES, TIER

WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}]"
WS_CODES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WS_SET = " || ".join(f"chr({c})" for c in WS_CODES)


# --- expressions -----------------------------------------------------------------


def strip(x):
    return f"trim({x}, {WS_SET})"


def collapse(x):
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def clean_title(x):
    return f"substring({collapse(f'coalesce({x}, {chr(39)}{chr(39)})')}, 1, {X.TITLE_CHARS})"


def clean_abstract(x):
    return collapse(f"coalesce({x}, '')")


def combined(title, abstract):
    return strip(f"{strip(title)} || chr(10) || chr(10) || {strip(abstract)}")


def noisy(x, key="doc_id"):
    strange = f"translate({x}, ',.', chr(160) || chr(28))"
    return f"CASE WHEN {key} % 3 = 0 THEN chr(8195) || {strange} || chr(133) ELSE {x} END"


def year4(x):
    return f"CASE WHEN length({x}) >= 4 THEN TRY_CAST(substring({x}, 1, 4) AS INTEGER) END"


def r6(x, name):
    return f"round({x}, 6) + 0.0 AS {name}"


def line1(x):
    return f"split_part({x}, chr(10), 1)"


LINE1 = line1("text")


# --- views -------------------------------------------------------------------------


PAPERS = f"""papers AS (
  SELECT 'doc-' || doc_id AS paper_id, {clean_title(LINE1)} AS title,
    {clean_abstract('text')} AS abstract,
    CASE WHEN doc_id % 7 <> 0 THEN source || '; ' || lang END AS authors,
    CAST(CASE WHEN doc_id % 11 <> 0 THEN 1991 + doc_id % 34 END AS INTEGER) AS year,
    source AS venue,
    CASE WHEN doc_id % 5 <> 0 THEN '10.1000/' || doc_id END AS doi,
    CASE WHEN doc_id % 13 <> 0 THEN 'cs.' || upper(lang) || ' ' || source END AS category
  FROM documents)"""

TURNS = f"""turns AS (
  SELECT 'conv-' || conv_id AS paper_id, {clean_title("role || ' ' || conv_id")} AS title,
    {clean_abstract('text')} AS abstract,
    CASE WHEN role <> 'user' THEN role END AS authors,
    CAST(2000 + turn AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS venue,
    CAST(NULL AS VARCHAR) AS doi, 'dialogue' AS category, turn
  FROM conversations)"""

LINES = """raw AS (
  SELECT doc_id, doc_id % 17 AS c, doc_id % 5 AS five, lang, source, text,
    CAST(doc_id AS VARCHAR) AS key, split_part(text, chr(10), 1) AS line1,
    (1991 + doc_id % 34) || '-05-01' AS dated
  FROM documents),
fields AS (
  SELECT *, json_object(
    'id', CASE c WHEN 6 THEN 'cs/' || key WHEN 7 THEN key || repeat('x', 70)
      WHEN 8 THEN ' ' ELSE key END,
    'title', CASE WHEN c = 3 THEN chr(65533) || line1 WHEN c IN (4, 5) THEN NULL
      WHEN c = 12 THEN chr(160) || 'a' || chr(28) || ' b' || chr(8195) || line1
      WHEN c = 13 THEN repeat('long ', 820) ELSE line1 END,
    'abstract', text,
    'authors', CASE WHEN c = 15 THEN '' ELSE source || '; ' || lang END,
    'categories', CASE WHEN c = 16 THEN 'cs.AIX' WHEN lang = 'en' THEN 'cs.CL cs.IR'
      WHEN lang = 'fr' THEN 'math.CO' ELSE 'stat.ML cs.LG' END,
    'update_date', CASE WHEN c NOT IN (9, 10, 11) THEN dated END,
    'doi', CASE WHEN c = 14 THEN ' ' || chr(160) ELSE ' 10.1/' || key END,
    'journal-ref', CASE WHEN five <> 0 THEN source END,
    'versions', CASE c
      WHEN 9 THEN '[{"created":"Mon, 2 Apr 2007 19:18:42 GMT"}]'::JSON
      WHEN 10 THEN '[{"created":"2007-04-02"},{"created":"2011-01-01"}]'::JSON
      WHEN 11 THEN '["2019-01-02"]'::JSON END)::VARCHAR AS json
  FROM raw),
lines AS (
  SELECT doc_id, CASE c WHEN 0 THEN ' ' || chr(160) || ' ' WHEN 1 THEN '{bad ' || json
    WHEN 2 THEN '[' || json || ']' ELSE json END AS value
  FROM fields),
records AS (
  SELECT doc_id, value::JSON AS j FROM lines
  WHERE json_valid(value) AND json_type(value) = 'OBJECT'),
record_fields AS (
  SELECT doc_id, j->>'id' AS id, j->>'title' AS title, j->>'abstract' AS abstract,
    j->>'authors' AS authors, j->>'categories' AS categories,
    j->>'update_date' AS update_date, j->>'doi' AS doi, j->>'journal-ref' AS journal_ref,
    j->>'$.versions[0].created' AS created,
    CASE WHEN json_type(j, '$.versions[0]') = 'VARCHAR' THEN j->>'$.versions[0]' END AS first_version
  FROM records)"""


def paper_id(x):
    ident = f"replace({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '/', '-')"
    return f"CASE WHEN {ident} = '' THEN 'unknown' ELSE substring({ident}, 1, 64) END"


def stripped_or_null(x, n):
    return f"nullif(substring({strip(x)}, 1, {n}), '')"


RECORD_YEAR = f"coalesce({year4('update_date')}, {year4('created')}, {year4('first_version')})"


def listed(codes):
    return "(" + " OR ".join(f"contains(categories, '{c}')" for c in codes) + ")"


def record_papers(codes):
    return f"""{LINES},
record_papers AS (
  SELECT doc_id, {paper_id('id')} AS paper_id, {clean_title('title')} AS title,
    {clean_abstract('abstract')} AS abstract, nullif(substring(authors, 1, 2000), '') AS authors,
    {RECORD_YEAR} AS year, {stripped_or_null('journal_ref', 500)} AS venue,
    {stripped_or_null('doi', 256)} AS doi, nullif(substring(categories, 1, 500), '') AS category
  FROM record_fields
  WHERE {listed(codes)} AND {clean_title('title')} <> '' AND {clean_abstract('abstract')} <> '')"""


VECTORS = """vectors AS (
  SELECT vec_id, label, 'vec-' || vec_id AS paper_id,
    CASE WHEN label <> 3 THEN 'vector ' || vec_id ELSE '' END AS title, '' AS abstract,
    'group ' || label AS authors,
    CAST(CASE WHEN vec_id % 11 <> 0 THEN 1991 + vec_id % 34 END AS INTEGER) AS year,
    CASE WHEN vec_id % 13 <> 0 THEN 'c' || label || ' s' || (vec_id % 3) END AS category,
    embedding::DOUBLE[] AS v
  FROM embeddings)"""

MEAN = """cells AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
mean AS (
  SELECT list(x ORDER BY pos) AS q FROM (SELECT pos, avg(x) AS x FROM cells GROUP BY pos))"""

LABEL_QUERIES = """cells AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
queries AS (
  SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS q,
    8 AS top_k, 3 + label AS own_k,
    CASE WHEN label % 2 = 0 THEN 1995 + label END AS min_year,
    CASE WHEN label % 3 <> 0 THEN 2015 + label END AS max_year,
    CASE label % 4 WHEN 1 THEN 'C' || label WHEN 2 THEN 'c_ s1' WHEN 3 THEN 's2' END AS pattern
  FROM (SELECT label, pos, avg(x) AS x FROM cells GROUP BY label, pos) GROUP BY label)"""

ALLOWED = """(min_year IS NULL OR year >= min_year) AND (max_year IS NULL OR year <= max_year)
  AND (pattern IS NULL OR upper(category) LIKE '%' || upper(pattern) || '%')"""


def embedded(prefix, source):
    """Hashed-word vectors of (id, body) as ``<prefix>_vec(id, cell, x)``."""
    return f"""{prefix}_words AS (
  SELECT id, w, count(*) AS n
  FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ({source}))
  GROUP BY id, w),
{prefix}_hash AS (SELECT w, md5(w) AS h FROM (SELECT DISTINCT w FROM {prefix}_words)),
{prefix}_cells AS (
  SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % {DIM} AS cell,
    sum(n * (1 - 2 * (('0x' || substr(h, 9, 1))::BIGINT % 2)))::BIGINT AS weight
  FROM {prefix}_words JOIN {prefix}_hash USING (w) GROUP BY ALL),
{prefix}_vec AS (
  SELECT id, cell, CAST(weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS FLOAT) AS x
  FROM {prefix}_cells WHERE weight <> 0)"""


DOC_BODY = f"SELECT paper_id AS id, {combined('title', 'abstract')} AS body FROM papers"
QUERY_BODY = "SELECT item_id AS id, text AS body FROM benchmark"


def text_distances(query_body):
    """``measured(query_id, paper_id, distance)`` of every text query and paper."""
    return f"""{PAPERS},
{embedded('d', DOC_BODY)},
{embedded('q', query_body)},
d_norm AS (SELECT id, sqrt(sum(x::DOUBLE * x)) AS size FROM d_vec GROUP BY id),
q_norm AS (SELECT id, sqrt(sum(x::DOUBLE * x)) AS size FROM q_vec GROUP BY id),
dots AS (
  SELECT q.id AS qid, d.id AS did, sum(q.x::DOUBLE * d.x) AS dot
  FROM q_vec q JOIN d_vec d USING (cell) GROUP BY ALL),
measured AS (
  SELECT q.id AS query_id, d.id AS paper_id, 1 - coalesce(dot, 0) / (q.size * d.size) AS distance
  FROM q_norm q CROSS JOIN d_norm d LEFT JOIN dots ON qid = q.id AND did = d.id)"""


def ranked(source, k, partition="PARTITION BY query_id"):
    return f"""SELECT * FROM (
  SELECT *, CAST(row_number() OVER ({partition} ORDER BY round(distance, 9), paper_id) AS INTEGER) AS rank
  FROM {source}) WHERE rank <= {k}"""


PLANES = """planes AS (
  SELECT j, i, 1 - 2 * (('0x' || substr(md5(j || ':' || i), 1, 1))::INTEGER % 2) AS r
  FROM range({bits}) a(j), range({dim}) b(i))"""


def coded(prefix, bits):
    """``<prefix>_code(id, word, bits)`` from ``<prefix>_vec``; word 0 has bits 0 to 31."""
    return f"""{prefix}_code AS (
  SELECT id, j // 32 AS word, sum(CASE WHEN s > 0 THEN 1::BIGINT << (j % 32) ELSE 0 END)::BIGINT AS bits
  FROM (SELECT id, j, sum(x::DOUBLE * r) AS s
        FROM {prefix}_vec JOIN planes ON i = cell WHERE j < {bits} GROUP BY id, j)
  GROUP BY id, word)"""


VECTOR_CELLS = """v_vec AS (
  SELECT paper_id AS id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS cell FROM vectors)"""
LABEL_CELLS = """q_vec AS (
  SELECT query_id AS id, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS cell FROM queries)"""
CODE_DISTANCE = """hamming AS (
  SELECT q.id AS query_id, d.id AS paper_id, sum(bit_count(xor(q.bits, d.bits)))::INTEGER AS distance
  FROM q_code q JOIN {d}_code d USING (word) GROUP BY ALL)"""


def in_bands(dim):
    """Of ``pairs(query_id, paper_id, k, distance)``, which a query's filters let pass, the
    ``opened`` ones and what follows from the last wanted of them: ``bounds(query_id, m, d)``.
    Reads ``d_code``, ``q_code``, ``q_vec`` and ``planes``.
    """
    bands, every = TIER.bands, 1 << TIER.bands
    numbers = ", ".join(f"({min(A.FIRST_BANDS << i, every)})" for i in range(bands) if A.FIRST_BANDS << i < 2 * every)
    return f"""{CODE_DISTANCE.format(d='d').replace("AS distance", "AS h")},
bands AS (SELECT id AS paper_id, (bits & {every - 1})::INTEGER AS band FROM d_code WHERE word = 0),
placed AS (SELECT * FROM pairs JOIN hamming USING (query_id, paper_id) JOIN bands USING (paper_id)),
sides AS (
  SELECT id AS query_id, j, abs(m) / sqrt(greatest({dim} - m * m, 1e-12) / {max(dim - 1, 1)}) AS far, m > 0 AS above
  FROM (SELECT id, j, sum(x::DOUBLE * r) / sqrt(sum(x::DOUBLE * x)) AS m
        FROM q_vec JOIN planes ON i = cell WHERE j < {bands} GROUP BY id, j)),
turns AS (
  SELECT query_id, v::INTEGER AS band, far, ((v >> j) & 1 = 1) <> above AS turned FROM sides, range({every}) b(v)),
places AS (
  SELECT query_id, band, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), band) AS place
  FROM (SELECT query_id, band, sum(CASE WHEN turned THEN far * far ELSE 0 END) AS score FROM turns GROUP BY ALL)),
steps(m) AS (SELECT DISTINCT * FROM (VALUES {numbers})),
open_steps AS (
  SELECT query_id, coalesce(min(m), {every}) AS m FROM (
    SELECT query_id, m FROM placed JOIN places USING (query_id, band) JOIN steps ON place <= m
    GROUP BY query_id, m HAVING count(*) >= max(k)) RIGHT JOIN (SELECT DISTINCT query_id FROM places) USING (query_id)
  GROUP BY query_id),
opened AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), paper_id) AS nth
  FROM placed JOIN places USING (query_id, band) JOIN open_steps USING (query_id) WHERE place <= m),
bounds AS (SELECT query_id, m, distance AS d, greatest(least(1 - distance, 1), -1) AS c FROM opened WHERE nth = k)"""


def within_bounds(share, suffix=""):
    """``found<suffix>``: the pairs that are measured by a search that aims at this share."""
    inner = A.math.sqrt(share)
    reach = ", ".join(f"({r!r})" for r in A.reaches(CODE_BITS, inner))
    crossed = f"1 / (1 + exp(greatest(least({A.LOGISTIC} * far * c / greatest(sqrt(1 - c * c), 1e-9), {A.STEEPEST}), -{A.STEEPEST})))"
    return f"""reach{suffix}(r) AS (VALUES {reach}),
limits{suffix} AS (SELECT *, (SELECT count(*) FROM reach{suffix} WHERE r < round(d, 9)) AS most FROM bounds),
chances{suffix} AS (
  SELECT query_id, band, round(exp(sum(ln(CASE WHEN turned THEN p ELSE 1 - p END))), 12) AS chance
  FROM (SELECT *, {crossed} AS p FROM turns JOIN bounds USING (query_id)) GROUP BY ALL),
near{suffix} AS (
  SELECT query_id, band FROM (
    SELECT *, sum(chance) OVER (PARTITION BY query_id ORDER BY chance DESC, band ROWS UNBOUNDED PRECEDING) - chance AS before
    FROM chances{suffix}) WHERE before < {inner!r}),
found{suffix} AS (
  SELECT query_id, paper_id, k, distance FROM opened
  UNION
  SELECT query_id, paper_id, k, distance FROM placed JOIN near{suffix} USING (query_id, band)
    JOIN limits{suffix} USING (query_id) WHERE h <= most)"""


def ann(filtered):
    allowed, k = (ALLOWED, "own_k") if filtered else ("true", "top_k")
    cells = VECTOR_CELLS.replace("v_vec", "d_vec")
    return f"""WITH {VECTORS},
{LABEL_QUERIES},
{PLANES.format(bits=CODE_BITS, dim=VECTOR_DIM)},
{cells},
{LABEL_CELLS},
{coded('d', CODE_BITS)},
{coded('q', CODE_BITS)},
pairs AS (
  SELECT query_id, paper_id, {k} AS k, list_cosine_distance(v, q) AS distance FROM queries, vectors WHERE {allowed}),
{in_bands(VECTOR_DIM)},
{within_bounds(TIER.share)},
best AS ({ranked('found', 'k')})
SELECT query_id, rank, paper_id, {r6('distance', 'distance')} FROM best"""


def ann_recall():
    shares = ", ".join(f"({s}, {i})" for i, s in enumerate(RECALL_SHARES))
    each = " UNION ALL ".join(f"SELECT query_id, paper_id, {i} AS place FROM found{i}" for i in range(len(RECALL_SHARES)))
    bounds = ",\n".join(within_bounds(share, str(i)) for i, share in enumerate(RECALL_SHARES))
    return f"""WITH {text_distances(QUERY_BODY)},
{PLANES.format(bits=CODE_BITS, dim=DIM)},
{coded('d', CODE_BITS)},
{coded('q', CODE_BITS)},
pairs AS (SELECT *, 8 AS k FROM measured),
{in_bands(DIM)},
{bounds},
met AS ({each}),
true_hits AS ({ranked('measured', 8)}),
shares(expected, place) AS (VALUES {shares})
SELECT CAST(expected AS DOUBLE) AS expected, count(*) AS neighbours, count(m.query_id) AS found,
  {r6('count(m.query_id) / count(*)', 'recall')}
FROM shares CROSS JOIN true_hits t
LEFT JOIN met m ON m.query_id = t.query_id AND m.paper_id = t.paper_id AND m.place = shares.place
GROUP BY expected"""


RESULT = "paper_id, title, abstract, authors, year, category"
SCORES = f"{r6('distance', 'distance')}, {r6('1 / (1 + greatest(distance, 0))', 'similarity')}"


def vector_top(k, where="true"):
    return f"""WITH {VECTORS}, {MEAN},
measured AS (
  SELECT vectors.*, list_cosine_distance(v, q) AS distance FROM vectors, mean WHERE {where}),
best AS ({ranked('measured', k, '')})
SELECT {RESULT}, {SCORES} FROM best"""


MERGED = f"""{PAPERS}, {TURNS},
changed AS (
  SELECT paper_id, substring('Revised: ' || title, 1, 4000) AS title, abstract, authors, year,
    CAST(NULL AS VARCHAR) AS venue, doi, category
  FROM papers WHERE paper_id IN (SELECT 'doc-' || doc_id FROM labels)),
last_turns AS (
  SELECT * EXCLUDE (turn, latest) FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY turn DESC) AS latest FROM turns)
  WHERE latest = 1)"""


def stored(source, created):
    return f"""SELECT paper_id, title, abstract, authors, year, venue, doi, category,
  CAST(length({combined('title', 'abstract')}) AS INTEGER) AS text_chars,
  CAST({DIM} AS INTEGER) AS dimension, '{created}' AS created_at
FROM {source}"""


PAPER_RULES = [
    ("paper_id IS NULL OR paper_id = ''", "paper_id missing"),
    ("length(paper_id) > 64", "paper_id too long"),
    ("title IS NULL OR title = ''", "title missing"),
    ("length(title) > 4000", "title too long"),
    ("abstract IS NULL OR abstract = ''", "abstract missing"),
    ("length(authors) > 2000", "authors too long"),
    ("length(venue) > 500", "venue too long"),
    ("length(doi) > 256", "doi too long"),
    ("length(category) > 500", "category too long"),
    ("year NOT BETWEEN 1500 AND 2100", "year out of range"),
    (f"title <> '' AND abstract <> '' AND {combined('title', 'abstract')} = ''", "text blank"),
]

REQUEST_RULES = [
    ("query IS NULL", "query missing"),
    ("length(query) NOT BETWEEN 2 AND 2000", "query length"),
    ("length(query) BETWEEN 2 AND 2000 AND length(trimmed) < 2", "query too short after trim"),
    ("k NOT BETWEEN 1 AND 50", "top_k out of range"),
    ("min_year NOT BETWEEN 1800 AND 2100", "min_year out of range"),
    ("max_year NOT BETWEEN 1800 AND 2100", "max_year out of range"),
    ("min_year > max_year", "min_year greater than max_year"),
    ("length(pattern) > 200", "category filter too long"),
    (
        rf"NOT regexp_full_match(wanted, '[A-Za-z0-9.,_\-{WS[1:-1]}]+')",
        "category filter characters",
    ),
]


def reasons(rules):
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + ")"


TEXT_BEST = f"""WITH {text_distances(QUERY_BODY)},
best AS ({ranked('measured', 8)})"""

REQUESTS = f"""requests AS (
  SELECT item_id AS query_id, trim(text) AS query, CAST(3 + item_id % 6 AS INTEGER) AS top_k,
    CAST(CASE WHEN item_id % 3 = 0 THEN 1998 END AS INTEGER) AS min_year,
    CAST(CASE WHEN item_id % 3 = 0 THEN 2016 END AS INTEGER) AS max_year,
    CASE item_id % 4 WHEN 1 THEN 'cs.en' WHEN 2 THEN 'CS_FR' END AS pattern
  FROM benchmark)"""


SQL = {
    "snapshot_parse": f"""WITH {LINES}
SELECT doc_id, id, title, abstract, authors, categories, update_date, doi, journal_ref
FROM record_fields""",
    "snapshot_rejects": f"""WITH {LINES}
SELECT doc_id, CASE WHEN json_valid(value) THEN 'not an object' ELSE 'bad json' END AS fault
FROM lines WHERE {strip('value')} <> '' AND doc_id NOT IN (SELECT doc_id FROM records)""",
    "ingest_rejects": f"""WITH {record_papers(DEFAULT_CATEGORIES)},
faults AS (
  SELECT count_if({strip('value')} = '') AS blank,
    count_if({strip('value')} <> '' AND NOT json_valid(value)) AS bad_json,
    count_if(json_valid(value) AND doc_id NOT IN (SELECT doc_id FROM records)) AS not_object FROM lines),
kept AS (
  SELECT count_if(NOT listed) AS unlisted, count_if(listed AND NOT worded) AS no_text FROM (
    SELECT coalesce({listed(DEFAULT_CATEGORIES)}, false) AS listed,
      coalesce({clean_title('title')} <> '' AND {clean_abstract('abstract')} <> '', false) AS worded FROM record_fields)),
counted AS (
  SELECT count(*) AS papers, count_if(paper_id = 'unknown') AS unknown_ids,
    count_if({reasons(PAPER_RULES)} <> '') AS rejected FROM record_papers)
SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in (*OUTCOMES, 'rejected'))}, CAST(bad_json + not_object AS BIGINT) AS bad_lines
FROM faults, kept, counted""",
    "clean_title": f"SELECT doc_id, {clean_title(noisy('text'))} AS title FROM documents",
    "clean_abstract": f"SELECT doc_id, {clean_abstract(noisy('text'))} AS abstract FROM documents",
    "paper_id_normalize": f"""SELECT doc_id, {paper_id('raw')} AS paper_id FROM (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  ' || doc_id || '/' || source || '/v1' || chr(10)
    WHEN 1 THEN repeat(source, 20) || doc_id WHEN 2 THEN ' ' WHEN 3 THEN doc_id::VARCHAR END AS raw
  FROM documents)""",
    "optional_fields": f"""SELECT doc_id, nullif(substring(e, 1, 2000), '') AS authors,
  {stripped_or_null('b', 500)} AS venue, {stripped_or_null('b', 256)} AS doi,
  nullif(substring(e, 1, 500), '') AS category
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '   ' ELSE {noisy('text')} END AS b,
  CASE WHEN doc_id % 4 = 1 THEN '' ELSE {noisy('text')} END AS e FROM documents)""",
    "year_extract": f"WITH {LINES} SELECT doc_id, {RECORD_YEAR} AS year FROM record_fields",
    "category_allowlist": f"""WITH {PAPERS} SELECT paper_id, category FROM papers
WHERE contains(category, 'cs.EN') OR contains(category, 'cs.F')""",
    "required_text": f"WITH {record_papers([''])} SELECT doc_id, title FROM record_papers",
    "record_to_paper": f"WITH {record_papers(DEFAULT_CATEGORIES)} SELECT * FROM record_papers",
    "first_n_cap": f"""WITH {record_papers(DEFAULT_CATEGORIES)}
SELECT doc_id, paper_id, title FROM record_papers ORDER BY doc_id LIMIT {CAP}""",
    "combined_text": f"""SELECT doc_id, {combined(line1(noisy('text')), noisy('text'))} AS combined_text
FROM documents""",
    "text_normalize": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(65533) || chr(65533)
  WHEN 1 THEN text END AS value FROM documents""",
    "strip_control_chars": rf"""SELECT doc_id,
  {strip(r"regexp_replace(chr(1) || chr(127) || text, '[\x00-\x1f\x7f]', ' ', 'g')")} AS value
FROM documents""",
    "validate_papers": f"""SELECT doc_id, {reasons(PAPER_RULES)} AS reasons FROM (
  SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN repeat(source, doc_id % 20) END AS paper_id,
    CASE WHEN doc_id % 10 = 3 THEN '  ' ELSE text END AS title,
    CASE WHEN doc_id % 10 = 3 THEN '  ' ELSE text END AS abstract,
    text AS authors, n_chars AS year, {LINE1} AS venue, {LINE1} AS doi, text AS category
  FROM documents)""",
    "validate_requests": f"""SELECT query_id, trimmed AS query, k AS top_k,
  wanted AS category_contains, {reasons(REQUEST_RULES)} AS reasons
FROM (
  SELECT *, {strip('query')} AS trimmed, nullif({strip('pattern')}, '') AS wanted FROM (
    SELECT doc_id AS query_id,
      CASE WHEN doc_id % 10 = 0 THEN ' x  ' ELSE {noisy('text')} END AS query,
      CAST(CASE WHEN doc_id % 7 <> 0 THEN doc_id % 60 ELSE 8 END AS INTEGER) AS k,
      CASE WHEN doc_id % 3 <> 0 THEN 1790 + doc_id % 320 END AS min_year,
      CASE WHEN doc_id % 4 <> 0 THEN 1900 + n_chars % 210 END AS max_year,
      CASE doc_id % 5 WHEN 0 THEN ' ' || source || chr(160) || 'x ' WHEN 1 THEN source || '%b'
        WHEN 2 THEN ' ' WHEN 3 THEN {LINE1} END AS pattern
    FROM documents))""",
    "embed_hash": f"""WITH {PAPERS}, {embedded('d', DOC_BODY)}
SELECT paper_id, CAST(cell AS INTEGER) AS cell, {r6('x::DOUBLE', 'weight')}
FROM papers LEFT JOIN d_vec ON paper_id = id""",
    "embed_normalize": f"""WITH cells AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS cell, (unnest(embedding)::DOUBLE * label)::FLOAT AS x
  FROM embeddings),
sized AS (SELECT *, sqrt(sum(x::DOUBLE * x) OVER (PARTITION BY vec_id)) AS size FROM cells)
SELECT vec_id, CAST(cell AS INTEGER) AS cell, {r6('CAST(x::DOUBLE / size AS FLOAT)::DOUBLE', 'weight')}
FROM sized WHERE size > 0
UNION ALL
SELECT DISTINCT vec_id, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) FROM sized WHERE size = 0""",
    "embed_dim_check": f"""SELECT vec_id, CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <> {VECTOR_DIM} THEN 'dimension'
  WHEN list_count(v) < len(v) THEN 'null element' END AS fault
FROM (SELECT vec_id, CASE label WHEN 0 THEN NULL WHEN 1 THEN embedding[1:32]
    WHEN 2 THEN list_append(embedding[1:{VECTOR_DIM - 1}], NULL) ELSE embedding END AS v FROM embeddings)""",
    "cosine_distance": f"""WITH {MEAN}
SELECT vec_id, {r6('list_cosine_distance(embedding::DOUBLE[], q)', 'distance')}
FROM embeddings, mean""",
    "similarity_score": f"""WITH {MEAN}
SELECT vec_id,
  {r6('1 / (1 + greatest(list_cosine_distance(embedding::DOUBLE[], q), 0))', 'similarity')}
FROM embeddings, mean""",
    "filter_year_range": f"""WITH {PAPERS} SELECT paper_id, year FROM papers
WHERE year >= 1999 AND year <= 2010""",
    "filter_category": f"""WITH {PAPERS} SELECT paper_id, category FROM papers
WHERE category IS NOT NULL AND upper(category) LIKE '%' || upper('cs_en SRC1') || '%'""",
    "search_exact": vector_top(20),
    "search_hybrid": vector_top(
        10, "year >= 1994 AND year <= 2018 AND upper(category) LIKE '%C_ S1%'"
    ),
    "search_text": f"""{TEXT_BEST}
SELECT query_id, rank, {RESULT}, {SCORES} FROM best JOIN papers USING (paper_id)""",
    "display_rows": f"""{TEXT_BEST}
SELECT query_id, rank, paper_id, substring(title, 1, 72) AS title, year,
  substring(coalesce(category, ''), 1, 36) AS category,
  coalesce(authors, 'Unknown authors') AS authors,
  round(1 / (1 + greatest(distance, 0)), 4) + 0.0 AS similarity, {r6('distance', 'distance')},
  translate(substring(abstract, 1, 160), chr(10), ' ') AS abstract_snippet
FROM best JOIN papers USING (paper_id)""",
    "search_batch": f"""WITH {VECTORS}, {LABEL_QUERIES},
measured AS (
  SELECT query_id, own_k, paper_id, list_cosine_distance(v, q) AS distance
  FROM queries, vectors WHERE {ALLOWED}),
best AS ({ranked('measured', 'own_k')})
SELECT query_id, rank, paper_id, {r6('distance', 'distance')} FROM best""",
    "search_response": f"""WITH {text_distances(QUERY_BODY)}, {REQUESTS},
{PLANES.format(bits=CODE_BITS, dim=DIM)},
{coded('d', CODE_BITS)},
{coded('q', CODE_BITS)},
pairs AS (
  SELECT m.*, top_k AS k FROM measured m JOIN requests USING (query_id) JOIN papers USING (paper_id) WHERE {ALLOWED}),
{in_bands(DIM)},
{within_bounds(TIER.share)},
best AS (SELECT query_id, rank, paper_id, distance, false AS approximate FROM ({ranked('pairs', 'k')})
  UNION ALL SELECT query_id, rank, paper_id, distance, true FROM ({ranked('found', 'k')})),
lists AS (
  SELECT query_id, approximate, count(*) AS hits, string_agg(paper_id, ',' ORDER BY rank) AS paper_ids,
    min(distance) AS best_distance, arg_min(title, rank) AS best_title
  FROM best JOIN papers USING (paper_id) GROUP BY query_id, approximate)
SELECT query_id, query, top_k, min_year, max_year, pattern AS category_contains,
  '{ENGINE}' AS engine, approximate, CAST(coalesce(hits, 0) AS INTEGER) AS hits,
  coalesce(paper_ids, '') AS paper_ids, {r6('best_distance', 'best_distance')}, best_title
FROM requests CROSS JOIN (VALUES (false), (true)) a(approximate) LEFT JOIN lists USING (query_id, approximate)""",
    "ann_codes": f"""WITH {VECTORS}, {PLANES.format(bits=CODE_BITS, dim=VECTOR_DIM)}, {VECTOR_CELLS},
{coded('v', CODE_BITS)}
SELECT id AS paper_id, CAST(word AS INTEGER) AS word, bits FROM v_code""",
    "ann_search": ann(filtered=False),
    "ann_hybrid": ann(filtered=True),
    "ann_recall": ann_recall(),
    "ann_tier_choice": """SELECT label, rows, budget, CAST(CASE WHEN rows * 32 <= budget THEN 256
  WHEN rows * 16 <= budget THEN 128 WHEN rows * 8 <= budget THEN 64
  WHEN rows * 4 <= budget THEN 32 END AS INTEGER) AS bits
FROM (SELECT label, count(*) AS rows FROM embeddings GROUP BY label),
  (VALUES (150::BIGINT), (500), (1000), (2000), (1073741824)) b(budget)""",
    "upsert_merge": f"""WITH {MERGED}
SELECT *, '2024-01-01' AS created_at FROM papers
  WHERE paper_id NOT IN (SELECT paper_id FROM changed)
UNION ALL SELECT *, '2024-01-01' FROM changed
UNION ALL SELECT *, '2024-02-01' FROM last_turns""",
    "upsert_report": f"""WITH {MERGED}
SELECT (SELECT count(*) FROM turns) + (SELECT count(*) FROM changed) AS rows_in,
  (SELECT count(*) FROM last_turns) + (SELECT count(*) FROM changed) AS distinct_ids,
  (SELECT count(*) FROM last_turns) AS inserted, (SELECT count(*) FROM changed) AS updated,
  CAST(0 AS BIGINT) AS without_vector""",
    "replace_load": f"WITH {PAPERS} {stored('papers', '2024-02-01')}",
    "corpus_roundtrip": f"WITH {PAPERS} SELECT * FROM papers",
    "schema_evolve": f"""WITH {MERGED}
SELECT * EXCLUDE (category), CAST(NULL AS VARCHAR) AS category FROM papers
UNION ALL SELECT * EXCLUDE (turn, category), category FROM turns
UNION ALL SELECT * EXCLUDE (category), category FROM changed""",
    "stream_ingest": f"""WITH {record_papers(DEFAULT_CATEGORIES)},
latest AS (
  SELECT * EXCLUDE (doc_id), '2024-02-01' AS created_at FROM record_papers WHERE doc_id IN
    (SELECT max(doc_id) FROM record_papers GROUP BY paper_id)),
{MERGED},
whole AS (SELECT * FROM latest UNION ALL SELECT *, '2024-01-01' FROM last_turns),
{embedded('d', f"SELECT paper_id AS id, {combined('title', 'abstract')} AS body FROM whole")},
{PLANES.format(bits=CODE_BITS, dim=DIM)},
{coded('d', CODE_BITS)},
codes AS (SELECT id AS paper_id, string_agg(bits::VARCHAR, ',' ORDER BY word) AS code FROM d_code GROUP BY id)
SELECT s.* EXCLUDE (created_at), whole.created_at, code FROM ({stored('whole', '')}) s JOIN whole USING (paper_id)
LEFT JOIN codes USING (paper_id)""",
    "corpus_count": "SELECT count(*) AS papers_count FROM documents",
    "corpus_profile": f"""WITH {PAPERS}, {embedded('d', DOC_BODY)}
SELECT 'ok' AS status, (SELECT count(*) FROM papers) AS papers_count,
  'hashed-words' AS embedding_model, CAST({DIM} AS INTEGER) AS embedding_dimension,
  (SELECT count(*) FROM papers WHERE paper_id NOT IN (SELECT id FROM d_vec)) AS without_vector,
  CAST({DIM} AS INTEGER) AS min_dimension, CAST({DIM} AS INTEGER) AS max_dimension,
  'yes' AS vector_index, 'exact' AS search_path""",
}
