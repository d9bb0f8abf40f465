"""Text functions, segmentation, heading classification, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import assess, classify, segment, tokens
from ..sources import files
from ..sources import json as json_source
from .base import Derived, query, spread, table

#: Every document as two pages, with numbered lines around its text.
CONTRACT = Derived(
    """SELECT doc_id, page_number, CASE WHEN page_number = 1 THEN concat('MASTER AGREEMENT ', CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'NO' END, chr(10), '1. Definitions', chr(10), source, ' in ', lang, chr(10), '(', doc_id % 9, ') Notice', chr(10),
    '(', doc_id % 7, ') Renewal', chr(10), 'Section 2.', doc_id % 5, CASE WHEN doc_id % 3 = 0 THEN '.4.1.2 Deep' ELSE ' Caps' END, chr(10), '(a) first item', chr(10), '(iv) roman item')
    ELSE concat('(', doc_id % 4, ') continues here', chr(10), text, chr(10), 'ARTICLE IV Indemnity', chr(10), '1.1 Services', chr(10), '1.1.', doc_id % 6, ' Work. ') END AS text
    FROM documents, (SELECT 1 AS page_number UNION ALL SELECT 2) p"""
)
_LINES = f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, k) AS line_no, page_number, line FROM (
    SELECT doc_id, page_number, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM (
      SELECT doc_id, page_number, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM {CONTRACT.sql})))"""
_LEVEL = rf"""CASE WHEN regexp_matches(line, '{fixed.NUMBER_3}') THEN 3 WHEN regexp_matches(line, '{fixed.NUMBER_2}') THEN 2
    WHEN regexp_matches(line, '{fixed.SECTION}') THEN 1 + length(regexp_extract(line, '{fixed.SECTION}', 1)) - length(replace(regexp_extract(line, '{fixed.SECTION}', 1), '.', ''))
    WHEN regexp_matches(line, '{fixed.ARTICLE}') THEN 1 WHEN regexp_matches(line, '{fixed.NUMBER_1}') THEN 1 WHEN regexp_matches(line, '{fixed.PAREN_ROMAN}') THEN 3
    WHEN regexp_matches(line, '{fixed.PAREN_LETTER}') THEN 2
    WHEN len(string_split_regex(line, '\s+')) <= 8 AND regexp_matches(line, '{fixed.CAPITALS}') THEN 1 END"""
_END = fixed.SENTENCE_END.replace("'", "''")
_HEADINGS = rf"""h0 AS (SELECT *, {_LEVEL} AS hard, regexp_matches(line, '{fixed.PAREN_NUMBER}') AS is_n FROM {_LINES}),
    h1 AS (SELECT *, lag(line) OVER w AS before, lag(hard) OVER w AS hard_before, sum(CASE WHEN is_n THEN 0 ELSE 1 END) OVER w AS run FROM h0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    h2 AS (SELECT *, max(CASE WHEN is_n AND (before IS NULL OR regexp_matches(before, '{_END}') OR hard_before IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS ok FROM h1),
    heads AS (SELECT doc_id, line_no, page_number, line, CAST(CASE WHEN is_n THEN CASE WHEN ok = 1 THEN 2 END ELSE hard END AS INTEGER) AS level FROM h2)"""


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, page_number, line FROM {_LINES}")
def line_explode(spark, d):
    return segment.explode_lines(CONTRACT.df(spark, d))


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_lines FROM documents")
def line_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.lines(F.col("text"))).alias("n_lines"))


@query(f"WITH {_HEADINGS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, level FROM heads")
def heading_detect(spark, d):
    return segment.detect_headings(segment.explode_lines(CONTRACT.df(spark, d))).select("doc_id", "line_no", "level")


@query(
    f"""WITH {_HEADINGS}, s AS (SELECT doc_id, line_no, line, level, {", ".join(f"last_value(CASE WHEN level <= {k} THEN level END IGNORE NULLS) OVER w AS v{k}, last_value(CASE WHEN level <= {k} THEN line END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))}
      FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(nullif(concat_ws(' > ', {", ".join(f"CASE WHEN v{k} = {k} THEN t{k} END" for k in range(1, 7))}), ''), 'UNTITLED') AS heading_path FROM s"""
)
def heading_breadcrumb(spark, d):
    return segment.breadcrumbs(segment.detect_headings(segment.explode_lines(CONTRACT.df(spark, d)))).select("doc_id", "line_no", "heading_path")


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len({_SENTENCES}) AS INTEGER) AS n, CAST(length(list_aggregate({_SENTENCES}, 'string_agg', '|')) AS INTEGER) AS chars FROM documents")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    # a text without sentences has no joined length in SQL, rather than 0
    return s.select("doc_id", F.size("s").alias("n"), F.when(F.size("s") > 0, F.length(F.array_join("s", "|"))).alias("chars"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{fixed.TOKEN}')) AS INTEGER) AS n FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("n"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{fixed.WORD}')) AS INTEGER) AS n, sha256(list_aggregate(regexp_extract_all(lower(text), '{fixed.WORD}'), 'string_agg', ' ')) AS sha FROM documents")
def word_tokens(spark, d):
    w = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    # a text without words has no hash in SQL, rather than that of an empty string
    return w.select("doc_id", F.size("w").alias("n"), F.when(F.size("w") > 0, F.sha2(F.array_join("w", " "), 256)).alias("sha"))


@query(
    rf"""WITH RECURSIVE s AS (SELECT doc_id, list_transform({_SENTENCES}, lambda x: len(regexp_extract_all(x, '{fixed.TOKEN}'))) AS ns FROM documents),
    p AS (SELECT doc_id, ns, 1 AS i, CAST(1 AS BIGINT) AS piece, ns[1] AS used FROM s WHERE len(ns) > 0
      UNION ALL SELECT doc_id, ns, i + 1, CASE WHEN used + ns[i + 1] > 512 THEN piece + 1 ELSE piece END, CASE WHEN used + ns[i + 1] > 512 THEN ns[i + 1] ELSE used + ns[i + 1] END FROM p WHERE i < len(ns))
    SELECT doc_id, CAST(max(piece) AS INTEGER) AS pieces, CAST(max(used) AS INTEGER) AS largest FROM p GROUP BY doc_id"""
)
def greedy_pack(spark, d):
    s = F.transform(text.sentences(F.col("text")), lambda x: F.struct(F.lit(1).alias("page"), x.alias("text"), text.token_count(x).alias("n")))
    packed = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", segment._pack(s, fixed.MAX_TOKENS).alias("p")).filter(F.size("p") > 0)
    return packed.select("doc_id", F.size("p").alias("pieces"), F.array_max(F.transform("p", lambda x: x["n"])).alias("largest"))


_DOC_LINES = _HEADINGS.replace(CONTRACT.sql, "(SELECT doc_id, 1 AS page_number, text FROM documents)")
_N = rf"len(regexp_extract_all(text, '{fixed.TOKEN}'))"


@query(
    rf"""WITH RECURSIVE {_DOC_LINES}, s AS (SELECT *, count(level) OVER w AS candidate, {", ".join(f"last_value(CASE WHEN level <= {k} THEN level END IGNORE NULLS) OVER w AS v{k}, last_value(CASE WHEN level <= {k} THEN line END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))}
      FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    paths AS (SELECT *, coalesce(nullif(concat_ws(' > ', {", ".join(f"CASE WHEN v{k} = {k} THEN t{k} END" for k in range(1, 7))}), ''), 'UNTITLED') AS heading_path FROM s),
    g AS (SELECT *, {_N} AS n FROM (SELECT doc_id, candidate, string_agg(line, chr(10) ORDER BY line_no) AS text, string_agg(line, ' ' ORDER BY line_no) AS flat, arg_min(heading_path, line_no) AS heading_path FROM paths GROUP BY ALL)),
    sent AS (SELECT *, {_N} AS n FROM (SELECT doc_id, candidate, unnest(range(len(l))) AS i, unnest(l) AS text FROM (SELECT doc_id, candidate, {_SENTENCES.replace("trim(text)", "trim(flat)")} AS l FROM g WHERE n > 512))),
    p AS (SELECT doc_id, candidate, i, CAST(0 AS BIGINT) AS piece, n AS used FROM sent WHERE i = 0
      UNION ALL SELECT x.doc_id, x.candidate, x.i, CASE WHEN p.used + x.n > 512 THEN p.piece + 1 ELSE p.piece END, CASE WHEN p.used + x.n > 512 THEN x.n ELSE p.used + x.n END FROM p JOIN sent x ON x.doc_id = p.doc_id AND x.candidate = p.candidate AND x.i = p.i + 1),
    pieces AS (SELECT doc_id, candidate, 0 AS piece, text, n FROM g WHERE n <= 512 UNION ALL SELECT doc_id, candidate, piece, string_agg(text, ' ' ORDER BY i), sum(n) FROM p JOIN sent USING (doc_id, candidate, i) GROUP BY ALL),
    l AS (SELECT doc_id, list({{'h': heading_path, 't': pieces.text, 'n': CAST(pieces.n AS BIGINT)}} ORDER BY candidate, piece) AS xs FROM pieces JOIN g USING (doc_id, candidate) GROUP BY doc_id),
    f AS (SELECT doc_id, xs, 0 AS i, xs[:0] AS merged, xs[1] AS wait, false AS waits FROM l
      UNION ALL SELECT doc_id, xs, i + 1, CASE WHEN x.n >= 40 THEN list_append(held, x) WHEN back THEN list_append(held[:-2], {{'h': held[-1].h, 't': held[-1].t || chr(10) || x.t, 'n': held[-1].n + x.n}}) ELSE held END, x, x.n < 40 AND NOT back
      FROM (SELECT *, coalesce(len(held) > 0 AND held[-1].n + x.n <= 512, false) AS back FROM (SELECT *, CASE WHEN ahead THEN {{'h': xs[i + 1].h, 't': wait.t || chr(10) || xs[i + 1].t, 'n': wait.n + xs[i + 1].n}} ELSE xs[i + 1] END AS x,
        CASE WHEN NOT waits OR ahead THEN merged ELSE list_append(merged, wait) END AS held FROM (SELECT *, waits AND wait.n + xs[i + 1].n <= 512 AS ahead FROM f WHERE i < len(xs))))),
    done AS (SELECT doc_id, CASE WHEN len(xs) = 1 THEN xs WHEN waits THEN list_append(merged, wait) ELSE merged END AS c FROM f WHERE i = len(xs))
    SELECT doc_id, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_ord, unnest(list_transform(c, lambda x: x.h)) AS heading_path, unnest(list_transform(c, lambda x: sha256(x.t))) AS sha, CAST(unnest(list_transform(c, lambda x: x.n)) AS INTEGER) AS n_tokens, 1 AS page_number FROM done"""
)
def chunk_documents(spark, d):
    """Clauses of every document (one page each)."""
    pages = spread(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text"))
    return segment.chunk_documents(pages).select("doc_id", "chunk_ord", "heading_path", F.sha2("text", 256).alias("sha"), "n_tokens", "page_number")


@query()
def bpe_token_count(spark, d):
    """Byte-pair tokens of every text; tested against the encoder itself."""
    return tokens.counted(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "n_tokens")


@query()
def bpe_chunk_documents(spark, d):
    """Clauses of every document within a budget of byte-pair tokens."""
    pages = spread(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text"))
    chunks = segment.chunk_documents(pages, counter=tokens.counted)
    return chunks.select("doc_id", "chunk_ord", "heading_path", F.sha2("text", 256).alias("sha"), "n_tokens", "page_number")


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, list_transform(range(1 + doc_id % 9), lambda k: (doc_id * 7919 + k * k * 104729) % CASE WHEN doc_id % 2 = 0 THEN 90 ELSE 560 END) AS ns FROM documents),
    f AS (SELECT doc_id, ns, 0 AS i, CAST([] AS BIGINT[]) AS merged, CAST(NULL AS BIGINT) AS wait FROM s
      UNION ALL SELECT doc_id, ns, i + 1, CASE WHEN x >= 40 THEN list_append(held, x) WHEN back THEN list_append(held[:-2], held[-1] + x) ELSE held END, CASE WHEN x >= 40 OR back THEN NULL ELSE x END
      FROM (SELECT *, coalesce(len(held) > 0 AND held[-1] + x <= 512, false) AS back FROM (SELECT *, CASE WHEN ahead THEN wait + ns[i + 1] ELSE ns[i + 1] END AS x, CASE WHEN wait IS NULL OR ahead THEN merged ELSE list_append(merged, wait) END AS held
        FROM (SELECT *, coalesce(wait + ns[i + 1] <= 512, false) AS ahead FROM f WHERE i < len(ns)))))
    SELECT doc_id, array_to_string(CASE WHEN len(ns) = 1 THEN ns WHEN wait IS NULL THEN merged ELSE list_append(merged, wait) END, ',') AS merged FROM f WHERE i = len(ns)"""
)
def merge_undersized(spark, d):
    number = (F.col("doc_id") * 7919).cast("long")
    n = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 9).cast("int")), lambda k: (number + k * k * 104729) % F.when(F.col("doc_id") % 2 == 0, 90).otherwise(560))
    size = F.transform(n, lambda x: F.struct(F.lit("h").alias("heading_path"), F.lit("t").alias("text"), F.lit(1).alias("page"), x.cast("int").alias("n")))
    merged = segment._merge(size.cast(f"array<{segment._CHUNK}>"), fixed.MIN_TOKENS, fixed.MAX_TOKENS)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(merged, lambda c: c["n"].cast("string")), ",").alias("merged"))


HEADINGS = Derived(
    """SELECT doc_id AS id, CASE doc_id % 13 WHEN 0 THEN concat(doc_id % 20, '. ', doc_id % 3, '. Venue') WHEN 1 THEN 'Indemnification and Limitation of Liability' WHEN 2 THEN concat('Indemnification > ', doc_id % 7, '.1 Termination')
    WHEN 3 THEN 'Revenue' WHEN 4 THEN 'Determination' WHEN 5 THEN concat('Section ', doc_id % 9, '.', doc_id % 5, ': Governing Law') WHEN 6 THEN '(a) CONFIDENTIAL INFORMATION' WHEN 7 THEN 'Article IV — Limitation of Liability'
    WHEN 8 THEN concat('Canceled ', replace(text, chr(10), ' ')) WHEN 9 THEN '  12.   Choice   of Law. ' WHEN 10 THEN '' WHEN 11 THEN 'IV. Non-Disclosure' ELSE replace(text, chr(10), ' ') END AS heading FROM documents"""
)
_NORM = "trim(heading)"
for _ in range(3):
    _NORM = f"trim(regexp_replace({_NORM}, '{fixed.LEADING_NUMBER}', ''))"
_NORM = f"lower(regexp_replace(trim({_NORM}, '{fixed.HEADING_TRIM}'), '\\s+', ' ', 'g'))"


@query(f"SELECT id, {_NORM} AS normal FROM {HEADINGS.sql}")
def heading_normalize(spark, d):
    return HEADINGS.df(spark, d).select("id", text.normal_heading(F.col("heading")).alias("normal"))


def _phrase_rows() -> str:
    return ", ".join(f"('{c}', '{p}')" for c in sorted(fixed.LEXICON) for p in fixed.LEXICON[c])


@query(
    rf"""WITH p(category, phrase) AS (VALUES {_phrase_rows()}), n AS (SELECT id, {_NORM} AS normal FROM {HEADINGS.sql}),
    m AS (SELECT id, category, length(regexp_extract(normal, '^(.*?)\b' || phrase || '\b', 1)) AS pos FROM n, p WHERE regexp_matches(normal, '\b' || phrase || '\b'))
    SELECT n.id, (SELECT category FROM m WHERE m.id = n.id ORDER BY pos, category LIMIT 1) AS category FROM n"""
)
def heading_classify(spark, d):
    return HEADINGS.df(spark, d).select("id", classify.classify_heading(F.col("heading")).alias("category"))


_WORDS = {"apache": ("apache license",), "bsd": ("bsd license", "mit license"), "cc": ("creative commons", "cc by"), "gpl": ("gnu general public license", "general public license")}


@query(
    r"""WITH n AS (SELECT doc_id, lower(text) AS t FROM documents),
    p(category, phrase) AS (VALUES ('apache', 'apache license'), ('bsd', 'bsd license'), ('bsd', 'mit license'), ('cc', 'creative commons'), ('cc', 'cc by'), ('gpl', 'gnu general public license'), ('gpl', 'general public license')),
    m AS (SELECT doc_id, category, strpos(t, phrase) AS pos FROM n, p WHERE contains(t, phrase))
    SELECT n.doc_id, (SELECT category FROM m WHERE m.doc_id = n.doc_id ORDER BY pos, category LIMIT 1) AS category FROM n"""
)
def lexicon_scan_documents(spark, d):
    """The lexicon's rule (earliest phrase wins) with another vocabulary, over whole texts."""
    low = F.lower("text")
    far = F.lit(1 << 30)
    at = {c: F.least(far, far, *(F.coalesce(F.nullif(F.instr(low, p), F.lit(0)), far) for p in ps)) for c, ps in _WORDS.items()}
    best = F.least(*at.values())
    out = F.lit(None).cast("string")
    for c in sorted(at, reverse=True):
        out = F.when((best < far) & (at[c] == best), c).otherwise(out)
    return table(spark, d, "documents").select("doc_id", out.alias("category"))


@query(
    r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(right(text, 200), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id, coalesce(CASE WHEN length(l[-1]) > 80 AND len(l) >= 2 THEN l[-2] ELSE l[-1] END, '') AS proxy FROM c"""
)
def heading_proxy(spark, d):
    return table(spark, d, "documents").select("doc_id", text.heading_proxy(F.col("text")).alias("proxy"))


#: Three tries an id, with answers of every kind.
_RAW = """CASE event_id % 11 WHEN 0 THEN '{not json' WHEN 1 THEN concat('{"severity": ', event_id % 10, ', "explanation": "a", "citation": "b"}') WHEN 2 THEN '{"severity": "urgent", "explanation": "a", "citation": "b"}' WHEN 3 THEN '["severity"]'
    WHEN 4 THEN '{"severity": "high", "explanation": null, "citation": "b"}' WHEN 5 THEN concat('{"severity": "high", "explanation": "', event_type, '"}') WHEN 6 THEN props
    ELSE concat('{"severity": "', CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END, '", "explanation": "', event_type, '", "citation": "b"}') END"""
ATTEMPTS = Derived(
    f"""SELECT event_id - event_id % 3 AS id, CAST(event_id % 3 + 1 AS INTEGER) AS n, CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'signup' THEN 503 WHEN event_type = 'view' AND event_id % 4 = 0 THEN 500 ELSE 200 END AS code,
    CASE event_id % 5 WHEN 0 THEN '7200' WHEN 1 THEN '5' WHEN 2 THEN 'soon' END AS retry_after, {_RAW} AS raw FROM events"""
)
OUTPUTS = Derived(f"SELECT event_id AS id, {_RAW} AS raw FROM events")
_ERROR = """CASE WHEN NOT json_valid(raw) THEN 'not json' WHEN json_type(raw) <> 'OBJECT' THEN 'not an object'
    WHEN coalesce(json_type(raw, '$.severity'), 'NULL') = 'NULL' THEN 'severity: missing' WHEN json_type(raw, '$.severity') <> 'VARCHAR' THEN 'severity: not a string'
    WHEN coalesce(json_type(raw, '$.explanation'), 'NULL') = 'NULL' THEN 'explanation: missing' WHEN json_type(raw, '$.explanation') <> 'VARCHAR' THEN 'explanation: not a string'
    WHEN coalesce(json_type(raw, '$.citation'), 'NULL') = 'NULL' THEN 'citation: missing' WHEN json_type(raw, '$.citation') <> 'VARCHAR' THEN 'citation: not a string'
    WHEN raw->>'$.severity' NOT IN ('low', 'medium', 'high') THEN 'severity: not allowed' END"""


@query(f"SELECT id, {_ERROR} AS error FROM {OUTPUTS.sql}")
def json_strict_validate(spark, d):
    return OUTPUTS.df(spark, d).select("id", assess.flag_error(F.col("raw")).alias("error"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


_PAGES = Derived(
    """SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN '## -- ?? ab !! ,, ..' WHEN 2 THEN 'ab cd ef gh' ELSE text END AS text,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(50 + doc_id % 50 AS DOUBLE) END AS conf FROM documents"""
)


@query(
    rf"""SELECT id, CASE WHEN trim(text) = '' THEN 'empty' WHEN conf IS NULL THEN 'no confidence' WHEN conf < 65 THEN 'low confidence'
    WHEN length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(regexp_replace(text, '\s', '', 'g')) < 0.5 THEN 'few letters'
    WHEN coalesce(list_max(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x))), 0) < 5 THEN 'no word' ELSE 'ok' END AS verdict FROM {_PAGES.sql}"""
)
def page_verdicts(spark, d):
    return _PAGES.df(spark, d).select("id", text.page_verdict(F.col("text"), F.col("conf")).alias("verdict"))


_LAYER = Derived("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(' ', chr(10), lang) WHEN 2 THEN '' END AS text FROM documents")
_READ = Derived(f"SELECT id, concat(' ', text, chr(10)) AS ocr_text, conf AS mean_conf FROM {_PAGES.sql} q WHERE id % 9 > 0")
_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    rf"""SELECT id, CASE WHEN used THEN {_BARE.format('ocr_text')} ELSE text END AS text, used AS ocr_derived FROM (SELECT *, coalesce(length({_BARE.format('text')}) < 50 AND mean_conf >= 65 AND {_BARE.format('ocr_text')} <> ''
    AND length(regexp_replace(ocr_text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(regexp_replace(ocr_text, '\s', '', 'g')) >= 0.5
    AND regexp_matches(ocr_text, '[A-Za-z]{{5}}'), false) AS used FROM (SELECT id, coalesce(text, '') AS text FROM {_LAYER.sql}) LEFT JOIN {_READ.sql} USING (id))"""
)
def ocr_fallback(spark, d):
    """Pages with little or no text take what was recognised of them, where that is good enough."""
    return files.with_ocr(_LAYER.df(spark, d), _READ.df(spark, d), "id")


_OCR = Derived("SELECT user_id AS page, CASE WHEN event_id % 5 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(event_id % 100 AS DOUBLE) END AS conf, CASE WHEN event_id % 7 = 0 OR user_id % 20 = 0 THEN ' ' ELSE event_type END AS text FROM events")


@query(f"SELECT page, avg(conf) FILTER (conf <> -1 AND trim(text) <> '') AS mean_conf FROM {_OCR.sql} GROUP BY page")
def ocr_confidence(spark, d):
    return files.ocr_confidence(_OCR.df(spark, d), "page")


_FILES = Derived(
    """SELECT concat(doc_id, CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.zip' END) AS path, CASE doc_id % 4 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '504B030414' WHEN 2 THEN '255044462D' ELSE '' END AS head,
    CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 26214401 ELSE n_chars END AS length FROM documents"""
)


@query(
    f"""SELECT path, CASE WHEN length = 0 THEN 'empty' WHEN length > 26214400 THEN 'too large' WHEN starts_with(head, '255044462D') OR (starts_with(head, '504B0304') AND path LIKE '%.docx') THEN 'ok' ELSE 'unsupported' END AS verdict FROM {_FILES.sql}"""
)
def upload_verdicts(spark, d):
    return files.validate_upload(_FILES.df(spark, d).withColumn("content", F.unhex("head"))).select("path", "verdict")


_BARE = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g'),
    '(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|header|footer|nav|ul|ol|table|title)\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"""
for _old, _new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_old}', '{_new}')"


@query(rf"SELECT page_id, url, array_to_string(list_filter(list_transform(string_split({_BARE}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages")
def html_page_extract(spark, d):
    return table(spark, d, "pages").select("page_id", "url", files.html_text(F.col("html")).alias("text"))


_UUID = "concat(substr(md5(CAST(doc_id AS VARCHAR(20))), 1, 8), '-', substr(md5(CAST(doc_id AS VARCHAR(20))), 9, 4), '-4', substr(md5(CAST(doc_id AS VARCHAR(20))), 14, 3), '-8', substr(md5(CAST(doc_id AS VARCHAR(20))), 18, 3), '-', substr(md5(CAST(doc_id AS VARCHAR(20))), 21, 12))"
_LABELLED = Derived(
    f"""SELECT CASE WHEN doc_id % 5 = 0 THEN source ELSE {_UUID} END AS contract_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {_UUID} END AS clause_id, CASE doc_id % 4 WHEN 0 THEN 'Termination' WHEN 1 THEN 'Unclassified' WHEN 2 THEN lang ELSE 'Confidentiality' END AS category,
    CASE doc_id % 6 WHEN 0 THEN 'Indemnification' WHEN 1 THEN source END AS alternate_category, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS is_risky, CASE doc_id % 5 WHEN 1 THEN 'urgent' WHEN 2 THEN NULL WHEN 3 THEN 'low' ELSE 'high' END AS severity,
    CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('q', doc_id) END AS query, doc_id FROM documents"""
)
_ALLOWED = "('Confidentiality', 'Governing Law / Jurisdiction', 'Indemnification', 'Limitation of Liability', 'Termination', 'Unclassified')"


@query(
    f"""SELECT doc_id, concat_ws('; ', CASE WHEN NOT regexp_matches(contract_id, '^[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}$') THEN 'contract_id: not a uuid' END, CASE WHEN clause_id IS NULL THEN 'clause_id: not a uuid' END,
    CASE WHEN category NOT IN {_ALLOWED} THEN 'category: not allowed' END, CASE WHEN alternate_category NOT IN {_ALLOWED} THEN 'alternate_category: not allowed' END,
    CASE WHEN is_risky IS NULL THEN 'is_risky: missing' END, CASE WHEN coalesce(severity, '') NOT IN ('low', 'medium', 'high') THEN 'severity: not allowed' END, CASE WHEN query = '' THEN 'query: empty' END) AS errors FROM {_LABELLED.sql}"""
)
def labelled_source_errors(spark, d):
    return json_source.validate_labelled(_LABELLED.df(spark, d)).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT doc_id, left(sha256(text), 12) AS ref FROM documents")
def content_refs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_ref(F.col("text")).alias("ref"))


_GROUND = Derived("SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' ELSE concat(event_id % 5, ',', user_id % 7, ',', event_id % 3, ',', event_id % 5) END AS cited, concat(event_id % 4, ',', event_id % 6, ',', user_id % 9) AS retrieved FROM events")


@query(f"SELECT id, array_to_string(list_filter(string_split(cited, ','), lambda x: NOT list_contains(string_split(retrieved, ','), x) AND x <> ''), ',') AS ungrounded FROM {_GROUND.sql}")
def grounding_check(spark, d):
    cited = F.filter(F.split("cited", ","), lambda x: x != "")
    return _GROUND.df(spark, d).select("id", F.array_join(assess.ungrounded(cited, F.split("retrieved", ",")), ",").alias("ungrounded"))


_CALLED = f"""r AS (SELECT *, CASE WHEN code = 200 THEN 'ok' WHEN code = 429 THEN CASE WHEN coalesce(TRY_CAST(retry_after AS DOUBLE) >= 90, false) THEN 'exhausted' ELSE 'rate_limited' END WHEN code = 503 THEN 'unavailable' ELSE 'failed' END AS reason FROM {ATTEMPTS.sql}),
    calls AS (SELECT id, min(n) AS n_calls, arg_min(CASE WHEN reason IN ('rate_limited', 'unavailable') THEN 'failed' ELSE reason END, n) AS outcome FROM r WHERE reason IN ('ok', 'exhausted', 'failed') OR n = 3 GROUP BY id)"""


@query(
    f"""WITH e AS (SELECT *, {_ERROR} AS error FROM {ATTEMPTS.sql} WHERE n <= 2)
    SELECT id, coalesce(arg_min(CASE WHEN error IS NULL THEN raw->>'$.severity' END, n) FILTER (error IS NULL), 'needs_manual_review') AS severity, max(error) FILTER (n = 1) AS first_error FROM e GROUP BY id"""
)
def validation_reduce(spark, d):
    return assess.reduce_validation(ATTEMPTS.df(spark, d), "id").select("id", "severity", "first_error")


@query(f"WITH {_CALLED} SELECT id, outcome, CAST(n_calls AS BIGINT) AS n_calls FROM calls")
def retry_reduce(spark, d):
    return assess.reduce_calls(ATTEMPTS.df(spark, d), "id")


@query(
    f"""WITH {_CALLED} SELECT id, coalesce(bool_or(outcome = 'exhausted') OVER (PARTITION BY id % 50 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM calls"""
)
def breaker_of_calls(spark, d):
    """Fifty runs of calls: only a long wait opens a run's breaker, not retries that are used up."""
    done = assess.reduce_calls(ATTEMPTS.df(spark, d), "id").withColumn("run", F.col("id") % 50)
    return assess.circuit_breaker(done, "run", "id", tripped=F.col("outcome") == "exhausted").select("id", "skipped")


_SUGGESTIONS = Derived("SELECT event_id - event_id % 3 AS id, CAST(event_id % 3 + 1 AS INTEGER) AS n, concat(event_id % 4, ',', user_id % 3) AS cited, concat(user_id % 5, ',', event_id % 6, ',', event_id % 4) AS retrieved, event_id % 9 = 0 AS failed FROM events")
_SUGGESTED = f"""t AS (SELECT id, n, CASE WHEN failed THEN 'failed' WHEN len(list_filter(string_split(cited, ','), lambda x: NOT list_contains(string_split(retrieved, ','), x))) = 0 THEN 'grounded' END AS kind FROM {_SUGGESTIONS.sql} WHERE n <= 2),
    sug AS (SELECT id, coalesce(arg_min(kind, n) FILTER (kind IS NOT NULL), 'needs_manual_review') AS status, CAST(coalesce(min(n) FILTER (kind IS NOT NULL), max(n)) AS BIGINT) AS n FROM t GROUP BY id)"""


def _suggestions(spark, d):
    s = _SUGGESTIONS.df(spark, d)
    return s.withColumn("cited", F.split("cited", ",")).withColumn("retrieved", F.split("retrieved", ","))


@query(f"WITH {_SUGGESTED} SELECT id, status, n FROM sug")
def suggestion_reduce(spark, d):
    return assess.reduce_suggestions(_suggestions(spark, d), "id")


@query(
    f"""WITH {_CALLED}, {_SUGGESTED}, c AS (SELECT DISTINCT id, id % 12 = 0 AS skipped FROM {ATTEMPTS.sql}), live AS (SELECT c.id, outcome, n_calls FROM c JOIN calls USING (id) WHERE NOT skipped),
    e AS (SELECT id, n, {_ERROR} AS error, CASE WHEN {_ERROR} IS NULL THEN raw->>'$.severity' END AS severity FROM {ATTEMPTS.sql} SEMI JOIN (SELECT id FROM live WHERE outcome = 'ok') USING (id) WHERE n <= 2),
    o AS (SELECT a.id, a.n, a.error, a.severity, b.error AS first FROM e a JOIN e b ON a.id = b.id AND b.n = 1 WHERE a.n = 1 OR b.error IS NOT NULL),
    ev AS (SELECT id, 0 AS phase, r.n AS pos, CASE WHEN r.n < n_calls THEN 'api_error_retry' WHEN outcome <> 'ok' THEN 'api_error_failed' END AS event_type FROM r JOIN live USING (id) WHERE r.n <= n_calls
      UNION ALL SELECT id, 1, n * 2, CASE WHEN error IS NOT NULL THEN 'validation_failure' WHEN n > 1 THEN 'validation_retry_success' END FROM o
      UNION ALL SELECT id, 1, 5, 'validation_needs_manual_review' FROM o WHERE n = 2 AND error IS NOT NULL
      UNION ALL SELECT id, 2, 0, 'final_flag_decision' FROM c
      UNION ALL SELECT id, 3, 0, CASE status WHEN 'failed' THEN 'grounding_error' WHEN 'needs_manual_review' THEN 'grounding_failure' END FROM sug SEMI JOIN (SELECT id FROM o WHERE severity IN ('high', 'medium')) USING (id))
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY phase, pos) - 1 AS seq, event_type FROM ev WHERE event_type IS NOT NULL"""
)
def audit_trail(spark, d):
    tries = ATTEMPTS.df(spark, d)
    clauses = tries.select("id", (F.col("id") % 12 == 0).alias("skipped")).distinct()
    return assess.audit_events(clauses, tries.select("id", "n", "code", "retry_after"), tries.select("id", "n", "raw"), _suggestions(spark, d), "id")


@query(
    r"""WITH f AS (SELECT source, CASE WHEN regexp_matches(lower(text), '\b(unlimited|sole discretion|irrevocabl[ye]|waives? all)\b') THEN 'high' WHEN regexp_matches(lower(text), '\b(indemnif|liab|terminat|penalt)') THEN 'medium' ELSE 'low' END AS severity FROM documents)
    SELECT source, count(*) AS persisted, count(*) AS indexed, count(*) FILTER (severity IN ('low', 'medium', 'high')) AS flagged, CAST(0 AS BIGINT) AS failed FROM f GROUP BY source"""
)
def assess_documents(spark, d):
    """The offline assessor's outputs over every document, validated and summarised per source."""
    from ..operators import providers

    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    flags = assess.reduce_validation(providers.assess(docs).withColumn("n", F.lit(1)), "doc_id")
    return assess.run_summary(flags.join(docs.select("doc_id", "source"), "doc_id"), "source")


@query("SELECT d.doc_id, l.quality = 1 AS actual, sha256(d.text) AS sha FROM documents d JOIN labels l USING (doc_id)")
def labelled_text_join(spark, d):
    j = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return j.select("doc_id", (F.col("quality") == 1).alias("actual"), F.sha2("text", 256).alias("sha"))
