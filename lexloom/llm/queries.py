"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, quality
from .centroids import op12_centroids
from .chat import op2_chat
from .decontaminate import op5_decontaminate
from .fim import op11_fill_in_middle
from .lattice_lm import op3_lattice_lm
from .line_dedup import op4_line_dedup
from .mixing import op6_mixing
from .quality import op1_quality
from .repeats import op13_suffix_dedup
from .secrets import op9_secrets
from .shards import op8_token_shards
from .simhash import op7_simhash
from .toxicity import op10_toxicity


_GAP = r"[\x20\x09-\x0D]+"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _n(pattern: str) -> str:
    return f"(length(bare) - length(regexp_replace(bare, '{pattern}', '', 'g')))"


_QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, trim(line, {_BLANKS}) AS bare FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT doc_id, line, length(bare) AS size, bare <> '' AND (
    10 * {_n(quality._SYMBOL)} >= length(regexp_replace(bare, '{_GAP}', '', 'g')) AND {_n(quality._SYMBOL)} > 0
    OR {_n(quality._SEPARATOR)} >= 3 AND len(string_split_regex(bare, '{_GAP}')) <= 4 * {_n(quality._SEPARATOR)} + 3
    OR {_n("!")} >= 3 AND 2 * {_n("!")} >= len(string_split_regex(bare, '{_GAP}'))
    OR NOT regexp_matches(bare, '{quality._END.replace("'", "''")}') AND len(string_split_regex(bare, '{_GAP}')) <= 3 AND NOT regexp_matches(bare, '{quality._ITEM}') AND NOT regexp_matches(bare, '{quality._UNSPACED}')
    OR regexp_matches(bare, '{quality.phrase_pattern(quality.PHRASES)}')) AS fails FROM l),
s AS (SELECT doc_id, CAST(sum(CASE WHEN fails THEN size ELSE 0 END) AS BIGINT) AS lost_chars, CAST(sum(size) AS BIGINT) AS line_chars, count(*) FILTER (size > 0) - count(DISTINCT line) FILTER (size > 0) AS n_dup_lines FROM j GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '{quality._SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars, line_chars FROM d JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * line_chars AS kept FROM f"""

_CHAT = rf"""WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS said FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, name, said) - 1 AS pos FROM t),
p AS (SELECT DISTINCT conv_id AS c, name AS perspective FROM t WHERE name <> 'system'),
x AS (SELECT conv_id, perspective, pos // 64 AS chunk, pos, name = perspective AS own, said || '<|end|>' || chr(10) AS body,
    '<|start|>' || CASE WHEN name = perspective THEN 'assistant' WHEN name = 'system' THEN name ELSE 'user name=' || name END || chr(10) AS head FROM k JOIN p ON conv_id IS NOT DISTINCT FROM c),
y AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY pos) AS BIGINT) AS done FROM x)
SELECT conv_id, perspective, chunk, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || body, '' ORDER BY pos) AS rendered,
    coalesce(string_agg(CAST(done - length(body) AS VARCHAR) || ':' || CAST(done - 1 AS VARCHAR), ',' ORDER BY pos) FILTER (own), '') AS mask FROM y GROUP BY conv_id, perspective, chunk"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINES = f"""WITH l AS (SELECT doc_id, k, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, r.key IS NULL OR l.doc_id = r.first AS stays FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (stays), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

_NORMAL = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BENCH = f"""WITH b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark), d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)"""

_MIX = rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len({_WORDS.format("text")}), 0) AS BIGINT) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
lev AS (SELECT arg_min(level, cap / weight) AS level FROM s2 WHERE cap >= weight * level),
s3 AS (SELECT source, source_size, CAST(least(cap, coalesce(weight * (SELECT level FROM lev), cap)) AS DOUBLE) AS target FROM s2),
s4 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM s3),
j AS (SELECT d.doc_id, d.size, d.k, s4.source_size, s4.target, s4.copies, CAST(floor(s4.target) AS BIGINT) - s4.copies * s4.source_size AS need, d.source FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k) AS upto, sum(size) OVER (PARTITION BY source, k) AS n FROM j)
SELECT doc_id, size, source_size, target, CAST(copies * size + CASE WHEN upto <= need THEN size WHEN upto - n > need OR n = 0 THEN 0 ELSE size * (need - upto + n) // n END AS BIGINT) AS taken FROM c"""


_FIM = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, '<P>' || substr(t, 1, a) AS p, '<M>' || substr(t, a + 1, b - a) AS m, '<S>' || substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _elkan() -> str:
    """Plain rounds: all distances (exact in doubles: the integers are small), then means."""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
    """c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x AS m FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 40))"""]
    for r in range(6):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT k, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d, c)) AS best
    FROM (SELECT k, vec_id, x, c, CAST(list_dot_product(x, x) - 2 * list_dot_product(x, m) + list_dot_product(m, m) AS BIGINT) AS d FROM (SELECT *, row_number() OVER () AS k FROM v) CROSS JOIN c{r}) GROUP BY k)""")
        if r < 5:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM c{r} LEFT JOIN (SELECT c, list(s ORDER BY i) AS n FROM (SELECT best.c AS c, i, floor(sum(x[i]) / count(*)) AS s FROM a{r}, range(1, 65) AS g(i) GROUP BY best.c, i) GROUP BY c) AS new USING (c))""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM a5 JOIN c5 ON best.c = c5.c"""


_ELKAN = _elkan()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_chat, op3_lattice_lm, op4_line_dedup, op5_decontaminate, op6_mixing, op7_simhash, op8_token_shards, op9_secrets, op10_toxicity, op11_fill_in_middle, op12_centroids, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": _QUALITY, "op2_chat": _CHAT, "op4_line_dedup": _LINES, "op5_decontaminate": _BENCH, "op6_mixing": _MIX, "op11_fill_in_middle": _FIM, "op12_centroids": _ELKAN}
