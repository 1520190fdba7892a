"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER, WORD_RE
from .decontamination import N
from .mixing import MOST, SIZE_RE, WEIGHTS

FIRST_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE}')"

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
      first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SIZE_RE}')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, length(bin(size)) AS digits, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS bucket FROM d),
k AS (SELECT *, CASE WHEN digits <= 5 THEN size ELSE 16 * digits + (size >> (digits - 5)) END AS cls FROM c),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1] AS w FROM s),
l AS (SELECT *, {MOST} * source_size AS cap,
      sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_rest
      FROM r WINDOW o AS (ORDER BY {MOST} * source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * w_rest <= rest * w AS capped, min(CASE WHEN cap * w_rest > rest * w THEN (cap / w, rk, rest, w_rest) END) OVER () AS o FROM l),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(o[3] AS DOUBLE) * w / CAST(o[4] AS DOUBLE) END AS target FROM f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
      CAST('0x' || substr(md5('42:' || coalesce('s' || source, 'n')), 1, 4) AS INTEGER) / 65536.0::DOUBLE AS off FROM t),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY cls, bucket, size, doc_id NULLS FIRST) AS DOUBLE) AS place FROM k)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(place * rate + off) - floor((place - 1) * rate + off), {MOST}) AS BIGINT) * size AS taken
FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source
"""

OP1 = rf"""
WITH d AS (SELECT doc_id, {FIRST_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {FIRST_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item_id, w, least({N}, len(w)) AS l FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, CAST(len(w) - l + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM bl),
ls AS (SELECT DISTINCT l FROM bl),
p AS (SELECT doc_id, l, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS i,
      unnest(list_transform(range(1, CAST(len(w) - l + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM d, ls WHERE len(w) >= l),
h AS (SELECT p.doc_id, p.i, p.l, g.item_id FROM p JOIN g ON p.l = g.l AND p.g = g.g),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ESCAPED = r"regexp_replace({}, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP10 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<s>' || {ESCAPED.format("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")} || chr(10) || CASE WHEN role = 'user' THEN '[INST] ' ELSE '' END
      || {ESCAPED.format("text")} || CASE WHEN role = 'user' THEN ' [/INST]' ELSE '' END || '</s>' AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

OP11 = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 50 = 0
), pos AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored ON scored.anchor_id = pos.anchor_id AND label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
