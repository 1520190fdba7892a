"""DuckDB SQL of the catalog's queries."""

from __future__ import annotations

from ..functions.text import LIFECYCLE_TERMS, ROUTINE_TERMS

EV = r"""ev AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn + 1 AS INTEGER) AS source_line, role, text AS content,
      conv_id || '-msg-' || lpad(CAST(turn + 1 AS VARCHAR), 6, '0') AS id FROM conversations)"""
MSG = EV + r""", msg AS (SELECT session_id, id, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS actor, regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS content, source_line
      FROM ev WHERE role IN ('user', 'assistant') AND regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') <> '')"""
LOG = r"""lg AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS source_line, event_type, props FROM events),
ne AS (SELECT *, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'file_change' WHEN 'purchase' THEN 'metadata' WHEN 'error' THEN 'parse_error' ELSE 'unknown' END AS kind FROM lg)"""
INV = r"""inv AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn + 1 AS INTEGER) AS n, 'SEC-' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') AS section_id,
      'SEC-' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') || ':D-001' AS k, regexp_extract(text, '^[^.]*') AS title, text AS decision, role, conv_id || ':' || (turn // 2) AS ref, turn,
      CASE role WHEN 'user' THEN 'proposed' WHEN 'assistant' THEN 'accepted' ELSE 'unknown' END AS status, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END AS conf FROM conversations)"""


def _norm(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _grams(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN CAST([] AS VARCHAR[]) WHEN len({x}) <= 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, CAST(len({x}) - 1 AS BIGINT)), lambda i: {x}[i:i + 2])) END"


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


_CHANGE = " OR ".join(f"contains(lower(a.title || a.decision || b.title || b.decision), '{t}')" for t in LIFECYCLE_TERMS)
_TECH = r"list_distinct(list_transform(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9_.:/\\-]{2,}|\p{Nd}+(?:\.\p{Nd}+)+'), lambda t: lower(t)))"
PAIRS = INV + rf""", f0 AS (SELECT *, {_norm('title')} AS t, {_norm('decision')} AS d, {_norm("title || ' ' || decision")} AS c, title || ' ' || decision AS x FROM inv),
f AS (SELECT *, {_grams('t')} AS tg, {_grams('d')} AS dg, {_grams('c')} AS cg, {_TECH} AS terms FROM f0),
pr AS (SELECT a.session_id, a.k AS lk, b.k AS rk, a.status AS ls, b.status AS rs, b.n - a.n AS dist, {_dice('a.tg', 'b.tg')} AS t, {_dice('a.dg', 'b.dg')} AS d, {_dice('a.cg', 'b.cg')} AS c,
      CASE WHEN a.ref = b.ref THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e, len(list_intersect(a.terms, b.terms)) AS tt,
      (a.status <> b.status AND a.status <> 'unknown' AND b.status <> 'unknown') OR {_CHANGE} AS life
      FROM f a JOIN f b ON a.session_id = b.session_id AND a.n < b.n),
sc AS (SELECT *, round(0.36::DOUBLE * t + 0.34::DOUBLE * d + 0.12::DOUBLE * c + 0.12::DOUBLE * e + 0.03::DOUBLE * (CASE WHEN dist = 1 THEN 1.0::DOUBLE WHEN dist = 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS s FROM pr),
cand AS (SELECT *, s >= 0.38 OR t >= 0.68 OR d >= 0.65 OR (e >= 0.34 AND c >= 0.28) OR (life AND dist <= 2 AND (c >= 0.16 OR tt >= 3)) OR (tt >= 2 AND t >= 0.62 AND c >= 0.18) AS strong,
      array_to_string(list_filter([CASE WHEN t >= 0.62 THEN 'similar_title' END, CASE WHEN d >= 0.60 THEN 'similar_decision_text' END, CASE WHEN c >= 0.48 THEN 'similar_combined_text' END,
      CASE WHEN e > 0 THEN 'shared_evidence' END, CASE WHEN dist <= 2 THEN 'nearby_sections' END, CASE WHEN life THEN 'possible_lifecycle_signal' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sc
      WHERE s >= 0.34 OR t >= 0.62 OR d >= 0.60 OR c >= 0.48 OR (e > 0 AND c >= 0.18) OR (life AND c >= 0.28))"""
def pairs_of(together: int) -> str:
    """The same with several conversations to a session."""
    n = f"CAST(conv_id % {together} * 8 + turn + 1 AS INTEGER)"
    return PAIRS.replace("CAST(conv_id AS VARCHAR) AS session_id", f"CAST(conv_id // {together} AS VARCHAR) AS session_id").replace("CAST(turn + 1 AS INTEGER) AS n", f"{n} AS n").replace("lpad(CAST(turn + 1 AS VARCHAR), 3, '0')", f"lpad(CAST({n} AS VARCHAR), 3, '0')")


PAIRS_4 = pairs_of(4)
#: Ranked pairs are walked one by one; ends holds both ends of those kept.
CAPPED = "WITH RECURSIVE " + PAIRS_4 + r""", rn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, lk, rk) AS i FROM cand),
wk AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ends FROM rn UNION ALL
      SELECT wk.session_id, rn.i, CASE WHEN len(list_filter(ends, lambda x: x = lk)) < 8 AND len(list_filter(ends, lambda x: x = rk)) < 8 THEN list_concat(ends, [lk, rk]) ELSE ends END FROM wk JOIN rn ON rn.session_id = wk.session_id AND rn.i = wk.i + 1),
kept AS MATERIALIZED (SELECT rn.* FROM wk JOIN wk p ON p.session_id = wk.session_id AND p.i = wk.i - 1 JOIN rn ON rn.session_id = wk.session_id AND rn.i = wk.i WHERE len(wk.ends) > len(p.ends))"""
#: Edges are walked strong ones first; roots holds each node's cluster, of twelve members at most.
CLUSTERS = CAPPED + r""", nd AS (SELECT session_id, list(k ORDER BY k) AS nodes FROM (SELECT session_id, lk AS k FROM kept UNION SELECT session_id, rk FROM kept) GROUP BY 1),
re AS MATERIALIZED (SELECT kept.*, nodes, row_number() OVER (PARTITION BY session_id ORDER BY strong DESC, s DESC, lk, rk) AS j FROM kept JOIN nd USING (session_id)),
un AS (SELECT session_id, CAST(0 AS BIGINT) AS j, nodes AS roots FROM nd UNION ALL
      SELECT u.session_id, j, CASE WHEN a <> b AND len(list_filter(roots, lambda x: x = a OR x = b)) <= 12 THEN list_transform(roots, lambda x: CASE WHEN x = b THEN a ELSE x END) ELSE roots END
      FROM (SELECT un.session_id, re.j, roots, roots[list_position(nodes, lk)] AS a, roots[list_position(nodes, rk)] AS b FROM un JOIN re ON re.session_id = un.session_id AND re.j = un.j + 1) u),
fin AS (SELECT session_id, arg_max(roots, j) AS roots FROM un GROUP BY 1),
root AS MATERIALIZED (SELECT session_id, unnest(nodes) AS k, unnest(roots) AS r FROM fin JOIN nd USING (session_id)),
mm AS (SELECT root.session_id, r, root.k, n AS sec, section_id, status, title, decision, ref, terms FROM root JOIN f ON f.session_id = root.session_id AND f.k = root.k),
mem AS (SELECT session_id, r, list(k ORDER BY k) AS ks, string_agg(section_id, ',' ORDER BY sec) AS secs, count(DISTINCT status) AS st, count(*) AS n,
      bool_and(""" + " OR ".join(f"contains(lower(title || ' ' || decision), '{t}')" for t in ROUTINE_TERMS) + r""") AS routine FROM mm GROUP BY 1, 2 HAVING count(*) > 1),
inp AS (SELECT kept.*, a.r FROM kept JOIN root a ON a.session_id = kept.session_id AND a.k = lk JOIN root b ON b.session_id = kept.session_id AND b.k = rk WHERE a.r = b.r),
inn AS (SELECT session_id, r, bool_or(life) AS life, bool_or(strong) AS strong, count(*) AS np FROM inp GROUP BY 1, 2),
why AS (SELECT session_id, r, string_agg(x, ',' ORDER BY x) AS why FROM (SELECT DISTINCT session_id, r, unnest(string_split(reasons, ',')) AS x FROM inp) WHERE x <> '' GROUP BY 1, 2),
tms AS (SELECT session_id, r, array_to_string(list_sort(list(x))[1:20], ',') AS tms FROM (SELECT mm.session_id, mm.r, x FROM (SELECT session_id, r, unnest(terms) AS x FROM mm) mm JOIN mem USING (session_id, r) GROUP BY mm.session_id, mm.r, x, mem.n HAVING count(*) = mem.n) GROUP BY 1, 2),
evs AS (SELECT mm.session_id, mm.r, any_value(ref) AS evs FROM mm JOIN mem USING (session_id, r) GROUP BY mm.session_id, mm.r HAVING count(DISTINCT ref) = 1),
cl AS (SELECT session_id, 'CLUSTER-' || substr(sha256(array_to_string(ks, chr(10))), 1, 12) AS cluster_id, ks, secs, mem.n, np, routine, strong, st > 1 OR life AS life, coalesce(why, '') AS why, coalesce(tms, '') AS tms, coalesce(evs, '') AS evs
      FROM mem JOIN inn USING (session_id, r) LEFT JOIN why USING (session_id, r) LEFT JOIN tms USING (session_id, r) LEFT JOIN evs USING (session_id, r))"""
ITEMS = r"""it AS (SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INTEGER) AS pos, 'D-' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') AS decision_id, role = 'user' AND turn > 0 AS scalar, role, text, turn,
      role = 'assistant' AND turn >= 5 AS unknown, conv_id || ':' || turn AS ref FROM conversations),
er AS (SELECT *, CASE WHEN trim(coalesce(role, '')) = '' OR trim(coalesce(text, '')) = '' THEN 'requires non-empty id, title, and decision' WHEN role NOT IN ('user', 'assistant') THEN 'confidence is invalid' WHEN turn = 0 THEN 'has no evidence' END AS late FROM it),
sp AS (SELECT *, CASE WHEN late IS NOT NULL THEN late WHEN unknown THEN 'unknown evidence: message:' || ref END AS error FROM er)"""
STATES = ITEMS + r""", ss AS (SELECT doc, count(*) FILTER (error IS NULL) AS kept, count(*) FILTER (error IS NOT NULL) AS rejected, count(*) FILTER (error IS NULL AND scalar) AS repairs FROM sp GROUP BY doc),
st AS (SELECT doc, true AS has_output, true AS root_ok, true AS hash_matches, kept, rejected, repairs, CASE WHEN rejected > 0 AND kept = 0 THEN 'invalid' WHEN rejected > 0 THEN 'partially_valid' ELSE 'valid' END AS state FROM ss)"""
RELS = INV + r""", lf AS (SELECT session_id, n AS pos, k AS src, 'SEC-' || lpad(CAST(n - 1 AS VARCHAR), 3, '0') || ':D-001' AS dst, CASE WHEN n % 4 = 2 THEN 'accepted' ELSE 'superseded' END AS st FROM inv WHERE role = 'assistant' AND n > 1),
up AS (SELECT session_id, k, arg_max(st, o) AS status FROM (SELECT session_id, dst AS k, st, pos * 2 AS o FROM lf UNION ALL SELECT session_id, src, 'accepted', pos * 2 + 1 FROM lf) GROUP BY session_id, k),
sm AS (SELECT session_id, arg_min(k, n) AS a, arg_max(k, n) AS b FROM inv WHERE role = 'user' GROUP BY session_id HAVING count(*) > 1),
gr AS (SELECT inv.*, CASE WHEN sm.a IS NOT NULL THEN sm.a || chr(10) || sm.b ELSE inv.k END AS g, sm.a IS NOT NULL AS merged FROM inv LEFT JOIN sm ON inv.session_id = sm.session_id AND inv.k IN (sm.a, sm.b)),
kp AS (SELECT gr.*, up.status AS new_status FROM gr LEFT JOIN up ON gr.session_id = up.session_id AND gr.k = up.k WHERE role <> 'system'),
al AS (SELECT session_id, g, string_agg(role, ',' ORDER BY m) AS alternatives FROM (SELECT session_id, g, role, min(n) AS m FROM kp GROUP BY ALL) GROUP BY 1, 2),
ra AS (SELECT session_id, g, string_agg(x, ',' ORDER BY m) AS rationale FROM (SELECT session_id, g, 'turn ' || (turn % 2) AS x, min(n) AS m FROM kp GROUP BY ALL) GROUP BY 1, 2),
rl AS (SELECT session_id, g, string_agg(DISTINCT r, ',' ORDER BY r) AS relations FROM (
      SELECT kp.session_id, g, 'lifecycle_relation' AS r FROM kp JOIN lf ON kp.session_id = lf.session_id AND kp.k IN (lf.src, lf.dst) UNION SELECT session_id, g, 'same_decision' FROM kp WHERE merged) GROUP BY 1, 2),
mk AS (SELECT session_id, g, min(n) AS first, arg_max(k, n) AS canonical_key, arg_max(title, n) AS title, coalesce(arg_max(new_status, k) FILTER (new_status IS NOT NULL), arg_max(status, n)) AS status,
      CASE min(conf) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, string_agg(k, ',' ORDER BY k) AS source_keys, count(DISTINCT ref) AS n_refs, string_agg(k || '=' || status, ',' ORDER BY k) AS statuses FROM kp GROUP BY session_id, g),
asm AS (SELECT mk.session_id, 'ID-' || lpad(CAST(row_number() OVER (PARTITION BY mk.session_id ORDER BY first) AS VARCHAR), 3, '0') AS decision_id, canonical_key, title, status, confidence, alternatives, rationale, source_keys,
      coalesce(relations, '') AS relations, n_refs, statuses FROM mk JOIN al USING (session_id, g) JOIN ra USING (session_id, g) LEFT JOIN rl USING (session_id, g))"""
# The catalog's Latin rules.
RULES = (("request_candidate", "(?:and the|und der|et la|y la)"), ("acceptance_candidate", "(?:of the|of a|de la)"), ("rejection_candidate", "(?:not|nicht|pas)"),
         ("uncertainty_candidate", "(?:th[ae]t?|ist)"), ("alternative_candidate", r"(?:or|oder)\s"), ("reason_candidate", r"(?:for|from|by)\s"))
_COUNTS = ", ".join(f"len(regexp_extract_all(content, '{p}')) AS {t}" for t, p in RULES)
SIG = MSG + f", sg AS (SELECT session_id, id, actor, source_line, {_COUNTS} FROM msg)"
_ANY = " + ".join(t for t, _ in RULES)
_SUMS = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t, _ in RULES)
_TYPES = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {t} > 0 THEN '{t}' END" for t, _ in RULES) + "], lambda x: x IS NOT NULL)), ',')"
_HITS = " UNION ALL ".join(
    f"SELECT id AS evidence_id, '{t}' AS type, unnest(regexp_extract_all(content, '{p}')) AS trigger, unnest(range(1, CAST(len(regexp_extract_all(content, '{p}')) + 1 AS BIGINT))) AS i, regexp_extract_all(content, '{p}') AS m, string_split_regex(content, '{p}') AS g FROM msg" for t, p in RULES)

SQL = {
    "prj02_classify": f"""WITH {LOG} SELECT session_id || CASE kind WHEN 'message' THEN '-msg-' ELSE '-evt-' END || lpad(CAST(source_line AS VARCHAR), 6, '0') AS id, session_id, source_line,
        CASE event_type WHEN 'view' THEN 'response_item' WHEN 'click' THEN 'event_msg' WHEN 'purchase' THEN 'turn_context' WHEN 'error' THEN NULL ELSE 'new_future_event' END AS source_event_type, kind,
        CASE kind WHEN 'message' THEN 'user' END AS role, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN props WHEN 'purchase' THEN 'turn_context:purchase' END AS content FROM ne""",
    "prj10_projection": f"WITH {MSG} SELECT session_id, id, actor, content, source_line FROM msg",
    "prj12_strip_blocks": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script(?:\s[^>]*)?>.*?</script>', '', 'gis'), '<style(?:\s[^>]*)?>.*?</style>', '', 'gis'), '<nav(?:\s[^>]*)?>.*?</nav>', '', 'gis') AS t FROM pages)
        SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM p""",
    "prj19_repair": f"""WITH {ITEMS} SELECT doc, pos, CASE WHEN scalar THEN 'risks' ELSE '' END AS repaired, CASE WHEN scalar THEN '["late"]' ELSE '[]' END AS risks FROM it""",
    "prj20_partial_acceptance": f"WITH {ITEMS} SELECT doc, pos, decision_id, error FROM sp",
    "prj22_section_states": f"WITH {STATES} SELECT * FROM st",
    "agg06_run_summary": f"""WITH {STATES} SELECT count(*) AS sections, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'partially_valid') AS partially_valid, count(*) FILTER (state = 'invalid') AS invalid,
        count(*) FILTER (state = 'missing') AS missing, CAST(sum(kept) AS BIGINT) AS decisions, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(repairs) AS BIGINT) AS repairs, bool_and(hash_matches) AS all_hashes_match,
        bool_and(state IN ('valid', 'partially_valid')) AS complete FROM st""",
    "val01_violations": f"WITH {ITEMS} SELECT doc, pos, decision_id, CASE WHEN scalar THEN 'risks must contain strings' ELSE late END AS error FROM er",
    "jon03_missing_evidence": "SELECT DISTINCT 'd' AS doc, 'message' AS evidence_type, CAST(doc_id AS VARCHAR) AS evidence_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "jon10_asof_section": """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2), e AS (SELECT user_id, ts, event_id AS error_id FROM events WHERE event_type = 'error')
        SELECT e.user_id, error_id, view_id FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "jon11_similar_pairs": f"WITH {PAIRS} SELECT session_id, lk AS left_decision_key, rk AS right_decision_key, t AS title_similarity, d AS decision_similarity, c AS combined_similarity, e AS evidence_similarity, s AS candidate_score, strong AS strong_cluster_candidate, reasons FROM cand",
    "jon11_large_sessions": f"WITH {pairs_of(40)} SELECT session_id, lk AS left_decision_key, rk AS right_decision_key, t AS title_similarity, d AS decision_similarity, c AS combined_similarity, s AS candidate_score, strong AS strong_cluster_candidate FROM cand",
    "srt04_capped_pairs": f"{CAPPED} SELECT session_id, lk AS left_decision_key, rk AS right_decision_key, s AS candidate_score FROM kept",
    "grf01_clusters": f"""{CLUSTERS} SELECT session_id, cluster_id, array_to_string(ks, ',') AS members, CASE WHEN routine OR NOT strong THEN 'uncertain' WHEN life THEN 'possible_lifecycle_relation' ELSE 'possible_same_decision' END AS candidate_relation,
        CASE WHEN life OR n >= 6 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS review_priority, np AS candidate_pair_count, n - 1 AS selected_edge_count, why AS candidate_reasons, tms AS shared_terms, evs AS shared_evidence, secs AS section_ids FROM cl""",
    "agg07_evaluation": f"""{CLUSTERS}, tot AS (SELECT session_id, count(*) AS n, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pp FROM inv GROUP BY 1), cp AS (SELECT session_id, count(*) AS np FROM kept GROUP BY 1),
        rv AS (SELECT session_id, len(nodes) AS nr FROM nd), cc AS (SELECT session_id, count(*) AS nc, CAST(sum(n) AS BIGINT) AS nm, max(n) AS big FROM cl GROUP BY 1), sz AS (SELECT session_id, string_agg(z || ':' || x, ',' ORDER BY z) AS sizes FROM (SELECT session_id, n::VARCHAR AS z, count(*) AS x FROM cl GROUP BY 1, 2) GROUP BY 1)
        SELECT tot.session_id, n AS inventory_decision_count, pp AS possible_cross_section_pair_count, coalesce(np, 0) AS candidate_pair_count, coalesce(nr, 0) AS ai_review_decision_count, coalesce(nc, 0) AS candidate_cluster_count, coalesce(nm, 0) AS clustered_decision_count,
        coalesce(nr, 0) - coalesce(nm, 0) AS pair_only_review_decision_count, n - coalesce(nm, 0) AS singleton_count, coalesce(nm, 0) - coalesce(nc, 0) AS selected_cluster_edge_count, CASE WHEN pp = 0 THEN 0.0::DOUBLE ELSE round(1 - coalesce(np, 0)::DOUBLE / pp, 6) END AS pair_comparison_reduction_rate,
        round(1 - coalesce(nr, 0)::DOUBLE / n, 6) AS ai_review_decision_reduction_rate, coalesce(big, 0) AS largest_cluster_size, sizes FROM tot LEFT JOIN cp USING (session_id) LEFT JOIN rv USING (session_id) LEFT JOIN cc USING (session_id) LEFT JOIN sz USING (session_id)""",
    "grf04_priority": "SELECT o_custkey, CASE WHEN max(o_totalprice) > 400000 OR count(*) >= 6 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS priority FROM orders GROUP BY 1",
    "jon14_context_window": f"WITH {INV} SELECT a.session_id, a.section_id, b.section_id AS context_section_id FROM inv a JOIN inv b ON a.session_id = b.session_id AND b.n BETWEEN a.n AND a.n + 2",
    "jon15_status_updates": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "jon15_lifecycle_status": f"WITH {RELS} SELECT session_id, k AS source_decision_key, status FROM up",
    "agg11_assembled": f"WITH {RELS} SELECT * FROM asm",
    "agg09_assembly_summary": f"""WITH {RELS}, a AS (SELECT session_id, count(*) AS decisions_after FROM asm GROUP BY 1)
        SELECT inv.session_id, count(*) AS decisions_before, coalesce(any_value(decisions_after), 0) AS decisions_after, CASE WHEN any_value(sm.a) IS NULL THEN 0 ELSE 1 END AS same_decision_groups,
        CASE WHEN any_value(sm.a) IS NULL THEN 0 ELSE 2 END AS merged_source_decision_count FROM inv LEFT JOIN a USING (session_id) LEFT JOIN sm USING (session_id) GROUP BY inv.session_id""",
    "jon16_lifecycle_applied": f"""WITH {RELS}, b AS (SELECT status, CASE WHEN status = 'proposed' THEN 'cancelled' ELSE status END AS later FROM asm),
        x AS (SELECT status, count(*) AS before, 0 AS after FROM b GROUP BY 1 UNION ALL SELECT later, 0, count(*) FROM b GROUP BY 1) SELECT status, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after FROM x GROUP BY 1""",
    "agg12_shared_set": """WITH b AS (SELECT DISTINCT o_custkey, o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), s AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM b GROUP BY 1)
        SELECT o_custkey, l_partkey FROM b JOIN s USING (o_custkey) GROUP BY o_custkey, l_partkey, n HAVING count(*) = n""",
    "agg13_latest_run": """WITH r AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT o_custkey AS session_id, o_orderkey AS run_id, l_linenumber AS decision_id, l_partkey FROM r JOIN lineitem ON l_orderkey = o_orderkey""",
    "agg01_kind_counts": "SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "agg04_signal_counts": f"WITH {SIG} SELECT session_id, count(*) AS messages_examined, count(*) FILTER ({_ANY} > 0) AS messages_with_signals, {_SUMS} FROM sg GROUP BY 1",
    "agg05_signal_rollup": f"WITH {SIG} SELECT actor, count(*) AS messages_examined, count(*) FILTER ({_ANY} > 0) AS messages_with_signals, {_SUMS} FROM sg GROUP BY 1",
    "win01_neighbors": f"WITH {MSG} SELECT session_id, id AS evidence_id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM msg WINDOW w AS (PARTITION BY session_id ORDER BY source_line)",
    "win02_prev_context": f"""WITH {SIG}, ty AS (SELECT *, {_TYPES} AS types, {_ANY} > 0 AS has FROM sg), pv AS (SELECT id, has, lag(id) OVER w AS p, lag(actor) OVER w AS a, lag(types) OVER w AS t FROM ty WINDOW w AS (PARTITION BY session_id ORDER BY source_line))
        SELECT id AS evidence_id, CASE WHEN has THEN p END AS previous_id, CASE WHEN has THEN a END AS previous_actor, CASE WHEN has THEN t END AS previous_types FROM pv""",
    "win03_first_occurrence": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "sig03_phrase_hits": f"""WITH {MSG}, h AS ({_HITS}), o AS (SELECT evidence_id, type, trigger, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS INTEGER) AS char_start FROM h)
        SELECT evidence_id, type, trigger, char_start, CAST(char_start + len(trigger) AS INTEGER) AS char_end FROM o""",
    "fn02_trigrams": f"WITH d AS (SELECT doc_id, {_norm('text')} AS t FROM documents) SELECT doc_id, CAST(len({_grams('t')}) AS BIGINT) AS n_trigrams FROM d",
    "fn05_tech_terms": f"WITH d AS (SELECT doc_id, text AS x FROM documents) SELECT doc_id, CAST(len({_TECH}) AS BIGINT) AS n_terms FROM d",
    "fn12_hashes": 'SELECT doc_id, substr(sha256(text), 1, 12) AS short, sha256(text) AS "full" FROM documents',
    "fn15_percent": "SELECT printf('%.2f%%', 100.0::DOUBLE * sum(quality) / count(*)) AS share FROM labels",
    "set03_coverage": "SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)",
    "jon17_registry_conflicts": "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1",
    "snk14_markdown": f"""WITH {EV} SELECT session_id, '# Conversation' || chr(10) || chr(10) || string_agg('### ' || id || chr(10) || chr(10) || '**' || upper(role[1]) || lower(role[2:]) || '**' || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10)
        || 'Source JSONL line: ' || source_line || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY source_line) AS markdown FROM ev GROUP BY 1""",
}
