"""DuckDB SQL for the queries of ``queries``, built from common table expressions of the same names."""

from __future__ import annotations

from . import oracle_samples as expected
from .operators.stats import COUNTERS
from .queries import ORDER_THRESHOLD, SUB_THRESHOLD, THRESHOLD

NODES = """
  line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS l FROM documents),
  toks AS (SELECT doc_id, l, list_filter(string_split(line, ' '), lambda x: x <> '') AS ts FROM line),
  leaf AS (SELECT doc_id, l, j, tok, l + 1 + row_number() OVER (PARTITION BY doc_id ORDER BY l, j) AS pos, regexp_full_match(tok, '[0-9]+') AS is_int
           FROM (SELECT doc_id, l, unnest(ts) AS tok, unnest(range(len(ts))) AS j FROM toks)),
  firsts AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, is_int, tok) AS first FROM leaf),
  numbered AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, is_int ORDER BY first) - 1 AS idx FROM firsts),
  node AS (
    SELECT doc_id, 0 AS pos, -1 AS parent, 0 AS depth, -1 AS l, 0 AS child_idx, 'Block' AS disc, '' AS data, count(*) AS n_children FROM toks GROUP BY doc_id
    UNION ALL SELECT doc_id, 1 + l + coalesce(sum(len(ts)) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0, 1, l, l, 'Block', '', len(ts) FROM toks
    UNION ALL SELECT doc_id, pos, pos - j - 1, 2, l, j, CASE WHEN is_int THEN 'Literal' ELSE 'Placeholder' END, CASE WHEN is_int THEN 'Int' ELSE 'Variable#' || idx END, 0 FROM numbered)"""

UNITS = (
    NODES
    + """,
  tree AS (SELECT doc_id, substr(md5('None::0#' || string_agg(disc || ':' || data || ':' || n_children, '|' ORDER BY pos)), 1, 16) AS fingerprint, count(*) AS n FROM node GROUP BY doc_id),
  unit AS (SELECT doc_id AS unit_id, lang AS kind, 'doc ' || doc_id AS name, concat(source, '/', doc_id, '.', lang) AS file, 1 AS line_start, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS line_end,
           fingerprint, n AS node_count, coalesce(toxic, 0) = 1 AS is_test FROM documents JOIN tree USING (doc_id) LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))"""
)

LINES = (
    NODES
    + """,
  lf AS (SELECT doc_id, l, pos, disc, data, child_idx, n_children, depth, min(pos) OVER (PARTITION BY doc_id, l, disc, data) AS first FROM node WHERE l >= 0),
  ln AS (SELECT doc_id, l, pos, disc, n_children, depth, CASE WHEN depth = 1 THEN 0 ELSE child_idx END AS child_idx, dense_rank() OVER (PARTITION BY doc_id, l, disc ORDER BY first) - 1 AS idx, data AS old FROM lf),
  lnode AS (SELECT doc_id, l, pos, depth, child_idx, disc, n_children, idx, CASE WHEN disc = 'Placeholder' THEN 'Variable#' || idx ELSE old END AS data FROM ln),
  ltree AS (SELECT doc_id, l, substr(md5(string_agg(disc || ':' || data || ':' || n_children, '|' ORDER BY pos)), 1, 16) AS fingerprint, count(*) AS n FROM lnode GROUP BY doc_id, l HAVING count(*) >= 5),
  sub AS (SELECT row_number() OVER (ORDER BY doc_id, l) - 1 AS unit_id, doc_id, l, 'block' AS kind, 'line ' || (l + 1) AS name, concat(source, '/', doc_id, '.', lang) AS file, 1 AS line_start,
          length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS line_end, fingerprint, n AS node_count, 'doc ' || doc_id AS parent_name FROM ltree JOIN documents USING (doc_id))"""
)

EXACT = """,
  sized AS (SELECT fingerprint, count(*) AS n_members FROM unit GROUP BY fingerprint HAVING count(*) > 1),
  exact AS (SELECT fingerprint, 1.0::DOUBLE AS similarity, n_members, list(unit_id ORDER BY unit_id) AS members, sum(greatest(line_end - line_start, 0) + 1) AS lines FROM unit JOIN sized USING (fingerprint) GROUP BY ALL)"""

PAIRS = """,
  cand AS (SELECT *, CASE WHEN node_count > 0 THEN floor(log2(node_count))::INT ELSE 0 END AS bucket FROM unit WHERE fingerprint NOT IN (SELECT fingerprint FROM sized)),
  key AS (SELECT doc_id AS unit_id, (depth, l, child_idx, disc, data) AS k FROM node JOIN cand ON unit_id = doc_id),
  pair AS (SELECT a, b, 2.0::DOUBLE * m / (x.node_count + y.node_count) AS score FROM (SELECT p.unit_id AS a, q.unit_id AS b, count(*) AS m FROM key p JOIN key q ON p.k = q.k AND p.unit_id < q.unit_id GROUP BY ALL)
           JOIN cand x ON x.unit_id = a JOIN cand y ON y.unit_id = b WHERE x.kind = y.kind AND x.bucket = y.bucket AND 2.0::DOUBLE * m / (x.node_count + y.node_count) >= {t})"""

NEAR = (
    PAIRS
    + """,
  edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
  reach AS (SELECT a AS x, a AS y FROM edge UNION SELECT r.x, e.b FROM reach r JOIN edge e ON e.a = r.y),
  part AS (SELECT x AS unit_id, min(y) AS component FROM reach GROUP BY x),
  least AS (SELECT component, min(score) AS similarity FROM pair JOIN part ON unit_id = a GROUP BY component),
  near AS (SELECT {composite} AS fingerprint, similarity, count(*) AS n_members, list(unit_id ORDER BY unit_id) AS members,
           sum(greatest(line_end - line_start, 0) + 1) AS lines FROM unit JOIN part USING (unit_id) JOIN least USING (component) GROUP BY component, similarity)"""
)

COMPOSITE = "substr(md5(count(*)::VARCHAR || ',' || sum(('0x' || fingerprint)::UBIGINT)::VARCHAR), 1, 16)"
TEXT_NEAR = NEAR.format(t=f"{THRESHOLD}::DOUBLE", composite=COMPOSITE)

IGNORED = """,
  ignored AS (SELECT DISTINCT fingerprint, 'starts with ' || substr(fingerprint, 1, 1) AS reason FROM unit WHERE fingerprint < '4' UNION ALL SELECT 'no hex', NULL),
  live AS (SELECT fingerprint FROM exact UNION SELECT fingerprint FROM near)"""

# lines: the same expressions over sub-units
_LINE_UNITS = LINES + ",\n  unit AS (SELECT * FROM sub)"
_LINE_PAIRS = NEAR.replace("key AS (SELECT doc_id AS unit_id, (depth, l, child_idx, disc, data) AS k FROM node JOIN cand ON unit_id = doc_id)", "key AS (SELECT unit_id, (lnode.depth, lnode.child_idx, disc, data) AS k FROM lnode JOIN cand ON cand.doc_id = lnode.doc_id AND cand.l = lnode.l)").format(t=f"{SUB_THRESHOLD}::DOUBLE", composite=COMPOSITE)

TOTALS = """
SELECT total_code_units, total_lines, exact_duplicate_groups, exact_duplicate_units, near_duplicate_groups, near_duplicate_units, exact_duplicate_lines, near_duplicate_lines, sub_exact_groups, sub_exact_units, sub_near_groups, sub_near_units,
  CASE WHEN total_lines = 0 THEN 0 ELSE exact_duplicate_lines / total_lines::DOUBLE * 100.0::DOUBLE END AS exact_duplicate_percent, CASE WHEN total_lines = 0 THEN 0 ELSE near_duplicate_lines / total_lines::DOUBLE * 100.0::DOUBLE END AS near_duplicate_percent
FROM (SELECT count(*) AS total_code_units, coalesce(sum(greatest(line_end - line_start, 0) + 1), 0)::BIGINT AS total_lines FROM {units}),
  (SELECT count(*) AS exact_duplicate_groups, coalesce(sum(n_members), 0)::BIGINT AS exact_duplicate_units, coalesce(sum(lines), 0)::BIGINT AS exact_duplicate_lines FROM exact),
  (SELECT count(*) AS near_duplicate_groups, coalesce(sum(n_members), 0)::BIGINT AS near_duplicate_units, coalesce(sum(lines), 0)::BIGINT AS near_duplicate_lines FROM near),
  {sub}"""
_NO_SUB = "(SELECT 0::BIGINT AS sub_exact_groups, 0::BIGINT AS sub_exact_units, 0::BIGINT AS sub_near_groups, 0::BIGINT AS sub_near_units)"
STATS = f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR} {TOTALS.format(units='unit', sub=_NO_SUB)}"

_SUB_CTES = (
    (_LINE_UNITS + EXACT + _LINE_PAIRS)
    .removeprefix(NODES)
    .replace("unit AS (", "sunit AS (", 1)
    .replace("FROM unit", "FROM sunit").replace("sized", "ssized").replace("  exact AS", "  sexact AS").replace("cand", "scand").replace("key", "skey").replace("pair", "spair").replace("edge", "sedge").replace("reach", "sreach").replace("part", "spart").replace("least AS", "sleast AS").replace("JOIN least", "JOIN sleast").replace("  near AS", "  snear AS")
)
STATS_SUB = f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR}{_SUB_CTES} " + TOTALS.format(units="unit", sub="(SELECT count(*) AS sub_exact_groups, coalesce(sum(n_members), 0)::BIGINT AS sub_exact_units FROM sexact), (SELECT count(*) AS sub_near_groups, coalesce(sum(n_members), 0)::BIGINT AS sub_near_units FROM snear)")

ORDERS = """
  item AS (SELECT l_orderkey AS unit_id, coalesce(l_returnflag, '') || coalesce(l_linestatus, '') AS data, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, coalesce(l_returnflag, '') || coalesce(l_linestatus, '')) - 1 AS i FROM lineitem),
  unit AS (SELECT unit_id, 'order' AS kind, count(*) AS line_end, count(*) + 1 AS node_count, substr(md5('None::0#Block::' || count(*) || '|' || string_agg('Item:' || data || ':0', '|' ORDER BY i)), 1, 16) AS fingerprint FROM item GROUP BY unit_id)"""

_ORDER_PAIRS = PAIRS.replace("key AS (SELECT doc_id AS unit_id, (depth, l, child_idx, disc, data) AS k FROM node JOIN cand ON unit_id = doc_id)", "key AS (SELECT unit_id, (i, data) AS k FROM item JOIN cand USING (unit_id) UNION ALL SELECT unit_id, (-1, '') FROM cand)").format(t=f"{ORDER_THRESHOLD}::DOUBLE")
_ORDER_SIZED = ",\n  sized AS (SELECT fingerprint FROM unit GROUP BY fingerprint HAVING count(*) > 1)"

_MEMBER = "{'name': name, 'kind': kind, 'file': file, 'line_start': line_start, 'line_end': line_end}"

_STATS_FIELDS = (*COUNTERS[:8], "exact_duplicate_percent", "near_duplicate_percent", *COUNTERS[8:])
_ALIKE_VALUE = "', similarity: ' || round_even(similarity * 100, 0)::BIGINT || '%'"
_ALIKE = _ALIKE_VALUE + " || "
_TEXT_ROWS = "SELECT ordinal, 'Group ' || ordinal || ' (fingerprint: ' || m.fingerprint || {alike}', ' || n_members || ' members):' AS header, '  - ' || name || ' (' || kind || ')' || {parent}' at ' || file || ':' || line_start || '-' || line_end AS line FROM m JOIN {units} USING (unit_id)"

SQL = {
    "scan_exclude_paths": r"""SELECT page_id, url, lower(regexp_extract(url, '[^/.][^/]*\.([^./]+)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(url, '[^/.][^/]*\.([^./]+)$', 1)) IN ('html', 'com') AND NOT contains(url, '/de/') AND NOT contains(url, 'blog.')""",
    "language_counts": "SELECT lang, count(*) AS files FROM documents GROUP BY lang",
    "language_detect": "SELECT * FROM (VALUES ('rust', 'rust'), ('python', 'python'), ('both', 'AmbiguousLanguage'), ('neither', 'NoRecognizedFiles'), ('empty', 'NoRecognizedFiles')) AS t(name, outcome)",
    "units_text": f"WITH {UNITS} SELECT unit_id, kind, name, file, line_start, line_end, fingerprint, node_count, node_count AS body_count, is_test FROM unit WHERE node_count >= 10 AND line_end - line_start + 1 >= 2",
    "units_orders": f"WITH {ORDERS} SELECT unit_id, fingerprint, node_count, line_end FROM unit",
    "text_tree_nodes": f"WITH {NODES} SELECT doc_id AS unit_id, depth, count(*) AS nodes, sum(pos)::BIGINT AS pos_sum, sum(parent)::BIGINT AS parent_sum, sum(child_idx)::BIGINT AS child_sum, sum(n_children)::BIGINT AS children FROM node GROUP BY ALL",
    "placeholder_index": "SELECT conv_id, name, first, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS index FROM (SELECT conv_id, role AS name, min(turn) AS first FROM conversations WHERE text IS NOT NULL GROUP BY ALL)",
    "reindexed_subtree": f"WITH {LINES} SELECT doc_id AS unit_id, l AS line_no, count(*) AS nodes, coalesce(max(idx) FILTER (disc = 'Placeholder'), -1) AS last_index, coalesce(sum(idx) FILTER (disc = 'Placeholder'), 0)::BIGINT AS index_sum FROM lnode GROUP BY ALL",
    "fingerprints": f"WITH {UNITS} SELECT unit_id, fingerprint FROM unit",
    "fingerprint_parse": r"""WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN printf('%X', event_id) WHEN 1 THEN '+00' || printf('%x', event_id) ELSE event_type END AS text FROM events)
SELECT event_id, CASE WHEN regexp_full_match(text, '[+]?0*[0-9A-Fa-f]{1,16}') THEN lpad(lower(ltrim(ltrim(text, '+'), '0')), 16, '0') END AS fingerprint FROM t""",
    "composite_fingerprint": f"WITH {UNITS} SELECT split_part(file, '/', 1) AS source, {COMPOSITE} AS fingerprint FROM unit GROUP BY 1",
    "exact_groups_text": f"WITH {UNITS}{EXACT} SELECT ordinal, fingerprint, similarity, n_members, unnest(members) AS unit_id FROM (SELECT *, row_number() OVER (ORDER BY n_members DESC, similarity DESC, fingerprint) AS ordinal FROM exact)",
    "exact_groups_orders": f"WITH {ORDERS} SELECT fingerprint, count(*) AS n_members, min(unit_id) AS first_unit FROM unit GROUP BY fingerprint HAVING count(*) > 1",
    "exact_members_text": f"WITH {UNITS}{EXACT} SELECT fingerprint, n_members, unit_id, name, file FROM unit JOIN sized USING (fingerprint)",
    "size_buckets": f"WITH {UNITS}{EXACT}{PAIRS.format(t=1)} SELECT kind, bucket, count(*) AS units, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM cand GROUP BY ALL",
    "near_candidates_text": f"WITH {UNITS}{EXACT} SELECT unit_id, fingerprint FROM unit WHERE fingerprint NOT IN (SELECT fingerprint FROM sized)",
    "dice_pairs_text": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR} SELECT a, b, score FROM pair",
    "dice_pairs_orders": f"WITH {ORDERS}{_ORDER_SIZED}{_ORDER_PAIRS} SELECT a, b, score FROM pair",
    "near_components_text": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR} SELECT unit_id, component FROM part",
    "near_groups_text": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR} SELECT fingerprint, similarity, n_members, unnest(members) AS unit_id FROM near",
    "near_members_text": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR} SELECT component, similarity, unit_id, name FROM unit JOIN part USING (unit_id) JOIN least USING (component)",
    "tests_excluded": f"WITH {UNITS} SELECT unit_id, fingerprint FROM unit WHERE unit_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "sub_units": f"WITH {LINES} SELECT unit_id, kind, name, file, fingerprint, node_count, parent_name FROM sub",
    "sub_exact_groups": f"WITH {LINES} SELECT fingerprint, count(*) AS n_members, min(unit_id) AS first_unit FROM sub GROUP BY fingerprint HAVING count(*) > 1",
    "sub_near_groups": f"WITH RECURSIVE {_LINE_UNITS}{EXACT}{_LINE_PAIRS} SELECT fingerprint, similarity, n_members, unnest(members) AS unit_id FROM near",
    "live_fingerprints_text": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR} SELECT fingerprint FROM exact UNION SELECT fingerprint FROM near",
    "ignore_filter": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR}{IGNORED} SELECT * FROM (SELECT 'exact' AS section, fingerprint, n_members FROM exact UNION ALL SELECT 'near', fingerprint, n_members FROM near) WHERE fingerprint NOT IN (SELECT fingerprint FROM ignored)",
    "ignore_stale": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR}{IGNORED} SELECT fingerprint, reason FROM ignored WHERE fingerprint NOT IN (SELECT fingerprint FROM live)",
    "ignore_live": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR}{IGNORED} SELECT fingerprint, reason FROM ignored WHERE fingerprint IN (SELECT fingerprint FROM live)",
    "ignore_upsert": f"WITH {UNITS}, old AS (SELECT DISTINCT fingerprint, 'starts with ' || substr(fingerprint, 1, 1) AS reason FROM unit WHERE fingerprint < '4' UNION ALL SELECT 'no hex', NULL) SELECT fingerprint, reason FROM old UNION ALL SELECT DISTINCT fingerprint, 'new' FROM unit WHERE fingerprint < '8' AND fingerprint NOT IN (SELECT fingerprint FROM old)",
    "stats_text": STATS,
    "stats_with_sub": STATS_SUB,
    "stats_rollup": f"WITH {UNITS} SELECT coalesce(kind, 'all') AS kind, coalesce(test, 'all') AS test, count(*) AS units, sum(greatest(line_end - line_start, 0) + 1)::BIGINT AS lines FROM (SELECT *, is_test::VARCHAR AS test FROM unit) GROUP BY ROLLUP (kind, test)",
    "check_limits_text": f"WITH s AS ({STATS}) SELECT limit_name, maximum, actual, actual > maximum AS failed FROM (SELECT 'max_exact' AS limit_name, 1000.0::DOUBLE AS maximum, exact_duplicate_groups::DOUBLE AS actual FROM s UNION ALL SELECT 'max_near', 0, near_duplicate_groups FROM s UNION ALL SELECT 'max_exact_percent', 5, exact_duplicate_percent FROM s UNION ALL SELECT 'max_near_percent', 99, near_duplicate_percent FROM s)",
    "group_ordinals": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR} SELECT section, row_number() OVER (PARTITION BY section ORDER BY n_members DESC, similarity DESC, fingerprint) AS ordinal, fingerprint, n_members, similarity FROM (SELECT 'exact' AS section, * FROM exact UNION ALL SELECT 'near', * FROM near)",
    "report_json_rows": f"WITH {UNITS}{EXACT} SELECT fingerprint, to_json({{'fingerprint': fingerprint, 'similarity': 1.0::DOUBLE, 'members': list({_MEMBER} ORDER BY unit_id)}})::VARCHAR AS json FROM unit JOIN sized USING (fingerprint) GROUP BY fingerprint",
    "report_json_near": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR}, shown AS (SELECT near.fingerprint, similarity, unnest(members) AS unit_id FROM near) SELECT fingerprint, to_json({{'fingerprint': shown.fingerprint, 'similarity': similarity, 'members': list({_MEMBER} ORDER BY unit_id)}})::VARCHAR AS json FROM shown JOIN (SELECT * EXCLUDE (fingerprint) FROM unit) USING (unit_id) GROUP BY shown.fingerprint, similarity",
    "report_json_stats": f"WITH s AS ({STATS}) SELECT '{{' || string_agg('\"' || name || '\":' || value, ',' ORDER BY i) || '}}' AS json FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS name, {c}::VARCHAR AS value FROM s" + (f" WHERE {c} > 0" if c.startswith("sub") else "") for i, c in enumerate(_STATS_FIELDS))
    + ")",
    "report_text_rows": f"WITH {UNITS}{EXACT}, g AS (SELECT *, row_number() OVER (ORDER BY n_members DESC, fingerprint) AS ordinal FROM exact), m AS (SELECT ordinal, fingerprint, n_members, similarity, unnest(members) AS unit_id FROM g) {_TEXT_ROWS.format(alike='', parent='', units='unit')}",
    "report_text_near": f"WITH RECURSIVE {UNITS}{EXACT}{TEXT_NEAR}, g AS (SELECT *, row_number() OVER (ORDER BY n_members DESC, similarity DESC, fingerprint) AS ordinal FROM near), m AS (SELECT ordinal, fingerprint, n_members, similarity, unnest(members) AS unit_id FROM g) {_TEXT_ROWS.format(alike=_ALIKE, parent='', units='unit')}",
    "report_text_sub": f"WITH RECURSIVE {_LINE_UNITS}{EXACT}{_LINE_PAIRS}, g AS (SELECT 'sub_exact' AS section, fingerprint, similarity, n_members, members, row_number() OVER (ORDER BY n_members DESC, fingerprint) AS ordinal FROM exact UNION ALL SELECT 'sub_near', fingerprint, similarity, n_members, members, row_number() OVER (ORDER BY n_members DESC, similarity DESC, fingerprint) FROM near), m AS (SELECT section, ordinal, fingerprint, n_members, similarity, unnest(members) AS unit_id FROM g) "
    + _TEXT_ROWS.format(alike=f"CASE section WHEN 'sub_near' THEN {_ALIKE_VALUE} ELSE '' END || ", parent="' in ' || parent_name || ", units="unit").replace("SELECT ordinal", "SELECT section, ordinal", 1),
    "python_units": expected.units_sql("PYTHON", expected.PYTHON),
    "rust_units": expected.units_sql("RUST", expected.RUST),
    "mapped_units": expected.units_sql("BRACES", expected.BRACES),
    **{name: expected.printed_sql(name) for name in expected.PRINTED},
    "config_precedence": """SELECT * FROM (VALUES ('defaults', 10, 0.9::DOUBLE, '', NULL, 0, FALSE, FALSE, 5), ('metadata', 15, 0.9, 'a', NULL, 0, FALSE, FALSE, 5), ('file over metadata', 25, 1.0, '', NULL, 3, FALSE, FALSE, 5),
  ('overrides', 5, 0.9, 'x,y,z', NULL, 0, TRUE, FALSE, 5), ('ill-typed file', 10, 0.9, '', 2, 0, FALSE, FALSE, 5), ('malformed files', 10, 0.9, '', NULL, 0, FALSE, TRUE, 7))
  AS t(name, min_nodes, similarity_threshold, exclude, max_exact_duplicates, min_lines, exclude_tests, sub_function, min_sub_nodes)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
