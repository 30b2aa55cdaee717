"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import CONTROL, RULES
from .quality_rules import SYMBOLS
from .url_filter import TWO_LABEL_SUFFIXES

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
WITH RECURSIVE
  w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), {WORDS}) AS ws FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
  e AS (SELECT doc_id, unnest(sh) AS g FROM s),
  n AS (SELECT doc_id, len(sh) AS n FROM s),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
  edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
  class AS (SELECT doc_id, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS class_id FROM s JOIN n USING (doc_id))
SELECT doc_id, n AS n_shingles, (SELECT min(y) FROM reach WHERE x = n.doc_id) AS component_id, class_id FROM n JOIN class USING (doc_id)
"""

OP1_LINKS = OP1.replace("AS component_id, class_id FROM", "AS component_id, class_id, (SELECT count(*) FROM edges WHERE x = n.doc_id) AS n_links FROM")

OP2 = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""


def _fit(name: str, groups: str) -> str:
    return f"""
  {name}_sums AS (SELECT count(*) AS j, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n::DOUBLE * n) AS n2, sum(k::DOUBLE * k / n) AS kk FROM {groups} WHERE n > 0),
  {name} AS (SELECT CASE WHEN n IS NULL THEN 0.5::DOUBLE WHEN k IN (0, n) THEN (k + 1) / (n + 2) WHEN n - n2 / n - (j - 1) <= 0 THEN (k + 1) / (n + 2) ELSE k / n END AS mean,
    CASE WHEN n IS NULL OR k IN (0, n) THEN 2.0::DOUBLE WHEN n - n2 / n - (j - 1) <= 0 THEN 1.0::DOUBLE
    ELSE 1 / least(greatest(((kk - k / n * k) / (k / n * (1 - k / n)) - (j - 1)) / (n - n2 / n - (j - 1)), 1e-3::DOUBLE), 0.5::DOUBLE) - 1 END AS weight FROM {name}_sums)"""


def _bound(k: str, n: str, mean: str, weight: str, z: float) -> str:
    rate = f"(({k} + {mean} * {weight}) / ({n} + {weight}))"
    return f"({rate} + ({z})::DOUBLE * sqrt({rate} * (1 - {rate}) / ({n} + {weight} + 1)))"


def _rules() -> tuple[str, str]:
    fits, rule, verdict = [], "", ""
    for action, text in sorted(RULES, key=lambda r: (-len(r[1]), -r[1].index("/"))):
        host, _, path = text.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", text, action))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in fits) + " END"
    return rule, verdict


OP3 = f"""
WITH
  rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  page AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {LOWER}) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
  label AS (SELECT host, count(*) AS n, count(*) FILTER (bad) AS k FROM (SELECT host, toxic = 1 OR quality = 0 AS bad FROM labels JOIN page ON page_id = doc_id) WHERE bad IS NOT NULL GROUP BY host),
  names AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM page),
  tree AS (SELECT host, CASE WHEN two THEN last2 ELSE l[-1] END AS suffix, CASE WHEN two THEN array_to_string(l[-3:], '.') ELSE last2 END AS domain
           FROM (SELECT host, l, array_to_string(l[-2:], '.') AS last2, len(l) > 2 AND array_to_string(l[-2:], '.') IN ({', '.join(repr(s) for s in TWO_LABEL_SUFFIXES)}) AS two FROM names)),
  level AS (SELECT tree.*, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM tree LEFT JOIN label USING (host)),
  above AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM level GROUP BY suffix),
  middle AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM level GROUP BY ALL),{_fit('fit1', 'above')},{_fit('fit2', 'middle')},{_fit('fit3', 'level')},
  suffixes AS (SELECT suffix, (k + mean * weight) / (n + weight) AS suffix_rate FROM above, fit1),
  domains AS (SELECT suffix, domain, (k + suffix_rate * weight) / (n + weight) AS domain_rate FROM middle JOIN suffixes USING (suffix), fit2),
  known AS (SELECT host, n, {_bound('k', 'n', 'domain_rate', 'weight', -0.25)} AS bound FROM level JOIN domains USING (suffix, domain), fit3)
SELECT page_id, host, path, {_rules()[0]} AS rule, coalesce({_rules()[1]}, CASE WHEN bound > (SELECT mean FROM fit1) THEN 'block' ELSE 'allow' END) AS verdict, n AS n_outcomes, round(bound, 6) AS bad_rate_bound
FROM page JOIN known USING (host)
"""

OP4 = rf"""
WITH
  w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
  win AS (SELECT doc_id, unnest([array_to_string(ws[i:i + 12], ' ') for i in range(1, len(ws) - 11)]) AS g, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
  owner AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
  gone AS (SELECT DISTINCT doc_id, i + o.j AS pos FROM win JOIN owner USING (g), (SELECT unnest(range(0, 13)) AS j) o WHERE first < doc_id),
  word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
  kept AS (SELECT doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY word.pos) FILTER (g.pos IS NULL), '') AS kept FROM word LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH
  w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
  win AS (SELECT doc_id, unnest([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) AS g, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
  rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
  repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
  line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, {WORDS}) GROUP BY doc_id),
  base AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[{SYMBOLS.decode()}]')) AS n_symbols,
           coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)),
  ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
  judged AS (SELECT *, NOT base_failed AND (100 * n_symbols > 10 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS borderline FROM ruled),
  host AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR borderline) AS k FROM judged GROUP BY source),{_fit('fit', 'host')},
  verdict AS (SELECT source, CASE WHEN {_bound('k', 'n', 'mean', 'weight', -3.0)} > 0.5 THEN 'reject' WHEN (k + mean * weight) / (n + weight) > mean * 1.01::DOUBLE THEN 'strict' ELSE 'lenient' END AS host_verdict FROM host, fit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, borderline, host_verdict, NOT base_failed AND host_verdict <> 'reject' AND NOT (borderline AND host_verdict = 'strict') AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
"""

OP8 = rf"""
WITH
  d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS size FROM documents),
  t AS (SELECT source, sum(size)::DOUBLE AS total, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
  f AS (SELECT *, 2.0 * total AS cap, coalesce(sum(2.0 * total) OVER before, 0) AS fill, (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS rest, sum(total) OVER () AS every
        FROM t WINDOW before AS (ORDER BY 2.0 * total / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  l AS (SELECT arg_min(level, fill) AS level FROM (SELECT fill, (every * 1.5 - fill) / rest AS level, cap / weight AS ratio FROM f) WHERE level <= ratio),
  g AS (SELECT source, total::BIGINT AS source_size, least(cap, level * weight)::DOUBLE AS target FROM f, l),
  r AS (SELECT doc_id, size, g.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS rank,
        ('0x' || substr(md5('0/' || CASE WHEN d.source IS NULL THEN 'null' ELSE '=' || d.source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
  c AS (SELECT *, least(floor((rank + 1) * rate + start) - floor(rank * rate + start), ceil(rate)) AS copies FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken FROM c
"""

OP10 = rf"""
WITH
  every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{CONTROL}' FROM (SELECT unnest([0, 1]) AS i)),
  t AS (SELECT *, regexp_replace(role, '<(!*)\|', '<!\1|', 'g') AS role_out, regexp_replace(text, '<(!*)\|', '<!\1|', 'g') AS out FROM every),
  o AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum(length('<|im_start|>' || role_out || '<|im_sep|>' || out || '<|im_end|>')) AS formatted_chars, list(role ORDER BY turn NULLS FIRST, role, text) AS roles FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
  regexp_full_match(array_to_string(roles, ' '), '(system )?user assistant( user assistant)*') AS valid
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op1_ngram_links": OP1_LINKS, "op2_exact_dedup": OP2, "op3_url_filter": OP3, "op4_substring_dedup": OP4, "op5_quality_rules": OP5, "op8_mixing": OP8, "op10_chat_format": OP10}
