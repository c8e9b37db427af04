"""The filter audit and the risk-controlled rules in SQL."""

from __future__ import annotations

from riskweave.llm import audit, cutoffs


def audit_sql() -> str:
    orders = ", ".join(f"'{x}'" for x in audit.ORDERS)
    bit = "(1 << (ascii(filter_order[step]) - 65))"
    before = "list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))"
    return f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{audit.WORD}') AS ws FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < {audit.LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {audit.LEAST_DISTINCT} * len(ws) THEN 2 ELSE 0 END
 + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {audit.MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '{audit.SYMBOLS}') THEN 8 ELSE 0 END
 + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT unnest([{orders}]) AS filter_order), s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
b AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST({bit} AS BIGINT) AS bit, CAST(coalesce({before}, 0) AS BIGINT) AS before FROM s),
x AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
 CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND toxic), 0) AS BIGINT) AS toxic_lost
 FROM c CROSS JOIN b GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x"""


def rules_sql() -> str:
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    word, w = audit.WORD, cutoffs.WINDOW
    fails = lambda rule, c: f"CAST({rule.over} AS DOUBLE) {'<' if rule.less else '>'} CAST({c!r} AS DOUBLE) * CAST({rule.base} AS DOUBLE)"
    steps = "[" + ", ".join(f"{{'rule': {r}, 'cutoff': {c}, 'hit': {fails(cutoffs.RULES[r], cutoffs.RULES[r].cutoffs[c])}}}" for r, c in cutoffs.STEPS) + "]"
    names = "CASE rule " + " ".join(f"WHEN {r} THEN '{rule.name}'" for r, rule in enumerate(cutoffs.RULES)) + " END"
    tail = f"list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN i < n THEN lgamma(n - i + 1) ELSE 0 END + i * ln({cutoffs.RISK}) + (n - i) * ln(1 - {cutoffs.RISK}))))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
v AS (SELECT rid, i, list_aggregate(ws[i:i + {w - 1}], 'string_agg', ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM d) AS x),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times FROM v) AS x WHERE times > 1),
p AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {w})) AS pos FROM r) AS x GROUP BY rid),
m AS (SELECT rid, doc_id, stratum, md5(t) AS key, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '{audit.BREAK}', '', 'g')) AS word_chars, {count(cutoffs.SYMBOLS)} AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(ws)) AS n_distinct, {count(cutoffs.CAPITALS)} AS n_capitals, {count(cutoffs.MARKS)} AS n_marks
 FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d) AS y LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < {cutoffs.LEAST_WORDS} OR 100 * n_repeat_words > {cutoffs.MOST_REPEATED} * n_words AS base_failed FROM m),
l AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
h AS (SELECT rid, stratum, unnest({steps}, recursive := true) FROM b WHERE NOT base_failed),
e AS (SELECT stratum, key, bool_or(good) AS good, key < '8' AS guide, min(rid) AS rid FROM b JOIN l USING (doc_id) WHERE NOT base_failed GROUP BY stratum, key),
g AS (SELECT e.stratum, rule, cutoff, count(*) FILTER (e.good) AS goods, count(*) FILTER (NOT e.good) AS bads, count(*) FILTER (e.good AND hit) AS good_hits, count(*) FILTER (NOT e.good AND hit) AS bad_hits FROM e JOIN h USING (rid) WHERE guide GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule, cutoff) AS place FROM (SELECT *, (bad_hits / bads) / ((good_hits + 1) / (goods + 1)) AS gain FROM g WHERE bad_hits > 0) AS x WHERE gain >= {cutoffs.LEAST_GAIN}),
a AS (SELECT rid, min(place) AS place FROM h JOIN q USING (stratum, rule, cutoff) WHERE hit GROUP BY rid),
t AS (SELECT stratum, count(*) AS n FROM e WHERE good AND NOT guide AND stratum IN (SELECT stratum FROM e WHERE guide) GROUP BY stratum),
k AS (SELECT q.stratum, q.place, any_value(t.n) AS n, count(a.place) AS k FROM q JOIN t USING (stratum) LEFT JOIN (SELECT e.stratum, a.place FROM e JOIN a USING (rid) WHERE good AND NOT guide) AS a ON a.stratum = q.stratum AND a.place <= q.place GROUP BY q.stratum, q.place),
z AS (SELECT stratum, max(place) AS passed FROM (SELECT stratum, place, bool_and({tail} <= {cutoffs.LEVEL} / (SELECT count(*) FROM t)) OVER (PARTITION BY stratum ORDER BY place) AS holds FROM k) AS x WHERE holds GROUP BY stratum)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(a.place <= z.passed, false) AS kept, CASE WHEN a.place <= z.passed THEN {names} END AS rule
 FROM b LEFT JOIN a USING (rid) LEFT JOIN z ON z.stratum = b.stratum LEFT JOIN q ON q.stratum = b.stratum AND q.place = a.place"""
