"""The operators as queries over the given tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import audit, cutoffs, extraction, fingerprints, hosts, mixing, neardup, neighbours, packing, perplexity, quotes, toxicity, whitening
from riskweave.llm.audit_sql import audit_sql, rules_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_mix, op3_fingerprints, op4_toxicity, op5_urls, op6_extract, op7_quotes, op8_near_duplicates, op9_quality, op10_pack, op11_whiten, op12_audit, op13_rules)}


def _mix_sql() -> str:
    """The water level of the targets is that of the first source, by how soon it is full, that isn't."""
    weights, schedules = list(mixing.WEIGHTS), [list(x) for x in mixing.SCHEDULES]
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST({weights} AS DOUBLE[])[rank % {len(weights)} + 1] AS weight, CAST({schedules} AS DOUBLE[][])[rank % {len(schedules)} + 1] AS f FROM r),
q AS (SELECT *, 3.0 * source_size / weight AS full_at, coalesce(sum(3.0 * source_size) OVER before, 0) AS gone, coalesce(sum(weight) OVER before, 0) AS gone_w FROM w WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(x, n) AS level FROM (SELECT ((SELECT sum(source_size) FROM s) - gone) / ((SELECT sum(weight) FROM w) - gone_w) AS x, full_at, row_number() OVER (ORDER BY full_at, source) AS n FROM q) AS y WHERE x <= full_at),
t AS (SELECT w.*, least(3.0 * source_size, weight * coalesce(level, 1e300)) AS target FROM w CROSS JOIN l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.f, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before, CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS passes FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, CAST(floor(target - passes * source_size + 0.5) AS BIGINT) - before)) AS part, (f[1] + f[2]) / 2 / 2 AS a, (f[2] + f[3]) / 2 / 2 AS c FROM b),
u AS (SELECT *, least(before / target, 1.0) * (a + c) AS x FROM p),
v AS (SELECT *, CASE WHEN x > a THEN 1 ELSE 0 END AS i, CASE WHEN x > a THEN x - a ELSE x END AS y FROM u)
SELECT doc_id, size, source_size, target, passes * size + part AS taken, CASE WHEN size > 0 THEN passes + CASE WHEN part * 2 >= size THEN 1 ELSE 0 END ELSE 0 END AS copies,
 CASE WHEN passes * size + part > 0 THEN least(i / 2.0 + CASE WHEN y > 0 THEN 2 * y / (f[i + 1] + sqrt(greatest(f[i + 1] * f[i + 1] + 2 * (f[i + 2] - f[i + 1]) * 2 * y, 0))) ELSE 0 END, 1.0) END AS position FROM v"""


def _fingerprint_sql() -> str:
    n = len(fingerprints.SUBSETS)
    terms = f"list_filter(list_distinct(regexp_split_to_array(lower(x), '{fingerprints.TERM_BREAK}')), lambda t: t <> '')"
    drawn = " + ".join(f"CASE WHEN CAST('0x' || substr(md5('{k}:' || term), 1, 5) AS BIGINT) < {int(share * (1 << 20))} THEN {1 << k} ELSE 0 END" for k, share in enumerate(fingerprints.SUBSETS))
    sums = ", ".join(f"left(md5(string_agg(term, ' ' ORDER BY term) FILTER (subsets & {1 << k} > 0)), 16) AS p{k}" for k in range(n))
    written = "CASE WHEN coalesce(" + ", ".join(f"p{k}" for k in range(n)) + ") IS NULL THEN '=' || md5(x) ELSE concat_ws('-', " + ", ".join(f"coalesce(p{k}, '_')" for k in range(n)) + ") END"
    alike = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 ELSE len(list_filter(range(1, {n} + 1), lambda i: split_part({a}, '-', i) = split_part({b}, '-', i) AND split_part({a}, '-', i) NOT IN ('_', ''))) / len(list_filter(range(1, {n} + 1), lambda i: NOT (split_part({a}, '-', i) IN ('_', '') AND split_part({b}, '-', i) IN ('_', '')))) END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
e AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC)),
f AS (SELECT doc_id, n_chars, text, next_id, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited FROM e),
c AS (SELECT term, count(*) AS df FROM (SELECT unnest({terms}) AS term FROM (SELECT text AS x FROM d) AS y) AS z GROUP BY term),
l AS (SELECT term, {drawn} AS subsets FROM c WHERE df >= {fingerprints.LEAST_SHARE} * (SELECT count(*) FROM d) AND df <= greatest({fingerprints.MOST_SHARE} * (SELECT count(*) FROM d), 1)),
x AS (SELECT doc_id, 0 AS kind, text AS x FROM f UNION ALL SELECT doc_id, 1, edited FROM f),
s AS (SELECT doc_id, kind, {sums} FROM (SELECT doc_id, kind, unnest({terms}) AS term FROM x) AS t JOIN l USING (term) GROUP BY doc_id, kind),
p AS (SELECT doc_id, kind, {written} AS fp FROM x LEFT JOIN s USING (doc_id, kind)),
j AS (SELECT f.doc_id, f.n_chars, sha256(f.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, n.fp AS next_fp FROM f JOIN p AS a ON a.doc_id = f.doc_id AND a.kind = 0 JOIN p AS b ON b.doc_id = f.doc_id AND b.kind = 1 JOIN p AS n ON n.doc_id = f.next_id AND n.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {alike("fingerprint", "edited_fingerprint")} AS near_edited, {alike("fingerprint", "next_fp")} AS near_next FROM j"""


def _hosts_sql() -> str:
    second = ", ".join(f"'{x}'" for x in hosts.SHARED_SECOND_LEVELS)
    bare, parts = "regexp_replace(host, ':[0-9]*$', '')", "string_split(regexp_replace(host, ':[0-9]*$', ''), '.')"
    suffix = f"CASE WHEN length({parts}[-1]) = 2 AND {parts}[-2] IN ({second}) THEN {parts}[-2] || '.' || {parts}[-1] ELSE {parts}[-1] END"
    before = f"string_split(left({bare}, greatest(length({bare}) - length(suffix) - 1, 0)), '.')[-1]"
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    rules = sorted(hosts.RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules) + " END"

    def level(groups: str, name: str) -> str:
        """Prior pages and posterior of a level whose rows have n, good and mean."""
        rho = "(sum(pow(good - n * mean, 2)) - sum(n * mean * (1 - mean))) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0)"
        pages = f"CASE WHEN count(*) < 3 OR {rho} IS NULL THEN {hosts.PRIOR_PAGES} WHEN {rho} <= 1 / ({hosts.MOST_PRIOR_PAGES} + 1) THEN {hosts.MOST_PRIOR_PAGES} ELSE greatest(1 / least({rho}, 0.99) - 1, 0.01) END"
        return f"{name}_s AS (SELECT {pages} AS pages FROM {groups} WHERE n > 0), {name} AS (SELECT *, pages * mean + good AS alpha, pages * (1 - mean) + n - good AS beta FROM {groups} CROSS JOIN {name}_s)"

    mean = "alpha / (alpha + beta)"
    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, CAST(floor(avg(quality) + 0.5) AS INTEGER) AS g FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(g) AS n, coalesce(sum(g), 0) AS good, {suffix} AS suffix FROM u LEFT JOIN l USING (page_id) GROUP BY host),
h AS (SELECT host, n, good, suffix, CASE WHEN coalesce({before}, '') <> '' THEN {before} || '.' || suffix ELSE suffix END AS domain FROM h0),
a AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (coalesce(sum(good), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM h) AS mean FROM h GROUP BY suffix),
{level("a", "sa")},
b AS (SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.good) AS good, any_value(sa.alpha / (sa.alpha + sa.beta)) AS mean FROM h JOIN sa USING (suffix) GROUP BY h.domain, h.suffix),
{level("b", "sb")},
c AS (SELECT h.host, h.n, h.good, sb.alpha / (sb.alpha + sb.beta) AS mean FROM h JOIN sb ON h.domain = sb.domain AND h.suffix = sb.suffix),
{level("c", "sc")},
v AS (SELECT u.page_id, u.host, u.path, {mean} + {hosts.BOUND_SD} * sqrt(alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1))) AS bound, {rule.replace("host", "u.host").replace("path", "u.path")} AS rule FROM u JOIN sc ON u.host = sc.host)
SELECT page_id, host, path, rule, coalesce({said}, CASE WHEN bound < {hosts.LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict FROM v"""


ORACLES: dict[str, str] = {"op2_mix": _mix_sql(), "op3_fingerprints": _fingerprint_sql(), "op5_urls": _hosts_sql(), "op12_audit": audit_sql(), "op13_rules": rules_sql()}
