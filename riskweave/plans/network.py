"""Queries of traces and sockets planted over order lines, and of tools and their pins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from riskweave import corpora
from riskweave.corpora import pick, pick_sql, text_sql
from riskweave.operators import network as ops
from riskweave.operators import pins
from riskweave.plans import detection as d
from riskweave.rules import catalog as c

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HOSTS = ["8.8.8.8", "10.1.2.3", "172.31.0.1", "172.32.0.1", "192.168.7.7", "169.254.169.254", "127.0.0.1", "2001:db8::1", "host.example", "256.1.1.1"]
PORTS = ["53", "80", "443", "8080"]
_K = "(l_orderkey * 7 + l_linenumber)"
CALLS = ["connect(3, {sa_family=AF_INET, sin_port=htons(", "sendto(4, buf, 10, 0, {sa_family=AF_INET, sin_port=htons(", "connect(5, {sa_family=AF_INET6, sin6_port=htons(", "write(1, "]
ADDRESSES = ['), sin_addr=inet_addr("', '), sin_addr=inet_addr("', '), sin6_addr=inet_pton(AF_INET6, "', '", "']


def trace_lines(spark, sf_dir):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    line = F.concat(pick(CALLS, k), pick(PORTS, F.floor(k / 3)), pick(ADDRESSES, k), pick(HOSTS, F.floor(k / 5)), F.lit('")}, 16) = 0'))
    return corpora.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("srv"), (F.col("l_suppkey") % 9).cast("string")).alias("target"), F.concat(F.lit("tool"), F.col("l_suppkey").cast("string")).alias("tool_name"), line.alias("line"))


_KEYS = "'srv' || CAST(l_suppkey % 9 AS VARCHAR) AS target, 'tool' || CAST(l_suppkey AS VARCHAR) AS tool_name"
TRACE = f"(SELECT {_KEYS}, {pick_sql(CALLS, _K)} || {pick_sql(PORTS, f'{_K} // 3')} || {pick_sql(ADDRESSES, _K)} || {pick_sql(HOSTS, f'{_K} // 5')} || '\")}}, 16) = 0' AS line FROM lineitem)"
_P = lambda i: f"CASE WHEN regexp_matches(line, {text_sql(ops.CONNECT)}) THEN regexp_extract(line, {text_sql(ops.CONNECT)}, {i}) ELSE regexp_extract(line, {text_sql(ops.SENDTO)}, {i}) END"
EVENTS = f"""(SELECT target, tool_name, CASE WHEN port = '53' THEN 'dns' WHEN regexp_matches(line, {text_sql(ops.CONNECT)}) THEN 'tcp' ELSE 'udp' END AS type, CASE WHEN contains(host, ':') THEN '[' || host || ']:' || port ELSE host || ':' || port END AS destination
FROM (SELECT *, {_P(2)} AS port, {_P(3)} AS host FROM {TRACE} AS t) AS p WHERE port <> '')"""


def events(spark, sf_dir):
    return ops.parse_trace(trace_lines(spark, sf_dir))


@query(f"SELECT target, count(*) AS lines, count(*) FILTER (line LIKE '%htons(%') AS calls FROM {TRACE} AS t GROUP BY target")
def read_trace_lines(spark, sf_dir):
    return trace_lines(spark, sf_dir).groupBy("target").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.contains("line", F.lit("htons("))).alias("calls"))


@query(f"SELECT * FROM {EVENTS} AS e")
def parse_trace(spark, sf_dir):
    return events(spark, sf_dir)


HOST = "CASE WHEN starts_with(destination, '[') THEN regexp_extract(destination, '^[[]([^]]*)[]]', 1) ELSE split_part(destination, ':', 1) END"
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = lambda h: f"CASE WHEN regexp_full_match({h}, '{_OCT}([.]{_OCT}){{3}}') THEN CAST(split_part({h}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({h}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({h}, '.', 3) AS BIGINT) * 256 + CAST(split_part({h}, '.', 4) AS BIGINT) END"
PRIVATE = lambda ip: "coalesce(" + " OR ".join(f"{ip} BETWEEN {a} AND {b}" for a, b in map(ops.block, c.PRIVATE_BLOCKS)) + ", FALSE)"
HOSTED = f"(SELECT *, {IP('host')} AS ip FROM (SELECT *, {HOST} AS host FROM {EVENTS} AS e) AS h)"


@query(f"SELECT target, tool_name, destination, host, ip FROM {HOSTED} AS h")
def ip_to_long(spark, sf_dir):
    h = ops.host_of(F.col("destination"))
    return events(spark, sf_dir).select("target", "tool_name", "destination", h.alias("host"), ops.ip_to_long(h).alias("ip"))


@query(f"SELECT target, tool_name, destination, host, regexp_extract(destination, ':([0-9]*)$', 1) AS port FROM {HOSTED} AS h")
def host_port(spark, sf_dir):
    return events(spark, sf_dir).select("target", "tool_name", "destination", F.explode(F.array(ops.host_port(F.col("destination")))).alias("p")).select("target", "tool_name", "destination", "p.host", "p.port")


@query(f"SELECT target, tool_name, destination, {PRIVATE('ip')} AS private FROM {HOSTED} AS h")
def connection_cidr_join(spark, sf_dir):
    return events(spark, sf_dir).select("target", "tool_name", "destination", ops.in_private_block(ops.ip_to_long(ops.host_of(F.col("destination")))).alias("private"))


CONNECTIONS = f"""(SELECT target, CASE WHEN type = 'dns' THEN 'net-probe-dns-query' WHEN NOT addr THEN 'net-probe-outbound-connection' WHEN host = '{c.METADATA_ADDRESS}' THEN 'net-probe-metadata-service' WHEN {PRIVATE('ip')} THEN 'net-probe-private-ip' ELSE 'net-probe-outbound-connection' END AS rule,
 CASE WHEN type = 'dns' THEN 1 WHEN addr AND host = '{c.METADATA_ADDRESS}' THEN 3 ELSE 2 END AS severity,
 CASE WHEN type = 'dns' THEN 'Tool made DNS query to ' || destination WHEN NOT addr THEN 'Tool made outbound ' || upper(type) || ' connection to ' || destination WHEN host = '{c.METADATA_ADDRESS}' THEN 'Tool connected to cloud metadata service at ' || destination
  WHEN {PRIVATE('ip')} THEN 'Tool connected to private/RFC1918 address ' || destination || ' (possible SSRF)' ELSE 'Tool made outbound ' || upper(type) || ' connection to public IP ' || destination END AS message, tool_name AS tool
 FROM (SELECT *, ip IS NOT NULL OR contains(host, ':') AS addr FROM {HOSTED} AS h) AS k)"""


@query(f"SELECT * FROM {CONNECTIONS} AS c")
def classify_connections(spark, sf_dir):
    return ops.classify(events(spark, sf_dir))


RAW = ["0101007F:0035", "0100000A:01BB", "FEA9FEA9:0050", "B80D0120000000000000000001000000:0050", "zz00007F:0035", "0101007F", "00000000000000000000000000000000:0016"]
DECODED = ["127.0.1.1:53", "10.0.0.1:443", "169.254.169.254:80", "[2001:db8::1]:80", None, None, "[::]:22"]
STATES = ["01", "01", "0A"]


def socket_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    line = F.when(k % 10 == 0, "  sl  local_address rem_address   st").otherwise(F.concat(F.lit("  "), k.cast("string"), F.lit(": 0100007F:1F90 "), pick(RAW, k), F.lit("  "), pick(STATES, F.floor(k / 2)), F.lit(" 0")))
    return corpora.table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), (k % 30).cast("string")).alias("target"), F.when((F.floor(k / 30) % 2 == 0) & (k % 30 < 20), "before").otherwise("after").alias("phase"), (k % 10 + 1).cast("int").alias("line_no"), line.alias("line"))


SOCKETS = f"(SELECT 't' || CAST(o_orderkey % 30 AS VARCHAR) AS target, CASE WHEN (o_orderkey // 30) % 2 = 0 AND o_orderkey % 30 < 20 THEN 'before' ELSE 'after' END AS phase, {pick_sql(DECODED, 'o_orderkey')} AS destination FROM orders WHERE o_orderkey % 10 > 0 AND (o_orderkey // 2) % 3 < 2 AND {pick_sql(DECODED, 'o_orderkey')} IS NOT NULL)"


@query(f"SELECT * FROM {SOCKETS} AS s")
def read_socket_snapshot(spark, sf_dir):
    return ops.socket_fields(socket_lines(spark, sf_dir))


@query(f"SELECT o_orderkey AS k, {pick_sql(RAW, 'o_orderkey')} AS raw, {pick_sql(DECODED, 'o_orderkey')} AS destination FROM orders")
def decode_socket_addr(spark, sf_dir):
    raw = pick(RAW, F.col("o_orderkey"))
    return corpora.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), raw.alias("raw"), ops.decode_address(raw).alias("destination"))


@query(f"SELECT DISTINCT target, destination FROM {SOCKETS} AS a WHERE phase = 'after' AND NOT EXISTS (SELECT 1 FROM {SOCKETS} AS b WHERE b.phase = 'before' AND b.target = a.target AND b.destination = a.destination)")
def new_connections(spark, sf_dir):
    return ops.new_connections(ops.socket_fields(socket_lines(spark, sf_dir)))


# Tools and pins.
_CANONS = "(VALUES " + ", ".join(f"({text_sql(s)}, {text_sql(json.dumps(d.parsed(s), sort_keys=True, separators=(',', ':'), ensure_ascii=False))})" for s in dict.fromkeys(corpora.SCHEMAS) if s and d.parsed(s) is not None) + ") AS c(schema, canon)"
FINGER = f"""(SELECT target, snapshot, tool_name, sha256(CAST(to_json({{'name': tool_name, 'description': coalesce(description, ''), 'inputSchema': coalesce(canon, '')}}) AS VARCHAR)) AS h FROM ({corpora.TOOLS_SQL}) AS t LEFT JOIN {_CANONS} ON input_schema = schema)"""


@query(f"SELECT target, snapshot, tool_name, h AS sha256 FROM {FINGER} AS f")
def tool_fingerprint(spark, sf_dir):
    return corpora.tools(spark, sf_dir).select("target", "snapshot", "tool_name", pins.fingerprint().alias("sha256"))


DIFFS = f"""(SELECT coalesce(o.target, n.target) AS target, coalesce(o.tool_name, n.tool_name) AS tool_name, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state
 FROM (SELECT * FROM {FINGER} AS f WHERE snapshot = 'old') AS o FULL JOIN (SELECT * FROM {FINGER} AS f WHERE snapshot = 'new') AS n ON o.target = n.target AND o.tool_name = n.tool_name)"""


def diffs(spark, sf_dir):
    tools = corpora.tools(spark, sf_dir)
    return pins.diff(tools.where("snapshot = 'new'"), pins.pin_table(tools.where("snapshot = 'old'")))


@query(f"SELECT target, tool_name, state, state <> 'unchanged' AS changed, CASE state WHEN 'new' THEN 'New tool — not in pinned baseline' WHEN 'removed' THEN 'Tool removed from server' WHEN 'changed' THEN 'Tool description or schema changed — possible rug pull' END AS description FROM {DIFFS} AS d")
def diff_pins(spark, sf_dir):
    return diffs(spark, sf_dir).select("target", "tool_name", "state", "changed", "description")


@query(f"SELECT target, bool_or(state <> 'unchanged') AS changed FROM {DIFFS} AS d GROUP BY target")
def pin_changed(spark, sf_dir):
    return pins.changed(diffs(spark, sf_dir))


@query(f"SELECT target, tool_name, max(h) AS sha256 FROM {FINGER} AS f WHERE snapshot = 'new' GROUP BY target, tool_name")
def write_pins(spark, sf_dir):
    """A baseline in place of another one."""
    from riskweave.sources.sinks import scratch

    path = scratch(spark, "pins")
    for snapshot in ("old", "new"):
        pins.write(corpora.tools(spark, sf_dir).where(F.col("snapshot") == snapshot), path)
    return pins.read(spark, path)
