"""Connection events: traces, socket tables, addresses and what they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.text import bound, once
from riskweave.rules import catalog as c
from riskweave.rules.dialect import to_java

# System calls with a destination, in trace text.
_ADDRESS = r"""\{sa_family=(AF_INET6?),\s*sin6?_port=htons\((\d+)\),\s*sin6?_addr=(?:inet_addr\(|inet_pton\(AF_INET6?,\s*)"([^"]+)\""""
CONNECT = r"connect\(\d+,\s*" + _ADDRESS
SENDTO = r"sendto\(\d+,.*" + _ADDRESS
DNS_PORT = 53


def join_host_port(host: Column, port: Column) -> Column:
    return F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]:"), port)).otherwise(F.concat(host, F.lit(":"), port))


def parse_trace(lines: DataFrame) -> DataFrame:
    """Columns of ``lines`` but line, and type and destination of each connect or sendto line."""
    rest = [x for x in lines.columns if x != "line"]
    rows = lines.where(F.contains("line", F.lit("htons(")) & (F.contains("line", F.lit("connect(")) | F.contains("line", F.lit("sendto("))))

    rows = once(rows.select(*rest, F.col("line").alias("_line")), _connect=F.regexp_extract("_line", to_java(CONNECT), 0))
    connects = F.col("_connect") != ""
    rows = once(rows, _call=F.when(connects, F.col("_connect")).otherwise(F.regexp_extract("_line", to_java(SENDTO), 0)), _connects=connects).where("_call != ''")
    # The call ends with its host's closing quote.
    port, host = F.regexp_extract("_call", to_java(r"htons\((\d+)\),[^\"]*\"[^\"]+\"$"), 1), F.substring_index(F.substring_index("_call", '"', -2), '"', 1)
    rows = once(rows, _port=port, _host=host)
    kind = F.when(F.col("_port").try_cast("int") == DNS_PORT, "dns").when(F.col("_connects"), "tcp").otherwise("udp")
    return once(rows, type=kind, destination=join_host_port(F.col("_host"), F.col("_port"))).select(*rest, "type", "destination")


def host_port(destination: Column) -> Column:
    """``host:port`` or ``[v6]:port`` cut in two (host, port); the whole text and no port where it has no such form."""
    plain, six = r"^([^:\[\]]*):([^:]*)\z", r"^\[([^\]]*)\]:([^:]*)\z"
    parts = lambda d, p: F.struct(F.regexp_extract(d, p, 1).alias("host"), F.regexp_extract(d, p, 2).alias("port"))
    return bound(destination, lambda d: F.when(d.rlike(plain), parts(d, plain)).when(d.rlike(six), parts(d, six)).otherwise(F.struct(d.alias("host"), F.lit(None).cast("string").alias("port"))))


def host_of(destination: Column) -> Column:
    """The host of ``host:port`` or ``[v6]:port``; the whole text where it has no such form."""
    plain, six = destination.rlike(r"^[^:\[\]]*:[^:]*\z"), destination.rlike(r"^\[[^\]]*\]:[^:]*\z")
    return F.when(plain, F.substring_index(destination, ":", 1)).when(six, F.substring(F.substring_index(destination, "]", 1), 2, 1 << 30)).otherwise(destination)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"


def ip_to_long(host: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octet = lambda i: F.substring_index(F.substring_index(host, ".", i + 1), ".", -1).try_cast("long")
    return F.when(host.rlike(IPV4), octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * (1 << 8) + octet(3))


def block(cidr: str) -> tuple[int, int]:
    address, bits = cidr.split("/")
    low = sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
    return low, low + (1 << (32 - int(bits))) - 1


def in_private_block(ip: Column) -> Column:
    """In one of the three constant address blocks, by number."""
    out = F.lit(False)
    for cidr in c.PRIVATE_BLOCKS:
        low, high = block(cidr)
        out = out | ip.between(low, high)
    return F.coalesce(out, F.lit(False))


def classify(events: DataFrame) -> DataFrame:
    """A finding for each event (target, tool_name, type, destination)."""
    events = once(events.select("target", "tool_name", "type", "destination"), host=host_of(F.col("destination")))
    events = once(events, ip=ip_to_long(F.col("host")))
    is_address, private = F.col("ip").isNotNull() | F.contains("host", F.lit(":")), in_private_block(F.col("ip"))
    dns, metadata = F.col("type") == "dns", F.col("host") == c.METADATA_ADDRESS
    rule = F.when(dns, "net-probe-dns-query").when(~is_address, "net-probe-outbound-connection").when(metadata, "net-probe-metadata-service").when(private, "net-probe-private-ip").otherwise("net-probe-outbound-connection")
    d = F.col("destination")
    message = (
        F.when(dns, F.concat(F.lit("Tool made DNS query to "), d)).when(~is_address, F.concat(F.lit("Tool made outbound "), F.upper("type"), F.lit(" connection to "), d))
        .when(metadata, F.concat(F.lit("Tool connected to cloud metadata service at "), d)).when(private, F.concat(F.lit("Tool connected to private/RFC1918 address "), d, F.lit(" (possible SSRF)")))
        .otherwise(F.concat(F.lit("Tool made outbound "), F.upper("type"), F.lit(" connection to public IP "), d))
    )
    severity = F.when(dns, c.WARNING).when(is_address & metadata, c.CRITICAL).otherwise(c.HIGH)
    return events.select("target", rule.alias("rule"), severity.alias("severity"), message.alias("message"), F.col("tool_name").alias("tool"))


def socket_fields(lines: DataFrame) -> DataFrame:
    """Established remote addresses of socket-table lines, decoded: the other columns and destination."""
    rest = [x for x in lines.columns if x not in ("line", "line_no")]
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.where((F.col("line_no") > 1) & (F.size(fields) >= 4) & (F.get(fields, 3) == "01")).select(*rest, F.get(fields, 2).alias("raw"))
    return rows.select(*rest, decode_address(F.col("raw")).alias("destination")).where("destination IS NOT NULL")


def decode_address(raw: Column) -> Column:
    """``ADDRESS:PORT`` in hexadecimal, words little-endian; null where it isn't such."""

    def decoded(raw: Column) -> Column:
        byte = lambda at: F.conv(F.substring(raw, at, 2), 16, 10)
        pair = lambda word, hi: F.lower(F.regexp_replace(F.concat(F.substring(raw, word * 8 + hi, 2), F.substring(raw, word * 8 + hi - 2, 2)), "^0{1,3}", ""))
        four = F.concat_ws(".", *[byte(at) for at in (7, 5, 3, 1)])
        six = F.concat_ws(":", F.lit(""), *[pair(w, hi) for w in range(4) for hi in (7, 3)], F.lit(""))
        port = F.conv(F.substring_index(raw, ":", -1), 16, 10)
        return F.when(raw.rlike(r"^[0-9A-Fa-f]{8}:[0-9A-Fa-f]{1,4}\z"), F.concat(four, F.lit(":"), port)).when(
            raw.rlike(r"^[0-9A-Fa-f]{32}:[0-9A-Fa-f]{1,4}\z"), F.concat(F.lit("["), bound(six, _compressed), F.lit("]:"), port)
        )

    return bound(raw, decoded)


def _compressed(padded: Column) -> Column:
    """``:a:b:...:`` without its outer colons, the first longest run of two or more zero groups as ``::``."""
    out = F.btrim(padded, F.lit(":"))
    for n in range(2, 9):
        run = ":" + "0:" * n
        short = F.concat(F.substring_index(padded, run, 1), F.lit("::"), F.substring(padded, F.instr(padded, F.lit(run)) + len(run), F.length(padded)))
        out = F.when(F.contains(padded, F.lit(run)), F.regexp_replace(short, r"^:(?!:)|(?<!:):\z", "")).otherwise(out)
    return out


def new_connections(sockets: DataFrame) -> DataFrame:
    """Destinations of a target's "after" snapshot that its "before" doesn't have."""
    now = sockets.where("phase = 'after'").select("target", "destination").distinct()
    return now.join(sockets.where("phase = 'before'").select("target", "destination"), ["target", "destination"], "left_anti")
