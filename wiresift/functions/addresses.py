"""Address text, address scopes and the service registry."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.functions.scalars import is_ipv4

# Private, loopback and reserved IPv4 blocks, as prefixes of the dotted text.
PRIVATE = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.)"  # 10/8, 172.16/12, 192.168/16
LOOPBACK = r"^127\."
RESERVED = (
    r"^(0\."  # 0.0.0.0/8
    r"|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."  # 100.64.0.0/10
    r"|127\."  # 127.0.0.0/8
    r"|169\.254\."  # 169.254.0.0/16
    r"|192\.0\.0\.|192\.0\.2\."  # 192.0.0.0/24, 192.0.2.0/24
    r"|198\.1[89]\."  # 198.18.0.0/15
    r"|198\.51\.100\.|203\.0\.113\."  # 198.51.100.0/24, 203.0.113.0/24
    r"|22[4-9]\.|2[3-5]\d\.)"  # 224.0.0.0/4, 240.0.0.0/4
)
# Not globally reachable and not loopback: private, link-local, documentation, benchmarking and reserved blocks.
LOCAL_USE = (
    r"^(0\."  # 0.0.0.0/8
    r"|10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\."  # 10/8, 172.16/12, 192.168/16
    r"|169\.254\."  # 169.254.0.0/16
    r"|192\.0\.0\.(?!9$|10$)|192\.0\.2\."  # 192.0.0.0/24 but two anycast addresses, 192.0.2.0/24
    r"|198\.1[89]\.|198\.51\.100\.|203\.0\.113\."  # 198.18.0.0/15, 198.51.100.0/24, 203.0.113.0/24
    r"|24\d\.|25[0-5]\.)"  # 240.0.0.0/4
)
UNIQUE_LOCAL_V6 = "^[fF][cCdD][0-9a-fA-F]{2}:"

# The explanation texts of the service context.
TEXT = {
    "discovery": "Validated GVCP discovery command to LAN broadcast",
    "to": " destination port ",
    "matches": " matches ",
    "context": "; port match is baseline context only",
    "reply": "Established reverse flow from ",
    "unproven": "Service source port observed without established reverse-flow evidence",
    "dynamic": "Dynamic source port is not independently suspicious",
    "none": "No registered service pattern",
}

# The (transport, port, tag, name, backend service) registry.
SERVICES = [
    ("UDP", 53, "DNS", "DNS", False), ("TCP", 53, "DNS", "DNS", False),
    ("TCP", 80, "HTTP", "HTTP", False), ("TCP", 443, "HTTPS", "HTTPS", False),
    ("TCP", 22, "SSH", "SSH", False), ("TCP", 21, "FTP", "FTP", False),
    ("TCP", 25, "SMTP", "SMTP", False), ("TCP", 465, "SMTPS", "SMTPS", False),
    ("TCP", 587, "SMTP_SUBMISSION", "SMTP submission", False),
    ("TCP", 853, "DNS_OVER_TLS", "DNS over TLS", False),
    ("UDP", 123, "NTP", "NTP", False),
    ("UDP", 3956, "GVCP", "GigE Vision discovery/control", False),
    ("UDP", 67, "DHCP_SERVER", "DHCP server", False), ("UDP", 68, "DHCP_CLIENT", "DHCP client", False),
    ("UDP", 161, "SNMP", "SNMP", False), ("UDP", 162, "SNMP_TRAP", "SNMP trap", False),
    ("TCP", 389, "LDAP", "LDAP", False), ("TCP", 636, "LDAPS", "LDAPS", False),
    ("TCP", 88, "KERBEROS", "Kerberos", False), ("UDP", 88, "KERBEROS", "Kerberos", False),
    ("TCP", 3389, "RDP", "RDP", False), ("TCP", 445, "SMB", "SMB", False),
    ("UDP", 137, "NETBIOS_NS", "NetBIOS name service", False),
    ("UDP", 138, "NETBIOS_DGM", "NetBIOS datagram", False),
    ("TCP", 139, "NETBIOS_SESSION", "NetBIOS session", False),
    ("TCP", 23, "TELNET", "Telnet", False), ("TCP", 6379, "REDIS", "Redis", True),
    ("TCP", 27017, "MONGODB", "MongoDB", True), ("TCP", 5432, "POSTGRESQL", "PostgreSQL", True),
    ("TCP", 3306, "MYSQL", "MySQL", True), ("TCP", 9092, "KAFKA", "Kafka", True),
    ("TCP", 5672, "RABBITMQ", "RabbitMQ", True),
    ("TCP", 15672, "RABBITMQ_MANAGEMENT", "RabbitMQ management", True),
    ("TCP", 6443, "KUBERNETES_API", "Kubernetes API", True),
]
FIRST_DYNAMIC_PORT = 49152


def _v6(low: Column) -> tuple[Column, Column]:
    """(the eight groups, whether the lower-case text is a valid address without a dotted tail)"""
    gap = low.contains("::")
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(low, "::", 1)), groups(F.substring_index(low, "::", -1))
    missing = 8 - F.size(left) - F.size(right)
    full = F.when(gap, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).otherwise(F.split(low, ":"))
    shape = low.rlike("^[0-9a-f:]+$") & ~low.contains(":::") & (F.size(F.split(low, "::")) <= 2) & ~low.rlike("(^:[^:]|[^:]:$)") & (~gap | (missing >= 1))
    return full, shape & (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))


def _mapped_v4(low: Column) -> Column:
    return low.rlike(r"^(0{0,4}:){0,5}:?(0{0,4}:)*ffff:\d+\.\d+\.\d+\.\d+$") & is_ipv4(F.substring_index(low, ":", -1))


def is_address(ip: Column) -> Column:
    """Whether the text is an IPv4 or IPv6 address; null is none."""
    low = F.lower(ip)
    return is_ipv4(ip) | F.coalesce(low.contains(":") & (_v6(low)[1] | _mapped_v4(low)), F.lit(False))


def _canonical_v6(text: Column) -> Column:
    """Canonical IPv6 text: lower case, no leading zeros, the first longest run of zero groups as `::`; invalid text as is."""
    low = F.lower(text)
    full, valid = _v6(low)
    plain = F.array_join(F.transform(full, lambda g: F.regexp_replace(g, "^0{1,3}(?=.)", "")), ":")
    # One pattern per run length, longest first; the lazy prefix takes the leftmost run.
    runs = [(f"(^|:)0(:0){{{n - 1}}}(:|$)", f"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$") for n in range(8, 1, -1)]
    short = F.coalesce(*[F.when(plain.rlike(test), F.regexp_replace(plain, whole, "$1::$2")) for test, whole in runs], plain)
    # An IPv4 tail keeps its dotted form.
    mapped = low.rlike(r"^(0{0,4}:){0,5}:?(0{0,4}:)*ffff:\d+\.\d+\.\d+\.\d+$")
    return F.when(mapped, F.concat(F.lit("::ffff:"), F.substring_index(low, ":", -1))).when(valid, short).otherwise(text)


def normalize_ip(ip: Column) -> Column:
    """Canonical address text; unparsable text stays, null becomes ''. Only text with a colon pays for the IPv6 rules."""
    clean = F.trim(F.coalesce(ip, F.lit("")))
    return F.when(clean.contains(":"), _canonical_v6(clean)).otherwise(clean)


def is_private(ip: Column) -> Column:
    return F.coalesce((ip.rlike(PRIVATE) & is_ipv4(ip)) | ip.rlike(UNIQUE_LOCAL_V6), F.lit(False))


def is_private_or_loopback(ip: Column) -> Column:
    return is_private(ip) | F.coalesce((ip.rlike(LOOPBACK) & is_ipv4(ip)) | (ip == "::1"), F.lit(False))


def ip_scope(ip: Column) -> Column:
    """private LAN / public IPv4 / reserved or non-public / unverified."""
    return (F.when(~is_ipv4(ip), "unverified").when(ip.rlike(PRIVATE), "private LAN")
            .when(ip.rlike(RESERVED), "reserved or non-public").otherwise("public IPv4"))


def blockable(ip: Column) -> Column:
    return ip_scope(ip).isin("private LAN", "public IPv4")


def service_registry(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{t}', {p}, '{tag}', '{name}', {str(backend).lower()})" for t, p, tag, name, backend in SERVICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS registry(transport, port, tag, service, backend)")


def service_tags(df: DataFrame, transport: str = "transport", src: str = "src_ip", dst: str = "dst_ip",
                 sport: str = "src_port", dport: str = "dst_port", established: str = "established",
                 discovery: str = "gvcp_discovery") -> DataFrame:
    """Add the service context of each row: two broadcast lookups in the 34-row registry, then one case chain."""
    reg = service_registry(df.sparkSession)
    side = lambda p: F.broadcast(reg.select(*[F.col(c).alias(f"_{p}_{c}") for c in reg.columns]))
    up = F.upper(F.col(transport))
    j = (df.join(side("d"), (up == F.col("_d_transport")) & (F.col(dport) == F.col("_d_port")), "left")
         .join(side("s"), (up == F.col("_s_transport")) & (F.col(sport) == F.col("_s_port")), "left"))
    to_service, from_service = F.col("_d_tag").isNotNull(), F.col("_s_tag").isNotNull()
    j = j.withColumns({
        "_internal": is_private_or_loopback(F.col(src)) & is_private_or_loopback(F.col(dst)),
        "_gvcp": F.coalesce((F.col("_d_tag") == "GVCP") & F.col(discovery) & is_private(F.col(src))
                            & (F.col(dst) == "255.255.255.255"), F.lit(False))})
    internal, gvcp = F.col("_internal"), F.col("_gvcp")
    backend = internal & F.col("_d_backend")
    reply = from_service & F.col(established)
    dynamic = F.col(sport) >= FIRST_DYNAMIC_PORT
    traffic_class = (
        F.when(gvcp | (to_service & backend), "INTERNAL_SERVICE").when(to_service, "NORMAL_SERVICE")
        .when(reply, "RESPONSE_TRAFFIC").when(from_service, "UNKNOWN").when(dynamic, "EPHEMERAL_CLIENT")
        .otherwise("UNKNOWN"))
    role = (
        F.when(gvcp, "SERVICE_DISCOVERY").when(to_service & backend, "INTERNAL_CLIENT")
        .when(to_service & (F.col("_d_tag") == "DNS"), "CLIENT_TO_DNS").when(to_service, "OUTBOUND_CLIENT")
        .when(reply, "SERVER_RESPONSE").when(from_service, "UNKNOWN").when(dynamic, "OUTBOUND_CLIENT")
        .otherwise("UNKNOWN"))
    nothing = F.when(dynamic, "EPHEMERAL_CLIENT_PORT").otherwise("UNKNOWN")
    return j.withColumns({
        "protocol_tag": F.coalesce("_d_tag", "_s_tag", nothing),
        "service": F.coalesce("_d_service", "_s_service",
                              F.when(dynamic, "Ephemeral client port").otherwise("UNKNOWN")),
        "traffic_class": traffic_class, "connection_role": role,
        "is_well_known_service": to_service | from_service,
        "is_internal_service": gvcp | ((to_service | from_service) & internal),
        "is_ephemeral_port": F.when(to_service, dynamic)
        .when(from_service, F.col(dport) >= FIRST_DYNAMIC_PORT).otherwise(dynamic),
        "rule_classification": traffic_class,
        "rule_reason": F.when(gvcp, TEXT["discovery"])
        .when(to_service, F.concat(up, F.lit(TEXT["to"]), F.col(dport).cast("string"), F.lit(TEXT["matches"]), F.col("_d_tag"), F.lit(TEXT["context"])))
        .when(reply, F.concat(F.lit(TEXT["reply"]), F.col("_s_tag"), F.lit(" port "), F.col(sport).cast("string")))
        .when(from_service, TEXT["unproven"]).when(dynamic, TEXT["dynamic"]).otherwise(TEXT["none"]),
    }).drop("_internal", "_gvcp", *[f"_{p}_{c}" for p in "ds" for c in reg.columns])


def gvcp_discovery_flag(protocol, src, dst, dst_port, mf, offset, payload, payload_len) -> Column:
    """The exact eight-byte discovery command to the LAN broadcast, sent by an IPv4 host of a local-use block (link-local ones included)."""
    body = F.hex(payload)
    return F.coalesce(
        (protocol == 17) & (dst_port == 3956) & (dst == "255.255.255.255") & is_ipv4(src)
        & src.rlike(LOCAL_USE) & (F.coalesce(mf, F.lit(0)) == 0) & (F.coalesce(offset, F.lit(0)) == 0)
        & (payload_len == 8) & (F.length(payload) == 8) & body.startswith("420100020000") & ~body.endswith("0000"),
        F.lit(False))


def routine_dns_flag(protocol, dst_port, mf, offset, payload, payload_len) -> Column:
    """One whole, uncompressed, common-type question in a plain DNS query; the name is walked over its hex text."""
    body = F.hex(payload)
    at = lambda pos, n: F.conv(F.substr(body, pos, F.lit(n)), 16, 10).cast("bigint")
    word = lambda i: at(F.lit(1 + 4 * i), 4)
    size = F.length(payload)
    header = ((word(1).bitwiseAND(F.lit(0xFA0F)) == 0) & (word(2) == 1) & (word(3) == 0) & (word(4) == 0) & (word(5) <= 2))
    # Walk the labels to the end: each takes two bytes at least of a payload of at most 512. -1 marks a bad label, -2 a finished name.
    start = F.struct(F.lit(12).cast("bigint").alias("pos"), F.lit(0).alias("state"))

    def hop(acc, _):
        width = F.when((acc["state"] == 0) & (acc["pos"] < size), at(acc["pos"] * 2 + 1, 2)).otherwise(F.lit(0))
        bad = (width > 63) | (acc["pos"] + 1 + width >= size)
        return (F.when(acc["state"] != 0, acc)
                .when((acc["pos"] >= size) | (width == 0), F.struct(acc["pos"].alias("pos"), F.lit(-2).alias("state")))
                .when(bad, F.struct(acc["pos"].alias("pos"), F.lit(-1).alias("state")))
                .otherwise(F.struct((acc["pos"] + 1 + width).alias("pos"), F.lit(0).alias("state"))))
    hops = F.greatest(F.lit(1), F.least(F.lit(256), F.ceil(size / 2))).cast("int")
    walked = F.aggregate(F.sequence(F.lit(1), hops), start, hop)
    pos = walked["pos"]
    question = ((walked["state"] != -1) & (pos + 5 <= size) & (at(pos * 2 + 7, 4) == 1)
                & at(pos * 2 + 3, 4).isin(1, 5, 12, 28, 33, 64, 65))
    ready = ((protocol == 17) & (dst_port == 53) & (size >= 12) & payload_len.between(12, 512)
             & (F.coalesce(mf, F.lit(0)) == 0) & (F.coalesce(offset, F.lit(0)) == 0))
    return F.coalesce(F.when(ready, header & question), F.lit(False))
