"""Column functions: pure expressions that stay inside whole-stage codegen."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_flow_key(sip: Column, sport: Column, dip: Column, dport: Column, proto: Column) -> Column:
    """`lo|hi|proto` with the endpoints as `ip:port` text in string order; the same for both directions."""
    a = F.concat_ws(":", sip, sport.cast("bigint").cast("string"))
    b = F.concat_ws(":", dip, dport.cast("bigint").cast("string"))
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b), proto.cast("bigint").cast("string"))


def telemetry_flow_key(sip: Column, sport: Column, dip: Column, dport: Column, proto: Column) -> Column:
    """`a:p<->b:q(PROTO)`: addresses in text order, then ports in numeric order."""
    forward = (sip < dip) | ((sip == dip) & (sport <= dport))
    text = lambda ip, port: F.concat(ip, F.lit(":"), port.cast("string"))
    return F.concat(
        F.when(forward, text(sip, sport)).otherwise(text(dip, dport)), F.lit("<->"),
        F.when(forward, text(dip, dport)).otherwise(text(sip, sport)), F.lit("("), proto, F.lit(")"))


V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(V4), F.lit(False))


def ip_to_int(ip: Column) -> Column:
    """IPv4 text as a number, null for anything else."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint")
    return F.when(is_ipv4(ip), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def flow_epoch(text: Column) -> Column:
    """Epoch seconds of a day-first timestamp in any of the flow meter's formats, naive as UTC, bad as null."""
    # The layouts flow files are known to use.
    formats = ["d/M/yyyy h:mm:ss a", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "d-M-yyyy H:mm:ss"]
    return F.unix_micros(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])) / F.lit(1e6)


def clean_rate(x: Column) -> Column:
    """NaN, infinities and null become 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def signed_log(x: Column) -> Column:
    v = clean_rate(x)
    return F.signum(v) * F.log1p(F.abs(v))


def payload_len(hex_text: Column) -> Column:
    """Bytes in a hex payload, `:` separators ignored."""
    return F.floor(F.length(F.coalesce(F.replace(hex_text, F.lit(":")), F.lit(""))) / 2).cast("int")


def payload_prefix(hex_text: Column, width: int = 128) -> Column:
    """The first `width` bytes of a hex payload, null when it is not hex."""
    digits = F.coalesce(F.replace(hex_text, F.lit(":")), F.lit(""))
    digits = F.substring(digits, 1, 2 * width)
    return F.when(digits.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(digits))


def payload_vector(payload: Column, width: int = 128) -> Column:
    """Byte values of a binary payload as an int array, cut or zero-padded to `width`."""
    digits = F.rpad(F.hex(F.substring(payload, 1, width)), 2 * width, "0")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def fragment_flag(mf: Column, offset: Column) -> Column:
    return (F.coalesce(mf, F.lit(0)) > 0) | (F.coalesce(offset, F.lit(0)) > 0)


def is_reversed(src_ip: Column, src_port: Column, dst_port: Column, syn_ip: Column, syn_port: Column) -> Column:
    """1 server to client, 0 client to server, -1 unknown: a bare first SYN names the client, else the higher port."""
    sp, dp = src_port.try_cast("double"), dst_port.try_cast("double")
    by_syn = F.when((syn_ip == src_ip) & (syn_port.try_cast("double") == sp), 0.0).otherwise(1.0)
    by_port = F.when(sp < dp, 1.0).when(sp > dp, 0.0).otherwise(-1.0)
    return F.when(syn_ip.isNotNull(), by_syn).otherwise(by_port)


def tcp_flag_class(syn, ack, fin, rst, psh, urg) -> Column:
    """The stealth-scan class of a TCP packet's flags, or null."""
    on, off = (lambda c: c == 1), (lambda c: c == 0)
    none = off(syn) & off(ack) & off(fin) & off(rst) & off(psh) & off(urg)
    return (
        F.when(none, "NULL")
        .when(on(fin) & on(psh) & on(urg) & off(syn) & off(ack) & off(rst), "XMAS")
        .when(on(fin) & off(syn) & off(ack) & off(rst) & off(psh) & off(urg), "FIN"))


def illegal_flags(syn, fin, rst) -> Column:
    """The illegal flag pair of a TCP packet by priority, or null."""
    return (F.when((syn == 1) & (fin == 1), "SYN+FIN").when((syn == 1) & (rst == 1), "SYN+RST")
            .when((fin == 1) & (rst == 1), "FIN+RST"))


def payload_bucket(n: Column) -> Column:
    return (F.when(n <= 64, "0_64").when(n <= 512, "65_512").when(n <= 1024, "513_1024")
            .when(n <= 1500, "1025_1500").otherwise("1501_plus"))


def protocol_name(proto: Column) -> Column:
    return (F.when(proto == 6, "TCP").when(proto == 17, "UDP").when(proto == 1, "ICMP").when(proto == 58, "ICMPv6")
            .otherwise("IPv4"))


def severity(value: Column, direction: int, tight: float, served: float) -> Column:
    v = value * direction
    return F.when(v >= tight, "HIGH").when(v >= served, "MEDIUM").otherwise("")


def half_away(x: Column, digits: int) -> Column:
    """Round half away from zero at `digits` decimals, computed as scaled doubles."""
    scale = float(10 ** digits)
    y = x * scale
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / scale


def portable_hash(key: Column, seed: Column) -> Column:
    """A 32-bit mix of an integer key and a seed that any SQL engine can compute: multiply, add, twice."""
    low = lambda x: F.pmod(x.cast("bigint"), F.lit(1 << 31))  # so that no product leaves 64 bits
    mixed = F.pmod(low(key) * F.lit(2654435761) + low(seed) * F.lit(40503), F.lit(4294967296))
    return F.pmod(mixed * F.lit(69069) + F.lit(1), F.lit(4294967296))
