"""The rule engine: window telemetry and per-source counts in, alert rows out.

Rules are callables `RuleInput -> DataFrame` in `RULES`; window-level rules share one pass over the telemetry row.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.operators.telemetry import US, packet_windows, window_telemetry

# Default thresholds.
DEFAULTS = {
    "unique_ports": 20, "unique_hosts": 20, "syn_per_second": 500.0, "syn_ack_ratio": 5.0, "min_syn_count": 50,
    "ack_per_second": 1000.0, "rst_per_second": 500.0, "udp_packets_per_second": 1000.0, "icmp_per_second": 300.0,
    "unique_targets": 15, "dns_packets_per_second": 500.0, "dns_bytes_per_second": 500000.0, "min_packets": 3,
    "burst_syn_per_second": 500.0,
}

# Alert type, severity, technique id, tactic, technique name, protocol of each rule.
META = {
    "port_scan": ("PORT_SCAN_INDICATOR", "HIGH", "T1046", "Discovery", "Network Service Discovery", "TCP/UDP"),
    "host_scan": ("HOST_SCAN_INDICATOR", "HIGH", "T1018", "Discovery", "Remote System Discovery", "IP"),
    "syn_flood": ("SYN_FLOOD_INDICATOR", "HIGH", "T1498.001", "Impact", "Direct Network Flood (SYN Flood)", "TCP"),
    "ack_flood": ("ACK_FLOOD_INDICATOR", "HIGH", "T1498.001", "Impact", "Direct Network Flood (ACK Flood)", "TCP"),
    "rst_flood": ("RST_FLOOD_INDICATOR", "HIGH", "T1499", "Impact", "Endpoint Denial of Service: Connection Teardown", "TCP"),
    "udp_flood": ("UDP_FLOOD_INDICATOR", "HIGH", "T1498.001", "Impact", "Direct Network Flood (UDP Flood)", "UDP"),
    "icmp_flood": ("ICMP_FLOOD_INDICATOR", "HIGH", "T1498.001", "Impact", "Direct Network Flood (ICMP Flood)", "ICMP"),
    "ping_sweep": ("PING_SWEEP_INDICATOR", "HIGH", "T1595.001", "Reconnaissance", "Active Scanning: IP Network Scanning", "ICMP"),
    "dns_amplification": ("DNS_AMPLIFICATION_INDICATOR", "HIGH", "T1498.002", "Impact",
                          "Network Denial of Service: Reflection Amplification", "UDP/DNS"),
    "null_scan": ("NULL_SCAN_INDICATOR", "HIGH", "T1046", "Discovery", "Network Service Discovery (Stealth NULL Scan)", "TCP"),
    "xmas_scan": ("XMAS_SCAN_INDICATOR", "HIGH", "T1046", "Discovery", "Network Service Discovery (Stealth XMAS Scan)", "TCP"),
    "fin_scan": ("FIN_SCAN_INDICATOR", "MEDIUM", "T1046", "Discovery", "Network Service Discovery (Stealth FIN Scan)", "TCP"),
    "connection_burst": ("CONNECTION_BURST_INDICATOR", "MEDIUM", "T1071", "Command and Control",
                         "Application Layer Protocol: Connection Spike", "TCP"),
    "suspicious_flags": ("SUSPICIOUS_TCP_FLAGS", "MEDIUM", "T1027", "Defense Evasion",
                         "Obfuscated/Abnormal Protocol Signatures (Illegal TCP Flags)", "TCP"),
}

# The reason text of each rule.
REASONS = {
    "port_scan": "One source contacted an unusually large number of destination ports (%d unique ports in %.0fs window).",
    "host_scan": "One source contacted an unusually large number of destination hosts (%d unique hosts in %.0fs window).",
    "syn_both": "High SYN rate (%.1f/sec) combined with abnormal SYN/SYN-ACK ratio (%.1f).",
    "syn_rate": "Excessive TCP SYN packet rate (%.1f/sec exceeds threshold %.1f/sec).",
    "syn_ratio": "Abnormal SYN/SYN-ACK ratio (%.1f with %d SYNs and %d SYN-ACKs).",
    "ack_flood": "Abnormal TCP ACK traffic rate (%.1f/sec exceeds threshold %.1f/sec).",
    "rst_flood": "Abnormal TCP RST packet rate detected (%.1f/sec exceeds threshold %.1f/sec). Possible connection teardown attack.",
    "udp_flood": "Unusually high UDP packet rate (%.1f/sec exceeds threshold %.1f/sec).",
    "icmp_flood": "Excessive ICMP packet rate detected (%.1f pkts/sec exceeds threshold %.1f pkts/sec). Possible ICMP/Ping Flood attack.",
    "ping_sweep": "Reconnaissance ping sweep observed: host probed %d unique destination IPs via ICMP Echo within %.0fs window.",
    "dns_amplification": "Unusually high DNS traffic detected (%.1f pkts/sec, %.1f KB/sec). Potential DNS Amplification or Flood attack.",
    "null_scan": "Stealth TCP NULL scan detected (%d packet(s) with 0 TCP control flags set). Commonly used to evade simple packet filters.",
    "xmas_scan": "Stealth TCP XMAS scan detected (%d packet(s) with FIN+PSH+URG flags set). Used for firewall probing and OS fingerprinting.",
    "fin_scan": "Stealth TCP FIN scan pattern detected (%d isolated FIN packet(s) without ACK). Used to bypass SYN packet filters.",
    "connection_burst": "Unusually high number of new TCP connection attempts (%.1f SYN/sec in window).",
    "suspicious_flags": "Unusual TCP flag combination observed (%s detected in %d packet(s)).",
}


@dataclass
class RuleInput:
    """What a rule may read: the windowed packets, their telemetry and the thresholds."""
    packets: DataFrame
    seconds: int = 10
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        self.config = {**DEFAULTS, **self.config}
        self._windows = None
        self._telemetry = None

    @property
    def windows(self) -> DataFrame:
        if self._windows is None:
            self._windows = packet_windows(self.packets, self.seconds)
        return self._windows

    @property
    def telemetry(self) -> DataFrame:
        if self._telemetry is None:
            self._telemetry = window_telemetry(self.packets, self.seconds)
        return self._telemetry


def _alert(rule: str, reason: Column, features: dict[str, Column], source: Column | None = None,
           combo: Column | None = None) -> Column:
    kind, severity, technique, tactic, name, protocol = META[rule]
    pairs = [x for k, v in features.items() for x in (F.lit(k), v.cast("double"))]
    return F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(technique).alias("mitre_attack_id"),
        F.lit(tactic).alias("mitre_tactic"), F.lit(name).alias("mitre_technique_name"), F.lit(protocol).alias("protocol"),
        (F.lit("") if source is None else source).alias("source_ip"),
        (F.lit("") if combo is None else combo).alias("flag_combination"), reason.alias("reason"),
        F.create_map(*pairs).alias("features"))


def _window_rules(cfg: dict) -> dict[str, tuple[Column, Column]]:
    """Trigger and alert of each rule that needs nothing but the telemetry row."""
    c, fmt = F.col, F.format_string
    span = {"duration_seconds": c("duration_seconds")}
    rate_hit = (c("syn_per_second") >= cfg["syn_per_second"]) & F.lit(cfg["syn_per_second"] > 0)
    ratio_hit = ((c("syn_count") >= cfg["min_syn_count"]) & (c("syn_ack_ratio") >= cfg["syn_ack_ratio"])
                 & F.lit(cfg["syn_ack_ratio"] > 0))
    syn_reason = (F.when(rate_hit & ratio_hit, fmt(REASONS["syn_both"], c("syn_per_second"), c("syn_ack_ratio")))
                  .when(rate_hit, fmt(REASONS["syn_rate"], c("syn_per_second"), F.lit(cfg["syn_per_second"])))
                  .otherwise(fmt(REASONS["syn_ratio"], c("syn_ack_ratio"), c("syn_count"), c("syn_ack_count"))))
    rules = {"syn_flood": (rate_hit | ratio_hit, _alert("syn_flood", syn_reason, {
        "syn_rate": c("syn_per_second"), "syn_count": c("syn_count"), "syn_ack_count": c("syn_ack_count"),
        "syn_ack_ratio": c("syn_ack_ratio"), "incomplete_conns": c("approx_incomplete_connections"), **span}))}
    for rule, rate, count, limit in (
            ("ack_flood", "ack_per_second", "ack_count", cfg["ack_per_second"]),
            ("rst_flood", "rst_per_second", "rst_count", cfg["rst_per_second"]),
            ("udp_flood", "udp_packets_per_second", "udp_packets", cfg["udp_packets_per_second"]),
            ("icmp_flood", "icmp_packets_per_second", "icmp_packets", cfg["icmp_per_second"])):
        rules[rule] = ((c(rate) >= limit) & F.lit(limit > 0), _alert(
            rule, fmt(REASONS[rule], c(rate), F.lit(limit)), {"rate": c(rate), "count": c(count), **span}))
    dns = (((c("dns_packets_per_second") >= cfg["dns_packets_per_second"]) & F.lit(cfg["dns_packets_per_second"] > 0))
           | ((c("dns_bytes_per_second") >= cfg["dns_bytes_per_second"]) & F.lit(cfg["dns_bytes_per_second"] > 0)))
    rules["dns_amplification"] = (dns, _alert(
        "dns_amplification", fmt(REASONS["dns_amplification"], c("dns_packets_per_second"), c("dns_bytes_per_second") / 1024.0),
        {"dns_rate": c("dns_packets_per_second"), "dns_bytes_per_sec": c("dns_bytes_per_second"), "dns_count": c("dns_packets"), **span}))
    for rule, count in (("null_scan", "null_scan_packets"), ("xmas_scan", "xmas_scan_packets"), ("fin_scan", "fin_scan_packets")):
        rules[rule] = (c(count) >= cfg["min_packets"], _alert(
            rule, fmt(REASONS[rule], c(count)), {"packet_count": c(count), **span}))
    burst = cfg["burst_syn_per_second"]
    rules["connection_burst"] = ((c("syn_per_second") >= burst) & F.lit(burst > 0), _alert(
        "connection_burst", fmt(REASONS["connection_burst"], c("syn_per_second")),
        {"syn_rate": c("syn_per_second"), "syn_count": c("syn_count"), **span}))
    return rules


def window_alerts(telemetry: DataFrame, config: dict | None = None, only: list[str] | None = None) -> DataFrame:
    """All window-level rules in one pass: each row builds its candidate alerts and keeps those that fired."""
    rules = _window_rules({**DEFAULTS, **(config or {})})
    chosen = [F.when(hit, alert) for name, (hit, alert) in rules.items() if only is None or name in only]
    fired = F.filter(F.array(*chosen), lambda a: a.isNotNull())
    return telemetry.select("window_index", "window_start", "window_end", F.inline(fired))


def _stamp(counts: DataFrame, x: RuleInput) -> DataFrame:
    start = F.col("window_start_us") / F.lit(1e6)
    return counts.withColumns({"window_start": start, "window_end": start + x.seconds})


def _source_fanout(x: RuleInput, rule: str, target: str, where: Column, limit: int, feature: str) -> DataFrame:
    """Distinct targets per (window, source) against a limit; the distinct count is pre-aggregated map-side."""
    counts = x.windows.where(where).groupBy("window_index", "window_start_us", "src_ip").agg(
        F.countDistinct(target).alias("n")).where(F.col("n") >= limit)
    alert = _alert(rule, F.format_string(REASONS[rule], F.col("n"), F.lit(float(x.seconds))),
                   {feature: F.col("n"), "threshold": F.lit(limit), "duration_seconds": F.lit(x.seconds)}, F.col("src_ip"))
    return _stamp(counts, x).select("window_index", "window_start", "window_end", F.inline(F.array(alert)))


def port_scan(x: RuleInput) -> DataFrame:
    return _source_fanout(x, "port_scan", "dst_port", F.col("dst_port") > 0, x.config["unique_ports"], "unique_destination_ports")


def host_scan(x: RuleInput) -> DataFrame:
    return _source_fanout(x, "host_scan", "dst_ip", F.lit(True), x.config["unique_hosts"], "unique_destination_hosts")


def ping_sweep(x: RuleInput) -> DataFrame:
    return _source_fanout(x, "ping_sweep", "dst_ip", F.col("is_icmp_echo"), x.config["unique_targets"], "unique_targets")


def suspicious_flags(x: RuleInput) -> DataFrame:
    counts = x.windows.where(F.col("illegal").isNotNull()).groupBy("window_index", "window_start_us", "illegal").agg(
        F.count(F.lit(1)).alias("n"))
    alert = _alert("suspicious_flags", F.format_string(REASONS["suspicious_flags"], F.col("illegal"), F.col("n")),
                   {"packet_count": F.col("n"), "duration_seconds": F.lit(x.seconds)}, combo=F.col("illegal"))
    return _stamp(counts, x).select("window_index", "window_start", "window_end", F.inline(F.array(alert)))


def telemetry_rules(x: RuleInput) -> DataFrame:
    return window_alerts(x.telemetry, x.config)


RULES = {"port_scan": port_scan, "host_scan": host_scan, "ping_sweep": ping_sweep, "suspicious_flags": suspicious_flags,
         "window": telemetry_rules}


def evaluate(packets: DataFrame, seconds: int = 10, config: dict | None = None, rules: dict | None = None) -> DataFrame:
    """Every registered rule over one capture."""
    x = RuleInput(packets, seconds, config or {})
    return reduce(DataFrame.unionByName, [rule(x) for rule in (rules or RULES).values()])
