"""Explicit table schemas; nothing is inferred."""
from __future__ import annotations

from pyspark.sql import types as T

# Column names of the label block shared by packets, flows and edges.
LABEL_COLUMNS = ["Label", "attack_name", "label_source", "label_confidence", "label_direction"]

PACKETS = T.StructType(
    [T.StructField("timestamp", T.DoubleType()), T.StructField("src_ip", T.StringType()),
     T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
     T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.IntegerType()),
     T.StructField("length", T.IntegerType()), T.StructField("frame_no", T.LongType()),
     T.StructField("ttl", T.IntegerType()), T.StructField("is_ipv6", T.ByteType()),
     T.StructField("tcp_window", T.IntegerType())]
    + [T.StructField(f"tcp_flag_{f}", T.ByteType()) for f in ("syn", "ack", "fin", "rst", "psh", "urg")]
    + [T.StructField("ip_flag_df", T.ByteType()), T.StructField("ip_flag_mf", T.ByteType()),
       T.StructField("ip_frag_offset", T.IntegerType()), T.StructField("tcp_retransmission", T.ByteType()),
       T.StructField("payload_len", T.IntegerType()), T.StructField("payload", T.BinaryType()),
       T.StructField("flow_key", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in LABEL_COLUMNS])

# The flow meter's 76 statistics, in its column order.
FLOW_STATISTICS = [
    "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std",
    "Flow Byts/s", "Flow Pkts/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s",
    "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var",
    "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt",
    "URG Flag Cnt", "CWE Flag Count", "ECE Flag Cnt", "Down/Up Ratio",
    "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg",
    "Fwd Byts/b Avg", "Fwd Pkts/b Avg", "Fwd Blk Rate Avg",
    "Bwd Byts/b Avg", "Bwd Pkts/b Avg", "Bwd Blk Rate Avg",
    "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts",
    "Init Fwd Win Byts", "Init Bwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]
RECORD_STATISTICS = [c for c in FLOW_STATISTICS if not c.startswith(("Active", "Idle"))]

# Identity columns of a flow row, and the header columns a flow file must have.
FLOW_IDENTITY = ["day", "capture", "flow_uid", "flow_key", "Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port",
                 "Protocol", "Timestamp"]
FLOW_REQUIRED = ["Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp", "Flow Duration"]

FLOWS = T.StructType(
    [T.StructField(c, T.DoubleType() if c in ("Src Port", "Dst Port", "Protocol") else T.StringType())
     for c in FLOW_IDENTITY]
    + [T.StructField(c, T.DoubleType()) for c in FLOW_STATISTICS]
    + [T.StructField(c, T.StringType()) for c in LABEL_COLUMNS])

# The twenty packet aggregates of an event, in contract order.
AGGREGATES = [
    "pkt_n", "pkt_len_mean", "pkt_len_std", "ttl_mean", "ttl_std", "win_mean", "win_std",
    "iat_mean", "iat_std", "iat_max", "syn_n", "ack_n", "fin_n", "rst_n", "psh_n", "urg_n",
    "payload_bytes", "payload_frac", "retrans_n", "frag_n",
]
CONTEXT = ["dt_src", "dt_dst", "port_delta", "dst_port_new"]
EVENT_COLUMNS = ["event_id", "t", "src_node_id", "dst_node_id", *CONTEXT, "flow_uid", "capture", "has_packets",
                 "reversed", *AGGREGATES, "label"]

# Columns that name an endpoint, a label or the clock (the activity columns carry a flow's absolute time): never model features.
FORBIDDEN_FEATURES = {
    "src_ip", "dst_ip", "src_port", "dst_port", "capture", "flow_uid", "day", "Src IP", "Dst IP", "Src Port",
    "Dst Port", "Flow ID", "flow_key", "src_node_id", "dst_node_id", "event_id", "t", "t_obs", "Timestamp",
    "label", *LABEL_COLUMNS, *(c for c in FLOW_STATISTICS if c.startswith(("Active", "Idle"))),
}

RULES = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("day", T.StringType()),
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("attacker_ips", T.ArrayType(T.StringType())),
    T.StructField("victim_ips", T.ArrayType(T.StringType())),
    T.StructField("service_ports", T.ArrayType(T.IntegerType())),
    T.StructField("protocols", T.ArrayType(T.IntegerType())),
    T.StructField("confidence", T.StringType()), T.StructField("rule_order", T.IntegerType())])

# JSON packet events of the capture stream.
PACKET_JSON = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("interface_name", T.StringType()), T.StructField("interface_type", T.StringType()),
    T.StructField("src_mac", T.StringType()), T.StructField("dst_mac", T.StringType()),
    T.StructField("ether_type", T.StringType()), T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.StringType()),
    T.StructField("length", T.IntegerType()), T.StructField("payload_len", T.IntegerType()),
    T.StructField("payload_hex", T.StringType())])
