"""Schemas of the tables, logs and JSON artefacts the operators work on."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(text: str, dtype: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, dtype) for name in text.split()]


# Column names of the public house-price table.
HOUSE_FEATURES = "MedInc HouseAge AveRooms AveBedrms Population AveOccup Latitude Longitude"
HOUSE_TARGET = "MedHouseVal"
HOUSE = T.StructType(_fields(HOUSE_FEATURES + " " + HOUSE_TARGET, T.DoubleType()))

# Column names of the public NetFlow v2 table, in feature-vector order.
FLOW_NUMERIC = """
L4_SRC_PORT L4_DST_PORT PROTOCOL L7_PROTO IN_BYTES IN_PKTS OUT_BYTES OUT_PKTS TCP_FLAGS
CLIENT_TCP_FLAGS SERVER_TCP_FLAGS FLOW_DURATION_MILLISECONDS DURATION_IN DURATION_OUT MIN_TTL
MAX_TTL LONGEST_FLOW_PKT SHORTEST_FLOW_PKT MIN_IP_PKT_LEN MAX_IP_PKT_LEN
SRC_TO_DST_SECOND_BYTES DST_TO_SRC_SECOND_BYTES RETRANSMITTED_IN_BYTES RETRANSMITTED_IN_PKTS
RETRANSMITTED_OUT_BYTES RETRANSMITTED_OUT_PKTS SRC_TO_DST_AVG_THROUGHPUT
DST_TO_SRC_AVG_THROUGHPUT NUM_PKTS_UP_TO_128_BYTES NUM_PKTS_128_TO_256_BYTES
NUM_PKTS_256_TO_512_BYTES NUM_PKTS_512_TO_1024_BYTES NUM_PKTS_1024_TO_1514_BYTES
TCP_WIN_MAX_IN TCP_WIN_MAX_OUT ICMP_TYPE ICMP_IPV4_TYPE DNS_QUERY_ID DNS_QUERY_TYPE
DNS_TTL_ANSWER FTP_COMMAND_RET_CODE
"""
FLOW_DOUBLE = {"L7_PROTO", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "FTP_COMMAND_RET_CODE"}
FLOW_CATEGORICAL = "IPV4_SRC_ADDR IPV4_DST_ADDR"
FLOW = T.StructType(
    _fields(FLOW_CATEGORICAL, T.StringType())
    + [
        T.StructField(name, T.DoubleType() if name in FLOW_DOUBLE else T.LongType())
        for name in FLOW_NUMERIC.split()
    ]
    + [T.StructField("Label", T.IntegerType()), T.StructField("Attack", T.StringType())]
)

# Header lines of the load-test result and resource-sample files.
BENCH_V1 = "concurrency,rps,avg_latency_ms,p95_latency_ms,p99_latency_ms,error_rate,cpu_percent,ram_mb"
BENCH_V2 = (
    "timestamp,concurrency,rps,latency_avg_ms,latency_p50_ms,latency_p95_ms,latency_p99_ms,"
    "error_rate,total_requests,success_requests,cpu_percent,mem_mb"
)
SAMPLES_V1 = "timestamp,cpu_user,cpu_system,cpu_idle,mem_total_kb,mem_used_kb"
SAMPLES_V2 = "timestamp,cpu_percent,mem_mb"


def text_schema(header: str) -> T.StructType:
    """All columns as text: result files may hold broken numbers, which are coerced later."""
    return T.StructType([T.StructField(name, T.StringType()) for name in header.split(",")])


PARAMS_JSON = """
numerical_features array<string>, categorical_features array<string>,
numerical_medians map<string,variant>, numerical_means map<string,variant>,
numerical_scales map<string,variant>, categorical_categories map<string,variant>
"""
METADATA_JSON = """
feature_names array<string>, numerical_features array<string>, categorical_features array<string>,
target string, classes array<string>, model_type string, input_shape array<int>
"""
