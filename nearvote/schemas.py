"""Schemas of what is read and written; nothing is inferred."""

REQUEST = (
    "id string, "
    "transaction struct<amount: double, installments: int, requested_at: string>, "
    "customer struct<avg_amount: double, tx_count_24h: int, known_merchants: array<string>>, "
    "merchant struct<id: string, mcc: string, avg_amount: double>, "
    "terminal struct<is_online: boolean, card_present: boolean, km_from_home: double>, "
    "last_transaction struct<timestamp: string, km_from_current: double>"
)
REFERENCE = "vector array<double>, label string"
#: The same as fields of a struct.
_FIELDS = REQUEST.replace(" string, t", ": string, t", 1).replace(" struct<", ": struct<")
WORKLOAD = f"entries array<struct<request: struct<{_FIELDS}>, expected_approved: boolean, expected_fraud_score: float>>"
TELEMETRY = ", ".join(f"f{i} double" for i in range(14)) + ", rows bigint, mode int"
RUN = (
    "run struct<duration: string, target_rps: double, requests_total: bigint, iterations: bigint, actual_rps: double>, "
    "latency struct<p50: double, p90: double, p99: double, max: double>, "
    "scoring struct<breakdown: struct<tp: bigint, tn: bigint, fp: bigint, fn: bigint, http_errors: bigint>, final_score: double>"
)
