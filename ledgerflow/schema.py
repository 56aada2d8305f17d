"""Schemas, fixed tables and the configuration of the transfer engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# US dollars per unit of a currency.
USD_RATES = {
    "US Dollar": 1.0,
    "Euro": 1.1718,
    "UK Pound": 1.2917,
    "Swiss Franc": 1.0929,
    "Yuan": 0.14931,
    "Shekel": 0.29612,
    "Rupee": 0.013616,
    "Ruble": 0.012853,
    "Yen": 0.0094877,
    "Bitcoin": 11881.6,
    "Canadian Dollar": 0.75798,
    "Australian Dollar": 0.70781,
    "Mexican Peso": 0.047297,
    "Saudi Riyal": 0.26659,
    "Brazil Real": 0.17710,
}

# Payment formats that a transfer file can name.
PAYMENT_FORMATS = ("ACH", "Cash", "Cheque", "Credit Card", "Bitcoin", "Wire", "Reinvestment")

#: Transfer files name two columns "Account", so columns go by position.
TRANSFER_CSV = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("ts_text", "from_bank", "from_account", "to_bank", "to_account", "amount_received_text", "receiving_currency", "amount_paid_text", "payment_currency", "format_text", "label_text", "row_text")
    ]
)

#: One transfer as JSON, as the scoring endpoint takes it.
TRANSFER_JSON = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("fromBank", T.StringType()),
        T.StructField("fromAccount", T.StringType()),
        T.StructField("toBank", T.StringType()),
        T.StructField("toAccount", T.StringType()),
        T.StructField("amountPaid", T.DoubleType()),
        T.StructField("paymentCurrency", T.StringType()),
        T.StructField("amountReceived", T.DoubleType()),
        T.StructField("receivingCurrency", T.StringType()),
        T.StructField("paymentFormat", T.StringType()),
    ]
)

EVIDENCE = T.StructType(
    [
        T.StructField("txId", T.LongType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("amountUsd", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("laundering", T.BooleanType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alertId", T.StringType()),
        T.StructField("txId", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("fromAccount", T.StringType()),
        T.StructField("toAccount", T.StringType()),
        T.StructField("amountUsd", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("paymentFormat", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("modelVersion", T.StringType()),
        T.StructField("ringId", T.StringType()),
        T.StructField("ringAccounts", T.ArrayType(T.StringType())),
        T.StructField(
            "detectors",
            T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("detail", T.StringType()), T.StructField("edges", T.ArrayType(EVIDENCE))])),
        ),
        T.StructField("topFeatures", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("contribution", T.DoubleType())]))),
    ]
)


@dataclass(frozen=True)
class Config:
    """Windows, caps and thresholds; minutes unless said otherwise."""

    # The defaults.
    window: int = 5760
    cap: int = 256
    fan_threshold: int = 5
    sg_min_paths: int = 3
    sg_branch: int = 24
    gs_min_degree: int = 3
    cycle_max_len: int = 6
    pass_window: int = 120
    pass_lookback: int = 1440
    pass_max_skim: float = 0.10
    velocity_window: int = 1440
    velocity_min: int = 10
    velocity_ratio: float = 3.0
    hub_degree: int = 100
    ring_min_size: int = 3
    ring_rebuild: int = 360
    ring_members: int = 50
    evidence_cap: int = 30


# The feature vector, in order. The last three come from neighbours' first-stage scores.
FEATURES = (
    *(f"fmt_{f.lower().replace(' ', '_')}" for f in PAYMENT_FORMATS),
    "log_amount_usd", "cross_currency", "same_bank", "round_amount",
    "src_out_distinct", "dst_in_distinct", "src_in_distinct", "dst_out_distinct",
    "scatter_gather_paths", "gather_scatter_degree", "cycle_len", "cycle_amount_ratio",
    "pass_gap_log_min", "pass_ratio", "src_velocity_24h", "src_velocity_ratio", "dst_in_24h",
    "pair_repeat", "rule_ring_size", "src_history", "dst_history", "src_out_ach_share", "dst_in_ach_share",
    "nbr_src_in_score", "nbr_src_out_score", "nbr_dst_score",
)
TXN_ONLY = FEATURES[:11]
STAGE1 = FEATURES[:30]
