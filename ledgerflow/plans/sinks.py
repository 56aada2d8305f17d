"""Sinks: sorted transfer files, pattern files, alert lines, case reports."""

from __future__ import annotations

import hashlib
import json
from html import escape
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import detector_names, file_minutes


def transfer_lines(transfers: DataFrame) -> DataFrame:
    """Transfers as the columns of a transfer file, with ``Row Id``, by time then arrival."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    flag = F.when(F.col("label"), "1").when(~F.col("label"), "0").otherwise("")
    return transfers.orderBy("m_raw", "seq").select(
        file_minutes(F.col("m_raw")).alias("Timestamp"), F.col("from_bank").alias("From Bank"), F.col("from_account").alias("Account"), F.col("to_bank").alias("To Bank"), F.col("to_account").alias("Account_to"), two("amount_received").alias("Amount Received"),
        F.col("receiving_currency").alias("Receiving Currency"), two("amount_paid").alias("Amount Paid"), F.col("payment_currency").alias("Payment Currency"), F.col("format").alias("Payment Format"), flag.alias("Is Laundering"), F.col("seq").alias("Row Id"),
    )


def write_transfers(transfers: DataFrame, path: str) -> None:
    transfer_lines(transfers).write.mode("overwrite").option("header", True).csv(path)


def write_patterns(patterns: DataFrame, path: str) -> None:
    """Pattern blocks as text, one row a block."""
    block = F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), "typology", F.lit(": \n"), F.array_join("keys", "\n"), F.lit("\nEND LAUNDERING ATTEMPT - "), "typology", F.lit("\n"))
    patterns.orderBy("index").select(block.alias("value")).write.mode("overwrite").text(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """One JSON document a line."""
    alerts.select(F.to_json(F.struct(*alerts.columns)).alias("value")).write.mode("overwrite").text(path)


def report_xml(case: dict, alerts: list[dict]) -> tuple[str, str]:
    """Report document of one case, and its SHA-256. A terminal renderer: one case's rows."""
    root = ET.Element("report")
    for name in ("reference", "reason", "priority"):
        ET.SubElement(root, name).text = str(case.get(name, ""))
    for a in alerts:
        t = ET.SubElement(root, "transaction", number=str(a["tx_id"]))
        for name in ("from_account", "to_account", "amount_usd", "event_ts"):
            ET.SubElement(t, name).text = str(a[name])
    ET.indent(root)
    text = ET.tostring(root, encoding="unicode")
    return text, hashlib.sha256(text.encode()).hexdigest()


def report_html(case: dict, nodes: list[dict], edges: list[dict]) -> str:
    """Summary page of one case with its flow table; every value is escaped."""
    row = lambda cells: "<tr>" + "".join(f"<td>{escape(str(c))}</td>" for c in cells) + "</tr>"
    body = "".join(row((e["source"], e["target"], e["amount"], e["detectors"])) for e in edges)
    who = "".join(row((n["label"], n["role"])) for n in nodes)
    return f"<!DOCTYPE html><html><head><title>{escape(str(case['reference']))}</title></head><body><h1>{escape(str(case['reference']))}</h1><p>{escape(str(case.get('reason', '')))}</p><table>{who}</table><table>{body}</table></body></html>"


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alert documents as rows of the case store: amounts in cents, detector names joined, the evidence as JSON."""
    return alerts.select(
        F.col("alertId").alias("alert_id"), F.col("txId").alias("tx_id"), F.col("timestamp").alias("event_ts"), F.col("fromAccount").alias("from_account"), F.col("toAccount").alias("to_account"), F.col("amountUsd").cast("decimal(19,2)").alias("amount_usd"),
        "currency", F.col("paymentFormat").alias("payment_format"), "score", "threshold", F.col("modelVersion").alias("model_version"), F.col("ringId").alias("ring_id"), F.coalesce("ringAccounts", F.array().cast("array<string>")).alias("ring_accounts"),
        detector_names(F.coalesce("detectors", F.array().cast(alerts.schema["detectors"].dataType))).alias("detector_names"), F.to_json("detectors").alias("evidence_json"), "detectors",
    )


def write_report(report: dict, path: str, spark: SparkSession) -> None:
    """An evaluation report under ``path``: ``report`` (JSON), ``table`` (Markdown) and ``curve`` (CSV). A few rows, whatever was evaluated."""
    from .alerts import render

    text = lambda name, value: spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    text("report", json.dumps(report))
    text("table", render(report))
    spark.createDataFrame([(r["threshold"], r["precision"], r["recall"]) for r in report["curve"]], "threshold double, precision double, recall double").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/curve")


def report_rows(reports: DataFrame) -> DataFrame:
    """Metadata of written reports (``case_id``, ``id``, ``report_type``, ``content`` as bytes): size and SHA-256, without the content."""
    return reports.select("case_id", "id", "report_type", F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
