"""Column functions of the transfer engine; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PAYMENT_FORMATS, USD_RATES


def parse_minutes(text: Column) -> Column:
    """Minutes since the epoch of ``yyyy/MM/dd HH:mm`` or an ISO timestamp; null if neither."""
    ts = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(text))
    return minutes(ts)


def minutes(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 60_000_000).cast("long")


def format_minutes(m: Column) -> Column:
    """RFC 3339 text of a minute, in UTC."""
    return F.date_format(F.timestamp_seconds(m * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_minutes(m: Column) -> Column:
    """A minute as transfer files write it."""
    return F.date_format(F.timestamp_seconds(m * 60), "yyyy/MM/dd HH:mm")


def account_key(bank: Column, account: Column) -> Column:
    return F.concat_ws(":", bank, account)


def bank_of(key: Column) -> Column:
    """The bank of ``bank:account``; UNKNOWN where either side is missing."""
    at = F.instr(key, ":")
    return F.when((at <= 1) | (at == F.length(key)), F.lit("UNKNOWN")).otherwise(F.substring_index(key, ":", 1))


def account_of(key: Column) -> Column:
    """The account of ``bank:account``; the whole key where either side is missing."""
    at = F.instr(key, ":")
    return F.when((at <= 1) | (at == F.length(key)), key).otherwise(F.substring(key, at + 1, F.length(key)))


def account_label(key: Column) -> Column:
    return F.concat(account_of(key), F.lit(" @"), bank_of(key))


def usd_rate(currency: Column) -> Column:
    """US dollars per unit; 1 for a currency that isn't in the table."""
    table = F.create_map(*[F.lit(x) for pair in USD_RATES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, currency), F.lit(1.0))


def payment_format(text: Column) -> Column:
    return F.when(text.isin(*PAYMENT_FORMATS), text).otherwise("Other")


def log1p(x: Column) -> Column:
    return F.log1p(F.greatest(x.cast("double"), F.lit(0.0)))


def cents(x: Column) -> Column:
    return F.round(x * 100) / 100


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def fold_of(key: Column) -> Column:
    """One of two balanced folds of accounts."""
    return F.pmod(F.xxhash64(key), F.lit(2)).cast("int")


def keep_negative(row: Column, rate: float) -> Column:
    """A deterministic sample of rows, by a hash of the id."""
    digest = F.substring(F.md5(F.concat(F.lit("row:"), row.cast("string"))), 1, 12)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(1_000_000)) < int(rate * 1_000_000)


def split_of(m: Column, train_end: Column | int, val_end: Column | int) -> Column:
    return F.when(m < train_end, "train").when(m < val_end, "val").otherwise("test")


def priority(max_score: Column, alerts: Column, total: Column) -> Column:
    # The bounds of a case's priority.
    return (
        F.when(((max_score >= 0.9) & (alerts >= 3)) | (total >= 1_000_000), "CRITICAL")
        .when((max_score >= 0.85) | (alerts >= 5) | (total >= 100_000), "HIGH")
        .when(max_score >= 0.6, "MEDIUM")
        .otherwise("LOW")
    )


def case_reference(year: Column, number: Column) -> Column:
    return F.format_string("CASE-%d-%06d", year.cast("int"), number.cast("long"))


# Codes of reports.
_CURRENCY_CODES = {
    "us dollar": "USD", "euro": "EUR", "yuan": "CNY", "yen": "JPY", "rupee": "INR", "swiss franc": "CHF", "shekel": "ILS", "canadian dollar": "CAD",
    "australian dollar": "AUD", "uk pound": "GBP", "mexican peso": "MXN", "brazil real": "BRL", "ruble": "RUB", "saudi riyal": "SAR", "bitcoin": "XBT",
}
_MODES = {"ach": "ACH", "wire": "WIRE", "cheque": "CHEQUE", "credit card": "CARD", "cash": "CASH", "bitcoin": "VIRTUAL", "reinvestment": "INTERNAL"}
_INDICATORS = {
    "fan_out": ("FANOUT", "Rapid dispersal of funds to many accounts (fan-out)"),
    "fan_in": ("FANIN", "Funds collected from many accounts (fan-in)"),
    "cycle": ("CYCLE", "Circular movement of funds returning to origin"),
    "scatter_gather": ("SCATGATH", "Scatter-gather layering through intermediaries"),
    "gather_scatter": ("GATHSCAT", "Gather-scatter consolidation then dispersal"),
    "pass_through": ("PASSTHRU", "Pass-through account: funds in and out within a short window"),
    "velocity": ("VELOCITY", "Unusual transaction velocity"),
    "ring": ("RING", "Member of a connected money-mule ring"),
    "model": ("MODEL", "Model risk score above alert threshold"),
}
_OTHER_INDICATOR = ("OTHER", "Other suspicious network pattern")


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return F.coalesce(found, F.lit(default))


def currency_code(currency: Column) -> Column:
    """ISO code of a currency's name; three capitals pass, others are XXX."""
    t = F.trim(currency)
    return F.when(t.rlike("^[A-Z]{3}$"), t).otherwise(_lookup(_CURRENCY_CODES, F.lower(t), "XXX"))


def transmode(fmt: Column) -> Column:
    return _lookup(_MODES, F.lower(F.trim(fmt)), "OTHER")


def funds_code(fmt: Column) -> Column:
    mode = transmode(fmt)
    return F.when(mode.isin("CASH", "VIRTUAL", "CHEQUE"), mode).otherwise("ACCOUNT")


def indicator_code(detector: Column, prefix: str = "") -> Column:
    """Code of a detector in reports, behind the reporting system's ``prefix``."""
    return F.concat(F.lit(prefix), _lookup({k: v[0] for k, v in _INDICATORS.items()}, detector, _OTHER_INDICATOR[0]))


def indicator_text(detector: Column) -> Column:
    return _lookup({k: v[1] for k, v in _INDICATORS.items()}, detector, _OTHER_INDICATOR[1])


def detector_names(detectors: Column) -> Column:
    """Distinct detector names in order, joined, at most 512 characters."""
    return F.substring(F.array_join(F.array_distinct(F.transform(detectors, lambda d: d["name"])), ","), 1, 512)
