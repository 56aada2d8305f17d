"""Sources of transfers: CSV files, JSON documents, event tables; and the pattern files.

Every source gives the canonical columns: ``seq`` (arrival order), ``m_raw`` (event
minute), ``m`` (event minute that never runs backwards), ``src`` and ``dst`` account
keys, banks, amounts, currencies, ``format``, ``label`` and ``amount_usd``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import TRANSFER_CSV, TRANSFER_JSON, Config
from ..storage import written

#: First number of transfers that come without an id.
NUMBERED = 1 << 62

CANONICAL = (
    "seq", "m_raw", "m", "from_bank", "from_account", "to_bank", "to_account", "src", "dst", "amount_paid", "payment_currency",
    "amount_received", "receiving_currency", "format", "label", "amount_usd",
)


def _canonical(df: DataFrame, clamp: bool) -> DataFrame:
    usd = F.col("amount_paid") * S.usd_rate(F.col("payment_currency"))
    df = df.withColumn("amount_usd", usd).withColumn("format", S.payment_format(F.col("format")))
    df = clamp_event_time(df) if clamp else df.withColumn("m", F.col("m_raw"))
    return df.select(*CANONICAL, *(["key"] if "key" in df.columns else []))


def clamp_event_time(df: DataFrame, block: int = 65_536) -> DataFrame:
    """Append ``m``: the largest ``m_raw`` up to the row, in ``seq`` order.

    Late rows are stamped with the clock instead of being dropped. The running maximum is
    taken per block of ``block`` sequence numbers and carried over by a prefix
    maximum over blocks, so only one row a block meets in one task.
    """
    df = df.withColumn("_block", F.floor(F.col("seq") / block))
    upto = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy("_block").agg(F.max("m_raw").alias("_top")).withColumn("_carry", F.max("_top").over(upto)).select("_block", "_carry")
    inside = Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(carried, "_block")
    return joined.withColumn("m", F.greatest(F.max("m_raw").over(inside), F.col("_carry"))).drop("_block", "_carry")


def read_csv(spark: SparkSession, path: str, clamp: bool = True) -> DataFrame:
    """Transfers of CSV files with a header, by column position.

    ``seq`` is the file's row id where it has one, else the row's place: files by path, rows as they stand in
    them. Rows with fewer than ten fields, an unreadable time or amount raise. ``key`` is the row as pattern files name it.
    """
    raw = spark.read.schema(TRANSFER_CSV).option("header", True).option("enforceSchema", True).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    given = F.expr("try_cast(row_text AS BIGINT)")
    if raw.where(given.isNull()).isEmpty():
        return _from_text(raw.withColumn("seq", given), clamp)
    # a task reads a block of a file from its start to its end; blocks are few, their sizes carry the count on
    numbered = written(raw.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1), "rows")
    sizes = numbered.groupBy("_file", "_block").agg(F.count("*").alias("n"))
    upto = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", "_block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_start"))
    placed = numbered.join(F.broadcast(starts), ["_file", "_block"])
    return _from_text(placed.withColumn("seq", F.coalesce(given, F.col("_start") + F.col("_place"))), clamp)


def _from_text(raw: DataFrame, clamp: bool) -> DataFrame:
    needed = lambda c, name: F.when(c.isNull(), F.raise_error(F.concat(F.lit(f"bad {name} at row "), F.col("seq").cast("string")))).otherwise(c)
    number = lambda name: needed(F.expr(f"try_cast({name} AS DOUBLE)"), name)
    df = raw.select(
        "seq", needed(S.parse_minutes(F.col("ts_text")), "timestamp").alias("m_raw"), "from_bank", "from_account", "to_bank", "to_account",
        S.account_key(F.col("from_bank"), F.col("from_account")).alias("src"), S.account_key(F.col("to_bank"), F.col("to_account")).alias("dst"),
        number("amount_paid_text").alias("amount_paid"), "payment_currency", number("amount_received_text").alias("amount_received"), "receiving_currency",
        F.col("format_text").alias("format"), F.when(F.col("label_text") == "1", True).when(F.col("label_text") == "0", False).alias("label"), row_key().alias("key"),
    )
    return _canonical(df, clamp)


def from_json(documents: DataFrame, column: str = "value", clamp: bool = True) -> tuple[DataFrame, DataFrame]:
    """Transfers of JSON texts, each an object or an array of objects.

    Missing received amount or currency take the paid side's. A transfer without an id gets a number from ``NUMBERED`` on, no two the
    same. The whole batch is checked; returns the valid transfers, and ``seq`` and ``errors`` of the others, unreadable documents among them.
    """
    text = F.trim(F.col(column))
    as_array = F.when(F.substring(text, 1, 1) == "[", text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    each = documents.select(F.posexplode_outer(F.from_json(as_array, f"array<{TRANSFER_JSON.simpleString()}>")).alias("pos", "t"))
    t = written(each.withColumn("_at", F.monotonically_increasing_id()).select("_at", F.col("t").isNull().alias("_broken"), "t.*"), "documents")
    bad = lambda cond, what: F.when(cond, F.lit(what))
    amount = F.col("amountPaid")
    errors = F.array_compact(
        F.array(
            bad(F.col("_broken"), "the document is unreadable or empty"),
            bad(amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")) | (amount < 0), "amountPaid must be finite and not negative"),
            bad(S.parse_minutes(F.col("timestamp")).isNull(), "timestamp is unreadable"),
            bad(F.col("fromAccount").isNull() | F.col("toAccount").isNull(), "accounts are required"),
        )
    )
    df = t.select(
        F.coalesce("id", F.col("_at") + NUMBERED).alias("seq"), S.parse_minutes(F.col("timestamp")).alias("m_raw"), F.col("fromBank").alias("from_bank"), F.col("fromAccount").alias("from_account"),
        F.col("toBank").alias("to_bank"), F.col("toAccount").alias("to_account"), S.account_key(F.col("fromBank"), F.col("fromAccount")).alias("src"), S.account_key(F.col("toBank"), F.col("toAccount")).alias("dst"),
        amount.alias("amount_paid"), F.col("paymentCurrency").alias("payment_currency"), F.coalesce("amountReceived", amount).alias("amount_received"),
        F.coalesce("receivingCurrency", "paymentCurrency").alias("receiving_currency"), F.col("paymentFormat").alias("format"), F.lit(None).cast("boolean").alias("label"), errors.alias("errors"),
    )
    valid = _canonical(df.where(F.size("errors") == 0), clamp)
    return valid, df.where(F.size("errors") > 0).select("seq", F.array_join("errors", "; ").alias("errors"))


def from_events(spark: SparkSession, sf_dir: str, clamp: bool = False) -> DataFrame:
    """The transfers view of the ``events`` table: the user sends to the account
    that ``props`` names. Banks, currencies and labels derive from the ids and the value. The
    table's times ascend with its ids, so the clock needs no clamp."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    src, dst = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    money = F.array(*map(F.lit, ("US Dollar", "Euro", "Yuan", "Bitcoin", "Unknown")))
    currency = lambda a: F.element_at(money, (F.pmod(a, F.lit(5)) + 1).cast("int"))
    kind = F.col("event_type")
    fmt = F.when(kind == "click", "ACH").when(kind == "view", "Wire").when(kind == "purchase", "Credit Card").when(kind == "signup", "Cheque").when(kind == "error", "Cash").otherwise("Other")
    df = e.select(
        F.col("event_id").alias("seq"), S.minutes(F.col("ts")).alias("m_raw"), F.pmod(src, F.lit(20)).cast("string").alias("from_bank"), src.cast("string").alias("from_account"),
        F.pmod(dst, F.lit(20)).cast("string").alias("to_bank"), dst.cast("string").alias("to_account"), src.alias("src"), dst.alias("dst"), F.col("value").alias("amount_paid"), currency(src).alias("payment_currency"),
        F.col("value").alias("amount_received"), currency(dst).alias("receiving_currency"), fmt.alias("format"), (F.col("value") > 150).alias("label"),
    )
    return _canonical(df, clamp)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Laundering attempts of text files: ``index`` (files by path, blocks as they stand in them), ``typology``, ``keys``.

    Blocks run from a BEGIN line, which names the typology, to an END line; the lines
    between are raw transfers, whose first ten fields are their key. A block ends with its file at the latest. Files are split
    where they are read, a task each; only a row a file meets in one task, to carry the blocks' number on.
    """
    begin, end = "BEGIN LAUNDERING ATTEMPT", "END LAUNDERING ATTEMPT"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", f"(?m)(?=^{begin})"), lambda x: x.startswith(begin)).alias("blocks"))
    carried = files.select("file", F.size("blocks").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "first")
    each = files.select("file", F.posexplode("blocks").alias("n", "block")).join(carried, "file")
    lines = F.split(F.element_at(F.split("block", f"(?m)^{end}"), 1), "\r?\n")
    key = lambda line: F.array_join(F.slice(F.split(line, ","), 1, 10), ",")
    keys = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.length(F.trim(x)) > 0), key)
    named = F.trim(F.regexp_extract("block", f"^{begin} - ([^:\r\n]*)", 1))
    return each.select((F.col("first") + F.col("n")).cast("int").alias("index"), named.alias("typology"), keys.alias("keys"))


def row_key() -> Column:
    """The first ten raw fields of a transfer file's row, as pattern files name it."""
    return F.array_join(F.array("ts_text", "from_bank", "from_account", "to_bank", "to_account", "amount_received_text", "receiving_currency", "amount_paid_text", "payment_currency", "format_text"), ",")


def split_boundaries(transfers: DataFrame, train: float = 0.6, val: float = 0.8) -> DataFrame:
    """One row: ``train_end`` and ``val_end``, midnights after the rows at these shares.

    The row at ``floor(n * share)`` is found by counting minutes, not by sorting rows.
    """
    per = transfers.groupBy(F.col("m_raw").alias("t")).agg(F.count("*").alias("c"))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("t")))
    midnight = lambda c: (F.ceil(c / 1440) * 1440).cast("long")
    ends = run.agg(midnight(at(train)).alias("train_end"), midnight(at(val)).alias("v"))
    return ends.select("train_end", F.greatest("v", F.col("train_end") + 1440).alias("val_end"))


def first_transfers(transfers: DataFrame, n: int) -> DataFrame:
    """The first ``n`` transfers in arrival order: a shorter replay."""
    return transfers.orderBy("seq").limit(n)


def read_config(spark: SparkSession, path: str) -> Config:
    """A configuration from a JSON file; what it leaves out has its default, an unknown name raises."""
    return Config(**json.loads(spark.read.text(path, wholetext=True).first().value))


def read_splits(spark: SparkSession, path: str) -> tuple[int, int]:
    """(``train_end``, ``val_end``) in minutes from a JSON file that names them as times."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "train_end string, val_end string").alias("s"))
    ends = tuple(row.select(S.parse_minutes(F.col("s.train_end")), S.parse_minutes(F.col("s.val_end"))).first())
    if None in ends or ends[0] >= ends[1]:
        raise ValueError(f"{path} doesn't name two times in order")
    return ends[0], ends[1]
