"""Synthetic transfers with planted laundering patterns, from a seed."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transfers import _canonical

# Typologies of planted patterns.
TYPOLOGIES = ("FAN-OUT", "FAN-IN", "CYCLE", "SCATTER-GATHER", "GATHER-SCATTER", "BIPARTITE", "STACK", "RANDOM")


def _pattern(kind: str, rng: random.Random, accounts: int, start: int) -> list[tuple[int, int, int]]:
    """(sender, receiver, minute) of one pattern."""
    a = rng.sample(range(accounts), 9)
    steps = {
        "FAN-OUT": [(a[0], x) for x in a[1:7]],
        "FAN-IN": [(x, a[0]) for x in a[1:7]],
        "CYCLE": list(zip(a[:5], [*a[1:5], a[0]])),
        "SCATTER-GATHER": [(a[0], x) for x in a[1:5]] + [(x, a[5]) for x in a[1:5]],
        "GATHER-SCATTER": [(x, a[0]) for x in a[1:5]] + [(a[0], x) for x in a[5:9]],
        "BIPARTITE": [(x, y) for x in a[:3] for y in a[3:6]],
        "STACK": [(x, y) for x, y in zip(a[:3], a[3:6])] + [(x, y) for x, y in zip(a[3:6], a[6:9])],
        "RANDOM": list(zip(a[:6], a[1:7])),
    }[kind]
    return [(s, r, start + 25 * k + rng.randrange(20)) for k, (s, r) in enumerate(steps)]


def generate(spark: SparkSession, accounts: int = 650, banks: int = 20, days: int = 12, rate: float = 0.4, per_typology: int = 6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(transfers, patterns). Background rows come from ``spark.range`` and seeded
    hashes, so any number is made in parallel; patterns are few and made on the driver."""
    n, start, length = int(accounts * days * rate), 27_700_560, days * 1440
    draw = lambda k, below: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(below))
    background = spark.range(n).select((F.lit(start) + draw(1, length)).alias("m_raw"), draw(2, accounts).alias("a"), draw(3, accounts).alias("b"), (draw(4, 500_000) / 100 + 1).alias("amount"), draw(5, 6).alias("f"), F.lit(False).alias("label"), F.lit(-1).alias("pattern"))
    rng, planted, names = random.Random(seed), [], []
    for kind in TYPOLOGIES:
        for _ in range(per_typology):
            size = round(rng.uniform(500, 5000), 2)
            for s, r, m in _pattern(kind, rng, accounts, start + rng.randrange(max(1, length - 400))):
                planted.append((m, s, r, round(size * rng.uniform(0.93, 1), 2), 0, True, len(names)))
            names.append((len(names), kind))
    rows = background.unionByName(spark.createDataFrame(planted, "m_raw long, a long, b long, amount double, f long, label boolean, pattern int"))
    order = F.row_number().over(Window.orderBy("m_raw", "a", "b", "amount")) - 1
    fmt = F.element_at(F.array(*map(F.lit, ("ACH", "Wire", "Credit Card", "Cheque", "Cash", "Bitcoin"))), (F.col("f") + 1).cast("int"))
    bank = lambda c: F.lpad(F.pmod(F.col(c), F.lit(banks)).cast("string"), 3, "0")
    numbered = rows.withColumn("seq", order.cast("long"))
    df = numbered.select(
        "seq", "m_raw", bank("a").alias("from_bank"), F.format_string("A%06d", "a").alias("from_account"), bank("b").alias("to_bank"), F.format_string("A%06d", "b").alias("to_account"),
        F.concat(bank("a"), F.lit(":"), F.format_string("A%06d", "a")).alias("src"), F.concat(bank("b"), F.lit(":"), F.format_string("A%06d", "b")).alias("dst"), F.col("amount").alias("amount_paid"), F.lit("US Dollar").alias("payment_currency"),
        F.col("amount").alias("amount_received"), F.lit("US Dollar").alias("receiving_currency"), fmt.alias("format"), "label",
    )
    keys = numbered.where("pattern >= 0").groupBy("pattern").agg(F.array_sort(F.collect_list("seq")).alias("rows"))
    patterns = spark.createDataFrame(names, "index int, typology string").join(keys, F.col("index") == F.col("pattern")).select("index", "typology", F.transform("rows", lambda x: x.cast("string")).alias("keys"))
    return _canonical(df, clamp=True), patterns
