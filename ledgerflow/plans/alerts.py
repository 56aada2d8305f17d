"""From transfers to scored transfers, alerts and evaluation reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detectors, features, metrics, rings
from ..schema import FEATURES, STAGE1, TXN_ONLY, Config
from ..storage import written
from . import models


def staged_transfers(transfers: DataFrame, train_end: int, val_end: int, cfg: Config = Config(), trees: int = 20, depth: int = 3, rate: float = 0.5, values: DataFrame | None = None) -> tuple[DataFrame, list[models.Model]]:
    """All transfers with their feature columns, the number of detectors that fire (``n_detectors``) and ``s1``; and
    the two first-stage models. ``values`` (``features.graph_values``) are found where they aren't given.

    First-stage models learn from transfers before ``train_end`` and stop early on those before ``val_end``.
    """
    values = features.graph_values(transfers, cfg) if values is None else values
    base = features.base_features(transfers, cfg, values=values)
    fired = values.select("seq", features.fired(cfg).alias("n_detectors"))
    rows = transfers.select("seq", "m", "src", "dst", "label", "amount_usd", "format").join(base, "seq").join(fired, "seq", "left").fillna(0, subset=["n_detectors"])
    rows = written(rows, "rows")
    staged, first = models.cross_fitted(rows, F.col("m") < train_end, list(STAGE1), trees, depth, rate, rows.where((F.col("m") >= train_end) & (F.col("m") < val_end)))
    staged = written(staged, "staged")
    full = staged.join(features.neighbour_features(staged, cfg), "seq", "left").fillna(0.0, subset=list(FEATURES[30:]))
    return written(full, "full"), first


def scored_transfers(transfers: DataFrame, train_end: int, val_end: int, cfg: Config = Config(), trees: int = 20, depth: int = 3, rate: float = 0.5, values: DataFrame | None = None) -> tuple[DataFrame, models.Model, list[models.Model]]:
    """All transfers with features, ``s1`` and ``score``; the final model and the first-stage models.

    Models learn from a weighted sample of the transfers before ``train_end``; the number of trees and the threshold follow from those
    between ``train_end`` and ``val_end``; nothing after is seen.
    """
    full, first = staged_transfers(transfers, train_end, val_end, cfg, trees, depth, rate, values)
    train, val = models.weighted_sample(full.where(F.col("m") < train_end), rate), full.where((F.col("m") >= train_end) & (F.col("m") < val_end))
    model = models.with_threshold(models.train_gbdt(train, list(FEATURES), val, trees=trees, depth=depth), val)
    return full.withColumn("score", model.score()), model, first


def alerts(transfers: DataFrame, scored: DataFrame, model: models.Model, cfg: Config = Config(), values: DataFrame | None = None, ring: DataFrame | None = None) -> DataFrame:
    """Alert documents of transfers that score at least the model's threshold.

    Rings of alerts count alerted transfers alone; the ring detector follows the others. ``values`` (``features.graph_values`` with
    evidence) and ``ring`` (``rings.running_rings`` with members) are found where they aren't given.
    """
    hot = written(scored.where(F.col("score") >= model.threshold), "hot")
    flagged = hot.select("seq")
    values = features.graph_values(transfers, cfg, evidence=True, asked=flagged) if values is None else values.join(flagged, "seq", "left_semi")
    ring = rings.ring_states(transfers, flagged, cfg, members=True) if ring is None else ring
    ring = written(ring.join(flagged, "seq", "left_semi"), "rings")
    # The ring detector follows the others, and its evidence becomes edges with theirs.
    linked = F.when(F.col("ring_size") >= cfg.ring_min_size, F.array(F.struct(
        F.lit("ring").alias("name"), F.col("ring_size").cast("double").alias("value"),
        F.format_string("account belongs to a ring of %d accounts linked by %d alerted transfers", F.col("ring_size").cast("long"), F.col("ring_edges").cast("long")).alias("detail"), "evidence")))
    both = detectors.hits(transfers, values, cfg).join(ring.select("seq", linked.alias("linked")), "seq", "full")
    none = F.array().cast(f"array<struct<{detectors.HIT.replace(' ', ':').replace(',:', ',')}>>")
    found = detectors.materialise_evidence(both.select("seq", F.concat(F.coalesce("hits", none), F.coalesce("linked", none)).alias("hits")).where("size(hits) > 0"), transfers, cfg)
    t = transfers.select("seq", "m_raw", "src", "dst", "amount_usd", "payment_currency", "format")
    j = hot.select("seq", "score", model.explain().alias("topFeatures")).join(t, "seq").join(found, "seq", "left").join(ring, "seq", "left")
    every = F.coalesce("detectors", F.array().cast(found.schema["detectors"].dataType))
    return j.select(
        F.concat(F.lit("txn-"), F.col("seq").cast("string")).alias("alertId"), F.col("seq").alias("txId"), S.format_minutes(F.col("m_raw")).alias("timestamp"), F.col("src").cast("string").alias("fromAccount"), F.col("dst").cast("string").alias("toAccount"),
        S.cents(F.col("amount_usd")).alias("amountUsd"), F.col("payment_currency").alias("currency"), F.col("format").alias("paymentFormat"), "score", F.lit(model.threshold).alias("threshold"), F.lit(model.version).alias("modelVersion"),
        F.when(F.col("ring_id").isNotNull(), F.concat(F.lit("R-"), F.col("ring_id").cast("string"))).alias("ringId"), F.coalesce(F.transform("members", lambda x: x.cast("string")), F.array().cast("array<string>")).alias("ringAccounts"), every.alias("detectors"), "topFeatures",
    )


#: Scores that need no model: the amount, the sender's velocity, the number of detectors that fire.
BASELINES = {"amount_rule": "log_amount_usd", "velocity_rule": "src_velocity_24h", "rules_only": "n_detectors"}


def baseline_thresholds(val: DataFrame) -> DataFrame:
    """One row per baseline: ``method``, and the ``threshold`` and ``val_f1`` of its best F1 on validation rows."""
    one = lambda name, c: metrics.best_f1(metrics.pr_sweep(val.select(F.col(c).cast("double").alias("score"), "label"))).select(F.lit(name).alias("method"), "threshold", F.col("f1").alias("val_f1"))
    return reduce(DataFrame.unionByName, (one(name, c) for name, c in BASELINES.items()))


def train_methods(transfers: DataFrame, train_end: int, val_end: int, cfg: Config = Config(), trees: int = 20, depth: int = 3, rate: float = 0.5, epochs: int = 300) -> tuple[DataFrame, dict[str, tuple[Column, float]], str]:
    """Train the three models and fit the three baselines.

    Returns all transfers with their features, per method its score and threshold (``gbdt`` first), and the
    single rule that was stronger on validation rows.
    """
    full, _ = staged_transfers(transfers, train_end, val_end, cfg, trees, depth, rate)
    train, val = models.weighted_sample(full.where(F.col("m") < train_end), rate), full.where((F.col("m") >= train_end) & (F.col("m") < val_end))
    boosted = lambda names: models.train_gbdt(train, list(names), val, trees=trees, depth=depth)
    trained = {"gbdt": boosted(FEATURES), "lr": models.train_lr(train, list(FEATURES), epochs=epochs), "gbdt_txn_only": boosted(TXN_ONLY)}
    methods = {name: (m.score(), models.with_threshold(m, val).threshold) for name, m in trained.items()}
    fitted = {r.method: r for r in baseline_thresholds(val).collect()}
    methods |= {name: (F.col(c).cast("double"), fitted[name].threshold if name in fitted else 1.0) for name, c in BASELINES.items()}
    naive = max(("amount_rule", "velocity_rule"), key=lambda n: fitted[n].val_f1 if n in fitted else 0.0)
    return full, methods, naive


def evaluate(scored: DataFrame, methods: dict[str, tuple[Column, float]], patterns: DataFrame | None = None, start: int | None = None, stop: int | None = None, naive: str | None = None) -> dict:
    """Report of all methods on the rows of a time window, as plain values; the first method also has
    its precision-recall curve, typologies (beside those of the ``naive`` one) and clusters of alerts.

    ``patterns`` have ``index``, ``typology`` and ``keys``, which are ``key`` of the rows.
    """
    window = F.lit(True) if start is None else F.col("m") >= start
    window = window if stop is None else window & (F.col("m") < stop)
    rows = scored.where(window)
    report: dict = {"rows": rows.count(), "positives": rows.where("label").count(), "naive": naive, "methods": {}}
    for k, (name, (score, threshold)) in enumerate(methods.items()):
        own = rows.withColumn("score", score).withColumn("alert", F.col("score") >= threshold)
        sweep = metrics.pr_sweep(own)
        found = metrics.confusion(own, threshold).first().asDict() | {"threshold": threshold, "average_precision": metrics.average_precision(sweep).first().ap}
        if k == 0:
            report["clusters"] = metrics.alert_clusters(own.where("alert")).first().asDict()
            report["curve"] = [r.asDict() for r in metrics.thin(sweep, 200).select("threshold", "precision", "recall").orderBy(F.desc("threshold")).collect()]
        if patterns is not None:
            matched = metrics.matched_patterns(own, patterns)
            found |= metrics.pattern_recall(matched, start=start, stop=stop).first().asDict()
            if k == 0 or name == naive:
                report.setdefault("typologies", {})[name] = [r.asDict() for r in metrics.typology_recall(matched).orderBy("typology").collect()]
        report["methods"][name] = found
    return report


def render(report: dict) -> str:
    """Markdown table of a report's methods."""
    head = ["method", "precision", "recall", "f1", "average_precision", "alerts_per_10k"]
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    lines += ["| " + " | ".join([name, *(f"{r[k]:.3f}" for k in head[1:])]) + " |" for name, r in report["methods"].items()]
    return "\n".join(lines)


def bounded(alerts: DataFrame, emit_from: int | None = None, max_alerts: int | None = None) -> DataFrame:
    """Alert documents of transfers at or after minute ``emit_from``, in arrival order, ``max_alerts`` at most."""
    if emit_from is not None:
        alerts = alerts.where(S.parse_minutes(F.col("timestamp")) >= emit_from)
    return alerts if max_alerts is None else alerts.orderBy("txId").limit(max_alerts)
