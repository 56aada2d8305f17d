"""The feature vector of every transfer, as one set-oriented plan.

``txn_features`` needs the transfer alone; ``account_features`` both accounts'
neighbourhoods; scatter-gather, cycles and rings join further accounts in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log1p
from ..schema import PAYMENT_FORMATS, STAGE1, Config
from ..storage import discard, written
from . import adjacency, paths, rings
from .adjacency import peers


def txn_features(transfers: DataFrame) -> DataFrame:
    """``seq`` and the eleven features that need no history."""
    paid = F.col("amount_paid")
    hot = {f"fmt_{f.lower().replace(' ', '_')}": (F.col("format") == f).cast("double") for f in PAYMENT_FORMATS}
    rest = {
        "log_amount_usd": log1p(F.col("amount_usd")),
        "cross_currency": (F.col("payment_currency") != F.col("receiving_currency")).cast("double"),
        "same_bank": (F.col("from_bank") == F.col("to_bank")).cast("double"),
        "round_amount": ((paid >= 100) & (paid % 100 < 1e-9)).cast("double"),
    }
    return transfers.select("seq", *(c.alias(n) for n, c in (hot | rest).items()))


def _share(entries: Column) -> Column:
    return F.when(F.size(entries) == 0, F.lit(0.0)).otherwise(F.size(F.array_remove(entries["ach"], 0)) / F.size(entries))


def _since(entries: str, minutes: int) -> Column:
    return F.size(adjacency.live(entries, minutes))


def pass_through(cfg: Config) -> Column:
    """Struct (gap, ratio, seq) of the latest inbound transfer that the row's
    outbound one forwards; null if none matches. For rows of direction O."""
    forwarded = lambda x: F.try_divide(F.col("amount"), x["amount"]).between(1 - cfg.pass_max_skim, 1 + 1e-6)
    fits = lambda x: (x["m"] >= F.col("m") - cfg.pass_lookback) & (x["peer"] != F.col("peer")) & (x["amount"] > 0) & forwarded(x)
    hit = F.try_element_at(F.filter(F.col("ins"), fits), F.lit(-1))
    return F.struct((F.col("m") - hit["m"]).alias("gap"), (F.col("amount") / hit["amount"]).alias("ratio"), hit["seq"].alias("seq"))


def account_sides(transfers: DataFrame, cfg: Config = Config(), evidence: bool = False, before: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Two rows per transfer, one per account, with all that its neighbourhood gives: the raw values
    (no logarithms) of both directions, the sender's most recent distinct ``funders`` and, with ``evidence``, the
    sequence numbers that a detector would show. Lists stay where they are made (``adjacency.live_adjacency``)."""
    sender = F.col("dir") == "O"
    days = F.greatest((F.col("m") - F.col("first_seen")) / 1440, F.lit(1.0))
    usual = F.col("total_out") / days * (cfg.velocity_window / 1440)
    sent = F.col("sent_24h")
    funders = F.slice(F.array_remove(F.array_distinct(F.reverse(F.col("ins")["peer"])), F.col("peer")), 1, cfg.sg_branch)
    cap = cfg.evidence_cap
    # a list with fewer counterparties never fires; senders show both lists, if both are long enough, receivers what they got
    some = lambda c, fires: F.when(fires, adjacency.recent_per_peer(F.col(c), cap))
    many = lambda c, least: F.size(peers(F.col(c))) >= least
    latest = F.filter(F.reverse("outs"), lambda x: x["m"] >= F.col("m") - cfg.velocity_window)
    recent = F.when(F.size(latest) >= cfg.velocity_min, F.slice(F.transform(latest, lambda x: x["seq"]), 1, cap))
    outs = {
        "n_out": F.size(peers(F.col("outs"))), "degree_out": F.size("outs"),
        "pair_repeat": F.when(sender, F.size(F.filter("outs", lambda x: (x["peer"] == F.col("peer")) & (x["seq"] != F.col("seq"))))),
        "sent_24h": F.when(sender, _since("outs", cfg.velocity_window)), "ach_out": F.when(sender, _share(F.col("outs"))),
    }
    ins = {
        "n_in": F.size(peers(F.col("ins"))), "degree_in": F.size("ins"), "pass": F.when(sender, pass_through(cfg)),
        "got_24h": F.when(~sender, _since("ins", cfg.velocity_window)), "ach_in": F.when(~sender, _share(F.col("ins"))), "funders": F.when(sender & (F.size("ins") > 0), funders),
    }
    if evidence:
        outs |= {"out_ev": some("outs", sender & many("outs", min(cfg.fan_threshold, cfg.gs_min_degree))), "recent_ev": F.when(sender, recent)}
        ins |= {"in_ev": some("ins", F.when(sender, (F.col("n_out") >= cfg.gs_min_degree) & many("ins", cfg.gs_min_degree)).otherwise(many("ins", cfg.fan_threshold)))}
    rows = adjacency.live_adjacency(transfers, outs, ins, cfg, before=before, rows=rows)
    return rows.select(
        "seq", "dir", "m", "acct", "peer", "history", "total_out", "total_in", "n_out", "n_in", (F.col("degree_out") + F.col("degree_in")).alias("degree"),
        F.when(sender, F.struct("pair_repeat", "sent_24h", F.when(usual > 0, sent / usual).otherwise(1.0).alias("velocity_ratio"), F.col("ach_out").alias("ach_share"), "pass")).alias("o"),
        F.when(~sender, F.struct("got_24h", F.col("ach_in").alias("ach_share"))).alias("i"),
        "funders", *(("out_ev", "in_ev", "recent_ev") if evidence else ()),
    )


def account_values(transfers: DataFrame, cfg: Config = Config(), sides: DataFrame | None = None) -> DataFrame:
    """One row per transfer between two accounts: what both neighbourhoods hold. One exchange by account, unless
    ``sides`` are given, and one by transfer."""
    scalars = account_sides(transfers, cfg) if sides is None else sides
    has_evidence = "recent_ev" in scalars.columns
    of = lambda d, c: F.max(F.when(F.col("dir") == d, F.col(c)))
    return scalars.groupBy("seq").agg(
        of("O", "n_out").alias("src_out"), of("O", "n_in").alias("src_in"), of("I", "n_in").alias("dst_in"), of("I", "n_out").alias("dst_out"),
        of("O", "degree").alias("src_degree"), of("I", "degree").alias("dst_degree"), of("O", "history").alias("src_history"), of("I", "history").alias("dst_history"),
        F.max("o").alias("o"), F.max("i").alias("i"),
        *([of("O", "out_ev").alias("src_out_ev"), of("O", "in_ev").alias("src_in_ev"), of("I", "in_ev").alias("dst_in_ev"), of("O", "recent_ev").alias("recent_ev")] if has_evidence else ()),
    ).select(
        "seq", "src_out", "src_in", "dst_in", "dst_out", "src_degree", "dst_degree", "src_history", "dst_history",
        F.col("o.pair_repeat").alias("pair_repeat"), F.col("o.sent_24h").alias("sent_24h"), F.col("o.velocity_ratio").alias("velocity_ratio"),
        F.col("o.ach_share").alias("src_ach_share"), F.col("i.ach_share").alias("dst_ach_share"), F.col("i.got_24h").alias("got_24h"),
        F.col("o.pass.gap").alias("pass_gap"), F.col("o.pass.ratio").alias("pass_ratio"), F.col("o.pass.seq").alias("pass_seq"),
        *(("src_out_ev", "src_in_ev", "dst_in_ev", "recent_ev") if has_evidence else ()),
    )


def graph_values(transfers: DataFrame, cfg: Config = Config(), evidence: bool = False, asked: DataFrame | None = None, before: DataFrame | None = None, rows: DataFrame | None = None, sent: DataFrame | None = None) -> DataFrame:
    """``account_values`` with scatter-gather (``paths``, ``origin``, ``mids``) and cycles (``cycle_len``,
    ``cycle_amount_ratio``, ``cycle_edges``) of every transfer, written out: features, rings and detectors read it.

    ``asked`` limits the result to some ``seq``; ``before`` and ``rows`` are as in ``adjacency.live_adjacency``, ``sent`` as in
    ``paths.scatter_gather``; with these, ``transfers`` serve cycles alone.
    """
    sides = written(account_sides(transfers, cfg, evidence, before, rows), "sides")
    sg, cyc = paths.scatter_gather(transfers, cfg, sides, asked, sent), paths.cycles(transfers, cfg, asked)
    wanted = sides if asked is None else sides.join(asked.select("seq"), "seq", "left_semi")
    values = written(account_values(transfers, cfg, wanted).join(sg, "seq", "left").join(cyc, "seq", "left"), "values")
    discard(sides)
    return values


def base_features(transfers: DataFrame, cfg: Config = Config(), values: DataFrame | None = None, ring: DataFrame | None = None) -> DataFrame:
    """``seq`` and the thirty features that need no model. Transfers to oneself have zeros.

    ``values`` are ``graph_values``, ``ring`` the ``ring_size`` of each transfer; both are found where they aren't given.
    """
    joined = graph_values(transfers, cfg) if values is None else values
    ring = rings.rule_rings(transfers, hit_flags(joined, cfg), cfg) if ring is None else ring
    edge = {
        "src_out_distinct": log1p(F.col("src_out")), "dst_in_distinct": log1p(F.col("dst_in")), "src_in_distinct": log1p(F.col("src_in")), "dst_out_distinct": log1p(F.col("dst_out")),
        "scatter_gather_paths": F.coalesce("paths", F.lit(0)).cast("double"), "gather_scatter_degree": log1p(F.least("src_in", "src_out")),
        "cycle_len": F.coalesce("cycle_len", F.lit(0)).cast("double"), "cycle_amount_ratio": F.coalesce("cycle_amount_ratio", F.lit(0.0)),
        "pass_gap_log_min": log1p(F.coalesce("pass_gap", F.lit(cfg.pass_lookback + 1))), "pass_ratio": F.coalesce("pass_ratio", F.lit(0.0)),
        "src_velocity_24h": log1p(F.col("sent_24h")), "src_velocity_ratio": log1p(F.col("velocity_ratio")), "dst_in_24h": log1p(F.col("got_24h")), "pair_repeat": log1p(F.col("pair_repeat")),
        "src_history": log1p(F.col("src_history")), "dst_history": log1p(F.col("dst_history")), "src_out_ach_share": F.col("src_ach_share"), "dst_in_ach_share": F.col("dst_ach_share"),
    }
    graph = joined.select("seq", *(c.alias(n) for n, c in edge.items()))
    sized = ring.select("seq", log1p(F.col("ring_size")).alias("rule_ring_size"))
    out = txn_features(transfers).join(graph, "seq", "left").join(sized, "seq", "left")
    return out.select("seq", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in STAGE1))


def _firing(cfg: Config) -> dict[str, Column]:
    """When each detector fires, over ``graph_values``."""
    return {
        "fan_out": F.col("src_out") >= cfg.fan_threshold, "fan_in": F.col("dst_in") >= cfg.fan_threshold, "scatter_gather": F.coalesce("paths", F.lit(0)) >= cfg.sg_min_paths,
        "gather_scatter": (F.col("src_in") >= cfg.gs_min_degree) & (F.col("src_out") >= cfg.gs_min_degree), "cycle": F.col("cycle_len").isNotNull(),
        "pass_through": F.coalesce(F.col("pass_gap") <= cfg.pass_window, F.lit(False)), "velocity": (F.col("sent_24h") >= cfg.velocity_min) & (F.col("velocity_ratio") >= cfg.velocity_ratio),
    }


def fired(cfg: Config = Config()) -> Column:
    """How many different detectors fire, over ``graph_values``."""
    return sum((c.cast("int") for c in _firing(cfg).values()), F.lit(0))


def hit_flags(values: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``seq``, whether a structural detector fires, and both accounts' degrees."""
    structural = reduce(lambda a, b: a | b, (c for name, c in _firing(cfg).items() if name != "velocity"))
    return values.select("seq", structural.alias("structural"), "src_degree", "dst_degree")


def neighbour_features(scored: DataFrame | None, cfg: Config = Config(), rows: DataFrame | None = None) -> DataFrame:
    """``seq`` and the three neighbour features from the first-stage scores ``s1``
    of both accounts' other live transfers. 0 where there is none. ``rows`` are account rows with ``s1``, in place of ``scored``."""
    top = lambda c: F.coalesce(F.array_max(F.transform(F.filter(c, lambda x: x["seq"] != F.col("seq")), lambda x: x["s1"])), F.lit(0.0))
    v = adjacency.live_adjacency(scored, {"b": top("outs")}, {"a": top("ins")}, cfg, fields=("m", "peer", "seq", "s1"), extra=("s1",), rows=rows).select("seq", "dir", "a", "b")
    of = lambda d, c: F.max(F.when(F.col("dir") == d, c))
    return v.groupBy("seq").agg(of("O", F.col("a")).alias("nbr_src_in_score"), of("O", F.col("b")).alias("nbr_src_out_score"), of("I", F.greatest("a", "b")).alias("nbr_dst_score"))
