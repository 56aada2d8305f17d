"""Queries over all that their tables hold, on small tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow import registry
from ledgerflow.operators import adjacency
from ledgerflow.schema import Config


def events(spark, folder, rows):
    """An ``events`` table of (user, k, day, value)."""
    begin = datetime(2024, 1, 1)
    made = [(k, begin + timedelta(days=day, minutes=k), user, "click", float(value), f'{{"k": {peer}}}') for k, (user, peer, day, value) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["case_grouping", "case_rollup_priority"])
def test_cases_follow_accounts_over_the_whole_history(spark, tmp_path, name):
    """Alerts of one account belong to one case, however many days lie between them."""
    sf = events(spark, tmp_path, [(1, 2, 0, 300), (1, 3, 20, 400), (4, 3, 40, 500), (7, 8, 40, 600), (1, 9, 41, 10)])
    rows = registry.QUERIES[name](spark, sf).collect()
    if name == "case_grouping":
        assert {r.alert_id: r.case_id for r in rows} == {"txn-0": 0, "txn-1": 0, "txn-2": 0, "txn-3": 3}
    else:
        assert {r.case_id: (r.alert_count, r.accounts, r.total_amount_usd) for r in rows} == {0: (3, 4, 1200.0), 3: (1, 2, 600.0)}


def test_alerts_and_features_share_one_pass_over_the_graph(spark, tmp_path, monkeypatch):
    sf, made, given = events(spark, tmp_path, [(1, 2, day, 10 + day) for day in range(10)]), [], []
    monkeypatch.setattr(registry.features, "graph_values", lambda *a, **k: made.append(k) or spark.range(1))
    monkeypatch.setattr(registry.alert_plan, "scored_transfers", lambda t, *a, **k: given.append(k["values"]) or (t, None, []))
    monkeypatch.setattr(registry.alert_plan, "alerts", lambda t, scored, model, cfg, values=None: given.append(values) or t.selectExpr("seq AS alertId"))
    registry.QUERIES["alert_payload"](spark, sf)
    assert [k.get("evidence") for k in made] == [True] and len(given) == 2 and given[0] is given[1]


def test_evidence_is_made_where_a_detector_shows_it(spark, tmp_path):
    """Senders show both lists, receivers what they got; natively sorted lists give each counterparty's latest transfer, newest first."""
    rows = [(1, 2, 0, 10), (3, 2, 0, 10), (4, 2, 0, 10), (2, 5, 0, 10), (2, 6, 0, 10), (1, 2, 1, 10), (2, 7, 1, 10), (8, 2, 1, 10), (9, 2, 1, 10)]
    t = registry.transfers(spark, events(spark, tmp_path, rows))
    sides = {(r.seq, r.dir): r for r in registry.features.account_sides(t, registry.CFG, evidence=True).collect()}
    assert sides[(6, "O")].out_ev == [6, 4, 3] and sides[(6, "O")].in_ev == [5, 2, 1]
    assert sides[(4, "O")].out_ev is None and sides[(4, "O")].in_ev is None  # two receivers
    assert sides[(8, "I")].in_ev == [8, 7, 5, 2, 1] and sides[(7, "I")].in_ev is None  # five senders, four
    assert all(r.out_ev is None for (_, d), r in sides.items() if d == "I")
    hits = {(r.seq, r.name): r.evidence for r in registry.QUERIES["detector_hits"](spark, str(tmp_path)).collect()}
    assert hits[(8, "fan_in")] == "8,7,5,2,1" and hits[(6, "gather_scatter")] == "5,2,1,6,4,3"


def test_live_entries_of_minutes_in_any_order(spark):
    """Live lists, the latest of each counterparty in them and the highest score of others, against a plain pass; and none asks each entry where minutes ascend."""
    cfg, rng = Config(cap=40, window=50), random.Random(9)
    rows, held, want = [], [], {}
    for k in range(400):
        m = k if k < 200 else rng.randrange(180, 420)
        rows.append((k, m, 1 + rng.randrange(5) * (rng.random() < 0.6), 99, 1.0, "Wire", float(k * 37 % 101)))
        held = [*held, rows[-1]][-cfg.cap :]
        live = [r for r in held if r[1] >= m - cfg.window]
        latest = {r[2]: r[0] for r in live}
        want[k] = [r[0] for r in live], sorted(latest.values(), reverse=True)[:3], max([r[6] for r in live if r[0] != k], default=0.0)
    t = spark.createDataFrame(rows, "seq long, m long, src long, dst long, amount_usd double, format string, s1 double")
    ins = {"live": F.transform("ins", lambda x: x["seq"]), "latest": adjacency.recent_per_peer(F.col("ins"), 3)}
    got = adjacency.live_adjacency(t, {}, ins, cfg).where("dir = 'I'").collect()
    assert {r.seq: (r.live, r.latest) for r in got} == {k: w[:2] for k, w in want.items()}
    near = {r.seq: r.nbr_dst_score for r in registry.features.neighbour_features(t, cfg).collect()}
    assert near == {k: w[2] for k, w in want.items()}
    plan = adjacency.live_adjacency(t, {}, ins, cfg)._jdf.queryExecution().executedPlan().toString()
    assert "array_position(sort_array" in plan
