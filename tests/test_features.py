import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import features, paths, rings
from ledgerflow.operators.components import connected
from ledgerflow.schema import STAGE1, Config
from tests.simulator import Simulator

COLUMNS = "seq long, m long, src long, dst long, amount_usd double, format string"


def world(spark, edges):
    """Transfers of (src, dst, minute, amount) in order."""
    rows = [(k, m, a, b, float(x), "ACH" if (a + b) % 3 == 0 else "Wire") for k, (a, b, m, x) in enumerate(edges)]
    df = spark.createDataFrame(rows, COLUMNS)
    same = lambda c: F.lit("US Dollar").alias(c)
    return df.select("*", F.col("amount_usd").alias("amount_paid"), same("payment_currency"), same("receiving_currency"), F.lit("1").alias("from_bank"), F.lit("2").alias("to_bank")), rows


def random_edges(seed, n=260, accounts=9):
    rng, m, out = random.Random(seed), 0, []
    for _ in range(n):
        m += rng.choice([0, 0, 1, 7, 60, 300])
        a, b = rng.randrange(accounts), rng.randrange(accounts)
        out.append((a, b, m, rng.choice([100, 95, 90, 50, 0])))
    return out


@pytest.mark.parametrize("cfg", [Config(), Config(cap=4, window=900, fan_threshold=3, hub_degree=7, ring_rebuild=200, cycle_max_len=4, sg_branch=2)])
def test_against_sequential_simulation(spark, cfg, monkeypatch):
    df, rows = world(spark, random_edges(1))
    sim, want = Simulator(cfg), {}
    for seq, m, a, b, x, f in rows:
        if (got := sim.step(seq, m, a, b, x, int(f == "ACH"))) is not None:
            want[seq] = got
    values = features.account_values(df, cfg)
    joined = values.join(paths.scatter_gather(df, cfg).select("seq", "paths"), "seq", "left").join(paths.cycles(df, cfg).select("seq", "cycle_len"), "seq", "left").cache()
    got = {r.seq: r.asDict() for r in joined.collect()}
    assert got.keys() == want.keys()
    free_of_cap = cfg.cap > 100
    for seq, w in want.items():
        for name, value in w.items():
            if name.startswith("ring_"):
                continue
            have = got[seq][name]
            have = 0 if have is None and name in ("paths", "cycle_len") else have
            assert have == value or (have is not None and value is not None and math.isclose(have, value, rel_tol=1e-9)), (seq, name, have, value)
    if free_of_cap:
        for walk in (rings.WALK, 0):  # epochs as one walk, and split into components
            monkeypatch.setattr(rings, "WALK", walk)
            ring = {r.seq: (r.ring_size, r.ring_id, r.members, r.evidence) for r in rings.rule_rings(df, features.hit_flags(joined, cfg), cfg, members=True).collect()}
            assert ring == {s: (w["ring_size"], w["ring_id"], w["ring_members"], w["ring_evidence"]) for s, w in want.items()}


def test_micro_worlds(spark):
    fan, _ = world(spark, [(0, k, 9 + k, 1) for k in range(1, 7)])
    assert features.account_values(fan).agg(F.max("src_out")).first()[0] == 6
    ring, _ = world(spark, [(1, 2, 1, 1000), (2, 3, 2, 990), (3, 4, 3, 980), (4, 1, 4, 970)])
    found = paths.cycles(ring).collect()
    assert [(r.seq, r.cycle_len, r.cycle_edges) for r in found] == [(3, 4, [0, 1, 2, 3])] and found[0].cycle_amount_ratio > 0.95
    assert not paths.cycles(ring, Config(cycle_max_len=3)).collect()
    back, _ = world(spark, [(2, 3, 1, 1), (1, 2, 2, 1), (3, 1, 3, 1)])
    assert not paths.cycles(back).collect()
    scatter, _ = world(spark, [(0, 1, 1, 1), (0, 2, 1, 1), (0, 3, 1, 1), (2, 9, 5, 1), (3, 9, 6, 1), (1, 9, 7, 1)])
    assert [(r.seq, r.paths, r.origin, r.mids) for r in paths.scatter_gather(scatter).orderBy("seq").collect()] == [(4, 2, 0, [2]), (5, 3, 0, [2, 3])]
    mule, _ = world(spark, [(7, 8, 100, 1000), (8, 9, 130, 950)])
    assert features.account_values(mule).where("pass_gap = 30").count() == 1
    late, _ = world(spark, [(7, 8, 100, 1000), (8, 9, 130, 1500)])
    assert features.account_values(late).where("pass_gap is not null").count() == 0


def test_a_hub_has_bounded_states(spark, monkeypatch):
    """A hub of 10,000 edges: a closing transfer meets what the hub's capped lists hold, in at most two runs of a stretch."""
    cfg, rng = Config(cap=64, window=4000), random.Random(5)
    edges = [(0, rng.randrange(1, 300), k, 10) if k % 2 else (rng.randrange(1, 300), 0, k, 10) for k in range(10_000)] + [(0, 500, 10_000, 9), (500, 501, 10_001, 9), (501, 502, 10_002, 9), (502, 503, 10_003, 9), (503, 0, 10_004, 9)]
    df, _ = world(spark, edges)
    met, plain = [], paths._stepped

    def counted(state, ends, runs, low, high, cfg):
        out = plain(state, ends, runs, low, high, cfg)
        assert runs is not None
        met.append((state.count(), out.count()))
        return out

    monkeypatch.setattr(paths, "_stepped", counted)
    got = {r.seq: r for r in paths.cycles(df, cfg, asked=df.where("seq >= 9900").select("seq")).collect()}
    assert all(n <= cfg.cap * states for states, n in met) and met[0][0] == 105
    assert got[10_004].cycle_len == 5 and got[10_004].cycle_edges == [10_000, 10_001, 10_002, 10_003, 10_004]
    # Of transfers back into the hub, those whose payment by the hub is still in its list close a cycle of two.
    for x in range(9900, 10_000, 2):
        sent = [s for s in range(10_000) if edges[s][0] == 0 and s < x][-cfg.cap :]
        two = [s for s in sent if edges[s][1] == edges[x][0]]
        assert (got[x].cycle_len == 2 and got[x].cycle_edges == [two[-1], x]) if two else x not in got or got[x].cycle_len > 2


def test_self_transfers_and_empty(spark):
    df, _ = world(spark, [(1, 1, 5, 100), (1, 2, 6, 200)])
    rows = {r.seq: r for r in features.base_features(df).collect()}
    assert rows[0]["pass_gap_log_min"] == 0 and rows[0]["src_history"] == 0 and rows[0]["round_amount"] == 1
    assert rows[1]["src_history"] == pytest.approx(math.log(2)) and rows[1]["pass_gap_log_min"] == pytest.approx(math.log(1442))
    assert features.base_features(df.where("seq < 0")).columns == ["seq", *STAGE1] and features.base_features(df.where("seq < 0")).count() == 0


def test_neighbour_scores(spark):
    df, _ = world(spark, [(1, 2, 1, 1), (1, 3, 2, 1), (2, 4, 3, 1)])
    rows = {r.seq: r for r in features.neighbour_features(df.withColumn("s1", F.lit(0.5))).collect()}
    assert (rows[0].nbr_src_out_score, rows[1].nbr_src_out_score, rows[2].nbr_src_in_score) == (0, 0.5, 0.5)


def test_components_match_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    lone = {x for e in edges for x in e} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in parent.items() if x not in lone}


def test_lists_stay_out_of_windows_and_sorted_rows(spark):
    """An account's list is met by position in its runs, so no window holds lists and no row is sorted with one."""
    df, _ = world(spark, random_edges(2))
    for made in (features.account_values(df), features.neighbour_features(df.withColumn("s1", F.lit(0.5)))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Window" in line and "collect_list" in line]
        assert "run" in plan
