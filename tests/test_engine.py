"""Sources, functions, evaluation, cases, models, sinks and streaming on small fixtures."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerflow import registry
from ledgerflow.functions import scalars as S
from ledgerflow.operators import cases, detectors, features, metrics
from ledgerflow.plans import alerts, models, sinks
from ledgerflow.schema import ALERT, Config
from ledgerflow.sources import synth, transfers
from ledgerflow.streaming import keyed, replay
from ledgerflow.streaming.replay import Replay
from tests.test_features import world


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    m = one(spark, S.parse_minutes(F.lit("2022/09/01 00:20")))
    assert one(spark, S.format_minutes(F.lit(m))) == "2022-09-01T00:20:00Z" and one(spark, S.parse_minutes(F.lit("2022-09-01T00:20:00Z"))) == m
    assert one(spark, S.parse_minutes(F.lit("2022/13/01 00:20"))) is None and one(spark, S.file_minutes(F.lit(m))) == "2022/09/01 00:20"
    assert [one(spark, S.bank_of(F.lit(k))) for k in ("1:2", ":2", "1:", "12")] == ["1", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert one(spark, S.account_label(F.lit("070:A:B"))) == "A:B @070"
    assert one(spark, S.usd_rate(F.lit("Euro"))) == 1.1718 and one(spark, S.usd_rate(F.lit("?"))) == 1.0
    assert [one(spark, S.currency_code(F.lit(c))) for c in ("Euro", " euro ", "GBP", "gbp", None)] == ["EUR", "EUR", "GBP", "XXX", "XXX"]
    assert [one(spark, S.funds_code(F.lit(c))) for c in ("Bitcoin", "cash", "ACH", "?")] == ["VIRTUAL", "CASH", "ACCOUNT", "ACCOUNT"]
    assert one(spark, S.indicator_code(F.lit("cycle"), "X-")) == "X-CYCLE" and one(spark, S.case_reference(F.lit(2024), F.lit(7))) == "CASE-2024-000007"


@pytest.mark.parametrize("row", [(0.9, 3, 1, "CRITICAL"), (0.1, 1, 1_000_000, "CRITICAL"), (0.86, 1, 1, "HIGH"), (0.1, 5, 1, "HIGH"), (0.6, 1, 1, "MEDIUM"), (0.59, 1, 1, "LOW")])
def test_priority(spark, row):
    assert one(spark, S.priority(*(F.lit(x) for x in row[:3]))) == row[3]


CSV = """Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering,Row Id
2023/03/05 10:26,0077,5501A,0031,7702B,310.25,Euro,310.25,Euro,ACH,1,0
2023/03/05 10:24,0077,5501A,0031,7702B,5,Euro,100,Euro,Odd,0,1
"""


def test_csv_source_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    rows = transfers.read_csv(spark, str(tmp_path / "t.csv")).orderBy("seq").collect()
    assert [(r.src, r.dst, r.format, r.label) for r in rows] == [("0077:5501A", "0031:7702B", "ACH", True), ("0077:5501A", "0031:7702B", "Other", False)]
    assert rows[1].m_raw == rows[0].m_raw - 2 and rows[1].m == rows[0].m and rows[0].amount_usd == pytest.approx(310.25 * 1.1718)
    sinks.write_transfers(transfers.read_csv(spark, str(tmp_path / "t.csv")), str(tmp_path / "out"))
    again = transfers.read_csv(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [r.amount_paid for r in again] == [310.25, 100.0] and [r.m_raw for r in again] == [r.m_raw for r in rows]
    (tmp_path / "bad.csv").write_text(CSV.replace("2023/03/05 10:24", "never"))
    with pytest.raises(Exception, match="bad timestamp"):
        transfers.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_json_source(spark):
    docs = [json.dumps({"id": 4, "timestamp": "2022-09-01T00:20:00Z", "fromBank": "1", "fromAccount": "a", "toBank": "2", "toAccount": "b", "amountPaid": 10.5, "paymentCurrency": "Euro"}), json.dumps([{"timestamp": "x", "fromAccount": "a", "toAccount": "b", "amountPaid": -1}])]
    good, bad = transfers.from_json(spark.createDataFrame([(d,) for d in docs], "value string"))
    assert [(r.seq, r.amount_received, r.receiving_currency) for r in good.collect()] == [(4, 10.5, "Euro")]
    assert "timestamp is unreadable" in bad.first().errors and "amountPaid" in bad.first().errors
    bare = json.dumps({"timestamp": "2022-09-01T00:20:00Z", "fromBank": "1", "fromAccount": "a", "toBank": "2", "toAccount": "b", "amountPaid": 1})
    good, bad = transfers.from_json(spark.createDataFrame([(bare,), (bare,), ("{broken",), ("",), (f"[{bare}, {bare}]",)], "value string"))
    numbers = [r.seq for r in good.collect()]
    assert len(numbers) == len(set(numbers)) == 4 and bad.count() == 2 and all("unreadable or empty" in r.errors for r in bad.collect())


def test_csv_without_row_ids_keeps_the_order_of_files(spark, tmp_path):
    head = CSV.splitlines()[0].removesuffix(",Row Id")
    line = "2023/03/05 10:{:02d},1,{},2,b,1,Euro,1,Euro,ACH,0"
    for name, part in (("a.csv", range(0, 400)), ("b.csv", range(400, 700))):
        (tmp_path / name).write_text("\n".join([head, *(line.format(k % 60, k) for k in part)]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = transfers.read_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.seq, int(r.from_account)) for r in rows) == [(k, k) for k in range(700)]
    patterns = spark.createDataFrame([(0, "CYCLE", [rows[0].key, rows[1].key])], "index int, typology string, keys array<string>")
    read = transfers.read_csv(spark, str(tmp_path)).withColumn("alert", F.lit(True))
    assert metrics.matched_patterns(read, patterns).count() == 2


def test_patterns_round_trip(spark, tmp_path):
    (tmp_path / "p.txt").write_text("BEGIN LAUNDERING ATTEMPT - CYCLE: Max 2 hops\na,b,c,d,e,f,g,h,i,j,1\nk,l,m,n,o,p,q,r,s,t,1\nEND LAUNDERING ATTEMPT - CYCLE\n\nBEGIN LAUNDERING ATTEMPT - FAN-IN: x\nEND LAUNDERING ATTEMPT - FAN-IN\n")
    got = transfers.read_patterns(spark, str(tmp_path / "p.txt"))
    assert [tuple(r) for r in got.orderBy("index").collect()] == [(0, "CYCLE", ["a,b,c,d,e,f,g,h,i,j", "k,l,m,n,o,p,q,r,s,t"]), (1, "FAN-IN", [])]
    sinks.write_patterns(got, str(tmp_path / "out"))
    assert transfers.read_patterns(spark, str(tmp_path / "out")).count() == 2
    many = spark.createDataFrame([(k, f"T{k % 7}", [f"{k},{j},c,d,e,f,g,h,i,j" for j in range(k % 5)]) for k in range(200)], "index int, typology string, keys array<string>")
    sinks.write_patterns(many.repartitionByRange(3, "index"), str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    assert sorted(map(tuple, transfers.read_patterns(spark, str(tmp_path / "many")).collect())) == sorted(map(tuple, many.collect()))
    # Files side by side, one with windows' line ends and words outside of blocks.
    (tmp_path / "a.txt").write_text("# head\r\nBEGIN LAUNDERING ATTEMPT - FAN-OUT\r\na,b,c,d,e,f,g,h,i,j,1\r\nEND LAUNDERING ATTEMPT - FAN-OUT\r\nafter\r\n")
    both = transfers.read_patterns(spark, str(tmp_path / "*.txt")).orderBy("index").collect()
    assert [tuple(r) for r in both] == [(0, "FAN-OUT", ["a,b,c,d,e,f,g,h,i,j"]), (1, "CYCLE", ["a,b,c,d,e,f,g,h,i,j", "k,l,m,n,o,p,q,r,s,t"]), (2, "FAN-IN", [])]


def test_confusion_and_average_precision(spark):
    four = spark.createDataFrame([(0.9, True), (0.8, False), (0.2, True), (0.1, False)], "score double, label boolean")
    r = metrics.confusion(four, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1, r.alerts_per_10k) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 5000)
    good = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.1, False)], "score double, label boolean")
    sweep = metrics.pr_sweep(good)
    assert metrics.average_precision(sweep).first().ap == 1 and metrics.best_f1(sweep).first().threshold == 0.8
    assert metrics.confusion(four.where("false"), 0.5).first().f1 == 0 and metrics.thin(sweep, 2).count() <= 3


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), min_size=1, max_size=25))
def test_sweep_is_the_explicit_confusion(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(s / 10, y) for s, y in rows], "score double, label boolean")
    positives = sum(y for _, y in rows)
    for r in metrics.pr_sweep(df).collect():
        hit = [y for s, y in rows if s / 10 >= r.threshold]
        assert r.tp == sum(hit) and r.fp == len(hit) - sum(hit) and r.recall == pytest.approx(sum(hit) / positives if positives else 0)


def alert(no, a, b, ring=None, members=()):
    return (f"a{no}", no, no, a, b, 100.0, 0.95, ring, list(members), f"2024-01-0{no}T00:00:00Z", [])


ALERTS = "alert_id string, alert_no long, tx_id long, from_account string, to_account string, amount_usd double, score double, ring_id string, ring_accounts array<string>, event_ts string, detectors array<struct<name:string,edges:array<struct<txId:long,from:string,to:string,amountUsd:double,timestamp:string,laundering:boolean>>>>"


def test_case_grouping_and_graph(spark):
    df = spark.createDataFrame([alert(1, "1:A", "1:B"), alert(2, "1:C", "1:D"), alert(3, "1:B", "1:C"), alert(4, "2:X", "2:Y", "R-1"), alert(5, "2:Z", "2:W", "R-1", ["2:Q"]), alert(6, "3:M", "3:N", " ")], ALERTS)
    groups = {r.alert_id: r.case_id for r in cases.group_cases(df).collect()}
    assert groups == {"a1": 1, "a2": 1, "a3": 1, "a4": 4, "a5": 4, "a6": 6}
    rolled = {r.case_id: r for r in cases.case_rollup(df, cases.group_cases(df)).collect()}
    assert (rolled[1].alert_count, rolled[1].accounts, rolled[1].priority) == (3, 4, "CRITICAL")
    edges = cases.graph_edges(df.where("alert_no <= 3"))
    roles = {r.id: r.role for r in cases.graph_nodes(edges, df.where("alert_no <= 3")).collect()}
    assert edges.count() == 3 and roles == {"1:A": "source", "1:B": "intermediary", "1:C": "intermediary", "1:D": "sink"}
    assert cases.new_alerts(df.select("alert_id", F.col("alert_no").alias("position")).unionByName(df.select("alert_id", (F.col("alert_no") + 10).alias("position"))), df.where("alert_no = 1").select("alert_id")).count() == 5
    with pytest.raises(ValueError):
        cases.case_page(df, "nothing")


def test_workflow_fold(spark):
    log = [("TRANSITION", "INVESTIGATING", None, "ann"), ("TRANSITION", "OPEN", None, "ann"), ("TRANSITION", "ESCALATED", None, "ann"), ("FILING_REQUESTED", None, None, "ann"), ("REPORT_GENERATED", "STR_XML", None, "ann"), ("FILING_REQUESTED", None, None, "ann")]
    log += [("TRANSITION", "CLOSED", "FALSE_POSITIVE", "bob"), ("FILING_APPROVED", None, None, "ann"), ("FILING_APPROVED", None, None, "bob"), ("COMMENT", None, None, "ann")]
    rows = [(1, k, a, t, d, who, None) for k, (a, t, d, who) in enumerate(log)] + [(2, 0, "TRANSITION", "INVESTIGATING", None, "x", None), (2, 1, "TRANSITION", "CLOSED", "STR_FILED", "x", None), (2, 2, "TRANSITION", "CLOSED", None, "x", None), (2, 3, "ASSIGNED", None, None, "x", "carol")]
    df = spark.createDataFrame(rows, "case_id long, event_id long, action string, to_status string, disposition string, actor string, assignee string")
    got = {r.case_id: (r.status, r.disposition, r.assignee, r.applied, r.rejected) for r in cases.fold_status(df).collect()}
    assert got == {1: ("CLOSED", "STR_FILED", None, 6, 4), 2: ("INVESTIGATING", None, "carol", 2, 2)}


def test_cases_over_two_batches(spark):
    """Merge into the oldest, closed cases stay closed, a shared ring id joins, duplicates keep their case."""
    df = spark.createDataFrame([alert(1, "1:A", "1:B"), alert(2, "1:C", "1:D"), alert(3, "7:X", "7:Y"), alert(4, "8:R", "8:S", "R-1"), alert(5, "1:B", "1:C"), alert(6, "7:X", "7:Z"), alert(7, "9:M", "9:N", "R-1"), alert(8, "9:N", "9:O")], ALERTS)
    first, second = df.where("alert_no < 5"), df.where("alert_no >= 5")
    empty = spark.createDataFrame([], "case_id long, status string, created_at long, merged_into long")
    members, opened, merges = cases.attach(first, first.where("false"), first.where("false").select("alert_id", F.col("alert_no").alias("case_id")), empty)
    assert {r.case_id for r in opened.collect()} == {1, 2, 3, 4} and merges.count() == 0
    closed = opened.withColumn("status", F.when(F.col("case_id") == 3, "CLOSED").otherwise(F.col("status")))
    members, after, merges = cases.attach(second, first, members, closed)
    got = {r.alert_id: r.case_id for r in members.collect()}
    assert got == {"a1": 1, "a2": 1, "a5": 1, "a3": 3, "a6": 6, "a4": 4, "a7": 4, "a8": 4}
    assert {(r.case_id, r.status, r.merged_into) for r in after.collect()} == {(1, "OPEN", None), (2, "MERGED", 1), (3, "CLOSED", None), (4, "OPEN", None), (6, "OPEN", None)}
    assert [tuple(r) for r in merges.collect()] == [(2, 1)]
    events = sorted((r.case_id, r.action, r.to_status, r.detail) for r in cases.attachment_events(second, members, closed, merges).collect())
    assert [e for e in events if e[1] != "ALERT_ATTACHED"] == [(1, "MERGED", "OPEN", "absorbed case 2"), (2, "MERGED", "MERGED", "into case 1"), (6, "CASE_CREATED", "OPEN", "alert a6")]
    assert [(e[0], e[3]) for e in events if e[1] == "ALERT_ATTACHED"] == [(1, "alert a5"), (4, "alert a7"), (4, "alert a8"), (6, "alert a6")]
    batch = spark.createDataFrame([("a1", 0), ("n1", 1), ("n1", 2)], "alert_id string, position long")
    known = members.unionByName(spark.createDataFrame([("n1", 9)], "alert_id string, case_id long"))
    assert [tuple(r) for r in cases.outcomes(batch, first, known).orderBy("position").collect()] == [(0, "a1", "DUPLICATE", 1), (1, "n1", "ACCEPTED", 9), (2, "n1", "DUPLICATE", 9)]
    filings = spark.createDataFrame([(1, 5, "REJECTED"), (1, 7, "PENDING")], "case_id long, id long, status string")
    reports = spark.createDataFrame([(1, 2, "STR_XML", b"xy"), (1, 1, "HTML", b"")], "case_id long, id long, report_type string, content binary")
    d = {r.case_id: r for r in cases.case_details(after, members, df, filings, sinks.report_rows(reports)).collect()}
    assert [a.alert_id for a in d[1].alerts] == ["a1", "a2", "a5"] and d[1].accounts == ["1:A", "1:B", "1:C", "1:D"] and d[1].filing.status == "PENDING" and [r.id for r in d[1].reports] == [1, 2]
    assert d[4].ring_ids == ["R-1"] and d[1].allowed == ["INVESTIGATING"] and d[3].allowed == [] and d[2].alerts is None and d[1].reports[1].size_bytes == 2
    page, total = cases.case_page(after, "created_at", size=2, statuses=("OPEN",))
    assert total == 3 and [r.case_id for r in page.collect()] == [6, 4]


def test_indicators_by_first_appearance(spark):
    rows = [("b", 2, "2024-01-02", ["velocity", "cycle"]), ("a", 1, "2024-01-03", ["fan_out"]), ("c", 3, "2024-01-01", []), ("d", 4, "2024-01-09", None), ("e", 5, "2024-01-09", ["nothing known"])]
    df = spark.createDataFrame(rows, "alert_id string, alert_no long, event_ts string, names array<string>").withColumn("detectors", F.transform("names", lambda n: F.struct(n.alias("name"))))
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3)], "alert_id string, case_id long")
    got = {r.case_id: r.indicators for r in cases.str_indicators(df, members, "P-").collect()}
    assert got == {1: ["P-VELOCITY", "P-CYCLE", "P-FANOUT", "P-MODEL"], 2: ["P-MODEL"], 3: ["P-OTHER", "P-MODEL"]}


def test_alert_requests_are_taken_whole_or_not(spark):
    good = {"alertId": "x", "txId": 1, "timestamp": "2024-01-01T00:00:00Z", "fromAccount": "a", "toAccount": "b", "amountUsd": 1.5, "score": 0.5, "threshold": 0.4, "detectors": [{"name": "cycle", "value": 3.0, "detail": "", "edges": []}, {"name": "cycle", "value": 3.0, "detail": "", "edges": []}, {"name": "ring", "value": 3.0, "detail": "", "edges": []}]}
    bodies = [json.dumps(good), json.dumps([good | {"alertId": "y"}, good | {"alertId": " ", "score": 2}]), "[]", "not json", json.dumps([good] * 4), json.dumps([good | {"alertId": "z", "unknown": 1}])]
    taken, bad = cases.parse_alerts(spark.createDataFrame(list(enumerate(bodies)), "request long, value string"), most=3)
    assert sorted((r.request, r.position, r.alertId) for r in taken.collect()) == [(0, 0, "x"), (5, 0, "z")]
    errors = {r.request: r.errors for r in bad.collect()}
    assert errors[1] == ["[1].alertId", "[1].score"] and errors[2] == ["no alerts in request"] and errors[4] == ["batch too large: 4 > 3"] and set(errors) == {1, 2, 3, 4}
    assert [(r.detector_names, float(r.amount_usd)) for r in sinks.alert_rows(taken.where("request = 0")).collect()] == [("cycle,ring", 1.5)]


def test_validation(spark):
    row = {f.name: None for f in ALERT.fields} | {"alertId": "x", "timestamp": "t", "fromAccount": "a", "toAccount": "b", "amountUsd": 1.0, "score": 0.5, "threshold": 0.5}
    bad = row | {"alertId": " ", "score": 2.0}
    got = cases.validate_alerts(spark.createDataFrame([row, bad], ALERT)).select("errors").collect()
    assert [r.errors for r in got] == [[], ["alertId", "score"]]


def test_detectors_and_evidence(spark):
    df, _ = world(spark, [(0, k, 9 + k, 1) for k in range(1, 7)])
    hits = {r.seq: r.hits for r in detectors.hits(df).collect()}
    assert [h.name for h in hits[5]] == ["fan_out"] and hits[5][0].value == 6 and hits[5][0].evidence == [5, 4, 3, 2, 1, 0] and not hits[3]
    full = detectors.materialise_evidence(detectors.hits(df), df).where("seq = 5").first()
    assert [e.txId for e in full.detectors[0].edges] == [5, 4, 3, 2, 1, 0]
    scatter, _ = world(spark, [(0, 1, 1, 1), (0, 2, 1, 1), (0, 3, 1, 1), (2, 9, 5, 1), (3, 9, 6, 1), (1, 9, 7, 1)])
    hit = detectors.hits(scatter).where("seq = 5").first().hits
    assert [(h.name, h.value, h.evidence) for h in hit[:1]] == [("scatter_gather", 3.0, [5, 0, 1, 3, 2, 4])]


def test_synthetic_world_models_and_alerts(spark, tmp_path):
    df, patterns = synth.generate(spark, accounts=60, days=4, rate=1.0, per_typology=1, seed=3)
    df = spark.createDataFrame(df.collect(), df.schema)
    assert patterns.count() == 8 and df.where("label").count() == patterns.select(F.explode("keys")).count()
    cfg = Config()
    base = features.base_features(df, cfg)
    rows = df.select("seq", "m", "src", "dst", "label", "amount_usd", "format").join(base, "seq")
    gbdt = models.train_gbdt(rows, [c for c in base.columns if c != "seq"], val=rows, trees=6, depth=3, every=2)
    back = models.Model.from_json(gbdt.to_json())
    scored = rows.withColumn("score", back.score())
    assert models.average_precision(rows, back.score()) > rows.select(F.avg(F.col("label").cast("int"))).first()[0]
    total = scored.select(F.abs(F.aggregate(back.contributions(), F.lit(0.0), lambda a, x: a + x) + sum(w * t["value"] for w, t in zip(back.body["weights"], back.body["trees"])) - back.margin()).alias("d")).agg(F.max("d")).first()[0]
    assert total < 1e-9
    lr = models.train_lr(models.weighted_sample(rows, 0.5), ["log_amount_usd", "src_out_distinct", "dst_in_distinct"], epochs=5)
    assert all(0 <= r.s <= 1 for r in rows.select(lr.score().alias("s")).collect())
    model = models.with_threshold(back, rows)
    out = alerts.alerts(df, scored, model, cfg)
    assert out.count() == scored.where(F.col("score") >= model.threshold).count() > 0
    sinks.write_alerts(out, str(tmp_path / "alerts"))
    assert alerts.bounded(out, max_alerts=2).count() <= 2 and alerts.bounded(out, emit_from=10**9).count() == 0
    report = alerts.evaluate(scored, {"gbdt": (F.col("score"), model.threshold)})
    assert 0 <= report["methods"]["gbdt"]["average_precision"] <= 1 and "precision" in alerts.render(report)


def test_exported_trees_score_like_a_plain_walk(spark):
    df, _ = world(spark, [(k % 7, k % 5, 3 * k, 50 + (k * 37) % 90) for k in range(80)])
    rows = df.withColumn("label", F.col("amount_usd") > 100)
    names = ["amount_usd", "src", "dst"]
    model = models.train_gbdt(rows, names, trees=4, depth=3)

    def walk(node, values):
        while "left" in node:
            node = node["left"] if values[node["feature"]] <= node["threshold"] else node["right"]
        return node["value"]

    for r in rows.withColumn("score", model.score()).collect():
        margin = sum(w * walk(t, [float(r[n]) for n in names]) for w, t in zip(model.body["weights"], model.body["trees"]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-2 * margin)))
    lr = models.train_lr(rows, names, epochs=4)
    for r in rows.withColumn("score", lr.score()).limit(5).collect():
        z = lr.body["bias"] + sum(w * (float(r[n]) - m) / s for n, w, m, s in zip(names, lr.body["weights"], lr.body["mean"], lr.body["std"]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_configuration_and_splits(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"window": 100, "fan_threshold": 2}')
    (tmp_path / "s.json").write_text('{"train_end": "2024-01-02T00:00:00Z", "val_end": "2024-01-03T00:00:00Z"}')
    (tmp_path / "bad.json").write_text('{"train_end": "never"}')
    assert transfers.read_config(spark, str(tmp_path / "c.json")) == Config(window=100, fan_threshold=2)
    a, b = transfers.read_splits(spark, str(tmp_path / "s.json"))
    assert b - a == 1440 and one(spark, S.format_minutes(F.lit(a))) == "2024-01-02T00:00:00Z"
    with pytest.raises(ValueError):
        transfers.read_splits(spark, str(tmp_path / "bad.json"))
    assert [r.seq for r in transfers.first_transfers(spark.createDataFrame([(3,), (1,), (2,)], "seq long"), 2).collect()] == [1, 2]


def test_regression_steps_are_those_of_one_plain_pass_after_another(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(3, 2), float(k % 2), 5.0, k % 3 == 0, 1.0 if k % 3 == 0 else 2.0) for k in range(60)]
    model = models.train_lr(spark.createDataFrame(rows, "a double, b double, c double, label boolean, weight double"), ["a", "b", "c"], epochs=6)
    total = sum(r[4] for r in rows)
    mean = [sum(r[4] * r[j] for r in rows) / total for j in range(3)]
    std = [max(math.sqrt(sum(r[4] * (r[j] - mean[j]) ** 2 for r in rows) / total), 1e-6) for j in range(3)]
    prior = sum(r[4] for r in rows if r[3]) / total
    w, a, b = [0.0, 0.0, 0.0, math.log(prior / (1 - prior))], [0.0] * 4, [0.0] * 4
    for t in range(1, 7):
        g = [0.0] * 4
        for r in rows:
            z = [*((r[j] - mean[j]) / std[j] for j in range(3)), 1.0]
            off = (1 / (1 + math.exp(-sum(x * y for x, y in zip(w, z)))) - r[3]) * r[4]
            g = [x + off * y for x, y in zip(g, z)]
        g = [x / total + (1e-4 * w[j] if j < 3 else 0) for j, x in enumerate(g)]
        a, b = [0.9 * x + 0.1 * y for x, y in zip(a, g)], [0.999 * x + 0.001 * y * y for x, y in zip(b, g)]
        w = [x - 0.05 * (p / (1 - 0.9**t)) / (math.sqrt(q / (1 - 0.999**t)) + 1e-8) for x, p, q in zip(w, a, b)]
    assert model.body["mean"] == pytest.approx(mean) and model.body["std"] == pytest.approx(std)
    assert [*model.body["weights"], model.body["bias"]] == pytest.approx(w, abs=1e-9)


def test_a_forest_of_400_trees(spark):
    """Scores, and contributions that add up to what the trees add to their roots; rows with nulls go right."""
    rng = random.Random(3)

    def grown(depth):
        node = {"value": rng.uniform(-1, 1)}
        if depth and (depth > 2 or rng.random() < 0.8):
            node |= {"feature": rng.randrange(33), "threshold": rng.uniform(0, 1), "left": grown(depth - 1), "right": grown(depth - 1)}
        return node

    trees, weights = [grown(4) for _ in range(400)], [rng.uniform(0, 1) for _ in range(400)]
    names = [f"f{k}" for k in range(33)]
    rows = [tuple(rng.random() if rng.random() < 0.95 else None for _ in names) for _ in range(50)]
    model = models.Model("gbdt", names, {"weights": weights, "trees": trees})
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = df.select(model.margin().alias("m"), model.contributions().alias("c"), model.explain(5).alias("top"), model.score().alias("s")).collect()

    def walk(node, row):
        while "left" in node:
            x = row[node["feature"]]
            node = node["left"] if x is not None and x <= node["threshold"] else node["right"]
        return node["value"]

    for r in got:
        want = [sum(w * walk(t, row) for w, t in zip(weights, trees)) for row in rows]
        at = min(range(50), key=lambda k: abs(want[k] - r.m))
        assert r.m == pytest.approx(want[at]) and r.s == pytest.approx(1 / (1 + math.exp(-2 * r.m)))
        assert sum(r.c) == pytest.approx(r.m - sum(w * t["value"] for w, t in zip(weights, trees)))
        assert [abs(x.contribution) for x in r.top] == pytest.approx(sorted(map(abs, r.c), reverse=True)[:5])
    assert df.where("false").select(model.score().alias("s"), model.explain().alias("e")).count() == 0
    lone = models.Model("gbdt", names, {"weights": [2.0], "trees": [{"value": 0.25}]})
    assert {r.m for r in df.select(lone.margin().alias("m")).collect()} == {0.5}


def test_training_sees_neither_test_rows_nor_the_threshold_training_rows(spark, tmp_path):
    df, patterns = synth.generate(spark, accounts=60, days=6, rate=0.6, per_typology=2, seed=4)
    df = spark.createDataFrame(df.collect(), df.schema)
    ends = transfers.split_boundaries(df).first()
    full, methods, naive = alerts.train_methods(df, ends.train_end, ends.val_end, trees=4, depth=2, epochs=3)
    assert list(methods) == ["gbdt", "lr", "gbdt_txn_only", "amount_rule", "velocity_rule", "rules_only"] and naive in methods
    val = full.where((F.col("m") >= ends.train_end) & (F.col("m") < ends.val_end))
    for score, threshold in methods.values():
        best = metrics.best_f1(metrics.pr_sweep(val.select(score.alias("score"), "label"))).first()
        assert threshold == pytest.approx(best.threshold)
    keyed = full.withColumn("key", F.col("seq").cast("string"))
    for stop in (None, ends.val_end + 1440):
        report = alerts.evaluate(keyed, methods, patterns.select("index", "typology", F.transform("keys", lambda k: k).alias("keys")), ends.val_end, stop, naive)
        assert len(report["methods"]) == 6 and report["rows"] == keyed.where((F.col("m") >= ends.val_end) & (F.lit(stop is None) | (F.col("m") < (stop or 0)))).count()
        assert set(report["typologies"]) == {"gbdt", naive} and report["curve"]
    sinks.write_report(report, str(tmp_path / "report"), spark)
    assert json.loads(spark.read.text(str(tmp_path / "report/report")).first().value)["rows"] == report["rows"]
    assert spark.read.option("header", True).csv(str(tmp_path / "report/curve")).count() == len(report["curve"])


def test_stream_equals_batch_and_alerts_once(spark, tmp_path):
    """Over several windows, with rings, late transfers, a repeated batch and an empty one."""
    from tests.test_features import random_edges

    cfg = Config(window=900, fan_threshold=3, hub_degree=30, ring_rebuild=200)
    df, rows = world(spark, random_edges(5, n=150))
    assert rows[-1][1] > 4 * cfg.window
    df = df.withColumn("m_raw", F.col("m") - F.when(F.col("seq") % 9 == 4, F.lit(30)).otherwise(0)).drop("m").withColumn("label", F.col("amount_usd") > 90)
    whole = transfers.clamp_event_time(df)
    base = features.base_features(whole, cfg)
    from ledgerflow.schema import STAGE1

    rows1 = whole.join(base, "seq")
    first = [models.train_gbdt(rows1.where(F.col("src") % 2 == k), list(STAGE1), trees=2, depth=2) for k in (0, 1)]
    staged = rows1.withColumn("s1", (first[0].score() + first[1].score()) / 2)
    full = staged.join(features.neighbour_features(staged, cfg), "seq", "left").fillna(0.0)
    model = models.train_gbdt(full, [*STAGE1, "nbr_src_in_score", "nbr_src_out_score", "nbr_dst_score"], trees=2, depth=2)
    model.threshold = full.select(model.score().alias("p")).approxQuantile("p", [0.8], 0.0)[0]
    scored = full.withColumn("score", model.score()).cache()
    want_alerts = {r.txId: r for r in alerts.alerts(whole, scored, model, cfg).collect()}

    place, source = str(tmp_path / "replay"), str(tmp_path / "in")
    cuts = [(0, 60), (60, 120), (120, 150)]
    fields = df.schema

    def run(k):
        """One more file, and a driver that starts anew."""
        if k is not None:
            df.where((F.col("seq") >= cuts[k][0]) & (F.col("seq") < cuts[k][1])).coalesce(1).write.parquet(f"{source}/{k}")
        query = Replay(spark, place, cfg, model, tuple(first)).start(spark.readStream.schema(fields).parquet(f"{source}/*"))
        query.awaitTermination()
        assert query.exception() is None
        return query

    run(0)
    run(1)
    # The driver was lost before the last batches were committed: they run again, from the state before them.
    for name in ("stamp", "keyed"):
        commits = sorted((tmp_path / "replay" / "checkpoint" / name / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last = commits[-1]
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(None)
    run(2)
    read = lambda what: spark.read.parquet(f"{place}/{what}/*")
    got, want = ({r.seq: r for r in x.collect()} for x in (read("out"), base))
    assert read("out").count() == len(got)
    assert got.keys() == want.keys() and max(r.rule_ring_size for r in want.values()) > 0
    for seq, w in want.items():
        assert all(math.isclose(got[seq][c], w[c], abs_tol=1e-9) for c in w.asDict()), (seq, [(c, got[seq][c], w[c]) for c in w.asDict() if not math.isclose(got[seq][c], w[c], abs_tol=1e-9)])
    scores = {r.seq: r.score for r in read("scores").collect()}
    assert all(math.isclose(scores[r.seq], r.score, abs_tol=1e-9) for r in scored.collect())
    sent = read("alerts").collect()
    assert sorted(r.txId for r in sent) == sorted(want_alerts) and len(sent) > 10
    assert all((r.ringId, r.ringAccounts, [d.name for d in r.detectors]) == (w.ringId, w.ringAccounts, [d.name for d in w.detectors]) for r in sent for w in [want_alerts[r.txId]])
    assert all(sorted(r.detectors) == sorted(want_alerts[r.txId].detectors) for r in sent)
    shown = [d for r in sent for d in r.detectors if d.name == "ring"]
    assert shown and all(d.edges for d in shown)
    assert not (tmp_path / "replay" / "state" / "0").exists()


def test_a_smaller_batch_reads_less_state(spark, tmp_path):
    """Of 2,400 accounts with a history, a batch that touches a tenth as many is handed a tenth as much."""
    cfg = Config(window=10_000, cap=8)
    history = [(a, (a * 7 + k) % 2400, k, 10) for k in range(3) for a in range(2400)]
    late = [(12 * a, (84 * a + 50) % 2400, 100, 10) for a in range(200)] + [(12 * a, (84 * a + 60) % 2400, 101, 10) for a in range(0, 200, 10)]
    df, _ = world(spark, history + late)
    df = df.withColumn("m_raw", F.col("m"))
    kept = {}

    def count(rows, _):
        for r in rows.groupBy("kind").count().collect():
            kept.setdefault(r["kind"], []).append(r["count"])

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.STORE)
    for k, (a, b) in enumerate([(0, 7200), (7200, 7400), (7400, 7420)]):
        df.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = keyed.histories(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")), cfg)
        stream.writeStream.foreachBatch(count).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    for kind, least in ((keyed.NEW, 380), (keyed.KEPT, 1000), (keyed.SENT, 700)):
        large, small = kept[kind][-2:]
        assert 6 < large / small < 14 and large > least, (kind, kept)


def test_readstream_runs(spark, tmp_path):
    df, _ = world(spark, [(1, 2, 5, 10), (2, 3, 6, 10)])
    df.withColumn("m_raw", F.col("m")).drop("m").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = Replay(spark, str(tmp_path / "r")).start(stream)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "r" / "out" / "*")).count() == 2


def test_reports():
    case = {"reference": "CASE-1", "reason": "<b>", "priority": "LOW"}
    xml, digest = sinks.report_xml(case, [{"tx_id": 1, "from_account": "a", "to_account": "b", "amount_usd": 1, "event_ts": "t"}])
    assert "&lt;b&gt;" in xml and len(digest) == 64
    assert "&lt;b&gt;" in sinks.report_html(case, [{"label": "x", "role": "source"}], [{"source": "a", "target": "b", "amount": 1, "detectors": "alert"}])


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) >= 45
