"""Investigation cases: idempotent ingest, grouping, workflow by event log, evidence graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import ALERT
from .components import connected

#: Largest batch that ingest takes.
MAX_BATCH = 1000
# Legal manual transitions of a case.
TRANSITIONS = (("OPEN", "INVESTIGATING"), ("INVESTIGATING", "ESCALATED"), ("INVESTIGATING", "CLOSED"), ("ESCALATED", "INVESTIGATING"), ("ESCALATED", "CLOSED"))
ACTIVE = ("OPEN", "INVESTIGATING", "ESCALATED")


def validate_alerts(alerts: DataFrame) -> DataFrame:
    """Append ``errors``: what is wrong with each alert (an empty array if nothing)."""
    bad = lambda cond, what: F.when(cond, F.lit(what))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    unit = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1)
    many = lambda c, n: F.coalesce(F.size(c), F.lit(0)) > n
    checks = F.array(
        bad(blank("alertId") | (F.length("alertId") > 128), "alertId"), bad(F.col("timestamp").isNull(), "timestamp"), bad(blank("fromAccount") | (F.length("fromAccount") > 64), "fromAccount"), bad(blank("toAccount") | (F.length("toAccount") > 64), "toAccount"),
        bad(F.col("amountUsd").isNull() | (F.col("amountUsd") < 0) | (F.col("amountUsd") > 1e12), "amountUsd"), bad(unit("score"), "score"), bad(unit("threshold"), "threshold"), bad(many("ringAccounts", 500), "ringAccounts"), bad(many("detectors", 32), "detectors"), bad(many("topFeatures", 64), "topFeatures"),
    )
    return alerts.withColumn("errors", F.array_compact(checks))


def parse_alerts(requests: DataFrame, column: str = "value", key: str = "request", most: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """Alerts of JSON requests, each an object or an array of objects.

    A request is taken whole or not at all. Returns the alerts of good requests with ``key`` and ``position``, and of every bad request
    ``key`` and ``errors``: not readable, empty, more than ``most`` alerts, or what is wrong at each index.
    """
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    listed = F.from_json(F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{ALERT.simpleString()}>")
    rows = requests.select(F.col(key), listed.alias("alerts"))
    n = F.size("alerts")
    whole = F.when(F.col("alerts").isNull(), "not an alert object or an array of alerts").when(n == 0, "no alerts in request").when(n > most, F.concat(F.lit("batch too large: "), n.cast("string"), F.lit(f" > {most}")))
    rows = rows.withColumn("whole", whole)
    each = validate_alerts(rows.where("whole IS NULL").select(key, F.posexplode("alerts").alias("position", "alert")).select(key, "position", "alert.*"))
    wrong = each.where(F.size("errors") > 0).select(key, "position", F.explode("errors").alias("e"))
    told = wrong.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]."), "e").alias("text")))).alias("l")).select(key, F.transform("l", lambda x: x["text"]).alias("errors"))
    bad = told.unionByName(rows.where("whole IS NOT NULL").select(key, F.array("whole").alias("errors")))
    return each.join(bad.select(key), key, "left_anti").drop("errors"), bad


def new_alerts(batch: DataFrame, stored: DataFrame | None = None, order: str = "position") -> DataFrame:
    """The alerts of a batch that are new: the first of each id that isn't stored yet."""
    first = Window.partitionBy("alert_id").orderBy(order)
    fresh = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh if stored is None else fresh.join(stored.select("alert_id"), "alert_id", "left_anti")


def outcomes(batch: DataFrame, stored: DataFrame, membership: DataFrame, order: str = "position") -> DataFrame:
    """What becomes of each alert of a batch: ``order``, ``alert_id``, ``outcome`` (ACCEPTED or DUPLICATE) and the ``case_id`` that
    has it. ``stored`` are the alerts before the batch, ``membership`` the cases after it."""
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy(order))
    known = stored.select("alert_id").distinct().withColumn("known", F.lit(True))
    rows = batch.select(order, "alert_id").withColumn("place", place).join(known, "alert_id", "left").join(membership, "alert_id", "left")
    return rows.select(order, "alert_id", F.when((F.col("place") == 1) & F.col("known").isNull(), "ACCEPTED").otherwise("DUPLICATE").alias("outcome"), "case_id")


def _keys() -> Column:
    """What ties an alert to others: its accounts, those of its ring, and a ring id that isn't blank."""
    return F.array_distinct(
        F.array_compact(
            F.concat(
                F.array(F.concat(F.lit("a:"), F.col("from_account")), F.concat(F.lit("a:"), F.col("to_account")), F.when(F.trim(F.coalesce("ring_id", F.lit(""))) != "", F.concat(F.lit("r:"), F.col("ring_id")))),
                F.transform(F.coalesce("ring_accounts", F.array().cast("array<string>")), lambda x: F.concat(F.lit("a:"), x)),
            )
        )
    )


def attach(fresh: DataFrame, stored: DataFrame, membership: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attach new alerts to cases: the membership and the cases after, and the merges (``absorbed``, ``survivor``).

    ``cases`` have ``case_id``, ``status``, ``created_at`` and ``merged_into``; ``fresh`` and ``stored`` the columns of ``group_cases``. An
    alert joins the active cases that share an account or a ring id with it, even through other new alerts; several merge into
    the oldest (``created_at``, then ``case_id``), which gets their alerts. Where there is none, a case opens, whose id is
    the least ``alert_no`` of its alerts. Closed and merged cases take nothing. The whole batch is one step, so no case opens only to be merged.
    """
    node = lambda kind, at, number: F.struct(F.lit(kind).alias("kind"), F.col(at).cast("long").alias("at"), F.col(number).cast("long").alias("id")).alias("node")
    old = stored.join(membership, "alert_id").join(cases.where(F.col("status").isin(*ACTIVE)).select("case_id", "created_at"), "case_id")
    rows = fresh.select(node(1, "alert_no", "alert_no"), F.explode(_keys()).alias("key")).unionByName(old.select(node(0, "created_at", "case_id"), F.explode(_keys()).alias("key")).distinct())
    hubs = rows.groupBy("key").agg(F.min("node").alias("a"))
    labels = connected(rows.join(hubs, "key").select("a", F.col("node").alias("b")))
    homes = fresh.select("alert_id", node(1, "alert_no", "alert_no")).join(labels, "node", "left").select("alert_id", F.coalesce("root", "node").alias("root"))
    merges = labels.where("node.kind = 0 AND root.id <> node.id").select(F.col("node.id").alias("absorbed"), F.col("root.id").alias("survivor"))
    kept = membership.join(merges, membership.case_id == merges.absorbed, "left").select("alert_id", F.coalesce("survivor", "case_id").alias("case_id"))
    after = cases.join(merges, cases.case_id == merges.absorbed, "left").select(
        "case_id", F.when(F.col("survivor").isNotNull(), "MERGED").otherwise(F.col("status")).alias("status"), "created_at", F.coalesce("survivor", "merged_into").alias("merged_into")
    )
    opened = homes.where("root.kind = 1").select(F.col("root.id").alias("case_id"), F.lit("OPEN").alias("status"), F.col("root.at").alias("created_at"), F.lit(None).cast("long").alias("merged_into")).distinct()
    return kept.unionByName(homes.select("alert_id", F.col("root.id").alias("case_id"))), after.unionByName(opened), merges


def attachment_events(fresh: DataFrame, membership: DataFrame, before: DataFrame, merges: DataFrame) -> DataFrame:
    """What ``attach`` did, for the audit trail: ``case_id``, ``action``, ``from_status``, ``to_status``, ``detail``. ``membership`` is that
    after it, ``before`` the cases before it. Cases open, absorb others and get their alerts."""
    status = before.select(F.col("case_id").alias("known"), F.col("status").alias("old"))
    got = fresh.join(membership, "alert_id").join(status, F.col("case_id") == F.col("known"), "left")
    row = lambda case, action, a, b, detail: [F.col(case).alias("case_id"), F.lit(action).alias("action"), a.alias("from_status"), b.alias("to_status"), detail.alias("detail")]
    none, now = F.lit(None).cast("string"), F.coalesce("old", F.lit("OPEN"))
    opened = got.where("known IS NULL").groupBy("case_id").agg(F.min_by("alert_id", "alert_no").alias("alert_id"))
    absorbed = merges.join(status, merges.absorbed == F.col("known"))
    kept = merges.join(status, merges.survivor == F.col("known"))
    said = lambda word, other: F.concat(F.lit(word), F.col(other).cast("string"))
    parts = [
        opened.select(*row("case_id", "CASE_CREATED", none, F.lit("OPEN"), said("alert ", "alert_id"))), got.select(*row("case_id", "ALERT_ATTACHED", now, now, said("alert ", "alert_id"))),
        kept.select(*row("survivor", "MERGED", F.col("old"), F.col("old"), said("absorbed case ", "absorbed"))), absorbed.select(*row("absorbed", "MERGED", F.col("old"), F.lit("MERGED"), said("into case ", "survivor"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def case_details(cases: DataFrame, membership: DataFrame, alerts: DataFrame, filings: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """One row per case with all that its page shows: ``accounts`` and ``ring_ids`` sorted, ``alerts`` by event time then arrival, the states
    it can go to (``allowed``), its latest ``filing`` and its ``reports`` by id. ``filings`` and ``reports`` have ``case_id`` and ``id``."""
    j = alerts.join(membership, "alert_id")
    lists = j.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("event_ts", "alert_no", "alert_id", "tx_id", "score", "amount_usd"))).alias("alerts"), F.array_sort(F.collect_set(F.when(F.trim("ring_id") != "", F.col("ring_id")))).alias("ring_ids")
    )
    who = j.select("case_id", F.explode(F.concat(F.array("from_account", "to_account"), F.coalesce("ring_accounts", F.array().cast("array<string>")))).alias("x")).groupBy("case_id").agg(F.array_sort(F.collect_set("x")).alias("accounts"))
    to = lambda status: F.array(*(F.lit(b) for a, b in TRANSITIONS if a == status)).cast("array<string>")
    allowed = F.when(F.col("status") == "OPEN", to("OPEN")).when(F.col("status") == "INVESTIGATING", to("INVESTIGATING")).when(F.col("status") == "ESCALATED", to("ESCALATED")).otherwise(to(""))
    out = cases.join(lists, "case_id", "left").join(who, "case_id", "left").withColumn("allowed", allowed)
    if filings is not None:
        out = out.join(filings.groupBy("case_id").agg(F.max_by(F.struct(*filings.columns), "id").alias("filing")), "case_id", "left")
    if reports is not None:
        out = out.join(reports.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("id", *(c for c in reports.columns if c not in ("id", "case_id"))))).alias("reports")), "case_id", "left")
    return out


def str_indicators(alerts: DataFrame, membership: DataFrame, prefix: str = "") -> DataFrame:
    """``case_id`` and the indicator codes of its report: those of its alerts' detectors by first appearance
    (alerts by event time, then arrival), each once, the model's last where it hasn't come before."""
    each = alerts.join(membership, "alert_id").select("case_id", "event_ts", "alert_no", F.posexplode_outer("detectors").alias("p", "d"))
    seen = each.where("d IS NOT NULL").groupBy("case_id", S.indicator_code(F.col("d.name"), prefix).alias("code")).agg(F.min(F.struct("event_ts", "alert_no", "p")).alias("first"))
    lists = seen.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "code"))), lambda x: x["code"]).alias("codes"))
    model = F.array(S.indicator_code(F.lit("model"), prefix))
    return each.select("case_id").distinct().join(lists, "case_id", "left").select("case_id", F.array_distinct(F.concat(F.coalesce("codes", F.array().cast("array<string>")), model)).alias("indicators"))


def group_cases(alerts: DataFrame) -> DataFrame:
    """``alert_id``, ``case_id``: alerts that share an account or a ring id, even
    through others, are one case; its id is the least ``alert_no`` in it.

    ``alerts`` has ``alert_id``, ``alert_no`` (arrival), ``from_account``,
    ``to_account``, ``ring_accounts``, ``ring_id``. Blank ring ids join nothing.
    Each key links its alerts to the least of them, not to one another.
    """
    rows = alerts.select("alert_no", F.explode(_keys()).alias("key"))
    hubs = rows.groupBy("key").agg(F.min("alert_no").alias("a"))
    labels = connected(rows.join(hubs, "key").select("a", F.col("alert_no").alias("b")))
    return alerts.join(labels, alerts.alert_no == labels.node, "left").select("alert_id", F.coalesce("root", "alert_no").alias("case_id"))


def case_rollup(alerts: DataFrame, membership: DataFrame) -> DataFrame:
    """Per case: alerts, highest score, total amount, accounts, priority."""
    j = alerts.join(membership, "alert_id")
    accounts = j.select("case_id", F.explode(F.array_distinct(F.concat(F.array("from_account", "to_account"), F.coalesce("ring_accounts", F.array().cast("array<string>"))))).alias("account")).groupBy("case_id").agg(F.count_distinct("account").alias("accounts"))
    totals = j.groupBy("case_id").agg(F.max("score").alias("max_score"), F.count("*").alias("alert_count"), F.sum(F.col("amount_usd").cast("decimal(19,2)")).alias("total"))
    return totals.join(accounts, "case_id").select("case_id", "max_score", "alert_count", F.col("total").cast("double").alias("total_amount_usd"), "accounts", S.priority(F.col("max_score"), F.col("alert_count"), F.col("total")).alias("priority"))


def case_page(cases: DataFrame, sort: str = "updated_at", descending: bool = True, page: int = 0, size: int = 20, statuses: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """One page of the cases in some statuses (all, if none is named), and how many there are; an unknown sort column raises."""
    cases = cases.where(F.col("status").isin(*statuses)) if statuses else cases
    if sort not in cases.columns:
        raise ValueError(f"unknown sort property: {sort}")
    key = F.desc(sort) if descending else F.asc(sort)
    return cases.orderBy(key, "case_id").offset(page * size).limit(size), cases.count()


def fold_status(events: DataFrame) -> DataFrame:
    """State of every case after its event log: ``case_id``, ``status``,
    ``disposition``, ``assignee``, ``applied``, ``rejected``.

    Events (``case_id``, ``event_id``, ``action``, ``to_status``, ``disposition``,
    ``actor``, ``assignee``) apply in order; one that the rules forbid changes nothing and counts as
    rejected. A report's type is the ``to_status`` of REPORT_GENERATED; filing needs one of type STR_XML. A case's log is short, so it folds inside one row.
    """
    pair = lambda a, b: F.array_contains(F.array(*(F.lit(f"{x}>{y}") for x, y in TRANSITIONS)), F.concat(a, F.lit(">"), b))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("OPEN").alias("status"), none.alias("disposition"), none.alias("assignee"), none.alias("pending"), F.lit(False).alias("reported"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))

    def step(s, e):
        a, to = e["action"], e["to_status"]
        closing = to == "CLOSED"
        fits = F.when(closing, F.coalesce(e["disposition"] != "STR_FILED", F.lit(False))).otherwise(e["disposition"].isNull())
        second = s["pending"].isNotNull() & (s["pending"] != e["actor"])
        ok = (
            F.when(a == "TRANSITION", pair(s["status"], to) & fits & s["pending"].isNull())
            .when(a == "ASSIGNED", s["status"].isin(*ACTIVE))
            .when(a == "COMMENT", F.lit(True))
            .when(a == "REPORT_GENERATED", F.lit(True))
            .when(a == "FILING_REQUESTED", (s["status"] == "ESCALATED") & s["pending"].isNull() & s["reported"])
            .when(a == "FILING_APPROVED", second & (s["status"] == "ESCALATED"))
            .when(a == "FILING_REJECTED", second)
            .otherwise(F.lit(False))
        )
        ok = F.coalesce(ok, F.lit(False))
        status = F.when(a == "TRANSITION", to).when(a == "FILING_APPROVED", "CLOSED").when((a == "FILING_REJECTED") & (s["status"] == "ESCALATED"), "INVESTIGATING").otherwise(s["status"])
        disposition = F.when((a == "TRANSITION") & closing, e["disposition"]).when(a == "FILING_APPROVED", "STR_FILED").otherwise(s["disposition"])
        pending = F.when(a == "FILING_REQUESTED", e["actor"]).when(a.isin("FILING_APPROVED", "FILING_REJECTED"), none).otherwise(s["pending"])
        keep = lambda new, old: F.when(ok, new).otherwise(old)
        return F.struct(
            keep(status, s["status"]).alias("status"), keep(disposition, s["disposition"]).alias("disposition"), keep(F.when(a == "ASSIGNED", e["assignee"]).otherwise(s["assignee"]), s["assignee"]).alias("assignee"),
            keep(pending, s["pending"]).alias("pending"), (s["reported"] | F.coalesce((a == "REPORT_GENERATED") & (to == "STR_XML"), F.lit(False))).alias("reported"), (s["applied"] + F.when(ok, 1).otherwise(0)).alias("applied"), (s["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"),
        )

    log = events.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "action", "to_status", "disposition", "actor", "assignee"))).alias("log"))
    return log.select("case_id", F.aggregate("log", start, step).alias("s")).select("case_id", "s.status", "s.disposition", "s.assignee", "s.applied", "s.rejected")


def graph_edges(alerts: DataFrame) -> DataFrame:
    """Evidence edges of alerts, each once: ``key``, ends, amount, detectors (in
    order of appearance, joined), whether alerted, and ``laundering`` (null if never said).

    ``alerts`` has ``alert_no``, ``tx_id``, ``from_account``, ``to_account``, ``event_ts``, ``amount_usd`` and ``detectors``.
    """
    own = alerts.select("alert_no", F.lit(-1).alias("d"), F.lit(0).alias("p"), F.col("tx_id"), F.col("from_account").alias("source"), F.col("to_account").alias("target"), F.col("event_ts").alias("ts"), F.col("amount_usd").alias("amount"), F.lit("alert").alias("name"), F.lit(None).cast("boolean").alias("laundering"))
    det = alerts.select("alert_no", F.posexplode("detectors").alias("d", "det")).select("alert_no", "d", F.col("det.name").alias("name"), F.posexplode("det.edges").alias("p", "e"))
    ev = det.select("alert_no", "d", "p", F.col("e.txId").alias("tx_id"), F.col("e.from").alias("source"), F.col("e.to").alias("target"), F.col("e.timestamp").alias("ts"), F.col("e.amountUsd").alias("amount"), "name", F.col("e.laundering").alias("laundering"))
    rows = own.unionByName(ev).withColumn("key", F.coalesce(F.concat(F.lit("tx:"), F.col("tx_id").cast("string")), F.concat_ws("|", "source", "target", "ts")))
    first = F.min(F.struct("alert_no", "d", "p", "source", "target", "amount", "tx_id", "ts")).alias("f")
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("alert_no", "d", "p", "name"))), lambda x: x["name"]))
    g = rows.groupBy("key").agg(first, F.array_join(names, ",").alias("detectors"), F.max("laundering").alias("laundering"), F.max(F.col("d") == -1).alias("alerted"))
    return g.select("key", "f.source", "f.target", "f.amount", "f.tx_id", "f.ts", "detectors", "laundering", "alerted")


def graph_nodes(edges: DataFrame, alerts: DataFrame) -> DataFrame:
    """Accounts of the evidence graph with role, degree and order of first appearance."""
    ends = edges.select(F.coalesce("ts", F.lit("~")).alias("ts"), F.coalesce("tx_id", F.lit((1 << 62))).alias("tx"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("id")), F.struct(F.lit(1).alias("side"), F.col("target").alias("id")))).alias("e"))
    seen = ends.groupBy("e.id").agg(F.sum((F.col("e.side") == 0).cast("int")).alias("sent"), F.sum((F.col("e.side") == 1).cast("int")).alias("got"), F.min(F.struct("ts", "tx", "e.side")).alias("first"))
    ring = alerts.select(F.explode("ring_accounts").alias("id")).distinct().withColumn("in_ring", F.lit(True))
    said = alerts.select(F.explode(F.array("from_account", "to_account")).alias("id")).distinct().withColumn("alerted", F.lit(True))
    n = seen.join(ring, "id", "full").join(said, "id", "left")
    sent, got = F.coalesce("sent", F.lit(0)), F.coalesce("got", F.lit(0))
    role = F.when((sent > 0) & (got > 0), "intermediary").when(sent > 0, "source").when(got > 0, "sink").otherwise("member")
    false = F.lit(False)
    return n.select("id", S.account_label(F.col("id")).alias("label"), role.alias("role"), S.bank_of(F.col("id")).alias("bank"), F.coalesce("in_ring", false).alias("in_ring"), F.coalesce("alerted", false).alias("alerted"), sent.alias("sent"), got.alias("got"), "first")


def str_reason(cases: DataFrame) -> DataFrame:
    """``case_id`` and the narrative of its report. ``cases`` has ``reference``,
    ``alert_count``, ``accounts``, ``total_amount_usd``, ``models`` (joined), ``max_score``, ``typologies`` (joined)."""
    some = F.when(F.col("models") != "", F.concat(F.lit(" "), F.col("models"))).otherwise("")
    seen = F.when(F.col("typologies") != "", F.col("typologies")).otherwise("model score only")
    # The wording of the narrative.
    text = F.concat(
        F.lit("Case "), "reference", F.lit(": "), F.col("alert_count").cast("string"), F.lit(" transaction alert(s) across "), F.col("accounts").cast("string"), F.lit(" account(s) totalling USD "), F.col("total_amount_usd").cast("decimal(19,2)").cast("string"),
        F.lit(" were flagged by the network monitoring model"), some, F.lit(" (maximum score "), F.col("max_score").cast("decimal(10,3)").cast("string"), F.lit("). Observed typologies: "), seen, F.lit(". The pattern is consistent with money-mule activity and layering of illicit funds."),
    )
    return cases.select("case_id", text.alias("reason"))
