"""Registered queries of the engine's own operators and their SQL.

All run over whole tables. ``events`` serves as the transfers (see
``sources.transfers.from_events``), ``labels`` with ``documents`` as scored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import adjacency, cases, detectors, features, metrics, paths, rings
from .plans import alerts as alert_plan
from .plans import models
from .schema import PAYMENT_FORMATS, STAGE1, TXN_ONLY, Config
from .sources import transfers as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CFG = Config()
#: Score from which a transfer is an alert, for the queries on clusters and cases.
ALERT_AT = 0.8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# DuckDB's view of the same transfers.
_T = """e AS (SELECT event_id AS seq, epoch_us(ts) // 60000000 AS m, user_id AS src, CAST(props->>'k' AS BIGINT) AS dst, value AS amount_paid, event_type,
  CASE event_type WHEN 'click' THEN 'ACH' WHEN 'view' THEN 'Wire' WHEN 'purchase' THEN 'Credit Card' WHEN 'signup' THEN 'Cheque' WHEN 'error' THEN 'Cash' ELSE 'Other' END AS format,
  ['US Dollar', 'Euro', 'Yuan', 'Bitcoin', 'Unknown'][user_id % 5 + 1] AS ccy,
  ['US Dollar', 'Euro', 'Yuan', 'Bitcoin', 'Unknown'][CAST(props->>'k' AS BIGINT) % 5 + 1] AS rccy FROM events),
t AS (SELECT *, amount_paid * CASE ccy WHEN 'Euro' THEN CAST('1.1718' AS DOUBLE) WHEN 'Yuan' THEN CAST('0.14931' AS DOUBLE) WHEN 'Bitcoin' THEN CAST('11881.6' AS DOUBLE) ELSE CAST('1.0' AS DOUBLE) END AS amount FROM e)"""
_L = (
    _T
    + """,
r AS (SELECT seq, m, src AS acct, 'O' AS dir, dst AS peer, amount, CAST(format = 'ACH' AS INT) AS ach FROM t WHERE src <> dst
  UNION ALL SELECT seq, m, dst, 'I', src, amount, CAST(format = 'ACH' AS INT) FROM t WHERE src <> dst),
l AS (SELECT *, list({'m': m, 'peer': peer, 'seq': seq, 'amount': amount, 'ach': ach}) OVER (PARTITION BY acct, dir ORDER BY seq ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) AS lst FROM r),
s AS (SELECT *, last_value(CASE WHEN dir = 'O' THEN lst END IGNORE NULLS) OVER w AS o0, last_value(CASE WHEN dir = 'I' THEN lst END IGNORE NULLS) OVER w AS i0, count(*) OVER w AS history,
  sum(CASE WHEN dir = 'O' THEN 1 ELSE 0 END) OVER w AS total_out FROM l WINDOW w AS (PARTITION BY acct ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT *, coalesce(list_filter(o0, lambda x: x.m >= m - 5760), []) AS outs, coalesce(list_filter(i0, lambda x: x.m >= m - 5760), []) AS ins FROM s)"""
)


def _peers(x: str) -> str:
    return f"list_distinct(list_transform({x}, lambda p: p.peer))"


# What an account's first transfer, its funders and the routes and cycles that a transfer completes are, on top of _L.
_SG = f"""sg_o AS (SELECT seq, m, acct AS src, list_filter(ins, lambda x: x.peer <> peer) AS fi FROM a WHERE dir = 'O'),
sg_d AS (SELECT seq, list_distinct(list_transform(list_filter(ins, lambda x: x.peer <> peer), lambda x: x.peer)) AS senders FROM a WHERE dir = 'I'),
sg_u AS (SELECT seq, m, src, unnest(fi) AS x FROM sg_o),
sg_f AS (SELECT seq, m, src, x.peer AS funder, max(x.seq) AS latest FROM sg_u GROUP BY ALL),
sg_k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY latest DESC) AS place FROM sg_f),
sg_s AS (SELECT acct, seq AS at, o0 FROM s WHERE dir = 'O'),
sg_j AS (SELECT k.seq, k.m, k.src, k.funder, k.place, so.o0 FROM sg_k AS k ASOF JOIN sg_s AS so ON k.funder = so.acct AND k.seq >= so.at WHERE place <= 24),
sg_c AS (SELECT j.seq, place, funder, list_intersect({_peers('list_filter(o0, lambda x: x.m >= m - 5760 AND x.peer <> src)')}, senders) AS mids FROM sg_j AS j JOIN sg_d AS d ON j.seq = d.seq),
sg_b AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY len(mids) DESC, place) AS r FROM sg_c WHERE len(mids) > 0),
sg AS (SELECT seq, len(mids) + 1 AS paths, funder AS origin, list_sort(mids) AS mids FROM sg_b WHERE r = 1)"""


def _cycle_ctes() -> str:
    """Shortest cycles by hops from the sender back; of equal ones that with the latest edges."""
    hops = ["g AS (SELECT seq, m, src, dst, amount, least(coalesce(lead(seq, 256) OVER (PARTITION BY dst ORDER BY seq), 9223372036854775807), coalesce(lead(seq, 256) OVER (PARTITION BY src ORDER BY seq), 9223372036854775807)) AS until FROM t WHERE src <> dst)", "h0 AS (SELECT seq AS x, m AS xm, src AS xs, dst AS xd, src AS node, m AS bound, amount AS lo, amount AS hi, [seq] AS path FROM g)"]
    for k in range(1, 6):
        hops.append(
            f"""n{k} AS (SELECT x, xm, xs, xd, g.src AS node, arg_max({{'bound': g.m, 'lo': least(lo, amount), 'hi': greatest(hi, amount), 'path': list_prepend(g.seq, path)}}, (g.m, g.seq)) AS b
  FROM h{k - 1} AS h JOIN g ON g.dst = h.node AND g.seq < h.x AND h.x < g.until AND g.m <= h.bound AND g.m >= h.xm - 5760 WHERE g.src <> h.xs GROUP BY x, xm, xs, xd, g.src)"""
        )
        hops.append(f"h{k} AS (SELECT x, xm, xs, xd, node, b.bound AS bound, b.lo AS lo, b.hi AS hi, b.path AS path FROM n{k} WHERE x NOT IN (SELECT x FROM n{k} WHERE node = xd))")
    found = " UNION ALL ".join(f"SELECT x AS seq, {k + 1} AS cycle_len, CASE WHEN b.hi > 0 THEN b.lo / b.hi ELSE 0 END AS cycle_amount_ratio, b.path AS cycle_edges FROM n{k} WHERE node = xd" for k in range(1, 6))
    return f"{', '.join(hops)}, cy AS ({found})"


# All values of both neighbourhoods.
_V = f"""f AS (SELECT seq, acct, min(m) OVER (PARTITION BY acct ORDER BY seq) AS first_seen FROM (SELECT seq, m, src AS acct FROM t UNION ALL SELECT seq, m, dst FROM t WHERE src <> dst) AS u),
vo AS (SELECT seq, m, len({_peers('outs')}) AS src_out, len({_peers('ins')}) AS src_in, len(outs) + len(ins) AS src_degree, history AS src_history, len(list_filter(outs, lambda x: x.peer = peer AND x.seq <> seq)) AS pair_repeat,
  len(list_filter(outs, lambda x: x.m >= m - 1440)) AS sent_24h, total_out / greatest((m - first_seen) / CAST(1440 AS DOUBLE), 1) AS usual, list_avg(list_transform(outs, lambda x: x.ach)) AS src_ach,
  list_filter(ins, lambda x: x.m >= m - 1440 AND x.peer <> peer AND x.amount > 0 AND amount / x.amount <= 1 + CAST('1e-6' AS DOUBLE) AND amount / x.amount >= CAST('0.9' AS DOUBLE))[-1] AS pass,
  amount FROM a JOIN f USING (seq, acct) WHERE dir = 'O'),
vd AS (SELECT seq, len({_peers('ins')}) AS dst_in, len({_peers('outs')}) AS dst_out, len(outs) + len(ins) AS dst_degree, history AS dst_history, len(list_filter(ins, lambda x: x.m >= m - 1440)) AS got_24h, list_avg(list_transform(ins, lambda x: x.ach)) AS dst_ach FROM a WHERE dir = 'I'),
v AS MATERIALIZED (SELECT *, sent_24h / usual AS velocity_ratio, m - pass.m AS pass_gap, amount / pass.amount AS pass_ratio FROM vo JOIN vd USING (seq) LEFT JOIN sg USING (seq) LEFT JOIN cy USING (seq))"""

# Rings: epochs, the edges that link accounts in each, and what the sender of a transfer reaches by those up to it.
_RG = """lk AS (SELECT v.seq, t.m, src, dst FROM v JOIN t USING (seq) WHERE (src_out >= 5 OR dst_in >= 5 OR coalesce(paths, 0) >= 3 OR (src_in >= 3 AND src_out >= 3) OR cycle_len IS NOT NULL OR coalesce(pass_gap, 1000000) <= 120) AND src_degree <= 100 AND dst_degree <= 100),
mi AS MATERIALIZED (SELECT DISTINCT m FROM t), nx AS MATERIALIZED (SELECT m, min(m) OVER (ORDER BY m RANGE BETWEEN 360 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM mi),
ep AS (SELECT min(m) AS start FROM mi UNION ALL SELECT nxt FROM ep JOIN nx ON ep.start = nx.m WHERE nxt IS NOT NULL), es AS (SELECT start, lead(start, 1, 1000000000) OVER (ORDER BY start) AS stop FROM ep),
le AS MATERIALIZED (SELECT start, a, b, min(seq) AS seq FROM (SELECT start, src AS a, dst AS b, seq FROM lk JOIN es ON m >= start - 5760 AND m < stop UNION ALL SELECT start, dst, src, seq FROM lk JOIN es ON m >= start - 5760 AND m < stop) AS u GROUP BY start, a, b),
pr AS (SELECT t.seq, src, start FROM t JOIN es ON m >= start AND m < stop WHERE src <> dst),
rc AS (SELECT DISTINCT pr.seq, pr.start, src AS node FROM pr JOIN le ON le.start = pr.start AND le.a = pr.src AND le.seq <= pr.seq UNION SELECT rc.seq, rc.start, le.b FROM rc JOIN le ON le.start = rc.start AND le.a = rc.node AND le.seq <= rc.seq),
rz AS (SELECT seq, count(*) AS ring_size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM rc GROUP BY seq)"""
_GRAPH = f"WITH RECURSIVE {_L.replace(' a AS (', ' a AS MATERIALIZED (').replace('s AS (SELECT *, last_value', 's AS MATERIALIZED (SELECT *, last_value')}, {_SG}, {_cycle_ctes()}, {_V}"

_FEATURES_SQL = f"""{_GRAPH}, {_RG}
SELECT t.seq, CAST(format = 'ACH' AS DOUBLE) AS fmt_ach, CAST(format = 'Cash' AS DOUBLE) AS fmt_cash, CAST(format = 'Cheque' AS DOUBLE) AS fmt_cheque, CAST(format = 'Credit Card' AS DOUBLE) AS fmt_credit_card,
  CAST(format = 'Bitcoin' AS DOUBLE) AS fmt_bitcoin, CAST(format = 'Wire' AS DOUBLE) AS fmt_wire, CAST(format = 'Reinvestment' AS DOUBLE) AS fmt_reinvestment,
  round(ln(1 + greatest(t.amount, 0)), 6) AS log_amount_usd, CAST(ccy <> rccy AS DOUBLE) AS cross_currency, CAST(src % 20 = dst % 20 AS DOUBLE) AS same_bank,
  CAST(amount_paid >= 100 AND amount_paid % 100 < 1e-9 AS DOUBLE) AS round_amount, """ + ", ".join(
    f"coalesce(round({x}, 6), CAST(0 AS DOUBLE)) AS {name}"
    for name, x in (
        ("src_out_distinct", "ln(1 + src_out)"), ("dst_in_distinct", "ln(1 + dst_in)"), ("src_in_distinct", "ln(1 + src_in)"), ("dst_out_distinct", "ln(1 + dst_out)"), ("scatter_gather_paths", "CAST(paths AS DOUBLE)"),
        ("gather_scatter_degree", "ln(1 + least(src_in, src_out))"), ("cycle_len", "CAST(cycle_len AS DOUBLE)"), ("cycle_amount_ratio", "cycle_amount_ratio"), ("pass_gap_log_min", "CASE WHEN v.seq IS NOT NULL THEN ln(1 + coalesce(pass_gap, 1441)) END"),
        ("pass_ratio", "pass_ratio"), ("src_velocity_24h", "ln(1 + sent_24h)"), ("src_velocity_ratio", "ln(1 + velocity_ratio)"), ("dst_in_24h", "ln(1 + got_24h)"), ("pair_repeat", "ln(1 + pair_repeat)"),
        ("rule_ring_size", "ln(1 + ring_size)"), ("src_history", "ln(1 + src_history)"), ("dst_history", "ln(1 + dst_history)"), ("src_out_ach_share", "src_ach"), ("dst_in_ach_share", "dst_ach"),
    )
) + " FROM t LEFT JOIN v ON t.seq = v.seq LEFT JOIN rz ON t.seq = rz.seq"

_HITS_SQL = _GRAPH + """,
ue AS (SELECT seq, dir, 'o' AS k, unnest(outs) AS x FROM a WHERE dir = 'O' UNION ALL SELECT seq, dir, 'i', unnest(ins) FROM a),
pe AS (SELECT seq, dir, k, x.peer AS peer, max(x.seq) AS e FROM ue GROUP BY ALL),
ev AS (SELECT seq, dir, k, list(e ORDER BY e DESC)[1:30] AS ev FROM pe GROUP BY seq, dir, k),
re AS (SELECT seq, list(x.seq ORDER BY x.seq DESC)[1:30] AS ev FROM (SELECT u.seq, x, m FROM ue AS u JOIN t ON t.seq = u.seq WHERE dir = 'O' AND k = 'o') AS q WHERE x.m >= m - 1440 GROUP BY seq),
lg AS (SELECT sg.seq, now, unnest(list_concat([{'place': 0, 'a': origin, 'b': src}], list_transform(mids, lambda x, i: {'place': 2 * i - 1, 'a': origin, 'b': x}), list_transform(mids, lambda x, i: {'place': 2 * i, 'a': x, 'b': dst}))) AS leg FROM sg JOIN (SELECT seq, m AS now, src, dst FROM t) AS z USING (seq) WHERE paths >= 3),
lt AS (SELECT lg.seq, leg.place AS place, max(t.seq) AS e FROM lg JOIN t ON t.src = leg.a AND t.dst = leg.b AND t.seq <= lg.seq AND t.m >= now - 5760 GROUP BY 1, 2),
le AS (SELECT seq, list(e ORDER BY place) AS es FROM lt WHERE e <> seq GROUP BY seq),
hit AS (SELECT v.seq, 0 AS n, 'fan_out' AS name, CAST(src_out AS DOUBLE) AS value, ev FROM v JOIN ev ON ev.seq = v.seq AND dir = 'O' AND k = 'o' WHERE src_out >= 5
 UNION ALL SELECT v.seq, 1, 'fan_in', dst_in, ev FROM v JOIN ev ON ev.seq = v.seq AND dir = 'I' AND k = 'i' WHERE dst_in >= 5
 UNION ALL SELECT v.seq, 2, 'scatter_gather', paths, list_concat([v.seq], es)[1:30] FROM v JOIN le USING (seq) WHERE paths >= 3
 UNION ALL SELECT v.seq, 3, 'gather_scatter', least(src_in, src_out), list_concat(i.ev[1:15], o.ev[1:15]) FROM v JOIN ev AS i ON i.seq = v.seq AND i.dir = 'O' AND i.k = 'i' JOIN ev AS o ON o.seq = v.seq AND o.dir = 'O' AND o.k = 'o' WHERE src_in >= 3 AND src_out >= 3
 UNION ALL SELECT seq, 4, 'cycle', cycle_len, cycle_edges FROM v WHERE cycle_len IS NOT NULL
 UNION ALL SELECT seq, 5, 'pass_through', pass_gap, [pass.seq, seq] FROM v WHERE pass_gap <= 120
 UNION ALL SELECT seq, 6, 'velocity', sent_24h, ev FROM v JOIN re USING (seq) WHERE sent_24h >= 10 AND velocity_ratio >= 3)
SELECT seq, n, name, value, array_to_string(ev, ',') AS evidence FROM hit"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_events(spark, sf_dir)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.account_values(transfers(spark, sf_dir), CFG)


@query("features", _FEATURES_SQL)
def _features(spark, sf_dir):
    return features.base_features(transfers(spark, sf_dir), CFG).select("seq", *(F.round(c, 6).alias(c) for c in STAGE1))


@query(
    "txn_features",
    f"""WITH {_T} SELECT seq, CAST(format = 'ACH' AS DOUBLE) AS fmt_ach, CAST(format = 'Cash' AS DOUBLE) AS fmt_cash, CAST(format = 'Cheque' AS DOUBLE) AS fmt_cheque, CAST(format = 'Credit Card' AS DOUBLE) AS fmt_credit_card,
  CAST(format = 'Bitcoin' AS DOUBLE) AS fmt_bitcoin, CAST(format = 'Wire' AS DOUBLE) AS fmt_wire, CAST(format = 'Reinvestment' AS DOUBLE) AS fmt_reinvestment,
  round(ln(1 + greatest(amount, 0)), 6) AS log_amount_usd, CAST(ccy <> rccy AS DOUBLE) AS cross_currency, CAST(src % 20 = dst % 20 AS DOUBLE) AS same_bank,
  CAST(amount_paid >= 100 AND amount_paid % 100 < 1e-9 AS DOUBLE) AS round_amount FROM t""",
)
def _txn(spark, sf_dir):
    f = features.txn_features(transfers(spark, sf_dir))
    return f.withColumn("log_amount_usd", F.round("log_amount_usd", 6))


def _counted(name: str, column: str, sql: str, side: str) -> None:
    @query(name, f"WITH {_L} SELECT seq, CAST({sql} AS BIGINT) AS {name} FROM a WHERE dir = '{side}'")
    def run(spark, sf_dir):
        return _values(spark, sf_dir).select("seq", F.col(column).cast("long").alias(name))


_counted("src_in_distinct", "src_in", f"len({_peers('ins')})", "O")
_counted("dst_out_distinct", "dst_out", f"len({_peers('outs')})", "I")
_counted("gather_scatter", "gs", f"least(len({_peers('ins')}), len({_peers('outs')}))", "O")
_counted("pair_repeat", "pair_repeat", "len(list_filter(outs, lambda x: x.peer = peer AND x.seq <> seq))", "O")
_counted("dst_in_24h", "got_24h", "len(list_filter(ins, lambda x: x.m >= m - 1440))", "I")
QUERIES["gather_scatter"] = lambda spark, sf_dir: _values(spark, sf_dir).select("seq", F.least("src_in", "src_out").cast("long").alias("gather_scatter"))


def _fan(name: str, column: str, side: str, lists: str) -> None:
    @query(name, f"WITH {_L} SELECT seq, len({_peers(lists)}) AS n, len({_peers(lists)}) >= 5 AS hit FROM a WHERE dir = '{side}'")
    def run(spark, sf_dir):
        return _values(spark, sf_dir).select("seq", F.col(column).cast("long").alias("n"), (F.col(column) >= CFG.fan_threshold).alias("hit"))


_fan("fan_out", "src_out", "O", "outs")
_fan("fan_in", "dst_in", "I", "ins")


@query(
    "ach_share",
    f"""WITH {_L}, x AS (SELECT seq, dir, round(CASE WHEN dir = 'O' THEN list_avg(list_transform(outs, lambda p: p.ach)) ELSE list_avg(list_transform(ins, lambda p: p.ach)) END, 6) AS v FROM a)
  SELECT seq, max(CASE WHEN dir = 'O' THEN v END) AS src_out_ach_share, max(CASE WHEN dir = 'I' THEN v END) AS dst_in_ach_share FROM x GROUP BY seq""",
)
def _ach(spark, sf_dir):
    return _values(spark, sf_dir).select("seq", F.round("src_ach_share", 6).alias("src_out_ach_share"), F.round("dst_ach_share", 6).alias("dst_in_ach_share"))


@query(
    "account_history",
    f"WITH {_L} SELECT seq, max(CASE WHEN dir = 'O' THEN history END) AS src_history, max(CASE WHEN dir = 'I' THEN history END) AS dst_history FROM a GROUP BY seq",
)
def _history(spark, sf_dir):
    return _values(spark, sf_dir).select("seq", "src_history", "dst_history")


@query(
    "velocity",
    f"""WITH {_L}, f AS (SELECT seq, acct, min(m) OVER (PARTITION BY acct ORDER BY seq) AS first_seen FROM (SELECT seq, m, src AS acct FROM t UNION ALL SELECT seq, m, dst FROM t WHERE src <> dst) AS u),
  x AS (SELECT a.seq, len(list_filter(outs, lambda p: p.m >= m - 1440)) AS n, total_out / greatest((m - first_seen) / CAST(1440 AS DOUBLE), 1) AS usual FROM a JOIN f ON a.seq = f.seq AND a.acct = f.acct WHERE dir = 'O')
  SELECT seq, n AS sent_24h, floor(n / usual * 1000000 + 0.5) / 1000000 AS velocity_ratio, n >= 10 AND n / usual >= 3 AS hit FROM x""",
)
def _velocity(spark, sf_dir):
    v = _values(spark, sf_dir)
    return v.select("seq", F.col("sent_24h").cast("long").alias("sent_24h"), (F.floor(F.col("velocity_ratio") * 1_000_000 + 0.5) / 1_000_000).alias("velocity_ratio"), ((F.col("sent_24h") >= CFG.velocity_min) & (F.col("velocity_ratio") >= CFG.velocity_ratio)).alias("hit"))


@query(
    "pass_through",
    f"""WITH {_L}, x AS (SELECT seq, m, amount, list_filter(ins, lambda p: p.m >= m - 1440 AND p.peer <> peer AND p.amount > 0 AND amount / p.amount <= 1 + CAST('1e-6' AS DOUBLE) AND amount / p.amount >= CAST('0.9' AS DOUBLE)) AS f FROM a WHERE dir = 'O')
  SELECT seq, m - f[-1].m AS gap, round(amount / f[-1].amount, 6) AS ratio, f[-1].seq AS matched, m - f[-1].m <= 120 AS hit FROM x WHERE len(f) > 0""",
)
def _pass(spark, sf_dir):
    v = _values(spark, sf_dir).where("pass_gap IS NOT NULL")
    return v.select("seq", F.col("pass_gap").alias("gap"), F.round("pass_ratio", 6).alias("ratio"), F.col("pass_seq").alias("matched"), (F.col("pass_gap") <= CFG.pass_window).alias("hit"))


@query("live_adjacency", f"WITH {_L} SELECT seq, dir, acct, len(outs) AS n_out, len(ins) AS n_in, list_sum(list_transform(outs, lambda p: p.seq)) AS out_sum FROM a")
def _live(spark, sf_dir):
    total = F.when(F.size("outs") > 0, F.aggregate("outs", F.lit(0).cast("long"), lambda a, x: a + x["seq"]))
    size = lambda c: F.size(c).cast("long")
    rows = adjacency.live_adjacency(transfers(spark, sf_dir), {"n_out": size("outs"), "out_sum": total}, {"n_in": size("ins")}, CFG, fields=("m", "seq"))
    return rows.select("seq", "dir", "acct", "n_out", "n_in", "out_sum")


@query(
    "fan_out_evidence",
    f"""WITH {_L}, u AS (SELECT seq, unnest(outs) AS x FROM a WHERE dir = 'O' AND len({_peers('outs')}) >= 5), p AS (SELECT seq, x.peer AS peer, max(x.seq) AS e FROM u GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY e DESC) AS k FROM p) SELECT seq, string_agg(CAST(e AS VARCHAR), ',' ORDER BY k) AS evidence FROM n WHERE k <= 30 GROUP BY seq""",
)
def _evidence(spark, sf_dir):
    shown = F.when(F.size(adjacency.peers(F.col("outs"))) >= CFG.fan_threshold, adjacency.recent_per_peer(F.col("outs"), CFG.evidence_cap))
    ev = adjacency.live_adjacency(transfers(spark, sf_dir), {"ev": F.when(F.col("dir") == "O", shown)}, {}, CFG, fields=("m", "peer", "seq")).where("dir = 'O' AND ev IS NOT NULL")
    return ev.select("seq", F.array_join(F.transform("ev", lambda x: x.cast("string")), ",").alias("evidence"))


@query("scatter_gather", f"WITH {_L}, {_SG} SELECT seq, paths, origin FROM sg")
def _scatter(spark, sf_dir):
    return paths.scatter_gather(transfers(spark, sf_dir), CFG).select("seq", F.col("paths").cast("long").alias("paths"), "origin")


@query("cycle_len", f"WITH {_T}, {_cycle_ctes()} SELECT seq, cycle_len, round(cycle_amount_ratio, 6) AS cycle_amount_ratio, array_to_string(cycle_edges, ',') AS cycle_edges FROM cy")
def _cycle(spark, sf_dir):
    found = paths.cycles(transfers(spark, sf_dir), CFG)
    return found.select("seq", "cycle_len", F.round("cycle_amount_ratio", 6).alias("cycle_amount_ratio"), _joined(F.col("cycle_edges")).alias("cycle_edges"))


def _joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


@query("detector_hits", _HITS_SQL)
def _hits(spark, sf_dir):
    order = F.array(*map(F.lit, (*detectors.STRUCTURAL, "velocity")))
    found = detectors.hits(transfers(spark, sf_dir), cfg=CFG).select("seq", F.explode("hits").alias("h"))
    return found.select("seq", (F.array_position(order, F.col("h.name")) - 1).cast("int").alias("n"), "h.name", "h.value", _joined(F.col("h.evidence")).alias("evidence"))


@query("event_time_clamp", "SELECT event_id AS seq, max(epoch_us(ts) // 60000000 - event_id % 7) OVER (ORDER BY event_id) AS m FROM events")
def _clamp(spark, sf_dir):
    late = transfers(spark, sf_dir).withColumn("m_raw", F.col("m_raw") - F.col("seq") % 7)
    return src.clamp_event_time(late.drop("m")).select("seq", "m")


_BOUNDS = """p AS (SELECT epoch_us(ts) // 60000000 AS m, row_number() OVER (ORDER BY epoch_us(ts) // 60000000) - 1 AS i, count(*) OVER () AS n FROM events),
b AS (SELECT CAST(ceil(max(CASE WHEN i = floor(n * 0.6) THEN m END) / 1440) * 1440 AS BIGINT) AS a, CAST(ceil(max(CASE WHEN i = floor(n * 0.8) THEN m END) / 1440) * 1440 AS BIGINT) AS c FROM p)"""


@query("split_boundaries", f"WITH {_BOUNDS} SELECT a AS train_end, greatest(c, a + 1440) AS val_end FROM b")
def _bounds(spark, sf_dir):
    return src.split_boundaries(transfers(spark, sf_dir))


@query("time_split", f"WITH {_BOUNDS} SELECT CASE WHEN m < a THEN 'train' WHEN m < greatest(c, a + 1440) THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(m) AS first, max(m) AS last FROM p, b GROUP BY 1")
def _split(spark, sf_dir):
    t = transfers(spark, sf_dir)
    ends = src.split_boundaries(t).first()
    return t.groupBy(S.split_of(F.col("m_raw"), ends.train_end, ends.val_end).alias("split")).agg(F.count("*").alias("n"), F.min("m_raw").alias("first"), F.max("m_raw").alias("last"))


@query("negative_sample", "SELECT event_id AS seq FROM events WHERE CAST('0x' || substr(md5('row:' || event_id), 1, 12) AS BIGINT) % 1000000 < 100000")
def _negatives(spark, sf_dir):
    return transfers(spark, sf_dir).where(S.keep_negative(F.col("seq"), 0.1)).select("seq")


# Scored rows for the metric family: a score of a transfer's value, its label as truth.
_SC = "x AS (SELECT event_id AS seq, round(value / (value + 50), 3) AS score, value > 60 AND event_id % 3 <> 0 AS label FROM events)"
_SW = (
    _SC
    + """, g AS (SELECT score AS threshold, sum(CAST(label AS INT)) AS t, sum(1 - CAST(label AS INT)) AS f FROM x GROUP BY 1),
w AS (SELECT threshold, CAST(sum(t) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(f) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp, sum(t) OVER () AS pos FROM g),
pr AS (SELECT threshold, tp, fp, tp / CAST(tp + fp AS DOUBLE) AS p, CASE WHEN pos = 0 THEN 0 ELSE tp / CAST(pos AS DOUBLE) END AS r FROM w),
sweep AS (SELECT threshold, tp, fp, p AS "precision", r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("amount_paid")
    return transfers(spark, sf_dir).select("seq", "m", "src", "dst", F.round(v / (v + 50), 3).alias("score"), ((v > 60) & (F.col("seq") % 3 != 0)).alias("label"))


_CONF = """SELECT tp, fp, fn, tn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(10000 * (tp + fp) / CAST(n AS DOUBLE), 6) AS alerts_per_10k FROM
 (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM
 (SELECT count(*) FILTER (score >= 0.6 AND label) AS tp, count(*) FILTER (score >= 0.6 AND NOT label) AS fp, count(*) FILTER (score < 0.6 AND label) AS fn, count(*) FILTER (score < 0.6 AND NOT label) AS tn, count(*) AS n FROM x) AS a) AS b"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("confusion", f"WITH {_SC} {_CONF}")
def _confusion(spark, sf_dir):
    return _rounded(metrics.confusion(_scored(spark, sf_dir), 0.6))


@query("alerts_per_10k", f"WITH {_SC} SELECT round(10000 * count(*) FILTER (score >= 0.7) / CAST(count(*) AS DOUBLE), 6) AS alerts_per_10k FROM x")
def _per_10k(spark, sf_dir):
    return _rounded(metrics.confusion(_scored(spark, sf_dir), 0.7).select("alerts_per_10k"))


@query("pr_sweep", f'WITH {_SW} SELECT threshold, tp, fp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep')
def _sweep(spark, sf_dir):
    return _rounded(metrics.pr_sweep(_scored(spark, sf_dir)).select("threshold", "tp", "fp", "precision", "recall", "f1"))


@query("average_precision", f'WITH {_SW} SELECT round(sum((recall - prev) * "precision"), 6) AS ap FROM (SELECT *, lag(recall, 1, 0) OVER (ORDER BY threshold DESC) AS prev FROM sweep) AS q')
def _ap(spark, sf_dir):
    return _rounded(metrics.average_precision(metrics.pr_sweep(_scored(spark, sf_dir))))


@query("best_f1", f'WITH {_SW} SELECT threshold, tp, fp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep ORDER BY f1 DESC, threshold DESC LIMIT 1')
def _best(spark, sf_dir):
    return _rounded(metrics.best_f1(metrics.pr_sweep(_scored(spark, sf_dir))).select("threshold", "tp", "fp", "precision", "recall", "f1"))


# Patterns for recall: each user's transfers of one type are one attempt.
_MP = _SC + ", mp AS (SELECT e.user_id AS idx, e.event_type AS typology, e.event_id AS seq, epoch_us(e.ts) // 60000000 AS m, x.score >= 0.75 AS alert FROM events AS e JOIN x ON e.event_id = x.seq)"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select(F.col("seq").cast("string").alias("key"), "seq", "m", (F.col("score") >= 0.75).alias("alert"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    patterns = e.groupBy(F.col("user_id").alias("index"), F.col("event_type").alias("typology")).agg(F.collect_list(F.col("event_id").cast("string")).alias("keys"))
    return metrics.matched_patterns(rows, patterns)


@query(
    "pattern_recall",
    f"WITH {_MP} SELECT count(*) AS patterns, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall_any, round(avg(CASE WHEN 2 * h >= n THEN 1.0 ELSE 0.0 END), 6) AS recall_half FROM (SELECT idx, count(*) AS n, sum(CAST(alert AS INT)) AS h FROM mp GROUP BY idx) AS q",
)
def _pattern(spark, sf_dir):
    return _rounded(metrics.pattern_recall(_matched(spark, sf_dir)))


@query("typology_recall", f"WITH {_MP} SELECT typology, count(DISTINCT seq) AS transfers, count(DISTINCT CASE WHEN alert THEN seq END) AS alerted, round(count(DISTINCT CASE WHEN alert THEN seq END) / CAST(count(DISTINCT seq) AS DOUBLE), 6) AS recall FROM mp GROUP BY 1")
def _typology(spark, sf_dir):
    return _rounded(metrics.typology_recall(_matched(spark, sf_dir)))


@query(
    "alert_clusters",
    """WITH RECURSIVE al AS (SELECT user_id AS a, CAST(props->>'k' AS BIGINT) AS b, value > 250 AND event_id % 3 <> 0 AS label FROM events WHERE value / (value + 50) >= CAST('0.8' AS DOUBLE)),
  ed AS (SELECT DISTINCT a, b FROM al UNION SELECT b, a FROM al), nodes AS (SELECT DISTINCT a AS n FROM ed),
  reach AS (SELECT n AS node, n AS other FROM nodes UNION SELECT reach.node, ed.b FROM reach JOIN ed ON reach.other = ed.a),
  lab AS (SELECT node, min(other) AS root FROM reach GROUP BY node), sz AS (SELECT root, count(*) AS size FROM lab GROUP BY root),
  tr AS (SELECT root, max(CAST(label AS INT)) AS tr FROM al JOIN lab ON al.a = lab.node GROUP BY root), per AS (SELECT size, tr FROM sz JOIN tr USING (root)),
  o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM per)
  SELECT (SELECT count(*) FROM per) AS clusters, round((SELECT avg(tr) FROM per), 6) AS cluster_precision, (SELECT max(size) FROM o WHERE i = n // 2) AS median_size, (SELECT max(size) FROM per) AS max_size""",
)
def _clusters(spark, sf_dir):
    t = transfers(spark, sf_dir).where(F.col("amount_paid") / (F.col("amount_paid") + 50) >= ALERT_AT)
    return _rounded(metrics.alert_clusters(t.select("src", "dst", ((F.col("amount_paid") > 250) & (F.col("seq") % 3 != 0)).alias("label"))))


@query("rule_ring_size", f"{_GRAPH}, {_RG} SELECT pr.seq, coalesce(ring_size, 0) AS ring_size FROM pr LEFT JOIN rz ON pr.seq = rz.seq")
def _ring(spark, sf_dir):
    return _rings(spark, sf_dir, False).select("seq", "ring_size")


@query(
    "ring_members",
    f"""{_GRAPH}, {_RG}, rm AS (SELECT seq, start, node, row_number() OVER (PARTITION BY seq ORDER BY node) AS k FROM rc),
  rl AS (SELECT rc.seq, min(lk.seq) AS ring_id, count(DISTINCT lk.seq) AS ring_edges, array_to_string(list_sort(list_sort(list(DISTINCT lk.seq), 'DESC')[:30]), ',') AS evidence FROM rc JOIN es USING (start) JOIN lk ON lk.src = rc.node AND lk.seq <= rc.seq AND lk.m >= rc.start - 5760 AND lk.m < stop GROUP BY rc.seq)
  SELECT rl.seq, ring_id, ring_edges, evidence, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM rl JOIN rm ON rm.seq = rl.seq AND k <= 50 GROUP BY ALL""",
)
def _members(spark, sf_dir):
    r = _rings(spark, sf_dir, True)
    return r.where("ring_id IS NOT NULL").select("seq", "ring_id", F.col("ring_edges").cast("long").alias("ring_edges"), _joined(F.col("members")).alias("members"), _joined(F.col("evidence")).alias("evidence"))


def _rings(spark: SparkSession, sf_dir: str, members: bool) -> DataFrame:
    t = transfers(spark, sf_dir)
    return rings.rule_rings(t, features.hit_flags(features.graph_values(t, CFG), CFG), CFG, members)


@query("graph_stats", f"WITH {_L} SELECT (SELECT count(DISTINCT acct) FROM (SELECT src AS acct FROM t UNION ALL SELECT dst FROM t) AS u) AS accounts, (SELECT count(*) FROM t WHERE src <> dst AND m >= (SELECT max(m) FROM t) - 5760) AS live_edges, (SELECT max(history) FROM a) AS busiest")
def _stats(spark, sf_dir):
    t = transfers(spark, sf_dir)
    now = t.agg(F.max("m")).first()[0]
    edge = F.col("src") != F.col("dst")
    ends = t.select(F.explode(F.array(F.struct(F.col("src").alias("acct"), (edge & (F.col("m") >= F.lit(now) - CFG.window)).cast("long").alias("live"), edge.cast("long").alias("edge")), F.struct(F.col("dst").alias("acct"), F.lit(0).cast("long").alias("live"), edge.cast("long").alias("edge")))).alias("e")).select("e.*")
    per = ends.groupBy("acct").agg(F.sum("live").alias("live"), F.sum("edge").alias("edges"))
    return per.agg(F.count("*").alias("accounts"), F.sum("live").alias("live_edges"), F.max("edges").alias("busiest"))


# Alerts for the cluster and case queries: transfers whose score reaches the alert threshold; account keys with their bank.
_AL = """al AS (SELECT 'txn-' || event_id AS alert_id, event_id AS alert_no, event_id AS tx_id, (user_id % 20) || ':' || user_id AS fa, ((CAST(props->>'k' AS BIGINT)) % 20) || ':' || (props->>'k') AS ta, round(value, 2) AS amount, value / (value + 50) AS score, ts FROM events WHERE value / (value + 50) >= CAST('0.8' AS DOUBLE))"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir).where(F.col("amount_paid") / (F.col("amount_paid") + 50) >= ALERT_AT)
    key = lambda a, b: S.account_key(F.col(a), F.col(b))
    return t.select(
        F.concat(F.lit("txn-"), F.col("seq").cast("string")).alias("alert_id"), F.col("seq").alias("alert_no"), F.col("seq").alias("tx_id"), key("from_bank", "from_account").alias("from_account"), key("to_bank", "to_account").alias("to_account"),
        F.round("amount_paid", 2).alias("amount_usd"), (F.col("amount_paid") / (F.col("amount_paid") + 50)).alias("score"), F.lit(None).cast("string").alias("ring_id"), F.array().cast("array<string>").alias("ring_accounts"), S.format_minutes(F.col("m")).alias("event_ts"),
        F.array(F.struct(F.lit("fan_out").alias("name"), F.lit(1.0).alias("value"), F.lit("").alias("detail"), F.array(F.struct(F.col("seq").alias("txId"), key("from_bank", "from_account").alias("from"), key("to_bank", "to_account").alias("to"), F.round("amount_paid", 2).alias("amountUsd"), S.format_minutes(F.col("m")).alias("timestamp"), (F.col("seq") % 2 == 0).alias("laundering"))).alias("edges"))).alias("detectors"),
    )


# Cases: alerts that share an account, over any number of links.
_CASES = """, k AS (SELECT alert_no, fa AS key FROM al UNION SELECT alert_no, ta FROM al), hub AS (SELECT key, min(alert_no) AS a FROM k GROUP BY key), lk AS (SELECT DISTINCT a, alert_no AS b FROM k JOIN hub USING (key)),
 ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), reach AS (SELECT alert_no AS node, alert_no AS other FROM al UNION SELECT reach.node, ed.b FROM reach JOIN ed ON reach.other = ed.a),
 cs AS (SELECT 'txn-' || node AS alert_id, min(other) AS case_id FROM reach GROUP BY node)"""
_WHOLE = "WITH RECURSIVE " + _AL + _CASES
# For the page and the reasons, an account of three days is an account of its own, so that alerts fall into many cases.
_CC = "WITH RECURSIVE " + _AL.replace(" AS fa,", " || ':' || (epoch_us(ts) // 259200000000) AS fa,").replace(" AS ta,", " || ':' || (epoch_us(ts) // 259200000000) AS ta,") + _CASES


def _case_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.substring("event_ts", 1, 10)
    number = F.floor(F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")) / 3).cast("string")
    return _alerts(spark, sf_dir).withColumns({c: F.concat_ws(":", c, number) for c in ("from_account", "to_account")})


@query("case_grouping", _WHOLE + " SELECT alert_id, case_id FROM cs")
def _grouping(spark, sf_dir):
    return cases.group_cases(_alerts(spark, sf_dir))


def _rollup(alerts: DataFrame) -> DataFrame:
    return cases.case_rollup(alerts, cases.group_cases(alerts))


_RL = """, j AS (SELECT * FROM al JOIN cs USING (alert_id)), ac AS (SELECT case_id, count(DISTINCT x) AS accounts FROM (SELECT case_id, fa AS x FROM j UNION ALL SELECT case_id, ta FROM j) AS u GROUP BY 1),
 ru AS (SELECT case_id, max(score) AS max_score, count(*) AS alert_count, CAST(sum(CAST(amount AS DECIMAL(19, 2))) AS DOUBLE) AS total FROM j GROUP BY 1),
 rollup AS (SELECT case_id, round(max_score, 6) AS max_score, alert_count, total AS total_amount_usd, accounts, CASE WHEN (max_score >= 0.9 AND alert_count >= 3) OR total >= 1000000 THEN 'CRITICAL' WHEN max_score >= 0.85 OR alert_count >= 5 OR total >= 100000 THEN 'HIGH' WHEN max_score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM ru JOIN ac USING (case_id))"""


@query("case_rollup_priority", _WHOLE + _RL + " SELECT * FROM rollup")
def _priority(spark, sf_dir):
    return _rollup(_alerts(spark, sf_dir)).withColumn("max_score", F.round("max_score", 6))


@query("case_list_page", _CC + _RL + " SELECT case_id, alert_count, priority FROM rollup ORDER BY alert_count DESC, case_id LIMIT 20")
def _page(spark, sf_dir):
    return cases.case_page(_rollup(_case_alerts(spark, sf_dir)).select("case_id", "alert_count", "priority"), "alert_count")[0]


_RF = """ SELECT case_id, 'Case CASE-2024-' || lpad(CAST(case_id AS VARCHAR), 6, '0') || ': ' || alert_count || ' transaction alert(s) across ' || accounts || ' account(s) totalling USD ' || CAST(CAST(total_amount_usd AS DECIMAL(19, 2)) AS VARCHAR)
 || ' were flagged by the network monitoring model rules (maximum score ' || CAST(CAST(max_score AS DECIMAL(10, 3)) AS VARCHAR) || '). Observed typologies: rapid dispersal of funds to many accounts (fan-out). The pattern is consistent with money-mule activity and layering of illicit funds.' AS reason FROM rollup"""


@query("str_reason", _CC + _RL + _RF)
def _reason(spark, sf_dir):
    c = _rollup(_case_alerts(spark, sf_dir)).withColumn("max_score", F.round("max_score", 6))
    seen = F.lower(S.indicator_text(F.lit("fan_out")))
    return cases.str_reason(c.withColumns({"reference": S.case_reference(F.lit(2024), F.col("case_id")), "models": F.lit("rules"), "typologies": seen}))


_DUP = "bt AS (SELECT 'a' || event_id % 500 AS alert_id, event_id AS position FROM events), st AS (SELECT DISTINCT 'a' || event_id % 37 AS alert_id FROM events WHERE event_id < 100)"


@query("alert_dedup", f"WITH {_DUP} SELECT alert_id, min(position) AS position FROM bt WHERE alert_id NOT IN (SELECT alert_id FROM st) GROUP BY alert_id")
def _dedup(spark, sf_dir):
    t = transfers(spark, sf_dir)
    named = lambda n: F.concat(F.lit("a"), (F.col("seq") % n).cast("string")).alias("alert_id")
    return cases.new_alerts(t.select(named(500), F.col("seq").alias("position")), t.where("seq < 100").select(named(37)).distinct())


@query(
    "ingest_outcomes",
    f"""WITH {_DUP}, o AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY position) = 1 AND alert_id NOT IN (SELECT alert_id FROM st) AS fresh FROM bt)
  SELECT position, alert_id, CASE WHEN fresh THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS outcome, CAST(substr(alert_id, 2) AS BIGINT) AS case_id FROM o""",
)
def _outcomes(spark, sf_dir):
    t = transfers(spark, sf_dir)
    named = lambda n: F.concat(F.lit("a"), (F.col("seq") % n).cast("string")).alias("alert_id")
    batch, stored = t.select(named(500), F.col("seq").alias("position")), t.where("seq < 100").select(named(37)).distinct()
    return cases.outcomes(batch, stored, batch.select("alert_id", F.substring("alert_id", 2, 20).cast("long").alias("case_id")).distinct())


# Alerts that arrive in two batches, even and odd numbers; accounts are of five days each, so that many cases form and some merge. Of
# the first batch's cases every third closes before the second batch comes.
_DAY = """da AS (SELECT event_id AS no, user_id || ':' || (epoch_us(ts) // 432000000000) AS fa, (props->>'k') || ':' || (epoch_us(ts) // 432000000000) AS ta, ts, round(value, 2) AS amount, value / (value + 50) AS score,
  ['fan_out', 'cycle', 'pass_through'][event_id % 3 + 1] AS det FROM events WHERE value / (value + 50) >= CAST('0.8' AS DOUBLE)),
dk AS (SELECT no, fa AS key FROM da UNION SELECT no, ta FROM da),
h1 AS (SELECT key, min(no) AS a FROM dk WHERE no % 2 = 0 GROUP BY key), l1 AS (SELECT DISTINCT a, no AS b FROM dk JOIN h1 USING (key) WHERE no % 2 = 0), e1 AS (SELECT a, b FROM l1 UNION SELECT b, a FROM l1),
r1 AS (SELECT no AS node, no AS other FROM da WHERE no % 2 = 0 UNION SELECT r1.node, e1.b FROM r1 JOIN e1 ON r1.other = e1.a), c1 AS (SELECT node AS no, min(other) AS case_id FROM r1 GROUP BY node),
n2 AS (SELECT 1000000000000 + no AS node, key FROM dk WHERE no % 2 = 1 UNION SELECT case_id, key FROM c1 JOIN dk USING (no) WHERE case_id % 3 <> 0),
h2 AS (SELECT key, min(node) AS a FROM n2 GROUP BY key), l2 AS (SELECT DISTINCT a, node AS b FROM n2 JOIN h2 USING (key)), e2 AS (SELECT a, b FROM l2 UNION SELECT b, a FROM l2),
r2 AS (SELECT DISTINCT node, node AS other FROM n2 UNION SELECT r2.node, e2.b FROM r2 JOIN e2 ON r2.other = e2.a), c2 AS (SELECT node, min(other) % 1000000000000 AS root FROM r2 GROUP BY node),
mem AS (SELECT c1.no, coalesce(root, case_id) AS case_id FROM c1 LEFT JOIN c2 ON c1.case_id = c2.node UNION ALL SELECT node - 1000000000000, root FROM c2 WHERE node >= 1000000000000),
st AS (SELECT DISTINCT c1.case_id, CASE WHEN c1.case_id % 3 = 0 THEN 'CLOSED' WHEN root <> c1.case_id THEN 'MERGED' ELSE 'OPEN' END AS status, CASE WHEN root <> c1.case_id THEN root END AS merged_into FROM c1 LEFT JOIN c2 ON c1.case_id = c2.node
  UNION SELECT root, 'OPEN', NULL FROM c2 WHERE root NOT IN (SELECT case_id FROM c1))"""


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, membership, cases) after both batches."""
    t = transfers(spark, sf_dir).where(F.col("amount_paid") / (F.col("amount_paid") + 50) >= ALERT_AT)
    day = F.floor(F.col("m") / 7200).cast("string")
    name = F.element_at(F.array(*map(F.lit, ("fan_out", "cycle", "pass_through"))), (F.col("seq") % 3 + 1).cast("int"))
    alerts = t.select(
        F.concat(F.lit("d-"), F.col("seq").cast("string")).alias("alert_id"), F.col("seq").alias("alert_no"), F.col("seq").alias("tx_id"), F.concat_ws(":", F.col("src").cast("string"), day).alias("from_account"), F.concat_ws(":", F.col("dst").cast("string"), day).alias("to_account"),
        F.round("amount_paid", 2).alias("amount_usd"), (F.col("amount_paid") / (F.col("amount_paid") + 50)).alias("score"), F.lit(None).cast("string").alias("ring_id"), F.array().cast("array<string>").alias("ring_accounts"), S.format_minutes(F.col("m")).alias("event_ts"), F.array(F.struct(name.alias("name"))).alias("detectors"),
    )
    first, second = alerts.where("alert_no % 2 = 0"), alerts.where("alert_no % 2 = 1")
    none = first.where("false").select("alert_id", F.col("alert_no").alias("case_id"))
    empty = spark.createDataFrame([], "case_id long, status string, created_at long, merged_into long")
    members, opened, _ = cases.attach(first, first.where("false"), none, empty)
    closed = opened.withColumn("status", F.when(F.col("case_id") % 3 == 0, "CLOSED").otherwise(F.col("status")))
    members, after, _ = cases.attach(second, first, members, closed)
    return alerts, members, after


@query("case_attach", f"WITH RECURSIVE {_DAY} SELECT 'd-' || no AS alert_id, case_id FROM mem")
def _attach(spark, sf_dir):
    return _two_batches(spark, sf_dir)[1]


@query(
    "case_details",
    f"""WITH RECURSIVE {_DAY}, j AS (SELECT * FROM da JOIN mem USING (no)), ac AS (SELECT case_id, string_agg(DISTINCT x, ',' ORDER BY x) AS accounts FROM (SELECT case_id, fa AS x FROM j UNION SELECT case_id, ta FROM j) AS u GROUP BY case_id),
  al AS (SELECT case_id, string_agg('d-' || no, ',' ORDER BY epoch_us(ts) // 60000000, no) AS alerts FROM j GROUP BY case_id)
  SELECT case_id, status, merged_into, coalesce(accounts, '') AS accounts, coalesce(alerts, '') AS alerts, CASE WHEN status = 'OPEN' THEN 'INVESTIGATING' ELSE '' END AS allowed FROM st LEFT JOIN ac USING (case_id) LEFT JOIN al USING (case_id)""",
)
def _details(spark, sf_dir):
    alerts, members, after = _two_batches(spark, sf_dir)
    d = cases.case_details(after, members, alerts)
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return d.select("case_id", "status", "merged_into", listed(F.col("accounts")).alias("accounts"), listed(F.transform("alerts", lambda x: x["alert_id"])).alias("alerts"), listed(F.col("allowed")).alias("allowed"))


@query(
    "str_indicators",
    f"""WITH RECURSIVE {_DAY}, j AS (SELECT case_id, CASE det WHEN 'fan_out' THEN 'FANOUT' WHEN 'cycle' THEN 'CYCLE' ELSE 'PASSTHRU' END AS code, min((epoch_us(ts) // 60000000, no)) AS f FROM da JOIN mem USING (no) GROUP BY ALL)
  SELECT case_id, string_agg(code, ',' ORDER BY f) || ',MODEL' AS indicators FROM j GROUP BY case_id""",
)
def _indicators(spark, sf_dir):
    alerts, members, _ = _two_batches(spark, sf_dir)
    return cases.str_indicators(alerts, members).select("case_id", F.array_join("indicators", ",").alias("indicators"))


@query("case_graph_edges", f"WITH {_AL} SELECT 'tx:' || tx_id AS key, fa AS source, ta AS target, amount, 'alert,fan_out' AS detectors, tx_id % 2 = 0 AS laundering, true AS alerted FROM al")
def _edges(spark, sf_dir):
    return cases.graph_edges(_alerts(spark, sf_dir)).drop("tx_id", "ts")


@query(
    "case_graph_nodes",
    f"""WITH {_AL}, n AS (SELECT fa AS id, 1 AS s, 0 AS g FROM al UNION ALL SELECT ta, 0, 1 FROM al), d AS (SELECT id, sum(s) AS s, sum(g) AS g FROM n GROUP BY id)
 SELECT id, split_part(id, ':', 2) || ' @' || split_part(id, ':', 1) AS label, CASE WHEN s > 0 AND g > 0 THEN 'intermediary' WHEN s > 0 THEN 'source' ELSE 'sink' END AS role, split_part(id, ':', 1) AS bank, false AS in_ring, true AS alerted, CAST(s AS BIGINT) AS sent, CAST(g AS BIGINT) AS got FROM d""",
)
def _nodes(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return cases.graph_nodes(cases.graph_edges(a), a).drop("first")


@query(
    "audit_fold_status",
    """WITH v AS (SELECT user_id AS case_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
 SELECT case_id, CASE WHEN count(*) >= 3 THEN 'CLOSED' WHEN count(*) = 2 THEN 'ESCALATED' ELSE 'INVESTIGATING' END AS status, CASE WHEN count(*) >= 3 THEN 'FALSE_POSITIVE' END AS disposition, least(count(*), 3) AS applied, greatest(count(*) - 3, 0) AS rejected FROM v GROUP BY case_id""",
)
def _fold(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("src").orderBy("seq"))
    e = transfers(spark, sf_dir).withColumn("k", k)
    to = F.when(F.col("k") == 1, "INVESTIGATING").when(F.col("k") == 2, "ESCALATED").otherwise("CLOSED")
    events = e.select(F.col("src").alias("case_id"), F.col("seq").alias("event_id"), F.lit("TRANSITION").alias("action"), to.alias("to_status"), F.when(F.col("k") >= 3, "FALSE_POSITIVE").alias("disposition"), F.lit("analyst").alias("actor"), F.lit(None).cast("string").alias("assignee"))
    out = cases.fold_status(events)
    return out.select("case_id", "status", "disposition", F.col("applied").cast("long").alias("applied"), F.col("rejected").cast("long").alias("rejected"))


@query(
    "payment_codes",
    f"""WITH {_T} SELECT seq, CASE format WHEN 'ACH' THEN 'ACH' WHEN 'Wire' THEN 'WIRE' WHEN 'Credit Card' THEN 'CARD' WHEN 'Cheque' THEN 'CHEQUE' WHEN 'Cash' THEN 'CASH' ELSE 'OTHER' END AS transmode,
 CASE format WHEN 'Cheque' THEN 'CHEQUE' WHEN 'Cash' THEN 'CASH' ELSE 'ACCOUNT' END AS funds, CASE ccy WHEN 'US Dollar' THEN 'USD' WHEN 'Euro' THEN 'EUR' WHEN 'Yuan' THEN 'CNY' WHEN 'Bitcoin' THEN 'XBT' ELSE 'XXX' END AS currency FROM t""",
)
def _codes(spark, sf_dir):
    t = transfers(spark, sf_dir)
    return t.select("seq", S.transmode(F.col("format")).alias("transmode"), S.funds_code(F.col("format")).alias("funds"), S.currency_code(F.col("payment_currency")).alias("currency"))


@query("account_ref", f"WITH {_T} SELECT seq, CAST(src % 20 AS VARCHAR) AS bank, CAST(src AS VARCHAR) AS account, src || ' @' || src % 20 AS label FROM t")
def _ref(spark, sf_dir):
    key = S.account_key(F.col("from_bank"), F.col("from_account"))
    return transfers(spark, sf_dir).select("seq", S.bank_of(key).alias("bank"), S.account_of(key).alias("account"), S.account_label(key).alias("label"))


_BASE_SQL = f"""{_GRAPH}, {_BOUNDS}, ends AS (SELECT a AS ta, greatest(c, a + 1440) AS va FROM b),
x3 AS (SELECT t.seq, t.m, amount_paid > 150 AS label, ln(1 + greatest(t.amount, 0)) AS amount_rule, coalesce(ln(1 + sent_24h), 0) AS velocity_rule, CAST(coalesce(CAST(src_out >= 5 AS INT) + CAST(dst_in >= 5 AS INT) + CAST(coalesce(paths, 0) >= 3 AS INT) + CAST(src_in >= 3 AND src_out >= 3 AS INT)
  + CAST(cycle_len IS NOT NULL AS INT) + CAST(coalesce(pass_gap, 1000000) <= 120 AS INT) + CAST(sent_24h >= 10 AND velocity_ratio >= 3 AS INT), 0) AS DOUBLE) AS rules_only FROM t LEFT JOIN v ON t.seq = v.seq),
u3 AS (SELECT 'amount_rule' AS method, m, label, amount_rule AS score FROM x3 UNION ALL SELECT 'velocity_rule', m, label, velocity_rule FROM x3 UNION ALL SELECT 'rules_only', m, label, rules_only FROM x3),
g3 AS (SELECT method, score, sum(CAST(label AS INT)) AS t, sum(1 - CAST(label AS INT)) AS f FROM u3, ends WHERE m >= ta AND m < va GROUP BY ALL),
w3 AS (SELECT method, score, sum(t) OVER w AS tp, sum(f) OVER w AS fp, sum(t) OVER (PARTITION BY method) AS pos FROM g3 WINDOW w AS (PARTITION BY method ORDER BY score DESC)),
f3 AS (SELECT method, score, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)::DOUBLE) * (tp / pos::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / pos::DOUBLE) END AS f1 FROM w3),
b3 AS (SELECT method, score AS threshold, f1 AS val_f1 FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, score DESC) AS r FROM f3) AS q WHERE r = 1),
c3 AS (SELECT method, threshold, val_f1, count(*) FILTER (score >= threshold AND label) AS tp, count(*) FILTER (score >= threshold AND NOT label) AS fp, count(*) FILTER (score < threshold AND label) AS fn, count(*) FILTER (score < threshold AND NOT label) AS tn FROM u3 JOIN b3 USING (method), ends WHERE m >= va GROUP BY ALL)
SELECT method, round(threshold, 6) AS threshold, round(val_f1, 6) AS val_f1, tp, fp, fn, tn FROM c3"""


@query("baseline_report", _BASE_SQL)
def _baselines(spark, sf_dir):
    """Thresholds of the three baselines by validation rows, and their confusion on test rows."""
    t = transfers(spark, sf_dir)
    ends = src.split_boundaries(t).first()
    fired = features.graph_values(t, CFG).select("seq", features.fired(CFG).alias("n_detectors"), S.log1p(F.col("sent_24h")).alias("src_velocity_24h"))
    rows = t.select("seq", "m", "label", S.log1p(F.col("amount_usd")).alias("log_amount_usd")).join(fired, "seq", "left").fillna(0, subset=["n_detectors", "src_velocity_24h"])
    limits = alert_plan.baseline_thresholds(rows.where((F.col("m") >= ends.train_end) & (F.col("m") < ends.val_end)))
    test = rows.where(F.col("m") >= ends.val_end).select("label", F.inline(F.array(*(F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("score")) for n, c in alert_plan.BASELINES.items()))))
    hit = F.col("score") >= F.col("threshold")
    n = lambda c: F.sum(c.cast("long"))
    counts = test.join(F.broadcast(limits), "method").groupBy("method", "threshold", "val_f1").agg(n(hit & F.col("label")).alias("tp"), n(hit & ~F.col("label")).alias("fp"), n(~hit & F.col("label")).alias("fn"), n(~hit & ~F.col("label")).alias("tn"))
    return counts.select("method", F.round("threshold", 6).alias("threshold"), F.round("val_f1", 6).alias("val_f1"), "tp", "fp", "fn", "tn")


#: Steps of the regression in queries: each is a pass over the training rows; the library's own default is 300.
EPOCHS = 40


@query("evaluate_methods")
def _methods(spark, sf_dir):
    """All six methods on test rows: models and thresholds never see them."""
    t = transfers(spark, sf_dir)
    ends = src.split_boundaries(t).first()
    full, methods, naive = alert_plan.train_methods(t, ends.train_end, ends.val_end, CFG, trees=10, depth=3, epochs=EPOCHS)
    found = alert_plan.evaluate(full, methods, start=ends.val_end, naive=naive)["methods"]
    return spark.createDataFrame([(k, round(float(v["precision"]), 6), round(float(v["recall"]), 6), round(float(v["f1"]), 6), round(float(v["average_precision"]), 6)) for k, v in found.items()], "method string, precision double, recall double, f1 double, average_precision double")


def _trained(spark: SparkSession, sf_dir: str, values: DataFrame | None = None):
    t = transfers(spark, sf_dir)
    ends = src.split_boundaries(t).first()
    return t, *alert_plan.scored_transfers(t, ends.train_end, ends.val_end, CFG, trees=10, depth=3, values=values)[:2]


@query("stage1_score")
def _stage1(spark, sf_dir):
    return _trained(spark, sf_dir)[1].select("seq", F.round("s1", 6).alias("s1"))


@query("gbdt_score")
def _gbdt(spark, sf_dir):
    _, scored, model = _trained(spark, sf_dir)
    return scored.select("seq", F.round("score", 6).alias("score"), (F.col("score") >= model.threshold).alias("alert"))


def _lr_sql(epochs: int, n: int = 12, rate: float = 0.05, l2: float = 1e-4) -> str:
    """The regression's steps as a recursive query: weights w, moments a and b, of which the last is the bias'."""
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    each = lambda form, sep=", ", upto=n: sep.join(form.format(j=j) for j in range(1, upto + 1))
    names = [*(f"CAST(format = '{f}' AS DOUBLE)" for f in PAYMENT_FORMATS), "ln(1 + greatest(amount, 0))", "CAST(ccy <> rccy AS DOUBLE)", "CAST(src % 20 = dst % 20 AS DOUBLE)", "CAST(amount_paid >= 100 AND amount_paid % 100 < 1e-9 AS DOUBLE)"]
    vs = ", ".join(f"{x} AS v{j}" for j, x in enumerate(names, 1))
    z = each(f"(v{{j}} - mu{{j}}) / greatest(sqrt(va{{j}}), {d(1e-6)}) AS x{{j}}", upto=n - 1) + f", {d(1.0)} AS x{n}"
    margin = each("w{j} * x{j}", " + ")
    grad = each(f"sum(off * x{{j}}) / any_value(ws) + {d(l2)} * any_value(w{{j}}) AS g{{j}}", upto=n - 1) + f", sum(off * x{n}) / any_value(ws) AS g{n}"
    moved = each(f"w{{j}} - {d(rate)} * (a{{j}} / (1 - power({d(0.9)}, t))) / (sqrt(b{{j}} / (1 - power({d(0.999)}, t))) + {d(1e-8)}) AS w{{j}}, a{{j}}, b{{j}}")
    kept = each(f"w{{j}}, {d(0.9)} * a{{j}} + (1 - {d(0.9)}) * g{{j}} AS a{{j}}, {d(0.999)} * b{{j}} + (1 - {d(0.999)}) * g{{j}} * g{{j}} AS b{{j}}")
    return f"""WITH RECURSIVE {_T}, {_BOUNDS},
q AS (SELECT seq, m, amount_paid > 150 AS label, {vs} FROM t),
tr AS MATERIALIZED (SELECT q.*, CASE WHEN label THEN {d(1.0)} ELSE {d(2.0)} END AS wt FROM q, b WHERE m < a AND (label OR CAST('0x' || substr(md5('row:' || seq), 1, 12) AS BIGINT) % 1000000 < 500000)),
mn AS MATERIALIZED (SELECT sum(wt) AS ws, sum(wt * CAST(label AS DOUBLE)) / sum(wt) AS prior, {each("sum(wt * v{j}) / sum(wt) AS mu{j}", upto=n - 1)} FROM tr),
vr AS MATERIALIZED (SELECT any_value(COLUMNS(mn.*)), {each("sum(wt * (v{j} - mu{j}) * (v{j} - mu{j})) / sum(wt) AS va{j}", upto=n - 1)} FROM tr, mn),
zs AS MATERIALIZED (SELECT CAST(label AS DOUBLE) AS y, wt, ws, {z} FROM tr, vr),
fit AS (SELECT 0 AS t, {each("CAST(0 AS DOUBLE) AS w{j}, CAST(0 AS DOUBLE) AS a{j}, CAST(0 AS DOUBLE) AS b{j}", upto=n - 1)}, ln(prior / (1 - prior)) AS w{n}, CAST(0 AS DOUBLE) AS a{n}, CAST(0 AS DOUBLE) AS b{n} FROM mn
  UNION ALL SELECT t, {moved} FROM (SELECT t, {kept} FROM (
    SELECT t + 1 AS t, {each("any_value(w{j}) AS w{j}, any_value(a{j}) AS a{j}, any_value(b{j}) AS b{j}")}, {grad} FROM (SELECT fit.*, zs.*, (1 / (1 + exp(-({margin}))) - y) * wt AS off FROM fit, zs WHERE t < {epochs}) AS o GROUP BY t) AS o2) AS o3)
SELECT seq, round(1 / (1 + exp(-({margin}))), 6) AS score FROM (SELECT seq, {z} FROM q, vr, b WHERE m >= a) AS u, fit WHERE t = {epochs}"""


@query("lr_score", _lr_sql(EPOCHS))
def _lr(spark, sf_dir):
    """Scores of the transfers that training hasn't seen."""
    t = transfers(spark, sf_dir)
    end = src.split_boundaries(t).first().train_end
    rows = t.select("seq", "m", "label").join(features.txn_features(t), "seq")
    model = models.train_lr(models.weighted_sample(rows.where(F.col("m") < end), 0.5), list(TXN_ONLY), epochs=EPOCHS)
    return rows.where(F.col("m") >= end).select("seq", F.round(model.score(), 6).alias("score"))


@query("explain_topk")
def _explain(spark, sf_dir):
    _, scored, model = _trained(spark, sf_dir)
    return scored.select("seq", F.array_join(F.transform(model.explain(5), lambda x: x["name"]), ",").alias("top"))


@query("alert_payload")
def _payload(spark, sf_dir):
    # the same values serve the features and the alerts' evidence
    values = features.graph_values(transfers(spark, sf_dir), CFG, evidence=True)
    t, scored, model = _trained(spark, sf_dir, values)
    a = alert_plan.alerts(t, scored, model, CFG, values)
    return a.select("alertId", F.to_json(F.struct(*a.columns)).alias("document"))
