"""Operator 3: quality rules by robust multivariate outliers. Built-in functions only.

Base counts come from each whole text. Four of them, transformed and rounded to
integers, make a document's statistic vector. Per language and source, a
minimum-covariance-determinant estimate is reached by concentration steps from two
starts (classical moments, and coordinate medians); the start with the smaller
determinant wins. A document is rejected when its squared Mahalanobis distance
exceeds a chi-square-scale cutoff.

Sums of integers don't depend on the order of rows, so the estimates don't
depend on the partitioning. The h-subset is cut at a histogram of distances
(sixteenths at first), so no group is ever collected or sorted: all aggregates combine map-side and
their rows are bounded by groups times histogram cells. A fixed ridge keeps the
covariance regular where statistics are constant, as most are in clean text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

_P = 4
_SCALE = 256  # integer steps of a transformed statistic's unit
_SHARE = 0.75  # of a group's rows in the h-subset
#: Histogram cells of a squared distance: sixteenths up to 256, from there 256 cells a factor of e, without an end.
_CELL = "CAST(floor(CASE WHEN {d2} < 256 THEN 16 * {d2} ELSE 4096 + 256 * ln({d2} / 256) END) AS BIGINT)"
#: Groups of language and source up to which one row for each is broadcast; more of them are shuffled.
BROADCAST_GROUPS = 10_000
#: Ridge of each statistic, as standard deviations in transformed units:
#: log words, log mean word length, log share of symbols, log share of repeats.
RIDGE = (0.5, 0.08, 0.4, 0.8)
#: Squared distance above which a document is rejected; a chi-square of four
#: degrees of freedom exceeds it once in 100,000 rows.
CUTOFF = 28.5
STEPS = 4


def consistency(share: float = _SHARE) -> float:
    """Factor that makes the h-subset's covariance consistent at the normal
    law, for four dimensions: share / P(chi2_6 <= chi2_4 quantile of share)."""
    low, high = 0.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < share else (low, mid)
    return share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in some ``width``-word window found twice or more.

    Windows compare by 64-bit hashes of their words' 64-bit hashes. They are
    sorted only where some hash repeats, so the cost is n log n at most.
    """

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        spans = lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return _let(_let(order, twins), lambda p: F.aggregate(spans(p), F.lit(0), lambda a, x: a + x))

    window = lambda s, i: F.xxhash64(*(F.get(s, i + k) for k in range(width)))
    hashes = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - width), lambda i: window(s, i))
    some = lambda s: _let(hashes(s), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), some))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long) and ``base_failed`` to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: F.translate(text, chars, "")
    blanks = " \t\n\x0b\f\r"
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, blanks, "") != "")
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    out = docs.withColumn("_counts", counts).withColumns(
        {
            "n_words": F.col("_counts.n"),
            "word_chars": F.length(without(blanks)).cast("long"),
            "n_symbols": (F.length(text) - F.length(without("#*$%&|<>"))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("_counts.r"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.drop("_counts").withColumn("base_failed", failed)


# The estimate as SQL text that Spark and DuckDB read alike; {x} names a relation.

_VECTOR = f"""
SELECT coalesce(lang, '') AS gl, coalesce(source, '') AS gs,
       CAST(round({_SCALE} * ln(CAST(n_words AS DOUBLE))) AS BIGINT) AS t1,
       CAST(round({_SCALE} * ln((word_chars + 100) / CAST(n_words + 20 AS DOUBLE))) AS BIGINT) AS t2,
       CAST(round({_SCALE} * ln(1 + 100 * n_symbols / CAST(word_chars + 100 AS DOUBLE))) AS BIGINT) AS t3,
       CAST(round({_SCALE} * ln(1 + 100 * (n_repeat_words + n_dup_lines) / CAST(n_words + 20 AS DOUBLE))) AS BIGINT) AS t4,
       count(*) AS w
FROM {{counts}} WHERE NOT base_failed
GROUP BY 1, 2, 3, 4, 5, 6"""

_MOMENT_LIST = ", ".join(
    ["CAST(sum(v.w) AS DOUBLE) AS n"]
    + [f"CAST(sum(v.w * v.t{i}) AS DOUBLE) AS s{i}" for i in range(1, _P + 1)]
    + [f"CAST(sum(v.w * v.t{i} * v.t{j}) AS DOUBLE) AS s{i}{j}" for i in range(1, _P + 1) for j in range(1, i + 1)]
)


def _number(x: float) -> str:
    """A literal that both engines read as the same double."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _shape(factor: float) -> str:
    """Location and Cholesky factor of the ridged covariance from moments."""
    cov = {(i, j): f"({_number(factor)} * (s{i}{j} - s{i} * s{j} / n) / n" + (f" + {_number((RIDGE[i - 1] * _SCALE) ** 2)}" if i == j else "") + ")" for i in range(1, _P + 1) for j in range(1, i + 1)}
    inner = "SELECT gl, gs, start, " + ", ".join(f"s{i} / n AS m{i}" for i in range(1, _P + 1)) + ", " + ", ".join(f"{cov[i, j]} AS c{i}{j}" for i, j in cov) + " FROM {moments}"
    for j in range(1, _P + 1):
        used = lambda a: "".join(f" - l{a}{k} * l{j}{k}" for k in range(1, j))
        inner = f"SELECT *, sqrt(c{j}{j}{used(j)}) AS l{j}{j} FROM ({inner}) AS a{j}"
        if j < _P:
            inner = "SELECT *, " + ", ".join(f"(c{i}{j}{used(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, _P + 1)) + f" FROM ({inner}) AS b{j}"
    names = [f"m{i}" for i in range(1, _P + 1)] + [f"l{i}{j}" for i, j in cov]
    return f"SELECT gl, gs, start, {', '.join(names)}, {' * '.join(f'l{i}{i}' for i in range(1, _P + 1))} AS det FROM ({inner}) AS z"


_DISTANCE = """
SELECT {hint} v.gl, v.gs, e.start, v.t1, v.t2, v.t3, v.t4, v.w, e.det,
       {d2} AS d2
FROM {vectors} AS v JOIN {estimates} AS e ON v.gl = e.gl AND v.gs = e.gs"""


def _d2() -> str:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[str] = []
    for i in range(1, _P + 1):
        y.append(f"((v.t{i} - e.m{i})" + "".join(f" - e.l{i}{k + 1} * {y[k]}" for k in range(i - 1)) + f") / e.l{i}{i}")
        y[-1] = f"({y[-1]})"
    return " + ".join(f"{a} * {a}" for a in y)


_ALL = "SELECT v.gl, v.gs, 0 AS start, {moments} FROM {vectors} AS v GROUP BY v.gl, v.gs"

_MEDIANS = """
WITH cells AS (SELECT gl, gs, d, t, sum(w) AS c FROM (
  SELECT gl, gs, 1 AS d, t1 AS t, w FROM {vectors} UNION ALL SELECT gl, gs, 2, t2, w FROM {vectors}
  UNION ALL SELECT gl, gs, 3, t3, w FROM {vectors} UNION ALL SELECT gl, gs, 4, t4, w FROM {vectors}) AS u GROUP BY gl, gs, d, t),
upto AS (SELECT gl, gs, d, t, sum(c) OVER (PARTITION BY gl, gs, d ORDER BY t) AS below, sum(c) OVER (PARTITION BY gl, gs, d) AS n FROM cells)
SELECT gl, gs, 1 AS start,
       {medians}, {spread}, CAST(1 AS DOUBLE) AS det
FROM upto WHERE 2 * below >= n GROUP BY gl, gs"""

_SUBSET = """
WITH cells AS (SELECT gl, gs, start, {own} AS b, sum(w) AS c FROM {distances} GROUP BY 1, 2, 3, 4),
upto AS (SELECT gl, gs, start, b, sum(c) OVER (PARTITION BY gl, gs, start ORDER BY b) AS below, sum(c) OVER (PARTITION BY gl, gs, start) AS n FROM cells),
cuts AS (SELECT gl, gs, start, min(b) AS cut FROM upto WHERE below >= {share} * n GROUP BY gl, gs, start)
SELECT {hint} v.gl, v.gs, v.start, {moments}
FROM {distances} AS v JOIN cuts AS k ON v.gl = k.gl AND v.gs = k.gs AND v.start = k.start
WHERE {theirs} <= k.cut GROUP BY v.gl, v.gs, v.start"""

_WINNER = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY gl, gs ORDER BY det, start) AS place FROM {estimates})
SELECT * FROM r WHERE place = 1"""


def statements(broadcast: bool = False) -> list[tuple[str, str]]:
    """(name, SQL) of the whole estimate, in order; each reads earlier names.
    ``counts`` must be there; ``winner`` has each group's estimate. ``broadcast`` hints
    (a comment to other engines) that the rows of groups are few."""
    hint = lambda name: f"/*+ BROADCAST({name}) */" if broadcast else ""
    cells = {"own": _CELL.format(d2="d2"), "theirs": _CELL.format(d2="v.d2")}
    spread = ", ".join(f"{_number(4 * RIDGE[i - 1] * _SCALE if i == j else 0.0)} AS l{i}{j}" for i in range(1, _P + 1) for j in range(1, i + 1))
    medians = ", ".join(f"CAST(min(CASE WHEN d = {i} THEN t END) AS DOUBLE) AS m{i}" for i in range(1, _P + 1))
    out = [
        ("vectors", _VECTOR.format(counts="counts")),
        ("moments0", _ALL.format(moments=_MOMENT_LIST, vectors="vectors")),
        ("estimates0", _shape(1.0).format(moments="moments0") + " UNION ALL SELECT * FROM (" + _MEDIANS.format(vectors="vectors", medians=medians, spread=spread) + ") AS med"),
    ]
    for k in range(1, STEPS + 1):
        out += [
            (f"distances{k}", _DISTANCE.format(hint=hint("e"), vectors="vectors", estimates=f"estimates{k - 1}", d2=_d2())),
            (f"moments{k}", _SUBSET.format(hint=hint("k"), distances=f"distances{k}", share=_SHARE, moments=_MOMENT_LIST, **cells)),
            (f"estimates{k}", _shape(consistency()).format(moments=f"moments{k}")),
        ]
    return [*out, ("winner", _WINNER.format(estimates=f"estimates{STEPS}"))]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Base counts, ``distance2`` and ``kept`` of every document.

    Returns ``doc_id``, the five counts, ``base_failed``, ``kept`` and
    ``distance2`` (squared Mahalanobis distance, null if ``base_failed``).
    Null texts count as empty and so fail; a null language or source counts as
    the empty one; repeated rows weigh in the estimates as often as they occur
    and get equal verdicts; an empty table gives no row. No other column is
    read, whatever its name. The counts are written once to the shared folder,
    since the estimate reads them several times.
    """
    spark = docs.sparkSession
    cols = {"doc_id": docs[id_col], "text": docs[text_col], "lang": docs[lang_col], "source": docs[source_col]}
    rows = base_counts(docs.select(*(c.alias(n) for n, c in cols.items()))).drop("text")
    counts = materialise(rows, "counts")
    held = {"counts": counts}
    groups = counts.select("lang", "source").distinct().limit(BROADCAST_GROUPS + 1).count()
    few = groups <= BROADCAST_GROUPS
    for name, sql in statements(few):
        # what several later steps read, or what would nest, is written out
        df = spark.sql(re.sub(r"\b(FROM|JOIN) (counts|vectors|winner|(?:moments|estimates|distances)\d)\b", r"\1 {\2}", sql), **_used(sql, held))
        held[name] = materialise(df, name) if name.startswith(("vectors", "distances", "estimates")) else df
    discard(*(held[n] for n in held if n.startswith("distances")), *(held[n] for n in held if n.startswith("estimates") and n != f"estimates{STEPS}"))
    scored = spark.sql(f"SELECT {'/*+ BROADCAST(e) */' if few else ''} v.gl, v.gs, v.t1, v.t2, v.t3, v.t4, " + _d2() + " AS distance2 FROM {vectors} AS v JOIN {winner} AS e ON v.gl = e.gl AND v.gs = e.gs", vectors=held["vectors"], winner=held["winner"])
    return attach(counts, scored, cutoff)


def _used(sql: str, held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    names = {m[1] for m in re.finditer(r"\b(?:FROM|JOIN) (counts|vectors|winner|(?:moments|estimates|distances)\d)\b", sql)}
    return {n: held[n] for n in names}


def attach(counts: DataFrame, scored: DataFrame, cutoff: float) -> DataFrame:
    """Verdicts: each document's counts joined with its vector's distance."""
    keyed = counts.sparkSession.sql(_VECTOR.split("count(*)")[0].strip().rstrip(",").replace("SELECT ", "SELECT *, ", 1) + " FROM {counts}", counts=counts.where("NOT base_failed"))
    near = keyed.join(scored, ["gl", "gs", "t1", "t2", "t3", "t4"])
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = near.select(*columns, (F.col("distance2") <= cutoff).alias("kept"), "distance2")
    failed = counts.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"))
    return passed.unionByName(failed)


#: The base counts in DuckDB's SQL, for the oracle.
_COUNTS_SQL = """
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
             list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w) AS u),
twin AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twin WHERE c > 1) AS u GROUP BY doc_id),
counts0 AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
counts AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts0)"""


def oracle_sql(cutoff: float = CUTOFF) -> str:
    """The whole operator over ``documents`` in DuckDB's SQL."""
    steps = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in statements())
    keys = _VECTOR.split("count(*)")[0].strip().rstrip(",").removeprefix("SELECT ")
    return f"""WITH {_COUNTS_SQL.strip()},
{steps},
keyed AS (SELECT doc_id, {keys} FROM counts WHERE NOT base_failed),
scored AS (SELECT v.gl, v.gs, v.t1, v.t2, v.t3, v.t4, {_d2()} AS distance2 FROM vectors AS v JOIN winner AS e ON v.gl = e.gl AND v.gs = e.gs),
verdict AS (SELECT doc_id, distance2 FROM keyed JOIN scored USING (gl, gs, t1, t2, t3, t4))
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(distance2 <= {_number(cutoff)}, false) AS kept
FROM counts AS c LEFT JOIN verdict AS x ON c.doc_id = x.doc_id"""
