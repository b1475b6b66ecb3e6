"""Registered queries over the driver tables, each paired (where SQL can
express it) with an independent DuckDB oracle.

Every query reads whole tables from ``sf_dir`` (or DataFrames Spark derives
from them); floats are rounded to 6 places on both sides.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import representation as rep
from ..operators import stats
from ..operators import untested
from ..sources import fixtures as fx
from ..sources.readers import table
from ..spec import DatasetSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


# -- shared oracle fragments --------------------------------------------------

ORDERS_SEGMENT_SQL = """
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderpriority,
         c.c_mktsegment, c.c_nationkey, CAST(o.o_orderstatus = 'F' AS INTEGER) AS is_filled
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

DOC_LABELS_SQL = """
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         l.quality AS y_true, 1 - l.toxic AS y_pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

DOC_LEFT_LABELS_SQL = """
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def chi2_oracle(pairs_sql: str) -> str:
    """Textbook chi-square: all cells of the marginal grid (zeros included),
    Yates when dof = 1.  ``pairs_sql`` yields (column, a, b) without NULLs."""
    return f"""
WITH p AS ({pairs_sql}),
cnt AS (SELECT "column", a, b, COUNT(*) AS n FROM p GROUP BY ALL),
r AS (SELECT "column", a, SUM(n) AS rt FROM cnt GROUP BY ALL),
c AS (SELECT "column", b, SUM(n) AS ct FROM cnt GROUP BY ALL),
tot AS (SELECT "column", SUM(n) AS nn FROM cnt GROUP BY ALL),
dims AS (SELECT t."column", t.nn,
           (SELECT COUNT(*) FROM r WHERE r."column" = t."column") AS nr,
           (SELECT COUNT(*) FROM c WHERE c."column" = t."column") AS nc
         FROM tot t),
grid AS (SELECT r."column", r.a, c.b, r.rt, c.ct FROM r JOIN c ON r."column" = c."column"),
cells AS (SELECT g."column", COALESCE(cnt.n, 0) AS o, g.rt * g.ct / d.nn AS e,
                 (d.nr - 1) * (d.nc - 1) AS dof
          FROM grid g JOIN dims d ON g."column" = d."column"
          LEFT JOIN cnt ON cnt."column" = g."column" AND cnt.a = g.a AND cnt.b = g.b)
SELECT "column",
       ROUND(CASE WHEN MAX(dof) = 0 THEN 0.0
                  WHEN MAX(dof) = 1 THEN SUM(POWER(ABS(o - e) - LEAST(0.5, ABS(o - e)), 2) / e)
                  ELSE SUM(POWER(o - e, 2) / e) END, 6) AS chi2,
       CAST(MAX(dof) AS BIGINT) AS dof
FROM cells GROUP BY "column"
"""


# -- A3 / A4: representation and outcome rates (minimum slice) ---------------

@register("representation_segments", f"""
WITH j AS ({ORDERS_SEGMENT_SQL}),
l AS (SELECT 'c_mktsegment' AS "column", CAST(c_mktsegment AS VARCHAR) AS v, is_filled FROM j
      UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), is_filled FROM j),
g AS (SELECT "column", v, COUNT(*) AS cnt, AVG(CAST(is_filled AS DOUBLE)) AS rate
      FROM l WHERE v IS NOT NULL GROUP BY ALL)
SELECT "column", v AS "group", cnt AS "count",
       ROUND(cnt / SUM(cnt) OVER (PARTITION BY "column"), 6) AS share,
       ROUND(rate, 6) AS outcome_rate,
       CASE WHEN cnt / SUM(cnt) OVER (PARTITION BY "column") < 0.05
            THEN printf('%s is under-represented (%.1f%%)', v,
                        100.0 * cnt / SUM(cnt) OVER (PARTITION BY "column")) END AS warning
FROM g
""")
def q_representation_segments(spark, sf_dir):
    df = fx.orders_by_segment(spark, sf_dir)
    out = rep.representation(df, ["c_mktsegment", "o_orderpriority"], "is_filled")
    return out.select("column", "group", "count", r6("share").alias("share"),
                      r6("outcome_rate").alias("outcome_rate"), "warning")


@register("outcome_rate_by_segment", f"""
WITH j AS ({ORDERS_SEGMENT_SQL})
SELECT 'c_mktsegment' AS "column", c_mktsegment AS "group",
       ROUND(AVG(CAST(is_filled AS DOUBLE)), 6) AS outcome_rate
FROM j WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
""")
def q_outcome_rate_by_segment(spark, sf_dir):
    df = fx.orders_by_segment(spark, sf_dir)
    out = rep.outcome_rate_by_group(df, "is_filled", ["c_mktsegment"])
    return out.select("column", "group", r6("outcome_rate").alias("outcome_rate"))


# -- T1 / T5 / T2: chi-square family ------------------------------------------

@register("chi2_documents_labels", chi2_oracle("""
  SELECT 'lang' AS "column", CAST(d.lang AS VARCHAR) AS a, CAST(l.toxic AS VARCHAR) AS b
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 'quality', CAST(l.quality AS VARCHAR), CAST(l.toxic AS VARCHAR)
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 'source', CAST(d.source AS VARCHAR), CAST(l.toxic AS VARCHAR)
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""))
def q_chi2_documents_labels(spark, sf_dir):
    df = fx.labelled_documents(spark, sf_dir)
    counts = stats.pair_counts(df, [("lang", "lang", "toxic"),
                                    ("quality", "quality", "toxic"),
                                    ("source", "source", "toxic")])
    return stats.chi2_tests(counts).select("column", r6("chi2").alias("chi2"), "dof")


@register("chi2_segment_status", chi2_oracle(f"""
  SELECT 'c_mktsegment' AS "column", CAST(c_mktsegment AS VARCHAR) AS a,
         CAST(o_orderstatus AS VARCHAR) AS b FROM ({ORDERS_SEGMENT_SQL})
  UNION ALL
  SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), CAST(o_orderstatus AS VARCHAR)
  FROM ({ORDERS_SEGMENT_SQL})
"""))
def q_chi2_segment_status(spark, sf_dir):
    df = fx.orders_by_segment(spark, sf_dir)
    counts = stats.pair_counts(df, [("c_mktsegment", "c_mktsegment", "o_orderstatus"),
                                    ("o_orderpriority", "o_orderpriority", "o_orderstatus")])
    return stats.chi2_tests(counts).select("column", r6("chi2").alias("chi2"), "dof")


# -- P1-P6, A1, A2, A5, A7, A8, F9, A9: profile ---------------------------------

from ..functions.text import NUMERIC_TEXT_PATTERN  # noqa: E402
from ..operators import fairness as fair  # noqa: E402
from ..operators import pii  # noqa: E402
from ..operators import profile as prof  # noqa: E402

DUCK_TYPES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(data_type) END"""


@register("overview_lineitem", f"""
SELECT column_name AS "column", CAST(ordinal_position - 1 AS INTEGER) AS position,
       {DUCK_TYPES} AS data_type,
       (SELECT COUNT(*) FROM lineitem) AS n_rows, 11 AS n_columns
FROM information_schema.columns WHERE table_name = 'lineitem'
""")
def q_overview_lineitem(spark, sf_dir):
    return prof.overview(table(spark, sf_dir, "lineitem"))


def _union_sql(cols, template):
    return "\n  UNION ALL ".join(template.format(c=c) for c in cols)


DOC_LABEL_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@register("missing_by_column_doc_labels", f"""
WITH j AS ({DOC_LEFT_LABELS_SQL}),
m AS ({_union_sql(DOC_LABEL_COLS, "SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, COUNT(*) AS n FROM j")})
SELECT "column", missing_count,
       round_even(CAST(missing_count AS DOUBLE) / n * 100.0 * 100.0, 0) / 100.0 AS missing_percent
FROM m WHERE missing_count > 0
""")
def q_missing_by_column_doc_labels(spark, sf_dir):
    return prof.missing_by_column(fx.documents_with_labels(spark, sf_dir))


@register("missing_total_doc_labels", f"""
WITH j AS ({DOC_LEFT_LABELS_SQL})
SELECT COUNT(*) AS n_rows, COUNT(*) * 6 AS n_cells,
       {" + ".join(f"(COUNT(*) - COUNT({c}))" for c in DOC_LABEL_COLS)} AS n_missing,
       ROUND(100.0 * ({" + ".join(f"(COUNT(*) - COUNT({c}))" for c in DOC_LABEL_COLS)}) / (COUNT(*) * 6), 6) AS missing_pct
FROM j
""")
def q_missing_total_doc_labels(spark, sf_dir):
    out = prof.missing_total(fx.documents_with_labels(spark, sf_dir))
    return out.select("n_rows", "n_cells", "n_missing", r6("missing_pct").alias("missing_pct"))


DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@register("distinct_counts_documents", f"""
{_union_sql(DOC_COLS, "SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM documents")}
""")
def q_distinct_counts_documents(spark, sf_dir):
    return prof.distinct_counts(table(spark, sf_dir, "documents"))


@register("value_counts_part", """
SELECT 'p_brand' AS "column", p_brand AS value, COUNT(*) AS "count" FROM part GROUP BY p_brand
UNION ALL
SELECT 'p_type', p_type, COUNT(*) FROM part GROUP BY p_type
""")
def q_value_counts_part(spark, sf_dir):
    return rep.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


def _underrep_sql(tbl, cols):
    return f"""
WITH l AS ({_union_sql(cols, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM " + tbl)}),
c AS (SELECT "column", v, COUNT(*) AS cnt FROM l GROUP BY ALL),
t AS (SELECT "column", SUM(cnt) AS total FROM c GROUP BY ALL),
p AS (SELECT c."column", v, cnt, round_even(CAST(cnt AS DOUBLE) / total * 100.0 * 100.0, 0) / 100.0 AS pct
      FROM c JOIN t ON c."column" = t."column" WHERE v IS NOT NULL)
SELECT "column", v AS "group", cnt AS "count", pct AS percentage FROM p WHERE pct < 5.0
"""


@register("underrepresented_part", _underrep_sql("part", ["p_name", "p_brand", "p_type"]))
def q_underrepresented_part(spark, sf_dir):
    return rep.underrepresented_groups(table(spark, sf_dir, "part"))


@register("underrepresented_documents",
          _underrep_sql("documents", ["text", "lang", "source"]))
def q_underrepresented_documents(spark, sf_dir):
    return rep.underrepresented_groups(table(spark, sf_dir, "documents"))


LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("quartiles_lineitem", _union_sql(LINE_NUM, """
SELECT '{c}' AS "column", ROUND(quantile_cont({c}, 0.25), 6) AS q1,
       ROUND(quantile_cont({c}, 0.75), 6) AS q3,
       ROUND(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM lineitem"""))
def q_quartiles_lineitem(spark, sf_dir):
    out = prof.quartiles(table(spark, sf_dir, "lineitem"), LINE_NUM)
    return out.select("column", r6("q1").alias("q1"), r6("q3").alias("q3"), r6("iqr").alias("iqr"))


EVENT_NUM = ["event_id", "user_id", "value"]


@register("outliers_events", f"""
WITH f AS ({_union_sql(EVENT_NUM, "SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events")}),
l AS ({_union_sql(EVENT_NUM, "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM events")})
SELECT f."column", ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3,
       ROUND(q1 - 3 * (q3 - q1), 6) AS lower, ROUND(q3 + 3 * (q3 - q1), 6) AS upper,
       COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS n_outliers,
       COUNT(*) AS n_rows,
       ROUND(100.0 * COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) / COUNT(*), 6) AS outlier_pct,
       CASE WHEN COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) > 0.05 * COUNT(*)
            THEN printf('%s: %.1f%% outliers', f."column",
                 100.0 * COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) / COUNT(*)) END AS warning
FROM l JOIN f ON l."column" = f."column" GROUP BY f."column", q1, q3
""")
def q_outliers_events(spark, sf_dir):
    out = prof.outliers(table(spark, sf_dir, "events"), EVENT_NUM)
    return out.select("column", *[r6(c).alias(c) for c in ["q1", "q3", "lower", "upper"]],
                      "n_outliers", "n_rows", r6("outlier_pct").alias("outlier_pct"), "warning")


@register("duplicates_documents_text", """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT text) AS n_distinct,
       COUNT(*) - COUNT(DISTINCT text) AS n_duplicates FROM documents
""")
def q_duplicates_documents_text(spark, sf_dir):
    return prof.duplicate_rows(table(spark, sf_dir, "documents").select("text"))


@register("duplicates_part_type_size", """
SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_distinct,
       CAST(SUM(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT p_type, p_size, COUNT(*) AS n FROM part GROUP BY ALL)
""")
def q_duplicates_part_type_size(spark, sf_dir):
    return prof.duplicate_rows(table(spark, sf_dir, "part"), ["p_type", "p_size"])


def events_with_k(spark, sf_dir):
    """events plus the JSON field ``k`` kept as text (numeric-as-text case)."""
    ev = table(spark, sf_dir, "events")
    return ev.withColumn("k_text", F.get_json_object("props", "$.k"))


EVENTS_K_SQL = "SELECT *, json_extract_string(props, '$.k') AS k_text FROM events"
NUMERIC_TEXT_SQL = NUMERIC_TEXT_PATTERN.replace("'", "''")


@register("numeric_as_text_events", f"""
WITH e AS ({EVENTS_K_SQL}),
l AS ({_union_sql(["event_type", "props", "k_text"], "SELECT '{c}' AS \"column\", {c} AS v FROM e")})
SELECT "column", COUNT(v) AS n_values,
       COUNT(*) FILTER (WHERE v IS NOT NULL AND regexp_matches(v, '{NUMERIC_TEXT_SQL}')) AS n_numeric,
       ROUND(COUNT(*) FILTER (WHERE v IS NOT NULL AND regexp_matches(v, '{NUMERIC_TEXT_SQL}')) / COUNT(v), 6) AS numeric_share,
       COUNT(v) > 0 AND COUNT(*) FILTER (WHERE v IS NOT NULL AND regexp_matches(v, '{NUMERIC_TEXT_SQL}')) = COUNT(v) AS numeric_as_text
FROM l GROUP BY "column"
""")
def q_numeric_as_text_events(spark, sf_dir):
    out = prof.numeric_as_text(events_with_k(spark, sf_dir))
    return out.select("column", "n_values", "n_numeric",
                      r6("numeric_share").alias("numeric_share"), "numeric_as_text")


QUALITY_EVENTS_SQL = f"""
WITH e AS ({EVENTS_K_SQL}),
d AS (SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM e)) AS dups FROM e),
m AS (SELECT 100.0 * ({" + ".join(f"(COUNT(*) - COUNT({c}))" for c in ["event_id", "ts", "user_id", "event_type", "value", "props", "k_text"])}) / (COUNT(*) * 7) AS pct FROM e),
l AS ({_union_sql(["event_type", "props", "k_text"], "SELECT '{c}' AS \"column\", {c} AS v FROM e")}),
t AS (SELECT "column", COUNT(v) AS nv,
             COUNT(*) FILTER (WHERE v IS NOT NULL AND regexp_matches(v, '{NUMERIC_TEXT_SQL}')) AS nn
      FROM l GROUP BY "column"),
bad AS (SELECT "column", CAST(nn AS DOUBLE) / nv AS share FROM t WHERE nv > 0 AND nn = nv)
SELECT 'duplicates' AS "check", dups = 0 AS passed, CAST(dups AS DOUBLE) AS value,
       CASE WHEN dups > 0 THEN printf('Duplicate rows: %d', dups) END AS warning FROM d
UNION ALL
SELECT 'missing', CASE WHEN pct < 30 THEN TRUE END, ROUND(pct, 6),
       CASE WHEN pct >= 30 THEN printf('High missing data: %.2f%%', pct) END FROM m
UNION ALL
SELECT 'types', (SELECT COUNT(*) FROM bad) = 0, CAST((SELECT COUNT(*) FROM bad) AS DOUBLE), NULL
UNION ALL
SELECT 'types_column', NULL, ROUND(share, 6), "column" || ': numeric as string' FROM bad
"""


@register("quality_checks_events", QUALITY_EVENTS_SQL)
def q_quality_checks_events(spark, sf_dir):
    out = prof.quality_checks(events_with_k(spark, sf_dir))
    return out.select("check", "passed", r6("value").alias("value"), "warning")


@register("quality_rollup_events", f"""
WITH q AS ({QUALITY_EVENTS_SQL})
SELECT COUNT(*) FILTER (WHERE "check" IN ('duplicates', 'missing', 'types')) AS total_checks,
       COUNT(*) FILTER (WHERE "check" IN ('duplicates', 'missing', 'types') AND passed) AS passed,
       COUNT(*) FILTER (WHERE "check" IN ('duplicates', 'missing', 'types') AND NOT passed) AS failed,
       COUNT(warning) AS n_warnings
FROM q
""")
def q_quality_rollup_events(spark, sf_dir):
    return prof.quality_rollup(prof.quality_checks(events_with_k(spark, sf_dir)))


# -- X2-X4: PII -----------------------------------------------------------------

def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_luhn(x: str) -> str:
    d = f"CAST(substr(reverse({x}), i + 1, 1) AS INTEGER)"
    return (f"(length({x}) > 0 AND list_sum(list_transform(range(length({x})), lambda i: "
            f"CASE WHEN i % 2 = 1 THEN ({d} * 2) % 10 + ({d} * 2) // 10 ELSE {d} END)) % 10 = 0)")


# What the oracle expects, as rules over rows: every run of a type's symbols,
# what makes a run valid, the windows between blanks that make a card, and the
# surer of two overlapping spans.
_BYTE = "(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CALL = r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
#: type: (run, valid run, rank among overlapping spans)
EXPECTED_PII = {
    "IBAN_CODE": (r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[0-9A-Za-z]+", "[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,38}", 1),
    "CREDIT_CARD": (r"[0-9](?:[ -]?[0-9])*", "[0-9](?:[ -]?[0-9]){12,18}", 2),
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", None, 3),
    "US_SSN": (r"[0-9]+(?:-[0-9]+)*", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 4),
    "URL": (r"https?://[^ \t\n\r<>\"']+", None, 5),
    "IP_ADDRESS": (r"[0-9]+(?:\.[0-9]+)*", rf"(?:{_BYTE}\.){{3}}{_BYTE}", 6),
    "PHONE_NUMBER": (rf"[0-9]*{_CALL}[0-9]*", _CALL, 7),
}


def _duck_mod97(x: str) -> str:
    s = f"replace({x}, ' ', '')"
    moved = f"(substr({s}, 5) || substr({s}, 1, 4))"
    codes = f"list_prepend(0, list_transform(range(length({moved})), lambda i: ascii(substr({moved}, i + 1, 1))))"
    return (f"(length({s}) BETWEEN 15 AND 34 AND list_reduce({codes}, lambda a, c: "
            f"CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1)")


def _duck_valid(x: str, pii_type: str) -> str:
    _, shape, _ = EXPECTED_PII[pii_type]
    ok = f"regexp_full_match({x}, {_sql_lit(shape)})" if shape else "TRUE"
    if pii_type == "CREDIT_CARD":
        digits = f"regexp_replace({x}, '[ -]', '', 'g')"
        return f"CASE WHEN {ok} THEN {_duck_luhn(digits)} ELSE FALSE END"
    return f"CASE WHEN {ok} THEN {_duck_mod97(x)} ELSE FALSE END" if pii_type == "IBAN_CODE" else ok


def pii_spans_sql(source: str) -> str:
    """CTEs over ``source`` (rid, v): kept (rid, type, a, b, x) are the spans
    [a, b) of v with their text x."""
    runs = "\nUNION ALL ".join(
        f"SELECT rid, '{t}' AS type, {rank} AS rank, unnest(regexp_extract_all(v, {_sql_lit(run)})) AS x, "
        f"unnest(string_split_regex(v, {_sql_lit(run)})[:-2]) AS piece, unnest(range(len(regexp_extract_all(v, {_sql_lit(run)})))) AS k FROM src"
        for t, (run, _, rank) in EXPECTED_PII.items())
    valid = " ".join(f"WHEN '{t}' THEN {_duck_valid('x', t)}" for t in EXPECTED_PII)
    card = "[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}"
    chain, kept = "", []
    for t, (_, _, rank) in sorted(EXPECTED_PII.items(), key=lambda e: e[1][2]):
        surer = "\nUNION ALL ".join(f"SELECT * FROM kept{r}" for r in kept)
        free = f"WHERE NOT EXISTS (SELECT 1 FROM ({surer}) o WHERE o.rid = s.rid AND o.a < s.b AND s.a < o.b)" if kept else ""
        chain += f",\nkept{rank} AS MATERIALIZED (SELECT * FROM (SELECT rid, type, a, b, x FROM span WHERE rank = {rank}) s {free})"
        kept.append(rank)
    return f"""
src AS MATERIALIZED ({source}),
run AS (
  SELECT rid, type, rank, x, sum(length(piece) + length(x)) OVER (PARTITION BY rid, type ORDER BY k) - length(x) AS a
  FROM ({runs})),
judged AS MATERIALIZED (
  SELECT *, CASE type {valid} END AS ok FROM run WHERE type <> 'CREDIT_CARD' OR length(x) >= 13),
-- a run of several numbers: every window of one to four pieces between blanks that is a card by itself
piece AS (
  SELECT rid, a, x, string_split(x, ' ') AS p, unnest(range(len(string_split(x, ' ')))) AS k
  FROM judged WHERE type = 'CREDIT_CARD' AND NOT ok AND contains(x, ' ')),
window_ AS (
  SELECT rid, a, x, k, array_to_string(p[k + 1 : k + 1 + j], ' ') AS w,
         coalesce(length(array_to_string(p[: k], ' ')) + CASE WHEN k > 0 THEN 1 ELSE 0 END, 0) AS o
  FROM piece CROSS JOIN range(4) t(j) WHERE k + j < len(p)),
card AS (
  SELECT rid, a, list({{'s': a + o, 'e': a + o + length(w), 'w': w, 't': []::STRUCT(s HUGEINT, e HUGEINT, w VARCHAR)[]}} ORDER BY o) AS l
  FROM (SELECT * FROM window_ WHERE regexp_full_match(w, '{card}'))
  WHERE {_duck_luhn("regexp_replace(w, '[ -]', '', 'g')")} GROUP BY rid, a),
inner_ AS (
  SELECT rid, unnest(list_reduce(list_prepend({{'s': (-1)::HUGEINT, 'e': 0::HUGEINT, 'w': '', 't': []::STRUCT(s HUGEINT, e HUGEINT, w VARCHAR)[]}}, l),
    lambda c, n: CASE WHEN n.s >= c.e THEN {{'s': n.s, 'e': n.e, 'w': n.w, 't': list_append(c.t, {{'s': n.s, 'e': n.e, 'w': n.w}})}} ELSE c END).t) AS c
  FROM card),
span AS MATERIALIZED (
  SELECT rid, type, rank, a, a + length(x) AS b, x FROM judged WHERE ok
  UNION ALL SELECT rid, 'CREDIT_CARD', 2, c.s, c.e, c.w FROM inner_){chain},
kept AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM kept{r}" for r in kept)})"""


def pii_findings_sql(tbl: str, cols) -> str:
    rows = _union_sql(cols, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM " + tbl)
    return f"""
WITH l AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM ({rows}) WHERE v IS NOT NULL),
{pii_spans_sql("SELECT rid, v FROM l")}
SELECT "column", type AS pii_type, count(*) AS n_detections, count(DISTINCT rid) AS n_rows,
       lpad(lower(hex(min(('0x' || substr(md5(x), 1, 15))::BIGINT))), 15, '0') AS example_hash
FROM kept JOIN l USING (rid) GROUP BY ALL
"""


def redact_sql(source: str, keep: str) -> str:
    """``source`` (a table with a text column), redacted; ``keep``: the other columns."""
    return f"""(
WITH l AS MATERIALIZED (SELECT row_number() OVER () AS rid, text AS v, {keep} FROM {source}),
{pii_spans_sql("SELECT rid, v FROM l WHERE v IS NOT NULL")},
told AS (
  SELECT rid, string_agg(substr(v, before + 1, a - before) || '<' || type || '>', '' ORDER BY a) AS head, max(b) AS upto
  FROM (SELECT rid, v, type, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before
        FROM (SELECT rid, type, a::BIGINT AS a, b::BIGINT AS b FROM kept) JOIN src USING (rid)) GROUP BY rid)
SELECT coalesce(head || substr(v, upto + 1), v) AS text, {keep} FROM l LEFT JOIN told USING (rid))"""


@register("pii_findings_documents", pii_findings_sql("documents", ["text", "lang", "source"]))
def q_pii_findings_documents(spark, sf_dir):
    return pii.pii_findings(table(spark, sf_dir, "documents"))


@register("pii_findings_conversations", pii_findings_sql("conversations", ["role", "text"]))
def q_pii_findings_conversations(spark, sf_dir):
    return pii.pii_findings(table(spark, sf_dir, "conversations"))


@register("pii_columns_documents", f"""
WITH f AS ({pii_findings_sql("documents", ["text", "lang", "source"])})
SELECT "column", CAST(SUM(n_detections) AS BIGINT) AS n_detections,
       list_sort(list(DISTINCT pii_type)) AS pii_types
FROM f GROUP BY "column"
""")
def q_pii_columns_documents(spark, sf_dir):
    return pii.pii_columns(pii.pii_findings(table(spark, sf_dir, "documents")))


@register("redacted_documents", f"""
SELECT doc_id, text, lang, source FROM {redact_sql("documents", "doc_id, lang, source")}
""")
def q_redacted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return pii.anonymize(docs)


# -- A13-A20: fairness ------------------------------------------------------------

FAIR_ATTRS = ["lang", "source"]
FAIR_METRIC_SQL = {
    "accuracy": "correct / n",
    "precision": "COALESCE(tp / NULLIF(tp + fp, 0), 0.0)",
    "recall": "COALESCE(tp / NULLIF(tp + fn, 0), 0.0)",
    "f1_score": "COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0)",
    "selection_rate": "pred_pos / n",
}
FAIR_COUNTS_SQL = f"""
WITH j AS ({DOC_LABELS_SQL}),
l AS ({_union_sql(FAIR_ATTRS, "SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS grp, y_true AS t, y_pred AS p FROM j")})
SELECT attribute, grp, COUNT(*) AS n, COUNT(*) FILTER (WHERE t = p) AS correct,
       COUNT(*) FILTER (WHERE t = 1 AND p = 1) AS tp, COUNT(*) FILTER (WHERE t <> 1 AND p = 1) AS fp,
       COUNT(*) FILTER (WHERE t = 1 AND p <> 1) AS fn, COUNT(*) FILTER (WHERE p = 1) AS pred_pos
FROM l WHERE grp IS NOT NULL AND t IS NOT NULL AND p IS NOT NULL GROUP BY ALL
"""
_METRIC_COLS = ", ".join(f'{e} AS "{k}"' for k, e in FAIR_METRIC_SQL.items())
FAIR_SUMMARY_SQL = f"""
WITH c AS ({FAIR_COUNTS_SQL}),
g AS (SELECT attribute, grp, {_METRIC_COLS} FROM c),
o AS (SELECT attribute, {_METRIC_COLS} FROM
      (SELECT attribute, SUM(n) AS n, SUM(correct) AS correct, SUM(tp) AS tp, SUM(fp) AS fp,
              SUM(fn) AS fn, SUM(pred_pos) AS pred_pos FROM c GROUP BY attribute)),
gl AS (UNPIVOT g ON {", ".join(f'"{k}"' for k in FAIR_METRIC_SQL)} INTO NAME metric VALUE v),
ol AS (UNPIVOT o ON {", ".join(f'"{k}"' for k in FAIR_METRIC_SQL)} INTO NAME metric VALUE overall),
s AS (SELECT attribute, metric, MIN(v) AS group_min, MAX(v) AS group_max FROM gl GROUP BY ALL)
SELECT s.attribute, s.metric, ol.overall, s.group_min, s.group_max,
       s.group_max - s.group_min AS difference,
       CASE WHEN s.group_max = 0 THEN NULL ELSE s.group_min / s.group_max END AS ratio
FROM s JOIN ol ON s.attribute = ol.attribute AND s.metric = ol.metric
"""


def _fair_input(spark, sf_dir):
    return fx.labelled_documents(spark, sf_dir)


@register("fairness_by_group", f"""
WITH c AS ({FAIR_COUNTS_SQL})
SELECT attribute, grp AS "group", n,
       {", ".join(f'ROUND({e}, 6) AS "{k}"' for k, e in FAIR_METRIC_SQL.items())}
FROM c
""")
def q_fairness_by_group(spark, sf_dir):
    out = fair.group_metrics(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    return out.select("attribute", "group", "n", *[r6(k).alias(k) for k in fair.DEFAULT_METRICS])


SUMMARY_NUM = ["overall", "group_min", "group_max", "difference", "ratio"]


@register("fairness_metric_summary", f"""
SELECT attribute, metric, {", ".join(f"ROUND({c}, 6) AS {c}" for c in SUMMARY_NUM)}
FROM ({FAIR_SUMMARY_SQL})
""")
def q_fairness_metric_summary(spark, sf_dir):
    out = fair.metric_summary(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    return out.select("attribute", "metric", *[r6(c).alias(c) for c in SUMMARY_NUM])


@register("demographic_parity", f"""
SELECT attribute, ROUND(difference, 6) AS dp_difference, ROUND(ratio, 6) AS dp_ratio
FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
""")
def q_demographic_parity(spark, sf_dir):
    s = fair.metric_summary(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    return fair.demographic_parity(s).select(
        "attribute", r6("dp_difference").alias("dp_difference"), r6("dp_ratio").alias("dp_ratio"))


FAIR_VIOLATIONS_SQL = f"""
WITH s AS ({FAIR_SUMMARY_SQL})
SELECT attribute, 'demographic_parity' AS metric,
       printf('Demographic parity violation: ratio = %.3f (should be ≥ %s)', ratio, '0.8') AS violation
FROM s WHERE metric = 'selection_rate' AND ratio < 0.8
UNION ALL
SELECT attribute, metric,
       printf('%s disparity: %.3f difference between groups',
              CASE metric WHEN 'accuracy' THEN 'Accuracy' WHEN 'precision' THEN 'Precision'
                          WHEN 'recall' THEN 'Recall' ELSE 'F1_score' END, ABS(difference))
FROM s WHERE metric IN ('accuracy', 'precision', 'recall', 'f1_score') AND ABS(difference) > 0.1
"""


@register("fairness_violations", FAIR_VIOLATIONS_SQL)
def q_fairness_violations(spark, sf_dir):
    s = fair.metric_summary(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    return fair.violations(s)


@register("fairness_report", f"""
SELECT attribute AS protected_attribute, 'demographic_parity_difference' AS metric,
       ROUND(difference, 6) AS value FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
UNION ALL
SELECT attribute, 'demographic_parity_ratio', ROUND(ratio, 6)
FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
""")
def q_fairness_report(spark, sf_dir):
    s = fair.metric_summary(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    return fair.fairness_report(s).select("protected_attribute", "metric", r6("value").alias("value"))


@register("fairness_bundle", f"""
SELECT 'summary' AS part, attribute || ' ' || metric AS item, ROUND(difference, 6) AS value FROM ({FAIR_SUMMARY_SQL})
UNION ALL SELECT 'demographic_parity', attribute, ROUND(ratio, 6) FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
UNION ALL SELECT 'counts', attribute || ' ' || grp, n::DOUBLE FROM ({FAIR_COUNTS_SQL})
UNION ALL SELECT 'by_group', attribute || ' ' || grp, ROUND(correct / n, 6) FROM ({FAIR_COUNTS_SQL})
UNION ALL SELECT 'violations', attribute || ' ' || violation, NULL FROM ({FAIR_VIOLATIONS_SQL})
UNION ALL SELECT 'report', attribute || ' demographic_parity_difference', ROUND(difference, 6) FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
UNION ALL SELECT 'report', attribute || ' demographic_parity_ratio', ROUND(ratio, 6) FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
UNION ALL SELECT 'status', CASE WHEN COUNT(*) = 0 THEN 'FAIR' ELSE 'CONCERNS' END, COUNT(*)::DOUBLE FROM ({FAIR_VIOLATIONS_SQL})
""")
def q_fairness_bundle(spark, sf_dir):
    """Every table of the one-call bundle, stacked."""
    b = fair.quick_fairness_check(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    part = lambda name, item, value: b[name].select(F.lit(name).alias("part"), item.alias("item"), value.cast("double").alias("value"))
    pair = lambda x, y: F.concat_ws(" ", x, y)
    return reduce(DataFrame.unionByName, [
        part("summary", pair("attribute", "metric"), r6("difference")), part("demographic_parity", F.col("attribute"), r6("dp_ratio")),
        part("counts", pair("attribute", "group"), F.col("n")), part("by_group", pair("attribute", "group"), r6("accuracy")),
        part("violations", pair("attribute", "violation"), F.lit(None)), part("report", pair("protected_attribute", "metric"), r6("value")),
        part("status", F.col("status"), F.col("total_violations"))])


@register("fairness_status", f"""
SELECT COUNT(*) AS total_violations,
       CASE WHEN COUNT(*) = 0 THEN 'FAIR' ELSE 'CONCERNS' END AS status
FROM ({FAIR_VIOLATIONS_SQL})
""")
def q_fairness_status(spark, sf_dir):
    s = fair.metric_summary(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    return fair.fairness_summary(fair.violations(s))


# -- J4-J8: encoders ----------------------------------------------------------------

from ..operators import association as assoc  # noqa: E402
from ..operators import encode as enc  # noqa: E402

BRAND_CODES = {"Brand#11": 1, "Brand#12": 2, "Brand#13": 3}


@register("derived_columns_part", """
SELECT p_partkey,
       COALESCE(CAST(p_brand = 'Brand#13' AS INTEGER), 0) AS is_brand_13,
       CASE WHEN p_size IS NULL THEN NULL WHEN p_size < 30 THEN '<30'
            WHEN p_size <= 50 THEN '30-50' ELSE '>50' END AS size_group,
       CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#13' THEN 3 END AS brand_code
FROM part
""")
def q_derived_columns_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", enc.binarise("p_brand", "Brand#13").alias("is_brand_13"),
                    enc.bucket("p_size").alias("size_group"),
                    enc.map_values("p_brand", BRAND_CODES).alias("brand_code"))


@register("label_codes_orders", """
SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT 'o_orderpriority' AS "column", COALESCE(CAST(o_orderpriority AS VARCHAR), 'nan') AS value FROM orders
      UNION SELECT DISTINCT 'o_orderstatus', COALESCE(CAST(o_orderstatus AS VARCHAR), 'nan') FROM orders)
""")
def q_label_codes_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return enc.label_codes(o, ["o_orderpriority", "o_orderstatus"])


@register("label_encoded_customer", """
SELECT c_custkey,
       CAST(dense_rank() OVER (ORDER BY COALESCE(c_mktsegment, 'nan')) - 1 AS BIGINT) AS c_mktsegment,
       CAST(dense_rank() OVER (ORDER BY COALESCE(c_name, 'nan')) - 1 AS BIGINT) AS c_name
FROM customer
""")
def q_label_encoded_customer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return enc.label_encode(c, ["c_mktsegment", "c_name"])


@register("impute_mean_doc_labels", f"""
SELECT doc_id, ROUND(COALESCE(CAST(quality AS DOUBLE), AVG(quality) OVER ()), 6) AS quality,
       ROUND(COALESCE(CAST(toxic AS DOUBLE), AVG(toxic) OVER ()), 6) AS toxic
FROM ({DOC_LEFT_LABELS_SQL})
""")
def q_impute_mean_doc_labels(spark, sf_dir):
    df = fx.documents_with_labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    out = enc.impute_mean(df, ["quality", "toxic"])
    return out.select("doc_id", r6("quality").alias("quality"), r6("toxic").alias("toxic"))


# -- T4: proxies --------------------------------------------------------------------

def _duck_code(tbl_alias_col: str) -> str:
    return f"dense_rank() OVER (ORDER BY COALESCE(CAST({tbl_alias_col} AS VARCHAR), 'nan')) - 1"


ORDERS_ENC_SQL = f"""
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
       CAST({_duck_code('o_orderstatus')} AS DOUBLE) AS o_orderstatus,
       CAST(o_totalprice AS DOUBLE) AS o_totalprice,
       CAST(epoch_us(o_orderdate) AS DOUBLE) AS o_orderdate,
       CAST({_duck_code('o_orderpriority')} AS DOUBLE) AS o_orderpriority
FROM orders
"""
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]


def _corr_pairs_sql(src: str, protected, cols) -> str:
    parts = [f"SELECT '{p}' AS protected_attribute, '{o}' AS proxy_variable, "
             f"ROUND(corr({p}, {o}), 6) AS r FROM e"
             for p in protected for o in cols if o != p]
    return f"WITH e AS ({src})\n" + "\nUNION ALL ".join(parts)


@register("proxy_matrix_orders", _corr_pairs_sql(ORDERS_ENC_SQL, ["o_orderpriority", "o_orderstatus"],
                                                 ORDERS_COLS))
def q_proxy_matrix_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = assoc.correlation_pairs(o, ["o_orderpriority", "o_orderstatus"], ORDERS_COLS)
    return out.select("protected_attribute", "proxy_variable", r6("r").alias("r"))


DOCS_ENC_SQL = f"""
SELECT CAST(doc_id AS DOUBLE) AS doc_id, CAST({_duck_code('text')} AS DOUBLE) AS text,
       CAST({_duck_code('lang')} AS DOUBLE) AS lang, CAST({_duck_code('source')} AS DOUBLE) AS source,
       CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) AS DOUBLE) AS text_len
FROM documents
"""


@register("proxies_documents", f"""
SELECT protected_attribute, proxy_variable, ROUND(ABS(r), 6) AS correlation
FROM ({_corr_pairs_sql(DOCS_ENC_SQL, ["n_chars"], ["doc_id", "text", "lang", "source", "n_chars", "text_len"])})
WHERE ABS(r) > 0.7
""")
def q_proxies_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text_len", F.length("text"))
    spec = DatasetSpec(target=None, protected_attributes=("n_chars",))
    out = assoc.proxy_variables(d, spec)
    return out.select("protected_attribute", "proxy_variable",
                      r6("correlation").alias("correlation"))


# -- T3: drift -------------------------------------------------------------------------

#: probabilities of the lattice paths of m + n steps that never reach the gap d
KS_PATHS_SQL = """list_reduce(
  list_prepend({'s': 0::BIGINT, 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'b': [1.0::DOUBLE]},
    list_transform(range(1, m + n + 1), lambda s: {
      's': s, 'lo': greatest(0, s - n, CAST(floor((s * m - round(d * m * n)) / (m + n)) AS BIGINT) + 1),
      'hi': least(m, s, CAST(ceil((s * m + round(d * m * n)) / (m + n)) AS BIGINT) - 1), 'b': []::DOUBLE[]})),
  lambda a, x: {'s': x.s, 'lo': x.lo, 'hi': x.hi, 'b': list_transform(range(x.lo, x.hi + 1), lambda i: (
      coalesce(CASE WHEN i >= a.lo THEN a.b[i - a.lo + 1] END, 0.0) * (n - x.s + 1 + i)
      + coalesce(CASE WHEN i > a.lo THEN a.b[i - a.lo] END, 0.0) * (m - i + 1)) / (m + n - x.s + 1)::DOUBLE)}).b"""


def _ks_sql(cur_sql: str, ref_sql: str, cols) -> str:
    a = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v, 1 AS s FROM ({cur_sql}) WHERE {c} IS NOT NULL"
        f"\n  UNION ALL SELECT '{c}', CAST({c} AS DOUBLE), 2 FROM ({ref_sql}) WHERE {c} IS NOT NULL"
        for c in cols)
    lam = "((sqrt(en) + 0.12 + 0.11 / sqrt(en)) * d)"
    return f"""
WITH a AS ({a}),
c AS (SELECT "column", v, COUNT(*) FILTER (WHERE s = 1) AS n1, COUNT(*) FILTER (WHERE s = 2) AS n2
      FROM a GROUP BY ALL),
w AS (SELECT "column", SUM(n1) OVER (PARTITION BY "column" ORDER BY v) AS c1,
             SUM(n2) OVER (PARTITION BY "column" ORDER BY v) AS c2,
             SUM(n1) OVER (PARTITION BY "column") AS t1, SUM(n2) OVER (PARTITION BY "column") AS t2
      FROM c),
dd AS (SELECT "column", MAX(ABS(c1 / t1 - c2 / t2)) AS d, CAST(MAX(t1) AS BIGINT) AS n1,
              CAST(MAX(t2) AS BIGINT) AS n2, MAX(t1) * MAX(t2) / (MAX(t1) + MAX(t2)) AS en
       FROM w GROUP BY "column"),
pp AS (SELECT *, CASE WHEN {lam} < 0.2 THEN 1.0 ELSE LEAST(1.0, GREATEST(0.0,
         list_sum(list_transform(range(1, 101), lambda k: 2.0 * power(-1.0, k - 1) * exp(-2.0 * k * k * {lam} * {lam})))))
         END AS p_large, CAST(least(n1, n2) AS BIGINT) AS m, CAST(greatest(n1, n2) AS BIGINT) AS n FROM dd),
pe AS (SELECT *, CASE WHEN n > 10000 OR p_large < 1e-12 THEN p_large WHEN round(d * m * n) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum({KS_PATHS_SQL})) END AS p FROM pp)
SELECT "column", ROUND(d, 6) AS statistic, n1 AS n_current, n2 AS n_reference,
       ROUND(p, 6) AS p_value, p < 0.05 AS drift FROM pe
"""


def _drift_out(df):
    return df.select("column", r6("statistic").alias("statistic"), "n_current", "n_reference",
                     r6("p_value").alias("p_value"), "drift")


@register("drift_lineitem_returnflag", _ks_sql(
    "SELECT * FROM lineitem WHERE l_returnflag = 'A'", "SELECT * FROM lineitem WHERE l_returnflag = 'R'",
    LINE_NUM))
def q_drift_lineitem_returnflag(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cur = li.where(F.col("l_returnflag") == "A").select(*LINE_NUM)
    ref = li.where(F.col("l_returnflag") == "R").select(*LINE_NUM)
    return _drift_out(assoc.ks_drift(cur, ref))


@register("drift_events_halves", _ks_sql(
    "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'",
    "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16'", EVENT_NUM))
def q_drift_events_halves(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    cur = ev.where(F.col("ts") < cut).select(*EVENT_NUM)
    ref = ev.where(F.col("ts") >= cut).select(*EVENT_NUM)
    return _drift_out(assoc.ks_drift(cur, ref))


# small samples: the p-values are counted exactly
@register("drift_small_segments", _ks_sql(
    "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 8",
    "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey = 3", ["c_acctbal", "c_nationkey"]))
def q_drift_small_segments(spark, sf_dir):
    cu = table(spark, sf_dir, "customer")
    building = F.col("c_mktsegment") == "BUILDING"
    cols = ["c_acctbal", "c_nationkey"]
    return _drift_out(assoc.ks_drift(cu.where(building & (F.col("c_nationkey") < 8)).select(cols), cu.where(~building & (F.col("c_nationkey") == 3)).select(cols)))


# -- T2 / T5 with p-values ---------------------------------------------------------------

def duck_chi2_sf(x: str, dof: str) -> str:
    """Upper chi-square tail in DuckDB SQL: 1 - P(dof/2, x/2) by the series
    sum_n exp(-y + (s+n) ln y - lgamma(s+n+1)), enough terms past the mode."""
    y, s = f"({x}) / 2.0", f"({dof}) / 2.0"
    n_terms = f"CAST(200 + 2 * ceil({y}) AS BIGINT)"
    series = (f"list_sum(list_transform(range(0, {n_terms}), lambda n: "
              f"exp(-({y}) + ({s} + n) * ln({y}) - lgamma({s} + n + 1))))")
    return (f"CASE WHEN ({dof}) = 0 OR ({x}) <= 0 THEN 1.0 "
            f"ELSE LEAST(1.0, GREATEST(0.0, 1.0 - {series})) END")


def chi2_p_oracle(pairs_sql: str) -> str:
    return f"""
WITH t AS ({chi2_oracle(pairs_sql)})
SELECT "column", chi2, dof, ROUND({duck_chi2_sf("chi2", "dof")}, 6) AS p_value FROM t
"""


DOC_NULL_FLAGS_SQL = _union_sql(
    ["doc_id", "source", "n_chars", "quality", "toxic"],
    "SELECT '{c}' AS \"column\", CAST(CAST({c} IS NULL AS INTEGER) AS VARCHAR) AS a, "
    "CAST(lang AS VARCHAR) AS b FROM (" + DOC_LEFT_LABELS_SQL + ") WHERE lang IS NOT NULL")


@register("missingness_bias_doc_labels", f"""
WITH t AS ({chi2_p_oracle(DOC_NULL_FLAGS_SQL)}),
nulls AS ({_union_sql(["doc_id", "source", "n_chars", "quality", "toxic"],
                     "SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS k FROM (" + DOC_LEFT_LABELS_SQL + ")")})
SELECT t."column", t.chi2, t.p_value, 'MNAR' AS mechanism
FROM t JOIN nulls ON t."column" = nulls."column" WHERE nulls.k > 0 AND t.p_value < 0.05
""")
def q_missingness_bias_doc_labels(spark, sf_dir):
    df = fx.documents_with_labels(spark, sf_dir)
    out = stats.missingness_bias(df, "lang")
    return out.select("column", r6("chi2").alias("chi2"), r6("p_value").alias("p_value"), "mechanism")


MISSING_ORDERS_SQL = """
SELECT *, CASE WHEN o_orderkey % 11 = 0 OR (o_orderstatus = 'F' AND o_orderkey % 3 = 0) THEN NULL ELSE o_totalprice END AS paid,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS by_chance FROM orders"""


@register("missingness_bias_orders", f"""
WITH t AS ({chi2_p_oracle(_union_sql(["paid", "by_chance"], "SELECT '{c}' AS \"column\", CAST(CAST({c} IS NULL AS INTEGER) AS VARCHAR) AS a, o_orderstatus AS b FROM (" + MISSING_ORDERS_SQL + ")"))})
SELECT "column", chi2, p_value, 'MNAR' AS mechanism FROM t WHERE p_value < 0.05
""")
def q_missingness_bias_orders(spark, sf_dir):
    """T2 on a price that is missing more often for one status."""
    o = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    df = o.select("o_orderstatus", F.when(~((key % 11 == 0) | ((status == "F") & (key % 3 == 0))), F.col("o_totalprice")).alias("paid"),
                  F.when(key % 7 != 0, F.col("o_custkey")).alias("by_chance"))
    return stats.missingness_bias(df, "o_orderstatus").select("column", r6("chi2").alias("chi2"), r6("p_value").alias("p_value"), "mechanism")


@register("missingness_tests_doc_labels", chi2_p_oracle(DOC_NULL_FLAGS_SQL))
def q_missingness_tests_doc_labels(spark, sf_dir):
    df = fx.documents_with_labels(spark, sf_dir)
    flags = df.select("lang", *[F.col(c).isNull().cast("int").alias(c)
                                for c in ["doc_id", "source", "n_chars", "quality", "toxic"]])
    counts = stats.pair_counts(flags, [(c, c, "lang") for c in
                                       ["doc_id", "source", "n_chars", "quality", "toxic"]])
    return stats.chi2_tests(counts).select("column", r6("chi2").alias("chi2"), "dof",
                                           r6("p_value").alias("p_value"))


SEG_PAIRS_SQL = f"""
  SELECT 'c_mktsegment' AS "column", CAST(c_mktsegment AS VARCHAR) AS a,
         CAST(o_orderstatus AS VARCHAR) AS b FROM ({ORDERS_SEGMENT_SQL})
  WHERE c_mktsegment IS NOT NULL AND o_orderstatus IS NOT NULL
  UNION ALL
  SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), CAST(o_orderstatus AS VARCHAR)
  FROM ({ORDERS_SEGMENT_SQL}) WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL
"""
SEG_SPEC = DatasetSpec(target="o_orderstatus",
                       protected_attributes=("c_mktsegment", "o_orderpriority"))


@register("disparity_tests_segments", f"""
SELECT "column", chi2, dof, p_value, p_value < 0.05 AS significant
FROM ({chi2_p_oracle(SEG_PAIRS_SQL)})
""")
def q_disparity_tests_segments(spark, sf_dir):
    df = fx.orders_by_segment(spark, sf_dir)
    out = stats.disparity_tests(df, "o_orderstatus", SEG_SPEC)
    return out.select("column", r6("chi2").alias("chi2"), "dof", r6("p_value").alias("p_value"),
                      "significant")


@register("crosstab_normalized_segments", f"""
WITH c AS (SELECT "column", a, b, COUNT(*) AS n FROM ({SEG_PAIRS_SQL}) GROUP BY ALL)
SELECT "column", a, b, n, ROUND(n / SUM(n) OVER (PARTITION BY "column", a), 6) AS share FROM c
""")
def q_crosstab_normalized_segments(spark, sf_dir):
    df = fx.orders_by_segment(spark, sf_dir)
    counts = stats.pair_counts(df, [("c_mktsegment", "c_mktsegment", "o_orderstatus"),
                                    ("o_orderpriority", "o_orderpriority", "o_orderstatus")])
    out = stats.crosstab_normalized(counts)
    return out.select("column", "a", "b", "n", r6("share").alias("share"))


# -- F2-F7, O5, O6: expectations and schema validation ---------------------------------

from ..operators import expect  # noqa: E402
from ..operators import minimise as mini  # noqa: E402
from ..operators import reweight as rw  # noqa: E402
from . import audit as audit_plan  # noqa: E402
from . import eda as eda_plan  # noqa: E402
from . import pipeline as pipe  # noqa: E402
from . import verdict as verdict_plan  # noqa: E402

LABEL_SPEC = DatasetSpec(target="quality", protected_attributes=())
LABELS_EXPECTED = ["doc_id", "quality", "toxic", "score"]

EXPECTATIONS_SQL = """
SELECT 'Target not null' AS expectation, 'quality' AS "column",
       COUNT(*) - COUNT(quality) = 0 AS success, CAST(COUNT(*) - COUNT(quality) AS DOUBLE) AS value FROM labels
UNION ALL SELECT 'Column values not null', 'doc_id', COUNT(*) = COUNT(doc_id), CAST(COUNT(*) - COUNT(doc_id) AS DOUBLE) FROM labels
UNION ALL SELECT 'Column values not null', 'quality', COUNT(*) = COUNT(quality), CAST(COUNT(*) - COUNT(quality) AS DOUBLE) FROM labels
UNION ALL SELECT 'Column values not null', 'toxic', COUNT(*) = COUNT(toxic), CAST(COUNT(*) - COUNT(toxic) AS DOUBLE) FROM labels
UNION ALL SELECT 'Column values in set', 'quality', COUNT(*) FILTER (WHERE quality NOT IN (0, 1)) = 0,
                 CAST(COUNT(*) FILTER (WHERE quality NOT IN (0, 1)) AS DOUBLE) FROM labels
UNION ALL SELECT 'Column values in set', 'toxic', COUNT(*) FILTER (WHERE toxic NOT IN (0, 1)) = 0,
                 CAST(COUNT(*) FILTER (WHERE toxic NOT IN (0, 1)) AS DOUBLE) FROM labels
UNION ALL SELECT 'Column exists', 'score', FALSE, CAST(NULL AS DOUBLE)
UNION ALL SELECT 'Row count valid', NULL, COUNT(*) >= 1, CAST(COUNT(*) AS DOUBLE) FROM labels
"""


def _label_expectations(spark, sf_dir):
    return expect.expectations(table(spark, sf_dir, "labels"), LABEL_SPEC, numeric_not_null=True,
                               in_set={"quality": [0, 1], "toxic": [0, 1]},
                               expected_columns=LABELS_EXPECTED)


@register("expectations_labels", EXPECTATIONS_SQL)
def q_expectations_labels(spark, sf_dir):
    return _label_expectations(spark, sf_dir)


@register("expectation_summary_labels", f"""
SELECT COUNT(*) FILTER (WHERE success) AS passed, COUNT(*) AS total,
       CASE WHEN COUNT(*) FILTER (WHERE success) = COUNT(*) THEN 'PASS' ELSE 'FAIL' END AS status,
       COUNT(*) FILTER (WHERE success) = COUNT(*) AS success
FROM ({EXPECTATIONS_SQL})
""")
def q_expectation_summary_labels(spark, sf_dir):
    return expect.expectation_summary(_label_expectations(spark, sf_dir))


@register("schema_validation_events", f"""
WITH e AS ({EVENTS_K_SQL}),
l AS ({_union_sql(["event_type", "props", "k_text"], "SELECT '{c}' AS \"column\", {c} AS v FROM e")}),
t AS (SELECT "column", COUNT(v) AS nv,
             COUNT(*) FILTER (WHERE v IS NOT NULL AND regexp_matches(v, '{NUMERIC_TEXT_SQL}')) AS nn
      FROM l GROUP BY "column"),
i AS (SELECT list_sort(list("column" || ': numeric data stored as string') FILTER (WHERE nv > 0 AND nn = nv)) AS issues FROM t)
SELECT CASE WHEN len(COALESCE(issues, [])) > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
       COALESCE(issues, []) AS issues FROM i
""")
def q_schema_validation_events(spark, sf_dir):
    return expect.schema_validation(events_with_k(spark, sf_dir))


AUDIT_STATUS_EVENTS_SQL = f"""
WITH s AS (SELECT status FROM ({ORACLE["schema_validation_events"]})),
r AS ({ORACLE["quality_rollup_events"]})
SELECT CASE WHEN (SELECT status FROM s) IN ('PASS', 'WARNING') AND (SELECT failed FROM r) = 0
            THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS compliance_status,
       CAST((SELECT failed FROM r) AS INTEGER) AS failed
"""


@register("audit_status_events", AUDIT_STATUS_EVENTS_SQL)
def q_audit_status_events(spark, sf_dir):
    ev = events_with_k(spark, sf_dir)
    schema = expect.schema_validation(ev)
    rollup = prof.quality_rollup(prof.quality_checks(ev))
    return audit_plan.audit_status(schema, rollup)


# -- M2, J1-J3, T6, T7, O2: minimisation -----------------------------------------------

GOV_SPEC = DatasetSpec(target="is_filled", protected_attributes=("c_mktsegment", "c_nationkey"),
                       domain="credit_scoring", name="credit_scoring_dataset")
GOV_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
            "c_mktsegment", "c_nationkey", "is_filled"]


def governed_orders(spark, sf_dir):
    return fx.orders_by_segment(spark, sf_dir).select(*GOV_COLS)


def _class_sql(cols, spec):
    prot = [a.lower().replace("-", "_").replace(" ", "_") for a in spec.protected_attributes]
    rows = []
    for i, c in enumerate(cols):
        norm = c.lower().replace("-", "_").replace(" ", "_")
        if c == spec.target:
            rows.append(f"('{c}', 'essential', '{mini.RATIONALE_TARGET}', NULL, NULL, {i})")
        elif any(p in norm for p in prot):
            rows.append(f"('{c}', 'prohibited', '{mini.RATIONALE_PROTECTED}', '{mini.GDPR_REF_PROTECTED}', "
                        f"'{mini.EU_AI_ACT_REF_PROTECTED}', {i})")
        else:
            rows.append(f"('{c}', 'optional', '{mini.RATIONALE_OPTIONAL}', NULL, NULL, {i})")
    return ("SELECT col0 AS feature, col1 AS class, col2 AS rationale, CAST(col3 AS VARCHAR) AS gdpr_ref, "
            "CAST(col4 AS VARCHAR) AS eu_ai_act_ref, CAST(col5 AS INTEGER) AS position FROM (VALUES "
            + ", ".join(rows) + ")")


@register("minimal_orders_protected_only", f"""
WITH j AS ({ORDERS_SEGMENT_SQL})
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, is_filled FROM j
""")
def q_minimal_orders_protected_only(spark, sf_dir):
    df = governed_orders(spark, sf_dir)
    minimal, _ = mini.create_minimal_dataset(df, mini.classify_features(df, GOV_SPEC), GOV_SPEC,
                                             importances=None)
    return minimal


LINE_SPEC = DatasetSpec(target="l_returnflag", protected_attributes=("l_linestatus",))


def _lineitem_forest(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return mini.feature_importance(li, "l_returnflag", mini.ForestParams())


@register("feature_importance_lineitem")
def q_feature_importance_lineitem(spark, sf_dir):
    """T6 with the reference's forest (100 trees, depth 10, seed 42):
    rows-only check (values cannot equal another library's forest)."""
    return _lineitem_forest(spark, sf_dir)


@register("selected_features_customer", """
SELECT c_custkey, c_acctbal FROM customer
""")
def q_selected_features_customer(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return mini.select_features(c, include=["c_custkey", "c_acctbal", "c_mktsegment", "nope"],
                                exclude=["c_mktsegment", "c_name", "absent"])


@register("pii_columns_dropped_documents", """
SELECT doc_id, lang, source, n_chars FROM documents
""")
def q_pii_columns_dropped_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cols = [r["column"] for r in pii.pii_columns(pii.pii_findings(docs)).collect()]
    out, _ = mini.drop_pii_columns(docs, cols, protected=["lang"], target="source")
    return out


# -- J9-J11, A6, O11: planted bias over customers -----------------------------------------

SCORE_TERMS = [("c_acctbal", 0.5, "max", None), ("c_nationkey", 0.3, "const", 24.0)]
PATTERN_SQL = {
    "no_bias": "1.0",
    "gender_bias": "CASE WHEN c_mktsegment = 'BUILDING' THEN 1.2 ELSE 1.0 END",
    "age_bias": "CASE WHEN c_nationkey < 10 THEN 0.8 ELSE 1.0 END",
}


def _customer_patterns():
    fav = F.col("c_mktsegment") == "BUILDING"
    young = F.col("c_nationkey") < 10
    return {"no_bias": rw.bias_rules("none"),
            "gender_bias": rw.bias_rules("gender", favoured=fav),
            "age_bias": rw.bias_rules("age", young=young)}


def _planted_sql(patterns) -> str:
    return f"""
WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey,
                  (0.0 + 0.5 * (c_acctbal / (SELECT MAX(c_acctbal) FROM customer)))
                  + 0.3 * (c_nationkey / 24.0) AS base FROM customer),
p AS ({" UNION ALL ".join(f"SELECT '{k}' AS pattern, c.*, base * {v} AS score FROM c" for k, v in patterns.items())}),
t AS (SELECT pattern, quantile_cont(score, 0.5) AS thr FROM p GROUP BY pattern),
l AS (SELECT p.pattern, c_custkey, c_mktsegment, CAST(score > thr AS INTEGER) AS y FROM p JOIN t USING (pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey) - 1 AS rk,
             COUNT(*) OVER (PARTITION BY pattern) AS cnt FROM l)
SELECT pattern, c_custkey, c_mktsegment, CASE WHEN rk < floor(0.05 * cnt) THEN 1 - y ELSE y END AS approved FROM r
"""


PLANTED_SQL = _planted_sql(PATTERN_SQL)


@register("bias_comparison_customers", f"""
SELECT pattern, c_mktsegment AS "group", COUNT(*) AS n, ROUND(AVG(approved), 6) AS outcome_rate
FROM ({PLANTED_SQL}) WHERE c_mktsegment IS NOT NULL GROUP BY ALL
""")
def q_bias_comparison_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey",
                                                "c_acctbal")
    score = rw.weighted_score(c, SCORE_TERMS)
    out = rw.bias_comparison(c, score, _customer_patterns(), "c_mktsegment", ["c_custkey"],
                             threshold_q=0.5, flip_share=0.05, seed=42)
    return out.select("pattern", "group", "n", r6("outcome_rate").alias("outcome_rate"))


@register("bias_intersectional_customers", f"""
SELECT pattern, c_mktsegment || CASE WHEN c_nationkey < 10 THEN ' young' ELSE ' other' END AS "group", COUNT(*) AS n, ROUND(AVG(approved), 6) AS outcome_rate
FROM ({_planted_sql({"intersectional": "CASE WHEN c_mktsegment <> 'BUILDING' AND c_nationkey < 10 THEN 0.7 WHEN c_mktsegment <> 'BUILDING' THEN 0.85 WHEN c_nationkey < 10 THEN 0.85 ELSE 1.0 END"})})
     JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey) GROUP BY ALL
""")
def q_bias_intersectional_customers(spark, sf_dir):
    """J9's fourth pattern: the rates of the groups that it crosses."""
    young = F.col("c_nationkey") < 10
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").withColumn(
        "crossed", F.concat("c_mktsegment", F.when(young, " young").otherwise(" other")))
    rules = rw.bias_rules("intersectional", favoured=F.col("c_mktsegment") == "BUILDING", young=young)
    out = rw.bias_comparison(c, rw.weighted_score(c, SCORE_TERMS), {"intersectional": rules}, "crossed", ["c_custkey"], threshold_q=0.5, flip_share=0.05, seed=42)
    return out.select("pattern", "group", "n", r6("outcome_rate").alias("outcome_rate"))


@register("planted_labels_customers", f"""
SELECT c_custkey, approved FROM ({PLANTED_SQL}) WHERE pattern = 'gender_bias'
""")
def q_planted_labels_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey",
                                                "c_acctbal")
    score = rw.weighted_score(c, SCORE_TERMS)
    out = rw.planted_outcome(c, score, _customer_patterns()["gender_bias"], 0.5, ["c_custkey"],
                             flip_share=0.05, seed=42)
    return out.select("c_custkey", "approved")


@register("quantile_threshold_orders", """
SELECT o_orderkey, CAST(o_totalprice > (SELECT quantile_cont(o_totalprice, 0.7) FROM orders) AS INTEGER) AS top30
FROM orders
""")
def q_quantile_threshold_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rw.above_quantile(o, "o_totalprice", 0.7, "top30").select("o_orderkey", "top30")


# -- O3/O4/O8/O9: bias EDA counts and the verdict over governed orders ---------------------

GOV_SQL = f"SELECT {', '.join(GOV_COLS)} FROM ({ORDERS_SEGMENT_SQL})"
GOV_TEXT = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
GOV_ENC_SQL = f"""
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
       CAST({_duck_code('o_orderstatus')} AS DOUBLE) AS o_orderstatus,
       CAST(o_totalprice AS DOUBLE) AS o_totalprice,
       CAST({_duck_code('o_orderpriority')} AS DOUBLE) AS o_orderpriority,
       CAST({_duck_code('c_mktsegment')} AS DOUBLE) AS c_mktsegment,
       CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(is_filled AS DOUBLE) AS is_filled
FROM ({GOV_SQL})
"""
GOV_PROT = ["c_mktsegment", "c_nationkey"]
GOV_DISP_PAIRS = _union_sql(
    GOV_PROT, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS a, CAST(is_filled AS VARCHAR) AS b "
              "FROM (" + GOV_SQL + ") WHERE {c} IS NOT NULL AND is_filled IS NOT NULL")
GOV_GROUPS = _union_sql(GOV_PROT, "SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS k FROM (" + GOV_SQL + ")")
GOV_DUPS = f"(SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM ({GOV_SQL}))) FROM ({GOV_SQL}))"
GOV_TYPES_BAD = ("(SELECT COUNT(*) FROM (" + _union_sql(
    GOV_TEXT, "SELECT '{c}' AS k, COUNT({c}) AS nv, COUNT(*) FILTER (WHERE {c} IS NOT NULL AND "
              "regexp_matches({c}, '" + NUMERIC_TEXT_SQL + "')) AS nn FROM (" + GOV_SQL + ")")
    + ") WHERE nv > 0 AND nn = nv)")
GOV_EDA_COUNTS_SQL = f"""
SELECT 'missing_sensitive_attrs_count' AS "check", CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'underrepresented_groups_count', COUNT(*) FROM ({_underrep_sql("(" + GOV_SQL + ")", GOV_TEXT)})
UNION ALL SELECT 'missingness_bias_count', CAST(0 AS BIGINT)
UNION ALL SELECT 'proxy_variables_count', COUNT(*) FROM ({_corr_pairs_sql(GOV_ENC_SQL, GOV_PROT, GOV_COLS)}) WHERE ABS(r) > 0.7
UNION ALL SELECT 'statistical_disparities_count', COUNT(*) FROM ({chi2_p_oracle(GOV_DISP_PAIRS)}) t
   JOIN ({GOV_GROUPS}) g ON t."column" = g."column" WHERE g.k <= 20 AND t.p_value < 0.05
"""


@register("missing_attributes_customer", """
SELECT unnest(['age', 'c_mktsegment', 'marital_status', 'sex']) AS attribute
EXCEPT SELECT lower(replace(replace(column_name, '-', '_'), ' ', '_')) FROM (DESCRIBE customer)
""")
def q_missing_attributes_customer(spark, sf_dir):
    """X1 where three of four expected attributes are no columns."""
    spec = DatasetSpec(target=None, protected_attributes=("Age", "c_mktsegment", "marital-status", "sex"))
    return rep.missing_sensitive_attributes(table(spark, sf_dir, "customer"), spec)


def _gov_eda(spark, sf_dir):
    return eda_plan.run_bias_eda(governed_orders(spark, sf_dir), GOV_SPEC)


@register("eda_counts_orders", GOV_EDA_COUNTS_SQL)
def q_eda_counts_orders(spark, sf_dir):
    return eda_plan.finding_counts(_gov_eda(spark, sf_dir))


def _verdict_sql(dups: str, types_bad: str, eda_counts: str) -> str:
    return f"""
WITH sig AS (
  SELECT 'excluded_count' AS "check", COUNT(*) AS n FROM ({_class_sql(GOV_COLS, GOV_SPEC)}) WHERE class = 'prohibited'
  UNION ALL SELECT 'prohibited_features_count', COUNT(*) FROM ({_class_sql(GOV_COLS, GOV_SPEC)}) WHERE class = 'prohibited'
  -- audit: no duplicates and no numeric-as-text column (high missing only warns)
  UNION ALL SELECT 'audit_compliant', CASE WHEN {dups} = 0 AND {types_bad} = 0 THEN 1 ELSE 0 END
  UNION ALL SELECT "check", n FROM ({eda_counts})),
v AS (SELECT
  CAST(COALESCE(SUM(n) FILTER (WHERE "check" = 'excluded_count'), 0) AS BIGINT) AS excluded_count,
  CAST(COALESCE(SUM(n) FILTER (WHERE "check" = 'audit_compliant'), 0) AS BIGINT) AS audit_compliant,
  CAST(COALESCE(SUM(n) FILTER (WHERE "check" = 'prohibited_features_count'), 0) AS BIGINT) AS prohibited_features_count,
  CAST(COALESCE(SUM(n) FILTER (WHERE "check" = 'underrepresented_groups_count'), 0) AS BIGINT) AS underrepresented_groups_count,
  CAST(COALESCE(SUM(n) FILTER (WHERE "check" = 'proxy_variables_count'), 0) AS BIGINT) AS proxy_variables_count,
  CAST(COALESCE(SUM(n) FILTER (WHERE "check" = 'statistical_disparities_count'), 0) AS BIGINT) AS statistical_disparities_count
  FROM sig),
w AS (SELECT *, underrepresented_groups_count + proxy_variables_count + statistical_disparities_count AS bias FROM v),
x AS (SELECT excluded_count, audit_compliant, prohibited_features_count, underrepresented_groups_count,
  proxy_variables_count, statistical_disparities_count,
  CASE WHEN excluded_count > 0 THEN 'COMPLIANT' ELSE 'WARNING' END AS gdpr_article_5_1_c,
  CASE WHEN audit_compliant > 0 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS gdpr_article_5_1_d,
  CASE WHEN prohibited_features_count > 0 THEN 'COMPLIANT' ELSE 'WARNING' END AS gdpr_article_9,
  CASE WHEN bias = 0 THEN 'COMPLIANT' WHEN bias < 5 THEN 'WARNING' ELSE 'NON_COMPLIANT' END AS eu_ai_act_annex_iii,
  list_filter([CASE WHEN audit_compliant = 0 THEN '{verdict_plan.I_QUALITY}' END,
               CASE WHEN bias >= 5 THEN printf('%d significant bias issues detected', bias) END],
              lambda s: s IS NOT NULL) AS issues,
  list_filter([CASE WHEN excluded_count = 0 THEN '{verdict_plan.W_NO_EXCLUSION}' END,
               CASE WHEN prohibited_features_count > 0 THEN printf('%d protected attributes identified and handled appropriately', prohibited_features_count) END,
               CASE WHEN bias > 0 AND bias < 5 THEN printf('%d potential bias issues detected', bias) END],
              lambda s: s IS NOT NULL) AS warnings,
  list_filter([CASE WHEN underrepresented_groups_count > 0 THEN '{verdict_plan.R_UNDERREP}' END,
               CASE WHEN proxy_variables_count > 0 THEN '{verdict_plan.R_PROXIES}' END,
               CASE WHEN statistical_disparities_count > 0 THEN '{verdict_plan.R_DISPARITIES}' END],
              lambda s: s IS NOT NULL) AS recommendations
  FROM w)
SELECT *, CASE WHEN 'NON_COMPLIANT' IN (gdpr_article_5_1_c, gdpr_article_5_1_d, gdpr_article_9, eu_ai_act_annex_iii)
                    OR len(issues) > 0 THEN 'NON_COMPLIANT'
               WHEN len(warnings) > 0 THEN 'COMPLIANT_WITH_WARNINGS' ELSE 'COMPLIANT' END AS overall_status
FROM x
"""


VERDICT_SQL = _verdict_sql(GOV_DUPS, GOV_TYPES_BAD, GOV_EDA_COUNTS_SQL)
# the reference's order: the checks run on the table without its protected columns
MIN_SQL = f"SELECT * EXCLUDE (c_mktsegment, c_nationkey) FROM ({GOV_SQL})"
MIN_DUPS = f"(SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM ({MIN_SQL}))) FROM ({MIN_SQL}))"
MIN_TYPES_BAD = ("(SELECT COUNT(*) FROM (" + _union_sql(
    GOV_TEXT[:2], "SELECT '{c}' AS k, COUNT({c}) AS nv, COUNT(*) FILTER (WHERE {c} IS NOT NULL AND "
                  "regexp_matches({c}, '" + NUMERIC_TEXT_SQL + "')) AS nn FROM (" + MIN_SQL + ")")
    + ") WHERE nv > 0 AND nn = nv)")
MIN_EDA_COUNTS_SQL = f"""
SELECT 'missing_sensitive_attrs_count' AS "check", CAST(2 AS BIGINT) AS n
UNION ALL SELECT 'underrepresented_groups_count', COUNT(*) FROM ({_underrep_sql("(" + MIN_SQL + ")", GOV_TEXT[:2])})
"""


@register("governance_verdict_orders_minimised", _verdict_sql(MIN_DUPS, MIN_TYPES_BAD, MIN_EDA_COUNTS_SQL))
def q_governance_verdict_orders_minimised(spark, sf_dir):
    """O9 in the reference's stage order, without the forest."""
    return pipe.run_governance(governed_orders(spark, sf_dir), GOV_SPEC, bias_on="minimised", importance=False).verdict


@register("governance_verdict_orders", VERDICT_SQL)
def q_governance_verdict_orders(spark, sf_dir):
    res = pipe.run_governance(governed_orders(spark, sf_dir), GOV_SPEC, bias_on="raw",
                              importance=False)
    return res.verdict


@register("governance_verdict_orders_forest")
def q_governance_verdict_orders_forest(spark, sf_dir):
    """O9 with the forest (rows-only: low-importance exclusions depend on
    the forest)."""
    res = pipe.run_governance(governed_orders(spark, sf_dir), GOV_SPEC, bias_on="minimised")
    return res.verdict


# -- P2, S1-S6 and streaming ---------------------------------------------------------------

from ..sources import readers, sinks  # noqa: E402
from ..streaming import redact as stream_redact  # noqa: E402


@register("preview_orders", """
SELECT * FROM orders ORDER BY o_orderkey LIMIT 10
""")
def q_preview_orders(spark, sf_dir):
    return prof.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], 10)


@register("csv_roundtrip_customer", """
SELECT * FROM customer
""")
def q_csv_roundtrip_customer(spark, sf_dir):
    """S4 then S1: header CSV written to shared scratch, read back with
    inferred types (cast to the table's types for comparison)."""
    c = table(spark, sf_dir, "customer")
    path = stream_redact.scratch_dir(spark, "customer-csv")
    sinks.write_csv(c, path)
    back = readers.read_csv(spark, path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in c.schema.fields])


@register("headerless_csv_nation", """
SELECT * FROM nation
""")
def q_headerless_csv_nation(spark, sf_dir):
    """Headerless CSV with given names/types and leading blanks skipped."""
    n = table(spark, sf_dir, "nation")
    path = stream_redact.scratch_dir(spark, "nation-csv")
    n.select(F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), "n_name"),
             F.concat(F.lit(" "), F.col("n_regionkey").cast("string"))) \
        .write.option("header", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.read_headerless_csv(spark, path, n.schema)


@register("json_report_fairness", f"""
SELECT attribute AS protected_attribute, 'demographic_parity_difference' AS metric,
       ROUND(difference, 6) AS value FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
UNION ALL
SELECT attribute, 'demographic_parity_ratio', ROUND(ratio, 6)
FROM ({FAIR_SUMMARY_SQL}) WHERE metric = 'selection_rate'
""")
def q_json_report_fairness(spark, sf_dir):
    """Findings written as JSON lines and read back."""
    s = fair.metric_summary(_fair_input(spark, sf_dir), "y_true", "y_pred", FAIR_ATTRS)
    path = stream_redact.scratch_dir(spark, "report-json")
    sinks.write_json_report({"fairness_report": fair.fairness_report(s)}, path)
    back = spark.read.schema("protected_attribute string, metric string, value double") \
        .json(f"{path}/fairness_report")
    return back.select("protected_attribute", "metric", r6("value").alias("value"))


@register("summary_text_orders", f"""
SELECT printf({_sql_lit(sinks.SUMMARY_TEMPLATE)}, '{GOV_SPEC.domain}', overall_status, 'at run time',
              gdpr_article_5_1_c, gdpr_article_5_1_d, gdpr_article_9, eu_ai_act_annex_iii,
              len(issues), len(warnings), len(recommendations)) AS value
FROM ({VERDICT_SQL})
""")
def q_summary_text_orders(spark, sf_dir):
    """The plain-text compliance summary, the run time masked."""
    res = pipe.run_governance(governed_orders(spark, sf_dir), GOV_SPEC, importance=False)
    text = sinks.summary_text(res.verdict, GOV_SPEC.domain)
    return text.select(F.regexp_replace("value", "Date: [0-9-]{10}T[0-9:]{8}", "Date: at run time").alias("value"))


@register("streaming_redaction_documents", f"""
SELECT doc_id, text, lang, source, n_chars FROM {redact_sql("documents", "doc_id, lang, source, n_chars")}
""")
def q_streaming_redaction_documents(spark, sf_dir):
    """X4 as a Structured Streaming job (file source -> redaction -> parquet
    file sink with checkpoint), read back as a batch table.  The source is
    the table itself, be it one file or a folder of files."""
    docs = table(spark, sf_dir, "documents")
    out = stream_redact.run_redaction(spark, stream_redact.file_or_folder(f"{sf_dir.rstrip('/')}/documents.parquet"), docs.schema)
    return spark.read.schema(docs.schema).parquet(out)


# -- A12: means -----------------------------------------------------------------------------

@register("column_means_lineitem", _union_sql(LINE_NUM, """
SELECT '{c}' AS "column", ROUND(AVG({c}), 6) AS mean FROM lineitem"""))
def q_column_means_lineitem(spark, sf_dir):
    out = prof.column_means(table(spark, sf_dir, "lineitem"), LINE_NUM)
    return out.select("column", r6("mean").alias("mean"))


@register("low_importance_orders")
def q_low_importance_orders(spark, sf_dir):
    """T7 where the forest finds something: ``o_orderstatus`` decides
    ``is_filled``, so most other features fall below 0.01 (rows-only)."""
    imps = mini.feature_importance(governed_orders(spark, sf_dir), "is_filled", mini.ForestParams())
    return mini.low_importance(imps, GOV_SPEC)


@register("drift_status_lineitem_returnflag", f"""
SELECT COUNT(*) FILTER (WHERE drift) AS n_drifted,
       CASE WHEN COUNT(*) FILTER (WHERE drift) > 0 THEN 'DRIFT_DETECTED' ELSE 'NO_DRIFT' END AS status
FROM ({ORACLE["drift_lineitem_returnflag"]})
""")
def q_drift_status_lineitem_returnflag(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cur = li.where(F.col("l_returnflag") == "A").select(*LINE_NUM)
    ref = li.where(F.col("l_returnflag") == "R").select(*LINE_NUM)
    return assoc.drift_status(assoc.ks_drift(cur, ref))


# -- checks of the second round ------------------------------------------------------------

@register("csv_roundtrip_documents", """
SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents
""")
def q_csv_roundtrip_documents(spark, sf_dir):
    """S4 then S1 on texts with quotes, commas, line ends and backslashes."""
    path = stream_redact.scratch_dir(spark, "documents-csv")
    sinks.write_csv(table(spark, sf_dir, "documents"), path)
    out = readers.read_csv(spark, path)
    return out.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


NOT_TESTED_SPEC = DatasetSpec(target="n_chars", protected_attributes=("text", "source", "kind"))


@register("not_tested_documents", """
WITH d AS (SELECT COUNT(DISTINCT n_chars) AS n, COUNT(DISTINCT text) AS t, COUNT(DISTINCT source) AS s, COUNT(*) AS r FROM documents)
SELECT * FROM (
  SELECT 'missingness' AS "check", 'n_chars' AS "column", 'not_tested' AS status, 'the target has 10 values or more' AS reason FROM d WHERE n >= 10
  UNION ALL SELECT 'disparity', 'text', 'not_tested', 'more than 20 groups' FROM d WHERE t > 20
  UNION ALL SELECT 'disparity', 'source', 'not_tested', 'more than 20 groups' FROM d WHERE s > 20
  UNION ALL SELECT 'proxies', 'kind', 'not_tested', 'fewer than two values' FROM d)
""")
def q_not_tested_documents(spark, sf_dir):
    """Skipped T2, T4 and T5 tests leave a row with the reason."""
    df = table(spark, sf_dir, "documents").withColumn("kind", F.lit("one"))
    return untested.not_tested(df, NOT_TESTED_SPEC)


NAN_SQL = "SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 5)::DOUBLE END AS x FROM orders"


@register("nan_rule_orders", f"""
WITH j AS ({NAN_SQL}),
g AS (SELECT x, COUNT(*) AS n FROM j WHERE x IS NOT NULL GROUP BY x)
SELECT 'distinct' AS "check", 'x' AS "column", COUNT(DISTINCT x)::DOUBLE AS value FROM j
UNION ALL SELECT 'expectation', 'x', (COUNT(*) - COUNT(x))::DOUBLE FROM j
UNION ALL SELECT 'groups', 'x', COUNT(*)::DOUBLE FROM g
UNION ALL SELECT 'largest_group', 'x', MAX(n)::DOUBLE FROM g
UNION ALL SELECT 'cells', 'x', COUNT(*)::DOUBLE FROM (SELECT DISTINCT x, o_orderstatus FROM j WHERE x IS NOT NULL AND o_orderstatus IS NOT NULL)
UNION ALL SELECT 'outcome_groups', 'o_orderstatus', COUNT(*)::DOUBLE FROM (SELECT o_orderstatus FROM j GROUP BY o_orderstatus HAVING AVG(x) IS NOT NULL)
""")
def q_nan_rule_orders(spark, sf_dir):
    """NaN is a missing value in every family of checks (planted in x)."""
    df = table(spark, sf_dir, "orders").withColumn(
        "x", F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("o_orderkey") % 5).cast("double")))
    row = lambda check, column, tbl, value: tbl.agg(value.cast("double").alias("value")).select(
        F.lit(check).alias("check"), F.lit(column).alias("column"), "value")
    groups = rep.representation(df, ["x"])
    parts = [
        row("distinct", "x", prof.distinct_counts(df, ["x"]), F.max("n_distinct")),
        row("expectation", "x", expect.expectations(df, DatasetSpec(target="x")).where(F.col("column") == "x"), F.max("value")),
        row("groups", "x", groups, F.count(F.lit(1))),
        row("largest_group", "x", groups, F.max("count")),
        row("cells", "x", stats.pair_counts(df, [("t", "x", "o_orderstatus")]).where(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count(F.lit(1))),
        row("outcome_groups", "o_orderstatus", rep.outcome_rate_by_group(df, "x", ["o_orderstatus"]).where(~F.isnan("outcome_rate")), F.count("outcome_rate")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
