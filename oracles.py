"""DuckDB SQL for the registered queries, built from the column lists of the two derived tables."""

from __future__ import annotations

from itertools import combinations

SEED = 42

EVENTS_MESSY = """
SELECT event_id, event_type, value AS value_good,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value_fair,
 CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS value_bad,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id % 10 AS INT) END AS digit_fair,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag01,
 CASE WHEN event_id % 50 = 0 THEN 1900 ELSE CAST(2000 + user_id % 25 AS INT) END AS reg_year,
 CASE WHEN event_id % 10 = 3 THEN '?' WHEN event_id % 10 = 7 THEN ' ' ELSE event_type END AS type_fair,
 CASE WHEN event_id % 7 = 0 THEN event_type ELSE CAST(user_id AS STRING) END AS mixed,
 CAST(user_id AS STRING) AS code_text,
 CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS STRING) ELSE CAST(value AS STRING) END AS float_text,
 CAST(NULL AS DOUBLE) AS empty_col
FROM {events}"""

LINEITEM_DERIVED = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS price,
 l_extendedprice * (1 - l_discount) AS price_net, -l_extendedprice AS price_neg,
 l_quantity AS qty, l_quantity + l_linenumber % 2 AS qty_adj, l_discount AS disc,
 CASE WHEN l_partkey % 3 <> 0 THEN NULL ELSE l_quantity END AS qty_sparse,
 CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS qty_some,
 CAST(1 AS DOUBLE) AS const_col, l_returnflag AS flag_text
FROM {lineitem}"""

# (column, is it stored as a number)
MESSY_COLUMNS = [
    ("event_type", False), ("value_good", True), ("value_fair", True), ("value_bad", True),
    ("digit_fair", True), ("flag01", True), ("reg_year", True), ("type_fair", False), ("mixed", False),
    ("code_text", False), ("float_text", False), ("empty_col", True),
]
PART_COLUMNS = [
    ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True),
]
LINEITEM_COLUMNS = [
    ("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True),
    ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
    ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False),
]
DERIVED_COLUMNS = [
    "l_orderkey", "l_linenumber", "price", "price_net", "price_neg", "qty", "qty_adj", "disc",
    "qty_sparse", "qty_some", "const_col", "flag_text",
]
KENDALL_COLUMNS = ["l_linenumber", "qty", "qty_adj", "disc", "qty_some", "const_col"]
IMPUTE_NUMBERS = {0: "none", 1: "mean_mode", 2: "random", 3: "zeros"}
IMPUTED_COLUMNS = [("value_fair", True), ("digit_fair", True), ("type_fair", False)]
NUMERIC_MESSY = ["value_good", "value_fair", "value_bad", "digit_fair", "flag01", "reg_year", "code_text", "float_text"]

MESSY = "em AS (" + EVENTS_MESSY.format(events="events") + ")"
DERIVED = "ld AS (" + LINEITEM_DERIVED.format(lineitem="lineitem") + ")"


def text(c: str) -> str:
    return f"CASE WHEN trim(CAST({c} AS VARCHAR), ' \t\n\r') IN ('?', '', 'None', 'nan', 'NaN') THEN NULL ELSE CAST({c} AS VARCHAR) END"


def number(c: str, stored: bool) -> str:
    return f"CAST({c} AS DOUBLE)" if stored else f"TRY_CAST({text(c)} AS DOUBLE)"


def long_table(source: str, columns, name: str = "cells", key: str | None = None) -> str:
    """``(feature, ordinal, stored, t, x)`` per cell, t = text or NULL when missing, x = number."""
    k = f"{key}, " if key else ""
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT {k}'{c}' AS feature, {i} AS ordinal, {str(stored).upper()} AS stored, "
        f"{f'CAST({c} AS VARCHAR)' if stored else text(c)} AS t, {number(c, stored)} AS x FROM {source}"
        for i, (c, stored) in enumerate(columns)) + ")"


STATS = """stats AS (
 SELECT feature, ordinal, stored, count(*) AS n_rows, count(*) - count(t) AS n_missing, count(x) AS n_number,
  count(*) FILTER (x % 1 = 0) AS n_integral, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_pop(x) AS dev,
  median(x) AS med
 FROM cells GROUP BY ALL)"""

FACTS = """typed AS (
 SELECT *, CASE WHEN n_missing >= n_rows / 3.0 THEN 'bad' WHEN n_missing > 0 THEN 'fair' ELSE 'good' END AS state,
  CASE WHEN NOT stored AND n_number = 0 THEN 'string'
   WHEN NOT stored AND n_number < n_rows - n_missing THEN 'unknown'
   WHEN regexp_matches(feature, 'year|Year|Date|date|Dates|yr') OR (contains(feature, 'YEAR') AND NOT contains(feature, 'Age')) THEN 'date'
   WHEN n_integral = n_number THEN 'int' ELSE 'float' END AS var_type
 FROM stats),
facts AS (
 SELECT * REPLACE (CASE WHEN var_type = 'unknown' THEN NULL ELSE lo END AS lo, CASE WHEN var_type = 'unknown' THEN NULL ELSE hi END AS hi),
  CASE WHEN var_type = 'string' THEN 'categorical' WHEN var_type IN ('unknown', 'date') THEN
    CASE var_type WHEN 'date' THEN 'numeric' ELSE 'unknown' END
   WHEN (stored OR var_type = 'int') AND lo % 1 = 0 AND hi % 1 = 0 AND lo BETWEEN 0 AND 9 AND hi BETWEEN 0 AND 9 THEN 'categorical'
   ELSE 'numeric' END AS measure_type
 FROM typed)"""


def facts(source_cte: str, source: str, columns) -> str:
    return "WITH " + ", ".join(x for x in (source_cte, long_table(source, columns), STATS, FACTS) if x)


def over_tables(select: str) -> str:
    """The same select over the facts of three tables."""
    parts = [("events_messy", MESSY, "em", MESSY_COLUMNS), ("part", "", "part", PART_COLUMNS),
             ("lineitem", "", "lineitem", LINEITEM_COLUMNS)]
    return " UNION ALL ".join(
        f"SELECT '{tbl}' AS tbl, * FROM ({facts(cte, src, cols)} {select})" for tbl, cte, src, cols in parts)


CENTER = """, values_once AS (SELECT DISTINCT feature, t, x FROM cells WHERE NOT stored AND t IS NOT NULL),
distinct_center AS (SELECT feature, avg(x) AS dmean, median(x) AS dmed FROM values_once GROUP BY feature)
SELECT feature, CASE WHEN var_type IN ('string', 'unknown') OR lo IS NULL THEN NULL
  WHEN var_type = 'date' OR measure_type = 'categorical' THEN round_even(CASE WHEN stored THEN med ELSE dmed END, 0)
  ELSE round_even(CASE WHEN stored THEN mean ELSE dmean END, 2) END AS center
FROM facts LEFT JOIN distinct_center USING (feature)"""

DOMAIN = """WITH {cells}, counts AS (SELECT feature, t, count(*) AS n FROM cells WHERE t IS NOT NULL AND NOT stored GROUP BY ALL),
facts AS (SELECT feature, count(*) AS domain_size, arg_min(t, (-n, t)) AS mode FROM counts GROUP BY feature)
SELECT feature, t AS value, n, domain_size, mode FROM counts JOIN facts USING (feature)"""


# Outlier rules over ``cells``: each gives feature -> (score expression, limit) through CTEs.
def outlier_flags(method: str) -> str:
    """CTEs ``fit`` per feature, and the condition that flags x."""
    if method == "zscore":
        return "fit AS (SELECT feature, avg(x) AS c, stddev_pop(x) AS s FROM cells GROUP BY feature)", "abs((x - c) / nullif(s, 0)) > 3"
    if method == "iqr":
        return ("fit AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM cells GROUP BY feature)",
                "(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))")
    base = """mid AS (SELECT feature, median(x) AS m, avg(x) AS a FROM cells GROUP BY feature),
fit AS (SELECT feature, m, median(abs(x - m)) AS mad, avg(abs(x - a)) AS mead FROM cells JOIN mid USING (feature) GROUP BY feature, m)"""
    if method == "mad":
        return base, "abs(x - mad) > 3 * mad"
    return base, "abs((x - m) / nullif(CASE WHEN mad = 0 THEN 1.253314 * mead ELSE 1.486 * mad END, 0)) > 3.5"


def two_column_outliers(method: str) -> str:
    fit, flag = outlier_flags(method)
    return f"""WITH cells AS (SELECT 'events.value' AS feature, event_id AS id, value AS x FROM events
 UNION ALL SELECT 'documents.n_chars', doc_id, CAST(n_chars AS DOUBLE) FROM documents), {fit}
SELECT feature, id, x AS value FROM cells JOIN fit USING (feature) WHERE {flag}"""


def verdicts(method: str, source_cte: str, source: str, columns) -> str:
    """CTEs up to ``verdicts (feature, outlier_verdict, n_outliers)``."""
    fit, flag = outlier_flags(method)
    return facts(source_cte, source, columns) + f""", {fit},
hits AS (SELECT feature, count(*) FILTER ({flag}) AS n FROM cells JOIN fit USING (feature) GROUP BY feature),
verdicts AS (SELECT feature, CASE WHEN var_type IN ('string', 'unknown') OR n_missing = n_rows THEN 'not-applicable'
  WHEN var_type = 'int' AND lo = 0 AND hi = 1 THEN 'no' WHEN n > 0 THEN 'yes' ELSE 'no' END AS outlier_verdict,
 CASE WHEN var_type IN ('string', 'unknown') OR n_missing = n_rows OR (var_type = 'int' AND lo = 0 AND hi = 1) THEN 0 ELSE n END AS n_outliers
 FROM facts LEFT JOIN hits USING (feature))"""


SUMMARY = """ SELECT count(*) AS n_features, max(n_rows) AS n_instances,
 count(*) FILTER (measure_type = 'categorical') AS n_discrete, count(*) FILTER (measure_type = 'numeric') AS n_continuous,
 count(*) FILTER (measure_type = 'unknown') AS n_unknown, CAST(sum(n_missing) AS BIGINT) AS n_missing,
 round_even(100.0 * sum(n_missing) / (count(*) * max(n_rows)), 2) AS pct_missing,
 count(*) FILTER (state = 'good') AS n_good, round_even(100.0 * count(*) FILTER (state = 'good') / count(*), 1) AS pct_good,
 count(*) FILTER (state = 'fair') AS n_fair, round_even(100.0 * count(*) FILTER (state = 'fair') / count(*), 1) AS pct_fair,
 count(*) FILTER (state = 'bad') AS n_bad, round_even(100.0 * count(*) FILTER (state = 'bad') / count(*), 1) AS pct_bad,
 CAST(sum(n_outliers) AS BIGINT) AS n_outliers,
 round_even(100.0 * sum(n_outliers) / (count(*) * max(n_rows)), 2) AS pct_outliers
FROM facts JOIN verdicts USING (feature)"""

DESCRIBE = """WITH cells AS (SELECT 'events.value' AS feature, value AS x FROM events
 UNION ALL SELECT 'documents.n_chars', CAST(n_chars AS DOUBLE) FROM documents),
m AS (SELECT feature, avg(x) AS a, median(x) AS md, stddev_pop(x) AS s FROM cells GROUP BY feature),
k AS (SELECT feature, a, md, s, avg((x - a) ** 2) AS m2, avg((x - a) ** 3) AS m3, avg((x - a) ** 4) AS m4 FROM cells JOIN m USING (feature) GROUP BY ALL)
SELECT feature, round_even(a, 2) AS mean, round_even(md, 2) AS median, round_even(s, 2) AS std,
 round_even(m3 / m2 ** 1.5, 2) AS skewness, round_even(m4 / m2 ** 2 - 3, 2) AS kurtosis FROM k"""


# Critical values for every n of the table, in SQL alone: the normal quantile by Acklam's rational approximation (relative
# error 1e-9) and Student's t by Hill's algorithm 396 (six digits). Fixed values of those two publications.
CRITICAL = """sizes AS (SELECT unnest(range(3, (SELECT count(*) FROM documents) + 1)) AS n),
tails AS (SELECT n, CAST(n - 2 AS DOUBLE) AS f, 0.1 / n AS two, sqrt(-2 * ln(0.05 / n)) AS q, 1 / (n - 2.5) AS a FROM sizes),
normal AS (SELECT *, 48 / (a * a) AS b, -(((((-7.784894002430293e-03 * q - 3.223964580411365e-01) * q - 2.400758277161838) * q - 2.549732539343734) * q
  + 4.374664141464968) * q + 2.938163982698783) / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996) * q + 3.754408661907416) * q + 1) AS x FROM tails),
third AS (SELECT *, ((20700 * a / b - 98) * a - 16) * a + 96.36 AS c FROM normal),
fourth AS (SELECT *, ((94.5 / (b + c) - 3) / b + 1) * sqrt(a * pi() / 2) * f AS d FROM third),
start AS (SELECT *, (d * two) ** (2 / f) AS y FROM fourth),
far AS (SELECT *, (((0.05 * d * (-x) - 5) * (-x) - 7) * (-x) - 2) * (-x) + b + c + CASE WHEN f < 5 THEN 0.3 * (f - 4.5) * (-x + 0.6) ELSE 0 END AS e FROM start),
bulk AS (SELECT *, a * ((((((0.4 * x * x + 6.3) * x * x + 36) * x * x + 94.5) / e - x * x - 3) / b + 1) * (-x)) ** 2 AS u FROM far),
student AS (SELECT n, f, f * CASE WHEN y > 0.05 + a THEN CASE WHEN u > 0.002 THEN exp(u) - 1 ELSE 0.5 * u * u + u END
  ELSE ((1 / (((f + 6) / (f * y) - 0.089 * d - 0.822) * (f + 2) * 3) + 0.5 / (f + 4)) * y - 1) * (f + 1) / (f + 2) + 1 / y END AS t2 FROM bulk),
critical AS (SELECT n, (n - 1) / sqrt(n) * sqrt(t2 / (n - 2 + t2)) AS g_crit FROM student)"""


def grubbs_cells() -> str:
    return f"""WITH {CRITICAL},
one AS (SELECT 1 AS side, doc_id, CAST(n_chars AS DOUBLE) AS v FROM documents
 UNION ALL SELECT -1, doc_id, -CAST(n_chars AS DOUBLE) FROM documents),
center AS (SELECT side, avg(v) AS c FROM one GROUP BY side),
left_over AS (SELECT side, doc_id, v, count(*) OVER w AS n, sum(v - c) OVER w AS s1, sum((v - c) * (v - c)) OVER w AS s2, c
 FROM one JOIN center USING (side) WINDOW w AS (PARTITION BY side ORDER BY v, doc_id ROWS UNBOUNDED PRECEDING)),
tests AS (SELECT side, doc_id, v, n, (v - c - s1 / n) / sqrt((s2 - s1 * s1 / n) / nullif(n - 1, 0)) AS g FROM left_over),
stops AS (SELECT side, max(n) AS stop_n FROM tests LEFT JOIN critical USING (n) WHERE n <= 2 OR NOT g > g_crit GROUP BY side)
SELECT DISTINCT doc_id, CAST(n_chars AS DOUBLE) AS value FROM tests JOIN stops USING (side) JOIN documents USING (doc_id) WHERE n > stop_n"""


GRUBBS_STEP = """SELECT feature, n, round(g_max, 6) AS g_max, round(g_min, 6) AS g_min FROM (
SELECT 'documents.n_chars' AS feature, count(n_chars) AS n, (max(n_chars) - avg(n_chars)) / stddev_samp(n_chars) AS g_max,
 (avg(n_chars) - min(n_chars)) / stddev_samp(n_chars) AS g_min FROM documents
UNION ALL SELECT 'events.value', count(value), (max(value) - avg(value)) / stddev_samp(value), (avg(value) - min(value)) / stddev_samp(value) FROM events)"""


def filled(method: str, c: str, stored: bool) -> str:
    """Expression for an imputed column of ``em`` joined with its fill value f_<c>."""
    own = f"CAST({c} AS DOUBLE)" if stored else text(c)
    return f"coalesce({own}, f_{c})"


MEAN_FILLS = f"""fills AS (SELECT avg(value_fair) AS f_value_fair, round_even(avg(digit_fair), 0) AS f_digit_fair,
 (SELECT {text('type_fair')} AS t FROM em WHERE {text('type_fair')} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS f_type_fair FROM em)"""


def impute_select(columns) -> str:
    return ", ".join(
        (f"round({filled('', c, s)}, 6)" if s else filled("", c, s)) + f" AS {c}" for c, s in columns)


def random_parts() -> tuple[str, str]:
    """CTEs with the drawn values, and the joins that bring them to ``em``."""
    parts, joins = [], []
    for c, stored in IMPUTED_COLUMNS:
        own = f"CAST({c} AS DOUBLE)" if stored else text(c)
        order = f"row_number() OVER (ORDER BY md5(concat('{SEED}', '|', '{c}', '|', CAST(event_id AS STRING)))) AS k"
        parts.append(f"o_{c} AS (SELECT {own} AS v, {order} FROM em WHERE {own} IS NOT NULL)")
        parts.append(f"m_{c} AS (SELECT event_id, {order} FROM em WHERE {own} IS NULL)")
        parts.append(f"d_{c} AS (SELECT event_id, v AS f_{c} FROM m_{c} JOIN o_{c} USING (k))")
        joins.append(f"LEFT JOIN d_{c} USING (event_id)")
    return ", ".join(parts), " ".join(joins)


def random_fill() -> str:
    parts, joins = random_parts()
    return f"WITH {MESSY}, {parts} SELECT event_id, {impute_select(IMPUTED_COLUMNS)} FROM em {joins}"


def curated_random() -> str:
    """Every column of the curated rows after random filling, with the statuses by the quartile rule as JSON."""
    parts, joins = random_parts()
    filled_columns = dict(IMPUTED_COLUMNS)
    columns = []
    for c, stored in MESSY_COLUMNS:
        if c in filled_columns:
            columns.append(f"{filled('random', c, stored)} AS {c}")
        else:
            columns.append(f"CAST({c} AS DOUBLE) AS {c}" if stored else f"{text(c)} AS {c}")
    pairs = ", ',', ".join(f"""'"{c}":"', max(CASE WHEN feature = '{c}' THEN status END), '"'""" for c, _ in MESSY_COLUMNS)
    return (f"{statuses('iqr')}, {parts}, st AS (SELECT event_id, concat('{{', {pairs}, '}}') AS status FROM statuses GROUP BY event_id) "
            f"SELECT event_id, {', '.join(columns)}, status FROM em JOIN st USING (event_id) {joins}")


def statuses(method: str) -> str:
    """CTEs up to ``statuses (event_id, feature, status)`` with mean/mode filling."""
    fit, flag = outlier_flags(method)
    return ("WITH " + ", ".join([MESSY, long_table("em", MESSY_COLUMNS, key="event_id"), STATS, FACTS, fit]) + f""",
statuses AS (SELECT event_id, feature, CASE
  WHEN var_type NOT IN ('string', 'unknown') AND n_missing < n_rows AND NOT (var_type = 'int' AND lo = 0 AND hi = 1) AND coalesce({flag}, FALSE) THEN 'outlier'
  WHEN t IS NULL THEN CASE WHEN state <> 'bad' AND var_type <> 'unknown' THEN 'imputed' ELSE 'missing' END
  WHEN var_type = 'unknown' AND x IS NULL THEN 'incompatible' ELSE 'ok' END AS status
 FROM cells JOIN facts USING (feature) LEFT JOIN fit USING (feature))""")


def usable(c: str) -> str:
    return "TRY_CAST(flag_text AS DOUBLE)" if c == "flag_text" else f"CAST({c} AS DOUBLE)"


def pair_report(columns, value: str, keep: str, digits: int) -> str:
    """One row per reported pair. ``value`` is SQL over complete rows ``p(a, b)``."""
    parts = []
    for e, l in combinations(columns, 2):
        parts.append(f"""SELECT '{l}' AS f1, '{e}' AS f2, (WITH raw AS (SELECT {usable(e)} AS a, {usable(l)} AS b FROM ld),
 gate AS (SELECT count(a) > count(*) / 2.0 AND count(b) > count(*) / 2.0 AS ok FROM raw),
 p AS (SELECT a, b FROM raw, gate WHERE ok AND a IS NOT NULL AND b IS NOT NULL) {value}) AS value""")
    return (f"WITH {DERIVED}, found AS ({' UNION ALL '.join(parts)}) SELECT f1, f2, round(value, {digits}) AS value FROM "
            f"(SELECT f1, f2, CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE value END AS value FROM found) WHERE {keep}")


VARIES = "CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN "
PEARSON = f"SELECT {VARIES} least(corr(a, b), 1.0) END FROM p"
COVARIANCE = "SELECT covar_samp(a, b) FROM p"
SPEARMAN = f"""SELECT {VARIES} least(corr(ra, rb), 1.0) END FROM (SELECT a, b,
 rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p)"""
KENDALL = """, t AS (SELECT a AS x, b AS y, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1, 2),
 z AS (SELECT sum(n) AS nn FROM t), s AS (SELECT sum(l.n * r.n * sign(l.x - r.x) * sign(l.y - r.y)) / 2.0 AS s FROM t l, t r),
 tx AS (SELECT sum(k * (k - 1)) / 2.0 AS v FROM (SELECT sum(n) AS k FROM t GROUP BY x)),
 ty AS (SELECT sum(k * (k - 1)) / 2.0 AS v FROM (SELECT sum(n) AS k FROM t GROUP BY y))
 SELECT s / nullif(sqrt((nn * (nn - 1) / 2.0 - tx.v) * (nn * (nn - 1) / 2.0 - ty.v)), 0) FROM s, z, tx, ty"""

#: The same score without pairs of rows: at each binary digit of x's position, rows with a one against those with a zero in their block.
KENDALL_BY_DIGITS = KENDALL.replace("""s AS (SELECT sum(l.n * r.n * sign(l.x - r.x) * sign(l.y - r.y)) / 2.0 AS s FROM t l, t r)""",
 """k AS (SELECT dense_rank() OVER (ORDER BY x) - 1 AS x, y, CAST(n AS BIGINT) AS n FROM t),
 lv AS (SELECT unnest(range(CAST(ceil(log2(max(x) + 1)) AS BIGINT))) AS l FROM k),
 g AS (SELECT l, x >> (l + 1) AS block, y, sum(CASE WHEN (x >> l) & 1 = 0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN (x >> l) & 1 = 1 THEN n ELSE 0 END) AS n1
  FROM k, lv GROUP BY ALL),
 w AS (SELECT n0, n1, sum(n0) OVER (PARTITION BY l, block ORDER BY y) AS upto, sum(n0) OVER (PARTITION BY l, block) AS zeros FROM g),
 s AS (SELECT CAST(sum(n1 * ((upto - n0) - (zeros - upto))) AS DOUBLE) AS s FROM w)""")

REPORT_FACTS = """ SELECT feature, storage, var_type, measure_type, n_missing, state, lo AS min, hi AS max,
 CASE WHEN var_type = 'unknown' THEN 'yes, unknown type of data' WHEN state = 'bad' THEN 'yes, bad feature' ELSE 'no' END AS incompatibility,
 CASE WHEN var_type = 'unknown' THEN n_rows - n_missing - n_number ELSE 0 END AS n_incompatible, outlier_verdict, n_outliers
FROM (SELECT *, CASE WHEN stored THEN 'continuous' ELSE 'discrete' END AS storage FROM facts) JOIN verdicts USING (feature)"""


def printed(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '?' WHEN {x} % 1 = 0 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


EVALUATION = f""", centers AS (SELECT * FROM ({{facts}} {CENTER})),
domains AS (SELECT feature, count(*) AS size, string_agg(t, ', ' ORDER BY t) AS listed
 FROM (SELECT DISTINCT feature, t FROM cells WHERE NOT stored AND t IS NOT NULL) GROUP BY feature)
SELECT feature, CASE WHEN var_type IN ('string', 'unknown') THEN CASE WHEN size >= 100 THEN 'Too large to display!!' ELSE concat('[', listed, ']') END
 ELSE concat('[', {printed('lo')}, ', ', {printed('hi')}, ']') END AS value_range,
 measure_type AS type, var_type AS variable_type, n_missing AS missing_values,
 CASE WHEN var_type IN ('string', 'unknown') THEN '-' ELSE {printed('center')} END AS center, state, outlier_verdict AS outliers,
 CASE WHEN var_type = 'unknown' THEN 'yes, unknown type of data' WHEN state = 'bad' THEN 'yes, bad feature' ELSE 'no' END AS incompatibilities
FROM facts JOIN verdicts USING (feature) JOIN centers USING (feature) LEFT JOIN domains USING (feature)"""


def oracle_sql() -> dict[str, str]:
    messy_facts = facts(MESSY, "em", MESSY_COLUMNS)
    label_columns = [("quality", True), ("toxic", True)]
    kept = [c for c, _ in MESSY_COLUMNS if c not in ("value_bad", "empty_col")]
    clean_columns = ", ".join(
        f"{text(c)} AS {c}" if c in ("event_type", "type_fair", "mixed", "code_text")
        else f"TRY_CAST({text(c)} AS DOUBLE) AS {c}" if c == "float_text" else c for c in kept)
    pivoted = ", ".join(
        f"max(CASE WHEN feature = '{c}' THEN status END) AS st_{c}" for c, _ in MESSY_COLUMNS)
    mean_fill = f"WITH {MESSY}, {MEAN_FILLS}"
    correlation = "value >= 0.9 AND value <= 1"
    sql = {
        "missing_normalised": f"WITH {MESSY} SELECT event_id, {text('type_fair')} AS type_fair, value_fair FROM em",
        "token_kinds": "WITH " + MESSY + ", " + long_table("em", [c for c in MESSY_COLUMNS if not c[1]]) + """
SELECT feature, CASE WHEN x IS NULL THEN 'string' WHEN x % 1 = 0 THEN 'int' ELSE 'float' END AS kind, count(*) AS n
FROM cells WHERE t IS NOT NULL GROUP BY 1, 2""",
        "feature_state": messy_facts + " SELECT feature, n_rows, n_missing, state FROM facts",
        "feature_types": messy_facts + " SELECT feature, CASE WHEN stored THEN 'continuous' ELSE 'discrete' END AS storage, var_type, measure_type FROM facts",
        "feature_range": over_tables("SELECT feature, CASE WHEN var_type IN ('string') THEN NULL ELSE lo END AS min, CASE WHEN var_type IN ('string') THEN NULL ELSE hi END AS max FROM facts"),
        "feature_center": over_tables(CENTER),
        "feature_domain": DOMAIN.format(cells=long_table("part", PART_COLUMNS)),
        "incompatible_cells": f"WITH {MESSY} SELECT event_id, 'mixed' AS feature, mixed AS value FROM em WHERE {text('mixed')} IS NOT NULL AND TRY_CAST(mixed AS DOUBLE) IS NULL",
        "incompatibility_report": messy_facts + """ SELECT feature, CASE WHEN var_type = 'unknown' THEN 'yes, unknown type of data'
 WHEN state = 'bad' THEN 'yes, bad feature' ELSE 'no' END AS incompatibility,
 CASE WHEN var_type = 'unknown' THEN n_rows - n_missing - n_number ELSE 0 END AS n_incompatible FROM facts""",
        "features_by_state": messy_facts + " SELECT state, string_agg(feature, ',' ORDER BY ordinal) AS features FROM facts GROUP BY state",
        "dataset_summary": verdicts("zscore", MESSY, "em", MESSY_COLUMNS) + SUMMARY,
        "evaluation_report": verdicts("iqr", MESSY, "em", MESSY_COLUMNS) + EVALUATION.format(facts=messy_facts),
        "describe_feature": DESCRIBE,
        **{f"outliers_{m}": two_column_outliers(m) for m in ("zscore", "modified_z", "iqr", "mad")},
        "outliers_binary_guard": verdicts("iqr", "", "labels", label_columns) + " SELECT feature, outlier_verdict, n_outliers FROM verdicts",
        "outliers_none": "SELECT feature, 'no' AS outlier_verdict, CAST(0 AS BIGINT) AS n_outliers FROM (VALUES ('quality'), ('toxic')) v(feature)",
        "outliers_verdicts": verdicts("modified_z", MESSY, "em", MESSY_COLUMNS) + " SELECT feature, outlier_verdict, n_outliers FROM verdicts",
        "outlier_cells": statuses("iqr") + " SELECT event_id, feature, x AS value FROM statuses JOIN cells USING (event_id, feature) WHERE status = 'outlier'",
        "outliers_grubbs_step": GRUBBS_STEP,
        "outliers_grubbs": grubbs_cells(),
        "impute_mean_mode": f"{mean_fill} SELECT event_id, {impute_select(IMPUTED_COLUMNS)} FROM em, fills",
        "impute_categorical_round": f"{mean_fill} SELECT event_id, {impute_select([('digit_fair', True)])} FROM em, fills",
        "impute_zeros": f"WITH {MESSY}, fills AS (SELECT 0.0 AS f_value_fair, 0.0 AS f_digit_fair, CAST(NULL AS VARCHAR) AS f_type_fair) SELECT event_id, {impute_select(IMPUTED_COLUMNS)} FROM em, fills",
        "impute_random": random_fill(),
        "impute_none": f"WITH {MESSY} SELECT event_id, value_fair, digit_fair, {text('type_fair')} AS type_fair FROM em",
        "cell_status": statuses("zscore") + " SELECT event_id, feature, status FROM statuses WHERE status <> 'ok'",
        "curated_table": statuses("zscore") + f", {MEAN_FILLS}, st AS (SELECT event_id, {pivoted} FROM statuses GROUP BY event_id) "
                         f"SELECT em.event_id, {impute_select(IMPUTED_COLUMNS)}, value_bad, value_good, st.* EXCLUDE (event_id) FROM em JOIN st USING (event_id), fills",
        "clean_table": f"WITH {MESSY} SELECT event_id, {clean_columns} FROM em",
        "corr_pearson": pair_report(DERIVED_COLUMNS, PEARSON, correlation, 6),
        "corr_spearman": pair_report(DERIVED_COLUMNS, SPEARMAN, correlation, 6),
        "corr_kendall": pair_report(KENDALL_COLUMNS, KENDALL, correlation, 6),
        "corr_kendall_all": pair_report(DERIVED_COLUMNS, KENDALL_BY_DIGITS, correlation, 6),
        "covariance_pairs": pair_report(DERIVED_COLUMNS, COVARIANCE, "value >= 0.9 OR value <= -1", 2),
        "similar_strings": """WITH d AS (SELECT DISTINCT p_name AS s FROM part WHERE trim(p_name) NOT IN ('?', '', 'None', 'nan', 'NaN'))
SELECT a.s AS f1, b.s AS f2, round(jaro_similarity(a.s, b.s), 6) AS value FROM d a JOIN d b ON a.s > b.s WHERE jaro_similarity(a.s, b.s) >= 0.92""",
        # jaro_similarity compares bytes: every letter beyond ASCII becomes one unused byte.
        "similar_lines": """WITH d AS (SELECT s, length(s) AS n, translate(s, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü',
  array_to_string(list_transform(range(1, 9) || range(14, 27), lambda k: chr(k::INT)), '')) AS plain
 FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS s FROM documents) WHERE trim(s) NOT IN ('?', '', 'None', 'nan', 'NaN'))
SELECT a.s AS f1, b.s AS f2, round(jaro_similarity(a.plain, b.plain), 6) AS value FROM d a JOIN d b
 ON a.s > b.s AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) WHERE jaro_similarity(a.plain, b.plain) >= 0.92""",
        "features_json_read": f"WITH {MESSY} SELECT CAST(event_id AS DOUBLE) AS event_id, value_fair, event_type, code_text FROM em",
        "dedup_headers": "SELECT CAST(event_id AS DOUBLE) AS a1, CAST(user_id AS DOUBLE) AS b, 'z' AS a2 FROM events",
        "csv_read": f"""WITH {MESSY} SELECT CAST(event_id AS DOUBLE) AS id, value_fair AS value1,
 concat(event_type, ' "', event_id, '", x') AS note, CASE WHEN event_id % 3 <> 0 THEN 7.0 END AS value2 FROM em""",
        "bracketed_values": "SELECT p_partkey, concat(' ', p_name, '  ') AS name FROM part",
        "similarity_none": "SELECT name AS f1, name AS f2, 0.0 AS value FROM (SELECT CAST(event_type AS VARCHAR) AS name FROM events) WHERE FALSE",
        "curate_events_table": curated_random(),
        "number_render": f"""WITH {MESSY} SELECT event_id, CASE WHEN value_fair IS NULL THEN '?' WHEN value_fair % 1 = 0 THEN CAST(CAST(value_fair AS BIGINT) AS VARCHAR)
 ELSE CAST(value_fair AS VARCHAR) END AS value_fair, event_type FROM em""",
        "curate_events": verdicts("modified_z", MESSY, "em", MESSY_COLUMNS) + REPORT_FACTS,
    }
    plain = {c: f"CAST({c} AS DOUBLE) AS {c}" if stored else f"{text(c)} AS {c}" for c, stored in MESSY_COLUMNS}
    from_text = plain | {c: f"CAST({c} AS DOUBLE) AS {c}" for c in ("code_text", "float_text")}
    raw = {c: f"CAST({c} AS DOUBLE) AS {c}" if stored else c for c, stored in MESSY_COLUMNS}
    whole = {c: x for c, x in plain.items()} | {c: c for c in ("digit_fair", "flag01", "reg_year")}
    texts = [("text", False), ("lang", False), ("source", False)]
    sql |= {
        "domain_of_texts": facts("", "documents", texts) + """, counts AS (SELECT feature, t, count(*) AS n FROM cells WHERE t IS NOT NULL GROUP BY ALL),
domains AS (SELECT feature, count(*) AS domain_size, md5(arg_min(t, (-n, t))) AS mode_md5 FROM counts GROUP BY feature)
SELECT feature, domain_size, mode_md5, n_missing, state FROM facts JOIN domains USING (feature)""",
        "csv_files": f"WITH {MESSY} SELECT CAST(event_id AS DOUBLE) AS event_id, {', '.join(from_text.values())} FROM em",
        "jsonl_files": f"WITH {MESSY} SELECT event_id, {', '.join(whole.values())} FROM em",
        "json_files": f"WITH {MESSY} SELECT CAST(event_id AS DOUBLE) AS event_id, {', '.join(raw.values())} FROM em",
        "similarity_by_numbers": f"SELECT 2 AS method, * FROM ({sql['corr_pearson']}) UNION ALL SELECT 4, * FROM ({sql['covariance_pairs']})",
        "impute_by_numbers": " UNION ALL ".join(
            f"SELECT {k} AS method, event_id, CAST(value_fair AS DOUBLE) AS value_fair, CAST(digit_fair AS DOUBLE) AS digit_fair, type_fair FROM ({sql[f'impute_{m}']})"
            for k, m in IMPUTE_NUMBERS.items()),
        "curate_by_numbers": " UNION ALL ".join(
            f"SELECT {k} AS method, * FROM ({verdicts(m, MESSY, 'em', MESSY_COLUMNS)} SELECT feature, outlier_verdict, n_outliers FROM verdicts)"
            for k, m in ((0, "zscore"), (2, "modified_z"), (3, "iqr"))),
        "written_report": f"""SELECT r.*, missing_values AS json_missing, state AS json_state, n AS n_curated, n AS n_clean, n AS n_read
FROM ({sql['evaluation_report']}) r, (SELECT count(*) AS n FROM events)""",
    }
    return sql
