"""Independent DuckDB SQL for each query key (same column names, same rounding).

Conventions: counts are BIGINT, doubles rounded like ``finalize`` (round to
6 decimals unless stated, then ``+ 0.0``), arrays flattened to strings.
"""

from __future__ import annotations

PROFILE_CTE = """
li_roll AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty_sum,
         avg(l_discount) + 0.0 AS disc_avg, avg(l_tax) + 0.0 AS tax_avg,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned_lines
  FROM lineitem GROUP BY l_orderkey),
order_profile AS (
  SELECT o_orderkey AS id, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y,
         o_orderstatus, c_mktsegment, n_name, r_name, o_totalprice, c_acctbal,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(qty_sum, 0) AS DOUBLE) AS qty_sum,
         CAST(coalesce(disc_avg, 0) AS DOUBLE) AS disc_avg,
         CAST(coalesce(tax_avg, 0) AS DOUBLE) AS tax_avg,
         CAST(coalesce(returned_lines, 0) AS BIGINT) AS returned_lines
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN li_roll ON o_orderkey = l_orderkey)"""

CATS = ["o_orderstatus", "c_mktsegment", "n_name", "r_name"]
NUMS = ["o_totalprice", "c_acctbal", "n_lines", "qty_sum", "disc_avg", "tax_avg", "returned_lines"]
PROFILE_COLS = ["id", "y"] + CATS + NUMS
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r(expr: str, d: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {d}) + 0.0)"


def with_profile(body: str, extra_ctes: str = "") -> str:
    ctes = PROFILE_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _long(table: str, cols, as_type: str, ids=(), val: str = "value") -> str:
    idl = "".join(f"{i}, " for i in ids)
    return _union([f"SELECT {idl}'{c}' AS variable, CAST({c} AS {as_type}) AS {val} FROM {table}"
                   for c in cols])


ORDER_RULES = [
    ("lines_per_order", "n_lines", 1, 7),
    ("discount_range", "disc_avg", 0.0, 0.10),
    ("tax_range", "tax_avg", 0.0, 0.08),
    ("quantity_range", "qty_sum", 1, 350),
    ("balance_range", "c_acctbal", -999.99, 9999.99),
    ("returned_within_lines", "returned_lines", 0, 7),
]


def oracle_catalog() -> dict[str, str]:
    o: dict[str, str] = {}
    o["null_report"] = with_profile(_union(
        [f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM order_profile"
         for c in PROFILE_COLS]
        + ["SELECT '(all columns)' AS column_name, CAST(" + " + ".join(
            f"count(*) FILTER (WHERE {c} IS NULL)" for c in PROFILE_COLS) + " AS BIGINT) AS n_null FROM order_profile"]))
    li_cols = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 0.0, l_extendedprice + 0.0, "
               "l_discount + 0.0, l_tax + 0.0, l_returnflag, l_linestatus, l_shipdate")
    o["duplicate_rows"] = f"""
      WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY {li_cols}),
           k AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
      SELECT CAST((SELECT sum(c) FROM g) AS BIGINT) AS n_rows,
             CAST((SELECT sum(c - 1) FROM g) AS BIGINT) AS n_duplicate_rows,
             CAST((SELECT sum(c - 1) FROM k) AS BIGINT) AS n_duplicate_keys"""
    o["key_uniqueness"] = _union([
        f"SELECT '{t}' AS table_name, '{kc}' AS key_cols, CAST(count(*) AS BIGINT) AS n_rows, "
        f"CAST((SELECT count(*) FROM (SELECT DISTINCT {kc} FROM {t})) AS BIGINT) AS n_distinct, "
        f"count(*) = (SELECT count(*) FROM (SELECT DISTINCT {kc} FROM {t})) AS is_unique FROM {t}"
        for t, kc in [("orders", "o_orderkey"), ("customer", "c_custkey"),
                      ("lineitem", "l_orderkey,l_linenumber")]])
    o["schema_report"] = """
      WITH d AS (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name,
                        CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                             WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string'
                             WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                             ELSE lower(column_type) END AS data_type
                 FROM (DESCRIBE SELECT * FROM orders))
      SELECT position, column_name, data_type,
             CASE WHEN data_type IN ('string', 'boolean') THEN 'categorical'
                  WHEN data_type IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') THEN 'numeric'
                  ELSE 'other' END AS kind,
             CAST((SELECT count(*) FROM orders) AS BIGINT) AS n_rows
      FROM d"""
    o["cardinality"] = with_profile(_union(
        [f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM order_profile"
         for c in PROFILE_COLS]))
    li_all = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    o["constant_columns"] = "SELECT * FROM (" + _union(
        [f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM lineitem"
         for c in li_all]) + ") WHERE n_distinct = 1"
    o["constant_columns_urgent"] = with_profile("SELECT * FROM (" + _union(
        [f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM order_profile WHERE y = 1"
         for c in PROFILE_COLS]) + ") WHERE n_distinct = 1")
    o["modelling_columns"] = with_profile(
        "SELECT y, " + ", ".join(c if c in ("n_lines", "returned_lines") else f"{r(c)} AS {c}" for c in NUMS) + " FROM order_profile")
    o["orders_csv"] = f"SELECT * REPLACE ({r('o_totalprice')} AS o_totalprice) FROM orders"
    o["freq_tables"] = with_profile(
        f"""SELECT variable, level, CAST(count(*) AS BIGINT) AS n,
                   {r('count(*) / sum(count(*)) OVER (PARTITION BY variable)')} AS prop
            FROM ({_long('order_profile', CATS, 'VARCHAR', val='level')}) GROUP BY variable, level""")
    o["numeric_summary"] = with_profile(
        f"""SELECT variable, {r('min(value)')} AS min, {r('quantile_cont(value, 0.25)')} AS q1,
                   {r('quantile_cont(value, 0.5)')} AS median, {r('avg(value)')} AS mean,
                   {r('quantile_cont(value, 0.75)')} AS q3, {r('max(value)')} AS max
            FROM ({_long('order_profile', NUMS, 'DOUBLE')}) GROUP BY variable""")
    line_long = _long("lineitem", LINE_MEASURES, "DOUBLE")
    fences_cte = f"""
      lv AS ({line_long}),
      f AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
            FROM lv GROUP BY variable),
      fx AS (SELECT variable, q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)"""
    o["iqr_outliers"] = f"""WITH {fences_cte}
      SELECT variable, CAST(sum(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
             {r('round(sum(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END) * 100.0 / count(value), 1)')} AS pct_outliers
      FROM lv JOIN fx USING (variable) GROUP BY variable"""
    o["box_stats"] = f"""WITH {fences_cte}
      SELECT variable,
             {r('min(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_lo,
             {r('any_value(q1)')} AS q1, {r('quantile_cont(value, 0.5)')} AS median, {r('any_value(q3)')} AS q3,
             {r('max(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_hi,
             CAST(sum(CASE WHEN value >= lo AND value <= hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
      FROM lv JOIN fx USING (variable) GROUP BY variable"""
    o["range_violations"] = with_profile(_union(
        [f"SELECT '{n}' AS rule, '{c}' AS column_name, {r(str(float(lo)))} AS lo, {r(str(float(hi)))} AS hi, "
         f"CAST(sum(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 ELSE 0 END) AS BIGINT) AS n_violations FROM order_profile"
         for n, c, lo, hi in ORDER_RULES]))
    o["noise_screen"] = with_profile(_union(
        [f"SELECT '{c}' AS variable, {r(f'corr({c}, o_totalprice)')} AS cor_with_reference, "
         f"{r(f'corr({c}, y)')} AS cor_with_outcome FROM order_profile"
         for c in ["c_acctbal", "disc_avg", "tax_avg"]]))
    # ---------------------------------------------------------- aggregates
    means = [("avg_totalprice", "o_totalprice", 2), ("avg_acctbal", "c_acctbal", 2),
             ("avg_lines", "n_lines", 2), ("avg_qty", "qty_sum", 2), ("avg_discount", "disc_avg", 4),
             ("avg_tax", "tax_avg", 4), ("avg_returned", "returned_lines", 2)]
    o["outcome_profile"] = with_profile(
        "SELECT y, CAST(count(*) AS BIGINT) AS n, "
        + ", ".join(f"{r(f'round(avg({c}), {d})')} AS {n}" for n, c, d in means)
        + f", {r('round(avg(CASE WHEN o_orderstatus = ' + chr(39) + 'O' + chr(39) + ' THEN 1.0 ELSE 0.0 END) * 100.0, 1)')} AS pct_open"
        + " FROM order_profile GROUP BY y")
    cat_long_y = _long("order_profile", CATS, "VARCHAR", ids=["y"], val="level")
    o["rate_by_category"] = with_profile(
        f"SELECT variable, level, CAST(count(*) AS BIGINT) AS n, {r('avg(y)')} AS rate, "
        f"CAST(row_number() OVER (PARTITION BY variable ORDER BY avg(y) DESC, level) AS INTEGER) AS ord "
        f"FROM ({cat_long_y}) GROUP BY variable, level")
    o["rate_with_reference"] = with_profile(
        f"""SELECT variable, level, CAST(count(*) AS BIGINT) AS n, {r('avg(y)')} AS rate,
                   CAST(row_number() OVER (PARTITION BY variable ORDER BY avg(y) DESC, level) AS INTEGER) AS ord,
                   {r('(SELECT avg(y) FROM order_profile)')} AS overall_rate,
                   {r('avg(y) / (SELECT avg(y) FROM order_profile)')} AS lift
            FROM ({cat_long_y}) GROUP BY variable, level""")
    o["category_share"] = with_profile(
        f"""SELECT variable, level, y, CAST(count(*) AS BIGINT) AS n,
                   {r('count(*) / sum(count(*)) OVER (PARTITION BY variable, level)')} AS share
            FROM ({cat_long_y}) GROUP BY variable, level, y""")
    o["likert_share"] = with_profile(
        f"""SELECT variable, y, value, CAST(count(*) AS BIGINT) AS n,
                   {r('count(*) / sum(count(*)) OVER (PARTITION BY variable, y)')} AS share
            FROM ({_long('order_profile', ['n_lines', 'returned_lines'], 'BIGINT', ids=['y'])})
            GROUP BY variable, y, value""")
    o["grand_share"] = with_profile(
        f"SELECT y, CAST(count(*) AS BIGINT) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share "
        "FROM order_profile GROUP BY y")
    o["event_share"] = f"""
      SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, event_type, CAST(count(*) AS BIGINT) AS n,
             {r('count(*) / sum(count(*)) OVER (PARTITION BY dayofweek(ts))')} AS share
      FROM events GROUP BY dayofweek(ts), event_type"""
    o["contingency_dense"] = """
      WITH a AS (SELECT DISTINCT l_returnflag FROM lineitem), b AS (SELECT DISTINCT l_linestatus FROM lineitem),
           c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
      SELECT a.l_returnflag, b.l_linestatus, CAST(coalesce(c.n, 0) AS BIGINT) AS n
      FROM a CROSS JOIN b LEFT JOIN c ON a.l_returnflag = c.l_returnflag AND b.l_linestatus = c.l_linestatus"""
    rules = [("status_open", "o_orderstatus = 'O'"), ("segment_building", "c_mktsegment = 'BUILDING'"),
             ("few_lines", "n_lines <= 2"), ("no_discount", "disc_avg <= 0.02"),
             ("any_returned", "returned_lines >= 1"), ("negative_balance", "c_acctbal < 0")]
    o["population_rates"] = with_profile(_union(
        [f"SELECT '{n}' AS rule, {r(f'avg(CASE WHEN {c} THEN y END)')} AS rate, "
         f"CAST(count(CASE WHEN {c} THEN 1 END) AS BIGINT) AS n FROM order_profile" for n, c in rules]))

    def cut(col, breaks, labels):
        parts = []
        for lo, hi, lab in zip(breaks[:-1], breaks[1:], labels):
            if hi == float("inf"):
                parts.append(f"WHEN {col} > {lo} THEN '{lab}'")
            else:
                parts.append(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'")
        return "CASE " + " ".join(parts) + " END"

    price = cut("o_totalprice", [0, 50000, 100000, 200000, 300000, 400000],
                ["<=50K", "50-100K", "100-200K", "200-300K", "300-400K"])
    bal = cut("c_acctbal", [-1000, 0, 2500, 5000, 10000], ["negative", "0-2.5K", "2.5-5K", "5-10K"])
    o["binned_rate"] = with_profile(
        f"""SELECT variable, bin, CAST(count(*) AS BIGINT) AS n, {r('round(avg(y) * 100.0, 1)')} AS rate_pct
            FROM (SELECT 'o_totalprice' AS variable, {price} AS bin, y FROM order_profile
                  UNION ALL SELECT 'c_acctbal', {bal}, y FROM order_profile) GROUP BY variable, bin""")
    ten = cut("n_lines", [-1, 1, 2, 5, 10, 20, float("inf")], ["0-1", "1-2", "2-5", "5-10", "10-20", "20+"])
    o["tenure_curve"] = with_profile(
        f"SELECT {ten} AS tenure_bin, {r('avg(y)')} AS rate, CAST(count(*) AS BIGINT) AS n "
        f"FROM order_profile GROUP BY 1")
    cohort_where = "c_mktsegment = 'BUILDING' AND o_totalprice >= 50000.0 AND o_totalprice <= 300000.0"
    o["cohort_kpis"] = with_profile(
        f"SELECT CAST(count(*) AS BIGINT) AS n, {r('avg(y)')} AS rate, {r('avg(o_totalprice)')} AS avg_totalprice, "
        f"{r('avg(c_acctbal)')} AS avg_acctbal FROM order_profile WHERE {cohort_where}")
    o["cohort_summary"] = with_profile(f"""
      SELECT n, n_positive, n_total, {r('rate_pct')} AS rate_pct, is_filtered,
             CAST(n AS VARCHAR) || ' rows, ' || CAST(n_positive AS VARCHAR) || ' positive (' ||
             coalesce(CAST(rate_pct AS VARCHAR), 'NA') || '%)' ||
             CASE WHEN is_filtered THEN ' - filtered view ' || CAST(n AS VARCHAR) || ' of ' || CAST(n_total AS VARCHAR)
                  ELSE '' END AS summary
      FROM (SELECT n, n_positive, n_total, round(n_positive * 100.0 / n, 1) AS rate_pct, n < n_total AS is_filtered
            FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS n_positive,
                         CAST((SELECT count(*) FROM order_profile) AS BIGINT) AS n_total
                  FROM order_profile WHERE {cohort_where}))""")
    o["group_median_flag"] = f"""
      WITH m AS (SELECT p_type, quantile_cont(p_retailprice, 0.5) AS med FROM part GROUP BY p_type)
      SELECT p_type, {r('med')} AS median_p_retailprice, CAST(count(*) AS BIGINT) AS n,
             CAST(sum(CASE WHEN p_retailprice < 0.8 * med THEN 1 ELSE 0 END) AS BIGINT) AS n_below
      FROM part JOIN m USING (p_type) GROUP BY p_type, med"""
    o["group_bands"] = """
      SELECT p_type, CAST(floor(min(p_retailprice) * 0.8) AS BIGINT) AS band_lo,
             CAST(ceil(max(p_retailprice) * 1.2) AS BIGINT) AS band_hi FROM part GROUP BY p_type"""
    o["values_per_group"] = """
      SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS "values",
             CAST(count(DISTINCT n_name) AS BIGINT) AS n_values
      FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
    o["group_value_rows"] = """
      SELECT p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS INTEGER) AS position
      FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_type IS NOT NULL)"""
    # ---------------------------------------------------------- statistics
    pairs = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1:]]
    corr_long = _union(
        [f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS c FROM order_profile" for a, b in pairs])
    o["pearson_long"] = with_profile(
        f"""SELECT var1, var2, {r('c')} AS correlation FROM up
            UNION ALL SELECT var2, var1, {r('c')} FROM up
            UNION ALL SELECT v, v, 1.0 FROM (VALUES {', '.join(f"('{c}')" for c in NUMS)}) t(v)""",
        f"up AS ({corr_long})")
    o["strong_pairs"] = with_profile(
        f"""SELECT least(var1, var2) AS var1, greatest(var1, var2) AS var2, {r('c')} AS correlation,
                   least(var1, var2) || ' — ' || greatest(var1, var2) AS pair
            FROM up WHERE abs(c) >= 0.70""",
        f"up AS ({corr_long})")
    o["pb_ranking"] = with_profile(_union(
        [f"SELECT '{c}' AS variable, {r(f'corr({c}, y)')} AS r_pb, {r(f'abs(corr({c}, y))')} AS abs_r FROM order_profile"
         for c in NUMS]))
    o["metric_reread"] = f"SELECT replace(variable, '_', ' ') AS variable, r_pb, abs_r FROM ({o['pb_ranking']})"
    o["chi_square"] = _chi_square_sql(cat_long_y)
    o["chi_square_asymptotic"] = _chi_square_tail_sql(cat_long_y)
    o["mc_statistic"] = f"SELECT variable, chi_sq FROM ({_chi_square_sql(cat_long_y)})"
    ctes, body = _histogram_sql("lineitem", "l_extendedprice", None)
    o["histogram"] = f"WITH {ctes}\n{body}"
    ctes, body = _histogram_sql("order_profile", "o_totalprice", "y")
    o["histogram_by_outcome"] = with_profile(body, ctes)
    o["scatter_bins"] = with_profile("""
      SELECT CAST(least(floor((o_totalprice - xa) / ((xb - xa) / 20)), 19) AS INTEGER) AS x_bin,
             CAST(least(floor((qty_sum - ya) / ((yb - ya) / 20)), 19) AS INTEGER) AS y_bin, y,
             CAST(count(*) AS BIGINT) AS n
      FROM order_profile, e GROUP BY ALL""",
        "e AS (SELECT min(o_totalprice) AS xa, max(o_totalprice) AS xb, min(qty_sum) AS ya, max(qty_sum) AS yb FROM order_profile)")
    o["kde"] = """
      WITH st AS (SELECT c_mktsegment, count(*) AS n, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS lo,
                         max(c_acctbal) AS hi,
                         quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr
                  FROM customer GROUP BY c_mktsegment),
           bw AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw, (hi - lo) / 63.0 AS step FROM st),
           g AS (SELECT c_mktsegment, n, bw, CAST(p AS INTEGER) AS point, lo + p * step AS x
                 FROM bw, range(0, 64) t(p))
      SELECT g.c_mktsegment, point, round(any_value(x), 4) + 0.0 AS x,
             round(sum(exp(-0.5 * ((x - c_acctbal) / bw) ^ 2) / (n * bw * sqrt(2 * pi()))) * 1e6, 6) + 0.0 AS density_e6
      FROM g JOIN customer c ON g.c_mktsegment = c.c_mktsegment
      GROUP BY g.c_mktsegment, point"""
    o.update(ml_oracles())
    o.update(feature_oracles())
    o.update(decision_oracles())
    return o


def _chi_square_cte(cat_long_y: str) -> str:
    return f"""lv AS ({cat_long_y}),
        cells AS (SELECT variable, level, count(*) AS row_n,
                         count(CASE WHEN y = 0 THEN 1 END) AS o0, count(CASE WHEN y = 1 THEN 1 END) AS o1
                  FROM lv GROUP BY variable, level),
        cls AS (SELECT variable, count(*) AS n, count(CASE WHEN y = 0 THEN 1 END) AS c0,
                       count(CASE WHEN y = 1 THEN 1 END) AS c1 FROM lv GROUP BY variable),
        t AS (SELECT variable, n, c0, c1,
                     CASE WHEN row_n * c0 / n > 0 THEN (o0 - row_n * c0 / n) * (o0 - row_n * c0 / n) / (row_n * c0 / n) ELSE 0 END +
                     CASE WHEN row_n * c1 / n > 0 THEN (o1 - row_n * c1 / n) * (o1 - row_n * c1 / n) / (row_n * c1 / n) ELSE 0 END AS term
              FROM cells JOIN cls USING (variable)),
        a AS (SELECT variable, n, sum(term) AS chi_sq, count(*) AS n_levels,
                     max(CASE WHEN c0 > 0 THEN 1 ELSE 0 END + CASE WHEN c1 > 0 THEN 1 ELSE 0 END) AS n_classes
              FROM t GROUP BY variable, n)"""


def _chi_square_tail_sql(cat_long_y: str) -> str:
    """Statistic, dof and upper tail 1 - P(dof / 2, chi_sq / 2), P by its power series."""
    extra = _chi_square_cte(cat_long_y) + """,
        h AS (SELECT variable, chi_sq, (n_levels - 1) * (n_classes - 1) AS dof, chi_sq / 2 AS x,
                     (n_levels - 1) * (n_classes - 1) / 2.0 AS a FROM a),
        p AS (SELECT variable, sum(CASE WHEN x > 0 THEN exp((a + k) * ln(x) - x - lgamma(a + k + 1)) ELSE 0 END) AS lower
              FROM h, range(0, 400) AS g(k) GROUP BY variable)"""
    return with_profile(f"""
      SELECT variable, {r('chi_sq')} AS chi_sq, CAST(dof AS INTEGER) AS dof, {r('1 - lower')} AS p_value
      FROM h JOIN p USING (variable)""", extra)


def _chi_square_sql(cat_long_y: str) -> str:
    extra = _chi_square_cte(cat_long_y)
    return with_profile(f"""
      SELECT variable, {r('chi_sq', 4)} AS chi_sq, CAST((n_levels - 1) * (n_classes - 1) AS BIGINT) AS dof,
             CAST(n AS BIGINT) AS n,
             {r('round(sqrt(chi_sq / (n * (least(n_levels, n_classes) - 1))), 3)', 4)} AS cramers_v
      FROM a""", extra)


def _histogram_sql(table: str, col: str, by: str | None) -> tuple[str, str]:
    bins = 30
    edges = f"e AS (SELECT min(CAST({col} AS DOUBLE)) AS mn, max(CAST({col} AS DOUBLE)) AS mx FROM {table})"
    idx = f"CAST(least(floor(({col} - mn) / ((mx - mn) / {bins})), {bins - 1}) AS INTEGER)"
    lo = r(f"mn + grid.bin * ((mx - mn) / {bins})", 4)
    hi = r(f"mn + (grid.bin + 1) * ((mx - mn) / {bins})", 4)
    if by:
        counts = f"c AS (SELECT {idx} AS bin, {by}, count(*) AS n FROM {table}, e GROUP BY ALL)"
        grid = f"grid AS (SELECT DISTINCT {by}, CAST(b AS INTEGER) AS bin FROM {table}, range(0, {bins}) t(b))"
        body = f"""SELECT grid.bin, grid.{by}, {lo} AS bin_lo, {hi} AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
              FROM grid CROSS JOIN e LEFT JOIN c ON grid.bin = c.bin AND grid.{by} = c.{by}"""
    else:
        counts = f"c AS (SELECT {idx} AS bin, count(*) AS n FROM {table}, e GROUP BY ALL)"
        grid = f"grid AS (SELECT CAST(b AS INTEGER) AS bin FROM range(0, {bins}) t(b))"
        body = f"""SELECT grid.bin, {lo} AS bin_lo, {hi} AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
              FROM grid CROSS JOIN e LEFT JOIN c ON grid.bin = c.bin"""
    return f"{edges}, {counts}, {grid}", body


# ------------------------------------------------------------------ splits, evaluation
ORDERS_Y = "oy AS (SELECT o_orderkey AS id, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y FROM orders)"
SPLIT_RANK = """sr AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1 AS rk,
                   count(*) OVER (PARTITION BY y) AS n FROM oy)"""


def _folds_cte(src: str, seed: int, name: str = "fo") -> str:
    return f"""{name}_rep AS (SELECT id, y, CAST(rp AS INTEGER) AS rep FROM {src}, range(1, 4) t(rp)),
      {name} AS (SELECT id, y, rep AS "repeat",
                   CAST((row_number() OVER (PARTITION BY rep, y ORDER BY md5('{seed}:' || CAST(rep AS VARCHAR) || ':' || CAST(id AS VARCHAR)), id) - 1) % 5 + 1 AS INTEGER) AS fold
                 FROM {name}_rep)"""


DOC_SCORES = """ds AS (
  SELECT m.model, d.doc_id AS id, l.toxic AS y,
         CASE m.model
           WHEN 'length' THEN CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2500.0)
           WHEN 'brevity' THEN 2500.0 / (CAST(d.n_chars AS DOUBLE) + 2500.0)
           ELSE CAST(len(string_split(d.text, ' ')) AS DOUBLE) / (CAST(len(string_split(d.text, ' ')) AS DOUBLE) + 400.0)
         END AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES ('length'), ('brevity'), ('words')) m(model))"""


def _cum_cte(src: str, keys: str) -> str:
    return f"""cl AS (SELECT {keys}, score, sum(y) AS n1, sum(1 - y) AS n0 FROM {src} GROUP BY {keys}, score),
      tot AS (SELECT {keys}, sum(y) AS P, sum(1 - y) AS N FROM {src} GROUP BY {keys}),
      cc AS (SELECT cl.*, P, N,
               sum(n1) OVER (PARTITION BY {', '.join('cl.' + k.strip() for k in keys.split(','))} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum1,
               sum(n0) OVER (PARTITION BY {', '.join('cl.' + k.strip() for k in keys.split(','))} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum0
             FROM cl JOIN tot USING ({keys}))"""


def _auc_cte(keys: str) -> str:
    return f"""auc AS (SELECT {keys}, sum(n1 * (N - cum0 + 0.5 * n0)) / (any_value(P) * any_value(N)) AS roc_auc
                FROM cc GROUP BY {keys})"""


SWEEP = """g AS (SELECT CAST(k AS DOUBLE) / 100.0 AS threshold FROM range(5, 96) t(k)),
      tc AS (SELECT model, threshold,
                    sum(CASE WHEN y = 1 AND score >= threshold THEN 1 ELSE 0 END) AS tp,
                    sum(CASE WHEN y = 0 AND score >= threshold THEN 1 ELSE 0 END) AS fp,
                    sum(CASE WHEN y = 1 AND score < threshold THEN 1 ELSE 0 END) AS fn,
                    sum(CASE WHEN y = 0 AND score < threshold THEN 1 ELSE 0 END) AS tn
             FROM ds CROSS JOIN g GROUP BY model, threshold),
      sw AS (SELECT model, threshold, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity FROM tc),
      swj AS (SELECT *, sensitivity + specificity - 1 AS j_index,
                     (1 - sensitivity) ^ 2 + (1 - specificity) ^ 2 AS distance FROM sw),
      bt AS (SELECT model, min(threshold) FILTER (WHERE j_index = mj) AS threshold, any_value(mj) AS j_index
             FROM (SELECT *, max(j_index) OVER (PARTITION BY model) AS mj FROM swj) GROUP BY model)"""

COUNTS_AT = """ct AS (SELECT ds.model, bt.threshold,
                    CAST(sum(CASE WHEN score >= bt.threshold AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
                    CAST(sum(CASE WHEN score >= bt.threshold AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
                    CAST(sum(CASE WHEN score < bt.threshold AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FN,
                    CAST(sum(CASE WHEN score < bt.threshold AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN
             FROM ds JOIN bt ON ds.model = bt.model GROUP BY ds.model, bt.threshold)"""


def _metric_cols(src: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST(TP + TN AS DOUBLE) / (TP + FP + FN + TN) AS accuracy,
                   CASE WHEN TP + FN > 0 THEN CAST(TP AS DOUBLE) / (TP + FN) END AS sensitivity,
                   CASE WHEN TN + FP > 0 THEN CAST(TN AS DOUBLE) / (TN + FP) END AS specificity,
                   CASE WHEN TP + FP > 0 THEN CAST(TP AS DOUBLE) / (TP + FP) END AS precision
            FROM {src}"""


def _with_f1(src: str, keys: str) -> str:
    return f"""SELECT {keys}, accuracy, sensitivity, specificity, precision,
                   CASE WHEN precision + sensitivity > 0 THEN 2 * precision * sensitivity / (precision + sensitivity) END AS f_meas
            FROM ({_metric_cols(src, keys)})"""


METRICS6 = ["accuracy", "sensitivity", "specificity", "precision", "f_meas", "roc_auc"]


def _long_metrics(src: str, keys: str, names=METRICS6, rnd: int = 6) -> str:
    return _union([f"SELECT {keys}, '{m}' AS metric, {r(m, rnd)} AS estimate FROM {src}" for m in names])


FRIENDLY_SQL = """CASE metric WHEN 'accuracy' THEN 'Accuracy' WHEN 'sensitivity' THEN 'Sensitivity (Recall)'
      WHEN 'specificity' THEN 'Specificity' WHEN 'precision' THEN 'Precision' WHEN 'f_meas' THEN 'F1 Score'
      WHEN 'roc_auc' THEN 'ROC AUC' WHEN 'j_index' THEN 'Youden J' WHEN 'distance' THEN 'Distance to corner'
      ELSE metric END"""


def ml_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["stratified_split"] = f"""WITH {ORDERS_Y}, {SPLIT_RANK}
      SELECT id, y, CASE WHEN rk < floor(n * 7 / 10) THEN 'train' ELSE 'test' END AS split FROM sr"""
    o["folds"] = f"""WITH {ORDERS_Y}, {SPLIT_RANK},
      tr AS (SELECT id, y FROM sr WHERE rk < floor(n * 7 / 10)), {_folds_cte('tr', 42)}
      SELECT id, y, "repeat", fold FROM fo"""
    grids = [("logistic", 1), ("decision_tree", 16), ("random_forest", 16), ("gradient_boosting", 20), ("mlp", 9)]
    run_grids = [("logistic", 1), ("decision_tree", 16), ("random_forest", 2), ("gradient_boosting", 2), ("mlp", 9)]

    def grid(rows):
        return "g AS (SELECT model, unnest(range(n))::INTEGER AS config FROM (VALUES " + ", ".join(
            f"('{m}', {n})" for m, n in rows) + ") t(model, n))"
    o["fit_plan"] = f"""WITH {ORDERS_Y}, {SPLIT_RANK},
      tr AS (SELECT id, y FROM sr WHERE rk < floor(n * 7 / 10)), {_folds_cte('tr', 42)}, {grid(grids)},
      s AS (SELECT "repeat", fold, count(*) AS n_assess, (SELECT count(*) FROM tr) - count(*) AS n_analysis
            FROM fo GROUP BY 1, 2)
      SELECT model, config, "repeat", fold, n_analysis, n_assess FROM g CROSS JOIN s"""
    o["fit_ledger"] = f"""WITH {ORDERS_Y}, {SPLIT_RANK},
      tr AS (SELECT id, y FROM sr WHERE rk < floor(n * 7 / 10)), {_folds_cte('tr', 42)}, {grid(run_grids)}
      SELECT model, config, "repeat", fold, 'done' AS state FROM g
      CROSS JOIN (SELECT DISTINCT "repeat", fold FROM fo)"""
    o["roc_curve"] = f"""WITH {DOC_SCORES}, {_cum_cte('ds', 'model')}
      SELECT model, {r('score')} AS threshold, {r('cum1 / P')} AS tpr, {r('cum0 / N')} AS fpr FROM cc
      UNION ALL SELECT DISTINCT model, NULL, 0.0, 0.0 FROM ds"""
    o["pr_curve"] = f"""WITH {DOC_SCORES}, {_cum_cte('ds', 'model')}
      SELECT model, {r('score')} AS threshold, {r('cum1 / P')} AS recall, {r('cum1 / (cum1 + cum0)')} AS precision FROM cc
      UNION ALL SELECT DISTINCT model, NULL, 0.0, 1.0 FROM ds"""
    o["pr_baseline"] = f"""WITH {DOC_SCORES}
      SELECT model, {r('avg(y)')} AS prevalence FROM ds GROUP BY model"""
    o["auc"] = f"""WITH {DOC_SCORES}, {_cum_cte('ds', 'model')}, {_auc_cte('model')}
      SELECT model, {r('roc_auc')} AS roc_auc FROM auc"""
    o["threshold_sweep"] = f"""WITH {DOC_SCORES}, {SWEEP}
      SELECT model, {r('threshold')} AS threshold, metric, {r('estimate')} AS estimate FROM (
        SELECT model, threshold, 'j_index' AS metric, j_index AS estimate FROM swj
        UNION ALL SELECT model, threshold, 'sensitivity', sensitivity FROM swj
        UNION ALL SELECT model, threshold, 'specificity', specificity FROM swj
        UNION ALL SELECT model, threshold, 'distance', distance FROM swj)"""
    o["best_threshold"] = f"""WITH {DOC_SCORES}, {SWEEP}
      SELECT model, {r('threshold')} AS threshold, {r('j_index')} AS j_index FROM bt"""
    o["confusion"] = f"""WITH {DOC_SCORES}, {SWEEP}, {COUNTS_AT}
      SELECT model, {r('threshold')} AS threshold, cell, n,
             CASE WHEN cell IN ('TP', 'FP') THEN 1 ELSE 0 END AS predicted,
             CASE WHEN cell IN ('TP', 'FN') THEN 1 ELSE 0 END AS actual,
             CASE cell WHEN 'TP' THEN 'caught' WHEN 'FP' THEN 'false alarm' WHEN 'FN' THEN 'missed (costly)'
                       ELSE 'correctly cleared' END AS reading
      FROM (SELECT model, threshold, 'TP' AS cell, TP AS n FROM ct UNION ALL SELECT model, threshold, 'FP', FP FROM ct
            UNION ALL SELECT model, threshold, 'FN', FN FROM ct UNION ALL SELECT model, threshold, 'TN', TN FROM ct)"""
    metrics_at_cte = f"""{DOC_SCORES}, {SWEEP}, {COUNTS_AT}, {_cum_cte('ds', 'model')}, {_auc_cte('model')},
      mw AS (SELECT m.*, auc.roc_auc FROM ({_with_f1('ct', 'model, threshold')}) m JOIN auc USING (model))"""
    o["metrics_at"] = f"""WITH {metrics_at_cte}
      SELECT model, {r('threshold')} AS threshold, metric, estimate FROM ({_long_metrics('mw', 'model, threshold')})"""
    o["display_metrics"] = f"""WITH {metrics_at_cte}
      SELECT model, {r('threshold')} AS threshold, metric, {r('round(estimate, 3)')} AS estimate,
             {FRIENDLY_SQL} AS metric_name
      FROM ({_long_metrics('mw', 'model, threshold', rnd=12)})"""

    def pct(c):
        return f"coalesce(CAST(round({c} * 100.0, 1) AS VARCHAR), 'NA')"
    o["model_summary"] = f"""WITH {metrics_at_cte}
      SELECT model, {r('threshold')} AS threshold,
             'At threshold ' || CAST(threshold AS VARCHAR) || ' the model finds ' || {pct('sensitivity')} ||
             '% of positives, clears ' || {pct('specificity')} || '% of negatives; ' || {pct('precision')} ||
             '% of flagged rows are positive; ROC AUC ' || coalesce(CAST(round(roc_auc, 3) AS VARCHAR), 'NA') || '.' AS summary
      FROM mw"""
    fold_cte = f"""{DOC_SCORES}, lab AS (SELECT doc_id AS id, toxic AS y FROM labels), {_folds_cte('lab', 7)},
      fp AS (SELECT ds.model, fo."repeat", fo.fold, ds.id, ds.y, ds.score FROM ds JOIN fo ON ds.id = fo.id AND ds.y = fo.y
             AND fo."repeat" IS NOT NULL),
      fc AS (SELECT model, "repeat", fold,
                    CAST(sum(CASE WHEN score >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
                    CAST(sum(CASE WHEN score >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
                    CAST(sum(CASE WHEN score < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FN,
                    CAST(sum(CASE WHEN score < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN
             FROM fp GROUP BY model, "repeat", fold),
      {_cum_cte('fp', 'model, "repeat", fold')}, {_auc_cte('model, "repeat", fold')},
      fw AS (SELECT m.*, auc.roc_auc FROM ({_with_f1('fc', 'model, "repeat", fold')}) m
             JOIN auc USING (model, "repeat", fold)),
      fl AS (SELECT model, "repeat", fold, metric, estimate FROM ({_long_metrics('fw', 'model, "repeat", fold', rnd=15)})),
      mc AS (SELECT model, avg(estimate) AS mean, stddev_samp(estimate) / sqrt(count(estimate)) AS std_err,
                    CAST(count(estimate) AS BIGINT) AS n FROM fl WHERE metric = 'roc_auc' GROUP BY model)"""
    o["fold_metrics"] = f"""WITH {fold_cte}
      SELECT model, "repeat", fold, metric, {r('estimate')} AS estimate FROM fl"""
    o["model_compare"] = f"""WITH {fold_cte}
      SELECT model, {r('mean')} AS mean, {r('std_err')} AS std_err, n FROM mc"""
    o["metrics_wide"] = f"""WITH {fold_cte}
      SELECT model, """ + ", ".join(
        f"{r(f'avg(CASE WHEN metric = {chr(39)}{m}{chr(39)} THEN estimate END)')} AS {m}"
        for m in sorted(METRICS6)) + " FROM fl GROUP BY model"
    o["metric_mean_se"] = f"""WITH {fold_cte}
      SELECT model, metric, {r('avg(estimate)')} AS mean,
             {r('stddev_samp(estimate) / sqrt(count(estimate))')} AS std_err,
             CAST(count(estimate) AS BIGINT) AS n FROM fl GROUP BY model, metric"""
    o["rate_pivot"] = with_profile("SELECT r_name, " + ", ".join(
        f"{r(f'avg(CASE WHEN o_orderstatus = {chr(39)}{v}{chr(39)} THEN y END)')} AS {v}" for v in "FOP")
        + " FROM order_profile GROUP BY r_name")
    o["display_formats"] = """
      SELECT replace(n_name, '_', ' ') AS nation,
             format('{:.1f}%', avg(CASE WHEN c_acctbal < 0 THEN 1.0 WHEN c_acctbal >= 0 THEN 0.0 END) * 100.0) AS in_debt,
             format('{:,}', CAST(round(sum(c_acctbal)) AS BIGINT)) AS balance
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"""
    o["best_model"] = f"""WITH {fold_cte}
      SELECT model, {r('mean')} AS mean FROM mc ORDER BY mean DESC, model LIMIT 1"""
    o["roc_marker"] = f"""WITH {DOC_SCORES}, {SWEEP},
      pts AS (SELECT model, threshold, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr FROM tc
              UNION ALL SELECT DISTINCT model, NULL, 0.0, 0.0 FROM ds
              UNION ALL SELECT DISTINCT model, NULL, 1.0, 1.0 FROM ds)
      SELECT pts.model, {r('pts.threshold')} AS threshold, {r('tpr')} AS tpr, {r('fpr')} AS fpr,
             coalesce(pts.threshold = bt.threshold, false) AS is_operating_point
      FROM pts JOIN bt ON pts.model = bt.model"""
    return o


# ------------------------------------------------------------------ features, SMOTE
def feature_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["engineered_features"] = with_profile(f"""
      SELECT id, {r('(disc_avg + tax_avg) / 2.0')} AS avg_rate,
             {r('least(returned_lines / greatest(n_lines, 1), 1.0)')} AS returned_ratio,
             {r('qty_sum / greatest(n_lines, 1)')} AS qty_per_line,
             {r('o_totalprice / greatest(qty_sum, 1.0)')} AS price_per_qty
      FROM order_profile""")
    cols = [("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus"),
            ("l_linenumber", "l_linenumber"), ("l_quantity", "l_quantity + 0.0"),
            ("l_discount", "l_discount + 0.0"), ("l_tax", "l_tax + 0.0")]
    lv = _union([f"SELECT '{n}' AS variable, CAST({e} AS VARCHAR) AS value FROM lineitem" for n, e in cols])
    o["nzv_report"] = f"""
      WITH lv AS ({lv}),
        fr AS (SELECT variable, value, count(*) AS cnt FROM lv GROUP BY variable, value),
        tp AS (SELECT variable, max(cnt) AS m1, count(*) AS n_distinct, sum(cnt) AS n FROM fr GROUP BY variable),
        sc AS (SELECT fr.variable, sum(CASE WHEN cnt = m1 THEN 1 ELSE 0 END) AS n_top,
                      max(CASE WHEN cnt < m1 THEN cnt END) AS m2b FROM fr JOIN tp USING (variable) GROUP BY fr.variable),
        s AS (SELECT tp.variable, n_distinct, n, m1 / (CASE WHEN n_top >= 2 THEN m1 ELSE m2b END) AS freq_ratio,
                     n_distinct * 100.0 / n AS pct_unique FROM tp JOIN sc USING (variable))
      SELECT variable, CAST(n_distinct AS BIGINT) AS n_distinct, {r('freq_ratio')} AS freq_ratio,
             {r('pct_unique')} AS pct_unique,
             coalesce(n_distinct = 1 OR (freq_ratio > 19.0 AND pct_unique <= 10.0), false) AS nzv
      FROM s"""
    dummies = [("o_orderstatus", ["O", "P"]),
               ("c_mktsegment", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
               ("r_name", ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])]
    o["dummy_coding"] = with_profile("SELECT id, " + ", ".join(
        f"CAST({c} = '{lvl}' AS INTEGER) AS {c}_{lvl.replace(' ', '_')}" for c, lvls in dummies for lvl in lvls)
        + " FROM order_profile")
    o["normalize"] = with_profile("SELECT id, " + ", ".join(
        f"{r(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS {c}" for c in NUMS)
        + " FROM order_profile")
    neighbours = """m AS (SELECT vec_id, embedding FROM embeddings WHERE label = 0),
        d AS (SELECT a.vec_id, b.vec_id AS nn_id,
                     sqrt(list_sum(list_transform(range(1, 65),
                          lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ^ 2))) AS distance
              FROM m a JOIN m b ON a.vec_id <> b.vec_id),
        rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nn_id) AS nn_rank FROM d)"""
    o["smote_neighbours"] = f"""WITH {neighbours}
      SELECT vec_id, CAST(nn_rank AS INTEGER) AS nn_rank, nn_id, {r('distance')} AS distance FROM rk WHERE nn_rank <= 5"""

    def uniform(tag: str) -> str:
        return f"CAST(('0x' || substr(md5('42:' || vec_id || ':' || copy || ':{tag}'), 1, 8)) AS BIGINT) / 4294967296.0"
    components = ", ".join(r(f"CAST(a.embedding[{i}] AS DOUBLE) + gap * (CAST(b.embedding[{i}] AS DOUBLE) "
                             f"- CAST(a.embedding[{i}] AS DOUBLE))") + f" AS x{i}" for i in range(1, 65))
    o["smote_rows"] = f"""WITH {neighbours},
        c AS (SELECT count(CASE WHEN label = 0 THEN 1 END) AS n_min, count(CASE WHEN label <> 0 THEN 1 END) AS n_maj
              FROM embeddings),
        w AS (SELECT n_min, greatest(CAST(floor(n_maj * 0.8) AS BIGINT) - n_min, 0) AS need FROM c),
        p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rho FROM m),
        y AS (SELECT vec_id, n_min, unnest(range(1, need // n_min + CASE WHEN rho < need % n_min THEN 1 ELSE 0 END + 1)) AS copy
              FROM p, w),
        z AS (SELECT vec_id, copy, {uniform('gap')} AS gap,
                     CAST(floor({uniform('nn')} * least(5, n_min - 1)) AS BIGINT) + 1 AS nn_rank FROM y)
      SELECT 'syn-' || z.vec_id || '-' || copy AS synthetic_id, z.vec_id AS parent_id, nn_id, {r('gap')} AS gap,
             CAST(1 AS INTEGER) AS y, {components}
      FROM z JOIN rk USING (vec_id, nn_rank) JOIN m a USING (vec_id) JOIN m b ON nn_id = b.vec_id"""
    return o


# ------------------------------------------------------------------ decision support
_COEF = [("o_totalprice", 0.10), ("c_acctbal", -0.05), ("n_lines", 0.20), ("qty_sum", 0.15),
         ("disc_avg", -0.10), ("tax_avg", 0.05), ("returned_lines", 0.25)]


def _score_expr() -> str:
    eta = "-1.4"
    for c, b in _COEF:
        eta = f"({eta} + {b} * (({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()))"
    eta = f"({eta} + CASE WHEN o_orderstatus = 'O' THEN 0.3 ELSE 0.0 END)"
    return f"1.0 / (1.0 + exp(-{eta}))"


SCORED = f"scored AS (SELECT *, {_score_expr()} AS score FROM order_profile)"
SCORE_SWEEP = """g AS (SELECT CAST(k AS DOUBLE) / 100.0 AS threshold FROM range(5, 96) t(k)),
      tc AS (SELECT threshold,
                    sum(CASE WHEN y = 1 AND score >= threshold THEN 1 ELSE 0 END) AS tp,
                    sum(CASE WHEN y = 0 AND score >= threshold THEN 1 ELSE 0 END) AS fp,
                    sum(CASE WHEN y = 1 AND score < threshold THEN 1 ELSE 0 END) AS fn,
                    sum(CASE WHEN y = 0 AND score < threshold THEN 1 ELSE 0 END) AS tn
             FROM scored CROSS JOIN g GROUP BY threshold),
      sj AS (SELECT threshold, tp / (tp + fn) + tn / (tn + fp) - 1 AS j FROM tc),
      bt AS (SELECT min(threshold) AS threshold FROM sj WHERE j = (SELECT max(j) FROM sj)),
      tiered AS (SELECT s.*, bt.threshold,
                        CASE WHEN score >= 0.6 THEN 'High' WHEN score >= bt.threshold THEN 'Medium' ELSE 'Low' END AS tier
                 FROM scored s CROSS JOIN bt)"""

_RATES = {"open": "o_orderstatus = 'O'", "not_open": "o_orderstatus <> 'O'", "building": "c_mktsegment = 'BUILDING'",
          "few_lines": "n_lines <= 2", "low_disc": "disc_avg <= 0.02", "low_tax": "tax_avg <= 0.02",
          "zero_ret": "returned_lines = 0", "asia": "r_name = 'ASIA'", "low_qty": "qty_sum <= 50"}


def _pct0(name: str) -> str:
    return f"CAST(CAST(round(st.{name} * 100.0) AS BIGINT) AS VARCHAR)"


_RULES_SQL = [
    ("OpenStatus", "high", "o_orderstatus = 'O'", "'Open order'",
     f"{_pct0('open')} || '% urgent vs ' || {_pct0('not_open')} || '% otherwise'"),
    ("Segment", "medium", "c_mktsegment = 'BUILDING'", "'Building segment'",
     f"{_pct0('building')} || '% urgent in this segment'"),
    ("FewLines", "high", "n_lines <= 2", "'Few lines (' || CAST(n_lines AS VARCHAR) || '/7)'",
     f"{_pct0('few_lines')} || '% urgent when lines <= 2'"),
    ("LowDiscount", "high", "disc_avg <= 0.02", "'Low discount'", f"{_pct0('low_disc')} || '% urgent when discount <= 2%'"),
    ("LowTax", "high", "tax_avg <= 0.02", "'Low tax'", f"{_pct0('low_tax')} || '% urgent when tax <= 2%'"),
    ("LowPrice", "high", "o_totalprice < med * 0.8", "'Below-median price for region ' || p.r_name",
     "'$' || format('{:,}', CAST(round(o_totalprice) AS BIGINT)) || ' vs median $' || format('{:,}', CAST(round(med) AS BIGINT))"),
    ("ManyReturns", "medium", "returned_lines >= 2 AND n_lines >= 5",
     "CAST(returned_lines AS VARCHAR) || ' returned lines'", "'Repeated returns on large orders'"),
    ("SmallAccount", "medium", "c_acctbal <= 1000 AND n_lines <= 2", "'Small account, small order'",
     "'Low-balance customers with small orders'"),
    ("NoReturns", "medium", "returned_lines = 0", "'No returned lines'", f"{_pct0('zero_ret')} || '% urgent with no returns'"),
    ("Asia", "medium", "p.r_name = 'ASIA'", "'Ships to ASIA'", f"{_pct0('asia')} || '% urgent for ASIA'"),
    ("LowQuantity", "medium", "qty_sum <= 50", "'Low quantity (' || CAST(CAST(qty_sum AS BIGINT) AS VARCHAR) || ')'",
     f"{_pct0('low_qty')} || '% urgent when quantity <= 50'"),
]
_ACTIONS_SQL = [(["OpenStatus"], "clock"), (["FewLines", "LowDiscount"], "tag"), (["LowTax"], "file"),
                (["LowPrice"], "dollar-sign"), (["ManyReturns"], "undo"), (["SmallAccount"], "user"),
                (["NoReturns"], "check"), (["Asia"], "ship"), (["LowQuantity"], "boxes")]

STATS = ("st AS (SELECT " + ", ".join(f"avg(CASE WHEN {c} THEN CAST(y AS DOUBLE) END) AS {n}" for n, c in _RATES.items())
             + " FROM order_profile),\n      md AS (SELECT r_name, quantile_cont(o_totalprice, 0.5) AS med FROM order_profile GROUP BY r_name)")


def _hits(profiles: str) -> str:
    return ("hits AS (SELECT p.*, " + ", ".join(
                 f"CASE WHEN {pred} THEN '{k}' END AS h{i}, CASE WHEN {pred} THEN '{sev}' END AS s{i}, "
                 f"CASE WHEN {pred} THEN {lab} || ': ' || {det} END AS d{i}"
                 for i, (k, sev, pred, lab, det) in enumerate(_RULES_SQL))
            + f" FROM {profiles} p JOIN md ON p.r_name = md.r_name CROSS JOIN st)")


EXPLAINED = STATS + ",\n" + _hits("order_profile")

# D6 on the order profile: every limit reads the inputs already clamped before it.
BANDS = ("bands AS (SELECT r_name, CAST(floor(min(o_totalprice) * 0.8) AS BIGINT) AS band_lo, "
         "CAST(ceil(max(o_totalprice) * 1.2) AS BIGINT) AS band_hi FROM order_profile GROUP BY r_name)")
CLAMPED = BANDS + """,
      limits AS (
        SELECT *, greatest(least(qty_sum, n2 * 50.0), 0.0) AS q2,
               greatest(least(o_totalprice, CAST(band_hi AS DOUBLE)), CAST(band_lo AS DOUBLE)) AS p2
        FROM (SELECT *, CAST(greatest(least(returned_lines, n2), 0) AS BIGINT) AS r2
              FROM (SELECT p.*, b.band_lo, b.band_hi, CAST(greatest(least(n_lines, 7), 0) AS BIGINT) AS n2
                    FROM order_profile p JOIN bands b USING (r_name)))),
      clamped AS (
        SELECT * REPLACE (n2 AS n_lines, r2 AS returned_lines, q2 AS qty_sum, p2 AS o_totalprice),
               CAST((n2 <> n_lines)::INTEGER + (r2 <> returned_lines)::INTEGER + (q2 <> qty_sum)::INTEGER
                    + (p2 <> o_totalprice)::INTEGER AS INTEGER) AS n_changed
        FROM limits)"""


def decision_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    n = len(_RULES_SQL)
    o["score_batch"] = with_profile(f"SELECT id, y, {r('score')} AS score FROM scored", SCORED)
    o["risk_tiers"] = with_profile(f"SELECT id, {r('score')} AS score, {r('threshold')} AS threshold, tier FROM tiered",
                                   SCORED + ",\n" + SCORE_SWEEP)
    o["tier_summary"] = with_profile(
        f"SELECT tier, CAST(count(*) AS BIGINT) AS n, {r('avg(y)')} AS rate, {r('avg(score)')} AS mean_score "
        "FROM tiered GROUP BY tier", SCORED + ",\n" + SCORE_SWEEP)
    keys = "concat_ws(',', " + ", ".join(f"h{i}" for i in range(n)) + ")"
    o["risk_factors"] = with_profile(
        f"""SELECT id, CAST({' + '.join(f'(h{i} IS NOT NULL)::INTEGER' for i in range(n))} AS INTEGER) AS n_factors,
                   {keys} AS factor_keys,
                   CAST({' + '.join(f"(coalesce(s{i} = 'high', false))::INTEGER" for i in range(n))} AS INTEGER) AS n_high,
                   concat_ws(' | ', {', '.join(f'd{i}' for i in range(n))}) AS details
            FROM hits""", EXPLAINED)
    act = []
    for ks, icon in _ACTIONS_SQL:
        cond = " OR ".join(f"h{i} IS NOT NULL" for i, rr in enumerate(_RULES_SQL) if rr[0] in ks)
        act.append(f"CASE WHEN {cond} THEN '{icon}' END")
    icons = "concat_ws(',', " + ", ".join(act) + ")"
    cnt = " + ".join(f"({a} IS NOT NULL)::INTEGER" for a in act)
    o["recommendations"] = with_profile(
        f"""SELECT id, CAST(CASE WHEN {cnt} = 0 THEN 1 ELSE {cnt} END AS INTEGER) AS n_actions,
                   CASE WHEN {cnt} = 0 THEN 'check-circle' ELSE {icons} END AS action_icons
            FROM hits""", EXPLAINED)
    o["clamp_profile"] = with_profile(
        f"SELECT id, n_lines, returned_lines, {r('qty_sum')} AS qty_sum, {r('o_totalprice')} AS o_totalprice, n_changed "
        "FROM clamped", CLAMPED)
    # the stream scores clamped inputs with the statistics and the cut-off of the profile as it is
    eta = "-1.4"
    for c, w in _COEF:
        eta = f"({eta} + {w} * ((h.{c} - m.m_{c}) / m.s_{c}))"
    eta = f"({eta} + CASE WHEN h.o_orderstatus = 'O' THEN 0.3 ELSE 0.0 END)"
    moments = ("moments AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c, _ in _COEF)
               + " FROM order_profile)")
    o["stream_score"] = with_profile(
        f"""SELECT id, y, {r('score')} AS score,
                   CASE WHEN score >= 0.6 THEN 'High' WHEN score >= threshold THEN 'Medium' ELSE 'Low' END AS tier,
                   {keys} AS factor_keys, CASE WHEN {cnt} = 0 THEN 'check-circle' ELSE {icons} END AS action_icons,
                   n_changed
            FROM (SELECT h.*, bt.threshold, 1.0 / (1.0 + exp(-{eta})) AS score
                  FROM hits h CROSS JOIN moments m CROSS JOIN bt)""",
        ",\n".join([SCORED, SCORE_SWEEP, STATS, CLAMPED, _hits("clamped"), moments]))
    o["valid_pairs"] = """
      WITH lines AS (
        SELECT cr.r_name, sn.n_name AS supplier_nation, CAST(count(*) AS BIGINT) AS n_lines
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) cr ON c.c_nationkey = cr.n_nationkey
        JOIN nation sn ON s.s_nationkey = sn.n_nationkey
        GROUP BY cr.r_name, sn.n_name),
      pairs AS (SELECT r_name, n_name AS supplier_nation FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT r_name, supplier_nation, n_lines,
             EXISTS (SELECT 1 FROM pairs p WHERE p.r_name = lines.r_name AND p.supplier_nation = lines.supplier_nation) AS is_valid
      FROM lines"""
    return o
