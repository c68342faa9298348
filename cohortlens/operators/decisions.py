"""Decision support re-aimed as table jobs.

A profile table is scored, tiered, explained and given actions in one pass
of column expressions:

* population statistics (subset rates, group medians) are computed once -
  subset rates in ONE aggregate used through scalar subqueries, group medians
  with the exact quantile operator and attached by an equi-join;
* each rule is a (predicate, label, detail, severity) expression; the hits
  form ``filter(array(...), x -> x is not null)`` of structs in rule order;
* actions follow from the flagged keys with ``arrays_overlap``; a fallback
  applies when no flagged key maps to an action.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import null_safe_join, scalar_fields
from cohortlens.operators.aggregates import group_bands, group_median


@dataclass
class RiskRule:
    key: str
    severity: str
    predicate: Callable[[dict], Column]       # stats -> boolean column
    label: Callable[[dict], Column]
    detail: Callable[[dict], Column]


def pct0(c: Column) -> Column:
    """Percent with no decimals as text (R ``round(x * 100)``)."""
    return F.round(c * 100.0).cast("long").cast("string")


def population_stats(df: DataFrame, rates: dict[str, Column], outcome: str = "y") -> dict[str, Column]:
    """A10 computed once: all subset rates come from one aggregate (one scalar subquery)."""
    return scalar_fields(df.agg(*[F.avg(F.when(cond, F.col(outcome).cast("double"))).alias(name)
                                  for name, cond in rates.items()]))


def apply_rules(df: DataFrame, rules: Sequence[RiskRule], stats: dict) -> DataFrame:
    """``risk_factors`` = array<struct<key,label,detail,severity>> in rule order.

    Statistics are attached as columns first: subqueries may not appear
    inside the higher-order ``filter``."""
    names = {k: f"_pop_{k}" for k in stats}
    df = df.withColumns({names[k]: v for k, v in stats.items()})
    st = {k: F.col(c) for k, c in names.items()}
    items = [F.when(r.predicate(st), F.struct(F.lit(r.key).alias("key"), r.label(st).alias("label"),
                                              r.detail(st).alias("detail"),
                                              F.lit(r.severity).alias("severity")))
             for r in rules]
    keys = [F.when(r.predicate(st), F.lit(r.key)) for r in rules]
    # risk_keys alone feeds the actions, so a query that needs only actions
    # never builds the label/detail strings (column pruning drops them)
    return df.withColumn("risk_factors", F.filter(F.array(*items), lambda x: x.isNotNull())) \
        .withColumn("risk_keys", F.filter(F.array(*keys), lambda x: x.isNotNull())) \
        .drop(*names.values())


def recommend(df: DataFrame, actions: Sequence[tuple[Sequence[str], str, str]],
              fallback: tuple[str, str]) -> DataFrame:
    """Actions for the flagged keys (``(keys, icon, text)`` in order), or the fallback."""
    keys = F.col("risk_keys") if "risk_keys" in df.columns else F.transform("risk_factors", lambda x: x["key"])
    items = [F.when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ks])),
                    F.struct(F.lit(icon).alias("icon"), F.lit(text).alias("text")))
             for ks, icon, text in actions]
    hits = F.filter(F.array(*items), lambda x: x.isNotNull())
    fb = F.array(F.struct(F.lit(fallback[0]).alias("icon"), F.lit(fallback[1]).alias("text")))
    return df.withColumn("actions", F.when(F.size(hits) > 0, hits).otherwise(fb))


def risk_tier(score: Column, threshold, high: float = 0.60) -> Column:
    """D3: High at >= 0.60, Medium at >= the operating threshold, else Low."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= F.lit(high), "High").when(score >= t, "Medium").otherwise("Low")


def logistic_score(df: DataFrame, coef: dict[str, float], intercept: float,
                   flags: dict[str, tuple[Column, float]] | None = None) -> Column:
    """D2 with a fixed-coefficient logistic on standardised inputs (mean and sd
    of the scored table from one aggregate, one scalar subquery)."""
    st = scalar_fields(df.agg(*[F.avg(c).alias(f"m_{c}") for c in coef],
                              *[F.stddev_samp(c).alias(f"s_{c}") for c in coef]))
    eta = F.lit(intercept)
    for c, b in coef.items():
        eta = eta + F.lit(b) * F.try_divide(F.col(c) - st[f"m_{c}"], st[f"s_{c}"])
    for _, (cond, b) in (flags or {}).items():
        eta = eta + F.when(cond, F.lit(b)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def clamp_cascade(df: DataFrame, steps: Sequence[tuple[str, Callable[[], Column], Callable[[], Column]]]) -> DataFrame:
    """Apply (column, lower, upper) clamps in dependency order; later bounds
    see earlier clamped values; NULL stays NULL.  Adds ``n_changed`` (Q13
    violations repaired)."""
    orig = {c: F.col(c) for c, _, _ in steps}
    out = df.select("*", *[F.col(c).alias(f"_orig_{c}") for c in orig])
    for c, lo, hi in steps:
        v = F.col(c)
        lo_c, hi_c = lo(), hi()
        if hi_c is not None:
            v = F.least(v, hi_c)
        if lo_c is not None:
            v = F.greatest(v, lo_c)
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), v).cast(dict(df.dtypes)[c]))
    changed = sum((~F.col(c).eqNullSafe(F.col(f"_orig_{c}"))).cast("int") for c in orig)
    return out.withColumn("n_changed", changed).drop(*[f"_orig_{c}" for c in orig])


def valid_choice(df: DataFrame, pairs: DataFrame, parent: str, child: str) -> DataFrame:
    """Keep ``child`` when (parent, child) is a valid pair, else replace it with
    the first valid child of the parent (alphabetical).  Validity is a left-semi
    style lookup against the pair table (one row per valid pair)."""
    first = pairs.groupBy(parent).agg(F.min(child).alias("_first"))
    ok = pairs.select(parent, child, F.lit(True).alias("_ok"))
    j = df.join(ok, [parent, child], "left").join(first, parent, "left")
    return j.withColumn(child, F.when(F.col("_ok"), F.col(child)).otherwise(F.col("_first"))) \
        .withColumn(f"{child}_was_valid", F.coalesce("_ok", F.lit(False))).drop("_ok", "_first")


# ---------------------------------------------------------------- employee rules
# The reference's eleven risk rules (key, severity, label and detail
# wording), in output order, and its recommendation texts.
def employee_rate_conditions() -> dict[str, Column]:
    c = F.col
    return {
        "ot_yes": c("OverTime") == "Yes", "ot_no": c("OverTime") == "No",
        "single": c("MaritalStatus") == "Single", "js_low": c("JobSatisfaction") <= 2,
        "es_low": c("EnvironmentSatisfaction") <= 2, "wlb_low": c("WorkLifeBalance") <= 2,
        "no_stock": c("StockOptionLevel") == 0, "travel_freq": c("BusinessTravel") == "Travel_Frequently",
        "ji_low": c("JobInvolvement") <= 2,
    }


def employee_rules() -> list[RiskRule]:
    c = F.col

    def txt(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return [
        RiskRule("OverTime", "high", lambda s: c("OverTime") == "Yes", lambda s: F.lit("Works overtime"),
                 lambda s: txt(pct0(s["ot_yes"]), "% attrition vs ", pct0(s["ot_no"]), "% without")),
        RiskRule("MaritalStatus", "medium", lambda s: c("MaritalStatus") == "Single",
                 lambda s: F.lit("Single (higher mobility)"),
                 lambda s: txt(pct0(s["single"]), "% attrition rate for single employees")),
        RiskRule("JobSatisfaction", "high", lambda s: c("JobSatisfaction") <= 2,
                 lambda s: txt("Low job satisfaction (", c("JobSatisfaction").cast("string"), "/4)"),
                 lambda s: txt(pct0(s["js_low"]), "% attrition when satisfaction <= 2")),
        RiskRule("EnvSatisfaction", "high", lambda s: c("EnvironmentSatisfaction") <= 2,
                 lambda s: txt("Low environment satisfaction (", c("EnvironmentSatisfaction").cast("string"), "/4)"),
                 lambda s: txt(pct0(s["es_low"]), "% attrition when satisfaction <= 2")),
        RiskRule("WorkLifeBalance", "high", lambda s: c("WorkLifeBalance") <= 2,
                 lambda s: txt("Poor work-life balance (", c("WorkLifeBalance").cast("string"), "/4)"),
                 lambda s: txt(pct0(s["wlb_low"]), "% attrition when WLB <= 2")),
        RiskRule("MonthlyIncome", "high", lambda s: c("MonthlyIncome") < c("median_MonthlyIncome") * 0.8,
                 lambda s: txt("Below-market income for Job Level ", c("JobLevel").cast("string")),
                 lambda s: txt("$", F.format_number(c("MonthlyIncome").cast("double"), 0), " vs median $",
                               F.format_number(F.round(c("median_MonthlyIncome")), 0))),
        RiskRule("PromotionStagnation", "medium",
                 lambda s: (c("YearsSinceLastPromotion") >= 5) & (c("YearsAtCompany") >= 5),
                 lambda s: txt(c("YearsSinceLastPromotion").cast("string"), " years without promotion"),
                 lambda s: F.lit("Long promotion gaps increase attrition risk")),
        RiskRule("EarlyCareer", "medium", lambda s: (c("Age") <= 30) & (c("YearsAtCompany") <= 2),
                 lambda s: F.lit("Early-career employee with short tenure"),
                 lambda s: F.lit("Employees under 30 with < 2 years have elevated attrition")),
        RiskRule("StockOptions", "medium", lambda s: c("StockOptionLevel") == 0,
                 lambda s: F.lit("No stock options"),
                 lambda s: txt(pct0(s["no_stock"]), "% attrition with no stock options")),
        RiskRule("Travel", "medium", lambda s: c("BusinessTravel") == "Travel_Frequently",
                 lambda s: F.lit("Travels frequently"),
                 lambda s: txt(pct0(s["travel_freq"]), "% attrition for frequent travellers")),
        RiskRule("JobInvolvement", "medium", lambda s: c("JobInvolvement") <= 2,
                 lambda s: txt("Low job involvement (", c("JobInvolvement").cast("string"), "/4)"),
                 lambda s: txt(pct0(s["ji_low"]), "% attrition when involvement <= 2")),
    ]


EMPLOYEE_ACTIONS = [
    (["OverTime"], "clock",
     "Review workload and overtime patterns. Consider redistributing tasks or hiring support."),
    (["JobSatisfaction", "EnvSatisfaction"], "comments",
     "Schedule a stay interview to understand dissatisfaction drivers. Discuss growth opportunities."),
    (["WorkLifeBalance"], "scale-balanced",
     "Explore flexible work arrangements: remote days, adjusted hours, or reduced travel."),
    (["MonthlyIncome"], "dollar-sign",
     "Conduct a compensation review. This employee is paid below the median for their level."),
    (["PromotionStagnation"], "arrow-up",
     "Discuss career development path. Consider a title change, lateral move, or stretch assignment."),
    (["EarlyCareer"], "user-graduate",
     "Assign a mentor. Early-career employees benefit from structured onboarding and check-ins at 6/12/18 months."),
    (["StockOptions"], "chart-line",
     "Consider equity participation. Stock options create long-term retention incentives."),
    (["Travel"], "plane",
     "Review travel requirements. Explore video conferencing alternatives where possible."),
    (["JobInvolvement"], "hands-helping",
     "Increase autonomy and ownership. Assign a meaningful project with visible impact."),
]
EMPLOYEE_FALLBACK = ("check-circle",
                     "No specific high-risk factors detected. Continue regular engagement and career conversations.")


def employee_constraints() -> list:
    """D6 cascade for employee inputs (dependency order)."""
    # The upper bounds of the cascade and the lowest and highest income.
    c, L = F.col, F.lit
    return [
        ("TotalWorkingYears", lambda: L(0), lambda: F.least(F.greatest(c("Age") - 16, L(0)), L(40))),
        ("YearsAtCompany", lambda: L(0), lambda: F.least(c("TotalWorkingYears"), L(40))),
        ("YearsInCurrentRole", lambda: L(0), lambda: F.least(c("YearsAtCompany"), L(18))),
        ("YearsWithCurrManager", lambda: L(0), lambda: F.least(c("YearsAtCompany"), L(17))),
        ("YearsSinceLastPromotion", lambda: L(0), lambda: F.least(c("YearsAtCompany"), L(15))),
        ("NumCompaniesWorked", lambda: L(0), lambda: F.least(c("TotalWorkingYears") + 1, L(9))),
        ("MonthlyIncome", lambda: F.greatest(c("band_lo"), L(1009)), lambda: F.least(c("band_hi"), L(19999))),
    ]


def repair_employees(df: DataFrame, population: DataFrame) -> DataFrame:
    """D6 whole: a role valid for the department, then the clamps, with the
    income band of the job level as found in the population."""
    pairs = population.select("Department", "JobRole").distinct()
    bands = group_bands(population, "JobLevel", "MonthlyIncome", lowest=1009, highest=19999)
    valid = valid_choice(df, pairs, "Department", "JobRole")
    return clamp_cascade(null_safe_join(valid, bands, ["JobLevel"], "left"), employee_constraints())


def explain_employees(df: DataFrame, population: DataFrame, outcome: str = "y") -> DataFrame:
    """D4 + D5 for employee profiles against a population table (with 0/1 ``y``)."""
    stats = population_stats(population, employee_rate_conditions(), outcome)
    med = group_median(population, "JobLevel", "MonthlyIncome")
    prof = df.join(med, "JobLevel", "left")
    out = apply_rules(prof, employee_rules(), stats)
    return recommend(out, EMPLOYEE_ACTIONS, EMPLOYEE_FALLBACK)
