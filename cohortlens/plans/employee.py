"""The reference's own workflow on an employee table (F1/F2 schema), composed
from the operators: load the CSV, publish the six EDA tables with the
reference's column names, and prepare the modelling table.

Nothing here is registered as a driver query (the test data has no employee
table); a user of the reference points ``load_employees`` at their CSV.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalars import signif
from cohortlens.operators import aggregates as A
from cohortlens.operators import quality as Q
from cohortlens.operators import stats as S
from cohortlens.sources.profile import EMPLOYEE_DROP, EMPLOYEE_SCHEMA
from cohortlens.sources.tables import read_csv, write_table

# The seven categorical predictors tested against the outcome,
# the three rate columns screened as noise, and the outcome's event level.
EMPLOYEE_CATEGORICALS = ["BusinessTravel", "Department", "EducationField", "Gender", "JobRole",
                         "MaritalStatus", "OverTime"]
NOISE_RATES = ["DailyRate", "HourlyRate", "MonthlyRate"]
EVENT = "Yes"

# The grouped profile by outcome (output name, column, decimals).
PROFILE_MEANS = {
    "avg_age": ("Age", 1), "avg_monthly_income": ("MonthlyIncome", 0),
    "avg_total_working_years": ("TotalWorkingYears", 1), "avg_years_at_company": ("YearsAtCompany", 1),
    "avg_distance_from_home": ("DistanceFromHome", 1), "avg_job_satisfaction": ("JobSatisfaction", 2),
    "avg_env_satisfaction": ("EnvironmentSatisfaction", 2), "avg_work_life_balance": ("WorkLifeBalance", 2),
    "avg_num_companies_worked": ("NumCompaniesWorked", 1),
    "avg_years_since_promotion": ("YearsSinceLastPromotion", 1),
}


def load_employees(spark: SparkSession, path: str) -> DataFrame:
    """S1 with the declared 35-column schema, plus the 0/1 outcome ``y``."""
    return with_outcome(read_csv(spark, path, EMPLOYEE_SCHEMA))


def with_outcome(df: DataFrame) -> DataFrame:
    return df.withColumn("y", (F.col("Attrition") == EVENT).cast("int"))


def numeric_predictors(df: DataFrame) -> list[str]:
    """Integer columns minus the identifier and the constants (23 in the reference)."""
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() in ("int", "bigint", "double")
            and f.name not in set(EMPLOYEE_DROP) | {"y"}]


def eda_tables(df: DataFrame, b: int = 2000) -> dict[str, DataFrame]:
    """The six published EDA tables, computed as Spark jobs."""
    nums = numeric_predictors(df)
    chi = S.chi_square(df, EMPLOYEE_CATEGORICALS)
    mc = S.mc_pvalue(df, EMPLOYEE_CATEGORICALS, b=b)
    chi_sq_results = chi.join(mc.select("variable", "p_value", "significant"), "variable").select(
        F.col("variable").alias("Variable"), F.round("chi_sq", 2).alias("chi_sq"),
        signif("p_value", 3).alias("p_value"), "cramers_v", "significant")
    pb = S.point_biserial(df, nums).select(F.col("variable").alias("Variable"), "r_pb", "abs_r")
    noise = Q.noise_screen(df, NOISE_RATES, "MonthlyIncome").select(
        F.col("variable").alias("Variable"), F.col("cor_with_reference").alias("cor_with_MonthlyIncome"),
        F.col("cor_with_outcome").alias("cor_with_Attrition"))
    outliers = Q.iqr_outliers(df, nums)
    summary = A.outcome_profile(df, PROFILE_MEANS, {"pct_overtime": F.col("OverTime") == "Yes"},
                                outcome="Attrition")
    strong = S.strong_pairs(df, nums)
    return {"chi_sq_results": chi_sq_results, "pb_correlations": pb, "noise_check": noise,
            "outlier_summary": outliers, "attrition_numeric_summary": summary, "cor_pairs_strong": strong}


def modelling_table(df: DataFrame) -> DataFrame:
    """Q14: the 31-column modelling table (identifier and constants removed)."""
    return Q.drop_columns(df, EMPLOYEE_DROP)


def publish(tables: dict[str, DataFrame], out_dir: str) -> None:
    """One CSV folder per table."""
    for name, t in tables.items():
        write_table(t.coalesce(1), os.path.join(out_dir, name), fmt="csv")
