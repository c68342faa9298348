"""The employee workflow on a planted-signal fixture built with Spark range + md5 uniforms."""
from pyspark.sql import functions as F

from cohortlens.functions.scalars import seeded_uniform
from cohortlens.plans import employee as EMP
from cohortlens.sources.profile import EMPLOYEE_COLUMNS


def planted_employees(spark, n=1470):
    u = lambda tag: seeded_uniform(11, "EmployeeNumber", F.lit(tag))
    i = lambda tag, lo, hi: (F.floor(u(tag) * (hi - lo + 1)) + lo).cast("int")
    pick = lambda tag, vals: F.element_at(F.array(*[F.lit(v) for v in vals]),
                                          (F.floor(u(tag) * len(vals)) + 1).cast("int"))
    df = spark.range(1, n + 1).select(F.col("id").cast("int").alias("EmployeeNumber"))
    df = df.select(
        "EmployeeNumber", i("age", 18, 60).alias("Age"),
        pick("bt", ["Non-Travel", "Travel_Rarely", "Travel_Frequently"]).alias("BusinessTravel"),
        i("dr", 102, 1499).alias("DailyRate"),
        pick("dep", ["Sales", "Human Resources", "Research & Development"]).alias("Department"),
        i("dist", 1, 29).alias("DistanceFromHome"), i("edu", 1, 5).alias("Education"),
        pick("ef", ["Life Sciences", "Medical", "Marketing", "Other"]).alias("EducationField"),
        F.lit(1).alias("EmployeeCount"), i("es", 1, 4).alias("EnvironmentSatisfaction"),
        pick("g", ["Male", "Female"]).alias("Gender"), i("hr", 30, 100).alias("HourlyRate"),
        i("ji", 1, 4).alias("JobInvolvement"), i("jl", 1, 5).alias("JobLevel"),
        pick("jr", ["Sales Executive", "Research Scientist", "Manager"]).alias("JobRole"),
        i("js", 1, 4).alias("JobSatisfaction"),
        pick("ms", ["Single", "Married", "Divorced"]).alias("MaritalStatus"),
        i("mr", 2094, 26999).alias("MonthlyRate"), i("nc", 0, 9).alias("NumCompaniesWorked"),
        F.lit("Y").alias("Over18"), pick("ot", ["Yes", "No", "No"]).alias("OverTime"),
        i("psh", 11, 25).alias("PercentSalaryHike"), i("pr", 3, 4).alias("PerformanceRating"),
        i("rs", 1, 4).alias("RelationshipSatisfaction"), F.lit(80).alias("StandardHours"),
        i("sol", 0, 3).alias("StockOptionLevel"), i("ttl", 0, 6).alias("TrainingTimesLastYear"),
        i("wlb", 1, 4).alias("WorkLifeBalance"))
    df = df.withColumn("MonthlyIncome", (F.col("JobLevel") * 3800 + i("inc", 0, 1500) - 1000).cast("int")) \
        .withColumn("TotalWorkingYears", F.least(F.greatest(F.col("Age") - 18, F.lit(0)), i("tw", 0, 40))) \
        .withColumn("YearsAtCompany", F.least(F.col("TotalWorkingYears"), i("yc", 0, 40))) \
        .withColumn("YearsInCurrentRole", F.least(F.col("YearsAtCompany"), i("yr", 0, 18))) \
        .withColumn("YearsSinceLastPromotion", F.least(F.col("YearsAtCompany"), i("ys", 0, 15))) \
        .withColumn("YearsWithCurrManager", F.least(F.col("YearsAtCompany"), i("ym", 0, 17)))
    eta = (-2.4 + 1.5 * (F.col("OverTime") == "Yes").cast("double")
           + 0.7 * (F.col("MaritalStatus") == "Single").cast("double")
           - 0.00015 * (F.col("MonthlyIncome") - 6500) - 0.3 * (F.col("JobInvolvement") - 2.5))
    df = df.withColumn("Attrition", F.when(u("y") < 1 / (1 + F.exp(-eta)), "Yes").otherwise("No"))
    return df.select(*[F.col(c).cast(t) for c, t in EMPLOYEE_COLUMNS])


def test_eda_tables_shapes_and_signal(spark):
    df = EMP.with_outcome(planted_employees(spark))
    t = {k: v.toPandas() for k, v in EMP.eda_tables(df, b=200).items()}
    assert len(t["chi_sq_results"]) == 7 and len(t["pb_correlations"]) == 23
    assert len(t["noise_check"]) == 3 and len(t["outlier_summary"]) == 23
    assert set(t["attrition_numeric_summary"].Attrition) == {"Yes", "No"}
    ot = t["chi_sq_results"].set_index("Variable").loc["OverTime"]
    assert ot.significant == "Yes" and ot.p_value < 0.01
    strong = t["cor_pairs_strong"]
    assert "JobLevel — MonthlyIncome" in set(strong.pair)
    assert len(EMP.modelling_table(df).columns) == 32  # 31 + the 0/1 outcome


def test_publish_writes_csv(spark, tmp_path):
    df = EMP.with_outcome(planted_employees(spark, 300))
    tables = EMP.eda_tables(df, b=50)
    EMP.publish({"noise_check": tables["noise_check"]}, str(tmp_path))
    back = spark.read.option("header", True).csv(str(tmp_path / "noise_check"))
    assert back.count() == 3 and "cor_with_MonthlyIncome" in back.columns
