from pyspark.sql import functions as F

from cohortlens.operators import decisions as DS


def _emp(spark):
    cols = ("id int, OverTime string, MaritalStatus string, JobSatisfaction int, EnvironmentSatisfaction int, "
            "WorkLifeBalance int, MonthlyIncome int, JobLevel int, YearsSinceLastPromotion int, YearsAtCompany int, "
            "Age int, StockOptionLevel int, BusinessTravel string, JobInvolvement int, y int")
    rows = [(1, "Yes", "Single", 1, 3, 3, 2000, 2, 6, 6, 40, 1, "Travel_Rarely", 3, 1),
            (2, "No", "Single", 3, 3, 3, 6000, 2, 0, 4, 40, 1, "Travel_Rarely", 3, 0),
            (3, "No", "Married", 4, 4, 4, 6000, 2, 0, 1, 25, 0, "Travel_Frequently", 2, 0),
            (4, "No", "Married", 4, 4, 4, 6500, 2, 0, 8, 45, 1, "Travel_Rarely", 3, 0)]
    return spark.createDataFrame(rows, cols)


def test_employee_rules_and_fallback(spark):
    df = _emp(spark)
    out = {r.id: r for r in DS.explain_employees(df, df).collect()}
    k1 = [f.key for f in out[1].risk_factors]
    assert k1 == ["OverTime", "MaritalStatus", "JobSatisfaction", "MonthlyIncome", "PromotionStagnation"]
    assert out[1].risk_factors[0].detail == "100% attrition vs 0% without"
    assert out[1].risk_factors[3].detail == "$2,000 vs median $6,000"
    # only 'Single' flagged -> MaritalStatus maps to no action -> fallback
    assert [f.key for f in out[2].risk_factors] == ["MaritalStatus"]
    assert [a.icon for a in out[2].actions] == ["check-circle"]
    assert [f.key for f in out[3].risk_factors] == ["EarlyCareer", "StockOptions", "Travel", "JobInvolvement"]


def test_clamp_cascade_idempotent_and_valid(spark):
    rows = [(20, 30, 35, 20, 20, 20, 12, 5000, 1000, 9000)]
    df = spark.createDataFrame(rows, "Age int, TotalWorkingYears int, YearsAtCompany int, YearsInCurrentRole int, "
                                     "YearsWithCurrManager int, YearsSinceLastPromotion int, NumCompaniesWorked int, "
                                     "MonthlyIncome int, band_lo int, band_hi int")
    once = DS.clamp_cascade(df, DS.employee_constraints())
    r = once.first()
    assert (r.TotalWorkingYears, r.YearsAtCompany, r.YearsInCurrentRole, r.NumCompaniesWorked) == (4, 4, 4, 5)
    twice = DS.clamp_cascade(once.drop("n_changed"), DS.employee_constraints()).first()
    assert twice.n_changed == 0


def test_valid_choice(spark):
    pairs = spark.createDataFrame([("Sales", "Manager"), ("Sales", "Sales Executive"), ("R&D", "Scientist")],
                                  "dept string, role string")
    df = spark.createDataFrame([(1, "Sales", "Scientist"), (2, "R&D", "Scientist")], "id int, dept string, role string")
    out = {r.id: r for r in DS.valid_choice(df, pairs, "dept", "role").collect()}
    assert out[1].role == "Manager" and not out[1].role_was_valid and out[2].role_was_valid


def test_valid_pairs_is_built_on_valid_choice(spark, monkeypatch):
    from cohortlens.plans import catalog
    calls, real = [], DS.valid_choice
    monkeypatch.setattr(DS, "valid_choice", lambda *a: calls.append(a[2:]) or real(*a))
    out = catalog.q_valid_pairs(spark, "/root/testdata/sf0.001")
    assert calls == [("r_name", "choice")] and out.columns == ["r_name", "supplier_nation", "n_lines", "is_valid"]
    assert {r["is_valid"] for r in out.collect()} == {True, False}
