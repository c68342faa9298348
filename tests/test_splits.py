from pyspark.sql import functions as F

from cohortlens.operators.splits import repeated_folds, stratified_split


def test_split_counts_exact(spark):
    df = spark.range(0, 1003).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    s = stratified_split(df, num=7, den=10).groupBy("y", "split").count().collect()
    c = {(r.y, r.split): r["count"] for r in s}
    assert c[(1, "train")] == 201 * 7 // 10 and c[(0, "train")] == 802 * 7 // 10
    assert c[(1, "train")] + c[(1, "test")] == 201


def test_each_row_one_fold_per_repeat_and_balanced(spark):
    df = spark.range(0, 500).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    f = repeated_folds(df, v=5, repeats=3).toPandas()
    assert (f.groupby(["id", "repeat"]).size() == 1).all() and len(f) == 1500
    sizes = f.groupby(["repeat", "y", "fold"]).size()
    for (rp, y), g in sizes.groupby(level=[0, 1]):
        assert g.max() - g.min() <= 1
