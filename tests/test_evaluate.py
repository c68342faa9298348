from pyspark.sql import functions as F

from cohortlens.operators import evaluate as EV


def _pred(spark, rows):
    return spark.createDataFrame([("m", i, y, s) for i, (y, s) in enumerate(rows)],
                                 "model string, id int, y int, score double")


def test_auc_with_ties(spark):
    # positives 0.8, 0.4 ; negatives 0.4, 0.1 -> pairs: (0.8>0.4)=1,(0.8>0.1)=1,(0.4=0.4)=.5,(0.4>0.1)=1
    p = _pred(spark, [(1, 0.8), (1, 0.4), (0, 0.4), (0, 0.1)])
    assert abs(EV.roc_auc(p).first().roc_auc - 3.5 / 4) < 1e-12


def test_auc_invariant_under_monotone_transform(spark):
    rows = [(i % 3 == 0, (i * 37 % 17) / 17.0) for i in range(40)]
    p = _pred(spark, [(int(a), b) for a, b in rows])
    q = p.withColumn("score", F.pow("score", 3.0))
    assert abs(EV.roc_auc(p).first().roc_auc - EV.roc_auc(q).first().roc_auc) < 1e-12


def test_sweep_monotone_and_best_tie_lowest(spark):
    p = _pred(spark, [(1, 0.9), (1, 0.7), (0, 0.3), (0, 0.2), (1, 0.35), (0, 0.6)])
    sw = EV.threshold_sweep(p).toPandas()
    sens = sw[sw.metric == "sensitivity"].sort_values("threshold").estimate.tolist()
    spec = sw[sw.metric == "specificity"].sort_values("threshold").estimate.tolist()
    assert all(a >= b for a, b in zip(sens, sens[1:])) and all(a <= b for a, b in zip(spec, spec[1:]))
    bt = EV.best_threshold(p).first()
    j = sw[sw.metric == "j_index"]
    best = j[j.estimate == j.estimate.max()].threshold.min()
    assert abs(bt.threshold - best) < 1e-12 and len(sens) == 91


def test_confusion_dense_and_precision_null(spark):
    p = _pred(spark, [(1, 0.2), (0, 0.1)])
    thr = spark.createDataFrame([("m", 0.5)], "model string, threshold double")
    cells = {r.cell: r.n for r in EV.confusion_at(p, thr).collect()}
    assert cells == {"TP": 0, "FP": 0, "FN": 1, "TN": 1}
    m = {r.metric: r.estimate for r in EV.metrics_at(p, thr).collect()}
    assert m["precision"] is None and m["accuracy"] == 0.5
