from cohortlens.streaming import score_stream as ST

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    s = ST.stream_score(spark, SF)
    b = ST.batch_score(spark, SF)
    assert s.count() == b.count() > 0
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
