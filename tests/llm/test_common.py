from ledgerflow.llm import common


def test_cut_and_clear(spark):
    made = common.cut(spark.range(10).selectExpr("id", "if(id > 5, null, id) as x"))
    assert made.count() == 10 and made.where("x is null").count() == 4
    common.clear_cuts(spark)
    assert common.cut(spark.range(3)).count() == 3


def test_set_aside(spark):
    df = spark.createDataFrame([(1, "a", "b")], "_0 long, text string, _1 string")
    plain, names = common.set_aside(df, "text")
    assert common.restored(plain, names, df.columns).collect() == df.collect() and plain.columns == ["_0", "_1", "_2", "text"]
