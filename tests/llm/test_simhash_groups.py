from arkose.llm import simhash


def test_one_row_of_each_group(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "all other words are these here"
    rows = [(5, a, "p"), (5, a, "p"), (7, a, "p"), (5, b, "q"), (9, b, "q"), (None, c, "r"), (None, c, "s"), (None, a, "z"), (None, None, None), (3, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = simhash.first_of_groups(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(5, a, "p"), (5, b, "q"), (None, c, "r"), (3, "", "e")], df.schema).collect()))


def test_unique_ids_need_no_comparison(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_groups(df).collect()) == [1, 3]
    assert simhash.first_of_groups(df.limit(0)).collect() == []
