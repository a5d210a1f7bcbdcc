from wavelake.llm import simhash as S


def test_one_row_stays_where_ids_repeat_or_are_null(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (5, "quite another text of seven words"), (None, "third text with no id"), (None, "third text with no id"), (8, "h i j k"), (8, "h i j k")]
    out = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, rows[3][1]), (2, rows[1][1]), (5, rows[2][1]), (8, rows[5][1])]
