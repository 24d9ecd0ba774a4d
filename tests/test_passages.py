"""The rerank of turns reads both halves of a passage."""

from lodestone.operators import turns


def test_rerank_reads_the_answer(spark):
    rows = [(1, 1, "apple", "pear " + "x" * 900), (2, 1, "nothing", "apple pear"), (3, 1, "y" * 800 + " apple", "z" * 800 + " pear")]
    df = spark.createDataFrame(rows, "s int, turn_no int, user_text string, assistant_text string")
    got = [(r.s, r.rerank > 0) for r in turns.keyword_rank(df, "apple pear", 15, 3, ["s", "turn_no"]).collect()]
    assert got == [(1, True), (2, True), (3, False)]
    assert [r.s for r in turns.keyword_rank(df.where("s > 1"), "apple pear", 15, 1, ["s", "turn_no"]).collect()] == [2]
