"""Rows that share an id but not their text are one node of the self-join."""

from lodestone.llm import jaccard


def test_other_text_of_a_copied_id_stays_in_the_join(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(5, a), (5, b), (3, a), (7, b + " end"), (9, "alone here and now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in jaccard.linked_components(df).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (9, 9)}
