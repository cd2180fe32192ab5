"""Rows without an id, and rows that share one, are documents of their own."""

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "test", None if t is None else len(t)) for i, t in rows], KIND)


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, a), (None, a + " end"), (5, b), (5, b), (5, c), (4, b), (None, c), (None, ""), (None, None), (6, "")]
    got = corpus_pipeline.near_copies(spark, table(spark, rows), "")
    assert got.columns == [x.split()[0] for x in KIND.split(", ")]
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len([x for x in got if x[1] in (a, a + " end")]) == 1
    assert sorted((x for x in got if x[1] not in (a, a + " end")), key=str) == sorted([(4, b), (5, c), (None, ""), (None, None), (6, "")], key=str)
