"""Rows without an id, and rows that share one, are documents of their own."""

from lanewise.llm.line_dedup import dedup_lines

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "test", None if t is None else len(t)) for i, t in rows], KIND)


def test_lines_of_rows_without_an_id_and_with_a_shared_one(spark):
    copy, one, two = "a line that stands in many rows", "the second row alone has this text", "nobody else holds these other words"
    for i, j in ((None, None), (7, 7)):
        rows = [(1, f"start\n{copy}"), (i, f"unlike\n{one}\nq"), (j, f"{two}\n{copy}\nr"), (i, f"last\n{two}\n{copy}")]
        got = dedup_lines(table(spark, rows)).collect()
        assert len(got) == 4 and sum(r["n_lines"] for r in got) == 11
        left = [x for r in got for x in r["text"].split("\n")]
        assert sorted(left) == sorted(["start", copy, "unlike", one, "q", two, "r", "last"])


def test_copies_at_one_line_of_rows_without_an_id(spark):
    for i in (None, 3):
        got = dedup_lines(table(spark, [(i, "the same text in each row\nand more of it")] * 4)).collect()
        assert sorted(r["n_dropped"] for r in got) == [0, 2, 2, 2]
