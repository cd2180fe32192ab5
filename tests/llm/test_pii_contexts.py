"""Contexts of seeds discover identifiers of unseen forms, and finds lead to further finds."""

from lanewise.llm.pii import bootstrap, find_pii
from tests.llm.data import documents


def spans(spark, texts):
    return [r["spans"] for r in find_pii(documents(spark, texts)).orderBy("doc_id").collect()]


def check(spark, seeds, unseen, kind, form, others=()):
    """Every unseen value is found whole where seeds stand; none of the others."""
    texts = [form.format(x) for x in [*seeds, *unseen]] + list(others)
    got, at = spans(spark, texts), form.index("{")
    for i, x in enumerate([*seeds, *unseen]):
        assert got[i] == f"{kind}:{at}:{at + len(x)}", x
    assert got[len(seeds) + len(unseen):] == [""] * len(others)


def test_phones_of_unseen_forms(spark):
    seeds = [f"+1 (269) 555-{n}" for n in range(1000, 1030)]
    unseen = ["555-123-4567", "(487) 555-7209", "487 555 7209", "(487)555.7209", "4875557209"]
    check(spark, seeds, unseen, "phone", "please call {} today", ["in 1984 we saw 2,345,678 of 12 34", "weight 555-987-6543 kilos"])


def test_cards_with_spaces(spark):
    seeds = ["4111 1111 1111 1111", "5500 0055 5555 5559", "4012 8888 8888 1881", "5105 1051 0510 5100", "6011 1111 1111 1117", "5555555555554444",
             "4012888888881881", "6011000990139424"]
    check(spark, seeds, ["4111 1111 1111 1112", "4111111111111113"], "card", "pay with visa {} now")


def test_mail_and_addresses_of_unseen_forms(spark):
    check(spark, [f"u{i}@host.org" for i in range(12)], ["jörg@intern", "root@localhost"], "email", "write to {} soon")
    check(spark, [f"10.0.0.{i}" for i in range(12)], ["10.0.0.300"], "ip", "server {} answers")


def test_a_number_beside_another_is_found(spark):
    seeds = [f"+1 (269) 555-{n}" for n in range(1000, 1030)]
    texts = [f"please call {x} today" for x in seeds] + ["please call 555-123-4567 2024002 now", "please call 555-123-4567 20240011223344 now"]
    got = spans(spark, texts)
    assert got[-2] == "phone:12:24" and got[-1] == "phone:12:24"


def test_found_values_support_patterns_of_later_rounds(spark):
    """The left word leads from seeds to new values; their right word, that no seed has, leads to others."""
    rows = [(0, f"u{i}", "mail", "x") for i in range(40)] + [(None, f"v{i}", "mail", "then") for i in range(4)] + [(None, "w7", "odd", "then")]
    found = {r["value"] for r in bootstrap(spark.createDataFrame(rows, "kind int, value string, before string, after string")).collect()}
    assert found == {"v0", "v1", "v2", "v3"}  # the right word: four found values of five, below 0.8 by their scores
    rows += [(None, f"v{i}", "mail", "then") for i in range(4, 8)]
    found = {r["value"] for r in bootstrap(spark.createDataFrame(rows, "kind int, value string, before string, after string")).collect()}
    assert found == {f"v{i}" for i in range(8)} | {"w7"}
