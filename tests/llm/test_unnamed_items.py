"""Test items without an id count in the filter, not in the report."""

import random

from lanewise.llm.decontamination import decontaminate, find_leaks
from tests.llm.data import documents, sentence


def test_items_without_an_id(spark):
    rng = random.Random(3)
    items = [f"{sentence(rng, 20, 10**6)}? {sentence(rng, 6, 10**6)}." for _ in range(4)]
    docs = documents(spark, [f"{sentence(rng, 30, 10**6)} {x} {sentence(rng, 30, 10**6)}" for x in items] + [sentence(rng, 80, 10**6)])
    table = spark.createDataFrame([(None, items[0]), (None, items[1]), (1, items[2]), (2, items[3])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, table, 2).collect()} == {(2, 1), (3, 2)}
    for shard in (1, 3, 10):
        assert [r["doc_id"] for r in decontaminate(docs, table, shard).collect()] == [4]
