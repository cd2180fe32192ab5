"""Pairs of sets that share a common passage, but too little for a link, are not listed one by one."""

import random

from pyspark.sql import functions as F

from lanewise.llm import linking
from lanewise.llm import ngram_join as N
from tests.llm.data import documents
from tests.llm.test_links import brute_components


def test_keys_of_a_common_passage_list_no_pairs_that_share_too_few(spark):
    # 80 nodes of 100 shingles that match four times: a common passage gives each the same ten keys; every other node shares ten more with the next.
    rows = [(k, n) for n in range(80) for k in range(10)] + [(1000 + n // 2 * 10 + k, n) for n in range(80) for k in range(10)]
    held = spark.createDataFrame([(k, n, 100 * 16 + 4, n) for k, n in rows], "key long, node long, meta long, component long")
    need = held.select(N._need(F.col("meta"), F.col("meta")).alias("n")).first()["n"]
    assert need == 13
    every, few = linking.listings(held, N._fits, None)[0], linking.listings(held, N._fits, N._need)[0]
    assert every.count() == 10 * 80 * 79 // 2 + 40 * 10
    assert few.count() == 40 * (20 - need + 1)
    want = {(n, n + 1) for n in range(0, 80, 2)}
    assert {tuple(r) for r in linking.listed_pairs(held, N._fits, N._need).collect()} == want
    assert {tuple(r) for r in linking.listed_pairs(held, N._fits, None).collect()} == want


def test_components_among_common_passages(spark):
    rng = random.Random(2)
    passage = [[f"p{j}x{i}" for i in range(25)] for j in range(3)]
    texts = []
    for i in range(150):
        own = [f"w{i // 3}y{k}" for k in range(60 + 10 * (i % 2))]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(passage[i % 3] + own + passage[(i + 1) % 3] * (i % 4 == 0)))
    assert {tuple(r) for r in N.jaccard_components(documents(spark, texts)).collect()} == brute_components(texts)
