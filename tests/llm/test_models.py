"""Learned operators, the index of test items, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import decontamination as D
from lanewise.llm import language as L
from lanewise.llm import quality as Q
from lanewise.llm.packing import Encoder, tokenizer_path
from tests.llm.data import LOWER, clashing, documents, sentence


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_scores(items, passage):
    """BM25 of every unit for the distinct words of a passage, as shares of the unit's own score."""
    units = []
    for i, (_, text) in enumerate(items):
        w = tokens(text)
        units += [(i, w[max(0, min(at, len(w) - D.UNIT)):at + D.UNIT]) for at in range(0, len(w), D.UNIT)]
    df, mean = Counter(x for _, w in units for x in set(w)), np.mean([len(w) for _, w in units])
    out = []
    for _, w in units:
        weight = {x: math.log1p((len(units) - df[x] + 0.5) / (df[x] + 0.5)) * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * len(w) / mean)) for x, n in Counter(w).items()}
        out.append(sum(v for x, v in weight.items() if x in set(passage)) / sum(weight.values()))
    return out


def test_retrieval_is_whole():
    """Block-max pruning finds exactly the units at the threshold or above."""
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randrange(3, 90), 60)) for i in range(70)]
    index = D.Index(items)
    passages = [tokens(sentence(rng, rng.randrange(5, 128), 80)) for _ in range(60)] + [tokens(t) for _, t in items[:5]] + [["unknown"]]
    from lanewise.llm.hashing import NOT_ALNUM, hash_words
    pairs = []
    for p, w in enumerate(passages):
        term = index.terms(hash_words(" ".join(w).encode(), NOT_ALNUM))
        pairs += [(p, t) for t in set(term[term >= 0].tolist())]
    passage, term = np.array(pairs).T
    found = set(zip(*(x.tolist() for x in index.retrieve(passage, term, len(passages))[:2]), strict=True))
    want = {(p, u) for p, w in enumerate(passages) for u, s in enumerate(brute_scores(items, w)) if s >= D.THRESHOLD - 1e-9}
    assert found == want and len(want) > 5


@pytest.mark.parametrize("shard", [2, 1000])
def test_leaks(spark, shard):
    rng = random.Random(8)
    items = [(i, f"{sentence(rng, 20, 3000)}? {sentence(rng, 6, 3000)}.") for i in range(4)] + [(9, sentence(rng, 150, 3000)), (10, ""), (11, None), (None, "x y")]
    near = items[1][1].split()
    near[7] = "other"
    texts = [f"{sentence(rng, 200, 3000)} {items[0][1].upper()} {sentence(rng, 300, 3000)}", " ".join(near), items[2][1].split("?")[0], sentence(rng, 3000, 3000), "", None,
             f"{sentence(rng, 61, 3000)} {items[9 - 5][1]}", items[3][1] + " " + items[2][1]]
    docs = clashing(documents(spark, texts), "item_id", "score")
    table = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = D.find_leaks(docs, table, shard)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(0, 0), (1, 1), (6, 9), (7, 2), (7, 3)}
    kept = D.decontaminate(docs, table, shard)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 5}
    none = table.filter("false")
    assert D.find_leaks(docs, none).count() == 0 and D.decontaminate(docs, none).count() == len(texts)
    assert D.find_leaks(docs.filter("false"), table).count() == 0


def brute_bits(samples, text):
    """Prediction by partial matching, byte by byte, from plain dictionaries."""
    def plain(t):
        t = re.sub(rb"[^a-z\x80-\xff]+", b" ", (" " * L.ORDER + t.lower()).encode())
        return b" " * L.ORDER + t.lstrip(b" ")

    trees = [defaultdict(Counter) for _ in range(L.ORDER + 1)]
    for s in samples:
        x = plain(s)
        for i in range(L.ORDER, len(x)):
            for k in range(L.ORDER + 1):
                trees[k][x[i - k:i]][x[i]] += 1
    x, total = plain(text), 0.0
    for i in range(L.ORDER, len(x)):
        for k in range(L.ORDER, -1, -1):
            own = trees[k].get(x[i - k:i])
            if not own or (k > 2 and sum(own.values()) < 2):
                continue
            whole = sum(own.values()) + len(own)
            if x[i] in own:
                total -= math.log2(own[x[i]] / whole)
                break
            total -= math.log2(len(own) / whole)
        else:
            total += 8
    return total


def test_code_lengths_byte_by_byte():
    a, b = ["the cat sat on the mat. The Mat!", "a cat, then the rat"], ["der Kater saß auf der Matte", "über die Ratte"]
    trees = L.Trees([*L._counted(a + b, ["a"] * len(a) + ["b"] * len(b))])
    texts = ["the cat", "Über Katzen 123 und Mäuse", "", "zzzz", "the the\n\nthe", "東京"]
    got = trees.bits(texts)
    assert trees.langs == ["a", "b"]
    for row, t in zip(got, texts, strict=True):
        assert row == pytest.approx([brute_bits(a, t), brute_bits(b, t)], rel=1e-5, abs=1e-4)


def test_languages(spark):
    rng = random.Random(5)
    words = {"en": "the of and cat house tree going where".split(), "de": "der und die katze haus baum gehend wohin".split(), "fr": "le et la chat maison arbre allant où".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60))), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (1003, "der katze haus und", None), (None, "the cat going where", "fr"), (1004, "the tree " * 30_000, None)]
    got = L.identify(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang_pred", "held_out")).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows[:180])
    assert {i: by[i]["held_out"] for i, _, _ in rows[:180]} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(180)}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "de" and by[None]["lang_pred"] == "en" and by[1004]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert L.identify(nothing).collect()[0]["lang_pred"] == "und"
    assert L.identify(nothing.filter("false")).count() == 0


def quality_rows(n=400, seed=2):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = ". ".join(sentence(rng, rng.randrange(5, 15)).capitalize() for _ in range(rng.randrange(1, 9)))
        if not good:
            text = rng.choice([lambda t: t.upper() + "!!", lambda t: re.sub(r"(\w+)", r"\1***", t), lambda t: (t.split()[0] + " ") * 40])(text)
        rows.append(text)
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark):
    texts, labels = quality_rows()
    docs = clashing(documents(spark, [*texts, "", None, "x" * 40_000]), "score", "positive")
    # Half of the labels are known; bad labels only tell the prior.
    known = spark.createDataFrame(labels[::2] + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in Q.score_quality(docs, known).collect()}
    assert len(got) == len(texts) + 3
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(labels[i][1], got[i]["predicted"]) for i in range(len(texts)) if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = Q.keep_good(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_without_labels(spark):
    docs, none = documents(spark, ["a b", None]), spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in Q.score_quality(docs, none).collect()] == pytest.approx([Q.PLAIN_PRIOR] * 2)
    assert Q.score_quality(docs.filter("false"), none).count() == 0


def test_labels_of_the_held_out_fold_are_never_read(spark):
    texts, labels = quality_rows(120)
    docs = documents(spark, texts)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in labels]
    first, second = (sorted(map(tuple, Q.score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flipped))
    assert first == second


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.3, (300, Q.N_FEATURES)), rng.normal(-1, 0.3, (100, Q.N_FEATURES))
    net = Q.fit(good[:100], np.concatenate((good[100:], bad)), 200 / 300)
    assert (net.score(good) > 0.5).mean() > 0.97 and (net.score(bad) < 0.5).mean() > 0.97


def test_pipeline(spark, tmp_path):
    """Junk, repeated lines, copies and test items go; clean documents stay; stages keep the columns."""
    rng = random.Random(12)
    texts, labels = quality_rows(150, seed=3)
    texts = [f"{t} {sentence(rng, 30, 10**6)}" if label[1] else t for t, label in zip(texts, labels, strict=True)]
    clean = "\n".join(". ".join(sentence(rng, 10, 10**6).capitalize() for _ in range(5)) for _ in range(3))
    line = ". ".join(sentence(rng, 12, 10**6).capitalize() for _ in range(3))
    item = f"{sentence(rng, 20, 10**6)}? {sentence(rng, 5, 10**6)}."
    body = [sentence(rng, 12, 10**6).capitalize() for _ in range(20)]
    extra = [clean, f"{line}\n{body[0]}. {body[1]}", f"{body[2]}. {body[3]}\n{line}", ". ".join(body), f"{body[5]}. {item} {body[6]}"]
    docs = documents(spark, texts + extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmarks", "packing"]
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        at = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "packing":
            assert at.columns == docs.columns
            kept.append({r["doc_id"]: r for r in at.collect()})
            assert all(r["n_chars"] == len(r["text"]) for r in kept[-1].values())
    n = len(texts)
    assert n in kept[-1] and kept[-1][n]["text"] == clean
    assert line in kept[1][n + 1]["text"] and line not in kept[1][n + 2]["text"]
    assert n + 4 in kept[2] and n + 4 not in kept[3]
    packed = at.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3]) and all(r["n"] == r["m"] for r in packed)
    tokenizer, stored = Encoder(tokenizer_path()).tokenizer, {}
    for r in at.orderBy("doc_id", "start").collect():
        stored.setdefault(r["doc_id"], []).extend(r["ids"])
    for doc, ids in stored.items():
        assert ids == tokenizer.encode(kept[3][doc]["text"], add_special_tokens=False).ids + [2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
