"""The filter audit against a run of every order, document by document."""

import random
import re
from itertools import permutations

from lanewise.llm.filter_audit import audit_filters
from tests.llm.data import clashing, documents

OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """{(part, order, step): counts} by applying each order to each document."""
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    docs = [(d, t or "", p or "") for d, t, p in rows]
    failing = []
    for d, t, p in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": any(d is not None and e is not None and e < d and t == u for e, u, _ in docs)}
        failing.append((p, {k for k in f if f[k]}, d in good, d in toxic))
    out, shapley = {}, {}
    for p in {p for _, _, p in docs}:
        own = [x for x in failing if x[0] == p]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, k in enumerate(order, 1):
                removed = [x for x in left if k in x[1]]
                left = [x for x in left if k not in x[1]]
                redundant = sum(k in x[1] for x in own) - len(removed)
                shapley[p, k] = shapley.get((p, k), 0) + len(removed)
                out[p, order, step] = [len(left), len(removed), redundant, sum(x[1] == {k} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def compare(spark, rows, labels, extra=()):
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *extra)
    got = audit_filters(docs, clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), *extra))
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in OUT) for r in got.collect()} == brute(rows, labels)


def texts(rng):
    plain = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 150, 199, 200, 260]))]
    dull = [f"w{rng.randrange(60)}" for _ in range(230)]
    kinds = [" ".join(plain), " ".join(dull), " ".join(plain).upper(), " \t".join(plain) + " 100%", "\n".join(dull) + " A|B", "", "ß É\x0b\x0c\r", "UP"]
    return rng.choice(kinds)


def test_all_orders_of_random_documents(spark):
    rng = random.Random(4)
    pool = [texts(rng) for _ in range(40)]
    rows = [(i, rng.choice([*pool, None]), rng.choice(["en", "de", None, ""])) for i in range(160)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)]
    compare(spark, rows, labels, ("hash", "part", "n", "bits", "slices", "good", "step"))


def test_repeated_and_missing_ids_and_labels(spark):
    rows = [(1, "same", "en"), (1, "same", "en"), (1, "same", "de"), (None, "same", "en"), (None, "same", "en"), (2, "same", "en"),
            (2, "other", "en"), (3, None, None), (4, "", None), (-1, "other", "en")]
    compare(spark, rows, [(1, 0, 1), (1, 1, None), (None, 1, 1), (4, 1, 0), (99, 1, 1)])


def test_group_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr("lanewise.llm.filter_audit.SLICE", 200)
    rows = [(i, "copy of one text" if i % 3 else f"text {i % 7}", "en") for i in range(90)]
    compare(spark, rows, [(i, i % 2, int(i % 5 == 0)) for i in range(90)])


def test_a_very_long_text_and_no_documents(spark):
    long = " ".join(f"w{i % 70000}" for i in range(200_000))
    compare(spark, [(1, long, "en"), (2, long, "en"), (3, long + " x", "en")], [(2, 1, 1)])
    empty = audit_filters(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0 and "shapley" in empty.columns
