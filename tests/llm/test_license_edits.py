"""Every template with one word inserted, dropped or replaced at every place."""

import re

import pytest

from lanewise.llm.licenses import COVERAGE, GRAM, TEMPLATES, scan_licenses
from tests.llm.data import documents


def left(n, at, gone, new):
    """Share of the runs of n words that stay when `gone` words at a place give way to `new` ones."""
    runs = n - GRAM + 1
    broken = sum(1 for i in range(runs) if (i < at + gone and at < i + GRAM if gone else i < at < i + GRAM))
    return (runs - broken) / runs


def test_one_edit_anywhere(spark):
    texts, want = [], []
    for label, text in TEMPLATES.items():
        w = re.findall("[a-z0-9]+", text.lower())
        for at in range(len(w)):
            for gone, new in ((0, ["zzz"]), (1, []), (1, ["zzz"])):
                texts.append(" ".join(["start", *w[:at], *new, *w[at + gone:], "end"]))
                want.append((label, left(len(w), at, gone, new), 1 + len(w) - gone + len(new)))
    for r in scan_licenses(documents(spark, texts)).collect():
        label, share, end = want[r["doc_id"]]
        own = [s for s in r["spans"] or [] if s["label"] == label]
        if share >= COVERAGE:
            # A run that the edit breaks may still stand where the template repeats it.
            assert len(own) == 1 and own[0]["coverage"] >= share - 1e-9, texts[r["doc_id"]]
            assert own[0]["end_word"] <= end and label in r["labels"].split(",")


def test_two_copies_stay_apart(spark):
    text = TEMPLATES["apache-2.0-notice"]
    r = scan_licenses(documents(spark, [f"{text} {text}"])).collect()[0]
    own = [s for s in r["spans"] if s["label"] == "apache-2.0-notice"]
    n = len(re.findall("[a-z0-9]+", text.lower()))
    assert [(s["first_word"], s["end_word"], s["coverage"]) for s in own] == [(0, n, pytest.approx(1)), (n, 2 * n, pytest.approx(1))]
