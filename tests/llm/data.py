"""Hand-made and random tables for the tests, and plain versions of what the operators define."""

import random
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(spark, texts, first=0):
    rows = [(i, t, "en", "test", None if t is None else len(t)) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df, *names):
    """`df` with extra columns whose names the operators use for themselves."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed=1, groups=6, size=8, words=60):
    """Texts in groups of near copies, a chain among them, with exact copies, short, blank and missing texts."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = sentence(rng, words, 5000).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    chain = sentence(rng, 80, 5000).split()
    for i in range(6):
        chain = [*chain[1:], f"c{i}"]
        out.append(" ".join(chain))
    out += [out[0], out[0].upper(), "one two", "one  two\n", "One\tTwo", "", None, "   \n", "a b c d e", "a b c d e f", "word"]
    return out


class Union:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def jaccard(a, b):
    return len(a & b), len(a | b)
