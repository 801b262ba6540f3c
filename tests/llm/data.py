"""Small documents with every awkward case, and brute-force twins."""

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
WORDS = [f"w{i}x" for i in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(70, "passage")
BASE = prose(160, "base")


def edited(text, k, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
    return " ".join(w)


def rows():
    out = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, "one two three four five"), (7, "ONE TWO three four five"),
        (8, BASE), (9, BASE), (9, BASE), (10, edited(BASE, 2, 1)), (11, edited(BASE, 3, 2)), (12, edited(BASE, 12, 3)),
        (13, prose(40, 13) + " " + PASSAGE + " " + prose(30, 14)), (14, PASSAGE + "\n" + prose(50, 15)), (15, prose(20, 16) + "\n\n" + PASSAGE),
        (16, "same " * 200), (17, "same " * 90), (None, prose(60, 18)), (None, prose(60, 19)), (None, prose(60, 19)),
        (18, prose(3000, 20)), (19, prose(3000, 20)[:9000]), (20, "naïve café — “quoted” İstanbul ΣΑΣ " * 12), (21, "<|endoftext|> don't we'll 12.5 x,—y " * 3),
        (22, PASSAGE), (23, "x" * 5000), (24, "a b c \u0000 d"),
    ]
    out += [(100 + i, edited(BASE, 4, 100 + i)) for i in range(12)]
    return [(i, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(out)]


def frame(spark, data=None, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, DOCS).repartition(3)
    # extra columns whose names clash with the operators' own
    return df.withColumns({"k1": F.lit("x"), "score": F.lit(1), "cid": F.lit(None).cast("string"), "n_words": F.lit("y")}) if extra else df


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def repeated(texts, window):
    """For each text, which words a window covers that also starts elsewhere."""
    words = [space_words(t) for t in texts]
    c = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        g = [False] * len(w)
        for k in range(len(w) - window + 1):
            if c[tuple(w[k : k + window])] > 1:
                g[k : k + window] = [True] * window
        out.append((w, g))
    return out


def shingle_set(t, n=5):
    w = space_words(lower(t))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(keys, linked):
    up = dict(zip(range(len(keys)), range(len(keys))))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(keys)):
        for j in range(i + 1, len(keys)):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(keys)):
        groups.setdefault(find(i), []).append(keys[i])
    first = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [first[find(i)] for i in range(len(keys))]
