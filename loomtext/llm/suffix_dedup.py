"""Substring dedup with sparse suffix arrays.

Only the suffixes that start at content-selected positions are kept: in every run of ``window`` words the k-gram with
the smallest hash (its minimiser), so that each repeat of at least ``window`` words holds one suffix start in all of
its copies, at the same place.

- Suffixes are grouped by their first k words; a partial count drops those that no other suffix begins like.
- Suffixes with equal words as far as their windows reach, on both sides, are one class with a count; a class with
  several copies is a repeat as a whole.
- One suffix of every remaining class goes into a suffix array: arrays are dealt by the first k words (large ones in
  salted parts), sorted by the words that follow, and neighbours are compared: the common prefix extends the match to
  the right, the common words before the start extend it to the left.
- A suffix can share a shorter prefix with one that is not its neighbour.  So windows that the neighbours leave open,
  in arrays of three and more, are compared by their hashes over the array's suffixes.  This makes the result exact:
  a word is repeated if a window of ``window`` words that also starts elsewhere covers it.

No pair of copies is formed; hot passages cost one row per document.  Defined cases as in substring_dedup: null text
has no words, rows with equal id and text are copies of each other, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import grouped, whole_groups
from .common import SpanHash, bounded_batches, discard, key_id, keyed, lean, signed, stored, word_hashes
from .substring_dedup import DROPPED, OCCURRENCES, _drop, _emit

SUFFIXES = "h long, salt int, k1 long, k2 long, at int, lo int, hi int, copies long, salted boolean, after binary, before binary, wins binary"
FOUND = "kind int, w long, k1 long, k2 long, lo int, hi int"


def _suffixes(window: int, k: int):
    """The kept suffix of each class with its words after and before the start, and its windows' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k1, k2, words, wanted in zip(pdf["k1"], pdf["k2"], word_hashes([t.encode() for t in pdf["text"]]), pdf["wanted"]):
                short = (words >> np.uint64(32)).astype("<u4")
                spans = SpanHash(words)
                for x in wanted:
                    h, lo, hi = x["h"], x["lo"], x["hi"]
                    at = _start(h, lo, hi, window, k, spans)
                    w = np.arange(lo, hi + 1)
                    rows.append((
                        h, (k2 & 0x7FFFFFFF) % x["parts"], k1, k2, at, lo, hi, x["copies"], x["parts"] > 1, short[at : hi + window].tobytes(),
                        short[lo:at][::-1].tobytes(), signed(spans(w, w + window)).tobytes(),
                    ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUFFIXES.split(", ")])

    return lean(run)


def _start(h: int, lo: int, hi: int, window: int, k: int, spans: SpanHash) -> int:
    """The leftmost k-gram with hash h that all windows lo..hi hold: their minimiser."""
    a = np.arange(hi, lo + window - k + 1)
    return int(a[np.flatnonzero(signed(spans(a, a + k)) == h)[0]])


def common(a: bytes, b: bytes) -> int:
    """Number of four-byte words in the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    lo, hi = 0, n // 4  # the first lo words are equal, the first hi are not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[4 * lo : 4 * mid] == b[4 * lo : 4 * mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _compare(window: int):
    """Sorted neighbours of each array.  kind 0: runs lo..hi of repeated windows; kind 1: a window left open, its
    hash w and place lo."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["h", "salt"]):
            h, salt = pdf["h"].to_numpy(), pdf["salt"].to_numpy()
            edge = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
            k1, k2, at, lo, hi, copies = (pdf[c].to_numpy() for c in ("k1", "k2", "at", "lo", "hi", "copies"))
            salted, n = pdf["salted"].to_numpy(), len(pdf)
            after, before, wins = pdf["after"].tolist(), pdf["before"].tolist(), [np.frombuffer(w, np.int64) for w in pdf["wins"]]
            right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)  # common words with the suffix before
            near = np.ones(n, bool)
            near[np.concatenate(([0], edge))] = False
            for i in np.flatnonzero(near).tolist():
                right[i], left[i] = common(after[i - 1], after[i]), common(before[i - 1], before[i])
            shift = np.zeros(n, np.int64)
            shift[1:] = at[1:].astype(np.int64) - at[:-1]
            prev = np.maximum(np.arange(n) - 1, 0)
            a = np.maximum(np.maximum(lo[prev], at[prev] - left), lo - shift)
            b = np.minimum(np.minimum(hi[prev], at[prev] + right - window), hi - shift)
            open_ = (hi - lo + 1).astype(np.int64)
            shut: dict[int, np.ndarray] = {}
            out: list[np.ndarray] = []
            for i in np.flatnonzero(near & (a <= b)).tolist():
                x, y, s, e = i - 1, i, int(a[i]), int(b[i])
                move = int(shift[i])
                if (wins[x][s - lo[x] : e - lo[x] + 1] != wins[y][s + move - lo[y] : e + move - lo[y] + 1]).any():
                    continue
                out += [(x, s, e), (y, s + move, e + move)]
                for k, p, q in ((x, s, e), (y, s + move, e + move)):
                    if k not in shut:
                        shut[k] = np.zeros(len(wins[k]), bool)
                    shut[k][p - lo[k] : q - lo[k] + 1] = True
            for k, m in shut.items():
                open_[k] -= m.sum()
            runs = np.array(out, np.int64).reshape(-1, 3)
            yield pd.DataFrame({"kind": 0, "w": 0, "k1": k1[runs[:, 0]], "k2": k2[runs[:, 0]], "lo": runs[:, 1].astype(np.int32), "hi": runs[:, 2].astype(np.int32)})
            # neighbours settle an array of two; else a window may be shared with a suffix further off, and in a
            # salted array with one of another part, open or not: all of its windows are compared
            first = np.concatenate(([0], edge))
            size = np.diff(np.concatenate((first, [n])))
            group = np.repeat(np.arange(len(first)), size)
            unsettled = np.bincount(group, (open_ > 0) & (copies == 1), len(first)) > 0
            rows = np.flatnonzero(((unsettled & (size > 2)) | salted[first])[group])
            if len(rows):
                many = hi[rows].astype(np.int64) - lo[rows] + 1
                own = np.repeat(rows, many)
                place = (np.repeat(lo[rows].astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
                yield pd.DataFrame({"kind": 1, "w": np.concatenate([wins[k] for k in rows.tolist()]), "k1": k1[own], "k2": k2[own], "lo": place, "hi": place})

    return lean(run)


def repeated_runs(spark: SparkSession, rows: DataFrame, window: int, k: int, array_rows: int) -> DataFrame:
    """(k1, k2, lo, hi): runs of window starts whose windows also start elsewhere; rows is keyed()."""
    occ = stored(spark, rows.where("text is not null").mapInArrow(_emit(window, k), OCCURRENCES), "minimisers")
    shared = (
        occ.groupBy("h").agg(F.sum("n").alias("total"), F.min("sh").alias("a"), F.max("sh").alias("b"))
        .where("total > 1").select("h", (F.col("a") != F.col("b")).alias("several"))
    )
    kept = stored(spark, occ.join(shared, "h"), "suffixes")
    discard(occ)
    classes = stored(
        spark,
        kept.where("several").groupBy("h", "sh").agg(F.sum("n").alias("copies"), F.min(F.struct("k1", "k2", F.slice("spans", 1, 2).alias("span"))).alias("one")),
        "suffix-classes",
    )
    whole = kept.where("not several").select("k1", "k2", "spans").unionAll(
        kept.where("several").join(classes.where("copies > 1").select("h", "sh"), ["h", "sh"]).select("k1", "k2", "spans")
    )
    runs = whole.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))).alias("i"), "spans").select(
        "k1", "k2", F.get("spans", F.col("i")).alias("lo"), F.get("spans", F.col("i") + 1).alias("hi")
    )
    large = classes.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > array_rows).select("h", F.ceil(F.col("c") / array_rows).cast("int").alias("parts"))
    wanted = classes.join(large, "h", "left").select(
        "one.k1", "one.k2",
        F.struct("h", F.get("one.span", 0).alias("lo"), F.get("one.span", 1).alias("hi"), "copies", F.coalesce("parts", F.lit(1)).alias("parts")).alias("x"),
    )
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted"))
    suffixes = rows.join(wanted, ["k1", "k2"]).mapInPandas(_suffixes(window, k), SUFFIXES)
    suffixes = suffixes.dropDuplicates(["h", "k1", "k2", "at"])  # a repeated row has its class's suffix once
    found = stored(spark, grouped(suffixes, ["h", "salt"], ["after"]).mapInPandas(_compare(window), FOUND), "neighbours")
    open_windows = found.where("kind = 1")
    twice = open_windows.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    return runs.unionAll(found.where("kind = 0").select("k1", "k2", "lo", "hi")).unionAll(
        open_windows.join(twice, "w").select("k1", "k2", "lo", "hi")
    )


def find_repeats(
    docs: DataFrame, window: int = 50, k: int = 16, array_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed (words in repeats of at least ``window`` words) and kept (the other
    words, joined by one space), with the row key (k1, k2).  ``array_rows``: from how many suffixes an array is dealt
    into salted parts; it changes no result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed(docs, id_col, text_col)
    runs = repeated_runs(spark, rows, window, k, array_rows).groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("runs"))
    out = rows.join(runs, ["k1", "k2"], "left").select("k1", "k2", "text", "runs").mapInArrow(_drop(window), DROPPED)
    return out.withColumn("doc_id", key_id("k1"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_repeated and kept_sha256: words in passages of at least 50 words that stand elsewhere."""
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", F.col("n_removed").alias("n_repeated"), F.sha2("kept", 256).alias("kept_sha256"))
