"""Exact substring dedup by seed and extend on winnowed anchors.

A window is ``window`` consecutive words of one document.  Its anchor is the word k-gram in it with the smallest
hash (the leftmost of equals), so equal windows have equal anchors at equal places.  Each anchor occurrence is
extended to both sides over all windows that it anchors; occurrences with the same extended words form a class.

- A class with two or more occurrences repeats as a whole: all its windows are covered.
- A class of one whose anchor occurs nowhere else has no repeated window.
- Otherwise one occurrence of every class with that anchor is extended window by window, and windows that start
  in two places are kept.  Passage edges are the usual case, so these are few.

No pair of occurrences is formed: classes and windows are counted by partial aggregates, so a passage that a third
of all documents share costs one row per document.  Runs of covered windows are the maximal repeats.

Hashes have 64 bits.  Defined cases: null text has no words; rows with equal id and text count as separate
documents (each is a copy of the other); texts below one window are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import (
    SpanHash, bounded_batches, discard, gram_hashes, integral, key_id, keyed, lean, row_key, signed, spare, stored, text_bytes, word_hashes,
)

OCCURRENCES = "h long, sh long, k1 long, k2 long, n int, spans array<int>"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    n, m, w = len(x) - width + 1, x, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:n], m[width - w : width - w + n])


def anchors(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions with the first and last start of the windows that they anchor."""
    n, width = len(h) - window + 1, window - k + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e
    g = gram_hashes(h, k)
    low = _least(g, width)
    # from one window to the next the anchor moves only if the entering gram is smaller, or if it was the one that left
    enter, left = np.zeros(n, bool), np.zeros(n, bool)
    enter[1:] = g[width:] < low[:-1]
    left[1:] = g[: n - 1] == low[:-1]
    left[0] = True
    left &= ~enter
    at = np.arange(n) + width - 1
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    gone = np.flatnonzero(left)
    for lo in range(0, len(gone), 65_536):
        part = gone[lo : lo + 65_536]
        at[part] = part + view[part].argmin(1)
    first = np.flatnonzero(enter | left)
    at = at[first]
    new = np.concatenate(([True], at[1:] != at[:-1]))  # a rescan may find what was there
    at, first = at[new], first[new]
    return at, first, np.concatenate((first[1:], [n])) - 1


def occurrences(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, class hash, first window, last window) of each anchor occurrence."""
    at, lo, hi = anchors(h, window, k)
    if not len(at):
        e = np.empty(0, np.int64)
        return e, e, e, e
    spans = SpanHash(h)
    own = spans(at, at + k)
    # the class: the extended words and where the anchor stands in them
    whole = spans(lo, hi + window) ^ ((at - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return signed(own), signed(whole), lo, hi


def _emit(window: int, k: int):
    """The occurrences of each text by (anchor, class): OCCURRENCES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, shs, sizes, spans, doc = [], [], [], [], []
            for i, words in enumerate(word_hashes(text_bytes(batch.column("text")))):
                h, sh, lo, hi = occurrences(words, window, k)
                if not len(h):
                    continue
                order = np.lexsort((lo, sh, h))
                h, sh = h[order], sh[order]
                cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (sh[1:] != sh[:-1]))))
                hs.append(h[cut])
                shs.append(sh[cut])
                sizes.append(np.diff(np.concatenate((cut, [len(h)]))))
                spans.append(np.stack((lo[order], hi[order]), 1).astype(np.int32).ravel())
                doc.append(np.full(len(cut), i))
            if not hs:
                continue
            n, at = np.concatenate(sizes), np.concatenate(doc)
            ends = np.concatenate(([0], np.cumsum(2 * n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hs)), pa.array(np.concatenate(shs)), batch.column("k1").take(pa.array(at)), batch.column("k2").take(pa.array(at)),
                    pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(spans))),
                ],
                names=["h", "sh", "k1", "k2", "n", "spans"],
            )

    return lean(run)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0], lo[1]..hi[1], ... end to end."""
    n = hi - lo + 1
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _windows(window: int):
    """Hashes of the windows of listed occurrences: (w, k1, k2, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(word_hashes(text_bytes(batch.column("text")))):
                spans = SpanHash(words)
                flat = np.array(batch.column("wanted")[i].as_py(), np.int64).reshape(-1, 2)
                at = ranges(flat[:, 0], flat[:, 1])
                own = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(spans(at, at + window))), batch.column("k1").take(own), batch.column("k2").take(own), pa.array(at.astype(np.int32))],
                    names=["w", "k1", "k2", "at"],
                )

    return lean(run)


def repeated_windows(spark: SparkSession, rows: DataFrame, window: int, k: int) -> DataFrame:
    """(k1, k2, lo, hi): runs of window starts lo..hi whose windows also start elsewhere; rows is keyed()."""
    occ = stored(spark, rows.where("text is not null").mapInArrow(_emit(window, k), OCCURRENCES), "anchors")
    seeds = (
        occ.groupBy("h").agg(F.sum("n").alias("total"), F.min("sh").alias("a"), F.max("sh").alias("b"))
        .where("total > 1").select("h", (F.col("a") != F.col("b")).alias("several"))
    )
    seeded = stored(spark, occ.join(seeds, "h"), "seeded")
    discard(occ)
    classes = (
        seeded.where("several").groupBy("h", "sh")
        .agg(F.sum("n").alias("copies"), F.min(F.struct("k1", "k2", F.slice("spans", 1, 2).alias("span"))).alias("one"))
    )
    classes = stored(spark, classes, "classes")
    repeats = classes.where("copies > 1").select("h", "sh")
    whole = seeded.where("not several").select("k1", "k2", "spans").unionAll(
        seeded.where("several").join(repeats, ["h", "sh"]).select("k1", "k2", "spans")
    )
    runs = whole.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))).alias("i"), "spans").select(
        "k1", "k2", F.get("spans", F.col("i")).alias("lo"), F.get("spans", F.col("i") + 1).alias("hi")
    )
    listed = classes.select("one.*").groupBy("k1", "k2").agg(F.flatten(F.collect_list("span")).alias("wanted"))
    windows = rows.join(listed, ["k1", "k2"]).mapInArrow(_windows(window), "w long, k1 long, k2 long, at int")
    windows = stored(spark, windows.dropDuplicates(["w", "k1", "k2", "at"]), "windows")
    twice = windows.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    edges = windows.join(twice, "w").select("k1", "k2", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return runs.unionAll(edges)


def _drop(window: int):
    """(k1, k2, n_words, n_removed, kept) of each text and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, kept = [], [], []
            runs = batch.column("runs").to_pylist()
            for text, own in zip(text_bytes(batch.column("text")), runs):
                words = text.split()
                gone = covered(len(words), own, window)
                left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                n_words.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["k1", "k2", "n_words", "n_removed", "kept"],
            )

    return lean(run)


DROPPED = "k1 long, k2 long, n_words long, n_removed long, kept string"


def covered(n: int, runs, window: int) -> np.ndarray | None:
    """Which of n words the windows of flat (lo, hi, lo, hi, ...) cover; None if none."""
    if runs is None or not len(runs):
        return None
    flat = np.asarray(runs, np.int64).reshape(-1, 2)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, flat[:, 0], 1)
    np.add.at(edge, flat[:, 1] + window, -1)
    return np.cumsum(edge[:n]) > 0


def drop_repeats(docs: DataFrame, window: int = 35, k: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (its words outside every repeated window, joined by one
    space), with the row key (k1, k2) for joins.  All copies of a passage are removed."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed(docs, id_col, text_col)
    runs = repeated_windows(spark, rows, window, k).groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("runs"))
    out = rows.join(runs, ["k1", "k2"], "left").select("k1", "k2", "text", "runs").mapInArrow(_drop(window), DROPPED)
    return out.withColumn("doc_id", key_id("k1"))


def cut_repeats(docs: DataFrame, window: int = 35, k: int = 12) -> DataFrame:
    """docs with every repeated window cut out of the text, as drop_repeats decides, and all other columns kept.

    A document of which nothing is left goes.  Untouched texts stay byte for byte, and what is left of a cut text
    keeps its white space; n_chars follows a changed text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    integral(docs, "doc_id")
    a, b, found, changed = spare(docs, "__k1", "__k2", "__runs", "__changed")
    runs = repeated_windows(spark, keyed(docs), window, k).groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias(found))
    tagged = docs.withColumn("text", F.col("text").cast("string")).withColumns(dict(zip((a, b), row_key())))
    joined = tagged.join(runs.withColumnsRenamed({"k1": a, "k2": b}), [a, b], "left").select(*docs.columns, found)
    own = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(docs_columns))]
            texts, cuts = columns[own], batch.column(len(docs_columns))
            if cuts.null_count < len(cuts):
                texts = [t.as_py() if not r.is_valid else cut_words(t.as_py(), r.as_py(), window) for t, r in zip(texts, cuts)]
                columns[own] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, cuts.is_valid()], names=[*docs_columns, changed])

    docs_columns = list(docs.columns)
    fields = [tagged.schema[c] for c in docs_columns]
    out = joined.mapInArrow(lean(run), StructType([*fields, StructField(changed, BooleanType())]))
    out = out.where(~F.col(changed) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(changed), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def cut_words(text: str | None, runs, window: int) -> str | None:
    """text without the words that the runs of windows cover; what is left keeps its white space."""
    if text is None or runs is None:
        return text
    raw = text.encode()
    space = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    gone = covered(len(starts), runs, window)
    turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    out, pos = [], 0
    for a, b in zip(turn[::2], turn[1::2]):
        out.append(raw[pos : starts[a]])
        pos = stops[b - 1]
    left = b"".join([*out, raw[pos:]]).decode()
    return left if left.strip(" \t\n\r\x0b\x0c") else ""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document: words in 35-word windows that stand elsewhere."""
    found = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
