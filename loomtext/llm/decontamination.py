"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised items (lower-cased A-Z, words of digits, letters and non-ASCII characters) make one automaton.  A
document's words are streamed through it; the state and the longest matching length after each word tell every
window (``window`` consecutive item words; a shorter item is one window) that ends there, and so the words that
are hit and the items they come from.

To skip text that cannot match, only every few words is a run of three words looked up first, at such a step that
every window holds one of the runs looked up; the surroundings of runs that items hold go through the automaton.
This drops nothing.

Items are read in blocks of about ``block_words`` words, one automaton each, so that what the driver and a worker hold
is bounded however large the benchmark is.  A benchmark of one block takes one pass over the documents.  Of several,
each block's hits are written before the next block is read, and the hits of all blocks are merged per document.

Defined cases: null or empty texts have no words and no hits; items with a null id or no words are left out;
repeated items count once; repeated documents give a row each; an empty benchmark hits nothing; ids that are no
integers are refused; columns of documents stay, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _ALNUM, alnum_words, bounded_batches, claim, discard, integral, keyed, lean, row_key, spare, stored

HITS = "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<long>"


class Automaton:
    """Generalised suffix automaton over item words, with the items of every window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = 8):
        self.window = window
        items = [(i, w) for i, w in items if w]
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.base = len(self.words) + 1
        coded = [(i, [self.words[w] for w in ws]) for i, ws in items]
        self._build([c for _, c in coded])
        self._owners(coded)
        self.shortest = min([window, *(len(c) for _, c in coded)])
        self.gram = min(3, self.shortest)  # base ** 3 stays far below 2 ** 63 at any allowed block size
        grams = {self._code(c[p : p + self.gram]) for _, c in coded for p in range(len(c) - self.gram + 1)}
        self.grams = np.array(sorted(grams), np.int64)

    def _code(self, words) -> int:
        out = 0
        for w in words:
            out = out * self.base + w
        return out

    def _build(self, texts: list[list[int]]) -> None:
        step: dict[int, int] = {}
        out: list[list[int]] = [[]]  # the words that leave each state
        link, length = [-1], [0]
        base = self.base

        def new(n: int) -> int:
            link.append(0)
            length.append(n)
            out.append([])
            return len(length) - 1

        def split(p: int, w: int, q: int) -> int:
            """A state for the prefix of q's strings that p reaches."""
            c = new(length[p] + 1)
            for x in out[q]:
                step[c * base + x] = step[q * base + x]
            out[c] = list(out[q])
            link[c], link[q] = link[q], c
            while p >= 0 and step.get(p * base + w) == q:
                step[p * base + w] = c
                p = link[p]
            return c

        for text in texts:
            last = 0
            for w in text:
                q = step.get(last * base + w)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else split(last, w, q)
                    continue
                cur, p = new(length[last] + 1), last
                while p >= 0 and (p * base + w) not in step:
                    step[p * base + w] = cur
                    out[p].append(w)
                    p = link[p]
                if p >= 0:
                    q = step[p * base + w]
                    link[cur] = q if length[q] == length[p] + 1 else split(p, w, q)
                last = cur
        self.step, self.link, self.length = step, link, length

    def _owners(self, coded: list[tuple[int, list[int]]]) -> None:
        """Items of each window-long string (by its state), and whole items shorter than a window."""
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, text in coded:
            state, n = 0, 0
            for w in text:
                state, n = self.step[state * self.base + w], n + 1
                if n >= self.window:
                    self.items.setdefault(self._window_state(state), set()).add(item)
            if n < self.window:
                s = state
                while self.length[self.link[s]] >= n:
                    s = self.link[s]
                self.short.setdefault(s, []).append((n, item))

    def _window_state(self, s: int) -> int:
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (start, stop) in order without overlaps, and the items whose windows occur."""
        if len(words) < self.shortest or not self.words:
            return [], set()
        ids = np.array(list(map(self.words.get, words, [-1] * len(words))), np.int64)
        regions = self._regions(ids)
        if not regions:
            return [], set()
        step, link, length, base, window = self.step, self.link, self.length, self.base, self.window
        spans: list[list[int]] = []
        found: set[int] = set()
        for lo, hi in regions:
            state, n = 0, 0
            for i, w in enumerate(ids[lo:hi].tolist(), lo):
                if w < 0:
                    state = n = 0
                    continue
                nxt = step.get(state * base + w)
                while nxt is None and state:
                    state = link[state]
                    n = length[state]
                    nxt = step.get(state * base + w)
                if nxt is None:
                    state = n = 0
                    continue
                state, n = nxt, n + 1
                reach = 0
                if n >= window:
                    found |= self.items[self._window_state(state)]
                    reach = window
                if self.short:
                    s = state
                    while s > 0:
                        for m, item in self.short.get(s, ()):
                            if m <= n:
                                found.add(item)
                                reach = max(reach, m)
                        s = link[s]
                if reach:
                    if spans and spans[-1][1] >= i + 1 - reach:
                        spans[-1][0] = min(spans[-1][0], i + 1 - reach)
                        spans[-1][1] = i + 1
                        while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                            a = spans.pop()
                            spans[-1] = [min(spans[-1][0], a[0]), a[1]]
                    else:
                        spans.append([i + 1 - reach, i + 1])
        return [(a, b) for a, b in spans], found

    def _regions(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where windows can be: around the item grams among every (shortest - gram + 1)th gram."""
        at = np.arange(0, len(ids) - self.gram + 1, self.shortest - self.gram + 1)
        code = self._code([ids[at + g] for g in range(self.gram)])
        code[np.any([ids[at + g] < 0 for g in range(self.gram)], axis=0)] = -1
        k = np.searchsorted(self.grams, code)
        k[k == len(self.grams)] = 0
        out: list[list[int]] = []
        for p in at[self.grams[k] == code].tolist():
            lo, hi = max(0, p + self.gram - self.window), min(len(ids), p + self.window)
            if out and lo <= out[-1][1]:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
        return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in blocks of about block_words words; the driver holds one block at a time."""
    integral(benchmark, id_col)
    rows = (
        benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
        .where("i is not null and t is not null").distinct()
    )
    block: list[tuple[int, str]] = []
    n = 0
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        n += len(alnum_words(r.t))
        if n >= block_words:
            yield block
            block, n = [], 0
    if block or n:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    block_words: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: its words, hit spans (word positions) and the items whose windows occur (schema HITS)."""
    out, names = _scan(docs, benchmark, window, block_words, id_col, text_col, None)
    return out.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(own) for c, own in zip(names, ("n_words", "spans", "items"))))


_TYPES = "n_words long, spans array<struct<start:int,stop:int>>, items array<long>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _scan(
    docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, id_col: str, text_col: str, max_span: int | None
) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, whose names come too; spans of more than max_span words are cut from the text."""
    bounded_batches(docs.sparkSession)
    integral(docs, id_col)
    names = spare(docs, "__n_words", "__spans", "__items")
    if dict(docs.dtypes)[text_col] != "string":
        docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    blocks = _blocks(benchmark, "item_id", "text", block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _one_pass(docs, first, window, text_col, max_span, names), names
    return _merge_passes(docs, itertools.chain([first, second], blocks), window, id_col, text_col, max_span, names), names


def _spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in x] for x in found], _SPAN)


def _one_pass(docs: DataFrame, block: list[tuple[int, str]], window: int, text_col: str, max_span: int | None, names: list[str]) -> DataFrame:
    columns = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("benchmark")
        automaton = Automaton([(i, alnum_words(t)) for i, t in block], window)
        own = columns.index(text_col)
        for batch in batches:
            texts = batch.column(own).to_pylist()
            counts, spans, items = [], [], []
            for text in texts:
                words = alnum_words(text)
                got, found = automaton.match(words)
                counts.append(len(words))
                spans.append(got)
                items.append(sorted(found))
            kept = [batch.column(k) for k in range(len(columns))]
            if max_span is not None and any(spans):
                kept[own] = pa.array([_cut(t, s, max_span) if s else t for t, s in zip(texts, spans)], kept[own].type)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.int64()))], names=[*columns, *names]
            )

    added = docs.sparkSession.createDataFrame([], _TYPES).toDF(*names).schema
    return docs.mapInArrow(lean(run), StructType(docs.schema.fields + added.fields))


def _hits(block: list[tuple[int, str]], window: int):
    """(k1, k2, spans, items) of the texts that hold a window of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("benchmark")
        automaton = Automaton([(i, alnum_words(t)) for i, t in block], window)
        for batch in batches:
            got = [automaton.match(alnum_words(t)) for t in batch.column("text").to_pylist()]
            at = pa.array([i for i, (spans, _) in enumerate(got) if spans], pa.int64())
            got = [x for x in got if x[0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1").take(at), batch.column("k2").take(at), _spans([x for x, _ in got]), pa.array([sorted(x) for _, x in got], pa.list_(pa.int64()))],
                names=["k1", "k2", "spans", "items"],
            )

    return lean(run)


def _merge_passes(docs: DataFrame, blocks: Iterator[list[tuple[int, str]]], window: int, id_col: str, text_col: str, max_span: int | None, names: list[str]) -> DataFrame:
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).where("text is not null")
    kinds = "k1 long, k2 long, spans array<struct<start:int,stop:int>>, items array<long>"
    parts = [stored(spark, rows.mapInArrow(_hits(block, window), kinds).dropDuplicates(["k1", "k2"]), "hits") for block in blocks]
    found = reduce(DataFrame.unionAll, parts).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = stored(spark, found.select("k1", "k2", _joined(F.array_sort("spans")).alias(names[1]), F.array_sort(F.array_distinct("items")).alias(names[2])), "hits")
    discard(*parts)
    a, b = spare(docs, "__k1", "__k2")
    out = docs.withColumns(dict(zip((a, b), row_key(id_col, text_col)))).join(found.withColumnsRenamed({"k1": a, "k2": b}), [a, b], "left")
    words = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")
    out = out.withColumns({
        names[0]: words, names[1]: F.coalesce(names[1], F.array().cast(found.schema[names[1]].dataType)), names[2]: F.coalesce(names[2], F.array().cast("array<long>")),
    })
    if max_span is not None:
        cut = F.pandas_udf(lambda t, s: pd.Series([_cut(x, [(r["start"], r["stop"]) for r in y], max_span) for x, y in zip(t, s)], dtype=object), "string")
        some = F.size(names[1]) > 0
        out = out.withColumn(text_col, F.when(some, cut(F.when(some, F.col(text_col)), F.col(names[1]))).otherwise(F.col(text_col)))
    return out.select(*docs.columns, *names)


def _joined(spans: Column) -> Column:
    """Sorted spans without overlaps."""

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["stop"] >= s["start"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(
            F.concat(out, F.array(s))
        )

    return F.aggregate(spans, F.array().cast("array<struct<start:int,stop:int>>"), add)


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words of alnum_words."""
    mark = np.frombuffer(text.translate(_ALNUM), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, max_span: int = 0, max_coverage: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents with spans of more than ``max_span`` hit words cut out of their text.

    A document whose hit words are more than ``max_coverage`` of its words goes.  Other columns stay as they are,
    except n_chars, which follows the new text where the table has it.
    """
    found, (words, spans, _) = _scan(docs, benchmark, window, 100_000, id_col, text_col, max_span)
    hit = F.aggregate(spans, F.lit(0), lambda a, s: a + s["stop"] - s["start"])
    out = found.where(~(hit > F.lit(max_coverage) * F.col(words)))
    changed = F.exists(spans, lambda s: s["stop"] - s["start"] > max_span)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _cut(text: str | None, spans, max_span: int) -> str | None:
    if text is None:
        return None
    raw = text.encode()
    at = word_offsets(raw)
    out, pos = [], 0
    for a, b in spans:
        if b - a > max_span:
            out.append(raw[pos : at[a][0]])
            pos = at[b - 1][1]
    return b"".join([*out, raw[pos:]]).decode()


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, by 8-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )
