"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct word 5-grams (64-bit hashes).  Equal sets are one class.  Two sets A and B reach
Jaccard similarity t only if they share one of the first |A| - ceil(t |A|) + 1 and |B| - ceil(t |B|) + 1 elements in
any common order, so these prefixes route classes to blocks; elements that are frequent inside some input partition
come last in the order, which keeps frequent passages out of the prefixes.  The order decides cost, never results.

Inside blocks, candidates come from R-trees over count vectors: the elements are hashed to groups, a class is the
point of its group counts, and two classes share at most the sum of the smaller counts.  A block's points are packed
into nodes by size, level upon level; a node is bounded by its largest counts and smallest size, and a search descends
from the root only where that bound still allows a link.  All trees of a batch are searched at once.  A pair must
also pass the positional filter at the shared element, and large sets a bound over finer groups.

Only components are asked for.  Small blocks return their candidate pairs, large ones star edges of their candidate
graph; the components of all of these are clusters.  Every class's text is sent to its cluster, where sets are built
and pairs that are not yet connected are verified by the exact similarity; see Clusters for large ones.  Nothing is
lost: linked classes share enough blocks, pass both filters and meet in a cluster.

Defined cases: null or empty texts and texts of white space have an empty set and stay alone; fewer words than n are
one shingle, the whole sequence; repeated rows are copies of each other; null ids: see keyed(), such a row's component
is the smallest id of its group or null; ids that are no integers are refused; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import grouped, stream_groups, whole_groups
from .common import (
    NO_ID, bounded_batches, connected_components, discard, frequency_threshold, gram_hashes, key_id, keyed, lean, mix, row_key, signed, sized,
    spare, stored, text_bytes, word_hashes,
)

#: Groups of the count vectors of all sets, and the finer ones of large sets.
GROUPS, FINE = 64, 256
#: A saturated count stands for any larger one.
FULL = 255
WIDE = 512
#: Sets from this size share at least one more element than this share of it in their (longer) prefixes.
LARGE, SHARE = 512, 0.03


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of the word hashes h."""
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < n:
        return mix(gram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(gram_hashes(h, n))


def text_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    return [shingles(h, n) for h in word_hashes([t.lower() for t in texts])]


def count_vector(s: np.ndarray, groups: int) -> np.ndarray:
    """How many elements fall into each group; ``groups`` is a power of two, and coarser groups are unions."""
    return np.bincount((s >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups).astype(np.int32)


def packed(counts: np.ndarray) -> bytes:
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def point(s: np.ndarray) -> bytes:
    """A set's count vector: fine groups for large sets."""
    return packed(count_vector(s, FINE if len(s) >= LARGE else GROUPS))


def points(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed vectors: all as GROUPS counts, the fine ones, and each row's place among those (-1: none)."""
    size = np.array([len(x) for x in raw])
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
    out, place = np.empty((len(raw), GROUPS), np.uint8), np.full(len(raw), -1)
    small, large = np.flatnonzero(size == GROUPS), np.flatnonzero(size == FINE)
    out[small] = data[at[small][:, None] + np.arange(GROUPS)]
    fine = data[at[large][:, None] + np.arange(FINE)]
    out[large] = np.minimum(fine.reshape(len(large), FINE // GROUPS, GROUPS).sum(1, dtype=np.int32), FULL)
    place[large] = np.arange(len(large))
    return out, fine, place


def shared_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts; where both are saturated the bound is open."""
    low = np.minimum(a, b)
    out = low.sum(1, dtype=np.int64)
    if low.dtype == np.uint8 and len(low) and low.max() == FULL:
        out[(low == FULL).any(1)] = 1 << 60
    return out


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1  # n - ceil(percent n / 100) + 1


def shared_keys(n: np.ndarray) -> np.ndarray:
    """How many prefix elements a pair must share, by its smaller size: prefixes are longer by one less.  One rare
    passage in common would otherwise make candidates of large sets."""
    return np.where(n >= LARGE, 1 + np.floor(n * SHARE).astype(np.int64), 1)


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of these sizes."""
    return -((-percent * (na + nb)) // (100 + percent))


def levels(first: np.ndarray, counts: np.ndarray, sizes: np.ndarray, fan: int) -> list[tuple[np.ndarray, ...]]:
    """The packed R-trees of all blocks, from the leaves up to one root a block.  Each level: the first child of each
    node, where its children end, its largest counts, its smallest size, the first node of each block."""
    out, top, high, low = [], first, counts, sizes
    while not out or (np.diff(top) > 1).any():
        n = np.diff(top)
        nodes = -(-n // fan)
        begin = np.concatenate(([0], np.cumsum(nodes)))
        block = np.repeat(np.arange(len(n)), nodes)
        child = top[block] + (np.arange(begin[-1]) - begin[block]) * fan
        high, low = np.maximum.reduceat(high, child, axis=0), low[child]
        out.append((child, np.minimum(child + fan, top[block + 1]), high, low, begin))
        top = begin
    return out


def forest_search(
    first: np.ndarray, counts: np.ndarray, sizes: np.ndarray, places: np.ndarray | None, percent: int, fan: int = 16, memory: int = 16_000_000
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (i, j), i < j, within blocks: rows first[b] to first[b + 1] - 1, by rising size.

    ``fan``: children of a node of a block's R-tree.  ``places`` are the positions of the block's element in the rows'
    orders, for the positional filter.  ``memory``: bytes of count vectors at a time.
    """
    slab = max(fan, memory // (counts.shape[1] * counts.itemsize))
    total = int(first[-1])
    if not total:
        return
    tree = levels(first, counts, sizes, fan)
    block = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = []  # the node of each level that holds a row
    below, start = np.arange(total), first
    for *_, begin in tree:
        below = begin[block] + (below - start[block]) // fan
        own.append(below)
        start = begin
    visits = np.cumsum(tree[0][4][block + 1] - own[0])
    at = 0
    while at < total:
        base = visits[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(visits, base + slab // fan, side="right")))
        q = np.arange(at, end)
        node = own[-1][q]
        for level in range(len(tree) - 1, -1, -1):
            child, last, high, low, _ = tree[level]
            keep = 100 * sizes[q] >= percent * low[node]
            far = np.flatnonzero(keep & (node != own[level][q]))
            if len(far):
                keep[far] = (100 + percent) * shared_bound(counts[q[far]], high[node[far]]) >= percent * (sizes[q[far]] + low[node[far]])
            q, node = q[keep], node[keep]
            # children before the row's own hold pairs that are found from their other side
            begin = np.maximum(child[node], own[level - 1][q] if level else q + 1)
            n = np.maximum(last[node] - begin, 0)
            q = np.repeat(q, n)
            node = np.repeat(begin, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        x, y = q, node
        keep = 100 * sizes[x] >= percent * sizes[y]
        if places is not None:
            need = needed(sizes[x], sizes[y], percent)
            need -= shared_keys(sizes[x]) - 1
            keep &= (places[x] <= sizes[x] - need) & (places[y] <= sizes[y] - need)
        x, y = x[keep], y[keep]
        keep = shared_bound(counts[x], counts[y]) >= needed(sizes[x], sizes[y], percent)
        yield x[keep], y[keep]
        at = end


def _describe(n: int, report: int, at_once: int = 3_000_000):
    """kind 0: (k1, k2, cid, n, counts) of a document; kind 1: an element (cid) that n texts hold, of the about
    ``at_once`` elements of a task that are compared at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            sets = text_sets(text_bytes(batch.column("text")), n)
            held += sets
            total += sum(map(len, sets))
            yield _facts(0, batch.column("k1"), batch.column("k2"), [class_id(s) for s in sets], [len(s) for s in sets], [point(s) for s in sets])
            if total > at_once:
                yield _frequent(held, report)
                held, total = [], 0
        if held:
            yield _frequent(held, report)

    return lean(run)


def _facts(kind: int, k1, k2, cid, n, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cid), kind, np.int32)), k1, k2, pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.binary())],
        names=["kind", "k1", "k2", "cid", "n", "counts"],
    )


def class_id(s: np.ndarray) -> int:
    """64-bit id of a set; 0 for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(signed(x)[0]) or 1


def _frequent(held: list[np.ndarray], report: int) -> pa.RecordBatch:
    x = np.concatenate(held)
    x.sort()
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    n = np.diff(np.concatenate((edge, [len(x)]))) if len(x) else edge
    many = n >= report
    none = pa.array(np.zeros(int(many.sum()), np.int64))
    return _facts(1, none, none, signed(x[edge[many]]), n[many], [b""] * len(none))


def _prefixes(n: int, percent: int, hot: Broadcast, salt_rows: int):
    """(key, salt, cid, at) for the prefix elements of each distinct set of a task.  at: twice the element's place, plus
    one if it may be the first common one where the set is the smaller of a pair.  salt: the part of an element that
    ``salt_rows`` texts and more hold, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = hot.value
        seen: set[int] = set()
        for batch in batches:
            keys, salts, ids, places = [], [], [], []
            for s in text_sets(text_bytes(batch.column("text")), n):
                cid = class_id(s)
                if not cid or cid in seen:
                    continue
                if len(seen) < 200_000:  # a set seen again only adds rows that the block drops
                    seen.add(cid)
                freq = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.searchsorted(known, s)
                    at[at == len(known)] = 0
                    freq = np.where(known[at] == s, times[at], 0)
                more = int(shared_keys(np.array(len(s)))) - 1
                p = min(prefix_length(len(s), percent) + more, len(s))
                place = np.arange(p)
                first = np.lexsort((s, freq))[:p]
                keys.append(signed(s[first]))
                parts = freq[first] // salt_rows
                salts.append(np.where(parts > 0, (cid & 0x7FFFFFFF) % (parts + 1), -1))
                ids.append(np.full(p, cid))
                places.append(2 * place + (place <= len(s) - needed(len(s), len(s), percent) + more))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, salts, ids, places)], names=["key", "salt", "cid", "at"])

    return lean(run)


class Links:
    """Star edges between int64 ids by union-find, bounded by the ids of one batch."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def frame(self) -> pd.DataFrame:
        rows = [(x, r) for x in self.up if (r := self.find(x)) != x]
        return pd.DataFrame(rows, columns=["u", "v"], dtype="int64")


CANDIDATES = "a long, b long, n long, keys long"


def _block_pairs(percent: int, hot_rows: int):
    """Candidate pairs of blocks sorted by (key, _i, _j, n), with their smaller size and the number of blocks.

    Of a block with more than ``hot_rows`` rows only star edges of its candidate graph come out, which count as
    sharing enough: what they connect is a superset of the block's pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["key", "_i", "_j"]):
            key, i, j = pdf["key"].to_numpy(), pdf["_i"].to_numpy(), pdf["_j"].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            first = np.concatenate(([0], new, [len(pdf)]))
            hot = np.repeat(np.diff(first) > hot_rows, np.diff(first))
            counts, fine, row = points(pdf["counts"].tolist())
            cid, c, sizes = pdf["cid"].to_numpy(), pdf["_c"].to_numpy(), pdf["n"].to_numpy()
            links, found = Links(), []
            for x, y in forest_search(first, counts, sizes, pdf["place"].to_numpy(), percent):
                keep = ((i[x] == j[x]) | (c[x] != c[y])) & (cid[x] != cid[y])
                x, y = x[keep], y[keep]
                both = np.flatnonzero((row[x] >= 0) & (row[y] >= 0))
                less = np.zeros(len(x), bool)
                less[both] = shared_bound(fine[row[x[both]]], fine[row[y[both]]]) < needed(sizes[x[both]], sizes[y[both]], percent)
                x, y = x[~less], y[~less]
                for a, b in np.unique(np.stack((cid[x[hot[x]]], cid[y[hot[x]]]), 1), axis=0).tolist():
                    links.add(a, b)
                x, y = x[~hot[x]], y[~hot[x]]
                found.append(np.stack((np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y]), sizes[x]), 1))
            stars = links.frame().rename(columns={"u": "a", "v": "b"}).assign(n=0, keys=1)
            pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True) if found else (np.empty((0, 3), np.int64), [])
            yield pd.concat([stars, pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "n": pairs[:, 2], "keys": times})])

    return lean(run)


def _verify(n: int, percent: int):
    """Star edges between components by verified pairs in groups of (cluster, _i, _j); rows say on which side of the
    group they stand and which component they belong to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in stream_groups(batches, ["cluster", "_i", "_j"]):
            g = g.drop_duplicates(["cid", "left", "right"])
            sets = text_sets([t.encode() for t in g["text"]], n)
            order = np.argsort([len(s) for s in sets], kind="stable")
            sets = [sets[k] for k in order]
            comp, left, right = (g[c].to_numpy()[order] for c in ("comp", "left", "right"))
            sizes = np.array([len(s) for s in sets])
            counts = np.stack([np.minimum(count_vector(s, WIDE), 65_535).astype(np.uint16) for s in sets])
            if counts.max() == 65_535:
                counts = np.stack([count_vector(s, WIDE) for s in sets])
            links = Links()
            for x, y in forest_search(np.array([0, len(sets)]), counts, sizes, None, percent):
                keep = (comp[x] != comp[y]) & ((left[x] & right[y]) | (right[x] & left[y]))
                for a, b in zip(x[keep].tolist(), y[keep].tolist()):
                    if links.find(int(comp[a])) != links.find(int(comp[b])):
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                            links.add(int(comp[a]), int(comp[b]))
            yield links.frame()

    return lean(run)


def _wide(n: int, groups: int = 2048):
    """Sizes and wide count vectors of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = text_sets([t.encode() for t in pdf["text"]], n)
            yield pd.DataFrame({"cluster": pdf["cluster"], "cid": pdf["cid"], "n": [len(s) for s in sets], "counts": [packed(count_vector(s, groups)) for s in sets]})

    return lean(run)


def _wide_pairs(percent: int):
    """Pairs of different components between the sides of groups of (cluster, _i, _j) that wide vectors allow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in stream_groups(batches, ["cluster", "_i", "_j"]):
            g = g.sort_values("n", kind="stable")
            counts = np.frombuffer(b"".join(g["counts"]), np.uint8).reshape(len(g), -1)
            comp, cid, left, right = (g[c].to_numpy() for c in ("comp", "cid", "left", "right"))
            for x, y in forest_search(np.array([0, len(g)]), counts, g["n"].to_numpy(), None, percent):
                keep = (comp[x] != comp[y]) & ((left[x] & right[y]) | (right[x] & left[y])) & (cid[x] != cid[y])
                x, y = x[keep], y[keep]
                yield pd.DataFrame({"a": np.minimum(cid[x], cid[y]), "b": np.maximum(cid[x], cid[y])})

    return lean(run)


class Clusters:
    """Exact links within clusters of candidate classes.

    ``texts``: cluster, cid, part, parts, text; a cluster of more than ``size`` classes has several parts.
    First every part is joined in itself.  Clusters of several parts then join two members of every component of
    every part, dealt anew, which connects what is really one group; and at last whatever is not in the cluster's
    largest component is compared with all of the cluster: first by wide count vectors, which are a small part of a
    text, then the pairs that are left by their texts.  A large group of copies is never paired with itself.
    """

    def __init__(self, texts: DataFrame, n: int, percent: int, size: int):
        self.spark, self.texts, self.n, self.percent, self.size = texts.sparkSession, texts, n, percent, size

    def _links(self, rows: DataFrame, name: str) -> DataFrame:
        found = grouped(rows.select("cluster", "_i", "_j", "cid", "comp", "left", "right", "text"), ["cluster", "_i", "_j"])
        return stored(self.spark, found.mapInPandas(_verify(self.n, self.percent), "u long, v long"), name)

    def _placed(self, links: DataFrame) -> DataFrame:
        """Members of clusters of several parts, without texts, with their components."""
        comps = connected_components(self.spark, links, "ngram-cc")
        own = self.texts.where("parts > 1").select("cluster", "cid", "part")
        return own.join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")

    def components(self) -> DataFrame:
        yes, no = F.lit(True), F.lit(False)
        t = self.texts
        links = self._links(t.select("*", F.col("part").alias("_i"), F.col("part").alias("_j"), F.col("cid").alias("comp"), yes.alias("left"), yes.alias("right")), "part-links")
        if not t.where("parts > 1").isEmpty():
            content = t.where("parts > 1").select("cluster", "cid", "text")
            placed = stored(self.spark, self._placed(links), "placed")
            two = placed.groupBy("cluster", "part", "comp").agg(F.min("cid").alias("x"), F.max("cid").alias("y"))
            few = two.select("cluster", "comp", F.explode(F.array_distinct(F.array("x", "y"))).alias("cid"))
            few = few.join(few.groupBy("cluster").agg(F.ceil(F.count("*") / self.size).alias("p")), "cluster")
            few = few.withColumn("_i", F.pmod(F.xxhash64(F.lit(1), "cid"), "p").cast("int")).withColumns({"_j": F.col("_i"), "left": yes, "right": yes})
            links = links.unionAll(self._links(content.join(sized(self.spark, few, "few"), ["cluster", "cid"]), "few-links"))
            placed = stored(self.spark, self._placed(links), "placed")
            sizes = placed.groupBy("cluster", "comp").agg(F.count("*").alias("m"))
            largest = sizes.groupBy("cluster").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
            many = largest.where("all > top.m").select(
                "cluster", F.col("top.comp").alias("big"),
                F.ceil((F.col("all") - F.col("top.m")) / self.size).cast("int").alias("p"), F.ceil(F.col("all") / self.size).cast("int").alias("q"),
            )
            rows = placed.join(many, "cluster")
            hashed = lambda by: F.pmod(F.xxhash64("cid"), by.cast("long")).cast("int")
            upto = lambda x: F.explode(F.sequence(F.lit(0), x - 1))
            left = rows.where("comp != big").select("cluster", "cid", "comp", hashed(F.col("p")).alias("_i"), upto(F.col("q")).alias("_j"), yes.alias("left"), no.alias("right"))
            right = rows.select("cluster", "cid", "comp", upto(F.col("p")).alias("_i"), hashed(F.col("q")).alias("_j"), no.alias("left"), yes.alias("right"))
            vectors = stored(self.spark, content.mapInPandas(_wide(self.n), "cluster long, cid long, n long, counts binary"), "wide").dropDuplicates(["cluster", "cid"])
            meet = grouped(left.unionAll(right).join(vectors, ["cluster", "cid"]), ["cluster", "_i", "_j"])
            pairs = stored(self.spark, meet.mapInPandas(_wide_pairs(self.percent), "a long, b long").distinct(), "wide-pairs")
            parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / self.size).alias("p"))
            dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "p").cast("int").alias("_i"))
            sides = dealt.select("a", "_i", F.col("a").alias("cid"), yes.alias("left"), no.alias("right")).distinct().unionAll(
                dealt.select("a", "_i", F.col("b").alias("cid"), no.alias("left"), yes.alias("right"))
            )
            own = placed.select("cid", "comp")
            sides = sized(self.spark, sides.join(own, "cid"), "sides")
            rest = content.select("cid", "text").join(sides, "cid").select("*", F.col("a").alias("cluster"), F.col("_i").alias("_j"))
            links = links.unionAll(self._links(rest, "rest-links"))
        return connected_components(self.spark, links, "ngram-cc")


def ngram_components(rows: DataFrame, n: int, percent: int, report: int, order_limit: int, chunk: int, hot_rows: int, cluster_rows: int, salt_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of keyed() rows: (k1, k2, cid, n) of every row, and (id, component) of the classes with links."""
    spark = rows.sparkSession
    described = rows.mapInArrow(_describe(n, report), "kind int, k1 long, k2 long, cid long, n long, counts binary")
    facts = stored(spark, described, "sets")
    docs = facts.where("kind = 0").select("k1", "k2", "cid", "n")
    classes = (
        facts.where("kind = 0 and n > 0").groupBy("cid")
        .agg(F.min(F.struct("k1", "k2")).alias("one"), F.max("n").alias("n"), F.max("counts").alias("counts"))
    )
    classes = stored(spark, classes, "classes")
    # the order's last elements: a bounded list that only decides how blocks fall
    hot = facts.where("kind = 1").groupBy("cid").agg(F.sum("n").alias("n"))
    hot = hot.where(F.col("n") >= frequency_threshold(hot, "n", order_limit)).toPandas()
    keys = hot["cid"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[at], hot["n"].to_numpy(np.int64)[at]))
    routed = rows.where("text is not null").mapInArrow(_prefixes(n, percent, known, salt_rows), "key long, salt long, cid long, at long")
    # blocks of one class, and blocks where no element can lead, go; the others' sizes come from the same pass.  A
    # frequent element is counted in salted parts, whose few counts are then added up
    w = Window.partitionBy("key", "salt")
    live = routed.withColumns({"x": F.min("cid").over(w), "y": F.max("cid").over(w), "l": F.max(F.col("at") % 2).over(w), "m": F.count("*").over(w)})
    part = [F.when(F.col("salt") >= 0, F.col(c)).alias(c) for c in ("salt", "x", "y", "l")]
    placed = live.where("salt >= 0 or (x != y and l = 1)").select("key", "cid", F.shiftright("at", 1).cast("int").alias("place"), "m", *part)
    placed = stored(spark, placed, "blocks")
    sums = placed.where("salt is not null").groupBy("key", "salt").agg(*[F.max(c).alias(c) for c in ("m", "l", "y")], F.min("x").alias("x"))
    sums = sums.groupBy("key").agg(F.sum("m").alias("m"), F.max("l").alias("l"), F.max("y").alias("y"), F.min("x").alias("x"))
    sums = sized(spark, sums.where("x != y and l = 1").select("key", "m"), "block-sizes")
    blocks = placed.where("salt is null").select("key", "cid", "place", "m").unionAll(
        placed.where("salt is not null").select("key", "cid", "place").join(sums, "key").select("key", "cid", "place", "m")
    ).withColumn("p", F.ceil(F.col("m") / chunk).cast("int"))
    known.unpersist()
    # a block of several chunks meets in pairs of chunks; vectors come to the rows before these are dealt
    c = F.pmod(F.xxhash64("cid"), F.col("p").cast("long")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda o: F.struct(F.least(F.col("_c"), o).alias("i"), F.greatest(F.col("_c"), o).alias("j")))
    split = blocks.join(classes.select("cid", "n", "counts"), "cid").withColumn("_c", c).withColumn("_to", F.explode(to))
    split = split.select("key", F.col("_to.i").alias("_i"), F.col("_to.j").alias("_j"), "_c", "cid", "place", "n", "counts")
    pairs = grouped(split, ["key", "_i", "_j"], ["n"]).mapInPandas(_block_pairs(percent, hot_rows), CANDIDATES)
    pairs = pairs.groupBy("a", "b").agg(F.sum("keys").alias("keys"), F.min("n").alias("n"))
    pairs = stored(spark, pairs.where((F.col("n") < LARGE) | (F.col("keys") >= F.floor(F.col("n") * SHARE) + 1)).select(F.col("a").alias("u"), F.col("b").alias("v")), "candidates")
    discard(placed)
    clusters = stored(spark, connected_components(spark, pairs, "clusters").select(F.col("id").alias("cid"), F.col("component").alias("cluster")), "clusters")
    discard(pairs)
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m")).where(F.col("m") > cluster_rows)
    parts = F.coalesce(F.ceil(F.col("m") / cluster_rows).cast("int"), F.lit(1))
    members = clusters.join(sizes, "cluster", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts").cast("long")).cast("int"))
    members = sized(spark, members.join(classes.select("cid", "one.*"), "cid").select("k1", "k2", "cid", "cluster", "part", "parts"), "members")
    discard(classes, clusters)
    texts = stored(spark, rows.join(members, ["k1", "k2"]).select("cluster", "cid", "part", "parts", "text"), "texts")
    return docs, Clusters(texts, n, percent, cluster_rows).components()


def ngram_join(
    docs: DataFrame, n: int = 5, percent: int = 80, report: int = 4, order_limit: int = 200_000,
    chunk: int = 2048, hot_rows: int = 64, cluster_rows: int = 128, salt_rows: int = 65_536, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: k1, k2 (its row key), n_shingles, component_id, the smallest id reachable by links, and
    component, which also tells groups without any id apart (null for empty sets).

    ``percent``: Jaccard similarity in hundredths.  ``report``: from how many texts of a part of a task an element
    counts as frequent; ``order_limit``: how many of those the order knows; ``chunk``, ``hot_rows`` and
    ``cluster_rows``: sizes at which blocks and clusters are treated in parts; ``salt_rows``: from how many texts on an
    element's rows are counted in several tasks.  None of these six changes results.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    described, comps = ngram_components(rows, n, percent, report, order_limit, chunk, hot_rows, cluster_rows, salt_rows)
    placed = described.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select(
        "k1", "k2", "n", F.when(F.col("n") > 0, F.coalesce("component", "cid")).alias("comp")
    )
    placed = stored(docs.sparkSession, placed, "placed")
    first = sized(docs.sparkSession, placed.where("comp is not null").groupBy("comp").agg(F.min(key_id("k1")).alias("first")), "first")
    return placed.join(first, "comp", "left").select(
        "k1", "k2", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first")).otherwise(key_id("k1")).alias("component_id"), F.col("comp").alias("component"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group: the row with the group's smallest id.

    Rows without words stay.  Of rows that share the smallest id, or of a group without ids, the one with the smallest
    key stays, and of rows with equal id and text the one whose columns have the smallest hash; equal rows are one.
    Texts are joined with narrow tables only, by broadcast while those are small."""
    spark = docs.sparkSession
    found = ngram_join(docs, **options)
    keys = found.groupBy("k1", "k2").agg(F.first("component").alias("component"), F.count("*").alias("copies"))
    first = keys.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("k1") == F.lit(NO_ID), "k1", "k2", "copies")).alias("f"))
    stay = first.select("f.k1", "f.k2", "f.copies").unionAll(keys.where("component is null").select("k1", "k2", F.lit(1).cast("long")))
    stay = stored(spark, stay, "stay")
    a, b = spare(docs, "__k1", "__k2")
    tagged = docs.withColumns(dict(zip((a, b), row_key())))
    kept = lambda rows, name: tagged.join(sized(spark, rows.select(F.col("k1").alias(a), F.col("k2").alias(b)), name), [a, b])
    out = kept(stay.where("copies = 1"), "single").select(*docs.columns)
    several = stay.where("copies > 1")
    if not several.isEmpty():
        plain = [c for c, kind in docs.dtypes if "map<" not in kind]
        one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
        out = out.unionAll(kept(several, "several").groupBy(a, b).agg(one.alias("r")).select("r.*"))
    return out


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: components of five-word-shingle similarity 0.8."""
    found = ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(key_id("k1").alias("doc_id"), "n_shingles", "component_id")
