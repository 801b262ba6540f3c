"""Shared helpers of the training-data operators: byte-level tokenising, stable hashing, document keys,
shared-folder tables and distributed connected components."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, release, remove, shared_dir, stored, there  # noqa: F401

#: A-Z to a-z; every ASCII byte outside 0-9 A-Z a-z to a space.  Bytes from 0x80 stay.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` as UTF-8 bytes (bytes.split cuts at just those six bytes)."""
    return text.encode().split() if text else []


def lower_space_words(text: str | None) -> list[bytes]:
    """As space_words with A-Z lower-cased (bytes.lower touches ASCII only)."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and non-ASCII characters."""
    return text.encode().translate(_ALNUM).split() if text else []


_OWNER: list = ["", None]


def claim(name: str, clear=None) -> None:
    """Python workers outlive tasks: whoever starts to fill a process-wide cache clears that of another operator."""
    if _OWNER[0] != name:
        if _OWNER[1] is not None:
            _OWNER[1]()
        _OWNER[:] = [name, clear]


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it keeps its memory
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow or mapInPandas; when a task ends its worker, which lives on, lets the memory go."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def text_bytes(column: pa.Array) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur style)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for p in range(k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[p : p + n]
    return mix(acc)


class SpanHash:
    """Polynomial hashes of any word span of one document in constant time."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INV = pow(BASE, -1, 1 << 64)

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.inv = _inverse_powers(self.n + 1)
        self.sum = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(h) * _base_powers(self.n), out=self.sum[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of words lo..hi-1, equal for equal words wherever they stand."""
        return mix((self.sum[hi] - self.sum[lo]) * self.inv[lo] + (hi - lo).astype(np.uint64))


_POW: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 14, 2 * len(have) if have is not None else 0)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        _POW[name] = have = np.multiply.accumulate(have)
    return have[:n]


def _base_powers(n: int) -> np.ndarray:
    return _grown("base", SpanHash.BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("inverse", SpanHash.INV, n)


#: Bytes that are hashed at a time, and how long a text may be before it is cut at white space.
SLAB, LONG = 1 << 17, 1 << 20


def _blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space (9 to 13 and 32)."""
    return ((data - np.uint8(9)) < 5) | (data == 32)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw cut at white space into parts of about LONG bytes; a word longer than that stays whole."""
    data, at = np.frombuffer(raw, np.uint8), 0
    while len(raw) - at > LONG:
        blank = np.flatnonzero(_blank(data[at : at + LONG]))
        if len(blank):
            end = at + int(blank[-1]) + 1
        else:
            m = re.compile(rb"[\t-\r ]").search(raw, at + LONG)
            end = m.end() if m else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hash_slab(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    full = ~_blank(data)
    edge = np.flatnonzero(full[1:] != full[:-1]) + 1
    lo, hi = edge[::2], edge[1::2]
    code = data.astype(np.uint64)
    code += np.uint64(1)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    code *= _base_powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code, out=total[1:])
    h = (total[hi] - total[lo]) * _inverse_powers(len(data))[lo]
    h += (hi - lo).astype(np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(mix(h), np.searchsorted(lo, ends[:-1], side="right"))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the white-space words of each text, equal in every process.

    A word's hash is a polynomial of its bytes' codes, taken from running sums over many texts at once: no word is
    cut out, looked up or kept.  Long texts are hashed in parts.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    n = 0
    for t in texts:
        if len(t) > LONG:
            if group:
                out += _hash_slab(group)
                group, n = [], 0
            out.append(np.concatenate([_hash_slab([x])[0] for x in _pieces(t)]))
            continue
        group.append(t)
        n += len(t)
        if n >= SLAB:
            out += _hash_slab(group)
            group, n = [], 0
    return out + (_hash_slab(group) if group else [])


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits (Spark has no unsigned long)."""
    return x.view(np.int64)


def bounded_batches(spark: SparkSession, records: int = 512) -> None:
    """Keep Arrow batches small: whole texts may be very long, and Spark bounds batches by rows.

    Results are lazy, so the bound must outlive the call: it is the one setting that operators lower in the caller's
    session.  They never raise it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > records:
        spark.conf.set(name, str(records))


def integral(df: DataFrame, *columns: str) -> None:
    """Ids are integers (or null); a table with other ids is refused rather than misread."""
    kinds = dict(df.dtypes)
    for name in columns:
        if kinds[name] not in ("tinyint", "smallint", "int", "bigint", "void"):
            raise TypeError(f"{name} is {kinds[name]}; ids must be integers")


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores until no column of df has one of them."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """The two columns of keyed() for a table that keeps its own."""
    i = F.col(id_col).cast("long")
    return F.coalesce(i, F.lit(NO_ID)), F.xxhash64(i, F.col(text_col).cast("string"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, text): a null-safe row key.  Repeated rows share it and so get the same result; rows that share
    an id but not their text, or have no id, stay apart."""
    integral(docs, id_col)
    k1, k2 = row_key(id_col, text_col)
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))


#: Stands for a null id in a key.
NO_ID = -(2**63)


def key_id(col: str = "k1"):
    """The id column back from a key."""
    return F.when(F.col(col) != F.lit(NO_ID), F.col(col))


def sized(spark: SparkSession, df: DataFrame, name: str, rows: int = 200_000) -> DataFrame:
    """df stored, to be joined by broadcast if it has at most ``rows`` rows of a few bytes, else by a shuffle."""
    table = stored(spark, df, name)
    return F.broadcast(table) if table.count() <= rows else table


def frequency_threshold(df: DataFrame, count: str, limit: int) -> int:
    """Least count such that no more than ``limit`` rows reach it: from a histogram of count magnitudes (sixteen to
    a doubling), so neither a sort nor many rows come to the driver."""
    magnitude = F.floor(F.log2(F.col(count)) * 16).cast("int")
    bins = df.where(F.col(count) > 0).groupBy(magnitude.alias("m")).agg(F.count("*").alias("n"), F.min(count).alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r.m):
        total += r.n
        if total > limit:
            break
        least = r.least
    return least


def connected_components(spark: SparkSession, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) for every node of edges (u, v); component is the smallest node reachable.

    Contraction: every node hooks to its smallest neighbour, pointers are followed to their roots, edges between
    roots remain.  Each round at least halves the nodes of a component; nothing is collected, hubs are
    pre-aggregated by min, and every round is cut by a stored table.
    """
    e = stored(
        spark,
        edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct(),
        f"{name}-edges",
    )
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("id"), F.col("b").alias("o")).unionAll(e.select("b", "a"))
        hook = both.groupBy("id").agg(F.min("o").alias("o")).select("id", F.least("id", "o").alias("p"))
        hook = stored(spark, hook, f"{name}-hook")
        while True:
            up = hook.select(F.col("id").alias("p"), F.col("p").alias("g"))
            nxt = stored(
                spark,
                hook.join(up, "p").select("id", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")),
                f"{name}-jump",
            )
            moved = not nxt.where("moved").isEmpty()
            discard(hook)
            hook = nxt
            if not moved:
                break
        hook = hook.select("id", "p")
        maps.append(hook)
        left = hook.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        contracted = stored(
            spark,
            e.join(left, "a").join(right, "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .where("a < b").distinct(),
            f"{name}-edges",
        )
        discard(e)
        e = contracted
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0]
    for m in maps[1:]:
        up = m.select(F.col("id").alias("p"), F.col("p").alias("g"))
        out = out.join(up, "p", "left").select("id", F.coalesce("g", "p").alias("p"))
    # a node hooks downwards only, so a root is the smallest node that its tree holds
    return out.select("id", F.col("p").alias("component"))
