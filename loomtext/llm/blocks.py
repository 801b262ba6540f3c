"""Splitting of large blocks: every pair of rows of a block meets in exactly one group of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows (_n) each block has, from partial counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"))


def large_blocks(sizes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The blocks of more than ``size`` rows and their number of chunks (_p)."""
    return sizes.where(F.col("_n") > size).select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_p"))


def split_blocks(rows: DataFrame, keys: list[str], by: str, large: DataFrame, wave: tuple[int, int] = (0, 1)) -> DataFrame:
    """rows with _i, _j and _c: a block of ``large`` is dealt into chunks by a hash of ``by``, and a row of chunk c goes
    to the groups (c, j) and (i, c) of all chunk pairs i <= j.  Other blocks are group (0, 0).

    Of all groups those of wave[0] come, of wave[1] waves in all; each group is in one wave, with all its rows.
    """
    dealt = rows.join(large, keys, "left").withColumn("_p", F.coalesce("_p", F.lit(1)))
    dealt = dealt.withColumn("_c", F.pmod(F.xxhash64(by), F.col("_p")).cast("int"))
    to = F.transform(
        F.sequence(F.lit(0), F.col("_p") - 1),
        lambda o: F.struct(F.least(F.col("_c"), o).alias("i"), F.greatest(F.col("_c"), o).alias("j")),
    )
    if wave[1] > 1:
        to = F.filter(to, lambda x: F.pmod(F.xxhash64(F.lit("wave"), *keys, x.i, x.j), F.lit(wave[1])) == wave[0])
    return dealt.withColumn("_to", F.explode(to)).select(
        *rows.columns, F.col("_to.i").alias("_i"), F.col("_to.j").alias("_j"), "_c"
    )


def grouped(df: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of a group next to each other, groups dealt by their keys."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def stream_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a sorted partition one by one, across batch borders; holds one group and one batch."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if pdf.empty:
            continue
        new = np.zeros(len(pdf), bool)
        for c in keys:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        for a, b in zip(cut[:-1], cut[1:]):
            part = pdf.iloc[a:b]
            own = tuple(part[c].iat[0] for c in keys)
            if held and own != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            last = own
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of several whole groups of a sorted partition, of about ``rows`` rows or one group."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        if pdf.empty:
            continue
        held.append(pdf)
        n += len(pdf)
        if n < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        tail = np.ones(len(frame), bool)
        for c in keys:
            v = frame[c].to_numpy()
            tail &= v == v[-1]
        cut = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
        if cut:
            yield frame.iloc[:cut]
        held, n = [frame.iloc[cut:]], len(frame) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


class Forest:
    """Union-find over 0..n-1 that returns star edges."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
