"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved (window of 8 bytes, step 4, so windows overlap and cover every
byte).  The filter outputs are max-pooled over overlapping chunks that together cover the whole document; each
chunk's pooled vector goes through a hidden layer; the mean and the maximum of the hidden vectors over all chunks
are combined into one probability.

The network is fitted on the driver on a bounded sample of labelled rows: ``sample_rows`` rows, those first in the
order of a hash of the id.  A text of more than ``chunks_per_doc`` chunks is dealt over the epochs, so that the fit
sees all of it.  Scoring reads whole texts of all rows inside their input partitions; nothing is shuffled.

Defined cases: null and empty texts score as a single empty chunk; repeated rows give equal scores; labels that
are null, not 0/1, or disagree for an id are left out of the fit; without any labelled row, or with one label only,
the score is the share of label 1 in the sample (0.5 without rows); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, claim, lean, spare

STEP = 4  # bytes
CELL = 16  # positions pooled first
CHUNK = 8  # cells in a chunk: 512 bytes
HOP = 7  # cells between chunk starts: neighbours share 64 bytes
CELL_BYTES = CELL * STEP
SLAB = 8192  # cells at a time when scoring


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each padded by at least one step of zeros to whole cells; the first cell of each."""
    cells = [len(t) // CELL_BYTES + 1 if len(t) % CELL_BYTES <= CELL_BYTES - STEP else len(t) // CELL_BYTES + 2 for t in texts]
    starts = np.concatenate(([0], np.cumsum(cells)))
    data = b"".join(t.ljust(c * CELL_BYTES, b"\0") for t, c in zip(texts, cells))
    return np.frombuffer(data, np.uint8), starts


def _chunk_cells(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each chunk (chunks, CHUNK), the last cell repeated past a document's end; first chunk of each."""
    n = np.diff(starts)
    counts = np.maximum(1, -(-(n - (CHUNK - HOP)) // HOP))
    first = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(n)), counts)
    at = starts[doc] + (np.arange(first[-1]) - first[doc]) * HOP
    return np.minimum(at[:, None] + np.arange(CHUNK), starts[doc + 1][:, None] - 1), first


class ByteCNN:
    """The network's parameters with forward and training passes."""

    def __init__(self, width: int = 8, filters: int = 48, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "emb": r.normal(0, 0.5, (256, width)).astype(f),
            "w": r.normal(0, (2 * STEP * width) ** -0.5, (2 * STEP * width, filters)).astype(f),
            "b": np.zeros(filters, f),
            "w1": r.normal(0, filters**-0.5, (filters, hidden)).astype(f),
            "b1": np.zeros(hidden, f),
            "w2": np.zeros(2 * hidden, f),
            "b2": np.zeros(1, f),
        }
        self.p["emb"][0] = 0

    def _cells(self, data: np.ndarray, starts: np.ndarray, want_at: bool = False):
        """Filter maxima of each cell, and the positions they come from."""
        e = self.p["emb"][data].reshape(-1, STEP * self.p["emb"].shape[1])
        half = e.shape[1]
        y = e @ self.p["w"][:half]
        y[:-1] += e[1:] @ self.p["w"][half:]
        y += self.p["b"]
        y[starts[1:] * CELL - 1] = 0  # this window would reach into the next text
        y = y.reshape(-1, CELL, y.shape[1])
        if want_at:
            at = y.argmax(1)
            return np.take_along_axis(y, at[:, None], 1)[:, 0], at
        return y.max(1), None

    def logits(self, texts: list[bytes]) -> np.ndarray:
        data, starts = _layout(texts)
        # a slab of cells at a time, with the step after it: a text of any length takes bounded memory
        slabs = []
        for at in range(0, int(starts[-1]), SLAB):
            end = min(at + SLAB, int(starts[-1]))
            part = data[at * CELL_BYTES : end * CELL_BYTES + STEP]
            part = np.concatenate((part, np.zeros((end - at + 1) * CELL_BYTES - len(part), np.uint8)))
            inside = starts[(starts > at) & (starts <= end)] - at
            slabs.append(self._cells(part, np.concatenate(([0], inside)))[0][: end - at])
        pooled = np.concatenate(slabs)
        cells, first = _chunk_cells(starts)
        x = np.maximum(pooled[cells[:, 0]], 0)
        for c in range(1, CHUNK):
            np.maximum(x, pooled[cells[:, c]], out=x)
        h = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        mean = np.add.reduceat(h, first[:-1]) / np.diff(first)[:, None]
        top = np.maximum.reduceat(h, first[:-1])
        return np.concatenate((mean, top), 1) @ self.p["w2"] + self.p["b2"][0]

    def probabilities(self, texts: list[bytes], bytes_at_once: int = 400_000) -> np.ndarray:
        """Of whole texts; texts are grouped so that a pass holds few bytes."""
        out, group, n, at = np.empty(len(texts)), [], 0, 0
        for i, t in enumerate(texts):
            if group and n + len(t) > bytes_at_once:
                out[at:i] = self.logits(group)
                group, n, at = [], 0, i
            group.append(t)
            n += len(t)
        if group:
            out[at:] = self.logits(group)
        return 1 / (1 + np.exp(-out))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 48, chunks_per_doc: int = 12, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on the log loss.  A long text gives ``chunks_per_doc`` chunks an epoch, or as many as it takes to see all of
        them in all epochs, in a random order of its own."""
        r = np.random.default_rng(seed)
        labels = labels.astype(np.float32)
        self.p["b2"][0] = np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // batch)
        piece = HOP * CELL_BYTES
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                picked = order[at : at + batch]
                cut: list[bytes] = []
                for i in picked:
                    t = texts[i]
                    n = -(-len(t) // piece)
                    if n > chunks_per_doc:
                        t = b"".join(t[k * piece : (k + 1) * piece] for k in dealt(n, chunks_per_doc, epoch, epochs, (seed, int(i))))
                    cut.append(t)
                grads = self._gradients(cut, labels[picked])
                step += 1
                speed = rate * min(1, step / 30) * (1 - 0.95 * step / total)
                for k, g in grads.items():
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.01 * (g * g - m2[k])
                    self.p[k] -= speed * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
                self.p["emb"][0] = 0

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, (data, starts) = self.p, _layout(texts)
        pooled, at = self._cells(data, starts, want_at=True)
        cells, first = _chunk_cells(starts)
        stack = pooled[cells]
        win = stack.argmax(1)
        raw = np.take_along_axis(stack, win[:, None], 1)[:, 0]
        x = np.maximum(raw, 0)
        z = x @ p["w1"] + p["b1"]
        h = np.maximum(z, 0)
        counts, doc = np.diff(first), np.repeat(np.arange(len(texts)), np.diff(first))
        mean, top = np.add.reduceat(h, first[:-1]) / counts[:, None], np.maximum.reduceat(h, first[:-1])
        v = np.concatenate((mean, top), 1)
        d = (1 / (1 + np.exp(-(v @ p["w2"] + p["b2"][0]))) - labels) / len(texts)
        dv = d[:, None] * p["w2"]
        k = h.shape[1]
        tied = (h == top[doc]).astype(h.dtype)  # equal chunks share a maximum's gradient
        tied /= np.add.reduceat(tied, first[:-1])[doc]
        dh = dv[doc, :k] / counts[doc][:, None] + tied * dv[doc, k:]
        dz = dh * (z > 0)
        dx = (dz @ p["w1"].T) * (raw > 0)
        # back through both poolings to the windows of the maxima
        cell = np.take_along_axis(cells, win, 1)
        pos = cell * CELL + at[cell, np.arange(raw.shape[1])]
        flat = np.minimum(pos.ravel()[:, None] * STEP + np.arange(2 * STEP), len(data) - 1)
        got = data[flat]
        width = p["emb"].shape[1]
        patch = p["emb"][got].reshape(*raw.shape, 2 * STEP * width)
        dw = np.einsum("cf,cfk->kf", dx, patch, optimize=True)
        dpatch = (dx[:, :, None] * p["w"].T[None]).reshape(-1, 2 * STEP, width)
        demb = np.zeros_like(p["emb"])
        codes = got.ravel()
        dflat = dpatch.reshape(-1, width)
        for c in range(width):
            demb[:, c] = np.bincount(codes, dflat[:, c], 256)
        return {
            "emb": demb, "w": dw, "b": dx.sum(0), "w1": x.T @ dz, "b1": dz.sum(0), "w2": v.T @ d, "b2": d.sum(keepdims=True),
        }


def dealt(n: int, least: int, epoch: int, epochs: int, seed: tuple[int, int]) -> np.ndarray:
    """Which of n chunks an epoch takes: at least ``least``, and over all epochs every one."""
    take = max(least, -(-n // epochs))
    return np.sort(np.random.default_rng(seed).permutation(n)[np.arange(epoch * take, (epoch + 1) * take) % n])


def held_out(id_col: str = "doc_id", fold: int = 0, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, folds: int = 5, fold: int = 0, epochs: int = 10,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> tuple[ByteCNN | None, float]:
    """The network fitted on at most ``sample_rows`` labelled rows outside the held-out fold, and the share of
    label 1 there.  Ids are compared as they are; rows are taken in the order of a hash of the id."""
    given = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
        .where("y in (0, 1) and i is not null").groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("y2"))
        .where("y = y2").select("i", "y")
    )
    # the drawn ids are at most sample_rows rows, so they are broadcast; no text is shuffled or sorted
    ids = docs.select(F.col(id_col).alias("i")).where(~held_out("i", fold, folds)).join(given, "i").distinct()
    drawn = ids.orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(drawn), "i")
    sample = texts.toPandas().sort_values(["i", "t"]).drop_duplicates("i")
    if sample.empty:
        return None, 0.5
    y = sample["y"].to_numpy()
    if y.min() == y.max():
        return None, float(y.mean())
    net = ByteCNN()
    net.fit([t.encode() if isinstance(t, str) else b"" for t in sample["t"]], y, epochs=epochs)
    return net, float(y.mean())


def score_quality(docs: DataFrame, net: ByteCNN | None, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and, last, the probability of label 1 for the whole text."""
    bounded_batches(docs.sparkSession)
    params = net.p if net is not None else None

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("quality")
        model = ByteCNN.__new__(ByteCNN)
        model.p = params
        for texts in batches:
            raw = [t.encode() if isinstance(t, str) else b"" for t in texts]
            yield pd.Series(np.round(model.probabilities(raw), 9) if params is not None else np.full(len(raw), share))

    (name,) = spare(docs, "__score")
    return docs.withColumn(name, F.pandas_udf(lean(score), "double")(F.col(text_col).cast("string")))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold, else 0) for every row of docs."""
    net, share = fit_quality(docs, labels, **fit)
    scored = score_quality(docs.select("doc_id", "text"), net, share)
    score = F.col(scored.columns[-1])
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    net, share = fit_quality(docs, labels, **fit)
    scored = score_quality(docs, net, share)
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def crc_mod(value: object, folds: int = 5) -> int:
    """held_out's remainder in Python, for tests."""
    return zlib.crc32(str(value).encode()) % folds
