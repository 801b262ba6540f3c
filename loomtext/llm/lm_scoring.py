"""Document scoring with a gated recurrent language model in numpy.

Counts.  Words of all training documents are counted (partial counts in the tasks, summed by word), and so are
document ends.  The ``head_words`` most frequent words with their counts are broadcast (a fixed bound); the other
words of each document are joined with their counts by word, pre-aggregated within the tasks.  Words are cut and
looked up in Arrow, some megabytes of text at a time.

Model.  A gated recurrent unit reads one token a step; its output layer is factored: a softmax over classes and, in
classes of frequent words, a softmax over the words of the class.  Words outside the ``vocabulary`` most frequent
ones form classes by their last letters; inside such a class a word has its add-1/2 share of the training counts,
with one place for words never seen, so that probabilities sum to one.  The document end is a token.

Training.  Truncated backpropagation: whole documents are laid end to end in parallel streams, the state is carried
from window to window, however long a document is, and cleared at document starts only.  A short warm-up on a bounded sample of documents sets the starting
point; then every task trains on all training documents it reads, and the tasks' parameters are averaged, weighted
by tokens.  Averaging adds rows of parameters by chunk, so no task or driver gathers more than one model.

Scoring.  Whole documents run through the network with their state carried across windows; the log probability of
a document is the sum over all of its tokens, its end included.

Defined cases: null or empty text is a document of its end alone; repeated rows are trained on and scored each; null
ids count as the empty text for the fold; without training documents the model knows no words; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, frequency_threshold, integral, lean, release, stored
from .quality_cnn import held_out

END = b"\x00\n"  # no word holds a line feed
LN10 = float(np.log(10))
BLOCK = 4096  # rows of logits at a time


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    r"""Words ``[^\x20\x09-\x0D]+`` of all texts end to end, A-Z lower-cased, and each text's number of them; null has
    none.  (Arrow cuts at just those six bytes.)"""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.binary())
    ends = lists.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text leaves an empty string
    if not full.all():
        ends = np.concatenate(([0], np.cumsum(full)))[ends]
        words = words.filter(pa.array(full))
    return words, np.diff(ends)


def grouped(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``size`` bytes, or of one row: a look-up of many words at once is cheap, and long
    texts don't add up."""

    def halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows < 2 or batch.nbytes <= size:
            yield batch
        else:
            yield from halved(batch.slice(0, batch.num_rows // 2))
            yield from halved(batch.slice(batch.num_rows // 2))

    held, n = [], 0
    for whole in batches:
        for batch in halved(whole):
            if held and n + batch.nbytes > size:
                yield pa.concat_batches(held)
                held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.nbytes
    if held:
        yield pa.concat_batches(held)


@dataclass
class Vocabulary:
    """Token ids of frequent words: id = class * per_class + place.  Other words fall into suffix classes."""

    words: dict[bytes, int]
    per_class: int
    head_classes: int
    tail_classes: int

    @classmethod
    def build(cls, words: list[bytes], per_class: int = 64, tail_classes: int = 32) -> Vocabulary:
        """words: most frequent first, the document end among them."""
        return cls({w: i for i, w in enumerate(words)}, per_class, -(-len(words) // per_class), tail_classes)

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail_classes

    @property
    def inputs(self) -> int:
        return self.head_classes * self.per_class + self.tail_classes

    def tail(self, word: bytes) -> int:
        """Class of a word outside the vocabulary: by its last byte and whether it holds non-ASCII letters."""
        kind = 0 if word.isascii() else 1 + (max(word) & 3)
        return (word[-1] * 7 + (word[-2] if len(word) > 1 else 0) * 3 + kind * 11) % self.tail_classes

    def tails(self, words: pa.Array) -> np.ndarray:
        """tail() of every word of an Arrow array; none is null or empty."""
        if not len(words):
            return np.empty(0, np.int64)
        words = words.cast(pa.binary())
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]]
        most = np.maximum.reduceat(data, at[:-1]).astype(np.int64)
        kind = np.where(most < 128, 0, 1 + (most & 3))
        second = np.where(np.diff(at) > 1, data[at[1:] - 2], 0)
        return (data[at[1:] - 1] * np.int64(7) + second * np.int64(3) + kind * 11) % self.tail_classes


class Network:
    """GRU with class-factored output; parameters in one dict of float32 arrays."""

    def __init__(self, vocab: Vocabulary, hidden: int = 24, seed: int = 5, params: dict | None = None):
        self.v, self.hidden = vocab, hidden
        if params is not None:
            self.p = params
            return
        r, f, h = np.random.default_rng(seed), np.float32, hidden
        self.p = {
            "in": r.normal(0, 0.3, (vocab.inputs, 3 * h)).astype(f),
            "u": (r.normal(0, h**-0.5, (h, 3 * h))).astype(f),
            "b": np.zeros(3 * h, f),
            "wc": r.normal(0, h**-0.5, (h, vocab.classes)).astype(f),
            "bc": np.zeros(vocab.classes, f),
            "ww": np.zeros((vocab.head_classes, h, vocab.per_class), f),
            "bw": np.zeros((vocab.head_classes, vocab.per_class), f),
        }

    def bias_from(self, counts: np.ndarray, tails: np.ndarray) -> None:
        """Start the output biases at the log frequencies."""
        v = self.v
        head = np.zeros(v.head_classes * v.per_class)
        head[: len(counts)] = counts
        head = head.reshape(v.head_classes, v.per_class)
        total = np.concatenate((head.sum(1), tails)) + 0.5
        self.p["bc"][:] = np.log(total / total.sum())
        share = (head + 0.05) / (head + 0.05).sum(1, keepdims=True)
        share[head == 0] = 1e-12
        self.p["bw"][:] = np.log(share)

    def run(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """States before each token of ids (T, B); fresh: a document starts here.  Returns states, the last one, and what
        backpropagation needs."""
        p, n = self.p, self.hidden
        half = np.float32(0.5)
        u_zr, u_c = _gates(p["u"])[:2] * half, np.ascontiguousarray(p["u"][:, 2 * n :])
        table = _gates(p["in"] + p["b"])
        table[:2] *= half  # the logistic function is half a tanh of the half, plus a half
        begins = fresh.any(1).tolist()
        shape = (len(ids) if keep else 1, ids.shape[1], n)
        states, x = np.empty((*ids.shape, n), table.dtype), np.empty((3, ids.shape[1], n), table.dtype)
        gates, resets, news = np.empty((shape[0], 2, *shape[1:]), table.dtype), np.empty(shape, table.dtype), np.empty(shape, table.dtype)
        for t in range(len(ids)):
            if begins[t]:
                h = h * (~fresh[t])[:, None]
            states[t] = h
            k = t if keep else 0
            zr, rh, c = gates[k], resets[k], news[k]
            for gate in range(3):
                np.take(table[gate], ids[t], axis=0, out=x[gate], mode="clip")  # a step's inputs stay in the cache
            np.matmul(h, u_zr, out=zr)
            zr += x[:2]
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            np.multiply(zr[1], h, out=rh)
            np.matmul(rh, u_c, out=c)
            c += x[2]
            np.tanh(c, out=c)
            h = h - c
            h *= zr[0]
            h += c
        return states, h, (states, gates, resets, news)

    def loss(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Log probabilities (natural) of the class, and of the word within head classes; adds gradients of the
        mean (over 1024 tokens at least) negative log likelihood and returns that of the states."""
        p, v = self.p, self.v
        n, m = len(target), self.hidden
        scale = np.float32(1 / max(n, 1024))  # small windows take small steps
        base = v.head_classes * v.per_class
        cls = np.where(target < base, target // v.per_class, target - base + v.head_classes)
        order = np.argsort(_narrow(cls, v.classes), kind="stable")  # a class's tokens lie together, those of head classes first
        cls, place = cls[order], target[order] % v.per_class
        cut = np.searchsorted(cls, np.arange(v.head_classes + 1)).tolist()
        h = np.empty((n, m + 1), states.dtype)  # a last column of ones stands for the biases
        h[:, :m] = np.take(states, order, axis=0)
        h[:, m] = 1
        wc = np.concatenate((p["wc"], p["bc"][None]))
        ww = np.concatenate((p["ww"], p["bw"][:, None]), axis=1)
        high = (np.abs(ww).sum(1).max(1) > 60).tolist()  # states are within -1 and 1: else nothing overflows
        got, sums = np.zeros((2, n), h.dtype), np.ones((2, n), h.dtype)
        ds = None if grads is None else np.empty_like(states)
        wide = max(v.classes, v.per_class)
        one, at, room = np.ones(wide, wc.dtype), np.arange(BLOCK), np.empty(BLOCK * wide, np.result_type(h, wc))

        def softmax(level: int, a: int, b: int, own: np.ndarray, w: np.ndarray, high: bool, add: tuple | None) -> None:
            """Logits of own and sums of exponentials of tokens a to b; gradients go to add and ds."""
            back = np.ascontiguousarray(w[:m].T) if add else None
            for a in range(a, b, BLOCK):  # a block's logits stay in the cache
                x = h[a : min(b, a + BLOCK)]
                i, part = at[: len(x)], slice(a, a + len(x))
                e = room[: len(x) * w.shape[1]].reshape(len(x), -1)
                np.matmul(x, w, out=e)
                if high:
                    e -= e.max(1, keepdims=True)
                got[level, part] = e[i, own[part]]
                np.exp(e, out=e)
                s = np.matmul(e, one[: e.shape[1]], out=sums[level, part])
                if add:
                    e *= (scale / s)[:, None]
                    e[i, own[part]] -= scale
                    g = x.T @ e
                    add[0][:] += g[:m]
                    add[1][:] += g[m]
                    if level:
                        ds[part] += e @ back
                    else:
                        np.matmul(e, back, out=ds[part])

        softmax(0, 0, n, cls, wc, np.abs(wc).sum(0).max() > 60, grads and (grads["wc"], grads["bc"]))
        for k in range(v.head_classes):
            softmax(1, cut[k], cut[k + 1], place, ww[k], high[k], grads and (grads["ww"][k], grads["bw"][k]))
        got -= np.log(sums, out=sums)
        got[0, : cut[-1]] += got[1, : cut[-1]]
        got = got[0]
        out = np.empty_like(got)
        out[order] = got
        if ds is not None:
            own, ds = ds, np.empty_like(ds)
            ds[order] = own
        return out, ds

    def back(self, ids: np.ndarray, fresh: np.ndarray, saved: tuple, dstates: np.ndarray, grads: dict) -> None:
        """Backpropagation through one window (truncated at its start)."""
        p, n = self.p, self.hidden
        states, gates, resets, news = saved
        u_z, u_r, u_c = (np.ascontiguousarray(u.T) for u in _gates(p["u"]))
        begins = fresh.any(1).tolist()
        dh = np.zeros((ids.shape[1], n), states.dtype)
        dx_all = np.empty((3, *ids.shape, n), states.dtype)
        f, rest, drh = np.empty_like(dh), np.empty_like(dh), np.empty_like(dh)
        for t in range(len(ids) - 1, -1, -1):  # a step's arrays stay in the cache; products of whole windows would not
            (z, r), h, c = gates[t], states[t], news[t]
            dz, dr, dc = dx_all[0, t], dx_all[1, t], dx_all[2, t]
            np.subtract(1, z, out=rest)
            np.multiply(dh, rest, out=dc)
            np.multiply(dc, z, out=dz)
            np.subtract(h, c, out=f)
            dz *= f
            np.multiply(c, c, out=f)
            np.subtract(1, f, out=f)
            dc *= f
            np.matmul(dc, u_c, out=drh)
            drh *= r
            np.subtract(1, r, out=f)
            f *= h
            np.multiply(drh, f, out=dr)
            dh *= z
            dh += drh
            np.matmul(dz, u_z, out=f)
            dh += f
            np.matmul(dr, u_r, out=f)
            dh += f
            dh += dstates[t]
            if begins[t]:
                dh *= (~fresh[t])[:, None]
        flat = dx_all.reshape(3, -1, n)
        before, reset = states.reshape(-1, n).T, resets.reshape(-1, n).T
        flat_ids = ids.ravel()
        order = np.argsort(_narrow(flat_ids, self.v.inputs), kind="stable")
        own = flat_ids[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows = own[first]
        for gate, source in enumerate((before, before, reset)):
            part = slice(gate * n, gate * n + n)
            grads["u"][:, part] += source @ flat[gate]
            sums = np.add.reduceat(np.take(flat[gate], order, axis=0), first, axis=0)
            grads["b"][part] += sums.sum(0)
            grads["in"][rows, part] += sums


def _gates(a: np.ndarray) -> np.ndarray:
    """Columns of the three gates as arrays of their own: (rows, 3 n) to (3, rows, n)."""
    return np.ascontiguousarray(a.reshape(len(a), 3, -1).transpose(1, 0, 2))


def _narrow(a: np.ndarray, most: int) -> np.ndarray:
    """Numbers below most in 16 bits where they fit: numpy sorts those by radix."""
    return a.astype(np.uint16) if most <= 1 << 16 else a


def streams(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Documents end to end in at most ``width`` columns of like length: ids (T, B) padded with -1, document starts,
    and each document's (column, first row)."""
    width = max(1, min(width, len(docs)))
    used = np.zeros(width, np.int64)
    place: list[tuple[int, int]] = [(0, 0)] * len(docs)
    heap = [(0, c) for c in range(width)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, c = heapq.heappop(heap)
        place[i] = (c, n)
        heapq.heappush(heap, (n + len(docs[i]), c))
        used[c] = n + len(docs[i])
    ids = np.full((int(used.max()), width), -1, np.int32)
    fresh = np.zeros(ids.shape, bool)
    for i, (c, n) in enumerate(place):
        ids[n : n + len(docs[i]), c] = docs[i]
        fresh[n, c] = True
    return ids, fresh, place


def train(net: Network, docs: list[np.ndarray], opt: Adam, width: int = 512, least: int = 96, step_tokens: int = 6144, longest: int = 128) -> int:
    """One pass over whole documents; returns the tokens seen.  The state is carried from window to window through each
    whole document.  The streams are so many (``least`` to ``width``) that all are about as long as the longest
    document: a long one runs beside the others instead of alone after them.  A window holds about ``step_tokens`` and is
    at most ``longest`` steps."""
    tokens = sum(map(len, docs))
    width = min(width, max(least, tokens // max(map(len, docs))))
    ids, fresh, _ = streams(docs, width)
    grads = {k: np.empty_like(a) for k, a in net.p.items()}
    h = np.zeros((ids.shape[1], net.hidden), np.float32)
    longest = max(12, min(longest, len(ids) // 64))  # a small corpus is worth several steps too
    t, end = 0, 0
    while end < len(ids):
        t, end = end, end + min(max(12, step_tokens // ids.shape[1]), longest)
        x, new = ids[t:end], fresh[t:end]
        live = x >= 0
        cols = live.any(0)
        if not cols.all():
            x, new, live, h = x[:, cols], new[:, cols], live[:, cols], h[cols]
            ids, fresh = ids[:, cols], fresh[:, cols]
        x0 = np.where(live, x, 0)
        states, h, saved = net.run(x0, new, h, True)
        for g in grads.values():
            g.fill(0)
        if live.all():
            dstates = net.loss(states.reshape(-1, net.hidden), x.ravel(), grads)[1].reshape(states.shape)
        else:
            dstates = np.zeros_like(states)
            dstates[live] = net.loss(states[live], x[live], grads)[1]
        net.back(x0, new, saved, dstates, grads)
        opt.step(net.p, grads)
    return tokens


def score(net: Network, docs: list[np.ndarray], width: int = 768, window: int = 24) -> np.ndarray:
    """Natural log probability of each whole document under the network's factored output."""
    ids, fresh, place = streams(docs, width)
    owner = np.zeros(ids.shape, np.int32)
    for d, (c, n) in enumerate(place):
        owner[n : n + len(docs[d]), c] = d
    out = np.zeros(len(docs))
    h = np.zeros((ids.shape[1], net.hidden), np.float32)
    cols = np.arange(ids.shape[1])
    for t in range(0, len(ids), window):
        x = ids[t : t + window, cols]
        live = x >= 0
        some = live.any(0)
        if not some.all():
            x, live, h, cols = x[:, some], live[:, some], h[some], cols[some]
        states, h, _ = net.run(np.where(live, x, 0), fresh[t : t + window, cols], h, False)
        got = net.loss(states[live], x[live])[0]
        out += np.bincount(owner[t : t + window, cols][live], got, len(docs))
    return out


class Adam:
    """Adam whose second moments of the large tables are kept, with a falling rate."""

    def __init__(self, rate: float, decay: float = 0.0):
        self.rate, self.decay, self.n = rate, decay, 0
        self.m: dict[str, np.ndarray] = {}
        self.s: dict[str, np.ndarray] = {}

    def step(self, p: dict, g: dict) -> None:
        self.n += 1
        rate = self.rate / (1 + self.decay * self.n)
        for k, d in g.items():
            if k not in self.m:
                self.m[k], self.s[k] = np.zeros_like(d), np.zeros_like(d)
            m, s = self.m[k], self.s[k]
            m *= 0.9
            m += 0.1 * d
            d *= d
            d *= 0.01
            s *= 0.99
            s += d
            np.sqrt(s, out=d)
            d += 1e-7
            np.divide(m, d, out=d)
            d *= rate / (1 - 0.9**self.n) * (1 - 0.99**self.n) ** 0.5
            p[k] -= d


@dataclass
class Language:
    """All that scoring needs: counts of head words, totals, vocabulary and network parameters."""

    vocab: Vocabulary
    head: dict[bytes, int]
    tokens: int
    distinct: int
    tail_tokens: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tail_distinct: np.ndarray = field(default_factory=lambda: np.zeros(0))
    params: dict | None = None
    hidden: int = 16
    least: int = 0  # the least count of a head word

    known: pa.Array | None = None  # the head words, in a process that looks words up

    def arrange(self) -> Language:
        """Once in a process: places of head words with their ids and logs; a place for each tail class follows, and one
        for the document end is the last."""
        if self.known is None:
            v = self.vocab
            base = v.head_classes * v.per_class
            self.known = pa.array(list(self.head), pa.binary())
            own = np.array([v.words.get(w, -1) for w in self.head], np.int64)
            own[own < 0] = base + v.tails(self.known.filter(pa.array(own < 0)))
            self.id_of = np.concatenate((own, np.arange(base, base + v.tail_classes), [v.words[END]])).astype(np.int32)
            logs = np.log10(np.array([*self.head.values(), self.head.get(END, 0)], float) + 0.5)
            self.log_of = np.concatenate((logs[:-1], np.zeros(v.tail_classes), logs[-1:]))
        return self

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Places of the tokens of all texts end to end, each text's number of them, and the words outside the head with
        the numbers of their texts."""
        words, n = cut_words(texts)
        got = pc.index_in(words, value_set=self.known)
        rare = got.is_null()
        outside, rare = words.filter(rare), rare.to_numpy(zero_copy_only=False)
        got = got.fill_null(0).to_numpy().copy()
        got[rare] = len(self.head) + self.vocab.tails(outside)
        at = np.full(len(got) + len(n), len(self.id_of) - 1, np.int32)
        inner = np.ones(len(at), bool)
        inner[np.cumsum(n + 1) - 1] = False
        at[inner] = got
        return at, n + 1, outside, np.repeat(np.arange(len(n)), n)[rare]

    def documents(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text's words and its end."""
        at, n, _, _ = self.places(texts)
        return np.split(self.id_of[at], np.cumsum(n)[:-1]) if len(n) else []


def _count(size: int = 1 << 23):
    """Partial word counts of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in grouped(batches, size):
            c = cut_words(batch.column("text"))[0].value_counts()
            ends += len(batch)
            yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], names=["w", "c"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["w", "c"])

    return lean(run)


def _tail_counts(vocab: Vocabulary):
    """Tail classes of words in place of the words (w, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(vocab.tails(batch.column("w")), pa.int32()), batch.column("c")], names=["k", "c"])

    return lean(run)


CHUNK = 8192


def _pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _train_task(shared, rate: float, decay: float, buffer: int):
    """Train on all texts of the partition from the shared start; parameters by chunk, times the tokens seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang: Language = shared.value.arrange()
        net = Network(lang.vocab, lang.hidden, params={k: v.copy() for k, v in lang.params.items()})
        opt, seen, held, n = Adam(rate, decay), 0, [], 0
        for batch in grouped(batches):
            for d in lang.documents(batch.column("text")):
                held.append(d)
                n += len(d)
                if n >= buffer:
                    seen += train(net, held, opt)
                    held, n = [], 0
        if held:
            seen += train(net, held, opt)
        if seen:
            flat = _pack(net.p)
            parts = range(0, len(flat), CHUNK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a // CHUNK for a in parts], pa.int32()), pa.array([seen for _ in parts], pa.int64()),
                    pa.array([flat[a : a + CHUNK].astype(np.float32).tobytes() for a in parts], pa.binary()),
                ],
                names=["part", "tokens", "x"],
            )

    return lean(run)


def _average(key, pdf: pd.DataFrame) -> pd.DataFrame:
    w = pdf["tokens"].to_numpy(np.float64)
    x = np.stack([np.frombuffer(b, np.float32) for b in pdf["x"]]).astype(np.float64)
    return pd.DataFrame({"part": [key[0]], "tokens": [int(w.sum())], "x": [((w[:, None] * x).sum(0) / w.sum()).astype(np.float32).tobytes()]})


def average(parts: DataFrame, fan: int = 32) -> DataFrame:
    """Weighted means of parameter chunks, in two levels so that no group holds every task's row."""
    level = parts.withColumn("g", F.pmod(F.xxhash64("x"), F.lit(fan)))
    level = level.groupBy("part", "g").applyInPandas(lambda k, p: _average(k, p), "part int, tokens long, x binary")
    return level.groupBy("part").applyInPandas(lambda k, p: _average(k, p), "part int, tokens long, x binary")


SCORED = "row long, id long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"


def _score_task(shared, buffer: int):
    """A number of each row, its id, counts and scores of head words, and the words outside the head with their
    numbers: SCORED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang: Language = shared.value.arrange()
        net = Network(lang.vocab, lang.hidden, params=lang.params)
        norm = np.log10(lang.tokens + 0.5 * (lang.distinct + 1))
        base_id = lang.vocab.head_classes * lang.vocab.per_class
        tail_norm = np.log10(lang.tail_tokens + 0.5 * (lang.tail_distinct + 1))
        share = np.where(lang.id_of < base_id, 0, lang.log_of - tail_norm[np.maximum(lang.id_of - base_id, 0)])  # of a place in its tail class
        row = TaskContext.get().partitionId() << 40

        def flush(held: list[tuple]) -> pa.RecordBatch:
            nonlocal row
            docs, ids, n, known, base, own, words, times = zip(*held)
            got = score(net, [d for group in docs for d in group]) / LN10
            number = np.arange(row, row + len(got))
            row += len(got)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(number), pa.concat_arrays(ids), *(pa.array(np.concatenate(x)) for x in (n, known, base)),
                    pa.array(got + np.concatenate(own)), pa.concat_arrays(words), pa.concat_arrays(times),
                ],
                names=[c.split()[0] for c in SCORED.split(", ")],
            )

        held, n = [], 0
        for batch in grouped(batches):
            at, size, outside, owner = lang.places(batch.column("text"))
            ends = np.cumsum(size)
            base = np.add.reduceat(lang.log_of[at], ends - size) - size * norm
            own = np.add.reduceat(share[at], ends - size)
            known = size - np.bincount(owner, minlength=len(size)) - (END not in lang.head)
            # a text's words outside the head, each once with its number of times
            codes = outside.dictionary_encode()
            kinds = max(1, len(codes.dictionary))
            pairs, times = np.unique(owner * kinds + codes.indices.to_numpy(), return_counts=True)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(pairs // kinds, minlength=len(size))))), pa.int32())
            words = pa.ListArray.from_arrays(offsets, codes.dictionary.take(pa.array(pairs % kinds)))
            times = pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))
            held.append((np.split(lang.id_of[at], ends[:-1]), batch.column("id"), size, known, base, own, words, times))
            n += len(at)
            if n >= buffer:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return lean(run)


def fit(rows: DataFrame, head_words: int, vocabulary: int, hidden: int, warm_docs: int, buffer: int) -> tuple[Language, DataFrame]:
    """The language model of the training rows (id, text), and the counts of all words (w, c)."""
    spark = rows.sparkSession
    counts = stored(spark, rows.select("text").mapInArrow(_count(), "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    least = frequency_threshold(counts, "c", head_words)
    head = counts.where((F.col("c") >= least) | (F.col("w") == F.lit(END))).toPandas()
    head = head.sort_values(["c", "w"], ascending=[False, True])
    words = [bytes(w) for w in head["w"]]
    top = words[:vocabulary]
    if END not in top:
        top = [END, *top[: vocabulary - 1]]
    vocab = Vocabulary.build(top)
    in_vocab = spark.createDataFrame([(bytearray(w),) for w in top], "w binary")
    tails = counts.join(F.broadcast(in_vocab), "w", "left_anti").mapInArrow(_tail_counts(vocab), "k int, c long").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # a row a class
    tail_tokens, tail_distinct = np.zeros(vocab.tail_classes), np.zeros(vocab.tail_classes)
    for r in tails:
        tail_tokens[r.k], tail_distinct[r.k] = r.c, r.v
    known = dict(zip(words, head["c"].tolist()))
    lang = Language(vocab, known, int(total.n or 0), int(total.v or 0), tail_tokens, tail_distinct, hidden=hidden, least=least)
    net = Network(vocab, hidden)
    net.bias_from(np.array([known.get(w, 0) for w in top], float), tail_tokens)
    lang.params = net.p
    # starting point: a bounded sample of documents, those first in the order of their keys' hash
    key = F.xxhash64("id", "text").alias("key")
    drawn = rows.select(key).distinct().orderBy(F.xxhash64("key"), "key").limit(warm_docs)
    sample = rows.withColumn("key", key).join(F.broadcast(drawn), "key").dropDuplicates(["key"]).select("key", "text").toPandas().sort_values("key")
    lang.arrange()
    docs = lang.documents(pa.array(sample["text"], pa.string(), from_pandas=True))
    if docs:
        opt = Adam(5e-3)
        for _ in range(2):
            train(net, docs, opt, width=128)
    lang.params, lang.known = net.p, None
    shared = spark.sparkContext.broadcast(lang)
    trained = rows.select("text").mapInArrow(_train_task(shared, 3e-3, 2e-3, buffer), "part int, tokens long, x binary")
    trained = stored(spark, trained, "trained")
    means = average(trained).toPandas().sort_values("part")
    discard(trained)
    if len(means):
        flat = np.concatenate([np.frombuffer(b, np.float32) for b in means["x"]])
        lang.params = _unpack(flat, net.p)
    release(spark)
    return lang, counts


def score_documents(
    docs: DataFrame, head_words: int = 150_000, vocabulary: int = 1024, hidden: int = 24, warm_docs: int = 300,
    buffer: int = 6_000_000, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; see the
    module's text.  ``head_words``, ``vocabulary`` and ``warm_docs`` bound the broadcast and the warm-up, ``buffer``
    the tokens that a task holds at a time; counts, training and scores cover all documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    integral(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    learned = rows.where(~held_out("id", fold, folds))
    lang, counts = fit(learned, head_words, vocabulary, hidden, warm_docs, buffer)
    shared = spark.sparkContext.broadcast(lang)
    scored = stored(spark, rows.mapInArrow(_score_task(shared, buffer), SCORED), "scored")
    # words outside the head: their counts come by a join, once for each word of a document
    each = scored.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("w"), F.col("x.times").alias("t"))
    rare = counts.where(F.col("c") < lang.least)
    part = each.join(rare, "w", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("known"),
        F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"),
    )
    out = scored.select("row", "id", "n_tokens", "n_known", "base", "score").join(part, "row", "left").select(
        F.col("id").alias("doc_id"), "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
    return out.select(
        "doc_id", held_out("doc_id", fold, folds).alias("held_out"), "n_tokens", "n_known",
        F.lit(lang.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
