"""Hierarchical multi-length packing of tokenised documents.

Every document is tokenised once (the different pieces of some megabytes of text are cut and looked up together in
Arrow) and its ids are laid into sequences of the tiers (powers of two up to the context size).  Full contexts are cut
off first; the rest of each document goes to the smallest tier that holds it.  Each tier packs its own rests best-fit;
the gaps of longer tiers are then filled from shorter tiers, cutting the last filler where needed, so that a sequence
ends exactly at its tier.  What is left at the end of a partition is cut at powers of two and so needs no padding
either.  Sequences of one tier form step groups of equal token counts.

The operator works inside the input partitions and never shuffles: one task packs what it reads.

Defined cases: null or empty text is a document with the end id only; repeated rows are packed once each; a null
doc_id is kept; ids that are no integers are refused; an empty table gives no rows; a very long text is cut into as many sequences as it fills.
"""

from __future__ import annotations

import bisect
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, bounded_batches, claim, integral, key_id, lean
from .lm_scoring import grouped

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier long, step_id long"
)


def _byte_letters() -> np.ndarray:
    """Byte-level vocabularies write bytes that are not printable as the letters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return np.array([256 + rest.index(b) if b in rest else b for b in range(256)], "<u4")


_LETTERS = _byte_letters()
_LETTER, _DIGIT, _MARK, _ODD = range(4)


def _byte_class(b: int) -> int:
    """The pre-tokenizer's class of ASCII and of the two bytes of Latin-1 letters (0xC3 and one from 0x80 on); an
    apostrophe can begin a contraction."""
    if 48 <= b <= 57:
        return _DIGIT
    if 128 <= b < 192 or b == 0xC3 or b < 128 and chr(b).isalpha():
        return _LETTER
    return _MARK if 33 <= b < 127 and b != 39 else _ODD


_CLASS = np.array([_byte_class(b) for b in range(256)], np.uint8)


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions begin to begin + n - 1 of all spans, end to end."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def cut_runs(runs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of all runs of non-white-space bytes, which of them are odd, and where each run's pieces begin (and
    the last ends).

    Plain runs are lower-cased and cut as the pre-tokenizer does: letters together, punctuation together, digits one by
    one.  Odd ones (other characters, apostrophes, perhaps special tokens) stay whole and as they are.
    """
    at = _offsets(runs)
    if at[-1] == at[0]:
        return pa.array([], pa.binary()), np.empty(0, bool), np.zeros(len(runs) + 1, np.int64)
    data = np.frombuffer(runs.buffers()[2], np.uint8)[at[0] : at[-1]]
    at -= at[0]
    first = at[:-1][at[:-1] < at[1:]]  # white space at an end of a text leaves an empty run
    kind = _CLASS[data]
    strange = kind == _ODD
    lead = data[:-1] == 0xC3
    strange[:-1] |= lead & ((data[1:] | 32) == 0xB7)  # the signs of multiplication and division
    strange[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    odd = np.logical_or.reduceat(strange, first)
    plain = ~np.repeat(odd, np.diff(np.append(first, len(data))))
    upper = (data - np.uint8(65)) < 26
    upper[1:] |= lead & ((data[1:] - np.uint8(0x80)) < 0x1F)
    upper &= plain
    edge = kind == _DIGIT
    edge[1:] |= kind[1:] != kind[:-1]
    edge &= plain
    edge[first] = True
    begin = np.flatnonzero(edge)
    lower = data + (upper.view(np.uint8) << 5)
    ends = np.append(begin, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(lower)])
    return pieces, ~plain[begin], np.searchsorted(begin, at)


class ChunkTokenizer:
    """Token ids of whole texts, looking up the different pieces of many texts at once.

    The tokenizer lower-cases, drops white space, never matches across it, and merges only within a piece of its
    pre-tokenizer.  So the ids of a text are those of its runs' pieces in order, and a plain piece's are those of the
    tokenizer's model alone: nothing is left to normalise or split.  Odd runs are encoded by the whole tokenizer.

    The cache holds at most ``limit`` pieces of at most ``longest`` bytes between calls; those not seen for longest go.
    """

    def __init__(self, path: str, limit: int = 400_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        self.model = self.tokenizer.model
        self.calls = 0
        self.known = pa.array([], pa.binary())
        self.used = np.empty(0, np.int64)  # the last call with each known piece
        self.n, self.ids = np.empty(0, np.int64), np.empty(0, "<u4")

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        """One for each process: Python workers serve many tasks."""
        claim("tokens", _TOKENIZERS.clear)
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For each text, its ids as little-endian 32-bit numbers."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        runs = lists.flatten().dictionary_encode()
        pieces, odd, begin = cut_runs(runs.dictionary)
        pieces = pieces.dictionary_encode()
        piece = pieces.indices.to_numpy()
        kinds = np.empty(len(pieces.dictionary), bool)
        kinds[piece] = odd
        at = self._look_up(pieces.dictionary, kinds)[piece]
        n = self.n[at]
        pool = self.ids[_spans((np.cumsum(self.n) - self.n)[at], n)]
        self._trim()
        # where the ids of each different run lie, and then of each run
        ends = np.concatenate(([0], np.cumsum(n)))[begin]
        which = runs.indices.to_numpy()
        n = np.diff(ends)[which]
        whole = pool[_spans(ends[which], n)].tobytes()
        cut = (4 * np.concatenate(([0], np.cumsum(n)))[_offsets(lists) - lists.offsets[0].as_py()]).tolist()
        return [whole[a:b] for a, b in zip(cut, cut[1:])]

    def _look_up(self, pieces: pa.Array, odd: np.ndarray) -> np.ndarray:
        """Where different pieces stand among the known ones; learns those that do not yet."""
        self.calls += 1
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        new, size = at < 0, len(self.known)
        known, n, coded = [self.known], [self.n], [self.ids]
        for kind, learn in ((False, self._plain), (True, self._odd)):
            rows = np.flatnonzero(new & (odd == kind))
            for i in range(0, len(rows), 16_384):
                part = rows[i : i + 16_384]
                known.append(pieces.take(pa.array(part)))
                ids = learn(known[-1])
                n.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                coded.append(np.fromiter(itertools.chain.from_iterable(ids), "<u4"))
                at[part] = size + np.arange(len(part))
                size += len(part)
        self.known, self.n, self.ids = pa.concat_arrays(known), np.concatenate(n), np.concatenate(coded)
        self.used = np.concatenate((self.used, np.zeros(size - len(self.used), np.int64)))
        self.used[at] = self.calls
        return at

    def _plain(self, words: pa.Array) -> list[list[int]]:
        """Ids of plain pieces: the merges alone."""
        at = _offsets(words)
        letters = _LETTERS[np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]]].tobytes().decode("utf-32-le")
        at, tokenize = at.tolist(), self.model.tokenize
        return [[t.id for t in tokenize(letters[a:b])] for a, b in zip(at, at[1:])]

    def _odd(self, words: pa.Array) -> list[list[int]]:
        """Ids of odd runs."""
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in words.to_pylist()], add_special_tokens=False)
        return [e.ids for e in coded]

    def _trim(self) -> None:
        """Bring the cache back to its bounds, well below so that it seldom happens."""
        keep = pc.binary_length(self.known).to_numpy() <= self.longest
        if len(self.known) > self.limit:
            keep[np.argsort(-self.used, kind="stable")[self.limit * 3 // 4 :]] = False
        if not keep.all():
            begin = np.cumsum(self.n) - self.n
            self.ids = self.ids[_spans(begin[keep], self.n[keep])]
            self.known, self.used, self.n = self.known.filter(pa.array(keep)), self.used[keep], self.n[keep]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


class Packer:
    """Packs (document, length) pairs into sequences; see the module's text.

    ``add`` queues a document; ``flush(last)`` returns finished sequences as (tier, [(document, start, length)]).
    """

    def __init__(self, context: int = 2048, tiers: tuple[int, ...] = (256, 512, 1024, 2048)):
        assert all(t & (t - 1) == 0 for t in tiers) and max(tiers) == context
        self.context, self.tiers = context, sorted(tiers)
        self.rests: list[tuple[int, int, int]] = []
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, length: int) -> None:
        start = 0
        while length - start >= self.context:
            self.done.append((self.context, [(doc, start, self.context)]))
            start += self.context
        if length > start:
            self.rests.append((doc, start, length - start))

    def _tier(self, n: int) -> int:
        return self.tiers[bisect.bisect_left(self.tiers, n)]

    def flush(self, last: bool = False) -> list[tuple[int, list[tuple[int, int, int]]]]:
        routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        for x in self.rests:
            routed[self._tier(x[2])].append(x)
        bins: dict[int, list[tuple[int, list]]] = {}
        for t in self.tiers:  # each tier packs its own, best fit for the longest first
            free: list[tuple[int, int]] = []
            own: list[list] = []
            for x in sorted(routed[t], key=lambda x: -x[2]):
                i = bisect.bisect_left(free, (x[2], -1))
                if i < len(free):
                    room, b = free.pop(i)
                else:
                    room, b = t, len(own)
                    own.append([])
                own[b].append(x)
                if room > x[2]:
                    bisect.insort(free, (room - x[2], b))
            gap = {b: room for room, b in free}
            bins[t] = [(gap.get(b, 0), own[b]) for b in range(len(own))]
        # the bins of shorter tiers are the stock for the gaps of longer ones
        rests: list[tuple[int, int, int]] = []
        for i in range(len(self.tiers) - 1, -1, -1):
            t = self.tiers[i]
            stock: list[tuple[int, int, int]] = []
            lower = i - 1
            for gap, items in sorted(bins[t], key=lambda b: b[0]):
                while gap:
                    while not stock and lower >= 0 and (bins[self.tiers[lower]] or lower > 0):
                        if bins[self.tiers[lower]]:
                            k = max(range(len(bins[self.tiers[lower]])), key=lambda j: bins[self.tiers[lower]][j][0]) if len(bins[self.tiers[lower]]) < 64 else -1
                            stock = sorted(bins[self.tiers[lower]].pop(k)[1], key=lambda x: x[2])
                        else:
                            lower -= 1
                    if not stock:
                        break
                    doc, start, n = stock.pop()
                    take = min(gap, n)
                    items.append((doc, start, take))
                    gap -= take
                    if take < n:
                        stock.append((doc, start + take, n - take))
                if gap:
                    rests.extend(items)
                else:
                    self.done.append((t, items))
            rests.extend(stock)
        self.rests = rests
        if last:
            self._close()
        out, self.done = self.done, []
        return out

    def _close(self) -> None:
        """Lay the last rests end to end and cut at powers of two."""
        left = sum(x[2] for x in self.rests)
        queue = self.rests[::-1]
        self.rests = []
        while left:
            size = min(self.context, 1 << (left.bit_length() - 1))
            need, items = size, []
            while need:
                doc, start, n = queue.pop()
                take = min(n, need)
                items.append((doc, start, take))
                need -= take
                if take < n:
                    queue.append((doc, start + take, n - take))
            self.done.append((size, items))
            left -= size


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    context: int = 2048,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    step_tokens: int = 16_384,
    buffer_tokens: int = 1_500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece (schema PIECES): ``ids`` are the piece's token ids, little-endian unsigned 32-bit.

    ``sequence_tokens`` is the sequence's length (context, a tier, or a power of two); ``step_id`` names the step
    group: sequences of one tier whose lengths add up to ``step_tokens``.  Ids are unique over all partitions.
    """

    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer.of(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        top = TaskContext.get().partitionId() << 40
        packer = Packer(context, tiers)
        held: dict[int, tuple[int, bytes]] = {}
        count, queued, seq = 0, 0, 0
        steps: dict[int, list[int]] = {}
        n_steps = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal seq, n_steps, held
            rows = []
            for tier, items in packer.flush(last):
                step = steps.get(tier)
                if step is None or step[1] + tier > step_tokens:
                    step = steps[tier] = [n_steps, 0]
                    n_steps += 1
                step[1] += tier
                at = 0
                for d, start, n in items:
                    doc_id, ids = held[d]
                    rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, top + seq, at, tier, tier, top + step[0]))
                    at += n
                seq += 1
            keep = {x[0] for x in packer.rests}
            held = {d: held[d] for d in keep}
            columns = zip(*rows) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in grouped(batches, 1 << 23):
            for doc_id, coded in zip(batch["doc_id"].to_pylist(), tok.encode(batch["text"])):
                coded += end
                held[count] = (doc_id, coded)
                packer.add(count, len(coded) // 4)
                count += 1
                queued += len(coded) // 4
                if queued >= buffer_tokens:
                    yield emit(False)
                    queued = sum(x[2] for x in packer.rests)
        yield emit(True)

    bounded_batches(docs.sparkSession)
    integral(docs, id_col)
    # a null among the ids would turn the others of its batch into floats
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id")
    rows = docs.select(doc_id, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), PIECES).withColumn("doc_id", key_id("doc_id"))


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents' token sequences, with the CRC-32 of their ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids of a piece as their CRC-32."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_tokens", "tier", "step_id",
    )
