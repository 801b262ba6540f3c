import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import data

key = lambda r: tuple(str(x) for x in r)


def bag(rows):
    return Counter(map(key, rows))


@pytest.fixture(scope="module")
def docs(spark):
    df = data.frame(spark)
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return data.frame(spark, [])


# --- packing -------------------------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_packing_round_trip(spark, docs, empty):
    from loomtext.llm.packing import digest, pack_documents

    path, tok = tokenizer()
    out = digest(pack_documents(docs, path, buffer_tokens=3000)).toPandas()
    expect = Counter()
    for i, t, *_ in data.rows():
        expect[(str(i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    by_doc = {}
    for (i, ids), n in expect.items():
        by_doc.setdefault((i, len(ids)), []).append((ids, n))
    total = sum(len(ids) * n for (_, ids), n in expect.items())
    assert out.length.sum() == total
    for r in out.itertuples():
        i = "None" if r.doc_id != r.doc_id else str(int(r.doc_id))
        crcs = {zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids, _ in by_doc[(i, r.doc_tokens)]}
        assert r.ids_crc32 in crcs
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all()
        assert g.length.sum() == g.sequence_tokens.iloc[0] <= 2048
        n = int(g.length.sum())
        assert n & (n - 1) == 0
    steps = out.drop_duplicates("sequence_id").groupby(["step_id"]).sequence_tokens.sum()
    assert steps.max() <= 16384
    assert pack_documents(empty, path).count() == 0
    large = spark.createDataFrame([(2**53 + 1, "a b"), (None, "c"), (-(2**62) - 1, "")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in pack_documents(large, path).collect()} == {2**53 + 1, None, -(2**62) - 1}


def test_packed_ids_are_the_tokenizers(spark):
    """Also where a small letter and a mark compose but the capital and the mark do not."""
    from loomtext.llm.packing import pack_documents

    path, tok = tokenizer()
    texts = ["J\u030c H\u0331 T\u0308", "\u00c9t\u00c9 \u00d7 a\u00f7b 12.5 3-4x", "it's L'\u00c9T\u00c9 <|endoftext|>A <|", "a\u00a0b\u0085c \u4e2d\u6587,", " \n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {}
    for r in sorted(pack_documents(docs, path).collect(), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i], "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [1]


def test_each_different_piece_is_encoded_once():
    """Capitals, digits and punctuation cost no encoding of their own; the cache keeps its bounds."""
    import pyarrow as pa

    from loomtext.llm.packing import ChunkTokenizer

    class Spy:
        def __init__(self, inner):
            self.inner, self.n = inner, Counter()

        def tokenize(self, text):
            self.n[text] += 1
            return self.inner.tokenize(text)

        def encode_batch_fast(self, texts, **how):
            self.n.update(texts)
            return self.inner.encode_batch_fast(texts, **how)

    path, whole = tokenizer()
    tok = ChunkTokenizer(path, limit=60)
    tok.model, tok.tokenizer = Spy(tok.model), Spy(tok.tokenizer)
    words = [a + b for a in "bdfgklmn" for b in ("ana", "elo", "iru", "ot\u00e9")]
    texts = [f"{w.title()}, {w}. {w.upper()}-{i}! don't" for i, w in enumerate(words)] * 3
    for _ in range(2):
        coded = tok.encode(pa.array(texts))
        assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert tok.tokenizer.n == {"don't": 1}
    assert len(tok.model.n) == 32 + 10 + 4 and set(tok.model.n.values()) == {1}
    rare = pa.array([" ".join(f"{w}{v}" for w in words for v in "aeiou")])
    assert tok.encode(rare) == ChunkTokenizer(path).encode(rare)
    assert len(tok.known) == len(tok.n) == len(tok.used) <= 60 and len(tok.ids) == tok.n.sum()


@pytest.mark.parametrize("seed", range(5))
def test_packer_keeps_every_token(seed):
    from loomtext.llm.packing import Packer

    r = np.random.default_rng(seed)
    p, lengths, got = Packer(64, (8, 16, 32, 64)), [], []
    for i in range(60):
        n = int(r.integers(1, 150))
        lengths.append(n)
        p.add(i, n)
        if i % 17 == 0:
            got += p.flush()
    got += p.flush(True)
    seen = {}
    for tier, items in got:
        assert sum(x[2] for x in items) == tier
        for d, start, n in items:
            seen.setdefault(d, []).append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at
            at += k
        assert at == n


# --- decontamination -----------------------------------------------------------------------------------------------

ITEMS = [(1, data.PASSAGE), (2, "one two three"), (3, None), (4, "?!"), (None, "one"), (5, " ".join(data.BASE.split()[20:40])), (1, data.PASSAGE), (6, "same same same same same same same same")]


def brute_contamination(texts, items, window=8):
    wins = {}
    for i, t in items:
        w = data.alnum_words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - window + 1)):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(k) for k in wins}
    for t in texts:
        w, hit, found = data.alnum_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = wins.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit |= set(range(k, k + n))
        yield len(w), hit, found


@pytest.mark.parametrize("block_words", [100_000, 10])
@pytest.mark.parametrize("items", [ITEMS, [x for x in ITEMS if x[0] not in (2, None)], []])
def test_decontamination(spark, docs, empty, items, block_words):
    from loomtext.llm.decontamination import find_contamination

    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(docs, bench, block_words=block_words).collect()
    got = bag((r.doc_id, r.n_words, sorted({w for s in r.spans for w in range(s.start, s.stop)}), sorted(r["items"])) for r in out)
    want = bag((i, n, sorted(h), sorted(f)) for (i, t, *_), (n, h, f) in zip(data.rows(), brute_contamination([t for _, t, *_ in data.rows()], items)))
    assert got == want
    assert find_contamination(empty, bench).count() == 0


def test_contamination_of_clashing_columns(spark, docs):
    """Columns with the operator's own names stay as they are, in one pass and in several."""
    from loomtext.llm.decontamination import _scan, decontaminate

    bench = spark.createDataFrame([(1, data.PASSAGE), (2, data.prose(40, 13))], "item_id long, text string")
    own = docs.withColumns({"__spans": F.lit("a"), "__n_words": F.lit("b"), "__items": F.lit("c"), "__k1": F.lit("d")})
    out = decontaminate(own, bench)
    assert out.columns == own.columns and {tuple(r) for r in out.select("__spans", "__n_words", "__items", "__k1").distinct().collect()} == {("a", "b", "c", "d")}
    one, several = (_scan(own, bench, 8, n, "doc_id", "text", 0) for n in (100_000, 10))
    assert one[1] == several[1] and one[0].columns == several[0].columns
    assert bag(map(str, one[0].collect())) == bag(map(str, several[0].collect()))


def test_decontaminated_texts(spark, docs):
    from loomtext.llm.decontamination import decontaminate

    bench = spark.createDataFrame([(1, data.PASSAGE), (9, "aa bb cc dd ee ff gg hh")], "item_id long, text string")
    out = decontaminate(docs, bench)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert 22 not in left and 14 not in left  # mostly benchmark
    for r in left.values():
        assert r.text is None or data.PASSAGE not in r.text
    assert left[8].text == data.BASE
    kept = [t for i, t, *_ in data.rows() if i == 13][0].replace(data.PASSAGE, "")
    assert left[13].text == kept if 13 in left else True


# --- quality -------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_everything(spark, docs, empty):
    from loomtext.llm.quality_cnn import classify_quality, crc_mod, keep_quality

    rows = [(i, data.prose(30 + i % 50, i) if i % 4 else "BUY!! NOW!! $$$ " * (3 + i % 9), "en", "s", 1) for i in range(400)]
    train = data.frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(301, None), (302, 7), (303, 0), (303, 1)], "doc_id long, quality int")
    out = classify_quality(train, labels, sample_rows=200, epochs=40).toPandas()
    assert len(out) == 400 and out.score.between(0, 1).all()
    assert all(bool(r.held_out) == (crc_mod(r.doc_id) == 0) for r in out.itertuples())
    held = out[out.held_out]
    assert (held.predicted == (held.doc_id % 4 > 0).astype(int)).mean() > 0.95
    some = classify_quality(docs, labels, sample_rows=50, epochs=1)
    assert some.count() == len(data.rows()) and some.where("score is null").count() == 0
    assert keep_quality(docs, labels, sample_rows=50, epochs=1).columns == docs.columns
    assert classify_quality(empty, labels).count() == 0
    assert classify_quality(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5


def test_long_texts_are_seen_whole():
    from loomtext.llm.quality_cnn import dealt

    for n, least, epochs in ((13, 12, 2), (300, 12, 10), (31, 1, 4)):
        parts = [dealt(n, least, e, epochs, (3, 1)).tolist() for e in range(epochs)]
        assert {k for p in parts for k in p} == set(range(n)) and all(len(set(p)) == len(p) for p in parts)


def test_quality_gradients():
    from loomtext.llm.quality_cnn import ByteCNN

    net = ByteCNN(4, 5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["w2"] += np.random.default_rng(1).normal(size=6)
    net.p["b"] += np.random.default_rng(2).normal(0, 0.2, 5)  # off the kinks of empty windows
    texts, y = [b"hello world " * 9, b"", b"abc" * 300], np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(texts)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net._gradients(texts, y)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert math.isclose((up - down) / 2e-6, g[name].reshape(-1)[k], rel_tol=2e-2, abs_tol=1e-6), name


# --- substrings ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["seeds", "suffixes"])
@pytest.mark.parametrize("window", [35, 50])
def test_repeats(spark, docs, empty, method, window):
    from loomtext.llm.substring_dedup import drop_repeats
    from loomtext.llm.suffix_dedup import find_repeats

    run = drop_repeats if method == "seeds" else lambda d, window: find_repeats(d, window, array_rows=3)
    out = run(docs, window=window).collect()
    got = bag((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out)
    texts = [t for _, t, *_ in data.rows()]
    want = bag(
        (i, len(w), sum(g), hashlib.sha256(" ".join(x for x, k in zip(w, g) if not k).encode()).hexdigest())
        for (i, *_), (w, g) in zip(data.rows(), data.repeated(texts, window))
    )
    assert got == want
    assert run(empty, window=window).count() == 0


def test_repeat_edges(spark):
    """Shared passages whose surroundings match in part, so that classes must be opened."""
    from loomtext.llm.substring_dedup import drop_repeats
    from loomtext.llm.suffix_dedup import find_repeats

    p = data.prose(60, "edge").split()
    rows = []
    for i in range(40):
        a, b = i % 7, 60 - (i * 3) % 11
        rows.append((i, " ".join([data.prose(5 + i % 4, f"l{i}"), *p[a:b], data.prose(4, f"r{i % 5}")]), "en", "s", 1))
    texts = [t for _, t, *_ in rows]
    df = data.frame(spark, rows)
    for window in (35, 50):
        want = {i: sum(g) for (i, *_), (_, g) in zip(rows, data.repeated(texts, window))}
        assert {r.doc_id: r.n_removed for r in drop_repeats(df, window=window).collect()} == want
        assert {r.doc_id: r.n_removed for r in find_repeats(df, window=window, array_rows=4).collect()} == want


def test_repeats_across_salted_parts(spark):
    """A single text and a class of copies that share a passage, dealt into different parts of one array."""
    from loomtext.llm.suffix_dedup import find_repeats

    rows = []
    for i in range(12):
        shared = data.prose(53, f"shared{i}")
        single, copied = (" ".join([data.prose(30, f"a{i}{x}"), shared, data.prose(30, f"b{i}{x}")]) for x in "xy")
        rows += [(3 * i, single, "en", "s", 1), (3 * i + 1, copied, "en", "s", 1), (3 * i + 2, copied, "en", "s", 1)]
    want = {i: sum(g) for (i, *_), (_, g) in zip(rows, data.repeated([t for _, t, *_ in rows], 50))}
    assert all(want[3 * i] == 53 for i in range(12))
    assert {r.doc_id: r.n_removed for r in find_repeats(data.frame(spark, rows), array_rows=1).collect()} == want


def test_cut_stage(spark, docs):
    from loomtext.llm.substring_dedup import cut_repeats

    out = cut_repeats(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    assert left[4] == "one" and left[2] == "" and left[1] is None and 9 not in left and 22 not in left
    for i in (13, 14, 15):
        assert data.PASSAGE not in left[i] and left[i].strip()


@pytest.mark.parametrize("seed", range(4))
def test_salted_arrays_are_exact(spark, seed):
    """Random short documents that share a 16-word core, so that its array is salted at any size."""
    from loomtext.llm.substring_dedup import drop_repeats
    from loomtext.llm.suffix_dedup import find_repeats

    r = np.random.default_rng(seed)
    core = data.prose(16, f"core{seed}").split()
    sides = [data.prose(60, f"side{seed}{k}").split() for k in range(4)]
    rows = []
    for i in range(40):
        a, b = sides[r.integers(4)], sides[r.integers(4)]
        rows.append((i, " ".join([*a[int(r.integers(0, 30)) :], *core, *b[: int(r.integers(20, 60))]]), "en", "s", 1))
    want = {i: sum(g) for (i, *_), (_, g) in zip(rows, data.repeated([t for _, t, *_ in rows], 50))}
    df = data.frame(spark, rows)
    for array_rows in (1, 2, 3, 4096):
        assert {x.doc_id: x.n_removed for x in find_repeats(df, array_rows=array_rows).collect()} == want, array_rows
    want = {i: sum(g) for (i, *_), (_, g) in zip(rows, data.repeated([t for _, t, *_ in rows], 35))}
    assert {x.doc_id: x.n_removed for x in drop_repeats(df).collect()} == want


def test_anchors_are_leftmost_minima():
    from loomtext.llm.common import gram_hashes, word_hashes
    from loomtext.llm.substring_dedup import anchors

    r = np.random.default_rng(0)
    for n, kinds in ((3, 2), (40, 1), (200, 3), (500, 400), (36, 9)):
        h = word_hashes([" ".join(f"v{k}" for k in r.integers(0, kinds, n)).encode()])[0]
        for window, k in ((35, 12), (9, 3)):
            at, lo, hi = anchors(h, window, k)
            g, got = gram_hashes(h, k), {}
            for a, x, y in zip(at, lo, hi):
                got |= {i: a for i in range(x, y + 1)}
            assert got == {i: i + int(g[i : i + window - k + 1].argmin()) for i in range(max(0, n - window + 1))}


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand and however texts are cut for hashing."""
    from loomtext.llm import common

    texts = [(t or "").encode() for _, t, *_ in data.rows()] + [b"\x0b \x0c", b"x" * 70 + b" y " + b"z" * 90]
    seen = {}
    for slab, long in ((1 << 17, 1 << 20), (50, 60), (1, 1 << 20)):
        monkeypatch.setattr(common, "SLAB", slab)
        monkeypatch.setattr(common, "LONG", long)
        for t, h in zip(texts, common.word_hashes(texts)):
            assert len(h) == len(t.split())
            for w, x in zip(t.split(), h.tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- near duplicates -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [{}, {"salt_rows": 1, "report": 2}, {"chunk": 2, "hot_rows": 2, "cluster_rows": 2, "salt_rows": 2, "report": 2}])
def test_ngram_join(spark, docs, empty, parts):
    from loomtext.llm.common import key_id
    from loomtext.llm.ngram_join import drop_near_duplicates, ngram_join

    out = ngram_join(docs, **parts).select(key_id("k1").alias("doc_id"), "n_shingles", "component_id").collect()
    sets = [data.shingle_set(t) for _, t, *_ in data.rows()]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(sets[i]) and bool(sets[j]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    comps = data.components([i for i, *_ in data.rows()], linked)
    assert bag(map(tuple, out)) == bag((i, len(s), c) for (i, *_), s, c in zip(data.rows(), sets, comps))
    kept = drop_near_duplicates(docs, **parts)
    assert kept.columns == docs.columns
    ids = sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None)
    want = sorted({c for (i, *_), c, s in zip(data.rows(), comps, sets) if c is not None and s} | {1, 2, 3})
    assert ids == want
    assert ngram_join(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Groups without ids, groups whose smallest id is shared, and rows that differ in other columns only."""
    from loomtext.llm.ngram_join import drop_near_duplicates

    near = [data.edited(data.BASE, 1, k) for k in range(6)]
    other = data.prose(90, "other")
    rows = [(None, near[0], "a", "s", 1), (None, near[1], "a", "s", 1)]
    rows += [(5, other, "x", "s", 1), (5, other, "y", "s", 1), (5, other, "y", "s", 1), (5, data.edited(other, 1, 3), "z", "s", 1), (6, other, "x", "s", 1)]
    rows += [(7, "", "x", "s", 0), (7, "", "x", "s", 0)]
    df = spark.createDataFrame(rows, data.DOCS)
    outs = [sorted(map(tuple, drop_near_duplicates(df.repartition(k)).collect()), key=str) for k in (1, 3)]
    assert outs[0] == outs[1]
    assert sorted(str(r[0]) for r in outs[0]) == ["5", "7", "7", "None"]
    with pytest.raises(TypeError):
        drop_near_duplicates(df.withColumn("doc_id", F.lit("a")))


def test_tree_is_complete():
    from loomtext.llm.ngram_join import count_vector, forest_search

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate((base[: r.integers(60, 400)], r.integers(0, 1 << 63, r.integers(1, 60)).astype(np.uint64)))) for _ in range(150)), key=len)
    counts, sizes = np.stack([np.minimum(count_vector(s, 64), 255).astype(np.uint8) for s in sets]), np.array([len(s) for s in sets])
    found = {(int(a), int(b)) for x, y in forest_search(np.array([0, 50, 150]), counts, sizes, None, 80, fan=4, memory=5_000) for a, b in zip(x, y)}
    for lo, hi in ((0, 50), (50, 150)):
        for i in range(lo, hi):
            for j in range(i + 1, hi):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    assert (i, j) in found


# --- licenses ------------------------------------------------------------------------------------------------------


def test_license_scan(spark, empty):
    from loomtext.llm.license_scan import PHRASES, TEMPLATES, scan_licenses

    texts = [
        None, "", "x\nLicensed under CC BY-NC 4.0.\ny", "All Rights\nReserved all rights reserved", "cc by cc by", "accc by", "CCé by",
        "This work is licensed under the GNU General Public License, version 3.", "under the Apache license, version 2.0: Licensed!", "released under a license",
        "Licensed under the\nApache License,\nVersion 2.0 (the License)", "all " + "x " * 9 + "rights " + "y " * 9 + "reserved", "all the rights are reserved",
        "public " * 40 + data.prose(30, 1) + " this program is free software under terms of the gnu general public license " + data.prose(40, 2) + " mit license under the released",
        "the of " * 6000 + "all rights reserved" + " of the" * 6000,
    ]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(7, texts[7], "en", "s", 1), (None, texts[2], "en", "s", 1)]
    out = scan_licenses(data.frame(spark, rows)).collect()

    def brute(t):
        w = data.alnum_words(t)
        places = sorted((k, lab) for p, lab in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        hits = []
        for k, (lab, tem) in enumerate(TEMPLATES):
            s, width = set(tem.split()), 2 * len(tem.split())
            best = max(((len(set(w[i : i + width]) & s), -i) for i in range(len(w)) if w[i] in s), default=(0, 0))
            if best[0] >= math.ceil(0.9 * len(s) - 1e-9):
                hits.append((k, lab, round(best[0] / len(s), 9)))
        return len(w), places, hits, max((h[2] for h in hits), default=0.0)

    got = bag((r.doc_id, r.n_words, sorted((p.start, p.label) for p in r.places), [(h.template, h.label, round(h.containment, 9)) for h in r.hits], round(r.score, 9)) for r in out)
    assert got == bag((i, *brute(t)) for i, t, *_ in rows)
    assert {h.label for r in out if r.doc_id == 10 for h in r.hits} == {"apache"} and [r.score for r in out if r.doc_id == 11] == [0.0]
    for r in out:
        for h in r.hits:  # the block that starts there holds what it says
            lab, tem = TEMPLATES[h.template]
            w = data.alnum_words(dict((i, t) for i, t, *_ in rows)[r.doc_id] if r.doc_id is not None else texts[2])
            assert len(set(w[h.start : h.start + 2 * len(tem.split())]) & set(tem.split())) / len(set(tem.split())) == pytest.approx(h.containment)
    assert scan_licenses(empty).count() == 0
    assert [c for c in ("Python", "Pandas", "Arrow") if c in scan_licenses(data.frame(spark, rows))._jdf.queryExecution().toString()] == []


# --- language model ------------------------------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    from loomtext.llm.lm_scoring import score_documents

    for head in (100_000, 20):
        out = score_documents(docs, head_words=head, vocabulary=64, warm_docs=10).collect()
        c = Counter()
        for i, t, *_ in data.rows():
            if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
                c.update(data.space_words(data.lower(t)))
                c["\n"] += 1
        n, v = sum(c.values()), len(c)
        want = Counter()
        for i, t, *_ in data.rows():
            w = [*data.space_words(data.lower(t)), "\n"]
            base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            want[(str(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 5), zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1)] += 1
        assert Counter((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.held_out) for r in out) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert score_documents(empty).count() == 0


def test_model_is_a_distribution_and_carries_state():
    from loomtext.llm import lm_scoring as L

    v = L.Vocabulary.build([L.END, *(f"w{i}".encode() for i in range(20))], per_class=8, tail_classes=4)
    net = L.Network(v, 6)
    net.bias_from(np.arange(21.0) + 1, np.array([3.0, 2, 1, 4]))
    r = np.random.default_rng(0)
    for k in ("wc", "ww"):
        net.p[k] += r.normal(0, 0.5, net.p[k].shape).astype(np.float32)
    h = r.uniform(-1, 1, (1, 6)).astype(np.float32)
    total = sum(math.exp(net.loss(h, np.array([t]))[0][0]) for t in [*range(21), *range(24, 28)])
    assert abs(total - 1) < 1e-4
    docs = [r.integers(0, 20, n).astype(np.int32) for n in (3, 50, 200, 1)]
    together, alone = L.score(net, docs, width=2, window=7), [L.score(net, [d], window=1000)[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)


def test_language_model_gradients():
    from loomtext.llm import lm_scoring as L

    v = L.Vocabulary.build([L.END, *(f"w{i}".encode() for i in range(10))], per_class=4, tail_classes=2)
    net = L.Network(v, 5)
    r = np.random.default_rng(2)
    net.p = {k: r.normal(0, 0.4, a.shape) for k, a in net.p.items()}
    ids, fresh = r.integers(0, 11, (6, 3)), np.zeros((6, 3), bool)
    fresh[0] = True
    fresh[3, 1] = True

    def run():
        states, _, saved = net.run(ids, fresh, np.zeros((3, 5)), True)
        states = states.astype(np.float64)
        g = {k: np.zeros_like(a) for k, a in net.p.items()}
        out, ds = net.loss(states.reshape(-1, 5), ids.reshape(-1), g)
        return out, ds, saved, g

    out, ds, saved, g = run()
    net.back(ids, fresh, saved, ds.reshape(6, 3, 5), g)
    for name in net.p:
        flat, gf = net.p[name].reshape(-1), g[name].reshape(-1)
        for k in np.argsort(-np.abs(gf))[:3]:
            old = flat[k]
            flat[k] = old + 1e-3
            up = run()[0].sum()
            flat[k] = old - 1e-3
            down = run()[0].sum()
            flat[k] = old
            assert math.isclose(-(up - down) / 2e-3 / 1024, gf[k], rel_tol=0.05, abs_tol=2e-6), name


def test_training_beats_unigrams(spark):
    from loomtext.llm.lm_scoring import score_documents

    rows = [(i, " ".join(("a%d b%d" % (k % 5, k % 5)) for k in range(i % 7, i % 7 + 40)), "en", "s", 1) for i in range(200)]
    out = score_documents(data.frame(spark, rows), warm_docs=100).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1] * 0.9


def test_full_size_network(spark, docs, monkeypatch):
    """Without options, scoring runs on the network of the README: 24 hidden units, 32 tail classes, 64 words a class."""
    from loomtext.llm import lm_scoring as L

    fitted, fit = [], L.fit
    monkeypatch.setattr(L, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    L.score_documents(docs, warm_docs=5)
    lang = fitted[0][0]
    assert lang.params["u"].shape == (24, 72) and lang.vocab.tail_classes == len(lang.tail_tokens) == 32
    assert (lang.vocab.per_class, lang.vocab.head_classes) == (64, -(-len(lang.vocab.words) // 64))


def test_training_carries_state_through_long_documents(monkeypatch):
    """A document is one stretch of a stream, whatever its length, and its state is cleared at its start only."""
    from loomtext.llm import lm_scoring as L

    v = L.Vocabulary.build([L.END, *(f"w{i}".encode() for i in range(20))], per_class=8, tail_classes=4)
    net, seen = L.Network(v, 6), []
    run = L.Network.run
    monkeypatch.setattr(L.Network, "run", lambda self, ids, fresh, h, keep: seen.append((ids.copy(), fresh.copy(), h.copy())) or run(self, ids, fresh, h, keep))
    r = np.random.default_rng(1)
    docs = [r.integers(0, 20, n).astype(np.int32) for n in (5000, 3, 40, 700, 1)]
    assert L.train(net, docs, L.Adam(1e-3), width=4, least=1) == sum(map(len, docs))
    assert sum(int(f.sum()) for _, f, _ in seen) == len(docs)
    assert all(np.abs(h).sum() > 0 for _, _, h in seen[1:])


def test_words_are_cut_and_looked_up_by_the_group(monkeypatch):
    """op1's time: a look-up serves thousands of texts, not one, and gives each text what looking up its words alone gives."""
    import pyarrow as pa

    from loomtext.llm import lm_scoring as L

    r = np.random.default_rng(4)
    letters = [*map(chr, range(40)), *"AZaz09 \t\n", "\x7f", "\u0085", "\u00a0", "\u2003", "é", "İ", "\U0001f600"]
    texts = ["".join(r.choice(letters, n)) for n in r.integers(0, 60, 3000)] + [None, "", " ", "\n a \n"]
    words = [[w.encode() for w in data.space_words(data.lower(t))] for t in texts]
    flat = [w for ws in words for w in ws]
    got, n = L.cut_words(pa.array(texts))
    assert got.to_pylist() == flat and n.tolist() == [len(ws) for ws in words]
    most = [w for w, _ in Counter(flat).most_common(60)]
    for head in ([L.END, *most], most[:1], []):
        v = L.Vocabulary.build([L.END, *most[:20]], per_class=8, tail_classes=7)
        assert v.tails(got.slice(5, 900)).tolist() == [v.tail(w) for w in flat[5:905]]
        lang = L.Language(v, {w: 2 for w in head}, 9, 9).arrange()
        calls, index_in = [], L.pc.index_in
        monkeypatch.setattr(L.pc, "index_in", lambda *a, **k: calls.append(1) or index_in(*a, **k))
        ids = [d.tolist() for batch in L.grouped(pa.RecordBatch.from_arrays([pa.array(texts[i : i + 512])], ["text"]) for i in range(0, len(texts), 512)) for d in lang.documents(batch.column("text"))]
        monkeypatch.undo()
        assert len(calls) == 1
        base = v.head_classes * v.per_class
        assert ids == [[v.words[w] if w in v.words and w in head else base + v.tail(w) for w in ws] + [0] for ws in words]
        _, _, outside, owner = lang.places(pa.array(texts))
        assert list(zip(owner, outside.to_pylist())) == [(i, w) for i, ws in enumerate(words) for w in ws if w not in head]
    assert lang.documents(pa.array([], pa.string())) == []
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for size in (1, 4000):
        parts = list(L.grouped(iter([whole, whole.slice(0, 0), whole.slice(7, 9)]), size))
        assert [t for b in parts for t in b.column("text").to_pylist()] == texts + texts[7:16]
        assert all(b.num_rows == 1 or b.nbytes <= size for b in parts)


def test_counting_makes_no_call_for_each_text():
    """op1's time, as far as a test can hold it: calls from Python, not seconds."""
    import sys

    import pyarrow as pa

    from loomtext.llm import lm_scoring as L

    texts = [None, "", *(f"  W{i % 9} w{i % 9}\x0b{i} é\u00a0É " for i in range(3000))]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 500])], ["text"]) for i in range(0, len(texts), 500)]
    calls = [0]

    def count(_, event, __):
        calls[0] += event in ("call", "c_call")

    run = L._count()(iter(batches))
    sys.setprofile(count)
    try:
        out = list(run)
    finally:
        sys.setprofile(None)
    got, want = Counter(), Counter({L.END: len(texts)})
    for batch in out:
        for w, c in zip(batch.column("w").to_pylist(), batch.column("c").to_pylist()):
            got[w] += c
    for t in texts:
        want.update(w.encode() for w in data.space_words(data.lower(t)))
    assert got == want
    assert calls[0] < len(texts)


def test_softmax_in_blocks(monkeypatch):
    """Log probabilities and gradients don't depend on the block, and large logits don't overflow."""
    from loomtext.llm import lm_scoring as L

    v = L.Vocabulary.build([L.END, *(f"w{i}".encode() for i in range(30))], per_class=8, tail_classes=5)
    r = np.random.default_rng(6)
    for size in (0.5, 200):
        net = L.Network(v, 6)
        net.p = {k: r.normal(0, size, a.shape).astype(np.float32) for k, a in net.p.items()}
        h, target = r.uniform(-1, 1, (500, 6)).astype(np.float32), r.choice([*range(10), *range(24, 37)], 500)  # none in the third class
        cls = np.where(target < 32, target // 8, target - 32 + 4)
        log = lambda x: x - x.max(1, keepdims=True) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True))
        p = {k: a.astype(float) for k, a in net.p.items()}
        want = log(h @ p["wc"] + p["bc"])[np.arange(500), cls]
        for i in np.flatnonzero(target < 32):
            want[i] += log((h[i] @ p["ww"][cls[i]] + p["bw"][cls[i]])[None])[0, target[i] % 8]
        results = []
        for block in (4096, 7):
            monkeypatch.setattr(L, "BLOCK", block)
            grads = {k: np.zeros_like(a) for k, a in net.p.items()}
            out, ds = net.loss(h, target, grads)
            assert np.allclose(out, want, rtol=1e-4, atol=1e-4)
            assert np.allclose(out, net.loss(h, target)[0])
            results.append([ds, *grads.values()])
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-5 * size) for a, b in zip(*results))
