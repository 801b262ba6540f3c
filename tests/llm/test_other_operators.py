import numpy as np
import pytest

from . import data

VECS = "vec_id long, embedding array<float>, label int, k1 string, block int"


def vectors():
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 16))
    rows = []
    for i in range(200):
        v = base[i % 40] + r.normal(size=16) * (0.0 if i % 5 == 0 else 0.1 * (i % 4))
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [1.0] * 15 + [None], 1), (305, [float("inf")] * 16, 1)]
    rows += [(306, rows[0][1], None), (307, rows[0][1], 0), (307, rows[0][1], 0), (None, rows[3][1], 0), (308, [2 * x for x in rows[0][1]], 0), (309, rows[0][1][:8], 0)]
    return [(*x, "c", 1) for x in rows]


@pytest.mark.parametrize("options", [{}, {"chunk": 3, "blocks": 3, "cell_rows": 4}, {"blocks": 16, "width": 2.0}])
def test_embeddings(spark, options):
    from loomtext.llm.embedding_dedup import link_embeddings

    rows = vectors()
    out = link_embeddings(spark.createDataFrame(rows, VECS).repartition(3), **options).collect()

    def good(v, lab, i):
        return i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v) / np.linalg.norm(v) if good(v, lab, i) else None for i, v, lab, *_ in rows]
    linked = lambda a, b: unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    comps = data.components([x[0] for x in rows], linked)
    want = sorted((str(rows[a][0]), sum(a != b and linked(a, b) for b in range(len(rows))), str(comps[a]), comps[a] is not None and comps[a] == rows[a][0]) for a in range(len(rows)))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out) == want
    assert link_embeddings(spark.createDataFrame([], VECS)).count() == 0
    wide = [(i, [float(x) for x in np.random.default_rng(i % 2).normal(size=3000)], 1, "c", 1) for i in range(4)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in link_embeddings(spark.createDataFrame(wide, VECS)).collect()) == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)]
    with pytest.raises(TypeError):
        link_embeddings(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"))


def page(title, body, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">'
        f'<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div>{extra}{body}'
        '<div id="comments"><p>Nice post</p></div><form><label>Mail</label><input></form><footer>&copy; site</footer></body></html>'
    )


def test_html(spark):
    from loomtext.llm.html_extract import extract_main_text

    rows = [(1, None, None), (2, "http://h/x", ""), (3, "no url", "<p>plain"), (3, "no url", "<p>plain"), (None, "http://h/2", page("t", "<article><h1>T</h1><p>a &amp; b<p>c<br>d</article>"))]
    rows += [(10 + i, f"http://big.example/{i}", page(f"t{i}", f"<article><h1>T {i}</h1><p><b>Text\n {i}<br><p>More &eacute; {i}</p><aside>side</aside><div class='share'>Share</div></article>")) for i in range(60)]
    rows += [(100 + i, f"http://plain.example/{i}", page("t", f"<div class='post'><h1>Title {i}</h1><p>{data.prose(40, i)}</p><p>{data.prose(20, -i)}</p></div>", "<div class='sidebar'><p>About us</p></div>")) for i in range(12)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string").repartition(2)
    out = extract_main_text(df, broadcast_hosts=1)
    got = {}
    for r in out.collect():
        got.setdefault((r.page_id, r.url), []).append(r.text)
    assert got[(1, None)] == [""] and got[(2, "http://h/x")] == [""] and got[(3, "no url")] == ["plain", "plain"]
    assert got[(None, "http://h/2")] == ["T\na & b\nc d"]
    for i in range(60):
        assert got[(10 + i, f"http://big.example/{i}")] == [f"T {i}\nText {i}\nMore é {i}"]
    for i in range(12):
        assert got[(100 + i, f"http://plain.example/{i}")] == [f"Title {i}\n{data.prose(40, i)}\n{data.prose(20, -i)}"]
    assert extract_main_text(df.limit(0)).count() == 0


def test_html_common_text(spark):
    """Text that all articles of a host share stays in a named article; without one, fixed text is told over the
    whole host, whatever the size of the groups."""
    from loomtext.llm.html_extract import extract_main_text

    series = [(i, f"http://series.example/{i}", page("t", f"<article><h2>Summary</h2><p>{data.prose(9, i)}</p><p>By a reporter</p></article>")) for i in range(20)]
    lead = lambda i: "" if i in (3, 14) else "<p>In this series</p>"
    plain = [(100 + i, f"http://plain.example/{i}", page("t", f"<div class='post'>{lead(i)}<p>{data.prose(40, i)}</p><p>Fixed line</p></div>")) for i in range(20)]
    df = spark.createDataFrame(series + plain, "page_id long, url string, html string")
    for hosts in (5_000, 0):
        got = {r.page_id: r.text for r in extract_main_text(df, broadcast_hosts=hosts).collect()}
        for i in range(20):
            assert got[i] == f"Summary\n{data.prose(9, i)}\nBy a reporter"
            assert got[100 + i] == ("In this series\n" if lead(i) else "") + data.prose(40, i)


def test_html_slot_holds_varying_text(spark):
    """A long block that is the same on all pages and has no telling name is not the article."""
    from loomtext.llm.html_extract import extract_main_text

    terms = data.prose(300, "terms")
    rows = [(i, f"http://terms.example/{i}", page("t", f"<div class='upper'><p>{terms}</p></div><div class='lower'><p>{data.prose(40, i)}</p></div>")) for i in range(12)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: data.prose(40, i) for i in range(12)}


def unnamed(i):
    """A page without any telling name: menu, varying notice, text, box; every fourth page has one more box, and page
    5 next to no text."""
    menu = "<div><a href='/a'>One</a> <a href='/b'>Two</a></div>"
    notice = f"<div><p>{data.prose(8, f'n{i}')}</p></div>"
    text = f"<div><p>{data.prose(3 if i == 5 else 60, f't{i}')}</p><p>{data.prose(2 if i == 5 else 20, f'u{i}')}</p></div>"
    more = f"<div><p>{data.prose(5, f'm{i}')}</p></div>" if i % 4 == 0 else ""
    return f"<html><body>{menu}{notice}{text}<div><p>About this site</p></div>{more}</body></html>", f"{data.prose(3 if i == 5 else 60, f't{i}')}\n{data.prose(2 if i == 5 else 20, f'u{i}')}"


def test_html_template_decides(spark):
    """On a host without names the classes choose the slot, also where a page alone would mislead; without the
    template, or on a host of few pages, the same pages come out otherwise."""
    from loomtext.llm import html_extract as H

    pages = [unnamed(i) for i in range(16)]
    rows = [(2**53 + 1 + i, f"http://unnamed.example/{i}", p) for i, (p, _) in enumerate(pages)]
    rows += [(None, "http://unnamed.example/x", None), (7, None, pages[0][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    assert {k: got[k] for k in got if k and k > 7} == {2**53 + 1 + i: want for i, (_, want) in enumerate(pages)}  # ids stay whole next to a null
    assert got[None] == "" and pages[0][1] in got[7]
    assert H.main_text(pages[5][0]) != pages[5][1]
    kept = [H._read(r.template) for r in H.host_templates(df.select(H.F.lit("h").alias("host"), "html").where("html is not null"), 8, 0.1).collect()]
    one = H.path_key
    assert len(kept) == 1
    frame = next(i for i, c in enumerate(kept[0].classes) if one("#/html/body") in c)
    assert {one(f"#/html/body/div{x}") for x in ("", "~2", "~3", "~4")} <= set(kept[0].classes[frame])
    optional = next(i for i, c in enumerate(kept[0].classes) if one("#/html/body/div~5") in c)
    again = next(i for i, c in enumerate(kept[0].classes) if one("#/html/body/div~3/p") in c)
    assert optional != frame != again and kept[0].nests[optional] == kept[0].nests[again] == frame
    assert one("#/html/body/div~3/p") in kept[0].repeated
    assert max(kept[0].mass, key=lambda k: kept[0].mass[k] if k not in map(one, ("#/html", "#/html/body")) else -1) == one("#/html/body/div~3")
    assert H.block_key("#/html/body/div/p", "About this site") in kept[0].fixed


def test_html_optional_part_is_no_article(spark):
    """A box that some pages of a host have, longer than their text, is not the article; where some pages have another
    layout, that layout's text is."""
    from loomtext.llm import html_extract as H

    notice = lambda i: f"<div><p>{data.prose(6, f'n{i}')}</p></div>"
    text, box = lambda i: data.prose(60, f"t{i}"), lambda i: data.prose(100, f"b{i}")
    boxed = [(i, "http://boxed.example/", f"<body>{notice(i)}<div><p>{text(i)}</p></div>" + (f"<div><p>{box(i)}</p></div>" if i % 4 == 0 else "")) for i in range(16)]
    two = [(100 + i, "http://two.example/", f"<body>{notice(i)}" + (f"<section><p>{text(i)}</p></section>" if i % 4 else f"<table><tr><td>{box(i)}</table>")) for i in range(16)]
    out = H.extract_main_text(spark.createDataFrame(boxed + two, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert got == {i: text(i) for i in range(16)} | {100 + i: text(i) if i % 4 else box(i) for i in range(16)}


def test_html_vectors_are_whole():
    """Sums of codes tell equal occurrence vectors from others, however the pages are dealt."""
    from loomtext.llm import html_extract as H

    r = np.random.default_rng(4)
    codes = [H._codes(f"page {i}")[1:] for i in range(60)]
    vectors = [tuple(int(x) for x in r.integers(0, 3, 60)) for _ in range(300)]
    sums = [tuple(sum(n * c[k] for n, c in zip(v, codes)) for k in (0, 1)) for v in vectors]
    assert len(set(sums)) == len(set(vectors))
    order = [["a", "b", "c"], ["a", "c", "b"]]
    t = H.deduce(9, [(k, 5, 5, 9, 1, 90, "#") for k in "abc"] + [("d", 7, 7, 9, 2, 45, "a")], [("x", 45, "d")], order)
    assert sorted(t.classes) == [["a", "b"], ["d"]] and t.nests[t.classes.index(["d"])] == t.classes.index(["a", "b"])
    assert t.mass == {"a": 5.0, "b": 10.0, "d": 0.0} and t.repeated == {"d"}


def test_html_long_and_deep(spark):
    from loomtext.llm.html_extract import extract_main_text

    long = "<article>" + "".join(f"<p>{data.prose(50, i)}</p>" for i in range(2000)) + "</article>"
    deep = "<div>" * 3000 + "down" + "</div>" * 3000
    df = spark.createDataFrame([(1, "http://a/1", long), (2, "http://a/2", deep)], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got == {1: "\n".join(data.prose(50, i) for i in range(2000)), 2: "down"}


def test_components(spark):
    from loomtext.llm.common import connected_components

    r = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(50)] + [(1000, int(k)) for k in r.integers(1001, 1200, 150)] + [(7, 7), (2000, 2001), (2001, 2000), (-5, 3000)]
    got = {x.id: x.component for x in connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = data.frame(spark, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2)) for i in range(8, 24)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, data.prose(60, 18))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    ids = {r[0] for r in now.select("doc_id").collect()}
    assert {4, 18, 23} <= ids and not {9, 10, 22} & ids  # copies go, single texts stay
    first = corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "run")).where("doc_tokens > 0")
    assert first.count() > 0
    kept = {r[0] for r in spark.read.parquet(str(tmp_path / "run" / "quality")).select("doc_id").collect()}
    assert kept <= {r[0] for r in docs.select("doc_id").collect()} and kept
    again = corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "run")).where("doc_tokens > 0")  # from what is there
    assert sorted(map(tuple, first.select("doc_id", "start", "ids_crc32").collect()), key=str) == sorted(map(tuple, again.select("doc_id", "start", "ids_crc32").collect()), key=str)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    """Every stage's decision against brute force, with a classifier that keeps all."""
    import corpus_pipeline

    rows = data.rows()
    bench = data.prose(60, 18)
    docs = spark.createDataFrame(rows, data.DOCS).repartition(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(8, 1), (18, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "run"))
    read = lambda name: [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "run" / name)).collect()]
    assert len(read("quality")) == len(rows)
    sets = [data.shingle_set(t) for _, t, *_ in rows]
    comps = data.components([i for i, *_ in rows], lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    near = read("near_duplicates")
    assert sorted(i for i, t in near if i is not None and data.space_words(t)) == sorted({c for c, s in zip(comps, sets) if c is not None and s})
    assert sum(i is None for i, _ in near) == 2
    texts = [t for _, t in near]
    want = sorted(str((i, [x for x, g in zip(w, gone) if not g])) for (i, t), (w, gone) in zip(near, data.repeated(texts, 35)) if not w or not all(gone))
    subs = read("substrings")
    assert sorted(str((i, data.space_words(t))) for i, t in subs) == want
    left = read("benchmarks")
    assert all(bench not in (t or "") for _, t in left) and len(left) < len(subs)
    assert sorted(str(x) for x in left) == sorted(str((i, t)) for i, t in subs if bench not in (t or ""))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _ in left}


def test_embeddings_in_waves(spark, monkeypatch):
    """However many chunk pairs a label has, no step moves much more than its vectors; links are the same with a grid,
    without one, and in many waves."""
    from loomtext.llm import embedding_dedup as E

    r = np.random.default_rng(8)
    x = r.normal(size=(1000, 32))
    x[500:] = x[:500] + r.normal(size=(500, 32)) * np.linspace(0.0, 0.3, 500)[:, None]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(e) for e in v], 1, "c", 1) for i, v in enumerate(x)], VECS)
    one = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = one @ one.T >= 0.98
    np.fill_diagonal(near, False)
    want = {i: int(n) for i, n in enumerate(near.sum(1))}
    moved, kept = [], E.grouped

    def counted(rows, *args):
        moved.append(rows.count())
        return kept(rows, *args)

    monkeypatch.setattr(E, "grouped", counted)
    for options in ({"chunk": 100, "wave_rows": 1}, {"cell_rows": 100}, {"cell_rows": 100, "pays": 1e9, "chunk": 300, "wave_rows": 2500}):
        moved.clear()
        assert {v.vec_id: v.n_links for v in E.link_embeddings(df, **options).collect()} == want
        if "wave_rows" in options:
            assert len(moved) > 1 and max(moved) <= 2 * max(1000, options["wave_rows"])
    assert len(moved) * 2500 < sum(moved) + 2500
    dense = [c + r.normal(size=32) * 0.001 for c in r.normal(size=(20, 32)) for _ in range(40)]
    assert E.paying_grid(dense, 4, 0.0001, 5, 4.0, 0.5) > 0 and E.paying_grid(list(x), 4, 0.04, 5, 4.0, 0.5) == 0
