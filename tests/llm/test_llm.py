"""The training-data operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontam, html, knn, langid, licenses, mixing, neardup, quality, sharding, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, wordless, long and repeated rows, and a clashing column."""
    long = words(random.Random(1), 20_000)
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, "?!", None, None), (3, "one two", "en", "a"), (4, long, "en", "a"), (5, long, "fr", "b"), (5, long, "fr", "b"), (6, "x" * 50_000, "en", "b")]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(-1) for c in ("score", "size", "n_hit", "class_id", "position")})


def test_warc_round_trip(spark):
    big = "ä<p>" * 100_000
    rows = [(1, "http://a", big), (2, None, big), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive(pages)
    chunks = warc.read_chunks(index).collect()
    for i, t in {2: big, 3: "", 4: "small"}.items():
        own = sorted((c for c in chunks if c.record_id == i), key=lambda c: c.chunk_no)
        assert b"".join(bytes(c.data) for c in own) == t.encode() and own[-1].running_sha1 == hashlib.sha1(t.encode()).hexdigest()
    last = {c.record_id: c for c in chunks if c["last"]}
    assert (last[1].record_type, last[1].refers_to, last[1].total_bytes) == ("revisit", 2, len(big.encode()))
    assert last[4].record_type == last[5].record_type == last[None].record_type == "response"
    assert warc.read_chunks(warc.archive(pages.limit(0))).count() == 0


def test_licenses(spark, odd):
    text = f"{words(random.Random(2), 300)} Released under the MIT License. {words(random.Random(3), 300)} {licenses.TEMPLATES['bsd-grant']}."
    got = licenses.scan(spark.createDataFrame([(1, text, "", "")], DOCS)).first()
    assert got.licenses == ["bsd-grant", "mit-notice"]
    assert text[got.matches[0].start : got.matches[0].end] == "Released under the MIT License"
    assert licenses.scan(odd).where("size(licenses) > 0").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).round(2)
    v[100:160] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0, 2.0]), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in knn.top_k(df, df.where("vec_id % 50 = 0"), block_rows=64, query_rows=4, n_pivots=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.floor(v * 256).astype(int)
    for q in range(0, 400, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert knn.top_k(df.limit(0), df.limit(0)).count() == 0


def test_quality(spark, docs, odd):
    rng = random.Random(5)
    rows = [(i, words(rng, 40) if i % 2 else " ".join(["spam&&&"] * 40), "en", "a") for i in range(200)]
    some = spark.createDataFrame(rows, DOCS)
    labels = some.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(some, labels)
    got = quality.score(some, model).join(labels, "doc_id").where(quality.held_out("doc_id"))
    assert got.where("predicted != quality").count() == 0
    assert quality.score(odd, model).where("score between 0 and 1").count() == 8
    assert quality.score(odd, quality.fit(odd.limit(0), labels.limit(0))).count() == 8


def test_language(spark, docs, odd):
    found = langid.identify(docs, langid.fit(docs)).where(quality.held_out("doc_id") & F.col("lang").isNotNull())
    assert found.where("lang_pred = lang").count() >= 0.9 * found.count()
    assert langid.identify(odd, langid.fit(odd)).where("lang_pred = 'und'").count() == 3
    assert langid.identify(odd, langid.fit(odd.limit(0))).where("lang_pred = 'und'").count() == 8


def test_codewords():
    code = langid.codewords(4)
    assert code.shape == (4, 7) and min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) == 4


def test_main_text(spark):
    page = lambda i: f"<html><head><title>t</title><script>a<b</script></head><body><nav><a>menu</a></nav><div>Follow us today</div><article><h1>Head {i}</h1><p>One &amp; <b>two</b><br>three {i}<p>four</article><div class='comments'>nice</div><footer>c</footer>"
    rows = [(i, "http://h.org/x", page(i)) for i in range(6)] + [(6, None, None), (7, "bad", "<p>a  b<!-- c"), (8, "http://h.org/y", "<html><body><div>Follow us today</div><div>own words</div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Head 2\nOne & two three 2\nfour" and got[6] == "" and got[7] == "a b" and got[8] == "own words"


def test_decontamination(spark, odd):
    rng = random.Random(7)
    items = [(i, words(rng, n)) for i, n in enumerate((0, 3, 10, 25))] + [(None, "?")]
    texts = [(1, f"{words(rng, 30)} {items[3][1][:90].upper()} x {items[1][1]}, tail"), (2, words(rng, 50)), (3, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 40):  # one automaton, and several
        got = decontam.decontaminate(d, b, automaton_bytes=size).select("doc_id", "n_words", "n_hit", F.size("item_ids"), decontam.items_digest(), "contaminated")
        assert sorted(map(tuple, got.collect())) == sorted(decontam.brute_force(texts, items))
    assert decontam.decontaminate(odd, b.limit(0)).where("contaminated").count() == 0


def test_sharding(spark, docs, odd):
    rows = sharding.shard_documents(docs).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert len(rows) == docs.count() and max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    hot = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("same")).otherwise(F.col("text")).alias("text"))
    assert max(sharding.shard_documents(hot).groupBy("shard").count().toPandas()["count"]) <= -(-docs.count() // 16)
    assert sharding.shard_documents(odd).count() == 8 and sharding.shard_documents(odd.limit(0)).count() == 0


def test_groups_that_fit_stay_whole_beside_a_hot_text(spark):
    texts = ["hot"] * 2000 + [f"middle {i // 150}" for i in range(600)] + [f"small {i // 4}" for i in range(1600)] + [f"own {i}" for i in range(1800)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert [t for t, s in shards.items() if len(s) > 1] == ["hot"]
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(375))


def test_near_duplicates(spark, odd):
    rng = random.Random(9)
    base = words(rng, 200).split()
    texts = [(i, words(rng, 120)) for i in range(30)]
    for i in range(30, 45):
        own = base[:]
        for _ in range(2):
            own[rng.randrange(200)] = "edited"
        texts.append((i, " ".join(own)))
    texts += [(50, texts[0][1]), (51, texts[1][1].upper())]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    df = {}
    for _, t in texts:
        for h in set(neardup.shingles(t).tolist()):
            df[h] = df.get(h, 0) + 1
    w = neardup.Weights(len(texts), np.array(list(df), np.uint64), np.array(list(df.values())))
    sets, up = [w.of(t) for _, t in texts], {i: i for i, _ in texts}
    for _ in texts:
        for a, (i, _) in enumerate(texts):
            for b, (j, _) in enumerate(texts[:a]):
                if neardup.similarity(sets[a], sets[b]) >= neardup.SIMILARITY:
                    up[i] = up[j] = min(up[i], up[j])
    assert got == up
    assert sorted((r.doc_id or 0, r.class_id) for r in neardup.near_duplicates(odd).collect()) == [(0, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6)]
    assert neardup.deduplicated(odd).count() == 6 and neardup.near_duplicates(odd.limit(0)).count() == 0


def test_a_pair_that_shares_a_band_is_compared_exactly(spark):
    rng = random.Random(21)
    texts = [(i, words(rng, 20)) for i in range(400)]
    pairs = []
    while len(pairs) < 4:  # similar pairs that share a band, though few of their samples agree
        a = words(rng, 186).split()
        b = a[:]
        for k in range(3):
            b[20 + 45 * k] = "edited"
        a, b = " ".join(a), " ".join(b)
        both = np.intersect1d(neardup.shingles(a), neardup.shingles(b))
        w = neardup.Weights(408, both, np.full(len(both), 2))
        x, y = w.of(a), w.of(b)
        same = neardup.samples(*x) == neardup.samples(*y)
        if neardup.similarity(x, y) >= neardup.SIMILARITY and same.reshape(neardup.BANDS, neardup.ROWS).all(1).any() and same.mean() < 0.65:
            pairs.append((a, b))
    texts += [(1000 + 2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[1001 + 2 * i] for i in range(4)] == [1000, 1002, 1004, 1006]


def test_sketches_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(1, 1 << 63, 400, dtype=np.uint64))
    a = (h[:300], np.ones(300, np.float32))
    b = (h[50:], np.full(350, 1.5, np.float32))
    agree = [(neardup.samples(a[0] ^ np.uint64(k), a[1]) == neardup.samples(b[0] ^ np.uint64(k), b[1])).mean() for k in range(40)]
    assert abs(np.mean(agree) - neardup.similarity(a, b)) < 0.05


def test_mixing(spark, docs, odd):
    rows = mixing.mix(docs).collect()
    assert all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in rows)
    longest = max(r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= longest and own[0].target <= 2 * own[0].source_size + 1e-6
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3
    assert mixing.mix(odd).count() == 8 and mixing.mix(odd.limit(0)).count() == 0


def test_takes_follow_the_schedule(spark, docs):
    import corpus_pipeline

    rows = mixing.mix(docs).where("taken > 0").collect()
    assert all(len(r.positions) * r.size == r.taken and r.positions[0] == r.position for r in rows)
    names = sorted({r.source for r in mixing.mix(docs).select("source").collect()}, key=lambda s: (s is None, s))
    laid = [r.doc_id for r in corpus_pipeline.mix(spark, docs, SF).collect()]
    twice = 0
    for n, s in enumerate(names):
        own, a = [r for r in rows if r.source == s], (-0.5, 0.0, 0.5)[n % 3]
        longest = max(r.size for r in own)
        for t in (0.1, 0.25, 0.5, 0.75, 0.9):
            words = sum(r.size for r in own for p in r.positions if p < t * 1e6)
            assert abs(words - own[0].target * ((1 - a) * t + a * t * t)) <= longest + 1
        ids = {r.doc_id for r in own}
        lie = [i for i in laid if i in ids]
        assert len(lie) == sum(len(r.positions) for r in own)
        repeats = [i for i, x in enumerate(lie) if x in lie[:i]]
        twice += len(repeats)
        assert not repeats or repeats[0] == len(ids)
    assert twice


def test_pipeline_stages_equal_brute_force(spark, docs):
    """Every stage on its own input: each against a plain version of it; extra columns named like results stay as they came."""
    import corpus_pipeline

    clash = ("score", "size", "n_words", "position", "spans", "class_id")
    now = docs.withColumns({c: F.lit(-7) for c in clash})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        own = now.select("doc_id", "text", "source").collect()
        out = stage(spark, now, SF)
        if name == "sharding":
            rows = out.collect()
            counts = [sum(r["shard"] == s for r in rows) for s in range(16)]
            assert max(counts) - min(counts) <= 1
            assert [(r["shard"], r.slot) for r in rows] == [(s, i) for s in range(16) for i in range(counts[s])]
            assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in own)
            # Every take keeps its place behind those that come before it in its shard.
            files = sorted({f.rsplit("/", 1)[1]: f for f in now.inputFiles()}.items())
            laid = [r.doc_id for _, f in files for r in spark.read.parquet(f).collect()]
            at = {}
            for i, d in enumerate(laid):
                at.setdefault(d, []).append(i)
            for s in range(16):
                last = -1
                for d in (r.doc_id for r in rows if r["shard"] == s):
                    last = next(i for i in at[d] if i > last)
            break
        assert out.columns == now.columns
        now = corpus_pipeline.materialize(out)
        got = now.collect()
        assert all(r[c] == -7 for r in got for c in clash)
        kept = sorted(r.doc_id for r in got)
        if name == "quality":
            values, bias = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = []
            for r in own:
                ids, n = quality.ids_counts(r.text)
                if 1 / (1 + np.exp(-(float((values[ids] * (n / max(1, n.sum()))).sum()) + bias))) >= 0.7:
                    want.append(r.doc_id)
        elif name == "near-duplicates":
            df = {}
            for r in own:
                for h in set(neardup.shingles(r.text).tolist()):
                    df[h] = df.get(h, 0) + 1
            w = neardup.Weights(len(own), np.array(list(df), np.uint64), np.array(list(df.values())))
            sets, up = [w.of(r.text) for r in own], list(range(len(own)))
            for i in range(len(own)):
                for j in range(i):
                    if own[i].text == own[j].text or neardup.similarity(sets[i], sets[j]) >= neardup.SIMILARITY:
                        a, b = up[i], up[j]
                        up = [b if x == a else x for x in up]
            want = [min(own[i].doc_id for i in range(len(own)) if up[i] == c) for c in set(up)]
        elif name == "decontamination":
            want = [r[0] for r in decontam.brute_force([(r.doc_id, r.text) for r in own], items) if not r[5]]
        else:
            want = [r.doc_id for r in mixing.mix(spark.createDataFrame(own)).collect() for _ in r.positions or ()]
        assert kept == sorted(want), name


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline

    for now in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, now, SF)
            assert name == "sharding" or out.columns == now.columns
            n = out.count()
            now = corpus_pipeline.materialize(out)
            assert now.count() == n


def test_kept_columns_may_clash(spark, docs):
    """Documents' columns named like an operator's own, and like the names it uses inside."""
    d = docs.withColumns({c: F.lit(3) for c in ("rid", "hub", "slot", "_file", "n")})
    assert {"rid", "hub", "n"} <= set(sharding.shard_documents(d, keep=["rid", "hub", "n", "slot"]).columns)
    got = mixing.mix(docs.withColumns({c: F.lit(3) for c in ("s", "b", "n", "target")}), keep=["doc_id", "text", "s", "b", "n"])
    assert got.where("s = 3 and b = 3 and n = 3").count() == docs.count()
    assert knn.top_k(spark.createDataFrame([(1, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "ids": F.lit(2)}), spark.createDataFrame([(50, [2.0])], "vec_id long, embedding array<double>")).count() == 1
    assert decontam.decontaminate(docs.limit(0), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_sharding_uses_all_links(spark):
    """Communities held together by second hubs only: propagation over all links cuts fewer than chance, and keeps sizes even."""
    rng = random.Random(31)
    n, size = 1600, 20
    links = []
    for i in range(n):
        c = i // size
        links += [(i, f"a{c:03}-{(i % size) // 4}"), (i, f"z{c:03}")] + ([(i, f"y{rng.randrange(n // 20)}")] if i % 5 == 0 else [])
    vertices = spark.createDataFrame([(i,) for i in range(n)], "rid long")
    got = {r.rid: r["shard"] for r in sharding.shard(vertices, spark.createDataFrame(links, "rid long, hub string"), rounds=12).collect()}
    counts = [list(got.values()).count(s) for s in range(16)]
    assert len(got) == n and max(counts) - min(counts) <= 1
    hubs = {}
    for i, h in links:
        hubs.setdefault(h, []).append(i)
    cut = {k: np.mean([got[a] != got[b] for h, x in hubs.items() if h[0] == k for a in x for b in x if a < b]) for k in "az"}
    assert cut["a"] == 0 and cut["z"] < 0.6  # with first hubs alone 0.79


def test_document_frequencies_are_exact(spark, monkeypatch):
    """The shingles of at least one of CLIP documents, with their exact frequencies, however the rows lie."""
    rng = random.Random(41)
    common = [words(rng, 5) for _ in range(40)]
    texts = [" ".join([words(rng, 12), *rng.sample(common, rng.randrange(4))]) for _ in range(3000)]
    df = {}
    for t in texts:
        for h in set(neardup.shingles(t).tolist()):
            df[h] = df.get(h, 0) + 1
    monkeypatch.setattr(neardup, "CLIP", 100)
    monkeypatch.setattr(neardup.Tally, "STEP", 400)
    for parts in (1, 7):
        w = neardup.common_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        want = {h: n for h, n in df.items() if n * 100 > 3000}
        assert len(want) >= 40 and w.keys.tolist() == sorted(want)
        assert np.allclose(w.idf, [np.log1p(3000 / want[h]) / np.log1p(100) for h in sorted(want)])
    t, true = neardup.Tally(), {}
    for text in texts:
        h = np.unique(neardup.shingles(text))
        t.add(h)
        for x in h.tolist():
            true[x] = true.get(x, 0) + 1
    t.finish()
    held = dict(zip(t.h.tolist(), t.n.tolist(), strict=True))
    assert all(0 <= n - held.get(x, 0) <= 2 * 3000 // t.STEP for x, n in true.items()) and len(held) < len(true) / 10


def test_quality_on_the_tables(spark):
    """Held-out accuracy on the tables, and scores that come from whole texts."""
    folder = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(d, labels)
    got = quality.score(d, model, keep=["doc_id"]).join(labels, "doc_id").where(quality.held_out("doc_id"))
    assert got.count() > 60 and got.where("predicted = quality").count() >= 0.95 * got.count()
    text = words(random.Random(3), 400_000)  # over two pieces
    values, bias = model
    ids, n = quality.ids_counts(text)
    z = float((values[ids] * (n / n.sum())).sum()) + bias
    one = quality.score(spark.createDataFrame([(text,)], "text string"), model).first()
    assert abs(one.score - 1 / (1 + np.exp(-z))) < 1e-6


def test_pieces_lose_no_ngram(monkeypatch):
    from lectern.llm import tokens

    data = words(random.Random(8), 500).encode() + b" same same " + b"y" * 700
    whole = tokens.counts(data, 2, 4, 12, True)
    monkeypatch.setattr(tokens, "PIECE", 64)
    assert all(np.array_equal(x, y) for x, y in zip(whole, tokens.counts(data, 2, 4, 12, True), strict=True))


def test_language_needs_a_letter(spark, docs):
    rows = spark.createDataFrame([(1, "½ ² ③ 12"), (2, "é")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(rows, langid.fit(docs)).orderBy("doc_id").collect()] == [True, False]


def article(i, rng, extra=""):
    return f"<h1>Title {words(rng, 3)}</h1>" + "".join(f"<p>{words(rng, 30)} {i}</p>" for _ in range(rng.randrange(2, 6))) + extra


def test_templates_equal_brute_force(spark):
    """Explicit occurrence vectors and classes, against the exclusive-or of hashes."""
    rng = random.Random(51)
    rows = []
    for h in range(4):
        for i in range(7 if h else 2):
            menu = "".join(f"<div class=x7><a href=/{k}>{k} of host {h}</a></div>" for k in ("news", "sport", "people"))
            ad = f"<div class='ad'>{words(rng, 6)}</div>" if rng.random() < 0.6 else ""
            tail = "<p>Write to us</p><p>Call us</p>" if i % 2 == 0 else ""
            rows.append((len(rows), f"http://h{h}.org/{i}", f"<html><body><div class=k1>{menu}</div>{ad}<div class=q>{article(i, rng, tail)}</div><ul class=z{i}><li><a>{words(rng, 2)}</a></ul><div>bottom {h}</div>"))
    rows += [(100 + r[0], r[1], r[2]) for r in rows[:9]]  # copies count once
    got = {(r.host, r.token): r.kind for r in html.templates(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect()}
    want, hosts = {}, {}
    for _, u, x in rows:
        p = html.Profile(list(html.walk(x)))
        hosts.setdefault(html.host_of(u), {})[p.ident] = p
    for h, pages in hosts.items():
        ids = sorted(pages)
        elements = {k for p in pages.values() for k in p.elements}
        texts = {k: v[1:] for p in pages.values() for k, v in p.texts.items()}
        vector = {k: tuple(pages[i].elements.get(k, [0])[0] for i in ids) for k in elements} | {k: tuple(pages[i].texts.get(k, [0])[0] for i in ids) for k in texts}
        on = {k: sum(map(bool, v)) for k, v in vector.items()}
        for k, (up, inside) in texts.items():
            own = [x for x, (u, _) in texts.items() if vector[x] == vector[k] and vector[u] == vector[up]]
            tags = 2 * (vector[up] == vector[k] or not inside and vector[0] == vector[k])
            if on[k] >= max(3, 0.5 * len(ids)) and len(own) + tags >= 2:
                want[h, k] = html.TEXT
        for k in elements - {0}:
            if on[k] < 3:
                continue
            bits = max(p.elements[k][2] for p in pages.values() if k in p.elements)
            chars, links, art = (sum(p.elements[k][j] for p in pages.values() if k in p.elements) for j in (3, 4, 5))
            every = sum(p.elements[0][3] for p in pages.values())
            most = chars * 2 > every
            out = not art and not most and (bits & (html.SEMANTIC | html.MARKED) or links and links >= html.MENU * chars)
            if out or bits & (html.SEMANTIC | html.MARKED | html.LIST):
                want[h, k] = html.OUT if out else html.KEPT
    assert got == want and {html.TEXT, html.OUT} <= set(got.values()) and not any(h == "h0.org" for h, _ in got)


def test_slots_decide_what_names_do_not_tell(spark):
    """Same-host pages whose menus, adverts and footers carry no telling names; and article text that names must not cost."""
    rng = random.Random(52)
    rows, want = [], {}
    for i in range(6):
        body = [f"Title {words(rng, 3)}", *(f"{words(rng, 30)} {i}" for _ in range(3 + i % 3))]
        menu = "".join(f"<div class=x7><a href=/{k}>{words(rng, 1) if k == 2 else 'Entry ' + str(k)}</a></div>" for k in range(5))
        main = f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:])
        rows.append((i, f"http://a.org/{i}", f"<html><head><title>t</title></head><body><div class=k1>{menu}</div><div class=q><p>{'All rights are with the publisher of this page. ' * 20}</p>{main}</div><div>The same last words</div>"))
        want[i] = "\n".join(body)
    keep = {
        10: ("<article><p title='the hidden cost'>a</p><p aria-hidden=false>b</p><p data-id=ad>c</p><section class='share prices'>d</section><section class=legal-history>e</section></article>", "a\nb\nc\nd\ne"),
        11: ("<body><p>see <a>a long reference to a page</a></p><p>other words</p>", "see a long reference to a page\nother words"),
        12: ("<article><p>x <math><mi>y</mi></math> <object>z</object> <noscript>w</noscript></article>", "x y z w"),
        13: ("<article class='post comments-open'><p>one</p></article>", "one"),
        14: ("<div class='content no-sidebar'><p>two</p></div>", "two"),
        15: ("<div id=related-work><p>three</p></div>", "three"),
        16: ("<div class=widget><p>all text of the page</p></div><div class=ad>buy</div>", "all text of the page"),
        17: ("<form><div><article><p>four</article></div></form><div class=comments>nice</div>", "four"),
        18: ("<article><p>five</p><div class='user-comments'>nice</div><footer>by me</footer></article><aside><article>six</article></aside>", "five"),
    }
    rows += [(k, "http://b.org/" if k % 2 else None, x) for k, (x, _) in keep.items()]
    want |= {k: t for k, (_, t) in keep.items()}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    for size in (500_000, 0):  # templates broadcast, and joined
        got = {r.page_id: r.text for r in html.extract(pages, broadcast_tokens=size).collect()}
        assert got == want
    odd = spark.createDataFrame([(1, "http://a.org", "<p>" + "x " * 300_000), (2, None, ""), (2, None, "")], pages.select("page_id", "url", "html").schema)
    assert sorted(r.n_chars for r in html.extract(odd).collect()) == [0, 0, 599_999] and html.extract(odd.limit(0)).count() == 0


def test_top_k_with_repeated_rows_and_several_parts_of_queries(spark):
    """Repeated rows count as often as in the SQL; blocks are repeated for the parts of the queries that visit them, and for nothing else."""
    import duckdb

    from lectern.llm import queries

    rng = np.random.default_rng(13)
    v = rng.normal(size=(300, 6)).round(1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1, v[1].tolist()), (7, v[7].tolist()), (7, v[8].tolist()), (50, v[50].tolist()), (100, v[3].tolist())] + [(i, v[9].tolist()) for i in range(300, 340)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    embeddings = df.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(queries.OP3_SQL).fetchall())
    for rows_of in (2, 1000):
        got = knn.top_k(df, df.where("vec_id % 50 = 0"), block_rows=40, query_rows=rows_of, n_pivots=4, pivot_sample=100)
        assert sorted(map(tuple, got.select("query_id", "vec_id", "rank", "score").collect())) == sorted((q, x, r, s) for q, r, x, s in want)


def test_warc_clashing_columns_and_shuffled_heads(spark, monkeypatch):
    page = "p" * 2000
    rows = [(i, "u", page if i % 3 else f"{page}{i // 9}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "bytes", "record_id", "refers_to")})
    out = []
    for few in (1_000_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
        out.append(sorted((r.record_id, r.record_type, r.refers_to or -1, r.total_bytes) for r in warc.read_chunks(warc.archive(pages), only_last=True, span=500).collect()))
    head = {t: max(i for i, _, x in rows if x == t) for _, _, t in rows}
    assert out[0] == out[1] == [(i, "response" if head[t] == i else "revisit", -1 if head[t] == i else head[t], len(t)) for i, _, t in rows]


def test_licenses_equal_brute_force(spark, docs):
    """Every window of two blocks at every place against every template, by sets of shingles; edited notices too."""
    rng = random.Random(61)
    full = licenses.TEMPLATES["isc-license"].split()
    full[40] = "edited"
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, f"{words(rng, rng.randrange(50))} {t} {words(rng, rng.randrange(50))}") for i, t in enumerate([*licenses.TEMPLATES.values(), " ".join(full)])]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: (set(s.tolist()), len(s)) for k, t in licenses.TEMPLATES.items() for s in [neardup.shingles(t)]}
    for i, t in rows:
        h, found = neardup.shingles(t).tolist(), []
        for k, (own, n) in sets.items():
            span = 1 << licenses.level_of(n)
            near = [j for j, x in enumerate(h) if x in own]
            if any(len(own & set(h[w * span : (w + 2) * span])) >= licenses.CONTAINMENT * len(own) for w in {max(0, j // span - d) for j in near for d in (0, 1)}):
                found.append(k)
        assert got[i] == sorted(found)
    assert "isc-license" in got[10_000 + len(licenses.TEMPLATES)]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_operator_on_empty_tables_and_clashing_columns(spark):
    """Rows come out as without the clashing columns, and empty tables give empty results of the same columns."""
    pages = spark.createDataFrame([(1, "http://a.b/1", "<p>one two</p>"), (2, None, None), (2, None, None), (3, "http://a.b/2", ""), (4, "http://a.b/3", "<article><p>" + "long text " * 30_000 + "</p></article>")], "page_id long, url string, html string")
    texts = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "x " * 50_000), (1, "one two three")], "doc_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (50, [2.0, None]), (50, [0.5, 0.5]), (2, []), (3, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    tagged = texts.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id").isNull(), "fr"))
    model = langid.fit(tagged)
    scored = quality.fit(texts.where("doc_id in (1, 3)"), spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    items = spark.createDataFrame([("i", "two three")], "item_id string, text string")
    cases = [
        (pages, ("payload_bytes", "payload_digest", "refers_to", "_key", "head", "pos", "data"), lambda d: warc.archive(d)),
        (pages, ("text", "n_chars", "host", "token", "pages"), lambda d: html.extract(d, keep=["page_id", "url"])),
        (texts, ("licenses", "matches"), lambda d: licenses.scan(d, keep=["doc_id"])),
        (texts, ("lang_pred", "score", "ambiguous"), lambda d: langid.identify(d, model, keep=["doc_id"])),
        (texts, ("score", "predicted"), lambda d: quality.score(d, scored).select("doc_id", "score", "predicted")),
        (texts, ("n_words", "n_hit", "items", "contaminated"), lambda d: decontam.decontaminate(d, items).select("doc_id", "n_words", "n_hit", "contaminated")),
        (texts, ("class_id", "_t", "t", "root", "k"), lambda d: neardup.near_duplicates(d)),
        (vectors, ("rank", "score", "rep", "dim", "pivot"), lambda d: knn.top_k(d, d.where("vec_id % 50 = 0"))),
    ]
    for table, clashing, apply in cases:
        plain = apply(table)
        crowded = apply(table.withColumns({c: F.lit("!") for c in clashing}))
        names = [c for c in plain.columns if c not in ("file", "offset", "length", "archive", "position")]
        assert sorted(map(str, plain.select(names).collect())) == sorted(map(str, crowded.select(names).collect()))
        none = apply(table.limit(0))
        assert none.columns == plain.columns and none.collect() == []
