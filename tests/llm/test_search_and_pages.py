"""Page extraction, ranked search and hard negatives against brute force; clashing names, equal rows and short spans in the others."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import base, extraction, host_rules, langid, minhash, mixing, negatives, ranking, sharding, substrings, vectors

NAMES = ["text", "n_chars", "_row", "_key", "_k", "_h1", "_host", "_place", "_t", "_hits", "_n", "rank", "score", "anchor", "leaf", "cell", "kept", "in0_", "_draw", "_copies"]


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "stone", "river", "a", "in", "mill", "road"]) for _ in range(n)).capitalize() + "."


def page(rng, i):
    """A page and its main text: headings, long and short paragraphs, a list, a quote, among what stands around."""
    paragraphs = [sentence(rng, rng.randrange(3, 90)) for _ in range(rng.randrange(2, 9))]
    paragraphs[0] = sentence(rng, 60)
    body, want = [], [f"Title {i} & more"]
    for at, p in enumerate(paragraphs):
        body.append(rng.choice([f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"<blockquote><p>{p.replace(' ', chr(10) + '  ', 1)}</p></blockquote>"]))
        want.append(p)
        if at == 1:
            body.append('<div class="AdBanner"><p>Buy the best of the stones and the mills in the river.</p></div><aside><p>Seen elsewhere: the road.</p></aside>')
    article = f"<h1>Title {i} &amp; more</h1>{''.join(body)}"
    inner = rng.choice([f"<article>{article}</article>", f"<main><article class='post has-sidebar'>{article}</article></main>", f'<div id="content">{article}</div>'])
    around = '<header><p>Site of the year</p></header><nav><ul><li><a href="/a">The</a></li><li><a href="/b">of</a></li></ul></nav><div class="cookie-notice"><p>We use the cookies of the site to follow you in and out of it, and so do our partners.</p></div>'
    after = '<section id="comments"><article><p>The first of the comments, to say that the road is long and the mill is old.</p></article></section><form><p>Write to the editors of the site:</p><input></form><footer>&copy; the owners of the site</footer>'
    return f'<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var t="</p><p>not the text</p>";</script></head><body>{around}<!-- <p>gone</p> -->{inner}{after}' + rng.choice(["</body></html>", "", "<p"]), "\n".join(" ".join(w.split()) for w in want)


def test_main_text(spark):
    rng = random.Random(11)
    made = [page(rng, i) for i in range(60)]
    rows = [(i, f"u{i}", h, *["x"] * 3) for i, (h, _) in enumerate(made)]
    rows += [(100, "u", None, *"xyz"), (None, None, "", *"xyz"), (101, "u", "<p", *"xyz"), (102, "u", "<p>" + "the of a " * 30000, *"xyz"), rows[3], (103, "u", "<div>" * 3000 + "<p>" + sentence(rng, 70), *"xyz")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string, _row string")
    got = extraction.main_text(df)
    assert got.columns == ["page_id", "url", "_row", "text", "n_chars"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert [by[i][0] == want for i, (_, want) in enumerate(made)].count(False) == 0
    assert by[100] == [""] and by[None] == [""] and by[101] == [""] and len(by[102][0]) == 9 * 30000 - 1 and len(by[3]) == 2 and by[103][0]
    assert extraction.main_text(df.limit(0)).count() == 0


def brute_ranks(docs, items, k=20):
    term = re.compile(ranking.TERM)
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    counts = [(d, Counter(term.findall(low(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        asked = Counter(term.findall(low(text)))
        found = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * x * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in asked.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out.update((item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1))
    return out


@pytest.mark.parametrize("options", [{}, {"block_docs": 7}, {"block_points": 60}, {"max_vocabulary": 5}])
def test_ranked_search(spark, options):
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "?!\x00 \x7f"), (None, docs[3][1]), (503, docs[3][1]), (503, docs[3][1]), (504, "Été_naïve W1-w1 日本 W2"), (505, "w3 " * 5000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(25)] + [(90, "été Naïve w2 w2"), (91, None), (92, "nowhere"), (93, "W1"), (93, "W1"), (None, "w3 w3")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in ranking.ranked_search(d, q, **options).collect())
    assert got == brute_ranks(docs, items)
    assert ranking.ranked_search(d.limit(0), q).count() == 0 and ranking.ranked_search(d, q.limit(0)).count() == 0


def test_treap_holds_its_points():
    rng = np.random.default_rng(1)
    for bits, n in ((1, 3), (4, 40), (7, 900), (6, 1)):
        at = rng.choice((1 << bits) ** 2, n, replace=False)
        row, col, value = at >> bits, at & ((1 << bits) - 1), rng.integers(1, 9, n)
        tree = ranking.Treap.load(ranking.Treap.build(row, col, value, bits))
        assert Counter(zip(row, col, value)) == Counter(zip(tree.row, tree.col, tree.value))


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 12, "cell": 10, "queries": 4, "degree": 4}])
def test_hard_negatives(spark, options):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(400):
        v = centres[i % 6] + rng.normal(size=8) * 0.3
        rows.append((i, [float(x) for x in v / np.sqrt((v * v).sum())], i % 5))
    rows += [(1000 + i, rows[40][1], 0 if i % 2 else 3) for i in range(60)]  # copies under two labels
    rows += [(2000, None, 1), (2100, [None] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, rows[3][1], None), (None, rows[3][1], 2), (2400, [0.0] * 8, 2), (2500, [], 1), (2600, [1.0, 2.0], 1), (2601, [2.0, 2.0], 1), (2602, [1.0, 1.9], 0), rows[100], rows[100], (2700, [1e300] * 8, 4), (2701, [1e299] * 8, 4), (2702, [1e300] * 7 + [9e299], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, row string, score string").repartition(3)
    got = Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect())
    use = [(k, [math.floor(256 * x) for x in v], c) for k, v, c in rows if k is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    held = lambda s: max(-negatives.LONG, min(negatives.LONG, s))
    want = Counter()
    for a, (k, v, c) in enumerate(use):
        if k % 100:
            continue
        scores = sorted((-held(sum(x * y for x, y in zip(v, w))), k2, i, c2) for i, (k2, w, c2) in enumerate(use) if i != a and len(w) == len(v))
        for ps, pk, _, _ in [s for s in scores if s[3] == c][:5]:
            fits = [s for s in scores if s[3] != c and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            want.update((k, pk, rank, nk, -ps, -ns) for rank, (ns, nk, _, _) in enumerate(fits, 1))
    assert got == want
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_clashing_names(spark):
    """Columns named like inner ones come back, those named like added ones are replaced."""
    docs = spark.createDataFrame([(i, f"word{i % 4} and some more of it. Another one. And a third." * 3, "s", "en") for i in range(12)], "doc_id long, text string, source string, lang string")
    named = docs.withColumns({c: F.lit(f"own {c}") for c in NAMES if c != "text"})
    vecs = spark.createDataFrame([(i, [float(i % 3), 1.0], 1) for i in range(9)], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(f"own {c}") for c in NAMES})
    made = {
        "op1": host_rules.host_quality(named), "op2": sharding.shuffle_into_shards(named), "op5": minhash.near_duplicates(named), "op6": substrings.remove_repeated_spans(named),
        "op8": vectors.near_duplicate_vectors(vecs), "op9": mixing.mixed_documents(named), "op10": langid.identify(named),
    }
    added = {"op1": {"kept"}, "op5": {"kept"}, "op8": {"kept"}, "op10": {"score"}}
    for name, df in made.items():
        rows = df.collect()
        own = [c for c in NAMES if c in df.columns and c not in added.get(name, ()) and c != "text"]
        assert len(rows) >= 9 and set(NAMES) - set(own) - added.get(name, set()) <= {"text"}, name
        assert all(r[c] == f"own {c}" for r in rows for c in own), name


def test_equal_rows_in_a_mix(spark):
    """Ten equal rows of which the budget takes three."""
    df = spark.createDataFrame([(1, "a b c", "s")] * 10 + [(2, "x y " * 40, "t")], "doc_id long, text string, source string")
    took = {r["_source"]: r.t for r in mixing.mix_sources(df, share=0.1).groupBy("_source").agg(F.sum("taken").alias("t")).collect()}
    made = {r.source: r["count"] for r in mixing.mixed_documents(df, share=0.1).groupBy("source").count().collect()}
    assert took["s"] == 8 and made["s"] in (2, 3)
    twice = mixing.mixed_documents(df, share=1.5, weights=(1,)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in twice}[1] == 20


def test_three_short_sentences(spark):
    df = spark.createDataFrame([(i, f"{t}\nOne. Two. Three.") for i, t in enumerate(["Alpha beta gamma.", "Delta.", "", "Eta theta iota kappa."])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.remove_repeated_spans(df).collect()}
    assert got[0].endswith("One. Two. Three.") and all("Two" not in got[i] for i in (1, 2, 3))
    assert all("Two" in r.text for r in substrings.remove_repeated_spans(df, least_words=4).collect())


def test_every_language_is_learned(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('wort ', cast(id as string), ' und so') as text", "concat('l', cast(id % 1000 as string)) as lang")
    df = df.union(spark.range(4000, 9000).selectExpr("id", "concat('mot ', cast(id as string))", "'hot'"))
    _, names = langid.training_rows(df, "doc_id", "text", "lang", 4000, 500, 10)
    known = {r.lang for r in df.where(~base.is_held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(names) == known and len(known) > 950 and max(Counter(names).values()) <= 4
