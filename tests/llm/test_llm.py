"""Corpus operators against brute force on small tables, with nulls, ties, repeats, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import host_rules, langid, minhash, mixing, packing, quality, sharding, substrings, token_files, vectors
from pulsegrid.llm.base import is_held_out
from pulsegrid.llm.tokens import Encoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, shard string, kept string, score string"


def words(rng, n, base=400):
    return [f"w{rng.randrange(base)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))) + ".", "en", f"s{i % 3}") for i in range(120)]
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, " \n\t ", None, "s1"), (203, "one", "en", None), (204, rows[5][1], "en", "s1"), (204, rows[5][1], "en", "s1"), (None, rows[5][1], "en", "s2"), (None, "x y z", None, None), (205, "long " + " ".join(words(rng, 9000)), "en", "s0"), (206, "naïve 😀   tail Σίσυφος", "en", "s0")]
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_host_rules(spark, docs, none):
    out = host_rules.host_quality(docs)
    assert out.count() == docs.count() and host_rules.host_quality(none).count() == 0
    assert host_rules.text_features("a b c d e a b c d e\nx\nx\n#") == (13, 13, 1, 1, 10)
    assert host_rules.text_features(None) == (0, 0, 0, 0, 0)
    bad = spark.createDataFrame([(i, "short" if i < 190 or i % 10 else "w " + " ".join(f"q{j}" for j in range(20)), "bad" if i < 190 else "good") for i in range(200)] + [(i, " ".join(f"q{j}" for j in range(20)), "good") for i in range(200, 400)], "doc_id long, text string, source string")
    made = {r.source: r.kept for r in host_rules.host_quality(bad).where("not base_failed").collect()}
    assert made == {"good": True}
    hosts = host_rules.host_verdicts(host_rules.base_rules(bad)).collect()
    assert {h.host: h.host_rejected for h in hosts} == {"bad": True, "good": False}


def test_host_verdict_on_documents(spark, small):
    """On the given table no host differs from the others beyond chance; one that does is rejected, with its clean documents, and only it."""
    docs = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "source", "text")
    assert {r.host_rejected for r in host_rules.host_quality(docs).select("host_rejected").distinct().collect()} == {False}
    hit = (F.col("source") == "src3") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 100 < 60)
    for change in ("repeat('a b c d e ', 9)", "concat(text, repeat('\n# $ | % & *', 500))", "concat(text, '\n', repeat('same line\n', 5))"):
        worse = docs.withColumn("text", F.when(hit, F.expr(change)).otherwise(F.col("text")))
        out = host_rules.host_quality(worse)
        assert {r.source for r in out.where("host_rejected").select("source").distinct().collect()} == {"src3"}
        assert out.where("host_rejected and not base_failed and kept").count() == 0 and out.where("not host_rejected and not base_failed and not kept").count() == 0


def test_shards(spark, docs, none, tmp_path):
    def made(**options):
        return [(r.doc_id, r.text, r["shard"], r.slot) for r in sharding.shuffle_into_shards(docs, n_shards=7, bucket_bytes=2000, **options).collect()]

    out = made()
    assert Counter(x[:2] for x in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    sizes = Counter(x[2] for x in out)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    assert [x[2:] for x in out] == [(s, i) for s in range(7) for i in range(sizes[s])]  # partitions in order hold all shards in slot order
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert made() == out
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert made(seed=18) != out
    path = f"{tmp_path}/shards"
    sharding.write_shards(sharding.shuffle_into_shards(docs, n_shards=7, bucket_bytes=2000), path)
    for s, n in sizes.items():  # files in order of their names hold a shard in slot order
        files = sorted(p for p in (tmp_path / "shards" / f"shard={s}").iterdir() if p.suffix == ".parquet")
        assert [slot for p in files for slot in pq.read_table(p, partitioning=None)["slot"].to_pylist()] == list(range(n))
    back = sharding.sharded_files(docs, n_shards=7, bucket_bytes=2000)
    assert Counter((r.doc_id, r.text, r["shard"], r.slot) for r in back.collect()) == Counter(out) and sharding.sharded_files(none).count() == 0
    with_map = docs.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    assert sharding.shuffle_into_shards(with_map, n_shards=7).count() == len(out)


def test_token_files(docs, none):
    code = Encoder(tokenizer_path("word_bpe_49k.json"), "word")
    out = token_files.token_files(docs.select("doc_id", "text"), tokens_per_file=400).orderBy("start").collect()
    rows = docs.collect()
    want = Counter()
    for r in rows:
        ids = [*code.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]
    keys = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert keys == sorted(keys) and token_files.token_files(none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("file,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_equals_tokenizer(file, kind):
    code = Encoder(tokenizer_path(file), kind, keep=5)
    texts = ["It's  a test\n\nI'll\tgo 123 $$$!! ", "Éauoi ß ñ l'été 12a", " \n x", " odd  ", "é combining", "<|endoftext|> x", "", "İ Σας", "a\r\n b \x0b\x0c"]
    assert code.encode(texts) == [np.array(code.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("file,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_keeps_added_tokens(file, kind):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path(file))
    texts = ["a <|endoftext|> b", "a<|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext| > x", "no token 12"]
    texts += [f"x {t.content} y{t.content}" for t in fresh.get_added_tokens_decoder().values()]
    assert Encoder(tokenizer_path(file), kind).encode(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing(docs, none):
    code = Encoder(tokenizer_path("byte_bpe_50k.json"), "byte")
    out = packing.pack_documents(docs.select("doc_id", "text", "shard")).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in out) == sum(len(x) // 4 + 1 for x in code.encode([r.text for r in docs.collect()]))
    assert all(sum(p.length for p in ps) % key[1] == 0 for key, ps in by_doc.items())
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.tokens)) and len(r.tokens) == 4 * r.length for r in out)
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at == r.sequence_tokens
    assert packing.pack_documents(none.select("doc_id", "text")).count() == 0


def test_pack_fills_windows():
    rng = random.Random(3)
    lengths = [rng.choice([1, 3, 90, 300, 700, 1500, 5000]) for _ in range(300)]
    sequences = packing.pack(lengths)
    sums = [sum(p[2] for p in s) for s in sequences]
    assert sum(sums) == sum(lengths) and sum(n not in packing.TIERS for n in sums) <= 1
    covered = {}
    for s in sequences:
        for doc, start, n in s:
            covered.setdefault(doc, []).append((start, n))
    for doc, parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]


def mutated(rng, base, share):
    return [w if rng.random() > share else f"m{rng.randrange(10**6)}" for w in base]


@pytest.mark.parametrize("options", [{}, {"region": 6, "block": 8}])
def test_near_duplicates(spark, docs, none, options):
    rng = random.Random(5)
    bases = [words(rng, 60, 3000) for _ in range(4)]
    texts = [" ".join(mutated(rng, bases[0], rng.choice([0.0, 0.03, 0.07, 0.11]))) for _ in range(90)]
    texts += [" ".join(mutated(rng, b, 0.02)).upper().replace("W", "w") for b in bases[1:] for _ in range(5)] + [" ".join(words(rng, 40, 3000)) for _ in range(40)] + [None, "", "  ", "one", "ONE", "one one one"]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles string")
    got = minhash.near_duplicates(df, width=2, **options).collect()
    sets = []
    for t in texts:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else ({tuple(w)} if w else set()))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = joined(pairs, range(len(texts)))
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (want[i], len(sets[i]), want[i] == i) for i in want}
    if not options:
        out = minhash.near_duplicates(docs, width=5)
        assert out.count() == docs.count() and minhash.near_duplicates(none).count() == 0
        assert {r.component_id for r in out.where(F.col("doc_id") == 204).collect()} == {5}


@pytest.mark.parametrize("deep", [9, 14])
def test_near_duplicates_in_crowded_regions(spark, deep):
    """A template crowds the trees' first depth; every pair of near copies in it is found, whatever the next depth."""
    rng = random.Random(deep)
    template = words(rng, 100, 10**6)
    texts = []
    for i in range(150):
        own = words(rng, 26, 10**6)
        texts += [" ".join(template + own), " ".join(template + [f"m{i}" if j in (4, 12, 20) else w for j, w in enumerate(own)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, width=2, percent=90, trees=4, depths=(2, deep), region=8, loose=0.75).collect()}
    sets = [set(zip(w, w[1:])) for w in map(str.split, texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert (len(pairs), sum(got[i] == got[j] for i, j in pairs)) == (150, 150) and got == joined(pairs, range(len(texts)))


def test_deduplicated_judges_rows(spark):
    """Rows that share an id, or have none, go by their own texts."""
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(words(rng, 40, 10**6)) for _ in range(5))
    rows = [(3, a), (7, a), (7, b), (7, b), (None, c), (None, d), (None, d + " more"), (None, a), (9, e), (8, e + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.deduplicated(spark, df, "").collect()
    made = Counter((r.doc_id, r.text.removesuffix(" more")) for r in got)
    assert made == Counter([(3, a), (7, b), (None, c), (None, d), (8, e)])


def test_repeated_spans(spark, docs, none):
    rng = random.Random(6)
    passage = " ".join(" ".join(words(rng, 9)).capitalize() + "." for _ in range(7))
    own = [" ".join(" ".join(words(rng, 9)).capitalize() + "." for _ in range(4)) for _ in range(6)]
    df = spark.createDataFrame([(i, f"{t}\n{passage}\n{t[::-1]}", "z") for i, t in enumerate(own)], "doc_id long, text string, n_removed string")
    out = {r.doc_id: r for r in substrings.remove_repeated_spans(df).collect()}
    assert passage in out[0].text and out[0].n_removed == 0
    for i in range(1, 6):
        assert out[i].n_removed == 7 and "\n".join(x for x in out[i].text.split("\n") if x) == f"{own[i]}\n{own[i][::-1]}"
    made = substrings.remove_repeated_spans(docs)
    assert made.count() == docs.count() and substrings.remove_repeated_spans(none).count() == 0
    assert [r.text for r in made.where("doc_id = 200").collect()] == [None]


@pytest.mark.parametrize("options", [{}, {"list_rows": 12, "cell": 10, "queries": 16}])
def test_vectors(spark, options):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + rng.normal(size=16) * rng.choice([0.1, 0.3])).astype("float32").tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[3][1], 1) for i in range(20)]
    odd = [(300, None, 1), (301, [0.0] * 16, 1), (302, [None] + [1.0] * 15, 1), (303, [float("nan")] + [1.0] * 15, 1), (304, rows[3][1], None), (None, rows[3][1], 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "q") for r in rows + odd], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(df, **options).collect()}
    ok = rows + odd[6:]
    unit = {r[0]: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in ok}
    label = {r[0]: r[2] for r in ok}
    pairs = [(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    n, root = Counter(a for a, _ in pairs), joined(pairs, unit)
    assert {k: v for k, v in got.items() if k in unit} == {k: (n[k], root[k], root[k] == k) for k in unit}
    assert all(got[k] == (0, k, True) for k in (300, 301, 302, 303, 304)) and got[None] == (0, None, False)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_mixing(spark, docs, none):
    sizes = {"a": 1000, "b": 30, "c": 500, "d": 40, None: 7}
    made = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    total, weights = 1.5 * sum(sizes.values()), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    capped = set()
    while True:
        left = total - sum(2 * sizes[k] for k in capped)
        level = left / sum(w for k, w in weights.items() if k not in capped)
        over = {k for k in sizes if k not in capped and level * weights[k] > 2 * sizes[k]}
        if not over:
            break
        capped |= over
    for k in sizes:
        assert made[k] == pytest.approx(2 * sizes[k] if k in capped else level * weights[k])
    out = mixing.mix_sources(docs, rows_per_bucket=8).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in out)
    for s in {r["_source"] for r in out}:
        own = [r for r in out if r["_source"] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    assert sorted(map(str, mixing.mix_sources(docs, rows_per_bucket=8).collect())) == sorted(map(str, out))
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and mixing.mixed_documents(none).count() == 0 and mixing.mix_sources(none).count() == 0


def test_languages(spark, docs, none):
    rng = random.Random(9)
    sounds = {"aa": ["ka", "ko", "ri"], "bb": ["ter", "sch", "ung"], "cc": ["eau", "oui", "ent"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[c]) for _ in range(3)) for _ in range(12)), c, "x") for i in range(300) for c in [rng.choice(list(sounds))]]
    rows += [(900, None, "aa", "x"), (901, "123 !!", "aa", "x"), (902, "", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in langid.identify(df, per_class=60).collect()}
    assert sum(out[i].lang_pred == c for i, _, c, _ in rows[:300]) >= 297
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(docs).count() == docs.count() and langid.identify(none).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(10)
    rows = [(i, " ".join(w + ("***" if i % 3 == 0 else "") for w in words(rng, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(df, labels)
    out = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    assert sum(out[i].predicted == int(i % 3 != 0) for i in range(300)) >= 295 and all(0 <= r.score <= 1 for r in out.values())
    assert quality.score_quality(docs, model).count() == docs.count() and quality.score_quality(none, model).count() == 0
    assert quality.learn(df, labels.limit(0)).score(quality.indicators("")) == 0.5


def test_pipeline(spark, small):
    before = spark.read.parquet(f"{small}/documents.parquet")
    start = before.columns
    docs, sizes = before, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == start
        sizes.append(docs.count())
    n = before.count()
    assert n >= sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[0] >= 0.95 * n
    assert docs.agg(F.max("doc_id")).first()[0] <= before.agg(F.max("doc_id")).first()[0]
    packed = corpus_pipeline.packed(spark, docs, small)
    assert packed.where("offset + length > 2048").count() == 0 and packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_spans_against_brute_force(spark):
    """Every occurrence but the first of every span goes, counted over all texts in plain Python."""
    rng = random.Random(16)
    shared = [" ".join(words(rng, n)).capitalize() + "." for n in (9, 9, 9, 30, 30, 60, 44)]
    wide = "".join(rng.choice("的一是不了人我在有他这中大来上国") for _ in range(60)) + "。"
    menu = "\n".join(f"item{i}" for i in range(60))
    texts = []
    for i in range(40):
        parts = [" ".join(words(rng, rng.randrange(3, 14), 10**6)) + "." for _ in range(6)]
        for passage in rng.sample([" ".join(shared[:3]), " ".join(shared[3:5]), shared[5], shared[6], wide, menu], 3):
            parts.insert(rng.randrange(len(parts)), passage if rng.random() < 0.6 else f"glued {i} {passage}")
        texts.append("\n".join(parts))
    texts += ["a\n" * 90, None, "", "a\n" * 90, texts[0], " \n "]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, hits = {}, {}
    order = sorted({(1 << 63 if k is None else k, t) for k, t in rows if t is not None}, key=lambda r: (r[0], r[1]))
    for k, t in order:  # rows that share no id but null are told apart by a hash: only their number is compared
        for h, i, n in substrings.spans(t):
            if h in seen:
                hits.setdefault((k, t), []).append(i * substrings.RUN + n)
            seen.setdefault(h, (k, t))
    got = Counter((r.doc_id, r.text, r.n_removed) for r in substrings.remove_repeated_spans(df).collect())
    want = Counter()
    for k, t in rows:
        x, _, n = substrings.without(t, hits.get((k, t), [])) if k is not None and t is not None else (t, 0, 0)
        want[(k, x, n)] += 1
    named = {x: n for x, n in got.items() if x[0] is not None}
    assert named == {x: n for x, n in want.items() if x[0] is not None}
    assert sum(got.values()) == len(rows)
    out = " ".join(x[1] or "" for x in got)  # rows equal in key and text are one document to each other
    assert out.count(menu) == 1 and out.count(wide) == 1 and out.count(shared[6]) <= 2  # the first, and one that is glued to other words


def test_sentences_cover_the_text():
    for t in ("Tiny.\n \nOne more. And so on\n\n", "a. b! c?\nd", "", "x" * 5000, "word " * 900, "一二三。四五！六", " lead\n"):
        places = substrings.sentences(t)
        assert all(a < b for a, b, _ in places) and [p[0] for p in places] == sorted(p[0] for p in places)
        assert "".join(t[a:b] for a, b, _ in places).split() == t.split() or not places or "".join("".join(t[a:b] for a, b, _ in places).split()) == "".join(t.split())


def test_vectors_of_extreme_size_and_several_lengths(spark):
    rng = np.random.default_rng(18)
    near = [[1e-200, 2e-200], [2e-200, 4.1e-200], [1.0, 2.0], [1e200, 2e200]]
    rows = [(i, v, 0) for i, v in enumerate(near)]
    centre = {8: rng.normal(size=(9, 8)), 12: rng.normal(size=(9, 12))}
    rows += [(10 + i, (centre[d][i % 9] + 0.2 * rng.normal(size=d)).tolist(), i % 2) for i in range(160) for d in [8 if i % 3 else 12]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(df, list_rows=10, cell=16).collect()}
    unit = {i: vectors.unit(np.array([v]))[0] for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    pairs = [(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    n, root = Counter(a for a, _ in pairs), joined(pairs, unit)
    assert got == {k: (n[k], root[k], root[k] == k) for k in unit} and [got[i][0] for i in range(4)] == [3] * 4


def test_many_languages(spark):
    """More languages than the sample has rows to spare: each is still learned; a repeated row counts once."""
    rng = random.Random(19)
    names = [f"l{i:03d}" for i in range(500)]
    rows = [(i * 3 + k, f"{name * 2} " * 3 + "".join(rng.choice("aeiou") for _ in range(4)), name) for i, name in enumerate(names) for k in range(3)]
    rows += [(1, rows[1][1], rows[1][2])] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample, labels = langid.training_rows(df, "doc_id", "text", "lang", 1000, 500, 10)
    assert len(sample) == len(labels) <= 1500 and len(set(labels)) == df.where(~is_held_out(F.col("doc_id"))).select("lang").distinct().count()
    out = langid.identify(df, sample=400)
    assert out.count() == len(rows) and out.where("score < 0 or score > 1").count() == 0


def test_one_repeated_row_is_sampled_once(spark):
    df = spark.createDataFrame([(1, "good words here")] * 400 + [(2, "b*** w***")] * 3 + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    model = quality.learn(df, labels)
    assert model.score(quality.indicators("good words here")) > model.score(quality.indicators("b*** w***"))


def test_stages_take_odd_tables(spark, docs, none):
    """Empty tables, null and repeated ids, null and long texts, extra columns with clashing names: rows keep their columns."""
    odd = docs.withColumns({"n_removed": F.lit("x"), "_row": F.lit(1), "tokens": F.lit("y"), "lang_pred": F.lit("z")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.count() > 0
        empty = stage(spark, odd.limit(0), "")
        assert empty.columns == odd.columns and empty.count() == 0
    assert corpus_pipeline.packed(spark, odd, "").count() > 0 and corpus_pipeline.packed(spark, odd.limit(0), "").count() == 0


def test_stages_read_short_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = corpus_pipeline.stage(lambda spark, docs, _: docs.mapInPandas(lambda batches: (b[:1].assign(id=len(b)) for b in batches), "id long"))
    try:
        made = [r[0] for r in sizes(spark, spark.range(0, 4500, 1, 1), "").collect()]
        assert sum(made) == 4500 and max(made) == corpus_pipeline.BATCH_ROWS
        spark.conf.set(key, "7")  # shorter ones stay
        assert max(r[0] for r in sizes(spark, spark.range(0, 100, 1, 1), "").collect()) == 7
    finally:
        spark.conf.set(key, before)
