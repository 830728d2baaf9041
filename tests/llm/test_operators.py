"""Operators on Spark against brute force, and on odd tables."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import embedding, fingerprint, mixing, packing, pii, quality, registry, secrets, simhash, suffix, toxicity
from lamina.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, null ids."""
    r = random.Random(9)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))
    long = sentence(30_000)
    rows = [(0, None, None), (1, "", "a"), (2, "   \n\t", "a"), (3, "one", "b"), (4, long, "b"), (5, long, None), (6, long[1000:], "c")]
    rows += [(7, "same text here " * 20, "c")] * 2 + [(8, "é漢字 🙂 " * 30, "c"), (None, "null id " * 40, "d"), (9, sentence(200), "d"), (9, sentence(200), "d")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


CLASH = "base extras mix_target mix_row q_kept sh_a sh_row sh_fp node s_spans s_row pii_email tox_score n key k text_ start u packed_text".split()
WHOLE = {  # operators that pass all columns on
    "mixing": mixing.mixed_rows, "quality": quality.keep_good, "near duplicates": simhash.keep_first, "personal data": pii.redact,
}
PARTLY = {  # operators that add columns, and those of the clashing names that theirs replace
    "mix": (mixing.mix, {"mix_target"}), "judge": (lambda d: quality.judge(d, *quality.fit(d)[:2]), {"q_kept"}),
    "secrets": (secrets.classify, {"s_spans", "s_row"}), "personal data": (pii.scan, {"pii_email"}), "toxicity": (lambda d: toxicity.score(d, None, {}), {"tox_score"}),
    "fingerprints": (simhash.fingerprints, {"sh_fp"}), "packing": (packing.pack, set(CLASH)), "suffixes": (suffix.strip_repeats, set(CLASH)), "sketches": (fingerprint.fingerprint_with_edits, set(CLASH)),
}


def crowded(df):
    return df.withColumns({c: F.lit(f"of {c}") for c in CLASH})


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_clashing_names_stay(odd, empty, name):
    out = WHOLE[name](crowded(odd))
    assert out.columns == crowded(odd).columns and out.dtypes == crowded(odd).dtypes
    rows = out.collect()
    assert rows and all(r[c] == f"of {c}" for r in rows for c in CLASH)
    assert WHOLE[name](crowded(empty)).collect() == []


@pytest.mark.parametrize("name", sorted(PARTLY))
def test_clashing_names_are_replaced(odd, empty, name):
    operator, gone = PARTLY[name]
    out = operator(crowded(odd))
    assert len(set(c.lower() for c in out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) >= odd.count() and all(r[c] == f"of {c}" for r in rows for c in CLASH if c not in gone)
    assert operator(crowded(empty)).collect() == []


def test_clashing_names_of_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(map(str, embedding.near_vectors(crowded(df)).collect())) == sorted(map(str, embedding.near_vectors(df).collect()))
    prints = spark.createDataFrame([(1, 7), (2, 7), (None, 7)], "doc_id long, sh_fp long").withColumns({c: F.lit(0) for c in ("sh_root", "component_id", "node", "fp", "root", "least")})
    assert {r.component_id for r in simhash.clusters(prints).collect()} == {1}


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def run(spark, sf, name):
    return registry.queries()[name](spark, sf)


# mixing


def levels(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if 2 * sizes[s] < level * w[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check_mix(rows, source, text):
    sizes = defaultdict(int)
    for r in rows:
        n = len((text[r.row] or "").encode().split())
        assert r.size == n and r.taken in (0, n, 2 * n)
        sizes[source[r.row]] += n
    want = levels(sizes)
    for s in sizes:
        own = [r for r in rows if source[r.row] == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9) for r in own)
        gap = want[s] - sum(r.taken for r in own)
        moves = {(c - r.taken // r.size) * r.size for r in own if r.size for c in (0, 1, 2)}
        assert abs(gap) <= 2e-4 * want[s] or not any(abs(gap - m) < abs(gap) for m in moves)  # no document's copies bring it nearer
        assert abs(gap) <= max((r.size for r in own), default=0) / 2 + 1e-6


def test_mix(spark, sf, docs):
    got = run(spark, sf, "op1_mix_sources").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    check_mix([r.asDict() and type("R", (), r.asDict() | {"row": r.doc_id}) for r in got], source, texts(docs))
    again = run(spark, sf, "op1_mix_sources").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_of_odd_tables(spark, odd, empty):
    narrow = mixing.mix(odd)
    assert narrow.count() == odd.count()
    rows = [type("R", (), {"row": (r.doc_id, r.text), "size": r.mix_size, "source_size": r.mix_source_size, "target": r.mix_target, "taken": r.mix_taken}) for r in narrow.collect()]
    check_mix(rows, {(r.doc_id, r.text): r.source for r in odd.collect()}, {(r.doc_id, r.text): r.text for r in odd.collect()})
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(odd).columns == odd.columns
    copies = Counter((r.doc_id, r.text) for r in mixing.mixed_rows(odd).collect())
    rows = Counter((r.doc_id, r.text) for r in odd.collect())
    assert all(copies[k] <= 2 * n for k, n in rows.items())
    clash = odd.withColumn("n", F.lit(1)).withColumn("k", F.lit(2)).withColumn("s", F.lit(3))
    assert mixing.mixed_rows(clash).columns == clash.columns


def test_tilts_are_exponential(spark, docs):
    cells = mixing.sized(docs).groupBy("mix_source", "mix_size").agg(F.count("*").alias("n"))
    state = mixing.solve_tilts(cells, mixing.source_targets(cells))
    rows = {r.mix_source: r for r in state.collect()}
    per = defaultdict(float)
    for c in cells.collect():
        s = rows[c.mix_source]
        rate = (2.0 if c.mix_size else 1.0) if s.full else min(2.0, np.exp(s.tilt * c.mix_size))
        per[c.mix_source] += c.n * c.mix_size * rate
    assert all(per[s] == pytest.approx(r.mix_target, rel=1e-5) for s, r in rows.items())


# packing


def check_packs(rows, by_text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    runs, tokens = defaultdict(list), defaultdict(Counter)
    for r in rows:
        runs[r.sequence_id].append(r)
        tokens[r.doc_id, r.doc_tokens][r.start, r.length] += 1
    for seq in runs.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    for key, text in by_text:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(tokens[key, len(ids)].elements())
        assert sum(n for _, n in pieces) % len(ids) == 0 and pieces
    for r in rows:
        for ids in ([*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in by_text if k == r.doc_id):
            if len(ids) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32:
                break
        else:
            raise AssertionError(r)


def test_packing(spark, sf, docs):
    check_packs(run(spark, sf, "op2_packing").collect(), list(texts(docs).items()))


def test_packing_of_odd_tables(odd, empty):
    small = odd.where("text is null or length(text) < 3000")
    check_packs(packing.pack(small).collect(), [(r.doc_id, r.text) for r in small.collect()])
    assert packing.pack(empty).count() == 0
    ids = packing.pack(odd, with_ids=True).collect()
    assert all(len(r.ids) == 2 * r.length for r in ids)


def test_packing_brings_topics_together(spark):
    """Documents of a topic, dealt over all input partitions, share windows."""
    r = random.Random(12)
    rows = []
    for i in range(1200):
        words = [f"topic{i % 40}w{r.randrange(30)}" for _ in range(60)] + [f"all{r.randrange(40)}" for _ in range(60)]
        rows.append((i, " ".join(words), "s"))
    shared = []
    for parts in (2, 16):
        out = packing.pack(documents(spark, rows).repartition(parts)).collect()
        runs = defaultdict(Counter)
        for x in out:
            runs[x.sequence_id][x.doc_id % 40] += 1
        shared.append(sum(max(c.values()) for c in runs.values()) / sum(sum(c.values()) for c in runs.values()))
    assert min(shared) > 0.6 and abs(shared[0] - shared[1]) < 0.1, shared  # by chance it would be near 1 / 4


# embeddings


def brute_links(vectors):
    n = len(vectors)
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                near[i, j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9
    return near


def check_links(rows, ids, near):
    deg = near.sum(1)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    for i, v in enumerate(ids):
        assert (rows[v].n_links, rows[v].component_id, rows[v].kept) == (deg[i], label[i], v == label[i]), v


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    vectors = [(centres[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.35])).tolist() for i in range(150)]
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    near = brute_links([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors])
    for part in (1024, 16):
        monkeypatch.setattr(embedding, "PART", part)
        check_links({r.vec_id: r for r in embedding.near_vectors(df).collect()}, list(range(len(vectors))), near)
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_embeddings_loose_pairs(spark):
    """Isolated pairs at the threshold are found in a table of 100,000 vectors."""
    rng, n = np.random.default_rng(3), 50_000
    x, y = rng.standard_normal((2, n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, 0.901 * x + math.sqrt(1 - 0.901**2) * y]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(2 * n), "embedding": list(both)}), "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding.near_vectors(df).collect()}
    assert sum(got[i + n].component_id == i and got[i].n_links > 0 for i in range(n)) > 0.98 * n


def test_passes_follow_density():
    """Evenly spread vectors need about the passes that their number asks for; crowded ones more, also where they are few."""
    even = {b: n for b, n in enumerate((500, 500, 1000, 2000, 4100, 3600))}
    few = embedding.passes_for(even)
    assert 0 <= few - embedding.passes_of(20_000) <= 3
    assert embedding.passes_for({**even, 14: 300}) > 2 * few
    assert embedding.passes_for({**even, 14: 100}) < 2 * few  # less than a hundredth
    assert embedding.passes_for({}) == 0


def test_embeddings_in_a_dense_region(spark):
    """Loose pairs are found among vectors that all lie near each other, but too far to be linked."""
    rng, n, pairs, dim = np.random.default_rng(9), 9_000, 300, 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    middle = unit(rng.standard_normal((1, dim)))
    away = rng.standard_normal((n, dim))
    region = math.sqrt(0.75) * middle + 0.5 * unit(away - (away @ middle.T) * middle)
    first = region[:pairs]
    other = rng.standard_normal((pairs, dim))
    other = 0.905 * first + math.sqrt(1 - 0.905**2) * unit(other - (other * first).sum(1, keepdims=True) * first)
    x = np.concatenate([region, other, rng.standard_normal((3_000, dim))]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding.near_vectors(df).collect()}
    y = unit(x.astype(np.float64))
    want = [int((y[i : i + 1] @ y.T >= 0.9).sum()) - 1 for i in range(len(y))]
    linked = [i for i, k in enumerate(want) if k]
    assert len(linked) >= 2 * pairs and all(got[i] <= k for i, k in enumerate(want))
    assert sum(got[i] == want[i] for i in linked) > 0.98 * len(linked)


def test_rounding_leaves_bounds():
    """Rounded vectors lie as near the true ones as they say, in any number of dimensions."""
    rng = np.random.default_rng(6)
    for dim in (1, 2, 16, 768):
        x = rng.standard_normal((200, dim)) * np.where(rng.random((200, dim)) < 0.2, 1e-6, 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y, off = embedding.unrounded(embedding.rounded(x).slice(50, 100), dim)
        assert (np.linalg.norm(x[50:150] - y, axis=1) <= off).all() and off.max() < 1e-3


def test_embeddings_near_the_threshold(spark):
    """Pairs that rounding leaves open are decided by the vectors themselves, on both sides of the threshold."""
    rng, n = np.random.default_rng(5), 400
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = rng.standard_normal((2, n, 32))
    x = unit(x)
    y = unit(y - (x * y).sum(1, keepdims=True) * x)
    c = (0.9 + rng.choice([-1, 1], n) * 10.0 ** -rng.integers(4, 10, n))[:, None]
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(2 * n), "embedding": list(both)}), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding.near_vectors(df).collect()}
    assert all(got[i] == got[i + n] == int(c[i, 0] >= 0.9) for i in range(n))


def test_embeddings_borders(spark):
    """What a pass finds does not depend on the number of partitions, however few rows they have."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x = np.concatenate([x, x + 0.3 * rng.standard_normal(x.shape)])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    seen = []
    for parts in (1, 7, 150):
        seen.append(sorted(tuple(r) for r in components(embedding.pass_links(nodes, range(1), 0.9, 8, parts)).collect()))
    assert seen[0] and seen[0] == seen[1] == seen[2]


# toxicity


def test_toxicity(spark, sf):
    got = {r.doc_id: r for r in run(spark, sf, "op4_toxicity").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == toxicity.held_out(i) for i, r in got.items())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count() and labels


def test_scores_of_all_documents(spark, sf, docs):
    """op4 and op6 give each document what their models, fitted alike, say of its whole text alone."""
    t = texts(docs)
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    model, lexicon = toxicity.train(toxicity.training_rows(docs, lab))
    got = {r.doc_id: r.score for r in run(spark, sf, "op4_toxicity").collect()}
    want = model.predict(np.array([toxicity.features(x, lexicon, {}) for x in t.values()]))
    assert np.allclose([got[k] for k in t], want, atol=1e-12)
    counts = Counter(quality.pattern(quality.votes(quality.profile(x.encode()))) for x in t.values())
    posterior, _, _ = quality.estimate(dict(counts))
    w, fitted, _ = quality.fit(docs)
    assert fitted == pytest.approx(posterior)
    got = {r.doc_id: r for r in run(spark, sf, "op6_quality").collect()}
    for k, x in t.items():
        p = quality.profile(x.encode())
        assert got[k].score == pytest.approx(quality.score(p, w), abs=1e-4) and got[k].posterior == pytest.approx(posterior[quality.pattern(quality.votes(p))])
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {k for k, r in got.items() if r.kept}


def test_toxicity_learns(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(5))
    rows, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(60)]
        bad = r.random() < 0.2
        for _ in range(3 * bad):
            w[r.randrange(60)] = r.choice(["badword", "verybad", "uglyx"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    docs, lab = documents(spark, [*rows, (5000, None, None), (5001, "", None)]), spark.createDataFrame([*labels, (None, 1), (7777, 1)], "doc_id long, toxic int")
    model, lexicon = toxicity.train(toxicity.training_rows(docs, lab))
    got = {x.doc_id: x.tox_score for x in toxicity.score(docs, model, lexicon).collect()}
    y = dict(labels)
    held = [i for i in y if toxicity.held_out(i)]
    assert np.mean([(got[i] >= 0.3) == y[i] for i in held]) > 0.98 and 0 <= got[5000] == got[5001]
    assert {x.tox_score for x in toxicity.score(docs, *toxicity.train([])).collect()} == {0.0}


def test_toxicity_sample_is_bounded(spark, odd, empty):
    docs = documents(spark, [(0, f"text number {i}", "s") for i in range(5000)] + [(i, "x" * 1000, "s") for i in range(1, 400)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(0, 1)], "doc_id long, toxic int")
    asked = [i for i in range(400) if not toxicity.held_out(i)]
    rows = toxicity.training_rows(docs, lab, most=10_000)
    assert len(rows) == len(asked) and ("text number 0", 1) in rows
    assert len(toxicity.training_rows(docs, lab, most=10)) <= 40
    rows = toxicity.training_rows(docs, lab, most_bytes=20_000)
    assert 19 <= len(rows) <= 21 and sum(len(t) for t, _ in rows) <= 20_000
    lab = spark.createDataFrame([(r.doc_id, 1) for r in odd.collect()], "doc_id long, toxic int")
    assert len(toxicity.training_rows(odd, lab)) == len({r.doc_id for r in odd.collect() if r.doc_id is not None and not toxicity.held_out(r.doc_id)})
    assert toxicity.training_rows(empty, lab) == []


def test_toxicity_of_null_ids(spark, tmp_path):
    documents(spark, [(None, "a b", "s"), (2, "c", "s"), (2, "c", "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = run(spark, str(tmp_path), "op4_toxicity").collect()
    assert [(r.doc_id, r.held_out, r.score, r.predicted) for r in sorted(got, key=lambda r: r.doc_id or 0)] == [(None, False, 0.0, 0), *[(2, toxicity.held_out(2), 0.0, 0)] * 2]


def test_long_obfuscated_words():
    word = "b" * 60 + "@" + "dword"
    lexicon = {word.replace("@", "a"): 5.0}
    odd_words = lambda t: toxicity.features(t, lexicon, {})[11]
    assert odd_words(f"so {word} here") == 1 and odd_words(f"{word}\n{word}") == 2 and odd_words("x" * 50 + f" {word}") == 1


# fingerprints


def shingles(t, k=5):
    w = t.encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def check_fingerprints(rows, ordered):
    for i, (key, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own = [r for r in rows if r.doc_id == key and r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert own, key
        j = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(own[0].near_edited - j(shingles(t), shingles(edited))) < 0.2 and abs(own[0].near_next - j(shingles(t), shingles(nxt))) < 0.2


@pytest.mark.parametrize("rows_a_range", [2048, 7])
def test_fingerprints(spark, sf, docs, monkeypatch, rows_a_range):
    monkeypatch.setattr(fingerprint, "ROWS", rows_a_range)
    got = run(spark, sf, "op5_fingerprints").collect()
    assert len(got) == docs.count()
    check_fingerprints(got, sorted(texts(docs).items(), reverse=True))


def test_fingerprints_of_odd_tables(odd, empty):
    rows = fingerprint.fingerprint_with_edits(odd).collect()
    order = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    assert len(rows) == len(order)
    check_fingerprints(rows, order)
    assert fingerprint.fingerprint_with_edits(empty).count() == 0
    assert fingerprint.fingerprint_with_edits(odd.where("doc_id = 3")).first().near_next == 1.0


def test_sketches_merge():
    a, b = (" ".join(f"w{i}" for i in range(x, x + 4000)).encode() for x in (0, 2000))
    s, t = fingerprint.sketch(a), fingerprint.sketch(b)
    both = fingerprint.merge(s, t)
    assert (fingerprint.merge(t, s) == both).all() and (fingerprint.unpack(fingerprint.pack(s)) == s).all()
    assert fingerprint.resemblance(s, t) == pytest.approx(1 / 3, abs=0.12) and fingerprint.containment(s, t) == pytest.approx(0.5, abs=0.15)
    assert fingerprint.distinct(both) == pytest.approx(6000, rel=0.2)


# quality


def test_quality(spark, sf):
    got = {r.doc_id: r for r in run(spark, sf, "op6_quality").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    good = [got[i].kept for i, q in labels if q == 1]
    assert np.mean(good) > 0.97


def test_quality_of_odd_tables(spark, odd, empty):
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(empty).count() == 0
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows = [(i, ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(12)) if i % 5 else f"{word()} " * 120 if i % 2 else " ".join(word().upper() + "!!" for _ in range(90)), "s") for i in range(600)]
    kept = {x.doc_id for x in quality.keep_good(documents(spark, rows)).collect()}
    assert kept == {i for i in range(600) if i % 5}


# suffix arrays


def brute_repeats(rows):
    """(key, text) in order -> results; equal rows count once."""
    seen, out = set(), {}
    for key, t in rows:
        if (key, t) in out:
            continue
        b = t.encode()
        gone, own = bytearray(len(b)), []
        for p in range(len(b) - 99):
            g = b[p : p + 100]
            if g in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(g)
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out[key, t] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


def test_repeats(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, sf, "op7_suffix_dedup").collect()}
    want = brute_repeats(sorted(texts(docs).items()))
    assert got == {k: v for (k, _), v in want.items()}


@pytest.mark.parametrize(("variants", "shard"), [(2000, 1_000_000), (500, 1_000_000), (3, 2000), (1, 2000)])
def test_repeats_planted(spark, monkeypatch, variants, shard):
    monkeypatch.setattr(suffix, "VARIANTS", variants)
    monkeypatch.setattr(suffix, "SHARD", shard)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    passage, line, base = sentence(40), sentence(22), sentence(150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))  # near copies
    rows += [(100 + i, sentence(r.randrange(30)) + " " + passage + " " + sentence(r.randrange(30)) + line) for i in range(30)]
    rows += [(200, "ab" * 400), (201, "ab" * 90), (202, "x" * 99), (203, "x" * 100), (204, passage), (205, ""), (206, "é漢" * 120)]
    rows += [(207, rows[3][1]), (208, rows[3][1]), (208, rows[3][1])]
    rows += [(300 + i, word() * r.randrange(1, 9) + passage[:130] + sentence(8)) for i in range(40)]  # ends of a passage, cut inside words
    df = documents(spark, [(k, t, None) for k, t in rows])
    out = suffix.strip_repeats(df.repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("sx_kept", 256).alias("h")).collect()
    want = brute_repeats(sorted(rows, key=lambda x: x[0]))
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.h) for x in out) == Counter((k, *want[k, t]) for k, t in rows)


def test_repeats_of_odd_tables(odd, empty):
    out = suffix.strip_repeats(odd).collect()
    assert len(out) == odd.count() and suffix.strip_repeats(empty).count() == 0
    by = defaultdict(list)
    for x in out:
        by[x.doc_id].append((x.n_bytes, x.n_removed, x.n_spans))
    assert by[5][0][1] == by[5][0][0] == by[6][0][1] + 1000 and by[4][0][1] == 0 and by[7][0] == by[7][1] and by[0] == [(0, 0, 0)]


# secrets and personal data


def test_secrets(spark, odd, empty):
    live, shown = "ghp_aB3dE6gH9jK2mN5pQ8sT1vW4yZ7", "sk_live_EXAMPLE123abcDEF456ghiJKL"
    rows = [(i, f"text {i} key {shown} end", f"src{i % 5}") for i in range(10)] + [(20, f"only {live} here password=hunter22", "src1")] + [(30, None, None), (31, "", "x")]
    rows += [(21, f"only {live} here password=hunter22", "src2")]  # a copy of the file: one owner
    got = {r.doc_id: r for r in secrets.classify(documents(spark, rows).select("doc_id", "source", "text")).collect()}
    assert all(got[i].s_spans == "" and (got[i].s_live, got[i].s_example) == (0, 1) for i in range(10))
    assert got[20].s_spans == f"key:5:{5 + len(live)},assign:42:59" and got[20].s_live == 2 and got[20].s_assign == 1
    assert got[30].s_spans == "" and got[30].s_base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.classify(odd.select("doc_id", "source", "text")).count() == odd.count()
    assert secrets.classify(empty.select("doc_id", "source", "text")).count() == 0


def plain_spans(t, patterns):
    """Spans of a contract's patterns: (kind, pattern, test of a match), in order of start, then kind."""
    import re

    found = []
    for place, (kind, pattern, fits) in enumerate(patterns):
        found += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, t) if fits(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


SECRETS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 12 <= sum(c.isdigit() for c in m[0]) <= 19 and luhn([c for c in m[0] if c.isdigit()])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
]


@pytest.mark.parametrize(("name", "patterns"), [("op8_secrets", SECRETS), ("op9_pii", PERSONAL)])
def test_base_spans_of_all_documents(spark, tmp_path, docs, name, patterns):
    r = random.Random(31)
    parts = ["password", "Api_Key", "TOKEN", ": ", "=", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x9/+", " ", "\n", "a@b.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (469) 555-8958", "é"]
    made = documents(spark, [(10**6 + i, "".join(r.choice(parts) for _ in range(r.randint(1, 30))), "s") for i in range(300)])
    docs = docs.unionByName(made).cache()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in run(spark, str(tmp_path), name).collect()}
    assert len(got) == docs.count()
    for key, t in texts(docs).items():
        want = plain_spans(t, patterns)
        assert got[key].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind, _, _ in patterns:
            assert got[key][f"n_{kind}"] == sum(w.split(":")[0] == kind for w in want)
        assert set(want) <= set(got[key].spans.split(","))
    assert sum(len(plain_spans(t, patterns)) for t in texts(docs).values()) > 20


def test_ownership_of_all_documents(spark, sf, docs):
    """Added spans are the candidates that are not copied widely, counted here in plain Python."""
    repos, owners, per = defaultdict(set), defaultdict(set), {}
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    for key, t, source in rows:
        base = secrets.base_spans(t)
        per[key] = base + secrets.added_candidates(t, base)
        for s in per[key]:
            repos[s[3]].add(source)
            owners[s[3]].add(t)
    example = lambda v: len(owners[v]) >= 3 and len(repos[v]) >= 3
    got = {r.doc_id: r for r in run(spark, sf, "op8_secrets").collect()}
    for key, spans in per.items():
        assert got[key].spans == secrets.joined([s for s in spans if s[2] != "key" or not example(s[3])])
        assert (got[key].n_live, got[key].n_example) == (sum(not example(s[3]) for s in spans), sum(example(s[3]) for s in spans))


def test_pii(spark, odd, empty):
    text = "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, tel +1 (469) 555-8958"
    rows = [(1, text, None), (2, None, None), (3, "nothing", None)]
    df = documents(spark, rows)
    r = {x.doc_id: x for x in pii.scan(df.select("doc_id", "text")).collect()}
    assert [r[1][f"pii_{k}"] for k in pii.BASE] == [1, 1, 1, 1] and r[2].pii_spans == ""
    assert r[1].pii_base_sha256 == hashlib.sha256(b"email:5:14,ip:18:26,card:33:52,phone:58:75").hexdigest()
    out = {x.doc_id: x for x in pii.redact(df).collect()}
    assert out[1].text == "mail <EMAIL> or <IP>, card <CARD>, tel <PHONE>" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[2].n_chars is None and out[3].text == "nothing"
    assert pii.redact(odd).count() == odd.count() and pii.redact(empty).count() == 0


# near duplicates


def test_simhash(spark, sf, docs):
    def fp(t):
        w = t.encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    t = texts(docs)
    prints = {k: fp(x) for k, x in t.items()}
    ids = sorted(prints)
    label = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = {r.doc_id: r for r in run(spark, sf, "op10_simhash").collect()}
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", label[k]) for k in ids}


def test_simhash_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 4)
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(10)}
    for f in list(fps):
        for _ in range(8):
            fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(fps)), "doc_id long, sh_fp long")
    got = {x.doc_id: x.component_id for x in simhash.clusters(df).collect()}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label))


def test_keep_first(spark, odd, empty):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows, kept = [], set()
    for g in range(12):
        base = [word() for _ in range(300)]
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[r.randrange(300)] = word()
            rows.append((100 * g + c, " ".join(w), "s"))
        kept.add(100 * g)
    rows += [(5000, rows[0][1], "s"), (5001, rows[0][1].upper(), "s"), (0, rows[0][1], "s")]
    out = simhash.keep_first(documents(spark, rows))
    assert sorted(x.doc_id for x in out.collect()) == sorted(kept) and out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert simhash.keep_first(empty).count() == 0
    left = [x.doc_id for x in simhash.keep_first(odd).collect()]
    assert left.count(4) == 1 and 5 not in left and left.count(7) == 1 and left.count(None) == 1


def test_keep_first_by_true_resemblance(spark):
    """Copies just above a resemblance of 0.8 go, those just below and texts that differ in counts only are told by their sets."""
    r = random.Random(6)
    new = iter(range(10**9))
    word = lambda: f"w{next(new)}x{r.randrange(1000)}"
    rows = []
    for g in range(60):
        base = [word() for _ in range(1000)]
        w = list(base)
        for p in r.sample(range(1, 199), 22 + g % 2):  # five shingles each; 22: 0.801, 23: 0.793
            w[5 * p] = word()
        rows += [(10 * g, " ".join(base), "s"), (10 * g + 1, " ".join(w), "s")]
    for g in range(60, 70):
        w = [word() for _ in range(200)]
        rows += [(10 * g, " ".join(w), "s"), (10 * g + 1, " ".join(w + w[:30] * 40), "s")]
    sets = {}
    for i, t, _ in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    like = lambda a, b: len(a & b) / len(a | b)
    gone = {10 * g + 1 for g in range(70) if like(sets[10 * g], sets[10 * g + 1]) >= 0.8}
    assert len(gone) == 40
    assert {x.doc_id for x in simhash.keep_first(documents(spark, rows)).collect()} == set(sets) - gone


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1300)] + [(r.randrange(3000, 3100), r.randrange(3000, 3100)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
