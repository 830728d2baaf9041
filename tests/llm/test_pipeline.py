import random
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from lamina.llm import mixing, pii, quality, registry


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n, seen = docs.columns, docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        seen.append((name, out.count()))
        if name != "packing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        if name in ("quality", "near duplicates"):
            assert out.count() <= n and not set(r[0] for r in out.select("doc_id").collect()) - set(r[0] for r in docs.select("doc_id").collect())
        docs = out.cache()
    assert len(seen) == 5 and seen[-1][1] > 0
    assert all(len(np.frombuffer(r.ids, "<u2")) == r.length for r in docs.collect())


def test_run_and_registry(spark, sf):
    import __spark_entry__

    q = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in registry.queries()} and set(registry.queries()) <= set(q) and "pipeline" in q
    out = q["pipeline"](spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for f in (root / "lamina").rglob("*.py"):
        assert "llm" in f.parts or "lamina.llm" not in f.read_text()


def test_mixing_runs_no_python(spark, sf):
    plan = registry.queries()["op1_mix_sources"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def whole(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_rows_against_brute_force(spark, tmp_path):
    """run() against the stages written out: every kept text's ids, in pieces that hold each copy once."""
    from tokenizers import Tokenizer

    r = random.Random(21)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(160):
        w = [word() for _ in range(200)]
        if i % 4 == 1 and (i - 1) % 10:  # near copies of the one before, on both sides of 0.8
            w = rows[-1][1].replace(".", "").split()
            for p in r.sample(range(1, 39), r.choice([1, 3, 5, 9])):
                w[5 * p] = word()
        text = " ".join(w) if i % 10 else " ".join(f"{word().upper()}!!" for _ in range(90))
        text += f" Mail {word()}@{word()}.org or 10.0.0.{i}." if i % 7 == 0 else "."
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, rows[2][1], "en", "s1", 5), (None, rows[3][1] + " more words at the end", "en", None, 9)]
    sf = whole(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    w, _, _ = quality.fit(docs)
    kept = [x for x in rows if quality.score(quality.profile((x[1] or "").encode()), w) >= 0.5]
    assert 100 < len(kept) < len(rows)
    sets = [set(zip(*(t[k:] for k in range(5)))) if len(t := (x[1] or "").lower().split()) >= 5 else {tuple(t)} - {()} for x in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    order = lambda x: (x[0] is None, x[0] or 0)
    first = [min((x for x, y in zip(kept, root) if y == g), key=order) for g in set(root)]
    assert 10 < len(kept) - len(first) < len(kept)
    trees, limits = pii.model()
    clean = {}
    for x in first:
        base, added = pii.find(x[1] or "", trees, limits)
        t, shift = x[1], 0
        for a, b, kind in sorted(base + added):
            t = t[: a - shift] + f"<{kind.upper()}>" + t[b - shift :]
            shift = len(x[1]) - len(t)
        clean[x[0]] = t
    assert any("<EMAIL>" in (t or "") for t in clean.values())
    third = spark.createDataFrame([(x[0], clean[x[0]], x[3]) for x in first], "doc_id long, text string, source string")
    copies = {x.doc_id: x.mix_copies for x in mixing.mix(third).collect()}

    out = corpus_pipeline.run(spark, sf).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen = Counter()
    for x in out:
        ids = [*tokens.encode(clean[x.doc_id] or "", add_special_tokens=False).ids, 1]
        assert len(ids) == x.doc_tokens and ids[x.start : x.start + x.length] == np.frombuffer(x.ids, "<u2").tolist()
        for i in range(x.start, x.start + x.length):
            seen[x.doc_id, i] += 1
    want = Counter({(k, i): n for k, n in copies.items() if n for i in range(len(tokens.encode(clean[k] or "", add_special_tokens=False).ids) + 1)})
    assert seen == want
    for x in [*{x.sequence_id for x in out}]:
        own = sorted((y.offset, y.length) for y in out if y.sequence_id == x)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and (total := sum(n for _, n in own)) and (total == 2048 or total & (total - 1) == 0)


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (1, "", None, "a", 0), (2, "same words here", "en", None, 15), (3, "same words here", "en", "b", 15), (4, "long text " * 30_000, "en", "b", 300_000)]
    out = corpus_pipeline.run(spark, whole(spark, tmp_path / "odd", rows)).collect()
    assert {x.doc_id for x in out} <= {None, 1, 2, 3, 4}
    assert corpus_pipeline.run(spark, whole(spark, tmp_path / "empty", [])).count() == 0
