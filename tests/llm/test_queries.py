"""Registered queries on small written folders against brute-force versions."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import TEXTS, coded_plainly, jaccard_components, links_plainly, prose

import corpus_pipeline
from sweetspan.llm import quality_rules, registry


def written(spark, folder, texts):
    """A folder whose documents have these texts, in files of their own."""
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_jaccard_query(spark, tmp_path):
    random, texts = np.random.default_rng(14), list(TEXTS)
    for base in prose(5, 31, 90):
        texts += [base, base.upper()]
        for edits in (1, 2, 3, 6):
            w = base.split()
            for k in random.integers(0, len(w), edits):
                w[k] = f"new{random.integers(1000)}"
            texts.append(" ".join(w))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.op6_ngram_jaccard(spark, written(spark, tmp_path, texts)).collect()}
    assert [out[k] for k in range(len(texts))] == jaccard_components(texts, 3, 9, 10)


def test_tree_weighting_query(spark, tmp_path):
    texts = [None, "", "ab cd ab  cd", "Ab cd\nef", "ab cd", "cd ab", "x", "ab cd gh", "ef ab"] + ["ab cd ef"] * 12
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    assert 0 < sum(held) < len(texts)
    out = {r["doc_id"]: r for r in registry.op7_tree_weighting(spark, written(spark, tmp_path, texts)).collect()}
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    train = [w for own, x in zip(tokens, held, strict=True) if not x for w in own]
    scores = coded_plainly([t for t, x in zip(texts, held, strict=True) if not x], texts)
    for k, own in enumerate(tokens):
        r = out[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(w in train for w in own), len(train))
        assert r["base_score"] == pytest.approx(sum(math.log10((train.count(w) + 1) / (len(train) + len(set(train)) + 1)) for w in own))
        assert r["score"] == pytest.approx(scores[k], rel=1e-5)


def test_lattice_query(spark, tmp_path):
    random = np.random.default_rng(16)
    rows = [(v, k % 4) for k, v in enumerate(random.normal(size=(60, 64)))]
    rows += [(v + random.normal(size=64) * s, y) for s in (0.02, 0.1, 0.19, 0.25) for v, y in rows[:15]]
    rows += [(rows[0][0], 0)] * 30 + [(None, 0)] * 20 + [(rows[1][0], None), (np.zeros(64), 1), (np.full(64, np.nan), 2)]
    table = spark.createDataFrame([(k, None if v is None else [float(x) for x in v], y) for k, (v, y) in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    table.withColumn("KEPT", F.lit(1)).withColumn("cell", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    links, firsts = links_plainly(rows)
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["component_id"] == r["vec_id"]) for r in registry.op9_lattice(spark, str(tmp_path)).collect()}
    assert out == {k: (links[k], firsts[k], firsts[k] == k) for k in range(len(rows))}


def test_token_query(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts, own, start = TEXTS + prose(20, 41), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    out = sorted(registry.op10_token_files(spark, written(spark, tmp_path, texts)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    for k, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(out[k]) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_host_verdicts_against_a_likelihood_fit(spark):
    """The moments' prior against the beta prior of highest likelihood, over hosts of unequal sizes and rates."""
    random = np.random.default_rng(5)
    sizes = random.integers(4, 160, 50)
    rates = np.where(np.arange(50) % 10 == 0, 0.75, random.beta(2, 30, 50))
    failed = random.binomial(sizes, rates)
    good, rows = prose(1, 3)[0], []
    for h, (n, f) in enumerate(zip(sizes.tolist(), failed.tolist(), strict=True)):
        rows += [(1000 * h + k, "short" if k < f else good, f"h{h}") for k in range(n)]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("host_rate").alias("rate"), F.count_if("kept").alias("kept")).collect()
    out = {r["source"]: r for r in out}
    beta = np.vectorize(lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))

    def likelihood(prior):
        a, b = prior
        return float((beta(a + failed, b + sizes - failed) - beta(a, b)).sum())

    a, b = max(((m * w, (1 - m) * w) for m in np.linspace(0.02, 0.5, 49) for w in np.geomspace(0.5, 200, 60)), key=likelihood)
    mean = failed.sum() / sizes.sum()
    top, apart = 4 * mean / (1 - mean + 4 * mean), 0
    for h, (n, f) in enumerate(zip(sizes.tolist(), failed.tolist(), strict=True)):
        assert out[f"h{h}"]["rate"] == pytest.approx((a + f) / (a + b + n), abs=0.08)
        low = np.quantile(random.beta(a + f, b + n - f, 20_000), 0.05)
        if abs(low - top) > 0.08:
            apart += 1
            assert out[f"h{h}"]["kept"] == (0 if low > top else n - f), h
    assert apart >= 40 and {r["kept"] == 0 for r in out.values()} == {True, False}


def test_pipeline_on_awkward_rows(spark, tmp_path):
    body = prose(1, 51, 80)[0]
    more = prose(5, 52, 90)
    rows = [(1, body, "a"), (1, body, "a"), (2, body, None), (3, body + " more", "b"), (3, more[0], "b"), (None, more[1], "a"), (None, None, None), (4, "", "a"), (5, None, "b"), (6, " \t\n\x0b ", "a"), (7, "\n".join(prose(2000, 53, 40)), "c"), (8, "x" * 200_000, "c"), (9, "🙂 é \x1c\x00 " * 30, "c"), (10, more[2], "c"), (11, more[3], None), (12, more[4], "b")]
    df = spark.createDataFrame([(i, t, s, "en" if i else None, len(t or ""), 1, "x", 2) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long, KEPT int, component_id string, m_row int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "text"]
    got = out.collect()
    assert {10, 11, 12, 7} <= {r["doc_id"] for r in got} <= {1, 3, 7, 10, 11, 12, None}
    uses = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert all(uses.count(k) <= 2 for k in uses) and all(r["round_trip"] and r["parity"] for r in got)
