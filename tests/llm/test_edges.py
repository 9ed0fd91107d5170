"""Every operator and stage on awkward tables: nulls, repeats, long texts, clashing names, other id types, and none at all."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sweetspan.llm import lattice, line_templates, mixing, pieces, quality_rules, registry, shards, shingle_join, skip_chain, token_files, tree_weighting, url_filter

#: Names that operators use inside, or give their results.
CLASHING = ["kept", "KEY", "pos", "doc", "row", "id", "component_id", "m_row", "m_key", "h", "bucket", "n_words", "n_lines", "drop", "salt", "rule", "n_pieces", "text_md5", "leaf"]
_random = np.random.default_rng(9)
_words = ["".join(_random.choice(list("abcdefghij"), 6)) for _ in range(900)]


def _prose(n):
    return " ".join(_random.choice(_words, n))


LONG = "\n".join(_prose(40) for _ in range(18_000))  # 5 MB
BODY = _prose(80)
ROWS = [(1, BODY, "a"), (1, BODY, "a"), (2, BODY, None), (3, BODY + " more", "b"), (3, _prose(70), "b"), (None, BODY, "a"), (None, _prose(60), None), (None, None, None), (4, "", "a"), (5, None, "b"), (6, " \t\n\x0b ", "a"), (7, LONG, "c"), (8, "x" * 200_000, "c"), (9, "🙂 é \x1c\x00 " * 30, "c")]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, s, "en" if i else None, len(t or ""), *(k for k in range(len(CLASHING)))) for i, t, s in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING))
    return df.repartition(3).persist()


def _tokens(df):
    spark = df.sparkSession
    out = token_files.TokenFiles(spark, token_files.new_folder(spark), __import__("public_tokenizers").path("byte_bpe_50k.json"))
    out.write(df)
    return out.documents()


def _store(df):
    from sweetspan.operators.graph import shared_dir

    store = shards.ShardStore(df.sparkSession, f"{shared_dir(df.sparkSession)}/edges-{uuid.uuid4().hex}", fan=2)
    store.append(df, rows_per_shard=3)
    store.append(df.limit(0))
    store.compact()
    return store.read()


#: Each operator over the table, and whether it passes all columns through.
OPERATORS = {
    "pieces": (lambda df: pieces.encode(df, registry.piece_model()), True),
    "quality": (lambda df: quality_rules.judge(df), True),
    "shards": (_store, True),
    "shares": (lambda df: mixing.shares(df), False),
    "jaccard": (lambda df: shingle_join.join(df), False),
    "tree": (lambda df: tree_weighting.score(df, F.col("doc_id") == 2, across=True), False),
    "lines": (lambda df: line_templates.clean(df), True),
    "tokens": (_tokens, False),
    "spans": (lambda df: skip_chain.find(df), True),
    "urls": (lambda df: url_filter.judge(df, registry.URL_RULES, url="text"), True),
    "urls in parts": (lambda df: url_filter.judge_in_parts(df, df.sparkSession.createDataFrame(registry.URL_RULES, "host string, path string, verdict string"), url="text"), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(table, name):
    run, passes = OPERATORS[name]
    out = run(table)
    assert out.count() == len(ROWS) and len({c.lower() for c in out.columns}) == len(out.columns)
    if passes:
        assert out.columns[: len(table.columns)] == table.columns
        kept = [c for c in table.columns if not (name == "lines" and c == "text")]
        assert out.select(*kept).exceptAll(table.select(*kept)).count() == 0
    again = run(table.repartition(2, "source"))
    assert out.columns == again.columns
    if name not in ("shares",):  # which rows of a repeated id are taken follows the order of the input
        assert out.exceptAll(again.select(*out.columns)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(table, name):
    out = OPERATORS[name][0](table.limit(0))
    assert out.count() == 0


def test_results_of_awkward_rows(table):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.join(table, size=3).collect()}
    assert {(1, 78, 1), (2, 78, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 78, None), (None, 0, None)} <= found
    assert len({r for r in found if r[0] == 3}) == 1  # one text of the id counts
    measures = {r["doc_id"]: r for r in quality_rules.judge(table).collect()}
    assert measures[7]["_n_words"] == 18_000 * 40 and measures[4]["_n_words"] == 0 and measures[5]["base_failed"]
    assert quality_rules.judge(table).where("doc_id = 1").select("base_failed").distinct().count() == 1
    ids = _tokens(table).orderBy("start").collect()
    assert [r["doc_id"] for r in ids][:3] == [None] * 3 and ids[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ids, ids[1:], strict=False))


def test_ids_of_other_types(spark):
    texts = ["a line that everyone has here\n" + _prose(20) for _ in range(4)]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_templates.clean(df).collect()} == {"d0": 0, "d1": 1, "d2": 1, "d3": 1}
    v = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x"), (3, [1.0, 2.0], "y"), (None, [1.0, 2.0], "x"), (5, [2.0, 4.0], "x")], "vec_id long, embedding array<double>, label string")
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.links(v).orderBy(F.col("vec_id").asc_nulls_last()).collect()] == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (5, 2, 1, False), (None, 0, None, True)]
    w = v.withColumn("label", F.when(F.col("vec_id") == 2, 1.2).otherwise(1.7))
    assert {r["vec_id"]: r["n_links"] for r in lattice.links(w).where("vec_id < 4").collect()} == {1: 2, 2: 0, 3: 2}
    assert lattice.links(v.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(table, tmp_path, name, stage):
    spark = table.sparkSession
    for df in (table, table.limit(0)):
        path = str(tmp_path / str(uuid.uuid4()))
        df.write.parquet(path)
        out = stage(spark, spark.read.parquet(path), "unused")
        if name != "SentencePiece":
            assert out.columns == table.columns
        rows = out.count()
        assert rows <= 2 * len(ROWS) and (rows > 0) == (df is table)
        assert out.where("n_chars < 0").count() == 0
