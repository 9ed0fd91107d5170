"""The pipeline's stages by their contract, and run() against stages computed plainly."""

import hashlib

import pytest
import sentencepiece

from sweetspan.llm import registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import jaccard_components, prose  # noqa: E402


def mixed_plainly(rows):
    """The mix of (id, source, size): every document's uses, cut where the budget ends."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(sizes))}
    budget, target, left = 1.5 * sum(sizes.values()), {}, set(sizes)
    while left:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in left}
        left = left - full if full else set()
    queue = []
    for s in sizes:
        run = 0
        for key, k, n in sorted((hashlib.md5(str(k).encode()).hexdigest(), k, n) for k, t, n in rows if t == s):
            run += n
            queue += [((run + copy * sizes[s]) / target[s], key, k, n) for copy in (0, 1)]
    out, total = [], 0
    for _, _, k, n in sorted(queue):
        total += n
        if total > budget:
            break
        out.append(k)
    return out


def test_run_takes_effect_stage_by_stage(spark, tmp_path):
    good = prose(12, 5, 120)
    edited = [g.replace(g.split()[7], "changed", 1) for g in good[:3]]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate([*good, *edited, good[4], "too short", "again and again " * 60])]
    rows = [(k, f"{t}\nAll rights of this page are reserved {k}", *x) for k, t, *x in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "sf").mkdir()
    df.write.parquet(f"{tmp_path}/sf/documents.parquet")
    now, kept = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), df.schema)
        kept[name] = sorted(r["doc_id"] for r in now.collect())
    assert kept["quality rules"] == list(range(16))
    texts = {r["doc_id"]: r["text"] for r in spark.createDataFrame(corpus_pipeline.line_dedup(spark, df, "").collect(), df.schema).collect()}
    assert texts[3] == good[3] and texts[0].endswith("reserved 0")
    firsts = [k for k, (_, c) in enumerate(jaccard_components([texts[k] for k in range(16)], 5, 8, 10)) if c == k]
    assert kept["n-gram Jaccard join"] == firsts and 12 not in firsts and 15 not in firsts
    out = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    mixed = mixed_plainly([(k, f"s{k % 2}", len(texts[k].split())) for k in firsts])
    assert sorted(r["doc_id"] for r in out) == kept["mixing"] == sorted(mixed)
    library = sentencepiece.SentencePieceProcessor(model_proto=registry.piece_model())
    assert all(r["piece_ids"] == library.encode(texts[r["doc_id"]]) and r["n_chars"] == len(texts[r["doc_id"]]) for r in out)
    assert all(r["round_trip"] and r["parity"] and r["n_odd"] == 0 and len(r["piece_ids"]) == r["n_pieces"] for r in out)


def test_empty_documents_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
