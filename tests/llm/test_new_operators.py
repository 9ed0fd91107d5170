"""Yinyang clusters, the skip-chain field and impact-ordered search against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetspan.llm import impact_search, registry, skip_chain, yinyang


def lloyd(rows, k, rounds, scale=64.0):
    """(id -> (cluster, distance)) and centroids by plain Lloyd rounds over Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centre = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(centre)) for _, v in kept]
        if step < rounds:
            for j in range(len(centre)):
                own = [v for (_, v), (_, g) in zip(kept, at, strict=True) if g == j]
                if own:
                    centre[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return {i: (j, d) for (i, _), (d, j) in zip(kept, at, strict=True)}, centre


def vectors(n, seed=0, spread=0.3):
    random_ = np.random.default_rng(seed)
    centre = random_.normal(size=(9, 64))
    return [(k, (centre[k % 9] + spread * random_.normal(size=64)).astype(np.float32).tolist()) for k in range(n)]


def test_yinyang_equals_lloyd(spark):
    rows = vectors(400)
    same = rows[3][1]
    rows += [(1000 + k, same) for k in range(150)] + [(2000, None), (2001, same[:63]), (2002, [*same[:63], None]), (2003, [*same[:63], float("nan")]), (2004, [*same[:63], float("inf")]), (2005, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(5)
    want, centre = lloyd(rows, 16, 3)
    got = {r["vec_id"]: r for r in yinyang.clustered(df).collect()}
    assert {i: (r["cluster"], r["distance"]) for i, r in got.items()} == want
    for r in got.values():
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centre[r["cluster"]])).encode()).hexdigest()
        assert r["inertia"] == sum(d for _, d in want.values()) and r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"])


def test_yinyang_filters_pass_over_most_distances(spark):
    rows = vectors(3000, 1, 0.05)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, _, measured = yinyang.cluster(df, k=30, rounds=8, groups=6)
    assert {r["id"]: (r["cluster"], r["distance"]) for r in found.collect()} == lloyd(rows, 30, 8)[0]
    assert measured[0] == 3000 * 30 and measured[-1] < 0.2 * measured[0]


def test_yinyang_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert yinyang.clustered(empty).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, [0.25] * 64), (2, [3e38] * 64)], "vec_id long, embedding array<float>")
    out = yinyang.clustered(few).collect()
    assert len(out) == 3 and {r["distance"] for r in out} <= {0, 64 * 16 * 16}
    huge = (np.arange(128).reshape(2, 64) % 7 - 3) * ((1 << 26) // 4)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in huge] for x in huge]
    assert yinyang.squared(huge, huge).tolist() == exact


def test_yinyang_query_on_a_written_table(spark, tmp_path):
    rows = vectors(300, 2)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in registry.op11_yinyang(spark, str(tmp_path)).collect()}
    assert got == lloyd(rows, 16, 3)[0]


# Personal data

_BASE = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_luhn(digits):
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_patterns(text):
    out = []
    for kind, pattern in enumerate(_BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(digits) <= 19 and plain_luhn(digits or "0"), 8 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns_equal_the_plain_expressions():
    random_ = random.Random(5)
    for _ in range(20_000):
        text = "".join(random_.choice("19.5 -+@ab()4é") for _ in range(random_.randint(0, 40)))
        assert skip_chain.patterns(text) == plain_patterns(text), text
    card = "4111 1111-1111 1111"
    assert skip_chain.patterns(f"x {card}.") == [(2, 2, 2 + len(card))]


@pytest.mark.parametrize("text", ["x" * 300_000, "9" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "@" * 100_000])
def test_long_texts_take_linear_time(text):
    skip_chain.Graph(text)


def test_marginals_are_exact_on_a_tree():
    graph = skip_chain.Graph("call +1 (017) 555-7713 or 4111111111111111 now")
    graph.seen[:] = 0
    n, rng = len(graph.core), np.random.default_rng(3)
    index = {x: k + 1 for k, x in enumerate(sorted({y for own in graph.features() for y in own}))}
    node = rng.normal(size=(len(index) + 1, 5))
    node[0] = 0
    field = skip_chain.Field(index, node, rng.normal(size=(5, 5)), np.zeros((5, 5)))
    own = skip_chain._scores(node, field.numbers(graph.features()))
    want = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        weight = math.exp(sum(own[k, x] for k, x in enumerate(labels)) + sum(field.chain[labels[k - 1], labels[k]] for k in graph.chain))
        want[range(n), labels] += weight
    assert not graph.skips and graph.chain and np.allclose(skip_chain.marginals(field, [graph]), want / want.sum(1, keepdims=True), atol=1e-6)


def test_a_skip_edge_carries_a_label_to_the_next_mention():
    graph = skip_chain.Graph("write to jo.7@mail.example.com please. Ask jo.7 again, or tel 99.")
    agree = 4 * np.eye(5)
    field = skip_chain.Field({"1": 1}, np.array([[0.0] * 5, [1.0, 0, 0, 0, 0]]), np.zeros((5, 5)), agree)
    p = skip_chain.marginals(field, [graph])
    assert [x.argmax() for x in p] == [1, 1, 0]


def make_docs(spark):
    random_ = random.Random(7)
    words = ["".join(random_.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    number = lambda ok: next(x for x in iter(lambda: "".join(random_.choice("0123456789") for _ in range(16)), None) if plain_luhn(x) == ok)
    phone = lambda: f"+1 ({random_.randint(100, 999)}) 555-{random_.randint(1000, 9999)}"
    address = lambda: ".".join(str(random_.randint(1, 255)) for _ in range(4))
    rows = []
    for k in range(600):
        text = [random_.choice(words) for _ in range(60)]
        for _ in range(2):
            text.insert(random_.randint(0, 59), random_.choice([number(True), number(False), phone(), address(), f"{random_.choice(words)}.{random_.randint(1, 99)}@mail.example.com", "2.0.", "version 3"]))
        rows.append((k, " ".join(text)))
    good = [number(True), number(True)]
    rows += [(1000, f"see {good[0]} {good[1]} there"), (1001, "tel +1 (017) 555-7713 12.13.14.15 end"), (1002, f"plain words, a number {number(False)} and version 2.0."), (1003, None), (1004, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_the_field_adds_what_patterns_miss_and_leaves_the_rest(spark):
    rows, df = make_docs(spark)
    found = skip_chain.find(df)
    out = {r["doc_id"]: r for r in skip_chain.digest(found).collect()}
    assert len(out) == len(rows)
    for k, text in rows:
        base = [f"{skip_chain.KINDS[a]}:{b}:{c}" for a, b, c in plain_patterns(text or "")]
        assert out[k]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, out[k]["spans"].split(",")))
        assert [out[k][f"n_{x}"] for x in skip_chain.KINDS] == [sum(s.startswith(x) for s in base) for x in skip_chain.KINDS]
    assert out[1000]["spans"] == "card:4:20,card:21:37" and out[1000]["n_card"] == 0
    assert out[1001]["spans"] == "ip:22:33,phone:4:21" and out[1001]["n_phone"] == 0
    assert not out[1002]["spans"] and not out[1003]["spans"] and not out[1004]["spans"]
    clean = {r["doc_id"]: r["text"] for r in skip_chain.redact(found).collect()}
    assert clean[1001] == "tel <phone> <ip> end" and clean[1002] == rows[-3][1] and clean[1003] is None
    added = sum(len(set(out[k]["spans"].split(",")) - {f"{skip_chain.KINDS[a]}:{b}:{c}" for a, b, c in plain_patterns(t or "")} - {""}) for k, t in rows[:600])
    assert added <= 6  # hardly anything in documents where patterns find all


def test_spans_query_on_a_written_table(spark, tmp_path):
    rows, df = make_docs(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["base_sha256"] for r in registry.op12_skip_chain(spark, str(tmp_path)).collect()}
    assert out == {k: hashlib.sha256(",".join(f"{skip_chain.KINDS[a]}:{b}:{c}" for a, b, c in plain_patterns(t or "")).encode()).hexdigest() for k, t in rows}


def test_texts_without_tokens_need_no_field(spark):
    df = spark.createDataFrame([(1, "no numbers"), (2, None)], "doc_id long, text string")
    assert [r["pii"] for r in skip_chain.find(df).collect()] == [[], []]
    assert skip_chain.find(df.limit(0)).count() == 0


# Search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    lists = [(i, Counter(plain_terms(t))) for i, t in docs]
    lists = [(i, c) for i, c in lists if c]
    n_docs, total = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(w for _, c in lists for w in c)
    out = set()
    for item, text in items:
        query, scores = Counter(plain_terms(text)), []
        for i, c in lists:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, q in query.items() if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])}
    return out


def corpus(n=700, seed=1):
    random_ = random.Random(seed)
    words = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(300)]
    pick = lambda size: " ".join(words[min(299, int(random_.expovariate(0.02)))] for _ in range(size))
    docs = [(k, pick(random_.choice([3, 20, 80, 300]))) for k in range(n)]
    hot = docs[5][1]
    docs += [(5000 + k, hot) for k in range(n // 3)] + [(9000, None), (9001, ""), (9002, " .,! "), (None, docs[7][1]), (9003, "w1 " * 20_000), (9004, "w2\x00w3_w4-W5")]
    items = [(k, docs[k][1][:200]) for k in range(25)] + [(100, pick(30)), (101, None), (102, "zzz"), (103, "w1 w1 w1 W1")]
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(6)
    q = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = plain_search(docs, items)
    got = [tuple(r) for r in impact_search.search(d, q).select("item_id", "rank", "doc_id", "score").collect()]
    assert set(got) == want and len(got) == len(want)
    blocks = impact_search.search(d, q, query_bytes=1500)
    assert {tuple(r) for r in blocks.select("item_id", "rank", "doc_id", "score").collect()} == want


def test_search_stops_early_and_is_still_exact():
    random_ = np.random.default_rng(4)
    n, vocabulary = 3000, 400
    rows = [np.unique(random_.integers(0, vocabulary, 40)) for _ in range(n)]
    rows[77] = np.arange(60)
    starts, term = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    tf, weight = random_.integers(1, 5, len(term)), random_.integers(1, 4000, vocabulary)
    tf[starts[77] : starts[78]] = 6
    length = np.array([len(r) for r in rows])
    block = impact_search.Block(np.arange(n), np.zeros(n, bool), length, starts, term, tf, weight, n, int(length.sum()))
    query = [(t, 1 + t % 2) for t in range(60)]
    want = sorted((-sum(c * int(i) for t, c in query for i in block.impact[starts[r] : starts[r + 1]][rows[r] == t]), r) for r in range(n))[:3]
    postings = sum(b - a for t, _ in query for a, b in [block.place[t]])
    assert [(-s, r) for r, s in block.top(query, 3, 1)] == want
    block.read = 0
    assert block.top(query, 1, 1) == [(77, -want[0][0])] and 0 < block.read < postings
    assert block.top(query, 3, -want[0][0] + 10**12) == []


def test_search_odd_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert impact_search.search(docs, items).count() == 0
    assert impact_search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_search_query_on_a_written_table(spark, tmp_path):
    docs, items = corpus(200, 2)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.op13_impact_search(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()
    assert {tuple(r) for r in got} == plain_search(docs, items)
