"""The training-data operators against brute-force versions, and on odd rows."""

import functools
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetspan.llm import lattice, line_templates, mixing, pieces, quality_rules, registry, shards, shingle_join, token_files, tree_weighting, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "  \n ", "one", "a b", "A b", "x y z " * 40, "The cat sat.\nThe cat sat.\nÜber ñ 🙂", "tab\tand\x0bvt " * 30, "word " * 5000, "a\n\nb  c\r\nd", "dup dup dup", "x y z " * 40]


def docs(spark, texts=TEXTS, n_parts=3):
    rows = [(k, t, ["s1", "s2", None][k % 3], "en" if k % 2 else None, len(t or ""), 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size long").repartition(n_parts)


def prose(n, seed=0, words=120):
    random = np.random.default_rng(seed)
    vocabulary = ["".join(random.choice(list("abcdefgh"), 5)) for _ in range(400)]
    return [" ".join(random.choice(vocabulary, words)) for _ in range(n)]


def test_quality_measures(spark):
    out = {r["doc_id"]: r for r in quality_rules.judge(docs(spark)).collect()}
    assert len(out) == len(TEXTS) and out[0]["size"] == 7
    for k, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        threes = list(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, x in enumerate(threes) if threes.count(x) > 1 for j in range(3)} if len(w) < 1000 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(docs(spark).limit(0)).count() == 0


def test_hosts_with_bad_documents_are_rejected(spark):
    rows = [(k, "good words here " + prose(1, k)[0], "good") for k in range(60)] + [(100 + k, "short", "bad") for k in range(60)] + [(200, prose(1, 99)[0], "bad")]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[k] for k in range(60)) and not out[200]


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q", "https://net/", "http://xnet/", "ftp://b.org#f", "http://c.org/fr/", "http://www.example.com/de/1", "http://example.com/den", "x://y://z"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for judge in (lambda: url_filter.judge(df, rules), lambda: url_filter.judge_in_parts(df, spark.createDataFrame(rules, "host string, path string, verdict string"), part_bytes=60)):
        out = [(r["_host"], r["path"], r["rule"], r["verdict"]) for r in judge().orderBy("page_id").collect()]
        assert out == [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("net", "/", "net/", "block"), ("xnet", "/", None, "allow"), ("b.org", "", None, "allow"), ("c.org", "/fr/", "org/fr/", "allow"), ("www.example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/den", None, "allow"), ("y:", "//z", None, "allow")]


def test_both_ways_of_judging_agree(spark):
    rules = [("a.org", "/�/", "block"), ("a.org", "/", "allow"), ("Example.COM", "/Äb", "block"), ("x.net", "/é", "block"), ("x.net", "/", "allow"), ("ÄÖ.de", "", "block"), ("org", "/�", "allow"), ("example.com", "/Äb", "block")]
    urls = ["http://a.org/�/x", "http://a.org/�", "http://b.org/�x", "http://EXAMPLE.com/Äbc", "http://www.Example.com/Äb", "http://x.net/é", "http://x.net/è", "http://x.net/e", "http://ÄÖ.de/", "http://äö.de/", "http://x.net/🙂", "http://a.org/\U0001f642�/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    plain = [tuple(r) for r in url_filter.judge(df, rules).orderBy("page_id").collect()]
    for size in (40, 200, 1 << 20):
        assert [tuple(r) for r in url_filter.judge_in_parts(df, table, part_bytes=size).orderBy("page_id").collect()] == plain
    assert [r[4:] for r in plain] == [("a.org/�/", "block"), ("org/�", "allow"), ("org/�", "allow"), ("example.com/Äb", "block"), ("example.com/Äb", "block"), ("x.net/é", "block"), ("x.net/", "allow"), ("x.net/", "allow"), ("ÄÖ.de", "block"), (None, "allow"), ("x.net/", "allow"), ("a.org/", "allow")]


def test_parity_verifies_and_repairs_only_if_asked():
    data = registry.piece_model()

    class Other:
        """A library that gives one segment other ids."""

        def __init__(self, own):
            self.own = own

        def encode(self, texts, **options):
            return [[5, *x] if "planted" in t else x for t, x in zip(texts, self.own.encode(texts, **options), strict=True)] if isinstance(texts, list) else self.own.encode(texts)

    text = ["a planted segment and others, planted", "none of it"]
    want, n = pieces.Codec(data, verify=False).encode(text)
    codec = pieces.Codec(data)
    codec.checked = Other(codec.checked)
    got, m = codec.encode(text)
    assert np.array_equal(got, want) and np.array_equal(m, n)
    assert len(codec.odd) == 1 and len(codec.odd & codec.segments(text[0])) == 1 and not codec.odd & codec.segments(text[1])
    mended = pieces.Codec(data, repair=True)
    mended.checked = Other(mended.checked)
    assert mended.encode(["planted"])[0].tolist() == [5, *pieces.Codec(data).encode(["planted"])[0]]


@pytest.mark.parametrize("dim", [16, 64, 384])
@pytest.mark.parametrize("cosine", [0.98, 0.981, 0.985, 0.99])
def test_recall_of_the_lattice_near_the_threshold(dim, cosine):
    random = np.random.default_rng([dim, int(cosine * 1000)])
    a, b = random.normal(size=(2, 2000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    start = np.full(2000, 3, np.uint64)
    (own_a, ask_a), (own_b, ask_b) = (lattice.cells(x, start, lattice.TABLES, lattice.PROBES, lattice.BLOCKS) for x in (a, b))
    met = (own_a == own_b) | (ask_a == own_b[:, :, None]).any(2) | (ask_b == own_a[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.998 and met.mean() >= 0.85


def test_digest_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: 7)  # every string has one digest
    store = url_filter.DigestStore(url_filter.DigestStore.build([("a", "/", "block"), ("b", "/", "allow"), ("c", "", "block")]))
    at = store.find([b"a/", b"b/", b"c", b"d/"])
    assert [store.string(k) if k >= 0 else None for k in at] == [b"a/", b"b/", b"c", None] and list(store.allow[at[:3]]) == [0, 1, 0]


def test_rules_without_a_path_and_a_store_in_parts(spark):
    rules = [("a.org", "", "block"), ("a.org", "/x/ä", "allow"), ("www.a.org", "", "allow"), *((f"h{k}.net", f"/{k}/", "block" if k % 2 else "allow") for k in range(300))]
    urls = [None, "", "http://a.org", "http://b.a.org/x/äö", "http://www.a.org/x/ä", "http://q.h7.net/7/7", "http://h8.net/8/", "http://h8.net/9/", "http://a.org", "http://" + "a." * 300 + "a.org/" + "x" * 30_000]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = [(None, "allow"), (None, "allow"), ("a.org", "block"), ("a.org/x/ä", "allow"), ("a.org/x/ä", "allow"), ("h7.net/7/", "block"), ("h8.net/8/", "allow"), (None, "allow"), ("a.org", "block"), ("a.org", "block")]
    for out in (url_filter.judge(df, rules), url_filter.judge_in_parts(df, table, part_bytes=500), url_filter.judge_in_parts(df, table)):
        assert [(r["_rule"], r["verdict"]) for r in out.orderBy("page_id").collect()] == want
    assert url_filter.judge(df.limit(0), rules).count() == url_filter.judge_in_parts(df.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=20_000, fan=2)
    for seed in range(4):
        store.append(docs(spark, prose(20, seed)), rows_per_shard=5)
    before = store.entries().count()
    version = store.compact()
    found = store.entries().orderBy("path").collect()
    assert len(found) < before and version == store.version() and store.pointer()["shards"] == len(found)
    assert sum(r["rows"] for r in found) == 80 and [r["shard"] for r in found] == list(range(len(found)))
    assert sorted(r["text"] for r in store.read().collect()) == sorted(t for s in range(4) for t in prose(20, s))
    assert store.read(4).count() == 80  # older versions stay readable until they are vacuumed
    store.vacuum()
    assert store.read().count() == 80
    base = store.pointer(version)
    store.append(docs(spark).limit(0))
    with pytest.raises(RuntimeError):
        store._commit(base, docs(spark).schema, store.entries().drop("shard"))


def test_shards_keep_the_columns_of_all_arrivals(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20, fan=2)
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], "doc_id long, path string"))
    assert store.read().count() == 0 and store.shard_table().count() == 0
    store.append(spark.createDataFrame([(1, "a", 7), (1, "a", 7), (None, None, None)], "doc_id long, text string, shard int"))
    store.append(spark.createDataFrame([(2, "b" * 5_000_000)], "doc_id long, text string"))
    store.append(spark.createDataFrame([("p", 3)], "path string, doc_id long"))
    for refused in ("doc_id string", "Text string"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], refused))
    store.compact()
    out = sorted((str(r["doc_id"]), len(r["text"] or ""), r["shard"], r["path"]) for r in store.read().collect())
    assert out == [("1", 1, 7, None), ("1", 1, 7, None), ("2", 5_000_000, None, None), ("3", 0, None, "p"), ("None", 0, None, None)]
    assert store.read().columns == ["doc_id", "path", "text", "shard"] and store.entries().count() < 3


def test_sharding_query(spark, tmp_path):
    df = docs(spark, prose(9000, 3, 8), 2)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.op4_sharding(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(texts) and all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in out)
    rows = {}
    for r in out:
        rows.setdefault(r["shard"], []).append(r["shard_rows"])
    assert all(set(x) == {len(x)} for x in rows.values()) and sorted(rows) == list(range(len(rows))) and len({r["version"] for r in out}) == 1


def test_mixing_targets_and_uses(spark):
    texts = [None, ""] + prose(60, 1, 50) + prose(3, 2, 400)
    rows = [(k, t, None if k % 7 == 0 else f"s{k % 4}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.shares(df).collect()
    assert len(out) == len(rows) and [r["taken"] for r in sorted(mixing.shares(df.repartition(7)).collect())] == [r["taken"] for r in sorted(out)]
    sizes = {}
    for k, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, open_ = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}, set(order)
    target, left = {}, 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
        if not open_:
            break
    target |= {s: level * weight[s] for s in open_}
    taken = {}
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 800 for s in target)
    assert mixing.mix(df).count() == sum(r["taken"] // r["size"] for r in out if r["size"])
    assert mixing.shares(df.limit(0)).count() == 0


def test_mixing_takes_single_rows_of_a_repeated_id(spark):
    rows = [(5, f"w{k} " * 10, "a", k, "x") for k in range(300)] + [(None, "w " * 10, "a", k, "x") for k in range(300)] + [(k, "w " * 10, "b", k, "x") for k in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m_row int, size string").repartition(5).cache()
    out = mixing.shares(df).collect()
    for source in "ab":
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() * 10 == sum(r["taken"] for r in out)
    df.unpersist()


def jaccard_components(texts, size, num, den):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(up))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else zip(*(w[j:] for j in range(size)), strict=False)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("size, num, den", [(3, 9, 10), (5, 8, 10)])
def test_jaccard_join(spark, size, num, den):
    random = np.random.default_rng(4)
    texts = list(TEXTS)
    for words in (12, 40, 200):
        for base in prose(6, words, words):
            texts += [base, base, base.upper()]
            for edits in (1, 1, 2, 4, 8):
                w = base.split()
                for k in random.integers(0, len(w), edits):
                    w[k] = f"new{random.integers(1000)}"
                texts.append(" ".join(w))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.join(docs(spark, texts), size=size, num=num, den=den).collect()}
    assert [out[k] for k in range(len(texts))] == jaccard_components(texts, size, num, den)
    assert shingle_join.join(docs(spark).limit(0)).count() == 0


def test_tree_weighting_follows_its_definition(spark):
    texts = [None, "ab abc", "Ab x", "ab abc abd ab", "zz"]
    df = docs(spark, texts, 2)
    out = {r["doc_id"]: r for r in tree_weighting.score(df, F.col("doc_id") == 4).collect()}
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    coded = [[b"\0" * 5 + b" " + w + (b" " if w else b"\n") for w in own] for own in tokens]

    def events(words):
        for w in words:
            for p in range(6, len(w)):
                for k in range(8):
                    yield w[p - 6 : p], (1 << k) | (w[p] >> (8 - k)), (w[p] >> (7 - k)) & 1

    counts = {}
    for own in coded[:4]:
        for c, node, bit in events(own):
            for d in range(7):
                counts.setdefault((c[6 - d :], node), [0, 0])[bit] += 1
    children = {}
    for c, node in counts:
        if c:
            children.setdefault((c[1:], node), []).append((c, node))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def mixed(key):
        own = kt(*counts[key])
        if len(key[0]) == 6:
            return own
        return np.logaddexp(own, sum(map(mixed, children.get(key, [])))) - math.log(2)

    def predict(c, node, bit, d=0):
        key = (c[6 - d :], node)
        n = counts.get(key, [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == 6:
            return own
        below = sum(map(mixed, children.get(key, [])))
        w = 1 / (1 + math.exp(below - (kt(*n))))
        return w * own + (1 - w) * predict(c, node, bit, d + 1)

    for k, own in enumerate(coded):
        expected = sum(math.log10(predict(*e)) for e in events(own))
        assert out[k]["score"] == pytest.approx(expected, rel=1e-5)
        train = [w for x in tokens[:4] for w in x]
        base = sum(math.log10((train.count(w) + 1) / (len(train) + len(set(train)) + 1)) for w in tokens[k])
        assert out[k]["base_score"] == pytest.approx(base) and out[k]["n_tokens"] == len(tokens[k]) and out[k]["train_tokens"] == len(train)
        assert out[k]["n_known"] == sum(w in train for w in tokens[k])
    assert tree_weighting.score(df.limit(0), F.lit(False)).count() == 0


def coded_plainly(trained, texts):
    """log10 probabilities of the texts under context trees over token edges, learnt from the trained texts."""
    counts = {}

    def events(text):
        data = b"\0" * 5 + b" " + b"".join(w + b" " for w in (text or "").lower().encode().split()) + b"\n"
        for p in range(6, len(data)):
            for k in range(8):
                yield data[p - 6 : p], (1 << k) | (data[p] >> (8 - k)), (data[p] >> (7 - k)) & 1

    for text in trained:
        for c, node, bit in events(text):
            for d in range(7):
                counts.setdefault((c[6 - d :], node), [0, 0])[bit] += 1
    children = {}
    for c, node in counts:
        if c:
            children.setdefault((c[1:], node), []).append((c, node))

    @functools.cache
    def below(key):
        return sum(map(mixed, children.get(key, [])))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def mixed(key):
        own = kt(*counts[key])
        return own if len(key[0]) == 6 else np.logaddexp(own, below(key)) - math.log(2)

    def predict(c, node, bit, d=0):
        key = (c[6 - d :], node)
        n = counts.get(key, [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == 6:
            return own
        w = 1 / (1 + math.exp(min(700.0, below(key) - kt(*n))))
        return w * own + (1 - w) * predict(c, node, bit, d + 1)

    return [sum(math.log10(predict(*e)) for e in events(text)) for text in texts]


def test_tree_weighting_across_tokens(spark):
    texts = ["ab cd ab  cd", "Ab cd\nef", None, "cd ab", "ab cd", "x"]
    out = {r["doc_id"]: r["score"] for r in tree_weighting.score(docs(spark, texts, 2), F.col("doc_id") > 2, across=True).collect()}
    assert [out[k] for k in range(len(texts))] == pytest.approx(coded_plainly(texts[:3], texts), rel=1e-5)
    assert out[4] > out[3] + 0.1  # the same words in an order met in training, and in another


def test_lines(spark):
    body = prose(8, 3, 30)
    license_ = "Licensed under the example license version"
    texts = [f"{b}\n{license_} {k}\nfooter line number {k} of the page" for k, b in enumerate(body)] + [None, "", body[0]]
    out = {r["doc_id"]: r for r in line_templates.clean(docs(spark, texts)).collect()}
    assert out[0]["n_dropped"] == 0 and all(out[k]["n_dropped"] == 2 and out[k]["text"] == body[k] for k in range(1, 8))
    assert out[8]["text"] is None and out[9]["text"] == "" and out[10]["n_dropped"] == 0
    assert line_templates.dedup(docs(spark, ["same boilerplate words here"] * 4)).count() == 1
    assert line_templates.clean(docs(spark).limit(0)).count() == 0


def test_template_with_a_varying_word(spark):
    texts = [f"{b}\nwritten by the author {name} for this site" for b, name in zip(prose(5, 8, 20), ["ann", "bob", "cy", "dee", "eve"], strict=True)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_templates.clean(docs(spark, texts)).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_short_lines_of_equal_start_stay(spark):
    texts = [f"{b}\nThe house was {x}" for b, x in zip(prose(5, 9, 20), ["sold.", "old.", "empty that year.", "cold that night.", "burnt."], strict=True)]
    out = {r["doc_id"]: r for r in line_templates.clean(docs(spark, texts)).collect()}
    assert all(out[k]["n_dropped"] == 0 and out[k]["text"] == t for k, t in enumerate(texts))
    assert line_templates.dedup(docs(spark, ["We met at noon", "We met at dawn", "We met at sea"])).count() == 3


def test_a_leaf_holds_several_templates(spark):
    names = ["ann", "bob", "cy", "dee"]
    families = [[f"see the page of {x} for more" for x in names], [f"see the page about {x} in detail" for x in names]]
    clean = [f"see the page {t}" for t in ("xa xb xc xd", "ya yb yc yd", "za zb zc zd", "ua ub uc ud", "va vb vc vd", "ra rb rc rd", "sa sb sc sd", "ta tb tc td", "of qb qc qd")]
    texts = [f"{b}\n{line}" for b, line in zip(prose(17, 10, 20), [*families[0], *families[1], *clean], strict=True)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_templates.clean(docs(spark, texts)).collect()}
    assert out == {k: int(k in (1, 2, 3, 5, 6, 7)) for k in range(17)}


def test_counts_of_long_and_short_lines(spark):
    body, passage = prose(14, 11, 20), prose(1, 12, 60)[0]
    texts = [f"{b}\nLes.\nTwo words" if k < 12 else f"{b}\nTwo words" for k, b in enumerate(body)]
    texts[2] += f"\n{passage}"
    texts[5] = f"{passage}\n{texts[5]}"
    texts += [f"{body[0]}\nRare line", f"{body[1]}\nRare line", f"{prose(1, 13, 60)[0]}\n\n", prose(1, 13, 60)[0]]
    out = {r["doc_id"]: r for r in line_templates.clean(docs(spark, texts)).collect()}
    assert [out[k]["n_dropped"] for k in range(18)] == [0, 2, 2, 2, 2, 3, *[2] * 6, 1, 1, 0, 0, 0, 0]
    assert passage in out[2]["text"] and out[5]["text"] == body[5] and out[17]["text"] == texts[17]

@pytest.mark.parametrize("num, n", [(8, 566), (8, 58), (8, 1108), (9, 1082)])
def test_pairs_that_agree_in_empty_segments_alone_share_a_cell(num, n, monkeypatch):
    levels = shingle_join.Levels(num, 10)
    level = levels.of(n)[0]
    monkeypatch.setattr(levels, "of", lambda _: [level])  # in other levels such a set has far too many empty ones
    assert levels.last[level] == n
    m, apart = levels.segments(level), levels.apart(level)
    assert m == apart + levels.sure(level)
    place = lambda k: -(-(k << 32) // m) << 32  # noqa: E731  the first hash of segment k
    a = np.sort(np.array([place(j % apart) + 1 + j for j in range(n)], np.uint64))
    b = np.sort(np.concatenate([a, np.array([place(j) + 100_000 * 2**32 // m + 7 for j in range(apart)], np.uint64)]))  # one more in each that isn't empty
    b = shingle_join.distinct(b)
    assert 10 * len(a) >= num * len(b)
    keys = [set(np.concatenate(shingle_join.cells(x, levels)).tolist()) for x in (a, b)]
    assert keys[0] & keys[1]


def test_fine_groups_of_many_segments_stay_in_order():
    h = np.sort(np.random.default_rng(14).integers(0, 1 << 64, 50_000, dtype=np.uint64))
    for m in (5, 70_000, 3_000_000):
        fine, segment = shingle_join._fine(h, m)
        exact = [(int(x) >> 32) * m * shingle_join.FINE >> 32 for x in h]
        assert fine.tolist() == exact and segment.tolist() == [x // shingle_join.FINE for x in exact]


def links_plainly(rows):
    """Links and components of the rows (vector, label), by all pairs."""
    v32 = [None if v is None else np.asarray(v, np.float32).astype(float) for v, _ in rows]
    good = [k for k, (v, (_, y)) in enumerate(zip(v32, rows, strict=True)) if v is not None and y is not None and len(v) and np.isfinite(v).all() and v.any()]
    links, parent = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(good, 2):
        if rows[a][1] == rows[b][1] and len(v32[a]) == len(v32[b]) and v32[a] @ v32[b] / np.linalg.norm(v32[a]) / np.linalg.norm(v32[b]) >= 0.98:
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return links, [find(k) for k in range(len(rows))]


def test_lattice(spark):
    random = np.random.default_rng(6)
    base = random.normal(size=(40, 16))
    rows = []
    for k in range(40):
        rows += [(base[k], k % 3), (base[k] * 2, k % 3), (base[k] + random.normal(size=16) * 0.03, k % 3), (base[k] + random.normal(size=16) * 0.25, k % 3)]
    rows += [(base[0], 0), (base[0], None), (np.zeros(16), 0), (np.full(16, np.nan), 0), (np.full(16, np.inf), 1), (np.array([]), 1), (None, 1), (base[0][:8], 0)]
    df = spark.createDataFrame([(k, None if v is None else [float(x) for x in v], y) for k, (v, y) in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    links, firsts = links_plainly(rows)
    out = {r["vec_id"]: r for r in lattice.links(df).collect()}
    assert {k: r["n_links"] for k, r in out.items()} == links
    assert all(r["component_id"] == firsts[k] and r["kept"] == (k == firsts[k]) for k, r in out.items())
    assert lattice.links(df.limit(0)).count() == 0


def test_large_cells_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TILE", 8)
    random = np.random.default_rng(7)
    v = random.normal(size=16) + random.normal(size=(50, 16)) * 0.02
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    assert {(r["n_links"], r["component_id"]) for r in lattice.links(df).collect()} == {(49, 0)}


def test_e8_decoder_finds_the_nearest_point():
    y = np.random.default_rng(8).normal(size=(200, 8)) * 2
    point = lattice.decode(y)
    far = ((y[:, None] - (point[:, None] + lattice._NEAR[None])) ** 2).sum(2).min(1)
    assert (((y - point) ** 2).sum(1) <= far + 1e-9).all() and len(lattice._NEAR) == 240


tokenizers = pytest.importorskip("public_tokenizers")


def test_pieces_equal_the_library(spark):
    import sentencepiece

    data = open(tokenizers.path("piece_bpe_32k.model"), "rb").read()
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [*TEXTS, " " * 37 + "z", "▁▁x ▁", "aaaaaaa ---- ===== \x1f", "日本語 🙂🙂🙂", "<s> </s>"]
    out = {r["doc_id"]: r for r in pieces.encode(docs(spark, texts), data).collect()}
    for k, t in enumerate(texts):
        assert out[k]["piece_ids"] == own.encode(t or "") and out[k]["parity"] and out[k]["round_trip"]
    codec = pieces.Codec(data)
    library = codec.own.decoder
    for t in texts[3:8]:
        ids = own.encode(t)
        assert codec.decode(ids) == t and library.decode([own.id_to_piece(i) for i in ids])[1:] == t


def test_long_runs_are_merged_by_place():
    import sentencepiece

    data = open(tokenizers.path("piece_bpe_32k.model"), "rb").read()
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(data, verify=False)
    for n in (19_990, 20_000, 30_000):
        for t in (" " * n + "z", "a" * n, "ab" * n + "bbb"):
            assert codec.encode([t])[0].tolist() == own.encode(t), (n, t[:3])


def _message(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_parity_is_null_where_nothing_is_checked(spark):
    from sweetspan.llm import registry

    assert [r["parity"] for r in pieces.encode(docs(spark, ["a b"]), registry.piece_model(), verify=False).collect()] == [None]


def test_unigram_model_by_hand():
    import sentencepiece

    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.5), ("c", -5.0), ("ab", -5.5), ("▁a", -5.2), ("▁abc", -6.0), ("bc", -7.0)]] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    data = b"".join(_message(1, _message(1, p.encode()) + _message(2, s) + _message(3, kind)) for p, s, kind in vocabulary)
    data += _message(2, _message(3, 1) + _message(35, 1)) + _message(3, _message(1, b"identity") + _message(4, 0))
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(data, verify=False)
    for t in ["abc", "ab abc a  bc", "xab", "", "cab\nabc"]:
        assert codec.encode([t])[0].tolist() == own.encode(t), t


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    texts = [*TEXTS, "a\t\n b  c\n\n  d it's\x1c x.  y <|endoftext|> z ", "trail ", "n\n"] + prose(30, 9)
    files = token_files.TokenFiles(spark, token_files.new_folder(spark), path)
    files.write(docs(spark, texts))
    out, own, start = sorted(files.documents().collect()), Tokenizer.from_file(path), 0
    for k, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(out[k]) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = token_files.TokenFiles(spark, token_files.new_folder(spark), path)
    empty.write(docs(spark).limit(0))
    assert empty.documents().count() == 0


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_huffman_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 40_000)
    lengths = token_files.code_lengths(np.bincount(ids))
    assert lengths.max() <= 16 and sum(2.0 ** -lengths[lengths > 0]) <= 1 + 1e-12
    payload, checkpoints = token_files.pack(ids, lengths, token_files.canonical(lengths))
    assert (token_files.Decoder(lengths).unpack(payload, checkpoints, n) == ids).all()


def test_length_limit_is_optimal_where_it_does_not_bind():
    counts = np.array([5, 9, 12, 13, 16, 45])
    assert token_files.code_lengths(counts).tolist() == [4, 4, 3, 3, 3, 1]
    assert token_files.code_lengths(2 ** np.arange(24), 8).max() <= 8
