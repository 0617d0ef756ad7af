"""URL lists, SimHash groups, language ID and the mixture against plain Python."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_fixtures import WORDS, frame, prose
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from siftline.llm import langid, mixing, simhash, stages, url_filter
from siftline.llm import textops as tx
from siftline.llm.rows import row_key

# --- 1


def decide(url, rules):
    """(decision, rule) straight from the definition: every rule against the URL."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
        host = (parts.netloc.rpartition("@")[2].partition(":")[0]).lower().rstrip(".")
    except ValueError:
        return "none", None
    if not host:
        return "none", None
    labels, segments = host.split("."), [x for x in parts.path.split("/") if x]
    best = None
    for pattern, kind in rules:
        h, _, path = pattern.strip().partition("/")
        h, own = h.lower().rstrip("."), [x for x in path.split("/") if x]
        n = len(h.split("."))
        if h and labels[-n:] == h.split(".") and segments[: len(own)] == own:
            rank = (n + len(own), n, kind == "block", "/".join([h, *own]))
            best = max(best or rank, rank)
    return ("none", None) if best is None else ("block" if best[2] else "allow", best[3])


def some_host(rng, n=3):
    return ".".join(str(rng.choice(["a", "b", "c", "example", "www"])) for _ in range(int(rng.integers(1, n + 1)))) + "." + str(rng.choice(["com", "org"]))


@pytest.mark.parametrize("limit", [1_000_000, 100])
def test_large_rule_tables_by_trie_and_by_join(spark, limit):
    rng = np.random.default_rng(3)
    path = lambda: "/".join(str(rng.choice(["x", "y", "z", ""])) for _ in range(int(rng.integers(0, 4))))
    rules = sorted({(f"{some_host(rng, 4)}/{path()}", str(rng.choice(["allow", "block"]))) for _ in range(3000)})
    rules += [("  A.example.com. \n", "block"), ("\tb.example.com/x//y/ ", "allow"), ("c.org", "allow"), ("c.org", "block")]
    urls = [f"http://{some_host(rng, 5)}/{path()}?q=1#f" for _ in range(400)] + ["http://a.example.com/" + "x/" * 5000, "http://" + "a." * 3000 + "com", "http://u@b.example.com:80//x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "pattern string, kind string")
    found = {r["page_id"]: (r["decision"], r["rule"]) for r in url_filter.url_filter(pages, table, limit=limit).collect()}
    for i, url in enumerate(urls):
        assert found[i] == decide(url, rules), url[:100]


@pytest.mark.parametrize("limit", [100, 0])
@pytest.mark.parametrize("kind", ["deny", None])
def test_wrong_kinds_are_errors_on_both_ways(spark, limit, kind):
    rules = spark.createDataFrame([("a.com", "allow"), ("b.com", kind)], "pattern string, kind string")
    pages = spark.createDataFrame([(1, "http://a.com")], "page_id long, url string")
    with pytest.raises((SparkRuntimeException, PythonException), match="a rule is allow or block"):
        url_filter.url_filter(pages, rules, limit=limit).collect()


# --- 2


def brute_groups(texts, budget=simhash.BUDGET, total=simhash.TOTAL):
    """Group of each text: word weights, signs, all pairs and their components, in plain Python."""
    bags = [Counter(h >> 16 for h in tx.hash_words(t)) for t in texts]
    n = len(texts)
    df = Counter(w for b in bags for w in b)
    weight = lambda w: 1.0 if df[w] < n * simhash.COMMON else float(np.clip((np.log(max(df[w] / n, simhash.COMMON)) / np.log(simhash.COMMON)) ** 2, 0.003, 1))
    prints = []
    for bag in bags:
        if not bag:
            prints.append(None)
            continue
        sums = np.zeros(128)
        for w, tf in bag.items():
            x = np.array([w], dtype=np.uint64)
            bits = np.unpackbits(np.stack([tx.mix(x), tx.mix(x ^ np.uint64(0x5DEECE66D1234567))], axis=1).view(np.uint8).reshape(16))
            sums += (bits - 0.5) * np.float32(weight(w)) * tf
        prints.append(np.packbits(sums > 0).view(np.uint64))
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations([i for i in range(n) if prints[i] is not None], 2):
        near, far = (int(np.bitwise_count(prints[i][k] ^ prints[j][k])) for k in (0, 1))
        if near <= budget and near + far <= total:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(n)]


def test_groups_match_all_pairs_of_fingerprints(spark):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(40):
        words = prose(int(rng.integers(20, 120)), rng).split()
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 6))):
                copy[at] = str(rng.choice(WORDS))
            texts.append(" ".join(copy))
    texts += ["", "?!"]
    found = {r["doc_id"]: (r["group_id"], r["keep"]) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    want = brute_groups(texts)
    assert [found[i][0] for i in range(len(texts))] == want
    assert [found[i][1] for i in range(len(texts))] == [g == i for i, g in enumerate(want)]


# --- 4


def test_held_out_languages(spark):
    """Fitted on two thirds of the documents; the rest, and a language that wasn't there, are judged."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 200")
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    model = langid.fit(docs.where(third != 0))
    rows = docs.where(third == 0).join(langid.identify(docs.where(third == 0), model).select("doc_id", F.col("lang").alias("found")), "doc_id").select("lang", "found").collect()
    right = np.mean([r["lang"] == r["found"] for r in rows])
    assert len(rows) > 1500 and right >= 0.95, right
    for out in ("en", "fr"):
        model = langid.fit(docs.where(F.col("lang") != out))
        foreign = langid.identify(docs.where(F.col("lang") == out), model).select("lang").collect()
        assert np.mean([r["lang"] == "und" for r in foreign]) >= 0.97, out


def test_nearest_centroid_by_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        data, off = tx.string_buffers(__import__("pyarrow").array([r["text"]]), True)
        counts = langid.gram_counts(data, off)[0]
        v = np.log1p(counts) * model.idf
        cos = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        best = int(cos.argmax())
        assert found[r["doc_id"]]["lang"] in (model.languages[model.owner[best]], "und")
        if counts.sum():
            assert found[r["doc_id"]]["score"] == pytest.approx(float(cos[best]), rel=1e-4)


# --- 7


def brute_mixture(rows, weights, keys, repeats=mixing.MAX_REPEATS):
    """(doc_id, source) -> uses. ``rows`` are (doc_id, source, text), ``keys`` gives a text's place in the seeded order."""
    texts = {}
    for d, s, t in rows:
        if d is not None and s is not None and t is not None and t.split():
            own = texts.setdefault(t, [d, set()])
            own[0] = min(own[0], d)
            own[1].add(s)
    patterns = defaultdict(list)
    for t, (d, sources) in texts.items():
        patterns[tuple(sorted(sources))].append((keys[d], d, len(t.split())))
    known = sorted(patterns.items(), key=lambda p: (-sum(x[2] for x in p[1]), list(p[0])))
    supply = [float(sum(x[2] for x in own)) for _, own in known]
    names = sorted(weights)
    members = [tuple(names.index(s) for s in p if s in names) for p, _ in known]
    quota = [weights[s] / sum(weights.values()) * sum(supply) for s in names]
    out = {}
    for (_, own), flow, whole in zip(known, mixing.solve(supply, members, quota, repeats), supply, strict=True):
        lo = 0.0
        for s in sorted(flow):
            hi, place = lo + flow[s], 0.0
            for _, d, n in sorted(own):
                uses = sum(lo <= place + j * whole < hi for j in range(repeats + 1))
                if uses:
                    out[d, names[s]] = uses
                place += n
            lo = hi
    return out


def test_drawn_documents_match_the_plan(spark):
    rng = np.random.default_rng(31)
    texts = [prose(int(rng.integers(3, 60)), rng) for _ in range(120)]
    rows = [(i, f"s{rng.integers(0, 5)}", texts[int(rng.integers(0, len(texts)))]) for i in range(300)] + [(900, None, texts[0]), (901, "s1", None), (902, "s1", " "), (None, "s2", "no id")]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"s0": 0.5, "s1": 0.2, "s2": 0.2, "s3": 0.05, "absent": 0.05}
    order = docs.select("doc_id", F.xxhash64(F.lit(0), F.col("doc_id"), F.xxhash64("text")).alias("u")).where("doc_id is not null").collect()
    keys = {r["doc_id"]: (r["u"] >> 52 & 0xFFF, r["u"]) for r in order}
    want = brute_mixture(rows, weights, keys)
    found = mixing.mix(docs, weights)
    assert {(r["doc_id"], r["source"]): r["uses"] for r in found.collect()} == want and len(want) > 50
    assert any(n > 1 for n in want.values())
    drawn = stages.draw_mixture(docs, weights)
    assert {(r["doc_id"], r["mix_source"]): r["mix_uses"] for r in drawn.collect()} == want


def test_rows_that_share_an_id_are_drawn_by_text(spark):
    rows = [(1, "alpha beta gamma", "s0"), (1, "other words of one id", "s1"), (2, "alpha beta gamma", "s0"), (1, "alpha beta gamma", "s0"), (1, "alpha beta gamma", None)]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    drawn = stages.draw_mixture(docs, {"s0": 1.0}).collect()
    assert {(r["doc_id"], r["text"], r["source"]) for r in drawn} == {(1, "alpha beta gamma", "s0")} and len(drawn) == 1
    both = stages.draw_mixture(docs, {"s0": 0.5, "s1": 0.5}).collect()
    assert {(r["doc_id"], r["text"]) for r in both} == {(1, "alpha beta gamma"), (1, "other words of one id")}


def test_row_keys_tell_ids_and_texts_apart(spark):
    rows = [(None, None), (None, ""), (1, None), (1, ""), (1, "a"), (2, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.select(row_key().alias("k")).where("k is not null").count() == 6
    assert df.where("doc_id is not null and text is not null").select(row_key().alias("k")).distinct().count() == 3
