"""Each operator on small fixtures: brute force where SQL can't say it, and the defined edge cases."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import chat, decontaminate, langid, linededup, mixing, ngram_lm, quality, simhash, stages, url_filter
from siftline.llm import textops as tx
from siftline.llm.queries import op8_lm_score

from llm_fixtures import CLASH, DOCS, RNG, WORDS, empty, frame, odd_rows, prose

FILTERS = {
    "quality": stages.drop_low_quality,
    "lines": stages.drop_repeated_lines,
    "simhash": stages.drop_near_duplicates,
    "decontaminate": lambda d: stages.drop_contaminated(d, d.sparkSession.createDataFrame([(1, prose(20)), (None, "x y z"), (2, None), (3, "")], "item_id long, text string")),
    "mix": stages.draw_mixture,
}


@pytest.mark.parametrize("name", FILTERS)
def test_stages_take_odd_rows_and_empty_tables(spark, name):
    docs = odd_rows(spark)
    out = FILTERS[name](docs)
    added = ["mix_source", "mix_uses"] if name == "mix" else []
    assert [c for c in out.columns if c not in added] == [c for c in docs.columns if c not in added]
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
    none = FILTERS[name](empty(spark))
    assert none.count() == 0 and none.columns[:5] == empty(spark).columns


ROWS = {
    "simhash": lambda d: simhash.near_duplicates(d), "langid": lambda d: langid.identify(d, langid.fit(d)), "lm": lambda d: ngram_lm.score(d, ngram_lm.train(d)),
    "quality": lambda d: quality.quality_scores(d), "lines": lambda d: linededup.dedup_lines(d),
}


@pytest.mark.parametrize("name", ROWS)
def test_scorers_give_each_row_a_result(spark, name):
    docs = odd_rows(spark)
    assert Counter(r["doc_id"] for r in ROWS[name](docs).collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert ROWS[name](empty(spark)).count() == 0


# 1

RULES = [("example.com", "block"), ("good.example.com", "allow"), ("example.com/free", "allow"), ("example.com/free/not", "block"), ("both.org", "allow"), ("both.org", "block"), (None, "block"), ("", "allow")]
URLS = ["http://example.com/x", "https://A.B.example.com./free/1", "http://example.com/free/not/2?q=1#f", "//good.example.com", "http://u:p@both.org:80/", "http://notexample.com", "nonsense", "", None, "http://example.com/freedom", "http://example.com//free//x"]
DECISIONS = ["block", "allow", "block", "allow", "block", "none", "none", "none", "none", "block", "allow"]


@pytest.mark.parametrize("limit", [1000, 2])
def test_url_filter(spark, limit):
    pages = spark.createDataFrame(list(enumerate([*URLS, URLS[0]])), "page_id long, url string").withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(RULES, "pattern string, kind string")
    found = {r["page_id"]: r for r in url_filter.url_filter(pages, rules, limit=limit).collect()}
    assert [found[i]["decision"] for i in range(len(URLS))] == DECISIONS and found[len(URLS)]["decision"] == "block"
    assert found[1]["rule"] == "example.com/free" and found[0]["keep"] is False and found[8]["keep"] is True
    assert url_filter.url_filter(pages.limit(0), rules, limit=limit).count() == 0
    assert {r["decision"] for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"none"}


# 2


@pytest.mark.parametrize("prefix", [3, 6])
def test_trie_join_finds_all_neighbours(spark, prefix):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    near = []
    for f in base:
        for flips in (0, 3, 9, 11, 12, 20):
            g = f.copy()
            for b in rng.choice(64, min(flips, 64), replace=False):
                g[0] ^= np.uint64(1) << np.uint64(b)
            near.append(g)
    f = np.unique(np.vstack([base, near]), axis=0)
    want = {(i, j) for i, j in combinations(range(len(f)), 2) if (d := int(np.bitwise_count(f[i, 0] ^ f[j, 0]))) <= 11 and d + int(np.bitwise_count(f[i, 1] ^ f[j, 1])) <= 24}
    reps = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(f.view(np.int64).tolist())], "rep long, f1 long, f2 long")
    edges = [(r["a"], r["b"]) for r in simhash.neighbour_edges(reps, len(f), prefix=prefix).collect()]
    assert {tuple(sorted(e)) for e in edges} <= want

    def groups(pairs):
        up = list(range(len(f)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        return Counter(frozenset(x for x in range(len(f)) if root(x) == r) for r in {root(x) for x in range(len(f))})

    assert groups(edges) == groups(want)


def test_near_copies_are_grouped(spark):
    """Copies with one word in 25 replaced: recall of 0.9 at least; exact copies always; unrelated texts never."""
    rng = np.random.default_rng(3)
    texts = [prose(200, rng) for _ in range(60)]
    copies = [" ".join(w if i % 25 else rng.choice(WORDS) for i, w in enumerate(t.split())) for t in texts]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts + copies + texts[:5])).collect()}
    assert sum(found[60 + i]["group_id"] == i for i in range(60)) >= 54
    assert all(found[120 + i]["group_id"] == i for i in range(5)) and all(found[i]["keep"] for i in range(60))


# 3


def test_chat_spans_and_rewrites(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", "end"), (None, 0, "user", "lost"), (2, 0, None, ""), (2, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("x"))
    out = chat.format_chats(turns).orderBy("conv_id", "turn").collect()
    assert "".join(r["span"] for r in out if r["conv_id"] == 1) == chat.chatml([{"role": r, "text": t or ""} for c, _, r, t in rows if c == 1])
    assert [r["status"] for r in out if r["conv_id"] is None] == ["no_conversation"] and sum(r["conv_id"] == 2 for r in out) == 2
    rewritten = {r["turn"]: r for r in chat.format_chats(turns, chat.last_only).where("conv_id = 1").collect()}
    assert rewritten[3]["status"] == "rewrites_history" and rewritten[1]["start"] is None and rewritten[0]["status"] == "ok"
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_conversations_and_texts(spark):
    """Every prefix is rendered, so the spans of 300 turns tile the last rendering; one text is a million characters."""
    said = [{"role": "user" if n % 2 else "assistant", "text": f"turn {n} " + "x" * (n % 7)} for n in range(300)] + [{"role": "user", "text": "y" * 1_000_000}]
    found = chat.spans(said, chat.chatml)
    assert [s for _, _, s in found] == ["ok"] * 301 and found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    rows = spark.createDataFrame([(1, n, t["role"], t["text"]) for n, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    out = {r["turn"]: r for r in chat.format_chats(rows).collect()}
    assert len(out) == 301 and out[300]["span"] == f"<|im_start|>user\n{'y' * 1_000_000}<|im_end|>\n" and out[300]["start"] == found[300][0]


# 4


def test_languages_held_out_and_rejected(spark):
    rng = np.random.default_rng(2)
    stems = {"aa": ["the", "ing", "wha", "ther"], "bb": ["que", "ción", "los", "ara"], "cc": ["sch", "ung", "der", "keit"]}
    make = lambda k, n: " ".join("".join(rng.choice(stems[k], 3)) for _ in range(n))
    rows = [(i, make(k, 60), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    held = [(i, make(k, 40), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [(900, "zyx qpk vjw " * 60, "und"), (901, "12 34 !!", "und"), (902, None, "und")]
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([found[i]["lang"] == k for i, _, k in held]) >= 0.97 and found[900]["lang"] == found[902]["lang"] == "und" and found[901]["score"] is None


def test_texts_of_a_language_without_labels_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200").select("doc_id", "text", "lang")
    rng = np.random.default_rng(13)
    noise = [(-1 - i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(400)), "und") for i in range(20)]
    out = sorted(r["lang"] for r in docs.select("lang").distinct().collect())[0]
    model = langid.fit(docs.where(F.col("lang") != out))
    found = langid.identify(docs.union(spark.createDataFrame(noise, docs.schema)), model).withColumnRenamed("lang", "got").join(docs.union(spark.createDataFrame(noise, docs.schema)), "doc_id").collect()
    assert np.mean([r["got"] == "und" for r in found if r["lang"] == out]) >= 0.9
    assert np.mean([r["got"] == r["lang"] for r in found if r["lang"] not in (out, "und")]) >= 0.9
    assert all(r["got"] == "und" for r in found if r["lang"] == "und")


# 5


def brute_containment(docs, items, n=5, threshold=0.6):
    out = {}
    for i, item in items:
        w = tx.hash_words(item)
        width = min(n, len(w))
        if not width:
            continue
        grams = [tuple(w[x : x + width]) for x in range(len(w) - width + 1)]
        need = max(1, math.ceil(round(len(set(grams)) * threshold, 9)))
        for d, text in docs:
            v = tx.hash_words(text)
            own = [tuple(v[x : x + width]) for x in range(len(v) - width + 1)]
            best = max((len(set(own[x : x + len(grams)]) & set(grams)) for x in range(len(own))), default=0)
            if best >= need:
                out[d, i] = round(best / len(set(grams)), 6)
    return out


@pytest.mark.parametrize("limit", [10_000, 3])
def test_decontamination_matches_brute_force(spark, limit):
    rng = np.random.default_rng(4)
    items = [(i, prose(int(n), rng)) for i, n in enumerate([30, 12, 3, 60, 1])] + [(5, None), (6, ""), (7, "same words " * 10)]
    cut = items[3][1].split()
    texts = [prose(50, rng), f"{prose(20, rng)} {items[0][1]} {prose(9, rng)}", " ".join(cut[:45]) + prose(3, rng), " ".join(cut[:25]) + " " + prose(80, rng) + " " + " ".join(cut[25:]), items[2][1].upper(), items[7][1], None, "", items[1][1]]
    docs = frame(spark, texts)
    found = decontaminate.contaminated(docs.union(docs), spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in found} == brute_containment(list(enumerate(texts)), items) and len(found) == len({(r["doc_id"], r["item_id"]) for r in found})


def test_items_with_null_or_shared_ids_are_found(spark):
    rng = np.random.default_rng(14)
    texts = [prose(30, rng) for _ in range(3)]
    items = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (1, texts[2])], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, texts), items).collect()
    assert {(r["doc_id"], r["item_id"], r["containment"]) for r in found} == {(0, None, 1.0), (1, 1, 1.0), (2, 1, 1.0)} and len(found) == 3


# 7


def cost(flow, supply, quota, repeats):
    total, got = 0.0, [0.0] * len(quota)
    for p, f in enumerate(flow):
        used = sum(f.values())
        for level in range(repeats):
            total += level * min(max(used - level * supply[p], 0), supply[p])
        for s, x in f.items():
            got[s] += x
    return total + mixing.SHORT * sum(max(0, q - g) for q, g in zip(quota, got, strict=True))


def test_flow_is_cheapest():
    """Against all integer flows of tiny cases."""
    from itertools import product

    rng = np.random.default_rng(8)
    for _ in range(12):
        members = [(0,), (0, 1), (1,)]
        supply, quota = [float(x) for x in rng.integers(1, 3, 3)], [float(x) for x in rng.integers(1, 5, 2)]
        best = math.inf
        for x in product(*[range(int(2 * supply[p]) + 1) for p, m in enumerate(members) for _ in m]):
            it = iter(x)
            flow = [{s: float(next(it)) for s in m} for m in members]
            if all(sum(f.values()) <= 2 * supply[p] for p, f in enumerate(flow)) and all(sum(f.get(s, 0) for f in flow) <= quota[s] for s in (0, 1)):
                best = min(best, cost(flow, supply, quota, 2))
        assert cost(mixing.solve(supply, members, quota, 2), supply, quota, 2) == pytest.approx(best)


def test_mixture_meets_reachable_weights(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(20, rng), "en", "a" if i % 4 else "b", 1) for i in range(400)] + [(1000, "shared text of both", "en", "a", 1), (1001, "shared text of both", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    first = mixing.mix(docs, {"a": 0.5, "b": 0.5})
    got = {r["source"]: r["t"] for r in first.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("t")).collect()}
    assert got["a"] == pytest.approx(got["b"], rel=0.02) and sum(got.values()) == pytest.approx(8004, rel=0.01)
    assert {(r["doc_id"], r["source"], r["uses"]) for r in first.collect()} == {(r["doc_id"], r["source"], r["uses"]) for r in mixing.mix(docs, {"a": 0.5, "b": 0.5}).collect()}


# 8


def brute_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney without pruning, straight from the definition."""
    seqs = [[0] * (order - 1) + [tuple([w]) for w in tx.hash_words(t)] + [1] for t in texts if tx.hash_words(t)]
    counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc = {n: ngram_lm._discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in counts.items()}
    take = lambda n, c: disc[n][min(c, 3) - 1] if c else 0.0
    total, kinds = sum(counts[1].values()), len(counts[1])
    base = sum(take(1, c) for c in counts[1].values()) / total

    def p(gram):
        n, c = len(gram), counts[len(gram)].get(gram, 0)
        if n == 1:
            return max(c - take(1, c), 0) / total + base / (kinds + 1)
        own = [v for g, v in counts[n].items() if g[:-1] == gram[:-1]]
        return p(gram[1:]) if not own else max(c - take(n, c), 0) / sum(own) + sum(take(n, v) for v in own) / sum(own) * p(gram[1:])

    return [None if not tx.hash_words(t) else sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for s in [[0] * (order - 1) + [tuple([w]) for w in tx.hash_words(t)] + [1]] for i in range(order - 1, len(s))) for t in texts]


def test_language_model_matches_the_definition(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(WORDS[:12], rng.integers(1, 15))) for _ in range(40)] + [None, "", WORDS[0]]
    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in ngram_lm.score(docs, ngram_lm.train(docs, 3, (1, 1, 1))).collect()}
    for i, want in enumerate(brute_kneser_ney(texts, 3)):
        assert found[i]["logprob"] == (None if want is None else pytest.approx(want, rel=1e-4)), i


def test_language_model_as_registered_stores_every_ngram(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS[:30], rng.integers(1, 15))) for _ in range(30)] + [None]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["logprob"] for r in op8_lm_score(spark, str(tmp_path)).collect()}
    for i, want in enumerate(brute_kneser_ney(texts, 3)):
        assert found[i] == (None if want is None else pytest.approx(want, rel=1e-4)), i


# 9


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(9)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((len(truth), 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (rng.random((len(truth), 5)) < 0.8)
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(kinds, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03 and np.abs(model.good - right).max() < 0.04 and np.abs(model.bad - right).max() < 0.06
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.95


def test_clean_text_stays_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_scores(docs).select("doc_id", "keep").join(labels, "doc_id").select("keep", F.col("quality").alias("label")).collect()
    kept = lambda label: np.mean([r["keep"] for r in rows if r["label"] == label])
    assert kept(1) >= 0.97, kept(1)
    assert kept(0) <= 0.5, kept(0)
