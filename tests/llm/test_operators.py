"""The operators on Spark, against brute force and on awkward input."""

import collections
import hashlib
import math
import random
import uuid
import zlib

import pytest

import emberline.llm.byte_bpe as byte_bpe
from emberline.llm import (
    decontamination,
    near_duplicates,
    pitman_yor,
    private_data,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_counts,
    url_reputation,
)
from emberline.llm.near_duplicates import Shingler, probability_jaccard
from emberline.llm.url_reputation import ALLOW, BLOCK, Rule
from emberline.session import shared_dir

tokenizers_ = pytest.importorskip("public_tokenizers")
BPE = str(tokenizers_.path("byte_bpe_multi_50k.tiktoken"))
JSON = str(tokenizers_.path("byte_bpe_50k.json"))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def invented(number, words, seed, vocabulary=3000):
    pick = random.Random(seed)
    return [" ".join(f"w{pick.randrange(vocabulary)}" for _ in range(words)) for _ in range(number)]


# ---- every operator on awkward rows and on none


def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


PER_ROW = {
    "private": lambda docs: private_data.report(docs),
    "secrets": lambda docs: secret_scan.report(docs),
    "bpe": lambda docs: byte_bpe.digest_documents(docs, BPE, tokenizers_.PATTERN, units=byte_bpe.UNITS),
    "bpe ids": lambda docs: byte_bpe.encode_documents(docs, BPE, tokenizers_.PATTERN),
    "counts": lambda docs: token_counts.count_tokens(docs, JSON, folder(docs.sparkSession)),
    "quality": lambda docs: quality_rules.with_verdict(quality_rules.judge_table(docs)),
    "classifier": lambda docs: quality_classifier.classify(docs),
    "classes": lambda docs: near_duplicates.near_duplicates(docs),
    "model": lambda docs: pitman_yor.score(docs),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_awkward_row_and_none_for_none(awkward, nothing, name):
    made = PER_ROW[name](awkward).collect()
    ids = lambda rows: collections.Counter(row["doc_id"] for row in rows)
    assert ids(made) == ids(awkward.collect())
    assert all(value is not None for row in made for column, value in row.asDict().items() if column not in ("doc_id", "class_id"))
    assert PER_ROW[name](nothing).collect() == []


def test_filters_keep_columns_of_awkward_rows(spark, awkward, nothing):
    benchmark = spark.createDataFrame([(1, "lorem ipsum dolor sit amet " * 5), (2, None), (None, "")], "item_id bigint, text string")
    none = benchmark.limit(0)
    for name, keep in {
        "quality": quality_rules.keep_good,
        "one": near_duplicates.keep_one,
        "benchmark": lambda docs: decontamination.decontaminate(docs, benchmark),
        "redact": private_data.redact,
    }.items():
        made = keep(awkward)
        assert made.columns == awkward.columns, name
        assert made.count() <= awkward.count()
        assert keep(nothing).collect() == []
    assert decontamination.decontaminate(awkward, none).count() == awkward.count()
    gone = set(row["doc_id"] for row in awkward.collect()) - set(
        row["doc_id"] for row in decontamination.decontaminate(awkward, benchmark).collect()
    )
    assert gone == {7}
    assert [row["text"] for row in private_data.redact(awkward).where("doc_id = 2").collect()] == [None]


# ---- near-duplicates


def brute_classes(texts):
    shingle = Shingler()
    bags = [shingle(text) for text in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i][0]) and len(bags[j][0]) and probability_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def copies(text, number, changes, seed):
    pick, words = random.Random(seed), text.split()
    out = []
    for n in range(number):
        own = list(words)
        for _ in range(changes):
            own[pick.randrange(len(own))] = f"changed{n}x{pick.random()}"
        out.append(" ".join(own))
    return out


def test_classes_equal_brute_force(spark):
    seeds = invented(40, 150, 1)
    texts = seeds + copies(seeds[0], 25, 2, 2) + copies(seeds[1], 6, 3, 3) + [seeds[2], seeds[2].upper(), "", "", "a b", "a  b"]
    texts += copies(" ".join(seeds[3].split()[:70] + seeds[4].split()[:80]), 3, 1, 5)
    random.Random(9).shuffle(texts)
    made = {row["doc_id"]: row["class_id"] for row in near_duplicates.near_duplicates(frame(spark, texts)).collect()}
    assert made == brute_classes(texts)
    kept = sorted(row["doc_id"] for row in near_duplicates.keep_one(frame(spark, texts)).collect())
    assert kept == sorted(set(made.values()))


def test_a_chain_of_similar_texts_is_one_class(spark):
    words = invented(1, 200, 4)[0].split()
    texts = []
    for step in range(12):
        texts.append(" ".join(words))
        words[step * 15] = f"new{step}"
        words[step * 15 + 1] = f"newer{step}"
    made = {row["class_id"] for row in near_duplicates.near_duplicates(frame(spark, texts)).collect()}
    assert made == {0}


# ---- decontamination


def brute_leaks(texts, items):
    import re

    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    out = {}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            a, b = words(text), words(item)
            best = 0
            for shift in range(-len(b), len(a)):
                pairs = [(a[shift + k], b[k]) for k in range(len(b)) if 0 <= shift + k < len(a)]
                run = 0
                for x, y in pairs:
                    run = max(0, run + (1 if x == y else -1))
                    best = max(best, run)
            if best >= 13:
                out[(i, j)] = best
    return out


def test_leaks_with_substitutions(spark):
    items = invented(12, 40, 21)
    texts = invented(30, 120, 22)
    plant = {}
    pick = random.Random(23)
    for doc in range(0, 30, 3):
        item = pick.randrange(12)
        words = items[item].upper().split()
        for place in pick.sample(range(40), 3):
            words[place] = "other"
        texts[doc] = f"{texts[doc]}. {', '.join(words)}! {texts[doc]}"
        plant[doc] = item
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for limit in (10**6, 0):
        made = decontamination.find_leaks(frame(spark, texts), benchmark, broadcast_seeds=limit).collect()
        assert {(row["doc_id"], row["item_id"]) for row in made} == set(brute_leaks(texts, items)) == set(plant.items())


def test_short_items_are_found(spark):
    pick = random.Random(31)
    items, texts, plant = [], [], {}
    for number in [*range(1, 20)] * 2:
        words = [f"i{len(items)}x{k}" for k in range(number)]
        items.append(" ".join(words))
        for place in pick.sample(range(1, number - 1), 0 if number < 8 else 2 if number in (16, 17, 18) else 1):
            words[place] = "other"
        changed = sum(word == "other" for word in words)
        plant[len(texts), len(items) - 1] = number - 2 * changed
        texts.append(" ".join([*invented(1, 30, number), *words, "end"]))
    for number in (8, 12, 14, 16, 19):  # too little of an item
        items.append(" ".join(f"j{number}x{k}" for k in range(number)))
        texts.append("a " + " ".join(f"j{number}x{k}" for k in range(number // 2)) + " b")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for limit in (10**6, 0):
        made = decontamination.find_leaks(frame(spark, texts), benchmark, broadcast_seeds=limit).collect()
        found = {(row["doc_id"], row["item_id"]): row["overlap"] for row in made}
        assert set(found) == set(plant)
        assert all(found[key] >= score for key, score in plant.items())


def test_decontamination_runs_no_python(spark):
    docs = frame(spark, invented(3, 30, 1))
    benchmark = docs.withColumnRenamed("doc_id", "item_id")
    plan = decontamination.find_leaks(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ---- secrets


def test_a_secret_of_letters_does_not_teach_itself(spark):
    texts = ["the description is required", "pwd: xkqzvbwpjhtmrgnl", "pwd: description"]
    docs = frame(spark, texts)
    ranks = secret_scan.learn_dictionary(docs)
    assert "description" in ranks and "xkqzvbwpjhtmrgnl" not in ranks
    assert {row["doc_id"]: row["spans"] for row in secret_scan.report(docs).collect()} == {0: "", 1: "guess:5:21", 2: ""}


# ---- token counts


@pytest.mark.parametrize("limit", [10**6, 2, 0])
def test_counts_come_from_the_cache(spark, limit):
    from tokenizers import Tokenizer

    texts = ["one two three", "one two three", "", "<|endoftext|> x", "ä ö ü " * 200, None]
    cache = folder(spark)
    tokenizer = Tokenizer.from_file(JSON)
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    docs = frame(spark, texts)
    for _ in range(2):
        made = token_counts.count_tokens(docs, JSON, cache, broadcast_rows=limit).collect()
        assert {row["doc_id"]: row["n_tokens"] for row in made} == want
        assert {row["doc_id"]: row["n_bytes"] for row in made} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
        assert spark.read.parquet(cache).count() == 4
    # what is stored is used, not counted again
    digest = hashlib.sha256(b"new text").hexdigest()
    spark.createDataFrame([(digest, token_counts.version_of(JSON), 77)], token_counts.CACHE).write.mode("append").parquet(cache)
    assert token_counts.count_tokens(frame(spark, ["new text"]), JSON, cache).first()["n_tokens"] == 77


# ---- language model


def test_model_scores(spark):
    texts = invented(60, 80, 31, vocabulary=60) + ["", "W1 w1 unseenword"]
    rows = {row["doc_id"]: row for row in pitman_yor.score(frame(spark, texts)).collect()}
    tokens = {i: [*text.lower().split(), ""] for i, text in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = collections.Counter(token for i in tokens if not held[i] for token in tokens[i])
    total, types = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (types + 1))) for t in own)
        row = rows[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[i], len(own), total)
        assert row["n_known"] == sum(counts[t] > 0 for t in own)
        assert row["base_score"] == pytest.approx(base) and row["score"] < 0


def test_model_is_a_distribution_and_independent_of_chunks(spark, monkeypatch):
    """One-word held-out texts: the probabilities of all words after the start, and one unknown, sum to one."""
    texts = invented(40, 25, 33, vocabulary=30)
    words = sorted({word for text in texts for word in text.split()})
    train = [(1, text, False) for text in texts]
    probes = [(100 + i, word, True) for i, word in enumerate([*words, "unknown"])] + [(99, "", True)]
    docs = spark.createDataFrame(train + probes, "doc_id bigint, text string, held boolean")
    from pyspark.sql import functions as F

    def run(frame):
        made = pitman_yor.score(frame, held=F.col("held")).where("doc_id >= 99").collect()
        return {row["doc_id"]: row["score"] for row in made}

    scores = run(docs.coalesce(1))
    after_known = spark.createDataFrame(
        train + [(99, "", True)] + [(1000 + 100 * i + j, f"{a} {b}", True) for i, a in enumerate(words[:2]) for j, b in enumerate([*words, "unknown"])],
        "doc_id bigint, text string, held boolean",
    )
    two = run(after_known)
    one = {word: scores[100 + i] for i, word in enumerate([*words, "unknown"])}
    for i, first in enumerate(words[:2]):
        # log P(first) + log P(second | first) + log P(end | second); the last two factors cancel out below
        ends = {b: 10 ** (two[1000 + 100 * i + j]) for j, b in enumerate([*words, "unknown"])}
        assert all(value > 0 for value in ends.values())
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 40)
    again = run(docs.repartition(5))
    assert again == pytest.approx(scores)
    assert sum(10**score for score in one.values()) < 1.0 and 10 ** scores[99] < 1.0


def test_base_and_pairs_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    c = rng.integers(0, 9, 50)
    corpus = pitman_yor.Corpus(int(c.sum()), int((c > 0).sum()), 1, 1, np.zeros(0), 0.7, 0.6)
    tables = np.minimum(c, 2)
    parent = pitman_yor.Parent(float(c.sum()), float(tables.sum()))
    base = pitman_yor.base_of(c, tables, parent, corpus, pitman_yor.Settings())
    known = base[c > 0].sum()
    unknown = pitman_yor.base_of(np.zeros(1), np.zeros(1), parent, corpus, pitman_yor.Settings())[0]
    assert known + unknown == pytest.approx(1.0)


# ---- urls


RULES = [Rule("org/", ALLOW), Rule("example.org/es/", BLOCK), Rule("com/de/", BLOCK)]


def test_url_rules(spark):
    urls = {
        "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", BLOCK),
        "http://example.org": ("example.org", "", None, ALLOW),
        "x://badexample.org/es/": ("badexample.org", "/es/", "org/", ALLOW),
        "http://com/de/x": ("com", "/de/x", "com/de/", BLOCK),
        "no scheme": ("", "", None, ALLOW),
        "http://h?/a/b": ("h", "", None, ALLOW),
        "a://b://c/d": ("b:", "//c/d", None, ALLOW),
        "\nhttp://É.com/de/\nz": ("É.com", "/de/\nz", "com/de/", BLOCK),
        None: ("", "", None, ALLOW),
        "": ("", "", None, ALLOW),
    }
    pages = spark.createDataFrame([(i, url, "clash") for i, url in enumerate(urls)], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "host string, blocked boolean")
    made = {row["page_id"]: tuple(row[1:]) for row in url_reputation.judge_urls(pages, RULES, none).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert made == dict(enumerate(urls.values()))
    assert url_reputation.judge_urls(pages.limit(0), RULES).collect() == []


def test_reputation_shrinks(spark):
    outcomes = [("bad.shop.com", True)] * 30 + [("good.site.com", False)] * 30 + [("new.shop.com", True)]
    outcomes += [(f"h{i}.site{i % 5}.net", False) for i in range(50)]
    known = spark.createDataFrame(outcomes, "host string, blocked boolean")
    urls = ["bad.shop.com", "other.shop.com", "good.site.com", "other.site.com", "x.y.net", "unheard.of"]
    pages = spark.createDataFrame([(i, f"http://{host}/") for i, host in enumerate(urls)], "page_id bigint, url string")
    made = {row["host"]: row for row in url_reputation.judge_urls(pages, [], known).collect()}
    rates = [made[host]["rate"] for host in ("bad.shop.com", "other.shop.com", "other.site.com")]
    assert rates[0] > rates[1] > rates[2] and made["x.y.net"]["rate"] < 0.2
    assert made["bad.shop.com"]["verdict"] == BLOCK and made["unheard.of"]["verdict"] == ALLOW


# ---- quality


def test_classifier_and_rules_against_labels(spark):
    good = [t + "." for t in invented(120, 90, 41)]
    bad = [" ".join(f"{w}%%%" for w in t.split()) for t in invented(20, 90, 42)]
    bad += [" ".join(f"{w}!!" for w in t.upper().split()) for t in invented(20, 90, 43)]
    bad += [" | ".join(t.split()) for t in invented(20, 60, 44)] + ["the same six words once more. " * 20] * 5
    docs = frame(spark, good + bad)
    truth = {i: i < len(good) for i in range(len(good) + len(bad))}
    kept = {row["doc_id"]: row["kept"] for row in quality_classifier.classify(docs, sample_rows=100).collect()}
    assert sum(kept[i] == truth[i] for i in truth) / len(truth) > 0.97
    assert all(kept[i] for i in range(len(good)))
    ruled = quality_rules.with_verdict(quality_rules.judge_table(docs)).collect()
    assert {row["doc_id"]: row["kept"] for row in ruled} == truth
    assert sorted(row["doc_id"] for row in quality_rules.keep_good(docs).collect()) == [i for i in truth if truth[i]]
