"""Source divergence, hard negatives and the trie self-join, against brute force and on awkward input."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import hard_negatives, simhash_trie, source_divergence

LOWER = {code: code + 32 for code in range(65, 91)}


# ---- source divergence


def brute_audit(rows, min_docs=3, top=200):
    """The contract, term by term and pair by pair, with Python's integers."""
    counts, docs = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    found = []
    for lang, groups in counts.items():
        kept = [term for term, n in docs[lang].items() if n >= min_docs]

        def shares(uses):
            whole = sum(uses[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (uses[t] + 1) // whole for t in kept}

        p = {source: shares(uses) for source, uses in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for source, uses in groups.items():
            pairs = [(other, sum((p[source][t] - p[other][t]) ** 2 // p[other][t] for t in kept)) for other in groups if other != source]
            own = [(t, (p[source][t] - q[t]) ** 2 // q[t]) for t in kept if uses[t] and p[source][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", own, top)):
                items.sort(key=lambda item: (-item[1], item[0].encode()))
                found += [(lang, source, part, item, value, n) for n, (item, value) in enumerate(items[:limit], 1)]
    return sorted(found)


def some_documents(number=150, seed=3):
    pick = random.Random(seed)
    words = [f"w{'abcdefgh'[n % 8]}{'xyzuv'[n // 8 % 5]}" for n in range(40)] + ["É", "été", "ÀB", "日本"]
    rows = []
    for _ in range(number):
        lang, source = pick.choice(["en", "en", "fr", None, ""]), pick.choice(["a", "b", "c", "d", None, "É"])
        text = " ".join(pick.choice(words[: pick.choice([5, 20, 44])]) + pick.choice(["", "1", ".", "\x00", "\t"]) for _ in range(30))
        rows.append((lang, source, pick.choice([text, text.upper(), text, "", None])))
    return rows + [("xx", "alone", "one two"), ("xx", "empty", None), ("yy", "single", "same same same")] + [("zz", "s", "q q")] * 4


def audited(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).withColumn("n", F.lit("x"))
    return sorted(tuple(row) for row in source_divergence.audit(docs).collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = some_documents()
    want = brute_audit(rows)
    assert audited(spark, rows) == want
    # many small blocks of terms and of groups, and a task that flushes its counts all the time
    for name, value in {"BLOCK_ROWS": 40, "BLOCK_GROUPS": 2, "CELLS": 100, "BLOCK_TERMS": 7, "HELD_TERMS": 5, "PIECE": 16}.items():
        monkeypatch.setattr(source_divergence, name, value)
    assert audited(spark, rows) == want
    assert audited(spark, []) == []


def test_joint_tables_are_exact_counts():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 4, (60, 3)), rng.integers(0, 5, (60, 2))
    table, (group_a, level_a), (group_b, level_b) = source_divergence.joint_tables(left, right)
    assert table.sum() == 60 * 3 * 2
    for x in range(len(level_a)):
        for y in range(len(level_b)):
            assert table[x, y] == ((left[:, group_a[x]] == level_a[x]) & (right[:, group_b[y]] == level_b[y])).sum()


def test_shares_are_exact_far_beyond_a_product_in_64_bits():
    rng = random.Random(1)
    pairs = [(rng.randrange(10**k), 10**k + rng.randrange(10**k)) for k in range(1, 15)]
    n, whole = (np.array(side, dtype=np.int64) for side in zip(*pairs))
    assert source_divergence.shares(n, whole).tolist() == [1 + 10**9 * (a + 1) // b for a, b in pairs]


# ---- hard negatives


def brute_negatives(rows, positives=5, negatives=5):
    """rows: (id, label, codes), all of them whole."""
    found = []
    for a, label, codes in rows:
        if a % 100:
            continue
        scored = [(r, own == label, sum(x * y for x, y in zip(codes, other))) for r, own, other in rows]
        near = sorted((-score, r) for r, same, score in scored if same and r != a)[:positives]
        for score, positive in ((-s, r) for s, r in near):
            fits = [(-s, r) for r, same, s in scored if not same and 80 * score <= 100 * s <= 100 * score]
            found += [(a, positive, n, r, score, -s) for n, (s, r) in enumerate(sorted(fits)[:negatives], 1)]
    return sorted(found)


def mined(spark, rows):
    vectors = spark.createDataFrame(rows, "id bigint, label int, codes array<bigint>").withColumn("slot", F.lit("clash"))
    return sorted(tuple(row) for row in hard_negatives.mine(vectors, F.col("id") % 100 == 0).collect())


def some_vectors(number, width, seed, spread=60):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread, (4, width))
    made = []
    for n in range(number):
        codes = centres[rng.integers(4)] + rng.integers(-spread, spread, width) // 2
        made.append((n * 10, int(rng.integers(3)), codes.tolist()))
    return made


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = some_vectors(260, 20, 1)
    rows += [(10_000 + n, rows[n][1], rows[n][2]) for n in range(60)]  # equal vectors: equal scores, ordered by id
    want = brute_negatives(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    for name, value in {"ROWS": 50, "ANCHORS": 6, "PACKED": 16, "CHUNK": 3, "GATHER": 10}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows) == want
    huge = [(i, label, [x * 10**6 for x in codes]) for i, label, codes in rows]
    assert mined(spark, huge) == brute_negatives(huge)


def test_negatives_of_awkward_rows(spark):
    whole = some_vectors(40, 3, 2)
    odd = [(None, 1, [1, 2, 3]), (5, None, [1, 2, 3]), (7, 1, None)]
    assert mined(spark, whole + odd) == brute_negatives(whole)
    short = whole + [(300_001, 1, []), (300_100, 2, [9]), (300_200, 1, [])]
    filled = [(i, label, (codes + [0, 0, 0])[:3]) for i, label, codes in short]
    assert mined(spark, short) == brute_negatives(filled)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1])]) == [] and mined(spark, [(100, 1, [])]) == []


def test_components_are_quantised_or_leave_the_row_out(spark):
    rows = [[0.5, -0.001], [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [], None]
    frame = spark.createDataFrame([(row,) for row in rows], "v array<float>")
    made = [row[0] for row in frame.select(hard_negatives.quantised(F.col("v"))).collect()]
    assert made == [[128, math.floor(256 * float(np.float32(-0.001)))], None, None, None, [], None]


def test_summaries_bracket_every_score():
    rng = np.random.default_rng(4)
    for width in (1, 5, 16, 64, 70):
        a, b = (rng.integers(-300, 300, (30, width)) + rng.integers(-200, 200, (30, 1)) for _ in range(2))
        left, right = (hard_negatives.Vectors(codes, hard_negatives.summaries(codes)) for codes in (a, b))
        exact, reach = a @ b.T, []
        for level in range(len(hard_negatives.LEVELS)):
            low, high = hard_negatives.bracket(left, right, level, None)
            assert (low <= exact).all() and (exact <= high).all()
            reach.append((high - low).sum())
        assert reach == sorted(reach, reverse=True)


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(values, budget=4):
    values = sorted(set(values))
    array, root = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= budget):
            root[find(i + 1 + int(j))] = find(i)
    groups = {}
    for i, value in enumerate(values):
        groups.setdefault(find(i), set()).add(value)
    return {frozenset(group) for group in groups.values()}


def clustered(seed=1, hot=500):
    """Lone fingerprints, chains of near ones, and one dense group in which nearly all share their upper bits."""
    pick = random.Random(seed)
    made = [pick.getrandbits(64) for _ in range(200)] + [0, 1, 15, 2**64 - 1, 2**63]
    for value in made[:50]:
        for _ in range(pick.randrange(1, 8)):
            for bit in pick.sample(range(64), pick.randrange(1, 6)):
                value ^= 1 << bit
            made.append(value)
    for _ in range(hot):
        value = made[0]
        for bit in pick.sample(range(24), pick.randrange(1, 9)):
            value ^= 1 << bit
        made.append(value)
    return sorted(set(made))


def linked(spark, values, **sizes):
    fps = spark.createDataFrame([(simhash_trie._signed(value),) for value in values], "fp bigint")
    edges = [(a % 2**64, b % 2**64) for a, b in simhash_trie.links(fps, **sizes).collect()]
    group = {value: {value} for value in values}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for value in group[b]:
                group[value] = group[a]
    return {frozenset(members) for members in group.values()}, edges


def test_fingerprints_equal_brute_force():
    texts = [None, "", " \n\t", "One", "a b c", "A B C D", "é É x y z Z", "w " * 50, "\x00 \x1f q"]
    pick = random.Random(2)
    texts += [" ".join(f"W{pick.randrange(90)}" for _ in range(pick.randrange(300))) for _ in range(30)]
    assert [simhash_trie.fingerprint(text) for text in texts] == [brute_fingerprint(text) for text in texts]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 150, "step": 6}])
def test_components_equal_brute_force(spark, sizes):
    values = clustered()
    groups, edges = linked(spark, values, **sizes)
    assert groups == brute_components(values)


def test_links_of_a_dense_group_grow_with_its_members(spark):
    pick = random.Random(4)
    values = sorted({pick.getrandbits(10) for _ in range(900)})
    groups, edges = linked(spark, values)
    assert groups == {frozenset(values)} and len(edges) < 16 * len(values)


def test_walk_covers_two_different_nodes():
    rng = np.random.default_rng(3)
    left, right = (np.unique(rng.integers(0, 2**20, 300, dtype=np.uint64)) for _ in range(2))
    values = np.concatenate([left, right + np.uint64(1 << 40)])
    u, v = np.array([[0, len(left)]]), np.array([[len(left), len(values)]])
    roots = simhash_trie.forest(len(values), simhash_trie.walk(values, u, v, 24, np.array([1])))
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= 3
    want = simhash_trie.forest(len(values), iter([(np.nonzero(near)[0], np.nonzero(near)[1] + len(left))]))
    assert (roots == want).all()


def test_documents_get_their_component(spark, awkward, nothing):
    pick = random.Random(6)
    base = [" ".join(f"w{pick.randrange(500)}" for _ in range(200)) for _ in range(6)]
    texts = base + [base[0].upper(), base[1] + " more", base[2].replace("w1", "v1", 1), "", None, "x"] + [base[3]] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = {row["doc_id"]: row for row in simhash_trie.near_duplicates(docs).collect()}
    values = [brute_fingerprint(text) for text in texts]
    assert [made[i]["fingerprint"] for i in range(len(texts))] == [f"{value:016x}" for value in values]
    group = {value: members for members in brute_components(values) for value in members}
    low = {i: min(j for j, other in enumerate(values) if other in group[values[i]]) for i in range(len(texts))}
    assert {i: row["component_id"] for i, row in made.items()} == low
    rows = simhash_trie.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count() and all(row["fingerprint"] is not None for row in rows)
    assert simhash_trie.near_duplicates(nothing).collect() == []


# ---- queries


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hard_negatives"])
def test_queries_equal_sql(spark, name):
    book, tables = pytest.importorskip("emberline.llm.book"), pytest.importorskip("tests.check_oracle")
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables not present")
    query, sql = book.LLM_BOOK[name]
    assert tables.compare(spark, tables.oracle(sf_dir), name, query, sql, sf_dir, may_be_empty=False) is None


def test_the_new_operators_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(11, 14)] == [1] * 3
