"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits; bit b is set if it is set in over half of the hashes of the text's four-word
shingles. Fingerprints link if they differ in at most ``BUDGET`` bits.

The join walks a binary trie against itself: it starts with the pair of the root with itself, goes from
a pair of nodes to the pairs of their children, adds one to the pair's differing bits where the two
children are of different sides, and leaves a pair as soon as the sum exceeds the budget. In one trie
over all fingerprints nearly every pair of upper nodes stays within the budget. So the bits are cut into
``BUDGET + 2`` blocks: two that differ in ``BUDGET`` bits agree on two blocks at least. There is one
trie for each choice of two blocks, with those blocks' bits on top and no budget for them; the rest of
a trie below one value of them is a bucket, and buckets are walked independently of each other.

A bucket of up to ``CHUNK`` fingerprints is walked in one task, many buckets at once. A larger one is
first walked by Spark, ``STEP`` levels at a time, as a table of node pairs with their differing bits,
until the two nodes of a pair are small enough for a task. Before that, fingerprints that differ in one
group of four bits only are linked by an aggregate, and a pair of nodes that lie in one component is
left out: it can't connect anything. Tasks return a spanning forest of the links they find, so the links
of a group of copies grow with its members, not with its pairs.

Equal fingerprints are one from the start. Nothing is collected but the number of large buckets' node
pairs that are left after each step.

Defined cases: a null text is an empty one; a text without words has the fingerprint zero, which links
like any other; one of fewer than four words is a single shingle; repeated rows get equal rows; an empty
table gives an empty result; a null id stays null and is the smallest; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import per_text, utf8
from emberline.llm.near_duplicates import components
from emberline.session import stage

WORDS = 4
SEED = 42
BITS = 64
BUDGET = 4
CHUNK = 2_048
STEP = 6
BATCH_ROWS = 100_000
FRONTIER = 1 << 20
HASHES = 100_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a whole text, as an unsigned number."""
    found = utf8(text).translate(LOWER).split()
    if not found:
        return 0
    # shingles are slices of the words joined by blanks
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    width = min(words, len(found))
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: len(found) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(first), HASHES):
        stop = start + HASHES
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[start:stop], last[start:stop])]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > len(first)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, one row per row."""
    return per_text(docs, id_col, text_col, "fp bigint", lambda: lambda text: (_signed(fingerprint(text, words)),))


# ---- the walk inside a task


def walk(
    values: np.ndarray, first: np.ndarray, second: np.ndarray, depth: int | np.ndarray, differing: np.ndarray, budget: int = BUDGET
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between places of ``values``, from pairs of trie nodes.

    A node is a range [from, to) of places; in each the values are sorted as unsigned numbers and agree
    on the bits above ``depth``. The two nodes of a pair are disjoint or the same. A pair at whose depth
    the bits left can't exceed the budget links all members of both; one link per member says so.
    """
    depth = np.broadcast_to(np.asarray(depth, dtype=np.int64), differing.shape)
    waiting = [(first, second, depth, differing)]
    while waiting:
        u, v, at, spent = waiting.pop()
        if len(spent) > FRONTIER:
            # depth first over parts of the frontier, so that it stays small
            for start in range(0, len(spent), FRONTIER // 2):
                cut = slice(start, start + FRONTIER // 2)
                waiting.append((u[cut], v[cut], at[cut], spent[cut]))
            continue
        single = (u[:, 1] - u[:, 0] == 1) & (v[:, 1] - v[:, 0] == 1)
        if single.any():
            # two fingerprints are left: the rest of their levels at once
            a, b, cost = u[single, 0], v[single, 0], spent[single]
            rest = np.left_shift(values[a] ^ values[b], at[single].astype(np.uint64))
            rest[at[single] >= BITS] = 0
            near = (cost + np.bitwise_count(rest) <= budget) & (a != b)
            yield a[near], b[near]
            u, v, at, spent = u[~single], v[~single], at[~single], spent[~single]
        full = spent + BITS - at <= budget
        if full.any():
            yield from _all_linked(u[full], v[full])
            u, v, at, spent = u[~full], v[~full], at[~full], spent[~full]
        if not len(spent):
            continue
        mid_u, mid_v = _middle(values, u, at), _middle(values, v, at)
        same = (u[:, 0] == v[:, 0]) & (u[:, 1] == v[:, 1])
        u0, u1 = np.stack([u[:, 0], mid_u], 1), np.stack([mid_u, u[:, 1]], 1)
        v0, v1 = np.stack([v[:, 0], mid_v], 1), np.stack([mid_v, v[:, 1]], 1)
        cross = spent + 1 <= budget
        other = cross & ~same
        next_u = np.concatenate([u0, u1, u0[cross], u1[other]])
        next_v = np.concatenate([v0, v1, v1[cross], v0[other]])
        next_at = np.concatenate([at, at, at[cross], at[other]]) + 1
        next_spent = np.concatenate([spent, spent, spent[cross] + 1, spent[other] + 1])
        size_u, size_v = next_u[:, 1] - next_u[:, 0], next_v[:, 1] - next_v[:, 0]
        alone = (size_u == 1) & (next_u[:, 0] == next_v[:, 0])
        on = (size_u > 0) & (size_v > 0) & ~alone
        if on.any():
            waiting.append((next_u[on], next_v[on], next_at[on], next_spent[on]))


def _middle(values: np.ndarray, nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where in each range the values with a set bit at the depth begin: a bisection of all ranges together."""
    low, high = nodes[:, 0].copy(), nodes[:, 1].copy()
    shift = (BITS - 1 - at).astype(np.uint64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        probe = np.minimum(middle, len(values) - 1)
        is_set = (values[probe] >> shift) & np.uint64(1) == 1
        high = np.where(open_ & is_set, middle, high)
        low = np.where(open_ & ~is_set, middle + 1, low)


def _all_linked(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every member of each pair of nodes with the first of its first node."""
    for nodes in (u, v):
        sizes = nodes[:, 1] - nodes[:, 0]
        starts = np.repeat(nodes[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        members = starts + np.arange(sizes.sum())
        heads = np.repeat(u[:, 0], sizes)
        yield heads[heads != members], members[heads != members]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place connected with each place."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while True:
                further = root[root]
                if (further == root).all():
                    break
                root = further
    return root


# ---- the tries


def blocks_of(budget: int = BUDGET) -> list[tuple[int, int]]:
    """(shift, width) of each block of bits."""
    n = budget + 2
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(BITS - cuts[k + 1], cuts[k + 1] - cuts[k]) for k in range(n)]


def orders(budget: int = BUDGET) -> list[tuple[list[tuple[int, int]], int]]:
    """Per trie, the order of the blocks and how many bits the two on top have."""
    blocks = blocks_of(budget)
    made = []
    for pair in combinations(range(len(blocks)), 2):
        top = [blocks[k] for k in pair]
        made.append((top + [block for k, block in enumerate(blocks) if k not in pair], sum(width for _, width in top)))
    return made


def reordered(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The fingerprint with its blocks in another order."""
    left, made = BITS, F.lit(0).cast("bigint")
    for shift, width in order:
        left -= width
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        made = made.bitwiseOR(F.shiftleft(part, left))
    return made


def tries(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(trie, moved, top, fp): every fingerprint in every trie, with its bits in the trie's order."""
    entries = []
    for number, (order, lead) in enumerate(orders(budget)):
        moved = reordered(F.col("fp"), order)
        entries.append(
            F.struct(F.lit(number).alias("trie"), moved.alias("moved"), F.shiftrightunsigned(moved, BITS - lead).alias("top"))
        )
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.trie", "e.moved", "e.top", "fp")


def in_tasks(rows: DataFrame, keys: list[str], depth: Column, budget: int) -> DataFrame:
    """A spanning forest of the links inside each group of rows, many groups at once in a task.

    A group is a pair of nodes at ``depth`` that differ in ``spent`` bits: the rows of ``side`` 0 are
    those of one, the rows of ``side`` 1 those of the other; without any there it is a node with itself.
    """

    def complete(held: pd.DataFrame) -> pd.DataFrame:
        opens = np.flatnonzero(changes(held, [*keys, "side"]))
        nodes = np.stack([opens, np.append(opens[1:], len(held))], 1)
        second = held["side"].to_numpy()[opens] == 1
        # a node of side 1 comes right behind its partner; one without a partner, or a partner of none, has no pair
        paired = np.append(second[1:], False) & ~second
        changed = changes(held, keys)[opens]
        paired &= ~np.append(changed[1:], True)
        u = nodes[~second]
        v = np.where(paired[:, None], np.roll(nodes, -1, axis=0), nodes)[~second]
        values = held["moved"].to_numpy().view(np.uint64)
        at, spent = (held[name].to_numpy(dtype=np.int64)[u[:, 0]] for name in ("depth", "spent"))
        several = (u[:, 1] - u[:, 0] > 1) | (u[:, 0] != v[:, 0])
        links = walk(values, u[several], v[several], at[several], spent[several], budget)
        roots = forest(len(held), links)
        fps, linked = held["fp"].to_numpy(), roots != np.arange(len(held))
        return pd.DataFrame({"a": fps[roots[linked]], "b": fps[linked]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < BATCH_ROWS:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = int(np.flatnonzero(changes(whole, keys))[-1])  # this group may go on in the next batch
            if last:
                yield complete(whole.iloc[:last])
            held = [whole.iloc[last:]]
        if held and sum(map(len, held)):
            yield complete(pd.concat(held, ignore_index=True))

    unsigned = F.col("moved").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "side", unsigned)
    return dealt.select(*keys, "side", "spent", "moved", "fp", depth.alias("depth")).mapInPandas(run, "a bigint, b bigint")


def changes(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where sorted rows begin another group."""
    columns = [rows[key].to_numpy() for key in keys]
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def bucket_links(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A spanning forest of the links inside each small bucket; rows as ``tries`` gives them."""
    lead = F.element_at(F.array(*[F.lit(bits) for _, bits in orders(budget)]), F.col("trie") + 1)
    return in_tasks(rows.withColumns({"side": F.lit(0), "spent": F.lit(0)}), ["trie", "top"], lead, budget)


def nibble_links(fps: DataFrame) -> DataFrame:
    """Fingerprints that differ within one group of four bits, each with the smallest of them."""
    masked = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(~(15 << 4 * k) % (1 << 64)))).alias("rest")) for k in range(16)]
    placed = fps.select("fp", F.explode(F.array(*masked)).alias("m")).select("fp", "m.k", "m.rest")
    low = placed.groupBy("k", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return placed.join(low, ["k", "rest"]).where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("moved", BITS - depth) if depth else F.lit(0).cast("bigint")


def node_pairs(rows: DataFrame, budget: int, chunk: int, step: int) -> Iterator[tuple[int, DataFrame]]:
    """The walk over large buckets: (depth, pairs of nodes that a task can take) for one depth after the other.

    ``rows`` are (trie, moved, root, fp) of the buckets; ``root`` names the component of each so far.
    """
    spark = rows.sparkSession
    first = min(lead for _, lead in orders(budget))
    frontier, depth = None, first - 1
    while True:
        depth = min(BITS, depth + (1 if frontier is None else step))
        nodes = rows.groupBy("trie", _prefix(depth).alias("node")).agg(
            F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")
        )
        nodes = stage(nodes, "nodes")
        if frontier is None:
            # the tops of some tries are a bit longer: that bit has no budget, which the pairs below can't break
            pairs = nodes.select("trie", F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0).alias("spent"))
        else:
            up = depth - before
            child = nodes.select(F.col("trie"), F.shiftrightunsigned("node", up).alias("parent"), F.col("node"))
            left = child.select("trie", F.col("parent").alias("u"), F.col("node").alias("cu"))
            right = child.select("trie", F.col("parent").alias("v"), F.col("node").alias("cv"))
            cost = F.col("spent") + F.bit_count(F.col("cu").bitwiseXOR(F.col("cv")))
            half = (F.col("u") != F.col("v")) | (F.col("cu") <= F.col("cv"))
            pairs = frontier.join(left, ["trie", "u"]).join(right, ["trie", "v"])
            pairs = pairs.withColumn("spent", (F.col("spent") + F.bit_count(
                F.col("cu").bitwiseXOR(F.col("cv")).bitwiseAND(F.lit((1 << up) - 1).cast("bigint"))
            )).cast("int")).where(half & (F.col("spent") <= budget))
            pairs = pairs.select("trie", F.col("cu").alias("u"), F.col("cv").alias("v"), "spent")
        of_u = nodes.select("trie", F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("low").alias("low_u"), F.col("high").alias("high_u"))
        of_v = nodes.select("trie", F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("low").alias("low_v"), F.col("high").alias("high_v"))
        sized = pairs.join(of_u, ["trie", "u"]).join(of_v, ["trie", "v"])
        apart = F.least("low_u", "low_v") != F.greatest("high_u", "high_v")
        small = (F.col("n_u") <= chunk) & (F.col("n_v") <= chunk)
        sized = stage(sized.where(apart).select("trie", "u", "v", "spent", small.alias("small")), "pairs")
        ready = sized.where("small").drop("small")
        yield depth, ready
        frontier, before = sized.where("not small").drop("small"), depth
        if depth == BITS or frontier.isEmpty():
            return


def pair_links(rows: DataFrame, pairs: DataFrame, depth: int, budget: int = BUDGET) -> DataFrame:
    """A spanning forest of the links of each pair of nodes."""
    placed = rows.select("trie", "moved", "fp", _prefix(depth).alias("node"))
    left = pairs.select("trie", F.col("u").alias("node"), "u", "v", "spent", F.lit(0).alias("side"))
    right = pairs.where("u <> v").select("trie", F.col("v").alias("node"), "u", "v", "spent", F.lit(1).alias("side"))
    dealt = left.unionByName(right).join(placed, ["trie", "node"])
    return in_tasks(dealt, ["trie", "u", "v"], F.lit(depth), budget)


def links(fps: DataFrame, budget: int = BUDGET, chunk: int = CHUNK, step: int = STEP) -> DataFrame:
    """Links (a, b) of different fingerprints that connect whatever differs in at most ``budget`` bits."""
    rows = tries(fps, budget)
    large = stage(rows.groupBy("trie", "top").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("trie", "top"), "large")
    if large.isEmpty():
        return bucket_links(rows, budget)
    found = bucket_links(rows.join(large, ["trie", "top"], "left_anti"), budget)
    hot = stage(rows.join(large, ["trie", "top"]).select("trie", "moved", "fp"), "hot")
    found = stage(found.unionByName(nibble_links(hot.select("fp").distinct())), "links") if budget >= 4 else stage(found, "links")
    roots = components(found).withColumnRenamed("key", "fp")
    classed = stage(hot.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classed")
    for depth, ready in node_pairs(classed, budget, chunk, step):
        found = found.unionByName(stage(pair_links(classed, ready, depth, budget), "links"))
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BUDGET,
    chunk: int = CHUNK, step: int = STEP,
) -> DataFrame:
    """(id, fingerprint, component_id) per row: 16 hex digits, and the smallest id that it is connected with."""
    rows = stage(fingerprints(docs, id_col, text_col, words).select(F.col(f"`{id_col}`").alias("id"), "fp"), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min(F.struct("id")).alias("low")), "distinct")
    edges = stage(links(fps.select("fp"), budget, chunk, step), "links")
    roots = components(edges).withColumnRenamed("key", "fp")
    rooted = stage(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("least"))
    named = rooted.join(lowest, "root").select("fp", F.col("least.id").alias("component_id"))
    made = rows.join(named, "fp")
    return made.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
