"""Near-duplicates by ProbMinHash, banding and verification.

A text is a bag of five-word shingles; its similarity with another is the probability Jaccard index of
the two weight vectors. ProbMinHash lets every shingle arrive again and again, as a Poisson process
whose rate is the shingle's weight; each arrival falls into a random register, a register keeps the
shingle that came first, and a shingle stops as soon as its next arrival is later than the latest
register. Two texts agree in a register with a probability equal to their similarity.

Registers are grouped into bands. Texts that share a band are candidates, which are verified on their
shingles, and verified links are joined into classes. No bucket is expanded into all its pairs: first
every member is compared with the leader of its bucket, the member that shares buckets with most others,
as a group's original does with its copies; after that only members of different classes meet, and all of those do whose sketches, a second signature, don't rule it out, so no candidate link
between classes is lost.

Equal texts (up to case) are one text from the start, whatever their number. Intermediate tables go to
the shared folder; nothing is collected.

Defined cases: a null text is an empty one; a text without words has no shingles and is a class of its
own; one of fewer than five words is a single shingle; repeated rows are in the same class; an empty
table gives an empty result; a null id stays null and is the smallest; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import per_batch, unused, utf8
from emberline.session import stage

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_SIZE = 32, 6
SKETCH_WORDS, PER_WORD = 72, 7
SKETCH = SKETCH_WORDS * PER_WORD
BATCH_SHINGLES = 400_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Shingler:
    """Weighted shingles of texts; hashes of words are kept while the table stays small."""

    def __init__(self, words: int = WORDS, cached: int = 300_000):
        self.words, self.cached = words, cached
        self.hashes: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        found = self.hashes.get(word)
        if found is None:
            if len(self.hashes) > self.cached:
                self.hashes.clear()
            found = self.hashes[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes in order, and how often each occurs."""
        words = utf8((text or "").lower()).split()
        if not words:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        hashes = np.fromiter(map(self._hash, words), np.uint64, len(words))
        width = min(self.words, len(words))
        rolled = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for shift in range(width):
            rolled = rolled * PRIME + hashes[shift : shift + len(rolled)]
        return np.unique(mixed(rolled), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of registers per bag; bags must not be empty.

    All shingles of all bags take their next arrival together, one round after the other. A shingle
    leaves once its arrival is later than the latest register of its bag.
    """
    sizes = [len(shingles) for shingles, _ in bags]
    shingle = np.concatenate([shingles for shingles, _ in bags])
    rate = np.concatenate([counts for _, counts in bags]).astype(np.float64)
    bag = np.repeat(np.arange(len(bags)), sizes)
    first = np.full(len(bags) * registers, np.inf)
    held = np.zeros(len(bags) * registers, dtype=np.uint64)
    time = np.zeros(len(shingle))
    arrival = 0
    while len(shingle):
        arrival += 1
        draw = mixed(shingle + np.uint64(arrival * int(PRIME) % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        place = bag * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        held[place[won]] = shingle[won]
        latest = first.reshape(len(bags), registers).max(axis=1)
        on = time < latest[bag]
        shingle, rate, bag, time = shingle[on], rate[on], bag[on], time[on]
    return held.reshape(len(bags), registers)


def band_keys(rows: np.ndarray, bands: int, size: int) -> np.ndarray:
    """One key per band: a hash of its registers and its number."""
    keys = np.empty((len(rows), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(rows), (band + 1) * int(PRIME) % 2**64, dtype=np.uint64)
        for column in range(band * size, (band + 1) * size):
            key = mixed(key * PRIME + rows[:, column])
        keys[:, band] = key
    return keys


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two bags: the sum over common shingles of 1 / sum(max(a'/a, b'/b)).

    Sorted by the ratio of the two weights, the inner sum is a suffix sum of one bag plus a prefix sum
    of the other.
    """
    both, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][in_a].astype(np.float64), b[1][in_b].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    # shingle j of a higher ratio counts by a's weight relative to i's, one of a lower ratio by b's
    from_a = only_a + np.cumsum(x[::-1])[::-1]
    from_b = only_b + np.cumsum(y) - y
    return float((1.0 / (from_a / x + from_b / y)).sum())


def key_of(text: Column) -> Column:
    """Equal for texts that are equal up to case."""
    return F.unhex(F.md5(F.lower(F.coalesce(text, F.lit("")))))


def banded(docs: DataFrame, id_col: str, text_col: str, bands: int, size: int) -> DataFrame:
    """(id, key, bands): an empty array for texts without words."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), key_of(text).alias("key")).alias("row"), text.alias("text"))

    def compute():
        shingle = Shingler()

        def run(texts: list[str]) -> Iterator[list[tuple]]:
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for text in texts:
                bag = shingle(text)
                waiting.append(bag)
                held += len(bag[0])
                if held > BATCH_SHINGLES or len(waiting) >= 2_000:
                    yield keyed(waiting)
                    waiting, held = [], 0
            if waiting:
                yield keyed(waiting)

        def keyed(bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
            full = [bag for bag in bags if len(bag[0])]
            found = iter(band_keys(signatures(full, bands * size), bands, size).view(np.int64).tolist() if full else [])
            return [(next(found) if len(bag[0]) else [],) for bag in bags]

        return run

    return per_batch(rows, "row", "text", "bands array<bigint>", compute).select("row.id", "row.key", "bands")


def bags_of(texts: DataFrame) -> DataFrame:
    """(key, text) to (key, bag): shingles as 32-bit numbers, then their counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for frame in frames:
            bags = []
            for text in frame["text"]:
                hashes, counts = shingle(text)
                short, place = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                bags.append(short.tobytes() + np.bincount(place, counts, len(short)).astype(np.uint32).tobytes())
            yield pd.DataFrame({"key": frame["key"], "bag": bags})

    return texts.mapInPandas(run, "key binary, bag binary")


def _bag(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(packed, dtype=np.uint32)
    return numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :].astype(np.int64)


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    left = bags.select(F.col("key").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            alike = [
                probability_jaccard(_bag(a), _bag(b)) >= similarity - 1e-9
                for a, b in zip(frame["bag_a"], frame["bag_b"])
            ]
            yield frame.loc[alike, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) for every key in an edge (a, b): the smallest key that it is connected with.

    Every key takes the smallest root among its neighbours, then its root's root, until nothing
    changes; each round is a table in the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    roots = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        closer = roots.join(near, F.col("key") == F.col("a")).select("key", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = closer.select(F.col("key").alias("root"), F.col("root").alias("further"))
        moved = stage(
            closer.join(jump, "root", "left").select("key", F.least("root", F.coalesce("further", "root")).alias("root"), "was"),
            "roots",
        )
        roots = moved.select("key", "root")
        if moved.where(F.col("root") != F.col("was")).isEmpty():
            return roots


def sketches_of(bags: DataFrame) -> DataFrame:
    """(key, sketch): a second signature of each bag, independent of the bands.

    A byte of each register is kept, seven to a word, which lets words be compared without overflow.
    """
    shifts = np.arange(PER_WORD, dtype=np.uint64) * np.uint64(8)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 500):
                part = frame.iloc[start : start + 500]
                found = [_bag(packed) for packed in part["bag"]]
                rows = signatures([(mixed(s.astype(np.uint64) + np.uint64(1)), n) for s, n in found], SKETCH)
                octets = (rows >> np.uint64(56)).reshape(len(rows), SKETCH_WORDS, PER_WORD)
                words = np.bitwise_or.reduce(octets << shifts, axis=2)
                yield pd.DataFrame({"key": part["key"], "sketch": list(words.astype(np.int64))})

    return bags.mapInPandas(run, "key binary, sketch array<bigint>")


def _agreement(a: str, b: str) -> Column:
    """In how many registers two sketches agree: bytes that are zero in the difference of their words."""
    low, high = (F.lit(sum(bits << 8 * k for k in range(PER_WORD))).cast("bigint") for bits in (0x7F, 0x80))

    def differing(x: Column, y: Column) -> Column:
        gap = x.bitwiseXOR(y)
        return F.bit_count((gap.bitwiseAND(low) + low).bitwiseOR(gap).bitwiseAND(high))

    return F.lit(SKETCH) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, one: total + one)


def _cross(members: DataFrame, bags: DataFrame | None, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of one bucket that are in different classes.

    Without bags: of each member with the bucket's leader, the member of the greatest weight. With bags:
    all whose sketches let a similar pair seem possible, by four standard deviations of their estimate.
    Two members that are in one class already are not compared, so a large class costs nothing here.
    """
    if bags is None:
        leader = F.max_by(F.struct("key", "root"), F.struct("weight", "key")).alias("leader")
        led = members.join(members.groupBy("bucket").agg(leader), "bucket")
        pairs = led.where(F.col("root") != F.col("leader.root")).select("key", F.col("leader.key").alias("other"))
    else:
        # first the classes that share a bucket, then their members: the members of one class never meet
        # the largest class of each bucket with several; its own members never meet
        sizes = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("bucket").agg(
            F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("classes")
        )
        mixed_up = members.join(largest.where(F.col("classes") > 1).drop("classes"), "bucket")
        # all buckets of a text that hold several classes: a pair is made in the first that both are in
        lists = mixed_up.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))
        sketches = stage(sketches_of(bags.join(lists.select("key"), "key", "left_semi")), "sketches")
        sketched = mixed_up.join(sketches.join(lists, "key"), "key")
        outside = sketched.where(F.col("root") != F.col("largest"))
        other = sketched.select(
            "bucket", F.col("key").alias("other"), F.col("root").alias("its_root"), F.col("sketch").alias("its_sketch"),
            F.col("buckets").alias("its_buckets"),
        )
        spread = (similarity * (1 - similarity) / SKETCH) ** 0.5
        least = int((similarity - 4 * spread) * SKETCH)
        once = (F.col("its_root") == F.col("largest")) | (F.col("key") < F.col("other"))
        here = F.array_min(F.array_intersect("buckets", "its_buckets")) == F.col("l.bucket")
        near = (F.col("root") != F.col("its_root")) & once & here & (_agreement("sketch", "its_sketch") >= least)
        pairs = outside.alias("l").join(
            other.alias("r"), (F.col("l.bucket") == F.col("r.bucket")) & near
        )
    return pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def text_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    bands: int = BANDS, band_size: int = BAND_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, key, single) per row, and (key, id, class_key, class_id) per different text.

    ``id`` of a key is the smallest id with that text, ``class_id`` the smallest of the class.
    """
    rows = stage(banded(docs, id_col, text_col, bands, band_size), "bands")
    texts = stage(
        rows.where(F.size("bands") > 0).groupBy("key").agg(F.min(F.struct("id")).alias("low"), F.max("bands").alias("bands"))
        .select("key", F.col("low.id").alias("id"), "bands"),
        "texts",
    )
    placed = texts.select("key", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = placed.join(shared, "bucket")
    # a text that many others share a bucket with lies in the middle of its group and leads best
    weights = members.groupBy("key").agg(F.sum("n").alias("weight"))
    members = stage(members.drop("n").join(weights, "key").select("key", "bucket", "weight"), "members")
    wanted = texts.join(members.select("key").distinct(), "key", "left_semi").select("key", "id")
    source = docs.select(
        F.col(f"`{id_col}`").alias("own"), key_of(F.col(f"`{text_col}`")).alias("own_key"), F.col(f"`{text_col}`").alias("text")
    )
    found = source.join(wanted, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    bags = stage(bags_of(found.select("key", "text")).dropDuplicates(["key"]), "bags")

    alone = members.withColumn("root", F.col("key"))
    led = stage(_cross(alone, None, similarity), "pairs")
    if led.isEmpty():
        classes = texts.select("key", "id", F.col("key").alias("class_key"), F.col("id").alias("class_id"))
        return rows, classes
    roots = components(stage(verified(led, bags, similarity), "verified"))
    classed = members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rest = _cross(stage(classed, "classed"), bags, similarity).join(led, ["a", "b"], "left_anti")
    links = verified(stage(rest, "pairs"), bags, similarity)
    # links between classes: only their roots matter now
    for side in ("a", "b"):
        own = roots.select(F.col("key").alias(side), F.col("root").alias("_root"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    links = stage(links.where(F.col("a") != F.col("b")).distinct(), "links")
    if not links.isEmpty():
        above = components(links).select(F.col("key").alias("root"), F.col("root").alias("top"))
        grown = roots.join(above, "root", "left").select("key", F.coalesce("top", "root").alias("root"))
        roots = grown.unionByName(above.select(F.col("root").alias("key"), F.col("top").alias("root"))).distinct()
    rooted = texts.select("key", "id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = stage(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min(F.struct("id", "key")).alias("low"))
    classes = rooted.join(lowest, "root").select(
        "key", "id", F.col("low.key").alias("class_key"), F.col("low.id").alias("class_id")
    )
    return rows, stage(classes, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) per row: the smallest id among the texts it is connected with by similar pairs."""
    rows, classes = text_classes(docs, id_col, text_col, similarity)
    of = classes.select("key", "class_id")
    own = F.when(F.size("bands") > 0, F.col("class_id")).otherwise(F.col("id"))
    return rows.select("id", "key", "bands").join(of, "key", "left").select(
        F.col("id").alias(id_col), own.alias("class_id")
    )


def _marked(value: Column) -> Column:
    """An id as text that tells null from every value."""
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), value.cast("string")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without all but one of each class, the one with the smallest id.

    Texts without words are all kept; of rows that repeat an id with its text one is kept.
    """
    _, classes = text_classes(docs, id_col, text_col, similarity)
    own, mark, key, low = (unused(docs, name) for name in ("own_key", "mark", "key", "low"))
    chosen = classes.where(F.col("key") == F.col("class_key"))
    chosen = chosen.select(F.col("key").alias(key), _marked(F.col("id")).alias(low))
    text = F.col(f"`{text_col}`")
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^ \t\n\r\x0b\f]")
    rows = docs.where(~wordless).select("*", key_of(text).alias(own), _marked(F.col(f"`{id_col}`")).alias(mark))
    first = rows.join(chosen, (F.col(own) == F.col(key)) & (F.col(mark) == F.col(low)))
    # the join has dealt the rows out by what they are told apart by here
    first = first.dropDuplicates([own, mark]).select(*[F.col(f"`{name}`") for name in docs.columns])
    return first.unionByName(docs.where(wordless))
