"""Operator 10: exact Jaccard join on word shingles with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, discard, held, small_batches, width, written
from tesserae.llm.shingles import mixed, shingle_sets, wide_sets

PLACES = 22  # bits of a counter's number in the frequency table, whatever the size of the corpus
BUCKETS = 1 << PLACES
SEGMENTS = 64
NARROW, WIDEST = 4096, 1 << 16  # bits of a bitmap in a tree, the least of a set's own, and the most
STARS = 4
BLOCK = 512
FAN = 8
SMALL = 2_000_000  # keys that may be broadcast: 16 MB

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64) | np.uint64(1)


def least_overlap(n, parts: tuple[int, int] = (80, 100)):
    """The least intersection of a set of n with any set that it links with."""
    return -(-parts[0] * n // parts[1])


def _count(n: int):
    """First pass: how often the shingles of each bucket occur in this partition's texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("shingles")
        counts, wait, size, some = np.zeros(BUCKETS, np.int32), [], 0, False

        def add() -> None:
            places, n = np.unique(np.concatenate(wait) >> np.uint64(64 - PLACES), return_counts=True)
            counts[places.astype(np.int64)] += n.astype(np.int32)

        for batch in batches:
            for s in shingle_sets(iter(batch["text"]), n):
                wait.append(s)
                size += len(s)
                if size > 1 << 18:
                    add()
                    wait, size, some = [], 0, True
        if size:
            add()
        if size or some:
            parts = np.minimum(counts, 255).astype(np.uint8).reshape(SEGMENTS, -1)
            yield pd.DataFrame({"segment": range(SEGMENTS), "counts": [x.tobytes() for x in parts]})

    return run


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch["segment"], batch["counts"], strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint8).astype(np.int64)
    out = {k: np.minimum(x, 65_535).astype(np.uint16).tobytes() for k, x in sums.items()}
    yield pd.DataFrame({"segment": list(out), "counts": list(out.values())}).astype({"segment": "int32"})


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each of BUCKETS buckets occur in all texts: a table of a fixed size (8 MB).

    A task's own count stops at 255 and the sum at 65535. The table only sets an order of shingles, the same for
    all documents; any order is exact.
    """
    parts = docs.select("text").mapInPandas(_count(n), "segment int, counts binary")
    got = parts.repartition(SEGMENTS, "segment").mapInPandas(_add, "segment int, counts binary").collect()
    out = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.uint16)
    for k, raw in got:
        out[k] = np.frombuffer(raw, np.uint16)
    return out.ravel()


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` places the hashes of a set fall on."""
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out)


def width_of(n: int) -> int:
    """Places of the bitmap of a set of n: a power of two, twice n at least."""
    return min(max(NARROW, 1 << int(2 * n - 1).bit_length()), WIDEST)


def _folded(raws: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words, folded to ``size`` bytes: place k goes to k modulo the new width."""
    wide = np.frombuffer(b"".join(raws), np.uint64).reshape(len(raws), -1, size // 8)
    return np.bitwise_or.reduce(wide, axis=1)


def _describe(n: int, common, parts: tuple[int, int]):
    """Second pass, a row for each document: size, key, bitmap, star keys, and its rarest shingles.

    Sets that link share one of each other's size - least_overlap + 1 rarest shingles, whatever the order; the
    frequency table makes frequent shingles come last.
    """

    @F.pandas_udf("struct<n: long, k1: long, k2: long, bits: binary, stars: array<long>, typical: double, rare: binary>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        held("shingles")
        often, rows = common.value, []
        for s in shingle_sets(iter(texts), n):
            size = len(s)
            if not size:
                rows.append((0, 0, 0, None, None, None, None))
                continue
            counts = often[(s >> np.uint64(64 - PLACES)).astype(np.int64)]
            order = np.argsort(counts, kind="stable")
            rare = s[order[: size - least_overlap(size, parts) + 1]]
            stars = [int(mixed(s * odd).min().astype(np.int64)) for odd in _ODD]
            rows.append((size, *set_key(s), bitmap(s, width_of(size)).tobytes(), stars, float(np.log(np.maximum(counts, 1)).mean()), rare.tobytes()))
        return pd.DataFrame(rows, columns=["n", "k1", "k2", "bits", "stars", "typical", "rare"])

    return describe.asNondeterministic()  # evaluated once


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rare = [np.frombuffer(x, np.int64) for x in batch["rare"]]
        lengths = list(map(len, rare))
        yield pd.DataFrame(
            {
                "token": np.concatenate(rare) if rare else np.zeros(0, np.int64),
                "set": np.repeat(batch["set"].to_numpy(), lengths),
                "root": np.repeat(batch["root"].to_numpy(), lengths),
            }
        )


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Tree:
    """Sets in order of size and likeness, in nodes of FAN children up to one root.

    A node holds the OR of its bitmaps, its range of sizes, the most shingles that share a bit with another of
    their set (slack), and its component if all below it have the same.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, root: np.ndarray):
        self.order = np.lexsort((bits[:, 0], root, n))
        n, bits, root = n[self.order], bits[self.order], root[self.order]
        self.levels = [(bits, n, n, n - _pop(bits), root, np.ones(len(n), bool))]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, slack, root, one = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            single = np.logical_and.reduceat(one, at) & (np.minimum.reduceat(root, at) == np.maximum.reduceat(root, at))
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                    np.maximum.reduceat(slack, at), root[at], single,
                )
            )

    def children(self, level: int, i: np.ndarray) -> np.ndarray:
        return np.minimum(i[:, None] * FAN + np.arange(FAN), len(self.levels[level - 1][1]) - 1)


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, parts: tuple[int, int]) -> np.ndarray:
    """Whether node pairs may hold a link: not one known component, sizes that fit, and overlap enough."""
    p, q = parts
    ok = ~(a[5][i] & b[5][j] & (a[4][i] == b[4][j]))
    ok &= p * np.maximum(a[1][i], b[1][j]) <= q * np.minimum(a[2][i], b[2][j])
    both = _pop(a[0][i] & b[0][j])
    most = np.minimum(np.minimum(a[3][i] + both, b[3][j] + both), np.minimum(a[2][i], b[2][j]))
    # intersection >= p/q union is the same as (p + q) intersection >= p (size + size)
    return ok & ((p + q) * most >= p * (a[1][i] + b[1][j]))


def joined(left: Tree, right: Tree | None, parts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal from both roots down: places (in the given order of rows) of pairs that may link."""
    same, right = right is None, right or left
    la, lb = len(left.levels) - 1, len(right.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = possible(left.levels[la], right.levels[lb], i, j, parts)
        i, j = i[keep], j[keep]
        if la == lb == 0 or not len(i):
            break
        down_a, down_b = la >= lb, lb >= la
        ci = left.children(la, i) if down_a else i[:, None]
        cj = right.children(lb, j) if down_b else j[:, None]
        i, j = (x.ravel() for x in np.broadcast_arrays(ci[:, :, None], cj[:, None, :]))
        la, lb = la - down_a, lb - down_b
        pair = np.unique(i * (len(right.levels[lb][1]) + 1) + j)  # the last children repeat
        i, j = pair // (len(right.levels[lb][1]) + 1), pair % (len(right.levels[lb][1]) + 1)
        if same and la == lb:
            i, j = i[i <= j], j[i <= j]
    if same:
        i, j = i[i < j], j[i < j]
    return left.order[i], right.order[j]


def _tree_join(parts: tuple[int, int]):
    """Joins the sets of each shingle's group, read from partitions sorted by group."""
    names = ["token", "i", "j"]

    def pairs(g: dict[str, np.ndarray]) -> np.ndarray:
        def tree(own: np.ndarray) -> Tree:
            return Tree(g["n"][own], g["bits"][own], g["root"][own])

        own = np.arange(len(g["set"]))
        if g["i"][0] == g["j"][0]:
            a, b = joined(tree(own), None, parts)
        else:
            one, two = own[g["side"] == g["i"][0]], own[g["side"] == g["j"][0]]
            if not len(one) or not len(two):
                return np.zeros((0, 2), np.int64)
            a, b = joined(tree(one), tree(two), parts)
            a, b = one[a], two[b]
        x, y = g["set"][a], g["set"][b]
        return np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)

    def leaves(g: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Groups that one node holds: the leaf step of the traversal, for all of them at once."""
        out = [np.zeros((0, 2), np.int64)]
        slack, one = g["n"] - _pop(g["bits"]), np.ones(len(g["n"]), bool)
        level = (g["bits"], g["n"], g["n"], slack, g["root"], one)
        for gap in range(1, FAN):
            for first in range(FAN - gap):
                i = start[size > first + gap] + first
                j = i + gap
                keep = possible(level, level, i, j, parts)
                keep &= (g["i"][i] == g["j"][i]) | (g["side"][i] != g["side"][j])
                x, y = g["set"][i[keep]], g["set"][j[keep]]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        return np.concatenate(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait: dict[str, np.ndarray] | None = None

        def cut(g: dict[str, np.ndarray], last: bool):
            marks = np.stack([g[x] for x in names], axis=1)
            edges = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(marks)]
            stop = len(edges) - 1 if last else len(edges) - 2
            size = np.diff(edges[: stop + 1])
            large = np.flatnonzero(size > FAN)
            out = [pairs({k: v[edges[x] : edges[x + 1]] for k, v in g.items()}) for x in large]
            out.append(leaves(g, edges[:stop][size <= FAN], size[size <= FAN]))
            rest = None if last else {k: v[edges[-2] :] for k, v in g.items()}
            found = np.unique(np.concatenate(out), axis=0)
            return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]}), rest

        for batch in batches:
            if not len(batch):
                continue
            g = {c: batch[c].to_numpy() for c in batch.columns if c != "bits"}
            g["bits"] = np.frombuffer(b"".join(batch["bits"]), np.uint64).reshape(len(batch), -1)
            if wait is not None:
                g = {k: np.concatenate([wait[k], v]) for k, v in g.items()}
            found, wait = cut(g, False)
            yield found
        if wait is not None:
            yield cut(wait, True)[0]

    return run


def _narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold every bitmap to the width of the trees."""
    for batch in batches:
        yield batch.assign(bits=[_folded([x], NARROW // 8).tobytes() for x in batch["bits"]])


def _bounded(parts: tuple[int, int]):
    """Pairs whose bitmaps, at the width of the narrower one, leave room for a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, m = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            widths = np.stack([batch["bits_a"].map(len), batch["bits_b"].map(len)], axis=1) if len(batch) else np.zeros((0, 2), int)
            keep = np.zeros(len(batch), bool)
            for pair in np.unique(widths, axis=0):
                own = np.flatnonzero((widths == pair).all(axis=1))
                for at in np.array_split(own, -(-len(own) * int(pair.max()) // (8 << 20))):
                    x, y = (_folded(list(batch[c].iloc[at]), int(pair.min())) for c in ("bits_a", "bits_b"))
                    most = np.minimum(n[at] - _pop(x & ~y), m[at] - _pop(y & ~x))
                    keep[at] = sum(parts) * most >= parts[0] * (n[at] + m[at])
            yield batch.loc[keep, ["a", "b"]]

    return run


def _sets(n: int):
    """Whole sets again, 128 bits of each shingle, for the documents that stand in a pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own in wide_sets(iter(batch["text"]), n):
                rows.append((*(set_key(own[0]) if own.size else (0, 0)), own.tobytes()))
            yield pd.DataFrame(rows, columns=["k1", "k2", "all"])

    return run


def _exact(parts: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["all_a"], batch["all_b"], strict=True):
                x, y = (np.frombuffer(z, np.uint64).reshape(2, -1) for z in (x, y))
                at = np.minimum(np.searchsorted(y[0], x[0]), y.shape[1] - 1)
                both = int((y[:, at] == x).all(axis=0).sum())
                keep.append(parts[1] * both >= parts[0] * (x.shape[1] + y.shape[1] - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _few(keys: DataFrame) -> DataFrame:
    """Keys, written, and marked for a broadcast if they are few enough."""
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, parts: tuple[int, int]) -> DataFrame:
    """The pairs that link: bitmaps first, then whole sets made again from the texts of the documents concerned."""
    pairs = written(pairs, "candidates")
    ends = reps.join(_few(_named(pairs)), "set", "left_semi").select("set", "n", "bits", "k1", "k2", "text_hash")
    ends = written(ends, "ends")
    side = lambda x: ends.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(
        f"{parts[0]} * greatest(n_a, n_b) <= {parts[1]} * least(n_a, n_b)"
    )
    near = written(near.mapInPandas(_bounded(parts), "a long, b long"), "pairs")
    wanted = written(ends.select("set", "k1", "k2", "text_hash").join(_few(_named(near)), "set", "left_semi"), "wanted")
    hashes = _few(wanted.select("text_hash").distinct())
    sets = docs.join(hashes, "text_hash", "left_semi").select("text").mapInPandas(_sets(n), "k1 long, k2 long, `all` binary")
    sets = sets.join(wanted.select("set", "k1", "k2"), ["k1", "k2"]).drop("k1", "k2")
    sets = written(sets.dropDuplicates(["set"]), "sets")
    side = lambda x: sets.select(F.col("set").alias(x), F.col("all").alias(f"all_{x}"))
    found = near.join(side("a"), "a").join(side("b"), "b").mapInPandas(_exact(parts), "a long, b long")
    found = written(found, "links")
    discard(pairs, ends, near, wanted, sets)
    return found


def _live(posts: DataFrame) -> DataFrame:
    """The postings of shingles that sets of different components share, each group of sets once.

    Near copies share many rare shingles, so most groups hold the same sets as another one. Groups are compared
    by number of sets and two hashes; the group of the smallest token stays.
    """
    ends = posts.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    live = written(posts.join(_few(ends.where("low < high").select("token")), "token"), "postings")
    same = live.groupBy("token").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("set")).alias("h1"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("h2")
    )
    first = same.groupBy("c", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    out = written(live.join(_few(first), "token"), "live")
    discard(live)
    return out


def _blocks(live: DataFrame) -> DataFrame:
    """Pairs of blocks to compare: sets of each group beside ``i`` and ``j``, and the block that they are of.

    A group of up to BLOCK sets is one block. In a larger one the component with most sets has blocks of its own,
    which are not compared with one another, so that sets which already hang together cost no pairs.
    """
    sizes = live.groupBy("token", "root").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("token").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("c"))
    sizes = sizes.select(
        "token", F.col("main.root").alias("main"), (F.col("c") <= BLOCK).alias("one"), F.ceil(F.col("main.c") / BLOCK).cast("int").alias("own"),
        F.greatest(F.ceil((F.col("c") - F.col("main.c")) / BLOCK), F.lit(1)).cast("int").alias("rest"),
    )
    is_main = F.col("root") == F.col("main")
    at = F.when(is_main, F.col("rest") + F.pmod(F.hash("set"), "own")).otherwise(F.pmod(F.hash("set"), "rest"))
    placed = live.join(sizes, "token").withColumn("side", F.when(F.col("one"), F.lit(0)).otherwise(at))
    last = F.when(F.col("one"), F.lit(0)).when(is_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("own") - 1)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("token", "set", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))


def near_sets(docs: DataFrame, words: int = 5, parts: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents joined by links: parts[1] * intersection >= parts[0] * union of their word shingles.

    Returns doc_id, text_hash, n_shingles, component_id (the smallest id that links reach) and kept (true for one
    text of each group) for every row. No link between different sets is lost; shingles are compared by 128 bits.

    1. Equal sets become one; links between sets with an equal minimum under one of a few hash orders, each to
       the most typical of its group (its shingles are the most frequent ones), are verified. They join large groups
       of near copies in linear work.
    2. Sets that link share one of their rarest shingles. Sets of a rare shingle that are not one component yet
       form signature trees (bitmaps, size ranges), in blocks where a shingle has very many; shingles that the same
       sets share are one group. Dual traversal drops node pairs whose largest possible overlap is too small. What
       is left is verified on whole sets.

    Null or empty texts, or texts without words: no shingles, alone. Repeated rows are copies of one another. Null
    ids name a group only if it has no other. Very long texts are hashed a block at a time. An empty table gives no
    rows. Only columns ``id_col`` and ``text_col`` are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    common = spark.sparkContext.broadcast(frequencies(docs, words))
    rows = docs.select("doc_id", "text_hash", _describe(words, common, parts)("text").alias("own"))
    rows = rows.select("doc_id", "text_hash", "own.*").withColumn("uid", F.monotonically_increasing_id())
    rows = written(rows, "documents")
    common.unpersist()  # workers drop their copies
    lows = rows.where("n > 0").groupBy("k1", "k2").agg(
        F.min("uid").alias("set"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("low")
    )
    lows = written(lows, "lows")
    reps = rows.drop("doc_id").withColumnRenamed("uid", "set").join(lows.select("set"), "set", "left_semi")
    reps = written(reps, "reps")

    star = reps.select("set", "typical", F.posexplode("stars").alias("k", "least"))
    centre = star.groupBy("k", "least").agg(F.max(F.struct("typical", "set"))["set"].alias("a"), F.count("*").alias("c"))
    pairs = star.join(centre.where("c > 1"), ["k", "least"]).where("a <> `set`").select("a", F.col("set").alias("b")).distinct()
    first = _links(pairs, reps, docs, words, parts)
    known = written(components(first), "known")

    rooted = reps.select("set", "rare").join(known, F.col("set") == F.col("node"), "left")
    rooted = rooted.select("set", "rare", F.coalesce("root", "set").alias("root"))
    posts = rooted.mapInPandas(_postings, "token long, `set` long, root long")
    live = _live(posts)
    blocks = _blocks(live)
    own = reps.join(_few(live.select("set").distinct()), "set", "left_semi")
    narrow = own.select("set", "n", "bits").mapInPandas(_narrow, "`set` long, n long, bits binary")
    order = ["token", "i", "j"]
    sorted_ = blocks.join(narrow, "set").repartition(width(spark), *order).sortWithinPartitions(*order)
    pairs = sorted_.mapInPandas(_tree_join(parts), "a long, b long").distinct()
    second = _links(pairs, reps, docs, words, parts)

    roots = written(components(first.union(second)), "roots")
    named = lows.join(roots, F.col("set") == F.col("node"), "left").select("k1", "k2", "low", F.coalesce("root", "set").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("low"))
    named = named.select("k1", "k2", "root").join(names, "root").select("k1", "k2", "low")
    out = rows.where("n > 0").select("doc_id", "text_hash", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "text_hash", "n", "k1", "k2"), allowMissingColumns=True)
    discard(reps, live, known, first, second)
    mine = (F.col("low.text_hash") == F.col("text_hash")) & F.col("low.doc_id").eqNullSafe(F.col("doc_id"))
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("component_id"),
        F.when(F.col("low").isNull(), F.lit(True)).otherwise(mine).alias("kept"),
    )
