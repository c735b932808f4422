"""Operator 11: compare the sources of each language by term, over a quadtree of the group-term count matrix."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import held, small_batches, written

#: Groups of a tile, terms of a column block, and joint nodes that a task expands at once.
TILE, COLUMNS, AT_ONCE = 256, 4096, 1 << 14
#: Entries of a counting task's table at which it goes on to the shuffle.
HELD_TERMS = 400_000
#: Shares are counted in parts of this.
UNIT = 1_000_000_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, in UTF-8, with A-Z lower-cased."""
    return text.encode().translate(_LETTERS).split()


# ---- the tree ----------------------------------------------------------------------------------------------------


class QuadTree:
    """A k-squared tree (k = 2) of a sparse matrix: a bit for each quadrant of a nonempty one, level by level.

    A quadrant without a nonzero cell has the bit 0 and nothing below it. The children of node ``i`` of a level are
    the bits 4 i to 4 i + 3; the node of a bit 1 is the number of ones before it.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.depth = (max(*shape, 1) - 1).bit_length()
        code = np.zeros(len(rows), np.int64)
        for b in range(self.depth):
            code |= (rows >> b & 1) << 2 * b + 1 | (cols >> b & 1) << 2 * b
        order = np.argsort(code)
        code, self.values = code[order], values[order]
        self.bits, self.ones = [], []
        nodes = np.zeros(min(1, len(code)), np.int64)
        for d in range(1, self.depth + 1):
            below = np.unique(code >> 2 * (self.depth - d))
            bits = np.zeros(4 * len(nodes), bool)
            bits[4 * np.searchsorted(nodes, below >> 2) + (below & 3)] = True
            self.bits.append(bits)
            self.ones.append(np.cumsum(bits) - 1)
            nodes = below

    def child(self, d: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The nodes of level d + 1 in a quadrant of nodes of level d; -1 where it, or the node, is all zero."""
        at = np.maximum(node, 0) * 4 + quadrant
        return np.where((node >= 0) & self.bits[d][at], self.ones[d][at], -1)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / whole), exact."""
    if len(counts) and int(counts.max()) + 2 > (1 << 62) // UNIT:
        return np.array([1 + UNIT * (int(c) + 2) // int(w) for c, w in zip(counts, whole, strict=True)], np.int64)
    return 1 + UNIT * (counts + 2) // whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_STEPS = np.array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], np.int64)


def pair_values(tree: QuadTree, n_cols: int, whole: np.ndarray, split: int) -> np.ndarray:
    """Summed distances of all pairs of rows (g, h) with g < split <= h, or with g < h where ``split`` is 0.

    Two row ranges go down the tree together, over one column range. Where both quadrants are all zero, all their
    pairs have the same two shares in every column, so the number of columns is noted for the range pair and priced
    once at the end; single cells are priced one by one. At most AT_ONCE node pairs are expanded at once, those of
    the deepest level first, so that memory is bounded by the depth.
    """
    n = len(whole)
    value = np.zeros((n, n), np.int64)
    if n < 2 or not n_cols:
        return value
    depth = tree.depth
    spans = [(n - 1 >> depth - d) + 1 for d in range(depth + 1)]
    empty = [np.zeros((s, s), np.int64) for s in spans]
    root = np.array([0 if len(tree.values) else -1], np.int64)
    start = np.zeros(1, np.int64)
    stack = [(0, root, root, start, start, start)]
    while stack:
        d, *now = stack.pop()
        if len(now[0]) > AT_ONCE:
            stack += [(d, *(x[k : k + AT_ONCE] for x in now)) for k in range(0, len(now[0]), AT_ONCE)]
            continue
        a, b, rows_a, rows_b, cols = now
        zero = (a < 0) & (b < 0)
        if zero.any():
            side = 1 << depth - d
            np.add.at(empty[d], (rows_a[zero], rows_b[zero]), np.minimum(n_cols, (cols[zero] + 1) * side) - cols[zero] * side)
            a, b, rows_a, rows_b, cols = (x[~zero] for x in (a, b, rows_a, rows_b, cols))
        if d == depth:
            left, right = (np.where(x >= 0, tree.values[np.maximum(x, 0)], 0) if len(x) else x for x in (a, b))
            np.add.at(value, (rows_a, rows_b), distance(shares(left, whole[rows_a]), shares(right, whole[rows_b])))
            continue
        if not len(a):
            continue
        step_a, step_b, step_c = (np.tile(x, len(a)) for x in _STEPS.T)
        a, b, rows_a, rows_b, cols = (np.repeat(x, 8) for x in (a, b, rows_a, rows_b, cols))
        next_a, next_b, next_c = 2 * rows_a + step_a, 2 * rows_b + step_b, 2 * cols + step_c
        side = 1 << depth - d - 1
        if split:
            own = (next_a * side < split) & ((next_b + 1) * side > split)
        else:
            own = (next_a < next_b) | ((next_a == next_b) & (side > 1))
        own &= (next_a * side < n) & (next_b * side < n) & (next_c * side < n_cols)
        a, b = tree.child(d, a[own], (2 * step_a + step_c)[own]), tree.child(d, b[own], (2 * step_b + step_c)[own])
        stack.append((d + 1, a, b, next_a[own], next_b[own], next_c[own]))
    for d, counts in enumerate(empty):
        at = np.arange(n) >> depth - d
        none = shares(np.zeros(n, np.int64), whole)
        value += counts[np.ix_(at, at)] * distance(none[:, None], none[None, :])
    return value


# ---- on Spark ----------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of each term by group, of a task; a full table goes on and a new one begins."""
    held("divergence")
    counts: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def rows() -> Iterator[pd.DataFrame]:
        for (lang, source), own in counts.items():
            seen = docs[lang, source]
            if not own:
                continue
            frame = {"term": [t.decode() for t in own], "n": list(own.values()), "docs": [seen[t] for t in own]}
            yield pd.DataFrame({"lang": lang, "source": source, **frame})

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            found, own = terms(text), counts[lang, source]
            size -= len(own)
            own.update(found)
            docs[lang, source].update(set(found))
            size += len(own)
            if size > HELD_TERMS:
                yield from rows()
                counts.clear()
                docs.clear()
                size = 0
    yield from rows()


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of one column block for the pairs of groups of two tiles (or within one)."""
    held("divergence")
    first = frame.iloc[0]
    heads = frame[frame["col"] < 0].sort_values("g")
    cells = frame[frame["col"] >= 0]
    groups = heads["g"].to_numpy()
    split = int((groups // TILE == first["a"]).sum()) if first["a"] != first["b"] else 0
    names, cols = np.unique(cells["col"].to_numpy(), return_inverse=True)
    tree = QuadTree(np.searchsorted(groups, cells["g"].to_numpy()), cols, cells["n"].to_numpy(), (len(groups), len(names)))
    whole = np.maximum(heads["n"].to_numpy(), 1)
    value = pair_values(tree, len(names), whole, split)
    n = np.arange(len(groups))
    g, h = np.nonzero((n[:, None] < split) & (n >= split) if split else n[:, None] < n)
    return pd.DataFrame({"lang": first["lang"], "g": groups[g], "h": groups[h], "value": value[g, h], "covered": len(names)})


def _share(count, total, v):
    """``shares`` on columns, in decimals."""
    top = (count + F.lit(2)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (total + v * F.lit(2)).cast("decimal(20,0)"))


def _distance(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out.where(F.col("rank") <= top) if top else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def audit(
    docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """How far the sources of a language lie apart by their terms, and which terms set each source apart.

    Returns lang, source, part, item, value, rank. Part ``pair`` has every other source of the language with the
    summed distance to it; part ``term`` the ``top`` terms that a source uses more than its language does.

    Null text, language or source is the empty string, which is a value like any other; ids are not read, so
    repeated rows and ids count each. Texts of any length are read whole. Ties rank by item in UTF-8 order. A group
    without terms has its pairs, a language that keeps no term has pairs of value 0, and an empty table gives no
    rows. Other columns are not read, whatever their names.

    Tasks count before the shuffle; counts are added by language, source and term and then gathered by term, a
    number for each source. Column blocks of about COLUMNS terms by tiles of TILE groups go to a task each, so no
    task holds more than two tiles of a block however large a language is. A cell is sent to as many tasks as its
    language has tiles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = {"text": text_col, "lang": lang_col, "source": source_col}
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in named.items()))
    parts = own.where("text <> ''").mapInPandas(_counted, "lang string, source string, term string, n long, docs long")
    cells = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = written(by_term.where(F.col("docs") >= min_docs).withColumn("col", F.monotonically_increasing_id()), "terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "v", "lang_total"]).withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = written(groups.withColumn("tiles", F.floor(F.max("g").over(Window.partitionBy("lang")) / TILE) + 1), "groups")

    used = kept.select("lang", "term", "col", F.col("n").alias("lang_n"), F.explode("cells").alias("c"))
    used = used.select("lang", "term", "col", "lang_n", "c.source", "c.n").join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    apart = used.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    by_item = _ranked(apart.withColumn("value", _distance(F.col("p"), F.col("q"))), "term", top)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / COLUMNS))
    tile = F.floor(F.col("g") / TILE)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("o")
    entries = used.select("lang", F.pmod(F.xxhash64("col"), blocks).alias("block"), tile.alias("t"), "col", "g", "n", others)
    heads = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    heads = heads.select("lang", "block", tile.alias("t"), F.lit(-1).cast("long").alias("col"), "g", (F.col("total") + 2 * F.col("v")).alias("n"), others)
    both = entries.union(heads).select("lang", "block", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "col", "g", "n")
    sums = both.groupBy("lang", "block", "a", "b").applyInPandas(_block, "lang string, g int, h int, value long, covered long")
    sums = sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    none = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(1))  # share of a term that the group lacks
    named = groups.select("lang", "g", "source", "v", none.alias("p"))
    pairs = sums.join(named, ["lang", "g"]).join(named.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("p").alias("q")), ["lang", "h"])
    rest = (F.col("v") - F.col("covered")) * _distance(F.col("p"), F.col("q"))  # terms that no group of the two tiles has
    pairs = written(pairs.select("lang", "source", "item", (F.col("value") + rest).alias("value")), "pairs")
    pairs = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return _ranked(pairs, "pair", None).union(by_item)
