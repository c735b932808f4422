"""Operator 9: remove repeated byte strings by prefix-free parsing and suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import hash_sample, small_batches, width, written
from tesserae.llm.shingles import BASE, _powers, mixed

GRAM = 32  # bytes of a trigger
PLACE = 24  # bits of a place in a block
BLOCK = 1 << 20  # bytes that are parsed at once
FLUSH = 300_000  # phrases that are combined before they are sent
NO_ID = (1 << 63) - 1

PIECE = "key long, phrase long, d long, th long, lo int, c int"


def _rolling(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    h, n, p = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), 1, BASE
    while n < GRAM:
        h = h[:-n] * np.uint64(p) + h[n:]
        n, p = 2 * n, p * p % (1 << 64)
    return mixed(h)


def _lowest(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    n = 1
    while 2 * n <= w:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if n < w else h


def parse(raws: list[bytes], size: int) -> Iterator[dict[str, np.ndarray]]:
    """Phrases of the texts: document number, first window start, number of window starts, trigger, fingerprint.

    A window is a string of ``size`` bytes within a text. Its trigger is the lowest rolling hash in it, so equal
    windows have equal triggers at equal places (the leftmost, where hashes tie), wherever they lie. A phrase is a
    run of windows with one trigger; it reaches to the end of its last window, which makes phrases overlap and the
    parse prefix-free. Also gives the joined bytes and each phrase's place in them. A text longer than a block is
    parsed in pieces that overlap by a window.
    """
    step = (1 << PLACE) - size
    if any(len(r) >= 1 << PLACE for r in raws):
        cuts = [(k, a) for k, r in enumerate(raws) for a in range(0, max(len(r) - size + 1, 1), step)]
        for x in parse([raws[k][a : a + step + size - 1] for k, a in cuts], size):
            origin = np.array(cuts)[x["doc"]]
            yield x | {"doc": origin[:, 0], "lo": x["lo"] + origin[:, 1]}
        return
    wait: list[int] = []
    total = 0
    for k in range(len(raws) + 1):
        if wait and (k == len(raws) or total + len(raws[k]) > BLOCK):
            yield from _parsed(wait, b"".join(raws[j] for j in wait), np.array([len(raws[j]) for j in wait]), size)
            wait, total = [], 0
        if k < len(raws) and len(raws[k]) >= size:
            wait.append(k)
            total += len(raws[k])


def _parsed(docs: list[int], raw: bytes, lengths: np.ndarray, size: int) -> Iterator[dict[str, np.ndarray]]:
    b = np.frombuffer(raw, np.uint8)
    h = _rolling(b)
    # the place of a hash breaks ties, so the minimum also tells where it is
    low = _lowest(h >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64), size - GRAM + 1)
    begin = np.cumsum(lengths) - lengths
    own = lengths - size + 1
    at = np.repeat(begin - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum())  # all window starts
    v = low[at]
    first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)])
    count = np.diff(np.r_[first, len(at)])
    trigger = h[(v[first] & np.uint64((1 << PLACE) - 1)).astype(np.int64)]
    place = at[first]
    which = np.searchsorted(begin, place, side="right") - 1
    power, inverse = _powers(len(b))
    sums = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])]
    end = place + count + size - 1
    print_ = mixed((sums[end] - sums[place]) * inverse[place] + (end - place).astype(np.uint64))
    yield {
        "doc": np.array(docs)[which], "lo": place - begin[which], "c": count, "trigger": trigger, "print": print_,
        "place": place, "bytes": b, "sums": sums, "inverse": inverse,
    }


def _parsed_batch(texts: pd.Series, size: int, docs: int = 64) -> Iterator[dict[str, np.ndarray]]:
    """``parse`` for a batch, a few documents at a time."""
    for a in range(0, len(texts), docs):
        for x in parse([t.encode("utf-8", "replace") for t in texts.iloc[a : a + docs]], size):
            yield x | {"doc": x["doc"] + a}


def _spans(d: np.ndarray, th: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of intervals within each document, in order."""
    if not len(d):
        return d, th, lo, end
    order = np.lexsort((lo, th, d))
    d, th, lo, end = d[order], th[order], lo[order], end[order]
    other = np.r_[True, (d[1:] != d[:-1]) | (th[1:] != th[:-1])]
    group = np.cumsum(other) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide  # furthest end so far in the document
    fresh = np.flatnonzero(other | np.r_[True, lo[1:] > reach[:-1]])
    return d[fresh], th[fresh], lo[fresh], np.maximum.reduceat(end, fresh)


def _once(*sorted_columns: np.ndarray) -> np.ndarray:
    """True for the first of equal rows: a row that the input repeats is one document."""
    return np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_columns])]


def _send(parts: list[tuple[np.ndarray, ...]], size: int) -> Iterator[pd.DataFrame]:
    """Combine before the shuffle: of equal phrases only the earliest is sent, the others are repeats.

    Repeats go along as spans with a negative end in place of a count.
    """
    key, ph, d, th, lo, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((lo, th, d, ph, key))
    order = order[_once(*(x[order] for x in (key, ph, d, th, lo)))]
    key, ph, d, th, lo, c = (x[order] for x in (key, ph, d, th, lo, c))
    first = np.r_[True, (key[1:] != key[:-1]) | (ph[1:] != ph[:-1])]
    x = _spans(d[~first], th[~first], lo[~first], (lo + c + size - 1)[~first])
    for kd, kp, dd, tt, ll, cc in (
        (key[first], ph[first], d[first], th[first], lo[first], c[first]),
        (mixed(x[0].astype(np.uint64)).astype(np.int64), np.zeros(len(x[0]), np.int64), x[0], x[1], x[2], -x[3]),
    ):
        for a in range(0, len(kd), 100_000):
            s = slice(a, a + 100_000)
            yield pd.DataFrame({"key": kd[s], "phrase": kp[s], "d": dd[s], "th": tt[s], "lo": ll[s].astype("int32"), "c": cc[s].astype("int32")})


def _phrases(size: int, hot):
    """Parse: a row for each phrase; a phrase with a very frequent trigger gives a row for each of its windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, parts, n = hot.value, [], 0
        for batch in batches:
            ids, ths = batch["d"].to_numpy(), batch["th"].to_numpy()
            for x in _parsed_batch(batch["text"], size):
                d, th = ids[x["doc"]], ths[x["doc"]]
                trigger = x["trigger"].astype(np.int64)
                spot = np.minimum(np.searchsorted(often, trigger), max(len(often) - 1, 0))
                is_hot = often[spot] == trigger if len(often) else np.zeros(len(d), bool)
                cold = ~is_hot
                parts.append((trigger[cold], x["print"].astype(np.int64)[cold], d[cold], th[cold], x["lo"][cold], x["c"][cold]))
                n += cold.sum()
                if is_hot.any():
                    c = x["c"][is_hot]
                    step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    at = np.repeat(x["place"][is_hot], c) + step
                    h = mixed((x["sums"][at + size] - x["sums"][at]) * x["inverse"][at] + np.uint64(size)).astype(np.int64)
                    lo = np.repeat(x["lo"][is_hot], c) + step
                    one = np.ones(len(h), np.int64)
                    windows = np.lib.stride_tricks.sliding_window_view(x["bytes"], size)
                    second = np.concatenate([_second_hash(windows[at[a : a + 20_000]]) for a in range(0, len(at), 20_000)])
                    parts.append((h, second, np.repeat(d[is_hot], c), np.repeat(th[is_hot], c), lo, one))
                    n += len(h)
                if n > FLUSH:
                    yield from _send(parts, size)
                    parts, n = [], 0
                del x
        if n:
            yield from _send(parts, size)

    return run


def _triggers(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in _parsed_batch(batch["text"], size):
                yield pd.DataFrame({"key": x["trigger"].astype(np.int64), "phrase": x["print"].astype(np.int64)})

    return run


def hot_triggers(docs: DataFrame, size: int, max_docs: int = 20_000, least: int = 16) -> np.ndarray:
    """Triggers with ``least`` or more different phrases among about ``max_docs`` documents chosen by hash of the id.

    They only decide which way a phrase goes; either way is exact.
    """
    some = docs.where(hash_sample("d", min(1.0, max_docs / max(docs.count(), 1))))
    pairs = some.select("text").mapInPandas(_triggers(size), "key long, phrase long").distinct()
    often = pairs.groupBy("key").count().where(F.col("count") >= least).select("key").toPandas()  # bounded by the sample
    return np.sort(often["key"].to_numpy(np.int64))


def _sorted_groups(work):
    """Calls ``work`` with columns of whole groups of equal ``key``, many groups at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut == 0 and (not wait or wait[-1]["key"].iloc[-1] == key[0]):
                wait.append(batch)
                continue
            if cut == 0:
                yield from work(pd.concat(wait))
                wait = [batch]
                continue
            yield from work(pd.concat([*wait, batch.iloc[:cut]]))
            wait = [batch.iloc[cut:]]
        if wait:
            yield from work(pd.concat(wait))

    return run


def _dictionary(size: int):
    """Of equal phrases all but the earliest are repeats. The earliest is a dictionary entry; it goes on where its
    trigger has other entries as well."""

    def work(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, ph, d, th, lo, c = (g[x].to_numpy() for x in ("key", "phrase", "d", "th", "lo", "c"))
        known = c < 0
        out = [(d[known], th[known], lo[known].astype(np.int64), -c[known].astype(np.int64))]
        key, ph, d, th, lo, c = (x[~known] for x in (key, ph, d, th, lo.astype(np.int64), c.astype(np.int64)))
        if len(key):
            once = _once(key, ph, d, th, lo)
            key, ph, d, th, lo, c = (x[once] for x in (key, ph, d, th, lo, c))
            group = np.r_[True, key[1:] != key[:-1]]
            first = group | np.r_[True, ph[1:] != ph[:-1]]
            out.append((d[~first], th[~first], lo[~first], (lo + c + size - 1)[~first]))
            number = np.cumsum(group) - 1
            entries = np.bincount(number, first)[number]
            go = first & (entries > 1)
            yield pd.DataFrame({"key": key[go], "phrase": ph[go], "d": d[go], "th": th[go], "lo": lo[go], "c": c[go]}).astype(
                {"lo": "int32", "c": "int32"}
            )
        d, th, lo, end = _spans(*(np.concatenate(x) for x in zip(*out, strict=True)))
        zero = np.zeros(len(d), np.int64)
        yield pd.DataFrame({"key": zero, "phrase": zero, "d": d, "th": th, "lo": lo, "c": -end}).astype({"lo": "int32", "c": "int32"})

    return _sorted_groups(work)


def _entries(size: int):
    """The bytes of each dictionary entry that goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.iloc[a : a + 500]
                n = part["keys"].map(len).to_numpy()
                raws = [t.encode("utf-8", "replace") for t in part["text"]]
                whole = [raw[x : x + c + size - 1] for raw, los, cs in zip(raws, part["los"], part["cs"], strict=True) for x, c in zip(los, cs, strict=True)]
                columns = {"key": np.concatenate(part["keys"].to_numpy()), "d": np.repeat(part["d"].to_numpy(), n), "th": np.repeat(part["th"].to_numpy(), n)}
                columns |= {"lo": np.concatenate(part["los"].to_numpy()), "c": np.concatenate(part["cs"].to_numpy()), "bytes": whole}
                yield pd.DataFrame(columns)

    return run


def _suffixes(size: int, most: int = 150_000):
    """Suffix order of dictionary entries, to the depth of a window: equal neighbours are repeats of the earliest."""

    def resolve(g: pd.DataFrame) -> tuple[np.ndarray, ...]:
        g = g.drop_duplicates(["d", "th", "lo"]).sort_values(["d", "th", "lo"], kind="stable")
        c, d, th, lo = (g[x].to_numpy() for x in ("c", "d", "th", "lo"))
        c, lo = c.astype(np.int64), lo.astype(np.int64)
        b = np.frombuffer(b"".join(g["bytes"]), np.uint8)
        begin = np.cumsum(c + size - 1) - (c + size - 1)
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        rows = np.lib.stride_tricks.sliding_window_view(b, size)[np.repeat(begin, c) + step]
        rows = np.ascontiguousarray(rows)
        order = np.argsort(rows.view(f"S{size}").ravel(), kind="stable")
        ranked = rows[order]
        again = np.zeros(len(order), bool)
        again[order[1:]] = (ranked[1:] == ranked[:-1]).all(axis=1)
        start = np.repeat(lo, c) + step
        return np.repeat(d, c)[again], np.repeat(th, c)[again], start[again], start[again] + size

    def work(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, windows = g["key"].to_numpy(), np.cumsum(g["c"].to_numpy().astype(np.int64))
        edges, lo = [0], 0
        stops = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        for stop in stops:  # whole groups, about ``most`` windows at once
            if windows[stop - 1] - lo > most:
                edges.append(stop)
                lo = windows[stop - 1]
        edges += [len(key)] if edges[-1] != len(key) else []
        for a, z in zip(edges, edges[1:], strict=False):
            d, th, lo_, end = _spans(*resolve(g.iloc[a:z]))
            yield pd.DataFrame({"d": d, "th": th, "lo": lo_, "c": -end}).astype({"lo": "int32", "c": "int32"})

    return _sorted_groups(work)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What is left of each text."""
    rows = []
    for text, own in zip(texts, spans, strict=True):
        raw, kept, end, removed, n = text.encode("utf-8", "replace"), [], 0, 0, 0
        last = -1
        own = np.sort(own) if own is not None else np.zeros(0, np.int64)
        for lo, hi in zip((own >> 32).tolist(), (own & 0xFFFFFFFF).tolist(), strict=True):
            if lo > last:
                n += 1
                kept.append(raw[end:lo])
            removed += max(0, hi - max(lo, last))
            end = last = max(last, hi)
        kept.append(raw[end:])
        rest = b"".join(kept)
        rows.append((len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _assert_apart(docs: DataFrame) -> None:
    """Raise where two texts of one id have the same 64-bit hash: a second hash, of 64 other bits, tells them apart."""
    other = F.xxhash64(F.lit(NO_ID), F.reverse("text"), F.octet_length("text"))
    twice = docs.groupBy("d", "th").agg(F.min(other).alias("low"), F.max(other).alias("high")).where("low <> high")
    if twice.take(1):
        raise ValueError("two texts of one id have the same hash; give the rows of this table different ids")


def _second_hash(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window's bytes that shares nothing with the rolling one."""
    size = windows.shape[1]
    rows = np.zeros((len(windows), -(-size // 8) * 8), np.uint8)
    rows[:, :size] = windows
    words = rows.view(np.uint64)
    salt = np.random.default_rng(9).integers(0, 1 << 64, words.shape[1], np.uint64)
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out += mixed(words[:, k] + salt[k])
    return mixed(out).astype(np.int64)


def remove_repeats(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``size``-byte string that also starts earlier in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row. Earlier
    means a smaller id, or an earlier start in the same document; strings are judged on the input and do not cross
    documents.

    Texts are parsed into phrases by rolling-hash triggers. Equal phrases meet by fingerprint, the earliest becomes
    the dictionary's; dictionary entries with a common trigger are put in suffix order, where equal neighbours of
    ``size`` bytes are repeats. Each task combines its own phrases first, and triggers with very many different
    phrases are spread window by window, so no shuffle key holds more rows than there are tasks and no group
    more than a small share of the documents.

    Equal phrases, and equal windows of frequent triggers, meet by 128 bits and their bytes are not compared; what
    meets by fewer bits is compared byte by byte. Null or empty text: no bytes. Rows with one id and one text count
    as one document and all get its result; one id with several texts is ordered by their 64-bit hash, and should two
    of them share it, the job fails rather than lose a text. Null ids come last. ``size`` must be more than 32.
    """
    if size <= GRAM:
        raise ValueError(f"size must be more than {GRAM}")
    spark, parts = docs.sparkSession, width(docs.sparkSession)
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"d": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})
    _assert_apart(docs)
    long_ = docs.where(F.octet_length("text") >= size)
    hot = spark.sparkContext.broadcast(hot_triggers(long_, size))
    pieces = long_.select("d", "th", "text").mapInPandas(_phrases(size, hot), PIECE)
    pieces = pieces.repartition(parts, "key").sortWithinPartitions("key", "phrase", "d", "th", "lo")
    entries = written(pieces.mapInPandas(_dictionary(size), PIECE), "dictionary")
    asked = entries.where("c > 0").groupBy("d", "th").agg(F.collect_list(F.struct("key", "lo", "c")).alias("own"))  # of one document
    asked = asked.select("d", "th", F.col("own.key").alias("keys"), F.col("own.lo").alias("los"), F.col("own.c").alias("cs"))
    texts = long_.select("d", "th", "text").join(asked, ["d", "th"])
    kinds = "key long, d long, th long, lo int, c int, bytes binary"
    going = texts.mapInPandas(_entries(size), kinds).repartition(parts, "key").sortWithinPartitions("key")
    found = written(going.mapInPandas(_suffixes(size), "d long, th long, lo int, c int"), "suffixes")
    spans = entries.where("c < 0").select("d", "th", "lo", "c").union(found)
    # start and end of a span in one number, which reaches Python as a plain array
    both = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(-F.col("c").cast("long"))
    spans = spans.groupBy("d", "th").agg(F.collect_list(both).alias("spans"))  # of one document
    whole = docs.join(spans, ["d", "th"], "left").select("doc_id", "text", "spans")
    kinds = "struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string, kept: binary>"
    cut = F.pandas_udf(_cut, kinds).asNondeterministic()  # evaluated once
    return whole.select("doc_id", cut("text", "spans").alias("own")).select("doc_id", "own.*")
