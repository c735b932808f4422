"""Operator 1: pack documents into fixed-length token sequences along a space-filling curve."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import held, small_batches, small_table, width, written
from tesserae.llm.hilbert import hilbert_key

BUCKETS, DIMS, BITS = 256, 4, 12
CACHED_WORDS = 400_000

#: Words of these characters alone need no Unicode normalisation; others take the tokenizer's own full path.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: How the tokenizer splits a plain word, once it is lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^0-9a-zà-öø-ÿß]+")


def _byte_letters() -> dict[int, str]:
    """The public byte-level BPE alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


#: The steps before the model of a tokenizer whose plain words may be encoded one by one.
_STEPS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


#: White space of one byte, and a byte that no UTF-8 text holds, which ends a document.
_BLANK, _END = b"\t\n\v\f\r ", b"\xff"


def _edges() -> np.ndarray:
    """Whether a text may be cut between two bytes, by 256 times the first and the second.

    Beside white space and the end that is where both are ASCII and ``_STEPS`` splits whatever stands around them:
    between letters, digits and other signs, and between digits. Contractions keep their apostrophe, and bytes of other
    characters, which may be marks, stay with their neighbours.
    """
    kind = np.full(256, 4, np.uint8)
    for k, own in enumerate((range(33, 127), map(ord, "0123456789"), [*range(65, 91), *range(97, 123)])):
        kind[list(own)] = k
    kind[ord("'")] = 4
    one, two = kind[:, None], kind[None, :]
    edges = (one < 3) & (two < 3) & ((one != two) | (one == 1))
    alone = np.isin(np.arange(256), list(_BLANK + _END))
    return (edges | alone[:, None] | alone[None, :]).ravel()


_EDGES, _KEPT = _edges(), ~np.isin(np.arange(256), list(_BLANK))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _cut_up(texts: pa.Array) -> pa.Array:
    """Pieces of all texts, each of which the tokenizer encodes on its own, and ``_END`` after those of each text.

    Capital ASCII letters become small ones, as in the tokenizer, but where a mark may follow: a capital can lack the
    composed letter that the small one has.
    """
    ended = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(_END, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    at = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    flat = np.frombuffer(ended.buffers()[2], np.uint8)[at[0] : at[-1]]
    edges = np.append(True, _EDGES[flat[:-1].astype(np.uint16) << 8 | flat[1:]])[: len(flat)]
    kept = _KEPT[flat]
    flat, edges = flat[kept], edges[kept]
    lower = _LOWER[flat]
    marks = np.flatnonzero(flat[1:] >= 0xCC)  # U+0300, the first of the marks, and all beyond
    lower[marks] = flat[marks]
    starts = np.append(np.flatnonzero(edges), len(flat))
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(lower)])


def _drops_blanks(tokenizer) -> bool:
    """Whether the tokenizer prepares text as ``_STEPS`` says, so that it never joins across a blank."""
    before, cuts = (json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    cuts = cuts.get("pretokenizers", [])
    kinds = [x["type"] for x in before.get("normalizers", [])], [x["type"] for x in cuts]
    if kinds != (_STEPS["normalizer"], _STEPS["pre_tokenizer"]) or tokenizer.post_processor:
        return False
    plain = cuts[0]["pattern"].get("Regex") == _STEPS["split"] and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
    plain &= not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
    added = tokenizer.get_added_tokens_decoder().values()
    return plain and not any(re.search(r"\s", x.content) or x.lstrip or x.rstrip or x.normalized for x in added)


class _Words(dict):
    """Token ids of each piece of text, as little-endian bytes.

    Where the tokenizer drops white space and never joins across a blank, a text's ids are those of its pieces;
    with any other tokenizer every text is encoded whole. Texts with special tokens, which keep their ids, are cut at
    blanks alone. A full cache becomes the older one, from which words that come again return.
    """

    def __init__(self, path: str, dtype: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.most, self.older = Tokenizer.from_file(path), dtype, most, {}
        self.by_piece = _drops_blanks(self.tokenizer)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = {x[0] for x in self.special}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _ids(self, word: str) -> list[int]:
        if len(word) <= 100 and word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):  # one part
            own = word.lower()
            own = own if own.isascii() else own.encode().decode("latin-1").translate(self.letters)  # ASCII letters are their own
            return [token.id for token in self.model.tokenize(own)]
        special = not self.first.isdisjoint(word) and any(x in word for x in self.special)
        if special or len(word) > 100 or not _PLAIN.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        parts = (x.encode().decode("latin-1").translate(self.letters) for x in _PARTS.findall(word.lower()))
        return [token.id for x in parts for token in self.model.tokenize(x)]

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def __missing__(self, word: str | bytes) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self._bytes(self._ids(word if isinstance(word, str) else word.decode()))
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(word) < 200:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        return self.batch(pa.array([text]), [])[0].tobytes()

    def _alone(self, text: str) -> bytes:
        if self.by_piece:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def batch(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another and with ``end`` after each, and how many each has.

        A piece that comes again in the batch is looked up once.
        """
        texts.validate(full=True)  # fails where a text is no UTF-8
        alone = np.ones(len(texts), bool)
        if self.by_piece:
            special = "|".join(map(re.escape, self.special))
            alone = pc.match_substring_regex(texts, special).to_numpy(zero_copy_only=False) if special else ~alone
        rows = np.flatnonzero(alone)
        found = _cut_up(pc.if_else(pa.array(alone), "", texts)).dictionary_encode()
        codes, words = found.indices.to_numpy().copy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ends = np.flatnonzero(codes == words.index(_END)) if words else codes
        end = self._bytes(end)
        ids = [end if word == _END else self[word] for word in words]
        ids += [self._alone(texts[k].as_py()) + end for k in rows.tolist()]
        codes[ends[rows]] = np.arange(len(words), len(ids))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        n, starts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        upto = np.cumsum(n)
        place = np.arange(n.sum()) + np.repeat(starts - (upto - n), n)
        return np.frombuffer(b"".join(ids), self.dtype)[place], np.diff(upto[ends], prepend=0)


def _words(path: str, dtype: str, most: int) -> _Words:
    return held(("words", path, dtype, most), lambda: _Words(path, dtype, most))


def _curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hashed token counts (n x BUCKETS) to Hilbert keys of a fixed random projection."""
    unit = np.sqrt(vectors) / np.maximum(np.sqrt(vectors.sum(axis=1, keepdims=True)), 1e-12)
    plane = np.random.default_rng(20240501).standard_normal((BUCKETS, DIMS))
    cells = np.clip((unit @ plane + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_key(cells, BITS)


def _tokenise(path: str, dtype: str, end_id: int, cached: int):
    @F.arrow_udf("struct<n: long, key: long, ids: binary>")
    def tokenise(texts: pa.Array) -> pa.Array:
        ids, n = _words(path, dtype, cached).batch(texts.fill_null(""), [end_id])
        spread = (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)
        spread += np.repeat(np.arange(len(n)) * BUCKETS, n)
        counts = np.bincount(spread, minlength=len(n) * BUCKETS).reshape(-1, BUCKETS)
        cuts = pa.array(np.append(0, np.cumsum(n) * np.dtype(dtype).itemsize), pa.int32())  # fails beyond 2 GB, as a row would
        own = pa.Array.from_buffers(pa.binary(), len(n), [None, cuts.buffers()[1], pa.py_buffer(ids)])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(_curve_keys(counts)), own], ["n", "key", "ids"])

    return tokenise.asNondeterministic()  # evaluated once


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens before each document within its partition of the curve."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch["n"].to_numpy()
        ends = before + np.cumsum(n)
        yield pd.DataFrame({"uid": batch["uid"], "part": part, "at": ends - n, "n": n})
        before = int(ends[-1]) if len(ends) else before


def _cut(dtype: str, length: int):
    @F.pandas_udf("array<struct<start: long, length: long, token_ids: binary, sequence_id: long, offset: long>>")
    def cut(ids: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for raw, at in zip(ids, places, strict=True):
            own = np.frombuffer(raw, dtype).astype("<u4")
            edges = [0, *range(length - at % length, len(own), length), len(own)]
            out.append(
                [
                    {"start": lo, "length": hi - lo, "token_ids": own[lo:hi].tobytes(), "sequence_id": (at + lo) // length, "offset": (at + lo) % length}
                    for lo, hi in zip(edges, edges[1:], strict=False)
                ]
            )
        return pd.Series(out)

    return cut.asNondeterministic()  # evaluated once


def pack(
    docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED_WORDS
) -> DataFrame:
    """Pack every document into sequences of ``seq_len`` tokens.

    Documents become hashed token vectors, are projected to a few dimensions and range-sorted by Hilbert key;
    neighbours along the curve follow one another, and the stream is cut every ``seq_len`` tokens, so that only
    the very last sequence can be short. Returns one row for each piece: doc_id, start, length, token_ids
    (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Ids are those of the tokenizer as its file has it: special tokens that stand in a text count as such. Texts of
    any length are encoded whole. Null or empty text: one token, ``end_id``. Repeated ids or rows: every row is packed on its own. Null ids
    stay null. An empty table gives no rows. Other columns are not read.

    Tokens are written once and shuffled once; places come from a sorted table of a few numbers a document, and
    the driver receives one total for each partition. A worker remembers the ids of up to twice ``cached`` words, about
    160 bytes each; the result does not depend on it.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    dtype = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = _tokenise(tokenizer_path, dtype, end_id, cached)("text").alias("_own")
    tokens = rows.select("doc_id", own).select("doc_id", "_own.n", "_own.key", "_own.ids")
    tokens = written(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    light = tokens.select("uid", "key", "n").repartitionByRange(width(spark), "key", "uid").sortWithinPartitions("key", "uid")
    places = written(light.mapInPandas(_running, "uid long, part int, at long, n long"), "places")
    totals = dict(places.groupBy("part").agg(F.sum("n")).collect())  # a row for each partition
    before, base = 0, []
    for part in sorted(totals):
        base.append((part, before))
        before += totals[part]
    bases = small_table(spark, base, "part int, base long")
    placed = places.join(F.broadcast(bases), "part").select("uid", (F.col("base") + F.col("at")).alias("place"))
    whole = tokens.select("uid", "doc_id", "n", "ids").join(placed.hint("merge"), "uid")
    pieces = whole.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(_cut(dtype, seq_len)("ids", "place")).alias("_own"))
    own = ["start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
    return pieces.select("doc_id", *(x if x == "doc_tokens" else f"_own.{x}" for x in own))
