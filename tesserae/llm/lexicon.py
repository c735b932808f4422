"""Operator 13: byte-pair encoding and decoding by a memory-mapped minimal transducer of frequent words."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import discard, held, shared_folder, small_batches, written
from tesserae.llm.packing import _PARTS, _PLAIN, _byte_letters, _drops_blanks

#: Words of the lexicon at most, bytes of one of them at most, and different words a counting task holds at once.
MOST_WORDS, LONGEST, HELD_WORDS = 1 << 17, 48, 300_000
#: Bytes from which a piece is merged by the tokenizer's own heap instead of in rounds over all pieces of a batch.
LONG = 200
#: Characters of text that are looked up together; longer texts are cut at blanks.
PART = 1 << 20

NONE = np.int64(1) << 40


def pieces(text: str) -> list[str]:
    """Blank-separated pieces of a text: no token crosses a blank."""
    return text.replace("\n", " ").replace("\t", " ").split(" ")


# ---- exact merging -----------------------------------------------------------------------------------------------


class Merger:
    """Ids of words by the tokenizer's merges, for many words at once.

    Each round merges in every piece the pair of lowest rank wherever it stands, from the left. That equals merging
    one place at a time, as long as no merge uses a token that only a later merge makes, which is checked.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not _drops_blanks(self.tokenizer):
            raise ValueError("the lexicon needs a tokenizer that drops white space and never joins across it")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in own], np.int64) for own in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        born = {int(x): k for k, x in enumerate(made)}
        if len(born) < len(pairs) or any(max(born.get(int(a), -1), born.get(int(b), -1)) >= k for k, (a, b) in enumerate(zip(left, right, strict=True))):
            raise ValueError("a merge of this tokenizer uses a token that a later one makes")
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], made
        self.letters = _byte_letters()
        self.bytes = {ord(x): b for b, x in self.letters.items()}
        self.inner = np.array([vocab[self.letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[self.letters[b] + end] for b in range(256)], np.int64)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = {x[0] for x in self.special}

    def _parts(self, word: str) -> list[bytes] | None:
        """Bytes of the parts a word is split into; None where the word holds a special token."""
        if _PLAIN.fullmatch(word) and self.first.isdisjoint(word):
            return [x.encode() for x in _PARTS.findall(word.lower())]
        if any(x in word for x in self.special):
            return None
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))
        return [x.translate(self.bytes).encode("latin-1") for x, _ in cut]

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place but the last."""
        keys = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NONE)

    def _merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and the part of each id."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = self.inner[np.frombuffer(b"".join(parts), np.uint8)]
        ids[np.cumsum(sizes) - 1] = self.last[[x[-1] for x in parts]]
        of, done = np.repeat(np.arange(len(parts)), sizes), []
        while len(ids):
            rank = np.append(self._ranks(ids), NONE)
            rank[:-1][of[:-1] != of[1:]] = NONE
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            low = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = low == NONE
            done.append((ids[over], of[over]))
            ids, of, rank, low = (x[~over] for x in (ids, of, rank, low))
            take = rank == low
            if not len(ids):
                break
            place = np.arange(len(take))
            begins = np.maximum.accumulate(np.where(take & ~np.append(False, take[:-1]), place, 0))
            take &= (place - begins) % 2 == 0  # of pairs that overlap, every other one
            ids[take] = self.made[rank[take]]
            keep = ~np.append(False, take[:-1])
            ids, of = ids[keep], of[keep]
        ids, of = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def ids(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, as the tokenizer encodes it."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        parts: list[bytes] = []
        owner: list[int] = []
        for k, word in enumerate(words):
            own = self._parts(word)
            if own is None or any(len(x) > LONG for x in own):
                out[k] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
            else:
                parts += own
                owner += [k] * len(own)
        if parts:
            ids, of = self._merged(parts)
            word = np.array(owner)[of]
            cuts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            for k, x in zip(word[cuts].tolist(), np.split(ids.astype(np.uint32), cuts[1:]), strict=True):
                out[k] = x
        return out


# ---- the transducer ----------------------------------------------------------------------------------------------


def compile_words(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """A minimal acyclic transducer from sorted, different words to id sequences, as the bytes of its file.

    Words come in byte order, so all states but those of the last word's path are final and equal ones are shared
    at once. Ids stand as near to the start as they can: on the way to a word's end they add up to its sequence.
    """
    known: dict[tuple, int] = {}
    outs: dict[tuple[int, ...], int] = {(): 0}
    frozen: list[tuple] = []
    path: list[list] = [[{}, None]]  # of the last word: arcs {byte: [target, ids]}, ids that end it
    before = b""

    def freeze(down_to: int) -> None:
        while len(path) > down_to + 1:
            arcs, ends = path.pop()
            own = (tuple((b, t, outs.setdefault(o, len(outs))) for b, (t, o) in arcs.items()), -1 if ends is None else outs.setdefault(ends, len(outs)))
            at = known.get(own)
            if at is None:
                at = known[own] = len(frozen)
                frozen.append(own)
            path[-1][0][before[len(path) - 1]][0] = at

    for word, ids in entries:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        freeze(same)
        for k in range(same):
            arc = path[k][0][word[k]]
            n = 0
            while n < min(len(arc[1]), len(ids)) and arc[1][n] == ids[n]:
                n += 1
            rest, arc[1], ids = arc[1][n:], arc[1][:n], ids[n:]
            if rest:
                nxt = path[k + 1]
                for a in nxt[0].values():
                    a[1] = rest + a[1]
                nxt[1] = None if nxt[1] is None else rest + nxt[1]
        for k in range(same, len(word)):
            path[k][0][word[k]] = [-1, ids if k == same else ()]
            path.append([{}, None])
        path[len(word)][1] = () if len(word) > same else ids
        before = word
    freeze(0)
    arcs, ends = path[0]
    frozen.append((tuple((b, t, outs.setdefault(o, len(outs))) for b, (t, o) in arcs.items()), -1 if ends is None else outs.setdefault(ends, len(outs))))
    arc = np.array([(s << 8 | b, t, o) for s, (own, _) in enumerate(frozen) for b, t, o in own], np.int64).reshape(-1, 3)
    arc = arc[np.argsort(arc[:, 0])]
    final = np.array([e for _, e in frozen], np.int64)
    starts = np.cumsum([0, *map(len, outs)])
    pool = np.array([x for o in outs for x in o], np.int64)
    body = [arc[:, 0], arc[:, 1], arc[:, 2], final, starts, pool]
    head = np.array([len(x) for x in body], np.int64)
    return b"".join(x.astype("<i8").tobytes() for x in (head, *body))


class Lexicon:
    """A compiled transducer, read from a memory-mapped file that all workers of a machine share."""

    def __init__(self, path: str):
        whole = np.memmap(path, "<i8", "r")
        cuts = np.cumsum([6, *whole[:6]])
        self.keys, self.target, self.out, self.final, self.starts, self.pool = (whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is known, how many ids it has, and the ids of all known words in order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, now = np.full(len(words), len(self.final) - 1), np.flatnonzero(sizes <= LONGEST)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        known = np.zeros(len(words), bool)
        step = 0
        while len(now):
            ended = now[sizes[now] == step]
            ends = self.final[state[ended]]
            known[ended[ends >= 0]] = True
            seen.append((ended[ends > 0], ends[ends > 0]))
            now = now[sizes[now] > step]
            if not len(now) or not len(self.keys):
                break
            keys = state[now] << 8 | flat[starts[now] + step]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            now, at = now[hit], at[hit]
            state[now] = self.target[at]
            seen.append((now[self.out[at] > 0], self.out[at][self.out[at] > 0]))
            step += 1
        word, out = (np.concatenate([x[k] for x in seen]).astype(np.int64) if seen else np.zeros(0, np.int64) for k in (0, 1))
        own = known[word]
        order = np.argsort(word[own], kind="stable")
        word, out = word[own][order], out[own][order]
        n = self.starts[out + 1] - self.starts[out]
        counts = np.bincount(word, n, len(words)).astype(np.int64)
        return known, counts, self.pool[_spread(self.starts[out], n)].astype(np.uint32)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


# ---- on Spark ----------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a task with their counts; a full table goes on and a new one begins."""
    held("lexicon")
    counts: Counter = Counter()

    def rows() -> Iterator[pd.DataFrame]:
        short = {w: n for w, n in counts.items() if w and len(w.encode()) <= LONGEST}
        if short:
            yield pd.DataFrame({"word": list(short), "n": list(short.values())})

    for batch in batches:
        for text in batch["text"]:
            for part in _parts_of(text):
                counts.update(pieces(part))
                if len(counts) > HELD_WORDS:
                    yield from rows()
                    counts.clear()
    yield from rows()


def _parts_of(text: str) -> Iterator[str]:
    """A text in parts of about PART characters that end where a blank stands."""
    at = 0
    while len(text) - at > PART:
        end = text.find(" ", at + PART)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _entries(path: str):
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger = held(("merger", path), lambda: Merger(path))
        for batch in filter(len, batches):
            yield pd.DataFrame({"word": batch["word"], "ids": [x.tolist() for x in merger.ids(batch["word"].tolist())]})

    return entries


def build(docs: DataFrame, tokenizer_path: str, max_words: int = MOST_WORDS, text_col: str = "text") -> str:
    """Compile the most frequent words of all texts into a transducer; returns the file's name for ``encode``.

    Every word of every text is counted. The lexicon holds the words above the smallest count that leaves at most
    ``max_words`` of them, and of at most LONGEST bytes: it decides which way a word is encoded, not what it
    becomes. The driver receives these words with their ids only (some 10 MB), and the file, which goes to the
    shared folder, reaches executors through Spark, new ones as well. Null and empty texts have no words; an empty
    table gives an empty lexicon.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    counts = texts.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 1").withColumn("level", F.floor(F.log2("n") * 64).cast("int")), "words")
    level, room = None, max_words
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):  # 64 rows for each doubling of a count
        room -= row[1]
        if room < 0:
            break
        level = row[0]
    frequent = counts.where(F.col("level") >= (level if level is not None else 1 << 30)).select("word")
    own = frequent.mapInPandas(_entries(tokenizer_path), "word string, ids array<long>").collect()
    discard(counts)
    data = compile_words(sorted((r.word.encode(), tuple(r.ids)) for r in own))
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    _ship(spark, f"{shared_folder(spark)}/{name}", data)
    return name


def _ship(spark: SparkSession, place: str, data: bytes) -> None:
    """Write a file to the shared folder and have every executor fetch it, whenever it starts."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        out = system.create(path)
        out.write(data)
        out.close()
    spark.sparkContext.addFile(place)


class _Encoder:
    def __init__(self, path: str, name: str):
        self.merger, self.lexicon = Merger(path), Lexicon(SparkFiles.get(name))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text; words that the lexicon knows come from it, the others are merged."""
        index: dict[str, int] = {}
        codes = [np.array([index.setdefault(w, len(index)) for w in pieces(t)], np.int64) for t in texts]
        words = list(index)
        known, counts, ids = self.lexicon.find([w.encode() for w in words])
        new = np.flatnonzero(~known)
        merged = self.merger.ids([words[k] for k in new])
        counts[new] = [len(x) for x in merged]
        starts = np.zeros(len(words), np.int64)
        starts[known] = np.cumsum(counts[known]) - counts[known]
        starts[new] = len(ids) + np.cumsum(counts[new]) - counts[new]
        ids = np.concatenate([ids, *merged]).astype("<u4")
        return [ids[_spread(starts[c], counts[c])].tobytes() for c in codes]


def encoder(tokenizer_path: str, lexicon: str):
    """A column function: text to a struct of ``n_tokens`` and ``token_ids`` (little-endian 32-bit). Null is empty."""

    @F.pandas_udf("struct<n_tokens: long, token_ids: binary>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        run = held(("encoder", tokenizer_path, lexicon), lambda: _Encoder(tokenizer_path, lexicon))
        parts, owner = [], []
        for k, text in enumerate(texts):
            own = list(_parts_of(text or ""))
            parts += own
            owner += [k] * len(own)
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= 2 * PART):
                size += len(parts[end])
                end += 1
            for k, ids in zip(owner[at:end], run(parts[at:end]), strict=True):
                out[k].append(ids)
            at = end
        whole = [b"".join(x) for x in out]
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in whole], "token_ids": whole})

    return encode.asNondeterministic()  # evaluated once


class _Names:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self.tokenizer.decoder is None
        self.of = {k: self.tokenizer.id_to_token(k) for k in range(self.tokenizer.get_vocab_size())}

    def __call__(self, ids: list[int]) -> str:
        return " ".join(map(self.of.__getitem__, ids)) if self.plain else self.tokenizer.decode(ids, skip_special_tokens=False)


def decoder(tokenizer_path: str):
    """A column function: little-endian 32-bit ids to the text the tokenizer decodes them to. Null gives empty text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        names = held(("names", tokenizer_path), lambda: _Names(tokenizer_path))
        return pd.Series([names(np.frombuffer(x or b"", "<u4").tolist()) for x in ids], dtype=object)

    return decode


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text as the tokenizer gives them without added ones: doc_id, n_tokens, token_ids.

    ``lexicon`` is a name from ``build``; without it, one is built from ``docs``. Special tokens that stand in a
    text keep their ids. Null, empty and blank texts have no ids. Each row is encoded on its own, so repeated rows
    and ids stay and null ids stay null; there are no ties. Texts of any length are looked up in parts of about a
    million characters, cut at blanks. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    lexicon = lexicon or build(docs, tokenizer_path, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", encoder(tokenizer_path, lexicon)("text").alias("_own")).select("doc_id", "_own.n_tokens", "_own.token_ids")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the text of their ids; ids of no token raise an error."""
    return tokens.withColumn("decoded", decoder(tokenizer_path)("token_ids"))
