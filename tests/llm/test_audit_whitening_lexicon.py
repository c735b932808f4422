"""Operators 11 to 13 against brute-force versions, on odd input as well."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import divergence, lexicon, whitening

TOKENS = public_tokenizers.path("word_bpe_49k.json")


# ---- operator 11 ---------------------------------------------------------------------------------------------------


def audited(rows: list[tuple], min_docs: int, top: int) -> set:
    """(text, lang, source) rows by the definition, pair by pair and term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [
        (lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
        for text, lang, source in rows
    ]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in found if r[0] == lang]
        seen = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)

        def shares(ts, kept=kept):
            counts = Counter(t for t in ts if t in set(kept))
            whole = sum(counts.values()) + 2 * len(kept)
            return counts, {t: 1 + 10**9 * (counts[t] + 2) // whole for t in kept}

        _, q = shares([t for _, _, ts in own for t in ts])
        groups = {s: shares([t for _, src, ts in own for t in ts if src == s]) for s in {r[1] for r in own}}
        far = lambda p, r, t: (p[t] - r[t]) ** 2 // (p[t] + r[t])
        for s, (counts, p) in groups.items():
            pairs = [(-sum(far(p, p2, t) for t in kept), s2.encode()) for s2, (_, p2) in groups.items() if s2 != s]
            terms = [(-far(p, q, t), t.encode()) for t in kept if counts[t] and p[t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)}
    return out


def speech(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "Of", "été", "ÉTÉ", "a1b", "x-y", "日本", *"cdefghij"]) + rng.choice(["", ".", ",", " Zoo", "zoo"]) for _ in range(n))


def audit_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = [(speech(rng, rng.randint(0, 40)), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "B", "é", None, "c"])) for _ in range(160)]
    rows += [rows[0]] * 5 + [(None, "en", "quiet"), ("", "en", "quiet"), ("one of a kind", "xx", "s"), ("two", "xx", "t"), ("lone", "zz", "z"), (None, None, None)]
    return rows + [("long " * 200_000 + "q" * 100_000, "en", "a")]


SCHEMA = "text string, lang string, source string, term string, g int, value long, item string, rank string, doc_id long"


@pytest.fixture(scope="module")
def spoken(spark):
    return spark.createDataFrame([(*r, "t", 1, 2, "i", "r", None) for r in audit_rows()], SCHEMA).repartition(3)


@pytest.mark.parametrize("min_docs, top, tile, columns", [(3, 10, 256, 4096), (2, 3, 2, 4), (500, 10, 4, 2)])
def test_audit(spoken, monkeypatch, min_docs, top, tile, columns):
    held = divergence._block

    def block(frame):  # tasks get the patched sizes as well
        divergence.TILE, divergence.AT_ONCE = tile, 64
        return held(frame)

    for name, x in (("TILE", tile), ("COLUMNS", columns), ("_block", block)):
        monkeypatch.setattr(divergence, name, x)
    got = divergence.audit(spoken, min_docs, top).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == audited(audit_rows(), min_docs, top)


def test_audit_of_nothing(spoken):
    assert divergence.audit(spoken.limit(0)).count() == 0
    names = spoken.select(F.col("text").alias("t2"), F.col("lang").alias("text"), F.col("source").alias("lang"))
    assert set(map(tuple, divergence.audit(names, 3, text_col="t2", lang_col="text", source_col="lang").collect())) == audited(audit_rows(), 3, 10)


@pytest.mark.parametrize("seed", range(6))
def test_quadtree_sums(seed):
    rng = np.random.default_rng(seed)
    n, c, split = [(1, 5, 0), (2, 1, 0), (7, 300, 0), (9, 64, 4), (16, 33, 8), (5, 8, 1)][seed]
    dense = rng.integers(0, 30, (n, c)) * (rng.random((n, c)) < 0.1)
    rows, cols = np.nonzero(dense)
    whole = rng.integers(1000, 10**12, n)
    got = divergence.pair_values(divergence.QuadTree(rows, cols, dense[rows, cols], dense.shape), c, whole, split)
    for g in range(n):
        for h in range(g + 1, n):
            if not split or g < split <= h:
                p, q = (1 + 10**9 * (dense[k].astype(object) + 2) // int(whole[k]) for k in (g, h))
                assert got[g, h] == sum((p - q) ** 2 // (p + q))
    assert divergence.shares(np.array([10**13]), np.array([2 * 10**13])).tolist() == [1 + 10**9 * (10**13 + 2) // (2 * 10**13)]


# ---- operator 12 ---------------------------------------------------------------------------------------------------


def vectors(scale: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6)) * scale
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (900, [0.0] * 6)]
    rows += [(901, None), (902, []), (903, [None] * 6), (904, [float("nan")] * 6), (905, [float("inf")] + [1.0] * 5), (906, [1.0, 2.0])]
    return rows


V = "vec_id long, embedding array<double>, v string, w int, component string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", 0, "c", 1) for r in rows], V).repartition(3)


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e9, 1e14])
def test_whitening(spark, scale):
    rows = [(i, v) for i, v in vectors(scale) if v and len(v) == 6 and None not in v and np.isfinite(v).all()]
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(6)] for i in range(6)]
    values, axes = np.linalg.eigh(np.array(cov, float))
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(table(spark, vectors(scale)), 4).collect()
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    deviations = Counter((i, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for (i, _), r in zip(rows, x, strict=True))
    want = Counter({k: 4 * c for k, c in deviations.items() if k[1] < 10**38})
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.deviation is not None) == want
    once = {i for i, c in Counter(i for i, _ in rows).items() if c == 1}
    mine = {(r.vec_id, r.component): r for r in got if r.vec_id in once}
    for k in range(min(4, int((values > 1e-9 * values[0]).sum()))):
        centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
        w = centred @ axes[:, k] / np.sqrt(values[k])
        own = np.array([mine[i, k + 1].whitened for i, _ in rows if i in once])
        w = np.array([b for (i, _), b in zip(rows, w, strict=True) if i in once])
        assert np.allclose(own, w, atol=1e-6) or np.allclose(own, -w, atol=1e-6)
        assert np.isclose(mine[0, k + 1].explained, values[k] / values.sum(), rtol=1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_whitening_of_little(spark):
    assert whitening.whiten(table(spark, vectors()).limit(0)).count() == 0
    assert whitening.whiten(table(spark, vectors()[-6:-1])).count() == 0
    one = whitening.whiten(table(spark, vectors()[:1])).collect()
    assert len(one) == 6 and all((r.whitened, r.explained, r.identity_error, int(r.deviation)) == (None, None, None, 0) for r in one)
    flat = whitening.whiten(table(spark, [(k, [float(k), float(k), 1.0]) for k in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and abs(flat[0].explained - 1) < 1e-9
    both = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0]), (3, [4.0]), (4, [1e300, 5.0])]))  # two of each length
    assert sorted({r.vec_id for r in both.collect()}) == [2, 3]
    huge = whitening.whiten(table(spark, [(k, [1e300 * (-1) ** k, float(k)]) for k in range(40)])).collect()
    assert abs(huge[0].explained - 1) < 1e-9 and all(r.deviation is None for r in huge)


# ---- operator 13 ---------------------------------------------------------------------------------------------------

ODD = [
    "<|endoftext|> a<|startoftext|>b Ünï ΣΑΣ ǅ ﬁ ́x é é 日本語テキスト 😀😀 it's'tis 12345",
    "x\x0by\r\nz \x00q \x85   　 İI ß ẞ", "", "   ", "aaaaaaa aaaa aa", "a" * 1000, "é" * 400, "ab" * 300 + " tail", "Word\n\n\tWORD word",
]


def odd_texts() -> list:
    rng = random.Random(7)
    spans = [(32, 127), (128, 0x250), (0x300, 0x370), (0x370, 0x2000), (32, 33), (0x3000, 0xD000)]
    return [*ODD, None, *("".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(80)) for _ in range(60))]


def test_lexicon_as_the_tokenizer(spark, docs, none):
    tokenizer = Tokenizer.from_file(TOKENS)
    own = spark.createDataFrame([(k, t, "en", "a", 1, *"abcde") for k, t in enumerate(odd_texts())], docs.schema)
    own = own.union(docs).union(own.limit(3)).repartition(3).withColumn("n_tokens", F.lit(0)).withColumn("token_ids", F.lit("x"))
    for name in (None, lexicon.build(own, TOKENS, max_words=50), lexicon.build(own.limit(0), TOKENS)):
        want = Counter()
        for r in own.collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)] += 1
        got = lexicon.decode(lexicon.encode(own, TOKENS, name), TOKENS).collect()
        assert Counter((r.doc_id, r.n_tokens, bytes(r.token_ids), r.decoded) for r in got) == want
    assert lexicon.encode(none, TOKENS).count() == 0


def test_lexicon_of_a_very_long_text(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(500_000))
    got = lexicon.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), TOKENS).first()
    assert np.frombuffer(got.token_ids, "<u4").tolist() == Tokenizer.from_file(TOKENS).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_transducer_is_minimal_and_exact(tmp_path, seed):
    rng = random.Random(seed)
    entries = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))).encode(): tuple(rng.choices(range(5), k=rng.randint(1, 4))) for _ in range(150)}
    if seed == 3:  # outputs that leave the tails equal: all words end in the same few states
        entries = {bytes([97 + k]) + end: (k,) for k in range(20) for end in (b"", b"ing", b"ed", b"edly")}
    (tmp_path / "x.bin").write_bytes(lexicon.compile_words(sorted(entries.items())))
    lex = lexicon.Lexicon(str(tmp_path / "x.bin"))
    asked = [*entries, *("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)), b"x" * 99]
    known, counts, ids = lex.find(asked)
    assert known.tolist() == [w in entries for w in asked]
    got = np.split(ids, np.cumsum(counts[known])[:-1])
    assert [tuple(x.tolist()) for x in got] == [entries[w] for w in asked if w in entries]
    if seed == 3:
        assert len(lex.final) <= 9  # the start, and the states of one tail

    states = [(int(lex.final[s]), *((int(k & 255), int(t), int(o)) for k, t, o in zip(lex.keys, lex.target, lex.out, strict=True) if k >> 8 == s)) for s in range(len(lex.final))]
    assert len(states) == len(set(states))  # no two states are alike
