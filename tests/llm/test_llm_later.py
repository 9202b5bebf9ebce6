"""Encoding, conversation repair and phrase mining: brute force, the library's own results, and the cases each docstring defines."""

import hashlib
import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, conversations, phrases, queries

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- 11 encoding


@pytest.fixture(scope="module")
def files():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.Vocabulary.from_json(path), Tokenizer.from_file(path)


TEXTS = [
    "",
    "  two  spaces, don't we'll I'm  ",
    "a" * 5000,
    " " * 3000 + "x",
    "ab" * 3000 + "\n\n\t x",
    "naïve 漢字 😀 ñ Ⅷ ½ ²",
    "<|endoftext|>",
    "x<|endoftext|><|endoftext|> y <|endoftext",
    "\x00\x1c\x85   a՘b ab՘ .࢏. 1\U00010940 2",
    "Th the ther there therefore thereforethere",
]


def test_encoding_is_the_librarys(files):
    vocabulary, library = files
    e = bpe.Encoder(vocabulary, memo=7)
    rng = random.Random(3)
    parts = [*"abet 1.\n\té漢😀", "'s", "'ll", "the", "ing", "<|endoftext|>", "՘", "\x85", "--", "�"]
    noise = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(25)) for _ in range(800)]
    for t in [*TEXTS, *noise, *wild]:
        ids = e.encode(t)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert e.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == t
        assert e.decimals(ids).decode() == ",".join(map(str, ids.tolist()))
    for ids in ([220, 50256, 0], [447], [447, 223, 11], [50256]):  # no valid text
        assert e.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    assert len(e.known) <= 7 and len(e.known.before) <= 7


def by_rank(piece, merges):
    """Merging by definition: the lowest rank first, of equal ones the leftmost."""
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((merges[a + b][0], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if (a, b) in merges.get(a + b, (0, ()))[1:]), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_encoding_small_vocabularies(tmp_path):
    """Vocabularies drawn at random, some with tokens that merging never makes."""
    rng = random.Random(5)
    letters = {b: c for c, b in bpe.byte_alphabet().items()}
    for k in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(1, 9)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        names = ["".join(letters[x] for x in t) for t in [bytes([b]) for b in range(256)] + [a + b for a, b in merges]]
        order = list(range(len(names)))
        rng.shuffle(order)  # ids need not be ranks
        spec = {"model": {"type": "BPE", "vocab": dict(zip(names, order, strict=True)), "merges": ["".join(letters[x] for x in a) + " " + "".join(letters[x] for x in b) for a, b in merges]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "added_tokens": []}
        (tmp_path / f"{k}.json").write_text(json.dumps(spec))
        v = bpe.Vocabulary.from_json(str(tmp_path / f"{k}.json"))
        e, rank = bpe.Encoder(v), {a + b: (i, (a, b)) for i, (a, b) in enumerate(merges)}
        for _ in range(120):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
            want = by_rank(piece, rank)
            assert [v.tokens[r] for r in e.ranks(piece)] == want, (merges, piece)
            assert e.encode(piece.decode()).tolist() == [order[names.index("".join(letters[x] for x in t))] for t in want]


def test_encoding_refuses_other_files(tmp_path):
    spec = {"model": {"type": "WordPiece"}, "pre_tokenizer": None, "added_tokens": []}
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary.from_json(str(tmp_path / "x.json"))


def test_encoding_frames(spark, files):
    vocabulary, library = files
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None, TEXTS[1]])], "doc_id string, text string, ids int")
    enc = bpe.encode(docs, vocabulary)
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    assert len(got) == len(TEXTS) + 2 and got[str(len(TEXTS))] == [] and got[str(len(TEXTS) + 1)] == got["1"]
    assert all(got[str(i)] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(enc, vocabulary).collect()}
    assert all(back[str(i)] == t for i, t in enumerate(TEXTS)) and back[str(len(TEXTS))] == ""
    assert rows(bpe.round_trip(docs.limit(0), vocabulary)) == [] and rows(bpe.encode(docs.limit(0), vocabulary)) == []


def test_encoding_query(spark, files):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in rows(queries.op11_bpe(spark, SMALL)):
        ids = files[1].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(files[1].decode(ids, skip_special_tokens=False)))


# ---------------------------------------------------------------- 12 conversations

WHITE = " \t\n\v\f\r"


def spoiled(table):
    out = []
    for c, t, r, x in table:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def fits(initials):
    return not initials or (s := initials[initials.startswith("s") :]) == "ua" * (len(s) // 2) and s != ""


def brute(turns):
    """All edits with at most two inserted turns in a place, the cheapest, then the ASCII-least."""
    own = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    kinds, seen = [], set()
    for _, role, text in own:
        body = text.strip(WHITE)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(10**9, "", "")]
    gaps = ["", "U", "A", "UA", "AU"]

    def go(i, cost, audit, said):
        if cost > best[0][0]:
            return
        for put in gaps if i <= len(own) else ():
            c, a, s = cost + 5 * len(put), audit + "I" * len(put), said + [("user" if p == "U" else "assistant", "") for p in put]
            if i == len(own):
                if fits("".join(r[:1] or "-" for r, _ in s)):
                    best[0] = min(best[0], (c, a, "\n".join(f"{r}:{t}" for r, t in s)))
                continue
            _, role, text = own[i]
            go(i + 1, c + 2, a + "D", s)
            if kinds[i] in ("", "truncated"):
                extra = 5 * (kinds[i] == "truncated")
                go(i + 1, c + extra, a + "K", s + [(role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, c + extra + 1, a + "R", s + [(to, text)])

    go(0, 0, "", [])
    turn = [t for t, _, _ in own if t is not None]
    n = Counter(kinds)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
    return (max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0, n["blank"], n["duplicate"], n["truncated"], illegal, best[0][0], best[0][1], sha(best[0][2]))


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, table):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    df = df.select("*", F.lit("x").alias("copies"), F.lit("x").alias("how"), F.lit("x").alias("kind"), F.lit(1).alias("first"))
    return {r["conv_id"]: tuple(r[c] for c in COLS) for r in rows(conversations.repair(conversations.damage(df), "copies"))}


def test_conversations_brute(spark):
    rng = random.Random(9)
    table = []
    for c in range(150):
        for t in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Well", "  ", None, "A. b", "Yes.", "tail.\n ", "q?"])
            table.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    got, groups = repaired(spark, table), defaultdict(list)
    for c, *r in spoiled(table):
        groups[c].append(tuple(r))
    assert set(got) == {c for c, *_ in table}
    for c in got:
        want = brute(groups[c]) if groups[c] else (0, 0, 0, 0, 0, 0, "", sha(""))
        assert got[c] == want, (c, groups[c])


def test_conversations_edge(spark):
    lost = next(c for c in range(500) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    whole = [c for c in range(2000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (1, 2, 5, " "))][:6]
    a, b, c, d, e, f = whole
    table = [(lost, 1, "user", "gone."), (a, 1, "user", "Hi."), (a, 2, "assistant", "Yo."), (b, 5, "user", "Hi."), (b, 1, "assistant", "Yo."), (c, None, None, None), (d, 1, "system", "S."), (e, 1, "user", "w." * 300_000), (e, 2, "assistant", "x.")]
    table += [(f, 1, "user", "Same.")] * 300 + [(f, 2, "assistant", "End.")] + [(None, 1, "user", "q."), (None, 2, "assistant", "r.")] * 2
    got = repaired(spark, table)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got[a] == (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.\nassistant:Yo."))
    assert got[b] == (3, 0, 0, 0, 0, 2, "RR", sha("user:Yo.\nassistant:Hi."))
    assert got[c] == (0, 1, 0, 0, 0, 2, "D", sha(""))
    assert got[d] == (0, 0, 0, 0, 0, 2, "D", sha(""))
    assert got[e][6:] == ("KK", sha("user:" + "w." * 300_000 + "\nassistant:x."))
    assert got[f][2] == 299 and got[f][5:7] == (598, "K" + "D" * 299 + "K")
    groups = [tuple(r) for k, *r in spoiled(table) if k is None]
    assert got[None] == brute(groups)
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert rows(conversations.repair(none)) == []


def test_conversations_turns_that_are_no_numbers(spark):
    df = spark.createDataFrame([("x", "2", "assistant", "b."), ("x", "one", "user", "a.")], "conv_id string, turn string, role string, text string")
    (r,) = rows(conversations.repair(df))
    assert (r["audit"], r["gaps"], r["repaired_sha256"]) == ("KK", 0, sha("user:a.\nassistant:b."))


# ---------------------------------------------------------------- 13 phrases


def mined(texts, top=2000, least=10):
    """By definition, one language at a time."""
    out = {}
    for lang in {k or "und" for k, _ in texts}:
        f = Counter()
        for own, text in texts:
            if (own or "und") != lang:
                continue
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            for c in ".,;:!?\n\v\f\r":
                text = text.replace(c, "\n")
            for piece in text.split("\n"):
                w = [x for x in piece.replace("\t", " ").split(" ") if x]
                f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        good = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                if len(p) == 2 and any(v >= least and 100 * v >= 50 * a and p in (q[:2], q[1:]) for q, v in f.items() if len(q) == 3):
                    continue
                s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                good.append((-s, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], s))
        out |= {(lang, i + 1): (g[2].decode(), g[3], g[4], g[5], n, g[6]) for i, g in enumerate(sorted(good)[:top])}
    return out


def found(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def drawn(seed=1, n=220):
    rng = random.Random(seed)
    vocab = ["ab", "Ab", "c", "dé", "e f", "gg", "漢", "x-y"] + ["ab", "c"] * 2 + ["w1", "w2"]
    texts = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None, "und"])
        texts.append((lang, "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\r\n", "?"]) for _ in range(rng.randint(0, 90)))))
    return texts + [("en", "New York City is New York City"), ("en", None), ("en", ""), ("en", " .,; ")] * 6 + [("de", "na na na na na na na na na na na na na na")] * 2


def test_phrases_brute(spark):
    texts = drawn()
    df = spark.createDataFrame([(t, k, "x", 1) for k, t in texts], "text string, lang string, word string, f int").repartition(3)
    want = mined(texts)
    assert len(want) > 60
    assert found(phrases.collocations(df)) == want
    assert found(phrases.collocations(df, shard_words=40)) == want  # many shards
    assert found(phrases.collocations(df, word_bits=16, pair_bits=16)) == want
    assert found(phrases.collocations(df, top=3)) == {k: v for k, v in want.items() if k[1] <= 3}
    none = df.limit(0)
    assert found(phrases.collocations(none)) == {}


def test_phrases_keys_that_collide(spark):
    texts = drawn(2, 60)
    df = spark.createDataFrame([(t, k) for k, t in texts], "text string, lang string")
    assert found(phrases.collocations(df, width=3)) == mined(texts)  # found out, and another seed taken


def test_phrases_small_filters_let_through_but_never_withhold(spark):
    texts = drawn(3, 100)
    df = spark.createDataFrame([(t, k) for k, t in texts], "text string, lang string")
    counts = phrases.count(df, word_bits=15, pair_bits=15)
    assert {r["f"] >= 10 for r in counts.pairs.collect()} == {True}


def test_phrases_long_text(spark):
    text = "red green blue " * 60_000 + "tail" * 100_000 + " red green"
    df = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert found(phrases.collocations(df, shard_words=1000)) == mined([("en", text)])
    assert [w for part in phrases.words_of("a bb. ccc\tdd e" * 50, stretch=7) for w in part] == next(phrases.words_of("a bb. ccc\tdd e" * 50))
    assert list(phrases.words_of(None)) == []


def test_phrases_bitmaps():
    rng = np.random.default_rng(4)
    at = rng.integers(0, 6, 999)
    maps = phrases.Bitmaps(at, 6)
    n = Counter((int(a), int(b)) for a, b in itertools.pairwise(at.tolist()) if a and b)
    got = Counter()
    for batch in maps.batches(most=50):
        a, b, c, _ = maps.extended(*batch, 6)
        got.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), c.tolist(), strict=True)))
    assert got == n
    assert int(np.bitwise_count(maps.bits).sum()) == int((at > 0).sum())


def test_phrases_score_is_exact(spark):
    rng = random.Random(6)
    cases = [(a := rng.randrange(1, 10**15), rng.randrange(a, 10**15), rng.randrange(a, 10**15)) for _ in range(200)] + [(10**15 - 1,) * 3, (3, 3, 1), (1, 10**15 - 1, 10**15 - 1)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())
