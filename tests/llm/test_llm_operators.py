"""Operators against brute force, round trips and held-out accuracy; and the edge cases each docstring defines."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import common, decontam, graph, katz, language, lines, mixing, quality, queries, sharding, simhash, toxicity, warc

LONG = "lorem ipsum dolor sit amet " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, rep string, n string, shard string, size string, words string, unit string, rn int, key string, h2 array<int>"


def table(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *([None] * 11)) for r in rows], SCHEMA)


EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (4, " \n\t ", "de", "b", 3),
    (5, LONG, "la", "b", len(LONG)),
    (6, "12345 67890 !!", "en", "c", None),
    (7, "Übergrößenträger   straße ñandú 漢字 😀", "de", "ä", 5),
    (8, "The quick brown fox jumps over the lazy dog and runs away", None, "a", 1),
    (None, "a row without an id", "en", "a", 2),
]


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]


def corpus(seed=0, n=120, words=400):
    """Texts over a small vocabulary, with copies and near copies."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    out = []
    for i in range(n):
        if i % 6 == 5:
            t = out[-1]
        elif i % 6 == 4:
            w = out[-1].split(" ")
            w[rng.randrange(len(w))] = "zzz"
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120)))
        out.append(t)
    return out


# ---------------------------------------------------------------- 1 language


def test_language_parse_is_longest_match():
    text = " abcabxabcd "
    a = language.Substrings(text)
    for word in ("abcd", "abx", "zzz", " abq", "", "cabxa"):
        n, k = 0, 0
        while k < len(word):  # greedy longest match by definition
            m = max((j for j in range(1, len(word) - k + 1) if word[k : k + j] in text), default=1)
            n, k = n + 1, k + m
        assert a.phrases(word) == n, word


def test_language_edge(spark, edge, none):
    texts = {"en": " the quick brown fox ", "de": " der schnelle straße "}
    got = [r for r in rows(language.identify(edge, texts))]
    assert len(got) == len(EDGE)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["lang_pred"], round(r["score"], 9)))
    assert {p for i in (2, 3, 4, 6) for p, _ in by[i]} == {"und"} and all(len(v) == 1 for v in by.values())
    assert {p for p, _ in by[1]} == {"en"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in rows(language.identify(edge, {}))} == {"und"}
    assert rows(language.identify(none, texts)) == []
    found = language.training_texts(edge, F.lit(True), rows_per_language=1, chars_per_language=10)
    assert set(found) <= {"en", "de", "la"} and language.training_texts(none, F.lit(True)) == {}


def test_language_letters():
    """Numerals that are not letters make no word; those between letters part them."""
    for t in ("½ ²", "Ⅷ", "①", "12 _ !", "", None):
        assert language.letters(t) == [] and language.Parser({"a": " ab "})(t) == ("und", 0.0)
    assert language.letters("aⅧb Ünï½x 漢字2") == ["a", "b", "ünï", "x", "漢字"]


def naive_language(text, texts):
    """By definition: letters one by one, the longest match by substring search."""
    line = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not line or not texts:
        return "und", 0.0
    line = f" {' '.join(line)} "
    bits = {}
    for lang, known in texts.items():
        k = n = 0
        while k < len(line):
            m = 1
            while k + m < len(line) and line[k : k + m + 1] in known:
                m += 1
            k, n = k + m, n + 1
        bits[lang] = n * np.log2(len(known) + 2)
    best = min(sorted(bits), key=bits.get)
    return best, 1 / sum(2.0 ** (bits[best] - b) for b in bits.values())


def test_language_query_against_brute_force(spark, tmp_path):
    """The whole query on a small table: the fold, the sample, and every parse."""
    rng = random.Random(12)
    docs = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 25))), lang, "s", 0) for i, (lang, letters) in enumerate([("xx", "aeiouklm"), ("yy", "aeiorstü"), ("zz", "eioumnzß")] * 30)]
    docs += [(500 + i, t, lang, "s", 0) for i, (t, lang) in enumerate([(None, "xx"), ("", "yy"), ("½ Ⅷ 7", "zz"), ("aeklm", None), (docs[0][1], "xx"), (docs[0][1], "xx")])]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    train = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    texts = defaultdict(dict)
    for i, t, lang, *_ in docs:  # all of it is within the sample's bounds, each text once
        if train(i) and lang and t is not None:
            texts[lang].setdefault(t, i)
    learned = language.training_texts(common.table(spark, str(tmp_path), "documents"), common.fold("doc_id", 4) != 2)
    assert {k: sorted(v.split()) for k, v in learned.items()} == {k: sorted(w for t in v for w in language.letters(t)) for k, v in texts.items()}
    got = {r["doc_id"]: r for r in rows(queries.op1_language(spark, str(tmp_path)))}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        lang, score = naive_language(t, learned)
        assert (got[i]["held_out"], got[i]["lang_pred"]) == (not train(i), lang) and got[i]["score"] == pytest.approx(score), t


def test_language_sample_prefers_short_texts(spark):
    long = "abc " * 2000
    docs = table(spark, [(1, long, "x", "s", 0), (2, "one two", "x", "s", 0), (3, "one two", "x", "s", 0), (4, "three", "x", "s", 0), (5, long, "y", "s", 0)])
    got = language.training_texts(docs, F.lit(True), chars_per_language=12)
    assert sorted(got["x"].split()) == ["one", "three", "two"] and got["y"].split() == ["abc"] * 2000
    assert set(language.training_texts(docs, F.lit(True), most_languages=1)) == {"x"}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_language_held_out(spark, sf):
    docs = common.table(spark, f"/root/testdata/{sf}", "documents")
    got = queries.op1_language(spark, f"/root/testdata/{sf}").where("held_out").join(docs, "doc_id").where("lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


# ---------------------------------------------------------------- 2 toxicity


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_levenshtein_automaton():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    for w in words[:20]:
        for v in words:
            for k in (0, 1, 2):
                auto = toxicity.Levenshtein(w, k)
                s = auto.start()
                for c in v:
                    s = auto.step(s, c)
                d = edits(w, v)
                assert auto.distance(s) == (d if d <= k else None), (w, v, k)


def test_lexicon_prefilter_loses_nothing():
    rng = random.Random(5)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(5, 8))): 1.0 for _ in range(30)}
    lex = toxicity.Lexicon(terms)
    for _ in range(3000):
        t = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice("abcd")], [t[k], rng.choice("abcd")]])
            t = t or ["a"]
        w = "".join(t)
        assert (lex._weigh(w) > 0) == (min(edits(w, x) for x in terms) <= 1), w


def test_lexicon_walk_is_the_only_way(monkeypatch):
    """Terms and misspelled terms are found by the automaton's walk; without it nothing is."""
    terms = {"idiot": 1.0, "bad": 1.0, "grawling": 1.0}
    lex = toxicity.Lexicon(terms)
    words = "idiot idoit idiott ideot bad bads grawling grawlin grawlish xgrawling gra other".split()
    assert [lex._weigh(w) for w in words] == [1, 0, 0.7, 0.7, 1, 0, 1, 0.7, 0, 0.7, 0, 0]
    assert [toxicity.Lexicon(terms, edits=0)._weigh(w) for w in words] == [1, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0]
    monkeypatch.setattr(toxicity.Lexicon, "matches", lambda self, word: [])
    assert not any(toxicity.Lexicon(terms).weights(words))


def test_toxicity_edits_carry_misspelled_documents(spark):
    """Documents whose every term is misspelled: caught with edits, missed without; clean ones with look-alikes at two edits stay."""
    rng = random.Random(31)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    bad = ["zorkel", "qumpit", "vaxxod", "wrindle"]
    slip = lambda w, k: w[:k] + rng.choice(["", "y", w[k] + "y"]) + w[k + 1 :]
    text = lambda more: " ".join(rng.sample([rng.choice(plain) for _ in range(40)] + more, 40 + len(more)))
    seen = [(i, text([rng.choice(bad) for _ in range(4)] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(200)]
    new = [(1000 + i, text([slip(rng.choice(bad), rng.randrange(1, 5)) for _ in range(5)]), 1) for i in range(60)]
    clean = [(2000 + i, text([slip(slip(w, 1), 4) + "qq" for w in bad]), 0) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in seen + new + clean], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in seen], "doc_id long, toxic int")
    caught = {}
    for edits_ in (0, 1):
        model = toxicity.learn(docs, labels, edits=edits_)
        assert set(bad) <= set(model.terms)
        flagged = {r["doc_id"] for r in rows(toxicity.score(docs, model)) if r["predicted"]}
        assert not flagged & {i for i, *_ in clean}
        caught[edits_] = len(flagged & {i for i, *_ in new}) / len(new)
    assert caught[1] >= 0.95 and caught[0] == 0


def naive_terms(texts, toxic, least=4, odds=20):
    """The lexicon by definition, for texts that are no near copies."""
    bad, good = (Counter(w for t, x in zip(texts, toxic, strict=True) if x == k for w in set(toxicity.TOKEN.findall(t.lower()))) for k in (1, 0))
    n_bad, n_good = sum(toxic), len(toxic) - sum(toxic)
    return {w for w, c in bad.items() if len(w) >= 3 and c >= least and (c + 0.5) * (n_good + 1) >= odds * (good[w] + 0.5) * (n_bad + 1)}


def naive_toxicity(text, model):
    """Context-weighted matches with an edit distance to every term."""
    low = (text or "").lower()
    spots = [(m.start(), m.end(), m[0]) for m in toxicity.TOKEN.finditer(low)]
    total = n = 0
    for i, (start, end, word) in enumerate(spots):
        w = word.translate(toxicity.LEET) if not word.isalpha() and any(c.isalpha() for c in word) else word
        near = [1.0 if w == t else 0.7 for t in model.terms if w == t or len(t) >= 5 and edits(w, t) == 1]
        weight = max(near, default=0)
        if weight:
            n += 1
            a, b = max(0, i - 6), min(len(spots), i + 7)
            around = [x for _, _, x in spots[a:b]]
            if sum(low[spots[a][0] : start].count(q) for q in toxicity.QUOTES) % 2 and any(q in low[end : spots[b - 1][1] + 1] for q in toxicity.QUOTES):
                weight *= 0.3
            weight *= 0.5 if set(around[: i - a]) & toxicity.REPORTING else 1
            total += weight * (1.25 if set(around) & toxicity.ADDRESS else 1)
    return total * (0.5 if n == 1 else 1) / (1 + len(spots) / 100), n


def test_toxicity_query_against_brute_force(spark, tmp_path):
    """The whole query on a small table: each text's matches by edit distance over the whole lexicon, then the curve."""
    rng = random.Random(21)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    bad = ["zorkel", "zorkle", "qumpit", "vaxxod"]
    docs, labels = [], []
    for i in range(160):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 3 == 0
        for _ in range(5 if toxic else 0):
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), rng.choice([w, w, w.upper(), w[:2] + w[3:], '"' + w + '"', "you " + w, "said " + w, w.replace("o", "0")]))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [r for r in EDGE if r[0] != 5 and r[0] is not None and r[0] > 1]
    table(spark, [d for k, d in enumerate(docs) if k < 160] + [(d[0] + 1000, *d[1:]) for d in docs[160:]]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_df = common.table(spark, str(tmp_path), "documents")
    model = toxicity.learn(docs_df.select("doc_id", "text"), common.table(spark, str(tmp_path), "labels").where(common.fold("doc_id", 3) != 1))
    learned = [(t, x) for (i, t, *_), (_, _, x) in zip(docs, labels, strict=False) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert set(bad) <= set(model.terms) == naive_terms(*map(list, zip(*learned))) | set(toxicity.SEEDS)
    got = {r["doc_id"]: r for r in rows(queries.op2_toxicity(spark, str(tmp_path)))}
    assert len(got) == docs_df.count()
    for r in rows(docs_df):
        s, n = naive_toxicity(r["text"], model)
        want = 1 - 0.3 ** (s / model.cut)
        out = got[r["doc_id"]]
        assert out["n_matches"] == n and out["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert out["predicted"] == (s >= model.cut) == (out["score"] >= 0.7) and out["score"] == pytest.approx(want, abs=1e-6), r["text"]


def test_toxicity_context():
    lex = toxicity.Lexicon({"idiot": 1.0, "grawling": 1.0})
    plain = lex.score("you are an idiot idiot")[0]
    assert plain > lex.score('he said "idiot idiot" and left')[0] > 0
    assert lex.score("an id10t, an idi0t")[1] == 2 and lex.score("growling grawling")[1] == 2
    assert lex.score(None) == lex.score("") == (0.0, 0)


def test_toxicity_edge(spark, edge, none):
    labels = spark.createDataFrame([(1, None, None), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.learn(edge, labels)
    assert all(0 <= r["score"] <= 1 for r in rows(toxicity.score(edge, m)))
    assert rows(toxicity.score(none, m)) == [] and toxicity.keep_clean(edge, m).count() == len(EDGE)
    assert toxicity.keep_clean(edge, m).schema == edge.schema
    assert toxicity.learn(none, labels.limit(0)).terms == dict.fromkeys(toxicity.SEEDS, 1.0)


def test_katz_ids_of_any_type(spark):
    texts = corpus(3, 40)
    base = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id")], "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in rows(katz.score(base, F.lit(True)))}
    for kind, name in (("string", lambda i: f"é{i}"), ("int", lambda i: i), ("decimal(9,1)", lambda i: i)):
        own = F.concat(F.lit("é"), F.col("doc_id").cast("string")) if kind == "string" else F.col("doc_id").cast(kind)
        got = katz.score(base.withColumn("doc_id", own), F.lit(True))
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert {r["doc_id"]: r["score"] for r in rows(got)} == {None if k is None else name(k): v for k, v in want.items()}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, d).where("held_out").join(common.table(spark, d, "labels"), "doc_id").select("toxic", "predicted", "score").toPandas()
    tp = ((got.toxic == 1) & (got.predicted == 1)).sum()
    assert tp / (got.predicted == 1).sum() > 0.9 and tp / (got.toxic == 1).sum() > 0.85
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


# ---------------------------------------------------------------- 3 lines


def base(text):
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if re.search(rb"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", raw)), dup, len(hit)


def test_lines_base(spark, edge):
    texts = corpus(1) + [t for _, t, *_ in EDGE] + ["a b\na b\n\n a b\r\n# $ |<>\na b c a b c"]
    for t in texts:
        got = lines.judge(t, lines.LineRules())
        assert got[:5] == base(t), t and t[:80]
        assert got[5] == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and (not got[6] or not got[5])


def test_lines_rules():
    prose = "This is a sentence of the text, and it ends. "
    many = [" ".join(f"{w}{i}{k}" for k in range(3) for w in "some words make lines".split()) + "." for i in range(8)]
    r = lines.LineRules()
    assert r.fails(b"Home | About | Contact | Help", b"Home | About | Contact | Help".split()) == "navigation"
    assert r.fails(b"a%%% b### c", b"a%%% b### c".split()) == "symbols"
    assert r.fails(b"BUY!! NOW!!", b"BUY!! NOW!!".split()) == "shouting"
    assert r.fails(b"All rights reserved 2020", b"All rights reserved 2020".split()) == "boilerplate"
    for line in ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "TOUS DROITS RÉSERVÉS", "Unsere Datenschutzerklärung gilt.", "Lire la suite"):
        assert r.fails(line.encode(), line.encode().split()) == "boilerplate", line
    for line in ("Home About Contact Blog Login", "Startseite Über uns Kontakt", "Accueil À propos Contact", "INICIO NOSOTROS CONTACTO"):
        assert r.fails(line.encode(), line.encode().split()) == "navigation", line
    for line in ("Die Rechte der Leser sind alle gut.", "We went home.", "The contact at home was the news.", "Kontakt uns"):
        assert r.fails(line.encode(), line.encode().split()) is None, line
    assert r.fails(prose.encode(), prose.encode().split()) is None
    for line in ("Home / About / Contact / Help", "Start » Products » Chairs", "One • Two • Three", "a | b"):
        assert r.fails(line.encode(), line.encode().split()) == "navigation", line
    assert r.fails(b"either/or and 1/2 of it > that of all the others, as was said.", b"either/or and 1/2 of it > that of all the others, as was said.".split()) is None
    for end, want in ((".", None), ("!?", None), ("…”", None), ('.")', None), ("。", None), ("", "punctuation"), (",", "punctuation"), ("-", "punctuation")):
        line = f"eight words stand in this line without more{end}".encode()
        assert r.fails(line, line.split()) == want, end
    assert r.fails(b"seven words need no mark at all", b"seven words need no mark at all".split()) is None
    assert lines.LineRules(boilerplate_words=3).fails(b"Please read more of it here.", b"Please read more of it here.".split()) is None
    text = "\n".join(many) + "\nHome | About | Us"
    got = lines.judge(text, r)
    assert got[6] and "Home" not in got[8] and got[7] == got[0] - 5


def test_lines_edge(edge, none):
    got = rows(lines.clean(edge))
    assert len(got) == len(EDGE) and rows(lines.clean(none)) == []
    assert {r["doc_id"]: r["kept"] for r in got}[2] is False


# ---------------------------------------------------------------- 4 decontamination


def norm(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def contaminated(text, items, window=13):
    w, hit, found = norm(text), set(), set()
    for i, t in items:
        iw = norm(t)
        k = min(window, len(iw))
        wins = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} if iw else set()
        for j in range(len(w) - k + 1):
            if wins and tuple(w[j : j + k]) in wins:
                hit |= set(range(j, j + k))
                found |= {str(i)} - {"None"}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("chunk", [2_000_000, 40])
def test_decontamination(spark, chunk):
    rng = random.Random(7)
    vocab = ["aa", "bb", "cc", "dd", "Ee", "f1", "ü"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 12, 13, 14, 30])))) for i in range(14)] + [(90, None), (91, "..."), (92, "Aa, bb"), (93, "aa bb")]
    docs = []
    for i in range(100, 160):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            w = rng.choice(items[:14])[1].split()
            t += " X " + "; ".join(w[: rng.randint(1, len(w))]) + " tail" * rng.randint(0, 300)
        docs.append((i, t, "en", "s", 0))
    docs += EDGE
    items += [(None, items[2][1]), (None, "only an item without an id holds this")]
    docs.append((400, "x only an item without an id holds this x", "en", "s", 0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("x"))
    got = rows(decontam.contamination(table(spark, docs), bench, chunk_words=chunk))
    want = Counter((i, *contaminated(t, items)) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    kept = decontam.keep_clean(table(spark, docs), bench, chunk_words=chunk)
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter(i for i, t, *_ in docs if not contaminated(t, items)[4])
    text_of = {i: t for i, t, *_ in docs}
    for r in got:
        text = text_of[r["doc_id"]]
        assert len(norm(decontam.cut_spans(text, r["spans"]))) == r["n_words"] - r["n_hit"]


@pytest.mark.parametrize("chunk", [2_000_000, 40])
def test_decontamination_cuts_spans(spark, chunk):
    """A passage below the limit goes from its document; other texts and columns stay."""
    leak = " ".join(f"leak{i}" for i in range(60))
    head, tail = (" ".join(f"{c}{i}" for i in range(970)) for c in "ab")
    docs = table(spark, [(1, f"{head} {leak} {tail}", "en", "s", 7), (2, tail, "en", "s", 8), (3, leak, "en", "s", 9), (4, None, "en", "s", None)])
    bench = spark.createDataFrame([(1, leak), (2, leak)], "item_id long, text string")
    out = decontam.keep_clean(docs, bench, chunk_words=chunk, cut=True)
    assert out.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows(out)} == {1: (f"{head}  {tail}", 7), 2: (tail, 8), 4: (None, None)}
    assert not any(r["n_hit"] for r in rows(decontam.contamination(out, bench)))


def test_decontamination_empty(spark, edge, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in rows(decontam.contamination(edge, bench)))
    assert rows(decontam.contamination(none, bench.union(spark.createDataFrame([(1, "a b")], bench.schema)))) == []


# ---------------------------------------------------------------- 5 WARC


def test_loser_tree():
    rng = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Example.org:443/A?b=C#d") == "org,example)/a?b=c"
    assert warc.url_key(None) == "" and warc.url_key("http://x.org:81") == "org,x:81)/"


PAGES = [(i, f"http://h{i % 3}.org/p{i % 5}", h) for i, h in enumerate(["x" * 120, "x" * 120, "y" * 99, "y" * 99, None, "", "WARC/1.1\r\n\r\n" * 20, "é\r\n\r\n" * 60, "x" * 120, "é\r\n\r\n" * 60])]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([*PAGES, (None, None, "z" * 200)], "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("file", F.lit(2))
    pages = pages.repartition(3)
    got = {r["page_id"]: r for r in rows(warc.archived(pages))}
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        rep = first.setdefault(b, i) if len(b) >= 100 else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if rep == i else ("revisit", rep))
    assert got[None]["record_type"] == "response" and len(got) == len(PAGES) + 1
    assert rows(warc.archived(pages.limit(0))) == []


def test_warc_index_is_ordered(spark):
    rng = random.Random(4)
    pages = spark.createDataFrame([(i, f"http://h{rng.randrange(5)}.org/{rng.randrange(9)}", "t" * i) for i in range(200)], "page_id long, url string, html string").repartition(5)
    folder = common.scratch(spark, "t")
    runs = warc.write_archives(pages, folder, F.col("page_id") * -1, run_rows=7, file_bytes=500)
    assert runs.select("run").distinct().count() > 5 and runs.select("file").distinct().count() > 5
    index = warc.merge_index(runs, 30)
    merged = sorted(rows(index), key=lambda r: r["position"])
    assert [r["position"] for r in merged] == list(range(200))
    order = [(r["url_key"], r["at"], r["page_id"]) for r in merged]
    assert order == sorted(order)
    seen = defaultdict(list)
    for r in merged:
        assert (r["nth"], r["previous_id"]) == (len(seen[r["url_key"]]) + 1, seen[r["url_key"]][-1] if seen[r["url_key"]] else None)
        seen[r["url_key"]].append(r["page_id"])
    got = rows(warc.read_archives(index, folder))
    assert sum(r["payload_bytes"] for r in got) == sum(range(200))
    assert {r["page_id"]: r["position"] for r in got} == {r["page_id"]: r["position"] for r in merged}


def test_warc_history_of_one_url_spans_tasks(spark):
    """One URL holds almost all captures, over many slices; without the merge their numbers would begin anew in each."""
    pages = spark.createDataFrame([(i, "http://a.org/" if i % 50 else f"http://{'ab'[i % 100 > 0]}{i}.org", None) for i in range(300)] + [(None, "http://a.org/", None)], "page_id long, url string, html string").repartition(4)
    index = warc.merge_index(warc.write_archives(pages, common.scratch(spark, "t"), F.coalesce("page_id", F.lit(-5)), run_rows=20), 10)
    one = sorted((r for r in rows(index) if r["url_key"] == "org,a)/"), key=lambda r: r["position"])
    assert [r["nth"] for r in one] == list(range(1, 296)) and [r["previous_id"] for r in one][1:] == [r["page_id"] for r in one][:-1] and one[0]["page_id"] is None


def test_warc_ends_of_slices():
    ends = [(0, 3, "a", "b", 2, 7), (1, 2, "b", "b", 2, 9), (3, 4, "b", "c", 1, 1), (4, 1, "d", "d", 1, 2)]
    assert warc.carried(ends) == [(0, 0, "a", 0, None), (1, 3, "b", 2, 7), (3, 5, "b", 4, 9), (4, 9, "d", 0, None)]


def test_warc_takes_any_id_and_time(spark):
    ids = [0, -1, 10**12, 2**62, -(2**63), 2**63 - 1]
    pages = spark.createDataFrame([(i, "http://x.org/", "z" * 150) for i in ids], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in rows(warc.archived(pages))}
    assert set(got) == set(ids) and {r["refers_to"] for r in got.values()} == {None, -(2**63)}
    assert warc.warc_date(-(2**63)) == "0001-01-01T00:00:00Z" and warc.warc_date(2**63 - 1) == "9999-12-31T23:59:59Z" and warc.warc_date(0) == "1970-01-01T00:00:00Z"


def test_warc_many_repeated_payloads(spark):
    """The joined way, beyond what may be broadcast, gives what the broadcast way gives."""
    pages = spark.createDataFrame([*PAGES, *PAGES, (None, None, "x" * 120)], "page_id long, url string, html string").repartition(3)
    kinds = []
    for limit in (0, 200_000):
        runs = warc.write_archives(pages, common.scratch(spark, "t"), F.lit(0), broadcast_rows=limit)
        kinds.append(Counter((r["page_id"], r["record_type"]) for r in rows(runs)))
    assert kinds[0] == kinds[1] and kinds[0][None, "revisit"] == 1


# ---------------------------------------------------------------- 6 Katz


@pytest.mark.parametrize(("order", "hot"), [(2, 1e-3), (2, 0.02), (3, 1e-3), (3, 0.02), (4, 0.01)])
def test_katz_against_brute_force(spark, order, hot):
    texts = [(i + 100, t, None, None, None) for i, t in enumerate(corpus(6, 90, 25))] + [r for r in EDGE if r[0] != 5 and r[0] is not None]
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    got = rows(katz.score(table(spark, texts).repartition(3), common.fold("doc_id", 10) != 0, order, block_words=300, bucket_entries=500, hot_share=hot))
    toks = [(i, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]) for i, t, *_ in texts]
    after = [defaultdict(Counter) for _ in range(order)]  # by the history's length
    for i, t in toks:
        for k in range(len(t) if train(i) else 0):
            for n in range(order):
                if n <= k + 1:
                    after[n][tuple(["<s>", *t][k + 1 - n : k + 1])][t[k]] += 1
    uni = after[0][()]
    total, types = sum(uni.values()), len(uni)
    of = lambda c: [0] + [c[r] for r in range(1, katz.K + 2)]
    p_uni = katz.Unigram.of(total, types, of(Counter(uni.values())))
    d = [katz.discounts(of(Counter(c for m in level.values() for c in m.values()))) for level in after]
    disc = lambda n, c: float(d[n][c]) if c <= katz.K else 1.0
    memo = {}

    def p(h, w):
        """Katz by definition, recursively."""
        n = len(h)
        if not n:
            return float(p_uni(np.array([uni.get(w, 0)]))[0])
        m = after[n].get(h)
        if not m:
            return p(h[1:], w)
        if h not in memo:
            base = sum(m.values()) + all(c > katz.K for c in m.values())
            memo[h] = base, (1 - sum(disc(n, c) * c for c in m.values()) / base) / (1 - sum(p(h[1:], x) for x in m))
        base, alpha = memo[h]
        return disc(n, m[w]) * m[w] / base if w in m else alpha * p(h[1:], w)

    for n in range(order):
        for h in list(after[n])[:20]:
            assert sum(p(h, w) for w in uni) + p(h, b"not a word") == pytest.approx(1)
    want = sorted((i, len(t), sum(w in uni for w in t), total, round(sum(np.log10((uni.get(w, 0) + 0.1) / (total + 0.1 * (types + 1))) for w in t), 6), round(sum(np.log10(p(tuple(["<s>", *t][max(0, k + 2 - order) : k + 1]), w)) for k, w in enumerate(t)), 6)) for i, t in toks)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_katz_edge(spark, edge, none):
    assert len(rows(katz.score(edge, F.lit(True)))) == len(EDGE)
    got = rows(katz.score(edge, F.lit(False)))
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in got)
    assert rows(katz.score(none, F.lit(True))) == []


def test_katz_blocks(tmp_path):
    texts = ["b a b", None, "c  a a d", "", "d e b a"]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "train": i != 2} for i, t in enumerate(texts)])
    folder, hashes = (f"file://{tmp_path}/{x}" for x in ("texts", "hashes"))
    made = [r for b in katz._blocks(folder, hashes, 8)(iter([batch])) for r in b.to_pylist()]
    assert [r["tokens"] for r in made] == [10, 6]
    words = []
    for r in made:
        block = katz.Block(katz._fetch(folder)(r["block"]))
        h = np.cumsum(katz.unpack(katz._fetch(hashes)(r["block"]))[0])
        assert (np.diff(h) > 0).all() and len(h) == len(block.order) == block.types - 1
        of = dict(zip(block.order.tolist(), h.tolist(), strict=True))
        words += [of[t] for t in block.tok.tolist()]
    want = [w for t in texts for w in [*katz.utf8(t).split(), b" end"]]
    assert words == [xxhash.xxh64_intdigest(w, 7) for w in want]


@pytest.mark.parametrize("size", [1, 5, 1 << 20, 1 << 44, 1 << 62])
def test_katz_distinct(size):
    for n in (0, 1, 2, 1000):
        code = np.random.default_rng(n).integers(0, size, n)
        for got, want in zip(katz._distinct(code, size), np.unique(code, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "u8", "i8", "f8"])
def test_katz_packed_types(kind):
    for n in (0, 1, 1000):
        a = np.random.default_rng(n).integers(0, 200, n).astype(kind)
        (b,) = katz.unpack(katz.pack(a))
        assert b.dtype == a.dtype and b.tolist() == a.tolist()


def test_katz_packing():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 40, 500, dtype=np.uint64), rng.integers(0, 9, 0, dtype=np.uint32)
    x, y = katz.unpack(katz.pack(a, b))
    assert (x == a).all() and y.dtype == b.dtype and not len(y)
    runs = np.array([3, 1, 4], dtype=np.uint32)
    v = np.array([5, 7, 9, 2, 1, 2, 3, 50], dtype=np.uint64)
    assert (katz.unsteps(katz.steps(v, np.array([0, 3, 4])), runs) == v).all()


# ---------------------------------------------------------------- 7 SimHash


def fp_of(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, ids, distance=4):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    items = list(zip(fps, ids))
    for k, (f, i) in enumerate(items):
        for g, j in items[:k]:
            if (f ^ g).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, none):
    texts = [(i + 100, t, None, None, None) for i, t in enumerate(corpus(8, 150, 300))] + [r for r in EDGE]
    got = rows(simhash.near_duplicates(table(spark, texts).repartition(4)))
    ids = sorted({i for i, *_ in texts if i is not None})
    text_of = {i: t for i, t, *_ in texts}
    fps = {i: fp_of(text_of[i]) for i in ids}
    want = groups([fps[i] for i in ids], ids)
    assert len(got) == len(texts)
    assert all(r["fp"] % (1 << 64) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = rows(simhash.keep_one(table(spark, texts)))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values())) and sum(r["doc_id"] is None for r in kept) == 1
    assert rows(simhash.near_duplicates(none)) == []


def test_simhash_long_text_in_steps():
    words = [f"w{i % 977}" for i in range(70_000)]
    assert simhash.fingerprint(" ".join(words)) == fp_of(" ".join(words))


@pytest.mark.parametrize("hot", [10, 20_000])
def test_link_forest(spark, hot):
    """Clusters and chains of fingerprints, with crowded keys cut into cells."""
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(80)]
    for b in list(fps[:15]):
        x = b
        for _ in range(6):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    centre = fps[0]
    fps += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)]
    fps = sorted(set(fps))
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    named = {r["node"]: r["component"] for r in graph.components(simhash.link_forest(reps, hot=hot)).collect()}
    assert {i: named.get(i, i) for i in range(len(fps))} == groups(fps, list(range(len(fps))))


@pytest.mark.parametrize("hot", [20, 60, 20_000])
def test_link_forest_with_crowded_neighbours(spark, monkeypatch, hot):
    """A key with few rows of its own that very many rows of a near key probe: no task's key holds them all, no link is lost."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 32))
    near = [base ^ (1 << b) for b in (3, 9, 20)]
    high = lambda: int(rng.integers(0, 1 << 32)) << 32
    fps = sorted({base | high() for _ in range(300)} | {near[int(rng.integers(0, 3))] | high() for _ in range(40)})
    for x in fps[:120]:
        for _ in range(int(rng.integers(1, 5))):
            x ^= 1 << int(rng.integers(0, 64))
        fps.append(x)
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    reps = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    monkeypatch.setattr(simhash, "plan", lambda *a: [(list(range(32)), 1), (list(range(32, 48)), 1), (list(range(48, 64)), 0)])
    up = simhash.Forest(len(fps))
    up.add(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.DISTANCE))
    named = {r["node"]: r["component"] for r in graph.components(simhash.link_forest(reps, hot=hot)).collect()}
    assert [named.get(i, i) for i in range(len(fps))] == up.label.tolist()

    def seen(distance):
        return lambda batches: (pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]) for b in batches)

    monkeypatch.setattr(simhash, "_links", seen)
    most = simhash.link_forest(reps, hot=hot).groupBy("a").count().agg(F.max("count")).first()[0]
    assert most <= 3 * hot and (hot < 100 or most > 300)


def test_thresholds_cover_the_distance():
    options = simhash.groupings(np.eye(64))
    near = [[simhash.independent(np.full(64, 0.5), g) for g in groups] for groups in options]
    for n in (10, 10**4, 10**6, 10**9):
        plan = simhash.allot(n, options, near)
        assert sum(e + 1 for _, e in plan) == simhash.DISTANCE + 1
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))


def test_unequal_thresholds_on_skewed_bits(spark):
    """40 of 64 bits follow four hidden ones: partitions of those tell little and get less, the others more; no link is lost."""
    rng = np.random.default_rng(11)
    n = 30_000
    bits = rng.integers(0, 2, (n, 64), dtype=np.uint64)
    for k in range(4):
        bits[:, 10 * k : 10 * k + 10] = bits[:, [10 * k]] ^ (rng.random((n, 10)) < 0.02)
    fps = (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    fps = np.unique(np.r_[fps, fps[:300] ^ np.uint64(1 << 45 | 1 << 50 | 1 << 63)])
    reps = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    plan = simhash.plan(reps, len(fps))
    assert len({e for _, e in plan}) > 1 and sum(e + 1 for _, e in plan) == simhash.DISTANCE + 1
    up = simhash.Forest(len(fps))
    for k in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[k : k + 500, None] ^ fps[None, :]) <= simhash.DISTANCE)
        up.add(a + k, b)
    named = {r["node"]: r["component"] for r in graph.components(simhash.link_forest(reps)).collect()}
    assert [named.get(i, i) for i in range(len(fps))] == up.label.tolist()


def test_candidates_are_estimated_from_pairs(spark):
    """Bits that always go together differ together: pair distances tell, single bits do not."""
    rng = random.Random(13)
    fps = sorted({sum((0xFF * rng.randrange(2)) << 8 * k for k in range(8)) for _ in range(400)})
    options = [[list(range(16)), list(range(16, 64))]]
    got = list(simhash._near_counts(np.array(fps[:50], dtype=np.uint64), options, 4)([pa.RecordBatch.from_arrays([pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["fp"])]))[0].to_pylist()
    want = Counter()
    for f in fps:
        for g in fps[:50]:
            for j, bits in enumerate(options[0]):
                d = sum((f ^ g) >> b & 1 for b in bits)
                if f != g and d <= 4:
                    want[0, j, d] += 1
    assert {(r["k"], r["j"], r["e"]): r["n"] for r in got if r["n"]} == want


def test_rows_that_share_an_id(spark):
    """Different texts under one id are two documents; equal ones are one."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black brown")
    docs = table(spark, [(1, a, "x", "s", 0), (1, b, "x", "s", 1), (1, a, "y", "s", 2), (2, b, "x", "s", 3), (3, c, "x", "s", 4), (None, c, "x", "s", 5), (None, None, None, None, None)])
    kept = sorted(((r["doc_id"], r["text"]) for r in rows(simhash.keep_one(docs))), key=repr)
    assert kept == sorted([(1, a), (1, b), (3, c), (None, c), (None, None)], key=repr) and simhash.keep_one(docs).columns == docs.columns


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200)] + [(300, 300 + i) for i in range(50)]
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in up.items() if k != 200}


# ---------------------------------------------------------------- 8 quality


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, acc = 20_000, np.array([[0.9, 0.8, 0.7, 0.85], [0.95, 0.9, 0.8, 0.9]])
    y = (rng.random(n) < 0.8).astype(int)
    votes = np.where(rng.random((n, 4)) < acc[y], y[:, None], 1 - y[:, None])
    votes[rng.random((n, 4)) < 0.2] = quality.NONE
    pat, counts = np.unique(votes, axis=0, return_counts=True)
    post, found = quality.expectation_maximisation(pat, counts.astype(float))
    assert np.abs(found - acc).max() < 0.06
    lookup = {tuple(p): q for p, q in zip(pat, post)}
    assert np.mean([(lookup[tuple(v)] > 0.5) == t for v, t in zip(votes, y)]) > 0.93


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, d).join(common.table(spark, d, "labels"), "doc_id").select("kept", "quality").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.93 and got.kept[got.quality == 1].mean() > 0.98


@pytest.mark.parametrize("limit", [300_000, 100_000])
def test_quality_repeats_far_apart(limit):
    """Word pairs count over the whole text, also where the memo is cleared in between."""
    shapes = quality.Shapes(limit)
    passage = [f"w{i}" for i in range(100_000)]
    f, _ = quality.facts(" ".join(passage * 4), shapes)
    assert abs(f.repeat_share - (1 - 100_000 / 399_999)) < 1e-9 and quality.LABELLERS["repetition"](f) == quality.BAD
    once = [f"w{i}" for i in range(250_000)]
    assert quality.facts(" ".join(once), shapes)[0].repeat_share == 0
    rng = random.Random(5)
    words = [rng.choice(passage[:300]) for _ in range(3_000)]
    pairs = list(zip(words, words[1:]))
    for step in (1, 2, 7, 1_000, 2_999, 3_000):
        assert abs(quality.facts(" ".join(words), shapes, step)[0].repeat_share - (1 - len(set(pairs)) / len(pairs))) < 1e-12


def naive_facts(text):
    """The labellers' view, word by word."""
    w = (text or "").split()
    if not w:
        return quality.Facts(*[0] * 9)
    n, pairs, seen_lines = len(w), list(zip(w, w[1:])), [x for x in text.split("\n") if x.strip()]
    share = lambda test: sum(map(test, w)) / n
    return quality.Facts(
        n, share(lambda x: any(c in "#*$%&|<>" for c in x)), share(lambda x: x in quality.BARS), share(lambda x: len(x) > 1 and x.isupper()),
        share(lambda x: len(x) > 1 and not x[-1].isalnum() and x[-1] == x[-2]), sum(map(len, w)) / n, 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        1 - len(set(seen_lines)) / len(seen_lines) if seen_lines else 0.0, share(lambda x: x[-1] in ".!?"),
    )


def test_quality_query_against_brute_force(spark, tmp_path):
    """The whole query: facts and features text by text, EM over single texts, and the scorer's sum."""
    rng = random.Random(17)
    texts = corpus(16, 80, 150) + [" ".join(w.upper() + "!!" for w in t.split()) for t in corpus(18, 12)] + [" | ".join(t.split()) for t in corpus(19, 12)] + [". ".join(t.split()) + "." for t in corpus(20, 12)]
    docs = [(i, t + rng.choice(["", ".", "\n" + t]), "en", "s", 0) for i, t in enumerate(texts)] + [(i + 1000, *r) for i, *r in EDGE if i not in (5, None)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op8_quality(spark, str(tmp_path)))
    facts = [naive_facts(t) for _, t, *_ in docs]
    codes = [quality.votes(f) for f in facts]
    per_text = np.array([[c // 3 ** (8 - i) % 3 for i in range(9)] for c in codes])
    post, _ = quality.expectation_maximisation(per_text, np.ones(len(docs)))  # one pattern for each text
    slot = lambda x: quality.xxhash.xxh32_intdigest(x) % 2048
    x = np.zeros((len(docs), quality.DIM))
    for i, (_, t, *_) in enumerate(docs):
        for w in (t or "").split():
            shape = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w)
            shape = "".join(c if k == 0 or shape[k - 1] != c else "+" if k == 1 or shape[k - 2] != c else "" for k, c in enumerate(shape))
            x[i, slot("s" + shape)] += 1
            x[i, 2048 + slot("p" + w.strip(quality.MARKS)[:3].lower())] += 1
    seen = quality.examined(common.table(spark, str(tmp_path), "documents"))
    weights = quality.learn(seen).weights
    want = {}
    for (i, t, *_), f, c, p in zip(docs, facts, x, post):
        z = quality.features(f, c) @ weights
        want[i] = (f.words, p, 1 / (1 + np.exp(-z)))
    assert len(got) == len(docs)
    for r in got:
        n, p, s = want[r["doc_id"]]
        assert r["n_words"] == n and r["posterior"] == pytest.approx(p, abs=1e-6) and r["score"] == pytest.approx(s, abs=1e-6) and r["kept"] == (r["score"] >= 0.5)


def test_quality_does_not_depend_on_partitions(spark):
    texts = [(i, t, None, None, None) for i, t in enumerate(corpus(22, 90, 60))]
    models = [quality.learn(quality.examined(table(spark, r).repartition(n)), sample=40) for r, n in ((texts, 1), (texts[::-1], 7))]
    assert (models[0].weights == models[1].weights).all() and models[0].posterior == models[1].posterior


def test_quality_edge(edge, none):
    seen = quality.examined(edge)
    m = quality.learn(seen)
    assert len(rows(quality.score(seen, m))) == len(EDGE) and rows(quality.classify(none)) == []
    assert all(0 <= r["score"] <= 1 for r in rows(quality.score(seen, m)))


# ---------------------------------------------------------------- 9 mixing


def test_sainte_lague_is_highest_quotients():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 6)
        votes, most = [rng.choice([0, 1, 3.5, 10, 10, 77]) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        seats = rng.randint(0, 25)
        got, want = mixing.sainte_lague(votes, seats, most), [0] * n
        for _ in range(seats):
            q = [(votes[i] / (2 * want[i] + 1), -i) for i in range(n) if want[i] < most[i] and votes[i] > 0]
            if not q:
                break
            want[-max(q)[1]] += 1
        assert got == want, (votes, seats, most)


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 1000], [5, 2], 1515) == pytest.approx([20, 1495]) and mixing.targets([0, 5], [5, 2], 7.5) == [0, 7.5]


def test_mixing(spark, none):
    texts = [(i + 100, t, None, s, None) for i, (t, s) in enumerate(zip(corpus(2, 200), [*"aaab" * 40, *"cd" * 20]))] + EDGE
    got = rows(mixing.mix(table(spark, texts), block_words=10, shard_words=700))
    again = rows(mixing.mix(table(spark, list(reversed(texts))).repartition(5), block_words=10, shard_words=700))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(texts)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] is not None
    names = sorted(s for s in sizes if s is not None) + [None]
    want = mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    for s, w in zip(names, want):
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= max(40, 0.03 * w)
    assert rows(mixing.mix(none)) == []
    mixed = mixing.apply_mix(table(spark, texts), block_words=10)
    assert mixed.columns == none.columns and max(Counter(r["doc_id"] for r in rows(mixed) if r["doc_id"] not in (1,)).values()) <= 2


def test_mixing_against_brute_force(spark):
    """taken, word by word: the words of each shard laid out in seeded order, the blocks chosen one by one."""
    texts = [(i + 100, t, None, s, None) for i, (t, s) in enumerate(zip(corpus(2, 150), [*"aaab" * 30, *"cd" * 15]))] + EDGE
    df = table(spark, texts)
    block, got = 10, rows(mixing.mix(df, block_words=10, shard_words=700, shard_rows=20))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    # the seeded hashes come from the engine, everything else is counted here
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(42))).otherwise(F.xxhash64("doc_id", F.lit(42)))
    hashed = [r.asDict() for r in df.select("doc_id", "text", "source", own.alias("dealt")).withColumn("h", F.xxhash64(F.lit(43), "dealt")).collect()]
    per = defaultdict(list)
    for r in hashed:
        per[r["source"]].append(r)
    names = sorted(k for k in per if k is not None) + [None]
    sizes = [sum(size(r["text"]) for r in per[k]) for k in names]
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    shards = {}
    for k, s in zip(names, sizes):
        n = max(1, -(-s // 700), -(-len(per[k]) // 20))
        shards[k] = [[r for r in per[k] if r["dealt"] % n == j] for j in range(n)]
        shards[k] = [x for x in shards[k] if x]
    total = lambda x: sum(size(r["text"]) for r in x)
    n_blocks = {k: [-(-total(x) // block) for x in v] for k, v in shards.items()}
    quota = mixing.sainte_lague(goal, round(sum(goal) / block), [2 * sum(n_blocks[k]) for k in names])
    want = Counter()
    for k, q in zip(names, quota):
        live = [(x, b) for x, b in zip(shards[k], n_blocks[k]) if b]
        for (x, b), seats in zip(live, mixing.sainte_lague([total(x) for x, _ in live], q, [2 * b for _, b in live])):
            number = next(j for j in range(10**6) if x[0]["dealt"] % max(1, -(-total(per[k]) // 700), -(-len(per[k]) // 20)) == j)
            turn = spark.range(1).select(F.pmod(F.xxhash64(F.lit(44), F.lit(k).cast("string"), F.lit(number).cast("long")), F.lit(b)).alias("r")).first()["r"]
            more = seats % b
            often = [seats // b + (((i + turn + 1) * more) // b > ((i + turn) * more) // b) for i in range(b)]
            assert sum(often) == seats
            at = 0
            for r in sorted(x, key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"] or 0, size(r["text"]))):
                want[r["doc_id"], size(r["text"])] += sum(often[w // block] for w in range(at, at + size(r["text"])))
                at += size(r["text"])
    have = Counter()
    for r in got:
        have[r["doc_id"], r["size"]] += r["taken"]
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in want.items() if v}


def test_mixing_keeps_any_columns(spark, none):
    """Columns that are called as the operator's own come through; so do rows without an id."""
    docs = table(spark, [(1, "a b c", "en", "s", 1), (None, "d e f", "en", "s", 2), (2, "", "en", "t", 3)])
    for name in ("m_copy", "m_times", "times", "copy", "id", "row", "c0", "taken", "a.b"):
        df = docs.withColumn(name, F.lit("kept"))
        out = mixing.apply_mix(df)
        assert out.columns == df.columns and {r[name] for r in out.collect()} <= {"kept"}
    assert mixing.apply_mix(none).collect() == []


def test_mixing_draws_row_by_row(spark):
    """Rows without ids, and rows of one id, are mixed as rows with ids are."""
    rng = random.Random(8)
    make = lambda ids: table(spark, [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(5, 40))), "en", "s", 1) for i in ids])
    for df in (make([None] * 500), make(range(500)), make([k // 50 for k in range(500)]), table(spark, [(7, "one text of five words", "en", "s", 1)] * 400)):
        words = sum(len(r["text"].split()) for r in rows(df))
        out = rows(mixing.apply_mix(df))
        assert abs(sum(len(r["text"].split()) for r in out) / words - 1.5) < 0.06
        times, had = Counter((r["doc_id"], r["text"]) for r in out), Counter((r["doc_id"], r["text"]) for r in rows(df))
        assert all(times[k] <= 2 * n for k, n in had.items()) and set(times) <= set(had)
        again = rows(mixing.apply_mix(df.repartition(3)))
        assert Counter((r["doc_id"], r["text"]) for r in again) == times


# ---------------------------------------------------------------- 10 sharding


def test_sharding(spark, none):
    texts = [(i + 100, t, None, None, None) for i, t in enumerate(corpus(4, 600))] + [(1000 + i, "same text again", None, None, None) for i in range(400)] + [r for r in EDGE if r[0] != 5]
    got = rows(sharding.shard(table(spark, texts).repartition(6), shards=7))
    assert len(got) == len(texts)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(7))
    sizes = Counter()
    text_of = {i: t for i, t, *_ in texts}
    for r in got:
        raw = (text_of[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.06 * sum(sizes.values()) / 7
    by_text = defaultdict(set)
    for r in got:
        by_text[text_of[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for t, v in by_text.items() if t != "same text again") and len(by_text["same text again"]) > 1
    assert rows(sharding.shard(none)) == []


def literal_packing(weights, shards, importance=(8.0, 1.0, 2.0)):
    """Heaviest first, each to the shard with the highest dot product, in plain Python."""
    even = [sum(w[d] for w in weights) / shards or 1.0 for d in range(3)]
    unit = [[x / e for x, e in zip(w, even)] for w in weights]
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(weights)
    for i in sorted(range(len(unit)), key=lambda i: (-max(unit[i]), i)):
        value = [sum(a * b * c for a, b, c in zip(importance, unit[i], room)) for room in left]
        out[i] = max(range(shards), key=lambda k: (round(value[k], 9), -k))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], unit[i])]
    return out


def test_sharding_against_literal_packing(spark):
    """Groups of equal texts so few and light that each is a bundle of its own: shards are those of the literal packing."""
    rng = random.Random(23)
    texts = [(i, "w" * rng.randint(1, 40) + f" {i // 2}", None, None, None) for i in range(60)]
    texts = [(i, texts[i // 2 * 2][1], *r) for i, _, *r in texts]
    got = {r["doc_id"]: r for r in rows(sharding.shard(table(spark, texts), shards=3, heavy_share=0.0001, cut_share=2.0))}
    by = defaultdict(list)
    for i, t, *_ in texts:
        by[t].append(i)
    units = {t: (len(ids) * (len(t) + 16), len(ids) * 2, len(ids)) for t, ids in by.items()}
    keys = spark.createDataFrame([(t,) for t in by], "t string").select("t", F.struct(F.xxhash64("t").alias("a"), F.hash("t").alias("b"), F.length("t").alias("n")).alias("g")).select("t", F.xxhash64("g", F.lit(0).cast("long")).alias("u")).collect()
    order = [r["t"] for r in sorted(keys, key=lambda r: r["u"])]  # ties in weight follow the units' numbers
    at = dict(zip(order, literal_packing([units[t] for t in order], 3)))
    assert {t: {got[i]["shard"] for i in ids} for t, ids in by.items()} == {t: {k} for t, k in at.items()}


def test_packing_against_literal_packing():
    rng = random.Random(24)
    for _ in range(40):
        w = [(rng.randint(1, 90), rng.randint(0, 9), rng.randint(1, 3)) for _ in range(rng.randint(0, 40))]
        n = rng.randint(1, 7)
        assert sharding.pack(np.array(w, dtype=float).reshape(-1, 3), n).tolist() == literal_packing(w, n)


def test_packing_prefers_room():
    at = sharding.pack(np.array([[10, 1, 1], [10, 1, 1], [5, 0.5, 1], [5, 0.5, 1]], dtype=float), 2)
    assert at[0] != at[1] and at[2] != at[3]


def test_arrow_batches_stay_small(spark):
    common.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512 and pa


def test_scratch_tables_can_be_cleaned(spark):
    import os

    path = common.scratch(spark, "t")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    common.clean(spark)
    assert not os.path.exists(local)


def test_scratch_of_a_stage_goes_but_for_its_result(spark):
    import os

    mark = common.scratch_mark()
    first, last = (common.written(spark.range(3), "t") for _ in range(2))
    paths = [p.removeprefix("file://") for p in common._SCRATCH[mark:]]
    common.clean(spark, mark, but_last=True)
    assert [os.path.exists(p) for p in paths] == [False, True] and last.count() == 3
    common.clean(spark, mark)
    assert not os.path.exists(paths[1])
