"""Operators on texts: language, SimHash, packing, pieces, toxicity, licences, chat, pages."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from eigenfold.llm import chat, html_extract, language, licenses, packing, pieces, simhash, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "a null key has a text"), (5, "Ünïcödé — “quotes” 中文 🎉\x00\x1c"), (6, "x" * 50_000), (7, "many words " * 5000), (8, "12345 !!! ...")]


def frame(spark, rows, extra=True):
    """(doc_id, text, lang, ...) with more columns whose names clash with results."""
    schema = "doc_id long, text string, lang string" + (", score string, fingerprint string, key string, lang_pred int, ids long" if extra else "")
    return spark.createDataFrame([(*r, *[None] * (3 - len(r)), *(["x", "y", "z", 1, 2] if extra else [])) for r in rows], schema)


def words(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


# --- language ------------------------------------------------------------------------------


def test_language_learns_and_predicts(spark):
    rng = random.Random(0)
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "éèçab"}
    rows = [(k, words(rng, kinds[l], 30), l) for k, l in enumerate(rng.choice(sorted(kinds)) for _ in range(300))]
    got = {r["doc_id"]: r for r in language.language_query(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(got[k]["held_out"] for k, _, _ in held)
    assert np.mean([got[k]["lang_pred"] == l for k, _, l in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_code_lengths_are_those_of_a_plain_model():
    """A dictionary of counts with escapes and exclusions gives the same bits."""
    texts = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"banana band ban"]}
    model = language.learn(texts)

    def plain(lang, text):
        pad = b"\n\n\n"
        data = pad + pad.join(texts[lang]) + pad
        grams = {n: {} for n in range(4)}
        for n in range(4):
            for i in range(len(data) - n):
                grams[n].setdefault(data[i : i + n], {}).setdefault(data[i + n], 0)
                grams[n][data[i : i + n]][data[i + n]] += 1

        @functools.cache
        def p(context, c):
            if context is None:
                return 1 / 256
            shorter = context[1:] if context else None
            seen = grams[len(context)].get(context)
            if not seen:
                return p(shorter, c)
            total, kinds = sum(seen.values()), len(seen)
            if c in seen:
                return seen[c] / (total + kinds)
            left = sum(p(shorter, x) for x in range(256) if x not in seen)
            return p(shorter, c) / left * kinds / (total + kinds)

        s = pad + text
        return -sum(np.log2(p(s[i - 3 : i], s[i])) for i in range(3, len(s)))

    for text in (b"abra", b"ban", b"zq!", b"a", b"ab"):
        data = np.frombuffer(text, np.uint8)
        got = model.code_lengths(data, np.array([0, len(data)]))[0]
        assert np.allclose(got, [plain("a", text), plain("b", text)], rtol=1e-4), text
    both = np.frombuffer(b"abraban", np.uint8)
    apart = model.code_lengths(both, np.array([0, 4, 4, 7]))
    assert np.allclose(apart, model.code_lengths(both, np.array([0, 4, 4, 7]), block=2), rtol=1e-5) and (apart[1] == 0).all()


def test_language_odd_rows(spark):
    model = language.learn({"a": [b"some words of one kind"], "b": ["ähnliche wörter".encode()]})
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(frame(spark, ODD), model).collect()]
    by = {k: (l, s) for k, l, s in got}
    assert len(got) == len(ODD) and by[1] == by[2] == by[3] == by[8] == ("und", 0.0) and by[None][0] in ("a", "b")
    kept = language.accepted(frame(spark, ODD), model)
    assert kept.columns == frame(spark, ODD).columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 8})
    empty = frame(spark, []).limit(0)
    assert language.language_query(empty).count() == 0 and language.train(empty) is None
    assert {r["lang_pred"] for r in language.identify(frame(spark, ODD), None).collect()} == {"und"}


def test_language_of_many_copies_is_learned(spark, monkeypatch):
    """Each language gives all its different texts, however often they occur."""
    rng = random.Random(9)
    few = {l: [words(rng, alphabet, 20) for _ in range(12)] for l, alphabet in (("aa", "abcde"), ("bb", "fghij"))}
    rows = [(k, t, l) for l, texts in few.items() for k, t in enumerate(texts)]
    docs = frame(spark, rows).where("lang = 'bb'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("copy").unionByName(frame(spark, rows).where("lang = 'aa'"))
    monkeypatch.setattr(language, "calibrated", lambda texts: texts)
    got = language.train(docs)
    assert {l: sorted(t) for l, t in got.items()} == {l: sorted(t.encode() for t in texts) for l, texts in few.items()}


def test_language_of_two_hundred_languages(spark):
    """Every language keeps its contexts, whatever the others have, and the model is no larger than its texts."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñ"
    kinds = {f"l{k:03}": [words(rng, rng.sample(letters, 9), 1) for _ in range(40)] for k in range(200)}
    rows = [(k, " ".join(rng.choices(kinds[l], k=60)), l) for k, l in enumerate(sorted(kinds) * 7)]
    docs = frame(spark, rows)
    model = language.train(docs, where=F.col("doc_id") < 1200)
    asked = [r for r in rows if r[0] >= 1200]
    lang, score, _ = language.predict_batch(model, pa.array([t for _, t, _ in asked]))
    assert len(model.languages) == 200 and np.mean([a == l for a, (_, _, l) in zip(lang, asked)]) > 0.99
    held = sum(x.nbytes for o in model.orders for x in vars(o).values())
    assert held < 64 * sum(len(t.encode()) for k, t, _ in rows if k < 1200)
    alone = language.learn({"l000": [t.encode() for k, t, l in rows if k < 1200 and l == "l000"]})
    data = np.frombuffer(asked[0][1].encode(), np.uint8)
    assert np.allclose(alone.code_lengths(data, np.array([0, len(data)]))[0, 0], model.code_lengths(data, np.array([0, len(data)]))[0, 0], rtol=1e-6)


def test_language_rejects_what_it_has_not_learned(spark):
    """Texts of another language go, those of a learned one stay, also with numbers and a key in them."""
    rng = random.Random(5)
    kinds = {"aa": [words(rng, "abcdeilnorst", 1) for _ in range(300)], "bb": [words(rng, "éèçaouixyzmn", 1) for _ in range(300)]}
    own = [(k, " ".join(rng.choices(kinds[l], k=60)), l) for k, l in enumerate(["aa", "bb"] * 60)]
    model = language.train(frame(spark, own[:100]))
    other = [(200 + k, words(rng, "ghjkpqvwfß", 40), "aa") for k in range(20)]
    keys = [(300 + k, f"{t} token {rng.getrandbits(128):032x} 4761598977407687 +1 (168) 555-5254", l) for k, t, l in own[100:]]
    short = [(400, kinds["aa"][0], "aa"), (401, "A.", "aa")]
    kept = {r["doc_id"] for r in language.accepted(frame(spark, own + other + keys + short), model).collect()}
    assert kept >= {r[0] for r in own + keys} and kept.isdisjoint({r[0] for r in other})
    assert len({400, 401} & kept) >= 1


# --- SimHash ---------------------------------------------------------------------------------


def slow_fingerprint(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    h = [xxhash.xxh64(b" ".join(w[i : i + words]), seed=42).intdigest() for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(keys, values, near=2):
    parent = {k: k for k in keys}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(list(zip(keys, values)), 2):
        if bin(x ^ y).count("1") <= near:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {k: top(k) for k in keys}


def test_fingerprint_matches_plain_one():
    rng = random.Random(1)
    for text in [None, "", " \t", "one", "One two", "a b c", "É é \x0b x\x1cy \xa0 z", words(rng, "abcé ", 400), "w " * 70_000]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(25):
        base = words(rng, "abcdefgh", 120).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz"
            rows.append((len(rows) + 10, " ".join(w)))
    rows += [(900, ""), (901, None), (902, "  ")]
    got = {r["doc_id"]: r for r in simhash.simhash_query(frame(spark, rows)).collect()}
    fp = {k: slow_fingerprint(t) for k, t in rows}
    assert all(int(got[k]["fingerprint"], 16) == fp[k] and len(got[k]["fingerprint"]) == 16 for k in fp)
    assert {k: got[k]["component_id"] for k in fp} == classes(list(fp), list(fp.values()))


def test_links_in_crowded_buckets(spark):
    """Many fingerprints that share most bits, and chains of steps of two bits, lose no link."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base}
    for _ in range(220):
        v = base
        for b in rng.sample(range(64), rng.randint(1, 5)):
            v ^= 1 << b
        values.add(v)
    chain = base
    for k in range(0, 60, 2):
        chain ^= 3 << k
        values.add(chain)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    unique = spark.createDataFrame([(v,) for v in signed], "fp long")
    from eigenfold.llm.common import components

    found = {r["node"]: r["component"] for r in components(simhash.links(unique, crowd=8)).collect()}
    want = classes(signed, [v & ((1 << 64) - 1) for v in signed])
    groups = lambda m: {frozenset(k for k in signed if m.get(k, k) == g) for g in set(m.get(k, k) for k in signed)}
    assert groups(found) == groups(want)


def test_simhash_thresholds():
    cost = [[0, 5, 50, 500], [0, 1, 3, 900], [0, 7, 8, 9]]
    best = min(sum(cost[k][t + 1] for k, t in enumerate(ts)) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 0)
    got = simhash.allocate(cost, 2, 3)
    assert sum(got) == 0 and sum(cost[k][t + 1] for k, t in enumerate(got)) == best
    sample = np.random.default_rng(0).integers(0, 1 << 62, 300).astype(np.uint64)
    groups = simhash.partition_bits(sample, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(sum(t) == 2 - len(g) + 1 for g, t in [simhash.plan(sample, 2, 300), simhash.plan(sample, 2, 10**9)])


def test_simhash_odd_rows(spark):
    got = simhash.simhash_query(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert (3, 1) in by and (4, 4) in by and any(k is None and c is None for k, c in by)
    kept = simhash.representatives(frame(spark, ODD))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == frame(spark, ODD).columns and sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 8] and ids.count(None) == 1
    assert simhash.simhash_query(frame(spark, []).limit(0)).count() == 0


def test_language_bounds(spark):
    rows = [(k, f"alpha beta gamma {k} " * 3, "aa") for k in range(30)] + [(100 + k, "rho sigma tau " * 40 + str(k), "bb") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train(docs, bytes_per_language=10).languages == ["aa", "bb"]  # at least one text each
    assert language.train(docs, bytes_in_all=1).languages == ["aa", "bb"]
    junk = spark.createDataFrame([(1, "alpha beta gamma", "x"), (2, "qzx" * 40 + "JKWVQZ" * 30, "x"), (3, None, "x"), (4, "12", "x"), (1, "alpha beta gamma", "x")], "doc_id long, text string, lang_pred string")
    assert [r["doc_id"] for r in language.accepted(junk, language.train(docs)).collect()] == [1, 1]
    assert language.accepted(junk, None).count() == 0 and language.accepted(junk.limit(0), language.train(docs)).count() == 0


# --- packing ------------------------------------------------------------------------------------


def test_word_ids_match_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, w, rng = Tokenizer.from_file(path), packing.WordIds(path, most=40), random.Random(4)
    alphabet = "aAéÉß 's't\x1c\x1d\x85\xa0 ́\n\t1２🎉中<|endoftext|>İΣς.!'_-"
    for _ in range(1500):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3)] + [None]
        for a, b in zip(texts, w.encode(texts)):
            assert b.tolist() == t.encode(a or "", add_special_tokens=False).ids, a


def check_packing(docs, pieces_found, capacity=2048, whole=True):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by, seqs = {}, {}
    for r in pieces_found:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    padding = total = 0
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert (r["offset"] == at or not whole) and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for k, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        total += at
    return padding / total


def test_packing_keeps_every_id(spark):
    rng = random.Random(5)
    docs = [(k, words(rng, "abcdefghéö", rng.choice((0, 1, 5, 300, 900)))) for k in range(60)] + [(98, None), (99, "")]
    assert check_packing(docs, packing.packed(frame(spark, docs).repartition(2)).collect()) < 0.1
    odd = [(k, t) for k, t in ODD if k is not None and k != 4]
    check_packing(odd, [r for r in packing.packed(frame(spark, ODD)).collect() if r["doc_id"] not in (None, 4)], whole=False)
    assert packing.packed(frame(spark, []).limit(0)).count() == 0


def test_harmonic_bins():
    assert packing.cuts(2048 * 2 + 1024 + 64 + 5) == [2048, 2048, 1024, 69] and packing.cuts(1) == [1]
    assert packing.cuts(2048 * 3) == [2048] * 3 and packing.cuts(680) == [680] and packing.cuts(1500) == [1024, 409, 67]
    for n in range(1, 5000, 7):
        found = packing.cuts(n)
        assert sum(found) == n and all(2048 // x * x >= 2048 * (1 - packing.WASTE) for x in found)
    bins = packing.Harmonic(100)
    done = [x for k in range(3) for x in bins.add((k, 0, 30))]
    assert [(x[-2], x[-1]) for x in done] == [(0, 0), (0, 30), (0, 60)]
    list(bins.add((9, 0, 45)))
    list(bins.add((8, 0, 30)))
    assert {(x[0], x[-2], x[-1]) for x in bins.rest()} == {(9, 1, 0), (8, 1, 45)}


# --- pieces --------------------------------------------------------------------------------------------


def test_pieces_are_lossless_and_reproducible(spark):
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ▁é中🎉\n\t  thing  x\x00İ") for _ in range(rng.randint(0, 40))) for _ in range(800)] + [" ", "  ", "▁", "a" * 3000, None, ""]
    seeds = pieces.row_seeds(list(range(len(texts))), 0)
    first = p.sample(texts, seeds)
    for t, ids in zip(texts, first):
        assert p.decode(ids) == (t or "").encode()
    again = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), most=10)
    assert all(np.array_equal(a, b) for a, b in zip(first[::-1], again.sample(texts[::-1], seeds[::-1])))
    got = pieces.encoded(frame(spark, ODD), seed=3).collect()
    assert len(got) == len(ODD)
    back = pieces.decoded(spark.createDataFrame(got)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((k or 0, t or "") for k, t in ODD)
    rows = pieces.pieces_query(frame(spark, ODD)).collect()
    assert all(r["lossless"] for r in rows) and pieces.pieces_query(frame(spark, []).limit(0)).count() == 0


def test_pieces_of_the_last_character_and_of_any_company():
    """The highest character is not mistaken for another, and a draw does not depend on the words met before."""
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(12)
    p = pieces.Pieces(path)
    texts = ["a\U0010ffffb", "\U0010ffff\u2581 \u2581\U0010ffff", "\u2581", " \u2581 "] + [words(rng, "theringas", 30) for _ in range(200)]
    seeds = pieces.row_seeds(list(range(len(texts))), 0)
    first = p.sample(texts, seeds)
    assert [p.decode(i).decode() for i in first] == texts
    for k in range(0, len(texts), 20):
        other = pieces.Pieces(path)
        other.sample([words(rng, "thoresin", 400)], seeds[:1])
        assert np.array_equal(other.sample(texts[k : k + 1], seeds[k : k + 1])[0], first[k])


def test_pieces_have_the_lattice_distribution():
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    voc = {m.id_to_piece(i): i for i in range(259, m.get_piece_size())}

    def paths(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in voc:
                for r in paths(s[k:]):
                    yield (voc[s[:k]], *r)

    every = list(paths("▁there"))
    weight = np.exp([-sum(p.cost[i] for i in x) for x in every])
    weight /= weight.sum()
    n = 20_000
    got = p.sample(["there"] * n, pieces.row_seeds(list(range(n)), 1))
    seen = {}
    for ids in got:
        seen[tuple(ids.tolist())] = seen.get(tuple(ids.tolist()), 0) + 1
    assert set(seen) <= set(every) and max(abs(seen.get(x, 0) / n - w) for x, w in zip(every, weight)) < 0.015


def test_language_takes_few_rows_at_a_time(spark, monkeypatch):
    """A large batch of texts is not worked on as a whole, and gives the same rows."""
    rng = random.Random(5)
    model = language.calibrated({k: [words(rng, alphabet, 20).encode() for _ in range(20)] for k, alphabet in (("aa", "abcdef"), ("bb", "uvwxyz"))})
    texts = [words(rng, rng.choice(("abcdef", "uvwxyz")), rng.randint(1, 20)) for _ in range(1500)] + ["", None, "12 !"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    docs = frame(spark, [(1, "a")])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *_: list(run(iter([batch]))))
    lang, score, _ = language.predict_batch(model, batch.column(1))
    got = language.identify(docs, model)
    assert max(b.num_rows for b in got) <= 512
    table = pa.Table.from_batches(got).to_pydict()
    assert table["doc_id"] == list(range(len(texts))) and table["lang_pred"] == lang and table["score"] == pytest.approx(score)
    kept = language.accepted(docs, model)
    assert max(b.num_rows for b in kept) <= 512 and {"aa", "bb"} == {lang[k] for b in kept for k in b.column(0).to_pylist()}


# --- toxicity -------------------------------------------------------------------------------------------------


def toxic_rows(rng, n):
    bad = ["blorpf", "kragnus", "vexlom"]
    rows, labels = [], []
    for k in range(n):
        w = words(rng, "abcdefghiklmnorst", rng.randint(20, 60)).split()
        y = rng.random() < 0.25
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, int(y)))
    return rows, labels


def test_toxicity_learns_and_sees_through_disguise(spark):
    rng = random.Random(7)
    rows, labels = toxic_rows(rng, 500)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_query(frame(spark, rows), marks).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all(got[k]["held_out"] for k, _ in held) and np.mean([got[k]["predicted"] == y for k, y in held]) > 0.97
    model = toxicity.train(frame(spark, rows), marks)
    for disguised in ("bl0rpf", "b l o r p f", "b.l.o.r.p.f", "vexxxxlom", "v3xl0m", "KR@GNUS!!", "kr-ag-nus", "BLORPF", "(vexlom)"):
        assert model.score(f"some text with {disguised} in it") > 0.9, disguised
    for clean in ("", None, "some text with nothing in it", "12:30 3.5% a b c d", "x" * 5000, "password=31acd0 AKIA7"):
        assert model.score(clean) < 0.3, clean
    kept = toxicity.accepted(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns and abs(kept.count() - sum(1 - y for _, y in labels)) <= 5


def test_toxicity_sees_through_letters_alone(spark):
    """Doubled letters, letters of another script and words of three spaced letters."""
    rng = random.Random(10)
    rows, labels = toxic_rows(rng, 500)
    rows = [(k, t.replace("blorpf", "zup")) for k, t in rows]
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for disguised in ("kraagnus", "vexllom", "vexlоm", "krаgnus", "z u p", "zuup", "ｋｒａｇｎｕｓ", "krágnüs", "vexlοm", "𝐯exlom", "v*xlom", "kr*gnus", "кragnus", "vexl０m"):
        assert model.score(f"some text with {disguised} in it") > 0.9, disguised
    for clean in ("some letters in a book", "x y z", "привет мир, сообщение", "élan naïve señor * star", "**** ****", "2 * 3 * 4", "καλημέρα κόσμε"):
        assert model.score(clean) < 0.3, clean


def plain_grams(counts):
    out = {}
    for word, n in counts.items():
        s = "#" + word + "#"
        for i, size in itertools.product(range(len(s)), range(1, 5)):
            if 1 < i + size <= len(s):
                out[s[i : i + size]] = out.get(s[i : i + size], 0) + n
    return out


def test_restore_is_the_best_path():
    """The beam search against all paths of the lattice."""
    model = toxicity.CharacterModel.of(plain_grams({"idiot": 5, "band": 3, "toad": 2}))

    def all_paths(raw):
        best = (float("inf"), None)
        options = [toxicity.channel(c, raw[i - 1] if i else "") for i, c in enumerate(raw)]
        for choice in itertools.product(*options):
            state, cost, out = "#", 0.0, ""
            for emitted, price in choice:
                cost += price
                if emitted == "#":
                    cost += model.cost(state[-3:], "#") if state != "#" else 0
                    state, out = "#", out + " "
                elif emitted:
                    cost += model.cost(state[-3:], emitted)
                    state, out = (state + emitted)[-3:], out + emitted
            cost += 0 if state == "#" else model.cost(state[-3:], "#")
            if cost < best[0]:
                best = (cost, out)
        return best[1].split()

    for raw in ("1d10t", "b@nd", "t0o0ad", "b a n d", "iddiot", "x-1", "b*nd", "tóad", "b**d"):
        assert toxicity.restore(raw, model) == all_paths(raw), raw


def test_character_model_counts_every_text(spark):
    rng = random.Random(8)
    texts = [words(rng, "abcdé.", 40) for _ in range(60)] + ["(Quoted) word, w0rd looong", "a" * 3, "quoted"]
    rows = [(k, t) for k, t in enumerate(texts)] + ODD
    cores = [token.strip(toxicity.EDGE) for _, t in rows for token in (t or "").lower().split()]
    plain = [c for c in cores if c.isalpha() and not any(len(list(g)) > 2 for _, g in itertools.groupby(c))]
    want = plain_grams({c: plain.count(c) for c in set(plain)})
    read = lambda m: {a + c: n for a, after in m.after.items() for c, n in after.items() if c}
    docs = frame(spark, rows).repartition(5)
    assert read(toxicity.letters_of(docs)) == want == read(toxicity.letters_of(docs, distinct=7))
    few = read(toxicity.letters_of(docs, most=50))
    assert 0 < len(few) <= 50 and few.items() <= want.items() and min(few.values()) > max(n for g, n in want.items() if g not in few)
    assert read(toxicity.letters_of(frame(spark, []).limit(0))) == {}


def test_character_model_has_no_cap(spark):
    """More strings than fit any fixed number of the size that there once was."""
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(0, 2499), i -> concat(char(97 + cast(id % 26 as int)), decode(unhex(hex(cast(19968 + (id * 2500 + i) % 20000 as int))), 'UTF-16BE'), decode(unhex(hex(cast(19968 + (id * 7919 + i * 31) % 20000 as int))), 'UTF-16BE'))))").alias("text"))
    words = {w for r in texts.collect() for w in r["text"].split()}
    model = toxicity.letters_of(texts)
    want = plain_grams(dict.fromkeys(words, 1))
    assert len(want) > 200_000 and sum(len(after) - 1 for after in model.after.values()) == len(want)


def test_toxicity_learns_and_scores_as_a_plain_model():
    rng = random.Random(13)
    rows, labels = toxic_rows(rng, 240)
    texts = [(t.replace("blorpf", rng.choice(("blorpf", "bl0rpf", "b l o r p f"))), y) for (_, t), (_, y) in zip(rows, labels)]
    counts = {}
    for t, _ in texts:
        for w in t.split():
            if w.isalpha():
                for g, n in plain_grams({w: 1}).items():
                    counts[g] = counts.get(g, 0) + n
    letters = toxicity.CharacterModel.of(counts)
    model = toxicity.learn(texts, letters, 0.2)

    def parts(text, spaced):
        found = set()
        for token in text.lower().split():
            for w in toxicity.words_of(token, letters):
                found |= {w} | {w[:n] + "-" for n in (4, 5, 6) if n < len(w)}
        for m in toxicity.SPACED.finditer(text.lower()) if spaced else ():
            for w in toxicity.restore(m[0], letters):
                found |= {w} | {w[:n] + "-" for n in (4, 5, 6) if n < len(w)}
        return found

    toxic = {toxicity.sketch(t): t for t, y in sorted(texts, reverse=True) if y}
    clean = [t for t, y in texts if not y]
    share = len(toxic) / (len(toxic) + len(clean))
    of = [parts(t, False) for t in toxic.values()], [parts(t, False) for t in clean]
    every = {f for p in of[0] for f in p}
    hits = {f: n for f in every if (n := sum(f in p for p in of[0])) >= 3}
    want = {}
    for f, n in hits.items():
        m = sum(f in p for p in of[1])
        p = n / (n + m)
        gain = n * np.log(p / share) + (m * np.log((1 - p) / (1 - share)) if m else 0)
        if p >= 0.95 and gain >= np.log(len(hits) + 1) + 5:
            want[f] = (n + 0.5) / (n + m + 1)
    assert want and model.weights == pytest.approx(want)
    missed = sum(not parts(t, True) & set(want) for t in toxic.values())
    assert model.base == pytest.approx(min(0.25, 0.2 * (missed + 0.5) / (len(toxic) + 1)))
    for t, _ in texts[:80] + [("", 0), ("b    l  o\tr p f", 1)]:
        left = 1 - model.base
        for f in parts(t, True) & set(want):
            left *= 1 - want[f]
        assert model.score(t) == pytest.approx(1 - left)


def test_toxicity_looks_closely_at_few_words(monkeypatch):
    """Plain words that begin like no learned feature are told apart together; the others are found as one by one."""
    letters = toxicity.CharacterModel.of(plain_grams({"blorpf": 5, "kragnus": 3, "zup": 2, "ooze": 1}))
    model = toxicity.ToxicityModel(letters, {"blorpf": 0.9, "blor-": 0.8, "kragnu-": 0.9, "zup": 0.7, "oo": 0.6, "aaaa-": 0.9, "gg": 0.9}, 0.1)
    rng = random.Random(21)
    odd = ["blorpf", "bloorpf!", "BLÓRPF", "(kragnusse)", "kragnu", "zzup", "zu", "zup+++", "oo", "o", "ooo", "aaaab", "aab", "ab", "g", "ggh", "!!!", "…", "zup…", "bl0rpf", "straße", "сообщение", "ｚｕｐ", "x" * 300, "漢字", "z\u0301up", "𝐳up"]
    odd += [rng.choice(("", "zup", "blor", "aaaa", "oo", "gg")) + "".join(rng.choice("zupobléо0.!a") for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    plain = sorted({"".join(rng.choice("cdefhijmnqstvwxyé") for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    one = {t: set(model.known(t.lower())) for t in odd + plain}
    assert sum(map(bool, one.values())) > 100 and not any(one[t] for t in plain)
    looked = []
    known = toxicity.ToxicityModel.known
    monkeypatch.setattr(toxicity.ToxicityModel, "known", lambda self, t: (looked.append(t), known(self, t))[1])
    for block in (7, toxicity.BLOCK):
        monkeypatch.setattr(toxicity, "BLOCK", block, raising=False)
        assert model.found([*odd, None, "", *plain]) == [*(one[t] for t in odd), set(), set(), *(one[t] for t in plain)]
        assert model.found([" ".join(plain), "zup " + " ".join(plain)]) == [set(), {"zup"}]
    looked.clear()
    model.found(plain)
    assert not looked


def test_spaced_words():
    found = lambda t: [m[0] for m in toxicity.SPACED.finditer(t)]
    assert found("an i    d    i \t o    t is") == ["i    d    i \t o    t"] and found("a b c") == ["a b c"] and found("a b cd") == [] and found("x y z word") == ["x y z"]


def test_toxicity_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_query(frame(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in got)
    marks = spark.createDataFrame([(1, 1), (4, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_query(frame(spark, ODD), marks).count() == len(ODD)
    assert toxicity.toxicity_query(frame(spark, []).limit(0), none).count() == 0


# --- licences ------------------------------------------------------------------------------------------------------


def plain_scan(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for p, l in licenses.PHRASES.items():
        k = p.split()
        own = [i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
        at += own
        labels |= {l} if own else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    rng = random.Random(8)
    lines = [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "CC BY cc-by, cc by",
        "the gnu general private license", "MIT", "Redistribution and use in source and binary forms, with or without modification", "apache\nlicense", "gnu general public license gnu general public license",
    ]
    rows = [(100 + k, words(rng, "abcdé", 20) + "\n" + "\n".join(rng.sample(lines, rng.randint(0, 3))) + "\n" + words(rng, "abcdé", 5)) for k in range(80)] + ODD
    got = licenses.license_query(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for k, t in rows:
        r = by[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        low = (t or "").lower()
        for line, label in ((lines[0], "gpl-notice"), (lines[1], "apache-2.0"), (lines[2], "mit-notice"), (lines[3], "cc-by-nc-4.0"), (lines[7], "bsd")):
            if line.lower() in low:
                assert label in r["labels"].split(","), (label, t)
        if lines[5] in low and "public" not in low:
            assert "gpl" not in r["labels"]
    assert licenses.license_query(frame(spark, []).limit(0)).count() == 0


def test_license_phrase_beside_rarer_template_words(spark):
    mit = "permission is hereby granted free of charge to everyone . documentation files associated obtaining person copy software any this"
    mpl = "subject to v 2 0 of something . this file is under the mozilla public license"
    got = {r["doc_id"]: r["labels"] for r in licenses.license_query(frame(spark, [(1, mit), (2, mpl)] + [(3 + k, "permission is hereby granted free of charge under the mozilla public license") for k in range(9)])).collect()}
    assert got[1] == "mit-notice" and got[2] == "mpl-2.0"


def plain_labels(text):
    """Labels of every template whose mandatory phrases stand in their places, tried at every place."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), set(filter(None, plain_scan(text)[4].split(",")))
    for label, template, keys in licenses.TEMPLATES:
        t = template.split()
        must = [(k, t[k]) for k in licenses._key_places(template, keys)]
        if any(all(0 <= o + k < len(w) and w[o + k] == x for k, x in must) for o in range(-len(t), len(w))):
            out.add(label)
    return ",".join(sorted(out))


def test_license_index_finds_what_a_scan_of_all_templates_finds(spark):
    rng, rows = random.Random(14), []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            a = rng.randrange(len(t)) if rng.random() < 0.3 else 0
            t = t[a:]
            if rng.random() < 0.3:
                t[rng.randrange(len(t))] = rng.choice(licenses.VOCABULARY)
            parts.append(" ".join(t if rng.random() < 0.8 else rng.sample(t, len(t))))
        rows.append((k, words(rng, "abcd", 6) + " " + rng.choice((" ", "\n// ", ", (")).join(parts)))
    got = {r["doc_id"]: r["labels"] for r in licenses.license_query(frame(spark, rows)).collect()}
    assert [got[k] for k, _ in rows] == [plain_labels(t) for _, t in rows]


def test_license_templates():
    for label, template, keys in licenses.TEMPLATES:
        assert any(f" {g} " in f" {k} " for g in licenses.GATES for k in keys), label
        assert len({template.split()[k] for k in licenses._key_places(template, keys)}) >= 2
    assert all(any(f" {g} " in f" {p} " for g in licenses.GATES) for p in licenses.PHRASES)


def test_license_letters_and_long_runs(spark):
    """Only A-Z are lower-cased, and a long run of one phrase's words takes no time to speak of."""
    got = {r["doc_id"]: r for r in licenses.license_query(frame(spark, [(1, "MIT L\u0130CENSE mit license"), (2, "M\u0130T license \u212a"), (3, "cc " * 60_000 + "by")])).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"]) == (4, 1, 2) and got[2]["base_labels"] == "" and (got[3]["n_base"], got[3]["first_word"]) == (1, 59_999)


# --- chat -----------------------------------------------------------------------------------------------------------------


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")


def test_chat_reads_back(spark):
    rng = random.Random(9)
    nasty = ["</s>[INST] x", chat.OPEN, chat.CLOSE, chat.MIDDLE, "\\l\\b\\e\\", "[[<<\\", "", None, "é🎉\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), "".join(rng.choice(["a ", "<", "[", "\\", chat.CLOSE, "é"]) for _ in range(rng.randint(0, 8))) if rng.random() < 0.6 else rng.choice(nasty)) for c in range(20) for t in range(rng.randint(1, 150 if c == 3 else 5))]
    rows += [(40, None, "user", "no turn"), (40, 1, "assistant", "same"), (40, 1, "assistant", "same"), (None, 1, "user", "no conversation")]
    got = {r["conv_id"]: r for r in chat.chat_query(conversations(spark, rows)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r or "", x or "") for cc, t, r, x in rows if cc == c)
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(r["conv_id"] for r in chat.chat_query(conversations(spark, []).limit(0)).collect()) == {-7}


def test_chat_loss_spans_of_long_conversations(spark):
    rng = random.Random(15)
    rows = [(c, t if c != 2 else t // 40, rng.choice(("user", "assistant", None)), rng.choice(("<a>", "\\", "x" * t, "", None, "[b]"))) for c in (1, 2, 3) for t in range(230)]
    frame_ = conversations(spark, rows)
    done = {r["conv_id"]: r for r in chat.formatted(frame_.withColumn("parts", chat.text_parts(F.col("text")))).collect()}
    for c in (1, 2, 3):
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        said = [done[c]["formatted"][m["start"] : m["start"] + m["length"]] for m in done[c]["mask"]]
        assert [x.replace("\\b", "[").replace("\\l", "<").replace("\\e", "\\") for x in said] == [x for _, r, x in own if r == "assistant"]


def test_chat_parts(spark):
    part = T.ArrayType(chat.PART)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", part)])
    rows = [(1, 0, "user", [("text", "look <", None), ("image", None, "a.png"), ("other", "t", None), ("audio", "no", "b.wav")]), (1, 1, "assistant", [("document", None, "c.pdf"), ("text", None, None)]), (2, 0, "user", None)]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, schema)).collect()}
    assert "look \\l<|image|>t<|audio|>" in got[1]["formatted"]
    assert [(x["type"], x["ref"]) for x in got[1]["refs"]] == [("image", "a.png"), ("audio", "b.wav"), ("document", "c.pdf")]
    assert got[1]["tokens"] == sum(chat.EXPANDED.values()) and got[2]["tokens"] == 0 and got[2]["refs"] == []
    start, length = got[1]["mask"][0]
    assert got[1]["formatted"][start : start + length] == "<|document|>"


# --- pages --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    return html_extract.default_labeller()


def test_blocks():
    b = html_extract.blocks("<title>t</title><p>a &amp; b<b> c<p>d<script>x<p></script>e<br>f<ul><li>g<li><a href='/'>h</a></ul>&lt;i&gt;<!-- <p>j -->k<textarea>l</textarea>")
    assert [x.text for x in b] == ["a & b c", "d", "e", "f", "g", "h", "<i>k"]
    assert b[5].linked == 1 and "li" in b[5].path and b[0].path[-1] == "p"
    assert html_extract.blocks(None) == html_extract.blocks("") == [] and html_extract.blocks("<p") == []
    assert [x.text for x in html_extract.blocks('<div title="a>b" class="x y">q</div>plain < text')] == ["q", "plain < text"]
    assert len(html_extract.blocks("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_quotes_open_a_value_only_after_an_equals_sign():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts("<p title=don't>First para.</p><p>It's second</p><p>third</p>") == ["First para.", "It's second", "third"]
    assert texts("<p it's>a</p><p data-x = 'b > c' \"d>e</p>f") == ["a", "e", "f"]
    assert texts("<p class=\"open>a</p><p>b</p>") == ["a", "b"]  # a quote that never closes is none


def test_every_path_entry_counts():
    deep = html_extract.blocks("<footer class='a b c d e f g h zebra'>" + "<div>" * 60 + "x" + "</div>" * 60 + "</footer>")
    assert {"footer", ".zebra"} <= set(deep[0].path)
    row = html_extract.vectors(deep)[0]
    assert row[html_extract.PATH_AT["footer"]] == row[html_extract.PATH_AT[".zebra"]] == 1


def test_batches_label_as_a_plain_pass_over_each_page(labeller):
    """One page, one block and one gate after another, without batches, masks or shared inputs."""
    made = [html_extract.blocks_and_labels(p)[0] for p in html_extract.sample_pages(12, 77)] + [[]]
    w = {k: np.asarray(v, np.float64) for k, v in labeller.w.items()}
    u, sigmoid = html_extract.UNITS, lambda a: 1 / (1 + np.exp(-a))
    for page, got in zip(made, labeller.content(made)):
        e = [np.tanh(x.astype(float) @ w["in"] + w["inb"]) for x in html_extract.vectors(page)]
        sides = []
        for d in "fb":
            h, c, out = np.zeros(u), np.zeros(u), {}
            for t in range(len(e)) if d == "f" else reversed(range(len(e))):
                a = e[t] @ w[d + "x"] + w[d + "b"] + h @ w[d + "h"]
                c = sigmoid(a[u : 2 * u]) * c + sigmoid(a[:u]) * np.tanh(a[3 * u :])
                h = out[t] = sigmoid(a[2 * u : 3 * u]) * np.tanh(c)
            sides.append(out)
        scores = [np.concatenate([sides[0][t], sides[1][t], e[t]]) @ w["out"] + w["outb"] for t in range(len(e))]
        assert all(bool(g) == (s > 0) for g, s in zip(got, scores) if abs(s) > 1e-3) and len(got) == len(page)


def test_gradients():
    net, rng = html_extract.Labeller.fresh(1), np.random.default_rng(0)
    net.w = {k: np.asarray(v, np.float64) for k, v in net.w.items()}
    x, mask, y = rng.standard_normal((4, 2, html_extract.WIDTH)) * 0.1, np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float), rng.integers(0, 2, (4, 2)).astype(float)
    _, g = net.gradients(x.astype(np.float32), mask.astype(np.float32), y.astype(np.float32))
    for k in ("in", "fx", "fh", "bx", "bh", "fb", "out"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        h, old = 1e-3, net.w[k][at]
        net.w[k][at] = old + h
        up, _ = net.gradients(x.astype(np.float32), mask.astype(np.float32), y.astype(np.float32))
        net.w[k][at] = old - h
        down, _ = net.gradients(x.astype(np.float32), mask.astype(np.float32), y.astype(np.float32))
        net.w[k][at] = old
        assert abs((up - down) / (2 * h) - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4, k


def test_labeller_on_held_out_pages(labeller):
    made = [html_extract.blocks_and_labels(p) for p in html_extract.sample_pages(150, 12345)]
    got = labeller.content([b for b, _ in made])
    wrong = sum((np.array(y, bool) != g).sum() for (_, y), g in zip(made, got))
    assert wrong / sum(len(y) for _, y in made) < 0.02


def test_extraction(spark, labeller):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>home</a></li><li><a href='/b'>news</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A title of it</h1><p>First &amp; foremost,\n  a sentence that goes on for a while.</p><p>Another one follows here, as it should.</p></article><footer>&copy; example.com all rights reserved</footer></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p>", "x"), (4, "z", "<script>" + "x" * 100_000, "x")]
    got = html_extract.html_query(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "A title of it\nFirst & foremost, a sentence that goes on for a while.\nAnother one follows here, as it should."
    assert texts[2] == texts[3] == texts[None] == texts[4] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("unit", ["<div>x", "<font color=red>x<br>", "<button>x", "<select>x<p>", "<svg>y", "<li>x<ul>", "<td>x", "<b> <i> "])
def test_unclosed_pages_take_linear_time(unit):
    """Ten times the page takes about ten times as long, and never a stack's copy for each block."""
    import time
    import tracemalloc

    took = []
    for size in (20_000, 200_000):
        page = unit * (size // len(unit))
        began = time.perf_counter()
        html_extract.blocks(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.01)
    tracemalloc.start()
    found = html_extract.blocks(page)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    if unit == "<div>x":
        assert len(found) == 200_000 // 6 and found[99].path == ("div",) * 100


def test_turns_of_one_number_go_by_their_raw_text(spark):
    """Escapes and end marks do not change the order; the SQL says the same."""
    import duckdb

    from eigenfold.llm import chat

    texts = ["ab", "ab!", "<a", "A", "", "<|end|>", "ab<", None, "\U0001f600", "\uffff"]
    rows = [(1, k % 2 if k % 3 else None, "user", t) for k, t in enumerate(texts * 2)] + [(1, 0, "assistant", t) for t in texts]
    conversations = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    c = duckdb.connect()
    c.register("conversations", conversations.toPandas().astype({"turn": "Int64"}))
    want = c.sql(chat.CHAT_SQL).fetchdf()
    got = chat.chat_query(conversations).toPandas()
    both = got.merge(want, on="conv_id", suffixes=("", "_sql"))
    assert len(both) == 2 and all((both[x] == both[x + "_sql"]).all() for x in ("n_turns", "turns_sha256", "loss_sha256", "loss_chars", "formatted_chars"))
