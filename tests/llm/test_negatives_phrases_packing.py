"""Hard negatives, phrases and packing: odd inputs have defined results, and results equal brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import negatives, packing, phrases

PATH = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


# --- 11: hard negatives


def mined(rows):
    """Plain search of all pairs; rows: (vec_id, whole numbers, label), already without those that take no part."""
    known = {i: (v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in sorted(i for i in known if i % 100 == 0):
        scores = sorted(((-dot(known[a][0], v), b, lab == known[a][1]) for b, (v, lab) in known.items() if b != a))
        for p, b, _ in [x for x in scores if x[2]][:5]:
            found = [(n, s) for s, n, same in scores if not same and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, b, k, n, -p, -s) for k, (n, s) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("cell,group", [(8192, 1024), (64, 2)])
def test_negatives_equal_plain_search(spark, monkeypatch, cell, group):
    monkeypatch.setattr(negatives, "CELL", cell)
    monkeypatch.setattr(negatives, "GROUP", group)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 13))
    rows = [(k, (base[k % 4] * rng.uniform(0.5, 2) + rng.normal(size=13)).astype(np.float32).tolist(), int(k % 3)) for k in range(0, 600, 2)]
    rows += [(701, rows[0][1], 0), (703, [0.0] * 13, 1)]  # equal vectors tie
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()))
    want = mined([(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], lab) for i, v, lab in rows])
    assert got == want and len({r[0] for r in got}) == 6


def test_odd_vectors_take_no_part(spark):
    one = [1.0, 0.5]
    rows = [(0, one, 1), (1, one, 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (8, one, None), (None, one, 1), (1, one, 1), (9, [3e38, 0.0], 1), (10, [], 2), (11, [0.5], 2)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS + ", id long, anchor string")
    # vec_id 0 is divisible by 7: its label becomes 2, so its positives are 2, 10 and 11, its negative is 1
    got = sorted(map(tuple, negatives.mine(df).collect()))
    assert got == []  # the positives' scores, 49152, 32768 and 0, are below the negative's, 81920
    assert negatives.mine(df.where("false")).count() == 0
    got = negatives.whole_numbers(df).collect()
    assert sorted((r["id"], r["label"]) for r in got) == [(0, 2), (1, 1), (2, 2), (10, 2), (11, 2)]


def test_tables_and_planes_give_inner_products():
    rng = np.random.default_rng(4)
    for width in (1, 8, 13, 64):
        v, a = rng.integers(-300, 300, (50, width)), rng.integers(-1000, 1000, width)
        assert (negatives.all_scores(negatives.subset_sums(a), negatives.bit_planes(v)) == v @ a).all()
    assert (negatives.all_scores(negatives.subset_sums(np.array([3, 4])), negatives.bit_planes(np.array([[1], [-2]]))) == [3, -6]).all()


# --- 12: phrases


def plain_phrases(rows, least, most=2000):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[s : s + m]) for s in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s : s + m]] = max(inside[p[s : s + m]], a)
        scored = []
        for p, a in cand.items():
            if inside[p] < a:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"range_paths": 40, "shard_words": 300}])
def test_phrases_equal_plain_counts(spark, sizes):
    rng = random.Random(6)
    vocabulary = ["the", "The", "a", "of", "É", "été", "x", "ÿ", "\U0001f600", "z\x1cz"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",,"]) for _ in range(rng.randint(0, 80)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " \t "), ("hot", "again and again " * 3000), ("en", "rare")] + [("hot", "one two three four five six.")] * 50
    docs = spark.createDataFrame([(*r, 1.0, "p") for r in rows], "lang string, text string, f double, phrase string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, 8, **sizes).collect()))
    assert got == plain_phrases(rows, 8) and {r[0] for r in got} == {"en", "fr", "und", "hot"}
    few = sorted(map(tuple, phrases.collocations(docs, 8, most=3, **sizes).collect()))
    assert few == plain_phrases(rows, 8, 3)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "...")], "lang string, text string"), 1).count() == 0


def test_transducers_survive_bytes_cuts_and_unions():
    rng = np.random.default_rng(1)
    names = [b"w%d" % k for k in range(300)]
    whole = rng.integers(0, 301, 20_000).astype(np.int32)
    parts = [phrases.build(x, names) for x in np.split(whole, [5_000])]
    again = [phrases.Transducer.from_bytes(p.to_bytes()) for p in parts]
    for p, q in zip(parts, again):
        assert p.words == q.words and (p.rows == q.rows).all() and (p.weights == q.weights).all()
    both = phrases.unite(again)
    cut = np.insert(whole, 5_000, 0)  # a shard ends where a piece does
    want = phrases.build(cut, names)
    assert both.words == want.words and (both.rows == want.rows).all() and (both.weights == want.weights).all()
    cuts = sorted(("en", tuple(rng.choice(names, rng.integers(1, 6)).tolist())) for _ in range(20)) + [("fr", (b"a",))]
    pieces = list(phrases._cut(want, "en", cuts))
    back = [phrases.Transducer.from_bytes(raw) for _, raw in pieces]
    for (place, _), t in zip(pieces, back):
        for row in t.rows:
            assert phrases._place(cuts, "en", tuple(t.words[k - 1] for k in row if k)) == place
    assert sum(int(t.weights.sum()) for t in back) == (whole != 0).sum()


def test_minimal_transducer_shares_states():
    known = sorted([((b"a", b"x"), 3), ((b"b", b"x"), 3), ((b"a",), 7), ((b"b",), 7), ((b"c",), 1)])
    t = phrases.Minimal(iter(known))
    assert all(t.weight(w) == f for w, f in known) and t.weight((b"x",)) == 0 and t.weight((b"a", b"x", b"x")) == 0
    assert len(t.states) == 4  # start, a and b, c, x


# --- 13: packing


def checked(docs, length, rows):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = Counter(tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,) for t in rows)
    pieces = packing.pack(docs, PATH, length).collect()
    assert [f"{n} {t}" for n, t in packing.pack(docs, PATH, length).dtypes][1:] == ["start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"]
    total = sum(len(k) * n for k, n in want.items())
    assert sum(p["length"] for p in pieces) == total
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    assert sorted(by) == list(range(-(-total // length)))
    for k, some in by.items():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == length or k == max(by)
    # pieces in order of place are the documents' ids, each whole
    held = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(docs, PATH, length).collect()}
    ids, got = [], Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        part = held[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["start"] == len(ids)
        ids += part.tolist()
        if len(ids) == p["doc_tokens"]:
            got[tuple(ids)] += 1
            ids = []
    assert got == want and not ids
    for k, v in held.items():
        n = sum(p["length"] for p in by[k])
        assert len(v) == length or n & (n - 1) == 0 and len(v) == n


def test_packing_equals_the_library(odd, none):
    rows = [r["text"] for r in odd.collect()]
    checked(odd.repartition(3), 4096, rows)
    checked(odd.coalesce(1), 7, rows)
    assert packing.pack(none, PATH).count() == 0 and packing.sequences(none, PATH).count() == 0


def test_runs_are_encoded_as_in_whole_texts(monkeypatch):
    library, use = Tokenizer.from_file(PATH), packing.RunEncoder(PATH)
    rng = random.Random(9)
    pool = [chr(k) for k in range(32, 0x250)] + list("abcXYZ'’.,;:!?<|>  \n\t\x1c\x85  ́Σς漢\U0001f600") + ["<|endoftext|>", "don't", "It's,"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None, ""]
    for limit in (10**9, 50):
        monkeypatch.setattr(packing, "REMEMBERED", limit)
        ids, sizes = use.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
