"""Turn reassembly, ball hashing and the blocked product against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.llm import jaccard, lexical, linededup, simhash, turns


def plain_events(batches, n_batches, patience):
    """(event, conv, turn, batch, payload or unreleased turns, n_missing, n_breaks) by one walk over the arrivals."""
    firsts, convs, out = {}, {}, []
    for rows in batches:
        for c, t, *_ in rows:
            firsts[c] = min(t, firsts.get(c, t))
    for b in range(n_batches + 1):
        arrived = {}
        for c, t, role, text in batches[b] if b < n_batches else []:
            said = (f"{role or ''}|{text or ''}".encode(), role or "")
            arrived.setdefault(c, {})
            arrived[c][t] = min(said, arrived[c].get(t, said))
        for c, held in arrived.items():
            s = convs.setdefault(c, {"kept": {}, "next": firsts[c], "silent": 0, "closed": False})
            if s["closed"]:
                out += [("reject", c, t, b, p.decode(), None, None) for t, (p, _) in held.items()]
                continue
            s["silent"] = 0
            for t, said in held.items():
                s["kept"].setdefault(t, said)
            while s["next"] in s["kept"]:
                out.append(("release", c, s["next"], b, s["kept"][s["next"]][0].decode(), None, None))
                s["next"] += 1
        for c, s in convs.items():
            if s["closed"] or c in arrived:
                continue
            s["silent"] += 1
            if s["silent"] == patience or b == n_batches:
                s["closed"] = True
                k = s["kept"]
                breaks = sum(t - 1 in k and k[t - 1][1] == k[t][1] for t in k)
                out.append(("close", c, -1, b, ",".join(str(t) for t in sorted(k) if t >= s["next"]), max(k) - firsts[c] + 1 - len(k), breaks))
    return sorted(map(repr, out))


def test_turns(spark):
    r = random.Random(4)
    n_batches, patience = 4, 2
    batches = [[] for _ in range(n_batches)]
    spans = {"1": range(4), "2": range(250, 264), "3": range(-260, -252), "": range(511, 514), "5": range(3), "6": range(254, 259)}
    for c, turns_ in spans.items():
        for t in turns_:
            for _ in range(r.choice([1, 1, 2])):
                if r.random() < 0.9:
                    batches[r.choice([0, 1, 3])].append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b é", None])))
    batches[0] += [("5", 0, "user", "x"), ("5", 0, "user", "w"), ("6", 254, "user", "q"), ("6", 255, "user", "q"), ("6", 256, "user", "q")]
    batches[2], batches[1] = [], [x for x in batches[1] if x[0] not in "56"]
    firsts = {}
    for rows in batches:
        for c, t, *_ in rows:
            firsts[c] = min(t, firsts.get(c, t))
    made = turns.Reassembly(spark, n_batches, patience)
    with pytest.raises(ValueError):
        made.finish()
    for rows in batches:
        data = [(c or None, t, role, text, firsts[c], 7) for c, t, role, text in rows] + [("1", None, "user", "no turn", 0, 7)] * bool(rows)
        made.feed(spark.createDataFrame(data, "conv_id string, turn long, role string, text string, first long, kind int"))
    made.finish()
    with pytest.raises(ValueError):
        made.feed(spark.createDataFrame([], "conv_id string, turn long, role string, text string, first long"))
    got = made.events().collect()
    rows = [(x.event, x.conv, x.turn, x.batch, ",".join(map(str, x.unreleased)) if x.event == "close" else x.payload, x.n_missing, x.n_breaks) for x in got]
    assert sorted(map(repr, rows)) == plain_events(batches, n_batches, patience)
    assert {x.event for x in got} == {"release", "reject", "close"}


def test_arrivals(spark):
    df = spark.createDataFrame([(1, 3, "user", "a", "x"), (1, 2, None, "b", "x"), (None, 5, "system", None, "x"), (1, None, "user", "c", "x")], "conv_id long, turn long, role string, text string, first string")
    import hashlib

    got = sorted(map(repr, map(tuple, turns.arrivals(df.drop("first")).collect())))
    wanted = []
    for c, t, role, text, first in [(1, 3, "user", "a", 2), (1, 2, None, "b", 2), (None, 5, "system", None, 5)]:
        h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
        wanted += [(c, t, role, text, first, h % 12)] + [(c, t, "user", text, first, (h + 3) % 12)] * (h % 7 < 2)
    assert got == sorted(map(repr, wanted))


def plain_print(text, words=3):
    held = text.lower().split()
    if not held:
        return 0
    hashes = [xxh64_intdigest(b" ".join(held[i : i + words]), 42) for i in range(max(len(held) - words + 1, 1))]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def test_fingerprints():
    r = random.Random(2)
    for _ in range(500):
        text = " ".join(r.choice(["A", "bb", "É", "\t", "c-d"]) for _ in range(r.randrange(12))).encode()
        assert simhash.fingerprint(text) == plain_print(text)
    long_ = " ".join(str(i) for i in range(simhash.PIECE + 50)).encode()
    assert simhash.fingerprint(long_) == plain_print(long_) and simhash.fingerprint(None) == 0


def test_links_are_those_of_all_pairs(spark):
    r = random.Random(9)
    held = {0, 1, 7, -1}
    for _ in range(40):
        x = r.getrandbits(64)
        held |= {x - (1 << 64) if x >> 63 else x}
        for _ in range(r.randrange(6)):  # a walk of steps of one to five bits
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << b
            held.add(x - (1 << 64) if x >> 63 else x)
    held = sorted(held)
    of = {x: x for x in held}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(held):
        for b in held[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                of[max(root(a), root(b))] = min(root(a), root(b))
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in held], "print long")))
    got = {x.node: x.root for x in found.collect()}
    assert {x: got.get(x, x) for x in held} == {x: root(x) for x in held}


def test_ball_hashing_edges(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(3, text), (1, text), (1, text), (None, text), (7, None), (9, ""), (8, " \t\n"), (5, "One two"), (6, "one  TWO"), (4, "é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit(1), "id": F.lit("x"), "component_id": F.lit(0)})
    got = sorted((x.doc_id or 0, x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect())
    assert [(d, c) for d, _, c in got] == [(0, 1), (1, 1), (1, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 7), (9, 7)]
    assert got[7][1] == "0" * 16 and all(re.fullmatch("[0-9a-f]{16}", f) for _, f, _ in got)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_ranks(docs, items, k, multiplicity=False):
    find = lambda t: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    texts = [(d, find(t)) for d, t in docs]
    texts = [(d, w) for d, w in texts if w]
    n_docs, n_terms = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        own = find(text)
        scored = []
        for d, w in texts:
            m = 50 + (50 * len(w) * n_docs) // n_terms
            s = sum((own.count(t) if multiplicity else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in set(own) if t in w)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("multiplicity", [False, True])
def test_ranks(spark, monkeypatch, multiplicity):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    r = random.Random(6)
    words = ["Ab", "ab", "c", "d9", "é", "É", "x-y", "_", "zz"]
    docs = [(i // 2 if i % 7 else None, " ".join(r.choice(words) for _ in range(r.randrange(20)))) for i in range(120)] + [(500, None), (501, "c " * 30_000)]
    items = [(i, " ".join(r.choice([*words, "none"]) for _ in range(r.randrange(9)))) for i in range(25)] + [(3, "ab c"), (None, "zz"), (77, None), (78, "zz " * 200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit(1), "item_id": F.lit(2)}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(0))
    got = lexical.rank(d, i, 5, multiplicity).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain_ranks(docs, items, 5, multiplicity)
    if multiplicity:
        assert lexical.rank(d.limit(0), i).count() == 0 and lexical.rank(d, i.limit(0)).count() == 0


def test_blocks_of_documents_merge(monkeypatch):
    best, r = lexical.Best(4), np.random.default_rng(1)
    scores, ids = r.integers(0, 6, 300), r.permutation(300)
    known = r.random(300) < 0.9
    for at in range(0, 300, 37):
        best.add(scores[at : at + 37], ids[at : at + 37], known[at : at + 37])
    wanted = sorted((-s, k, i) for s, i, k in zip(scores, ids, known, strict=True) if s > 0)[:4]
    assert [(-s, k, i) for s, k, i in zip(best.scores, best.known, best.ids, strict=True)] == wanted


def test_fingerprints_of_single_positions_reach_no_join(spark):
    line = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(1, "\n".join(line(i) for i in range(10))), (2, "\n".join([line(50), *(line(i) for i in range(3, 8)), line(51)])), (3, "\n".join(line(i) for i in range(60, 75)))]
    found = linededup.windows(linededup.worded_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    left = found.join(linededup.shared_fingerprints(found), "fingerprint", "left_semi")
    assert {x.id for x in left.select("id").distinct().collect()} == {1, 2} and left.count() < found.count() / 2
    assert sorted((x["first"], x["last"]) for x in linededup.runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 5)]


def test_pairs_of_many_keys_are_few_rows(spark, monkeypatch):
    # sets that share hundreds of keys: the same pairs, but hardly a row for each key
    r = random.Random(5)
    rows = [(key, node, r.choice((1, 2, 3, 3)), 99, True) for key in r.sample(range(1 << 40), 300) for node in range(10) if r.random() < 0.6]
    roots = {node: node // 2 for node in range(10)}
    groups = spark.createDataFrame(rows, "key long, node long, flags long, centre long, crowded boolean")
    sizes = {node: 100 if node < 5 else 3000 for node in range(10)}
    docs = spark.createDataFrame([(k, n, [0] * (jaccard.SLOTS // 64)) for k, n in sizes.items()], "node long, n_shingles long, fold array<long>")
    by_key = {}
    for key, node, flags, *_ in rows:
        by_key.setdefault(key, []).append((node, flags))
    met = [(p, i) for held in by_key.values() for p, f in held for i, g in held if f & 2 and g & 1 and roots[p] != roots[i] and sizes[p] == sizes[i]]
    seen, plain = [], jaccard.ordered
    monkeypatch.setattr(jaccard, "ordered", lambda a, b, pairs: seen.append(pairs.count()) or plain(a, b, pairs))
    found = jaccard.crossing(groups, spark.createDataFrame(list(roots.items()), "node long, root long"), docs, 75)
    assert sorted(map(tuple, found.collect())) == sorted({(min(x), max(x)) for x in met})
    assert seen[0] * 10 < len(met)


def test_order_is_fitted_on_every_document(spark, monkeypatch):
    # counts, coordinates and halves follow documents that a sample of 4096 would leave out, and the table's order is that of the list
    import public_tokenizers as P
    from brindle.llm import packing

    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 9))) for _ in range(6000)]
    tokens = packing.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), P.path("word_bpe_49k.json"), 2, 50000)
    df, n, _ = packing.frequencies(tokens, 50000)
    held = [packing.ids_of(x.ids, x.n).astype(np.int64) for x in tokens.where("n > 0").collect()]
    assert n == 6000 and df.tolist() == np.bincount(np.concatenate([np.unique(x) for x in held]), minlength=50000).tolist()
    made, plain = packing.fitted(tokens, df, n)[0], packing.order_of(held, 50000)
    assert np.array_equal(made.draws, plain.draws) and np.allclose(np.abs(made.loads), np.abs(plain.loads), atol=1e-2)
    sizes = np.bincount(made.keys(held)[0][:, 0], minlength=2**packing.DEPTH)
    assert sizes.sum() == 6000 and sizes.max() < 6000 / 16


def test_ids_are_held_once(spark):
    # the first table goes as soon as the second has its ids, and nodes are found in SQL as in numpy
    import public_tokenizers as P
    from brindle.llm import packing, store

    rows = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=8))) for i in range(500)], "doc_id long, text string")
    before = len(store._written)
    packing.pack(rows, P.path("word_bpe_49k.json"), with_ids=False)
    assert [path.rsplit("/", 1)[1].split("-")[0] for _, path in store._written[before:]] == ["marked"]
    tokens = packing.encoded(rows, P.path("word_bpe_49k.json"), 2, 50000)
    df, n, _ = packing.frequencies(tokens, 50000)
    order, marked = packing.fitted(tokens, df, n)
    got = {x.row: (x.topic, x.first, x.second) for x in packing.ordered(marked, order).collect()}
    held = marked.collect()
    keys = order.keys([packing.ids_of(x.ids, x.n).astype(np.int64) for x in held])[0]
    assert {x.row: tuple(k) for x, k in zip(held, keys.tolist())} == got and len({x[0] for x in got.values()}) > 50


WORDS = [f"{a}{b}" for a in ("red", "blue", "stone", "river", "cloud", "glass", "north", "paper") for b in ("", "s", "ing", "er", "house", "line", "mark", "way")]
