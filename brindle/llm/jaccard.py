"""Exact Jaccard self-join of word n-gram sets by universe partition and the pigeonhole principle.

Sets of similarity t or more differ in at most H = (|x| + |y|)(1 - t)/(1 + t) elements. Sizes lie in bands by the factor
1/t, so a set's partners lie in its own band, the one below, or the one above (which then looks down). In band j a hash deals
the universe of shingles to m_j segments; a difference of H over the segments of a set leaves, for any allocation of
tolerances v_i in {skip = -1, 0, 1} with the sum of (v_i + 1) at least H + 1, one segment that differs in at most v_i.

Every set is indexed under its segments (their content hash) of its own band, and in the first d_j of them also under the
segments' one-deletion neighbourhoods. As a probe it chooses an allocation for its own band and for the one below: segments
with tolerance 0 at the least cost, which falls with the number of shingles (a segment of one common shingle meets many
strangers, one of several hardly any), so the smallest are skipped; where that isn't enough, tolerance 1 in the first d_j.
In bands of small sets all segments have neighbourhoods.

Candidates are verified exactly on the shingle sets. A group of sets under one key is never paired off: first each with one
centre; then, as linked sets are in one component already, a probe and an indexed set of different components, and of these
only the pairs that sizes and sketches (the parity of the shingles in some slots, which bounds the difference from below)
don't rule out. That test is the join's own condition, so pairs that it rules out are never rows.

Shingles and sets are known by 64-bit (62-bit for sets) hashes. Equal sets are one node of the graph, whose documents get
the node's component.

Defined results: an empty, null or blank text has no shingles and is linked with nothing; one with fewer words than a
shingle has one, the whole sequence; rows of one id are judged each by its text; rows with a null id take part, and a
component's id is the smallest that isn't null; an empty table gives no rows; other columns take no part. Long texts are
one array of shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import fresh, written

WORDS, PERCENT = 5, 75
#: Bands from this size on index neighbourhoods of some segments only.
SMALL = 32
#: Slots of a set's sketch (at least), which joins compare as numbers of 64 bits.
SLOTS = 1024
#: Keys before each key that are looked at for an earlier meeting of a pair.
EARLIER = 16
#: The most sets with candidates of which the driver makes a filter, and its slots for each. It spares texts from being made
#: into sets again and never decides; beyond it the texts are joined.
FILTERED, FILTER_SLOTS = 1 << 21, 16
#: Frequent shingles that steer the allocation, and the sets of a task that are counted together (memory of a worker).
FREQUENT, COUNTED = 1 << 16, 4000
NONE = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (a splitmix64 step)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: Bytes whose words are hashed at once, which bounds memory on long texts.
CHUNK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SPACES = re.compile(rb"[\x20\x09-\x0D]")
#: A random number for each byte at each of 64 places of a word; beyond them the numbers recur times an odd power.
PLACES = np.random.default_rng(20).integers(0, 1 << 64, (64, 256), dtype=np.uint64).ravel()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, byte offsets) of the words in data: the sum of their bytes' numbers, mixed with the length."""
    codes = np.frombuffer(data, np.uint8)
    inside = ~SPACE[codes]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    value = PLACES[((place & 63) << 8) + codes[inside]]
    if sizes.max() > 64:
        far = place > 63
        odd = np.full(int(place.max() >> 6) + 1, GOLD, dtype=np.uint64)
        odd[0] = 1
        value[far] *= np.multiply.accumulate(odd)[place[far] >> 6]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * GOLD), starts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each whole text, as 64-bit hashes."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        ends = np.cumsum([len(x) + 1 for x in held])
        hashes, starts = word_hashes(b" ".join(held))
        at = [0, *np.searchsorted(starts, ends).tolist()]
        runs = chained(hashes, words) if len(hashes) >= words else hashes
        for a, b in zip(at, at[1:]):
            out.append(np.unique(runs[a : b - words + 1]) if b - a >= words else distinct(hashes[a:b], words))
        held.clear()

    for text in texts:
        data = (text or "").encode("utf-8", "replace").lower()  # bytes: only A-Z change
        if len(data) > CHUNK:
            flush()
            size, at, parts = 0, 0, []
            while at < len(data):
                cut = SPACES.search(data, min(len(data), at + CHUNK))
                to = cut.start() if cut else len(data)
                parts.append(word_hashes(data[at:to])[0])
                at = to
            out.append(distinct(np.concatenate(parts), words))
            continue
        held.append(data)
        size += len(data)
        if size >= CHUNK:
            flush()
            size = 0
    flush()
    return out


def distinct(hashes: np.ndarray, words: int) -> np.ndarray:
    """The shingles of one text's words; fewer words than a shingle has are one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(chained(hashes, min(words, len(hashes))))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix((out + GOLD) ^ hashes[i : len(hashes) - n + 1 + i])
    return out


def sketch_of(found: np.ndarray) -> bytes:
    """The parity of the shingles in each of 2^k slots, as many as there are shingles or more (SLOTS at least).

    Two sets differ in at least as many shingles as their sketches in bits; halves folded together make the shorter sketch."""
    slots = max(SLOTS, 1 << int(len(found) - 1).bit_length())
    return np.packbits(np.bincount((mix(found + M1) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def folded(sketch: bytes) -> np.ndarray:
    """The sketch of SLOTS slots, as signed numbers of 64 bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, "<i8").reshape(-1, SLOTS // 64), axis=0)


def may_link(n: int, sketch: bytes, m: int, other: bytes, percent: int) -> bool:
    """False only if the sets of n and m shingles can't be similar."""
    if percent * max(n, m) > 100 * min(n, m):
        return False
    bits, x, y = 8 * min(len(sketch), len(other)), int.from_bytes(sketch, "little"), int.from_bytes(other, "little")

    def narrow(value: int, wide: int) -> int:
        while wide > bits:
            wide //= 2
            value = (value >> wide) ^ (value & ((1 << wide) - 1))
        return value

    x, y = narrow(x, 8 * len(sketch)), narrow(y, 8 * len(other))
    return (x ^ y).bit_count() <= difference(n + m, percent)


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) >> 2


def difference(total: np.ndarray | int, percent: int = PERCENT):
    """H: the most elements in which two sets of together total elements may differ."""
    return total * (100 - percent) // (100 + percent)


@lru_cache
def bands(most: int, percent: int = PERCENT) -> np.ndarray:
    """The smallest size of each band, up to a band above most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array([*out, max(out[-1] + 1, -(-out[-1] * 100 // percent))], dtype=np.int64)


def layout(low: np.ndarray, high: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """m (segments) and d (those with neighbourhoods) of the bands of sizes low to high - 1."""
    need = difference((high - 1) + (high - 1) * 100 // percent, percent) + 1  # the most that any probe of the band needs
    small = low < SMALL
    # an eighth more segments than that, as some are empty and the smallest are to be skipped
    m = np.where(small, (need + 1) // 2, need * 9 // 8)
    return m, np.where(small, m, m // 12 + 2)


def key_rows(sets: list[np.ndarray], nodes: np.ndarray, below: bool, percent: int = PERCENT, wide: bool = False, frequent: tuple[np.ndarray, np.ndarray] = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, node * 4 + flags, nodes without a full allocation) for the sets' own bands, or as probes of the bands below.

    Flags: 1 indexed, 2 probe. wide: empty segments are indexed and probed everywhere, so that every set has a full allocation
    (as many segments as are needed exist); else only where neighbourhoods are."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    edges = bands(int(sizes.max(initial=1)), percent)
    band = np.searchsorted(edges, sizes, side="right") - 1 - below
    inside = band >= 0
    if below:
        inside &= -(-sizes * percent // 100) < edges[np.maximum(band, 0) + 1]
    pick = np.flatnonzero(inside & (sizes > 0))
    if not len(pick):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    sizes, band, nodes = sizes[pick], band[pick], nodes[pick]
    tokens = np.concatenate([sets[i] for i in pick])
    m, d = layout(edges[band], edges[band + 1], percent)
    need = difference(sizes + np.minimum(edges[band + 1] - 1, sizes * 100 // percent), percent) + 1
    base, total = np.cumsum(m) - m, int(m.sum())
    owner = np.repeat(np.arange(len(pick)), sizes)
    seg = (mix(tokens ^ GOLD) % m[owner].astype(np.uint64)).astype(np.int64)
    slot = base[owner] + seg
    count = np.bincount(slot, minlength=total)
    half = np.uint64(0xFFFFFFFF)
    content = np.bincount(slot, (tokens & half).astype(float), minlength=total).astype(np.uint64) + (np.bincount(slot, (tokens >> np.uint64(32)).astype(float), minlength=total).astype(np.uint64) << np.uint64(32))
    doc = np.repeat(np.arange(len(pick)), m)
    place = np.arange(total) - base[doc]
    salt = mix(band[doc].astype(np.uint64) * GOLD + place.astype(np.uint64))
    near = place < d[doc]
    full = count > 0
    # the allocation: as many segments with tolerance 0 as are needed, at the least cost: a segment meets at most the documents
    # that hold its rarest shingle, and of equal ones that of more shingles meets fewer
    rarest = np.full(total, np.iinfo(np.int64).max)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], tokens), len(frequent[0]) - 1)
        np.minimum.at(rarest, slot, np.where(frequent[0][at] == tokens, frequent[1][at], 0))
    order = np.lexsort((mix(content), -count, rarest, doc))
    rank = np.empty(total, dtype=np.int64)
    rank[order] = np.arange(total) - base[doc[order]]
    probe = full & (rank < need[doc])
    short = need - np.bincount(doc[full], minlength=len(pick)).clip(max=need)
    # tolerance 1 where neighbourhoods are, then empty segments there, which meet the empty and those of one shingle
    more = full & near
    upto = np.cumsum(more) - np.concatenate([[0], np.cumsum(more)])[base][doc]
    wider = more & (upto <= short[doc])
    short = np.maximum(0, short - np.bincount(doc[more], minlength=len(pick)))
    void = near & ~full
    upto = np.cumsum(void) - np.concatenate([[0], np.cumsum(void)])[base][doc]
    used = void & (2 * (upto - 1) < short[doc])
    short = np.maximum(0, short - 2 * np.bincount(doc[void], minlength=len(pick)))
    probe |= used
    own = full | near
    if wide:
        far = ~own
        upto = np.cumsum(far) - np.concatenate([[0], np.cumsum(far)])[base][doc]
        probe |= far & (upto <= short[doc])
        short = np.maximum(0, short - np.bincount(doc[far], minlength=len(pick)))
        own = np.ones(total, dtype=bool)
    shown = probe if below else (own | probe)
    flags = (0 if below else own.astype(np.int64)) + 2 * probe
    keys, says = [mix(content + salt)[shown]], [(nodes[doc] * 4 + flags)[shown]]
    # one-deletion neighbourhoods
    gone = wider[slot] if below else near[slot]
    keys.append(mix(content[slot] - tokens + salt[slot])[gone])
    says.append((nodes[owner] * 4 + (0 if below else 1) + 2 * wider[slot])[gone])
    return np.concatenate(keys), np.concatenate(says), nodes[short > 0]


def described(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (the text's hash), n_shingles, node, sketch and fold (its folded(); null without shingles).

    Each task adds rows with n_shingles -1 whose sketch holds the shingles in a hundredth of its documents or more, with
    their counts: at most a hundred times the mean size of its sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies of one set count once in a task
        held: list[np.ndarray] = []
        n = 0

        def frequent() -> pd.DataFrame:
            all_, counts = np.unique(np.concatenate(held) if held else np.empty(0, dtype=np.uint64), return_counts=True)
            often = counts >= max(3, n // 100)
            data = all_[often].tobytes() + counts[often].astype(np.uint64).tobytes()
            return pd.DataFrame({"id": pd.array([None], dtype="Int64") if whole else [None], "h": [0], "n_shingles": [-1], "node": pd.array([None], dtype="Int64"), "sketch": [data], "fold": [None]})

        for b in batches:
            sets = shingle_sets(list(b.text), words)
            for s in sets:
                if len(s) and (k := node_of(s)) not in seen:
                    seen.add(k)
                    held.append(s)
                    n += 1
            if n >= COUNTED:
                yield frequent()
                held, n = [], 0
            sketches = [sketch_of(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"id": b.id, "h": b.h, "n_shingles": [len(s) for s in sets], "node": pd.array([node_of(s) if len(s) else None for s in sets], dtype="Int64"), "sketch": sketches, "fold": [None if x is None else folded(x) for x in sketches]})
        if held:
            yield frequent()

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    whole = dict(rows.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, h long, n_shingles long, node long, sketch binary, fold array<long>")


def frequent_shingles(described_: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all documents, at most FREQUENT, sorted, with their counts. They only steer the allocation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b.sketch:
                both = np.frombuffer(data, np.uint64).reshape(2, -1)
                yield pd.DataFrame({"s": both[0].view(np.int64), "n": both[1].view(np.int64)})

    each = described_.where("n_shingles < 0").select("sketch").mapInPandas(run, "s long, n long")
    top = each.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()
    order = np.argsort(top.s.to_numpy(dtype=np.int64).view(np.uint64), kind="stable")
    return top.s.to_numpy(dtype=np.int64).view(np.uint64)[order], top.n.to_numpy(dtype=np.int64)[order]


def keyed(df: DataFrame, words: int = WORDS, percent: int = PERCENT, text_col: str = "text", wide: bool = False, frequent: tuple[np.ndarray, np.ndarray] = NONE) -> DataFrame:
    """key, said (node * 4 + flags) of every set: what is shuffled. A null key marks a set without a full allocation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: copies needn't be said again
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                sets = [s for s in shingle_sets(texts[at : at + 256], words) if len(s)]
                nodes = [node_of(s) for s in sets]
                fresh = [i for i, n in enumerate(nodes) if n not in seen and (seen.add(n) or True)]
                if not fresh:
                    continue
                for below in (False, True):
                    keys, says, left = key_rows([sets[i] for i in fresh], np.array([nodes[i] for i in fresh], dtype=np.int64), below, percent, wide, frequent)
                    if len(left):
                        yield pa.record_batch([pa.nulls(len(left), pa.int64()), pa.array(left * 4)], names=["key", "said"])
                    for k in range(0, len(keys), 200_000):
                        yield pa.record_batch([pa.array(keys[k : k + 200_000].view(np.int64)), pa.array(says[k : k + 200_000])], names=["key", "said"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, said long")


def grouped(rows: DataFrame) -> DataFrame:
    """key, node, flags, centre, crowded: the members of keys that a probe and another set share. centre: the key's smallest
    probe. crowded: two sets or more share the key with the centre, so that its pairs with them aren't all."""
    from pyspark.sql import Window

    key = Window.partitionBy("key")
    node, probe = F.shiftrightunsigned("said", 2), F.col("said").bitwiseAND(2) != 0
    found = rows.select("key", "said").withColumns({"low": F.min(node).over(key), "high": F.max(node).over(key), "centre": F.min(F.when(probe, node)).over(key)})
    found = found.where("key IS NULL OR (low < high AND centre IS NOT NULL)")
    found = found.select("key", F.shiftrightunsigned("said", 2).alias("node"), F.col("said").bitwiseAND(3).alias("flags"), "centre")
    other = F.when(F.col("node") != F.col("centre"), F.col("node"))
    return found.withColumn("crowded", F.min(other).over(key) < F.max(other).over(key))


def ordered(a, b, pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def possible(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out. Sketches are a small part of the sets."""
    nodes = docs.where("node IS NOT NULL").select("node", "n_shingles", "sketch").dropDuplicates(["node"])
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [may_link(*x, percent) for x in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return with_both.mapInArrow(run, "a long, b long")


def sets_of(nodes: DataFrame, docs: DataFrame, df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Written table: node, held (the sorted shingles, 8 bytes each) of the wanted nodes. One text of each is made into a set."""
    reps = written(docs.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "h")).alias("rep")).join(nodes, "node", "left_semi").select("rep.*"), "reps")
    n = reps.count()
    if n <= FILTERED:
        slots = 1 << max(10, (n * FILTER_SLOTS).bit_length())
        hashed = lambda i, h: F.pmod(F.xxhash64(i, h), F.lit(slots)).cast("int")
        wanted = np.zeros(slots, dtype=bool)
        wanted[reps.select(hashed("id", "h").alias("slot")).toPandas().slot.to_numpy()] = True  # at most FILTERED numbers
        packed = np.packbits(wanted)
        texts = df.select(hashed(F.col(id_col), F.xxhash64(F.col(text_col))).alias("slot"), F.col(text_col).alias("text"))
    else:
        packed = None
        own = df.select(F.col(id_col).alias("own"), F.xxhash64(F.col(text_col)).alias("own_h"), F.col(text_col).alias("text"))
        texts = own.join(reps, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h")), "left_semi").select(F.lit(0).alias("slot"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: copies needn't be said again
        for b in batches:
            at = np.arange(b.num_rows)
            if packed is not None:
                slot = b.column(0).to_numpy()
                at = np.flatnonzero(packed[slot >> 3] >> (7 - (slot & 7)) & 1)
            for k in range(0, len(at), 256):
                sets = {node_of(s): s for s in shingle_sets(b.column(1).take(pa.array(at[k : k + 256])).to_pylist(), words) if len(s)}
                fresh = [n for n in sets if n not in seen and (seen.add(n) or True)]
                yield pa.record_batch([pa.array(fresh, pa.int64()), pa.array([sets[n].tobytes() for n in fresh], pa.binary())], names=["node", "held"])

    sets = texts.mapInArrow(run, "node long, held binary")
    return written(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "held")


def linked(pairs: DataFrame, docs: DataFrame, df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, by their whole sets. docs: described()."""
    pairs = written(possible(pairs, docs, percent), "possible")
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    sets = sets_of(nodes, docs, df, words, id_col, text_col)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("held").alias("of_b")), "b")
    with_a = with_b.join(sets.select(F.col("node").alias("a"), F.col("held").alias("of_a")), "a")
    return with_a.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


def crossing(groups: DataFrame, rooted: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key and that sizes and sketches don't rule out, but for the centres' pairs.

    Two sets with a long passage in common share hundreds of keys. Each carries the EARLIER keys before each of its keys, and
    where these have one in common the pair is a row there (or at one before that), so not here."""
    from pyspark.sql import Window

    known = written(groups.where("crowded AND node <> centre").join(rooted, "node", "left").select("key", "node", "flags", F.coalesce("root", "node").alias("root")), "known")
    spans = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    others = known.join(spans, "key", "left_semi")
    facts = docs.where("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("fold").alias("fold"))
    # a fold that is full of differences rules nothing out
    tells = F.expr(f"2 * n * {100 - percent} div {100 + percent} < {SLOTS * 3 // 5}")
    probes, indexed = (F.col("flags").bitwiseAND(bit) != 0 for bit in (2, 1))
    before = Window.partitionBy("node", indexed).orderBy("key").rowsBetween(-EARLIER, -1)
    lists = {c: F.collect_list(F.when(is_, F.col("key"))).over(before) for c, is_ in (("p_before", probes), ("i_before", indexed))}
    rows = others.join(facts, "node").withColumns({"fold": F.when(tells, F.col("fold")), "both": probes & indexed} | lists)
    open_ = written(rows.select("key", "node", "flags", "both", "root", "n", "fold", *lists), "open")

    def side(bit: int, c: str) -> DataFrame:
        return open_.where(F.col("flags").bitwiseAND(bit) != 0).select("key", f"{c}_before", *[F.col(x).alias(f"{c}_{x}") for x in ("node", "both", "root", "n", "fold")])

    most = F.expr(f"(p_n + i_n) * {100 - percent} div {100 + percent}")
    differ = sum((F.bit_count(F.col("p_fold")[j].bitwiseXOR(F.col("i_fold")[j])) for j in range(1, SLOTS // 64)), F.bit_count(F.col("p_fold")[0].bitwiseXOR(F.col("i_fold")[0])))
    fits = (F.col("p_root") != F.col("i_root")) & (percent * F.greatest("p_n", "i_n") <= 100 * F.least("p_n", "i_n")) & F.coalesce(differ <= most, F.lit(True))
    # once, where each is the other's probe, and not where they have met at one of the keys just before
    fits = fits & ~(F.col("p_both") & F.col("i_both") & (F.col("p_node") > F.col("i_node"))) & ~F.arrays_overlap("p_before", "i_before")
    pairs = side(2, "p").withColumnRenamed("key", "p_key").join(side(1, "i"), (F.col("p_key") == F.col("key")) & fits)
    return ordered(F.col("p_node"), F.col("i_node"), pairs)


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in links (a, b), by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def join(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: id, n_shingles, node; edges: a, b of nodes). The edges' components are those of all links."""
    first = written(described(df, words, id_col, text_col), "sets")
    docs, frequent = first.where("n_shingles >= 0"), frequent_shingles(first)
    groups = written(grouped(keyed(df, words, percent, text_col, frequent=frequent)), "groups")
    if not groups.where("key IS NULL").isEmpty():  # so rare that all are indexed anew
        groups = written(grouped(keyed(df, words, percent, text_col, wide=True, frequent=frequent)), "groups")
    star = ordered(F.col("centre"), F.col("node"), groups)
    rooted = components(linked(star, docs, df, words, percent, id_col, text_col))
    rest = linked(crossing(groups, rooted, docs, percent), docs, df, words, percent, id_col, text_col)
    return docs, rooted.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest)


def near_duplicates(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach, the own included)."""
    docs, links = join(df, words, percent, id_col, text_col)
    rooted = components(links)
    placed = docs.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    out = placed.join(firsts, "root", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without near duplicates: of each component the row of the smallest (id, text hash) stays, and all without shingles."""
    docs, links = join(df, words, percent, id_col, text_col)
    placed = docs.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")).select("first.id", "first.h")
    id_, h = fresh(df, "own_id", "own_h")
    stays = written(first.union(docs.where("node IS NULL").select("id", "h")).distinct().toDF(id_, h), "stays")
    out = df.join(stays, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(h)), "left_semi")
    if docs.where("node IS NOT NULL").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return out
    # rows of equal id and text: one stays
    same = out.withColumn(h, F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.col(text_col))))
    return same.where(F.col(h).isNull()).unionByName(same.where(F.col(h).isNotNull()).dropDuplicates([id_col, h])).drop(h)
