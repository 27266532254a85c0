"""Lexical retrieval packing.

Documents are encoded once to a table of token ids in the shared folder. Document frequencies of all terms (token ids, so
never more than the vocabulary) and the mean length are counted over all documents. A window starts with a seed, its
unused neighbours by falling BM25 score fill it, and the document that is cut at the window's end is the next window's seed.

Shards are dealt by lexical content, so that a seed's neighbours are in its own shard: all documents are put in one order,
cut into shards of about SHARD_TOKENS tokens, and each shard has an inverted index that answers its seeds by all their
distinct terms. The order is that of a tree of topics (latent semantic coordinates, halved again and again; counts, coordinates
and halves are of all documents), within a topic that of two weighted minhashes of the terms, which put copies and near
copies side by side, and then that of a hash. Copies in any number are parted by the last hash only. A task sees
one shard and half of the next at most. Only the last window of a shard has room left.

Every document gets a number when the table is written, the tokens before it in its task; a window's sequence_id is the number of
its first token.

Defined results: a null or empty text has only the end id; repeated rows and rows of one id are documents of their own
(start and doc_tokens are the row's); null ids pass through; an empty table gives no pieces; other columns take no part;
a document longer than a window fills windows of its own first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.store import dropped, written
from brindle.llm.tokens import forget, library_table

WINDOW, SHARD_TOKENS = 4096, 1 << 20
K1, B = 1.2, 0.75
#: The tree of topics: its depth, coordinates, hashed terms, bins of a coordinate and passes over the documents that fit it.
DEPTH, COORDINATES, BUCKETS, BINS, PASSES = 8, 16, 4096, 1024, 2
#: What stands for 1 in whole sums; documents whose hashed terms are held at a time.
ONE, DENSE = 1 << 20, 256
#: Tokens whose terms are looked at together, if they aren't one document's.
SUMMED = 1 << 17
#: Documents that are encoded at a time, which bounds a worker's memory.
ROWS = 1024
#: Documents whose coordinates a task counts.
PLACES = 1 << 15


def distinct(docs: list[np.ndarray], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the distinct terms of each document, in this order. Terms are less than wide; no document is empty."""
    kind = np.uint16 if wide <= 1 << 16 else np.int64
    sizes = np.array([len(d) for d in docs])
    all_ = np.concatenate([np.sort(d.astype(kind), kind="stable") for d in docs])
    new = np.ones(len(all_), dtype=bool)
    new[1:] = all_[1:] != all_[:-1]
    new[np.cumsum(sizes) - sizes] = True
    at = np.flatnonzero(new)
    return np.repeat(np.arange(len(docs)), sizes)[at], all_[at].astype(np.int64), np.diff(at, append=len(all_))


@dataclass
class Order:
    """Puts documents in an order of content: topic, and two weighted minhashes."""

    loads: np.ndarray  # coordinates of each term
    draws: np.ndarray  # two exponential draws of each term, divided by its weight
    cuts: list[tuple[np.ndarray, np.ndarray]]  # of each level: the coordinate and the value that halves each node

    def keys(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A row of topic, first and second minhash for each document (ids, never empty), and how many of them hold each term."""
        place, least, counts = self.marks(docs)
        return np.column_stack([self.topic(place), least]), counts

    def marks(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates and the two minhashes of each document, and how many of them hold each term."""
        wide = len(self.loads)
        place, least = np.zeros((len(docs), self.loads.shape[1]), dtype=np.float32), np.zeros((len(docs), 2), dtype=np.int32)
        counts = np.zeros(wide, dtype=np.int64)
        for at, to, owner, terms in grouped(docs, wide):
            first = np.searchsorted(owner, np.arange(to - at))
            counts += np.bincount(terms, minlength=wide)
            place[at:to] = unit(np.add.reduceat(self.loads[terms], first, axis=0))
            for i in (0, 1):
                draw = self.draws[i][terms]
                hit = np.flatnonzero(draw == np.minimum.reduceat(draw, first)[owner])
                least[at:to, i] = terms[hit[np.searchsorted(owner[hit], np.arange(to - at))]]
        return place, least, counts

    def topic(self, place: np.ndarray) -> np.ndarray:
        node = np.zeros(len(place), dtype=np.int64)
        for axis, value in self.cuts:
            node = 2 * node + (place[np.arange(len(place)), axis[node]] > value[node])
        return node.astype(np.int32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def grouped(docs: list[np.ndarray], wide: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, document, term) of the distinct terms of about SUMMED tokens' documents at a time."""
    at = 0
    while at < len(docs):
        to, n = at, 0
        while to < len(docs) and (n == 0 or n + len(docs[to]) <= SUMMED):
            n, to = n + len(docs[to]), to + 1
        owner, terms, _ = distinct(docs[at:to], wide)
        yield at, to, owner, terms
        at = to


@dataclass
class Topics:
    """What the order is fitted with. Sums over documents are whole numbers (ONE for 1), so that the order of adding is no matter."""

    idf: np.ndarray
    draws: np.ndarray
    bucket: np.ndarray  # of each term
    signed: np.ndarray  # its idf, of either sign
    base: np.ndarray  # the leading right singular vectors of documents by buckets, so far

    def order(self) -> Order:
        return Order((self.base[self.bucket] * self.signed[:, None]).astype(np.float32), self.draws, [])

    def turned(self, docs: list[np.ndarray]) -> np.ndarray:
        """What these documents add to the next base of the subspace iteration, a row for each bucket."""
        out = np.zeros(self.base.shape)
        for i in range(0, len(docs), DENSE):
            for at, to, owner, terms in grouped(docs[i : i + DENSE], len(self.idf)):
                x = np.bincount(owner * BUCKETS + self.bucket[terms], self.signed[terms], (to - at) * BUCKETS).reshape(-1, BUCKETS)
                x = unit(x.astype(np.float32))
                out += x.T @ (x @ self.base)
        return np.rint(out * ONE).astype(np.int64)


def topics_of(df: np.ndarray, n_docs: int) -> Topics:
    """From the number of documents that hold each term."""
    r, terms = np.random.default_rng(7), len(df)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    draws = (r.exponential(size=(2, terms)) / idf).astype(np.float32)
    bucket, sign = r.integers(0, BUCKETS, terms), r.choice([-1.0, 1.0], terms)
    return Topics(idf, draws, bucket, sign * idf, r.normal(size=(BUCKETS, COORDINATES)).astype(np.float32))


def spreads(order: Order, place: np.ndarray) -> np.ndarray:
    """Of each node and axis: documents, sum and sum of squares."""
    node, wide = order.topic(place), 1 << len(order.cuts)
    rows = [[np.bincount(node, w, wide) for w in (None, place[:, k], place[:, k] ** 2)] for k in range(place.shape[1])]
    return np.rint(np.array(rows).transpose(2, 0, 1) * np.array([1, ONE, ONE])).astype(np.int64)


def widest(sums: np.ndarray) -> np.ndarray:
    """The axis of most variance of each node."""
    n, total, squares = (sums[:, :, i].astype(float) for i in range(3))
    n = np.maximum(n, 1)
    return (squares / n - total / n * (total / n / ONE)).argmax(axis=1)


def bins(order: Order, axis: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Documents of each node and bin of its axis."""
    node, wide = order.topic(place).astype(np.int64), 1 << len(order.cuts)
    at = np.clip(np.floor((place[np.arange(len(place)), axis[node]] + 1) * (BINS / 2)), 0, BINS - 1).astype(np.int64)
    return np.bincount(node * BINS + at, minlength=wide * BINS).reshape(wide, BINS)


def edge(bin_: np.ndarray) -> np.ndarray:
    """The value up to which a bin goes."""
    return ((np.asarray(bin_) + 1) * (2 / BINS) - 1).astype(np.float32)


def order_of(docs: list[np.ndarray], terms: int) -> Order:
    """Fitted on the distinct terms of these documents; fitted() does it for a table."""
    topics = topics_of(np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=terms) if docs else np.zeros(terms), len(docs))
    for _ in range(PASSES * bool(docs)):
        topics.base = np.linalg.qr(topics.turned(docs).astype(np.float32))[0]
    order = topics.order()
    place = order.marks(docs)[0]
    for _ in range(DEPTH):
        axis = widest(spreads(order, place))
        upto = bins(order, axis, place).cumsum(axis=1)
        order.cuts.append((axis, edge((2 * upto >= upto[:, -1:]).argmax(axis=1))))
    return order


def coordinates(places: pa.Array) -> np.ndarray:
    return places.flatten().to_numpy().reshape(-1, COORDINATES)


def documents(b: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of a batch of ids and n."""
    return [ids_of(d, n).astype(np.int64) for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]


def fitted(tokens: DataFrame, df: np.ndarray, n_docs: int) -> tuple[Order, DataFrame]:
    """The order of content, from all documents, and a written table of their rows with first, second and place (the coordinates).
    What comes to the driver is a row for each bucket, or for each node and axis."""
    topics = topics_of(df, n_docs)
    held = tokens.where("n > 0").select("ids", "n")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker that has encoded doesn't need its table any more
        out = np.zeros(topics.base.shape, dtype=np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                out += topics.turned(documents(b.slice(i, ROWS)))
        yield pa.record_batch([pa.array(np.arange(BUCKETS)), *(pa.array(np.ascontiguousarray(x)) for x in out.T)], names=["bucket", *axes])

    axes = [f"c{k}" for k in range(COORDINATES)]
    for _ in range(PASSES * bool(n_docs)):
        made = held.mapInArrow(turned, "bucket long, " + ", ".join(f"{c} long" for c in axes)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in axes]).toPandas()
        topics.base = np.linalg.qr(made.sort_values("bucket")[axes].to_numpy(dtype=np.float32))[0]
    order = topics.order()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                some = b.slice(i, ROWS)
                place, least, _ = order.marks(documents(some.select(["ids", "n"])))
                flat = pa.array(place.ravel(), pa.float32())
                own = [*(pa.array(np.ascontiguousarray(x)) for x in least.T), pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * COORDINATES, pa.int32()), flat)]
                yield pa.record_batch([*some.columns, *own], names=[*some.schema.names, "first", "second", "place"])

    kind = dict(tokens.dtypes)["id"]
    docs = written(tokens.where("n > 0").mapInArrow(marked, f"id {kind}, row long, n long, ids binary, first int, second int, place array<float>"), "marked")
    # coordinates are few bytes of a row: a task takes those of several files. What finds nodes needs the cuts alone, not the terms' loads
    places = docs.select("place").coalesce(max(tokens.sparkSession.sparkContext.defaultParallelism, n_docs // PLACES))
    tree = Order(order.loads[:0], order.draws[:, :0], order.cuts)

    def summed(count, names: list[str]) -> DataFrame:
        """Sums of count(places) over the table: node, what stands beside it, and the sums."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = 0
            for b in batches:
                out = out + count(coordinates(b.column(0)))
            if not np.isscalar(out):
                out = out.reshape(*out.shape[:2], -1)
                node, beside = np.nonzero(out[:, :, 0])
                yield pa.record_batch([pa.array(node), pa.array(beside), *(pa.array(np.ascontiguousarray(x)) for x in out[node, beside].T)], names=["node", "beside", *names])

        return places.mapInArrow(run, "node long, beside long, " + ", ".join(f"{c} long" for c in names)).groupBy("node", "beside").agg(*[F.sum(c).alias(c) for c in names])

    so_far = F.sum("n").over(Window.partitionBy("node").orderBy("beside"))
    for level in range(DEPTH * bool(n_docs)):
        sums = np.zeros((1 << level, COORDINATES, 3), dtype=np.int64)
        for node, axis, *rest in summed(lambda place: spreads(tree, place), ["n", "total", "squares"]).collect():
            sums[node, axis] = rest
        axis, value = widest(sums), np.zeros(1 << level, dtype=np.float32)
        halves = summed(lambda place: bins(tree, axis, place), ["n"]).select("node", "beside", so_far.alias("upto"), F.sum("n").over(Window.partitionBy("node")).alias("all"))
        for node, bin_ in halves.where("2 * upto >= all").groupBy("node").agg(F.min("beside")).collect():
            value[node] = edge(bin_)
        order.cuts.append((axis, value))
    return order, docs


def encoded(df: DataFrame, vocabulary: str, end_id: int, terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table: id, row (a number of its own for each token of each row: that of its first), n, ids (little-endian, two bytes
    each where all fit). Each task adds a row with n -1 whose ids hold terms and in how many of its documents they are (8 bytes
    each)."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, row = library_table(vocabulary), TaskContext.get().partitionId() << 40
        end, seen = np.array([end_id], np.uint32), np.zeros(terms, dtype=np.int64)
        names = ["id", "row", "n", "ids"]
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                some = b.slice(i, ROWS)
                ids = [np.concatenate([x, end]) for x in chunks.ids(some.column(1))]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                for *_, held in grouped(ids, terms):
                    seen += np.bincount(held, minlength=terms)
                narrow = [(x.astype("<u2") if x.max() < 1 << 16 else x.astype("<u4")).tobytes() for x in ids]
                yield pa.record_batch([some.column(0), pa.array(row + np.cumsum(n) - n), pa.array(n), pa.array(narrow, pa.binary())], names=names)
                row += int(n.sum())
            empty = b.column(0)[:0]
        if row & ((1 << 40) - 1):
            at = np.flatnonzero(seen)
            yield pa.record_batch([pa.nulls(1, empty.type), pa.array([-1]), pa.array([-1]), pa.array([at.tobytes() + seen[at].tobytes()], pa.binary())], names=names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"id {kind}, row long, n long, ids binary"), "tokens")


def ordered(docs: DataFrame, order: Order) -> DataFrame:
    """fitted()'s rows with their topic in the place of the coordinates; the ids stay in the JVM."""
    topic = F.lit(0)
    if order.cuts:
        levels = F.array(*[F.struct(F.lit(axis.astype(np.int32)).alias("axis"), F.lit(value.astype(np.float32)).alias("value")) for axis, value in order.cuts])
        topic = F.aggregate(levels, F.lit(0), lambda node, level: 2 * node + (F.get("place", F.get(level["axis"], node)) > F.get(level["value"], node)).cast("int"))
    return docs.withColumn("topic", topic).drop("place")


def ids_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2").astype(np.uint32)


def frequencies(tokens: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents, tokens: over the whole table. As many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker that has encoded doesn't need its table any more
        for b in batches:
            for data in b.column(0).to_pylist():
                term, docs = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.record_batch([pa.array(term), pa.array(docs)], names=["term", "docs"])

    counts = tokens.where("n < 0").select("ids").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toPandas()
    n_docs, n_tokens = tokens.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = np.zeros(terms, dtype=np.int64)
    out[counts.term.to_numpy(dtype=np.int64)] = counts.docs.to_numpy(dtype=np.int64)
    return out, n_docs, n_tokens


class Index:
    """BM25 inverted index of one shard's documents, by the idf of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        sizes = np.array([len(d) for d in docs])
        self.n, self.wide = len(docs), len(idf)
        doc, term, tf = distinct(docs, self.wide)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean_length))).astype(np.float32)
        self.of_doc, self.terms = np.searchsorted(doc, np.arange(len(docs) + 1)), term.astype(np.int32)
        by_term = np.argsort(term.astype(np.uint16 if self.wide <= 1 << 16 else np.int64), kind="stable")
        self.doc, self.weight, self.term = doc[by_term].astype(np.int32), weight[by_term], self.terms[by_term]
        self.first = np.searchsorted(self.term, np.arange(self.wide + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents that weren't forgotten, by all distinct terms of the seed."""
        terms = self.terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        first = self.first[terms]
        sizes = self.first[terms + 1] - first
        upto = np.cumsum(sizes)
        at = np.repeat(first - (upto - sizes), sizes) + np.arange(int(upto[-1]))
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)

    def forget(self, used: np.ndarray) -> None:
        """Take the postings of used documents out."""
        on = ~used[self.doc]
        self.doc, self.weight, self.term = self.doc[on], self.weight[on], self.term[on]
        self.first = np.searchsorted(self.term, np.arange(self.wide + 1))


def fill(docs: list[np.ndarray], index: Index, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): every id of every document once. The first unused document is a seed
    where no document was cut."""
    used = np.zeros(len(docs), dtype=bool)
    sizes = [len(d) for d in docs]
    free, held = len(docs), len(docs)
    sequence, room, next_ = 0, window, 0
    seed, at = -1, 0
    while True:
        if seed < 0:
            while next_ < len(docs) and used[next_]:
                next_ += 1
            if next_ == len(docs):
                return
            seed, at = next_, 0
            used[seed] = True
            free -= 1
        while sizes[seed] - at >= room:  # it fills what is left
            yield seed, at, room, sequence, window - room
            sequence, at, room = sequence + 1, at + room, window
        if at == sizes[seed]:
            seed = -1
            continue
        yield seed, at, sizes[seed] - at, sequence, window - room
        room -= sizes[seed] - at
        if free < 0.7 * held:
            index.forget(used)
            held = free
        left = np.flatnonzero(~used)
        ahead, seed = left[np.argsort(-index.scores(seed)[left], kind="stable")].tolist(), -1
        for k in ahead:
            used[k] = True
            free -= 1
            if sizes[k] >= room:
                seed, at = k, 0
                break
            yield k, 0, sizes[k], sequence, window - room
            room -= sizes[k]


def pack(df: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (binary, little-endian unsigned 32-bit)."""
    from tokenizers import Tokenizer

    terms = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), end_id + 1)
    tokens = encoded(df, vocabulary, end_id, terms, id_col, text_col)
    docs, n_docs, n_tokens = frequencies(tokens, terms)
    order, marked = fitted(tokens, docs, n_docs)
    dropped(tokens)  # marked has all of it
    idf, mean = np.log1p((n_docs - docs + 0.5) / (docs + 0.5)), n_tokens / max(n_docs, 1)

    def packed(ids: pa.Array, rows: np.ndarray, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first: dict[int, int] = {}
        made = []
        for k, start, length, sequence, offset in fill(held, Index(held, idf, mean), window):
            made.append((k, start, length, first.setdefault(sequence, int(rows[k]) + start), offset))
        for i in range(0, len(made), 4096):
            k, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*made[i : i + 4096]))
            own = [held[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(k.tolist(), start.tolist(), length.tolist())]
            columns = [ids.take(pa.array(k)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array([len(held[d]) for d in k.tolist()], pa.int64()), pa.array(sequence), pa.array(offset)]
            yield pa.record_batch(columns + [pa.array(own, pa.binary())] * with_ids, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names, rows, held, sizes = [], [], [], []

        def shards(least: int) -> Iterator[pa.RecordBatch]:
            """Shards of what is held, as long as it is least tokens or more."""
            nonlocal names, rows, held, sizes
            while (total := sum(sizes)) and total >= least:
                cut = len(sizes) if total < 1.5 * shard_tokens else int(np.searchsorted(np.cumsum(sizes), shard_tokens)) + 1
                ids = pa.concat_arrays(names)
                yield from packed(ids[:cut], np.concatenate(rows)[:cut], held[:cut])
                names, rows, held, sizes = [ids[cut:]], [np.concatenate(rows)[cut:]], held[cut:], sizes[cut:]

        for b in batches:
            n = b.column(2).to_pylist()
            names.append(b.column(0))
            rows.append(b.column(1).to_numpy())
            held += [ids_of(d, k) for d, k in zip(b.column(3).to_pylist(), n)]
            sizes += n
            yield from shards(int(1.5 * shard_tokens))
        yield from shards(1)

    by = ["topic", "first", "second", "tie"]
    dealt = ordered(marked, order).withColumn("tie", F.xxhash64("row")).repartitionByRange(max(1, -(-n_tokens // shard_tokens)), *by).sortWithinPartitions(*by)
    kind = dict(tokens.dtypes)["id"]
    made = dealt.select("id", "row", "n", "ids").mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    return made.withColumnRenamed("id", id_col)
