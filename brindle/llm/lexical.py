"""Ranked lexical search: every document ranked for every item by a blocked sparse matrix product.

Items are the rows of a sparse matrix of term multiplicities, documents the columns of a term-document matrix of int64 impacts.
A task holds a block of documents at a time: it makes the block's postings (sorted by term), then each item's row of the product
by merging the postings of its terms into one accumulator (Gustavson), and takes the block's best k. The best of a task's blocks
are merged as it goes, so that a task gives k rows for an item at most; a window over those, limited before the shuffle, ends it.

Scores follow a fixed law in 64-bit integers. N is the documents with a term, L all their terms, n a document's, df the
documents holding a term, tf its occurrences there:
w = floor(1000 ln((2N+2)/(2df+1))), m = 50 + (50 n N) div L, score = sum of w * ((10^9 tf) div (1000 tf + 20 m)).

Items go to the tasks as a broadcast of one block of items, whose bytes are counted first: at most BLOCK_BYTES (an item beyond
that is a block of its own); more items are further blocks, each a pass over the documents. Documents are read whole, and all
counts are over all of them.

Defined results: a null or empty text has no term and is in no ranking; rows of a repeated id are rows of their own; equal scores by
ascending id, null ids first; each row of the items is an item, also of a repeated or null id; an item without a term
or a match has no rows; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.store import written

K = 50
#: Bytes of text in a block of items, documents in a block of a task.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 8192
#: Bytes of a term: ASCII letters and digits and all beyond ASCII; A-Z become a-z, all others a space.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items: their ids, the vocabulary, and term numbers with multiplicities of each item."""

    def __init__(self, rows: list[tuple[int | None, bytes]], multiplicity: bool):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        for _, text in rows:
            numbers = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text)], np.int64)
            held, times = np.unique(numbers, return_counts=True)
            self.rows.append((held, times if multiplicity else np.ones_like(times)))


def _item_blocks(items: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """Blocks of items of at most BLOCK_BYTES each, or of one item. Rows that are no more than one block stay whole."""
    rows = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text") + 16
    total = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total <= BLOCK_BYTES:
        return [rows] if total else []
    n = 2 * math.ceil(total / BLOCK_BYTES)
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        held = rows.groupBy(block.alias("block")).agg(F.sum(size.cast("long")).alias("size"), F.count_distinct("item", "text").alias("n")).orderBy("block").collect()
        if all(r["size"] <= BLOCK_BYTES or r["n"] <= 1 for r in held) or n > 1 << 16:
            return [rows.where(block == r["block"]) for r in held]
        n *= 2


def _counted(docs: DataFrame, shared) -> DataFrame:
    """id, n (terms of the text), terms (numbers of the vocabulary's that it holds), times: a row for each text with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.vocabulary.get
        for b in batches:
            kept, n, held, times, ends = [], [], [], [], [0]
            for row, text in enumerate(b.column(1)):
                words = terms(text.as_buffer().to_pybytes())
                if not words:
                    continue
                numbers, counts = np.unique(np.fromiter((number(w, -1) for w in words), np.int32, len(words)), return_counts=True)
                known = numbers >= 0
                kept.append(row)
                n.append(len(words))
                held.append(numbers[known])
                times.append(counts[known])
                ends.append(ends[-1] + int(known.sum()))
            joined = [np.concatenate(x).astype(t) if x else np.empty(0, t) for x, t in ((held, np.int32), (times, np.int64))]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in joined]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "times"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, times array<bigint>")


class Best:
    """The k best (score, id) so far; equal scores by id, null ids first."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        least = max(1, self.scores[-1] if len(self.scores) == self.k else 1)
        if len(scores) > self.k:
            least = max(least, np.partition(scores, len(scores) - self.k)[-self.k])
        new = np.flatnonzero(scores >= least)
        if not len(new):
            return
        s, i, known_ = np.append(self.scores, scores[new]), np.append(self.ids, ids[new]), np.append(self.known, known[new])
        order = np.lexsort((i, known_, -s))[: self.k]
        self.scores, self.ids, self.known = s[order], i[order], known_[order]


def _ranked(counted: DataFrame, shared, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its number in the block), item_id, doc, score: the best k of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value, weights.value
        best = [Best(k) for _ in items.ids]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_DOCS):
                b = whole.slice(at, BLOCK_DOCS)
                id_, n, lists, times = (b.column(i) for i in range(4))
                n = n.to_numpy().astype(np.int64)
                m = 50 + (50 * n * n_docs) // n_terms
                sizes = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(n)), sizes)
                term, tf = lists.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
                impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                order = np.argsort(term, kind="stable")
                doc, impact = doc[order], impact[order]
                start = np.searchsorted(term[order], np.arange(len(w) + 1))
                known = np.array(id_.is_valid())
                ids = id_.fill_null(0).to_numpy().astype(np.int64)
                for row, (held, multiplicity) in enumerate(items.rows):
                    merged = np.zeros(len(n), np.int64)
                    for t, times_ in zip(held.tolist(), multiplicity.tolist(), strict=True):
                        of = slice(start[t], start[t + 1])
                        merged[doc[of]] += times_ * impact[of]
                    best[row].add(merged, ids, known)
        for row, found in enumerate(best):
            if len(found.scores):
                size = len(found.scores)
                made = [pa.array([row] * size, pa.int32()), pa.array([items.ids[row]] * size, pa.int64()), pa.array(found.ids, pa.int64(), mask=~found.known), pa.array(found.scores)]
                yield pa.RecordBatch.from_arrays(made, ["item", "item_id", "doc", "score"])

    return counted.mapInArrow(run, "item int, item_id bigint, doc bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = K, multiplicity: bool = False, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_col, rank (from 1), id_col, score: the k best documents of each item with a score above 0.

    multiplicity: count a term as often as the item holds it. Ids are longs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    made = []
    for number, block in enumerate(_item_blocks(items, item_col, text_col)):
        rows = sorted(((r["item"], r["text"].encode()) for r in block.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        held = Items(rows, multiplicity)
        shared = spark.sparkContext.broadcast(held)
        counted = written(_counted(texts, shared), "terms")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(held.vocabulary), np.int64)
        # a row for each term of the block at most
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
            df[r["term"]] = r["n"]
        weights = spark.sparkContext.broadcast(np.array([weight(n_docs, x) for x in df.tolist()], np.int64))
        made.append(_ranked(counted, shared, weights, n_docs, max(n_terms, 1), k).withColumn("block", F.lit(number)))
    if not made:
        return spark.createDataFrame([], f"{item_col} bigint, rank int, {id_col} bigint, score bigint")
    place = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    best = reduce(DataFrame.unionByName, made).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
