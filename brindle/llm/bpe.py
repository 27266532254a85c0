"""Byte-level BPE by an Aho-Corasick automaton and backtracking.

Bytes are mapped to the Latin-1 characters of the same number, so that pyahocorasick can hold the vocabulary. The
encoder takes the automaton's longest matches. Where two neighbours aren't compatible (merging would have crossed their
border) it falls back to the next shorter prefix token, and steps back where no prefix is left; a position that has failed
isn't tried again, so the time is linear in the piece. Compatibility of neighbours is memoised.

Defined results: a null text counts as empty (no ids); rows are encoded each by itself, so repeated rows, null ids and
empty tables need no special case; other columns of the input take no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.tokens import ChunkTable, said

#: Remembered pairs before that memo starts anew.
MEMO_PAIRS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.shorter: dict[int, int] = {}  # the longest proper prefix that is a token
        self.halves: dict[int, tuple[int, int]] = {}  # of the merge that makes a token
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.of_latin = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.starts, self.most = ahocorasick.Automaton(), max(map(len, ranks), default=0)
        for token, rank in ranks.items():
            prefix = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
            if prefix is not None:
                self.shorter[rank] = prefix
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            made, prefix = len(token) == 1, self.shorter.get(rank)
            while not made and prefix is not None:
                rest = ranks.get(token[self.size[prefix] :])
                if rest is not None and max(prefix, rest) < rank and self.compatible(prefix, rest):
                    self.halves[rank], self.merged[prefix, rest], made = (prefix, rest), rank, True
                prefix = self.shorter.get(prefix)
            if made:  # else no merges lead to it, and only a piece that equals it gets it
                self.starts.add_word(token.decode("latin-1"), rank)
        self.fits.clear()  # these were found before all merges were known
        self.starts.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Would the merges leave the border between these two tokens alone?

        Undo the later of the merges on both sides of the border again and again. If the two tokens that then touch it
        have a merge of their own that comes before the one just undone, the merges would have crossed the border."""
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, before, answer = left, right, 1 << 62, True
        while True:
            if (own := self.merged.get((a, b))) is not None and own < before:
                answer = False
                break
            # of equal ranks the left token's merge comes first in the text, so the right one is undone first
            later_left = a > b
            for side in (later_left, not later_left):
                if side and a in self.halves:
                    before, a = a, self.halves[a][1]
                    break
                if not side and b in self.halves:
                    before, b = b + 1, self.halves[b][0]
                    break
            else:
                break
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        self.fits[left, right] = answer
        return answer

    def longest(self, said: str) -> int:
        """The longest token that merges can make at the start of said: the automaton's path, cut back to a token."""
        n = self.starts.longest_prefix(said)
        while (rank := self.of_latin.get(said[:n])) is None or (n > 1 and rank not in self.halves):
            n -= 1
        return rank

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        said, n = piece.decode("latin-1"), len(piece)
        done = [rank for _, rank in self.starts.iter_long(said)]
        fits = self.fits
        if all(fits.get(pair) or self.compatible(*pair) for pair in zip(done, done[1:])):
            return done  # longest matches alone; only one sequence has compatible neighbours throughout
        size, shorter = self.size, self.shorter
        done, at, token = [], 0, done[0]
        failed: set[int] = set()
        while at < n:
            last = done[-1] if done else None
            while token is not None:
                end = at + size[token]
                if end not in failed and (last is None or fits.get((last, token)) or self.compatible(last, token)):
                    break
                token = shorter.get(token)
            if token is None:
                failed.add(at)
                token = done.pop()
                at -= size[token]
                token = shorter.get(token)
                continue
            done.append(token)
            at = end
            token = self.longest(said[at : at + self.most]) if at < n else None
        return done

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def _worker(path: str, pattern: str) -> tuple[ByteBpe, ChunkTable, list[str]]:
    """Once in each worker."""
    codec = ByteBpe(read_ranks(path), pattern)

    def encode(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [codec.encode(c.decode("utf-8", "replace")) for c in said(codes, starts, sizes)]
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    return codec, ChunkTable(encode), [str(i) for i in range(max(codec.bytes_of, default=0) + 1)]


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the token ids of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, _ = _worker(ranks, pattern)
        for b in batches:
            ids = [x.astype("i4") for x in table.ids(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded binary: the bytes of each row's token ids; null ids give no bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, _, _ = _worker(ranks, pattern)
        for b in batches:
            yield pd.DataFrame({"id": b.id, "decoded": [codec.decode([] if x is None else list(x)) for x in b.ids]})

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    Encoding and decoding run in one pass over the rows, so that no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, table, decimal = _worker(ranks, pattern)
        for b in batches:
            n, said_, back = [], [], []
            for found in table.ids(b.column(1)):
                ids = found.tolist()
                n.append(len(ids))
                said_.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(said_, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
