"""Near duplicates by SimHash fingerprints, found by meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 have it. Fingerprints link at RADIUS (3) or
fewer differing bits. Equal ones are one node, so a group of copies is one row from the first count on.

Every fingerprint emits variants of itself, at the variant's own 64 bits all that meet are compared. Two that differ in one or
two bits meet where each has flipped one bit or none. Three bits are met by one flip from one side and two from the other:
three differing bits are an odd number, so one of the two has odd parity, and two of three bits stand in the same half of the
word, so only fingerprints of odd parity flip two bits, both in one half (992 pairs, by Turan the fewest that hit every
triple). All that reach a variant by at most one flip are within two bits of one another, and all that reach it by two are
within three of each of those: a group with one near member is linked as a whole, by a star on its least near member, without
pairs. At most 1 + 64 + 2016 fingerprints reach a variant, so no group can be larger, whatever the data hold.

Before the balls are emitted, fingerprints that can't have a partner are ruled out exactly: of two that differ in three bits or
fewer, one half differs in at most one bit, so one side's half lies in the other's ball of radius one (66 keys of 33 bits).

Defined results: a null, empty or blank text has fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle; repeated rows and ids are rows of their own; a null id takes no part in the least id of a component, whose rows then all
have null if no other is there; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.llm.jaccard import components
from brindle.llm.store import written

WORDS, SEED, RADIUS = 3, 42, 3
#: Shingles whose bits are counted at once.
PIECE = 1 << 16
PLACES, BITS = np.arange(0, 2048, 256), np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: No flip and every single flip; two flips within a half.
NEAR = [0, *(_signed(1 << i) for i in range(64))]
FAR = [_signed(1 << i | 1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
#: Flips within 32 bits, of at most one bit.
HALF = [0, *(1 << i for i in range(32))]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64 bits as a signed long. Only ASCII letters are lower-cased and only ASCII white space parts words."""
    held = (text or b"").lower().split()
    if not held:
        return 0
    said = b" ".join(held)
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
    starts, n = np.append(0, ends[:-1]), max(len(held) - words + 1, 1)
    ends = ends[min(words, len(held)) - 1 :] - 1
    seen = np.zeros(2048, np.int64)
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        shingles = map(said.__getitem__, map(slice, starts[at:to].tolist(), ends[at:to].tolist()))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), ">u8", to - at)
        # how often each of the 8 bytes has each value, then their bits
        seen += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + PLACES).ravel(), minlength=2048)
    ones = (seen.reshape(8, 256) @ BITS).ravel()
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, print: a row for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words) for t in b.column(1)), pa.int64(), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["id", "print"])

    held = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, print bigint")


def with_partner(prints: DataFrame) -> DataFrame:
    """The distinct prints of which another agrees in one half but for a bit at most; all that have a link are among them."""
    low = F.col("print").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("print", 32).bitwiseOR(F.lit(1 << 32))
    halves = prints.select("print", F.explode(F.array(low, high)).alias("half"))
    # written, so that a crowded half is split by the join
    exact = written(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")), "halves")
    probes = halves.select("print", "half", F.explode(F.array(*map(F.lit, HALF))).alias("flip"))
    probes = probes.select("print", F.col("half").bitwiseXOR(F.col("flip").cast("long")).alias("half"), (F.col("flip") != 0).alias("other"))
    # by sorting: Spark takes an explode's rows for as many as its input's, and would broadcast the 66 probes of every print
    return probes.join(exact.hint("merge"), "half").where("other OR n > 1").select("print").distinct()


def links(prints: DataFrame) -> DataFrame:
    """a, b: stars over the distinct prints whose components are those of all links."""
    odd = F.bit_count("print") % 2 == 1
    near, far = (F.array(*map(F.lit, masks)).cast("array<bigint>") for masks in (NEAR, FAR))
    flips = F.explode(F.when(odd, F.concat(near, far)).otherwise(near))
    variants = with_partner(prints).select("print", flips.alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("variant"))
    reached = F.bit_count(F.col("print").bitwiseXOR(F.col("variant")))
    centre = F.min(F.when(reached <= 1, F.col("print"))).over(Window.partitionBy("variant"))
    return variants.select("print", centre.alias("centre")).where("print <> centre").select(F.col("print").alias("a"), F.col("centre").alias("b")).distinct()


def near_duplicates(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id (the smallest id that links reach, the own included)."""
    docs = written(fingerprints(df, words, id_col, text_col), "prints")
    prints = written(docs.groupBy("print").agg(F.min("id").alias("least")), "nodes")
    rooted = components(links(prints.select("print")))
    placed = prints.join(rooted, prints["print"] == rooted["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that a print of very many rows is split by the join
    known = written(placed.join(firsts, "root").select("print", "component_id"), "known")
    said = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return docs.join(known, "print").select(F.col("id").alias(id_col), said.alias("fingerprint"), "component_id")
