"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole text is encoded (the shares of word shapes
and the mean of learned vectors of hashed words, through one tanh layer); a gated attention network weighs the passages,
and the weighted mean of their codes gives the document's score. Only document labels are needed: what the attention
weighs in a passage is learned from them.

The model is fitted on the driver from at most SAMPLE labelled documents, those of the smallest hash of the id, and the first
FIT_CHARS code points of each; these bounds hold for the fit only. It is a few thousand numbers, sent with the tasks. All
documents are scored, each passage by passage of its whole text.

Defined results: a null or empty text is one passage without words; repeated rows are scored each, alike; null ids are
scored but never learned from; labels of ids without a document are left out, and of several labels of an id the smallest
counts, as does of several rows of an id the smallest text, a null one first; without labels of both kinds the score is the smoothed share of label 1; an empty table gives no rows; other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE, BUCKETS, VECTOR, CODE, GATE, SAMPLE = 48, 2048, 8, 16, 8, 4000
FIT_CHARS = 200_000
#: Passages of one matrix while scoring, which bounds memory on very long texts.
BATCH = 4096
SHAPES = 32


@lru_cache(maxsize=200_000)
def word_code(word: bytes) -> int:
    """bucket * SHAPES + shape: how long the word is, how it is written and what it ends with."""
    text = word.decode("utf-8", "replace")
    letters = sum(map(str.isalpha, text))
    if letters == 0:
        kind = 0 if any(map(str.isdigit, text)) else 1
    elif any(c in "#*$%&|<>{}=\\~^" for c in text):
        kind = 2
    elif letters > 1 and text.isupper():
        kind = 3
    elif any(map(str.isdigit, text)):
        kind = 4
    elif text[0].isupper():
        kind = 5
    else:
        kind = 6
    end = 0 if text[-1:].isalnum() else 1 if text[-1:] in ".!?" else 2
    long = 0 if letters < 4 else 1 if letters < 11 else 2
    shape = min(SHAPES - 1, kind * 4 + (end if kind < 5 else (long if end == 0 else 3)))
    return crc32(word.lower()) % BUCKETS * SHAPES + shape


def codes(text: str | None) -> np.ndarray:
    return np.fromiter(map(word_code, text.encode("utf-8", "replace").split()), dtype=np.int64) if text else np.empty(0, dtype=np.int64)


class Bag:
    """The words of some documents, cut into passages."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.passages = np.maximum(1, -(-sizes // PASSAGE))
        words = np.concatenate(texts) if len(texts) else np.empty(0, dtype=np.int64)
        self.bucket, self.shape = words // SHAPES, words % SHAPES
        first = np.cumsum(self.passages) - self.passages
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.of_word = np.repeat(first, sizes) + place // PASSAGE
        self.n = int(self.passages.sum())
        self.of_passage = np.repeat(np.arange(len(sizes)), self.passages)
        self.words = np.maximum(1, np.bincount(self.of_word, minlength=self.n)).astype(float)

    def shapes(self) -> np.ndarray:
        return np.bincount(self.of_word * SHAPES + self.shape, minlength=self.n * SHAPES).reshape(self.n, SHAPES) / self.words[:, None]

    def mean(self, vectors: np.ndarray) -> np.ndarray:
        got = vectors[self.bucket]
        return np.stack([np.bincount(self.of_word, got[:, k], minlength=self.n) for k in range(vectors.shape[1])], axis=1) / self.words[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    wide = SHAPES + VECTOR
    return {"E": r.normal(0, 0.1, (BUCKETS, VECTOR)), "W": r.normal(0, wide**-0.5, (wide, CODE)), "c": np.zeros(CODE), "V": r.normal(0, CODE**-0.5, (CODE, GATE)), "U": r.normal(0, CODE**-0.5, (CODE, GATE)), "w": np.zeros(GATE), "o": r.normal(0, CODE**-0.5, CODE), "b": np.zeros(1)}


def forward(p: dict[str, np.ndarray], bag: Bag) -> dict[str, np.ndarray]:
    x = np.concatenate([bag.shapes(), bag.mean(p["E"])], axis=1)
    h = np.tanh(x @ p["W"] + p["c"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    return {"x": x, "h": h, "v": v, "u": u, "e": (v * u) @ p["w"]}


def gradient(p: dict[str, np.ndarray], bag: Bag, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(weighted cross-entropy of a batch of documents, its derivative by each parameter)."""
    n, f = len(labels), forward(p, bag)
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag.of_passage, f["e"])
    a = np.exp(f["e"] - top[bag.of_passage])
    a /= np.bincount(bag.of_passage, a)[bag.of_passage]
    z = np.zeros((n, CODE))
    np.add.at(z, bag.of_passage, a[:, None] * f["h"])
    raw = z @ p["o"] + p["b"]
    loss = float((weight * (np.logaddexp(0, raw) - labels * raw)).sum() / n)
    dy = (sigmoid(raw) - labels) * weight / n
    g = {"o": z.T @ dy, "b": np.array([dy.sum()])}
    at = (dy[:, None] * p["o"])[bag.of_passage]
    da = (at * f["h"]).sum(1)
    de = a * (da - np.bincount(bag.of_passage, a * da)[bag.of_passage])
    g["w"] = (f["v"] * f["u"]).T @ de
    dvu = de[:, None] * p["w"]
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
    dx = (a[:, None] * at + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    g["W"], g["c"] = f["x"].T @ dx, dx.sum(0)
    de_ = (dx @ p["W"].T)[:, SHAPES:] / bag.words[:, None]
    g["E"] = np.stack([np.bincount(bag.bucket, de_[bag.of_word, k], minlength=BUCKETS) for k in range(VECTOR)], axis=1)
    return loss, g


def learn(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over batches of documents; classes weigh alike."""
    p, r = start(seed), np.random.default_rng(seed)
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            _, g = gradient(p, Bag([texts[j] for j in some]), labels[some], weight[some])
            t += 1
            for k in p:
                grad = g[k] + decay * p[k] * (k != "b")
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.001 * (grad**2 - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return p


def score(p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """One number for each document. Passages go through in batches; a document's attention is summed over batches."""
    n = len(texts)
    # -1e300: below any, and its difference with itself is 0
    top, total, z = np.full(n, -1e300), np.zeros(n), np.zeros((n, CODE))
    part: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if not part:
            return
        bag = Bag(part)
        f, own = forward(p, bag), np.asarray(owner)
        who = own[bag.of_passage]
        new = top.copy()
        np.maximum.at(new, who, f["e"])
        shrink = np.exp(np.maximum(top - new, -700.0))
        a = np.exp(f["e"] - new[who])
        total[:] = total * shrink + np.bincount(who, a, minlength=n)
        z[:] *= shrink[:, None]
        z[:] += np.stack([np.bincount(who, a * f["h"][:, k], minlength=n) for k in range(CODE)], axis=1)
        top[:] = new
        part.clear()
        owner.clear()

    held = 0
    for i, words in enumerate(texts):
        for at in range(0, max(1, len(words)), BATCH * PASSAGE):
            part.append(words[at : at + BATCH * PASSAGE])
            owner.append(i)
            held += len(part[-1]) // PASSAGE + 1
            if held >= BATCH:
                flush()
                held = 0
    flush()
    return sigmoid((z / np.maximum(total, 1e-300)[:, None]) @ p["o"] + p["b"]) if n else np.empty(0)


def held_out(id_: Column) -> Column:
    """True for the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most sample ids, one row of each; a null text is smaller than any other
    named = documents.select(F.col(id_col).alias("id"), F.struct(F.col(text_col).isNotNull().alias("some"), F.substring(F.col(text_col), 1, FIT_CHARS).alias("text")).alias("t")).join(F.broadcast(chosen), "id")
    rows = named.groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("id", "t.text", "y").toPandas().sort_values("id")
    y = rows.y.to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        p = {k: np.zeros_like(v) for k, v in start().items()}
        share = (y.sum() + 1) / (len(y) + 2)
        return p | {"b": np.array([np.log(share / (1 - share))])}
    return learn([codes(t) for t in rows.text], y)


def classify(documents: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    small = {k: v.astype(np.float64) for k, v in model.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[float] = []
            for i in range(0, len(b), 256):
                got.extend(score(small, [codes(t) for t in b.text.iloc[i : i + 256]]))
            yield pd.DataFrame({"id": b.id, "score": np.asarray(got, dtype=float)})

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of documents that the model predicts as good, with all their columns."""
    import pyarrow as pa

    small, at = {k: v.astype(np.float64) for k, v in model.items()}, documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                yield some.filter(pa.array(score(small, [codes(t) for t in some.column(at).to_pylist()]) >= 0.5))

    return documents.mapInArrow(run, documents.schema)
