"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased text, relative
frequency times inverse document frequency. Training is
follow-the-regularised-leader with elastic-net penalties; a temperature fitted
on held-back rows calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .pretoken import LETTER, class_table

BITS, ORDERS = 16, 3
#: Most labelled rows that the fit reads, over all languages alike (but LEAST_ROWS of each), and most bytes of n-grams that come to the driver.
MOST_ROWS, LEAST_ROWS, MOST_BYTES = 4096, 16, 256 << 20
#: Numbers that a step of a prediction holds: characters times languages.
STEP = 8_000_000
UNKNOWN = "und"


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams (orders x characters) of all texts, each text's characters' bounds, and its letters.

    A text ends in two line ends, so an n-gram never reaches into the next one.
    """
    low = [t.lower() if t else "" for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join([t + "\n\n" for t in low]).encode("utf-32-le"), "<u4")
    begin = np.cumsum(size + 2) - size - 2
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    bounds = np.append(0, np.cumsum(size))
    out, mixed = np.empty((ORDERS, len(at)), np.uint16), np.zeros(len(at), np.uint32)
    for n in range(ORDERS):
        mixed = (mixed ^ points[at + n]) * np.uint32(0x9E3779B1) + np.uint32(n + 1)
        mixed ^= mixed >> np.uint32(15)
        out[n] = (mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    letters = np.append(0, np.cumsum(class_table()[points[at]] == LETTER))
    return out, bounds, letters[bounds[1:]] - letters[bounds[:-1]]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages), times inverse document frequency and scale
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        hashed, bounds, letters = grams(texts)
        logits = np.zeros((len(texts), len(self.languages)))
        size = np.diff(bounds)
        some = np.flatnonzero(size)
        step = max(STEP // len(self.languages), 1)
        for a in range(0, int(bounds[-1]), step):  # a text may reach over several steps
            b = min(a + step, int(bounds[-1]))
            gained = self.weights[hashed[0, a:b]]
            for n in range(1, ORDERS):
                gained += self.weights[hashed[n, a:b]]
            own = some[(bounds[:-1][some] < b) & (bounds[1:][some] > a)]
            logits[own] += np.add.reduceat(gained, np.maximum(bounds[:-1][own] - a, 0), axis=0, dtype=np.float64)
        logits[some] /= size[some, None]
        share = softmax((logits + self.bias) / self.temperature)
        best = share.argmax(1)
        known = letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, share.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 3) -> Model | None:
    """Fit on (language, feature numbers, relative frequencies); every fifth row is held back for the temperature."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    holders = np.zeros(1 << BITS)
    for _, at, _ in rows:
        holders[at] += 1
    idf = np.log((1 + len(rows)) / (1 + holders)) + 1
    scale = 1 / max(float(np.mean([np.linalg.norm(v * idf[at]) for _, at, v in rows])), 1e-9)
    data = [(number[x], at, v * idf[at] * scale) for x, at, v in rows]
    order = np.random.default_rng(seed).permutation(len(data))
    held = {int(i) for i in order[::5]} if len(data) >= 10 else set()
    z, n = np.zeros((1 << BITS, len(languages))), np.zeros((1 << BITS, len(languages)))
    bias, bias_n = np.zeros(len(languages)), np.zeros(len(languages))

    def lazy(at: np.ndarray) -> np.ndarray:
        small = np.abs(z[at]) <= l1
        return np.where(small, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.tolist():
            if i in held:
                continue
            y, at, v = data[i]
            w = lazy(at)
            logit = v @ w + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += p * p
            bias -= 0.1 * p / np.sqrt(1 + bias_n)
    weights = lazy(np.arange(1 << BITS))
    temperature = 1.0
    if held:
        logits = np.array([data[i][2] @ weights[data[i][1]] + bias for i in sorted(held)])
        truth = np.array([data[i][0] for i in sorted(held)])
        tried = np.geomspace(0.05, 20, 121)
        loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in tried]
        temperature = float(tried[int(np.argmin(loss))])
    return Model(languages, (weights * (idf * scale)[:, None]).astype(np.float32), bias, temperature)


def fit(docs: DataFrame, may_learn: Column, label: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Train on at most about MOST_ROWS labelled rows where ``may_learn`` holds; None if there are none.

    Every language gives the same number of rows as far as it has them, chosen
    by a hash of the id; their whole texts are read. No language is left out:
    each gives LEAST_ROWS even if that goes beyond MOST_ROWS. Rows whose n-grams
    would take the driver beyond its share of MOST_BYTES are passed over.
    """
    rows = docs.where(may_learn & F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(label).cast("string").alias("lang")).where("t <> ''")
    have = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not have:
        return None
    each = max(MOST_ROWS // len(have), LEAST_ROWS)
    share = F.create_map(*[F.lit(x) for lang, n in have.items() for x in (lang, min(1.0, each / n))])
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                hashed, bounds, _ = grams(part.column("t").to_pylist())
                at, share = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids, count = np.unique(hashed[:, a:b], return_counts=True)
                    at.append(ids.astype("<u2").tobytes())
                    share.append((count / max(b - a, 1)).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["id", "lang", "at", "share"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = stored(chosen.select("id", "lang", "t").mapInArrow(run, f"id {kind}, lang string, at binary, share binary"), "grams")
    own = F.octet_length("at") + F.octet_length("share")
    before = F.sum(own).over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "at")) - own
    got = told.withColumn("before", before).where(F.col("before") <= MOST_BYTES // len(have)).drop("before").collect()
    got.sort(key=lambda r: (r.id is None, 0 if r.id is None else r.id, r.at))
    return train([(r.lang, np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.share, "<f4").astype(float)) for r in got])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score) for every row of ``docs``; ``row`` is the whole input row as a struct.

    Only the text is an input of a prediction. A text that is null, empty or
    has no letter is ``und`` with score 0, and so is every text where there was
    nothing to learn from. Repeated rows are each returned; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = source.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "row", field=text_col):
                texts = pc.struct_field(part.column("row"), text_col).to_pylist()
                found, score = model.predict(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return source.mapInArrow(run, f"row {kind}, lang_pred string, score double")
