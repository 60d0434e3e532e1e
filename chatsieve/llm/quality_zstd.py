"""Quality by compression: two zstandard dictionaries and a calibrated difference.

One dictionary is trained on pieces of good labelled texts, one on pieces of
bad ones.  A text is compressed in blocks of 512 bytes with either, so the
dictionary and not the text's own past explains it; the difference of the two
sizes over their sum says which class it resembles.  A logistic curve, fitted
on labelled texts that the dictionaries did not see, makes it a probability.

Training takes a bounded sample: about ``PER_CLASS`` labelled rows a class,
half for the dictionary (at most ``PIECES`` blocks a row, spread over the
text) and half, whole, for the curve.  Scoring is a map over all whole texts.

Defined results: null and empty texts have difference 0, so they score what
the curve says there; without labels of both classes the score is the share
of good labels (0.5 without any); repeated rows score alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text, in_remainder, ship_package

BLOCK = 512
LEVEL = 3
DICT_BYTES = 112_640
PER_CLASS = 2_000
PIECES = 12


def pieces(text: bytes, block: int = BLOCK, most: int = PIECES) -> list[bytes]:
    """At most ``most`` blocks, evenly spread over the whole text."""
    starts = range(0, len(text), block)
    step = max(1, -(-len(starts) // most))
    return [text[i:i + block] for i in starts[::step]]


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Sizer:
    """Normalised difference of the sizes of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False)
        self.good, self.bad = compressor(good), compressor(bad)

    def difference(self, text: bytes) -> float:
        good = bad = 0
        for i in range(0, len(text), BLOCK):
            part = text[i:i + BLOCK]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
        return (bad - good) / (bad + good) if text else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, lightly damped."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """About ``per_class`` rows (doc_id, text, y) of either class, chosen by a hash of the id."""
    seen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("lid"), F.col("quality").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64("lid"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("y") == 1, min(1.0, per_class / max(1, n.get(1, 0)))).otherwise(
        min(1.0, per_class / max(1, n.get(0, 0))))
    picked = seen.where(chance < share)
    # About 2 * per_class narrow rows, so this side may be broadcast.
    return docs.join(F.broadcast(picked), docs["doc_id"] == picked["lid"]).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The two dictionaries and the curve, from rows (doc_id, text) and (doc_id, quality)."""
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, per_class).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, y, p) for i, t, y in zip(b["doc_id"], b["text"], b["y"])
                                for p in pieces(t.encode())], columns=["doc_id", "y", "piece"])

    got = sample.where("half = 0").select("doc_id", "text", "y").mapInPandas(cut, "doc_id long, y int, piece binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["piece"])))
    content = {y: [bytes(r["piece"]) for r in got if r["y"] == y] for y in (0, 1)}
    if not content[0] or not content[1]:
        n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"rate": n.get(1, 0) / sum(n.values()) if n else 0.5}
    model = {"good": train_dictionary(content[1]), "bad": train_dictionary(content[0])}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Sizer(model["good"], model["bad"])
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "d": [s.difference(t.encode()) for t in b["text"]]})

    # The classes were sampled at different rates; the curve is fitted to their true shares.
    points = sample.where("half = 1").select("text", "y").mapInPandas(measure, "y int, d double").collect()
    n = {r["y"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("quality").cast("int").alias("y"))
         .agg(F.count(F.lit(1)).alias("n")).collect()}
    points.sort()
    y = np.array([p["y"] for p in points], dtype=float)
    if not 0 < y.sum() < len(y):
        model["curve"] = (0.0, 40.0)
        return model
    b0, b1 = fit_curve(np.array([p["d"] for p in points]), y)
    b0 += np.log((n[1] / n[0]) / (y.sum() / (len(y) - y.sum())))
    model["curve"] = (float(b0), b1)
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score."""
    df = id_and_text(docs, id_col, text_col)
    if "rate" in model:
        return df.select("doc_id", F.lit(float(model["rate"])).alias("score"))
    ship_package(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        s, (b0, b1) = Sizer(m["good"], m["bad"]), m["curve"]
        for b in batches:
            d = np.array([s.difference(t.encode()) for t in b["text"]], dtype=float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1.0 / (1.0 + np.exp(-np.clip(b0 + b1 * d, -30, 30)))})

    return df.mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on labels whose id leaves another remainder than 0 by 5; score every document."""
    rows = id_and_text(docs)
    fold = in_remainder(F.col("doc_id"), 5, 0)
    model = train(rows, labels.select("doc_id", "quality").where(~fold))
    return score(rows, model).select("doc_id", fold.alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))
