"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1; for each bit a binary n-gram
classifier (mean log ratio of the n-gram frequencies of the languages on its
two sides) predicts the bit.  Decoding chooses the codeword with the least
sum of logistic losses, each bit weighted by how well its classifier did on
the sample; a small gap to the second codeword flags the text as ambiguous.

N-grams are byte pairs (exactly) and byte triples (hashed to 2^17) of the lower-cased text, so
the tables have a fixed size.  Training takes a bounded sample of about
``PER_LANGUAGE`` documents a language, whole texts; its counts are summed by
Spark.  Prediction is a map over all whole texts, in slices of 1 MB.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any labelled document everything is ``und``; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text, in_remainder, ship_package, sole_tables

PER_LANGUAGE = 1_500
TOGETHER = 4 << 20
MOST_LANGUAGES = 1_000
PAIRS, TRIPLES = 1 << 16, 1 << 17
SIZE = PAIRS + TRIPLES
SLICE = 1 << 20
SHARPNESS = 8.0
AMBIGUOUS = 0.05
ACCEPTED = 0.95  # least score of a text whose language counts as known
LETTER = regex.compile(r"\p{L}")


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the byte pairs and of the byte triples that start at each byte."""
    a = raw.astype(np.uint32)
    pairs = (a[:-1] << 8) | a[1:]
    triples = (((pairs[:-1] << 8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(15)
    return pairs, triples + np.uint32(PAIRS)


def codewords(n: int, seed: int = 11, tries: int = 200) -> np.ndarray:
    """(languages, bits) of +1 and -1: every split for up to 5 languages, else the best random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [(1, *s) for s in itertools.product((1, -1), repeat=n - 1) if -1 in s]
        return np.array(cols, dtype=float).T
    rnd, best, far = np.random.default_rng(seed), None, -1
    for _ in range(tries):
        code = rnd.choice([-1.0, 1.0], size=(n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T + 2 * code.shape[1] * np.eye(n)).min()
        if apart > far:
            best, far = code, apart
    return best


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """(texts, bits): mean weight of each text's n-grams; texts are taken together up to ``TOGETHER`` characters."""
    if len(texts) > 1 and sum(map(len, texts)) > TOGETHER:
        half = len(texts) // 2
        return np.concatenate([margins(texts[:half], weights), margins(texts[half:], weights)])
    raws = [t.lower().encode() for t in texts]
    ends = np.cumsum([len(r) + 2 for r in raws])  # two zero bytes after each text
    buf = np.frombuffer(b"\0\0".join(raws) + b"\0\0\0\0", dtype=np.uint8)
    total = np.zeros((len(texts), weights.shape[1]))
    starts = np.concatenate([[0], ends[:-1]])
    weights = np.concatenate([weights, np.zeros((1, weights.shape[1]), dtype=weights.dtype)])
    for lo in range(0, int(ends[-1]), SLICE):
        hi = min(int(ends[-1]), lo + SLICE)
        pairs, triples = grams(buf[lo:hi + 2])
        k = hi - lo
        pairs, triples = pairs[:k], triples[:k]
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right")
        # N-grams that reach into the next text weigh nothing.
        for places, back in ((pairs, 1), (triples, 1), (triples, 2)):
            over = ends[first:last + 1] - back - lo
            places[over[(over >= 0) & (over < k)]] = SIZE
        cuts = np.maximum(starts[first:last + 1] - lo, 0)
        for places in (pairs, triples):
            total[first:last + 1] += np.add.reduceat(weights[places], cuts, axis=0)
    n = np.array([2.0 * (len(r) + 1) for r in raws])
    return total / n[:, None]


def decode(z: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its probability and whether the second is as near."""
    code, weight = model["code"], model["bit_weight"]
    loss = np.stack([(weight * np.logaddexp(0, -SHARPNESS * z * row)).sum(axis=1) for row in code], axis=1) / weight.sum()
    best = loss.argmin(axis=1)
    p = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    if code.shape[0] == 1:
        return best, np.ones(len(z)), np.zeros(len(z), dtype=bool)
    two = np.partition(loss, 1, axis=1)
    return best, p[np.arange(len(z)), best], (two[:, 1] - two[:, 0]) < AMBIGUOUS


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """Model from rows (text, lang) with a letter in the text; None without such rows."""
    ship_package(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("lang", F.xxhash64("text").alias("h"))
    n = {r["lang"]: r["n"] for r in hashed.distinct().groupBy("lang")
         .agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(n) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not n:
        return None
    langs = sorted(n)
    # Of the different texts of a language: copies neither crowd out a language nor swell the sample.
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 24)) / float(1 << 24)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / n[k]))]), F.col("lang"))
    sample = rows.where(chance < share).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables()
        for b in batches:
            for lang, own in b.groupby("lang"):
                sums = np.zeros(SIZE, dtype=np.int64)
                for t in own["text"]:
                    pairs, triples = grams(np.frombuffer(t.lower().encode() + b"\0\0\0", dtype=np.uint8))
                    sums += np.bincount(pairs[:-1], minlength=SIZE) + np.bincount(triples, minlength=SIZE)
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "at": at, "n": sums[at]})

    counted = (sample.mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at")
               .agg(F.sum("n").alias("n")).toPandas())  # at most languages x SIZE rows
    langs = sorted(counted["lang"].unique())
    if not langs:
        return None
    freq = np.zeros((len(langs), SIZE))
    for i, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        freq[i, own["at"].to_numpy()] = own["n"].to_numpy()
        freq[i] /= freq[i].sum()
    code = codewords(len(langs))
    weights = np.zeros((SIZE, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        if (code[:, b] == 1).all():
            continue
        yes, no = freq[code[:, b] == 1].mean(axis=0), freq[code[:, b] == -1].mean(axis=0)
        weights[:, b] = np.log((yes + 1e-6) / (no + 1e-6))
    model = {"langs": langs, "code": code, "weights": weights, "bit_weight": np.ones(code.shape[1])}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables()
        m = held.value
        place = {lang: i for i, lang in enumerate(m["langs"])}
        for b in batches:
            if len(b):
                sign = m["code"][[place[x] for x in b["lang"]]]
                ok = (sign * margins(list(b["text"]), m["weights"]) > 0).sum(axis=0)
                yield pd.DataFrame({"bit": range(len(ok)), "ok": ok, "n": len(b)})

    bits = (sample.mapInPandas(right, "bit int, ok long, n long").groupBy("bit")
            .agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect())
    for r in bits:
        share_right = (r["ok"] + 1) / (r["n"] + 2)
        model["bit_weight"][r["bit"]] = max(0.05, np.log(share_right / (1 - share_right)))
    return model


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, ambiguous."""
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if model is None:
        return df.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    ship_package(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables()
        m = held.value
        for b in batches:
            pred, score, unsure = ["und"] * len(b), np.zeros(len(b)), np.ones(len(b), dtype=bool)
            known = [i for i, t in enumerate(b["text"]) if t is not None and LETTER.search(t)]
            if known:
                best, p, close = decode(margins([b["text"].iloc[i] for i in known], m["weights"]), m)
                for i, k in zip(known, best):
                    pred[i] = m["langs"][k]
                score[known], unsure[known] = p, close
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": pred, "score": score, "ambiguous": unsure})

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def fold(id_col: str = "doc_id"):
    return in_remainder(F.col(f"`{id_col}`"), 4, 2)


def train_on_fold(docs: DataFrame) -> dict | None:
    """Learn from the documents whose id's crc32 leaves another remainder than 2 by 4."""
    return train(docs.where(~fold()).select("text", "lang"))


def held_out_languages(docs: DataFrame) -> DataFrame:
    return predict(docs, train_on_fold(docs)).select("doc_id", fold().alias("held_out"), "lang_pred", "score", "ambiguous")


def with_known_language(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns unchanged.

    Texts that are ``und``, ambiguous or scored below ``ACCEPTED`` go.  With a
    single learned language every text with a letter has score 1.
    """
    if model is None:
        return docs.limit(0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        m = held.value
        out = np.zeros(len(texts), dtype=bool)
        known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        if known:
            _, score, close = decode(margins([texts.iloc[i] for i in known], m["weights"]), m)
            out[known] = ~close & (score >= ACCEPTED)
        return pd.Series(out)

    return docs.where(accepted(F.col("text")))
