"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of a document's characters (ASCII letters in lower case), counted once per
document and hashed into ``2 ** BITS`` places. From the labelled documents each place gets the ratio

    r = log((1 + toxic documents with it) / (total)) - log((1 + other documents with it) / (total))

and a logistic regression is fitted to the features multiplied by ``r``. Places that say little are
left out by their deviation from independence, which keeps long clean documents from collecting
many small weights. Scoring is one table look-up per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import column, fold, labelled_texts, map_pandas, narrow, stratified

BITS, SIZES = 20, (3, 4, 5, 6, 7)
#: Bounds of the training sample: documents of a label, and the length up to which a text is taken for training.
PER_LABEL, TRAIN_CHARS = 1000, 12_000
#: Places kept, and the least number of training documents that hold one.
FEATURES, LEAST = 6000, 4
STEPS, RATE, RIDGE = 250, 0.05, 2e-3
THRESHOLD = 0.7
#: Characters hashed at once.
SLICE = 1 << 18

_ASCII = {c: c + 32 for c in range(65, 91)}
_STEP = np.uint32(0x9E3779B1)


def places(text: str) -> Iterator[np.ndarray]:
    """Hashed places of all n-grams, in slices of bounded size; a space stands before and after the text."""
    codes = np.frombuffer(f" {text} ".translate(_ASCII).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes <= 32) & (codes > 0), np.uint32(32), codes)
    longest = SIZES[-1]
    for s in range(0, max(1, len(codes) - 1), SLICE):
        part = codes[s : s + SLICE + longest - 1]
        mixed = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if n > len(part):
                break
            mixed = (mixed[: len(part) - n + 1] * _STEP) ^ ((part[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B))
            if n in SIZES:
                own = mixed[:SLICE]
                yield ((own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def features(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint32), *places(text)]))


def train(texts: Sequence[str], labels: np.ndarray) -> dict[str, Any]:
    """Weights by place (already multiplied by the log-count ratios) and the intercept."""
    texts_of: dict[str, int] = {}
    for t, y in zip(texts, labels, strict=True):
        texts_of.setdefault(t, int(y))
    rows, y = [features(t) for t in texts_of], np.array(list(texts_of.values()), np.float64)
    size = 1 << BITS
    with_1 = np.bincount(np.concatenate([x for x, v in zip(rows, y, strict=True) if v == 1]), minlength=size)
    with_0 = np.bincount(np.concatenate([x for x, v in zip(rows, y, strict=True) if v == 0]), minlength=size)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((1 + with_1) / (2 + n1)) - np.log((1 + with_0) / (2 + n0))
    both = with_1 + with_0
    expected = both * n1 / len(y)
    deviation = np.where(both >= LEAST, (with_1 - expected) / np.sqrt(np.maximum(expected, 1e-9) * (1 - n1 / len(y)) + 0.5), 0)
    keep = np.argsort(-np.abs(deviation), kind="stable")[:FEATURES]
    keep = keep[np.abs(deviation[keep]) > 2]
    number = np.full(size, -1, np.int32)
    number[keep] = np.arange(len(keep))
    column_of = [c[c >= 0] for c in (number[x] for x in rows)]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in column_of])
    flat = np.concatenate([np.empty(0, np.int32), *column_of])
    scale = ratio[keep]
    # Balanced classes in the loss and in the intercept: THRESHOLD is one of a balanced probability.
    weight = np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    beta, bias = np.zeros(len(keep)), 0.0
    m, v, mb, vb = np.zeros(len(keep)), np.zeros(len(keep)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, (beta * scale)[flat], len(rows)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(flat, d[owner], len(keep)) * scale + RIDGE * beta
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        beta -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= 4 * rate * mb / (np.sqrt(vb) + 1e-8)
    table = np.zeros(size, np.float32)
    table[keep] = beta * scale
    return {"table": table, "bias": float(bias)}


def score_text(model: dict[str, Any], text: str) -> float:
    """Probability that a whole text is toxic."""
    table = model["table"]
    found = [p[table[p] != 0] for p in places(text)]
    held = np.unique(np.concatenate([np.empty(0, np.uint32), *found]))
    z = model["bias"] + float(table[held].sum(dtype=np.float64))
    return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, Any] | None:
    """Learn from about ``PER_LABEL`` documents of each label with at most ``TRAIN_CHARS`` characters, each taken whole.

    Both bounds together limit what the driver gets: the draw gives about ``2 * PER_LABEL`` rows, and the
    limit, which only many rows of one identifier can reach, takes rows by a hash, not by their identifiers.
    Rows without a label or a text are left out; None if there are not both labels.
    """
    rows = labelled.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(label_col).cast("int").alias("label"))
    rows = rows.where(f"label in (0, 1) and length(text) between 1 and {TRAIN_CHARS}")
    drawn = stratified(rows, "doc_id", "label", PER_LABEL, 2, seed=11).orderBy(F.xxhash64("doc_id", "text", F.lit(13)), "doc_id", "label", "text")
    got = drawn.limit(4 * PER_LABEL).orderBy("doc_id", "label", "text").collect()
    labels = np.array([r["label"] for r in got])
    if len(set(labels.tolist())) < 2:
        return None
    return train([r["text"] for r in got], labels)


def score(df: DataFrame, model: dict[str, Any] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of each row; ``predicted`` is 1 from ``THRESHOLD`` on.

    A null text is scored like an empty one. Without a model every score is 0. Rows are independent:
    repeated rows get equal results, a null identifier is passed on, and other columns are not read.
    """
    rows = narrow(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            scores = [score_text(known, t or "") if known else 0.0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores})

    out = map_pandas(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col, 3) == 1, F.lit(True))


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents of two of three folds and score all of ``docs``."""
    model = fit(labelled_texts(docs, labels.where(~held_out()), "toxic", 2 * PER_LABEL), label_col="label")
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
