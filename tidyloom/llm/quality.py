"""Quality classifier: a convolutional network over bytes, in numpy.

A document is cut into overlapping chunks that cover all of it. ``FILTERS`` learned filters, each
``WIDTH`` bytes wide, slide over a chunk; as their input is one of 256 bytes at each place, a filter
is a table and the convolution a sum of table rows. Each filter's largest response in a chunk is
kept (max pooling), a small dense layer turns these into features of the chunk, and their largest
and mean values over all chunks give one probability for the document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import column, fold, labelled_texts, map_pandas, narrow, stratified

CHUNK, OVERLAP = 384, 64
WIDTH, FILTERS, HIDDEN = 5, 16, 12
#: Bounds of the training sample: documents of a label, and chunks of a document, spread over all of it.
PER_LABEL, SAMPLE_CHUNKS = 1500, 6
STEPS, BATCH, RATE = 500, 48, 0.02
THRESHOLD = 0.3
#: Chunks convolved at once.
ROWS = 32

Weights = dict[str, np.ndarray]


def chunks_of(data: bytes) -> np.ndarray:
    """All chunks (chunk, byte) of a text; the last is moved back to end with the text, a short text is padded with zeros."""
    if len(data) <= CHUNK:
        return np.frombuffer(data.ljust(CHUNK, b"\0"), np.uint8)[None]
    starts = np.arange(0, len(data) - OVERLAP, CHUNK - OVERLAP)
    starts = np.minimum(starts, len(data) - CHUNK)
    return np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(CHUNK)]


def responses(tables: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Responses (chunk, place, filter) of all filters at all places."""
    codes, places = chunks.astype(np.intp), CHUNK - WIDTH + 1
    total = tables[0].take(codes[:, :places], axis=0)
    for k in range(1, WIDTH):
        total += tables[k].take(codes[:, k : k + places], axis=0)
    return total


def pool(tables: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    parts = [responses(tables, chunks[s : s + ROWS]).max(axis=1) for s in range(0, len(chunks), ROWS)]
    return np.concatenate(parts)


def _document(w: Weights, hidden: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of documents, and their logits, from the features of their chunks, which stand in a row."""
    largest = np.maximum.reduceat(hidden, starts)
    mean = np.add.reduceat(hidden, starts) / counts[:, None]
    features = np.concatenate([largest, mean], axis=1)
    return features, features @ w["top"] + w["top_bias"]


def train(documents: Sequence[np.ndarray], labels: np.ndarray, seed: int = 5, steps: int = STEPS, share: float | None = None) -> Weights:
    """Fit to documents, each an array of chunks, by backpropagation through both poolings.

    ``share`` is that of label 1 where the documents were drawn from; by default that of ``labels``.
    """
    rng = np.random.default_rng(seed)
    w: Weights = {
        "tables": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)),
        "dense": rng.normal(0, 0.3, (FILTERS, HIDDEN)),
        "dense_bias": np.zeros(HIDDEN),
        "top": rng.normal(0, 0.2, 2 * HIDDEN),
        "top_bias": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    classes = [c for c in classes if len(c)]
    if share is None:
        share = labels.mean() if len(labels) else 0.5
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, BATCH // len(classes)) for c in classes])
        y = labels[pick].astype(np.float32)
        counts = np.array([len(documents[i]) for i in pick])
        starts = np.cumsum(counts) - counts
        chunks = np.concatenate([documents[i] for i in pick])
        r = responses(w["tables"], chunks)
        where = r.argmax(axis=1)
        pooled = np.take_along_axis(r, where[:, None], axis=1)[:, 0]
        hidden = np.tanh(pooled @ w["dense"] + w["dense_bias"])
        features, logit = _document(w, hidden, starts, counts)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        g = {"top": features.T @ d, "top_bias": d.sum(keepdims=True)}
        d_features = d[:, None] * w["top"]
        owner = np.repeat(np.arange(len(pick)), counts)
        d_hidden = (d_features[:, HIDDEN:] / counts[:, None])[owner]
        d_hidden += d_features[owner, :HIDDEN] * (hidden == features[owner, :HIDDEN])
        d_hidden *= 1 - hidden * hidden
        g["dense"], g["dense_bias"] = pooled.T @ d_hidden, d_hidden.sum(axis=0)
        d_pooled = d_hidden @ w["dense"].T
        g["tables"] = np.zeros_like(w["tables"])
        row, unit = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None]
        for k in range(WIDTH):
            np.add.at(g["tables"][k], (chunks[row, where + k], unit), d_pooled)
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, x in g.items():
            x = x + 1e-4 * w[k]
            mean[k] = 0.9 * mean[k] + 0.1 * x
            square[k] = 0.99 * square[k] + 0.01 * x * x
            w[k] = (w[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-6)).astype(np.float32)
    # The classes were drawn evenly; their true shares belong into the probability.
    share = min(max(float(share), 0.02), 0.98)
    w["top_bias"] = w["top_bias"] + np.float32(np.log(share / (1 - share)))
    return w


def score_texts(model: Weights | None, texts: Sequence[str | None], prior: float = 0.5) -> list[float]:
    """Probability of label 1 of each whole text; a long one is convolved in parts of bounded size."""
    if not len(texts):
        return []
    if model is None:
        return [prior] * len(texts)
    pooled, counts = [], []
    waiting: list[np.ndarray] = []
    held = 0
    for text in texts:
        chunks = chunks_of((text or "").encode("utf-8", "replace"))
        counts.append(len(chunks))
        waiting.append(chunks)
        held += len(chunks)
        if held >= 4 * ROWS:
            pooled.append(pool(model["tables"], np.concatenate(waiting)))
            waiting, held = [], 0
    if waiting:
        pooled.append(pool(model["tables"], np.concatenate(waiting)))
    n = np.array(counts)
    hidden = np.tanh(np.concatenate(pooled) @ model["dense"] + model["dense_bias"])
    logit = _document(model, hidden, np.cumsum(n) - n, n)[1]
    return [round(float(p), 6) for p in 1 / (1 + np.exp(-logit.astype(np.float64)))]


def share_of_ones(rows: DataFrame, label_col: str) -> float | None:
    """The share of label 1 among all rows labelled 0 or 1; None if there are none."""
    label = column(label_col).cast("int")
    return rows.where(label.isin(0, 1)).agg(F.avg(label)).first()[0]


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None
) -> Weights | None:
    """Learn from about ``PER_LABEL`` documents of each label, ``SAMPLE_CHUNKS`` chunks of each.

    The executors cut the chunks, so the driver gets about seven megabytes whatever the texts' lengths.
    ``share`` is that of label 1 if ``labelled`` is a sample drawn by label; else it is counted in all its rows.
    Rows without a text count as empty texts, rows without a label are left out; None if there are
    not both labels.
    """
    rows = labelled.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(label_col).cast("int").alias("label"))
    rows = rows.where("label in (0, 1)")
    if share is None:
        share = share_of_ones(rows.where("doc_id is not null"), "label")
    rows = stratified(rows, "doc_id", "label", PER_LABEL, 2)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, label in zip(b["doc_id"], b["text"], b["label"], strict=True):
                chunks = chunks_of((text or "").encode("utf-8", "replace"))
                pick = np.unique(np.linspace(0, len(chunks) - 1, SAMPLE_CHUNKS).round().astype(int))
                out.append((i, chunks[pick].tobytes(), label))
            yield pd.DataFrame(out, columns=["id", "chunks", "label"])

    kind = dict(rows.dtypes)["doc_id"]
    got = map_pandas(rows, sample, f"id {kind}, chunks binary, label int").orderBy("id", "label", "chunks").limit(4 * PER_LABEL).collect()
    labels = np.array([r["label"] for r in got])
    if len(set(labels.tolist())) < 2:
        return None
    return train([np.frombuffer(bytes(r["chunks"]), np.uint8).reshape(-1, CHUNK) for r in got], labels, share=share)


def score(df: DataFrame, model: Weights | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of each row; ``predicted`` is 1 from ``THRESHOLD`` on.

    A null text is scored like an empty one. Without a model every score is 0.5. Rows are independent:
    repeated rows get equal results, a null identifier is passed on, and other columns are not read.
    """
    rows = narrow(df, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score_texts(model, list(b["text"]))})

    out = map_pandas(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col, 5) == 0, F.lit(True))


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents of four of five folds and score all of ``docs``.

    The share of label 1 is that of all labels of these folds, each counted once, not of the sample.
    """
    known = labels.where(~held_out())
    share = share_of_ones(known.select("doc_id", "quality").distinct(), "quality")
    model = fit(labelled_texts(docs, known, "quality", PER_LABEL), label_col="label", share=share)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
