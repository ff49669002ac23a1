"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The recurrent cell is a minimal gated unit (one gate that forgets and admits). Its gate is a clipped
line and its candidate a softsign, which cost a fraction of the exponential functions:

    g = clip(xg + Ug h, 0, 1);  c = softsign(xc + g * (Uc h));  h = h + g * (c - h)

One pass reads a chunk of bytes forwards, one backwards; both states label every position with
probabilities of the languages, and a document gets the mean over all its positions. Documents are
cut into chunks of ``CHUNK`` bytes that cover the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import batches, column, fold, map_pandas, narrow, stratified
from tidyloom.names import HIDDEN as RESERVED
from tidyloom.names import require_free

CHUNK, HIDDEN, ROWS = 128, 8, 2048
#: Bounds of the training sample: documents of a language, windows of a document, bytes of a window.
PER_LANGUAGE, WINDOWS, WINDOW = 250, 3, 64
STEPS, BATCH, RATE = 140, 192, 0.03
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")

Weights = dict[str, np.ndarray]


def _cell(table: np.ndarray, recur: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (position, unit, row) of one pass over ``codes`` (position, row); ``keep`` gets what backpropagation needs."""
    steps, rows = codes.shape
    h = recur.shape[1]
    out = np.empty((steps, h, rows), np.float32)
    state, x = np.zeros((h, rows), np.float32), np.empty((2 * h, rows), np.float32)
    a, size = np.empty((2 * h, rows), np.float32), np.empty((h, rows), np.float32)
    for t in range(steps):
        table.take(codes[t], axis=1, out=x, mode="clip")
        np.matmul(recur, state, out=a)
        if keep is not None:
            raw = a.copy()
        gate, cand = a[:h], a[h:]
        gate += x[:h]
        if keep is not None:
            open_ = (gate > 0) & (gate < 1)
        np.maximum(gate, 0, out=gate)
        np.minimum(gate, 1, out=gate)
        cand *= gate
        cand += x[h:]
        np.abs(cand, out=size)
        size += 1
        cand /= size
        if keep is not None:
            keep.append((state, raw[h:], open_, gate.copy(), cand.copy(), size.copy()))
        cand -= state
        cand *= gate
        np.add(state, cand, out=out[t])
        state = out[t]
    return out


def _cell_back(
    recur: np.ndarray, codes: np.ndarray, keep: list, grad: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the recurrent weights from those of the states (through time, last first)."""
    steps, h, rows = grad.shape
    d_recur, d_in = np.zeros_like(recur), np.empty((steps, 2 * h, rows), np.float32)
    later = np.zeros((h, rows), np.float32)
    for t in range(steps - 1, -1, -1):
        state, raw, open_, gate, cand, size = keep[t]
        d = grad[t] + later
        d_cand = d * gate / (size * size)
        d_gate = (d * (cand - state) + d_cand * raw) * open_
        d_in[t, :h], d_in[t, h:] = d_gate, d_cand
        d_a = np.concatenate([d_gate, d_cand * gate])
        d_recur += d_a @ state.T
        later = d * (1 - gate) + recur.T @ d_a
    flat, at = d_in.transpose(1, 0, 2).reshape(2 * h, -1), codes.ravel()
    return np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32), d_recur


def _probabilities(w: Weights, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(position, language, row)"""
    p = np.matmul(w["out_f"], forward)
    p += np.matmul(w["out_b"], backward)
    p += w["bias"]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, seed: int = 3, steps: int = STEPS) -> Weights:
    """Fit to ``windows`` (row, byte) by backpropagation through time; every position carries its row's label."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    w: Weights = {"out_f": rng.normal(0, 0.3, (n_labels, h)), "out_b": rng.normal(0, 0.3, (n_labels, h)), "bias": np.zeros((n_labels, 1))}
    for side in "fb":
        table = rng.normal(0, 0.5, (2 * h, 256))
        table[:h] = table[:h] * 0.3 + 0.4
        w |= {f"table_{side}": table, f"recur_{side}": rng.normal(0, 0.4 / np.sqrt(h), (2 * h, h))}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        codes, y = np.ascontiguousarray(windows[pick].T).astype(np.intp), labels[pick]
        kept_f, kept_b = [], []
        forward = _cell(w["table_f"], w["recur_f"], codes, kept_f)
        backward = _cell(w["table_b"], w["recur_b"], codes[::-1], kept_b)[::-1]
        d = _probabilities(w, forward, backward)
        d[:, y, np.arange(len(y))] -= 1
        d /= d.shape[0] * d.shape[2]
        g = {
            "out_f": np.einsum("tkr,thr->kh", d, forward, optimize=True),
            "out_b": np.einsum("tkr,thr->kh", d, backward, optimize=True),
            "bias": d.sum(axis=(0, 2))[:, None],
        }
        g["table_f"], g["recur_f"] = _cell_back(w["recur_f"], codes, kept_f, np.matmul(w["out_f"].T, d))
        g["table_b"], g["recur_b"] = _cell_back(w["recur_b"], codes[::-1], kept_b, np.matmul(w["out_b"].T, d)[::-1])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, x in g.items():
            x = x * min(1.0, 1.0 / max(norm, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * x
            square[k] = 0.99 * square[k] + 0.01 * x * x
            w[k] = (w[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-6)).astype(np.float32)
    return w


def label_positions(w: Weights, chunks: np.ndarray) -> np.ndarray:
    """Probabilities (position, language, chunk) of every byte of ``chunks`` (chunk, position)."""
    codes = np.ascontiguousarray(chunks.T).astype(np.intp)
    forward = _cell(w["table_f"], w["recur_f"], codes)
    backward = _cell(w["table_b"], w["recur_b"], codes[::-1])[::-1]
    return _probabilities(w, forward, backward)


def pooled(w: Weights, texts: Sequence[bytes]) -> np.ndarray:
    """Mean of the probabilities over all positions, one row per text; zeros for an empty text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n_chunks = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(texts)), n_chunks)
    first = np.concatenate([[0], np.cumsum(n_chunks)])
    chunks = np.zeros((int(first[-1]), CHUNK), np.uint8)
    flat = chunks.reshape(-1)
    for i, t in enumerate(texts):
        at = int(first[i]) * CHUNK
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    within = np.arange(len(owner)) - first[owner]
    used = np.minimum(CHUNK, sizes[owner] - within * CHUNK)
    total = np.zeros((len(texts), len(w["bias"])))
    for s in range(0, len(chunks), ROWS):
        p = label_positions(w, chunks[s : s + ROWS])
        inside = np.arange(CHUNK)[:, None] < used[s : s + ROWS]
        np.add.at(total, owner[s : s + ROWS], np.einsum("tkr,tr->rk", p, inside.astype(np.float32)))
    return total / np.maximum(sizes, 1)[:, None]


def predict(model: dict[str, Any] | None, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model:
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if known:
            p = pooled(model["weights"], [texts[i].encode("utf-8", "replace") for i in known])
            best = p.argmax(axis=1)
            for i, k, row in zip(known, best, p, strict=True):
                names[i], scores[i] = model["labels"][k], round(min(1.0, float(row[k])), 6)
    return names, scores


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Any] | None:
    """Learn from about ``PER_LANGUAGE`` documents a language, ``WINDOWS`` windows spread over each whole text.

    The windows are cut by the executors, so the driver gets a few hundred kilobytes whatever the
    lengths of the texts. None if there is nothing to learn from.
    """
    rows = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    rows = stratified(rows.where("length(text) > 0"), "doc_id", "lang", PER_LANGUAGE)

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            for i, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                data = text.encode("utf-8", "replace")
                for k in range(WINDOWS):
                    at = max(0, len(data) - WINDOW) * k // (WINDOWS - 1)
                    out.append((i, k, data[at : at + WINDOW].ljust(WINDOW, b"\0"), lang))
            yield pd.DataFrame(out, columns=["id", "k", "window", "label"])

    kind = dict(rows.dtypes)["doc_id"]
    got = map_pandas(rows, windows, f"id {kind}, k int, window binary, label string").orderBy("label", "id", "k", "window")
    got = got.limit(2 * 64 * PER_LANGUAGE * WINDOWS).collect()
    if not got:
        return None
    labels = sorted({r["label"] for r in got})
    data = np.array([np.frombuffer(bytes(r["window"]), np.uint8) for r in got])
    y = np.array([labels.index(r["label"]) for r in got])
    return {"labels": labels, "weights": train(data, y, len(labels))}


def identify(df: DataFrame, model: dict[str, Any] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row.

    A null text, or one without letters, gets ``und`` and score 0, as does every text if there was
    nothing to learn from. Rows are independent: repeated rows get equal results, a null identifier is
    passed on, equal probabilities go to the first language by name, and other columns are not read.
    """
    rows = narrow(df, id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            names, scores = predict(model, list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": names, "score": scores})

    return map_pandas(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(fold(id_col, 3) == 1, F.lit(True))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from two of three folds of ``docs`` and identify all of it."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: dict[str, Any] | None, least: float = 0.0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a recognized language of at least that score, which replaces the one given; all columns stay.

    Rows are judged one by one: repeated rows all stay or all go, whatever their identifiers. Null texts, and
    those without letters, go. An empty table stays empty. Reserved column names raise.
    """
    require_free(docs.columns)
    found_as = F.col(RESERVED + "found")

    @F.pandas_udf("lang string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(model, list(texts))
        return pd.DataFrame({"lang": names, "score": scores})

    batches(docs.sparkSession)
    # Declared non-deterministic, as a filter on it would otherwise be moved in front and evaluate it a second time.
    named = docs.withColumn(RESERVED + "found", found.asNondeterministic()(column(text_col)))
    kept = named.where((found_as["lang"] != UNDETERMINED) & (found_as["score"] >= least))
    return kept.withColumn(lang_col, found_as["lang"]).select(*[column(c) for c in docs.columns])
