"""Hard negatives by inner product, mined with cover trees over norm-augmented candidates.

One more coordinate gives all candidates of a tree the same length, so they lie on a sphere, where the
inner product with an anchor falls as the angle grows. A cover tree halves its radius from level to level:
each node has a candidate as its centre, its children's centres are apart by more than the radius of
their level, and its covering radius, the largest angle below it, bounds the inner products of all that it
holds from above and from below. The search descends to the nodes with the largest bounds first, skips
those whose bounds lie outside all windows that the anchor asks for, or cannot beat what it has found,
and scores single candidates exactly.

A tree holds about ``TREE_NUMBERS`` numbers: candidates are dealt to the nearest of a bounded sample of centres,
and a crowded centre gets several trees. Trees and anchors are written to the shared folder once, and a task
reads a block of anchors and ``TREES_A_MEETING`` trees, the most promising first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.llm.common import column, load_arrays, map_pandas, new_folder, one_file_a_task, save_arrays, sized
from tidyloom.session import cut

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Numbers in a tree, anchors read together, trees read by one task, rows that become centres (for each of as many vector lengths).
TREE_NUMBERS, ANCHORS, TREES_A_MEETING, CENTRES, LENGTHS = 1 << 19, 256, 64, 64, 4
#: Nodes that an anchor descends to at once, and the rows below which a node is not split.
WIDTH, LEAF = 4, 8
_SLACK = 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; beyond 64 bits they raise."""
    top = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < 1 << 53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q.tolist()], object) @ np.array([[int(v) for v in row] for row in x.tolist()], object).T
    return whole.astype(np.int64)


@dataclass
class CoverTree:
    """``child`` lists, node by node, a row of ``x`` (the centre) and the node below it, -1 for a single candidate."""

    x: np.ndarray
    length: float
    radius: np.ndarray
    begin: np.ndarray
    child: np.ndarray
    below: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> CoverTree:
        norm = np.linalg.norm(x, axis=1)
        length = float(norm.max(initial=0)) or 1.0
        y = np.hstack([x, np.sqrt(np.maximum(0, length**2 - norm**2))[:, None]]) / length
        middle = y.mean(axis=0)
        root = int((y @ middle).argmax())
        radius, children = [], []
        todo = [(root, np.arange(len(x)), None)]
        below: list[list[int]] = []
        while todo:
            centre, rows, parent = todo.pop()
            number = len(radius)
            if parent is not None:
                below[parent[0]][parent[1]] = number
            angle = np.arccos(np.clip(y[rows] @ y[centre], -1, 1))
            radius.append(float(angle.max()))
            parts = [(r, np.array([r])) for r in rows.tolist()] if len(rows) <= LEAF or radius[-1] < 1e-7 else cls._split(y, centre, rows, angle)
            children.append([c for c, _ in parts])
            below.append([-1] * len(parts))
            todo += [(c, r, (number, k)) for k, (c, r) in enumerate(parts) if len(r) > 1]
        sizes = [len(c) for c in children]
        return cls(x, length, np.array(radius), np.cumsum([0, *sizes]), np.concatenate([np.array(c) for c in children]), np.concatenate([np.array(b) for b in below]))

    @staticmethod
    def _split(y: np.ndarray, centre: int, rows: np.ndarray, angle: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Children with half the radius: centres are apart by more than that, and each row is below one that covers it."""
        reach, parts = float(angle.max()) / 2, []
        near = angle <= reach
        parts.append((centre, rows[near]))
        rows = rows[~near]
        while len(rows):
            angle = np.arccos(np.clip(y[rows] @ y[rows[0]], -1, 1))
            near = angle <= reach
            near[0] = True
            parts.append((int(rows[0]), rows[near]))
            rows = rows[~near]
        return parts


@dataclass
class Asks:
    """Anchors with the windows of scores that they look for, and the best found so far of each window."""

    x: np.ndarray
    label: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    top: int
    norm: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)
    found: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norm = np.linalg.norm(self.x, axis=1)
        self.least = np.full(self.low.shape, np.iinfo(np.int64).min)
        #: Rows of anchor, window, score, null identifier, identifier.
        self.found = np.empty((0, 5), np.int64)

    def wanted(self, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether any window of anchors ``a`` can take a score between these bounds."""
        need = np.maximum(self.low[a], self.least[a])
        return ((upper[..., None] >= need) & (lower[..., None] <= self.high[a])).any(axis=-1)

    def take(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, label: np.ndarray, row: np.ndarray) -> None:
        """Offer candidates to anchors ``a``: ``score`` has a row for each of them."""
        fit = ((self.label[a][:, None] == label) == self.same) & (self.row[a][:, None] != row)
        new = [self.found]
        for w in range(self.low.shape[1]):
            need = np.maximum(self.low[a, w], self.least[a, w])
            good = fit & (score >= need[:, None]) & (score <= self.high[a, w][:, None])
            if score.shape[1] > self.top:  # all that tie with the last of the best stay
                kept = np.where(good, score, np.iinfo(np.int64).min)
                good &= score >= np.partition(kept, -self.top, axis=1)[:, [-self.top]]
            i, j = np.nonzero(good)
            new.append(np.stack([a[i], np.full(len(i), w), score[i, j], null[j], ids[j]], axis=1))
        if sum(len(n) for n in new[1:]):
            found = np.concatenate(new)
            found = found[np.lexsort((found[:, 4], found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
            key = found[:, 0] * self.low.shape[1] + found[:, 1]
            rank = np.arange(len(key)) - np.searchsorted(key, key)
            self.found = found[rank < self.top]
            last = found[rank == self.top - 1]
            self.least[last[:, 0], last[:, 1]] = last[:, 2]


def descend(tree: CoverTree, asks: Asks, ids: np.ndarray, null: np.ndarray, label: np.ndarray, row: np.ndarray) -> int:
    """Offer to ``asks`` what the tree holds; how many candidates were scored."""
    scored = 0
    scale = asks.norm * tree.length

    def bounds(a: np.ndarray, score: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.maximum(scale[a], 1e-300).reshape(-1, *[1] * (score.ndim - 1))
        angle = np.arccos(np.clip(score / s, -1, 1))
        slack = _SLACK * s + _SLACK
        return s * np.cos(np.maximum(angle - radius, 0)) + slack, s * np.cos(np.minimum(angle + radius, np.pi)) - slack

    anchor = np.arange(len(asks.x))
    node = np.zeros(len(anchor), np.int64)
    upper = np.full(len(anchor), np.inf)
    lower = -upper
    while len(anchor):
        alive = asks.wanted(anchor, upper, lower)
        anchor, node, upper, lower = anchor[alive], node[alive], upper[alive], lower[alive]
        order = np.lexsort((-upper, anchor))
        anchor, node, upper, lower = anchor[order], node[order], upper[order], lower[order]
        now = np.arange(len(anchor)) - np.searchsorted(anchor, anchor) < WIDTH
        later = [(anchor[~now], node[~now], upper[~now], lower[~now])]
        a_now, n_now = anchor[now], node[now]
        by = np.argsort(n_now, kind="stable")
        edge = np.flatnonzero(np.diff(n_now[by], prepend=-1))
        for k, s in enumerate(edge):
            mine = by[s : edge[k + 1] if k + 1 < len(edge) else len(by)]
            a, n = a_now[mine], n_now[mine[0]]
            child, below = tree.child[tree.begin[n] : tree.begin[n + 1]], tree.below[tree.begin[n] : tree.begin[n + 1]]
            score = products(asks.x[a], tree.x[child])
            single = np.flatnonzero(below < 0)
            if len(single):
                c = child[single]
                asks.take(a, score[:, single], ids[c], null[c], label[c], row[c])
                scored += len(a) * len(single)
            inner = np.flatnonzero(below >= 0)
            if len(inner):
                up, low = bounds(a, score[:, inner].astype(float), tree.radius[below[inner]])
                i, j = np.nonzero(asks.wanted(np.broadcast_to(a[:, None], up.shape), up, low))
                later.append((a[i], below[inner[j]], up[i, j], low[i, j]))
        anchor, node, upper, lower = (np.concatenate(x) for x in zip(*later, strict=True))
    return scored


def _usable(label: str, vector: str) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(label).isNotNull() & F.coalesce(whole, F.lit(False))


def quantized(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``(row, vec_id, label, x)`` of the rows that take part: whole components, a number for each label and row."""
    rows = df.select(column(id_col).cast("bigint").alias("vec_id"), column(label_col).alias("label"), column(vector_col).alias("e"))
    rows = rows.where(_usable("label", "e"))
    whole = isinstance(rows.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("bigint") if whole else F.xxhash64("label")
    x = F.transform("e", lambda v: F.rint(F.floor(v.cast("double") * scale)))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), x.alias("x"), F.size("e").alias("length")))


def build_trees(rows: DataFrame) -> DataFrame:
    """Write a cover tree for each group of near rows: ``(length, path)``."""
    folder = new_folder(rows.sparkSession, "trees")
    lengths = rows.groupBy("length").count().orderBy(F.desc("count"), "length").limit(LENGTHS).collect()
    frequent = rows.where(F.col("length").isin([r["length"] for r in lengths]))
    drawn = frequent.withColumn("n", F.row_number().over(W.partitionBy("length").orderBy(F.xxhash64("row"), "row"))).where(F.col("n") <= CENTRES)
    centres: dict[int, np.ndarray] = {}
    for r in drawn.orderBy("length", "n").select("length", "x").collect():
        centres.setdefault(r["length"], []).append(r["x"])
    centres = {n: np.array(c) / np.maximum(np.linalg.norm(np.array(c), axis=1, keepdims=True), 1e-300) for n, c in centres.items()}

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.zeros(len(b), np.int32)
            for n, at in b.groupby("length").indices.items():
                if n in centres:
                    cell[at] = (np.stack(b["x"].iloc[at].to_list()) @ centres[n].T).argmax(axis=1)
            yield b.assign(cell=cell)

    schema = "row bigint, vec_id bigint, label bigint, x array<double>, length int, cell int"
    placed = cut(map_pandas(rows, cells, schema))
    size = F.greatest(F.floor(TREE_NUMBERS / F.greatest("length", F.lit(1))), F.lit(LEAF))
    counts = placed.groupBy("length", "cell").agg(F.count("*").alias("n")).select("length", "cell", F.ceil(F.col("n") / size).alias("trees"))
    dealt = placed.join(sized(counts), ["length", "cell"]).withColumn("tree", F.pmod(F.xxhash64("row"), F.col("trees")))

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree.of(np.stack(group["x"].to_list()).reshape(len(group), -1))
        path = save_arrays(
            folder, **vars(tree) | {"length": np.array(tree.length)}, ids=group["vec_id"].fillna(0).astype(np.int64).to_numpy(),
            null=group["vec_id"].isna().astype(np.int64).to_numpy(), label=group["label"].to_numpy(), row=group["row"].to_numpy(),
        )
        return pd.DataFrame({"length": [group["length"].iloc[0]], "path": [path]})

    return cut(dealt.groupBy("length", "cell", "tree").applyInPandas(plant, "length int, path string"))


def best_in_windows(trees: DataFrame, asks: DataFrame, same: bool, top: int) -> DataFrame:
    """``(row, w, score, vec_id, rank)``: for each window of ``asks(row, label, x, length, windows)`` its ``top`` best candidates.

    ``windows`` are pairs of the lowest and the highest score; ``w`` is the place of a window in that list. Candidates
    have the anchor's label if ``same``, else another one, and are never the anchor's own row.
    """
    folder = new_folder(trees.sparkSession, "anchors")
    counts = asks.groupBy("length").agg(F.ceil(F.count("*") / ANCHORS).alias("blocks"))
    dealt = asks.join(sized(counts), "length").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))

    def store(group: pd.DataFrame) -> pd.DataFrame:
        width = max(len(w) for w in group["windows"])
        window = np.array([[*[(r["low"], r["high"]) for r in w], *[(1, 0)] * (width - len(w))] for w in group["windows"]], np.int64)
        x = np.stack(group["x"].to_list()).reshape(len(group), -1)
        path = save_arrays(folder, x=x, label=group["label"].to_numpy(), row=group["row"].to_numpy(), low=window[:, :, 0], high=window[:, :, 1])
        return pd.DataFrame({"length": [group["length"].iloc[0]], "anchors": [path]})

    blocks = cut(dealt.groupBy("length", "block").applyInPandas(store, "length int, anchors string"))
    many = trees.groupBy("length").agg(F.ceil(F.count("*") / TREES_A_MEETING).alias("groups"))
    grouped = trees.join(sized(many), "length").groupBy("length", F.pmod(F.xxhash64("path"), F.col("groups")).alias("g"))
    meetings = blocks.join(grouped.agg(F.sort_array(F.collect_list("path")).alias("trees")), "length").select("anchors", "trees")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, paths in zip(b["anchors"], b["trees"], strict=True):
                ask = Asks(**load_arrays(path), same=same, top=top)
                first = {}
                for p in paths:
                    tree = load_arrays(p)
                    first[p] = float((ask.x @ tree["x"][tree["child"][0]]).mean())
                for p in sorted(paths, key=lambda p: -first[p]):
                    data = load_arrays(p)
                    tree = CoverTree(*[data[f] for f in ("x", "length", "radius", "begin", "child", "below")])
                    descend(tree, ask, *[data[f] for f in ("ids", "null", "label", "row")])
                f = ask.found
                ids = pd.array(f[:, 4], "Int64")
                ids[f[:, 3] > 0] = pd.NA
                yield pd.DataFrame({"row": ask.row[f[:, 0]], "w": f[:, 1], "score": f[:, 2], "vec_id": ids})

    found = map_pandas(one_file_a_task(cut(meetings)), meet, "row bigint, w int, score bigint, vec_id bigint")
    order = W.partitionBy("row", "w").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``; a score is an inner product of whole numbers, and one beyond 64 bits
    raises. ``anchor`` says, by ``vec_id``, which rows are anchors. The positives of an anchor are its best other rows of
    its label; for each of them the best rows of other labels with a score between ``low`` and ``high`` percent of
    the positive's are returned. Scores that tie are ordered by identifier, a null one last.

    Rows without a label, or whose vector is null or holds a null or non-finite component, take no part; zero and
    empty vectors do, and only vectors of one length meet. Repeated rows are each an anchor and a candidate. An
    anchor without positives, or a positive without negatives, gives no rows. Identifiers are whole numbers.
    Other columns are not read.
    """
    rows = quantized(df, id_col, vector_col, label_col, scale)
    trees = build_trees(rows)
    anchors = rows.where(F.coalesce(anchor, F.lit(False)))
    window = "struct<low:bigint,high:bigint>"
    all_ = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    near = best_in_windows(trees, anchors.select("row", "label", "x", "length", all_.cast(f"array<{window}>").alias("windows")), True, positives)
    near = cut(near.select("row", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Whole numbers s with low * p <= 100 * s <= high * p, for p = 100 * q + r.
    q, r = "(positive_score - pmod(positive_score, 100)) div 100", "pmod(positive_score, 100)"
    bounds = F.expr(f"struct({low} * ({q}) + ({low} * {r} + 99) div 100 as low, {high} * ({q}) + ({high} * {r}) div 100 as high)")
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("w", bounds.alias("b")))).alias("windows"))
    asks = anchors.join(windows.select("row", F.expr("transform(windows, x -> x.b)").cast(f"array<{window}>").alias("windows")), "row")
    far = best_in_windows(trees, asks.select("row", "label", "x", "length", "windows"), False, negatives)
    named = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    out = far.select("row", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["row", "w"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_labels(df: DataFrame) -> DataFrame:
    """The table of the query: every seventh row gets the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return df.select("vec_id", "embedding", moved.alias("label"))
