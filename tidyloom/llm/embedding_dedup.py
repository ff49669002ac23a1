"""Near-duplicate embeddings: tiles compared in the order of their principal components.

Vectors are scaled to length one and turned to the principal axes of the whole table, so the leading
coordinates carry the most. Two tiles are multiplied a block of coordinates at a time. What the
remaining coordinates can add is at most the product of the two suffix norms, so a pair stops as
soon as its sum and that bound stay below the threshold; the pairs left over are verified on the
vectors as given.

Which tiles meet: only vectors of one label and length are compared, and a cosine of ``c`` bounds the
difference of the first coordinate by ``sqrt(2 - 2c)``, so a vector meets its own cell of that width
and the next one. Cells are dealt into tiles of about ``TILE`` rows, which are written to the shared folder
once; a meeting is a pair of file names, and reads its two tiles. So vectors are shuffled once, however
large a label or a cell is, and a task holds two tiles. Equal vectors of a label are one row with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import column, join_hot, load_arrays, map_pandas, new_folder, one_file_a_task, save_arrays
from tidyloom.llm.components import local_roots, smallest_members
from tidyloom.session import cut

THRESHOLD, TILE = 0.93, 1024
#: Coordinates of the first two blocks; a third has the rest.
BLOCKS = (8, 24)


def _usable(name: str):
    whole = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.col("label").isNotNull() & F.coalesce(whole & F.exists(name, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the axes (columns, most variance first) of the second moments of all unit vectors.

    Tasks send sums, which are added up in a shuffle; the driver gets half a matrix for each of the
    four most frequent lengths. Other lengths keep their coordinates, which changes the speed only.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for size, rows in b["embedding"].groupby(b["embedding"].map(len)):
                u = _unit(np.stack(rows.to_list()))
                sums[size] = sums.get(size, 0) + u.T @ u
        for size, m in sums.items():
            i, j = np.triu_indices(size)
            yield pd.DataFrame({"size": size, "i": i, "j": j, "v": m[i, j]})

    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(4).collect()
    frequent = vectors.where(F.size("embedding").isin([r["n"] for r in lengths])).select("embedding")
    total = map_pandas(frequent, moments, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
    matrices = {r["n"]: np.zeros((r["n"], r["n"])) for r in lengths}
    for r in total.toLocalIterator():
        matrices[r["size"]][r["i"], r["j"]] = matrices[r["size"]][r["j"], r["i"]] = r["v"]
    return {n: np.linalg.eigh(m)[1][:, ::-1] for n, m in matrices.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of ``x`` and ``j`` of ``y``; few are gathered at once, as all pairs of two tiles may be near."""
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 16):
        part = slice(s, s + (1 << 16))
        out[part] = np.einsum("nd,nd->n", x[i[part]], y[j[part]])
    return out


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of ``x`` and ``y`` with at least that cosine."""
    a, b = _unit(x), _unit(y)
    if axes is not None:
        a, b = a @ axes, b @ axes
    ends = [e for e in BLOCKS if e < a.shape[1]] + [a.shape[1]]
    i = j = None
    total, at, slack = 0.0, 0, 1e-9
    for end in ends:
        rest_a, rest_b = np.linalg.norm(a[:, end:], axis=1), np.linalg.norm(b[:, end:], axis=1)
        if i is None:
            total = total + a[:, at:end] @ b[:, at:end].T
            alive = total + rest_a[:, None] * rest_b[None] >= threshold - slack
            if end == ends[-1] or alive.mean() < 0.1:
                i, j = np.nonzero(alive)
                total = total[i, j]
        else:
            total = total + _dots(a[:, at:end], b[:, at:end], i, j)
            alive = total + rest_a[i] * rest_b[j] >= threshold - slack
            i, j, total = i[alive], j[alive], total[alive]
        at = end
    p, q = x.astype(np.float64), y.astype(np.float64)
    cosine = _dots(p, q, i, j) / (np.linalg.norm(p, axis=1)[i] * np.linalg.norm(q, axis=1)[j])
    return i[cosine >= threshold], j[cosine >= threshold]


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row.

    Rows without a label, or whose vector is null, empty, zero or holds a null or non-finite component,
    link with nothing and are their own component; so are vectors of different lengths to each other.
    Repeated rows are different vectors with one identifier: they link with each other, share
    a component, and are each kept if theirs is the smallest identifier. Null identifiers are never
    the smallest, unless a component has no other. Other columns are not read.
    """
    rows = df.select(column(id_col).alias("vec_id"), column(label_col).alias("label"), column(vector_col).alias("embedding"))
    good = rows.where(_usable("embedding")).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    lone = rows.where(~_usable("embedding")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    pairs = cut(_compare(classes, threshold))
    links = pairs.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    counts = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    members = smallest_members(classes, links)
    found = cut(members.join(counts, "node", "left"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    linked = join_hot(good, found, ["label", "embedding"], "copies").select("vec_id", n_links, "component_id")
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(classes: DataFrame, threshold: float) -> DataFrame:
    """``(node, links, root)`` for each node and pair of tiles with links: how many, and a node that it reaches there."""
    axes = principal_axes(classes)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-12

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.zeros(len(b), np.int32)
            for size, at in b.groupby(b["embedding"].map(len)).indices.items():
                turn = axes[size][:, 0] if size in axes else np.eye(size)[:, 0]
                cell[at] = np.floor(_unit(np.stack(b["embedding"].iloc[at].to_list())) @ turn / width)
            yield b.assign(size=b["embedding"].map(len), cell=cell)

    kind = dict(classes.dtypes)
    placed = map_pandas(
        classes.select("node", "copies", "label", "embedding"), cells,
        f"node bigint, copies bigint, label {kind['label']}, embedding array<double>, size int, cell int",
    )
    placed = cut(placed)
    where = ["label", "size", "cell"]
    full = placed.groupBy(*where).agg(F.count("*").alias("n"))
    tiles = cut(full.select(*where, "n", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    dealt = join_hot(placed, tiles, where, "n").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    folder = new_folder(classes.sparkSession, "tiles")

    def store(group: pd.DataFrame) -> pd.DataFrame:
        path = save_arrays(folder, x=np.stack(group["embedding"].to_list()), node=group["node"].to_numpy(), copies=group["copies"].to_numpy())
        return group[[*where, "tile"]].head(1).assign(path=path)

    stored = cut(dealt.groupBy(*where, "tile").applyInPandas(store, f"label {kind['label']}, size int, cell int, tile int, path string"))
    # A meeting is two tiles of one cell (or one tile with itself), or one of a cell and one of the next.
    one = stored.select(*where, F.col("tile").alias("p"), F.col("path").alias("one"))
    two = stored.select(*where, F.col("tile").alias("q"), F.col("path").alias("two"))
    own = one.join(two, where).where("p <= q")
    beside = one.join(two.withColumn("cell", F.col("cell") - 1), where)
    meetings = cut(own.unionByName(beside).select("size", "one", "two"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, p, q in zip(b["size"], b["one"], b["two"], strict=True):
                first = load_arrays(p)
                second = first if p == q else load_arrays(q)
                i, j = linked_pairs(first["x"], second["x"], axes.get(int(size)), threshold)
                if p == q:
                    i, j = i[i < j], j[i < j]
                    node, copies = first["node"], first["copies"]
                else:
                    node, copies = (np.concatenate([first[c], second[c]]) for c in ("node", "copies"))
                    j = j + len(first["node"])
                links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                has = links > 0
                yield pd.DataFrame({"node": node[has], "links": links[has].astype(np.int64), "root": node[local_roots(len(node), i, j)][has]})

    return map_pandas(one_file_a_task(meetings), meet, "node bigint, links bigint, root bigint")
