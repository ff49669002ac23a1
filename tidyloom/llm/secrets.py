"""Secrets in texts, weighed by who uses them across the corpus.

Detectors find candidates in whole texts. The corpus then tells how widely each candidate is used: its
hash is counted by distinct repositories and distinct owners. What stands in many owners' texts is a
copied example, and so is what stands in very many repositories of one; what only one owner has, in few
repositories, is likely a live credential. What lies between is neither, and is reported. Candidates of the
open detector (long mixed strings without a keyword) are left out if they are copied; the base
kinds are always reported, with their ownership.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import column, join_hot, map_pandas
from tidyloom.names import HIDDEN, require_free
from tidyloom.session import cut

#: Base kinds in the order of the report, with the least length: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS, LEAST = ["assign", "access", "hex", "mixed"], {"assign": 12, "access": 18, "hex": 16}
#: The open detector: length, and bits a character.
MIXED, MIXED_LENGTH, MIXED_BITS = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.0
#: Owners, or repositories, from which on a candidate counts as widely copied.
WIDE, WIDE_REPOSITORIES = 3, 50

Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end, secret)`` of the base kinds; offsets in code points, ``end`` exclusive."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def mixed_spans(text: str, taken: list[Span]) -> list[Span]:
    """Long strings with digits and letters of both cases, outside the spans already found."""
    out = []
    for m in MIXED.finditer(text):
        v = m[0]
        if any(a < m.end() and m.start() < z for _, a, z, _ in taken):
            continue
        if re.search(r"[0-9]", v) and re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and bits(v) >= MIXED_BITS:
            out.append(("mixed", m.start(), m.end(), v))
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``(row, doc_id, repository, owner, text_key, spans)`` of each row; a span has kind, start, end and the secret's SHA-256."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), column(id_col).alias("doc_id"), column(text_col).alias("text"),
        column(repository_col).cast("string").alias("repository"), column(owner_col).cast("string").alias("owner"),
        F.xxhash64(column(text_col)).alias("text_key"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = []
            for text in b["text"]:
                found = base_spans(text) if text else []
                found += mixed_spans(text, found) if text else []
                spans.append([{"kind": k, "start": a, "end": z, "secret": hashlib.sha256(s.encode()).hexdigest()} for k, a, z, s in ordered(found)])
            yield b.drop(columns="text").assign(spans=spans)

    span = "array<struct<kind:string,start:bigint,end:bigint,secret:string>>"
    return map_pandas(rows, run, f"row bigint, doc_id {dict(rows.dtypes)['doc_id']}, repository string, owner string, text_key bigint, spans {span}")


def ownership(found: DataFrame) -> DataFrame:
    """``(secret, repositories, owners, uses)`` over the corpus.

    Repeated uses are reduced before they are counted, so a secret in a third of all texts is no task's
    burden. A null owner or repository is not counted as one.
    """
    uses = found.select("row", "repository", "owner", F.explode("spans").alias("s")).select("row", "repository", "owner", F.col("s.secret").alias("secret"))
    once = uses.groupBy("secret", "repository", "owner").agg(F.count("*").alias("uses"))
    by_owner = once.groupBy("secret", "owner").agg(F.count("repository").alias("in_owner"), F.sum("uses").alias("uses"))
    by_repository = once.where("repository is not null").groupBy("secret", "repository").agg(F.lit(1).alias("one")).groupBy("secret").agg(F.count("*").alias("repositories"))
    by_secret = by_owner.groupBy("secret").agg(F.count("owner").alias("owners"), F.sum("uses").alias("uses"))
    return by_secret.join(by_repository, "secret", "left").na.fill(0, ["repositories"]).select("secret", "repositories", "owners", "uses")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``(doc_id, text_key, found)`` of each row: a hash of its text and its spans in order, with ``repositories``, ``owners`` and ``live`` of each.

    ``copied`` holds for secrets of at least ``WIDE`` owners or ``WIDE_REPOSITORIES`` repositories, ``live`` for those of
    at most one owner that are not copied. Spans of the open detector are left out if they are copied. Null and empty texts have no spans; repeated rows are each reported
    (and count as one repository); a null identifier is passed on. Other columns are not read.
    """
    found = cut(candidates(df, id_col, text_col, repository_col, owner_col))
    owned = cut(ownership(found))
    spans = found.where("size(spans) > 0").select("row", F.explode("spans").alias("s")).select("row", "s.*")
    joined = join_hot(spans, owned, "secret", "uses")
    joined = joined.withColumn("copied", (F.col("owners") >= WIDE) | (F.col("repositories") >= WIDE_REPOSITORIES))
    joined = joined.withColumn("live", (F.col("owners") <= 1) & ~F.col("copied")).where("kind <> 'mixed' or not copied")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    fields = ["start", "rank", "end", "kind", "repositories", "owners", "live", "copied"]
    each = joined.withColumn("rank", rank).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("found"))
    kept = found.select("row", "doc_id", "text_key").join(each, "row", "left")
    none = F.array().cast(dict(each.dtypes)["found"])
    return kept.select("doc_id", "text_key", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and span lists of each row of ``scan``."""
    base = F.filter("found", lambda s: s["kind"] != "mixed")

    def count(test) -> Column:
        return F.size(F.filter("found", test)).cast("bigint")

    def of(kind: str) -> Column:
        return count(lambda s: s["kind"] == kind)

    return scanned.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["copied"]).alias("n_copied"),
    )


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]``; overlapping spans become one.

    Rows are told apart by identifier and text; repeated rows are all changed alike. Texts without spans, null
    and empty ones stay as they are, and so does an empty table. Reserved column names raise.
    """
    require_free(docs.columns)
    row, text_key, span = (HIDDEN + x for x in ("id", "key", "spans"))
    spans = scanned.where("size(found) > 0").select(
        F.col("doc_id").alias(row), F.col("text_key").alias(text_key),
        F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(span),
    )
    spans = cut(spans.dropDuplicates([row, text_key]))
    same = column(id_col).eqNullSafe(F.col(row)) & (F.xxhash64(column(text_col)) == F.col(text_key))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, [(s["start"], s["end"]) for s in found]) for t, found in zip(texts, spans, strict=True)], dtype=object)

    changed = docs.join(spans, same).withColumn(text_col, without(column(text_col), F.col(span)))
    if length_col in docs.columns:
        changed = changed.withColumn(length_col, F.length(column(text_col)).cast(docs.schema[length_col].dataType))
    return docs.join(spans, same, "left_anti").unionByName(changed.select(*[column(c) for c in docs.columns]))


def replaced(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, z in sorted(spans):
        if a >= at:
            parts += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return "".join([*parts, text[at:]])
