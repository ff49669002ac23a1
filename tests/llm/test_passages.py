"""Repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import TEXTS, awkward, empty, rows_of, sort_rows
from tidyloom.llm import byte_words, substring_dedup

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def passages(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    places = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = {p for i in range(len(w) - window + 1) if places[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sort_rows(out)


def found(df, **options):
    return rows_of(substring_dedup.digest(substring_dedup.repeated_passages(df, **options)), *COLUMNS)


def random_rows(seed, n=60):
    """Few words, a passage in a third of the texts, copies."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "bb", "ccc", "ñandú", "x" * 20]) for _ in range(n))
    passage = text(9)
    rows = [(i, text(rng.randint(0, 30)) + (f"\n{passage}\t" if i % 3 == 0 else "")) for i in range(n)]
    return rows + [(100 + i, rows[0][1]) for i in range(20)]


@pytest.mark.parametrize(("window", "group", "part"), [(1, 10, 500), (3, 8, 200), (8, 8, 1 << 20), (12, 20, 300)])
def test_random_texts(spark, window, group, part):
    """Small files and groups, so that prefixes of every length are used."""
    rows = random_rows(window)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(df, window=window, group_size=group, part_bytes=part) == passages(rows, window)


def test_awkward_tables(spark):
    rows = [*TEXTS, (20, "word " * 90), (21, "q r s"), (22, "t u v")]
    assert found(awkward(spark, rows), window=4) == passages(rows, 4)
    assert found(awkward(spark, rows)) == passages(rows, 35)
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0


def test_kept_text_and_runs(spark):
    rows = [(1, " a  b\nc d e "), (2, "x b c d\ty"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.repeated_passages(df, window=3)
    spans = F.transform("removed", lambda s: F.array(s["start"], s["end"]))
    assert rows_of(got.select("doc_id", "kept", spans.alias("s")), "doc_id", "kept", "s") == [(1, "a e", [[1, 4]]), (2, "x y", [[1, 4]]), (3, "", [])]


def test_tree_nodes():
    keys = np.array([[1, 2], [3, 4], [1, 2], [1, 5], [3, 4], [1, 2], [0, 0]], np.uint32)
    order, begin, end = substring_dedup.deep_nodes(keys)
    assert sorted(sorted(order[a:b].tolist()) for a, b in zip(begin, end, strict=True)) == [[0, 2, 5], [1, 4]]
    assert [len(x) for x in substring_dedup.deep_nodes(keys[:0])[1:]] == [0, 0]


def test_suffixes_of_a_large_group_are_split(spark, monkeypatch):
    """Texts that share a prefix and go on differently are in several groups at last."""
    rows = [(i, "a b c d e f " + " ".join(f"w{i}{k}" for k in range(9))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    levels = substring_dedup._prefix_levels
    monkeypatch.setattr(substring_dedup, "_prefix_levels", lambda *a: seen.append(levels(*a)) or seen[-1])
    assert found(df, window=10, group_size=50, part_bytes=4000) == passages(rows, 10)
    assert len(seen[0]) > 2 and len(seen[0][0][1])


def test_hashes_of_words():
    rows = ["", None, "abcdefgh abcdefghi", "abcdefgh", "z" * 5000 + " é x", "z" * 5000]
    raw, bounds = byte_words.texts(pa.array(rows).slice(1))
    starts, ends, first = byte_words.word_bounds(raw, bounds, byte_words.SPACED)
    words = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["abcdefgh", "abcdefghi", "abcdefgh", "z" * 5000, "é", "x", "z" * 5000]
    h = byte_words.hash_words(raw, starts, ends).tolist()
    assert h[0] == h[2] and h[3] == h[6] == xxhash.xxh64_intdigest("z" * 5000) and len(set(h)) == 5
    assert first.tolist() == [0, 0, 2, 3, 6, 7]


def test_words_of_morse_sequences_have_hashes_of_their_own():
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    pair = [word, word.translate({97: 98, 98: 97})]
    raw, bounds = byte_words.texts(pa.array(pair))
    starts, ends, _ = byte_words.word_bounds(raw, bounds, byte_words.SPACED)
    assert len(set(byte_words.hash_words(raw, starts, ends).tolist())) == 2
