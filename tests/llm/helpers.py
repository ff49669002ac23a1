"""Brute-force counterparts of the operators, and awkward tables."""

from __future__ import annotations

import base64
import hashlib
import re
import string
import zlib

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Null, empty, blank, one word, repeated rows, a null identifier, a very long text, odd characters.
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e f"), (5, "a b c d e f"),
    (None, "a b c d e f"), (6, "Ein längerer Satz über ñandúes — x… 😀 <|endoftext|> it's"),
    (7, "lorem ipsum dolor " * 20_000), (8, "12345 67890 !!! ???"), (9, "A B C D E F"),
    (10, "x" * 300_000), (-4, " 　 \x85\ttab\r\nend  "),
]


def awkward(spark, rows=TEXTS):
    """``rows`` with further columns whose names clash with those of results and internals."""
    names = "doc_id bigint, text string, source string, lang string, score double, fp string, row int, spans string, word string, node int, prediction string"
    return spark.createDataFrame([(*r, "s", "en", 0.5, "f", 1, "p", "w", 3, "q") for r in rows], names)


def empty(spark):
    return awkward(spark).limit(0)


def rows_of(df, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def sort_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def components(n, links):
    """Smallest number that each of ``n`` reaches."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash_rows(docs):
    fps = [simhash(t) for _, t in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = components(len(fps), links)
    least = {}
    for (d, _), r in zip(docs, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(docs, fps, root, strict=True)]


def contamination_rows(docs, items, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    windows = {}
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    found |= got
                    hit |= set(range(s, s + n))
        found.discard(None)
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def embedding_rows(vectors, threshold=0.93):
    """From ``(vec_id, embedding, label)``."""

    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for i, (_, v, a) in enumerate(vectors):
        for j, (_, u, b) in enumerate(vectors[:i]):
            if usable(v, a) and usable(u, b) and a == b and len(v) == len(u):
                x, y = np.array(v, float), np.array(u, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.append((i, j))
    root, least = components(len(vectors), links), {}
    for (d, *_), r in zip(vectors, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    degree = [sum(i in p for p in links) for i in range(len(vectors))]
    return [(d, n, least.get(r), d == least.get(r)) for (d, *_), n, r in zip(vectors, degree, root, strict=True)]


def warc_rows(pages):
    payloads = [(h or "").encode() for _, h in pages]
    first = {}
    for (p, _), b in zip(pages, payloads, strict=True):
        if p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for (p, _), b in zip(pages, payloads, strict=True):
        again = p is not None and p != first[b]
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((p, len(b), sha, "revisit" if again else "response", first[b] if again else None))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def secret_spans(text):
    """Base spans ``(start, rank, kind, end)``, stated plainly."""
    kinds = [
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ]
    found = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)
