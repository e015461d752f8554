"""Small documents with all the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "mark string, cls string, token string, gid string, shard string, row string, id string, n_words string, score string"
)


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def texts(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty and short texts, repeats and a long one."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "ñandú", "x\x00y", "tab"]
    passage = sentence(rng, 70, words)
    rows = []
    for i in range(n):
        kind = i % 6
        body = sentence(rng, rng.randrange(1, 160), words)
        if kind == 1:
            body = sentence(rng, 20, words) + "\n" + passage + " " + body
        if kind == 2 and rows:
            body = rng.choice(rows)[1] or ""
        if kind == 3 and rows:
            w = (rng.choice(rows)[1] or "a").split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "edited"
            body = " ".join(w)
        rows.append((rng.randrange(10**6), body))
    rows += [(7, None), (8, ""), (9, " \n\t "), (11, "one"), (12, "one"), (13, "One two"), (14, "a b c d e"), (15, "a b c d e")]
    rows += [(16, passage.upper()), (16, passage), (16, passage), (None, passage), (None, None), (None, passage)]
    rows += [(17, sentence(rng, 6000, words)), (18, "x" * 3000), (19, "x" * 49), (20, "\n".join(["same line here"] * 30))]
    rows += [(21, "tail " + passage[3:200]), (2**60, "big id " + passage)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    full = [(i, t, ("en", "de", None)[k % 3], f"s{k % 4}", 0, "m", "c", "t", "g", "s", "r", "i", "n", "sc") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(text, lower=False):
    text = text or ""
    if lower:
        text = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(units, first, key, window):
    """Which units lie in a window that also starts in a document before `key`."""
    out = [False] * len(units)
    for j in range(len(units) - window + 1):
        if first[units[j : j + window]] < key:
            out[j : j + window] = [True] * window
    return out


def least(rows, units_of, window):
    first = {}
    for i, t in rows:
        key, units = (2**63 if i is None else i), units_of(t)
        for j in range(len(units) - window + 1):
            w = units[j : j + window]
            first[w] = min(first.get(w, 2**64), key)
    return first


def word_repeats(rows, window):
    first = least(rows, lambda t: tuple(words(t)), window)
    out = []
    for i, t in rows:
        w = tuple(words(t))
        gone = covered(w, first, 2**63 if i is None else i, window)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return Counter(out)


def byte_repeats(rows, window):
    first = least(rows, lambda t: (t or "").encode(), window)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = covered(data, first, 2**63 if i is None else i, window)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone, strict=True) if not g))))
    return Counter(out)


def shingles(text, k=5):
    w = words(text, lower=True)
    return {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, min(len(w), 1)))}


def components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    lowest = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            lowest[find(x)] = min(lowest.get(find(x), 2**63), i)
    return Counter((i, len(sets[x]), None if i is None else lowest[find(x)]) for x, (i, _) in enumerate(rows))


def contamination(rows, items, span):
    low = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    )
    windows = {}
    for i, t in items:
        w = low(t)
        n = min(span, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                ids = windows.get(tuple(w[j : j + n]))
                if ids:
                    hit |= set(range(j, j + n))
                    found |= {str(x) for x in ids if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return Counter(out)
