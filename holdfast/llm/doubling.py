"""Removal of repeated word windows, level by level.

A window of `window` words is made of windows of half the length, and these of halves again. The shortest are looked at
everywhere; at each following length only those windows whose two halves (which overlap when the length is odd) are both
repeated in different documents; until the full length is reached or no candidate is left. Short lengths compare shortened
hashes, as a false hit only lets a candidate live on; the full length compares whole ones.

At the full length each window learns the least document that holds it, and the words of windows that start in a document
with a smaller doc_id are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm import batches as b
from holdfast.llm.components import stored
from holdfast.llm.words import coded, hashes, rolled, split

WINDOW = 50
SHORTEST = 13
SPARE_BITS = 10


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the shortest up: each is half of the next one, rounded up."""
    out = [window]
    while (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def word_content(part: pa.RecordBatch) -> dict:
    """Ids, words (coded) and word counts of a batch."""
    ids, null = b.ids_of(part)
    words, owner = split(part.column("text"))
    distinct, codes = coded(words)
    return {
        "ids": ids,
        "null": null,
        "words": distinct.cast(pa.binary()).to_pylist(),
        "codes": b.planes(codes.astype(np.uint32)),
        "counts": np.bincount(owner, minlength=part.num_rows),
    }


def _unpacked(content: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = b.unplanes(content["codes"]).astype(np.int64)
    owner = np.repeat(np.arange(len(content["counts"])), content["counts"])
    return codes, owner, hashes(pa.array(content["words"], pa.binary()))[codes] if len(codes) else np.zeros(0, np.uint64)


def _windows(h: np.ndarray, owner: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at every word, and whether it ends in the same document."""
    value = rolled(h, length) >> np.uint64(64 - bits)
    inside = owner[: len(value)] == owner[length - 1 :] if len(value) else np.zeros(0, bool)
    pad = len(h) - len(value)
    return np.r_[value, np.zeros(pad, np.uint64)], np.r_[inside, np.zeros(pad, bool)]


def _next(alive: np.ndarray, short: int, length: int) -> np.ndarray:
    """Starts of windows whose first and last `short` words start at starts that are alive."""
    shift = length - short
    out = np.zeros(len(alive), bool)
    out[: len(alive) - shift] = alive[: len(alive) - shift] & alive[shift:]
    return out


def _asked(h, owner, ids, starts, length, bits):
    value, inside = _windows(h, owner, length, bits)
    at = np.flatnonzero(inside & starts)
    keys, least, most, number = b.distinct(value[at], ids[owner[at]])
    return at, keys, least, most, number


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words; texts below `window` words lose none. A null doc_id counts as greater than all
    others, so such a document removes nothing elsewhere. Documents that share a doc_id remove nothing from each other.
    Extra columns are ignored; an empty table gives an empty table.
    """
    packed = b.pack(documents, word_content)
    owners, lengths = packed.owners, levels(window)
    # Enough bits that few of the windows meet by chance.
    bits = min(64, max(32, packed.size.bit_length() + SPARE_BITS))
    width = {n: 64 if n == window else bits for n in lengths}

    def ask(level: int):
        """Take the answers of the last level, and ask for the windows of this one."""

        def step(row, content):
            codes, owner, h = _unpacked(content)
            ids, length = content["ids"], lengths[level]
            starts = np.ones(len(h), bool)
            if level:
                short = lengths[level - 1]
                starts = _alive(row, content, h, owner, level - 1)
                yield 0, row["gid"], -1, np.packbits(starts).tobytes()
                starts = _next(starts, short, length)
            _, keys, least, most, _ = _asked(h, owner, ids, starts, length, width[length])
            if length == window:
                extra = least
            else:
                extra = least != most
            for bucket, gid, data in b.questions(row["gid"], keys, width[length], owners, extra):
                yield 1, gid, bucket, data

        return step

    def _alive(row, content, h, owner, level):
        """Starts of the windows of a level that are repeated."""
        length = lengths[level]
        starts = np.ones(len(h), bool)
        if level:
            before = np.unpackbits(np.frombuffer(b.told(row, "alive")[-1], np.uint8), count=len(h)).astype(bool)
            starts = _next(before, lengths[level - 1], length)
        at, keys, _, _, number = _asked(h, owner, content["ids"], starts, length, width[length])
        hit = b.answers(row, "answers", keys, width[length], owners, bool)
        alive = np.zeros(len(h), bool)
        alive[at] = hit[number] if len(at) else False
        return alive

    rows = packed.table.select("gid", "blob")
    for level in range(len(lengths)):
        made = stored(b.each_batch(rows, ask(level), "kind long, gid long, bucket long, data binary"), "asked")
        asked = made.where("kind = 1").select("bucket", "gid", "data")
        told = {"alive": made.where("kind = 0").select("gid", "bucket", "data")} if level else {}
        answered = (b.ask_least if lengths[level] == window else b.ask_repeated)(asked)
        rows = b.with_answers(packed, **told, answers=answered)

    def finish(row, content):
        codes, owner, h = _unpacked(content)
        ids, counts = content["ids"], content["counts"]
        starts = np.ones(len(h), bool)
        if len(lengths) > 1:
            before = np.unpackbits(np.frombuffer(b.told(row, "alive")[-1], np.uint8), count=len(h)).astype(bool)
            starts = _next(before, lengths[-2], window)
        at, keys, _, _, number = _asked(h, owner, ids, starts, window, 64)
        least = b.answers(row, "answers", keys, 64, owners, np.int64)
        later = at[least[number] < ids[owner[at]]] if len(at) else at
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, later, 1)
        np.add.at(edge, later + window, -1)
        removed = np.cumsum(edge[:-1]) > 0
        gone = np.bincount(owner[removed], minlength=len(ids))
        kept, words = codes[~removed].tolist(), content["words"]
        ends = np.cumsum(counts - gone).tolist()
        for i, end in enumerate(ends):
            text = b" ".join([words[c] for c in kept[ends[i - 1] if i else 0 : end]])
            name = None if content["null"][i] else int(ids[i])
            yield name, int(counts[i]), int(gone[i]), hashlib.sha256(text).hexdigest()

    return b.each_batch(rows, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
