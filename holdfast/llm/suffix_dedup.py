"""Removal of repeated byte strings with suffix arrays of shards.

All texts are looked at as UTF-8 bytes. Every window of `window` bytes has an anchor: of its grams of 32 bytes the one with
the least hash (the first of equals). Equal windows have equal anchors at equal places, so the windows of an anchor, which
are neighbours and make a piece of text, are only compared with pieces of the same anchor. Anchors that only one document
holds are dropped first; the pieces of the others go to the shard of their anchor.

Each shard sorts the suffixes of its pieces (prefix doubling by Larsson and Sadakane: groups of equal rank are refined,
sorted ones are left alone) and finds the common prefixes of neighbours in Kasai's order. Windows in a run of common
prefixes of at least `window` bytes are equal, and the least document among them decides. A shard beyond `part_bytes` is cut
into parts by batch: each part decides what it can alone, and the windows of its least documents are merged with those of
the other parts by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import batches as b
from holdfast.llm.components import stored
from holdfast.llm.words import mix

WINDOW = 50
GRAM = 32
SHARDS_PER_OWNER = 8
PART_BYTES = 3 << 20
STRETCH = 1 << 20
SPARE_BITS = 10


def byte_content(part: pa.RecordBatch) -> dict:
    ids, null = b.ids_of(part)
    texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
    return {"ids": ids, "null": null, "lens": np.fromiter(map(len, texts), np.int64, len(texts)), "bytes": b"".join(texts)}


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a big-endian number; bytes past the end are 0."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    return np.ndarray((len(data),), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in every run of `width` values."""
    value, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        value, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        span += step
    return at


def pieces(content: dict, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and document (its position) of every piece of a batch.

    Whole documents are taken together up to about `STRETCH` bytes, to bound memory.
    """
    data, lens = np.frombuffer(content["bytes"], np.uint8), content["lens"]
    ends, found, low = np.cumsum(lens), [], 0
    while low < len(lens):
        base = int(ends[low - 1]) if low else 0
        high = max(int(np.searchsorted(ends, base + STRETCH, side="right")), low + 1)
        key, start, count, doc = _pieces(data[base : int(ends[high - 1])], lens[low:high], window)
        found.append((key, start + base, count, doc + low))
        low = high
    if not found:
        found = [_pieces(data, lens, window)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pieces(data: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return np.zeros(0, np.uint64), none, none, none
    words = _words8(data)
    h = words[: len(data) - GRAM + 1]
    for at in range(8, GRAM, 8):
        h = mix(h + np.uint64(at)) ^ words[at : len(data) - GRAM + 1 + at]
    h = mix(h)
    at = first_least(h, window - GRAM + 1)
    ends = np.repeat(np.cumsum(lens), lens)
    start = np.flatnonzero(np.arange(window, len(data) + 1) <= ends[: len(data) - window + 1])
    if not len(start):
        return np.zeros(0, np.uint64), none, none, none
    anchor = at[start]
    first = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(anchor) != 0)])
    doc = np.searchsorted(np.cumsum(lens), start[first], side="right")
    # Least hashes are small ones: mixed again, they spread over all ranges of keys.
    return mix(h[anchor[first]]), start[first], np.diff(np.r_[first, len(start)]), doc


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each, by prefix doubling from 7 bytes on."""
    n = len(data)
    # Seven bytes, then how many of them are real: the end of the data comes before any byte.
    real = np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)
    key = (_words8(data) >> np.uint64(8) << np.uint64(8)) | real
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = _group_starts(key[order])
    depth = 7
    while True:
        size = np.bincount(rank[:n], minlength=n)
        loose = np.flatnonzero(size[rank[order]] > 1)  # places in groups of more than one
        if not len(loose):
            return order, rank[:n]
        suffix = order[loose]
        follow = rank[np.minimum(suffix + depth, n)]
        by = rank[suffix] * (n + 1) + follow + 1
        sort = np.argsort(by, kind="stable")
        order[loose] = suffix[sort]
        by = by[sort]
        new = np.r_[True, by[1:] != by[:-1]]
        rank[order[loose]] = loose[np.maximum.accumulate(np.where(new, np.arange(len(loose)), 0))]
        depth *= 2


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For every place of a sorted array the first place of its group of equals."""
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0)) if len(ordered) else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 1 << 15) -> np.ndarray:
    """Common prefix, up to `most`, of every suffix with the one before it in order, found in text order.

    The next suffix in the text shares at most one byte less with its own predecessor (Kasai), so each carries on from
    there. Many stretches of the text are walked side by side.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.where(rank > 0, order[rank - 1], -1)
    stride = -(-n // min(lanes, n))
    lane = np.arange(0, n, stride)
    h = np.zeros(len(lane), np.int64)
    for t in range(stride):
        i = lane + t
        on = i < n
        i, h = i[on], h[on]
        lane = lane[on]
        j = before[i]
        h = np.where(j >= 0, np.maximum(h - 1, 0), 0)
        busy = np.flatnonzero(j >= 0)
        while len(busy):
            x, y = i[busy] + h[busy], j[busy] + h[busy]
            more = (h[busy] < most) & (x < n) & (y < n)
            more &= data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)]
            busy = busy[more]
            h[busy] += 1
        out[rank[i]] = h
    return out


def least_of_windows(data: np.ndarray, doc: np.ndarray, is_start: np.ndarray, window: int):
    """Windows in suffix order, the least document among those equal to each, and the number of its group."""
    order, rank = suffix_array(data)
    prefix = common_prefixes(data, order, rank, window)
    new = prefix < window
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    starts = is_start[order]
    value = np.where(starts, doc[order], b.NO_ID)
    least = np.minimum.reduceat(value, np.flatnonzero(new)) if len(new) else value
    return order[starts], least[group[starts]], group[starts]


def _shard(window: int):
    """Decide the windows of one part of a shard. Equal pieces are sorted once, for the least of their documents."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts, bucket = int(group["parts"].iloc[0]), int(group["bucket"].iloc[0])
        got, gids = [b.expand(x) for x in group["data"]], group["gid"].to_numpy()
        seen, number = {}, []
        for x in got:
            ends = np.cumsum(x["windows"] + window - 1).tolist()
            number += [seen.setdefault(x["bytes"][low:high], len(seen)) for low, high in zip([0, *ends], ends)]
        number, docs = np.array(number, np.int64), np.concatenate([x["docs"] for x in got])
        windows = np.concatenate([x["windows"] for x in got])
        first = np.full(len(seen), b.NO_ID)
        np.minimum.at(first, number, docs)

        lens = np.fromiter(map(len, seen), np.int64, len(seen))
        data = np.frombuffer(b"".join(seen), np.uint8)
        piece = np.repeat(np.arange(len(seen)), lens)
        is_start = np.arange(len(data)) + window <= np.cumsum(lens)[piece]
        doc = first[piece]
        at, least, _ = least_of_windows(data, doc, is_start, window)
        gone = np.zeros(len(data), bool)
        gone[at] = doc[at] > least

        # From the windows of each piece to those of its copies.
        begin = (np.cumsum(lens) - lens)[number]
        inside = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        bits = gone[np.repeat(begin, windows) + inside] | np.repeat(docs > first[number], windows)
        total = np.array([int(x["windows"].sum()) for x in got])
        rows = [
            (int(gid), bucket, 0, b.squeeze(np.packbits(x))) for gid, x in zip(gids, np.split(bits, np.cumsum(total)[:-1]), strict=True)
        ]
        if parts > 1:
            batch = np.repeat(np.arange(len(got)), [len(x["windows"]) for x in got])
            local = np.cumsum(windows) - windows - (np.cumsum(total) - total)[batch]
            held = np.flatnonzero(docs == first[number])
            held = held[np.argsort(number[held], kind="stable")]
            open_at = at[doc[at] == least]
            low = np.searchsorted(number[held], piece[open_at], side="left")
            n = np.searchsorted(number[held], piece[open_at], side="right") - low
            each = np.repeat(np.arange(len(open_at)), n)
            copy = held[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(each))]
            at = open_at[each]
            place = local[copy] + at - (np.cumsum(lens) - lens)[piece[at]]
            rows += _open_windows(data, at, doc[at], gids[batch[copy]], place, window, bucket, parts)
        return pd.DataFrame(rows, columns=["gid", "bucket", "kind", "data"])

    return run


def _open_windows(data, at, docs, gids, place, window, bucket, parts) -> Iterator[tuple]:
    """Rows for the merge, by a hash of the window's first bytes: windows in order, document, batch and number."""
    text = np.lib.stride_tricks.sliding_window_view(data, window)[at]
    owner = mix(_words8(data)[at]) % np.uint64(parts)
    for r in np.unique(owner).tolist():
        mine = owner == r
        made = {"text": text[mine].tobytes(), "docs": docs[mine], "gid": gids[mine], "number": place[mine]}
        yield int(r), bucket, 1, b.squeeze(made)


def _merge(window: int):
    """Windows of several parts of a shard, each list in order: which ones have a smaller document in another part."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = [b.expand(x) for x in group["data"]]
        # Bytes at the end may be 0, which numpy's strings drop: a closing byte keeps them.
        lists = [np.frombuffer(x["text"], np.uint8).reshape(-1, window) for x in got]
        lists = [np.c_[x, np.ones(len(x), np.uint8)].view(f"S{window + 1}").ravel() for x in lists]
        least = [x["docs"].copy() for x in got]
        for i, mine in enumerate(lists):
            for j, other in enumerate(lists):
                if i != j:
                    at = np.searchsorted(other, mine)
                    hit = at < len(other)
                    hit[hit] = other[at[hit]] == mine[hit]
                    least[i][hit] = np.minimum(least[i][hit], got[j]["docs"][at[hit]])
        rows = []
        for x, low in zip(got, least, strict=True):
            gone = np.flatnonzero(low < x["docs"])
            for gid in np.unique(x["gid"][gone]).tolist():
                rows.append((gid, int(group["bucket"].iloc[0]), b.squeeze(x["number"][gone][x["gid"][gone] == gid])))
        return pd.DataFrame(rows, columns=["gid", "bucket", "data"])

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty; texts below `window` bytes lose nothing. A null doc_id counts as greater than all others, so
    such a document removes nothing elsewhere. Documents that share a doc_id remove nothing from each other. Extra columns
    are ignored; an empty table gives an empty table.
    """
    packed = b.pack(documents, byte_content)
    owners = packed.owners
    bits = min(64, max(32, packed.size.bit_length() + SPARE_BITS))

    def keys_of(content):
        key, start, count, doc = pieces(content, window)
        key = key >> np.uint64(64 - bits)
        return (*b.distinct(key, content["ids"][doc]), key, start, count, doc)

    def ask(row, content):
        keys, least, most, *_ = keys_of(content)
        for bucket, gid, data in b.questions(row["gid"], keys, bits, owners, least != most):
            yield gid, bucket, data

    asked = b.each_batch(packed.table.select("gid", "blob"), ask, "gid long, bucket long, data binary")
    repeated = stored(b.ask_repeated(asked), "anchors")

    def send(row, content):
        keys, _, _, number, key, start, count, doc = keys_of(content)
        if not len(keys):
            return
        live = np.flatnonzero(b.answers(row, "anchors", keys, bits, owners, bool)[number])
        bucket = np.searchsorted(b.cut(keys, bits, owners * SHARDS_PER_OWNER)[1:], number[live], side="right")
        ids, text = content["ids"], content["bytes"]
        seen, mine = {}, np.zeros(len(live), np.int64)
        for k, i in enumerate(live.tolist()):
            mine[k] = seen.setdefault(text[start[i] : start[i] + count[i] + window - 1], len(seen))
        first = np.full(len(seen), b.NO_ID)
        np.minimum.at(first, mine, ids[doc[live]])
        one = np.full(len(seen), -1)
        one[mine[::-1]] = np.arange(len(live))[::-1]
        # Copies inside the batch travel once, for the least of their documents.
        of, slot = bucket[one], np.zeros(len(seen), np.int64)
        whole = list(seen)
        for x in np.unique(of).tolist():
            at = np.flatnonzero(of == x)
            slot[at] = np.cumsum(count[live[one[at]]]) - count[live[one[at]]]
            joined = b"".join(whole[i] for i in at.tolist())
            made = b.squeeze({"windows": count[live[one[at]]], "docs": first[at], "bytes": joined})
            yield 1, row["gid"], x, len(joined), made
        kept = {"start": start[live], "count": count[live], "bucket": bucket, "slot": slot[mine], "first": first[mine], "doc": doc[live]}
        yield 0, row["gid"], -1, 0, b.squeeze(kept)

    rows = b.with_answers(packed, anchors=repeated)
    sent = stored(b.each_batch(rows, send, "kind long, gid long, bucket long, size long, data binary"), "pieces")
    shards = sent.where("kind = 1")
    parts = shards.groupBy("bucket").agg(F.ceil(F.sum("size") / part_bytes).cast("long").alias("parts"))
    placed = shards.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")))
    decided = placed.groupBy("bucket", "part").applyInPandas(_shard(window), "gid long, bucket long, kind long, data binary")
    decided = stored(decided, "decided")
    # In rows of kind 1, gid is the number of the merge.
    merged = decided.where("kind = 1").groupBy("bucket", "gid").applyInPandas(_merge(window), "gid long, bucket long, data binary")
    told = {
        "kept": sent.where("kind = 0").select("gid", "bucket", "data"),
        "bits": decided.where("kind = 0").select("gid", "bucket", "data"),
        "more": merged,
    }

    def finish(row, content):
        ids, lens, data = content["ids"], content["lens"], np.frombuffer(content["bytes"], np.uint8)
        edge = np.zeros(len(data) + 1, np.int64)
        kept = b.told(row, "kept")
        if kept:
            k = b.expand(kept[-1])
            total = int(k["count"].sum())
            flags = {x: np.unpackbits(b.expand(v)) for x, v in b.told(row, "bits").items()}
            for x in row["more"] or []:
                flags[x["bucket"]][b.expand(x["data"])] = 1
            at = np.repeat(np.arange(len(k["start"])), k["count"])
            inside = np.arange(total) - np.repeat(np.cumsum(k["count"]) - k["count"], k["count"])
            gone = (ids[k["doc"]] > k["first"])[at]
            if flags:
                names = np.array(sorted(flags))
                flat = np.concatenate([flags[x] for x in names.tolist()])
                base = np.cumsum([0, *(len(flags[x]) for x in names.tolist())])[:-1]
                gone |= flat[(base[np.searchsorted(names, k["bucket"])] + k["slot"])[at] + inside].astype(bool)
            start = (k["start"][at] + inside)[gone]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + window, -1)
        removed = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(lens).tolist()
        for i, end in enumerate(ends):
            low = ends[i - 1] if i else 0
            part, text = removed[low:end], data[low:end]
            n = int(part.sum())
            spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()) if n else 0
            kept_text = text[~part] if n else text
            name = None if content["null"][i] else int(ids[i])
            yield name, int(lens[i]), n, spans, hashlib.sha256(kept_text.tobytes()).hexdigest()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return b.each_batch(b.with_answers(packed, **told), finish, schema)
