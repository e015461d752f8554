"""SimHash near copies by deletion-variant signatures.

A fingerprint has 64 bits, each the majority over the hashes of a document's word shingles. Two fingerprints link if at
most two bits differ. Cut into two segments, one of the segments then differs in at most one bit. So every fingerprint is
indexed under each of its segments with one bit wiped out (32 variants a segment); fingerprints that link meet under an
equal variant, by an equality join, and are verified on all bits.

Equal fingerprints are one node, so copies cost one row per task. A variant that many different fingerprints share is
not paired within: its members are indexed again, by the same rule, on the segment that has not been looked at, whose
halves differ in at most one bit too. The fourth level leaves at most eight bits open, so a variant there has few members.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components, is_heavy, merged, stored
from holdfast.llm.words import slices, split, starts_of

SHINGLE = 3
HASH_SEED = 42
BITS = 64
DISTANCE = 2
# Members of a variant that are paired at once; variants with more are cut further.
PAIRED = 32
LEAST_WIDTH = 8

_PIECE = 1 << 17
# The bits of a byte, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _hashed(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, raw, repeat(HASH_SEED)), np.uint64, len(raw))


def shingle_hashes(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle of `k` words, in order of the texts; a text of fewer words is one shingle."""
    n = len(texts)
    words, owner = split(texts, lower=True)
    words = words.cast(pa.binary())
    first, counts = starts_of(owner, n)
    long = np.flatnonzero(owner[: max(0, len(owner) - k + 1)] == owner[k - 1 :])
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, len(long), _PIECE):
        place = long[at : at + _PIECE]
        a, b = int(place[0]), int(place[-1]) + 1
        joined = pc.binary_join_element_wise(*(words.slice(a + i, b - a) for i in range(k)), b" ")
        # Starts that run into the next text are hashed with the rest and left out after it.
        hashes.append(_hashed(joined.to_pylist())[place - a])
        owners.append(owner[place])
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = [b" ".join(words.slice(first[i], counts[i]).to_pylist()) for i in short.tolist()]
    h, own = np.concatenate([*hashes, _hashed(whole)]), np.concatenate([*owners, short])
    order = np.argsort(own, kind="stable")
    return h[order], own[order]


def fingerprints(texts: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of every text: a bit is set if over half of the shingle hashes have it. No words: zero."""
    n = len(texts)
    h, owner = shingle_hashes(texts, k)
    first, counts = starts_of(owner, n)
    # Sums of up to 255 shingles of one text, eight counters in one number.
    parts = -(-counts // 255)
    begin = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    total = np.zeros((n, BITS), np.int64)
    if len(begin):
        of = np.repeat(np.arange(n), parts)
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for byte, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            lanes = np.add.reduceat(_SPREAD[column], begin).view(np.uint8).reshape(-1, 8)
            total[of[head], 8 * byte : 8 * byte + 8] = np.add.reduceat(lanes, head, axis=0, dtype=np.int64)
    major = (2 * total > counts[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


def _documents(k: int):
    def run(batches):
        for piece in slices(batches, "text"):
            fp = pa.array(fingerprints(piece.column("text"), k).view(np.int64))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), fp], ["doc_id", "fp"])

    return run


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """Each row once for every one-wildcard variant of the two halves of the `width` bits from its `offset`.

    `key` names all that is fixed so far, `bit` is the bit wiped out, and `offset` moves on to the other half.
    """
    half = width // 2
    wide = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("v"))
    upper, place = F.col("v") >= half, F.pmod("v", F.lit(half))
    start = F.col("offset") + F.when(upper, half).otherwise(0)
    segment = F.call_function("shiftrightunsigned", F.col("fp"), start).bitwiseAND(F.lit((1 << half) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return wide.select(
        "node",
        "fp",
        F.xxhash64("key", F.lit(width), "v", segment.bitwiseAND(F.bitwise_not(one))).alias("key"),
        (F.col("offset") + F.when(upper, 0).otherwise(half)).cast("int").alias("offset"),
        place.alias("place"),
        (segment.bitwiseAND(one) != 0).alias("bit"),
    )


def near_links(nodes: DataFrame, distance: int = DISTANCE, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between the `node`s whose fingerprints differ in one to `distance` (at most 2) bits.

    `nodes` has (node, fp) with every fingerprint once. Every such pair is found, some of them more than once.
    """
    links, width = None, BITS
    rows = nodes.select("node", "fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("offset"))
    while True:
        wide = _variants(rows, width)
        ends = [F.count(F.lit(1)).alias("members"), F.min("bit").alias("low"), F.max("bit").alias("high"), F.max("place").alias("at")]
        # Members that agree in a whole segment meet under its variant 0; under the others only those that differ in it count.
        sizes = wide.groupBy("key").agg(*ends).where("members > 1 AND (at = 0 OR low <> high)").select("key", "members")
        met = stored(wide.drop("place", "bit").join(merged(sizes), "key"), "variants")
        last = width <= LEAST_WIDTH
        few = met if last else met.where(F.col("members") <= paired)
        a, b = few.select("key", F.col("node").alias("a"), F.col("fp").alias("x")), few.select("key", F.col("node").alias("b"), F.col("fp").alias("y"))
        near = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
        found = stored(a.join(merged(b), "key").where(near).select("a", "b"), "near")
        links = found if links is None else links.unionByName(found)
        rows = met.where(F.col("members") > paired).select("node", "fp", "key", "offset")
        if last or rows.isEmpty():
            return links
        width //= 2


def near_copies(documents: DataFrame, k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fp (the fingerprint as a signed long), component_id.

    Texts without words, null ones included, have fingerprint zero and link with each other and with what is within
    the distance of zero. A row with a null doc_id has its fingerprint, a null component_id and links with nothing. Rows
    that repeat a doc_id are separate documents. Extra columns are ignored; an empty table gives an empty table.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stored(docs.mapInArrow(_documents(k), "doc_id long, fp long"), "fingerprints")
    named = base.where("doc_id IS NOT NULL")
    nodes = named.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    # A node sorts by its least doc_id, so the root of a component begins with the component's id.
    nodes = stored(nodes.select(F.struct("least", "fp").alias("node"), "fp", "least", "rows"), "nodes")
    roots = components(near_links(nodes, distance), "a", "b")
    linked = roots.select(F.col("node.fp").alias("fp"), F.col("root.least").alias("component_id"))
    known = stored(nodes.join(merged(linked), "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id")), "classes")
    total = named.count()
    hot = known.where(is_heavy("rows", total)).select("fp", "component_id")
    first = named.join(F.broadcast(hot), "fp", "left")
    rest = first.where("component_id IS NULL").select("doc_id", "fp").join(merged(known.select("fp", "component_id")), "fp")
    nameless = base.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    columns = ["doc_id", "fp", "component_id"]
    return first.where("component_id IS NOT NULL").select(columns).unionByName(rest.select(columns)).unionByName(nameless.select(columns))


def as_hex(fp):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
