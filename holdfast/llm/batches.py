"""Documents packed in batches, and questions from batches to the whole corpus.

`pack` writes the documents once, as compressed batches of a few MB, to a table bucketed by batch. Later steps join what
they learned about a batch to it, without shuffling the texts again. A document is known by its batch and its position in
it, so repeated and missing ids do no harm.

`ask_repeated` and `ask_least` send the keys (hashes) of each batch, sorted and without repeats, to the tasks that own the
ranges of the keys, and bring an answer for each key back to the batch. A key that a third of all documents hold is sent
once per batch.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.words import slices
from holdfast.session import work_path

BATCH_BYTES = 4 << 20
BATCH_ROWS = 20_000
NO_ID = np.iinfo(np.int64).max


def squeeze(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def expand(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(values: np.ndarray) -> tuple[np.dtype, bytes]:
    """The bytes of the numbers by significance, which compresses small numbers well."""
    return values.dtype.str, values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplanes(packed: tuple[str, bytes]) -> np.ndarray:
    kind = np.dtype(packed[0])
    return np.ascontiguousarray(np.frombuffer(packed[1], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


@dataclass
class Packed:
    """The table (gid, n, size, blob), and how many batches and bytes it holds."""

    table: DataFrame
    batches: int
    size: int

    @property
    def owners(self) -> int:
        """Key ranges: as many as keep the keys of one range at those of a few batches."""
        return max(16, self.batches // 2)


def ids_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id, with NO_ID for null, and whether it is null."""
    column = part.column("doc_id")
    null = np.asarray(column.is_null())
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), null


def pack(documents: DataFrame, content: Callable[[pa.RecordBatch], dict]) -> Packed:
    """Write the documents (doc_id, text) in batches. `content` makes the dict to keep of a batch from its rows."""
    spark = documents.sparkSession

    def run(batches):
        task = TaskContext.get().partitionId()
        for i, part in enumerate(slices(batches, "text", BATCH_BYTES, BATCH_ROWS)):
            made = content(part)
            row = [[(task << 32) | i], [part.num_rows], [part.column("text").nbytes], [squeeze(made)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["gid", "n", "size", "blob"],
            )

    thin = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = thin.mapInArrow(run, "gid long, n long, size long, blob binary")
    name = f"packed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "gid").option("path", work_path(spark, name)).saveAsTable(name)
    table = spark.table(name)
    total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return Packed(table, total[0], total[1])


def with_answers(packed: Packed, **told: DataFrame) -> DataFrame:
    """The batches with, for each name, the list of what was `told` (gid, bucket, data) to each of them."""
    rows = packed.table.select("gid", "blob")
    for name, answers in told.items():
        mine = answers.groupBy("gid").agg(F.collect_list(F.struct("bucket", "data")).alias(name))
        rows = rows.join(mine, "gid", "left")
    return rows


def told(row: dict, name: str) -> dict[int, bytes]:
    """Data by bucket."""
    return {x["bucket"]: x["data"] for x in row[name] or []}


def each_batch(rows: DataFrame, step: Callable[[dict, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply `step` (row, content of its batch), which yields tuples of the schema's columns."""
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in rows.sparkSession.createDataFrame([], schema).schema])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made = list(step(row, expand(row["blob"])))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow.types, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def cut(keys: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Where sorted keys of so many bits pass from one owner's range to the next: owners + 1 positions."""
    edges = (np.arange(1, owners, dtype=object) * (1 << bits) // owners).astype(np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the least and greatest document of each, and the key's number for each given one."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(k)] - 1 if len(k) else first
    number = np.empty(len(k), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(k)]))
    return k[first], d[first], d[last], number


def questions(gid: int, keys: np.ndarray, bits: int, owners: int, extra: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, gid, data) of sorted distinct keys and a value for each."""
    edges = cut(keys, bits, owners)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        at = slice(edges[b], edges[b + 1])
        steps = np.diff(keys[at], prepend=np.uint64(0))
        values = np.packbits(extra[at]) if extra.dtype == bool else extra[at]
        yield b, gid, squeeze((planes(steps), planes(values)))


def answers(row: dict, name: str, keys: np.ndarray, bits: int, owners: int, kind) -> np.ndarray:
    """The answers to `questions`, in the order of the keys."""
    edges, got = cut(keys, bits, owners), told(row, name)
    out = np.zeros(len(keys), kind)
    for b, data in got.items():
        n = edges[b + 1] - edges[b]
        values = unplanes(expand(data))
        out[edges[b] : edges[b + 1]] = np.unpackbits(values, count=n).astype(bool) if kind is bool else values
    return out


def _by_bucket(rows: DataFrame, answer: Callable[[list[np.ndarray], list[np.ndarray]], Iterator[np.ndarray]]) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = [expand(x) for x in group["data"]]
        keys = [np.cumsum(unplanes(k)) for k, _ in asked]
        data = [squeeze(planes(np.ascontiguousarray(x))) for x in answer(keys, [unplanes(v) for _, v in asked])]
        return pd.DataFrame({"gid": group["gid"], "bucket": group["bucket"], "data": data})

    return rows.groupBy("bucket").applyInPandas(run, "gid long, bucket long, data binary")


def ask_repeated(rows: DataFrame) -> DataFrame:
    """For every key: whether batches or documents of one batch share it. Values say whether documents of the batch do."""

    def answer(keys, flags):
        many = [np.unpackbits(f, count=len(k)).astype(bool) for k, f in zip(keys, flags, strict=True)]
        whole = np.sort(np.concatenate(keys))
        twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
        for k, m in zip(keys, many, strict=True):
            if len(twice):
                at = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
                m = m | (twice[at] == k)
            yield np.packbits(m)

    return _by_bucket(rows, answer)


def ask_least(rows: DataFrame) -> DataFrame:
    """For every key: the least of the values (documents) of all batches."""

    def answer(keys, docs):
        whole, value = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((value, whole))
        whole, value = whole[order], value[order]
        first = np.r_[True, whole[1:] != whole[:-1]]
        whole, value = whole[first], value[first]
        for k in keys:
            yield value[np.searchsorted(whole, k)]

    return _by_bucket(rows, answer)
