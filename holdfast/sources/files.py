"""CSV and JSON files."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions below travel with the tasks, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REASON = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("reason_human", T.StringType()),
        T.StructField("impact", T.DoubleType()),
        T.StructField("value", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("student_id", T.StringType()),
        T.StructField("asof_date", T.StringType()),
        T.StructField("prob_churn", T.DoubleType()),
        T.StructField("top_reasons", T.ArrayType(REASON)),
        *[T.StructField(c, T.StringType()) for c in ("email", "customer_email", "name", "customer_name")],
        *[T.StructField(c, T.StringType()) for c in ("product", "plan", "segment", "language", "campaign_id")],
        T.StructField("days_inactive", T.LongType()),
        T.StructField("last_interaction_at", T.StringType()),
    ]
)

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_BLANK = b" \t\r\n\xef\xbb\xbf"
_STATE = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("first", pa.binary()), ("odd", pa.int32())]
    + [(c, pa.int64()) for c in ("depth_0", "depth_1", "low_0", "low_1")]
)
_RECORD_PART = pa.schema([("file", pa.string()), ("origin", pa.int64()), ("at", pa.int64()), ("record", pa.binary())])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; a byte-order mark is not part of the first name."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False).columns


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes, so that a value goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def csv_scan(
    spark: SparkSession, path: str, multi_line: bool | None = None, header: list[str] | None = None
) -> DataFrame:
    """All columns as text. Fields beyond the header are dropped; a short row is filled with NULLs.

    Files with line breaks inside quotes are read whole, by one task each; that is found out by a look at the lines
    unless ``multi_line`` says it.
    """
    if multi_line is None:
        multi_line = has_open_quotes(spark, path)
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE"}
    reader = spark.read.options(**options)
    if header is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
    return reader.csv(path)


def csv_write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Blanks around a value are part of it."""
    df.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def _json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files' text cut behind every closing brace, with the file split of each piece, in order within a split."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """((file, start), pieces) of consecutive pieces of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, at = [batch.column(c) for c in ("file", "start")], 0
        if all(k[0] == k[-1] for k in keys):
            splits = [(keys[0][0].as_py(), keys[1][0].as_py())] * batch.num_rows
        else:
            splits = list(zip(*(k.to_pylist() for k in keys)))
        for split, same in groupby(splits):
            n = len(list(same))
            yield split, batch.column("piece").slice(at, n).to_pylist()
            at += n


def _unquoted(piece: bytes) -> list[bytes]:
    """The piece cut at its quotes: its parts are in turn outside and inside of strings."""
    return (_ESCAPED.sub(b"", piece) if b"\\" in piece else piece).split(b'"')


def _depth_change(parts: list[bytes], quoted: int) -> int:
    """How many levels a piece opens before its end, if it starts outside (0) or inside (1) of a string."""
    outside = b"".join(parts[quoted::2])
    return outside.count(b"{") + outside.count(b"[") - outside.count(b"]")


def _split_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: its first character, whether it has an odd number of quotes, and for a start outside and inside of a
    string the change of depth and the least depth behind a piece."""
    states: dict = {}
    for split, pieces in _by_split(batches):
        first, quoted, depth, least = states.get(split, (b"", [0, 1], [0, 0], [None, None]))
        for piece in pieces:
            first = first or piece.lstrip(_BLANK)[:1]
            parts = _unquoted(piece)
            for k in (0, 1):
                depth[k] += _depth_change(parts, quoted[k])
                quoted[k] ^= (len(parts) - 1) & 1
                if not quoted[k]:
                    depth[k] -= 1
                    least[k] = depth[k] if least[k] is None else min(least[k], depth[k])
        states[split] = first, quoted, depth, least
    rows = [(*split, first, q[0], *d, *low) for split, (first, q, d, low) in states.items()]
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_STATE.names, r)) for r in rows], schema=_STATE)


def _split_starts(states: list) -> tuple[dict, list[str]]:
    """(depth, whether inside of a string, split that holds the start of the open record) at the start of every split; and
    the files whose brackets do not fit."""
    starts, broken = {}, []
    for file, rows in groupby(sorted(states, key=lambda r: (r["file"], r["start"])), key=lambda r: r["file"]):
        depth, quoted, origin = 0, 0, 0
        for r in rows:
            starts[file, r["start"]] = depth, quoted, origin
            low = r[f"low_{quoted}"]
            # The depth between two records is 1.
            if depth < 2 and not quoted or low is not None and depth + low <= 1:
                origin = r["start"]
            depth, quoted = depth + r[f"depth_{quoted}"], quoted ^ r["odd"]
        # The end of a file counts as a closing brace.
        if depth != -1 or quoted:
            broken.append(file)
    return starts, broken


def _records(starts: dict, whole: bool):
    """A task function that puts the pieces together: records within a split (``whole``), or the parts of those that splits cut."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, out = None, []
        depth = quoted = origin = 0
        waiting: list[bytes] = []

        def part() -> None:
            if waiting and not whole:
                out.append({"file": here[0], "origin": origin, "at": here[1], "record": b"".join(waiting)})

        for split, pieces in _by_split(batches):
            if split != here:
                part()
                here, waiting = split, []
                depth, quoted, origin = starts[split]
            for piece in pieces:
                parts = _unquoted(piece)
                if depth < 2 and not quoted:
                    waiting, origin = [], here[1]
                    mark, text = (b"," if depth else b"["), piece.lstrip(_BLANK)
                    piece = text[1:] if text[:1] == mark else text
                depth += _depth_change(parts, quoted)
                quoted ^= (len(parts) - 1) & 1
                if quoted or depth - 1 >= 1:
                    waiting.append(piece + b"}")
                    depth -= not quoted
                    if depth != 1 or quoted:
                        continue
                else:
                    # The end of the file: nothing but the closing bracket, unless something else than records is listed.
                    depth -= 1
                    waiting.append(piece if piece.strip(_BLANK).strip(b"]") else b"")
                if origin != here[1]:
                    part()
                elif whole and waiting != [b""]:
                    out.append({"file": None, "origin": None, "at": None, "record": b"".join(waiting)})
                waiting = []
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD_PART)
                out.clear()
        part()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD_PART)

    return run


def json_records_scan(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of files that each hold one JSON array; any other top level is an error.

    A file is read by as many tasks as it has splits, wherever its line breaks are. A first look at all splits tells
    at which depth and whether inside of a string each one starts; the records that splits cut are put together by a
    shuffle of their parts alone. A record that cannot be parsed is a row of NULLs; a file whose brackets do not fit
    is left to Spark, which reads it whole.
    """
    pieces = _json_pieces(spark, path)
    # A row per split.
    states = pieces.mapInArrow(_split_states, "file string, start long, first binary, odd int, depth_0 long, depth_1 long, low_0 long, low_1 long").collect()
    starts, broken = _split_starts(states)
    firsts: dict[str, bytes] = {}
    for r in sorted(states, key=lambda r: (r["file"], r["start"])):
        firsts[r["file"]] = firsts.get(r["file"]) or bytes(r["first"])
    wrong = [file for file, first in firsts.items() if first not in (b"", b"[")]
    if wrong:
        raise ValueError(f"expected a JSON array of records in {wrong[0]}")
    kind = "file string, origin long, at long, record binary"
    sound = pieces if not broken else pieces.where(~F.col("file").isin(broken))
    texts = sound.mapInArrow(_records(starts, whole=True), kind).select("record")
    if any(depth > 1 or quoted for depth, quoted, _ in starts.values()):
        parts = sound.mapInArrow(_records(starts, whole=False), kind).groupBy("file", "origin")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda p: p["record"].cast("string")), "")
        texts = texts.unionByName(parts.agg(joined.cast("binary").alias("record")).select("record"))
    found = texts.select(F.from_json(F.col("record").cast("string"), schema).alias("record")).select("record.*")
    if broken:
        found = found.unionByName(spark.read.schema(schema).json(broken, multiLine=True))
    return found


def json_export(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON object per line, UTF-8, NULL fields kept."""
    df.write.mode(mode).json(path, ignoreNullFields=False)
    return path


def json_lines_scan(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)
