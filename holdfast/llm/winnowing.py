"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII. A window is `span` consecutive
words of an item; an item with fewer words is one window. Both sides keep, of every run of `span - gram + 1` consecutive
word grams, the one with the least hash (the first of equals): a span that documents and items share holds the same kept
gram, so joining kept grams misses none; grams are joined by hash. Shorter items have spans, and so kept grams, of their own length. Every hit is
extended to the windows around it, which are compared as text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import stored

SPAN = 10
GRAM = 5

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = (1 << 31) - 1


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed. Texts in ASCII take the short way to the same result."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _upto(last: Column) -> Column:
    """1, 2, ..., last; empty if last < 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _paired(array: Column, other: Column, shift: int, size: Column, step) -> Column:
    """step(array[i], other[i + shift]) for all i at which both are there; `size` is the size of `other`."""
    left = F.greatest(size - shift, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), left), F.slice(other, F.lit(shift + 1), left), step)


def _with_runs(rows: DataFrame, one: str, out: str, length: int, step, joint: bool) -> DataFrame:
    """Adds `out`: of every `length` consecutive values of `one`, the value of all by `step`, put together by doubling.

    With `joint` the two halves of a run may overlap, as they may for a least value; else they follow each other.
    """
    names, done = {1: one}, 1
    while done < length:
        half = min(done, length - done)
        if half not in names:
            half = max(n for n in names if n <= half)
        shift = length - done if joint and 2 * done >= length else done
        other = names[done] if joint else names[half]
        to = done + (shift if joint else half)
        rows = rows.withColumn(f"{out}_{to}", _paired(F.col(names[done]), F.col(other), shift, F.size(other), step))
        done = to
        names[done] = f"{out}_{to}"
    return rows.withColumn(out, F.col(names[length])).drop(*[n for n in names.values() if n != one])


def _kept_grams(rows: DataFrame, spans: list[int]) -> DataFrame:
    """Rows (key columns, span, hash, pos) of the grams that winnowing keeps from the `words` of each row, for every span.

    Words are hashed once, grams once for each gram length, and the least of a window by few shifted comparisons.
    """
    keys = [c for c in rows.columns if c != "words"]
    out = rows.select(*keys, F.transform("words", lambda w: F.hash(w)).alias("marks"))
    grams = sorted({min(GRAM, s) for s in spans})
    for gram in grams:
        out = _with_runs(out, "marks", "run", gram, lambda a, b: F.hash(a, b), joint=False)
        out = out.withColumn(f"grams_{gram}", F.transform("run", _placed)).drop("run")
    for span in spans:
        gram = min(GRAM, span)
        out = _with_runs(out, f"grams_{gram}", f"least_{span}", span - gram + 1, lambda a, b: F.least(a, b), joint=True)
    kept = [F.struct(F.lit(s).alias("span"), F.array_distinct(f"least_{s}").alias("kept")) for s in spans]
    kept = out.select(*keys, F.inline(F.array(*kept))).select(*keys, "span", F.explode("kept").alias("kept"))
    pos = F.col("kept").bitwiseAND(F.lit(_LOW)).cast("int")
    return kept.select(*keys, "span", F.shiftright("kept", 31).alias("hash"), pos.alias("pos"))


def _placed(gram: Column, at: Column) -> Column:
    """31 bits of a gram's hash above its place from 1 (arrays have at most 2^31 elements): the least one is the first of the least."""
    return F.shiftleft(gram.cast("long").bitwiseAND(F.lit(_LOW)), 31).bitwiseOR(at.cast("long") + 1)


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, span, window text of every window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("span", F.least(F.lit(span), F.size("words")))
    windows = F.transform(_upto(F.size("words") - F.col("span") + 1), lambda i: F.array_join(F.slice("words", i, F.col("span")), " "))
    return items.select("item_id", "span", F.explode(windows).alias("window"))


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, with_mark: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; on demand the text's mark.

    Null and empty texts have no words, on either side; without benchmark windows nothing is hit. Items with a null id
    count as hits but not as items. Rows that repeat a doc_id are judged by their own texts; a null doc_id is kept. Extra
    columns are ignored; an empty table gives an empty table.
    """
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words_of(text).alias("words"))
    items = stored(benchmark_windows(benchmark, span), "windows")
    spans = sorted(r.span for r in items.select("span").distinct().collect())  # span values at most
    plain = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("mark"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_ANY_CASE)).cast("long").alias("n_words"),
    )
    if not spans:
        return _report(plain.withColumns({"n_hit": F.lit(0), "items": F.array().cast("array<string>")}), with_mark)

    known = [_kept_grams(items.where(F.col("span") == n).select(F.split("window", " ").alias("words")), [n]) for n in spans]
    marks = known[0]
    for more in known[1:]:
        marks = marks.unionByName(more)
    met = _kept_grams(docs, spans).join(marks.select("span", "hash").distinct(), ["span", "hash"], "left_semi").drop("hash")
    # Rows that share id and text are looked at once from here on.
    hits = met.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("span", "pos")).alias("places"))
    hits = stored(hits, "hits").withColumnsRenamed({"doc_id": "hit_id", "mark": "hit_mark"})

    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark"))
    near = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    near = near.join(hits, same).select("doc_id", "mark", words_of(F.col("text")).alias("words"), "places")
    around = near.select("doc_id", "mark", "words", F.inline("places"))
    back = F.col("span") - F.least(F.lit(GRAM), F.col("span"))
    first, last = F.greatest(F.lit(1), F.col("pos") - back), F.least(F.col("pos"), F.size("words") - F.col("span") + 1)
    around = around.withColumn("start", F.explode(F.sequence(first, last)))
    around = around.select("doc_id", "mark", "span", "start", F.array_join(F.slice("words", F.col("start"), F.col("span")), " ").alias("window"))
    texts = items.groupBy("span", "window").agg(F.collect_set("item_id").alias("item_ids"))
    found = around.join(texts, ["span", "window"])
    covered = F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("span") - 1)))
    totals = found.groupBy("doc_id", "mark").agg(
        F.size(F.array_distinct(covered)).alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items")
    )
    totals = totals.withColumnsRenamed({"doc_id": "hit_id", "mark": "hit_mark"})
    return _report(plain.join(totals, same, "left"), with_mark)


def _report(rows: DataFrame, with_mark: bool) -> DataFrame:
    ids = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0))
    return rows.select(
        "doc_id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort(ids), ","), "UTF-8"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        *(["mark"] if with_mark else []),
    )
