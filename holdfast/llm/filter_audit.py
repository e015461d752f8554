"""Which filter removes what, in every order of five filters.

Filters: A under 100 words; B fewer than 80 distinct words in 100; C more than 10 capitals (A-Z) in 100 code points;
D any of #$%&*|; E the same text as a document with a smaller doc_id anywhere in the table.

E is an existential self-join: rows whose text hash occurs under different ids are matched, by a left-semi join on hash,
exact text and smaller doc_id, with the first holder of every such text. The ids that E fails are united with those
that the other filters fail, and both become one number of five bits per document. What any order of the filters
removes follows from how many documents have each of the 32 combinations, so the 120 orders cost nothing per document.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import heavy, stored
from holdfast.llm.words import coded, slices, split
from holdfast.operators.membership import possible

# Fixed values of the five filters.
FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"

_E_BIT = 1 << FILTERS.index("E")
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between each two edges."""
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[edges[1:]] - total[edges[:-1]]


def text_failures(texts: pa.Array) -> np.ndarray:
    """Bits of A to D for every text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    words, owner = split(texts)
    distinct, codes = coded(words)
    n_words = np.bincount(owner, minlength=n)
    pairs = np.unique(owner * max(1, len(distinct)) + codes)
    n_distinct = np.bincount(pairs // max(1, len(distinct)), minlength=n)
    capitals, points = _sums(_CAPITAL[data], edges), _sums((data & 0xC0) != 0x80, edges)
    failed = [
        n_words < LEAST_WORDS,
        100 * n_distinct < DISTINCT_PERCENT * n_words,
        100 * capitals > CAPITAL_PERCENT * points,
        _sums(_SYMBOL[data], edges) > 0,
    ]
    return sum(f.astype(np.int64) << i for i, f in enumerate(failed))


def _facts(batches):
    for piece in slices(batches, "text"):
        bits = pa.array(text_failures(piece.column("text")))
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "part", "mark")), bits], ["doc_id", "part", "mark", "bits"])


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, bits, n): how many rows of each document and part fail which filters (bit 0 is A).

    A null text is an empty one, so null and empty texts are identical; a null lang is the part ''. A null doc_id is
    smaller than none: such a row never fails E and makes no other row fail it. Rows that repeat a doc_id are judged by
    their own texts and do not make each other fail E. Extra columns are ignored; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )
    facts = stored(docs.mapInArrow(_facts, "doc_id long, part string, mark long, bits long"), "facts")
    copies = _later_copies(docs, facts).select("doc_id", "part", "mark", F.lit(_E_BIT).cast("long").alias("bits"), F.lit(0).alias("n"))
    united = facts.withColumn("n", F.lit(1)).unionByName(copies)
    # Rows with the same id and text fail the same filters.
    united = united.groupBy("doc_id", "part", "mark").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return united.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))


def _later_copies(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of `docs` whose text a smaller doc_id has too.

    Only texts whose hash occurs under different ids are shuffled. A hash that more than one row in 1024 has is dealt to
    as many parts as keep to that share, each with its own copy of the text's first holder.
    """
    ids = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("rows")]
    repeated = stored(facts.groupBy("mark").agg(*ids).where("least < most"), "repeated")
    n, total = repeated.count(), facts.count()
    suspects = possible(docs, "mark", repeated, "mark", n)
    firsts = suspects.groupBy("mark", "text").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    hot = heavy(repeated, "mark", "rows", total)
    firsts = firsts.where("least < most").join(F.broadcast(hot), "mark", "left")
    firsts = firsts.select("mark", "text", "least", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("salt"))
    later = suspects.join(F.broadcast(hot), "mark", "left")
    later = later.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int"))
    a, b = later.alias("a"), firsts.alias("b")
    same = (F.col("a.mark") == F.col("b.mark")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text"))
    return a.join(b, same & (F.col("a.doc_id") > F.col("b.least")), "left_semi")


def order_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the filter, bits of the filters before) of every step of every order."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, 1 << i, before))
            before |= 1 << i
    return steps


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang), filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Nulls, repeats and empty tables as in `failures`. A document is good (toxic) if any row of `labels` with its doc_id
    says so; labels without an id, or of unknown documents, count nowhere.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    told = told.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("good").alias("good"), F.bool_or("bad").alias("bad"))
    rows = failures(documents).join(told, "doc_id", "left")

    def counted(flag):
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))

    # At most 32 rows a part from here on; each meets the 600 steps.
    combinations = rows.groupBy("part", "bits").agg(F.sum("n").alias("n"), counted("good").alias("good"), counted("bad").alias("bad"))
    steps = F.array(*[F.struct(*map(F.lit, s)) for s in order_steps()]).cast("array<struct<filter_order:string,step:int,own:bigint,before:bigint>>")
    met = combinations.select("*", F.inline(steps))
    fails, earlier = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0

    def total(of, when):
        return F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")

    report = met.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("bits") == F.col("own")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("bad", fails & ~earlier).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shares = report.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return report.withColumn("letter", letter).join(shares, ["part", "letter"]).drop("letter")
