"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

A document's tokens (words) are weighted by factor(source) * factor(language) * factor(topic), where the factors are
raked in turn until the weighted token shares of sources, languages and topics meet their targets. The probabilities of
the draw are such products too, raked under the bound of 1: cells at 1 stay there and the others are raked for the rest, so
that the kept tokens meet the targets. No group can keep more tokens than it has: one whose target asks for more is kept
whole, the others share what it leaves in proportion to their targets, and the driver logs the group's name.

The table is aggregated once, to one row per source with its tokens by language and topic. Sources may be many: their
factors are computed row by row in Spark. Only sums per (language, topic), per bin of source factors, and per bin of the
sources' targets come to the driver.
"""

from __future__ import annotations

import logging
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import stored

ROUNDS = 12
SOFTEN = {"source": 0.7, "lang": 0.8, "topic": 0.8}
KEEP = 0.8
BOUND_ROUNDS = 40
CLOSE = 1e-4
TOP = 1e13
BINS_PER_E = 200
SCALE = 1 << 30
CAPITALS = "[A-Z]"

_WORD = r"[^\x20\x09-\x0D]+"


def _occurrences(text: Column, characters: str) -> Column:
    """How often any of the characters occurs."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0))


def topic_of(text: Column) -> Column:
    """A rough topic by form: `short`, `table`, `markup`, `caps`, `shout` or `prose`, by shares of characters."""
    size = F.length(text)
    return (
        F.when(size < 200, "short")
        .when(_occurrences(text, "|") * 50 >= size, "table")
        .when(_occurrences(text, "#*$%&<>") * 20 >= size, "markup")
        .when(F.regexp_count(text, F.lit(CAPITALS)) * 2 >= size, "caps")
        .when(_occurrences(text, "!") * 50 >= size, "shout")
        .otherwise("prose")
    )


def _lookup(factors: dict[str, float], key: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in factors.items()))[key]


def soft_targets(totals: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to the totals raised to a power below 1: small groups gain, large ones lose."""
    raised = {k: v**power for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def describe(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, the text's checksum and the whole `row`; null source and language become ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        name("source").alias("source"),
        name("lang").alias("lang"),
        topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.struct("*").alias("row"),
    )


def bounded_factors(n: np.ndarray, x: np.ndarray, group: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For every group the factor f, up to TOP, with sum(n * min(1, f * x)) = want over its cells.

    Cells that reach 1 are fixed there and the factor is found anew from the others, until no more reach it.
    """
    sums = lambda v: np.bincount(group, v, minlength=len(want))
    there = sums(n)
    full, f = np.zeros(len(n), bool), np.ones(len(want))
    while True:
        rest, left = sums(np.where(full, 0.0, n * x)), want - sums(np.where(full, n, 0.0))
        f = np.where(rest > 0, np.clip(left, 0, None) / np.where(rest > 0, rest, 1.0), TOP)
        f = np.where(there > 0, np.where(want >= there, TOP, np.minimum(f, TOP)), 1.0)
        now = full | (f[group] * x >= 1)
        if (now == full).all():
            return f
        full = now


def attainable(wanted: np.ndarray, there: np.ndarray, total: float) -> np.ndarray:
    """Shares `wanted` of the total, cut at what is there; the cut goes to the others in proportion."""
    level = bounded_factors(there, wanted / np.where(there > 0, there, 1.0), np.zeros(len(there), int), np.array([total]))[0]
    return np.minimum(level * wanted, there)


def raked(
    described: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    rounds: int = ROUNDS,
    keep: float = KEEP,
) -> DataFrame:
    """`described` with a `weight` per token, 1.0 on average over all tokens, and a `probability`.

    `targets` may give shares by `source`, `lang` or `topic` name (of all names that occur); what it does not give is
    softened from the table's own shares. Languages and topics are few by nature, and their factors are constants of the
    plan; sources are not.
    """
    spark = described.sparkSession
    pairs = described.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("n"))
    cells = pairs.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "n")).alias("cells"), F.sum("n").alias("total"))
    given = targets or {}
    if given.get("source"):
        shares = spark.createDataFrame([(k, float(v)) for k, v in given["source"].items()], "source string, share double")
        cells = cells.join(shares, "source", "left").fillna(0.0, ["share"])
    else:
        cells = cells.withColumn("share", F.pow("total", F.lit(SOFTEN["source"])))
    cells = stored(cells, "cells")
    sums = cells.select("source", F.inline("cells")).groupBy("lang", "topic").agg(F.sum("n").alias("n")).collect()
    if not sums:
        return described.withColumn("weight", F.lit(1.0)).withColumn("probability", F.lit(1.0))
    langs, topics = sorted({r.lang for r in sums}), sorted({r.topic for r in sums})
    whole = sum(r.n for r in sums) or 1.0
    by = lambda f, names: {x: sum(r.n for r in sums if r[f] == x) for x in names}
    of_lang, of_topic = by("lang", langs), by("topic", topics)
    want_lang = given.get("lang") or soft_targets(of_lang, SOFTEN["lang"])
    want_topic = given.get("topic") or soft_targets(of_topic, SOFTEN["topic"])
    shares = cells.agg(F.sum("share")).first()[0] or 1.0
    want_source = F.col("share") / shares * whole

    lang, topic = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def source_factor() -> Column:
        inner = F.aggregate(
            "cells", F.lit(0.0), lambda acc, c: acc + c["n"] * _lookup(lang, c["lang"]) * _lookup(topic, c["topic"])
        )
        return F.when(inner > 0, want_source / inner).otherwise(1.0)

    for _ in range(rounds):
        weighted = cells.select(source_factor().alias("a"), F.inline("cells"))
        got = weighted.groupBy("lang", "topic").agg(F.sum(F.col("a") * F.col("n")).alias("n")).collect()
        m = np.zeros((len(langs), len(topics)))
        for r in got:
            m[langs.index(r.lang), topics.index(r.topic)] = r.n
        lang, topic = _raked(m, langs, topics, topic, want_lang, want_topic, whole)

    # The draw: the same products under the bound, from the weights on, to targets that the groups can meet.
    totals = [np.array([of[x] for x in names]) for of, names in ((of_lang, langs), (of_topic, topics))]
    wanted = [np.array([want.get(x, 0.0) for x in names]) for want, names in ((want_lang, langs), (want_topic, topics))]
    reach = [attainable(w / (w.sum() or 1.0), t, keep * whole) for w, t in zip(wanted, totals, strict=True)]
    level = _source_level(cells, keep * whole)
    _tell(cells, langs, topics, wanted, totals, keep * whole, shares)
    b, c = (np.array([f[x] for x in names]) for f, names in ((lang, langs), (topic, topics)))
    scale = 1.0
    for _ in range(BOUND_ROUNDS):
        binned = _bounded_sources(cells, langs, topics, b, c, level).groupBy("lang", "topic", "bin")
        got = binned.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("factor")).alias("x")).toPandas()
        got = got[got["n"] > 0]
        n, i, j = got["n"].to_numpy(float), got["lang"].to_numpy(int), got["topic"].to_numpy(int)
        a, old = got["x"].to_numpy(float) / n, (b, c)
        b = bounded_factors(n, a * c[j], i, reach[0])
        c = bounded_factors(n, a * b[i], j, reach[1])
        scale = bounded_factors(n, a * b[i] * c[j], np.zeros(len(n), int), np.array([keep * whole]))[0] if len(n) else 1.0
        if all(np.abs(np.log(np.maximum(x, 1e-30) / np.maximum(y, 1e-30))).max() < CLOSE for x, y in zip((b, c), old, strict=True)):
            break
    if abs(np.log(max(scale, 1e-30))) > 0.01 and keep < 1:
        logging.getLogger(__name__).warning("the targets exclude each other under probabilities of 1 at most: kept shares differ")
    factors = cells.select("source", source_factor().alias("factor"))
    chances = _bounded_sources(cells, langs, topics, *old, level).select("source", F.col("factor").alias("chance")).distinct()
    weight = F.col("factor") * _lookup(lang, F.col("lang")) * _lookup(topic, F.col("topic"))
    bound = [_lookup(dict(zip(names, f.tolist(), strict=True)), F.col(k)) for k, names, f in (("lang", langs, b), ("topic", topics, c))]
    probability = F.least(F.lit(1.0), F.col("chance") * bound[0] * bound[1] * float(scale))
    joined = described.join(stored(factors.join(chances, "source"), "factors"), "source")
    return joined.withColumn("weight", weight).withColumn("probability", probability).drop("factor", "chance")


def _source_level(cells: DataFrame, total: float) -> float:
    """The level for which sum(min(total of source, level * share)) is `total`: over whole sources, by bins of their ratio."""
    ratio = F.floor(F.log(F.col("share") / F.col("total")) * BINS_PER_E)
    some = cells.where("total > 0 AND share > 0").groupBy(ratio.alias("bin"))
    got = some.agg(F.sum("total").alias("n"), F.sum("share").alias("share")).toPandas()
    n, share = got["n"].to_numpy(float), got["share"].to_numpy(float)
    return float(bounded_factors(n, share / n, np.zeros(len(n), int), np.array([total]))[0]) if len(n) else 1.0


def _bounded_sources(cells: DataFrame, langs, topics, b: np.ndarray, c: np.ndarray, level: float) -> DataFrame:
    """(source, lang, topic, n, factor, bin) per cell: the source's factor under the bound, and the bin of its logarithm."""
    code = [{x: i for i, x in enumerate(names)} for names in (langs, topics)]

    def run(batches):
        for batch in batches:
            size = batch.num_rows
            inner = batch.column("cells")
            owner = np.repeat(np.arange(size), inner.value_lengths().to_numpy(zero_copy_only=False))
            flat = inner.flatten()
            i, j = (np.array([of[x] for x in flat.field(k).to_pylist()], np.int64) for of, k in zip(code, ("lang", "topic"), strict=True))
            n = flat.field("n").to_numpy(zero_copy_only=False)
            total, share = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("total", "share"))
            f = bounded_factors(n, b[i] * c[j], owner, np.minimum(total, level * share))
            bins = np.floor(np.log(np.maximum(f, 1e-30)) * BINS_PER_E).astype(np.int64)
            columns = [batch.column("source").take(pa.array(owner)), pa.array(i), pa.array(j), pa.array(n), pa.array(f[owner]), pa.array(bins[owner])]
            yield pa.RecordBatch.from_arrays(columns, ["source", "lang", "topic", "n", "factor", "bin"])

    return cells.select("source", "cells", "total", "share").mapInArrow(
        run, "source string, lang long, topic long, n double, factor double, bin long"
    )


def _tell(cells: DataFrame, langs, topics, wanted, totals, total: float, shares: float):
    """Log which targets ask for more tokens than there are."""
    over = cells.where(F.col("share") / shares * total > F.col("total") * (1 + 1e-9))
    sources = over.orderBy("source").limit(20).select("source").collect()
    short = [("source", [r.source for r in sources])]
    for name, names, want, there in (("lang", langs, wanted[0], totals[0]), ("topic", topics, wanted[1], totals[1])):
        missed = want / (want.sum() or 1.0) * total > there * (1 + 1e-9)
        short.append((name, [x for x, m in zip(names, missed, strict=True) if m]))
    for name, found in short:
        if found:
            logging.getLogger(__name__).warning("targets by %s beyond the tokens there are, kept whole: %s", name, found)


def _raked(m, langs, topics, topic, want_lang, want_topic, whole):
    """One step for the languages, then one for the topics, on tokens weighted by source."""
    c = np.array([topic[t] for t in topics])
    rows = m @ c
    b = np.array([want_lang.get(x, 0.0) * whole / r if r > 0 else 1.0 for x, r in zip(langs, rows, strict=True)])
    columns = b @ m
    c = np.array([want_topic.get(x, 0.0) * whole / s if s > 0 else 1.0 for x, s in zip(topics, columns, strict=True)])
    return dict(zip(langs, b.tolist(), strict=True)), dict(zip(topics, c.tolist(), strict=True))


def weighted_draw(described: DataFrame, targets: dict | None = None, keep: float = KEEP) -> DataFrame:
    """`described` documents with weight, probability and kept.

    The draw compares a hash of doc_id and text with the probability, so it repeats, and equal rows get equal draws.
    """
    weighted = raked(described, targets, keep=keep)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "crc"), F.lit(SCALE)) / F.lit(float(SCALE))
    return weighted.withColumn("kept", draw < F.col("probability"))


def mix_sources(documents: DataFrame, targets: dict | None = None, keep: float = KEEP) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, weight, probability, kept.

    Null source, language or text count as ''; a document without words has the weight of its cell and can be kept. Extra
    columns are ignored; an empty table gives an empty table.
    """
    described = stored(describe(documents).drop("row"), "described")
    drawn = weighted_draw(described, targets, keep)
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


def mixed_documents(documents: DataFrame, targets: dict | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of the input that the draw keeps, with all their columns."""
    return weighted_draw(describe(documents), targets, keep).where("kept").select("row.*")
