"""Quality rules whose cutoffs come from labelled holdouts with a bounded risk of rejecting good documents.

Each rule rejects a document when one of its measures exceeds a cutoff. For every stratum (language), rule and cutoff of a
fixed grid, the labelled good documents beyond the cutoff are counted. A cutoff is safe if the exact binomial probability
of seeing so few of them, were the true risk `risk / rules`, is at most `delta / (strata * rules)` (the correction for
testing several strata and rules). The cutoffs of a rule are tested in a fixed order, from the laxest down, and testing
stops at the first that is not safe, so no correction among them is needed. Of the safe cutoffs the one with the best
balance of rejected bad and good documents is taken. With probability 1 - delta, no stratum then loses more than `risk` of
its good documents to the rules. A stratum with too few labels has no safe cutoff and keeps everything.

The grid does not depend on the labels, so all of them are holdout. Counts per stratum, rule and cutoff are summed by
Spark over all labelled rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import stored
from holdfast.llm.words import coded, hashes, mix, rolled, slices, split

RISK = 0.05
DELTA = 0.05
WINDOW = 8
STEPS = 400
GOOD_COST = 5

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_pipes n_marks n_capitals n_letters".split()
_SCHEMA = ", ".join(["row_key long, doc_id long, stratum string", *[f"{c} long" for c in _COUNTS]])

# Measures lie between 0 and 1; a rule rejects what lies above its cutoff.
RULES = {
    "symbols": "try_divide(n_symbols, word_chars)",
    "repeated_words": "try_divide(n_repeat_words, n_words)",
    "repeated_lines": "try_divide(n_dup_lines, n_lines)",
    "few_distinct_words": "1 - try_divide(n_distinct, n_words)",
    "pipes": "try_divide(n_pipes, n_words)",
    "exclamations": "try_divide(n_marks, n_words)",
    "capitals": "try_divide(n_capitals, n_letters)",
    "few_letters": "1 - try_divide(n_letters, word_chars)",
}


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier one, of each text."""
    lists = pc.split_pattern(texts, "\n")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    worded = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]")
    _, code = coded(flat.filter(worded))
    owner = owner.filter(worded).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(texts)
    total = np.bincount(owner, minlength=n)
    key = np.unique(owner * (code.max() + 1 if len(code) else 1) + code)
    distinct = np.bincount(key // (code.max() + 1), minlength=n) if len(code) else np.zeros(n, np.int64)
    return total, total - distinct


def _repeated_words(h: np.ndarray, owner: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words in windows that occur twice or more in their text, for each of n texts."""
    grams = rolled(h, window)
    if not len(grams):
        return np.zeros(n, np.int64)
    own = owner[: len(grams)]
    at = np.flatnonzero(own == owner[window - 1 :])
    key = mix(grams[at] ^ mix(own[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeated = at[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else at
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + window, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=n)


def _measure(batches):
    for part in slices(batches, "text"):
        texts, n = pc.fill_null(part.column("text"), ""), part.num_rows
        words, owner = split(texts)
        distinct, codes = coded(words)
        h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        n_words = np.bincount(owner, minlength=n)
        chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0)
        pair = np.unique(owner * max(len(distinct), 1) + codes)
        lines, dup_lines = _lines(texts)
        columns = [
            n_words,
            np.bincount(owner, chars, minlength=n).astype(np.int64),
            _count(texts, r"[#*$%&|<>]"),
            dup_lines,
            _repeated_words(h, owner, n, WINDOW),
            lines,
            np.bincount(pair // max(len(distinct), 1), minlength=n),
            _count(texts, r"\|"),
            _count(texts, r"[!?]"),
            _count(texts, r"\p{Lu}"),
            _count(texts, r"\p{L}"),
        ]
        rows = [part.column(c) for c in ("row_key", "doc_id", "stratum")]
        yield pa.RecordBatch.from_arrays([*rows, *[pa.array(c, pa.int64()) for c in columns]], ["row_key", "doc_id", "stratum", *_COUNTS])


def measures(documents: DataFrame, stratum: str | Column = "lang") -> DataFrame:
    """Counts of every document, one row per input row; a missing stratum is ''."""
    named = F.col(stratum) if isinstance(stratum, str) else stratum
    thin = documents.select(
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(named.cast("string"), F.lit("")).alias("stratum"),
        F.col("text").cast("string").alias("text"),
    )
    return thin.mapInArrow(_measure, _SCHEMA)


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial(n, p), exact up to rounding."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    pick = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()])
    terms = pick + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(0.0, top + math.log(np.exp(terms - top).sum())))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> float | None:
    """The cutoff of one rule and stratum, from counts of good and bad documents per bin of the grid; None if none is safe.

    Bin i holds measures in (i / STEPS, (i + 1) / STEPS]; measures of 0 are in no bin beyond a cutoff.
    """
    n, best, chosen = int(good.sum()), 0.0, None
    beyond_good, beyond_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    for i in range(len(good) - 1, 0, -1):
        lost = int(beyond_good[i])
        if lost > risk * n or log_binomial_tail(lost, n, risk) > math.log(delta):
            break
        gain = float(beyond_bad[i]) - GOOD_COST * lost
        if gain > best:
            best, chosen = gain, i / STEPS
    return chosen


def _bin(rule: str) -> Column:
    """Number of the grid's bin; measures at or below 0 are in bin 0, missing ones too."""
    return F.coalesce(F.least(F.lit(STEPS), F.greatest(F.lit(0), F.ceil(F.expr(RULES[rule]) * STEPS))), F.lit(0))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule), from all labelled documents that pass the base rules.

    A document with several labels is good only if all of them say so; null labels and ids do not count.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(F.col("quality").cast("int")).alias("quality"))
    labelled = measured.where(~base_failed()).join(known, "doc_id")
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), _bin(r).alias("bin")) for r in RULES])
    long = labelled.select("stratum", "quality", F.inline(pairs))
    counts = long.groupBy("stratum", "rule", "bin").agg(
        F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")
    )
    rows = counts.toPandas()  # strata x rules x bins at most
    strata = max(rows["stratum"].nunique(), 1)
    found = {}
    for (stratum, rule), mine in rows.groupby(["stratum", "rule"]):
        good, bad = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
        good[mine["bin"].to_numpy(int)], bad[mine["bin"].to_numpy(int)] = mine["good"], mine["bad"]
        cutoff = choose_cutoff(good, bad, risk / len(RULES), delta / (strata * len(RULES)))
        if cutoff is not None:
            found[(stratum, rule)] = cutoff
    return found


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rejected(cutoffs: dict[tuple[str, str], float]) -> Column:
    """Whether any rule of the row's stratum fires."""
    fired = F.lit(False)
    for (stratum, rule), cutoff in sorted(cutoffs.items()):
        fired = fired | ((F.col("stratum") == stratum) & (_bin(rule) >= round(cutoff * STEPS)))
    return fired


def filter_quality(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base rules. A null language is a stratum of its own. Without labels
    only the base rules decide. Rows that repeat a doc_id are judged by their own texts, and each counts as labelled. Extra
    columns are ignored; an empty table gives an empty table.
    """
    measured = stored(measures(documents), "measures")
    cutoffs = fit_cutoffs(measured, labels, risk, delta)
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select(*shown, base_failed().alias("base_failed"), (~base_failed() & ~rejected(cutoffs)).alias("kept"))
