"""Language identification with unigram pieces, summed over all segmentations.

The pieces are the entries of a fixed public vocabulary that consist of letters, and all single letters besides. Each
language has a probability for every piece. The probability of a word is the sum over all its segmentations of the
products of the pieces' probabilities, found by a forward pass over the characters. Piece probabilities are learned by
expectation maximisation with forward and backward passes over word counts.

Words are the maximal runs of letters, lower-cased. A long run, as in scripts without spaces, is scored as a whole: what a
piece of it does to the sums over the last characters is a small matrix for each language, and the matrices of the consecutive pieces are
multiplied, scaled as they go. For the fit alone, long runs count as consecutive runs of 64 letters. The language with the largest sum of log probabilities over all words
of the text and of the log prior wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import stored
from holdfast.llm.words import coded, slices, split

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 20_000
ROUNDS = 3
LONGEST = 8
FLOOR = 0.1
# Letters of a run that are scored in one pass; a longer run is put together from steps of STEP letters.
SHORT = 24
STEP = 16
UNKNOWN = "und"
SLICE = 4 << 20
# Words of a length that are scored at once.
WORDS = 1 << 14

_ODD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str = VOCABULARY, longest: int = LONGEST) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, up to `longest` characters, sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if 1 <= len(p) <= longest and p.isalpha()})


class Pieces:
    """The vocabulary with a number for each piece, found by hash. The last number is `other`, an unlisted character."""

    SLOT_BITS = 20

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.names = sorted(pieces)
        self.other = len(self.names)
        hashed = [int(self._hash(np.array([[ord(c) for c in p]], np.uint64))[0]) for p in self.names]
        self.hash = np.array([*hashed, 0], np.uint64)
        # Two slots for each hash; the few pieces whose slots are both taken are compared one by one.
        self.slots = [np.full(1 << self.SLOT_BITS, self.other, np.int32) for _ in range(2)]
        self.crowded = []
        for i, h in enumerate(hashed):
            free = [k for k in (0, 1) if self.slots[k][self._slot(h, k)] == self.other]
            if free:
                self.slots[free[0]][self._slot(h, free[0])] = i
            else:
                self.crowded.append(i)

    def _slot(self, h, k: int):
        """The top bits, or the bits below them."""
        if isinstance(h, int):
            return (h >> (64 - self.SLOT_BITS * (k + 1))) & ((1 << self.SLOT_BITS) - 1)
        return (h >> np.uint64(64 - self.SLOT_BITS * (k + 1))) & np.uint64((1 << self.SLOT_BITS) - 1)

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h = np.full(len(chars), chars.shape[1], np.uint64)
        for i in range(chars.shape[1]):
            h = (h ^ chars[:, i]) * _ODD
            h ^= h >> np.uint64(29)
        return h

    def find(self, chars: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these characters; -1 where there is none, `other` for an unlisted character."""
        h = self._hash(chars)
        first, second = (slots[self._slot(h, k)] for k, slots in enumerate(self.slots))
        number = np.where(self.hash[first] == h, first, second)
        number[self.hash[number] != h] = self.other if chars.shape[1] == 1 else -1
        for i in self.crowded:
            number[h == self.hash[i]] = i
        return number


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of letters, lower-cased, and the index of the text of each."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+", " ")
    return split(spaced)


def by_length(runs: list[str], most: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which, characters) blocks of runs of equal length. A run beyond `most` is taken in consecutive pieces of it."""
    parts = [(i, r[s : s + most]) for i, r in enumerate(runs) for s in range(0, len(r), most)]
    lengths = np.array([len(p) for _, p in parts], np.int64)
    which = np.array([i for i, _ in parts], np.int64)
    blocks = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        joined = "".join(parts[i][1] for i in at.tolist())
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(at), n)
        blocks.append((which[at], chars))
    return blocks


def lattice(pieces: Pieces, chars: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For every end position 1..n, the (start, piece numbers) of the pieces that end there."""
    n = chars.shape[1]
    return [[(s, pieces.find(chars[:, s:e])) for s in range(max(0, e - pieces.longest), e)] for e in range(1, n + 1)]


def forward(edges, p: np.ndarray, rows: int) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix; p has one row per piece, a row of zeros last, a column per language."""
    alpha = [np.ones((rows, p.shape[1]))]
    for ends in edges:
        total = np.zeros((rows, p.shape[1]))
        for start, number in ends:
            at = np.flatnonzero(number >= 0)
            total[at] += alpha[start][at] * p[number[at]]
        alpha.append(total)
    return alpha


def steps(pieces: Pieces, p: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What steps of a run do: rows x languages x to x from, where `from` and `to` count back from the step's start and end.

    `chars` holds the `pieces.longest` - 1 characters before each step and those of the step, `lengths` of them in use.
    """
    back, rows, langs = pieces.longest, len(chars), p.shape[1]
    n = chars.shape[1] - back + 1
    # sums[back - 1 + e][row, k]: of all ways to end at e that leave the run's part before the step at its k-th last place.
    sums = np.zeros((back + n, rows, back, langs))
    for k in range(back):
        sums[back - 1 - k, :, k] = 1.0
    for e in range(1, n + 1):
        for size in range(1, back + 1):
            number = pieces.find(chars[:, e + back - 1 - size : e + back - 1])
            # Unlisted pieces have the number -1, the row of zeros.
            sums[back - 1 + e] += sums[back - 1 + e - size] * p[number][:, None, :]
    ends = back - 1 + lengths[:, None] - np.arange(back)
    return sums[ends, np.arange(rows)[:, None]].transpose(0, 3, 1, 2)


def long_run_score(pieces: Pieces, p: np.ndarray, run: str) -> np.ndarray:
    """Log probability of one run of any length in every language, by the products of its steps."""
    back, langs = pieces.longest, p.shape[1]
    chars = np.frombuffer(run.encode("utf-32-le"), np.uint32).astype(np.uint64)
    count = -(-len(chars) // STEP)
    padded = np.zeros(back - 1 + count * STEP, np.uint64)
    padded[back - 1 : back - 1 + len(chars)] = chars
    windows = np.lib.stride_tricks.sliding_window_view(padded, back - 1 + STEP)[::STEP]
    lengths = np.full(count, STEP)
    lengths[-1] = len(chars) - (count - 1) * STEP
    state, scale = np.zeros((langs, back, 1)), np.zeros(langs)
    state[:, 0] = 1.0
    for first in range(0, count, 1024):
        some = slice(first, first + 1024)
        for step in steps(pieces, p, windows[some], lengths[some]):
            state = step @ state
            most = state.max(axis=(1, 2))
            state, scale = state / most[:, None, None], scale + np.log(most)
    return scale + np.log(state[:, 0, 0])


def word_scores(pieces: Pieces, log_free: np.ndarray, runs: list[str]) -> np.ndarray:
    """Log probability of every run in every language, over all segmentations of the whole run."""
    out = np.zeros((len(runs), log_free.shape[1]))
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    short = np.flatnonzero(sizes <= SHORT)
    for which, chars in by_length([runs[i] for i in short.tolist()]):
        for a in range(0, len(which), WORDS):
            some = chars[a : a + WORDS]
            out[short[which[a : a + WORDS]]] = np.log(forward(lattice(pieces, some), log_free, len(some))[-1])
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = long_run_score(pieces, log_free, runs[i])
    return out


def expected(pieces: Pieces, p: np.ndarray, runs: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of weighted runs, for one language (p with one column)."""
    counts = np.zeros(pieces.other + 1)
    for which, chars in by_length(runs):
        edges, rows, n = lattice(pieces, chars), len(chars), chars.shape[1]
        alpha = forward(edges, p, rows)
        beta = [np.zeros((rows, 1)) for _ in range(n)] + [np.ones((rows, 1))]
        for e in range(n, 0, -1):
            for start, number in edges[e - 1]:
                at = np.flatnonzero(number >= 0)
                beta[start][at] += p[number[at]] * beta[e][at]
        # A run whose probability is beyond doubles says nothing about its pieces.
        scale = np.where(alpha[n] > 1e-290, weight[which][:, None] / np.maximum(alpha[n], 1e-290), 0.0)
        for e in range(1, n + 1):
            for start, number in edges[e - 1]:
                at = np.flatnonzero(number >= 0)
                share = alpha[start][at] * p[number[at]] * beta[e][at] * scale[at]
                counts += np.bincount(number[at], share[:, 0], minlength=len(counts))
    return counts


def held_out() -> Column:
    """crc32 of the doc_id as text, modulo 4, is 2 (a null id counts as an empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def quotas(prior: dict[str, int], train_docs: int) -> dict[str, int]:
    """Rows to train on by language: as many of each, or all of a language with fewer, whose rest goes to the others."""
    out, left = {}, train_docs
    for i, (lang, n) in enumerate(sorted(prior.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(prior) - i)))
        left -= out[lang]
    return out


def training_rows(usable: DataFrame, prior: dict[str, int], train_docs: int) -> DataFrame:
    """About `train_docs` rows drawn per language by `quotas`, those with the least hashes of doc_id and text.

    A language within its quota is taken whole. Equal rows are drawn together.
    """
    scale = 1 << 40
    bounds = [(F.lit(x), F.lit(scale if q == prior[x] else int(scale * q / prior[x]) + 1)) for x, q in quotas(prior, train_docs).items()]
    bound = F.create_map(*chain.from_iterable(bounds))[F.col("lang").cast("string")]
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", F.col("text").cast("string")), F.lit(scale))
    return usable.where(draw < bound)


def learn(documents: DataFrame, path: str = VOCABULARY, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> dict:
    """Languages, log priors and piece probabilities.

    The model is fitted on about `train_docs` labelled rows (`training_rows`); priors are counted on all labelled rows. Word counts are summed by Spark; sums per language and piece, which the fixed vocabulary bounds,
    come to the driver after each round.
    """
    spark = documents.sparkSession
    usable = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    prior = {r.lang: r["count"] for r in usable.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    langs, total = sorted(prior), sum(prior.values())
    names = vocabulary_pieces(path)
    model = {"langs": langs, "path": path, "prior": np.log([prior[x] / total for x in langs]) if langs else np.zeros(0)}
    pieces = Pieces(names)
    flat = np.full((pieces.other + 2, max(len(langs), 1)), 1.0 / (pieces.other + 1))
    flat[-1] = 0.0
    model["p"] = flat
    if not langs:
        return model
    sample = training_rows(usable, prior, train_docs)
    shared = spark.sparkContext.broadcast({"langs": langs})

    def count_words(batches):
        code = {x: i for i, x in enumerate(shared.value["langs"])}
        for part in slices(batches, "text", SLICE):
            label = np.array([code[x] for x in part.column("lang").to_pylist()], np.int64)
            runs, owner = letter_runs(part.column("text"))
            distinct, codes = coded(runs)
            size = max(len(distinct), 1)
            keys, n = np.unique(label[owner] * size + codes, return_counts=True)
            if len(keys):
                columns = [pa.array(keys // size), distinct.take(pa.array(keys % size)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "run", "n"])

    counted = sample.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = counted.mapInArrow(count_words, "lang long, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    counted = stored(counted, "letter_runs")
    for _ in range(rounds):
        step = spark.sparkContext.broadcast((names, model["p"]))

        def collect(batches, step=step):
            names, p = step.value
            pieces = Pieces(names)
            for batch in batches:
                lang, n = batch.column("lang").to_numpy(), batch.column("n").to_numpy().astype(float)
                runs = np.array(batch.column("run").to_pylist(), object)
                for x in np.unique(lang):
                    mine = lang == x
                    got = expected(pieces, p[:, x : x + 1], runs[mine].tolist(), n[mine])
                    used = np.flatnonzero(got)
                    values = [pa.array(np.full(len(used), x)), pa.array(used), pa.array(got[used])]
                    yield pa.RecordBatch.from_arrays(values, ["lang", "piece", "n"])

        sums = counted.mapInArrow(collect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        got = sums.toPandas()
        counts = np.full((pieces.other + 1, len(langs)), FLOOR)
        np.add.at(counts, (got["piece"].to_numpy(int), got["lang"].to_numpy(int)), got["n"].to_numpy(float))
        model["p"] = np.vstack([counts / counts.sum(axis=0), np.zeros(len(langs))])
        step.unpersist()
    return model


def _score_slice(texts: pa.Array, model: dict, pieces: Pieces) -> tuple[list[str], np.ndarray]:
    """Language and share for every text."""
    n, langs = len(texts), model["langs"]
    runs, owner = letter_runs(texts)
    distinct, codes = coded(runs)
    scored = word_scores(pieces, model["p"], distinct.to_pylist())
    total = np.stack([np.bincount(owner, scored[codes, j], minlength=n) for j in range(len(langs))], axis=1)
    any_letter = np.bincount(owner, minlength=n) > 0
    total = total + model["prior"]
    best = total.argmax(axis=1)
    share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, any_letter, strict=True)]
    return names, np.where(any_letter, share, 0.0)


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """The input with `lang_pred` and `score`, columns that replace any of these names.

    `score` is the share of the best language among all (0 to 1); `und` with score 0 if the text is null or has no letter,
    or if nothing could be learned. The whole text counts. An empty table gives an empty table.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages numbers
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")]

    # Only the text goes to Python; all other columns stay in the JVM.
    @F.arrow_udf("lang_pred string, score double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        pieces = Pieces(vocabulary_pieces(model["path"]))
        for texts in batches:
            names, shares = [], [np.zeros(0)]
            for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", SLICE):
                if model["langs"]:
                    some, share = _score_slice(part.column("text"), model, pieces)
                else:
                    some, share = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                names += some
                shares.append(share)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(shares))], ["lang_pred", "score"])

    # Spark would repeat a deterministic function in a filter.
    found = documents.select(*kept, score.asNondeterministic()(F.col("text").cast("string")).alias("_language"))
    return found.select(*kept, "_language.lang_pred", "_language.score")


def predict_language(documents: DataFrame, **settings) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = learn(documents, **settings)
    thin = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return identify(thin, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
