"""Text scores of a small causal self-attention model over subword pieces.

A text is its lower-cased words, each cut into pieces of a fixed public vocabulary (the piece at a word's start carries the
mark of the start), and an end. For every context (a frequent piece, the end, or any other piece) the counts of all training
texts give the smoothed probability of the next piece. One layer of causal self-attention with relative positions over the
contexts so far, trained in numpy, corrects it: pieces have classes, and the model adds a term per class to the log
probabilities and normalises. So log P(piece | before) = log P(class | before) + log P(piece | class, context).

Training starts from a bounded seed (`SEED_BATCHES` batches) in one task, each of whose epochs takes another share of all
windows. Then every batch takes steps from there on all windows of its training documents, and the weights are averaged over
all batches. Each prediction, the ends included, trains once, in the window that scores it.

Long texts are scored in overlapping windows: each prediction is made once, in the first window that holds it, with at least
`CONTEXT - STRIDE` pieces before it where the text has them.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import batches as b
from holdfast.llm.components import stored
from holdfast.llm.words import coded, hashes, split

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CONTEXTS = 512
CLASSES = 64
BANDS = 12
SMOOTH = 50.0
WIDTH = 16
CONTEXT = 32
STRIDE = 24
EARLY = CONTEXT - STRIDE  # positions that later windows only attend to
SEED_BATCHES = 4
SEED_EPOCHS = 3
STEP = 64
KNOWN_WORDS = 1 << 18
KNOWN_LETTERS = 64
COLUMNS = [slice(i * WIDTH, (i + 1) * WIDTH) for i in range(4)]
PAD = CONTEXTS  # before a text's start
END = 0  # class and context of the end; the first input of every text is the end


def held_out(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """crc32 of the id as text modulo 7 is 2 (a null id counts as an empty text)."""
    texts = [b"" if n else str(i).encode() for i, n in zip(ids.tolist(), null.tolist(), strict=True)]
    return np.fromiter((zlib.crc32(t) % 7 == 2 for t in texts), bool, len(texts))


class Cutter:
    """Cuts words into pieces. The first `KNOWN_WORDS` words are kept with their pieces, as many come again in later batches."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}

    def cut(self, words: list[str]) -> list[bytes]:
        """The pieces of each word, as the bytes of uint16 numbers."""
        got = list(map(self.known.get, words))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            made = self.model.encode([words[i] for i in new], num_threads=1)
            raw = np.fromiter(chain.from_iterable(made), np.uint16).tobytes()
            at = 0
            for i, x in zip(new, made, strict=True):
                got[i] = raw[at : (at := at + 2 * len(x))]
            room = KNOWN_WORDS - len(self.known)
            self.known.update((words[i], got[i]) for i in new[:room] if len(words[i]) <= KNOWN_LETTERS)
        return got


def piece_content(path: str):
    """Words and pieces of a batch; the vocabulary is opened once per task."""
    opened = []

    def run(part: pa.RecordBatch) -> dict:
        if not opened:
            opened.append(Cutter(path))
        ids, null = b.ids_of(part)
        words, owner = split(part.column("text"), lower=True)
        distinct, codes = coded(words)
        # Words are numbered in the order of their hashes, which are all that later steps need of them.
        key = hashes(distinct)
        order = np.argsort(key, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        cut = opened[0].cut(distinct.to_numpy(zero_copy_only=False).tolist())
        cut = [cut[i] for i in order.tolist()]
        lens = np.fromiter(map(len, cut), np.int64, len(cut)) // 2
        return {
            "ids": ids,
            "null": null,
            "held": held_out(ids, null),
            "keys": b.planes(np.diff(key[order], prepend=np.uint64(0))),
            "codes": b.planes(number[codes]),
            "counts": np.bincount(owner, minlength=part.num_rows),
            "pieces": b.planes(np.frombuffer(b"".join(cut), np.uint16)),
            "lens": b.planes(lens.astype(np.uint32)),
        }

    return run


def _codes(content: dict) -> tuple[np.ndarray, np.ndarray]:
    codes = b.unplanes(content["codes"]).astype(np.int64)
    return codes, np.repeat(np.arange(len(content["counts"])), content["counts"])


def _keys(content: dict) -> np.ndarray:
    """Hashes of the batch's words, in order."""
    return np.cumsum(b.unplanes(content["keys"]))


def _sequence(content: dict, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts in order, and how many each text has."""
    lens = b.unplanes(content["lens"]).astype(np.int64)
    first = np.cumsum(lens) - lens
    each = lens[codes]
    total = int(each.sum())
    at = np.repeat(first[codes] - (np.cumsum(each) - each), each) + np.arange(total)
    flat = b.unplanes(content["pieces"]) if len(lens) else np.zeros(0, np.uint16)
    per_text = np.bincount(owner, each, minlength=len(content["counts"])).astype(np.int64)
    return flat[at].astype(np.int64), per_text


def ask_totals(rows: DataFrame) -> DataFrame:
    """For every key (word hash): the sum of the values (training counts) of all batches, by batch.

    Rows also carry, once per range of keys, the sum of all values and the number of keys with a positive one.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = [b.expand(x) for x in group["data"]]
        keys = [np.cumsum(b.unplanes(k)) for k, _ in asked]
        whole, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, np.concatenate([b.unplanes(v) for _, v in asked]), minlength=len(whole)).astype(np.int64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        data = [b.squeeze(b.planes(x)) for x in np.split(total[number], cuts)]
        once = np.r_[1, np.zeros(len(group) - 1, np.int64)]
        return pd.DataFrame(
            {
                "gid": group["gid"].to_numpy(),
                "bucket": group["bucket"].to_numpy(),
                "data": data,
                "n": once * int(total.sum()),
                "v": once * int((total > 0).sum()),
            }
        )

    return rows.groupBy("bucket").applyInPandas(run, "gid long, bucket long, data binary, n long, v long")


class Kinds:
    """Context and class of every piece, the end last; made from the pieces' counts."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.context = np.full(size + 1, CONTEXTS - 1, np.int64)
        self.context[order[: CONTEXTS - 2]] = np.arange(1, CONTEXTS - 1)
        self.context[size] = END
        own = CLASSES - 1 - 2 * BANDS
        self.kind = np.zeros(size + 1, np.int64)
        self.kind[order[:own]] = np.arange(1, own + 1)
        for side, base in ((False, own + 1), (True, own + 1 + BANDS)):
            rest = order[own:]
            rest = rest[starts[rest] == side]
            mass = np.cumsum(counts[rest] + 1.0)
            if len(rest):
                self.kind[rest] = base + np.minimum((mass - 1e-9) / mass[-1] * BANDS, BANDS - 1).astype(np.int64)


class Tables:
    """Log probabilities from counts: of each piece in each context, and of each class in each context."""

    def __init__(self, kinds: Kinds, key: np.ndarray, n: np.ndarray):
        size = len(kinds.kind)
        table = np.zeros((CONTEXTS, size), np.float32)
        table.ravel()[key] = n
        plain = table.sum(axis=0, dtype=np.float64) + 1.0
        table += (SMOOTH * plain / plain.sum()).astype(np.float32)
        table /= table.sum(axis=1, dtype=np.float64)[:, None].astype(np.float32)
        prior = np.stack([np.bincount(kinds.kind, row, minlength=CLASSES) for row in table])
        self.kinds = kinds
        self.prior = np.log(np.maximum(prior, 1e-30)).astype(np.float32)
        self.piece = np.log(table, out=table)


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first prediction and first scored prediction of every window; `lengths` counts each text's predictions."""
    n = 1 + np.maximum(0, -(-(lengths - CONTEXT) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, k * STRIDE, np.where(k == 0, 0, CONTEXT + (k - 1) * STRIDE)


class Attention:
    """One head of causal self-attention over contexts, with a residual and a softmax over the next class."""

    NAMES = ("embed", "query", "key", "value", "near", "out", "bias")

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = weights or {
            "embed": draw(CONTEXTS, WIDTH) * np.float32(CONTEXTS**0.5) / 4,
            "query": draw(WIDTH, WIDTH),
            "key": draw(WIDTH, WIDTH),
            "value": draw(WIDTH, WIDTH),
            "near": np.zeros(CONTEXT, np.float32),
            "out": draw(WIDTH, CLASSES) / 10,
            "bias": np.zeros(CLASSES, np.float32),
        }
        gap = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
        self.cells = np.arange(CONTEXTS * WIDTH).reshape(CONTEXTS, WIDTH)
        self.gap, self.mask = np.maximum(gap, 0), np.where(gap >= 0, 0, -1e9).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    def filled(self, flat: np.ndarray) -> Attention:
        out, at = {}, 0
        for n in self.NAMES:
            size = self.w[n].size
            out[n] = flat[at : at + size].reshape(self.w[n].shape).astype(np.float32)
            at += size
        return Attention(out)

    def attend(self, seen: np.ndarray, skip: int = 0, table: np.ndarray | None = None):
        """Hidden states of windows of contexts (windows x CONTEXT), without those of the first `skip` positions.

        A window may begin with `PAD`s, to which no other attends. `table` are the model's `rows`, if they are at hand.
        """
        rows = np.take(self.rows() if table is None else table, seen, axis=0, mode="clip")
        x, q, k, v = (rows[..., c] for c in COLUMNS)
        a = np.matmul(q[:, skip:], k.transpose(0, 2, 1))
        a += (self.w["near"][self.gap] + self.mask)[skip:]
        padded = np.flatnonzero(seen[:, 0] == PAD)
        if len(padded):
            pad = seen[padded] == PAD
            a[padded] += np.where(pad[:, None, :] & ~pad[:, skip:, None], -1e9, 0).astype(a.dtype)
        np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a /= _row_sums(a)
        mixed = np.matmul(a, v)
        return rows, a, mixed, x[:, skip:] + mixed

    def rows(self) -> np.ndarray:
        """Embedding, scaled query, key and value of every context, side by side, and a -1."""
        rows = np.empty((CONTEXTS, 4 * WIDTH + 1), self.w["embed"].dtype)
        rows[:, :WIDTH] = self.w["embed"]
        rows[:, WIDTH:-1] = self.w["embed"] @ self._projections()
        rows[:, -1] = -1
        return rows

    def _projections(self) -> np.ndarray:
        """Side by side; the scale of the dot products, a power of 2, is in the query's."""
        return np.concatenate([self.w["query"] * np.float32(WIDTH**-0.5), self.w["key"], self.w["value"]], axis=1)

    def _weights(self, hidden: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Logits of the classes after each hidden state, which has a 1 at its end."""
        logits = hidden @ np.concatenate([self.w["out"], self.w["bias"][None]])
        np.clip(logits, -60, 60, out=logits)
        logits += prior
        return logits

    def log_probability(self, hidden: np.ndarray, prior: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log P of the target class after each hidden state."""
        flat = np.ones((len(hidden), WIDTH + 1), hidden.dtype)
        flat[:, :WIDTH] = hidden
        logits = self._weights(flat, prior)
        picked = logits[np.arange(len(target)), target]
        np.exp(logits, out=logits)
        return picked - np.log(_row_sums(logits)[:, 0])

    def gradients(self, seen: np.ndarray, prior: np.ndarray, target: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean loss over the positions that count, given the prior of all positions or of those that count.

        Positions that do not count have no loss; the others attend to them. If none of the first `EARLY` counts, these do not attend.
        """
        w, skip = self.w, 0 if counts[:, :EARLY].any() else EARLY
        rows, a, mixed, h = self.attend(seen, skip)
        x, q, k, v = (rows[..., c] for c in COLUMNS)
        used = np.flatnonzero(counts[:, skip:])
        flat = np.ones((len(used), WIDTH + 1), h.dtype)
        flat[:, :WIDTH] = np.take(h.reshape(-1, WIDTH), used, axis=0)
        prior = prior.reshape(-1, CLASSES)
        p = self._weights(flat, prior if len(prior) == len(used) else prior[counts.ravel()])
        np.exp(p, out=p)
        share = p.dtype.type(1 / max(len(used), 1))
        p *= share / _row_sums(p)
        p.ravel()[np.arange(0, p.size, CLASSES) + target[counts]] -= share
        back = flat.T @ p
        grads = {"out": back[:WIDTH], "bias": back[WIDTH]}
        # Gradients of hidden states; the last column meets the -1 of the rows.
        dh = np.zeros((*h.shape[:2], WIDTH + 1), p.dtype)
        dh.reshape(-1, WIDTH + 1)[used, :WIDTH] = p @ w["out"].T
        dx = dh[..., :WIDTH]
        dh[..., WIDTH:] = _row_sums(dx * mixed)
        ds = np.matmul(dh, rows[..., 3 * WIDTH :].transpose(0, 2, 1))
        ds *= a
        near = (np.ones(len(ds), p.dtype) @ ds.reshape(len(ds), -1)).reshape(ds.shape[1:])
        grads["near"] = np.bincount(self.gap[skip:].ravel(), near.ravel(), minlength=CONTEXT)
        d = np.empty((*seen.shape, 3 * WIDTH), p.dtype)
        d[:, :skip, :WIDTH] = 0
        np.matmul(ds, k, out=d[:, skip:, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q[:, skip:], out=d[..., WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), dx, out=d[..., 2 * WIDTH :])
        d = d.reshape(-1, 3 * WIDTH)
        made = x.reshape(-1, WIDTH).T @ d
        made[:, :WIDTH] *= np.float32(WIDTH**-0.5)
        grads |= {n: made[:, c] for n, c in zip(("query", "key", "value"), COLUMNS, strict=False)}
        into = (d @ self._projections().T).reshape(x.shape)
        into[:, skip:] += dx
        cell = np.take(self.cells, seen.ravel(), axis=0, mode="clip")
        embed = np.bincount(cell.ravel(), into.ravel(), minlength=CONTEXTS * WIDTH).reshape(-1, WIDTH)
        return grads | {"embed": embed}


def _row_sums(values: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is kept; as a product, for short rows."""
    return values @ np.ones((values.shape[-1], 1), values.dtype)


class Adam:
    """Steps on all weights as one array; the model's weights are views of it."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.flat = model.flat().astype(np.float32)
        self.m, self.s = np.zeros_like(self.flat), np.zeros_like(self.flat)
        at = 0
        for n in model.NAMES:
            shape, size = model.w[n].shape, model.w[n].size
            model.w[n] = self.flat[at : at + size].reshape(shape)
            at += size

    def step(self, grads: dict[str, np.ndarray]):
        self.t += 1
        g = np.concatenate([grads[n].ravel() for n in self.model.NAMES], dtype=np.float32)
        self.m += 0.1 * (g - self.m)
        self.s += 0.01 * (g * g - self.s)
        up = self.m / (1 - 0.9**self.t)
        up /= np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-8
        up *= self.rate
        self.flat -= up


def _stream(content: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts with an end (-1) after each, and the number of predictions of each text."""
    lens = np.r_[b.unplanes(content["lens"]).astype(np.int64), 1]
    flat = np.r_[b.unplanes(content["pieces"]).astype(np.int64), -1] if len(lens) > 1 else np.full(1, -1)
    ends = np.cumsum(content["counts"])
    # The end follows a text's words as one more word.
    word = np.insert(b.unplanes(content["codes"]).astype(np.int64), ends, len(lens) - 1)
    each = lens[word]
    stop = np.cumsum(each)
    at = np.repeat((np.cumsum(lens) - lens)[word] - (stop - each), each)
    at += np.arange(len(at))
    return flat[at], np.diff(stop[ends + np.arange(len(ends))], prepend=0)


def _before(context: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The context each piece is predicted from: of the piece before it, or the end's at a text's start."""
    seen = np.r_[END, context[:-1]]
    seen[np.cumsum(lengths) - lengths] = END
    return seen


class Windows:
    """The windows of a batch's texts: where their predictions are, and which of these are scored there."""

    def __init__(self, lengths: np.ndarray):
        self.text, self.first, scored = windows_of(lengths)
        self.begin = (np.cumsum(lengths) - lengths)[self.text] + self.first
        self.low, self.high = scored - self.first, np.minimum(lengths[self.text] - self.first, CONTEXT)
        self.last, self.step = int(lengths.sum()) - 1, np.arange(CONTEXT)

    def at(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the predictions of some windows, and which of them they score."""
        scored = (self.step >= self.low[some, None]) & (self.step < self.high[some, None])
        return np.minimum(self.begin[some, None] + self.step, self.last), scored


def _apart(seen: np.ndarray, target: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The early positions that count moved to the ends of padded windows, if few windows have any: so none attends early."""
    some = np.flatnonzero(counts[:, :EARLY].any(axis=1))
    if not 0 < len(some) * 8 <= len(seen):
        return seen, target, counts
    made = []
    for values, pad in ((seen, PAD), (target, END), (counts, False)):
        more = np.full((len(some), CONTEXT), pad, values.dtype)
        more[:, STRIDE:] = values[some, :EARLY]
        made.append(np.concatenate([values, more]))
    made[2][: len(seen), :EARLY] = False
    return made[0], made[1], made[2]


def train_on(model: Attention, content: dict, tables: Tables, rate: float, seed: int, share: int = 0, shares: int = 1) -> int:
    """Adam steps on the windows of the training texts, dealt to `shares` in turn; how many positions were trained on."""
    piece, lengths = _stream(content)
    target, seen = tables.kinds.kind[piece], _before(tables.kinds.context[piece], lengths)
    windows = Windows(lengths)
    text, first = windows.text, windows.first
    use = np.flatnonzero(((first // STRIDE + text) % shares == share) & ~content["held"][text])
    np.random.default_rng(seed).shuffle(use)
    adam, total = Adam(model, rate), 0
    for i in range(0, len(use), STEP):
        now = use[i : i + STEP]
        at, real = windows.at(now)
        context, wanted, real = _apart(seen[at], target[at], real)
        adam.step(model.gradients(context, np.take(tables.prior, context[real], axis=0), wanted, real))
        total += int(real.sum())
    return total


def score_texts(model: Attention, content: dict, tables: Tables, block: int = STEP) -> np.ndarray:
    """log10 probability of every text of a batch."""
    piece, lengths = _stream(content)
    target, seen = tables.kinds.kind[piece], _before(tables.kinds.context[piece], lengths)
    log_p = tables.piece[seen, piece] - tables.prior[seen, target]
    windows, table = Windows(lengths), model.rows()
    for skip, some in ((0, windows.first == 0), (EARLY, windows.first > 0)):
        group = np.flatnonzero(some)
        for i in range(0, len(group), block):
            at, real = windows.at(group[i : i + block])
            hidden, now = model.attend(seen[at], skip, table)[-1][real[:, skip:]], at[real]
            log_p[now] += model.log_probability(hidden, np.take(tables.prior, seen[now], axis=0), target[now])
    return np.add.reduceat(log_p.astype(np.float64), np.cumsum(lengths) - lengths) / np.log(10)


def _pair_counts(rows: DataFrame, kinds) -> DataFrame:
    """(key, n): how often each piece follows each context in the training texts; key = context * pieces + piece."""

    def run(batches):
        told = kinds.value
        size = len(told.kind)
        table = np.zeros(CONTEXTS * size, np.int32)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                content = b.expand(blob)
                piece, lengths = _stream(content)
                train = np.repeat(~content["held"], lengths)
                key = _before(told.context[piece], lengths) * size + np.where(piece < 0, size - 1, piece)
                key = np.sort(key[train].astype(np.int32))
                edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
                table[key[edge[:-1]]] += np.diff(edge).astype(np.int32)
        used = np.flatnonzero(table)
        for i in range(0, len(used), 1 << 16):
            part = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].astype(np.int64))], ["key", "n"])

    counted = rows.select("blob").mapInArrow(run, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def score_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end alone. Without training rows all counts are 0 and the model is the untrained one. A null
    doc_id trains. Rows that repeat a doc_id all count. Extra columns are ignored; an empty table gives an empty table.
    """
    spark = documents.sparkSession
    packed = b.pack(documents, piece_content(vocabulary))
    owners = packed.owners

    def ask(row, content):
        """Questions for the words' training counts, and the batch's piece counts and training texts."""
        codes, owner = _codes(content)
        train = ~content["held"]
        key = _keys(content)
        n = np.bincount(codes[train[owner]], minlength=len(key)).astype(np.int64)
        for bucket, gid, data in b.questions(row["gid"], key, 64, owners, n):
            yield 1, gid, bucket, data, 0
        each = np.repeat(n, b.unplanes(content["lens"]))
        pieces = b.unplanes(content["pieces"]).astype(np.int64) if len(each) else np.zeros(0, np.int64)
        counted = np.bincount(pieces, each)
        for p in np.flatnonzero(counted).tolist():
            yield 0, row["gid"], p, b"", int(counted[p])
        yield 0, row["gid"], -1, b"", int(train.sum())

    schema = "kind long, gid long, bucket long, data binary, n long"
    asked = stored(b.each_batch(packed.table.select("gid", "blob"), ask, schema), "asked")
    totals = stored(ask_totals(asked.where("kind = 1").select("bucket", "gid", "data")), "totals")
    counted = asked.where("kind = 0").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row per piece at most
    texts = int(counted.loc[counted["bucket"] == -1, "n"].sum())
    pieces = counted[counted["bucket"] >= 0]
    starts = _starts(vocabulary)
    counts = np.zeros(len(starts))
    counts[pieces["bucket"].to_numpy(int)] = pieces["n"]
    kinds = Kinds(counts, starts)
    pairs = _pair_counts(packed.table, spark.sparkContext.broadcast(kinds)).toPandas()  # contexts x vocabulary at most
    sums = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n_all, v_all = int(sums[0]) + texts, int(sums[1]) + (texts > 0)

    told = spark.sparkContext.broadcast(Tables(kinds, pairs["key"].to_numpy(np.int64), pairs["n"].to_numpy(np.float32)))
    seed = _seeded(packed, told)
    shared = spark.sparkContext.broadcast(seed.flat())

    def adapt(batches):
        """Trains on every batch from the seed's weights; the task's weighted sums, once."""
        total, sums = 0.0, None
        for part in batches:
            for row in part.to_pylist():
                model = Attention().filled(shared.value)
                n = train_on(model, b.expand(row["blob"]), told.value, 0.003, row["gid"] & 0xFFFF)
                if n:
                    flat = model.flat().astype(np.float64) * n
                    total, sums = total + n, flat if sums is None else sums + flat
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(np.full(len(sums), total)), pa.array(sums)], ["bucket", "n", "x"])

    steps = packed.table.select("gid", "blob").mapInArrow(adapt, "bucket long, n double, x double")
    mean = steps.groupBy("bucket").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("bucket").toPandas()
    weights = mean["x"].to_numpy(np.float64) if len(mean) else seed.flat()
    final = spark.sparkContext.broadcast(weights)

    def finish(row, content):
        codes, owner = _codes(content)
        c = b.answers(row, "totals", _keys(content), 64, owners, np.int64)
        log_base = np.log10((c + 1.0) / (n_all + 1.0 * (v_all + 1)))
        end = np.log10((texts + 1.0) / (n_all + 1.0 * (v_all + 1)))
        size = len(content["ids"])
        base = np.bincount(owner, log_base[codes], minlength=size) + end
        known = np.bincount(owner, (c > 0)[codes], minlength=size).astype(int) + (texts > 0)
        score = score_texts(Attention().filled(final.value), content, told.value)
        for i in range(size):
            name = None if content["null"][i] else int(content["ids"][i])
            tokens = int(content["counts"][i]) + 1
            yield name, bool(content["held"][i]), tokens, int(known[i]), n_all, float(base[i]), float(score[i])

    rows = b.with_answers(packed, totals=totals.select("gid", "bucket", "data"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return b.each_batch(rows, finish, schema)


def _starts(path: str) -> np.ndarray:
    """Which pieces of the vocabulary start a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([model.id_to_piece(i).startswith("▁") for i in range(model.get_piece_size())])


def _seeded(packed: b.Packed, told) -> Attention:
    """The model after a few epochs over the seed batches, trained in one task."""

    def train(group: pd.DataFrame) -> pd.DataFrame:
        model = Attention()
        for epoch in range(SEED_EPOCHS):
            for i, blob in enumerate(group.sort_values("gid")["blob"]):
                train_on(model, b.expand(blob), told.value, 0.01 / (1 + epoch), epoch * 100 + i, epoch, SEED_EPOCHS)
        return pd.DataFrame({"data": [b.squeeze(model.flat())]})

    # The batches are chosen by their numbers, so no task reads others.
    chosen = [r.gid for r in packed.table.select("gid").orderBy(F.xxhash64("gid"), "gid").limit(SEED_BATCHES).collect()]
    few = packed.table.where(F.col("gid").isin(chosen)).select(F.lit(0).alias("one"), "gid", "blob")
    made = few.groupBy("one").applyInPandas(train, "data binary").collect()
    return Attention().filled(b.expand(made[0].data)) if made else Attention()
