"""Quality rules, language model scores and language identification."""

import math
import random
import re
import zlib
from collections import Counter

import corpus
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from holdfast.llm import attention_lm, language, quality_rules


@pytest.fixture(scope="module")
def rows():
    return corpus.texts(4)


def plain_measures(text):
    text = text or ""
    w, seen, dup = corpus.words(text), set(), 0
    for line in text.split("\n"):
        if corpus.words(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    hit = {p for j in range(len(w) - 7) if count[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), base


def test_measures(spark, rows):
    rows = [*rows, (30, "a|b # c\n\na|b # c\n \n" + "t u v w x y z s " * 4 + "&<>")]
    labels = spark.createDataFrame([(30, 1, 0, "x"), (None, 0, 1, "y"), (31, None, 0, "z")], "doc_id long, quality int, toxic int, lang string")
    got = Counter(tuple(r) for r in quality_rules.filter_quality(corpus.frame(spark, rows), labels).collect())
    want = Counter((i, *plain_measures(t)[:5], plain_measures(t)[5], not plain_measures(t)[5]) for i, t in rows)
    assert got == want
    assert quality_rules.filter_quality(corpus.frame(spark, []).limit(0), labels.limit(0)).count() == 0


def test_rules_reject_junk_and_keep_good(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(4000):
        junk = i % 8 == 0
        words = [rng.choice(vocabulary) + ("###" if junk else "") for _ in range(25)]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.filter_quality(docs, known).collect()}
    good = [kept[i] for i, q in labels if q]
    assert sum(not k for k in good) <= quality_rules.RISK * len(good)
    assert not any(kept[i] for i, q in labels if not q)


def test_binomial_tail_and_cutoffs():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.1), (5, 5, 0.3), (200, 7, 0.05)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.exp(quality_rules.log_binomial_tail(k, n, p)) == pytest.approx(want)
    steps = quality_rules.STEPS
    good, bad = np.zeros(steps + 1), np.zeros(steps + 1)
    good[0], bad[200] = 5000, 100
    assert 0 < quality_rules.choose_cutoff(good, bad, 0.01, 0.001) <= 200 / steps
    good[0] = 100  # too few labels to be sure
    assert quality_rules.choose_cutoff(good, bad, 0.01, 0.001) is None
    good[0], good[200] = 5000, 200  # bad ones cannot be had without good ones
    assert quality_rules.choose_cutoff(good, bad, 0.01, 0.001) is None


def test_guarantee_holds_on_fresh_documents():
    """Over many draws of labels, the true risk of the chosen cutoff exceeds the bound in few of them."""
    rng, steps, missed = np.random.default_rng(1), quality_rules.STEPS, 0
    for _ in range(300):
        good = np.bincount(np.minimum((rng.exponential(0.08, 3000) * steps).astype(int), steps), minlength=steps + 1)
        bad = np.bincount(rng.integers(steps // 8, steps, 3000), minlength=steps + 1)
        cutoff = quality_rules.choose_cutoff(good, bad, 0.02, 0.05)
        missed += cutoff is not None and math.exp(-cutoff / 0.08) > 0.021
    assert missed <= 0.05 * 300 + 12


def test_base_scores(spark, rows):
    got = attention_lm.score_documents(corpus.frame(spark, rows)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*corpus.words(t, lower=True), "\0end"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        tokens = [*corpus.words(t, lower=True), "\0end"]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        want[(i, held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert attention_lm.score_documents(corpus.frame(spark, []).limit(0)).count() == 0


def test_one_word_of_very_many_pieces(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(180_000))
    rows = [(0, f"a {long} b"), (1, long), (3, "some more words")]
    run = attention_lm.piece_content(attention_lm.VOCABULARY)
    assert attention_lm._sequence(bare := run(pa.RecordBatch.from_pydict({"doc_id": [5], "text": [" "]})), *attention_lm._codes(bare))[1].tolist() == [0]
    part = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    content = run(part)
    pieces, per_text = attention_lm._sequence(content, *attention_lm._codes(content))
    model = sentencepiece.SentencePieceProcessor(model_file=attention_lm.VOCABULARY)
    want = [[p for w in t.split() for p in model.encode(w)] for _, t in rows]
    assert len(want[1]) > 100_000
    assert per_text.tolist() == [len(w) for w in want] and pieces.tolist() == sum(want, [])
    got = attention_lm.score_documents(corpus.frame(spark, rows, 1)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {0: 4, 1: 2, 3: 4} and all(math.isfinite(r.score) for r in got)


def test_model_gradients():
    rng, model = np.random.default_rng(0), attention_lm.Attention()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    seen = rng.integers(0, attention_lm.CONTEXTS, (2, attention_lm.CONTEXT))
    target = rng.integers(0, attention_lm.CLASSES, seen.shape)
    prior, real = rng.standard_normal((attention_lm.CONTEXTS, attention_lm.CLASSES)), rng.random(seen.shape) < 0.7

    def loss():
        hidden = model.attend(seen)[-1]
        return -model.log_probability(hidden[real], prior[seen[real]], target[real]).sum() / real.sum()

    grads = model.gradients(seen, prior[seen], target, real)
    for name in model.NAMES:
        at = tuple(rng.integers(0, s) for s in model.w[name].shape)
        at = (int(seen[0, 0]), *at[1:]) if name == "embed" else at
        old, e = model.w[name][at], 1e-4
        model.w[name][at] = old + e
        up = loss()
        model.w[name][at] = old - e
        down = loss()
        model.w[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-9)


def test_gradients_need_the_prior_of_counted_positions_only():
    """Positions that do not count take no part in the softmax over classes."""
    rng, model = np.random.default_rng(1), attention_lm.Attention()
    seen = rng.integers(0, attention_lm.CONTEXTS, (3, attention_lm.CONTEXT))
    target, real = rng.integers(0, attention_lm.CLASSES, seen.shape), rng.random(seen.shape) < 0.6
    prior = rng.standard_normal((attention_lm.CONTEXTS, attention_lm.CLASSES)).astype(np.float32)
    whole = model.gradients(seen, prior[seen], target, real)
    few = model.gradients(seen, prior[seen[real]], target, real)
    assert all((whole[n] == few[n]).all() and np.abs(few[n]).max() > 0 for n in model.NAMES)


def test_early_positions_of_later_windows_do_not_attend(monkeypatch):
    """What is skipped changes neither the other hidden states nor the gradient of the same predictions in whole windows."""
    lm, rng = attention_lm, np.random.default_rng(3)
    model = lm.Attention()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    seen, target = rng.integers(0, lm.CONTEXTS, (9, lm.CONTEXT)), rng.integers(0, lm.CLASSES, (9, lm.CONTEXT))
    prior, counts = rng.standard_normal((lm.CONTEXTS, lm.CLASSES)), rng.random(seen.shape) < 0.8
    assert model.attend(seen, lm.EARLY)[-1] == pytest.approx(model.attend(seen)[-1][:, lm.EARLY :], abs=1e-12)
    counts[1:, : lm.EARLY] = False
    whole, asked, plain = model.gradients(seen, prior[seen], target, counts), [], lm.Attention.attend
    monkeypatch.setattr(lm.Attention, "attend", lambda self, seen, skip=0, table=None: (asked.append(skip), plain(self, seen, skip, table))[1])
    context, wanted, real = lm._apart(seen, target, counts)
    assert len(context) == 10 and sorted(zip(context[real], wanted[real], strict=True)) == sorted(zip(seen[counts], target[counts], strict=True))
    apart = model.gradients(context, prior[context[real]], wanted, real)
    assert asked == [lm.EARLY] and all(apart[n] == pytest.approx(whole[n], abs=1e-12) for n in model.NAMES)
    many = lm._apart(seen, target, np.ones(seen.shape, bool))
    assert many[0] is seen and many[2].all()


def test_words_are_cut_once(monkeypatch):
    """A word that comes again in a later batch is not cut again, as long as few words are kept."""
    cutter = attention_lm.Cutter(attention_lm.VOCABULARY)
    words = ["some", "words", "come", "again", "x" * 200, "\u00a0", "\x01"]
    want = [np.array(cutter.model.encode(w), np.uint16).tobytes() for w in words]
    asked, plain = [], cutter.model

    class Noted:
        def encode(self, some, **more):
            asked.extend(some)
            return plain.encode(some, **more)

    cutter.model = Noted()
    assert [cutter.cut(words) for _ in range(3)] == [want] * 3
    assert Counter(asked) == {w: 3 if len(w) > attention_lm.KNOWN_LETTERS else 1 for w in words}
    monkeypatch.setattr(attention_lm, "KNOWN_WORDS", len(cutter.known) + 1)
    assert cutter.cut(["new", "newer", *words])[2:] == want and len(cutter.known) == attention_lm.KNOWN_WORDS


def test_pairs_are_counted_in_training_texts(spark):
    texts = ["one two one two " * 30, "one two", None, "held " * 9, "", "x" * 300]
    run = attention_lm.piece_content(attention_lm.VOCABULARY)
    content = run(pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    content["held"] = np.array([False, False, False, True, False, False])
    piece, lengths = attention_lm._stream(content)
    kinds = attention_lm.Kinds(np.bincount(piece[piece >= 0], minlength=32_000).astype(float), np.zeros(32_000, bool))
    want, at = Counter(), 0
    for n, held in zip(lengths.tolist(), content["held"].tolist(), strict=True):
        text = piece[at : at + n].tolist()
        if not held:
            before = [attention_lm.END, *kinds.context[text[:-1]].tolist()]
            want.update((c, p % 32_001) for c, p in zip(before, text, strict=True))
        at += n
    rows = spark.createDataFrame([(attention_lm.b.squeeze(content),)] * 2, "blob binary")
    got = attention_lm._pair_counts(rows, spark.sparkContext.broadcast(kinds)).collect()
    assert {divmod(r.key, 32_001): r.n for r in got} == {k: 2 * n for k, n in want.items()}


def test_adam_steps_as_written_out():
    """Steps on the flat array do to every weight what the formula says."""
    rng, model = np.random.default_rng(2), attention_lm.Attention()
    want = {n: x.astype(float) for n, x in model.w.items()}
    m, v = ({n: 0.0 for n in want} for _ in range(2))
    adam = attention_lm.Adam(model, 0.01)
    for t in range(1, 4):
        grads = {n: rng.standard_normal(x.shape) for n, x in want.items()}
        adam.step(grads)
        for n, g in grads.items():
            m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.99 * v[n] + 0.01 * g * g
            want[n] = want[n] - 0.01 * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-8)
    assert all(model.w[n] == pytest.approx(want[n], abs=1e-5) for n in want)


def test_windows_score_each_prediction_once():
    lengths = np.array([1, 31, 32, 33, 56, 57, 500])
    text, first, scored = attention_lm.windows_of(lengths)
    for i, n in enumerate(lengths.tolist()):
        seen = [p for t, f, s in zip(text, first, scored, strict=True) if t == i for p in range(s, min(f + attention_lm.CONTEXT, n))]
        assert seen == list(range(n))


def test_every_prediction_trains_once(monkeypatch):
    texts = ["one two three " * 200, "held", "short", "", "x" * 3000]
    run = attention_lm.piece_content(attention_lm.VOCABULARY)
    content = run(pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts}))
    content["held"] = np.array([False, True, False, False, False])
    piece, lengths = attention_lm._stream(content)
    size, ends = 32_000, Counter()
    kinds = attention_lm.Kinds(np.bincount(piece[piece >= 0], minlength=size).astype(float), np.zeros(size, bool))
    tables = attention_lm.Tables(kinds, np.zeros(0, np.int64), np.zeros(0, np.float32))
    plain = attention_lm.Attention.gradients

    def noted(self, seen, prior, target, counts):
        ends.update(target[counts].tolist())
        return plain(self, seen, prior, target, counts)

    monkeypatch.setattr(attention_lm.Attention, "gradients", noted)
    use = np.repeat(~content["held"], lengths)
    want = Counter(kinds.kind[piece[use]].tolist())
    assert attention_lm.train_on(attention_lm.Attention(), content, tables, rate=0.003, seed=1) == use.sum() and ends == want
    ends.clear()
    for share in range(3):
        attention_lm.train_on(attention_lm.Attention(), content, tables, rate=0.003, seed=1, share=share, shares=3)
    assert ends == want and want[attention_lm.END] >= 4


def test_piece_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    counts, starts = rng.integers(0, 50, 700).astype(float), rng.random(700) < 0.5
    kinds = attention_lm.Kinds(counts, starts)
    key = np.unique(rng.integers(0, attention_lm.CONTEXTS * 701, 5000))
    tables = attention_lm.Tables(kinds, key, rng.integers(1, 9, len(key)).astype(np.float32))
    assert np.exp(tables.piece.astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-3)
    hidden = np.ones((3, attention_lm.WIDTH), np.float32)
    model = attention_lm.Attention()
    total = np.zeros(3)
    for piece in range(701):
        k = np.full(3, kinds.kind[piece])
        log_p = model.log_probability(hidden, tables.prior[:3], k)
        total += np.exp(log_p + tables.piece[:3, piece] - tables.prior[np.arange(3), k])
    assert total == pytest.approx(1, abs=2e-3)


LANGUAGES = {"en": "the of and tion ing ther was with ould", "de": "der die und schen lich keit zwi über ge", "fr": "le la les eau que ment oux é tre"}


def language_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LANGUAGES))
        parts = LANGUAGES[lang].split()
        rows.append((i, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), lang))
    return rows


def test_language(spark):
    rows = language_rows(600, 3)
    edge = [(900, None, "en"), (901, "", "de"), (902, "12 #! 3", "fr"), (903, "THE OF AND x1y", None), (None, "der die und", "de"), (904, "语言", None)]
    edge += [(905, "a" * 500 + " " + "the " * 5000, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows + edge], "doc_id long, text string, lang string, row string, lang_pred string")
    got = {r.doc_id: r for r in language.predict_language(docs).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred == got[905].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    unlabelled = language.predict_language(docs.withColumn("lang", docs.lang.substr(100, 1)).where("lang is null"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language.predict_language(docs.limit(0)).count() == 0


def test_language_sends_only_the_text_to_python(spark):
    docs = spark.createDataFrame([(i, t, x) for i, t, x in language_rows(60, 4)], "doc_id long, text string, lang string")
    docs = docs.withColumn("a.b", docs.doc_id + 1).withColumn("score", docs.doc_id)
    named = language.identify(docs, language.learn(docs))
    plan = named.where("lang_pred <> 'und' AND score > 0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert named.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score"]
    assert all(r["a.b"] == r.doc_id + 1 and 0 <= r.score <= 1 for r in named.collect())


def test_rare_language_and_one_id_in_the_sample(spark):
    many = [(None if i % 3 == 0 else i, t, x) for i, t, x in language_rows(3000, 5) if x != "fr"]
    few = [(10_000 + i, t, x) for i, t, x in language_rows(400, 6) if x == "fr"][:40]
    docs = spark.createDataFrame(many + few, "doc_id long, text string, lang string")
    prior = Counter(x for _, _, x in many + few)
    drawn = Counter((r.lang, r.doc_id is None) for r in language.training_rows(docs, prior, 240).collect())
    assert drawn["fr", False] == 40
    others = sorted(set(prior) - {"fr"})
    for x in others:
        n, none = drawn[x, False] + drawn[x, True], drawn[x, True]
        assert n == pytest.approx(200 / len(others), rel=0.4) and 0.1 * n < none < 0.6 * n
    got = {r.doc_id: r for r in language.predict_language(docs, train_docs=60).collect()}
    held = [got[i].lang_pred for i, _, _ in few if got[i].held_out]
    assert len(held) > 5 and held.count("fr") > 0.8 * len(held)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "ba", "aba"])
    p = np.vstack([np.random.default_rng(1).random((pieces.other + 1, 2)), np.zeros(2)])
    number = {n: i for i, n in enumerate(pieces.names)}

    def plain(word, j):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, 4):
            head = word[:n]
            if len(head) == n and (head in number or n == 1):
                total += p[number.get(head, pieces.other), j] * plain(word[n:], j)
        return total

    words = ["a", "abab", "babab", "azb", "zz"]
    got = language.word_scores(pieces, p, words)
    assert np.exp(got) == pytest.approx(np.array([[plain(w, j) for j in (0, 1)] for w in words]))
    counts = language.expected(pieces, p[:, :1], ["abab"], np.array([2.0]))
    length = sum(len(n) * c for n, c in zip([*pieces.names, "?"], counts, strict=True))
    assert length == pytest.approx(8.0)


def test_long_runs_are_scored_as_a_whole():
    """Runs of scripts without spaces against sums of logarithms, letter by letter."""
    rng, draw = np.random.default_rng(3), random.Random(1)
    names = sorted({"".join(draw.choice("abcd") for _ in range(draw.randrange(1, 6))) for _ in range(60)} | set("abcd"))
    pieces = language.Pieces(names)
    p = np.vstack([rng.random((pieces.other + 1, 2)) * 1e-3, np.zeros(2)])
    number = {n: i for i, n in enumerate(pieces.names)}

    def plain(word, j):
        sums = [0.0]
        for e in range(1, len(word) + 1):
            heads = [(s, number.get(word[s:e], pieces.other if e - s == 1 else None)) for s in range(max(0, e - pieces.longest), e)]
            logs = [sums[s] + np.log(p[k, j]) for s, k in heads if k is not None]
            sums.append(max(logs) + np.log(np.exp(np.array(logs) - max(logs)).sum()))
        return sums[-1]

    sizes = (1, 23, 24, 25, 32, 33, 64, 65, 1000, 10_000)
    words = ["".join(draw.choice("abcdz") for _ in range(n)) for n in sizes] + ["z" * 64, "z" * 10_000, "é" * 300]
    got = language.word_scores(pieces, p, words)
    assert got == pytest.approx(np.array([[plain(w, j) for j in (0, 1)] for w in words]), rel=1e-9)
