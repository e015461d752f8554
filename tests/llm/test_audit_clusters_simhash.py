"""Filter audit, centroid clustering and SimHash against plain versions."""

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import corpus
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from holdfast.llm import filter_audit, shallot, simhash

LABELS = "doc_id long, quality int, toxic int, text string, part string, bits long"


def collected(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# Filter audit


def audit_rows():
    rng, rows = random.Random(5), []
    letters = [f"w{i}" for i in range(150)]
    for i in range(90):
        n = rng.choice([0, 3, 99, 100, 101, 130])
        text = " ".join(rng.sample(letters, min(n, 120)) if i % 3 else rng.choices(letters, k=n))
        text += rng.choice(["", "", " A", " #", " ÄÖ", " " + "Q" * 60])
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(rng.randrange(200), rng.choice(rows)[1], "en") for _ in range(60)]
    rows += [(None, rows[3][1], "en"), (None, rows[3][1], "en"), (300, None, "fr"), (301, "", None), (302, "", "fr"), (7, rows[0][1], "en"), (7, rows[0][1], "en")]
    rows += [(1000 + i, "the same text", "de") for i in range(40)] + [(999, "long " * 5000, "en")]
    return rows


def plain_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, bad = ({r[0] for r in labels if r[c] == 1} - {None} for c in (1, 2))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w, caps = corpus.words(t), sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * caps > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and i > least.get(t, i)
        facts.append((lang or "", fails, i in good, i in bad))
    out = {}
    for order in permutations("ABCDE"):
        for step, letter in enumerate(order, 1):
            for part in {f[0] for f in facts}:
                mine = [f for f in facts if f[0] == part]
                left = [f for f in mine if not any(f[1][x] for x in order[: step - 1])]
                removed = [f for f in left if f[1][letter]]
                fail = sum(f[1][letter] for f in mine)
                only = sum(f[1][letter] and sum(f[1].values()) == 1 for f in mine)
                counts = (len(left) - len(removed), len(removed), fail - len(removed), only, sum(f[2] for f in removed), sum(f[3] for f in removed))
                out[part, "".join(order), step] = counts
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c[1]
    return Counter((*k, *c, shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items())


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("share", [1024, 4])
def test_audit_against_plain(spark, monkeypatch, share):
    monkeypatch.setattr("holdfast.llm.components.HEAVY_SHARE", share)
    rows = audit_rows()
    labels = [(i, (1, 0, None)[i % 3], (0, 1, 1, None)[i % 4]) for i in range(0, 320, 2)] + [(None, 1, 1), (4, 0, 1), (4, 1, 0), (5000, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, t, lang in rows], "doc_id long, text string, lang string, part string, bits int, mark int").repartition(3)
    told = spark.createDataFrame([(*x, "t", "p", 1) for x in labels], LABELS)
    assert collected(filter_audit.audit(docs, told), *AUDIT) == plain_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs, told = corpus.frame(spark, [(1, "a")]), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs.limit(0), told).count() == 0
    report = filter_audit.audit(docs, told)
    assert report.count() == 600
    assert report.agg(F.sum("removed"), F.sum("good_lost")).first()[:] == (120, 0)


def test_text_failures_of_a_slice():
    texts = pa.array(["x", None, "A b", "é" * 9 + "Q", "a" * 9 + "Q", "a" * 8 + "QQ", "|"])
    assert filter_audit.text_failures(texts.slice(1)).tolist() == [1, 1 | 4, 1, 1, 1 | 4, 1 | 8]


# SimHash


def plain_fingerprint(text, k=3):
    w = [x.encode() for x in corpus.words(text, lower=True)]
    grams = [b" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w))))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, distance=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and bin(fps[a] ^ fps[b]).count("1") <= distance:
                root[find(a)] = find(b)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [None if i is None else least[find(x)] for x, i in enumerate(ids)]


def simhash_rows():
    rows = corpus.texts(3, 70)
    rng = random.Random(8)
    words = [f"v{i}" for i in range(300)]
    base = corpus.sentence(rng, 400, words).split(" ")
    for i in range(40):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((5000 - i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("share", [1024, 3])
def test_simhash_against_plain(spark, monkeypatch, share):
    monkeypatch.setattr("holdfast.llm.components.HEAVY_SHARE", share)
    rows = simhash_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], [f"{x:016x}" for x in fps], plain_components([i for i, _ in rows], fps), strict=True))
    found = simhash.near_copies(corpus.frame(spark, rows).withColumn("fp", F.lit("x")).withColumn("node", F.lit(1)))
    assert collected(found.withColumn("hex", simhash.as_hex("fp")), "doc_id", "hex", "component_id") == want


def test_fingerprints_of_slices_and_long_texts():
    texts = [t for _, t in simhash_rows()] + ["a b", " ".join(f"q{i % 977}" for i in range(150_000))]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints(pa.array(texts).slice(9, 20)).tolist() == [plain_fingerprint(t) for t in texts[9:29]]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("paired", [1, 3, 32])
def test_links_of_crowded_variants(spark, paired):
    rng = random.Random(paired)
    fps = {rng.getrandbits(64) for _ in range(40)}
    crowd = rng.getrandbits(64)
    for _ in range(150):
        x = crowd
        for _ in range(rng.randrange(0, 5)):
            x ^= 1 << rng.choice([0, 1, 5, 17, 31, 32, 33, 40, 47, 48, 62, 63])
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    got = {frozenset(r) for r in simhash.near_links(nodes, paired=paired).collect()}
    assert got == {frozenset((a, b)) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2}


def test_variants_do_not_go_through_the_driver(spark, monkeypatch):
    """A small file of nodes has 64 variants a node, which Spark takes for as small as the file."""
    write, plans = simhash.stored, []
    nodes = write(spark.range(300).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp")), "nodes")
    monkeypatch.setattr(simhash, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    assert simhash.near_links(nodes).count() == 0
    assert len(plans) == 2
    assert all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in plans)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_copies(corpus.frame(spark, [(1, "a")]).limit(0)).count() == 0


# Centroid clustering


def plain_clusters(rows, k=8, rounds=10, width=4, seed=3):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), ",".join(map(str, v)), v) for i, v in kept if i is not None)
    centroids = [v for *_, v in named[:k]]
    if not centroids:
        return Counter()

    def away(v, c):
        return sum((x - y) ** 2 for x, y in zip(v, c, strict=True))

    def nearest():
        return [min((away(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = nearest()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = nearest()
    fit = lambda x: x if x is not None and x < 1 << 63 else None
    inside = {}
    for d, c in found:
        inside[c] = None if inside.get(c, 0) is None or fit(d) is None else inside.get(c, 0) + d
    inside = {c: fit(x) for c, x in inside.items()}
    every = None if None in inside.values() else fit(sum(inside.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, fit(d), inside[c], every, names[c]) for (i, _), (d, c) in zip(kept, found, strict=True))


CLUSTERED = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def vectors(n, seed, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, spread) for _ in range(4)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.3 * spread) for x in rng.choice(middles)]) for i in range(n)]


def awkward():
    rows = vectors(120, 1)
    rows += [(500, None), (501, [1.0, 2.0, 3.0]), (502, [1.0, None, 2.0, 3.0]), (503, [1.0, math.nan, 2.0, 3.0]), (504, [math.inf, 0.0, 0.0, 0.0]), (505, [])]
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (7, [0.5] * 4), (7, [0.25] * 4), (7, [0.25] * 4), (600, [0.0] * 4), (601, [-0.0] * 4), (602, [-1e-9] * 4)]
    return rows + [(700 + i, [0.125] * 4) for i in range(50)]


CASES = {
    "awkward": awkward(),
    "few": vectors(3, 2),
    "one": [(1, [1.0, 2.0, 3.0, 4.0])],
    "equal": [(i, [1.0] * 4) for i in range(20)],
    "grid": [(i, [i % 3 / 1024, i % 5 / 1024, i % 2 / 1024, 0.0]) for i in range(60)],
    "large": vectors(60, 4, 1e6),
    "huge": vectors(30, 5) + [(100, [1e300, 0.0, 0.0, 0.0]), (101, [1.7e308, -1.0, 0.0, 0.0]), (102, [-1.7e308, -1.0, 0.0, 0.0])],
}


@pytest.mark.parametrize("case", CASES)
def test_clusters_against_plain(spark, case):
    rows = CASES[case]
    table = spark.createDataFrame([(i, v, "c", 1, "g") for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int, gid string")
    found = shallot.cluster_vectors(table.repartition(3), width=4)
    assert collected(found, *CLUSTERED) == plain_clusters(rows)


def test_clusters_of_an_empty_table_and_without_ids(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert shallot.cluster_vectors(table).columns == CLUSTERED
    nameless = spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert shallot.cluster_vectors(nameless).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_search_keeps_bounds_and_saves_work(seed, monkeypatch):
    """Bounds hold in every round, the assignment is that of all distances, and fewer distances are taken."""
    rng = np.random.default_rng(seed)
    middles = rng.integers(-900, 900, (9, 16))
    points = (middles[rng.integers(0, 9, 3000)] + rng.integers(-60, 60, (3000, 16))).astype(np.int16)
    centroids, before, state, taken = points[:9].astype(int).tolist(), None, None, 0
    measure = shallot._squared

    def counted(v, c):
        nonlocal taken
        taken += len(v)
        return measure(v, c)

    monkeypatch.setattr(shallot, "_squared", counted)
    for _ in range(12):
        now = shallot.Centroids(centroids, before)
        packed = None if state is None else shallot._state_of(shallot._packed_state(state))
        state = shallot.search(points, now, packed)
        away = ((points[:, None].astype(np.int64) - np.array(centroids)) ** 2).sum(axis=2)
        assert (state[0] == away.argmin(axis=1)).all()
        assert (state[2] ** 2 >= away.min(axis=1)).all()
        away[np.arange(len(points)), state[0]] = 1 << 60
        assert (state[3] <= np.sqrt(away.min(axis=1))).all()
        before = centroids
        centroids = [(points[state[0] == j].astype(int).sum(axis=0) // max(1, (state[0] == j).sum())).tolist() for j in range(9)]
    assert taken < 12 * 9 * len(points) / 2
