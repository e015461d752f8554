"""Similarity self-join of documents on word shingles, by token groups.

A document's set holds its distinct shingles of `k` words (a shorter text is one shingle; no words, no set). Two sets
link when 100 * intersection >= percent * union. The result is exact up to equal hashes of 52 bits inside one pair.

1. Equal sets are one class. Of every class the tokens below a hash threshold are counted over all classes. A token that no
   other class has is a miss against every other; a class with more misses than a link allows is alone. What is left are
   the candidates, whose whole sets are made.
2. In a few rounds every candidate not yet linked is compared with one leader, the class that most of its least tokens
   name; leaders have few tokens of their own. The links found make groups.
3. A token that only one group has is a miss against all classes outside of it. Classes with too many such misses are closed:
   first by the tokens below a threshold, then by all tokens of the few that are left. Only open classes go on. Those that are
   alone are compared with the hub of the group near them.
4. The token-group matrix: open classes of a group, with sizes and shares of misses alike, are one coarse group; every token
   with the coarse groups that have it is their unions of tokens. Joining a class with it counts its overlap with each union.
   Where that overlap may suffice, the same is asked of the blocks of the coarse group, which are of bounded size; only
   qualifying blocks are opened. Their members are compared in rounds, one, two, four and so on at a time, all of them
   in the end; between the rounds pairs that links have connected meanwhile drop out.
5. Components over all links.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.components import components, merged, stored, with_values
from holdfast.llm.words import coded, hashes, mix, rolled, slices, split, starts_of
from holdfast.operators.membership import possible
from holdfast.session import work_path

PERCENT = 75
SHINGLE = 5
COUNTED = 0.4
KEPT = 0.4
ROUNDS = 4
# Least tokens by which classes name a leader, and coarse groups per size by the share of misses.
NAMED_BY = 16
SHARES = 8
BLOCK = 128

_BITS = 52
_LOW = np.uint64((1 << _BITS) - 1)


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and token of every distinct shingle, in order; and where each text's tokens start.

    A token is 52 bits of a hash. At most 4096 texts at once, so that owner and token fit one number.
    """
    n = len(texts)
    words, owner = split(texts, lower=True)
    distinct, codes = coded(words)
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    first, counts = starts_of(owner, n)
    grams = rolled(h, k)
    whole = owner[: len(grams)] == owner[k - 1 :] if len(grams) else np.zeros(0, bool)
    tokens, owners = [grams[whole]], [owner[: len(grams)][whole]]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        value = np.full(len(short), m, np.uint64)
        for i in range(m):
            value = value * np.uint64(0x9E3779B97F4A7C15) + h[first[short] + i]
        tokens.append(mix(value))
        owners.append(short)
    token, own = np.concatenate(tokens) & _LOW, np.concatenate(owners).astype(np.uint64)
    key = np.sort((own << np.uint64(_BITS)) | token)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    own = (key >> np.uint64(_BITS)).astype(np.int64)
    return own, (key & _LOW).astype(np.int64), starts_of(own, n)[0]


def _class_of(tokens: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: the sum of its mixed tokens, mixed with its size."""
    total = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        plain = mix(tokens.astype(np.uint64))
        total[full] = np.add.reduceat(plain, first[full])
    return mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _per_document(k: int, emit):
    """A task function over (doc_id, mark, text) batches; `emit` makes the rows from a slice's sets."""

    def run(batches):
        for part in slices(batches, "text"):
            own, tokens, first = _sets(part.column("text"), k)
            size = np.bincount(own, minlength=part.num_rows)
            yield emit(part, own, tokens, first, size, _class_of(tokens, first, size))

    return run


def _describe(part, own, tokens, first, size, cls):
    columns = [part.column("doc_id"), part.column("mark"), pa.array(size), pa.array(cls, mask=size == 0)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "cls"])


def _counted(part, own, tokens, first, size, cls):
    """The tokens below the threshold with their class."""
    usable = ~np.asarray(part.column("doc_id").is_null())
    at = np.flatnonzero((tokens < int(COUNTED * (1 << _BITS))) & usable[own])
    return pa.RecordBatch.from_arrays([pa.array(tokens[at]), pa.array(cls[own[at]])], ["token", "cls"])


def _whole(part, own, tokens, first, size, cls):
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cls), lists], ["doc_id", "cls", "tokens"])


def _links(a, b, percent: int):
    """Whether two arrays of distinct tokens link."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _fits(common, sizes, percent: int):
    """Whether sets whose sizes add up to `sizes` may link with at most `common` tokens in common.

    They link when 100 * intersection >= percent * (sizes - intersection).
    """
    return common * (100 + percent) >= sizes * percent


def _allowed_misses(n: str, percent: int):
    """How many tokens of a set of size n may be missing from a set that links with it."""
    return F.col(n) - F.ceil(F.col(n) * percent / 100)


def jaccard_components(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), mark (of the text).

    Null text, empty text and text of white space only: n_shingles 0, component_id the own doc_id. Null doc_id:
    component_id is null, and the row links with nothing. Equal texts are in one component. Rows that repeat a doc_id
    are separate documents. Other columns of the input are ignored; an empty table gives an empty table.
    """
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    base = stored(docs.mapInArrow(_per_document(k, _describe), "doc_id long, mark long, n_shingles long, cls long"), "sets")
    named = base.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls")
    classes = stored(named.agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")), "classes")
    sets, name = _candidate_sets(docs, classes, k, percent)
    found, near = _leader_links(sets, percent)
    links = found.unionByName(_group_links(sets, components(found, "a", "b"), near, percent))
    documents.sparkSession.sql(f"DROP TABLE {name}")
    # A node sorts by its least doc_id, so the root of a component begins with the component's id.
    ends = merged(classes.select("cls", F.struct("least", "cls").alias("end")))
    links = links.join(ends.withColumnsRenamed({"cls": "a", "end": "x"}), "a").join(ends.withColumnsRenamed({"cls": "b", "end": "y"}), "b")
    roots = components(links, "x", "y").select(F.col("node.cls").alias("cls"), F.col("root.least").alias("root"))
    known = classes.join(merged(roots), "cls", "left").select("cls", "rows", F.coalesce("root", "least").alias("own"))
    whole = with_values(base, stored(known, "known"), "cls", "rows", base.count(), "own")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "doc_id"))
    return whole.select("doc_id", "n_shingles", own.alias("component_id"), "mark")


def _candidate_sets(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> tuple[DataFrame, str]:
    """(cls, n, own, tokens) of the classes that may link with another one, tokens in order; and the table's name.

    `own` is the share of a class's counted tokens that no other class has, in SHARES parts of what a link allows.

    The table is bucketed by class, so later joins by class move no tokens of it.
    """
    spark = docs.sparkSession
    counted = docs.mapInArrow(_per_document(k, _counted), "token long, cls long")
    ends = counted.groupBy("token").agg(F.min("cls").alias("cls"), F.max("cls").alias("last"))
    misses = ends.where("cls = last").groupBy("cls").agg(F.count(F.lit(1)).alias("misses"))
    reps = classes.join(merged(misses), "cls", "left").where(F.coalesce("misses", F.lit(0)) <= _allowed_misses("n", percent))
    own = F.coalesce("misses", F.lit(0)) * (100 * SHARES / (COUNTED * (100 - percent))) / F.col("n")
    reps = stored(reps.select("cls", F.col("least").alias("doc_id"), own.alias("own")), "candidates")
    # The filter lets few other rows through; whatever row a class comes from, its set is the same.
    chosen = possible(docs, "doc_id", reps, "doc_id", reps.count())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = chosen.mapInArrow(_per_document(k, _whole), "doc_id long, cls long, tokens array<long>").select("cls", "tokens")
    sets = sets.repartition(buckets, "cls").dropDuplicates(["cls"]).join(merged(reps.select("cls", "own").repartition(buckets, "cls")), "cls")
    name = f"token_sets_{uuid.uuid4().hex}"
    sets = sets.select("cls", F.size("tokens").cast("long").alias("n"), "own", "tokens")
    sets.write.bucketBy(buckets, "cls").option("path", work_path(spark, name)).saveAsTable(name)
    return spark.table(name), name


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("own")), "a")
    both = both.join(sets.select(F.col("cls").alias("b"), "tokens"), "b")
    return both.where(_links("own", "tokens", percent)).select("a", "b")


def _leader_links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with leaders, and (cls, leader) of the first round.

    Leaders have few tokens of their own, so they are amid their near copies; the first round takes the class with
    the fewest, the others order classes with about as few differently.
    """
    named_by = F.explode(F.slice("tokens", 1, NAMED_BY)).alias("token")
    least = stored(sets.select("cls", "own", F.least("n", F.lit(NAMED_BY)).alias("of"), named_by), "least")
    found = first = None
    for r in range(ROUNDS):
        order = F.struct(F.col("own") if r == 0 else F.floor("own"), F.xxhash64(F.lit(r), "cls"))
        leaders = least.groupBy("token").agg(F.min_by("cls", order).alias("leader"))
        votes = least
        if found is not None:
            votes = votes.join(merged(found.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "cls", "left_anti")
        votes = votes.join(merged(leaders), "token").where("cls <> leader").groupBy("cls", "leader")
        votes = votes.agg(F.count(F.lit(1)).alias("votes"), F.max("of").alias("of")).groupBy("cls")
        named = votes.agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"), F.max("votes").alias("votes"), F.max("of").alias("of"))
        if first is None:
            named = first = stored(named, "leaders")
        # With fewer tokens in common a link is unlikely; the matrix finds it then.
        pairs = named.where("2 * votes >= of").select(F.col("cls").alias("a"), F.col("leader").alias("b"))
        new = stored(_verified(pairs, sets, percent), "found")
        found = new if found is None else found.unionByName(new)
    return found, first.select("cls", "leader")


def _outer_tokens(rows: DataFrame) -> DataFrame:
    """(cls, outer): how many of the tokens (token, cls, gid) of a class another group has too."""
    placed = rows.select("token", "cls", "gid").repartition("token")
    spans = placed.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low < high").select("token")
    return placed.join(merged(spans), "token", "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("outer"))


def _open_classes(sets: DataFrame, held, outer: DataFrame, percent: int) -> DataFrame:
    """The sets whose `inner` tokens, of `held` those that only their own group has, leave room for a link outside."""
    inner = held - F.coalesce("outer", F.lit(0))
    return sets.join(outer, "cls", "left").withColumn("inner", inner).drop("outer").where(F.col("inner") <= _allowed_misses("n", percent))


def _group_links(sets: DataFrame, grouped: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that are not connected yet."""
    labels = grouped.select(F.col("node").alias("cls"), "root")
    leaders = near.join(merged(labels.withColumnsRenamed({"cls": "leader", "root": "near"})), "leader", "left")
    leaders = leaders.select("cls", F.coalesce("near", "leader").alias("near"))
    members = sets.select("cls", "n").join(merged(labels), "cls", "left").join(merged(leaders), "cls", "left")
    members = members.select(
        "cls",
        # Sizes of sets that link are in the same or in neighbouring classes.
        F.floor(F.log("n") / F.log(F.lit(100 / percent))).alias("size"),
        F.coalesce("root", "cls").alias("gid"),
        F.col("root").isNull().alias("alone"),
        F.coalesce("root", "near", "cls").alias("group"),
    )
    members = stored(members, "members")
    named = sets.drop("own").join(merged(members), "cls")
    below = F.filter("tokens", lambda t: t < int(KEPT * (1 << _BITS)))
    outer = _outer_tokens(named.select("cls", "gid", F.explode(below).alias("token")))
    opened = stored(_open_classes(named, F.size(below), outer, percent), "open")
    outer = _outer_tokens(opened.select("cls", "gid", F.explode("tokens").alias("token")))
    opened = stored(_open_classes(opened.drop("inner"), F.col("n"), outer, percent), "open")
    heard, opened = _hub_links(opened, sets, percent)
    share = F.floor(F.col("inner") * 100 * SHARES / (F.col("n") * (100 - percent)))
    opened = stored(opened.withColumn("coarse", F.xxhash64("group", "alone", "size", share)), "open")
    parts = opened.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.xxhash64("coarse", F.pmod(F.xxhash64("cls"), F.col("parts")))
    placed = stored(opened.drop("tokens").join(parts, "coarse").withColumn("block", block), "placed")
    rows = opened.select("cls", "tokens").join(merged(placed), "cls").withColumn("token", F.explode("tokens")).drop("tokens")

    # Two that are alone would ask each other, so only one of them asks.
    asked = _qualifying(rows, rows, "coarse", [F.expr("NOT other_alone OR coarse <= other_coarse")], percent)
    fine = rows.join(asked, "cls")
    once = F.expr("NOT other_alone OR coarse < other_coarse OR block <= other_block")
    found = _qualifying(fine, rows, "block", [F.col("asked_coarse") == F.col("other_coarse"), once], percent)
    return heard.unionByName(_compared(found.select("cls", F.col("asked_block").alias("block")), placed, sets, percent))


def _hub_links(opened: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of open classes that are alone with the hub of their group, and the open classes, those linked in its group.

    The hub is the member that has the fewest tokens to itself, of all tokens.
    """
    order = F.struct("inner", F.xxhash64("cls"))
    hubs = opened.where("NOT alone").groupBy("group", "size").agg(F.min_by("cls", order).alias("b"))
    pairs = opened.where("alone").join(hubs, ["group", "size"]).select(F.col("cls").alias("a"), "b")
    links = stored(_verified(pairs, sets, percent), "hub_links")
    joined = opened.join(merged(links.select(F.col("a").alias("cls"), "b")), "cls", "left").withColumn("alone", F.col("alone") & F.col("b").isNull())
    return links, joined.withColumn("gid", F.when(F.col("b").isNull(), F.col("gid")).otherwise(F.col("group"))).drop("b")


def _compared(asked: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the classes and the members of the blocks that they ask."""
    number = F.row_number().over(Window.partitionBy("block").orderBy("cls")) - 1
    others = placed.select("block", number.alias("number"), *[F.col(c).alias(f"other_{c}") for c in ("cls", "n", "gid", "inner")])
    others = stored(others, "numbered")
    sizes = others.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    waiting = stored(asked.join(sizes, "block").join(placed.select("cls", "n", "gid", "inner"), "cls"), "waiting")
    links, tried, take = None, 0, 1
    while True:
        at = F.explode(F.sequence(F.lit(tried), F.least(F.lit(tried + take), F.col("members")) - 1))
        turn = waiting.withColumn("number", at).withColumn("number", F.pmod(F.col("number") + F.pmod(F.xxhash64("cls"), F.col("members")), F.col("members")))
        # Each of the two has at least its inner tokens as misses.
        common = F.least(F.col("n") - F.col("inner"), F.col("other_n") - F.col("other_inner"))
        room = _fits(common, F.col("n") + F.col("other_n"), percent) & (F.col("gid") != F.col("other_gid"))
        pairs = turn.join(merged(others), ["block", "number"]).where(room)
        pairs = pairs.select(F.least("cls", "other_cls").alias("a"), F.greatest("cls", "other_cls").alias("b")).distinct()
        new = stored(_verified(pairs, sets, percent), "opened_links")
        links = new if links is None else links.unionByName(new)
        tried, take = tried + take, 2 * take
        waiting = waiting.where(F.col("members") > tried)
        if not new.isEmpty():
            gids = others.select(F.col("other_cls").alias("a"), F.col("other_gid").alias("x"))
            met = new.join(gids, "a").join(gids.withColumnsRenamed({"a": "b", "x": "y"}), "b")
            roots = components(met, "x", "y").select(F.col("node").alias("gid"), "root")
            waiting = waiting.join(roots, "gid", "left").withColumn("gid", F.coalesce("root", "gid")).drop("root")
            others = others.join(roots.withColumnRenamed("gid", "other_gid"), "other_gid", "left")
            others = stored(others.withColumn("other_gid", F.coalesce("root", "other_gid")).drop("root"), "numbered")
            spans = others.groupBy("block").agg(F.min("other_gid").alias("low"), F.max("other_gid").alias("high"))
            waiting = waiting.join(spans, "block").where("low <> high OR low <> gid").drop("low", "high")
        waiting = stored(waiting, "waiting")
        if waiting.isEmpty():
            return links


def _qualifying(asking: DataFrame, rows: DataFrame, level: str, also: list, percent: int) -> DataFrame:
    """(cls, asked_<level>): the unions of tokens with which a class may have enough in common for a link.

    A class that is alone asks all unions of a fitting size, a class of a group those of later groups; `also` narrows that.
    """
    names = ["coarse", "group", "alone", "size"]
    unions = rows.groupBy("token", level, *[c for c in names if c != level]).agg(F.count(F.lit(1)).alias("holders"))
    # What a member may have in common with a set of size s is enough if `most` is at least percent * s.
    most = F.col("n") * 100 - F.col("inner") * (100 + percent)
    ends = rows.groupBy(F.col(level).alias(f"other_{level}")).agg(F.min("inner").alias("other_inner"), F.min("n").alias("other_n"), F.max(most).alias("most"))
    unions = unions.withColumnsRenamed({c: f"other_{c}" for c in dict.fromkeys([level, *names])})
    met = asking.join(unions, "token").where(F.abs(F.col("size") - F.col("other_size")) <= 1)
    met = met.where("alone OR (NOT other_alone AND group < other_group)")
    # In its own union a class is one of the holders.
    met = met.where((F.col(level) != F.col(f"other_{level}")) | (F.col("holders") > 1))
    for condition in also:
        met = met.where(condition)
    overlap = met.groupBy("cls", "n", f"other_{level}").agg(F.count(F.lit(1)).alias("both"))
    overlap = overlap.join(ends, f"other_{level}")
    room = (F.col("n") - F.col("both")) * 100 + F.col("other_inner") * percent <= F.col("n") * (100 - percent)
    room = room & _fits(F.col("both"), F.col("n") + F.col("other_n"), percent) & (F.col("most") >= F.col("n") * percent)
    return overlap.where(room).select("cls", F.col(f"other_{level}").alias(f"asked_{level}"))
