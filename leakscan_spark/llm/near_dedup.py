"""MinHash near-dedup by an inverted join over signature coordinates.

Every distinct shingle set gets a signature of ``COORDINATES`` minima and is
posted under each coordinate-value pair. Two sets over the similarity agree in
at least ``T`` coordinates (all but ``MISSED`` of them), so:

* Prefix: with tokens ordered by how many sets hold them, a pair that agrees in
  T places shares one of each set's first K - T + 1 tokens. Tokens that one set
  holds alone join nothing and only shorten the prefix.
* Merge: in a posting list of up to ``SHORT`` sets all pairs meet, their
  agreements are counted over the whole signatures, and pairs with T or more
  are confirmed on full shingle sets.
* Skip: a longer list is never paired. It falls into bands of similar set
  sizes; a band's most central member is its hub, and the others are compared
  with the hub alone. Two members can be
  linked without both being linked to the hub only if they share enough of
  what sets them apart from it: for sets A, B with differences D from the hub,
  |A ^ B| = |D(A) ^ D(B)|. So the differences are posted, rarest first, under
  (hub, shingle), each as far as a link may leave them unmatched, and a
  pair is formed where its first common shingle leaves enough of both. Every
  pair the list holds is thus either implied by links to the hub or found.
* Strays: only a member linked to the hub has to be compared with a stray by
  differences, if the stray is near enough. Strays of one hub are posted again,
  once each and not once per hub, under the rarest of the shingles that strays
  share. Most share too few with any other and are out. Short lists are paired,
  long ones get hubs as before, and what strays from these shows all its
  differences. Links inside a class known by then are not looked for.

Copies of one shingle set are one node. Components of the links give each
document the smallest document reachable.

Null texts, empty texts and texts without words are linked with nothing. Texts
with fewer words than a shingle have one shingle, the whole sequence. Repeated
rows are copies of each other. Rows of one id with different texts are kept apart
by a hash of the text; rows with a null id are linked with nothing and have no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, blocks, mixed, saved, table, text_blocks, unused, utf8
from .components import components

COORDINATES = 32
SHORT = 24
MISSED = 1e-6

_rng = np.random.default_rng(11)
_FLIP = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def least_agreement(percent: int, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """The most agreements that all but ``missed`` of the pairs at the similarity reach."""
    s, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * s**t * (1 - s) ** (coordinates - t)
        if below > missed:
            return max(1, t)
    return coordinates


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (keys unique across rows, hashes, rows), ordered by row."""
    words = Words(data, offsets)
    grams, at = words.grams(n)
    rows = words.rows[at]
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            for h in words.hashes[words.first[r] : words.first[r + 1]]:
                whole[k] = mixed(whole[k : k + 1] * np.uint64(31) + h)[0]
        grams, rows = np.r_[grams, whole], np.r_[rows, short]
    keys, at = np.unique(grams ^ mixed(rows.astype(np.uint64)), return_index=True)
    order = np.argsort(rows[at], kind="stable")
    return keys[order], grams[at][order], rows[at][order]


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, t, text): an id may have several texts, so the text's hash goes with it."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def signatures(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, t, n_shingles, hi, lo, sig): the text's hash, set size, set hash and minima of every row; no sig for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch["text"]):
                _, grams, rows = shingles(data, offsets, n)
                sizes = np.bincount(rows, minlength=hi - lo)
                some = np.flatnonzero(sizes)
                first = np.r_[0, np.cumsum(sizes[some])[:-1]]
                sums = np.zeros((2, hi - lo), np.uint64)
                minima = np.zeros((len(some), COORDINATES), np.int32)
                if len(some):
                    sums[0, some] = np.add.reduceat(mixed(grams), first)
                    sums[1, some] = np.add.reduceat(mixed(grams ^ _FLIP[0]), first)
                    for k in range(COORDINATES):
                        values = (((grams ^ _FLIP[k]) * _TIMES[k]) >> np.uint64(32)).astype(np.uint32)
                        minima[:, k] = np.minimum.reduceat(values, first).view(np.int32)
                ends = np.zeros(hi - lo + 1, np.int32)
                ends[1:] = np.cumsum(sizes > 0) * COORDINATES
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"][lo:hi], "t": batch["t"][lo:hi], "n_shingles": pa.array(sizes.astype(np.int64)),
                    "hi": pa.array(sums[0].view(np.int64)), "lo": pa.array(sums[1].view(np.int64)),
                    "sig": pa.ListArray.from_arrays(pa.array(ends), pa.array(minima.ravel())),
                })

    return keyed(documents).mapInArrow(sign, "doc_id long, t long, n_shingles long, hi long, lo long, sig array<int>")


def postings(tokens: DataFrame) -> DataFrame:
    """(token, node, center): of (node, token, least), each node under its rarest tokens, one of which any set that shares ``least`` has too.

    ``center`` adds up how common a node's tokens are: the typical member of a group has the most.
    """
    held = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    lists = tokens.join(held, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("c", "token"))).alias("held"), F.sum("c").alias("center"), F.max("least").alias("least")
    )
    prefix = F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)
    return lists.where(F.size("held") >= F.col("least")).select("node", "center", F.explode(prefix).alias("p")).select(
        F.col("p.token").alias("token"), "node", "center"
    )


def coordinates(nodes: DataFrame, least: int) -> DataFrame:
    """(node, token, least): each coordinate with its value."""
    return nodes.select("node", F.posexplode("sig").alias("k", "v")).select(
        "node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"),
        F.lit(least).alias("least"),
    )


def whole_sets(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, token, least): every shingle of (node, text), and how many of them any set over the similarity shares."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch["text"]):
                _, grams, rows = shingles(data, offsets, n)
                ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=hi - lo))].astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "node": batch["node"][lo:hi], "grams": pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64))),
                })

    sets = texts.select("node", "text").mapInArrow(split, "node long, grams array<long>")
    least = F.ceil(F.size("grams") * percent / 100).cast("int")
    return sets.select("node", least.alias("least"), F.explode("grams").alias("token"))


def candidates(posted: DataFrame, nodes: DataFrame, least: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of short lists that agree often enough, and (hub, member) pairs of long lists."""
    c = F.col
    lists = posted.groupBy("token").agg(F.count("*").alias("n"))
    lists = saved(lists.where(c("n") > 1), "lists")  # a plain table: Spark can then split the long lists' joins
    short = posted.join(lists.where(c("n") <= SHORT).select("token"), "token").select("token", "node")
    met = short.alias("x").join(short.alias("y"), "token").where(c("x.node") < c("y.node"))
    met = met.select(c("x.node").alias("a"), c("y.node").alias("b")).distinct()
    left = nodes.select(c("node").alias("a"), c("sig").alias("sa"))
    right = nodes.select(c("node").alias("b"), c("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = met.join(left, "a").join(right, "b").where(agree >= least).select("a", "b")
    # Linked sets are alike in size, so a long list falls into bands of sizes, each set in two neighbouring ones.
    band = F.floor(F.log("size") / math.log(100 / percent)).cast("int")
    long = posted.join(lists.where(c("n") > SHORT).select("token"), "token").join(nodes.select("node", "size"), "node")
    long = saved(long.select("token", "node", "center", F.explode(F.array(band, band + 1)).alias("band")), "long-lists")
    hubs = saved(
        long.groupBy("token", "band").agg(F.max(F.struct("center", (-c("node")).alias("node"))).alias("top")), "hubs"
    ).select("token", "band", (-c("top.node")).alias("a"))
    stars = long.join(hubs, ["token", "band"]).select("a", c("node").alias("b")).where("a != b").distinct()
    return pairs, stars


CONFIRMED = "a long, b long, star boolean, common long, size_a long, size_b long, apart array<long>"


def confirmed(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Exact set sizes of pairs (a, b, star), and for stars the shingles that one side alone has, those of ``a`` first."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [utf8(batch[side]) for side in ("ta", "tb")]
            for lo, hi in blocks(sides[0][1] + sides[1][1]):
                part, rows = batch.slice(lo, hi - lo), hi - lo
                (ka, ga, ra), (kb, gb, rb) = (shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n) for data, at in sides)
                both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                alone_a, alone_b = np.ones(len(ka), bool), np.ones(len(kb), bool)
                alone_a[ia], alone_b[ib] = False, False
                star = part["star"].to_numpy(zero_copy_only=False)
                grams, owner = np.r_[ga[alone_a], gb[alone_b]], np.r_[ra[alone_a], rb[alone_b]]
                grams, owner = grams[star[owner]], owner[star[owner]]
                grams = grams[np.argsort(owner, kind="stable")]
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))].astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "a": part["a"], "b": part["b"], "star": part["star"],
                    "common": pa.array(np.bincount(ra[ia], minlength=rows)),
                    "size_a": pa.array(np.bincount(ra, minlength=rows)), "size_b": pa.array(np.bincount(rb, minlength=rows)),
                    "apart": pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64))),
                })

    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(ta, "a").join(tb, "b").select("a", "b", "star", "ta", "tb")
    return rows.mapInArrow(confirm, CONFIRMED)


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    c = F.col
    union = c("size_a") + c("size_b") - c("common")
    return pairs.where(100 * c("common") >= percent * union)


def parted(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` with ``apart_yet``: whether the classes in ``labels`` hold a and b apart."""
    a, b = (labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")) for side in "ab")
    named = pairs.join(a, "a", "left").join(b, "b", "left")
    return named.withColumn("apart_yet", F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).drop("label_a", "label_b")


def star_marks(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, distance, apart_yet) of hubs and members, by Jaccard distance."""
    c, union = F.col, F.col("size_a") + F.col("size_b") - F.col("common")
    marks = stars.select("a", "b", (100 * c("common") >= percent * union).alias("linked"), (1 - c("common") / union).alias("distance"))
    return parted(marks, labels)


def of_hubs(marks: DataFrame, condition: Column) -> DataFrame:
    """The rows of hubs that have a member for the condition."""
    return marks.join(marks.where(condition).select("a").distinct(), "a", "left_semi")


def beside_linked(marks: DataFrame, percent: int) -> DataFrame:
    """The members linked to a hub, and the strays that may be linked to one of them, no farther from the hub than that one and a link."""
    c = F.col
    reach = marks.where("linked").groupBy("a").agg((F.max("distance") + (100 - percent) / 100 + 1e-9).alias("reach"))
    met = marks.join(reach, "a").where(c("linked") | (c("apart_yet") & (c("distance") <= c("reach"))))
    return of_hubs(met, c("apart_yet"))


def differences(stars: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of hubs that a stray may be linked to, and one row for each difference that a link may be found by.

    In hundredths, with Q = 100 - percent: a member x differs from hub h in d(x)
    shingles, of which new(x) are its own and the others the hub's. x strays if
    100 d > Q (|h| + new). A link of sets A, B means (200 - Q) |A ^ B| <= Q (|A| + |B|),
    where |A ^ B| = d(a) + d(b) - 2 overlap. So B lacks at most Q |A| / 100 of
    A's new shingles and Q |A| / percent of all of A's differences. A member with more new
    shingles than any link leaves unmatched is found by those alone; only the others, deep
    ones, also show what they lack of the hub. A stray within twice the distance
    may also be linked to a member linked to the hub.
    """
    c, q = F.col, 100 - percent
    member = stars.select(
        c("a").alias("hub"), c("b").alias("node"), "apart", F.size("apart").cast("long").alias("d"),
        (c("size_b") - c("common")).alias("new"), c("size_a").alias("h"), c("size_b").alias("size"),
    )
    member = member.withColumn("lost", c("d") - c("new")).withColumn("stray", 100 * c("d") > q * (c("h") + c("new")))
    member = member.withColumn("near", 100 * c("d") <= 2 * q * (c("h") + c("new")))
    # Without a stray the hub implies every link, and members linked to the hub matter only to strays near enough.
    strays = member.where("stray").withColumn("deep", 100 * c("new") <= q * c("size"))
    met_by = strays.where("near").groupBy("hub").agg(F.max("deep").alias("deep"))
    listed = strays.unionByName(member.where("not stray").join(met_by, "hub"))
    shown = F.when(c("deep"), c("apart")).otherwise(F.slice("apart", (c("lost") + 1).cast("int"), c("new").cast("int")))
    element = listed.select("hub", "node", "stray", "near", "deep", "lost", F.posexplode(shown).alias("at", "element"))
    return listed.drop("apart"), element


def apart_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one hub that may be linked although not both are linked to the hub.

    In one order of a hub's differences, new shingles first and rarer ones before, the
    first common one of a pair follows only on what the partner lacks, so a prefix is posted. If the
    partner strays, also 200 overlap > 100 d(a) - Q new(a).
    """
    c, q = F.col, 100 - percent
    listed, element = differences(stars, percent)
    # Counted where they stand: one shuffle tells how many members, and how many strays, hold an element.
    alike = Window.partitionBy("hub", "element")
    counted = element.withColumn("c", F.count("*").over(alike)).withColumn("strays", F.count_if("stray").over(alike))
    met = F.when(~c("stray"), c("strays") > 0).otherwise((c("strays") > 1) | (c("near") & (c("c") > 1)))
    of_hub = c("deep") & (c("at") < c("lost"))
    shared = counted.where(met).groupBy("hub", "node").agg(
        F.sort_array(F.collect_list(F.struct(of_hub.alias("of_hub"), "c", "element"))).alias("held"),
        F.count_if(~of_hub).alias("held_new"),
    )
    overlap = F.floor((100 * c("d") - q * c("new")) / 200) + 1
    lacked = F.floor(q * c("size") / percent)
    lacked = F.when(c("stray") & c("near"), lacked).otherwise(F.least(lacked, c("d") - overlap)) - c("d")
    # What nobody else holds is lacked by every partner, so that the prefix of the others is shorter.
    prefix = F.size("held") + 1 + F.when(c("deep"), lacked).otherwise(F.floor(q * c("size") / 100) - c("new"))
    place = lambda e, j: F.struct(
        e["element"].alias("element"), F.get("held", j - 1)["element"].alias("before"),
        F.greatest(c("held_new") - j, F.lit(0)).alias("rest"),
        F.when(e["of_hub"], F.size("held") - j).otherwise(c("lost")).alias("rest_of_hub"),
    )
    posted = F.transform(F.slice("held", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")), place)
    listed = listed.join(shared, ["hub", "node"])
    listed = listed.select("hub", "node", "d", "new", "size", "stray", "near", F.inline(posted))
    one, two = listed.where("stray").alias("x"), listed.alias("y")
    least = lambda name: F.least(f"x.{name}", f"y.{name}")
    apart = c("x.d") + c("y.d") - 2 * (least("rest") + least("rest_of_hub"))
    wanted = F.when(c("y.stray"), c("x.node") < c("y.node")).otherwise(c("x.near"))
    met = one.join(two, (c("x.hub") == c("y.hub")) & (c("x.element") == c("y.element")) & wanted
                   & ~F.coalesce(c("x.before") == c("y.before"), F.lit(False))  # met there already
                   & (100 * (c("x.new") - least("rest")) <= q * c("x.size"))
                   & (100 * (c("y.new") - least("rest")) <= q * c("y.size"))
                   & ((200 - q) * apart <= q * (c("x.size") + c("y.size"))))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def grouped(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept) of every row.

    A set's node is its smallest id, or a hash of id and text where that id has
    several texts, which may be in several sets.
    """
    c = F.col
    least = least_agreement(percent)
    signed = saved(signatures(documents, n), "signatures")
    sets = signed.where((c("n_shingles") > 0) & c("doc_id").isNotNull())
    several = sets.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b")
    owned = sets.groupBy("hi", "lo", "n_shingles").agg(F.min(F.struct("doc_id", "t")).alias("owner"), F.first("sig").alias("sig"))
    marked = owned.join(several.select(c("doc_id").alias("shared")), c("owner.doc_id") == c("shared"), "left")
    node = F.when(c("shared").isNull(), c("owner.doc_id")).otherwise(F.xxhash64("owner.doc_id", "owner.t"))
    nodes = saved(marked.select("hi", "lo", "n_shingles", node.alias("node"), "owner", "sig"), "sets")
    sized = nodes.select("node", "sig", c("n_shingles").alias("size"))
    posted = saved(postings(coordinates(nodes.select("node", "sig"), least)), "postings")
    wanted = posted.select("node").distinct().join(nodes.select("node", "owner.*"), "node")
    texts = keyed(documents).join(wanted, ["doc_id", "t"])
    texts = saved(texts.groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")
    pairs, stars = candidates(posted, sized, least, percent)
    both = pairs.withColumn("star", F.lit(False)).unionByName(stars.withColumn("star", F.lit(True)))
    first = saved(confirmed(saved(both, "candidates"), texts, n), "confirmed")
    links = saved(linked(first, percent).select("a", "b"), "links")
    labels = components(links)
    marks = saved(star_marks(first.where("star"), labels, percent), "marks")
    # Where every stray is in its hub's class already, whatever else is linked is in that class too.
    if not marks.where("apart_yet").isEmpty():
        between = lambda pairs: parted(pairs, labels).where("apart_yet").select("a", "b", F.lit(False).alias("star"))
        beside = apart_pairs(first.where("star").join(beside_linked(marks, percent).select("a", "b"), ["a", "b"]), percent)
        strays = of_hubs(marks, c("apart_yet")).where(~c("linked")).select(c("b").alias("node")).distinct()
        tokens = saved(whole_sets(texts.join(strays, "node"), n, percent), "shingles")
        pairs, stars = candidates(saved(postings(tokens), "postings"), sized, least, percent)
        both = between(pairs.unionByName(beside).distinct()).unionByName(stars.withColumn("star", F.lit(True)))
        second = saved(confirmed(saved(both, "candidates"), texts, n), "confirmed")
        marks = star_marks(second.where("star"), labels, percent)
        searched = second.where("star").join(of_hubs(saved(marks, "marks"), c("apart_yet")).select("a", "b"), ["a", "b"])
        third = confirmed(saved(between(apart_pairs(searched, percent)), "candidates"), texts, n)
        more = linked(second, percent).unionByName(linked(third, percent)).select("a", "b")
        labels = components(saved(links.unionByName(more), "links"))
    named = labels.join(nodes.select("node", "owner"), "node")
    smallest = named.groupBy("label").agg(F.min("owner").alias("smallest"))
    labelled = named.select("node", "label").join(smallest, "label").select("node", "smallest")
    classes = nodes.select("hi", "lo", "n_shingles", "node", "owner")
    joined = signed.select("doc_id", "t", "n_shingles", "hi", "lo").join(classes, ["hi", "lo", "n_shingles"], "left")
    joined = joined.join(labelled, "node", "left")
    member = (c("n_shingles") > 0) & c("doc_id").isNotNull()
    own = F.struct("doc_id", "t")
    head = F.when(member, F.coalesce("smallest", "owner")).otherwise(own)
    return joined.select("doc_id", "t", "n_shingles", head["doc_id"].alias("component_id"), (head == own).alias("kept"))


def clusters(documents: DataFrame, n: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return grouped(documents, n, percent).drop("t")


def representatives(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that name their group; rows alike in id and text stay once."""
    t = unused("text_hash", documents)
    gone = grouped(documents, n, percent).where(~F.col("kept")).select("doc_id", F.col("t").alias(t)).distinct()
    rows = documents.withColumn(t, F.xxhash64("text")).join(gone, ["doc_id", t], "left_anti")
    named = rows.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", t])
    return named.unionByName(rows.where(F.col("doc_id").isNull())).select(*documents.columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for all documents."""
    return clusters(table(spark, sf_dir, "documents"))
