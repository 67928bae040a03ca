"""Operator 8: n-gram Jaccard join as a blocked sparse product of the document by n-gram matrix.

Rows of the matrix are *classes* (documents with equal shingle sets count once),
columns are shingles.  The product is never formed whole:

1.  Size-derived bounds choose the columns that have to be multiplied.  A pair
    with Jaccard >= t has an overlap of at least ``t * max(|x|, |y|)``.  Of each class
    the last ``left_out(n)`` columns in hash order are not emitted; as that number
    never falls with n, a pair still shares ``ceil(t n) - left_out(n)`` of the columns
    emitted, for both its sizes n.  A column that stands in one class is dropped, and
    so is a class with fewer columns left than that.  Of the rest, ordered from
    rare to frequent, all but the last ``ceil(t n) - left_out(n) - 1`` suffice.
2.  Classes that share a block of equal columns, directly or through others, make a
    cluster; links never leave it.  The sets of a cluster are made anew from the
    texts and multiplied in one task: overlap counts of a row with all rows of
    fitting size at once, pairs below the bound discarded.  Rows that links have
    already brought together are left out, so a cluster of near copies costs little
    more than one row times the others, and what leaves the task are the links of a
    spanning forest, never all pairs.
3.  A cluster beyond ``ROWS`` sets or ``WEIGHT`` shingles is cut into parts by size, and
    pairs of parts are multiplied; their links are joined to components afterwards.  In a
    cluster beyond ``STAR_FROM`` times that, every class is checked first against the
    middle of the star it shares most blocks with, and the links are contracted; parts
    that lie in one component are not paired.

The check of a pair is exact on the sets of 64-bit shingle hashes.  Columns held
by many classes of one task are salted before the shuffle: from ``HOT`` classes
on, only the fact that they are frequent matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepkit.llm import textcols as T
from prepkit.llm.components import components

SHINGLE = 5
NUM, DEN = 80, 100     #: link when DEN * overlap >= NUM * union
WHOLE = 64             #: sets up to this size emit all their columns
HOT = 256              #: a column of so many classes counts as frequent, however many it has
SALTS = 97
STAR = 512             #: partners that one task compares with the middle of a star
ROWS = 512             #: sets that are multiplied in one task (two parts: twice as many)
WEIGHT = 1 << 18       #: their shingles together
STAR_FROM = 64         #: times these, stars are tried before parts are paired
#: classes to be checked are found by a broadcast join up to so many (40 bytes each), by a shuffled one beyond
BROADCAST_CLASSES = 500_000
NO_ID = -2**63


def left_out(n):
    """Columns of a set of n that are not emitted: it never falls with n and stays below ceil(0.8 n)."""
    return np.maximum(0, n - WHOLE) * 13 // 20


LEFT_OUT = f"cast(greatest(0, n - {WHOLE}) * 13 div 20 as int)"
#: columns that a set of n shares with any partner among those emitted
COMMON = f"cast(ceil(n * {NUM} / {DEN}) as int) - {LEFT_OUT}"


def class_of(s: np.ndarray) -> int:
    """64-bit digest of a shingle set (sorted uint64); 0 stands for the empty set."""
    if not len(s):
        return 0
    h = T.mix((T.mix(s) * T.PLACE_KEY[60]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(h.view(np.int64)[0]) or 1


def _sets(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        data, offs = T.buffers(batch.column(text))
        for lo, hi in T.doc_groups(offs):
            yield batch, lo, T.shingle_sets(T.words_of(data, offs[lo:hi + 1], T.WHITE, True), SHINGLE)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, sets in _sets(batches, 2):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(lo, len(sets)), batch.column(1).slice(lo, len(sets)),
             pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())],
            ["_id", "_h", "n", "cls"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(col, salt, cls, n): the columns of each class's prefix; a class once a task."""
    seen: set[int] = set()
    load = np.zeros(1 << 20, np.int32)
    exact: dict[int, int] = {}
    for _, _, sets in _sets(batches, 0):
        cols, classes, sizes = [], [], []
        for s in sets:
            if len(s) and (c := class_of(s)) not in seen:
                seen.add(c)
                p = len(s) - int(left_out(len(s)))
                cols.append(s[:p])
                classes.append(np.full(p, c, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
        if not cols:
            continue
        col, cls = np.concatenate(cols), np.concatenate(classes)
        salt = np.zeros(len(col), np.int32)
        bucket = (col >> np.uint64(44)).astype(np.int64)
        np.add.at(load, bucket, 1)
        for i in np.flatnonzero(load[bucket] >= HOT):
            key = int(col[i])
            exact[key] = seen_here = exact.get(key, 0) + 1
            if seen_here > HOT:      # HOT rows went out unsalted, so the column is known to be frequent
                salt[i] = 1 + int(cls[i]) % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(col.view(np.int64)), pa.array(salt), pa.array(cls), pa.array(np.concatenate(sizes))],
            ["col", "salt", "cls", "n"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, salt, side, cls, members) in this order, the pivot's own set first -> (a, b) that link."""
    at, pivot = None, None
    for batch in batches:
        a, b = [], []
        keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for (head, salt, side, cls), raw in zip(keys, batch.column(4)):
            members = np.frombuffer(raw.as_buffer(), np.uint64)
            if side == 0:
                at, pivot = (head, salt), members.copy()
            elif at == (head, salt):
                x, y = (pivot, members) if len(pivot) <= len(members) else (members, pivot)
                place = np.searchsorted(y, x)
                both = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                if DEN * both >= NUM * (len(x) + len(y) - both):
                    a.append(head)
                    b.append(cls)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def spanning_links(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of different labels that join all that is linked; with two sides, only across."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    n = np.array([len(sets[i]) for i in order], np.int64)
    labels, sides, cross = labels[order], sides[order], bool(sides.any())
    starts = np.concatenate(([0], np.cumsum(n)))
    _, col = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(int(col.max()) + 1, np.int32)
    fits = np.searchsorted(n, n * DEN // NUM, "right")        # rows that are not too large
    out = []
    for i in range(len(n) - 1):
        end = fits[i]
        open_ = labels[i + 1:end] != labels[i]
        if cross:
            open_ &= sides[i + 1:end] != sides[i]
        rows = np.flatnonzero(open_) + i + 1
        if not len(rows):
            continue
        mark[col[starts[i]:starts[i + 1]]] = 1
        if len(rows) * 4 < end - i:
            both = np.array([mark[col[starts[j]:starts[j + 1]]].sum() for j in rows])
        else:
            both = np.add.reduceat(mark[col[starts[i + 1]:starts[end]]], starts[i + 1:end] - starts[i + 1])[rows - i - 1]
        mark[col[starts[i]:starts[i + 1]]] = 0
        for j in rows[DEN * both >= NUM * (n[i] + n[rows] - both)]:
            if labels[j] != labels[i]:
                out.append((int(order[i]), int(order[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, whole, side, cls, label, members) sorted by place -> (whole, a, b).

    Of a place that is a whole cluster, (class, component) of all that link with another
    class; of a pair of parts the links between classes."""
    place, rows = None, []

    def found() -> pa.RecordBatch:
        whole, side, cls, label, members = zip(*{r[2]: r for r in rows}.values())
        sets = [np.frombuffer(m, np.uint64) for m in members]
        links = spanning_links(sets, np.array(label, np.int64), np.array(side)) if len(sets) > 1 else []
        pairs = [(cls[i], cls[j]) for i, j in links]
        if whole[0]:
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            for x, y in pairs:
                x, y = sorted((top(x), top(y)))
                up[y] = up[x] = x
            pairs = [(x, top(x)) for x in up]
        return pa.RecordBatch.from_arrays(
            [pa.array([bool(whole[0])] * len(pairs), pa.bool_()), pa.array([x for x, _ in pairs], pa.int64()),
             pa.array([y for _, y in pairs], pa.int64())], ["whole", "a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(5)))
        for (here, whole, side, cls, label), raw in zip(keys, batch.column(5)):
            if here != place:
                if rows:
                    yield found()
                place, rows = here, []
            rows.append((whole, side, cls, label, raw.as_buffer().to_pybytes()))
    if rows:
        yield found()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, sets in _sets(batches, 0):
        yield pa.RecordBatch.from_arrays(
            [pa.array([class_of(s) for s in sets], pa.int64()),
             pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "members"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.col("text").cast("string").alias("_text"))


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, checkpointed.

    The sets are made anew from the texts and moved once: every b to the place of its a.
    An a with many partners has several places."""
    pairs = pairs.select("a", "b").checkpoint()
    places = pairs.groupBy("a").agg((1 + F.floor(F.count(F.lit(1)) / STAR)).cast("int").alias("places"))
    moves = pairs.join(places, "a").select(
        F.col("b").alias("cls"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), "places").cast("int").alias("salt"),
        F.lit(1).alias("side"))
    moves = moves.union(places.select("a", "a", F.explode(F.expr("sequence(0, places - 1)")), F.lit(0)))
    moves = moves.join(classes.select("cls", F.col("least_id").alias("_id")), "cls").checkpoint()
    ids, asked = moves.select("_id").distinct(), moves.select("cls", "pivot", "salt", "side")
    if moves.count() <= BROADCAST_CLASSES:
        ids, asked = F.broadcast(ids), F.broadcast(asked)
    sets = (_texts(docs).join(ids, "_id", "left_semi").select("_text")
            .mapInArrow(_set_rows, "cls long, members binary"))
    return (sets.join(asked, "cls").select("pivot", "salt", "side", "cls", "members")
            .repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "side")
            .mapInArrow(_overlap, "a long, b long").distinct().checkpoint())


def _size_ok(n: str, m: str) -> Column:
    return F.expr(f"least({n}, {m}) * {DEN} >= greatest({n}, {m}) * {NUM}")


def blocks(docs: DataFrame) -> DataFrame:
    """(col, cls, n): the columns whose blocks have to be multiplied, checkpointed.

    The rarity of a column (rows that name it, HOT at most) is the same for all
    its rows, so ordering by it keeps the bound on common columns."""
    column = W.partitionBy("col", "salt")
    rows = (docs.select(F.col("text").cast("string").alias("_text"))
            .mapInArrow(_prefixes, "col long, salt int, cls long, n int")
            .withColumn("df", F.expr(f"least(count(1) over (partition by col, salt), {HOT})"))
            .withColumn("shared", F.min("cls").over(column) < F.max("cls").over(column))
            .where("salt > 0 or shared")
            .withColumn("df", F.when(F.col("salt") > 0, HOT).otherwise(F.col("df"))))
    whole = W.partitionBy("cls")
    rows = (rows.dropDuplicates(["cls", "col"])
            .withColumn("left", F.count(F.lit(1)).over(whole))
            .withColumn("at", F.row_number().over(whole.orderBy("df", "col"))))
    return rows.where(F.expr(f"at <= left - ({COMMON}) + 1")).select("col", "cls", "n").checkpoint()


def _band(n: str) -> Column:
    """Sizes that a link may join lie in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(1.26)))


def _star_links(docs: DataFrame, classes: DataFrame, block: DataFrame) -> DataFrame:
    """Links (a, b) of every class with the middle of the star that it shares most blocks with."""
    banded = block.select("col", "cls", "n", _band("n").alias("band"))
    middle = banded.groupBy("col", "band").agg(F.min(F.struct("cls", "n")).alias("p"))
    middles = middle.select("col", F.explode(F.array("band", F.col("band") + 1)).alias("band"),
                            F.col("p.cls").alias("a"), F.col("p.n").alias("m"))
    star = (banded.join(middles, ["col", "band"]).where("a <> cls").where(_size_ok("n", "m"))
            .groupBy("a", F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("common")))
    best = star.groupBy("b").agg(F.max_by("a", F.struct("common", "a")).alias("a"))
    return _linked(docs, classes, best)


def _places_of_parts(members: DataFrame, known: DataFrame) -> DataFrame:
    """place, side, cls, label: large clusters cut into parts, each pair of parts a place.

    members: (cls, cluster, n); known: (node, component) of the links found so far."""
    rows = (members.join(known.select(F.col("node").alias("cls"), F.col("component").alias("c")), "cls", "left")
            .select("cls", "cluster", "n", F.coalesce("c", "cls").alias("label"), _band("n").alias("band")))
    large = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= ROWS)
    # classes of one large component stand in parts of their own
    rows = rows.join(large.select("cluster", "label", F.col("label").alias("own")), ["cluster", "label"], "left")
    rows = rows.withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    parts = rows.groupBy("cluster", "own", "band").agg(
        F.greatest(F.floor(F.count(F.lit(1)) / ROWS), F.floor(F.sum("n") / WEIGHT)).cast("int").alias("more"))
    rows = rows.join(parts, ["cluster", "own", "band"]).withColumn(
        "part", F.struct("own", "band", F.pmod(F.xxhash64("cls"), F.col("more") + 1).cast("int").alias("salt")))
    each = parts.select("cluster", "own", "band", F.explode(F.expr("sequence(0, more)")).alias("salt")).select(
        "cluster", "band", F.struct("own", "band", "salt").alias("part"))
    first = each.select("cluster", F.col("part").alias("p"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    pairs = first.join(each.withColumnRenamed("part", "q"), ["cluster", "band"]).where("p <= q or p.band < q.band").where(
        "p.own <> q.own or p.own = 0")
    pairs = pairs.select("cluster", "p", "q", F.xxhash64("cluster", "p", "q").alias("place"))
    sides = pairs.select("cluster", "place", F.col("p").alias("part"), F.lit(0).alias("side")).union(
        pairs.where("p <> q").select("cluster", "place", "q", F.lit(1)))
    return rows.join(sides, ["cluster", "part"]).select("place", "side", "cls", "label")


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that link with another one.

    classes: (cls, n, least_id), a row a class."""
    block = blocks(docs)
    least = block.groupBy("col").agg(F.min("cls").alias("a"))
    clusters = components(block.join(least, "col").where("a <> cls").select("a", F.col("cls").alias("b")))
    members = clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster")).join(
        classes.select("cls", F.col("n").cast("long").alias("n"), F.col("least_id").alias("_id")), "cls").checkpoint()
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    large = (size.where((F.col("rows") > ROWS) | (F.col("weight") > WEIGHT))
             .withColumn("huge", (F.col("rows") > STAR_FROM * ROWS) | (F.col("weight") > STAR_FROM * WEIGHT))
             .select("cluster", "huge").checkpoint())
    n_large, n_huge = large.agg(F.count(F.lit(1)), F.count_if("huge")).first()
    small = members.join(large, "cluster", "left_anti") if n_large else members
    moves = small.select(F.col("cluster").alias("place"), F.lit(True).alias("whole"), F.lit(0).alias("side"), "cls",
                         F.col("cls").alias("label"), "_id")
    first = None
    if n_large:
        split = members.join(large, "cluster").checkpoint()
        known = docs.sparkSession.createDataFrame([], "node long, component long")
        if n_huge:
            first = _star_links(docs, classes, block.join(split.where("huge").select("cls"), "cls", "left_semi"))
            known = components(first)
        parts = _places_of_parts(split.select("cls", "cluster", "n"), known)
        moves = moves.union(parts.join(split.select("cls", "_id"), "cls").select(
            "place", F.lit(False).alias("whole"), "side", "cls", "label", "_id"))
    moves = moves.checkpoint()
    ids, asked = moves.select("_id").distinct(), moves.drop("_id")
    if moves.count() <= BROADCAST_CLASSES:
        ids, asked = F.broadcast(ids), F.broadcast(asked)
    sets = (_texts(docs).join(ids, "_id", "left_semi").select("_text")
            .mapInArrow(_set_rows, "cls long, members binary"))
    out = (sets.join(asked, "cls").select("place", "whole", "side", "cls", "label", "members")
           .repartition("place").sortWithinPartitions("place").mapInArrow(_products, "whole boolean, a long, b long")
           .checkpoint())
    done = out.where("whole").select(F.col("a").alias("node"), F.col("b").alias("component"))
    if not n_large:
        return done
    links = out.where("not whole").select("a", "b")
    return done.union(components(links if first is None else links.union(first)))


def grouped(docs: DataFrame) -> DataFrame:
    """_id, _h (id and digest of a document), n, component (least id of its group), head (least _id, _h of it).

    One row per input row; documents without shingles are their own group."""
    text = docs["text"].cast("string")
    rows = (docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"),
                        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"), text.alias("text"))
            .mapInArrow(_classes, "_id long, _h long, n long, cls long").checkpoint())
    classes = rows.where("n > 0").groupBy("cls").agg(
        F.first("n").alias("n"), F.min(F.nullif("_id", F.lit(NO_ID))).alias("least"),
        F.min(F.struct("_id", "_h")).alias("head")).withColumn("least_id", F.col("head._id")).checkpoint()
    linked = link_classes(docs, classes)
    named = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "least", "head", F.coalesce("component", "cls").alias("comp")).checkpoint()
    groups = named.groupBy("comp").agg(F.min("least").alias("component"), F.min("head").alias("head"))
    ids = named.select("cls", "comp").join(groups, "comp").select("cls", "component", "head")
    own = F.col("n") == 0
    return rows.join(ids, "cls", "left").select(
        "_id", "_h", "n", F.when(own, F.nullif("_id", F.lit(NO_ID))).otherwise(F.col("component")).alias("component"),
        F.when(own, F.struct("_id", "_h")).otherwise(F.col("head")).alias("head"))


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles long, component_id long, one row per input row.

    Words are runs of anything but space and \\t-\\r, with A-Z lower-cased; a text
    with 1 to 4 words has its whole sequence as one shingle.  Two documents link
    when 100 * overlap >= 80 * union.  ``component_id`` is the least doc_id
    reachable by links.  Null or empty texts have no shingles and no links, so
    ``component_id`` is their own doc_id.  Rows with a null doc_id take part and
    keep the null id; a component of such rows alone has a null id.  Repeated
    rows each give a row.  Other columns are ignored.
    """
    return grouped(docs).select(F.nullif("_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
                                F.col("component").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each group: the one with the least id (null
    ids first).  Documents without words stay; repeated rows of one id and text stay once."""
    groups = grouped(docs).where("n > 0").checkpoint()
    key = F.struct("_id", "_h")
    extra = groups.where(F.col("head") != key).select("_id", "_h").distinct().checkpoint()
    again = groups.where(F.col("head") == key).groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = again.select("_id", "_h").checkpoint()
    text = docs["text"].cast("string")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
                        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"),
                        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"))
    n_extra, n_again = extra.count(), again.count()
    if n_extra <= BROADCAST_CLASSES:
        extra = F.broadcast(extra)
    kept = keyed.join(extra, ["_id", "_h"], "left_anti")
    if n_again:
        twice = F.broadcast(again) if n_again <= BROADCAST_CLASSES else again
        kept = kept.join(twice, ["_id", "_h"], "left_anti").unionByName(
            keyed.join(twice, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]))
    return kept.select("_row.*")
