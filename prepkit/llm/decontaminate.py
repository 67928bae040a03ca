"""Operator 3: benchmark decontamination by a size-partitioned MinHash containment search.

Items are short, documents long, so what counts is containment: the share of an
item's shingles that a document holds.  Items are partitioned by their number n of
shingles, into classes of n from 2^k to 2^(k+1) - 1.  The sketch of an item is its ``n - ceil(t n) + 1`` smallest shingle hashes: a
document that holds at least t of the item cannot miss all of them, so the search
loses nothing.  Every partition has a bound, the largest hash of its sketches, and a least size;
the shingles of a document above the bounds of all partitions that it is large enough for
are dropped before anything is exploded, and a document too small for a partition is
never looked up in it.  Candidates are verified
by exact containment of the shingles as texts.

Only DataFrame functions.  Items of fewer than five words are looked up as one
shingle of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = (80, 100)      #: containment from 80 / 100
NO_ID = -2**63
#: sketches are broadcast up to so many hashes, candidates up to so many documents; beyond, both are shuffled
BROADCAST_ROWS = 500_000

#: words: letters, marks and digits, lower-cased
WORDS = r"filter(split(lower(coalesce(cast(text as string), '')), '[^\\p{L}\\p{M}\\p{N}]+'), w -> w <> '')"


def _grams(words: str, n: str, made_of: str) -> str:
    """Every run of n words, as texts; ``made_of`` names the array."""
    return f"transform(sequence(1, size({words}) - {n} + 1), i -> array_join(slice({made_of}, i, {n}), ' '))"


def _hashed(n: int) -> str:
    """Distinct 64-bit hashes of every run of n words, from the array ``wh`` of word hashes."""
    parts = ", ".join(f"wh[i + {j}]" for j in range(n))
    return f"transform(sequence(0, size(wh) - {n}), i -> xxhash64({parts}))"


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)),
            F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))


def _docs(docs: DataFrame) -> DataFrame:
    _id, _h = _key(docs)
    return docs.select(_id.alias("_id"), _h.alias("_h"), docs["text"].alias("text"))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, gram (words of a shingle), shingle, hash, n: distinct shingles of each item."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.expr(WORDS).alias("words")).where("size(words) > 0")
    words = words.withColumn("gram", F.least(F.size("words"), F.lit(SHINGLE)))
    rows = words.select("item_id", "gram", F.explode(F.array_distinct(F.expr(_grams("words", "gram", "words")))).alias("shingle"))
    rows = rows.groupBy("item_id", "gram", "shingle").agg(F.lit(1))   # rows that share an id are one item
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w))
    hashed = rows.select("item_id", "gram", "shingle", parts.alias("p"))
    # the hash of the document side: xxhash64 over the word hashes
    value = F.lit(None).cast("long")
    for g in range(1, SHINGLE + 1):
        value = F.when(F.col("gram") == g, F.xxhash64(*[F.col("p")[j] for j in range(g)])).otherwise(value)
    return hashed.select("item_id", "gram", "shingle", value.alias("hash")).join(sizes, "item_id")


def sketches(shingles: DataFrame) -> DataFrame:
    """item_id, gram, size_class, n, hash: the smallest hashes of each item that cannot all be missing."""
    num, den = THRESHOLD
    part = shingles.groupBy("item_id", "gram", "n").agg(F.sort_array(F.collect_set("hash")).alias("all"))
    least = F.expr(f"slice(all, 1, cast(n - ceil(n * {num} / {den}) + 1 as int))")
    return part.select("item_id", "gram", "n", F.floor(F.log2("n")).cast("int").alias("size_class"),
                       F.explode(least).alias("hash"))


def size_bounds(sketch: DataFrame) -> dict[int, list]:
    """gram -> (size_class, largest hash, least n, rows) of its partitions; at most some 30 for each gram."""
    out: dict[int, list] = {}
    for r in (sketch.groupBy("gram", "size_class").agg(F.max("hash").alias("top"), F.min("n").alias("least"),
                                                       F.count(F.lit(1)).alias("rows")).orderBy("gram", "size_class").collect()):
        out.setdefault(r["gram"], []).append((r["size_class"], r["top"], r["least"], r["rows"]))
    return out


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """_id, _h, item_id, n, shared of all pairs of a document and an item that it contains."""
    num, den = THRESHOLD
    shingles = item_shingles(items.where("item_id is not null")).checkpoint()
    sketch = sketches(shingles).checkpoint()
    bounds = size_bounds(sketch)
    found = None
    base = _docs(docs)
    if bounds:
        wide = base.withColumn("wh", F.expr(f"transform({WORDS}, w -> xxhash64(w))"))
    # one pass for each shingle length that occurs, five at most; nearly always one
    for gram, classes in bounds.items():
        # words of the smallest document that can match an item of a class
        keep = {size: -(-least * num // den) + gram - 1 for size, _, least, _ in classes}
        tops = "greatest(cast(null as bigint), cast(null as bigint), " + ", ".join(f"if(size(wh) >= {keep[size]}, {top}L, null)" for size, top, _, _ in classes) + ")"
        # explode_outer: for explode the optimizer adds a filter on the array and pushes it through the
        # projections, where the word hashes would be made anew for every element
        hashes = wide.select("_id", "_h", "wh", F.expr(tops).alias("top")).select("_id", "_h", F.size("wh").alias("words"), F.expr(
            f"if(top is not null, filter({_hashed(gram)}, x -> x <= top), null)").alias("hs"))
        hashes = hashes.select("_id", "_h", "words", F.explode_outer("hs").alias("hash")).where("hash is not null")
        least_words = F.create_map(*[F.lit(v) for pair in keep.items() for v in pair])
        looked = sketch.where(F.col("gram") == gram).select(
            "hash", "item_id", "n", least_words[F.col("size_class")].alias("least_words"))
        if sum(rows for _, _, _, rows in classes) <= BROADCAST_ROWS:
            looked = F.broadcast(looked)
        hits = (hashes.join(looked, "hash").where("words >= least_words")
                .where(F.expr(f"(words - {gram} + 1) * {den} >= n * {num}"))
                .select("_id", "_h", "item_id").distinct())
        found = hits if found is None else found.union(hits)
    if found is None:
        found = base.select("_id", "_h", F.lit(0).cast("long").alias("item_id")).limit(0)
    candidates = found.checkpoint()
    return _verified(base, candidates, shingles)


def _verified(base: DataFrame, candidates: DataFrame, shingles: DataFrame) -> DataFrame:
    """Exact containment of the items that a candidate document may hold."""
    num, den = THRESHOLD
    keys = candidates.select("_id", "_h").distinct()
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    words = base.join(keys, ["_id", "_h"], "left_semi").select("_id", "_h", F.expr(WORDS).alias("words"))
    grams = candidates.join(shingles.select("item_id", "gram").distinct(), "item_id").select("_id", "_h", "gram").distinct()
    held = words.join(grams, ["_id", "_h"]).where("size(words) >= gram").select(
        "_id", "_h", "gram", F.explode_outer(F.array_distinct(F.expr(_grams("words", "gram", "words")))).alias("shingle")).distinct()
    looked = shingles.select("item_id", "gram", "shingle", "n")
    if looked.count() <= BROADCAST_ROWS:
        looked = F.broadcast(looked)
    return (held.join(looked, ["gram", "shingle"]).groupBy("_id", "_h", "item_id", "n")
            .agg(F.count(F.lit(1)).alias("shared")).where(F.expr(f"shared * {den} >= n * {num}")))


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, n_shingles, n_shared long, containment double.

    One row per pair whose containment is 0.8 or more, over all items and all documents.
    Items of 1 to 4 words have one shingle, the whole of them; items without words, null
    texts and empty texts match nothing.  Items that share an item_id are one item, a null
    item_id is left out.  Documents that share a doc_id are judged each by itself and the
    best containment is returned; rows with a null doc_id are returned under a null id.
    Other columns are ignored.
    """
    shared = containment(docs, items)
    return (shared.groupBy("_id", "item_id").agg(F.max("shared").alias("n_shared"), F.first("n").alias("n_shingles"))
            .select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "item_id",
                    F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"),
                    (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, that contain no item; rows are judged by id and text."""
    bad = containment(docs, items).select("_id", "_h").distinct().checkpoint()
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[
        c.alias(n) for c, n in zip(_key(docs), ("_id", "_h"))])
    return keyed.join(bad, ["_id", "_h"], "left_anti").select("_row.*")


def oracle_sql() -> str:
    """DuckDB twin over documents and benchmark."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')"
    grams = "list_distinct(list_transform(range(1, len(w) - g + 2), lambda i: array_to_string(w[i:i + g - 1], ' ')))"
    return f"""
WITH iw AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, g, unnest({grams}) AS s FROM (SELECT item_id, w, least(len(w), {SHINGLE}) AS g FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
dw AS (SELECT doc_id, text, {words} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, text, g, unnest({grams}) AS s FROM dw, (SELECT DISTINCT g FROM i) WHERE len(w) >= g),
m AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i USING (g, s) GROUP BY doc_id, text, item_id)
SELECT doc_id, item_id, max(n) AS n_shingles, max(k) AS n_shared, max(k) / max(n) AS containment
FROM m JOIN n USING (item_id) WHERE k * 100 >= n * 80 GROUP BY doc_id, item_id"""
