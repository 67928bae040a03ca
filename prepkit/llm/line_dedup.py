"""Operator 7: removal of repeated passages by content-defined chunks of lines.

Every line gets a hash; a rolling hash over two neighbouring line hashes chooses
chunk boundaries where it is the least of three in a row (so boundaries depend on
nearby lines only, and at least every third line ends a chunk), and lines of
``min_words / 4`` words or more are chunks of their own.  What is looked up globally are the
*runs* of up to five lines around a boundary: the lines before it with the next line,
and the line before it with the next ones; besides, single lines of more than
``min_words`` words.  A run ends at the boundaries of long lines, which are the same
wherever the line stands; other boundaries near the ends of a passage may depend on
what stands around it, so a run looks past them.  A passage of two lines or more, of
more than ``min_words`` words together, has a boundary inside that all its copies share,
and another one every three lines at most, so all its lines lie in runs that the copies
have in common.

Lines in runs that stand in more than one place (equal line hashes, provided that the bytes
behind them are equal) make the *regions* of a document.  A region may be glued together from
repeats of different origin, so it is cut into windows: from every line on, and up to every line,
the fewest lines that have more than ``min_words`` words.  A window that stands earlier (in the order
of doc_id and line) as a whole is removed.  Every line of a passage of so many words lies in such a
window inside the passage, so exactly the passages go that stand as one at one earlier place.

Only DataFrame functions; texts are shuffled once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

MIN_WORDS = 50       #: passages of more words are removed; words stand between space and \\t-\\r
PRIME = 2147483647
#: windows that stand in more than rows / COMMON_WINDOWS places (and LEAST_COMMON) are common: COMMON_WINDOWS at most
COMMON_WINDOWS = 20_000
LEAST_COMMON = 32
NO_ID = -2**63


def _lines(docs: DataFrame) -> DataFrame:
    """_id, _h (digest of the text), lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(text).alias("_h"), F.expr("split(coalesce(cast(text as string), ''), '\\n', -1)").alias("lines"))


#: documents with repeated lines are joined to the texts by a broadcast up to so many (and ten times
#: as many lines), by a shuffle beyond
BROADCAST_DOCS = 200_000


#: lines whose words are not their blanks plus one; no pattern, which would copy every line
ODD_BLANKS = "y = '' or startswith(y, ' ') or endswith(y, ' ') or " + " or ".join(
    f"contains(y, '{x}')" for x in ("  ", "\t", "\v", "\f", "\r"))


def _words(lines: str) -> str:
    """Words of each line: runs of anything but space and \\t-\\r.  Only lines with odd blanks are split."""
    split = r"size(filter(split(y, '[ \\t-\\r]+'), w -> w <> ''))"
    return (f"transform({lines}, y -> if({ODD_BLANKS}, {split}, "
            "octet_length(y) - octet_length(replace(y, ' ', '')) + 1))")


HASHES = "transform(lines, x -> cast(conv(substring(md5(x), 1, 15), 16, 10) as bigint))"


def _rolling(min_words: int) -> str:
    """Rolling hash over two line hashes; long lines are marked by -1.

    Of a passage of 2 to 4 lines and more than ``min_words`` words one line at least is long."""
    return f"""transform(hashes, (h, i) -> if(words[i] >= {min_words // 4 + 1}, -1L,
        (if(i > 0, hashes[i - 1] % {PRIME}, 0L) * 31 + h % {PRIME}) % {PRIME}))"""



def _least(i: str, others: list[str]) -> str:
    return " and ".join(f"(r[{i}] <= coalesce(get(r, {o}), {PRIME}L))" for o in others)


#: places i whose line ends a chunk: the last, before and after a long line, or the least of three in a row
BOUNDARIES = f"""filter(sequence(0, size(r) - 1), i -> i = size(r) - 1 or r[i] = -1 or r[i + 1] = -1
    or ({_least('i', ['i - 1', 'i - 2'])}) or ({_least('i', ['i - 1', 'i + 1'])}) or ({_least('i', ['i + 1', 'i + 2'])}))"""


def _hard(i: str) -> str:
    """Whether line i ends a chunk because it or the next line is long."""
    return f"(coalesce(get(r, {i}), 0) = -1 or coalesce(get(r, {i} + 1), 0) = -1)"


#: first and last line that a run at boundary b reaches
REACH = 3
FIRST = "greatest(0, b - {r}, {m})".format(r=REACH, m=", ".join(
    f"if({_hard(f'b - {d}')}, b - {d} + 1, 0)" for d in range(1, REACH + 1)))
LAST = "least(size(r) - 1, b + {r}, {m})".format(r=REACH, m=", ".join(
    f"if({_hard(f'b + {d}')}, b + {d}, size(r))" for d in range(1, REACH + 1)))
NONE = "cast(array() as array<struct<a: int, z: int>>)"


def _runs_at_boundaries(min_words: int) -> str:
    """[from, to] of the runs at every boundary; single lines are runs if they are long enough."""
    return f"""array_distinct(flatten(transform(ends, b -> concat(
        if(words[b] > {min_words}, array(struct(b as a, b as z)), {NONE}),
        if(b = size(hashes) - 1, {NONE}, concat(
            transform(sequence({FIRST}, b), j -> struct(j as a, b + 1 as z)),
            if({LAST} > b + 1, transform(sequence(b + 2, {LAST}), j -> struct(b as a, j as z)), {NONE})))))))"""


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _h, a, z, run: the line hashes a..z of every run that is looked up."""
    rows = (_lines(docs).where("size(lines) > 1 or length(lines[0]) > 0")
            .select("_id", "_h", F.expr(HASHES).alias("hashes"), F.expr(_words("lines")).alias("words")))
    rows = rows.select("_id", "_h", "hashes", "words", F.expr(_rolling(min_words)).alias("r"))
    rows = rows.select("_id", "_h", "hashes", "words", "r", F.expr(BOUNDARIES).alias("ends"))
    rows = rows.select("_id", "_h", F.explode(F.expr(
        f"transform({_runs_at_boundaries(min_words)}, x -> struct(x.a as a, x.z as z, slice(hashes, x.a + 1, x.z - x.a + 1) as run))")).alias("x"))
    return rows.select("_id", "_h", "x.a", "x.z", "x.run")


#: neighbouring or overlapping ranges of a sorted array made one
MERGED = """aggregate({ranges}, cast(array() as array<struct<a: int, z: int>>), (s, x) -> if(
    size(s) > 0 and x.a <= element_at(s, -1).z + {gap}, concat(slice(s, 1, size(s) - 1),
    array(struct(element_at(s, -1).a as a, greatest(element_at(s, -1).z, x.z) as z))), concat(s, array(struct(x.a as a, x.z as z)))))"""


def regions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _h, regions: of the documents that hold a repeated run, its lines as sorted [a, z].  Checkpointed."""
    all_runs = runs(docs, min_words)
    repeated = all_runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("run")
    found = all_runs.join(repeated, "run").groupBy("_id", "_h").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("spans"))
    return found.select("_id", "_h", F.expr(MERGED.format(ranges="spans", gap=1)).alias("regions")).checkpoint()


def passages(docs: DataFrame, marked: DataFrame, min_words: int) -> DataFrame:
    """_id, _h, ranges: the lines of windows that stand earlier as a whole, as sorted disjoint [a, z].  Checkpointed."""
    rows = (_texts(docs).join(marked, ["_id", "_h"]).select("_id", "_h", "regions", F.expr("split(text, '\\n', -1)").alias("lines"))
            .select("_id", "_h", "regions", F.expr(HASHES).alias("hashes"), F.expr(_words("lines")).alias("words"))
            .select("_id", "_h", F.explode(F.expr("flatten(transform(regions, (x, r) -> transform(sequence(x.a, x.z), "
                                                  "i -> struct(r as region, i as line, hashes[i] as hash, words[i] as words))))")).alias("x"))
            .select("_id", "_h", "x.*"))
    # rows of one id and text are one document
    rows = rows.repartition("_id", "_h").dropDuplicates(["_id", "_h", "line"])
    region = W.partitionBy("_id", "_h", "region")
    rows = rows.withColumn("upto", F.sum("words").over(region.orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    one = F.collect_list(F.struct("line", "hash", "words"))
    rows = rows.select("_id", "_h", one.over(region.orderBy("before").rangeBetween(0, min_words)).alias("on"),
                       one.over(region.orderBy("upto").rangeBetween(-min_words, 0)).alias("back"))
    rows = rows.select("_id", "_h", F.explode(F.array(F.sort_array("on"), F.sort_array("back"))).alias("w"))
    rows = rows.where(f"aggregate(w, 0, (s, x) -> s + x.words) > {min_words}").select(
        "_id", "_h", F.expr("w[0].line").alias("a"), F.expr("w[size(w) - 1].line").alias("z"),
        F.expr("struct(xxhash64(w.hash) as h, md5(cast(w.hash as string)) as m)").alias("window")).distinct().checkpoint()
    firsts = (rows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_h", "a")).alias("first"))
              .where("n > 1").select("window", "n", "first").checkpoint())
    # the rows of a very common window learn its place by a broadcast, so they do not meet in one task
    many = max(LEAST_COMMON, rows.count() // COMMON_WINDOWS)
    common, rare = F.broadcast(firsts.where(F.col("n") > many).drop("n")), firsts.where(F.col("n") <= many).drop("n")
    later = rows.join(common, "window").union(rows.join(common.select("window"), "window", "left_anti").join(rare, "window"))
    later = later.where(F.struct("_id", "_h", "a") != F.col("first"))
    return later.groupBy("_id", "_h").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("spans")).select(
        "_id", "_h", F.expr(MERGED.format(ranges="spans", gap=1)).alias("ranges")).checkpoint()


def _texts(docs: DataFrame) -> DataFrame:
    """_row (all columns), text, _id, _h."""
    text = docs["text"].cast("string")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("text"),
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"))


def _clashes(docs: DataFrame, marked: DataFrame) -> list[str]:
    """Line hashes behind which different bytes stand, among all lines of regions.

    The lines are compared byte by byte; equal ones are merged before the shuffle.  Hashes
    have 60 bits, so the answer is next to always empty."""
    lines = (_texts(docs).join(marked, ["_id", "_h"]).select(F.expr("split(text, '\\n', -1)").alias("lines"), "regions")
             .select(F.explode(F.expr("flatten(transform(regions, x -> slice(lines, x.a + 1, x.z - x.a + 1)))")).alias("line")))
    return (lines.groupBy(F.expr("substring(md5(line), 1, 15)").alias("hash"))
            .agg(F.min("line").alias("one"), F.max("line").alias("other")).where("one <> other")
            .agg(F.collect_set("hash")).first()[0])


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_row (all columns of a document), n_lines, n_removed, words_removed, text (what is left)."""
    marked = regions(docs, min_words)
    n, numbers = marked.agg(F.count(F.lit(1)), F.sum(F.expr("aggregate(regions, 0, (s, x) -> s + x.z - x.a + 1)"))).first()
    small = n <= BROADCAST_DOCS and (numbers or 0) <= 10 * BROADCAST_DOCS
    hint = F.broadcast if small else (lambda d: d)
    clashes = _clashes(docs, hint(marked))
    ranges = passages(docs, hint(marked), min_words)
    rows = _texts(docs).join(hint(ranges), ["_id", "_h"], "left").withColumn("lines", F.expr("split(text, '\\n', -1)"))
    inside = _words("slice(lines, x.a + 1, x.z - x.a + 1)")
    rows = rows.withColumn("ranges", F.expr(f"transform(ranges, x -> struct(x.a as a, x.z as z, aggregate({inside}, 0, (s, w) -> s + w) as w))"))
    if clashes:
        # a passage goes if all its bytes are those of the earlier one
        rows = rows.withColumn("bad", F.array(*[F.lit(x) for x in clashes])).withColumn("ranges", F.expr(
            "filter(ranges, x -> not exists(slice(lines, x.a + 1, x.z - x.a + 1), "
            "y -> array_contains(bad, substring(md5(y), 1, 15))))"))
    gone = "exists(ranges, x -> i between x.a and x.z)"
    return rows.select(
        "_row", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.expr("cast(coalesce(aggregate(ranges, 0, (s, x) -> s + x.z - x.a + 1), 0) as long)").alias("n_removed"),
        F.expr("cast(coalesce(aggregate(ranges, 0, (s, x) -> s + x.w), 0) as long)").alias("words_removed"),
        F.when(F.size("ranges") > 0, F.expr(f"array_join(filter(lines, (y, i) -> not {gone}), '\n')"))
        .otherwise(F.col("text")).alias("text"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_lines, n_removed, words_removed long, text string.

    One row per input row; ``text`` is what is left, its lines joined by \\n.  What goes are passages of
    whole lines and more than ``min_words`` words that stand as one passage at one earlier place.  Of equal
    passages the one with the least doc_id and line stays; null doc_ids come first.  Null
    texts stay null and have no lines; empty texts have one empty line.  Rows with equal
    doc_id and text are one document to the operator, so they lose the same lines.
    Other columns are ignored.
    """
    return cleaned(docs, min_words).select(F.col("_row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed",
                                "words_removed", "text")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, repeated passages cut out of ``text`` (and ``n_chars``
    counted anew); a document that loses all its words goes."""
    rows = cleaned(docs, min_words)
    left = (F.col("n_removed") == 0) | (F.col("text").rlike(r"[^ \t-\r]"))
    text = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("_row.n_chars"))
    return rows.where(left).select(*[text[c].alias(c) if c in text else F.col("_row").getField(c).alias(c) for c in docs.columns])
