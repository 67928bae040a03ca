"""Balancing / resampling.

All draws are hash-driven: rows are numbered inside their class by
``md5(row_id | seed)`` and draw ``j`` of class ``c`` picks row
``md5(c | j | seed) mod count_c``.  Results therefore do not depend on the
partition layout, survive task retries unchanged, and can be reproduced by a
SQL engine.  Class counts stay a table, whatever their number.  Draws are made
from it in chunks that are dealt over many tasks, and attached by an equi-join on
``(class, row number, salt)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import canonical_str, clean_value, hash_bigint, is_numeric
from ..functions.numbering import global_row_number, rank_within_group, small_side
from ..functions.selection import mark_first
from ..functions.stats import exact_quantiles, unpivot_values
from ..session import ensure_checkpoint_dir, shuffle_partitions

DRAW_CHUNK = 100_000      # draws that one task makes at a time
DRAWS_PER_ROW = 10_000    # draws of one row that may meet in one task
_TWO60 = float(1 << 60)


def _row_key(df: DataFrame, row_id: list[str] | None) -> list[str]:
    if row_id:
        return list(row_id)
    # no id given: every column (identical rows are interchangeable)
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]


def _order(df: DataFrame, row_id: list[str] | None, seed: int) -> list[Column]:
    """Deterministic row order: 60-bit hash of (row id, seed), then the id itself.

    With an explicit ``row_id`` the hash is md5-based (reproducible by SQL
    engines); without one every column is hashed with the JVM-side xxhash64,
    which is much cheaper than building the md5 text of the whole row.
    """
    keys = _row_key(df, row_id)
    if row_id:
        h = hash_bigint(*[F.col(k) for k in keys], F.lit(seed))
    else:
        h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)).bitwiseAND(F.lit((1 << 60) - 1))
    return [h, *[F.col(k) for k in keys]]


def _ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rank_within_group`` by an ``_order``; its hash is a column, so the sort does not make it anew for every comparison."""
    return rank_within_group(df.withColumn("_hash", order[0]), group, [F.col("_hash"), *order[1:]], name=name).drop("_hash")


def class_table(df: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, n)``, one per class; as many as there are classes, so it is never collected."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)


def _with_salts(needs: DataFrame) -> DataFrame:
    """Adds ``_salts``: over how many copies of its rows the draws of a class are spread."""
    return needs.withColumn("_salts", (F.lit(1) + F.expr(f"(k div n) div {DRAWS_PER_ROW}")).cast("int"))


def _draws(needs: DataFrame, key: str, seed: int) -> DataFrame:
    """Draws ``(key, _j, _pick, _salt)`` for the table ``needs(key, n, k, _salts)``: k draws among n rows.

    Draw ``j`` (1-based) of a class picks row number ``md5(class | j | seed) mod n + 1``.
    The draws of a class are made in chunks that are dealt over the cluster.
    """
    spark = needs.sparkSession
    total = needs.agg(F.sum("k")).first()[0] or 0
    parts = max(1, min(shuffle_partitions(spark), math.ceil(total / DRAW_CHUNK)))
    chunks = (needs.select(key, "n", "k", "_salts", F.explode(F.expr(f"sequence(0L, (k - 1) div {DRAW_CHUNK})")).alias("_b"))
              .repartition(parts))
    d = chunks.select(key, "n", "_salts", F.explode(F.expr(
        f"sequence(_b * {DRAW_CHUNK} + 1, least(k, (_b + 1) * {DRAW_CHUNK}))")).alias("_j"))
    pick = F.pmod(hash_bigint(F.col(key), F.col("_j"), F.lit(seed)), F.col("n")) + 1
    return d.select(key, "_j", pick.alias("_pick"), F.pmod(F.col("_j"), F.col("_salts")).cast("int").alias("_salt"))


def _drawn(numbered: DataFrame, needs: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows of ``numbered(key, _pick, ...)`` that the draws pick, once per draw.

    A class of few rows and very many draws has its rows repeated under salts, so its
    draws do not meet in one task."""
    needs = _with_salts(needs.where("k > 0").select(key, "n", "k")).checkpoint(eager=True)
    copies = numbered.join(small_side(needs.select(key, "_salts")), key).withColumn(
        "_salt", F.explode(F.expr("sequence(0, _salts - 1)"))).drop("_salts")
    return _draws(needs, key, seed).join(copies, [key, "_pick", "_salt"]).drop("_j", "_pick", "_salt")


def _top_up(df: DataFrame, key: str, seed: int, row_id: list[str] | None,
            target_count: int | None = None) -> DataFrame:
    """Every class of ``key`` (not NULL) topped up to ``target_count`` (default: the largest)."""
    counts = class_table(df, key)
    mx = target_count if target_count is not None else counts.agg(F.max("n")).first()[0]
    needs = counts.withColumn("k", F.lit(mx) - F.col("n")).where("k > 0")
    if mx is None or not needs.limit(1).count():
        return df
    src = df.join(small_side(needs.select(key)), key, "left_semi")
    numbered = _ranked(src, [key], _order(df, row_id, seed), "_pick")
    return df.unionByName(_drawn(numbered, needs, key, seed).select(*df.columns))


def random_oversample(df: DataFrame, t: str, seed: int = 42,
                      row_id: list[str] | None = None) -> DataFrame:
    """B1: drop NULL targets; top every class up to the majority count with replacement."""
    base = df.where(clean_value(df, t).isNotNull())
    return _top_up(base, t, seed, row_id)


def random_undersample(df: DataFrame, t: str, seed: int = 42,
                       row_id: list[str] | None = None) -> DataFrame:
    """B2: drop NULL targets; keep the ``min`` smallest-hash rows of every class.

    The hash at rank ``min`` of a class is its cut, so the rows are filtered and never sorted."""
    base = df.where(clean_value(df, t).isNotNull())
    marked = mark_first(base, [t], _order(base, row_id, seed), lambda sizes: str(sizes.agg(F.min("_size")).first()[0] or 0))
    return marked.where("_in").drop("_in")


def _normal(*parts: Column) -> Column:
    """Standard normal from two hash uniforms (Box-Muller); layout independent."""
    u1 = (hash_bigint(*parts, F.lit("u1")).cast("double") + 1.0) / F.lit(_TWO60 + 1.0)
    u2 = hash_bigint(*parts, F.lit("u2")).cast("double") / F.lit(_TWO60)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gaussian_noise(df: DataFrame, t: str, noise_level: float = 0.05, seed: int = 42,
                   row_id: list[str] | None = None) -> DataFrame:
    """Target + N(0, (level * population std)^2), hash-seeded per row.

    Without a row id the rows are numbered, so equal rows get noise of their own."""
    cols = df.columns
    sd = df.agg(F.stddev_pop(clean_value(df, t).cast("double"))).first()[0] or 0.0
    keys = list(row_id or [])
    if not keys:
        df, keys = global_row_number(df, _order(df, None, seed), name="_row"), ["_row"]
    z = _normal(*[F.col(k) for k in keys], F.lit(seed))
    return df.withColumn(t, clean_value(df, t).cast("double") + z * F.lit(noise_level * sd)).select(*cols)


def kde_resample(df: DataFrame, t: str, n_samples: int | None = None, seed: int = 42,
                 bandwidth: float = 0.2, row_id: list[str] | None = None,
                 joint: bool = False) -> DataFrame:
    """N new rows; target = drawn target + N(0, bandwidth^2); other columns
    drawn independently with replacement (``joint=True`` draws one row for all)."""
    spark = df.sparkSession
    numbered = global_row_number(df, _order(df, row_id, seed), name="_idx")
    n = numbered.agg(F.max("_idx")).first()[0] or 0
    if n == 0:
        return df
    m = n_samples or n
    parts = max(1, min(shuffle_partitions(spark), math.ceil(m / 100_000)))
    base = spark.range(0, m, numPartitions=parts).withColumnRenamed("id", "_i")

    def pick(tag: str) -> Column:
        return F.pmod(hash_bigint(F.col("_i"), F.lit(tag), F.lit(seed)), F.lit(n)) + 1

    if joint:
        out = base.withColumn("_idx", pick("row")).join(numbered, "_idx")
    else:
        # every (draw, column) asks for a row; one join answers all, one aggregation puts the draws together
        asks = base.select("_i", F.explode(F.array(*[
            F.struct(F.lit(j).alias("j"), pick(c).alias("_idx")) for j, c in enumerate(df.columns)])).alias("a")).select("_i", "a.j", "a._idx")
        answers = asks.join(numbered, "_idx").groupBy("_i")
        out = answers.agg(*[F.first(F.when(F.col("j") == j, F.struct(F.col(f"`{c}`").alias("v"))), True).alias(f"_v{j}")
                            for j, c in enumerate(df.columns)])
        out = out.select("_i", *[F.col(f"_v{j}.v").alias(c) for j, c in enumerate(df.columns)])
    z = _normal(F.col("_i"), F.lit(seed), F.lit("kde"))
    out = out.withColumn(t, F.col(t).cast("double") + z * F.lit(bandwidth))
    return out.select(*df.columns)


def quantile_bin_oversample(df: DataFrame, t: str, q: int = 10, seed: int = 42,
                            row_id: list[str] | None = None) -> DataFrame:
    """Quantile bins (right-closed, lowest included, duplicate edges dropped),
    NULL targets dropped, every bin topped up to the largest bin."""
    probs = [i / q for i in range(q + 1)]
    edges = exact_quantiles(unpivot_values(df, [t]), probs).get(t)
    if edges is None:
        return df.limit(0)
    uniq = sorted(set(edges))
    arr = F.array(*[F.lit(float(e)) for e in uniq])
    v = clean_value(df, t).cast("double")
    b = F.greatest(F.size(F.filter(arr, lambda e: e < v)) - 1, F.lit(0))
    binned = df.where(v.isNotNull()).withColumn("_bin", b)
    return _top_up(binned, "_bin", seed, row_id or [c for c in df.columns]).drop("_bin")


def tail_resample(df: DataFrame, t: str, tail_fraction: float = 0.05, seed: int = 42,
                  row_id: list[str] | None = None) -> DataFrame:
    """Rows at or beyond the tail quantiles, drawn with replacement until the
    added rows number ``n - tails``; all original rows kept."""
    q = exact_quantiles(unpivot_values(df, [t]), [tail_fraction, 1 - tail_fraction]).get(t)
    if q is None:
        return df
    lo, hi = q
    v = clean_value(df, t).cast("double")
    tails = df.where((v <= F.lit(lo)) | (v >= F.lit(hi))).withColumn("_one", F.lit(1))
    n, n_tails = df.count(), tails.count()
    need = n - n_tails
    if n_tails == 0 or need <= 0:
        return df
    keys = row_id or [c for c in df.columns]
    numbered = _ranked(tails, ["_one"], _order(tails.drop("_one"), keys, seed), "_pick")
    needs = df.sparkSession.createDataFrame([(1, n_tails, need)], "_one int, n bigint, k bigint")
    return df.unionByName(_drawn(numbered, needs, "_one", seed).select(*df.columns))


# Technique names of the balancing request, per target type.
TECHNIQUE_NAMES = {
    "categorical": ["random oversampling", "random undersampling", "smote", "smotenc", "adasyn",
                    "cluster-based oversampling"],
    "continuous": ["smoter", "gaussian noise injection", "kde-based resampling",
                   "quantile-based binning + oversampling", "tail-focused resampling"],
}
#: names of this library for the same techniques
OWN_NAMES = {
    "random_oversample": "random oversampling", "random_undersample": "random undersampling",
    "cluster_oversample": "cluster-based oversampling", "gaussian_noise": "gaussian noise injection",
    "kde_resample": "kde-based resampling", "quantile_bin_oversample": "quantile-based binning + oversampling",
    "tail_resample": "tail-focused resampling",
}


def technique_of(name: str) -> tuple[str, str]:
    """(target type, technique) of a technique name, in any case and with blanks, hyphens or underscores."""
    plain = lambda x: " ".join(x.lower().replace("_", " ").replace("-", " ").split())
    for kind, names in TECHNIQUE_NAMES.items():
        for n in names:
            if plain(name) == plain(n) or OWN_NAMES.get(name.strip().lower()) == n:
                return kind, n
    raise ValueError(f"Unknown balancing technique: {name}")


def balance(df: DataFrame, t: str, technique: str, seed: int = 42,
            row_id: list[str] | None = None, binary: bool = False) -> DataFrame:
    """Dispatch by technique name after a check against the type of the target.

    ``binary`` cleans the target first.  A categorical numeric target is bigint in the
    result, rounded half to even."""
    from . import neighbours as NB
    from .smoter import smoter
    from .target import clean_binary_target, flatten_target_cell, target_type
    if binary:
        df = clean_binary_target(flatten_target_cell(df, t), t)
    wanted, name = technique_of(technique)
    kind = target_type(df, t)
    if kind != wanted:
        raise ValueError(f"Unsupported {kind} technique: {technique}")
    build = {
        "random oversampling": lambda: random_oversample(df, t, seed, row_id),
        "random undersampling": lambda: random_undersample(df, t, seed, row_id),
        "smote": lambda: NB.smote(df, t, row_id, seed=seed),
        "smotenc": lambda: NB.smotenc(df, t, row_id, category_columns(df, t), seed=seed),
        "adasyn": lambda: NB.adasyn(df, t, row_id, seed=seed),
        "cluster-based oversampling": lambda: cluster_oversample(df, t, seed=seed, row_id=row_id),
        "smoter": lambda: smoter(df, t, row_id, seed=seed),
        "gaussian noise injection": lambda: gaussian_noise(df, t, seed=seed, row_id=row_id),
        "kde-based resampling": lambda: kde_resample(df, t, seed=seed, row_id=row_id),
        "quantile-based binning + oversampling": lambda: quantile_bin_oversample(df, t, seed=seed, row_id=row_id),
        "tail-focused resampling": lambda: tail_resample(df, t, seed=seed, row_id=row_id),
    }
    out = build[name]()
    if kind == "categorical" and is_numeric(df, t):
        out = out.withColumn(t, F.bround(F.col(t).cast("double")).cast("bigint"))
    return out


def balance_report(df: DataFrame, balanced: DataFrame, t: str) -> DataFrame:
    """The imbalance check before and after, one row each (``stage``)."""
    from .target import run_imbalance_analysis
    return (run_imbalance_analysis(df, t).withColumn("stage", F.lit("before"))
            .unionByName(run_imbalance_analysis(balanced, t).withColumn("stage", F.lit("after"))))


def category_columns(df: DataFrame, t: str) -> list[str]:
    """String columns other than the target."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name != t]


def cluster_oversample(df: DataFrame, t: str, n_clusters: int = 5, seed: int = 42,
                       row_id: list[str] | None = None) -> DataFrame:
    """Per non-majority class, k-means (k = min(5, n)) on one-hot features; draws with
    replacement in equal shares from every cluster found, at least as many as are missing;
    then exactly as many rows as the majority has, without replacement, from originals + draws.

    K-means runs with ``pyspark.ml`` (distributed Lloyd iterations) on sparse one-hot
    vectors, so a column may have any number of levels; draws and the final cut are
    hash-ranked, so they do not depend on the layout.  One model is fitted per minority class.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    from .transforms import Step, level_table

    spark = df.sparkSession
    base = df.where(clean_value(df, t).isNotNull())
    counts = class_table(base, t)
    mx = counts.agg(F.max("n")).first()[0]
    if mx is None:
        return base
    cats = [f.name for f in df.schema.fields
            if f.name != t and isinstance(f.dataType, (T.StringType, T.BooleanType))]
    nums = [c for c in df.columns if c != t and c not in cats and is_numeric(df, c)]
    encoded = base
    for i, c in enumerate(cats):
        codes = level_table(Step(c, "label_encoding", "label_encoding"), base)
        encoded = (encoded.withColumn("_key", F.coalesce(canonical_str(encoded, c), F.lit("")))
                   .join(codes.withColumnRenamed("_code", f"_code{i}"), "_key").drop("_key")
                   .withColumn(f"_code{i}", F.col(f"_code{i}").cast("double")))
    vectors = [f"_hot{i}" for i in range(len(cats))]
    if cats:
        encoded = OneHotEncoder(inputCols=[f"_code{i}" for i in range(len(cats))], outputCols=vectors,
                                dropLast=False).fit(encoded).transform(encoded)
    encoded = encoded.withColumns({f"_num{i}": F.coalesce(clean_value(df, c).cast("double"), F.lit(0.0))
                                   for i, c in enumerate(nums)})
    encoded = VectorAssembler(inputCols=[f"_num{i}" for i in range(len(nums))] + vectors,
                              outputCol="_features").transform(encoded).select(*df.columns, "_features")
    keys = _row_key(df, row_id)
    out = base.join(small_side(counts.where(F.col("n") == mx).select(t)), t, "left_semi")
    for row in counts.where(F.col("n") < mx).orderBy(t).toLocalIterator():
        part = encoded.where(F.col(t) == F.lit(row[t]))
        model = KMeans(k=min(n_clusters, row["n"]), seed=seed, featuresCol="_features",
                       predictionCol="_cluster").fit(part) if row["n"] > 1 else None
        labelled = (model.transform(part) if model else part.withColumn("_cluster", F.lit(0))).select(*df.columns, "_cluster")
        sizes = class_table(labelled, "_cluster")          # n_clusters rows at most
        found = sizes.count()
        needs = sizes.withColumn("k", F.lit(math.ceil((mx - row["n"]) / found)).cast("bigint"))
        numbered = _ranked(labelled, ["_cluster"], _order(df, keys, seed), "_pick")
        numbered = numbered.withColumn("_number", F.col("_pick"))
        extra = (_drawn(numbered, needs, "_cluster", seed)
                 .withColumn("_h", hash_bigint(F.lit("draw"), F.col("_cluster"), F.col("_number"),
                                               *[F.col(c) for c in keys], F.lit(seed)))
                 .select(*df.columns, "_h"))
        orig = labelled.withColumn("_h", hash_bigint(F.lit("orig"), *[F.col(c) for c in keys],
                                                     F.lit(seed))).select(*df.columns, "_h")
        pool = orig.unionByName(extra).withColumn("_one", F.lit(1))
        ranked = rank_within_group(pool, ["_one"], [F.col("_h"), *[F.col(c) for c in keys]], name="_r")
        out = out.unionByName(ranked.where(F.col("_r") <= mx).select(*df.columns))
    return out
