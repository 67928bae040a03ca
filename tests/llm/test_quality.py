import re
import zlib
from collections import Counter

import numpy as np

from prepkit.llm import docstats as S
from prepkit.llm import gam, rule_forest

SF01 = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics(spark, odd):
    for df in (spark.read.parquet(f"{SF01}/documents.parquet"), odd):
        labels = spark.read.parquet(f"{SF01}/labels.parquet")
        got = rule_forest.quality_rules(df, labels).collect()
        want = Counter((r.doc_id, *brute(r.text)) for r in df.collect())
        assert Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_rules_keep_good_and_reject_bad(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = rule_forest.quality_rules(spark.read.parquet(f"{SF01}/documents.parquet"), labels).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.2


def test_rules_without_labels(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rule_forest.quality_rules(odd, none).collect()
    assert len(got) == odd.count()
    assert all(r.kept != r.base_failed and r.anomaly == 0 for r in got)
    assert rule_forest.quality_rules(empty, none).collect() == []


def test_forest_finds_what_is_far_off():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 3)), rng.normal(12, 1, (20, 3))])
    score = rule_forest.grow(x).score(x)
    assert score[2000:].min() > np.quantile(score[:2000], 0.99)


def test_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = gam.quality_scores(spark.read.parquet(f"{SF01}/documents.parquet"), labels)
    rows = got.collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, r.quality) for r in got.where("held_out").join(labels, "doc_id").collect()]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = ({r.doc_id: r.score for r in gam.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_classifier_on_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 1), (7, 0), (None, 1), (8, None), (4, 1), (10, 0)],
                                   "doc_id long, quality int")
    assert gam.quality_scores(odd, labels).count() == odd.count()
    assert gam.quality_scores(empty, labels).collect() == []
    none = labels.where("false")
    assert {r.score for r in gam.quality_scores(odd, none).collect()} == {0.5}
    kept = gam.without_low_quality(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9
    assert S.ratios({f: np.zeros(2) for f in S.FIELDS}).shape == (2, len(S.RATIOS))


def test_forest_judges_every_statistic():
    """A text that is far off in one statistic only is odder than all good texts, whichever it is."""
    rng = np.random.default_rng(5)
    n = 3000
    words = rng.integers(100, 400, n)
    c = {"n_words": words, "word_chars": words * 5 + rng.integers(-30, 30, n), "n_symbols": np.zeros(n, int),
         "n_dup_lines": np.zeros(n, int), "n_repeat_words": np.zeros(n, int), "n_lines": words // 20,
         "n_distinct_words": words * 4 // 5, "n_equal_next": words // 200, "n_pipes": np.zeros(n, int),
         "n_digits": rng.integers(0, 20, n), "n_upper": words // 12, "n_stops": words // 7, "max_word": rng.integers(9, 20, n)}
    forest = rule_forest.fit(c, np.ones(n, int))
    plain = {"n_words": 200, "word_chars": 1000, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 10,
             "n_distinct_words": 160, "n_equal_next": 1, "n_pipes": 0, "n_digits": 10, "n_upper": 16, "n_stops": 28, "max_word": 14}
    off = [{}, {"n_dup_lines": 8}, {"n_repeat_words": 50}, {"n_digits": 950}, {"n_upper": 200}, {"max_word": 900},
           {"n_symbols": 150}, {"word_chars": 3000}, {"n_words": 40_000, "word_chars": 200_000, "n_lines": 2000,
           "n_distinct_words": 32_000, "n_equal_next": 200, "n_digits": 2000, "n_upper": 3300, "n_stops": 5700}]
    rows = [plain | x for x in off]
    columns = {f: np.array([r[f] for r in rows]) for f in S.FIELDS}
    assert not rule_forest.base_failed(columns).any()
    odd_ = forest.score(S.ratios(columns)) > forest.threshold
    assert odd_.tolist() == [False] + [True] * 8


def test_threshold_covers_all_good_rows(spark):
    """With a forest of few rows the good rows lost are still bounded over all of them."""
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = rule_forest.quality_rules(docs, labels, sample_rows=40).join(labels.where("quality = 1"), "doc_id").where("not base_failed").collect()
    scores = sorted(r.anomaly for r in rows)
    allowed = int(len(scores) * rule_forest.GOOD_LOSS)
    assert sum(not r.kept for r in rows) == allowed
    assert len(rows) > 300 and all(r.kept == (r.anomaly <= scores[len(scores) - 1 - allowed]) for r in rows)
