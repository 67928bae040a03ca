import collections
import random
import re

import pytest

from prepkit.llm import ngram_join as J
from prepkit.llm.components import components


def brute(rows):
    """(doc_id, number of shingles, component) by comparing every pair that shares a shingle."""
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = collections.Counter((b, a) for at in where.values() for a in at for b in at if b < a)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r) for r in J.ngram_jaccard_join(df).collect()), key=str)


def families(seed):
    """Groups of near copies of all sizes, some behind a passage that many share."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(250)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    rows = []
    for g in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 8, 20, 60, 200]))]
        for _ in range(25 if g < 5 else rnd.choice([1, 1, 2, 3])):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(t) // 30])):
                if len(t) > 4:
                    t[rnd.randrange(len(t))] = rnd.choice(words)
            text = " ".join(t)
            rows.append((len(rows), passage + "\n" + text if rnd.random() < 0.4 else text))
    return rows


def test_against_brute_force(spark):
    rows = families(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute(rows)


def test_many_holders_of_a_column(spark, monkeypatch):
    """With a low limit the columns of the families are salted; nothing may change."""
    monkeypatch.setattr(J, "HOT", 4)
    rows = families(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(df) == brute(rows)


@pytest.mark.parametrize("star_from", [1, 64])
def test_large_clusters_in_parts(spark, monkeypatch, star_from):
    monkeypatch.setattr(J, "ROWS", 5)
    monkeypatch.setattr(J, "WEIGHT", 600)
    monkeypatch.setattr(J, "STAR", 3)
    monkeypatch.setattr(J, "STAR_FROM", star_from)
    rows = families(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(df) == brute(rows)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd) == brute(rows)
    assert result(empty) == []


def test_one_of_each_group_stays(odd):
    kept = J.without_near_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((str(r.doc_id) for r in kept.collect()))
    assert ids == sorted(["1", "2", "3", "4", "7", "8", "9", "10", "12", "None", "None"])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(200, 300)] + [(7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(100, 141)} | {(x, 1) for x in [1, *range(200, 300)]}


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_with_heavy_nodes(spark, monkeypatch, few):
    """By broadcasts of all nodes and of the heavy ones only: stars of many leaves, leaves that are smaller than their middle, chains between stars."""
    monkeypatch.setattr("prepkit.llm.components.FEW_EDGES", few)
    rnd = random.Random(8)
    edges = [(500, i) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(1299, 3000), (3000, 2000), (2000, 2001)]
    edges += [(5000 + rnd.randrange(300), 5000 + rnd.randrange(300)) for _ in range(150)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    want = {(x, top(x)) for e in edges if e[0] != e[1] for x in e}
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
