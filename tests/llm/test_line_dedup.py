import collections
import random
import re

from prepkit.llm import line_dedup as L


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]", text) if w]


def brute(rows, min_words=50):
    """Removed lines per (id, text): maximal passages of equal lines that stand at one earlier place.

    Walks all documents line by line and follows every earlier place with the same line."""
    texts = sorted({(-2**63 if d is None else d, t) for d, t in rows if t}, key=lambda x: x[0])
    order = {}
    for d, t in texts:
        order.setdefault(d, []).append(t)
    assert all(len(v) == 1 for v in order.values())         # one text an id, so the order is clear
    places = collections.defaultdict(list)
    gone = collections.defaultdict(set)
    for d, t in texts:
        lines = t.split("\n")
        size = [len(words(x)) for x in lines]
        following = {}                                      # earlier place -> first line of the passage that reached it
        for i, x in enumerate([*lines, None]):
            now = {(e, j): following.pop((e, j - 1), i) for e, j in places[x]} if x is not None else {}
            for start in following.values():                # passages that end before line i
                if sum(size[start:i]) > min_words:
                    gone[d, t] |= set(range(start, i))
            following = now
            if x is not None:
                places[x].append((d, i))
    return gone


def line(rnd, n):
    return " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))


def corpus(seed):
    """Documents of lines of all lengths, with passages of over 50 words put into many of them."""
    rnd = random.Random(seed)
    passages = [[line(rnd, 60)], [line(rnd, 27), line(rnd, 25)], [line(rnd, 9) for _ in range(7)], [line(rnd, 4) for _ in range(30)],
                [line(rnd, 2), line(rnd, 50)], [line(rnd, 18), line(rnd, 17), line(rnd, 17)]]
    rows = []
    for d in range(120):
        lines = [line(rnd, rnd.choice([3, 8, 12, 30])) for _ in range(rnd.randrange(1, 12))]
        for k, p in enumerate(rnd.sample(passages, rnd.choice([0, 1, 2]))):
            at = len(lines) if k else rnd.randrange(min(len(lines), 3))
            lines[at:at] = p
        rows.append((d, "\n".join(lines)))
    return rows, passages


def test_every_planted_passage_stays_once(spark):
    rows, passages = corpus(1)
    got = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for p in passages:
        block = "\n".join(p)
        holders = [d for d, t in rows if block in t]
        assert len(holders) > 5
        for k, d in enumerate(holders):
            for x in p:
                assert (x in got[d].text.split("\n")) == (k == 0), (k, d)
    planted = {x for p in passages for x in p}
    for d, t in rows:    # nothing else goes
        own = [x for x in t.split("\n") if x not in planted]
        assert [x for x in got[d].text.split("\n") if x not in planted and x] == own
        assert got[d].n_lines == len(t.split("\n"))
        assert got[d].n_removed == got[d].n_lines - (len(got[d].text.split("\n")) if got[d].text else 0)


def test_copies_and_short_repeats(spark):
    rnd = random.Random(5)
    one = "\n".join(line(rnd, 20) for _ in range(10))
    short = line(rnd, 30) + "\n" + line(rnd, 20)
    rows = [(1, one), (2, one), (3, one + "\n" + line(rnd, 5)), (4, short), (5, short), (6, "a b\n" * 100), (None, line(rnd, 60)), (7, None), (8, "")]
    df = spark.createDataFrame([(d, t, None if t is None else len(t), "q") for d, t in rows],
                               "doc_id long, text string, n_chars long, ranges string")
    got = {r.doc_id: r for r in L.line_dedup(df).collect()}
    gone = brute(rows)
    for d, t in rows:
        assert got[d].n_removed == len(gone.get((-2**63 if d is None else d, t), ())), d
    assert got[2].text == "" and got[1].text == one and got[5].text == short and got[3].n_removed == 10
    assert got[6].text.startswith("a b\n") and got[6].n_removed > 90
    assert got[7].text is None and got[7].n_lines == 0 and got[8].n_lines == 1
    left = L.without_repeats(df)
    assert left.columns == df.columns
    assert {(r.doc_id, r.n_chars) for r in left.collect()} == {
        (d, None if t is None else len(got[d].text)) for d, t in rows if d != 2}


def test_odd_rows(odd, empty):
    got = L.line_dedup(odd)
    assert got.count() == odd.count()
    assert [r.n_removed for r in got.where("doc_id = 5").collect()] == [1, 1]      # the null doc_id comes first
    assert [r.n_removed for r in got.where("doc_id = 11").collect()] == [2]
    assert L.line_dedup(empty).collect() == []


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    gone = brute(rows)
    for r in L.line_dedup(docs).collect():
        text = next(t for d, t in rows if d == r.doc_id)
        assert r.text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get((r.doc_id, text), ())), r.doc_id


def test_words_are_counted_whatever_stands_between_them(spark):
    lines = ["", " ", "a", "a b", " a  b ", "a\tb c", "\t\t", "a\r", "  a", "a  b", "é\u2028x\x0bz", "a\x0cb", "\u00a0 x", "a "]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = [r[0] for r in df.selectExpr(L._words("array(x)") + "[0]").collect()]
    assert got == [len(words(x)) for x in lines]


def test_tabs_padding_and_blank_lines(spark):
    rnd = random.Random(9)
    one = line(rnd, 60).replace(" ", "\t")
    two = line(rnd, 30).replace(" ", "\t") + "\n" + line(rnd, 25).replace(" ", "\t")
    code = "\n".join(" " * 12 + line(rnd, 5).replace(" ", "   ") for _ in range(4))
    table = line(rnd, 20).replace(" ", "    ")
    sparse = ("\n" * 10).join(line(rnd, 4) for _ in range(6))
    rows = []
    for k, (text, goes) in enumerate([(one, True), (two, True), (code, False), (table, False), (sparse, False)]):
        for copy in range(2):
            rows.append((10 * k + copy, f"{line(rnd, 6)}\n{text}\n{line(rnd, 7)}", text, goes and copy == 1))
    rows += [(100, "\n\t\n" + one + "\n \n", one, True)]      # no word is left
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in L.line_dedup(df).collect()}
    for d, text, passage, goes in rows:
        assert (passage not in got[d].text) == goes, d
        assert len(words(got[d].text)) == len(words(text)) - got[d].words_removed, d
        assert got[d].words_removed == (len(words(passage)) if goes else 0), d
    assert {r.doc_id for r in L.without_repeats(df).collect()} == {r[0] for r in rows} - {100}


def test_repeats_of_different_origin_are_not_added_up(spark):
    rnd = random.Random(11)
    a, b, c, d, e, f = (line(rnd, 15) for _ in range(6))
    rows = [(1, f"{a}\n{b}"), (2, f"{c}\n{d}"), (3, f"{a}\n{b}\n{c}\n{d}"), (4, f"{a}\n{b}"),
            (5, f"{e}\n{a}\n{b}\n{c}\n{d}\n{f}"),                     # as one passage in 3
            (6, f"{c}\n{d}\n{a}\n{b}")]                                # in another order: nowhere as one
    got = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(1, 7)] == [0, 0, 0, 0, 4, 0]
    assert got[5].text == f"{e}\n{f}" and got[5].words_removed == 60
    gone = brute(rows)
    assert all(len(gone.get(r, ())) == got[r[0]].n_removed for r in rows)
    short = {r.doc_id: r.n_removed for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20).collect()}
    gone = brute(rows, 20)
    assert short == {r[0]: len(gone.get(r, ())) for r in rows}
