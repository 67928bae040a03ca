"""License scan, benchmark decontamination and WARC archive against DuckDB and brute force."""

import base64
import collections
import hashlib
import re

import duckdb
import pyarrow as pa
import pytest

from prepkit.llm import decontaminate, license_scan, textcols, warc_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(df, con, sql):
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = collections.Counter(tuple(r[c] for c in cols) for r in df.collect())
    want = collections.Counter(tuple(row[rel.columns.index(c)] for c in cols) for row in rel.fetchall())
    assert got == want


def test_license_twin(table, duck):
    same(license_scan.license_scan(table("documents")).drop("matches"), duck, license_scan.oracle_sql())


def test_license_templates(spark, odd, empty):
    texts = ["Licensed under the Apache License, Version 2.0.", "under the Apache license 2.0", "under the apache licence 2.0",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files", "GNU General Public License as published by the FSF, version 3 of", "CC BY\nCC BY-NC 4.0 cc by",
             "GNU General Public License one two three four five six seven eight nine version 3", "Copyright 2020 X. All rights reserved",
             None, "", "cc", "rights reserved. All", "ccé by"]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(len(texts))] == [
        "apache-2.0", "apache-2.0", "", "mit", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0", "gpl", "copyright,reserved", "", "", "", "", ""]
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (3, 0, 7)
    assert [(m.label, m.first_word, m.last_word) for m in got[5].matches] == [("cc-by-nc-4.0", 2, 6)]
    assert (got[8].n_words, got[8].n_base, got[8].first_word, got[8].score) == (0, 0, None, 0.0)
    assert license_scan.license_scan(odd).count() == odd.count()
    assert license_scan.license_scan(empty).collect() == []


def test_license_capitals_where_a_segment_ends(spark, monkeypatch):
    """A capital is a letter of its word, also where a long text is cut into segments."""
    text = "x" * textcols.SEGMENT + " " + "z" * (textcols.SEGMENT - 6) + " CC BYzantine CC BY All Rights RESERVED"
    shifted = [text.replace("z ", "z" * i + " ", 1) for i in range(40)]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(shifted)), "doc_id long, text string").coalesce(1)).collect()
    assert {(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {(9, 2, 4, 6, "cc-by,reserved")}
    monkeypatch.setattr(textcols, "SEGMENT", 8)
    data, offs = textcols.buffers(pa.array(["ABCDEFGHIJKL", "Ab CDEFGHIJ kL MNOP", "", "QR"]))
    assert textcols.words_of(data, offs, textcols.NON_ALNUM, True).counts.tolist() == [1, 4, 0, 1]


def test_words_of_segments(monkeypatch, table):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(textcols, "SEGMENT", 100)
    texts = [r.text for r in table("documents").collect()][:60] + ["", None, "x" * 1000, " a" * 300]
    data, offs = textcols.buffers(pa.array(texts))
    words = textcols.words_of(data, offs, textcols.WHITE, False)
    for i, t in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert [bytes(data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b])] == want
        assert all(words.hash[a + k] == textcols.word_hash(w) for k, w in enumerate(want[:20]))
    assert len(np.unique(words.hash)) == len({w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")})


def test_decontamination_twin(table, duck):
    same(decontaminate.contained_items(table("documents"), table("benchmark")), duck, decontaminate.oracle_sql())


def brute_containment(docs, items):
    def grams(text, g=None):
        w = re.findall(r"\w+", (text or "").lower())
        g = g or min(len(w), 5)
        return g, {" ".join(w[i:i + g]) for i in range(len(w) - g + 1)} if w else set()
    out = set()
    for item, text in items:
        if item is None:
            continue
        g, want = grams(text)
        for d, t in docs:
            n = len(want & grams(t, g)[1]) if g else 0
            if want and 100 * n >= 80 * len(want):
                out.add((d, item, len(want), n))
    return out


def test_decontamination_brute_force(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    long_words = next(t for _, t in docs if t and len(t) > 10**5 and " " in t)
    inner = " ".join(long_words.split()[5000:5040])
    near = inner.split()
    near[39] = "changed"
    far = list(near)
    far[10] = far[20] = "changed"
    items = [(1, inner.upper()), (2, " ".join(near)), (3, " ".join(far)), (4, "one two"), (5, "One"), (6, ""), (7, None),
             (None, inner), (8, "no such words at all in any text"), (9, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(odd, bench)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == brute_containment(docs, items)
    left = decontaminate.clean_documents(odd, bench)
    assert left.columns == odd.columns
    bad = {d for d, *_ in brute_containment(docs, items)}
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(d for d, _ in docs if d not in bad)
    assert decontaminate.contained_items(empty, bench).collect() == []
    assert decontaminate.contained_items(odd, bench.where("false")).collect() == []


def test_warc_twin(spark, table, duck):
    path = warc_store.new_archive(spark)
    warc_store.write_archive(table("pages"), path)
    same(warc_store.read_index(spark, path), duck, warc_store.oracle_sql())


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "x"), (3, None, None), (4, "http://d/", ""), (5, "u", "é\n" * 1000),
            (5, "u", "é\n" * 1000), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, sha256 string")
    path = warc_store.new_archive(spark)
    warc_store.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = warc_store.read_records(spark, path).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        http, _, body = rest[:-4].partition(b"\r\n\r\n")
        payload = bytes(r.payload)
        assert payload.decode() in [x[2] or "" for x in rows if x[0] == r.page_id]
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert body == (payload if fields["WARC-Type"] == "response" else b"")
        assert "Evil" not in fields
    index = {r.page_id: r for r in warc_store.read_index(spark, path).collect()}
    assert (index[1].record_type, index[1].refers_to, index[2].record_type, index[2].refers_to) == ("revisit", 2, "response", None)
    assert (index[3].refers_to, index[4].record_type, index[5].payload_bytes) == (4, "response", 3000)


def test_warc_smallest_payload_and_empty_table(spark, table):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "x"), (4, "d", "x")], "page_id long, url string, html string")
    path = warc_store.new_archive(spark)
    warc_store.write_archive(pages, path, min_bytes=2)
    assert {(r.page_id, r.refers_to) for r in warc_store.read_index(spark, path).collect()} == {(1, 2), (2, None), (3, None), (4, None)}
    path = warc_store.new_archive(spark)
    warc_store.write_archive(pages.where("false"), path)
    assert warc_store.read_index(spark, path).collect() == []


def test_warc_damage_is_noticed(spark):
    pages = spark.createDataFrame([(1, "a", "xy")], "page_id long, url string, html string")
    path = warc_store.new_archive(spark)
    warc_store.write_archive(pages, path)
    broken = path + "-broken"
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "payload_digest", "payload_bytes", "cast('zz' as binary) as payload") \
        .write.parquet(f"{broken}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{broken}/records")
    with pytest.raises(Exception, match="digest"):
        warc_store.read_index(spark, broken).collect()


@pytest.mark.parametrize("damage", ["replace(http, 'Content-Length: 2', 'Content-Length: 3') as http", "concat(http, 'x') as http"])
def test_warc_index_reads_the_whole_records(spark, damage):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], "page_id long, url string, html string")
    path = warc_store.new_archive(spark)
    warc_store.write_archive(pages, path)
    broken = path + "-http"
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{broken}/payloads")
    spark.read.parquet(f"{path}/records").selectExpr("page_id", "header", damage, "sha256").write.parquet(f"{broken}/records")
    assert len(warc_store.read_index(spark, path).collect()) == 2
    with pytest.raises(Exception, match="lengths"):
        warc_store.read_index(spark, broken).collect()


def test_items_are_partitioned_by_size(spark):
    """Every size class has bounds of its own, and a corpus with items of many sizes loses none."""
    words = [[f"w{i}x{j}" for j in range(n)] for i, n in enumerate([1, 3, 5, 6, 9, 20, 40, 70, 300])]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "item_id long, text string")
    bounds = decontaminate.size_bounds(decontaminate.sketches(decontaminate.item_shingles(items)))
    assert [(c[0], c[2]) for c in bounds[5]] == [(0, 1), (1, 2), (2, 5), (4, 16), (5, 36), (6, 66), (8, 296)]
    assert all(c[1] is not None for c in bounds[5]) and set(bounds) == {1, 3, 5}
    docs = spark.createDataFrame([(i, "a b c " + " ".join(w) + " d e") for i, w in enumerate(words)] + [(50, " ".join(words[8][:200]))],
                                 "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(i, i) for i in range(len(words))}
