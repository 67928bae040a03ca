"""The pipeline against a plain twin of its stages, on whole tables of a small folder."""

import collections
import hashlib
import random
import re
import struct

import pytest

import corpus_pipeline
from prepkit.llm import byte_bpe, decontaminate, gam, line_dedup
from test_line_dedup import brute as repeated
from test_ngram_join import brute as components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with all kinds of cases, labels and benchmark as Parquet."""
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "io", "ung", "ent", "al")]

    def prose(n):
        return "".join(w + rnd.choice([" ", " ", " ", ". ", ", ", "\n"]) for w in rnd.choices(words, k=n)).strip()

    rows, labels = [], []
    item = prose(40).replace("\n", " ")
    passage = prose(70).replace("\n", " ")
    for i in range(160):
        kind = i % 8
        text = prose(120) if kind != 1 else " ".join(w + "%%%" for w in rnd.choices(words, k=80))
        if kind == 2:
            text = " ".join(text.split()[:60]) + " " + item + " " + " ".join(text.split()[60:])
        if kind == 3:
            text = text + "\n" + passage + "\n" + prose(20)
        if kind == 4 and rows:
            # two changed words: near enough to link, and no run of more than 50 words stays the same
            near = re.split(r"(\s)", rows[-4][1])
            near[len(near) // 6 * 2] = near[len(near) // 3 * 2] = "changed"
            text = "".join(near)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 0 if kind == 1 else 1, 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, prose(50), "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_a_plain_twin(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    got, seen = docs, {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, got, folder).write.parquet(f"{folder}/out/{name}")
        got = spark.read.parquet(f"{folder}/out/{name}")
        seen[name] = [tuple(r) for r in got.collect()]
        if name != "byte_bpe":
            assert got.columns == columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # quality: by the scores of the operator
    keep = {r.doc_id for r in gam.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    rows = [r for r in rows if r[0] in keep]
    assert sorted(map(str, ((r[0], r[1]) for r in seen["quality_classifier"]))) == sorted(map(str, rows))
    assert not any(r[0] is not None and r[0] < 160 and r[0] % 8 == 1 for r in rows)
    # repeated passages
    gone = repeated(rows)
    cut = []
    for d, t in rows:
        lines = gone.get((-2**63 if d is None else d, t), set())
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in lines) if t is not None else None
        if not lines or left.strip(" "):
            cut.append((d, left))
    assert sorted(map(str, ((r[0], r[1]) for r in seen["line_dedup"]))) == sorted(map(str, cut))
    # one of each group
    group = collections.Counter()
    kept = []
    for d, n, c in components(cut):
        if n == 0 or d == c:
            kept.append(d)
        group[c] += 1
    assert sorted(map(str, (r[0] for r in seen["ngram_jaccard_join"]))) == sorted(map(str, kept))
    assert max(group.values()) > 1
    # leaks
    item = re.findall(r"\w+", spark.read.parquet(f"{folder}/benchmark.parquet").first().text.lower())
    want = {tuple(item[i:i + 5]) for i in range(len(item) - 4)}

    def leaks(t):
        w = re.findall(r"\w+", (t or "").lower())
        return len(want & {tuple(w[i:i + 5]) for i in range(len(w) - 4)}) >= 0.8 * len(want)

    clean = [(d, t) for d, t in cut if d in kept and not leaks(t)]
    assert sorted(map(str, (r[0] for r in seen["benchmark_decontamination"]))) == sorted(str(d) for d, _ in clean)
    assert len(clean) < len(kept)
    # tokens
    codec = byte_bpe.codec(byte_bpe.vocabulary_path())
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    out = {r[0]: r[1:] for r in seen["byte_bpe"]}
    for d, t in clean:
        ids = library.encode_ordinary(t or "")
        assert out[d] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                          hashlib.sha256((t or "").encode()).hexdigest())


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert gam.without_low_quality(docs, labels).collect() == []
    assert line_dedup.without_repeats(docs).collect() == []
    assert decontaminate.clean_documents(docs, bench).collect() == []
    assert decontaminate.clean_documents(spark.read.parquet(f"{folder}/documents.parquet"), bench.where("false")).count() == 163
