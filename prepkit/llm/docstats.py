"""Rule statistics of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm import textcols as T

WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PIPE = np.zeros(256, dtype=bool)
PIPE[ord("|")] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[0x30:0x3A] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[0x41:0x5B] = True
STOP = np.zeros(256, dtype=bool)
STOP[list(b".,;:!?")] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_distinct_words", "n_equal_next", "n_pipes", "n_digits", "n_upper", "n_stops", "max_word"]


def _repeated(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each place whether (text, h) stands elsewhere too."""
    if not len(h):
        return np.zeros(0, bool)
    key = T.mix(h ^ T.mix(text.astype(np.uint64) + T.PLACE_KEY[50]))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _distinct(text: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """Distinct h per text."""
    if not len(h):
        return np.zeros(texts, np.int64)
    key = T.mix(h ^ T.mix(text.astype(np.uint64) + T.PLACE_KEY[50]))
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    return np.bincount(text[order[first]], minlength=texts)


def _count(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(table[data[a:b]]) for a, b in zip(offs[:-1], offs[1:])], np.int64)


def group_stats(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The FIELDS of the texts at ``offs``."""
    texts = len(offs) - 1
    words = T.words_of(data, offs, T.WHITE, False)
    text = words.text_of()
    n_words = words.counts
    inside = ~T.WHITE & T.LEAD
    lines = T.words_of(data, offs, NEWLINE, False)
    line_text = lines.text_of()
    with_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_text, line_hash = line_text[with_word], lines.hash[with_word]
    n_lines = np.bincount(line_text, minlength=texts)
    dup_lines = n_lines - _distinct(line_text, line_hash, texts)
    # words covered by 8-word windows that stand twice or more in the text
    h, at = T.windows(words, WINDOW)
    twice = _repeated(at, h)
    n = len(words.hash)
    cover = np.zeros(n + 1, np.int64)
    place = np.arange(n)
    place = place[:max(0, n - WINDOW + 1)]
    place = place[text[place] == text[place + WINDOW - 1]] if len(place) else place
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, place[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[:n] > 0
    equal_next = np.zeros(n, bool)
    if n:
        equal_next[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text, words.end - words.start)
    return [n_words, _count(inside, data, offs), _count(SYMBOLS, data, offs), dup_lines,
            T.per_text_sum(covered, words.first), n_lines, _distinct(text, words.hash, texts),
            T.per_text_sum(equal_next, words.first), _count(PIPE, data, offs), _count(DIGIT, data, offs),
            _count(UPPER, data, offs), _count(STOP, data, offs), longest]


def batch_stats(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The FIELDS of the texts of a column, for some neighbouring texts at a time."""
    data, offs = T.buffers(column)
    for lo, hi in T.doc_groups(offs):
        yield dict(zip(FIELDS, group_stats(data, offs[lo:hi + 1])))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo = 0
        for columns in batch_stats(batch.column(1)):
            n = len(columns["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), *(pa.array(c, pa.int64()) for c in columns.values())],
                ["doc_id", *FIELDS])
            lo += n


def doc_stats(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id and FIELDS (long), one row per input row.

    Words are runs of anything but space and \\t-\\r.  Null and empty texts have
    zeros.  ``n_repeat_words``: words inside 8-word windows found twice or more in
    the text.  ``n_dup_lines``: lines with a word that equal an earlier line.
    """
    schema = "doc_id long, " + ", ".join(f"{f} long" for f in FIELDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(_stats, schema)


def ratios(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Features of the statistics, one row a text; none depends on who wrote it or where."""
    c = {k: np.asarray(v, np.float64) for k, v in columns.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_distinct_words"] / words, c["n_equal_next"] / words,
        c["n_pipes"] / words, c["n_digits"] / chars, c["n_upper"] / words, c["n_stops"] / words,
        np.log1p(c["max_word"]), words / lines, c["n_symbols"] / chars], axis=1)


RATIOS = ["log_words", "word_length", "symbols", "dup_lines", "repeat_words", "distinct_words", "equal_next",
          "pipes", "digits", "upper", "stops", "log_max_word", "words_a_line",
          "symbols_a_char"]


def agreed_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality (0 or 1): labels that are null, or contradict each other for one doc_id, are left out."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
            .where("quality = most").drop("most"))


def labelled_sample(stats: DataFrame, labels: DataFrame, bound: int, where: str = "true") -> tuple[dict, np.ndarray]:
    """Statistics and quality (0 or 1) of at most ``bound`` labelled rows, chosen by a hash of doc_id.

    The rows that reach the driver are bounded by ``bound``.
    """
    rows = (stats.where(where).join(agreed_labels(labels), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", *FIELDS).limit(bound).toArrow())
    columns = {f: rows.column(f).to_numpy() for f in FIELDS}
    return columns, rows.column("quality").to_numpy().astype(np.int64)
