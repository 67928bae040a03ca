"""Operator 4: byte-level BPE encoding and decoding by a two-tier lookup.

A batch of texts is split into pre-tokens by code point classes, all at once.
Tier one is a minimal perfect hash over the vocabulary: the different pre-tokens
of the batch are hashed, and those that are whole vocabulary entries get their id
from one table read (checked byte by byte).  Tier two is for the rest: a heap of
mergeable neighbours over a linked list of the pre-token's bytes, lowest rank
first, leftmost first; recent results are kept.  Decoding gathers the bytes of
the ids again.

The splitter stands for the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm import textcols as T

VOCABULARY = "byte_bpe_50k.tiktoken"
#: pre-tokens of tier two that a worker remembers
REMEMBERED = 50_000
#: a single text is split in pieces of about so many bytes (cut before white space)
PIECE = 1 << 21
#: code points with the property White_Space (fixed values)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3

_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                               np.uint8, 0x110000)
        _classes[WHITE_SPACE] = SPACE
    return _classes


def split_points(cps: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Sorted places where pre-tokens begin; ``text_start``: places where a text begins."""
    n = len(cps)
    cls = code_point_classes()[cps]
    begins = np.zeros(n + 1, bool)
    begins[text_start] = True
    begins = begins[:n]
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = cls[1:] != cls[:-1]
    run |= begins
    run_at = np.flatnonzero(run)
    run_cls = cls[run_at]
    run_end = np.append(run_at[1:], n)
    cut = run.copy()
    # a run of white space before anything else of the same text leaves its last character to what follows
    follows = np.append(~begins[run_at[1:]], False)
    space = run_cls == SPACE
    last = run_end[space & follows] - 1
    cut[last] = True
    # ... and joins it if that character is a blank
    blank = last[cps[last] == 0x20]
    cut[blank + 1] = False
    # contractions: a lone apostrophe that follows no blank of its text, before letters
    lone = run_at[(run_cls == OTHER) & (run_end - run_at == 1) & follows & (cps[run_at] == 0x27)]
    if len(lone):
        after_blank = np.zeros(len(lone), bool)
        inner = lone > 0
        after_blank[inner] = (cps[lone[inner] - 1] == 0x20) & ~begins[lone[inner]]
        lone = lone[~after_blank]
        text_end = np.append(text_start, n)
        end = text_end[np.searchsorted(text_end, lone, "right")]
        padded = np.concatenate([cps, np.zeros(3, cps.dtype)])
        for letters in CONTRACTIONS:
            size = len(letters)
            ok = lone + size < end
            for j, x in enumerate(letters):
                ok &= padded[lone + 1 + j] == ord(x)
            at = lone[ok]
            cut[at + 1] = False
            rest = at + 1 + size
            cut[rest[rest < n]] = True
    return np.flatnonzero(cut)


class PerfectHash:
    """A minimal perfect hash over different 64-bit keys: hash and displace."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        home = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(self.n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        self.order = np.zeros(self.n, np.int64)     # place -> key
        for size in range(int(sizes.max(initial=0)), 1, -1):
            todo = np.flatnonzero(sizes == size)
            members = order[bounds[todo][:, None] + np.arange(size)]
            d = 0
            while len(todo):
                # one displacement for all buckets of a size that have no place yet
                d += 1
                place = self._place(keys[members], np.full(1, d, np.uint64))
                ordered = np.sort(place, axis=1)
                free = ~taken[place].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
                at = np.flatnonzero(free)
                _, first = np.unique(place[at].ravel(), return_index=True)
                claimed = np.zeros(place[at].size, bool)
                claimed[first] = True
                at = at[claimed.reshape(-1, size).all(1)]
                taken[place[at]] = True
                self.order[place[at]] = members[at]
                self.shift[todo[at]] = d
                left = np.ones(len(todo), bool)
                left[at] = False
                todo, members = todo[left], members[left]
        single = np.flatnonzero(sizes == 1)          # a lone key is sent to a free place directly
        place = np.flatnonzero(~taken)[:len(single)]
        self.order[place] = order[bounds[single]]
        self.shift[single] = -1 - place

    def _place(self, keys: np.ndarray, d) -> np.ndarray:
        return (T.mix(keys + d * T.PLACE_KEY[40]) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        d = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._place(keys, d.astype(np.uint64)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; by length, so that short spans cost what they are long."""
    h = np.zeros(len(starts), np.uint64)
    size = ends - starts
    live = np.arange(len(starts))
    j = 0
    while len(live):
        live = live[size[live] > j]
        if j >= 64:       # a very long span: whole bytes at once
            for i in live:
                h[i] ^= np.frombuffer(hashlib.blake2b(data[starts[i] + 64:ends[i]].tobytes(), digest_size=8).digest(),
                                      np.uint64)[0]
            break
        h[live] = (h[live] + T._BYTE_KEY[data[starts[live] + j]]) * np.uint64(T._BASE)
        j += 1
    return T.mix(h + size.astype(np.uint64) * T.PLACE_KEY[41])


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        size = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        at = np.concatenate(([0], np.cumsum(size)))
        keys = span_hashes(data, at[:-1], at[1:])
        self.hash = PerfectHash(keys)
        order = self.hash.order
        self.keys, self.place_id = keys[order], self.ids[order]
        self.place_bytes = [tokens[k] for k in order]
        # bytes of an id, for decoding
        top = int(self.ids.max()) + 1
        self.size = np.zeros(top, np.int64)
        self.size[self.ids] = size
        self.at = np.zeros(top, np.int64)
        self.at[self.ids] = at[:-1]
        self.bytes = data
        self.seen: dict[bytes, list[int]] = {}

    @classmethod
    def read(cls, path: str) -> "Codec":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})

    def merge(self, word: bytes) -> list[int]:
        """Tier two: merge neighbours in a linked list, lowest rank first, leftmost first.

        The heap holds rank * base + place; an entry counts if the pair at its place still
        has its rank."""
        get, n = self.ranks.get, len(word)
        base = n + 1
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        pair = [get(word[i:i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r * base + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), base)
            if pair[i] != r:
                continue                 # one of the two has merged meanwhile
            j = after[i]
            end = after[i] = after[j]
            pair[j] = -2
            if end < n:
                before[end] = i
                r = pair[i] = get(word[i:after[end]], -1)
                if r >= 0:
                    push(heap, r * base + i)
            else:
                pair[i] = -1
            k = before[i]
            if k >= 0:
                r = pair[k] = get(word[k:end], -1)
                if r >= 0:
                    push(heap, r * base + k)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[word[i:after[i]]])
            i = after[i]
        return out

    def missing(self, word: bytes) -> list[int]:
        got = self.seen.get(word)
        if got is None:
            got = self.merge(word)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[word] = got
        return got

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts at ``offsets`` as uint32, ids per text)."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        texts = len(offsets) - 1
        if hi == lo:
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        raw = data[lo:hi]
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(cps) == len(raw):
            cut = split_points(cps, np.unique(offsets[:-1][offsets[:-1] < hi] - lo))
        else:
            byte_at = np.flatnonzero(T.LEAD[raw])
            first = np.searchsorted(byte_at, np.unique(offsets[:-1][offsets[:-1] < hi] - lo))
            cut = byte_at[split_points(cps, first)]
        start, end = cut, np.append(cut[1:], len(raw))
        h = span_hashes(raw, start, end)
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        u_hash, u_start, u_end = h[index], start[index], end[index]
        place = self.hash(u_hash)
        hit = self.keys[place] == u_hash
        parts: list[list[int]] = []
        buf = raw.tobytes()
        for k, (p, ok, a, b) in enumerate(zip(place.tolist(), hit.tolist(), u_start.tolist(), u_end.tolist())):
            word = buf[a:b]
            if ok and self.place_bytes[p] == word:
                parts.append([int(self.place_id[p])])
            else:
                parts.append(self.missing(word))
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.array([x for p in parts for x in p], np.uint32)
        u_at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        size = sizes[inverse]
        out_at = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(u_at[inverse] - out_at[:-1], size) + np.arange(out_at[-1])]
        per_text = out_at[np.searchsorted(start, offsets - lo, "left")]
        return ids, np.diff(per_text)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        at = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[np.repeat(self.at[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()


def _pieces(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pieces of one text that are split into pre-tokens alike, alone or together: cuts
    between a character that is no white space and ASCII white space."""
    while hi - lo > PIECE:
        look = lo + PIECE
        while look < hi:
            part = data[look - 1:min(look + PIECE, hi)]
            cut = np.flatnonzero(T.WHITE[part[1:]] & ~T.WHITE[part[:-1]] & (part[:-1] < 0x80))
            if len(cut):
                look += int(cut[0])
                break
            look = min(look + PIECE, hi)
        yield lo, look
        lo = look
    if lo < hi:
        yield lo, hi


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec.read(path)
    return _codecs[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_tokens long, ids_sha256, decoded_sha256 string [, ids array<int>].

    ``path`` is a rank file that every executor can open; by default the installed
    vocabulary, found on the executor.  Null and empty texts have no ids; repeated
    rows and null doc_ids each give a row; other columns are ignored.  A very long text
    is encoded in pieces whose pre-tokens are the same as those of the whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for batch in batches:
            data, offs = T.buffers(batch.column(1))
            for lo, hi in T.doc_groups(offs):
                if hi - lo == 1 and offs[hi] - offs[lo] > PIECE:
                    parts = [c.encode(data, np.array([a, b]))[0] for a, b in _pieces(data, int(offs[lo]), int(offs[hi]))]
                    parts_of = [parts]
                else:
                    ids, counts = c.encode(data, offs[lo:hi + 1])
                    bounds = np.concatenate(([0], np.cumsum(counts)))
                    parts_of = [[ids[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
                count, coded, decoded = [], [], []
                for parts in parts_of:
                    one, two = hashlib.sha256(), hashlib.sha256()
                    for p in parts:
                        one.update(p.astype("<u4").tobytes())
                        two.update(c.decode(p))
                    count.append(sum(map(len, parts)))
                    coded.append(one.hexdigest())
                    decoded.append(two.hexdigest())
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(coded),
                           pa.array(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.int32)
                                             for parts in parts_of], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
