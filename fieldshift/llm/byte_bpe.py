"""Byte-level BPE encoding and decoding of whole texts.

Pre-tokens that are themselves in the vocabulary are resolved by a minimal perfect hash; the others are merged by a
heap over linked bytes, lowest rank first and leftmost among equals. Texts are cut before white space, where no
pre-token can span, and what each cut piece encodes to is remembered up to a bound.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from .support import Memory, map_documents

#: Pieces, and pre-tokens, that each of a Python worker's two generations remembers.
REMEMBERED = 120_000
#: Most documents and bytes of text that are encoded at once.
ROWS, BYTES = 1024, 2 << 20
#: A space that goes on with white space, so that no pre-token need begin at it; RE2, for Arrow.
UNEVEN = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets; a bucket of several has the first seed that sends
    its keys to free slots, a bucket of one has its slot as a negative number. A comparison tells foreign keys."""

    def __init__(self, keys: list[bytes]):
        n = self.size = max(1, len(keys))
        self.buckets = max(1, n // 2)
        self.keys, self.seeds, self.slots = keys, [0] * self.buckets, [-1] * n
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault((h >> 32) % self.buckets, []).append(i)
        ordered = sorted(groups.items(), key=lambda g: -len(g[1]))
        several = [g for g in ordered if len(g[1]) > 1]
        for bucket, members in several:
            seed = 0
            while True:
                places = [self._place(hashes[i], seed) for i in members]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for i, place in zip(members, places):
                self.slots[place] = i
        free = (slot for slot, taken in enumerate(self.slots[:]) if taken < 0)
        for (bucket, (i,)), slot in zip(ordered[len(several) :], free):
            self.seeds[bucket], self.slots[slot] = -slot - 1, i

    def _place(self, h: int, seed: int) -> int:
        if seed < 0:
            return -seed - 1
        x = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return ((x >> 32) ^ x) % self.size

    def find(self, key: bytes) -> int:
        """The key's index, or -1."""
        h = xxhash.xxh64_intdigest(key)
        at = self.slots[self._place(h, self.seeds[(h >> 32) % self.buckets])]
        return at if at >= 0 and self.keys[at] == key else -1


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of ``piece``: while any adjacent pair is a token, merge the pair of lowest rank, leftmost first."""
    n = len(piece)
    rank_of = ranks.get
    end = list(range(1, n + 1))  # of the segment that starts here; 0 where none does
    before = list(range(-1, n - 1))  # start of the segment to the left
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, left, stop = heappop(heap)
        middle = end[left]
        if not middle or middle >= stop or end[middle] != stop:
            continue
        end[left], end[middle] = stop, 0
        if stop < n:
            before[stop] = left
            r = rank_of(piece[left : end[stop]])
            if r is not None:
                heappush(heap, (r, left, end[stop]))
        left_of = before[left]
        if left_of >= 0:
            r = rank_of(piece[left_of:stop])
            if r is not None:
                heappush(heap, (r, left_of, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


def _joined(values: pa.Array, first: np.ndarray) -> pa.Array:
    """Binary values of one fresh array joined: those from first[i] up to first[i + 1] become value i."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1][first] if len(values) else np.zeros(len(first), np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), values.buffers()[2] or pa.py_buffer(b"")])


class Codec:
    """Encodes and decodes by a vocabulary in rank order; ids travel as little-endian unsigned 32-bit integers."""

    #: Before a space after other than white space a pre-token begins.
    _cut = re.compile(r"(?<=\S)(?= )")

    def __init__(self, vocabulary: PerfectHash, pattern: str):
        self.hash, self.tokens = vocabulary, vocabulary.keys
        self.ranks = {t: i for i, t in enumerate(self.tokens) if t}
        self.split = regex.compile(pattern).findall
        self.spelling = pa.array(self.tokens, pa.binary())
        self.pieces, self.words = Memory(REMEMBERED), Memory(REMEMBERED)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            raw = word.encode()
            whole = self.hash.find(raw)
            ids = np.array([whole] if whole >= 0 else heap_merge(raw, self.ranks), "<u4").tobytes()
            if len(word) <= LONGEST_REMEMBERED:
                self.words.put(word, ids)
        return ids

    def _slow(self, piece: str) -> bytes:
        ids = self.pieces.old.get(piece)
        if ids is None:
            ids = b"".join(map(self._word, self.split(piece)))
        if len(piece) <= LONGEST_REMEMBERED:
            self.pieces.now[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        self.pieces.turn()  # between texts, so that one text sees one generation
        known, slow = self.pieces.now.get, self._slow
        return b"".join([known(p) or slow(p) for p in self._cut.split(text)])

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (null: none) as binary values. What stands between single spaces is looked up once."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False))
        if len(odd) == len(texts):
            return pa.array(list(map(self.encode, texts.to_pylist())), pa.binary())
        if len(odd):
            even = np.setdiff1d(np.arange(len(texts)), odd)
            parts = [self.encode_all(texts.take(pa.array(even))), *[pa.array([self.encode(texts[i].as_py())], pa.binary()) for i in odd.tolist()]]
            return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate([even, odd]))))
        words = pc.split_pattern(texts, " ")
        first = words.offsets.to_numpy()  # of each text's words; the first of them has no space before it
        flat = words.flatten()
        distinct = flat.dictionary_encode()
        self.pieces.turn()
        known, slow = self.pieces.now.get, self._slow
        after = [f" {w}" for w in distinct.dictionary.to_numpy(zero_copy_only=False)]
        heads = flat.take(pa.array(first[:-1])).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([known(p) or slow(p) for p in after + heads], pa.binary())
        index = distinct.indices.to_numpy().copy()
        index[first[:-1]] = len(after) + np.arange(len(heads))
        return _joined(ids.take(pa.array(index)), first)

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The bytes of each text's ids, both as binary values."""
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        numbers = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4") if len(ids) else np.empty(0, np.uint32)
        return _joined(self.spelling.take(pa.array(numbers)), (ends - ends[0]) // 4)


_codecs: dict[str, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """The Python worker's codec for a broadcast vocabulary; a worker keeps one."""
    vocabulary = shared.value
    codec = _codecs.get(pattern)
    if codec is None or codec.hash is not vocabulary:
        codec = _codecs[pattern] = Codec(vocabulary, pattern)
    return codec


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(doc_id, n_tokens long, ids binary) per row: the whole text's ids, special tokens being ordinary text.

    With ``decoded``, also what the ids decode to (binary), by the same Python worker, which halves their number.
    Each match of ``pattern`` is encoded by itself. A null or empty text gives no ids; ids may be null or repeated,
    every row stays; an empty table gives no row; extra columns are ignored. The vocabulary, whose size is fixed, is
    read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(vocabulary)))

    def make():
        codec = _codec(shared, pattern)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode_all(batch.column(1))
            counts = pc.divide(pc.binary_length(ids).cast(pa.int64()), 4)
            names, arrays = ["doc_id", "n_tokens", "ids"], [batch.column(0).cast(pa.int64()), counts, ids]
            if decoded:
                names.append("decoded")
                arrays.append(codec.decode_all(ids))
            return pa.RecordBatch.from_arrays(arrays, names)

        return apply

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return map_documents(docs, [id_col, text_col], schema, make, ROWS, BYTES)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, n_tokens long, ids binary, decoded binary): the bytes that each row's ids stand for; null: none."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def make():
        tokens = shared.value

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
            arrays = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            arrays += [pa.array(ids, pa.binary()), pa.array(texts, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded"])

        return apply

    return map_documents(encoded, [id_col, ids_col], "doc_id long, n_tokens long, ids binary, decoded binary", make)
