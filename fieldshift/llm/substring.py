"""Removal of repeated 50-word passages, by a count-min prefilter and an exact second pass.

Documents are dealt once into chunks of bounded bytes, kept as a table bucketed by chunk, so that later passes read a
chunk where it lies and texts are never shuffled. Then

1. every chunk sends its count-min cells, sorted and delta-coded, to the tasks that own parts of the sketch; these
   add them up and answer with a bit for each cell sent: counted twice or more, or not. Estimates are never too low.
2. every chunk sends the hashes of windows whose cells are all repeated, with the smallest doc_id that has them, to the
   tasks that own hash ranges; these group them exactly and answer with a bit: a smaller doc_id elsewhere, or not.
3. every chunk removes the words of windows that start in a document with a smaller doc_id.

A window that many documents share is one entry per chunk, so no group grows beyond the number of chunks. A chunk sends
at most 2 ** ``MOST_BITS`` messages a pass and row, however large the corpus. Where the sketch needs more parts, the
messages of a coarse part from a batch of chunks are merged into one such partition sketch, which is sent on to finer
parts; the answers come back the same way. So messages stay at some hundred entries each and their number grows with the corpus.

Windows are told apart by 128 hash bits over two independent hashes of each word: at 100 TB, some 10 ** 13 windows, the
chance that any two windows share them without sharing their words is below 10 ** -12.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize, raw_texts, scratch_path, slices

WINDOW = 50
#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 12_000_000
#: Rows of the sketch, and bits of the cells that one task adds up.
DEPTH, BLOCK_BITS = 2, 23
#: Bits of the parts that a chunk sends messages to, and of those that a merged batch sends on to.
MOST_BITS = 12
#: Windows that an exact group is planned for.
GROUP_WINDOWS = 1 << 20
MOST_BUCKETS = 20_000
#: Words whose hash a Python worker remembers.
REMEMBERED = 500_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_hashes: dict[bytes, bytes] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent hashes of 64 bits of each word, in two columns."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    get, digest = _hashes.get, xxhash.xxh3_128_digest

    def of(word: bytes) -> bytes:
        h = get(word)
        if h is None:
            h = _hashes[word] = digest(word)
        return h

    return np.frombuffer(b"".join(map(of, words)), np.uint64).reshape(-1, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _rolling(values: np.ndarray, base: int, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values: a polynomial modulo 2 ** 64, by prefix sums."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)))])
    return _mix((sums[width:] - sums[:-width]) * _powers(pow(base, -1, 1 << 64), len(values) - width + 1))


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


class Windows:
    """The windows of a chunk's documents: start places in the joined words, two hashes, and each one's document."""

    def __init__(self, texts: list[bytes | None], ids: list[int | None], width: int):
        self.width = width
        self.words = [(t or b"").split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        empty = np.empty(0, np.uint64)
        self.start, self.high, self.low, self.doc = np.empty(0, np.int64), empty, empty, np.empty(0, np.int64)
        if total >= width:
            values = np.concatenate([_word_hashes(w) for w in self.words])
            room = np.where(np.array([i is not None for i in ids]), np.maximum(sizes - width + 1, 0), 0)
            which = np.repeat(np.arange(len(ids)), room)
            self.start = np.arange(len(which)) - np.repeat(np.cumsum(room) - room, room) + self.first[which]
            self.high, self.low = (_rolling(values[:, k], _BASES[k], width)[self.start] for k in (0, 1))
            self.doc = np.array([i or 0 for i in ids], np.int64)[which]

    def cells(self, depth: int, bits: int) -> Iterator[np.ndarray]:
        for row in range(depth):
            yield _mix(self.high + np.uint64(row) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - bits)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes of 7 bits, the lowest first, the last of each without the top bit."""
    left = values.astype(np.uint64)
    columns, present = [], []
    live = np.ones(len(left), bool)
    while live.any():
        rest = left >> np.uint64(7)
        more = rest > 0
        columns.append(((left & np.uint64(127)) | (more.astype(np.uint64) << np.uint64(7))).astype(np.uint8))
        present.append(live)
        live, left = live & more, rest
    if not columns:
        return b""
    return np.stack(columns, 1)[np.stack(present, 1)].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    index = np.cumsum(last) - last
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.empty(0, np.int64)
    place = np.arange(len(raw)) - starts[index] if len(raw) else starts
    out = np.zeros(int(last.sum()), np.uint64)
    for shift in range(int(place.max()) + 1 if len(raw) else 0):
        at = place == shift
        out[index[at]] |= (raw[at] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * shift)
    return out


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(parts: list[tuple[bytes, int]]) -> np.ndarray:
    found = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in parts]
    return np.concatenate(found) if found else np.empty(0, bool)


def _answers(table: pa.Table, kind: int) -> list[tuple[bytes, int]]:
    rows = [r for r in table.to_pylist() if r["kind"] == kind]
    return [(r["bits"], r["n"]) for r in sorted(rows, key=lambda r: r["part"])]


def _runs(keys: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """Stretches of sorted keys with equal ``key >> shift``."""
    top = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    values, first = np.unique(top, return_index=True)
    for value, a, b in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield value, slice(a, b)


class _Cells:
    """Messages of sorted cells, each counted once or more often; asked is whether all count it more often."""

    def write(self, part: int, shift: int, keys: np.ndarray, values: np.ndarray) -> tuple[bytes, None]:
        steps = np.diff(keys, prepend=np.uint64(part << shift))
        return pack(steps * np.uint64(2) + (values > 1)), None

    def read(self, part: int, shift: int, n: int, data: bytes, more: None) -> tuple[np.ndarray, np.ndarray]:
        steps = unpack(data)
        return np.uint64(part << shift) + np.cumsum(steps >> np.uint64(1), dtype=np.uint64), (steps & np.uint64(1)).astype(np.uint8) + np.uint8(1)

    def fold(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, their counts up to 2, and each entry's place among them."""
        distinct, place = np.unique(keys, return_inverse=True)
        return distinct, np.minimum(np.bincount(place, values, len(distinct)), 2).astype(np.uint8), place

    def told(self, mine: np.ndarray, folded: np.ndarray) -> np.ndarray:
        """What an entry's answer is beside that of its distinct key: here nothing."""
        return np.zeros(len(mine), bool)

    def settle(self, part: int, shift: int, messages: list[tuple]) -> list[np.ndarray]:
        counts, base = np.zeros(1 << shift, np.uint8), np.uint64(part << shift)
        for message in messages:  # read twice, so that only the counts are held
            keys, values = self.read(part, shift, *message)
            at = (keys - base).astype(np.int64)
            counts[at] = np.minimum(counts[at] + values, 2)
        return [counts[(self.read(part, shift, *message)[0] - base).astype(np.int64)] > 1 for message in messages]


class _Hashes:
    """Messages of sorted windows by their hash pairs, with a doc_id; asked is whether any has a smaller one."""

    def write(self, part: int, shift: int, keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
        return keys.tobytes(), zstandard.ZstdCompressor(level=1).compress(values.tobytes())

    def read(self, part: int, shift: int, n: int, data: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(data, np.uint64).reshape(-1, 2), np.frombuffer(zstandard.ZstdDecompressor().decompress(more), np.int64)

    def fold(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, their smallest doc_ids, and each entry's place among them."""
        order = np.lexsort((values, keys[:, 1], keys[:, 0]))
        keys, values = keys[order], values[order]
        new = np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return keys[new], values[new], place

    def told(self, mine: np.ndarray, folded: np.ndarray) -> np.ndarray:
        return folded < mine

    def settle(self, part: int, shift: int, messages: list[tuple]) -> list[np.ndarray]:
        read = [self.read(part, shift, *message) for message in messages]
        values = np.concatenate([v for _, v in read])
        _, smallest, place = self.fold(np.concatenate([k for k, _ in read]), values)
        return np.split(smallest[place] < values, np.cumsum([len(v) for _, v in read])[:-1])


_Codec = _Cells | _Hashes


def _messages(codec: _Codec, kind: int, owner: int, shift: int, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
    """One message per part that holds any of the sorted keys."""
    for part, at in _runs(keys if keys.ndim == 1 else keys[:, 0], shift):
        yield kind, part, owner, at.stop - at.start, *codec.write(part, shift, keys[at], values[at])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    return pa.table(list(zip(*rows)), schema=_schema(ddl)) if rows else _schema(ddl).empty_table()


def exchange(messages: DataFrame, codec: _Codec, shift: int, fine: int, batches: int) -> DataFrame:
    """The answers to ``messages``, which go to the parts ``key >> shift``.

    If ``fine`` is smaller, what the messages of a part from a batch of owners hold is merged, sent on to the parts
    ``key >> fine`` and settled there.
    """

    def settle(at: int):
        def run(table: pa.Table) -> pa.Table:
            kinds, parts, owners, sizes, data, more = (table.column(c).to_pylist() for c in table.column_names)
            flags = codec.settle(parts[0], at, list(zip(sizes, data, more)))
            return pa.table([kinds, parts, owners, sizes, list(map(_bits, flags))], schema=_schema(ANSWER))

        return run

    if fine >= shift:
        return messages.groupBy("kind", "part").applyInArrow(settle(shift), ANSWER)

    held = materialize(messages.withColumn("batch", F.pmod(F.xxhash64("owner"), F.lit(batches))), "messages")

    def merged(table: pa.Table):
        kinds, parts, owners, sizes, data, more = (table.column(c).to_pylist() for c in table.column_names[:6])
        read = [codec.read(parts[0], shift, *m) for m in zip(sizes, data, more)]
        values = np.concatenate([v for _, v in read])
        return (kinds, parts, owners, sizes), values, codec.fold(np.concatenate([k for k, _ in read]), values)

    def send(table: pa.Table) -> pa.Table:
        (kinds, *_), _, (keys, values, _) = merged(table)
        return _table(list(_messages(codec, kinds[0], table.column("batch")[0].as_py(), fine, keys, values)), MESSAGE)

    def spread(table: pa.Table, answers: pa.Table) -> pa.Table:
        columns, values, (_, folded, place) = merged(table)
        rows = sorted(answers.select(["fine_part", "bits", "n"]).to_pylist(), key=lambda r: r["fine_part"])
        flags = _flags([(r["bits"], r["n"]) for r in rows])[place] | codec.told(values, folded[place])
        return pa.table([*columns, list(map(_bits, np.split(flags, np.cumsum(columns[3])[:-1])))], schema=_schema(ANSWER))

    group = ("kind", "part", "batch")
    back = held.groupBy(*group).applyInArrow(send, MESSAGE).groupBy("kind", "part").applyInArrow(settle(fine), ANSWER)
    back = back.select("kind", F.shiftright("part", shift - fine).alias("part"), F.col("owner").alias("batch"), F.col("part").alias("fine_part"), "n", "bits")
    return held.groupBy(*group).cogroup(back.groupBy(*group)).applyInArrow(spread, ANSWER)


def _chunk(table: pa.Table, width: int) -> tuple[Windows, list]:
    ids = table.column("doc_id").to_pylist()
    return Windows(table.column("text").to_pylist(), ids, width), ids


class _Exact:
    """A chunk's candidate windows: distinct hash pairs in order, with the smallest doc_id and each window's place."""

    def __init__(self, windows: Windows, answers: pa.Table, depth: int, bits: int):
        candidate = np.ones(len(windows.start), bool)
        for row, cells in enumerate(windows.cells(depth, bits)):
            distinct, place = np.unique(cells, return_inverse=True)
            repeated = _flags(_answers(answers, row))
            candidate &= repeated[place] if len(distinct) else candidate
        self.at = np.flatnonzero(candidate)
        pairs = np.stack([windows.high[self.at], windows.low[self.at]], 1)
        self.keys, self.doc, self.group = _Hashes().fold(pairs, windows.doc[self.at])


def _deal(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_id, text binary, n_bytes), written bucketed by chunk."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches):
            texts, chunks = raw_texts(batch.column(1)), []
            for t in texts:
                size = len(t or b"") + 64
                if held and held + size > chunk_bytes:
                    chunk, held = chunk + 1, 0
                held += size
                chunks.append(chunk)
            sizes = pa.array([len(t or b"") for t in texts], pa.int64())
            arrays = [pa.array(chunks, pa.int64()), batch.column(0).cast(pa.int64()), pa.array(texts, pa.binary()), sizes]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "doc_id", "text", "n_bytes"])

    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    dealt = plain.mapInArrow(number, "chunk long, doc_id long, text binary, n_bytes long")
    buckets = max(1, min(MOST_BUCKETS, plain.rdd.getNumPartitions()))
    name = f"chunks_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)

    def drop() -> None:  # the files go with the shared folder; a catalog that outlives the session keeps no entry either
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)
    return spark.table(name)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES,
    depth: int = DEPTH,
    block_bits: int = BLOCK_BITS,
    cell_bits: int | None = None,
    most_bits: int = MOST_BITS,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per row of ``docs``.

    Words are runs of other than ASCII white space; a window is ``width`` consecutive words of one document. Words
    covered by a window whose words also start in a document with a smaller doc_id go; ``kept`` joins the others by
    one space. Windows are judged on the input. A null text has no words; a document without an id neither loses
    words nor makes others lose them; equal ids are not smaller than each other, so repeated rows keep their words;
    an empty table gives no row; extra columns are ignored.
    """
    chunks = _deal(docs, id_col, text_col, chunk_bytes)
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = cell_bits or max(16, min(60, int(size).bit_length()))  # about eight cells for each window
    shift, fine = _shifts(bits, bits - block_bits, most_bits)
    exact_shift, exact_fine = _shifts(64, (size // 6 // group_windows).bit_length(), most_bits)
    batches = 1 + size // (chunk_bytes << most_bits)
    texts = chunks.select("chunk", "doc_id", "text")
    cells_codec, hashes_codec = _Cells(), _Hashes()

    def sketch(table: pa.Table) -> pa.Table:
        windows, _ = _chunk(table, width)
        chunk = table.column("chunk")[0].as_py()
        rows = []
        for row, cells in enumerate(windows.cells(depth, bits)):
            distinct, count = np.unique(cells, return_counts=True)
            rows += _messages(cells_codec, row, chunk, shift, distinct, count)
        return _table(rows, MESSAGE)

    def candidates(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], MESSAGE)
        exact = _Exact(_chunk(table, width)[0], answers, depth, bits)
        chunk = table.column("chunk")[0].as_py()
        return _table(list(_messages(hashes_codec, -1, chunk, exact_shift, exact.keys, exact.doc)), MESSAGE)

    def apply(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * 4, schema=_schema(RESULT))
        windows, ids = _chunk(table, width)
        exact = _Exact(windows, answers, depth, bits)
        earlier = _flags(_answers(answers, -1))
        covered = np.zeros(sum(map(len, windows.words)) + width + 1, np.int64)
        if len(exact.at):
            gone = earlier[exact.group] | (windows.doc[exact.at] > exact.doc[exact.group])
            starts = windows.start[exact.at[gone]]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + width, -1)
        drop = np.cumsum(covered) > 0
        rows = []
        for i, words, first in zip(ids, windows.words, windows.first.tolist()):
            out = drop[first : first + len(words)]
            kept = [w for w, o in zip(words, out.tolist()) if not o] if out.any() else words
            rows.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pa.table(list(zip(*rows)), schema=_schema(RESULT))

    cells = texts.groupBy("chunk").applyInArrow(sketch, MESSAGE)
    repeated = materialize(exchange(cells, cells_codec, shift, fine, batches), "repeated").withColumnRenamed("owner", "chunk")
    by_chunk = texts.groupBy("chunk")
    asked = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(candidates, MESSAGE)
    earlier = materialize(exchange(asked, hashes_codec, exact_shift, exact_fine, batches), "earlier").withColumnRenamed("owner", "chunk")
    answers = repeated.unionByName(earlier)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(apply, RESULT)


def _shifts(width: int, wanted: int, most: int) -> tuple[int, int]:
    """By how much keys of ``width`` bits are shifted for coarse and fine parts, of which 2 ** ``wanted`` are needed."""
    wanted = min(max(0, wanted), 2 * most)
    return width - min(wanted, most), width - wanted


MESSAGE = "kind int, part long, owner long, n int, data binary, more binary"
ANSWER = "kind int, part long, owner long, n int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])
