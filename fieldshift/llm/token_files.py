"""Token ids in Parquet list columns: written in document order, read back by column, row group and page.

Documents are sorted by range before they are encoded, so that ids are never shuffled. Each file holds one range of
documents; row groups and pages are small and carry column and offset indexes, so a reader fetches the metadata or the
ids of a few documents without the rest. Ids are dictionary-coded (or delta-coded, for large vocabularies).
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import map_documents, scratch_path

END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 1000
#: Most documents and bytes of text that are encoded at once.
ROWS, BYTES = 4096, 8 << 20
#: Words and word pieces that each of a worker's two generations remembers.
REMEMBERED = 300_000

#: Texts of these characters are in composed form and lower-cased character by character.
_PLAIN = regex.compile(r"[\x21-\x7e\xc0-\xff]*")


class WordEncoder(dict):
    """A tokenizer's ids of whole texts, word by word, each distinct word or piece of one being encoded once.

    It holds for tokenizers that drop white space and merge within pre-tokens only, as the file's own pre-tokenizer
    tells; ``pieces`` is its pattern, by which words of plain characters are cut. Other words go to the library whole.
    The mapping itself is the younger generation of what is remembered, words and pieces alike.
    """

    def __init__(self, serialized: str, pieces: str, remembered: int = REMEMBERED):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(serialized)
        self.tokenize = self.tokenizer.model.tokenize
        self.cut = regex.compile(pieces).findall
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How the model spells bytes.
        self.spelling = {ord(c): "".join(p for p, _ in spell(c)) for c in map(chr, [*range(33, 127), *range(192, 256)])}
        self.remembered, self.old = remembered, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode(word)
        self[word] = ids
        return ids

    def _encode(self, word: bytes) -> bytes:
        if word.isalpha():  # of ASCII letters
            low = word.lower()
            return self._merge(low.decode()) if low == word else self[low]
        text = word.decode()
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = self.cut(text.lower())
        if len(pieces) == 1 and pieces[0] == text:
            return self._merge(text.translate(self.spelling))
        return b"".join([self[p.encode()] for p in pieces])

    def _merge(self, spelt: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelt)])

    def encode_all(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text (null: empty) and the end id. Words are looked up once for all texts."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        distinct = words.flatten().dictionary_encode()
        found = list(map(self.__getitem__, distinct.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        known = pa.ListArray.from_arrays(_offsets(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
        ids = known.take(distinct.indices)
        ends = ids.offsets.to_numpy()[words.offsets.to_numpy()[1:]]
        values = np.insert(ids.values.to_numpy(), ends, end_id)
        if len(self) >= self.remembered:
            self.old = dict(self)
            self.clear()
        return pa.ListArray.from_arrays(_offsets(ends + np.arange(1, len(ends) + 1)), pa.array(values))


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], ends]).astype(np.int32))


_encoders: dict[int, WordEncoder] = {}


def _encoder(serialized: str, pieces: str) -> WordEncoder:
    key = hash((serialized, pieces))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(serialized, pieces)
    return _encoders[key]


def _pattern(serialized: str) -> str:
    import json

    steps = json.loads(serialized)["pre_tokenizer"]["pretokenizers"]
    return next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")


def encode_sorted(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """(part, local_start, doc_id, n_tokens, ids array): whole texts by the tokenizers library, and the end id.

    Rows are in ascending doc_id order, nulls first, ties by text hash (so one frequent id may lie in many parts);
    ``part`` numbers the ranges and local_start counts the ids before the row in its part.
    """
    with open(tokenizer, encoding="utf-8") as file:
        serialized = file.read()
    pattern = _pattern(serialized)
    shared = docs.sparkSession.sparkContext.broadcast(serialized)
    tie = F.xxhash64("text")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = plain.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def make():
        encoder, part, total = _encoder(shared.value, pattern), TaskContext.get().partitionId(), 0

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal total
            lists = encoder.encode_all(batch.column(1), end_id)
            ends = lists.offsets.to_numpy()[1:].astype(np.int64)
            counts = np.diff(ends, prepend=0)
            parts = pa.array(np.full(len(ends), part, np.int32))
            starts = pa.array(total + ends - counts)
            total += int(ends[-1])
            return pa.RecordBatch.from_arrays([parts, starts, batch.column(0), pa.array(counts), lists], list(_FIELDS))

        return apply

    return map_documents(ordered, ["doc_id", "text"], ", ".join(f"{n} {t}" for n, t in _FIELDS.items()), make, ROWS, BYTES)


_FIELDS = {"part": "int", "local_start": "long", "doc_id": "long", "n_tokens": "long", "ids": "array<int>"}


def write(encoded: DataFrame, path: str, encoding: str = "dictionary") -> None:
    """Write the rows of :func:`encode_sorted`; ``encoding`` of ids is "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    options = {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }
    encoded.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before.

    ``where`` may name doc_id, part and n_tokens and reaches the page indexes; without ``ids`` their pages aren't read.
    """
    schema = ", ".join(f"{n} {t}" for n, t in _FIELDS.items() if ids or n != "ids")
    rows = spark.read.schema(schema).parquet(path)
    sizes = spark.read.schema("part int, n_tokens long").parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # one row per file, so this is no gathering of documents
    totals = [(r.part, r["size"]) for r in sizes.orderBy("part").toLocalIterator()]
    before, offsets = 0, []
    for part, size in totals:
        offsets.append((part, before))
        before += size
    bases = spark.createDataFrame(offsets, "part int, base long")
    chosen = rows if where is None else rows.where(where)
    return chosen.join(F.broadcast(bases) if len(offsets) <= 100_000 else bases, "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *(["ids"] if ids else [])
    )


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back, n_tokens being counted in the ids themselves."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(2)
            values = lists.flatten().to_numpy().astype("<u4")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends - counts, ends)]
            arrays = [batch.column(0), batch.column(1), pa.array(counts), pa.array(crcs, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

        return apply

    return map_documents(stored, ["doc_id", "start", "ids"], "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def store(docs: DataFrame, tokenizer: str, path: str | None = None, encoding: str = "dictionary") -> DataFrame:
    """Encode ``docs``, write the files and read them back as (doc_id, start, n_tokens, ids).

    A null or empty text has the end id alone. Null ids come first, equal ids go by text hash, repeated rows stay; an
    empty table writes and reads no row; extra columns are ignored.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write(encode_sorted(docs, tokenizer), path, encoding)
    return read(docs.sparkSession, path)
