"""Token ids in patched frame-of-reference blocks, written in order and read back.

A segment is one self-contained binary value, little-endian:

    magic, values per block, documents, ids, blocks
    document ids, flags of NULL ids, ids per document
    where each block starts in the body, counted in bytes
    per block: minimum, bit width, number of exceptions,
               packed differences, places of exceptions, their differences

Differences to the block's minimum are packed at a width that holds a given
share of them; the rest are exceptions, packed as zero and listed in full. Every
segment tells where each block starts, so ids can be read from the middle.
Segments are rows of a Parquet table, so any store that Spark writes will do, and
a lost task is written again as a whole.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from array import array
from collections.abc import Iterator
from string import punctuation
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import col, kept_in_worker, ship_package

MAGIC = b"TWPFOR1\0"
BLOCK = 512
SHARE = 0.9
SEGMENT_IDS = 1 << 20
MEMO_LIMIT = 900_000
BATCH_BYTES = 4 << 20
HEAD = struct.Struct("<8sIIQI")


def pack(values: np.ndarray, block: int = BLOCK, share: float = SHARE) -> tuple[np.ndarray, bytes]:
    """Block starts and body of non-negative 32-bit values."""
    if not len(values):
        return np.zeros(0, np.uint32), b""
    padded = np.pad(values.astype(np.uint32), (0, -len(values) % block), mode="edge").reshape(-1, block)
    least = padded.min(1)
    rest = padded - least[:, None]
    rank = min(block - 1, int(share * block))
    widths = np.frexp(np.partition(rest, rank, 1)[:, rank].astype(np.float64))[1].astype(np.uint8)
    large = rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    small = np.where(large, 0, rest)
    packed: dict[int, bytes] = {}
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        bits = np.unpackbits(small[at].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        body = np.packbits(bits[:, :width].reshape(len(at), -1), axis=1, bitorder="little")
        packed.update(zip(at.tolist(), (row.tobytes() for row in body)))
    out, starts, end = [], np.empty(len(padded), np.uint32), 0
    for at in range(len(padded)):
        places = np.flatnonzero(large[at])
        piece = b"".join(
            (
                struct.pack("<IBH", int(least[at]), int(widths[at]), len(places)),
                packed[at],
                places.astype("<u2").tobytes(),
                rest[at][places].astype("<u4").tobytes(),
            )
        )
        starts[at] = end
        end += len(piece)
        out.append(piece)
    return starts, b"".join(out)


def unpack(starts: np.ndarray, body: bytes, count: int, block: int = BLOCK) -> np.ndarray:
    """The values that `pack` was given."""
    out = np.zeros((len(starts), block), np.uint32)
    raw = np.frombuffer(body, np.uint8)
    heads = [struct.unpack_from("<IBH", body, start) for start in starts.tolist()]
    widths = np.array([width for _, width, _ in heads], np.int64)
    for width in np.unique(widths):
        if not width:
            continue
        at = np.flatnonzero(widths == width)
        size = int(width) * block // 8
        rows = raw[starts[at].astype(np.int64)[:, None] + 7 + np.arange(size)]
        bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(-1, int(width))
        whole = np.zeros((len(bits), 32), np.uint8)
        whole[:, : int(width)] = bits
        out[at] = np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(len(at), block)
    for at, (least, width, exceptions) in enumerate(heads):
        if exceptions:
            places = int(starts[at]) + 7 + width * block // 8
            where = np.frombuffer(body, "<u2", exceptions, places)
            out[at][where] = np.frombuffer(body, "<u4", exceptions, places + 2 * exceptions)
    out += np.array([least for least, _, _ in heads], np.uint32)[:, None] if heads else np.uint32(0)
    return out.reshape(-1)[:count]


def segment(doc_ids: list, ids: list[np.ndarray], block: int = BLOCK) -> bytes:
    lengths = np.array([len(x) for x in ids], "<u4")
    values = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    starts, body = pack(values, block)
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, block, len(doc_ids), len(values), len(starts))
    return b"".join((head, known.tobytes(), null.tobytes(), lengths.tobytes(), starts.astype("<u4").tobytes(), body))


def read_segment(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids."""
    magic, block, docs, count, blocks = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    known = np.frombuffer(raw, "<i8", docs, at)
    null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(raw, "<u4", blocks, at + 13 * docs)
    values = unpack(starts, raw[at + 13 * docs + 4 * blocks :], count, block)
    return [None if n else int(x) for x, n in zip(known, null)], lengths, values


# The pieces the tokenizer makes of printable ASCII in lower case.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be seen."""
    seen = [byte for byte in range(256) if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE]
    others = {byte: 256 + at for at, byte in enumerate(byte for byte in range(256) if byte not in seen)}
    return [chr(others.get(byte, byte)) for byte in range(256)]


BYTE_CHARACTERS = _byte_characters()


class WordTokens:
    """Ids of texts by a tokenizer that never joins what white space parts.

    Texts are cut at ASCII white space, and each different part of a batch is
    looked up once, among parts whose ids are remembered up to a limit. Of a part
    not met yet, the pieces are looked up in the same way where they are plain:
    those of printable ASCII, and a run of letters before ASCII punctuation, in
    lower case. Other parts are given to the library together.
    """

    def __init__(self, definition: str, memo_limit: int = MEMO_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.merges = self.library.model
        self.memo_limit = memo_limit
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other as unsigned 32-bit integers, and where each text's end. NULL is empty."""
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        occurring = parts.flatten().dictionary_encode()
        different = occurring.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded = pa.array(self._coded(different), pa.large_binary()).take(occurring.indices)
        _, offsets, values = coded.buffers()
        ends = np.frombuffer(offsets, np.int64)[parts.offsets.to_numpy()[1:]] // 4
        return np.frombuffer(values or b"", np.uint32)[: ends[-1] if len(ends) else 0], ends

    def _coded(self, parts: list[str]) -> list[bytes]:
        if len(self.memo) > self.memo_limit:
            self.memo.clear()
        found = list(map(self.memo.get, parts))
        new = [part for part, ids in zip(parts, found) if ids is None]
        if not new:
            return found
        self._learn(new)
        return list(map(self.memo.__getitem__, parts))

    def _learn(self, parts: list[str]) -> None:
        memo, wanted, piece = self.memo, [], self._piece
        for part in parts:
            word = part.rstrip(punctuation)
            if word.isascii():
                lower = part.lower()
                if word.isalpha():
                    ids = piece(lower[: len(word)])
                    memo[part] = ids + piece(lower[len(word) :]) if len(word) < len(part) else ids
                elif part.isprintable() and "<|" not in part:  # which special tokens start with
                    memo[part] = b"".join(map(piece, PIECES.findall(lower)))
                else:
                    wanted.append(part)
                continue
            lower = normalize("NFC", word).lower()
            # Two capitals whose lower case depends on what is around them, or is two characters.
            if lower.isalpha() and word.isalpha() and "Σ" not in word and "İ" not in word:
                ids = piece(lower)
                memo[part] = ids + piece(part[len(word) :]) if len(word) < len(part) else ids
            else:
                wanted.append(part)
        for part, coded in zip(wanted, self.library.encode_batch_fast(wanted, add_special_tokens=False)):
            memo[part] = array("I", coded.ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece in lower case, for which only the library's merges are left to do."""
        ids = self.memo.get(piece)
        if ids is None:
            seen = piece if piece.isascii() else "".join(map(BYTE_CHARACTERS.__getitem__, piece.encode()))
            ids = self.memo[piece] = array("I", [token.id for token in self.merges.tokenize(seen)]).tobytes()
        return ids


def _batches_of(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """`texts` in slices of up to about `most` bytes, each of one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(first, last - first)
        first = last


_SEGMENTS = "part int, seq int, part_start bigint, n_tokens bigint, payload binary"


def _writer(definition, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made = hash(definition.value), kept_in_worker("pfor")
        if key not in made:
            made[key] = WordTokens(definition.value)
        coder = made[key]
        part, seq, written, held = TaskContext.get().partitionId(), 0, 0, 0
        docs, ids = [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([written], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([segment(docs, ids)], pa.binary()),
                ],
                names=["part", "seq", "part_start", "n_tokens", "payload"],
            )

        gc.disable()  # nothing here holds cycles, and looking for some takes long
        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for texts in _batches_of(batch.column("text")):
                values, ends = coder.encode_all(texts)
                values = np.insert(values, ends, end_id)
                for coded in np.split(values, ends[:-1] + np.arange(1, len(ends))):
                    docs.append(next(doc_ids))
                    ids.append(coded)
                    held += len(coded)
                    if held >= segment_ids:
                        yield flush()
                        seq, written, held, docs, ids = seq + 1, written + held, 0, [], []
        if docs:
            yield flush()
        gc.enable()

    return run


def write_ids(
    df: DataFrame,
    path: str,
    definition: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Writes the ids of every text, each followed by `end_id`, in ascending order of `doc_id`.

    NULL ids come first, rows of one id in the order of a hash of their texts. A
    NULL or empty text has the end id only. `definition` is the content of a
    tokenizer file.
    """
    spark = df.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast(definition)
    order = ["doc_id", F.xxhash64("text")]
    docs = df.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    sorted_docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_docs.mapInArrow(_writer(shipped, end_id, segment_ids), _SEGMENTS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each segment, their ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        for part, begin, raw in zip(
            batch.column("part").to_pylist(), batch.column("part_start").to_pylist(), batch.column("payload")
        ):
            docs, lengths, values = read_segment(raw.as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            offsets = np.concatenate(([0], 4 * ends)).astype(np.int64)
            coded = pa.Array.from_buffers(
                pa.large_binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<u4", copy=False))]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(np.full(len(docs), part, np.int32)),
                    pa.array(begin + ends - lengths),
                    coded.cast(pa.binary()),
                ],
                names=["doc_id", "part", "at", "coded"],
            )


def read_coded(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `start` (ids of all documents before it), `coded` (its ids as little-endian unsigned 32-bit integers)."""
    ship_package(spark)
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task that wrote.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    rows = segments.select("part", "part_start", "payload").mapInArrow(
        _read, "doc_id bigint, part int, at bigint, coded binary"
    )
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "coded")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `start` (ids of all documents before it), `ids` of what `write_ids` wrote."""

    @F.arrow_udf("array<int>")
    def numbers(coded: pa.Array) -> pa.Array:
        lists = [np.frombuffer(own.as_py(), "<u4").view(np.int32) for own in coded]
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32)))

    return read_coded(spark, path).select("doc_id", "start", numbers("coded").alias("ids"))
