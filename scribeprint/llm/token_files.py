"""Token ids in binary files: patched frame-of-reference blocks.

A file is a run of chunks, a chunk holds the ids of consecutive documents in blocks of ``BLOCK`` ids. Of a block the
least id is taken away, the rest is packed in as many bits as ``PERCENTILE`` percent of them need, and the others are
exceptions: their places, and their values in full. Long documents go on in the next chunk, so a chunk is bounded
whatever its documents are. A chunk, all numbers little-endian::

    "PFR1", version u32, bytes behind this field u64
    shard u32, chunk u32 (its number in the shard), documents u32, ids u32, blocks u32
    documents: id i64, count u32 (ids in this chunk), first chunk u32 (where the document begins),
               flags u32 (1 goes on in the next chunk, 2 comes from the one before, 4 has no id)
    block starts: u32 each, from the first block, and one more for the end
    blocks: least id u32, bits u8, zero u8, exceptions u16, their places u16 each and values u32 each, packed rest

and a line feed, which is where Spark's writer ends a row. Documents are in ascending order of their ids: ids are made
where the texts are, the rows with ids (not texts) are dealt out by ranges of the document id, and a range is a shard.
Where a document starts among all ids follows from the sums of the chunks before it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeprint.llm.scratch import as_text, folder, importable, map_rows, written
from scribeprint.llm.words import POWERS, PIECE_BYTES, fold_values, mix, runs, text_buffers

END_ID = 2
BLOCK, PERCENTILE = 1024, 95
#: Ids of a chunk, of a shard (a task's share), and chunks of a file.
CHUNK_IDS, SHARD_IDS, FILE_CHUNKS = 1 << 17, 1 << 23, 64
#: Distinct words whose ids a worker keeps, and words that are encoded in one call.
CACHE_WORDS, CALL_WORDS = 800_000, 4_096
#: Rows of a batch that are encoded before their ids are handed on.
ROWS = 1_024
MAGIC = b"PFR1"
_HEAD, _SIZES = struct.Struct("<4sIQ"), struct.Struct("<5I")
_DOCUMENT = np.dtype([("id", "<i8"), ("count", "<u4"), ("first", "<u4"), ("flags", "<u4")])
GOES_ON, COMES_ON, NO_ID = 1, 2, 4


def _kinds() -> np.ndarray:
    """For each byte: 0 white space, 1 a letter, 2 a mark, 3 anything else."""
    kinds = np.full(256, 3, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[[*range(65, 91), *range(97, 123)]] = 1
    kinds[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|"]] = 2
    return kinds


KINDS = _kinds()


class WordIds:
    """Ids of many texts at a time, each distinct word encoded once.

    For tokenizers that compose characters, drop white space, lower-case, and cut letters from marks: then white space
    and places between an ASCII letter and an ASCII mark always cut, but for apostrophes and in special
    strings (``<|``), and A-Z are as a-z. Words with ``<`` stay as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.first = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.length, self.ids = np.empty(0, np.int64), np.empty(0, np.uint32)

    def _learn(self, hashes: np.ndarray, names: list[str]) -> None:
        length, parts = np.empty(len(names), np.int64), [self.ids]
        for k in range(0, len(names), CALL_WORDS):
            found = [e.ids for e in self.encode(names[k:k + CALL_WORDS], add_special_tokens=False)]
            length[k:k + len(found)] = [len(ids) for ids in found]
            parts.append(np.array(list(chain.from_iterable(found)), np.uint32))
        first = len(self.ids) + np.cumsum(length) - length
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first, self.length = np.insert(self.first, at, first), np.insert(self.length, at, length)
        self.ids = np.concatenate(parts)

    def _words(self, data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words of data[own[0]:own[-1]] start and end, and their hashes. None goes over the end of a row."""
        base = int(own[0])
        kind = KINDS[data[base:own[-1]]]
        before = np.concatenate([[np.uint8(0)], kind[:-1]])
        before[own[:-1][own[1:] > own[:-1]] - base] = 0
        cut = (before == 0) | ((kind == 1) & (before == 2)) | ((kind == 2) & (before == 1))
        start = np.flatnonzero((kind > 0) & cut)
        # A word ends where the next one starts or white space does.
        stops = np.append(((kind == 0) & (before > 0)) | ((kind > 0) & cut), True)
        stops[own[1:] - base] = True
        stop = np.flatnonzero(stops)
        end = stop[np.searchsorted(stop, start, side="right")]
        up, down = POWERS.upto(len(kind) + 1)
        sums = np.zeros(len(kind) + 1, np.uint64)
        np.cumsum(fold_values(True)[data[base:own[-1]]] * up[:-1], out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * down[start])
        special = np.flatnonzero(data[base:own[-1]] == ord("<"))
        if len(special):
            mine = np.unique(np.searchsorted(start, special, side="right") - 1)
            np.cumsum(fold_values(False)[data[base:own[-1]]] * up[:-1], out=sums[1:])
            hashes[mine] = mix((sums[end[mine]] - sums[start[mine]]) * down[start[mine]] + np.uint64(1))
        return start + base, end + base, hashes

    def _ids(self, data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows, and where those of each row end."""
        if own[-1] == own[0]:
            return np.empty(0, np.uint32), np.zeros(len(own), np.int64)
        start, end, hashes = self._words(data, own)
        distinct, sample, each = np.unique(hashes, return_index=True, return_inverse=True)

        def new() -> np.ndarray:
            at = np.searchsorted(self.hashes, distinct)
            known = at < len(self.hashes)
            known[known] = self.hashes[at[known]] == distinct[known]
            return np.flatnonzero(~known)

        if len(self.hashes) + len(unknown := new()) > CACHE_WORDS:
            self.forget()
            unknown = new()
        if len(unknown):
            text = data.data
            self._learn(distinct[unknown], [str(text[a:b], "utf-8") for a, b in zip(
                start[sample[unknown]].tolist(), end[sample[unknown]].tolist())])
        at = np.searchsorted(self.hashes, distinct)[each]
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.ids[runs(self.first[at], length)], ends[np.searchsorted(start, own)]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty. Texts are taken in pieces of about a megabyte; a long one is cut at
        white space."""
        data, offsets = text_buffers(column)
        low = 0
        while low < len(column):
            high = int(np.searchsorted(offsets, offsets[low] + PIECE_BYTES, side="right")) - 1
            high = min(max(high, low + 1), len(column))
            own = offsets[low:high + 1]
            if own[-1] - own[0] > PIECE_BYTES:
                yield self._long(data, int(own[0]), int(own[1]))
            else:
                ids, ends = self._ids(data, own)
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    yield ids[a:b]
            low = high

    def _long(self, data: np.ndarray, low: int, high: int) -> np.ndarray:
        parts = []
        while low < high:
            cut = min(low + PIECE_BYTES, high)
            while cut < high and KINDS[data[cut]]:
                gaps = np.flatnonzero(KINDS[data[cut:cut + PIECE_BYTES]] == 0)
                cut = cut + int(gaps[0]) if len(gaps) else min(cut + PIECE_BYTES, high)
            parts.append(self._ids(data, np.array([low, cut]))[0])
            low = cut
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """Read once in a worker."""
    return WordIds(path)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
            end_id: int = END_ID) -> DataFrame:
    """``id, n_tokens, ids`` (see ``_stored``) of every document, with the end id."""
    plain = docs.select(as_text(text).alias("text"), F.col(doc_id).cast("long").alias("id"))

    def run(batches, arrow):
        own = word_ids(path)
        for batch in batches:
            for low in range(0, len(batch), ROWS):  # what is made of a batch is not held all at once
                part = batch.slice(low, ROWS)
                sizes, stored = [], []
                for ids in own.texts(part.column(0)):
                    sizes.append(len(ids) + 1)
                    stored.append(_stored(np.append(ids, np.uint32(end_id))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], schema=arrow)
            del batch, part
            pa.default_memory_pool().release_unused()

    return map_rows(plain, run, T.StructType.fromDDL("id long, n_tokens long, ids binary"))


_CODEC = pa.Codec("zstd", compression_level=1)


def _stored(ids: np.ndarray) -> bytes:
    """Ids as they are moved: width of an id, bytes, and the ids in two or four bytes each, compressed."""
    data = ids.astype("<u4" if int(ids.max()) >= 1 << 16 else "<u2")
    return struct.pack("<BI", data.itemsize, data.nbytes) + _CODEC.compress(data.tobytes(), asbytes=True)


def _unstored(data: pa.Buffer) -> np.ndarray:
    width, size = struct.unpack_from("<BI", data)
    return np.frombuffer(_CODEC.decompress(data[5:], size), f"<u{width}").astype(np.uint32)


def pack_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A block of at most 65,535 ids."""
    least = ids.min()
    rest = (ids - least).astype("<u4")
    at = -(-percentile * (len(rest) - 1) // 100)
    width = int(np.partition(rest, at)[at]).bit_length()
    places = np.flatnonzero(rest.astype(np.uint64) >> np.uint64(width))
    values = rest[places].tobytes()
    rest[places] = 0
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return b"".join((struct.pack("<IBBH", int(least), width, 0, len(places)), places.astype("<u2").tobytes(), values,
                     np.packbits(bits, bitorder="little").tobytes()))


def unpack_block(data: memoryview, count: int) -> np.ndarray:
    least, width, _, n = struct.unpack_from("<IBBH", data)
    places = np.frombuffer(data, "<u2", n, 8)
    values = np.frombuffer(data, "<u4", n, 8 + 2 * n)
    bits = np.zeros((count, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 6 * n), count=count * width,
                                    bitorder="little").reshape(count, width)
    rest = np.packbits(bits, axis=1, bitorder="little").view("<u4")[:, 0].astype(np.uint32)
    rest[places] = values
    return rest + np.uint32(least)


def pack_chunk(shard: int, chunk: int, documents: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = [pack_block(ids[k:k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u4")
    body = b"".join((_SIZES.pack(shard, chunk, len(documents), len(ids), len(blocks)), documents.tobytes(),
                     starts.tobytes(), *blocks))
    return _HEAD.pack(MAGIC, 1, len(body)) + body


def read_chunk(body: memoryview) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Shard, number, documents and ids of a chunk."""
    shard, chunk, n_docs, n_ids, n_blocks = _SIZES.unpack_from(body)
    at = _SIZES.size
    documents = np.frombuffer(body, _DOCUMENT, n_docs, at)
    at += documents.nbytes
    starts = np.frombuffer(body, "<u4", n_blocks + 1, at).astype(np.int64) + at + 4 * (n_blocks + 1)
    blocks = [unpack_block(body[a:b], min(BLOCK, n_ids - k * BLOCK))
              for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist()))]
    return shard, chunk, documents, np.concatenate(blocks) if blocks else np.empty(0, np.uint32)


def read_block(body: memoryview, number: int) -> np.ndarray:
    """One block of a chunk, found by the block starts; nothing else is unpacked."""
    _, _, n_docs, n_ids, n_blocks = _SIZES.unpack_from(body)
    at = _SIZES.size + n_docs * _DOCUMENT.itemsize
    a, b = np.frombuffer(body, "<u4", 2, at + 4 * number).tolist()
    base = at + 4 * (n_blocks + 1)
    return unpack_block(body[base + a:base + b], min(BLOCK, n_ids - number * BLOCK))


def chunks_of(data: bytes | memoryview) -> Iterator[memoryview]:
    """Bodies of the chunks of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        magic, version, size = _HEAD.unpack_from(data, at)
        if magic != MAGIC or version != 1:
            raise ValueError(f"no chunk of token ids at byte {at}")
        at += _HEAD.size
        yield view[at:at + size]
        at += size + 1
        if bytes(view[at - 1:at]) != b"\n":
            raise ValueError(f"the chunk before byte {at} does not end where its length says")


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, chunk_ids: int):
    """Input: shard, id and packed ids, in order. Output: chunks."""
    documents, parts, held, chunk, shard = [], [], 0, 0, 0

    def closed():
        nonlocal documents, parts, held, chunk
        row = pack_chunk(shard, chunk, np.array(documents, _DOCUMENT), np.concatenate(parts))
        documents, parts, held, chunk = [], [], 0, chunk + 1
        return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], schema=schema)

    for batch in batches:
        for number, doc_id, data in zip(*batch.columns):
            shard, doc_id = number.as_py(), doc_id.as_py()
            ids, first, at = _unstored(data.as_buffer()), chunk, 0
            while at < len(ids):
                part = ids[at:at + chunk_ids - held]
                flags = (GOES_ON * (at + len(part) < len(ids)) | COMES_ON * (at > 0) | NO_ID * (doc_id is None))
                documents.append((doc_id or 0, len(part), first, flags))
                parts.append(part)
                held += len(part)
                at += len(part)
                if held == chunk_ids:
                    yield closed()
    if held:
        yield closed()


def write_files(tokens: DataFrame, path: str, chunk_ids: int = CHUNK_IDS, shard_ids: int = SHARD_IDS,
                file_chunks: int = FILE_CHUNKS) -> str:
    """Files of all rows of ``encoded`` in ascending order of ids; null ids come first.

    Rows of one id are cut between shards like others, by a number of their own.
    """
    tokens = written(tokens.withColumn("row", F.monotonically_increasing_id()), "token-ids")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    ranged = (tokens.repartitionByRange(max(1, -(-total // shard_ids)), "id", "row").sortWithinPartitions("id", "row")
              .select(F.spark_partition_id().alias("shard"), "id", "ids"))
    chunks = map_rows(ranged, lambda b, arrow: _cut(b, arrow, chunk_ids), T.StructType.fromDDL("chunk binary"))
    (chunks.select(F.col("chunk").cast("string")).write.option("lineSep", "\n").option("compression", "none")
     .option("maxRecordsPerFile", file_chunks).text(path))
    return path


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all chunks, by chunk: ``before`` counts ids of the chunk before the piece, ``crc`` is its own.

    ``n_ids`` is the chunk's on its first row and 0 on the others, so that sums count chunks once.
    """
    importable(spark)
    schema = T.StructType.fromDDL("shard long, chunk long, id long, first long, flags long, before long, count long, "
                                  "crc long, n_ids long")

    def run(batches, arrow):
        for batch in batches:
            for content in batch.column(0):
                for body in chunks_of(memoryview(content.as_buffer())):
                    shard, chunk, documents, ids = read_chunk(body)
                    count, n = documents["count"].astype(np.int64), len(documents)
                    ends = np.cumsum(count)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for c, e in zip(count.tolist(), ends.tolist())]
                    flags = documents["flags"].astype(np.int64)
                    sizes = np.zeros(n, np.int64)
                    sizes[:1] = len(ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, shard)), pa.array(np.full(n, chunk)),
                        pa.array(documents["id"].astype(np.int64), mask=(flags & NO_ID) > 0),
                        pa.array(documents["first"].astype(np.int64)), pa.array(flags), pa.array(ends - count),
                        pa.array(count), pa.array(crc, pa.int64()), pa.array(sizes)], schema=arrow)

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_rows(files, run, schema)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a sequence from those of its parts: (crc, bytes). A CRC runs on linearly in the bits it starts with."""
    crc = 0
    for own, size in parts:
        ahead = before = None
        while size or ahead is None:
            zeros = bytes(min(size, 1 << 20))
            ahead = zlib.crc32(zeros, crc if ahead is None else ahead)
            before = zlib.crc32(zeros, 0 if before is None else before)
            size -= len(zeros)
        crc = ahead ^ before ^ own
    return crc


def _merge(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """Input: pieces of documents that go over chunks, as lists of (chunk, count, crc) in order."""
    for batch in batches:
        crc = [joined_crc([(p["crc"], 4 * p["count"]) for p in parts]) for parts in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], schema=schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in files of ``write_files``."""
    pieces = written(read_pieces(spark, path), "token-pieces")
    chunks = pieces.filter("n_ids > 0").select("shard", "chunk", "n_ids")
    in_shard = Window.partitionBy("shard").orderBy("chunk")
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("all_"))  # one row a shard: a task's work in writing
    shards = shards.select("shard", (F.sum("all_").over(Window.orderBy("shard")) - F.col("all_")).alias("base"))
    begins = (chunks.join(shards, "shard")
              .select("shard", "chunk", (F.col("base") + F.sum("n_ids").over(in_shard) - F.col("n_ids")).alias("begin")))
    placed = pieces.join(begins, ["shard", "chunk"]).withColumn("start", F.col("begin") + F.col("before"))
    whole = F.col("flags").bitwiseAND(F.lit(GOES_ON | COMES_ON)) == 0
    names = [F.col("id").alias("doc_id"), "start"]
    parts = (placed.filter(~whole).groupBy("shard", "first", "id")
             .agg(F.min("start").alias("start"), F.sum("count").alias("n_tokens"),
                  F.array_sort(F.collect_list(F.struct("chunk", "count", "crc"))).alias("parts")))
    merged = map_rows(parts.select(*names, "n_tokens", "parts"), _merge,
                      T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long"))
    return placed.filter(whole).select(*names, F.col("count").alias("n_tokens"),
                                       F.col("crc").alias("ids_crc32")).unionByName(merged)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
               **sizes: int) -> DataFrame:
    """Encodes ``docs`` with the file ``path`` of the ``tokenizers`` library, writes token files and reads them back.

    ``doc_id, start, n_tokens, ids_crc32`` of every document, from the files. Null and empty texts have the
    end id only. Texts of any length are encoded whole. Null ids come first; rows of one id are documents of their
    own and follow each other in no set order. An empty table gives an empty result. Only the id and the text are
    read of ``docs``, so other columns may have any name. ``sizes``: those of ``write_files``.
    """
    spark = docs.sparkSession
    return read_documents(spark, write_files(encoded(docs, path, doc_id, text, end_id), folder(spark, "tokens"), **sizes))
