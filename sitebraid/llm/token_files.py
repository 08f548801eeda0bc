"""Token-id files with directly addressable codes: any token can be read without decoding a block.

An id is split into chunks of a fixed number of bits, least significant first. Level 0 holds the first
chunk of every id, level k the k-th chunk of those ids that need more than k chunks. A bitmap beside each
level says which of its entries continue; a rank directory over the bitmap (one count each 512 bits) turns
an entry's place on one level into its place on the next. Reading token i takes one lookup a level.

Files are Parquet tables in the shared folder (any store that Spark can write); a row is one segment of
at most SEGMENT_TOKENS ids with its levels, bitmaps, directories and the documents that lie in it.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, id_and_text, new_path, ranged, ranges_of, slices
from .subwords import encoder

#: Bits of a chunk on each level; 8 + 8 + 8 + 8 covers unsigned 32-bit ids.
CHUNK_BITS = 8
#: Bits between two counts of a rank directory.
RANK_EVERY = 512
#: Most ids in a segment; a longer document goes on in the next one.
SEGMENT_TOKENS = 1 << 19
#: The end id that closes each document.
END_ID = 2

SEGMENTS = "range int, segment int, n_tokens long, codes binary, doc_ids array<long>, doc_tokens array<long>, doc_opens array<boolean>"


def pack(ids: np.ndarray) -> bytes:
    """The codes of a segment: a count, then for each level its size, chunks, bitmap and rank directory."""
    rest, levels = ids.astype("<u4", copy=False), []
    while True:
        more = rest >= 1 << CHUNK_BITS
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype="<u4") if len(more) else np.zeros(0, "<u4")
        ranks = np.cumsum(counts, dtype="<u4") - counts
        levels.append(struct.pack("<I", len(rest)) + (rest & ((1 << CHUNK_BITS) - 1)).astype("u1").tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return struct.pack("<B", len(levels)) + b"".join(levels)


class Segment:
    """Random access into packed codes."""

    def __init__(self, codes: bytes):
        self.levels, at = [], 1
        for _ in range(codes[0]):
            (n,) = struct.unpack_from("<I", codes, at)
            at += 4
            chunks = np.frombuffer(codes, "u1", n, at)
            at += n
            bits = np.frombuffer(codes, "u1", -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(codes, "<u4", -(-n // RANK_EVERY), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """Token i, by one place on each level."""
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_EVERY
            inside = np.unpackbits(bits[block * RANK_EVERY // 8 : i // 8 + 1], bitorder="little")[: i - block * RANK_EVERY]
            i, shift = int(ranks[block]) + int(inside.sum()), shift + CHUNK_BITS
        raise ValueError("a code continues past its last level")

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop; only what they need of each level is touched."""
        out = np.zeros(max(0, stop - start), "<u4")
        places, shift = np.arange(len(out)), 0
        for chunks, bits, ranks in self.levels:
            out[places] |= chunks[start:stop].astype("<u4") << np.uint32(shift)
            if not len(places):
                break
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            block = start // RANK_EVERY
            before = int(np.unpackbits(bits[block * RANK_EVERY // 8 : start // 8 + 1], bitorder="little")[: start - block * RANK_EVERY].sum()) if block < len(ranks) else 0
            start = (int(ranks[block]) if block < len(ranks) else 0) + before
            stop, places, shift = start + int(more.sum()), places[more], shift + CHUNK_BITS
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts, end_id after each, and writes segments in ascending doc_id order to path.

    Null texts count as empty; null ids come first; rows of one id are ordered by text (by a hash of it and
    then the text where an id has so many rows that they fill several ranges). One shuffle, of the texts by
    range of doc_id; each task then streams its sorted rows into segments.
    """
    texts = id_and_text(docs, id_col, text_col)
    ranges = ranges_of(texts.select("doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.asarray([end_id], "<u4")
        held, ids, counts, opens, size, number, part = [], [], [], [], 0, 0, None

        def flush():
            nonlocal held, ids, counts, opens, size, number
            row = {"range": [part], "segment": [number], "n_tokens": [size], "codes": [pack(np.concatenate(held))], "doc_ids": [ids], "doc_tokens": [counts], "doc_opens": [opens]}
            held, ids, counts, opens, size, number = [], [], [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row, schema=SEGMENT_ARROW)

        for batch in slices(batches):
            part = column(batch, "range")[0].as_py()
            for doc, packed in zip(column(batch, "doc_id").to_pylist(), coder.encode(column(batch, "text").to_pylist()), strict=True):
                tokens, at = np.concatenate([np.frombuffer(packed, "<u4"), end]), 0
                while at < len(tokens):
                    piece = tokens[at : at + SEGMENT_TOKENS - size]
                    held.append(piece)
                    ids.append(doc)
                    counts.append(len(piece))
                    opens.append(at == 0)
                    at, size = at + len(piece), size + len(piece)
                    if size == SEGMENT_TOKENS:
                        yield flush()
        if size:
            yield flush()

    dealt = ranged(texts, ranges).repartitionById(ranges.n, F.col("range")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text")
    dealt.select("range", "doc_id", "text").mapInArrow(run, SEGMENTS).write.parquet(path)


SEGMENT_ARROW = pa.schema([("range", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("codes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("doc_opens", pa.list_(pa.bool_()))])

PARTS = "range int, segment int, doc_id long, opens boolean, at long, n long, crc long, bytes long"


def read_documents(spark, path: str) -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids_crc32.

    Segments are decoded where they are read. A document that spans segments is put together from the
    checksums of its parts, so no task needs more than a segment.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # starts: tokens of earlier ranges, then of earlier segments of the range; one row a range is windowed alone
    totals = segments.groupBy("range").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.select("range", (F.sum("tokens").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    starts = segments.select("range", "segment", "n_tokens").join(F.broadcast(before), "range")  # at most MOST_RANGES rows
    starts = starts.select("range", "segment", (F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(W.partitionBy("range").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment, at = Segment(row["codes"]), 0
                out = {k: [] for k in ("range", "segment", "doc_id", "opens", "at", "n", "crc", "bytes")}
                for doc, n, opens in zip(row["doc_ids"], row["doc_tokens"], row["doc_opens"], strict=True):
                    data = segment.tokens(at, at + n).tobytes()
                    for k, v in zip(out, (row["range"], row["segment"], doc, opens, at, n, zlib.crc32(data), len(data)), strict=True):
                        out[k].append(v)
                    at += n
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("range", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("opens", pa.bool_()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("bytes", pa.int64())]))

    parts = segments.select("range", "segment", "codes", "doc_ids", "doc_tokens", "doc_opens").mapInArrow(run, PARTS)
    placed = parts.join(starts, ["range", "segment"]).withColumn("start", F.col("base") + F.col("at"))
    # a part that doesn't open a document belongs to the document before it in its range
    own = W.partitionBy("range").orderBy("start")
    numbered = placed.withColumn("doc", F.sum(F.col("opens").cast("int")).over(own))
    whole = numbered.groupBy("range", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "crc", "bytes"))).alias("crcs"))
    return whole.select("doc_id", "start", "n_tokens", joined_crc("crcs.crc", "crcs.bytes").alias("ids_crc32"))


def crc_join(first: int, second: int, length: int) -> int:
    """The checksum of two byte strings in a row, from theirs and the second's length (powers of the shift by one zero byte)."""
    def apply(matrix, value):
        out, k = 0, 0
        while value:
            if value & 1:
                out ^= matrix[k]
            value >>= 1
            k += 1
        return out

    shift = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):  # squared thrice: one zero byte
        shift = [apply(shift, x) for x in shift]
    while length:
        if length & 1:
            first = apply(shift, first)
        shift = [apply(shift, x) for x in shift]
        length >>= 1
    return first ^ second


@F.pandas_udf(T.LongType())
def joined_crc(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    def one(values, lengths):
        total = int(values[0])
        for value, length in zip(values[1:], lengths[1:], strict=True):
            total = crc_join(total, int(value), int(length))
        return total

    return pd.Series([one(c, n) for c, n in zip(crcs, sizes, strict=True)], dtype="int64")


def encode_write_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files of docs to a new folder under the shared one and reads them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
