"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its s-mers is that of its first or its
last s-mer. Whether it is depends on the k-mer alone, so an unchanged passage keeps its anchors wherever
it moves. A fingerprint is the SKETCH anchors of smallest hash with their places (first occurrence), as
hexadecimal text; a text shorter than K has one anchor, the hash of all of it, and an empty text none.
Likeness is the share of common anchors among the smallest of both together (a Jaccard estimate), where a
common anchor counts only if its shift agrees with the median shift of all common ones.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_and_text, map_slices, ranged, ranges_of, slices

#: Code points of a k-mer and of its inner s-mers; anchors in a fingerprint.
K, S, SKETCH = 12, 4, 64
#: Shifts agree within this many code points or this share of the longer place.
SHIFT, SHIFT_SHARE = 32, 0.05
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Code points hashed at once.
BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def _anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of an array of at least K code points."""
    n = len(points)
    small = points[: n - S + 1].astype("u8")
    for j in range(1, S):
        small = small * _M1 + points[j : n - S + 1 + j]
    small = _mix(small)
    span, low = K - S + 1, small
    width = 1
    while width * 2 <= span:  # sliding minimum by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(small) - span + 1], low[span - width : span - width + len(small) - span + 1])
    places = np.flatnonzero((small[: len(low)] == low) | (small[span - 1 : span - 1 + len(low)] == low))
    whole = np.zeros(len(places), "u8")
    for j in range(0, K - S + 1, S):
        whole = (whole + small[places + j]) * _M1
    if (K - S) % S:
        whole = (whole + small[places + K - S]) * _M1
    return _mix(whole), places


def sketch(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest distinct anchor hashes (32 bits) in ascending order and their first places."""
    if not len(points):
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    if len(points) < K:
        digest = hashlib.blake2b(points.astype("<u4").tobytes(), digest_size=4).digest()
        return np.frombuffer(digest, ">u4").astype("u8"), np.zeros(1, "i8")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(points) - K + 1, BLOCK):
        hashes, places = _anchors(points[at : at + BLOCK + K - 1])
        hashes >>= np.uint64(32)
        # hash above, place below: one sort finds the smallest hashes and their first places
        keys = (hashes << np.uint64(32)) | (places + at).astype("u8")
        keys.sort()
        keep = np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64(1 << 40)))[:SKETCH]
        found.append(keys[keep])
    keys = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
    if len(found) > 1:
        keys = keys[np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64(1 << 40)))[:SKETCH]]
    return keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype("i8")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; 1 for equal fingerprints, two empty ones included."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    union = np.union1d(a[0], b[0])[:SKETCH]
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = common <= union[-1]
    if not inside.any():
        return 0.0
    pa_, pb = a[1][i[inside]], b[1][j[inside]]
    shift = pa_ - pb
    agrees = np.abs(shift - np.median(shift)) <= np.maximum(SHIFT, SHIFT_SHARE * np.maximum(pa_, pb))
    return float(agrees.sum() / len(union))


def as_text(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """Eight hexadecimal digits of hash and eight of place an anchor."""
    out = np.empty((len(fingerprint[0]), 2), ">u4")
    out[:, 0], out[:, 1] = fingerprint
    return out.tobytes().hex()


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(text), ">u4").reshape(-1, 2)
    return pairs[:, 0].astype("u8"), pairs[:, 1].astype("i8")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; no shuffle. Null texts count as empty."""

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": column(part, "doc_id"), "fingerprint": [as_text(sketch(code_points(t))) for t in column(part, "text").to_pylist()]}

    return map_slices(id_and_text(docs, id_col, text_col), run, "doc_id long, fingerprint string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of an edited copy and that of the next document.

    Documents are ordered by descending doc_id, null ids last; rows of one id by descending text, or by a hash
    of it and then the text where an id has so many rows that they fill several ranges. The last one's next is
    the first. The edited copy has its last floor(n/2) code points replaced by as many first ones of the next
    text, or all it has. A table of one row has itself as next; an empty table gives none.

    One shuffle: texts go to ranges of doc_id. The top row of each range goes to the range above it as
    well, since the lowest row there needs it (the topmost goes to the lowest range).
    """
    texts = id_and_text(docs, id_col, text_col)
    spark, ranges = docs.sparkSession, ranges_of(texts.select("doc_id"), "doc_id")
    rows = ranged(texts, ranges)
    tops = rows.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("top")).orderBy("range").collect()  # a row a range
    lending = [(r["range"], r["top"]["doc_id"], r["top"]["tie"], tops[(i + 1) % len(tops)]["range"]) for i, r in enumerate(tops)]
    lent = F.broadcast(spark.createDataFrame(lending, "range int, top long, top_tie long, above int"))  # MOST_RANGES rows at most
    is_top = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie"))
    own, other = F.struct(F.col("range").alias("range"), F.lit(False).alias("lent")), F.struct(F.col("above").alias("range"), F.lit(True).alias("lent"))
    dealt = rows.join(lent, "range").select("doc_id", "text", "tie", F.explode(F.when(is_top, F.array(own, other)).otherwise(F.array(own))).alias("home"))
    dealt = dealt.select("doc_id", "text", "tie", "home.lent", "home.range")
    ordered = dealt.repartitionById(ranges.n, F.col("range")).sortWithinPartitions("lent", F.desc_nulls_last("doc_id"), F.desc("tie"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, over = None, False
        for batch in slices(batches):
            out = {f: [] for f in OUT.names}
            for doc, text, lent in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), column(batch, "lent").to_pylist(), strict=True):
                if over:
                    break
                points = code_points(text)
                row = (doc, points, sketch(points))
                if before is not None:
                    _pair(out, before, row)
                before, over = row, lent
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=OUT)

    return ordered.select("doc_id", "text", "lent").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _pair(out: dict, row: tuple, after: tuple) -> None:
    """Adds the result of a row, given the next one."""
    doc, points, own = row
    half = len(points) // 2
    edited = np.concatenate([points[: len(points) - half], after[1][:half]])
    changed = sketch(edited)
    for k, v in zip(OUT.names, (doc, len(points), hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, after[2])), strict=True):
        out[k].append(v)
