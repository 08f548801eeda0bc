"""Packing documents into fixed-length sequences by bin completion.

A piece is a document, or for a longer one a stretch of exactly the sequence length (the first stretch may
be shorter). Only the count of pieces of each length matters for the plan, at most CAPACITY numbers however
many pieces there are, so the driver gets that histogram and searches over it:

* a bin is completed around the largest piece left: fillings that leave no room for a left piece and that
  no single larger piece could improve on (undominated) are tried, fullest first, each as many times in a
  row as the counts allow;
* a branch ends when the waste so far, with what is left filled perfectly, can't beat the best plan known;
* best-fit decreasing gives the first plan, and the search stops at the lower bound or after NODES nodes.

Each step of a plan uses up a length, so a plan has at most CAPACITY patterns. Pieces are then numbered
within their length (a common length is dealt over many tasks) and their number says where they go.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, id_and_text, slices, write_table
from .subwords import TABLE_ENTRIES, encoder

CAPACITY, END_ID = 1024, 2
#: Bounds of the search: nodes in all, fillings tried a node, steps in looking for fillings.
NODES, FILLINGS, EFFORT = 3000, 5, 1500
#: Pieces numbered in one task.
PIECES_A_TASK = 100_000


@dataclass(frozen=True)
class Pattern:
    """Lengths in a sequence, largest first, and how many sequences are filled so."""

    lengths: tuple[int, ...]
    times: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No plan has fewer bins: for each k, pieces over capacity - k stand alone, those over half of it each open a bin."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    k = np.arange(capacity // 2 + 1)
    alone = number[-1] - number[capacity - k + 1]  # longer than capacity - k
    large = number[capacity - k + 1] - number[capacity // 2 + 1]
    large_volume = volume[capacity - k + 1] - volume[capacity // 2 + 1]
    small_volume = volume[capacity // 2 + 1] - volume[k]
    more = np.maximum(0, -(-(small_volume - (large * capacity - large_volume)) // capacity))
    return max(-(-total // capacity), int((alone + large + more).max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram: bins that are alike are kept and filled together."""
    open_bins: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = {}
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            room = min((r for r, b in by_room.items() if r >= size and b), default=None)
            if room is None:
                fit = min(left, max(1, left // (capacity // size))) if left >= capacity // size else 1
                lengths, times = (size,) * (capacity // size if left >= capacity // size else left), fit if left >= capacity // size else 1
                left -= len(lengths) * times
            else:
                old = by_room[room].pop()
                many = min(room // size, left)
                here = open_bins.pop(old)
                times = min(here, left // many)
                if here > times:
                    open_bins[old] = here - times
                    by_room[room].append(old)
                lengths = old + (size,) * many
                left -= many * times
            if lengths in open_bins:
                open_bins[lengths] += times
            else:
                open_bins[lengths] = times
                by_room.setdefault(capacity - sum(lengths), []).append(lengths)
    return [Pattern(k, v) for k, v in open_bins.items()]


def fillings(counts: np.ndarray, room: int, most: int = FILLINGS, effort: int = EFFORT) -> list[tuple[int, ...]]:
    """Undominated fillings of room from the pieces left, fullest first, larger pieces first among equals.

    A search in depth with its own stack: each step takes one more piece, no larger than the last.
    """
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    left = np.array([counts[s] for s in sizes], "i8").tolist()
    after = np.concatenate([np.cumsum((counts > 0)[::-1])[::-1], [0]])  # how many lengths from each on are left
    found: dict[tuple[int, ...], int] = {}
    full = steps = 0

    def dominated(chosen: tuple[int, ...], slack: int) -> bool:
        """Whether a single larger piece in the place of a chosen one would leave less room."""
        used: dict[int, int] = {}
        for t in chosen:
            used[t] = used.get(t, 0) + 1
        for t in used:
            top = min(t + slack, len(counts) - 1)
            spent = sum(counts[x] <= n for x, n in used.items() if t < x <= top)
            if after[t + 1] - after[top + 1] > spent:
                return True
        return False

    # a frame: next length to try, room left, the length taken last and how often in a row, whether a piece fitted
    stack, chosen = [[0, room, -1, 0, False]], []
    while stack:
        frame = stack[-1]
        i, slack, last, run, _ = frame
        while i < len(sizes) and (sizes[i] > slack or left[i] <= (run if i == last else 0)):
            i += 1
        if i < len(sizes):
            frame[4] = True
            steps += 1
            if steps <= effort and full < most:
                frame[0] = i + 1
                chosen.append(sizes[i])
                stack.append([i, slack - sizes[i], i, run + 1 if i == last else 1, False])
                continue
        elif not frame[4]:
            key = tuple(chosen)
            if not (slack and dominated(key, slack)):
                full += slack == 0 and key not in found
                found[key] = slack
        stack.pop()
        if chosen:
            chosen.pop()
    if not found:  # the search ended early: the greedy filling
        chosen, slack = [], room
        for s, n in zip(sizes, left, strict=True):
            times = min(n, slack // s)
            chosen, slack = chosen + [s] * times, slack - s * times
        found[tuple(chosen)] = slack
    return sorted(found, key=lambda c: (found[c], len(c), [-x for x in c]))[:most]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns that use every piece once, in as few bins as the search finds."""
    counts = np.zeros(capacity + 1, "i8")
    for size, n in histogram.items():
        counts[size] = n
    best = best_fit(counts, capacity)
    fewest, least = sum(p.times for p in best), lower_bound(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())
    stack: list[tuple[np.ndarray, tuple, int]] = [(counts, (), 0)]
    for _ in range(nodes):
        if not stack or fewest <= least:
            break
        left, chosen, bins = stack.pop()
        rest = np.flatnonzero(left)
        if not len(rest):
            if bins < fewest:
                fewest, best = bins, _unrolled(chosen)
            continue
        used = total - int((left * np.arange(capacity + 1)).sum())
        waste = bins * capacity - used
        if -(-(total + waste) // capacity) >= fewest or bins + lower_bound(left, capacity) >= fewest:
            continue
        size = int(rest[-1])
        left[size] -= 1
        branches = fillings(left, capacity - size)
        left[size] += 1
        for filling in reversed(branches):  # the fullest is taken up next
            lengths = (size, *filling)
            need = {s: lengths.count(s) for s in set(lengths)}
            times = min(int(left[s]) // n for s, n in need.items())
            after = left.copy()
            for s, n in need.items():
                after[s] -= n * times
            stack.append((after, (chosen, Pattern(lengths, times)), bins + times))
    return best


def _unrolled(chain: tuple) -> list[Pattern]:
    out = []
    while chain:
        chain, pattern = chain
        out.append(pattern)
    return out[::-1]


def slots(patterns: list[Pattern]) -> np.ndarray:
    """A row for each length in a pattern: length, first number, times in the pattern, first sequence, first offset; sorted."""
    rows, first_sequence, numbered = [], 0, {}
    for p in patterns:
        offset = 0
        for size in dict.fromkeys(p.lengths):
            n = p.lengths.count(size)
            rows.append((size, numbered.get(size, 0), n, first_sequence, offset))
            numbered[size] = numbered.get(size, 0) + n * p.times
            offset += n * size
        first_sequence += p.times
    return np.array(sorted(rows), "i8").reshape(-1, 5)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """Pieces of every row's ids with the end id: doc_id, piece, start, length, ids_crc32. No shuffle.

    entries: how many pieces a worker's tables hold; memory against time, never a difference in ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer, entries), np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out = {f: [] for f in PIECES.names}
            for doc, packed in zip(column(batch, "doc_id").to_pylist(), coder.encode(column(batch, "text").to_pylist()), strict=True):
                data = packed + end
                n, at, piece = len(data) // 4, 0, 0
                step = n % capacity or capacity
                while at < n:
                    for k, v in zip(PIECES.names, (doc, piece, at, step, zlib.crc32(data[4 * at : 4 * (at + step)])), strict=True):
                        out[k].append(v)
                    at, step, piece = at + step, capacity, piece + 1
            yield pa.RecordBatch.from_pydict(out, schema=PIECES)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Every piece gets its own place, repeated rows included; sequences are gapless from offset 0 and
    numbered from 0. Null ids are packed like others. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = write_table(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = slots(plan(histogram, capacity, nodes))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(histogram.values()) // PIECES_A_TASK))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(tasks)).cast("int"))
    sizes = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = sizes.select("length", "deal", (F.sum("n").over(W.partitionBy("length").orderBy("deal")) - F.col("n")).alias("before"))
    order = W.partitionBy("length", "deal").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(order) - 1).join(before, ["length", "deal"]).withColumn("number", F.col("number") + F.col("before"))
    keys = (table[:, 0] << 44) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, length = column(batch, "number").to_numpy(), column(batch, "length").to_numpy()
            row = table[np.searchsorted(keys, (length << 44) | number, "right") - 1]
            k = number - row[:, 1]
            columns = {n: column(batch, n) for n in PIECES.names}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(row[:, 3] + k // row[:, 2]), "offset": pa.array(row[:, 4] + k % row[:, 2] * length)})

    return numbered.select(*PIECES.names, "number").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
