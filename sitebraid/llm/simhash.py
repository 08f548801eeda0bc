"""SimHash near duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at
most two bits, some segment is equal and the segment after it (the first after the third) differs in at
most one bit: two errors can't spoil all three pairs of neighbours. A segment is a word of the perfect
(23, 12) Golay code, which decodes every word to one codeword at most three bits away. Each fingerprint
is filed under its equal segment and the index of the next one's codeword, and looked up under the
indices that its own next segment and, if that has an odd number of bits, its one-bit neighbours decode to
(one or a few). What meets there is verified on all 64 bits.

Equal fingerprints are one node. A key that files more than CROWD fingerprints is not joined: all who
file or look there are linked by the words at most one bit away instead. Two fingerprints share such a
word exactly if they differ in at most two bits, and no word has more than 65 fingerprints, so this is
exact and grows with the members, not with their pairs.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, id_and_text, map_slices, write_table
from .components import connected

#: Words of a shingle; bits that linked fingerprints may differ in (the keys below serve up to 2).
SHINGLE, RADIUS = 3, 2
SEED = 42
#: Fingerprints of a key that are still joined pair by pair.
CROWD = 24
#: A fingerprint with more than this share of the rows is looked up in a broadcast table (so at most 1 / SHARE rows).
SHARE = 0.001

# The code's generator polynomial, and where the segments start and how long they are.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_CAPITALS = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1)


def _hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_CAPITALS).split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)][: len(words)], "u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashing = xxhash.xxh64_intdigest
    return np.array([hashing(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "u8")


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    octets = hashes.astype(">u8").view("u1").reshape(-1, 8)
    if len(hashes) < 400:
        counts = np.unpackbits(octets, axis=1).sum(axis=0, dtype="i8")
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64; 0 for a text without words."""
    return _majority(_hashes(text, shingle))


def several(text: str, shingle: int, views: int) -> list[int]:
    """The fingerprint of the distinct shingles, then those of their hashes mixed anew for each further view."""
    hashes = np.unique(_hashes(text, shingle))
    out = [_majority(hashes)]
    for view in range(1, views):
        mixed = hashes + np.uint64(view * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(_majority(mixed ^ (mixed >> np.uint64(32))))
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row; null texts have no words. No shuffle."""

    def run(part: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(t, shingle) for t in column(part, "text").to_pylist()], "u8").view("i8")
        return {"doc_id": column(part, "doc_id"), "fp": values}

    return map_slices(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each octet at its place, and the error of at most three bits behind each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    octets = np.array([[remainder(x << shift & 0x7FFFFF) for x in range(256)] for shift in (0, 8, 16)], "i4")
    unit = [remainder(1 << b) for b in range(23)]
    errors = np.zeros(2048, "i4")
    for a in range(23):
        errors[unit[a]] = 1 << a
        for b in range(a):
            errors[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return octets, errors


def codeword(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords nearest to 23-bit words."""
    octets, errors = _syndromes()
    syndrome = octets[0][words & 255] ^ octets[1][words >> 8 & 255] ^ octets[2][words >> 16 & 255]
    return (words ^ errors[syndrome]) >> 11


def _segments(values: np.ndarray) -> list[np.ndarray]:
    bits = values.view("u8")
    return [((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype("i8") for at, size in SEGMENTS]


def file_keys(values: np.ndarray, view: np.ndarray | int = 0) -> np.ndarray:
    """The three keys that fingerprints are filed under, a row each: view and pair of segments, equal segment, codeword index."""
    parts = _segments(values)
    return np.stack([(3 * view + i) << 40 | parts[i] << 12 | codeword(parts[(i + 1) % 3]) for i in range(3)], axis=1)


def look_keys(values: np.ndarray, view: np.ndarray | int = 0) -> list[np.ndarray]:
    """The keys that each fingerprint is looked up under: its own, and those of the next segment's one-bit neighbours if it
    has an odd number of bits. Of two segments one bit apart just one is odd, so one of both finds the other."""
    parts = _segments(values)
    found = []
    for i in range(3):
        after, size = parts[(i + 1) % 3], SEGMENTS[(i + 1) % 3][1]
        odd = (np.bitwise_count(after.view("u8")) & 1).astype("i8")[:, None]
        near = np.concatenate([after[:, None], after[:, None] ^ (odd << np.arange(size, dtype="i8"))], axis=1)
        found.append(((3 * view + i) << 40 | parts[i] << 12)[:, None] | codeword(near))
    return [np.unique(row) for row in np.concatenate(found, axis=1)]


def links(nodes: DataFrame) -> DataFrame:
    """view, u, v: links that hold together all fingerprints of nodes (fp, and view where there are several) at most RADIUS bits apart.

    nodes are distinct. Within a crowded key every fingerprint is linked to the smallest that shares a word
    one bit away, elsewhere to each near one. Fingerprints of different views are never linked.
    """
    nodes = nodes.select("view", "fp") if "view" in nodes.columns else nodes.select(F.lit(0).cast("long").alias("view"), "fp")

    def filed(batches):
        for b in batches:
            values, views = column(b, "fp").to_numpy(), column(b, "view").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(file_keys(values, views).ravel()), pa.array(np.repeat(values, 3))], ["key", "fp"])

    def looked(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                values, views = column(b, "fp").to_numpy()[at : at + 20_000], column(b, "view").to_numpy()[at : at + 20_000]
                keys = look_keys(values, views)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(values, [len(k) for k in keys]))], ["key", "fp"])

    files = nodes.mapInArrow(filed, "key long, fp long")
    looks = nodes.mapInArrow(looked, "key long, fp long")
    sizes = files.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("first"), F.max("fp").alias("final"))
    view = F.expr("shiftright(key, 40) div 3").alias("view")
    hits = write_table(looks.join(sizes, "key").where((F.col("n") > 1) | (F.col("first") != F.col("fp"))).select(view, "key", "fp", "n", "first", "final"), "hits")
    few = hits.where(F.col("n") <= 2).select("view", "fp", F.explode(F.array_distinct(F.array("first", "final"))).alias("other"))
    some = hits.where((F.col("n") > 2) & (F.col("n") <= CROWD)).select("key", "view", "fp").join(files.select("key", F.col("fp").alias("other")), "key").select("view", "fp", "other")
    near = few.unionByName(some).where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS))
    crowd = hits.where(F.col("n") > CROWD).select("view", "fp").distinct()
    words = crowd.select("view", "fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << b).view("i8")))) for b in range(64)))).alias("word"))
    hubs = words.groupBy("view", "word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1)
    through = words.join(hubs, ["view", "word"]).select("view", "fp", F.col("hub").alias("other"))
    return near.unionByName(through).select("view", F.col("fp").alias("u"), F.col("other").alias("v")).where(F.col("u") != F.col("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every row.

    Null and empty texts share the fingerprint zero and are linked like any other. Repeated rows stay
    repeated. Rows whose doc_id is null get their component's smallest id, null if it has none.
    """
    rows = write_table(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = connected(links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = write_table(rooted.join(least, "root").select("fp", "n", "component_id"), "components")
    total = rows.count()
    often = known.where(F.col("n") > max(1000, int(total * SHARE))).select("fp", F.col("component_id").alias("often_id"), F.lit(True).alias("often"))
    marked = rows.join(F.broadcast(often), "fp", "left")  # at most 1 / SHARE rows
    hot = marked.where("often").select("doc_id", "fp", F.col("often_id").alias("component_id"))
    rest = marked.where("often is null").select("doc_id", "fp").join(known.select("fp", "component_id"), "fp")
    return hot.unionByName(rest)


#: Shingles and views of the pipeline's stage: two words, as many fingerprints as find most copies.
COPY_SHINGLE, COPY_VIEWS = 2, 10
#: Two texts are near copies if their sets of shingles of so many words have at least ALIKE tenths of their union in common.
ALIKE_SHINGLE, ALIKE = 5, 8
#: Members of a key up to which all their pairs are proposed: of Golay keys, and of rare shingles in crowded ones.
SMALL_KEY, SMALL_SHINGLE = 4, 8
#: Smallest shingle hashes kept of a text; how many of them, rarest first, are second keys in crowded keys, and of those that more than SMALL_SHINGLE share.
SKETCH, RARE, COMMON = 64, 12, 4
#: Sets in a block at most, and their shingles (unless one set has more).
BLOCK, BLOCK_SHINGLES = 256, 1_000_000


def several_keys(values: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the row of each: an equal segment and every codeword at most four bits from the next one.

    Those are what the segment itself and its one-bit neighbours decode to, one to six. Segments up to two bits
    apart nearly always have a codeword in common.
    """
    parts, keys, rows = _segments(values), [], []
    for i in range(3):
        after, size = parts[(i + 1) % 3], SEGMENTS[(i + 1) % 3][1]
        near = codeword(np.concatenate([after[:, None], after[:, None] ^ (1 << np.arange(size, dtype="i8"))], axis=1))
        near.sort(axis=1)
        fresh = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, at = np.nonzero(fresh)
        keys.append((3 * view + i) << 40 | parts[i][row] << 12 | near[row, at])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _neighbours(keys: np.ndarray, nodes: np.ndarray, firsts: np.ndarray, small: int, chained: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sorted rows: all of a key with at most small rows; of a larger one each row with the one ahead of it and the key's first if
    chained, else none. And which rows have such keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.repeat(np.diff(np.append(starts, len(keys))), np.diff(np.append(starts, len(keys))))
    left, right = ([firsts], [nodes]) if chained else ([], [])
    for gap in range(1, small):
        same = np.flatnonzero((keys[gap:] == keys[:-gap]) & ((size[gap:] <= small) | (chained and gap == 1)))
        left.append(nodes[same])
        right.append(nodes[same + gap])
    u, v = np.concatenate(left), np.concatenate(right)
    return u[u != v], v[u != v], size > small


def _met(keyed: DataFrame, small: int, chained: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs u < v of the nodes that share a key (key, node), and the nodes of keys whose pairs may not be among them.

    Rows are sorted by key over all tasks, so a key with very many members is dealt over several: if chained, all its members are
    in a chain, and in each task in a star around the first there. No task holds a key. Nodes come second if their key has more
    than small members or may go on in another task.
    """

    def met(batches):
        task = TaskContext.get().partitionId()
        held_keys, held, first = np.zeros(0, "i8"), np.zeros(0, "i8"), None
        ends: list[tuple[int, int]] = []

        def told(u, v=None):
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(u), none if v is None else pa.array(v), none, none], ["u", "v", "key", "task"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held_keys, column(batch, "key").to_numpy()])
            nodes = np.concatenate([held, column(batch, "node").to_numpy()])
            opens = np.concatenate([[True], keys[1:] != keys[:-1]])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), 0))
            firsts = nodes[at]
            if first is not None and len(held_keys):
                firsts[keys == held_keys[-1]] = first
            ends = [ends[0] if ends else (int(keys[0]), int(nodes[0])), (int(keys[-1]), int(nodes[-1]))]
            u, v, large = _neighbours(keys, nodes, firsts, small, chained)
            first, keep = firsts[-1], min(small, len(keys))
            held_keys, held = keys[-keep:], nodes[-keep:]
            if len(u):
                yield told(np.minimum(u, v), np.maximum(u, v))
            crowd = np.unique(nodes[large | (keys == ends[0][0])])
            if len(crowd):
                yield told(crowd)
        if ends:
            yield told(np.unique(held[held_keys == ends[1][0]]))
        for side, (key, node) in enumerate(ends):
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([side]), pa.array([key]), pa.array([task])], ["u", "v", "key", "task"])

    found = write_table(keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(met, "u long, v long, key long, task long").distinct(), "met")
    plain = found.where("task is null")
    pairs, crowd = plain.where("v is not null").select("u", "v"), plain.where("v is null").select(F.col("u").alias("node"))
    if not chained:
        return pairs, crowd
    ends = sorted(tuple(r) for r in found.where("task is not null").select("task", "v", "key", "u").collect())  # two rows a task
    over = [(min(a[3], b[3]), max(a[3], b[3])) for a, b in zip(ends[1::2], ends[2::2]) if a[2] == b[2] and a[3] != b[3]]
    return pairs.unionByName(keyed.sparkSession.createDataFrame(over, "u long, v long")) if over else pairs, crowd


def _golay(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u < v: all pairs of nodes under the Golay keys of few members; and the nodes of the crowded ones."""

    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                nodes, fps = column(part, "node").to_numpy(), column(part, "fps").flatten().to_numpy().reshape(part.num_rows, -1)
                for view in range(fps.shape[1]):
                    keys, rows = several_keys(np.ascontiguousarray(fps[:, view]), view)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes[rows])], ["key", "node"])

    return _met(classes.select("node", "fps").mapInArrow(keyed, "key long, node long"), SMALL_KEY, chained=False)


def _sharing(classes: DataFrame, crowd: DataFrame) -> DataFrame:
    """u < v: pairs of nodes of crowd under those of their sketched shingles that the fewest of them share (two at least).

    The nodes of a shingle that many share are chained only: this finds most links, few pairs at a time, and rest() finds the others.
    """
    shingles = classes.select("node", "sketch").join(crowd, "node").select("node", F.explode("sketch").alias("key"))
    shingles = write_table(shingles, "crowded")
    common = shingles.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(W.partitionBy("node").orderBy("n", "key"))
    rare = shingles.join(common, "key").select("node", "key", "n", place.alias("place")).where((F.col("place") <= COMMON) | (F.col("n") <= SMALL_SHINGLE) & (F.col("place") <= RARE))
    return _met(rare.select("key", "node"), SMALL_SHINGLE, chained=True)[0]


def proposed(classes: DataFrame) -> DataFrame:
    """u < v: pairs of nodes that meet under a key of some view. classes: node (long), fps (a fingerprint a view), sketch (its smallest shingle hashes).

    Of a Golay key with few members all pairs are proposed; the members of crowded ones meet under shared shingles.
    """
    pairs, crowd = _golay(classes)
    return pairs.unionByName(_sharing(classes, crowd))


def prefixes(sets: DataFrame) -> DataFrame:
    """key, same, component, size, left: the rarest shingles of each set of at least two sets (same, component, shingles), of which near copies must share one.

    Shingles are in one order for all, rare ones first; left is how many of the set are not before this one, size all of them. Where
    the first that two sets share has left of them in one and in the other, they share at most the lesser of both.
    """
    shingles = sets.select("same", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    often = shingles.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    left = F.row_number().over(W.partitionBy("same").orderBy(F.desc("n"), F.desc("key")))
    return shingles.join(often, "key").select("key", "same", "component", "size", left.alias("left")).where(10 * F.col("left") >= ALIKE * F.col("size"))


def _alike(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets with ALIKE tenths of their union in common that hold together whatever such pairs do; sets of a label already are."""
    sizes, m = np.array([len(s) for s in sets]), len(sets)
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, several = np.repeat(np.arange(m), sizes), n[place] > 1
    row, place = row[several], (np.cumsum(n > 1) - 1)[place[several]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((m, m), "f4")
    for start in range(0, int((n > 1).sum()), 4096):
        a, b = np.searchsorted(place, [start, start + 4096])
        has = np.zeros((m, 4096), "f4")
        has[row[a:b], place[a:b] - start] = 1
        common += has @ has.T
    near = np.triu((10 + ALIKE) * common >= ALIKE * (sizes[:, None] + sizes[None, :]), 1) & (labels[:, None] != labels[None, :])
    parent, out = list(range(int(labels.max()) + 1)), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        a, b = int(labels[i]), int(labels[j])
        while parent[a] != a:
            a = parent[a] = parent[parent[a]]
        while parent[b] != b:
            b = parent[b] = parent[parent[b]]
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def rest(sets: DataFrame) -> DataFrame:
    """u, v: links that join all components of sets (same, component, shingles) between which near copies are left.

    Sets meet under their rarest shingles (prefixes). Keys whose sets are of one component are done. The others, sorted, are cut into
    blocks, and all sets of a block and of each two blocks of a key are compared, unless they are of one component. Tasks
    hold two blocks at a time; a key of n sets of different components takes some n * n / 2 comparisons.
    """
    entries = write_table(prefixes(sets), "prefixes")
    size, left = F.col("size"), F.col("left")
    # of two near copies the smaller has so much left of itself; and the larger enough for both
    smaller = F.when((10 + ALIKE) * left >= 2 * ALIKE * size, size)
    keys = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(smaller).alias("least")).where("low != high and least is not null")
    unsettled = entries.join(keys.select("key", "least"), "key").where((10 + ALIKE) * left >= ALIKE * (size + F.col("least"))).select("key", "component", "same", "size")

    def cut(batches):
        block, rows, shingles, before = TaskContext.get().partitionId() << 40, 0, 0, None
        for batch in batches:
            blocks = []
            for key, size in zip(column(batch, "key").to_pylist(), column(batch, "size").to_pylist(), strict=True):
                if rows >= BLOCK or shingles + size > BLOCK_SHINGLES or (rows >= BLOCK // 2 and key != before):
                    block, rows, shingles = block + 1, 0, 0
                rows, shingles, before = rows + 1, shingles + size, key
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), column(batch, "key"), column(batch, "component"), column(batch, "same")], ["block", "key", "component", "same"])

    def compare(batches):
        for group in _groups(batches):
            names = [x for b in group for x in column(b, "component").to_pylist()]
            same = [x for b in group for x in column(b, "same").to_pylist()]
            shingles = [x.values.to_numpy() for b in group for x in column(b, "shingles")]
            pairs = _alike(shingles, np.unique(np.array(names, "S16").view("V16"), return_inverse=True)[1])
            yield pa.RecordBatch.from_arrays([pa.array([same[i] for i, _ in pairs], pa.binary()), pa.array([same[j] for _, j in pairs], pa.binary())], ["u", "v"])

    blocks = write_table(unsettled.repartitionByRange("key", "component", "same").sortWithinPartitions("key", "component", "same").mapInArrow(cut, "block long, key long, component binary, same binary"), "blocks")
    bounds = (F.min("component").alias("low"), F.max("component").alias("high"))
    alone = blocks.groupBy("block").agg(*bounds).where("low != high").select(F.col("block").alias("a"), F.col("block").alias("b"))
    held = blocks.groupBy("key", "block").agg(*bounds)
    held = held.join(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    a, b = (held.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("block", "low", "high"))) for side in "ab")
    across = a.join(b, "key").where("a_block < b_block and (a_low != b_low or a_low != a_high or b_low != b_high)").select(F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct()
    pairs = alone.unionByName(across).select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    met = pairs.join(blocks.select("block", "same").distinct(), "block").select("a", "b", "same").distinct().join(sets, "same")
    return met.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(compare, "u binary, v binary")


def _groups(batches):
    """The slices of each group of rows of equal a, b, which come in order."""
    held, own = [], None
    for batch in batches:
        a, b = column(batch, "a").to_numpy(), column(batch, "b").to_numpy()
        cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if start == stop:
                continue
            if held and own != (a[start], b[start]):
                yield held
                held = []
            own = (a[start], b[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield held


def _mark(docs: DataFrame) -> Column:
    """A hash of a whole row, all columns."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return F.xxhash64(*(F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(f"`{c}`") for c in docs.columns))


def _words_digest(text: str) -> bytes:
    """Of a text's words, A-Z in lower case."""
    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").translate(_CAPITALS).split()))


def _copies(docs: DataFrame, shingle: int, views: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, same) and classes of equal words (same, least row, its component) with near copies linked."""

    def run(part: pa.RecordBatch) -> dict:
        texts = column(part, "text").to_pylist()
        values = [np.array(several(t, shingle, views), "u8").view("i8").tolist() for t in texts]
        sketches = [np.unique(_hashes(t, ALIKE_SHINGLE))[:SKETCH].view("i8") for t in texts]
        return {"doc_id": column(part, "doc_id"), "mark": column(part, "mark"), "same": [_words_digest(t) for t in texts], "fps": values, "sketch": sketches}

    def shingled(part: pa.RecordBatch) -> dict:
        texts = column(part, "text").to_pylist()
        same = [_words_digest(t) for t in texts]
        sets = [np.unique(_hashes(t, ALIKE_SHINGLE)).view("i8") for t in texts]
        return {"node": np.array([int.from_bytes(x[:8], "big", signed=True) for x in same], "i8"), "same": same, "shingles": sets}

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), _mark(docs).alias("mark"))
    rows = write_table(map_slices(narrow, run, "doc_id long, mark long, same binary, fps array<long>, sketch array<long>"), "views")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    classes = write_table(rows.groupBy("same").agg(least.alias("least"), F.any_value("fps").alias("fps"), F.any_value("sketch").alias("sketch")), "classes")
    # a node is eight bytes of its class's digest; what meets by chance is told apart by all sixteen below
    nodes = classes.select(_node(F.col("same")).alias("node"), "fps", "sketch")
    few, crowd = _golay(nodes)
    pairs = write_table(few.unionByName(_sharing(nodes, crowd)).distinct(), "pairs")
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(crowd).distinct()
    marks = classes.select(_node(F.col("same")).alias("node"), "least.mark").join(asked, "node").select("mark").distinct()
    sets = write_table(map_slices(narrow.join(marks, "mark", "left_semi").select("text"), shingled, "node long, same binary, shingles array<long>").dropDuplicates(["same"]), "shingles")
    one = lambda n, s: sets.select(F.col("node").alias(n), F.col("same").alias(f"{n}_same"), F.col("shingles").alias(s))
    both = pairs.join(one("u", "s"), "u").join(one("v", "t"), "v")
    common, sizes = F.size(F.array_intersect("s", "t")), F.size("s") + F.size("t")
    alike = both.where((10 + ALIKE) * common >= ALIKE * sizes).select(F.col("u_same").alias("u"), F.col("v_same").alias("v"))
    roots = connected(alike.distinct())
    component = F.coalesce("root", "same").alias("component")
    crowded = sets.join(crowd, "node", "left_semi").join(roots.withColumnRenamed("node", "same"), "same", "left").select("same", component, "shingles")
    more = write_table(rest(write_table(crowded, "crowded_sets")), "rest")
    if not more.isEmpty():
        roots = connected(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    known = classes.join(roots.select(F.col("node").alias("same"), "root"), "same", "left").select("same", "least", F.coalesce("root", "same").alias("component"))
    return rows.select("doc_id", "mark", "same"), write_table(known, "components")


def _node(same: Column) -> Column:
    """The first eight bytes of a digest as a signed number."""
    return F.conv(F.hex(F.substring(same, 1, 8)), 16, -10).cast("long")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, views: int = COPY_VIEWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id, null if there is none) of every row: near copies by their five-word shingles are linked.

    Texts of equal words are one class. Each class has several fingerprints (the same shingles, hashed anew);
    classes that meet under a Golay key of any of them are proposed (those of crowded keys, all of them, under the
    rarest of their shingles, which loses no pair), and a pair is linked if its shingle sets have ALIKE tenths in common. Repeated rows stay repeated; null texts have no words, like empty ones.
    """
    rows, classes = _copies(docs, shingle, views, id_col, text_col)
    least = classes.groupBy("component").agg(F.min("least").alias("least")).select("component", F.col("least.doc_id").alias("component_id"))
    return rows.join(classes.join(least, "component").select("same", "component_id"), "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = COPY_SHINGLE, views: int = COPY_VIEWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, of each component of near copies: that of the smallest doc_id (none: last), of equal ids the one of smallest hash.

    Rows are told apart by all their columns, so ids may repeat or be null; of rows equal in all columns one stays.
    """
    rows, classes = _copies(docs, shingle, views, id_col, text_col)
    kept = classes.groupBy("component").agg(F.min("least").alias("least")).select("least.no_id", F.coalesce("least.doc_id", F.lit(0)).alias("id"), "least.mark")
    keys = rows.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    times = keys.groupBy("no_id", "id", "mark").agg(F.count("*").alias("times"))
    kept = write_table(kept.join(times, ["no_id", "id", "mark"]), "kept")
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), _mark(docs).alias("mark"))
    own = own.select("row", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    found = own.join(kept.where("times = 1"), ["no_id", "id", "mark"], "left_semi")
    if not kept.where("times > 1").isEmpty():
        again = own.join(kept.where("times > 1"), ["no_id", "id", "mark"], "left_semi").dropDuplicates(["no_id", "id", "mark"])
        found = found.unionByName(again)
    return found.select("row.*")
