"""How the sources of a language diverge in their terms, priced on hash-consed segment trees.

Terms are counted a task at a time before they are shuffled. A language's kept terms are dealt into blocks of about
WIDTH, and over a block every group (language and source) has a segment tree of its counts: leaves with equal counts
are one node, and so are inner nodes with equal children, for all groups of the block. The difference of two groups
is found by walking both trees at once from the root; a pair of nodes that is met several times at a level is one
entry with a multiplicity, so it is opened and priced once, and a node against itself under equal totals costs
nothing and isn't opened. Blocks add up. Sources of a language meet SOURCES at a time, so a task holds at most
2 * SOURCES trees of one block, however many terms or sources there are.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, slices, write_table

#: Documents of a language that a term must be in; terms that a group lists at most.
LEAST_DOCUMENTS, LISTED = 30, 50
#: Added to every count; what shares are told in.
SMOOTH, SCALE = 5, 1_000_000_000
#: Terms of a block, sources of a chunk, pairs of groups walked at once.
WIDTH, SOURCES, PAIRS = 4096, 48, 64
#: Languages whose totals are broadcast (two numbers each); those of more meet their terms in a join.
MOST_LANGS = 50_000
#: Different terms that a task counts before it hands its counts on.
COUNTED = 200_000
#: Octets of a term: letters (A-Z as a-z) and all of other alphabets; every other octet parts terms.
_OCTETS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_OCTETS).split()


def plain(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, text of every row with nulls as ''."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])


def counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                keys = list(times)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array([k.decode() for k in keys], pa.string()), pa.array(list(times.values()), pa.int64()), pa.array([docs[k] for k in keys], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for part in slices([batch], 256):
                texts = column(part, "text").cast(pa.binary()).to_pylist()
                for lang, source, text in zip(column(part, "lang").to_pylist(), column(part, "source").to_pylist(), texts, strict=True):
                    found = terms(text)
                    times, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    before = len(times)
                    times.update(found)
                    docs.update(set(found))
                    size += len(times) - before
                if size >= COUNTED:
                    yield from told()
                    size = 0
        yield from told()

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """p of a count: 1 + floor(SCALE * (n + SMOOTH) / total), exact."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", top, total.cast("decimal(19,0)")) + 1


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in numpy, a thousand at a time so that nothing overflows below totals of 9e15."""
    out, left = np.zeros(len(n), "i8"), n + SMOOTH
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


class Trees:
    """Segment trees of counts (a row a group), consed over all rows: nodes of equal content have one number at their height."""

    def __init__(self, matrix: np.ndarray):
        width = 1 << max(0, (matrix.shape[1] - 1).bit_length())
        padded = np.full((len(matrix), width), -1, "i8")  # -1: no term here
        padded[:, : matrix.shape[1]] = matrix
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes, self.children = nodes.reshape(padded.shape), []
        while nodes.shape[1] > 1:
            base = int(nodes.max()) + 1
            keys, joined = np.unique(nodes[:, ::2] * base + nodes[:, 1::2], return_inverse=True)
            self.children.append((keys // base, keys % base))
            nodes = joined.reshape(len(matrix), -1)
        self.roots = nodes[:, 0]

    def differences(self, a: np.ndarray, b: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, int]:
        """Summed difference of shares for rows a and b, and how many pairs of leaves were priced."""
        pair, u, v, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), "i8")
        level = totals[a] == totals[b]
        for left, right in self.children[::-1]:
            pair, u, v, times = self._merged(pair, u, v, times, level)
            pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
            u, v = np.concatenate([left[u], right[u]]), np.concatenate([left[v], right[v]])
        pair, u, v, times = self._merged(pair, u, v, times, level)
        real = self.leaves[u] >= 0  # both have a term there or neither has
        pair, u, v, times = pair[real], u[real], v[real], times[real]
        price = np.abs(shares(self.leaves[u], totals[a[pair]]) - shares(self.leaves[v], totals[b[pair]])) * times
        out = np.zeros(len(a), "i8")
        np.add.at(out, pair, price)
        return out, len(pair)

    @staticmethod
    def _merged(pair: np.ndarray, u: np.ndarray, v: np.ndarray, times: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
        """Equal node pairs of a pair of groups made one; those that cost nothing left out."""
        open_ = ~(level[pair] & (u == v))
        pair, u, v, times = pair[open_], u[open_], v[open_], times[open_]
        if not len(pair):
            return pair, u, v, times
        base = int(max(u.max(), v.max())) + 1
        keys, first, same = np.unique((pair * base + u) * base + v, return_index=True, return_inverse=True)
        summed = np.zeros(len(keys), "i8")
        np.add.at(summed, same, times)
        return pair[first], u[first], v[first], summed


PRICED = "lang string, a long, b long, value long"


def _priced(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differences in one block of all pairs of groups of two chunks of sources (or of one)."""
    one = pa.Table.from_batches(list(batches))  # at most 2 * SOURCES rows of a block's counts
    lang, _, ci, cj = (k.as_py() for k in key)
    numbers, chunks, totals = (one[c].to_numpy() for c in ("no", "chunk", "total"))
    matrix = np.zeros((len(numbers), one["width"][0].as_py()), "i8")
    for row, cells in enumerate(one["cells"].to_pylist()):
        for c in cells or ():
            matrix[row, c["place"]] = c["n"]
    trees = Trees(matrix)
    a, b = np.nonzero(np.triu(np.ones((len(numbers),) * 2, bool), 1)) if ci == cj else (x.ravel() for x in np.meshgrid(np.flatnonzero(chunks == ci), np.flatnonzero(chunks == cj), indexing="ij"))
    for at in range(0, len(a), PAIRS):
        u, v = a[at : at + PAIRS], b[at : at + PAIRS]
        value, _ = trees.differences(u, v, totals)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(np.minimum(numbers[u], numbers[v])), pa.array(np.maximum(numbers[u], numbers[v])), pa.array(value)], ["lang", "a", "b", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every occurring group.

    'pair': each other source of the language with the summed difference of shares over all kept terms, all ranks (0
    where the language keeps none). 'term': the kept terms that a group has in a larger share than its language, LISTED ranks.
    Nulls in text, lang and source count as ''; a row of any id counts once, repeated rows repeatedly; documents
    without terms still make a group. An empty table gives an empty result. Other columns are ignored.
    """
    rows = plain(docs)
    # a hash of the term deals a block; its place in there goes by how common it is, so that rare terms are neighbours
    counted = write_table(counts(rows), "counts")
    known = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "whole")
    known = write_table(known, "known")
    langs = write_table(known.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("n")).select("lang", "v", (F.col("n") + SMOOTH * F.col("v")).alias("lang_total")), "langs")
    langs = F.broadcast(langs) if langs.count() <= MOST_LANGS else langs  # a join dealt by lang would keep a language's terms together up to the window
    blocks = F.ceil(F.col("v") / WIDTH)
    dealt = known.join(langs.select("lang", "v"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    dealt = dealt.withColumn("place", F.row_number().over(W.partitionBy("lang", "block").orderBy(F.desc("whole"), "term")) - 1)
    cells = write_table(counted.select("lang", "source", "term", "n").join(dealt.select("lang", "term", "whole", "block", "place"), ["lang", "term"]), "cells")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("total"), "lang_total")
    groups = write_table(groups.withColumn("no", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("chunk", F.expr(f"no div {SOURCES}").cast("int")), "groups")
    return _pairs(cells, groups).unionByName(_terms(cells, groups))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    widths = cells.groupBy("lang", "block").agg((F.max("place") + 1).alias("width"))
    packed = cells.groupBy("lang", "block", "source").agg(F.collect_list(F.struct("place", "n")).alias("cells"))
    chunks = groups.groupBy("lang").agg(F.max("chunk").alias("last"))
    trees = groups.join(widths, "lang").join(packed, ["lang", "block", "source"], "left").join(chunks, "lang")
    met = trees.select("lang", "block", "no", "chunk", "total", "width", "cells", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    met = met.select("lang", "block", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "no", "chunk", "total", "width", "cells")
    values = met.groupBy("lang", "block", "ci", "cj").applyInArrow(_priced, PRICED).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    side = lambda n, s: groups.select("lang", F.col("no").alias(n), F.col("source").alias(s))
    every = side("a", "s").join(side("b", "t"), "lang").where("a < b").join(values, ["lang", "a", "b"], "left")
    both = every.select("lang", F.coalesce("value", F.lit(0)).alias("value"), F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))).alias("x"))
    return _ranked(both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))


def _terms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    p = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("total")) - share(F.col("whole"), F.col("lang_total"))).alias("value"))
    return _ranked(p.where("value > 0").select("lang", "source", F.lit("term").alias("part"), "item", "value")).where(F.col("rank") <= LISTED)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


SQL = rf"""
    WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    w AS (SELECT r, lang, source, unnest(ws) AS term FROM t),
    kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM t),
    s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
    d AS (SELECT g.lang, g.source, CAST(coalesce(s.n, 0) + {SMOOTH} * v.v AS HUGEINT) AS total FROM g JOIN v USING (lang) LEFT JOIN s USING (lang, source)),
    p AS (SELECT d.lang, d.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * CAST(coalesce(c.n, 0) + {SMOOTH} AS HUGEINT)) // d.total AS p,
        1 + ({SCALE} * CAST(kept.n + {SMOOTH} AS HUGEINT)) // CAST(v.n + {SMOOTH} * v.v AS HUGEINT) AS q
        FROM d JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x) WHERE part = 'pair' OR rank <= {LISTED}"""
