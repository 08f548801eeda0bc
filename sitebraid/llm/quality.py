"""Quality rules as a ledger of bits, with DataFrame functions only: no Python runs on the executors.

Every rule is evaluated once a document. The ledger holds a document's measurements and `failed`, a long in which
bit i says that RULES[i] failed. Policies are versions: a mask of rules that reject and how many of them a document
may fail. They are applied to the ledger, never to texts again, and what each rule does in a policy (ablation) comes
from the counts of the different bit patterns, of which there are at most 2 ** len(RULES) however many documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, write_table

#: Words of a window whose repeats count.
WINDOW = 8
#: Characters between words, and those counted as symbols.
_BETWEEN, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
_OTHER = r"[^\p{L}\p{M}]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule on measurements, in whole numbers; `failed` is written the same in Spark and in other SQL."""

    name: str
    failed: str


#: A rule's place here is its bit in every ledger: new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("few_letters", "100 * n_letters < 40 * word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version: the rules that reject, and how many of them a document may fail and still be kept."""

    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return bits(*self.rules)


def bits(*names: str) -> int:
    """The mask of rules by name."""
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[n] for n in set(names))


BASE = Policy(1, ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy(2, (*BASE.rules, "symbols", "repeated_lines")), Policy(3, tuple(r.name for r in RULES)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda binds it, a plain column would be pasted in at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows (of a power of two) that occur twice or more among words, the first occurrence included.

    Windows are told apart by 64-bit hashes, chained from those of half the length. Where some repeat, they are sorted by hash and those with an equal
    neighbour give their places, whose union is measured: n log n for any text.
    """

    def covered(hashes: Column) -> Column:
        n = F.size(hashes)

        def of(rows: Column) -> Column:
            at = lambda i: F.get(rows, i)["h"]
            twin = lambda r, i: F.when((r["h"] == at(i - 1)) | (r["h"] == at(i + 1)), r["i"])
            places = F.sort_array(F.filter(F.transform(rows, twin), lambda p: p.isNotNull()))
            return _bound(places, lambda p: F.aggregate(p, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")), lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n")))["n"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < n, _bound(ordered, of)).otherwise(F.lit(0))

    def windows(chained: Column, length: int) -> Column:
        """Hashes of as many neighbours again: each is chained with the one that follows its stretch."""
        if length == window:
            return _bound(F.slice(chained, F.lit(1), F.size(words) - (window - 1)), covered)
        after = F.slice(chained, F.lit(length + 1), F.size(chained))
        return _bound(F.zip_with(chained, after, lambda a, b: F.xxhash64(a, b)), lambda longer: windows(longer, 2 * length))

    return F.when(F.size(words) >= window, windows(words, 1)).otherwise(F.lit(0))


def _measured(text: Column) -> Column:
    """struct of MEASURES (longs)."""
    words = F.array_remove(F.split(text, _BETWEEN, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    by_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return F.struct(
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("n_symbols"), F.length(F.regexp_replace(text, _OTHER, "")).alias("n_letters"),
        _bound(words, by_words).alias("w"), _bound(lines, by_lines).alias("l"),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES and failed of every row. No shuffle.

    Null texts count as empty: no words, so few_words fails. Rows without an id, repeated rows and equal texts
    keep a row each; other columns are ignored; an empty table gives an empty one.
    """
    m = id_and_text(docs, id_col, text_col).select("doc_id", _measured(F.col("text")).alias("m")).select("doc_id", "m.*").select("doc_id", "*", "w.*", "l.*")
    m = m.select("doc_id", *[F.col(c).cast("long").alias(c) for c in MEASURES])
    failed = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return m.select("*", failed.alias("failed"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of measured(), written to the shared folder: policies and ablations read numbers, not texts."""
    return write_table(measured(docs, id_col, text_col), "ledger")


def keeps(failed: Column, policy: Policy) -> Column:
    """Whether a policy keeps a document with these bits."""
    hits = F.bit_count(failed.bitwiseAND(F.lit(policy.mask).cast("long")))
    return hits <= policy.allowed


def apply(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """A ledger with keeps_v<version> for each policy."""
    return rows.select("*", *[keeps(F.col("failed"), p).alias(f"keeps_v{p.version}") for p in policies])


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, by: tuple[str, ...] = ()) -> DataFrame:
    """by, version, rule: failing (documents that fail the rule), kept (by the policy) and kept_without (the rule).

    Bit patterns are counted first (map-side), then every rule of every policy is judged on the patterns alone.
    """
    patterns = rows.groupBy(*by, "failed").agg(F.count("*").alias("n"))
    cases = F.array(*(F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(bits(r)).cast("long").alias("bit"), F.lit(p.mask).cast("long").alias("mask"), F.lit(p.allowed).alias("allowed")) for p in policies for r in p.rules))
    each = patterns.select(*by, "failed", "n", F.explode(cases).alias("c")).select(*by, "failed", "n", "c.*")
    hits = lambda mask: F.bit_count(F.col("failed").bitwiseAND(mask)) <= F.col("allowed")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    failing = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return each.groupBy(*by, "version", "rule").agg(count(failing).alias("failing"), count(hits(F.col("mask"))).alias("kept"), count(hits(F.col("mask").bitwiseAND(F.bitwise_not("bit")))).alias("kept_without"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (by the newest policy), then the bits failed."""
    rows = ledger(docs)
    base = ~keeps(F.col("failed"), BASE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & keeps(F.col("failed"), POLICIES[-1])).alias("kept"), "failed")


def _sql() -> str:
    failed = " + ".join(f"CASE WHEN {r.failed} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    win AS (SELECT r, unnest(range(1, greatest(0, len(words) - {WINDOW - 1}) + 1)) AS i, words FROM w),
    txt AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS x FROM win),
    twin AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM txt) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twin, range(0, {WINDOW}) AS o(k) GROUP BY r),
    m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(length(text) - length(regexp_replace(text, '[\p{{L}}\p{{M}}]+', '', 'g')) AS BIGINT) AS n_letters,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
    f AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept, failed FROM f"""


SQL = _sql()
