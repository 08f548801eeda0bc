"""Personal data in texts, with DataFrame functions only: no Python runs on the executors.

Each base kind is found by its pattern (leftmost, not overlapping) and checked; what fails is dropped. The
patterns below match what the plain ones do, but are written so that Java's matcher neither recurses once
a repetition nor tries a long run again from each of its characters.

High-recall generators propose further spans: spelt-out addresses, numbers with an area code in brackets
or after a word that announces one, and card-like numbers. Gradient-boosted trees score them on the
format of the span and its context; they are fitted on all different texts, where base spans are the positive and
failed candidates the negative examples, and compiled to CASE expressions. Candidates stay in Spark, equal ones
counted: a level of a tree needs the sums of each value of each feature in each node, which alone come to the driver.
A span is added if its score passes its kind's threshold, calibrated on a quarter of the texts that the trees aren't
fitted on, and it overlaps no base span and no better added one.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, write_table

KINDS = ("email", "ip", "card", "phone")
#: Boosting: trees, depth, step, least weight of a leaf; precision asked of a threshold, and where it may not go below.
TREES, DEPTH, STEP, LEAF, PRECISION, FLOOR = 24, 3, 0.3, 4.0, 0.98, 0.6
#: Characters of context on either side.
CONTEXT = 24
#: Steps of a gradient's unit in sums, which are whole numbers and so the same in any order; of a score's in thresholds, and the largest score told apart.
UNIT, GRID, FAR = 1 << 30, 1000, 30
#: Trees that are summed up anew in each pass, before scores are written.
SUMMED = 4

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns. A group of one character with a look-behind repeats without recursion.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@(?=[A-Za-z0-9-]++[.][A-Za-z0-9-])(?:[A-Za-z0-9.-](?<![.][.]))+(?<![.])",
    "ip": r"(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++",
    "card": r"[0-9](?:[0-9 -](?<![ -][ -]))+(?<![ -])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests of a text that a match of the kind needs.
NEEDS = {"email": "@[A-Za-z0-9-]", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: What generators propose beyond the base: kind, what the text needs, pattern.
PROPOSED = (
    ("email", r"(?i)[(\[{] ?at ?[)\]}]", rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++ ?[(\[{{] ?at ?[)\]}}] ?[A-Za-z0-9-]+ ?(?:[.]|[(\[{{] ?dot ?[)\]}}]) ?[A-Za-z0-9-]{{2,24}}"),
    ("phone", r"\([0-9]{2,4}\)", r"(?<![0-9+] ?)\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])"),
    ("phone", r"(?i)(?:tel|fon|phone|mobile|móvil|call|fax)[.:]? {0,2}[0-9]", r"(?i)(?<=(?:tel|fon|phone|mobile|móvil|call|fax)[.:]{0,1} {0,2})(?<![0-9])[0-9][0-9 .-]{7,16}[0-9]"),
)
ANNOUNCE = {"email": "mail|contact|write|correo|courriel", "ip": "ip|host|server|address", "card": "card|visa|master|karte|tarjeta|carte|credit", "phone": "tel|fon|phone|mobile|móvil|call|fax|sms"}
FEATURES = ("kind", "length", "digits", "different digits", "separators", "longest digits", "letters", "letter before", "letter after", "digit after", "announced", "sentence")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the check sum."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i)))
    return F.when((n >= 1) & (n <= 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(F.substr(p, F.greatest(F.length(p) - 2, F.lit(1))), "^$", "0").cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda s: _valid(kind, s["m"])


def _failing(kind: str):
    return lambda s: ~_valid(kind, s["m"]) & F.length(_digits(s["m"])).between(7, 19)


def _of_kind(k: int):
    return lambda s: s["k"] == k


def _spans(kind: str, pieces: Column, matches: Column) -> Column:
    """start, k, end, m of matches, given the pieces between them."""
    none = F.lit(0)
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), none, lambda acc, x: acc + F.length(x))

    def one(i: Column) -> Column:
        m = F.get(matches, i)
        start = total(pieces, i + 1) + F.when(i > 0, total(matches, i)).otherwise(none)
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), (start + F.length(m)).alias("end"), m.alias("m"))

    return F.when(F.size(matches) > 0, F.transform(F.sequence(none, F.size(matches) - 1), one)).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,k:int,end:int,m:string>>)")


def _found(df: DataFrame) -> DataFrame:
    """doc_id, text, base and failed (spans of base patterns), proposed (spans of generators)."""
    sources = [(f"b{i}", k, NEEDS[k], BASE[k]) for i, k in enumerate(KINDS)] + [(f"g{i}", *p) for i, p in enumerate(PROPOSED)]
    t = F.col("text")
    own = df.columns
    cut = df.select(*own, *[x for name, _, need, pattern in sources for x in (F.when(t.rlike(need), F.split(t, pattern, -1)).otherwise(F.array(t)).alias(f"{name}_p"), F.when(t.rlike(need), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")).alias(f"{name}_m"))])
    spans = cut.select(*own, *[_spans(k, F.col(f"{name}_p"), F.col(f"{name}_m")).alias(name) for name, k, _, _ in sources])
    valid = {f"b{i}": k for i, k in enumerate(KINDS)}
    base = F.sort_array(F.concat(*[F.filter(name, _passing(k)) for name, k in valid.items()]))
    failed = F.concat(*[F.filter(name, _failing(k)) for name, k in valid.items() if k != "email"])
    return spans.select(*own, base.alias("base"), failed.alias("failed"), F.concat(*[F.col(f"g{i}") for i in range(len(PROPOSED))]).alias("proposed"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _features(text: Column, s: Column) -> Column:
    """Small integers on a span's format and context, in the order of FEATURES; its leading plus and check sum are not among them."""
    m = F.regexp_replace(s["m"], r"^\+", "")
    digits = _digits(m)
    left = F.lower(F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
    before, after = F.when(s["start"] > 0, F.substr(text, s["start"], F.lit(1))).otherwise(F.lit(" ")), F.substr(text, s["end"] + 1, F.lit(1))
    announced = F.coalesce(*[F.when(s["k"] == i, left.rlike(ANNOUNCE[k]).cast("int")) for i, k in enumerate(KINDS)])
    many = F.size(F.array_distinct(F.split(digits, "")))
    longest = F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda x: F.length(x)))
    return F.array(
        s["k"], F.least(F.length(m), F.lit(60)), F.least(F.length(digits), F.lit(30)), many, F.least(F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")), F.lit(20)), F.least(F.coalesce(longest, F.lit(0)), F.lit(30)),
        F.least(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.lit(40)), before.rlike("[A-Za-z]").cast("int"), after.rlike("[A-Za-z]").cast("int"), after.rlike("[0-9]").cast("int"), announced, before.rlike(r"[\s(:]").cast("int"),
    )


@dataclass
class Trees:
    """Boosted trees as nested (feature, at most, left, right) with numbers as leaves, the prior odds and a threshold a kind."""

    trees: list
    prior: float
    thresholds: tuple[float, ...]

    def odds(self, x: Column) -> Column:
        """The sum of the trees as an expression over an array of features."""

        def tree(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            feature, most, left, right = t
            return F.when(F.get(x, F.lit(feature)) <= most, tree(left)).otherwise(tree(right))

        out = F.lit(float(self.prior))
        for t in self.trees:
            out = out + tree(t)
        return out


def _cut(gs: np.ndarray, hs: np.ndarray, n: np.ndarray, whole: float) -> tuple[float, int]:
    """The best gain and its place, given the sums up to each value of a feature."""
    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
    gain[(n < LEAF) | (n[-1] - n < LEAF)] = -1
    at = int(np.argmax(gain))
    return float(gain[at]), at


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None) -> Trees:
    """Logistic boosting over small integers; y: 1 for personal data. Thresholds come from the rows held out (all rows of a kind without any)."""
    held = np.zeros(len(y), bool) if held is None else held
    learn = np.flatnonzero(~held)
    if not len(learn) or y[learn].min() == y[learn].max():
        never = 1e9  # nothing to tell apart: nothing is added
        return Trees([], 0.0, (never,) * len(KINDS))
    prior = float(np.log(y[learn].mean() / (1 - y[learn].mean())))
    odds, trees = np.full(len(y), prior), []

    def leaf(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        return float(STEP * g[rows].sum() / (h[rows].sum() + 1))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        best = (1e-6, None, None)
        if depth:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f in range(x.shape[1]):
                values = x[rows, f]
                size = int(values.max()) + 1
                gain, at = _cut(*(np.cumsum(np.bincount(values, weights=w, minlength=size)) for w in (g[rows], h[rows], np.ones(len(rows)))), whole)
                if gain > best[0]:
                    best = (gain, f, at)
        if best[1] is None:
            return leaf(rows, g, h)
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1))

    def value(tree) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], value(tree[2]), value(tree[3]))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        trees.append(grow(learn, y - p, p * (1 - p) + 1e-9, DEPTH))
        odds = odds + value(trees[-1])
    thresholds = []
    for k in range(len(KINDS)):
        own = (x[:, 0] == k) & held if ((x[:, 0] == k) & held).any() else x[:, 0] == k
        floor = float(np.log(FLOOR / (1 - FLOOR)))
        if own.any():
            order = np.argsort(-odds[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= PRECISION)
            floor = max(floor, float(odds[own][order][good[-1]])) if len(good) else 1e9
        thresholds.append(floor)
    return Trees(trees, prior, tuple(thresholds))


def _grown(rows: DataFrame, odds: Column) -> tuple | float:
    """A tree of `boost` on rows (x, y, n) that have odds, a level a pass; only sums by node, feature and value are gathered."""
    x, p = F.col("x"), 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
    here = rows.select("x", "y", "n", p.alias("p"))
    whole = lambda v: (F.round(v * UNIT).cast("long") * F.col("n"))
    here = here.select("x", "n", whole(F.col("y") - F.col("p")).alias("g"), whole(F.col("p") * (1 - F.col("p")) + 1e-9).alias("h"))
    splits: dict[int, tuple[int, int]] = {}
    leaves: dict[int, float] = {}
    leaf = lambda g, h: float(STEP * g / (h + 1))

    def node(k: int) -> Column:
        """The number of the open node that a row is in (children of k: 2 k and 2 k + 1), null in a leaf."""
        if k in splits:
            f, most = splits[k]
            return F.when(F.get(x, F.lit(f)) <= most, node(2 * k)).otherwise(node(2 * k + 1))
        return F.lit(None).cast("int") if k in leaves and k not in open_ else F.lit(k)

    open_ = [1]
    for _ in range(DEPTH):
        each = here.select(node(1).alias("node"), "g", "h", "n", F.posexplode("x").alias("f", "value")).where("node is not null")
        sums: dict[int, dict[int, list]] = {}
        for r in each.groupBy("node", "f", "value").agg(*(F.sum(c).alias(c) for c in "ghn")).collect():  # nodes x features x values
            sums.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["value"], r["g"] / UNIT, r["h"] / UNIT, r["n"]))
        fresh = []
        for k in open_:
            best = (1e-6, None, None, None)
            for f, found in sorted(sums.get(k, {}).items()):
                value, *parts = np.array(sorted(found)).T
                gs, hs, n = (np.cumsum(v) for v in parts)
                leaves.setdefault(k, leaf(gs[-1], hs[-1]))
                gain, at = _cut(gs, hs, n, gs[-1] ** 2 / (hs[-1] + 1))
                if gain > best[0] * (1 + 1e-9):  # of equal gains the first feature's
                    best = (gain, f, int(value[at]), (leaf(gs[at], hs[at]), leaf(gs[-1] - gs[at], hs[-1] - hs[at])))
            if best[1] is not None:
                splits[k] = best[1:3]
                leaves[2 * k], leaves[2 * k + 1] = best[3]
                fresh += [2 * k, 2 * k + 1]
        open_ = fresh
        if not open_:
            break

    def tree(k: int):
        return (*splits[k], tree(2 * k), tree(2 * k + 1)) if k in splits else leaves[k]

    return tree(1)


def boosted(examples: DataFrame) -> Trees:
    """`boost` over a table of examples: x (array of small integers), y, held, n (how often). Thresholds are told apart to 1 / GRID."""
    n, right = examples.where("not held").agg(F.sum("n"), F.sum(F.col("y") * F.col("n"))).first()
    if not n or right in (0, n):
        return Trees([], 0.0, (1e9,) * len(KINDS))  # nothing to tell apart: nothing is added
    mean = right / n
    model, x, late = Trees([], float(np.log(mean / (1 - mean))), ()), F.col("x"), []
    rows = examples.withColumn("odds", F.lit(model.prior))
    for i in range(TREES):
        late.append(_grown(rows.where("not held"), F.col("odds") + Trees(late, 0.0, ()).odds(x)))
        if len(late) == SUMMED or i + 1 == TREES:
            rows = write_table(rows.withColumn("odds", F.col("odds") + Trees(late, 0.0, ()).odds(x)), "odds")
            model.trees, late = model.trees + late, []
    score = F.floor(F.least(F.greatest(F.col("odds"), F.lit(-float(FAR))), F.lit(float(FAR))) * GRID)
    found = rows.groupBy(F.get(x, F.lit(0)).alias("k"), "held", score.alias("score")).agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("y")).collect()  # at most 2 x GRID x FAR a kind and half
    thresholds = []
    for k in range(len(KINDS)):
        own = [r for r in found if r["k"] == k and r["held"]] or [r for r in found if r["k"] == k]
        floor = float(np.log(FLOOR / (1 - FLOOR)))
        if own:
            sums: dict[int, np.ndarray] = {}
            for r in own:
                sums[r["score"]] = sums.get(r["score"], np.zeros(2)) + (r["n"], r["y"])
            order = sorted(sums, reverse=True)
            n, y = np.cumsum([sums[v] for v in order], axis=0).T
            good = np.flatnonzero(y / n >= PRECISION)
            floor = max(floor, order[good[-1]] / GRID) if len(good) else 1e9
        thresholds.append(floor)
    return Trees(model.trees, model.prior, tuple(thresholds))


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """x, y, held, n of the candidates of all different texts of docs: base spans (y 1) and those that failed (0); a quarter of the texts is held.

    Texts are told apart by a hash; copies count once, and no text is shuffled.
    """
    rows = id_and_text(docs, id_col, text_col).where(F.col("text").rlike("[0-9]{3}|@")).select("text", F.xxhash64("text").alias("h"))
    kept = lambda a, y: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), _features(F.col("text"), s).alias("x"), F.lit(y).alias("y")))
    spans = F.concat(kept(F.col("base"), 1), kept(F.filter("failed", lambda s: ~F.exists("base", lambda b: _overlaps(s, b))), 0))
    each = _found(rows).select("h", F.explode(spans).alias("c")).select("h", "c.*").distinct()
    return each.groupBy("x", "y", (F.pmod("h", F.lit(4)) == 0).alias("held")).agg(F.count("*").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on the candidates of all different texts. A quarter of the texts sets the thresholds alone."""
    return boosted(write_table(examples(docs, id_col, text_col), "examples"))


def find(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base, spans (arrays of start, k, end, m in code points, by start and kind) of every row.

    Null texts count as empty. Copies and repeated rows get the same spans. No shuffle.
    """
    return _chosen(id_and_text(docs, id_col, text_col), trees)


def _chosen(rows: DataFrame, trees: Trees) -> DataFrame:
    own = rows.columns
    found = _found(rows)
    candidates = F.filter(F.concat("proposed", "failed"), lambda s: ~F.exists("base", lambda b: _overlaps(s, b)))
    scored = found.select(*own, "base", F.when(F.size(F.concat("proposed", "failed")) > 0, F.transform(candidates, lambda s: F.struct(s.alias("s"), _features(F.col("text"), s).alias("x")))).alias("c"))
    scored = scored.select(*own, "base", F.transform("c", lambda c: F.struct(trees.odds(c["x"]).alias("odds"), c["s"].alias("s"))).alias("c"))
    passes = lambda c: F.coalesce(*[F.when(c["s"]["k"] == k, c["odds"] >= t) for k, t in enumerate(trees.thresholds)])
    good = scored.select(*own, "base", F.filter("c", passes).alias("c"))
    better = lambda a, b: (a["odds"] > b["odds"]) | ((a["odds"] == b["odds"]) & ((a["s"]["start"] < b["s"]["start"]) | ((a["s"]["start"] == b["s"]["start"]) & (a["s"]["k"] < b["s"]["k"]))))
    added = F.coalesce(F.transform(F.filter("c", lambda a: ~F.exists("c", lambda b: _overlaps(a["s"], b["s"]) & better(b, a))), lambda c: c["s"]), _no_spans())
    return good.select(*own, "base", F.sort_array(F.concat("base", added)).alias("spans"))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every row."""
    found = find(docs, fit(docs))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; spans that overlap become one, named by the first.

    All columns stay, in order; a column n_chars gets the new length. Null texts become empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct("*").alias("row"))
    found = _chosen(rows, trees)
    text, zero = F.col("text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    name = lambda s: F.element_at(F.array(*(F.lit(f"<{k}>") for k in KINDS)), s["k"] + 1)
    part = lambda acc, s: F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), name(s))).otherwise(F.lit(""))
    folded = F.aggregate("spans", zero, lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], part(acc, s)).alias("out")))
    done = found.select("row", "text", folded.alias("f"))
    done = done.select("row", F.concat("f.out", F.substr(text, F.col("f.at") + 1)).alias("text"))
    changed = {text_col: F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])
