"""Byte-pair encoding as a deterministic automaton over token labels.

The automaton starts as one state with a loop for every base symbol and accepts every splitting of a
string into symbols. Each merge (u, v), in order, adds its gadget: arcs labelled u now lead to a copy of
their old target that lacks the arc v, and wherever u and then v could be read, an arc uv leads to v's
target. What is left at the end accepts exactly the encodings that the merges produce, one a string.

Where an arc leads depends on its label alone, so a state is shared by labels, and its transitions are told
by what it lacks. A merge (u, v) takes from a state the arc v and the arcs of all labels that begin with v
and come later. Numbered in postorder of the tree of first parts, children in the order of their merges,
those are neighbours, so a state's table is a sorted list of stretches of label numbers: a transition exists
if its number lies between two stretches. The tables are compiled once, before anything is read.

Encoding reads a piece from left to right and never goes back: each prefix has one accepted path, so each
place gets its state and last arc from the one transition that the tables allow to it. The arcs back from the
end give the ids. Decoding emits the arcs' labels.
"""

import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, id_and_text, map_slices
from .subwords import byte_pieces, word_pieces

#: Pieces in each of a worker's two tables of encoded pieces, and characters of the longest piece that they keep.
PIECES, LONGEST = 250_000, 128
NEVER = 1 << 60


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter of each byte, by the published rule: visible Latin-1 stands for itself, the rest for 256 and up."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Automaton:
    """Compiled merges: states, transitions, encode of one piece's symbols, labels of ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.labels = {i: t for t, i in vocab.items()}
        self.longest = max(map(len, vocab), default=1)
        size = max(vocab.values(), default=0) + 1
        self.part = [-1] * size  # a merged label's first part
        self.born = [-1] * size  # and the merge that made it
        self.state = [0] * size  # where arcs of this label lead
        self.lacks: list[dict[int, int]] = [{}]  # a state's lost arcs, by the merge that took them
        shared = [size]
        for now, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if not self._has(self.state[u], v):
                continue
            self.part[w], self.born[w] = u, now
            shared[self.state[w]] -= 1
            self.state[w] = self.state[v]
            shared[self.state[v]] += 1
            old = self.state[u]
            if shared[old] > 1:  # copy on write
                shared[old] -= 1
                self.state[u] = len(self.lacks)
                self.lacks.append(dict(self.lacks[old]))
                shared.append(1)
            self.lacks[self.state[u]][v] = now
        made = {left + right for left, right in merges}
        self.usable = {t: i for t, i in vocab.items() if self.born[i] >= 0 or t not in made}
        self._compile(size)
        del self.lacks

    def _has(self, state: int, label: int) -> bool:
        """Whether the state has an arc with this label."""
        lacks, until = self.lacks[state], NEVER
        if not lacks:
            return True
        while label >= 0:
            if lacks.get(label, NEVER) <= until and label in lacks:
                return False
            until, label = self.born[label], self.part[label]
        return True

    def _compile(self, size: int) -> None:
        """Numbers of labels, and each state's table: where stretches of missing numbers start and end, in turn."""
        children: dict[int, list[int]] = {}
        for w in sorted((w for w in range(size) if self.born[w] >= 0), key=self.born.__getitem__):
            children.setdefault(self.part[w], []).append(w)
        self.number, lowest, at = [0] * size, [0] * size, 0
        for root in range(size):
            if self.born[root] >= 0:
                continue
            stack = [(root, iter(children.get(root, ())))]
            lowest[root] = at
            while stack:
                label, rest = stack[-1]
                child = next(rest, None)
                if child is None:
                    self.number[label], at = at, at + 1
                    stack.pop()
                else:
                    lowest[child] = at
                    stack.append((child, iter(children.get(child, ()))))
        births = {v: [self.born[w] for w in ws] for v, ws in children.items()}

        def table(lacks: dict[int, int]) -> array:
            stretches = []
            for v, now in lacks.items():
                later = bisect_left(births.get(v, ()), now)
                stretches.append((lowest[children[v][later]] if later < len(births.get(v, ())) else self.number[v], self.number[v] + 1))
            bounds = array("I")
            for start, stop in sorted(stretches):
                if bounds and start <= bounds[-1]:
                    bounds[-1] = max(bounds[-1], stop)
                else:
                    bounds.extend((start, stop))
            return bounds

        self.tables = [table(lacks) for lacks in self.lacks]

    def step(self, state: int, label: int) -> bool:
        """Whether the state has an arc with this label, by its table."""
        return not bisect_right(self.tables[state], self.number[label]) & 1

    def encode(self, letters: str) -> list[int]:
        """The one accepted path over a piece's letters, the last of which carries the suffix."""
        n, get, number, tables, leads = len(letters), self.usable.get, self.number, self.tables, self.state
        states, starts, arcs = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                label = get(letters[start:end] if end < n else letters[start:] + self.suffix)
                if label is not None and not bisect_right(tables[states[start]], number[label]) & 1:
                    states[end], starts[end], arcs[end] = leads[label], start, label
                    break
            else:
                raise ValueError(f"no path over {letters!r}")
        ids, at = [], n
        while at:
            ids.append(arcs[at])
            at = starts[at]
        return ids[::-1]


class Codec:
    """encode(texts) -> arrays of ids; decode(ids) -> text, for a byte-lettered BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in pre.get("pretokenizers", [pre])]
        suffix = model.get("end_of_word_suffix") or ""
        if steps == ["Split", "ByteLevel"] and suffix:
            self.split = word_pieces
        elif steps == ["ByteLevel"] and not suffix and spec.get("normalizer") is None:
            self.split = byte_pieces
        else:
            raise ValueError(f"neither of the two known ways of splitting: {path}")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, suffix)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels = [""] * (max([*model["vocab"].values(), *self.added.values()]) + 1)
        for t, i in [*model["vocab"].items(), *self.added.items()]:
            self.labels[i] = t
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.table = str.maketrans({b: c for b, c in enumerate(self.letters)})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, key: str | int) -> bytes:
        """Packed ids of a piece or an added token."""
        if isinstance(key, int):
            return array("I", [key]).tobytes()
        # bytes as Latin-1 characters, then each as its letter
        return array("I", self.automaton.encode(key.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table))).tobytes()

    def _cut(self, text: str) -> list[str | int]:
        """Pieces of a text, with the ids of added tokens found in it."""
        if not any(a in text for a in self.added):
            return self.split(text)
        out: list[str | int] = []
        while text:
            at, neg, token = min(((text.find(a), -len(a), a) for a in self.added if a in text), default=(-1, 0, ""))
            if not token:
                out += self.split(text)
                break
            out += [*self.split(text[:at]), self.added[token]]
            text = text[at - neg :]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = []
        for text in texts:
            cut = self._cut(text)
            ids = list(map(known.get, cut))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        key = cut[i]
                        if (x := known.get(key)) is None:
                            x = older.get(key)
                            x = self._piece(key) if x is None else x
                            if isinstance(key, int) or len(key) <= LONGEST:
                                known[key] = x
                        ids[i] = x
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The arcs' labels: letters back to bytes where the file has a byte decoder, else joined by a space."""
        labels = map(self.labels.__getitem__, ids.tolist())
        if not self.bytewise:
            return " ".join(labels)
        back = self.bytes_of
        return b"".join(bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in labels).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One compiled codec a worker process and file."""
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row's whole text (null: no ids). No shuffle; repeated rows stay repeated."""

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": column(part, "doc_id"), "ids": [x.tolist() for x in codec(tokenizer).encode(column(part, "text").to_pylist())]}

    return map_slices(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of every row of doc_id, ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(tokenizer).decode(np.asarray(x or [], "u4")) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode, then decode of those ids, told by digests: doc_id, n_tokens, ids_sha256, decoded_sha256; no shuffle."""

    def run(part: pa.RecordBatch) -> dict:
        coder, counts, of_ids, of_text = codec(tokenizer), [], [], []
        for ids in coder.encode(column(part, "text").to_pylist()):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest())
            of_text.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return {"doc_id": column(part, "doc_id"), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_slices(id_and_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
