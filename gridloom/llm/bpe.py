"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled once into a deterministic automaton over tokens. It
starts as one state with an arc for each byte, and each merge (u, v) -> w adds
a gadget: arcs of u lead to a copy of their target without the arc v, and w gets
an arc wherever u has one, leading where v led. What the automaton accepts are
exactly the token sequences that BPE makes, and the accepted sequence of a word
is unique. All arcs of a token lead to one state, so a state is named by the
token read last, and a row of the transition table only says which arcs are
gone. With the tokens numbered so that those that begin with v, made by later
merges, and v itself stand side by side, every gadget takes away one run of
numbers; a row holds the runs of its gadgets, joined and sorted. The table of a
50,000-merge vocabulary has 800,000 runs and is compiled in a second.

A word is encoded by table lookups, byte by byte, never going back: a trie of
the labels with failure links gives the longest token that ends at a byte, links
from token to token the shorter ones, and of these the one counts that has an
arc from the state at its start. Each byte has exactly one, so the last byte's
token leads back through the word's ids. Texts are pre-split by the vocabulary's
pattern; words seen before come from a bounded table. Decoding emits the label
(bytes) of each arc.

Null texts are empty: no ids, empty decoded text. Special tokens of the file
that stand in a text become their ids, as the tokenizers library has it by
default. Very long words take time in proportion to their length. Repeated rows
give one row each; an empty table gives no rows; other columns are passed by.
Bytes that are not UTF-8 after decoding (id lists cut inside a character) become
U+FFFD. A vocabulary that makes one token by two merges is refused.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import WordIds

#: Words whose ids a worker remembers at most; any other word is encoded anew.
REMEMBERED = 800_000
#: White space of the pre-splitting pattern (the Unicode property), fixed values.
WHITE = "\t-\r \x85\xa0  -     　"


def _ranges(kind: str, limit: int) -> str:
    """A character class body of all code points below ``limit`` whose category starts with ``kind``."""
    out, start = [], None
    for c in range(limit + 1):
        inside = c < limit and unicodedata.category(chr(c)).startswith(kind)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(4)
def splitter(limit: int = sys.maxunicode + 1) -> re.Pattern:
    """The byte-level vocabulary's pattern, its classes spelled out, for texts of code points below ``limit``."""
    letters, numbers = _ranges("L", limit), _ranges("N", limit)
    return re.compile(f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@lru_cache(1)
def unknown() -> re.Pattern:
    """Code points that this Python's Unicode tables don't know; the library's may."""
    return re.compile(f"[{_ranges('Cn', sys.maxunicode + 1)}]")


@lru_cache(1)
def library_split():
    from tokenizers.pre_tokenizers import ByteLevel

    tool, alphabet = ByteLevel(add_prefix_space=False, use_regex=True), byte_alphabet()
    return lambda text: [bytes(map(alphabet.__getitem__, w)).decode() for w, _ in tool.pre_tokenize_str(text)]


def split(text: str) -> list[str]:
    """The words of a text; small classes are matched faster, so they are taken where they suffice."""
    if text.isascii():
        return splitter(0x80).findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return library_split()(text) if unknown().search(text) else splitter().findall(text)
    return splitter(0x100).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The vocabulary's printable stand-in for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class Automaton:
    """Tokens with their labels, the table of arcs, and the trie that finds the tokens ending at a byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.labels: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.labels[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.size = size
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        bytes_of = [vocab[c] for c in alphabet if c in vocab]
        self._trie(bytes_of + self._compile(np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)))

    def _compile(self, merges: np.ndarray) -> list[int]:
        """Lay out the table of arcs, gadget by gadget; the tokens that some gadget makes."""
        left, right, whole = merges.T
        n, number = len(merges), np.arange(len(merges))
        made, begins, ends_in = (np.full(self.size, -1, np.int64) for _ in range(3))
        made[whole], begins[whole], ends_in[whole] = number, left, right
        if len(np.unique(whole)) < n:
            raise ValueError("the vocabulary makes a token by two merges")
        # Post-order over "begins with", made earlier first: v and what its later merges made are one run, v last.
        place, first = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        longer: dict[int, list[int]] = {}
        for u, w in zip(left.tolist(), whole.tolist(), strict=True):
            longer.setdefault(u, []).append(w)
        count = 0
        for root in np.flatnonzero(begins < 0).tolist():
            first[root], stack = count, [(root, 0)]
            while stack:
                token, k = stack.pop()
                if k < len(own := longer.get(token, ())):
                    first[own[k]] = count
                    stack += [(token, k + 1), (own[k], 0)]
                else:
                    place[token] = count
                    count += 1
        run_from, run_to = place[right].copy(), place[right] + 1
        for k, v in enumerate(right.tolist()):
            own = longer.get(v, ())
            later = bisect.bisect_left(own, k, key=made.__getitem__)
            if later < len(own):
                run_from[k] = first[own[later]]
        # The gadgets at a token's state, in order: those of the token, and of what its state was copied from before that copy.
        at = np.argsort(left, kind="stable")
        keys, start = left[at] * (n + 1) + at, np.searchsorted(left[at], np.arange(self.size))

        def gadgets(state: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            row = np.arange(len(state))
            while len(row):
                times = np.searchsorted(keys, state * (n + 1) + before) - start[state]
                inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield np.repeat(row, times), at[np.repeat(start[state], times) + inner]
                copied = ends_in[state] >= 0
                row, before, state = row[copied], made[state[copied]], ends_in[state[copied]]

        found = [np.concatenate(x) for x in zip(*gadgets(np.arange(self.size), np.full(self.size, n)), strict=True)]
        wide = np.int64(count + 1)
        opens, closes = found[0] * wide + run_from[found[1]], found[0] * wide + run_to[found[1]]
        order = np.argsort(opens, kind="stable")
        opens, closes = opens[order], np.maximum.accumulate(closes[order])
        new = np.append(True, opens[1:] > closes[:-1]) if len(opens) else np.zeros(0, bool)
        last = np.append(np.flatnonzero(new)[1:], len(opens)) - 1 if len(opens) else np.zeros(0, np.int64)
        runs = np.stack([opens[new], closes[last]], axis=1)
        self.rows = (2 * np.searchsorted(runs[:, 0], np.arange(self.size + 1) * wide)).tolist()
        self.gone = array("i", (runs - (runs[:, :1] // wide) * wide).astype(np.int32).ravel().tobytes())
        self.place = place.tolist()
        # A gadget whose arc v was gone from the state of u by then makes nothing.
        idle = np.zeros(n, bool)
        for k, gadget in gadgets(left, number):
            idle[k[(run_from[gadget] <= place[right[k]]) & (place[right[k]] < run_to[gadget])]] = True
        alive = np.ones(self.size, bool)
        for k, (u, v, w) in enumerate(merges.tolist()):
            alive[w] = alive[u] and alive[v] and not idle[k]
        return whole[alive[whole]].tolist()

    def _trie(self, tokens: list[int]) -> None:
        """goto: (node, byte) to node; fail: the node of the longest proper suffix; longest: the longest token that ends a node; shorter: the next one that ends a token."""
        self.goto: dict[int, int] = {}
        self.fail, self.longest, self.shorter = [0], [-1], [-1] * self.size
        self.lengths = list(map(len, self.labels))
        for token in tokens:
            node = 0
            for byte in self.labels[token]:
                node = self.goto.setdefault(node << 8 | byte, len(self.fail))
                if node == len(self.fail):
                    self.fail.append(0)
                    self.longest.append(-1)
            self.longest[node] = token
        level = [(0, byte, node) for byte in range(256) if (node := self.goto.get(byte))]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.goto.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        while level:
            after = []
            for above, byte, node in level:
                if above:
                    back = self.fail[above]
                    while back and back << 8 | byte not in self.goto:
                        back = self.fail[back]
                    self.fail[node] = self.goto.get(back << 8 | byte, 0)
                token, other = self.longest[node], self.longest[self.fail[node]]
                if token < 0:
                    self.longest[node] = other
                else:
                    self.shorter[token] = other
                after += [(node, *x) for x in below.get(node, ())]
            level = after

    def follows(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` leads to has an arc for ``token``."""
        return not bisect.bisect_right(self.gone, self.place[token], self.rows[last], self.rows[last + 1]) & 1

    def word(self, word: bytes) -> list[int]:
        """The ids on the one accepted path that spells ``word``."""
        goto, fail, longest, shorter, lengths = self.goto, self.fail, self.longest, self.shorter, self.lengths
        gone, place, rows, find = self.gone, self.place, self.rows, bisect.bisect_right
        ends, node = [-1], 0  # the token that ends at each byte
        for at, byte in enumerate(word, 1):
            step = goto.get(node << 8 | byte)
            while step is None and node:
                node = fail[node]
                step = goto.get(node << 8 | byte)
            node = step or 0
            token = longest[node]
            while token >= 0:
                last = ends[at - lengths[token]]
                if last < 0 or not find(gone, place[token], rows[last], rows[last + 1]) & 1:
                    break
                token = shorter[token]
            else:
                raise ValueError(f"no path for {word[:at][-50:]!r}: the vocabulary lacks a byte")
            ends.append(token)
        out, at = [], len(word)
        while at:
            out.append(ends[at])
            at -= lengths[ends[at]]
        return out[::-1]

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, piece) runs of a text; pieces are whole texts where nothing special occurs."""
        if not any(s in text for s in self.special):
            yield False, text
            return
        for k, part in enumerate(re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text)):
            if part:
                yield bool(k % 2), part


class Encoder:
    """An automaton with the memory of words; one per worker."""

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self.words = WordIds(lambda w: self.automaton.word(w.encode("utf-8", "surrogatepass")), split, np.uint32, REMEMBERED)
        labels = self.automaton.labels
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_sizes = np.array(list(map(len, labels)), np.int64)
        self.label_starts = np.concatenate([[0], np.cumsum(self.label_sizes)[:-1]])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; special tokens in a text stand for themselves."""
        pieces = [list(self.automaton.pieces(t)) for t in texts]
        plain = iter(self.words.encode([p for own in pieces for special, p in own if not special]))
        ids = [[np.array([self.automaton.special[p]], np.uint32) if special else next(plain) for special, p in own] for own in pieces]
        return [own[0] if len(own) == 1 else np.concatenate([np.zeros(0, np.uint32), *own]) for own in ids]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The arc labels of some ids, one after the other."""
        sizes = self.label_sizes[ids]
        total = int(sizes.sum())
        if not total:
            return b""
        ends = np.cumsum(sizes)
        return self.label_bytes[np.repeat(self.label_starts[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def lossy(data: bytes) -> str:
    return data.decode("utf-8", "replace")


#: Decimal digits and a comma of each id are looked up, not formatted anew.
_decimals: dict[int, str] = {}


def id_list(ids: np.ndarray, size: int) -> bytes:
    """Decimal ids joined by commas."""
    if not _decimals:
        _decimals.update(enumerate(map(str, range(max(size, 1 << 16)))))
    return ",".join(map(_decimals.__getitem__, ids.tolist())).encode()


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, token_ids, decoded of each text."""
    return _run(docs, vocabulary, id_col, text_col, full=True)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each text."""
    return _run(docs, vocabulary, id_col, text_col, full=False)


def _run(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, full: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                counts, left, right = [], [], []
                for ids in tool.encode_all([t or "" for t in part.column("text").to_pylist()]):
                    decoded = tool.decode(ids)
                    counts.append(len(ids))
                    if full:
                        left.append(ids.astype(np.int32))
                        right.append(lossy(decoded))
                    else:
                        left.append(hashlib.sha256(id_list(ids, tool.automaton.size)).hexdigest())
                        right.append(hashlib.sha256(decoded if decoded.isascii() else lossy(decoded).encode()).hexdigest())
                ids = pa.array(left, pa.list_(pa.int32())) if full else pa.array(left, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), ids, pa.array(right, pa.string())], names)

    names = ["id", "n_tokens", "token_ids", "decoded"] if full else ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ddl = f"id {kind}, n_tokens long, " + ("token_ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string")
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)
    return out.withColumnRenamed("id", id_col)
