"""Byte-level BPE encoding and decoding by traversal of a trie of distinct words.

The last token of every prefix is a function of the prefix alone: among the vocabulary entries that end the
prefix there is exactly one that can follow the last token of what stands before it. So words are put into
a trie, a depth-first walk carries the last-token states downwards, and the encoding of a shared prefix is
computed once. Sorted distinct words are that trie in depth-first order: moving on to the next word keeps the
states of the common prefix and drops the rest, so that no nodes need to be stored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, arrow_limits, by_batches, release_memory, texts

# White space and the word pattern of the byte-level pre-tokeniser.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"
PIECES = _WORDS.format(L=r"\p{L}", N=r"\p{N}", W=WHITE)
#: Bytes of words and their ids that stay known in one process (twice, while the older half is on its way out), and bytes of ids that are decoded at once.
CACHE_BYTES, DECODE_BYTES = 24 << 20, 1 << 20
#: Texts of these characters alone go through the plain engine, with letters and numbers spelled out.
COMMON = r"\x00-\u024f\u2000-\u206f\u20a0-\u20bf"
COMMON_PIECES = _WORDS.format(L="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", N="0-9\xb2\xb3\xb9\xbc-\xbe", W=WHITE)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary; path is a tokenizer file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[self.ids[a], self.ids[b]] = rank
            self.parts.setdefault(self.ids[a + b], (self.ids[a], self.ids[b], rank))
        self.sizes = {i: len(b) for b, i in self.ids.items()}
        self.marks = {i: array("I", [i]).tobytes() for i in self.ids.values()}
        #: All beginnings of vocabulary entries; a state is the longest of them that a prefix ends with.
        self.starts = {b[:n] for b in self.ids for n in range(1, len(b) + 1)}
        #: By state: the lengths and tokens of the vocabulary entries that it ends with, longest first.
        self.endings: list[tuple[tuple[int, int], ...]] = [()]
        self.states: dict[bytes, int] = {b"": 0}
        self.names = [b""]
        #: The next state by state and byte, worked out when first met.
        self.moves: dict[int, int] = {}
        self.follows: dict[int, bool] = {}
        n = max(self.bytes) + 1
        self.lengths = np.array([len(self.bytes.get(i, b"")) for i in range(n)], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(n)), np.uint8)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.common = re.compile(f"[{COMMON}]*").fullmatch
        self.common_pieces = re.compile(COMMON_PIECES).findall
        self.all_pieces = regex.compile(PIECES).findall
        self.cache = TwoGenerationCache(CACHE_BYTES)

    def pieces(self, text: str) -> list[str]:
        return self.common_pieces(text) if self.common(text) else self.all_pieces(text)

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        name = self.names[state] + bytes((byte,))
        while name not in self.starts and name:
            name = name[1:]
        to = self.states.get(name)
        if to is None:
            to = self.states[name] = len(self.names)
            self.names.append(name)
            self.endings.append(tuple((len(name) - i, t) for i in range(len(name)) if (t := self.ids.get(name[i:])) is not None))
        self.moves[state << 8 | byte] = to
        return to

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of token while it is being built, each with the rank that ends it."""
        out, end = [(token, float("inf"))], None
        while (made := self.parts.get(token)) is not None:
            token, end = made[side], made[2]
            out.append((token, end))
        return out

    def can_follow(self, a: int, b: int) -> bool:
        """Whether the text of a and b together is encoded as [a, b]: no merge ever crosses the seam.

        A crossing merge happens if its rank comes before the one that ends its left part, and no later than the
        one that ends its right part (of equal merges the leftmost goes first).
        """
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            right = self._edge(b, 0)
            known = not any((m := self.merge.get((x, y))) is not None and m < x_end and m <= y_end for x, x_end in self._edge(a, 1) for y, y_end in right)
            if len(self.follows) > 150_000:
                self.follows.clear()
            self.follows[key] = known
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers; each trie node is visited once."""
        moves, endings, follows, sizes, marks, out = self.moves, self.endings, self.follows, self.sizes, self.marks, {}
        # along the path to the current node: the state, and the last token's id, of every prefix
        states, last, before = [0], [-1], b""
        for word in sorted(words):
            depth, n = 0, len(word)
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                depth += 1
            del states[depth + 1 :], last[depth + 1 :]
            state = states[depth]
            for end in range(depth + 1, n + 1):
                to = moves.get(state << 8 | word[end - 1])
                state = self._move(state, word[end - 1]) if to is None else to
                states.append(state)
                for k, token in endings[state]:
                    if k == end:
                        break
                    ok = follows.get(last[end - k] << 32 | token)
                    if ok or ok is None and self.can_follow(last[end - k], token):
                        break
                last.append(token)
            tokens, end = [], n
            while end:
                tokens.append(marks[t := last[end]])
                end -= sizes[t]
            tokens.reverse()
            out[word] = b"".join(tokens)
            before = word
        return out

    def forget(self) -> None:
        """Empties the cache, so that an idle worker holds little more than the vocabulary."""
        self.cache = TwoGenerationCache(CACHE_BYTES)
        release_memory()

    def learn(self, pieces: list[str]) -> None:
        """Puts the encodings of pieces that are not known yet into the cache."""
        new = self.cache.missing(pieces)
        if new:
            raw = [p.encode() for p in new]
            known = self.encode_words(raw)
            self.cache.add(new, [known[p] for p in raw])

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; strings of special tokens become those tokens."""
        cut = [self.split(t) if self.split and any(s in t for s in self.special) else [t] for t in batch]
        found = [[self.pieces(p) if i % 2 == 0 else p for i, p in enumerate(ps)] for ps in cut]
        self.learn([c for ps in found for p in ps[::2] for c in p])
        get = self.cache.young.__getitem__
        mark = {s: array("I", [i]).tobytes() for s, i in self.special.items()}
        return [b"".join([b"".join(map(get, p)) if i % 2 == 0 else mark[p] for i, p in enumerate(ps)]) for ps in found]

    def decode_batch(self, batch: list[bytes]) -> list[str]:
        """The text of each one's ids, gathered from the bytes of all tokens in a row; not valid UTF-8 becomes U+FFFD."""
        out, at = [], 0
        while at < len(batch):
            stop, held = at, 0
            while stop < len(batch) and (stop == at or held + len(batch[stop]) <= DECODE_BYTES):
                held += len(batch[stop])
                stop += 1
            part = batch[at:stop]
            at = stop
            ids = np.frombuffer(b"".join(part), "<u4")
            sizes = self.lengths[ids]
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1] if len(ends) else 0)
            place += np.repeat(self.offsets[ids] - ends + sizes, sizes)
            data = self.blob[place].tobytes()
            cuts = [0, *np.concatenate([[0], ends])[np.cumsum([len(x) // 4 for x in part])].tolist()]
            out += [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return out

    def decode(self, ids: bytes) -> str:
        return self.decode_batch([ids])[0]


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary, once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Encodes every whole text and decodes it again: id_col, columns to keep, token_ids (binary: little-endian unsigned 32-bit),
    same (whether decoding gave the text back), and, with_text, decoded.

    A null text counts as empty (no ids, decoded ''); rows with equal or null ids each get a row; an empty table
    gives an empty result; other columns are not read.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in by_batches(batches):
            given = texts(b, b.num_columns - 1)
            ids = bpe.encode_batch(given)
            decoded = bpe.decode_batch(ids)
            out = {"token_ids": pa.array(ids, pa.binary()), "same": pa.array([x == y for x, y in zip(given, decoded, strict=True)], pa.bool_())} | ({"decoded": pa.array(decoded, pa.string())} if with_text else {})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out.values()], [*b.schema.names[:-1], *out])
        bpe.forget()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, token_ids binary, same boolean" + ", decoded string" * with_text)


def n_tokens(token_ids) -> F.Column:
    """The number of ids in a binary column of ids."""
    return F.expr(f"octet_length({token_ids}) div 4").cast("long")
