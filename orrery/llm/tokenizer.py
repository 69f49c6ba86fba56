"""Encoding by a byte-level BPE vocabulary through an automaton built from its merges."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the public pattern that splits a text before byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = (b for b in range(256) if b not in set(plain))
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}
    return [letters[b] for b in range(256)]


class Automaton:
    """Deterministic automaton over tokens that accepts exactly the correct BPE segmentations.

    A state is the token read last; its arcs are the tokens that may follow. It starts as one state per byte,
    each with an arc for every byte. The gadget of merge number r, (x, y) → z, in order of the merges, adds
    state z, which takes over the arcs of y as they are then, gives an arc z to every state that has an arc x then,
    and takes arc y from state x. The arcs aren't stored: each state and each arc keeps the step at which
    it was made and what it was made from (tables left, right, step), and whether a state has an arc follows from
    the gadgets that touched the two chains. Asked arcs are remembered in a table.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], remember: int = 2_000_000) -> None:
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ids = {t: i for t, i in vocabulary.items()}
        self.size, self.remember = max(ids.values()) + 1, remember
        self.left, self.right, self.step = [-1] * self.size, [-1] * self.size, [0] * self.size
        self.label: list[bytes] = [b""] * self.size
        self.by_label: dict[bytes, int] = {}
        self.gadgets: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for b, c in enumerate(letters):
            if c in ids:
                self._add(ids[c], bytes([b]))
        for r, (x, y) in enumerate(merges, 1):
            z, i, j = ids[x + y], ids[x], ids[y]
            self.left[z], self.right[z], self.step[z] = i, j, r
            made = all(self.by_label.get(self.label[t]) == t for t in (i, j)) and self._arc(i, j)
            self.label[z] = bytes(back[c] for c in x + y)
            if made:  # else earlier gadgets leave this merge nothing to do, and no text is ever split into z
                self._add(z, self.label[z])
            self.gadgets[i * self.size + j] = r
        self.longest = max(map(len, self.by_label), default=0)

    def _add(self, token: int, label: bytes) -> None:
        self.label[token] = label
        self.by_label[label] = token

    def may_follow(self, state: int, token: int) -> bool:
        """Whether state has an arc token."""
        key = state * self.size + token
        known = self.arcs.get(key)
        if known is None:
            known = self._arc(state, token)
            if len(self.arcs) >= self.remember:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _arc(self, state: int, token: int) -> bool:
        # x runs over the states from which state inherits, until when it does; y over the arcs from which token was made
        x, x_until = state, 1 << 60
        while x >= 0:
            y, y_until = token, 1 << 60
            while y >= 0:
                r = self.gadgets.get(x * self.size + y)
                if r is not None and r < x_until and r <= y_until:
                    return False
                y, y_until = self.left[y], self.step[y]
            x, x_until = self.right[x], self.step[x]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The one path of the automaton that spells word; the state after every prefix is found from left to right."""
        n = len(word)
        if (whole := self.by_label.get(word)) is not None:
            return [whole]
        state = [-1] * (n + 1)
        find, may = self.by_label.get, self.may_follow
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = find(word[start:end])
                if token is not None and (start == 0 or (state[start] >= 0 and may(state[start], token))):
                    state[end] = token
                    break
        path = []
        while n > 0:
            token = state[n]
            if token < 0:
                raise ValueError(f"the vocabulary has no token for {word[:n]!r}")
            path.append(token)
            n -= len(self.label[token])
        return path[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(self.label[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str = VOCABULARY) -> Automaton:
    """The automaton of a byte-level vocabulary file; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges)


class _Words(dict):
    """Word → ids, filled on demand and emptied at a bound."""

    def __init__(self, automaton: Automaton, bound: int = 200_000) -> None:
        self.automaton, self.bound = automaton, bound

    def __missing__(self, word: str) -> list[int]:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = ids
        return ids


def encode_texts(df: DataFrame, doc_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (list of int) of every text, whole, without special tokens; no shuffle.

    Null and empty texts have an empty list. A text that looks like a special token is plain text. One row per
    input row, also for repeated texts. The automaton (a few MB, its size is that of the vocabulary) is broadcast;
    a task holds one Arrow batch and a bounded table of words.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = _Words(shared.value), regex.compile(PATTERN).findall
        for batch in batches:
            ids: list[int] = []
            offsets = [0]
            for t in batch.column(1).to_pylist():
                if t:
                    for word in split(t):
                        ids += words[word]
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return df.select(doc_id, text).mapInArrow(encode, schema)


def decode_ids(df: DataFrame, doc_id: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of every list of ids; a null list has a null text, an empty one the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(doc_id, ids).mapInArrow(decode, schema)
