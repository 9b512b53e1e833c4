"""Encoding of a corpus with a public byte-level BPE tokenizer, by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens whose paths
are exactly the token sequences BPE gives: starting from one state with an arc
per byte, each merge u v -> w adds one gadget. All arcs labelled u are led to a
new state, a copy of their old target without the arc v, and w gets an arc
beside each u that could be followed by v. A pre-split word is encoded by the
only path that spells it; decoding emits the arcs' labels.

A state is kept as the difference from the state it copies, so that a gadget
costs the same however many arcs a state has, and copies of one token's states
are found by bisection; the transition table is filled as
transitions are asked for.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.recent import Recent
from millrace.session import spread

#: The published pre-splitting pattern of the 50k byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks aren't 0, 1, 2, ...")
    return [t for _, t in pairs]


class TokenAutomaton:
    """The automaton of a vocabulary whose ids are its merge ranks, bytes first."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        # the id of each token, -1 for what only begins one; and of each token the longest shorter one that begins it
        self.begun = dict.fromkeys((t[:n] for t in tokens for n in range(1, len(t))), -1) | self.ids
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in tokens]
        # a label's left part, for labels made by merges
        self.left: list[int] = [-1] * len(tokens)
        # states of one token's gadgets follow one another: each copies the one before, the first the token's first target
        self.owner, self.copied, self.born = [-1], [-1], [-1]
        self.states: list[list[int]] = [[] for _ in tokens]
        self.lacking: dict[tuple[int, int], int] = {}
        self.target = [0] * len(tokens)
        #: Whether a state has an arc with a label, as far as asked for.
        self.table = Recent(lambda asked: self._has(*asked), 4_000_000)
        for w, token in enumerate(tokens):
            if len(token) > 1:
                self._gadget(w, *self._parts(token, w))

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``: what BPE with the earlier merges leaves of it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ids.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best[0] >= rank:
                raise ValueError(f"{token!r} has no two parts")
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def _gadget(self, w: int, u: int, v: int) -> None:
        before, after, state = self.target[u], self.target[v], len(self.copied)
        self.copied.append(before)
        self.owner.append(u)
        self.born.append(w)
        self.states[u].append(state)
        self.lacking[u, v] = state
        self.target[u], self.target[w], self.left[w] = state, after, u

    def _has(self, state: int, label: int) -> bool:
        while state:
            if label >= self.born[state] and self.left[label] >= 0:
                label = self.left[label]  # made with or after the state, beside its left part's arc
                continue
            u = self.owner[state]
            without = self.lacking.get((u, label))
            if without is not None and without <= state:
                return False
            # down the copies to the first state that the label is younger than
            own = self.states[u]
            at = bisect_left(own, label, hi=bisect_right(own, state), key=self.born.__getitem__)
            if at < len(own) and self.born[own[at]] == label and own[at] <= state:
                at += 1
            state = own[at - 1] if at else self.copied[own[0]]
        return True

    def _longest(self, word: bytes, at: int) -> int:
        """The longest token that ``word`` goes on with at a place."""
        begun, found, end = self.begun, -1, at + 1
        while (label := begun.get(word[at:end])) is not None and end <= len(word):
            found = label if label >= 0 else found
            end += 1
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels of the only path that spells ``word``.

        At each state the longest token with an arc is tried first. Just one
        path leads to a place in the word, so a place from which none goes on is
        given up for good.
        """
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        size, tokens, table, target, shorter = len(word), self.tokens, self.table, self.target, self.shorter
        out: list[int] = []
        closed: set[int] = set()
        at = state = 0
        label = self._longest(word, 0)
        while at < size:
            while label >= 0 and (at + len(tokens[label]) in closed or not table[state, label]):
                label = shorter[label]
            if label >= 0:
                out.append(label)
                at, state = at + len(tokens[label]), target[label]
                label = self._longest(word, at)
            else:
                closed.add(at)
                last = out.pop()
                at, state, label = at - len(tokens[last]), target[out[-1]] if out else 0, shorter[last]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


#: A blank beside other white space, or a second blank.
_RUN = re.compile(r" \s|[^\S ] ")


class Encoder:
    """Encodes texts: pre-splits them and runs each word through the automaton.

    No word of the pattern goes on over a single blank, so the pieces between
    blanks are encoded on their own, each with the blank before it; pieces and
    words met of late are remembered. A text in which blanks meet other white
    space is pre-split as a whole.
    """

    def __init__(self, automaton: TokenAutomaton, pattern: str = PATTERN, remember: int = 300_000):
        self.automaton, self.split = automaton, regex.compile(pattern).findall
        # ids as 32-bit integers, ready to be joined
        self.words = Recent(lambda word: array("i", automaton.encode(word.encode("utf-8"))).tobytes(), remember)
        self.pieces = Recent(lambda piece: self._whole(" " + piece), remember)

    def _whole(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.split(text)])

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as consecutive 32-bit integers."""
        if not text:
            return b""
        if _RUN.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        pieces = self.pieces
        return self._whole(first) + b"".join([pieces[p] for p in rest])

    def __call__(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


def token_ids(documents: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row, without special tokens; their strings are ordinary text.

    ``vocabulary`` is the path of the vocabulary file, which is sent to the
    executors. A null and an empty text have the empty list. Rows stay as they
    are, repeated ones too; texts go whole.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[key]
    sent = spark.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder_of(sent.value)
        for batch in batches:
            packed = [encode.packed(t) for t in batch.column(1).to_pylist()]
            ends = pa.array([0, *accumulate(len(p) // 4 for p in packed)], pa.int32())
            data = b"".join(packed)
            ids = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, ids)], names=[key, "ids"])

    return spread(documents.select(F.col(key), F.col(text)), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


_MADE: dict[int, Encoder] = {}


def _encoder_of(data: bytes) -> Encoder:
    """The encoder of a vocabulary file's content, made once in a worker."""
    if hash(data) not in _MADE:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
        _MADE[hash(data)] = Encoder(TokenAutomaton([t for _, t in pairs]))
    return _MADE[hash(data)]


def p8_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of each document by byte_bpe_50k."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", vocabulary)
