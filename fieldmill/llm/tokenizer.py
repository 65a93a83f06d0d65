"""Byte-level BPE as a lazily determinised finite-state transducer, run over a whole corpus.

A BPE encoding is the one sequence of vocabulary entries whose neighbours are all *compatible* (two entries are compatible if merging
their joint bytes gives back exactly those two). So a left-to-right machine needs, for every place where an entry could still
begin, the node of the vocabulary trie reached since then and the entry that ends there. That tuple is the transducer's state. States
and transitions are built when first met (lazily), and each live alternative carries the output that is not yet common to all of
them; the common part is emitted at once, so a token comes out after a lookahead bounded by the longest entry.

The pre-tokens of the public pattern are the transducer's words. Between whitespace and the next whitespace nothing depends on the
rest of the text, so the output for such a chunk is remembered as raw int32 bytes, and an encoded text is a join of byte strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the public vocabulary; every function takes another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Unicode White_Space, and the pre-token pattern of the public byte-level BPE with that class written out.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_WORD = regex.compile(PATTERN)
# The same words for ASCII texts, for the faster of the two engines.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_LONG = 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Vocabulary file (base64 entry, rank) to entries by bytes."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The defining procedure: join the neighbouring pair of lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if best == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class BpeTransducer:
    """Deterministic transducer over bytes. ``max_states`` bounds its memory: beyond it the built part is dropped and grown anew."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.entries = {i: w for w, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for word, token in ranks.items():
            node = 0
            for byte in word:
                node = self.child[node].setdefault(byte, len(self.child))
                if node == len(self.ends):
                    self.child.append({})
                    self.ends.append(-1)
            self.ends[node] = token
        self._split: dict[int, tuple[int, int]] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: live alternatives (trie node, entry before it, pending output); the last one is the end of the text so far.
        start = ((0, -1, ()),)
        self.index = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two entries whose merge made ``token``; of a single byte, itself twice."""
        found = self._split.get(token)
        if found is None:
            word, ranks = self.entries[token], self.ranks
            cuts = [(max(a, b), a, b) for i in range(1, len(word)) if (a := ranks.get(word[:i], -1)) >= 0 and (b := ranks.get(word[i:], -1)) >= 0]
            cuts = [x for x in cuts if x[0] < token]
            if len(cuts) > 1:
                parts = merge_bytes(word, {w: r for i in range(len(word)) for j in range(i + 1, len(word) + 1) if (r := ranks.get(w := word[i:j], token)) < token})
                found = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
            else:
                found = cuts[0][1:] if cuts else (token, token)
            self._split[token] = found
        return found

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: begin the word): no merge across their border comes before those inside them.

        Walks down the two derivations from the border, the younger entry first, and looks for a merge of the two inner ends that is
        older than what they became part of.
        """
        if before < 0:
            return True
        left, right, until = before, token, 1 << 40
        ranks, entries, halves = self.ranks, self.entries, self._halves
        while True:
            joint = ranks.get(entries[left] + entries[right])
            if joint is not None and joint < until and halves(joint) == (left, right):
                return False
            inner_left, inner_right = halves(left)[1], halves(right)[0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                left, until = inner_left, left
            else:
                right, until = inner_right, right + 1

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, here = [], None
        for node, before, pending in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            token = self.ends[to]
            if here is None and token >= 0 and self.fits(before, token):
                here = (0, token, (*pending, token))
            if self.child[to]:
                live.append((to, before, pending))
        if here is None:
            raise ValueError("the vocabulary lacks a byte")
        live.append(here)
        common, first = 0, live[0][2]
        if first:
            common = min(len(x[2]) for x in live)
            while common and any(x[2][:common] != first[:common] for x in live):
                common -= 1
        out = first[:common]
        new = tuple((node, before, pending[common:]) for node, before, pending in live)
        at = self.index.get(new)
        if at is None:
            if len(self.states) >= self.max_states:  # also within a word, however long it is
                self._reset()
                state = -1
            at = self.index[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        if state >= 0:
            self.moves[state][byte] = (at, out)
        return at, out

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-token."""
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in word:
            step = moves[state].get(byte)
            if step is None:
                step = self._move(state, byte)
                moves = self.moves
            state = step[0]
            if step[1]:
                out += step[1]
        out += self.states[state][-1][2]
        return out


class _Words(dict):
    def __init__(self, machine: BpeTransducer, limit: int) -> None:
        super().__init__()
        self.machine, self.limit = machine, limit

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.machine.encode(word.encode("utf-8", "surrogatepass")), dtype="<i4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


class _Chunks(dict):
    def __init__(self, words: _Words, limit: int) -> None:
        super().__init__()
        self.words, self.limit = words, limit

    def __missing__(self, chunk: str) -> bytes:
        out = b"".join(map(self.words.__getitem__, (_ASCII_WORD if chunk.isascii() else _WORD).findall(chunk)))
        if len(self) >= self.limit:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


class Encoder:
    """Texts to ids with bounded memory of words and chunks already seen."""

    def __init__(self, vocabulary: bytes, memory: int = 300_000) -> None:
        self.machine = BpeTransducer(read_ranks(vocabulary))
        self.chunks = _Chunks(_Words(self.machine, memory), memory)

    def raw(self, text: str | None) -> bytes:
        """Ids as little-endian int32; empty for null and empty texts."""
        if not text:
            return b""
        if len(text) > _LONG:
            return b"".join(self.chunks[m.group()] for m in _CHUNK.finditer(text))
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw(text), dtype="<i4").tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(vocabulary: bytes) -> Encoder:
    """One encoder a Python worker and vocabulary; it outlives the task, so its memory serves later ones."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, out_col: str = "ids") -> DataFrame:
    """``id_col`` and the ids of ``text_col`` as ARRAY<INT>, one row for each row, without special tokens.

    Null and empty texts give an empty list, never null; a null id stays; repeated rows stay repeated; an empty table gives an empty
    result. Other columns are not read. There is no shuffle, and the vocabulary travels to the workers with the task (under 1 MB).
    """
    data = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{out_col}` array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder_for(data.value).raw
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                found = [raw(x) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], [id_col, out_col])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text_col: str, vocabulary: str = VOCABULARY, out_col: str = "n_tokens") -> DataFrame:
    """``df`` without ``text_col`` and with the number of its tokens as ``out_col`` (0 for null and empty)."""
    data = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    keep = [c for c in df.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out_col}` bigint"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder_for(data.value).raw
        for batch in batches:
            sizes = pa.array([len(raw(x)) // 4 for x in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), sizes], [*keep, out_col])

    return df.select(*keep, F.col(text_col)).mapInArrow(run, schema)


class Utf8Machine:
    """Incremental UTF-8: bytes in, complete code points out; what breaks off or is ill-formed becomes U+FFFD."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.point = 0, 0x80, 0xBF, 0
        self.odd = 0

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.need and self.low <= byte <= self.high:
                self.point = self.point << 6 | byte & 0x3F
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(chr(self.point))
                continue
            if self.need:
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.need, self.point = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.need, self.point = 2, byte & 0x0F
                self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                self.need, self.point = 3, byte & 0x07
                self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, vocabulary: str = VOCABULARY, out_col: str = "text") -> DataFrame:
    """The texts of id lists; null lists give null, empty ones an empty text. Ids outside the vocabulary raise an error."""
    data = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{out_col}` string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = encoder_for(data.value).machine.entries

        def text(ids: list[int] | None) -> str | None:
            if ids is None:
                return None
            joined = b"".join([entries[i] for i in ids])
            try:
                return joined.decode("utf-8")
            except UnicodeDecodeError:
                machine = Utf8Machine()
                return machine.feed(joined) + machine.close()

        for batch in batches:
            found = pa.array([text(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_col, out_col])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)
