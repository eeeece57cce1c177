"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines stand for the tokenizer. The first splits characters into pretokens: it reads the classes of
a character and the next, and marks where a pretoken begins. A text is cut into chunks; the map from entry state to exit
state of each is found on its own, the maps are composed by a prefix scan, and the chunks are then marked from their true
entry states. The second reads a pretoken's bytes; each transition is annotated with the tokens that it adds to the
encoding of what has been read (a merge may take some back). Its states are found as they are first met.

Cases: a null text counts as empty and has no tokens. Special strings inside a text count one token each, as the
library has it by default. Texts with code points that are unassigned in this Python's Unicode go to the library, and so do
pretokens of more than ``LONG_PRETOKEN`` bytes. Pretokens count as equal only if their bytes are. Repeated rows have a
result each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.blocks import distinct_spans, sliced

LIMIT = 512
CHUNK = 64
BLOCK_CHARS = 1 << 20
#: States, and pairs of tokens, kept before a worker starts anew, to bound its memory; spans advance together by so many bytes.
STATES = 250_000
SPAN_BYTES = 1 << 18
#: Longer pretokens, whose states are hardly ever met again, are counted by the library's merges.
LONG_PRETOKEN = 2048

# character classes
SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE, STMD, E, RV, L, END = range(11)
# states of the pretokenizer: OPEN always begins a pretoken
OPEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, TAKE_ONE, TAKE_E, TAKE_L, CLOSE = range(10)


def _begin(c: int, n: int) -> int:
    """The state after the first character c of a pretoken, n being the class of the next character."""
    if c in (SPACE, WHITE):
        if n in (SPACE, WHITE, END):
            return IN_WHITE
        return AFTER_SPACE if c == SPACE else OPEN
    if c == APOSTROPHE:
        return {STMD: TAKE_ONE, RV: TAKE_E, L: TAKE_L}.get(n, IN_OTHERS)
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}.get(c, IN_LETTERS)


def _step(state: int, c: int, n: int) -> tuple[int, bool]:
    """(next state, whether a pretoken begins at c)."""
    kind = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: IN_OTHERS}.get(c, IN_LETTERS)
    white = c in (SPACE, WHITE)
    if c == END:
        return OPEN, True
    if state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS) and not white and kind == state:
        return state, False
    if state == AFTER_SPACE and not white:
        return kind, False
    if state == IN_WHITE and white and n in (SPACE, WHITE, END):
        return IN_WHITE, False
    if state == TAKE_ONE or state == CLOSE:
        return OPEN, False
    if state == TAKE_E and n == E or state == TAKE_L and n == L:
        return CLOSE, False
    return _begin(c, n), True


@cache
def _split_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next states and marks by (state, class * 11 + next class), the class of every code point, and the unassigned ones."""
    steps = np.array([[_step(s, c, n) for c in range(11) for n in range(11)] for s in range(10)])
    kinds = [unicodedata.category(chr(i)) for i in range(0x110000)]
    classes = np.full(0x110001, OTHER, np.uint8)
    classes[:-1] = [{"L": LETTER, "N": NUMBER, "Z": WHITE}.get(k[0], OTHER) for k in kinds]
    classes[[9, 10, 11, 12, 13, 0x85]] = WHITE
    unassigned = np.array([k == "Cn" for k in kinds])
    for chars, value in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("e", E), ("rv", RV), ("l", L)):
        classes[[ord(c) for c in chars]] = value
    classes[0x110000] = END
    return steps[..., 0].astype(np.uint8), steps[..., 1].astype(bool), classes, unassigned


def split_marks(classes: np.ndarray) -> np.ndarray:
    """Where pretokens begin, for classes of texts that END divides."""
    table, marks, _, _ = _split_tables()
    flat, flags = table.ravel(), marks.ravel()
    following = np.full(len(classes), END, np.uint16)
    following[:-1] = classes[1:]
    symbols = classes.astype(np.uint16) * 11 + following
    chunks = -(-len(symbols) // CHUNK)
    padded = np.full(chunks * CHUNK, END * 12, np.uint16)
    padded[: len(symbols)] = symbols
    padded = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(10, dtype=np.uint16), (chunks, 1))
    for k in range(CHUNK):
        maps = flat[maps * 121 + padded[k][:, None]].astype(np.uint16)
    entry = np.empty(chunks, np.uint16)
    before = _exclusive_scan(maps)
    entry[:] = before[:, OPEN]
    out = np.empty((CHUNK, chunks), bool)
    for k in range(CHUNK):
        at = entry * np.uint16(121) + padded[k]
        out[k] = flags[at]
        entry = flat[at].astype(np.uint16)
    return out.T.ravel()[: len(symbols)]


def _exclusive_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of all maps before each, by doubling: after a step of width w each holds that of up to 2w maps."""
    out = np.tile(np.arange(10, dtype=np.uint16), (len(maps), 1))
    out[1:] = maps[:-1]
    width = 1
    while width < len(out):
        out[width:] = np.take_along_axis(out[width:], out[:-width], axis=1)
        width *= 2
    return out


def _signed(x: int) -> int:
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


class TokenTransducer:
    """Bytes of a pretoken to its number of tokens.

    A state holds, for every place from which a token could still grow into what follows, the node of the vocabulary's
    trie reached from there, the last token of the encoding up to there, and how many tokens that has less than all that
    was read. The encoding of a longer prefix ends in the one token that may stand after the last token before it.
    """

    def __init__(self, ranks: dict[bytes, int], pair_ok):
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, number in ranks.items():
            node = 0
            for b in text:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.token):
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = number
        self.pair_ok = pair_ok
        self.forget()

    def forget(self) -> None:
        """Back to the first state; what is needed again is compiled again."""
        self.allowed: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.held: list[tuple] = [((0, -1, 0),)]
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        """An open-addressed table of the transitions, by state * 256 + byte."""
        self.keys, self.goes, self.adds, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the empty place for it."""
        mask = len(self.keys) - 1
        at = ((keys * 0x9E3779B97F4A7C1 >> 24) & mask).astype(np.int64)
        wrong = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            held = self.keys[at[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return at

    def compile(self, state: int, byte: int) -> None:
        grown, found = [], None
        for node, last, less in self.held[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            grown.append((child, last, less))
            token = self.token[child]
            if found is None and token >= 0 and (last < 0 or self._may_follow(last, token)):
                found = (token, less + 1)
        token, added = found
        key = (*((n, t, less - added) for n, t, less in grown if self.children[n]), (0, token, 0))
        number = self.states.setdefault(key, len(self.held))
        if number == len(self.held):
            self.held.append(key)
        if 2 * self.filled >= len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            keys, goes, adds = self.keys[old], self.goes[old], self.adds[old]
            self._table(2 * len(self.keys))
            for k, g, a in zip(keys.tolist(), goes.tolist(), adds.tolist(), strict=True):
                self._put(k, g, a)
        self._put(state * 256 + byte, number, added)

    def _put(self, key: int, number: int, added: int) -> None:
        mask = len(self.keys) - 1
        at = (_signed(key * 0x9E3779B97F4A7C1) >> 24) & mask
        while self.keys[at] >= 0:
            at = (at + 1) & mask
        self.keys[at], self.goes[at], self.adds[at] = key, number, added
        self.filled += 1

    def _may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.allowed:
            self.allowed[key] = self.pair_ok(a, b)
        return self.allowed[key]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens of each span of data, in batches of spans of about equal lengths."""
        order = np.argsort(starts - ends, kind="stable")
        batch = np.cumsum((ends - starts)[order]) // SPAN_BYTES
        out = np.empty(len(order), np.int64)
        for part in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
            if len(self.held) > STATES or len(self.allowed) > STATES:
                self.forget()
            out[part] = self._together(data, starts[part], (ends - starts)[part])
        return out

    def _together(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All spans, longest first, advance together, a byte at a time."""
        state, total = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
        active, k = len(starts), 0
        while active := int(np.searchsorted(-lengths[:active], -k, "left")):
            keys = state[:active].astype(np.int64) * 256 + data[starts[:active] + k]
            at = self._slots(keys)
            missing = np.unique(keys[self.keys[at] < 0])
            if len(missing):
                for key in missing.tolist():
                    self.compile(key >> 8, key & 255)
                at = self._slots(keys)
            total[:active] += self.adds[at]
            state[:active] = self.goes[at]
            k += 1
        return total


@cache
def compiled(path: str) -> tuple[TokenTransducer, list[str], Callable[[bytes], int]]:
    """The transducer of a tokenizers file of the byte-level BPE kind, its special strings, and the library's count of a pretoken."""
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    vocabulary = model["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = [t["content"] for t in model["added_tokens"]]
    ranks = {bytes(letters[c] for c in token): number for token, number in vocabulary.items() if token not in special}
    merging = Tokenizer.from_file(path)
    merging.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    names = {number: token for token, number in vocabulary.items()}

    def pair_ok(a: int, b: int) -> bool:
        return [t.id for t in merging.model.tokenize(names[a] + names[b])] == [a, b]

    symbol = {b: c for c, b in letters.items()}

    def merged(pretoken: bytes) -> int:
        return len(merging.model.tokenize("".join(symbol[b] for b in pretoken)))

    return TokenTransducer(ranks, pair_ok), special, merged


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    machine, special, merged = compiled(path)
    total = np.zeros(len(texts), np.int64)
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        pieces = [text]
        for mark in special:
            if mark in text:
                total[row] += text.count(mark)
                pieces = [p for x in pieces for p in x.split(mark)]
        for piece in pieces:
            if size and size + len(piece) > BLOCK_CHARS:
                _count(machine, merged, rows, parts, total)
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(piece)
            size += len(piece) + 1
    _count(machine, merged, rows, parts, total)
    unassigned = np.flatnonzero(total < 0)
    if len(unassigned):
        from meterframe.llm.tokens import encoder

        total[unassigned] = [len(encoder(path)(texts[i])) for i in unassigned]
    return total


def _count(machine: TokenTransducer, merged: Callable[[bytes], int], rows: list[int], parts: list[str], total: np.ndarray) -> None:
    joined = "\n".join(parts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    classes = _split_tables()[2][points]
    classes[np.cumsum(lengths) - 1] = END
    begins = np.flatnonzero(split_marks(classes))
    data = np.frombuffer(joined.encode(), np.uint8)
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    places = np.cumsum(wide) - wide
    row = np.repeat(np.asarray(rows, np.int64), lengths)[begins]
    real = np.flatnonzero(classes[begins] != END)
    starts = places[begins]
    ends = np.append(starts[1:], len(data))[real]
    starts, row = starts[real], row[real]
    first, inverse = distinct_spans(data, starts, ends)
    starts, ends = starts[first], ends[first]
    counts, long = np.empty(len(first), np.int64), ends - starts > LONG_PRETOKEN
    counts[~long] = machine.counts(data, starts[~long], ends[~long])
    counts[long] = [merged(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    np.add.at(total, row, counts[inverse])
    odd = _split_tables()[3][points]
    if odd.any():  # the library may know newer classes: such texts are left to it
        total[np.repeat(np.asarray(rows, np.int64), lengths)[odd]] = np.iinfo(np.int64).min // 2


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counted = count_tokens(texts, path)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counted), pa.array(counted > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
