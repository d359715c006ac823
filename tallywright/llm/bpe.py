"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A text is cut by the vocabulary's pattern, and each piece is encoded by itself.
For a piece, every prefix has exactly one BPE encoding, and it is the encoding
of a shorter prefix plus one last token. The transducer reads a piece byte by
byte and keeps, for each position where a later token could still begin, the
last token of the prefix that ends there. A token is emitted as soon as all
those positions agree on it, so the lookahead is bounded by the longest token.
A state is what has been read since the last emission, with the token emitted
last; states and transitions are made when first met, and dropped together when
they take more bytes than a limit, so memory is bounded and one very long piece
costs time in proportion to its length. The rest of a short piece that leaves
the known steps is searched for: tokens from left to right, each of which must
fit after the one before, from the last emission on.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import col, kept_in_worker, ship_package, tidied

# Memory of a worker beside the vocabulary itself, in bytes as counted below.
STATE_BYTES = 24 << 20
MEMO_BYTES = 60 << 20
MEMO_LENGTH = 64
# Steps after a new one that are not kept.
UNKEPT = 48
# Of the pieces that meet an unknown step, one in so many keeps it.
KEEP = 256
# Bytes by which the tokens that begin at a position are looked up.
HEAD = 4
FITS = 1 << 20
UNREADABLE = "the vocabulary lacks a byte, or its merges are not in order"
# What a dictionary's entry, a tuple and a number take, about.
ENTRY, TUPLE, NUMBER = 80, 56, 32
NEVER = float("inf")


def read_ranks(path: str) -> bytes:
    """The rank file as it is: a line per token, base64 and rank."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    """Bytes of one piece in, token ids out.

    A state holds the token emitted last (-1 if none) and, for the end of what has
    been read and for each earlier position where a longer token may still begin,
    the trie node of the bytes from there on and the tokens from the last emission
    up to there.
    """

    def __init__(self, ranks: dict[bytes, int], state_bytes: int = STATE_BYTES):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.state_bytes = state_bytes
        # All tokens as a trie: (node, byte) -> node, where tokens end, and which nodes have children.
        self._child: dict[int, int] = {}
        self._ends: dict[int, int] = {}
        self._inner: set[int] = set()
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self._inner.add(node)
                node = self._child.setdefault(node << 8 | byte, len(self._child) + 1)
            self._ends[node] = rank
        self._base = max(self.token, default=0) + 1 | 1  # odd, so that the lower bits of a pair depend on both
        self._longest = max(map(len, ranks), default=0)
        self._lengths = {rank: len(token) for token, rank in ranks.items()}
        self._new = 0
        self._parts: dict[int, tuple[int, int] | None] = {}
        # Which tokens fit after which: a table of fixed size, where a later pair takes an earlier one's place.
        self._fits = array("q", [-1]) * FITS
        self._forget()

    def _forget(self) -> None:
        # A state is one flat tuple: the token before, then node and tokens of
        # each start. A step is kept by state and byte; if it emits, the number
        # of the next state is complemented and the tokens are kept beside it.
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._next: dict[int, int] = {}
        self._emits: dict[int, tuple[int, ...]] = {}
        self._spines: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}
        self._heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        self.held = 0
        self._start = self._id((-1, 0, ()))

    def _id(self, state: tuple) -> int:
        known = self._ids.get(state)
        if known is None:
            known = self._ids[state] = len(self._states)
            self._states.append(state)
            self.held += ENTRY + TUPLE + NUMBER * len(state)
        return known

    def encode(self, piece: bytes) -> list[int]:
        if self.held > self.state_bytes:
            self._forget()
        out: list[int] = []
        if not piece:
            return out
        at, step, emits, last = self._start, self._next.get, self._emits, len(piece) - 1
        begin = 0
        while True:
            for place in range(begin, last):
                key = at << 8 | piece[place]
                to = step(key)
                if to is None:
                    break
                if to < 0:
                    out += emits[key]
                    to = ~to
                at = to
            else:
                break
            # What follows grows by one kept step for each KEEP pieces that end soon, as most rarely
            # come again; their rest is found without states. A long one keeps a step now and then.
            state = self._states[at]
            self._new += 1
            if last - place < UNKEPT and self._new % KEEP:
                return out + self._rest(state[0], piece, place - self._pending(state))
            if self.held > 2 * self.state_bytes:  # within one very long piece
                self._forget()
                step, emits = self._next.get, self._emits
                key = self._id(state) << 8 | piece[place]
            agreed, state = self._kept_step(key, state)
            out += agreed
            place += 1
            if last - place < UNKEPT:
                return out + self._rest(state[0], piece, place - self._pending(state))
            begin = place + UNKEPT
            for place in range(place, begin):
                agreed, state = self._step(state, piece[place])
                out += agreed
            at = self._id(state)
        key = at << 8 | piece[last]
        to = step(key)
        if to is None:  # no state is made for where a piece ends
            out += self._to_end(self._states[at], piece[last])
        else:
            if to < 0:
                out += emits[key]
                to = ~to
            out += self._states[to][-1]
        return out

    def _pending(self, state: tuple) -> int:
        """Bytes read since the last emission."""
        return sum([self._lengths[token] for token in state[-1]])

    def _rest(self, left: int, piece: bytes, at: int) -> list[int]:
        """Tokens from a position where `left` is settled as the token before, to the end of the piece.

        The longest token that fits comes first; where none does, the one before
        is given up for a shorter one, and no other path ends there.
        """
        first, end, dead = left, len(piece), None
        heads, lengths, fits, base = self._heads.get, self._lengths, self._fits, self._base
        last = FITS - 1
        out: list[int] = []
        tried: list = []
        while at < end:
            head = piece[at : at + HEAD]
            node, found = heads(head) or self._head(head)
            found = iter(self._longer(node, piece, at + HEAD, found) if node else found)
            while True:
                for right in found:
                    key = left * base + right + base
                    known = fits[key & last]
                    if (known & 1 if known >> 1 == key else self._fit(left, right)) and (
                        dead is None or at + lengths[right] not in dead
                    ):
                        break
                else:
                    if not out:
                        raise ValueError(UNREADABLE)
                    dead = dead or set()
                    dead.add(at)
                    at -= lengths[out.pop()]
                    left, found = out[-1] if out else first, tried.pop()
                    continue
                break
            tried.append(found)
            out.append(right)
            at += lengths[right]
            left = right
        return out

    def _head(self, head: bytes) -> tuple[int, tuple[int, ...]]:
        """The tokens that these bytes begin with, the longest first, and the node where longer ones go on, or 0."""
        found, node = (), 0
        for byte in head:
            node = self._child.get(node << 8 | byte, 0)
            if not node:
                break
            token = self._ends.get(node)
            if token is not None:
                found = (token, *found)
        known = self._heads[head] = (node if len(head) == HEAD and node in self._inner else 0, found)
        self.held += ENTRY + 3 * TUPLE + NUMBER * len(found)
        return known

    def _longer(self, node: int, piece: bytes, at: int, found: tuple[int, ...]) -> tuple[int, ...]:
        """The same with those longer ones that go on from `at`."""
        child, ends = self._child.get, self._ends.get
        for byte in piece[at : at + self._longest]:
            node = child(node << 8 | byte)
            if node is None:
                break
            token = ends(node)
            if token is not None:
                found = (token, *found)
        return found

    def _to_end(self, state: tuple, byte: int) -> tuple[int, ...]:
        """Tokens from the last emission to the end of this byte: the one last token that fits, and those before it."""
        before, child, ends = state[0], self._child.get, self._ends.get
        for i in range(1, len(state), 2):
            node = child(state[i] << 8 | byte)
            if node is not None:
                token, tokens = ends(node), state[i + 1]
                if token is not None and self._fit(tokens[-1] if tokens else before, token):
                    return (*tokens, token)
        raise ValueError(UNREADABLE)

    def _kept_step(self, key: int, state: tuple) -> tuple[tuple[int, ...], tuple]:
        """The step of a known state, remembered."""
        agreed, after = self._step(state, key & 255)
        to = self._id(after)
        self.held += ENTRY + NUMBER
        if agreed:
            self._emits[key] = agreed
            self.held += ENTRY + TUPLE + NUMBER * len(agreed)
            to = ~to
        self._next[key] = to
        return agreed, after

    def _step(self, state: tuple, byte: int) -> tuple[tuple[int, ...], tuple]:
        """The tokens that one more byte settles, and the state after it."""
        before, child, ends, inner = state[0], self._child.get, self._ends.get, self._inner
        longer: list = [before]
        last = None
        for i in range(1, len(state), 2):  # the longest first, the end of the last byte at last
            node = child(state[i] << 8 | byte)
            if node is None:
                continue
            tokens = state[i + 1]
            if last is None:
                token = ends(node)
                if token is not None and self._fit(tokens[-1] if tokens else before, token):
                    last = (*tokens, token)
            if node in inner:
                longer.append(node)
                longer.append(tokens)
        if last is None:
            raise ValueError(UNREADABLE)
        longer.append(0)
        longer.append(last)
        # What all of them begin with is settled.
        agreed = longer[2]
        for i in range(4, len(longer), 2):
            if not agreed:
                break
            while longer[i][: len(agreed)] != agreed:
                agreed = agreed[:-1]
        if not agreed:
            return agreed, tuple(longer)
        longer[0] = agreed[-1]
        for i in range(2, len(longer), 2):
            longer[i] = longer[i][len(agreed) :]
        return agreed, tuple(longer)

    def _reached(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self._halves(token) is not None

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging `left` + `right` leaves the border between them alone.

        While the two are built, the border lies between a token on the right
        edge of `left` and one on the left edge of `right`. The pair merges if
        its rank comes before the merges that would consume either; of equal
        ranks the one further left comes first.
        """
        key = left * self._base + right + self._base  # from 0, as `left` may be -1
        place = key & (FITS - 1)
        known = self._fits[place]
        if known >> 1 != key:
            fits = self._reached(right) and (left < 0 or not self._crosses(left, right))
            self._fits[place] = known = key << 1 | fits
        return known & 1 == 1

    def _crosses(self, left: int, right: int) -> bool:
        rank_of = self.ranks.get
        right_spine = self._spine(right, False)
        for a, a_until in self._spine(left, True):
            for b, b_until in right_spine:
                merged = rank_of(a + b)
                if merged is not None and merged < a_until and merged <= b_until:
                    return True
        return False

    def _spine(self, token: int, right_edge: bool) -> list[tuple[bytes, float]]:
        """The tokens that stand on an edge of `token` while it is built, and the rank that ends each."""
        key = (token, right_edge)
        spine = self._spines.get(key)
        if spine is None:
            spine, until, part = [], NEVER, token
            while True:
                spine.append((self.token[part], until))
                halves = self._halves(part)
                if halves is None:
                    break
                until, part = part, halves[1 if right_edge else 0]
            self._spines[key] = spine
            self.held += ENTRY + TUPLE + TUPLE * len(spine)
        return spine

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a byte, or if no merges reach it."""
        if token not in self._parts:
            parts = [self.token[token][i : i + 1] for i in range(len(self.token[token]))]
            while len(parts) > 2:
                pairs = [(self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(pairs)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._parts[token]


# The same pieces by the standard library's faster engine, which has no classes
# by Unicode property: its letters are the letters and the numbers that are not
# decimal digits, so texts with such numbers, or with the four separators that
# only it takes for blanks, are left to the other one.
SEPARATORS = re.compile("[\x1c-\x1f]")
PLAIN = {r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)", r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}


@cache
def odd_characters() -> frozenset[str]:
    return frozenset(
        chr(c) for c in range(sys.maxunicode + 1) if 0x1C <= c < 0x20 or unicodedata.category(chr(c)) in ("No", "Nl")
    )


class Encoder:
    """Texts to ids: pattern, transducer, and a bounded memory of what frequent pieces gave."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_bytes: int = MEMO_BYTES):
        blank = r"\p{White_Space}"
        self.find = regex.compile(pattern.replace(r"\s", blank).replace(r"\S", rf"[^{blank}]")).findall
        for whole, plain in PLAIN.items():
            pattern = pattern.replace(whole + "+", plain + "+")
        self.find_plain = self.find if r"\p" in pattern else re.compile(pattern).findall
        self.odd = odd_characters()
        self.transducer = Transducer(ranks)
        self.memo_bytes = memo_bytes
        self.pieces = _Memo(lambda piece: array("i", self.transducer.encode(piece.encode())).tobytes())

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(self.encode_bytes(text), np.intc)

    def encode_bytes(self, text: str) -> bytes:
        """The same as C integers."""
        plain = text.isascii() and not SEPARATORS.search(text) or self.odd.isdisjoint(set(text))
        find = self.find_plain if plain else self.find
        coded = b"".join(map(self.pieces.__getitem__, find(text)))
        if 2 * self.pieces.held > self.memo_bytes:
            self.pieces = self.pieces.renewed()
        return coded


class _Memo(dict):
    """Remembers short keys only; long ones are worked out each time.

    Once the entries take half the memory allowed, they become the old ones of a
    new memory. Old entries that are met again move over, the others go with the
    next change.
    """

    def __init__(self, make, old: dict | None = None):
        super().__init__()
        self.make, self.old, self.held = make, {} if old is None else old, 0

    def renewed(self) -> _Memo:
        self.old = {}
        return _Memo(self.make, self)

    def __missing__(self, key):
        value = dict.get(self.old, key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMO_LENGTH:
                return value
        self[key] = value
        self.held += ENTRY + sys.getsizeof(key) + sys.getsizeof(value)
        return value


class Utf8Stream:
    """Bytes in, text out, in steps of any size.

    The state is the beginning of a character that the bytes so far have not
    ended: at most three bytes. Bytes that are not UTF-8 become U+FFFD, as many
    as `bytes.decode` gives for the whole.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        end = len(data) - self._unfinished(data)
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of an unfinished but so far valid character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            needs = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if back >= needs:
                return 0
            if back > 1:
                second = data[-back + 1]
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= second <= high:
                    return 0
            return back
        return 0


class Decoder:
    def __init__(self, ranks: dict[bytes, int], step: int = 4096):
        self.token = {rank: token for token, rank in ranks.items()}
        self.step = step

    def decode(self, ids: np.ndarray) -> str:
        stream, out = Utf8Stream(), []
        for at in range(0, len(ids), self.step):
            out.append(stream.feed(b"".join(map(self.token.__getitem__, ids[at : at + self.step].tolist()))))
        out.append(stream.close())
        return "".join(out)


def _coder(kind: type, raw: bytes, *more):
    """One coder per Python worker and vocabulary."""
    made = kept_in_worker("bpe")
    key = (kind, hash(raw), *more)
    if key not in made:
        made[key] = kind(parse_ranks(raw), *more)
    return made[key]


def encode(df: DataFrame, text: str, ranks: bytes, pattern: str, ids_as: str = "ids") -> DataFrame:
    """`df` with the token ids of column `text` as array<int> in `ids_as`.

    NULL and the empty text give an empty array. `ranks` is the content of a
    rank file; its size is that of the vocabulary, so it is broadcast. Other
    columns are kept; one called `ids_as` is replaced.
    """
    ship_package(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(ranks)

    def coded(texts: pa.Array) -> pa.Array:
        encoder = _coder(Encoder, shipped.value, pattern)
        values, ends = array("i"), array("i", [0])
        # The tables hold no cycles, and looking for some took a third of the time.
        gc.disable()
        try:
            for text_ in texts:
                values.frombytes(encoder.encode_bytes(text_.as_py() or ""))
                ends.append(len(values))
        finally:
            gc.enable()
        flat = pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    @F.arrow_udf("array<int>")
    def token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(lambda parts: map(coded, parts))(batches)

    return df.withColumn(ids_as, token_ids(col(text)))


def decode(df: DataFrame, ids: str, ranks: bytes, text_as: str = "decoded") -> DataFrame:
    """`df` with the text of the token ids in column `ids`; NULL gives the empty text."""
    ship_package(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(ranks)

    def decoded(lists: pa.Array) -> pa.Array:
        decoder = _coder(Decoder, shipped.value)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        out, ends = bytearray(), array("i", [0])
        for begin, end in zip(offsets, offsets[1:]):
            out += decoder.decode(values[begin:end]).encode()
            ends.append(len(out))
        return pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(out)])

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(lambda parts: map(decoded, parts))(batches)

    # An expression between the two functions keeps a decode of what `encode`
    # gives from being planned together with a second run of it.
    return df.withColumn(text_as, text_of(F.coalesce(col(ids), F.array().cast("array<int>"))))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """Number of ids, digest of the ids in decimal, digest of the decoded bytes."""
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    ]
