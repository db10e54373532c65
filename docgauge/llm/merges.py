"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding.  Merging takes the pair of least rank again and again, and each merge
looks at its own pair only.  So a row of tokens is the encoding of its bytes
exactly if each two neighbours are the encoding of their own bytes: the first
merge that crossed a border in the whole would be the first to cross it in the
two neighbours alone, and the other way round.  That makes a finite-state
transducer of the merges.  Its guesses are the tokens that may be under way: a
node of the vocabulary's trie, and the token before it.  After each byte exactly
one guess ends in a token that agrees with the one before it; that token ends the
encoding of the bytes so far.  A state of the determinised transducer is the set
of guesses that are still alive, with that token.  The guesses reach back no
further than the longest token; the encodings before them meet soon after, and
what lies before that place is emitted: at the end of a match, or when `WINDOW`
bytes are under way.  States and moves are made when a text first asks for them
and dropped together beyond `MOST_STATES`; texts of any length take linear time.

Texts are cut into matches of the public pattern; a match that is a token itself
is that token, as the library has it.  Matches never reach across the start of a
run of white space, so each different chunk between those places is encoded once
and remembered (`tokens.TokenCache`).

Decoding.  The tokens' bytes are joined block by block; an incremental UTF-8
state machine keeps back the bytes of an unfinished character, so text comes out
while ids still come in, and bytes are never held as a whole.

Rules for odd rows: a null text counts as empty and has no ids; empty texts
likewise; null ids in a list to decode are an error; repeated rows and null
doc_ids give a row each; an empty table gives no rows; other columns are left
unread, so names may clash.
"""

from __future__ import annotations

import base64
import hashlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import arrow_schema, ship, sole_cache
from docgauge.llm.tokens import TokenCache, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of what a worker remembers of states and of pairs of tokens.
MOST_STATES, MOST_PAIRS = 300_000, 1_000_000
#: Bytes under way before tokens are emitted within one match; more than twice the longest token.
WINDOW = 1 << 10
#: Ids that are decoded at once.
BLOCK = 1 << 14


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """The determinised transducer of one vocabulary; it grows as texts ask for it.

    A guess is a node of the trie and the token before the bytes that lead there,
    one number (`node << SHIFT | token + 1`, 0 for no token).  A state is a set of
    guesses and the last token of the encoding so far.
    """

    SHIFT = 24

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES, most_pairs: int = MOST_PAIRS):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.ranks, self.most_states, self.most_pairs = ranks, most_states, most_pairs
        self.bytes_of = {t: b for b, t in ranks.items()}
        # the vocabulary's trie: node and byte -> node; a node's token, or -1; whether a longer token goes on from it; its depth
        self.child: dict[int, int] = {}
        self.token, self.inner, self.depth = [-1], [True], [0]
        for piece, t in ranks.items():
            node = 0
            for b in piece:
                key = node << 8 | b
                self.inner[node] = True
                upper, node = node, self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[upper] + 1)
            self.token[node] = t
        self.agrees: dict[int, bool] = {}
        self.steps: dict[int, tuple | None] = {}
        self._forget()

    def _forget(self) -> None:
        """State 0 is the start. moves: state and byte -> state."""
        self.moves: dict[int, int] = {}
        self.states: dict[tuple, int] = {}
        self.guesses: list[tuple[int, ...]] = [(0,)]
        self.last: list[int] = [-1]

    def _steps(self, token: int):
        """How the token's own bytes merge, in order: ranks, its first part after each merge, its last part; None if they don't merge to it."""
        got = self.steps.get(token, 0)
        if got == 0:
            piece, ranks = self.bytes_of[token], self.ranks
            parts = [piece[i : i + 1] for i in range(len(piece))]
            order, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                order.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            got = self.steps[token] = (order + [1 << 62], firsts, lasts) if len(parts) == 1 else None
        return got

    def _agree(self, before: int, token: int) -> bool:
        """Whether the two, or the one if `before` is -1, are the encoding of their own bytes: no pair across their border is ever the one of least rank."""
        key = before + 1 << self.SHIFT | token
        got = self.agrees.get(key)
        if got is None:
            if len(self.agrees) >= self.most_pairs:
                self.agrees.clear()
            self.agrees[key] = got = self._compared(before, token)
        return got

    def _compared(self, before: int, token: int) -> bool:
        right = self._steps(token)
        if right is None or before < 0:
            return right is not None
        left = self._steps(before)
        if left is None:
            return False
        (left_ranks, _, lasts), (right_ranks, firsts, _), ranks, i, j = left, right, self.ranks, 0, 0
        while True:
            # of equal ranks the pair further left goes first
            crossing, a, b = ranks.get(lasts[i] + firsts[j], 1 << 62), left_ranks[i], right_ranks[j]
            if crossing < a and crossing <= b and crossing < 1 << 62:
                return False
            if a <= b:
                if a == 1 << 62:
                    return True
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> int:
        """The state after `byte`."""
        child, tokens, inner, agrees, shift = self.child, self.token, self.inner, self.agrees, self.SHIFT
        low, alive, last = (1 << shift) - 1, [], -1
        for guess in self.guesses[state]:
            node = child.get(guess >> shift << 8 | byte, 0)
            if node:
                before, token = guess & low, tokens[node]
                if last < 0 <= token:
                    agree = agrees.get(before << shift | token)
                    if agree if agree is not None else self._agree(before - 1, token):
                        last = token
                if inner[node]:
                    alive.append(node << shift | before)
        alive.append(last + 1)
        key = tuple(alive)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.last)
            self.guesses.append(key)
            self.last.append(last)
        self.moves[state << 8 | byte] = to
        return to

    def _certain(self, state: int, ends: list[int]) -> int:
        """How many bytes' tokens can't change any more: where the encodings before all guesses meet."""
        n, size = len(ends), self.bytes_of
        starts = {n - self.depth[g >> self.SHIFT] for g in self.guesses[state]}
        while len(starts) > 1:
            last = max(starts)
            starts.remove(last)
            starts.add(last - len(size[ends[last - 1]]))
        return starts.pop()

    def _back(self, ends: list[int], upto: int) -> list[int]:
        """The tokens of the first `upto` bytes, from the last token of each prefix."""
        out, size = [], self.bytes_of
        while upto:
            token = ends[upto - 1]
            out.append(token)
            upto -= len(size[token])
        out.reverse()
        return out

    def encode(self, piece: bytes, window: int = WINDOW) -> list[int]:
        """The ids of one match of the pattern; tokens are emitted at the end and whenever `window` bytes are under way."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(self.last) > self.most_states:
            self._forget()
        state, out, ends, moves, last = 0, [], [], self.moves, self.last
        for byte in piece:
            to = moves.get(state << 8 | byte)
            state = to if to is not None else self._move(state, byte)
            ends.append(last[state])
            if len(ends) >= window:
                sure = self._certain(state, ends)
                out += self._back(ends, sure)
                del ends[:sure]
        out += self._back(ends, len(ends))
        return out


class Encoder(TokenCache):
    """Batches of texts -> ids, as `TokenCache`, with chunks encoded by the transducer; one per Python worker and vocabulary."""

    lead, kind = True, np.dtype("<u4")

    def __init__(self, path: str, most: int = 500_000):
        import public_tokenizers

        self.transducer, self.most = Transducer(ranks_of(path)), most
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._forget()

    def _forget(self) -> None:
        super()._forget()
        self.pieces: dict[str, list[int]] = {}

    def _learn(self, chunks: list[str]) -> None:
        chunks = [c for c in chunks if c not in self.known]
        encode, pieces, find, ids, sizes = self.transducer.encode, self.pieces, self.pattern.findall, [], []
        for chunk in chunks:
            n = len(ids)
            for piece in find(chunk):
                got = pieces.get(piece)
                if got is None:
                    got = encode(piece.encode())
                    if len(piece) < 64:
                        pieces[piece] = got
                ids += got
            sizes.append(len(ids) - n)
        if chunks:
            self._add(chunks, np.array(sizes, np.int64), np.array(ids, "<u4"))


#: Well-formed UTF-8 (fixed values): state -> (least byte, greatest byte, next state); state 0 is between characters.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}
_MOVES = {(s, b): to for s, ranges in UTF8.items() for low, high, to in ranges for b in range(low, high + 1)}


class Utf8Stream:
    """Bytes in, characters out as soon as they are complete; the state is the bytes of an unfinished character, three at most. Bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        # an unfinished character begins within the last three bytes; what is before them can't change any more
        cut = len(data)
        for start in range(max(0, len(data) - 3), len(data)):
            if data[start] >= 0xC0:
                state = 0
                for b in data[start:]:
                    state = _MOVES.get((state, b), -1)
                    if state <= 0:
                        break
                if state > 0:
                    cut = start
                    break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Decoder:
    """Ids -> bytes and text, in blocks."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.table: list[bytes | None] = [None] * (1 + max(ranks.values()))
        for piece, t in ranks.items():
            self.table[t] = piece

    def blocks(self, ids: list[int]):
        """(bytes, text that is complete so far) of each block of ids; the last one ends the text."""
        stream = Utf8Stream()
        for i in range(0, len(ids), BLOCK):
            part = ids[i : i + BLOCK]
            if min(part) < 0 or max(part) >= len(self.table):
                raise ValueError("an id isn't in the vocabulary")
            data = b"".join(itemgetter(*part)(self.table)) if len(part) > 1 else self.table[part[0]]
            text = stream.feed(data)
            yield data, text if i + BLOCK < len(ids) else text + stream.finish()


_held: dict[str, tuple[Encoder, Decoder]] = {}


def _worker(path: str) -> tuple[Encoder, Decoder]:
    sole_cache(f"merges {path}", lambda: _held.pop(path, None))
    if path not in _held:
        _held[path] = (Encoder(path), Decoder(path))
    return _held[path]


def _by_part(docs: DataFrame, schema: str, make, path: str, text: str) -> DataFrame:
    """`make(batch slice, ids, offsets, decoder)` over slices of a few MB of text."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        encoder, decoder = _worker(path)
        for b in batches:
            starts = [(a, ids, offsets) for a, ids, offsets in encoder.encode_in_parts(b.column(at))]
            for a, ids, offsets in starts:
                yield make(b.slice(a, len(offsets) - 1), ids, offsets, decoder)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""
    wanted = arrow_schema(schema := "doc_id long, ids array<int>")

    def make(b, ids, offsets, _):
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([b.column(0), lists.cast(wanted.field("ids").type)], schema=wanted)

    return _by_part(_plain(docs), schema, make, path or tokenizer_path(VOCABULARY), "text")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text of lists of ids; null for null, U+FFFD for bytes that aren't UTF-8."""
    ship(rows.sparkSession)
    path = path or tokenizer_path(VOCABULARY)

    def run(batches):
        decoder = Decoder(path)
        for b in batches:
            texts = [None if x is None else "".join(t for _, t in decoder.blocks(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text is encoded, and its ids are decoded again block by block."""
    wanted = arrow_schema(schema := "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    decimal: list[bytes] = []

    def make(b, ids, offsets, decoder):
        if not decimal:
            decimal.extend(b"%d" % i for i in range(len(decoder.table)))
        ids, shas, backs = ids.tolist(), [], []
        for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own, sha = ids[x:y], hashlib.sha256()
            shas.append(hashlib.sha256(b" ".join(itemgetter(*own)(decimal)) if y - x > 1 else b"".join(map(decimal.__getitem__, own))).hexdigest())
            for data, _ in decoder.blocks(own):
                sha.update(data)
            backs.append(sha.hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], schema=wanted)

    return _by_part(_plain(docs), schema, make, path or tokenizer_path(VOCABULARY), "text")
