"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The token that ends a prefix of a pre-token is unique: it is the token t such
that the last token before it and t stay apart when merged together. So the
encodings of all prefixes form a chain of last tokens, and a deterministic
machine can read bytes from left to right. Its state holds the starts from
which a longer token may still come, and the token that ends at each; a
transition gives the token that ends at the byte read. Once a single start is
left, all tokens up to it are certain and are written out, following the chain
back. States and transitions are made on first use.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from noema.llm.frames import keyed_text, map_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct pre-tokens and machine states that one Python worker remembers before it starts afresh.
MEMO, STATES = 160_000, 220_000
#: Bytes whose tokens wait at least before they are written out; they are once the machine is in a state with a single start.
PENDING = 64


class Transducer:
    """Encoder of a rank file: ``ranks`` maps byte strings to ids, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        #: Of the byte strings that begin tokens: the number of a string and a byte give the longer string's number; the token that a string is, or -1; whether longer tokens begin with it.
        self.longer: dict[int, int] = {}
        self.token_at, self.open = [-1], [True]
        for piece, token in ranks.items():
            node = 0
            for byte in piece:
                below = self.longer.get(node << 8 | byte)
                if below is None:
                    below = self.longer[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.open.append(False)
                    self.open[node] = True
                node = below
            self.token_at[node] = token
        self.apart: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.spelled: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.reset()

    def reset(self) -> None:
        #: A state is a tuple of live starts, the latest last: (number of the bytes read since the start, the token that ends at the start or -1).
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int, bool]] = {}

    def by_merging(self, piece: bytes) -> list[int]:
        """Ids by repeated merges of the lowest-ranked pair, the definition that the machine is tested against."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def growth(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """How the part at one end of a token grows while it is merged together (side 0: its left end, -1: its right end): the parts, each with the rank of the merge that makes it longer."""
        if (known := self.spines.get((token, side))) is None:
            whole = self.token_bytes[token]
            parts = [whole[k : k + 1] for k in range(len(whole))]
            known, part = [], parts[side]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if parts[side] != part:
                    known.append((part, rank))
                    part = parts[side]
            known.append((part, float("inf")))
            self.spines[token, side] = known
        return known

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, merged together, give these two tokens: no merge across the border comes before both its parts have grown on."""
        key = left << 20 | right
        if (known := self.apart.get(key)) is None:
            if len(self.apart) > 300_000:
                self.apart.clear()
            a, b, i, j, known = self.growth(left, -1), self.growth(right, 0), 0, 0, True
            while True:
                across = self.ranks.get(a[i][0] + b[j][0])
                if across is not None and across < a[i][1] and across <= b[j][1]:
                    known = False
                    break
                if a[i][1] == b[j][1] == float("inf"):
                    break
                if a[i][1] <= b[j][1]:
                    i += 1
                else:
                    j += 1
            self.apart[key] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int, bool]:
        """The transition of a state by one byte: next state, the token that ends here, and whether all tokens up to here are certain."""
        here, live, apart = -1, [], self.apart
        for read, last in self.states[state]:
            grown = self.longer.get(read << 8 | byte)
            if grown is None:
                continue
            if here < 0 and (token := self.token_at[grown]) >= 0:
                if last < 0:
                    here = token
                else:
                    known = apart.get(last << 20 | token)
                    if self.stays_apart(last, token) if known is None else known:
                        here = token
            if self.open[grown]:
                live.append((grown, last))
        if here < 0:
            raise ValueError("no token ends here: the ranks lack single bytes")
        live.append((0, here))
        key = tuple(live)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = (number, here, len(live) == 1)
        return move

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if len(self.states) > STATES:
            self.reset()
        out: list[int] = []
        state, moves, ends = 0, self.moves, []
        for byte in piece:
            state, token, certain = moves.get(state << 8 | byte) or self.step(state, byte)
            ends.append(token)
            if certain and len(ends) >= PENDING:
                out += self.trace(ends)
                ends.clear()
        return (*out, *self.trace(ends))

    def trace(self, ends: list[int]) -> list[int]:
        """Tokens of a stretch, from the token that ends at each of its bytes."""
        out, at, size = [], len(ends), self.sizes
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def encode(self, pieces: Iterable[str]) -> list[tuple[int, ...]]:
        """Ids of each pre-token."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = memo[piece] = self.encode_piece(piece.encode())
            out.append(ids)
        return out


    def spell(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        """Of each pre-token: how many ids, the ids with commas between, and the bytes that the ids stand for.

        What was asked for lately is remembered in two generations: once the
        younger is full, it becomes the older, and what is used again moves on.
        """
        if len(self.spelled) > MEMO:
            self.older, self.spelled = self.spelled, {}
        known, older = self.spelled, self.older
        for piece in set(pieces).difference(known):
            if (entry := older.get(piece)) is None:
                ids = self.encode_piece(piece.encode())
                entry = (len(ids), ",".join(map(str, ids)), b"".join([self.token_bytes[i] for i in ids]))
            known[piece] = entry
        return list(map(known.__getitem__, pieces))


class Utf8Stream:
    """Decodes chunks of bytes that may cut characters: a state machine keeps the open bytes of a character between chunks."""

    def __init__(self) -> None:
        self.open = b""

    def feed(self, chunk: bytes) -> str:
        data = self.open + chunk
        back = 0
        while back < min(3, len(data)) and data[-1 - back] & 0xC0 == 0x80:
            back += 1
        lead = data[-1 - back] if back < len(data) else 0
        need = 1 if lead >= 0xC0 else 0
        need += (lead >= 0xE0) + (lead >= 0xF0)
        cut = len(data) - back - 1 if need > back else len(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@functools.lru_cache(2)
def _machine(path: str) -> Transducer:
    return Transducer(read_ranks(path))


@functools.lru_cache(4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def decode_stream(machine: Transducer, ids: list[int], chunk: int = 65_536) -> Iterator[str]:
    """Text of an id sequence, chunk by chunk."""
    stream, get = Utf8Stream(), machine.token_bytes.__getitem__
    for k in range(0, len(ids), chunk):
        yield stream.feed(b"".join(map(get, ids[k : k + chunk])))
    yield stream.close()


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: doc_id, ids (null text: none). One pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, pieces = _machine(ranks), _pattern(pattern)
        ids = [list(chain.from_iterable(machine.encode(pieces.findall(t or "")))) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(keyed_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """Text of every id list: doc_id, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = _machine(ranks)
        texts = ["".join(decode_stream(machine, ids or [])) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Encodes and decodes every text and returns digests of both sides (and the decoded text with ``keep_text``).

    A null text counts as empty; a null id stays null; repeated rows each give
    a row; an empty table gives none; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, split = _machine(ranks), _pattern(pattern)
        counts, id_hashes, text_hashes, back = [], [], [], []
        for text in batch.column(1).to_pylist():
            seen = machine.spell(split.findall(text or ""))
            counts.append(sum(n for n, _, _ in seen))
            id_hashes.append(hashlib.sha256(",".join([ids for _, ids, _ in seen]).encode()).hexdigest())
            stream, digest, parts = Utf8Stream(), hashlib.sha256(), []
            for k in range(0, len(seen) + 1, 65_536):
                part = stream.feed(b"".join([data for _, _, data in seen[k : k + 65_536]]))
                part += stream.close() if k + 65_536 > len(seen) else ""
                digest.update(part.encode())
                if keep_text:
                    parts.append(part)
            text_hashes.append(digest.hexdigest())
            back.append("".join(parts))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(back, pa.string())] * keep_text, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["text"] * keep_text)

    return map_batches(keyed_text(docs, id_col, text_col), run, SCHEMA + ", text string" * keep_text)
