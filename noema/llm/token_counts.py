"""Token counts by rank-synchronous array merging.

Pre-tokens are ragged numpy arrays of symbols. In each round every sequence
looks up the merge ranks of its neighbouring symbols, and all places that hold
the sequence's lowest rank are merged at once. What survives is counted.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from noema.llm.frames import keyed_text, map_batches, offsets_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Distinct pre-tokens whose counts one Python worker remembers before it starts afresh.
MEMO = 300_000


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stays, the rest moves above 255."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b if b in keep else next(moved)) for b in range(256)]


class WordBpe:
    """The counting side of a byte-level BPE tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        ids = model["vocab"]
        letters = byte_symbols()
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + suffix] for c in letters], np.int64)
        self.width = max(ids.values()) + 1
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        keys = np.array([a * self.width + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([c for _, _, c in merges], np.int64)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and how many special strings stand in it (each is one token)."""
        found = 0
        if self.specials is not None and "<|" in text:
            parts = self.specials.split(text)
            found = len(parts) - 1
        else:
            parts = [text]
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += self.words.findall(part.lower())
        return out, found

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Symbols left of each word once no merge applies."""
        raw = [w.encode() for w in words]
        starts = offsets_of(np.fromiter(map(len, raw), np.int64, len(raw)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[data]
        symbols[starts[1:] - 1] = self.last[data[starts[1:] - 1]]
        owner = np.repeat(np.arange(len(raw)), np.diff(starts))
        counts = np.diff(starts)
        none = len(self.merged)
        while len(symbols) > 1:
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(np.append(rank, none), edges)
            size = np.diff(np.append(edges, len(owner)))
            live = lowest < none
            if not live.any():
                break
            hit = np.append(rank, none)
            hit = (hit == np.repeat(lowest, size)) & (hit < none)
            # overlapping places (a run of one symbol) merge from the left: every second place of a run
            run = hit & ~np.concatenate(([False], hit[:-1]))
            place = np.arange(len(hit))
            begun = np.maximum.accumulate(np.where(run, place, -1))
            hit &= (place - begun) % 2 == 0
            spots = np.flatnonzero(hit)
            symbols[spots] = self.merged[rank[spots]]
            counts -= np.bincount(owner[spots], minlength=len(counts))
            keep = np.repeat(live, size)  # sequences without a merge are finished
            keep[spots + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split = [self.pre_tokens(t) for t in texts]
        if len(self.memo) > MEMO:  # what is used again moves on from the older generation
            self.older, self.memo = self.memo, {}
        wanted = set().union(*(words for words, _ in split)).difference(self.memo)
        self.memo.update((w, self.older[w]) for w in wanted if w in self.older)
        new = [w for w in wanted if w not in self.older]
        for k in range(0, len(new), 100_000):
            self.memo.update(zip(new[k : k + 100_000], self.merge_counts(new[k : k + 100_000]).tolist(), strict=True))
        get = self.memo.__getitem__
        return [sum(map(get, words)) + found for words, found in split]


@functools.lru_cache(2)
def _model(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of every text.

    One pass without a shuffle. A null text counts as empty (0 bytes, 0
    tokens); a null id stays null; repeated rows each give a row; an empty
    table gives none; other columns are not read. ``tokenizer`` is the path
    of the vocabulary file, which every executor must have.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(tokenizer)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts: list[int] = []
        for k in range(0, len(texts), 1000):
            counts += model.count(texts[k : k + 1000])
        sizes = [len(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(keyed_text(docs, id_col, text_col), run, SCHEMA)
