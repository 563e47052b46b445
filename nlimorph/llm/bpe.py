"""Operator 7: byte-level BPE encoding and decoding in batched numpy merge rounds.

The words a batch needs that the worker does not know yet are laid out in one flat array of symbols.
In each round every adjacent pair is looked up by binary search over the sorted pair keys of the
vocabulary, each word's lowest-ranked pair is merged wherever it stands in that word, and the array is
closed up; words without a known pair leave. Words of over ``LONG`` bytes would need too many rounds: they
share an array whose symbols know their neighbours, a round is one rank, and only the places that a merge
changed are looked up again. Results go to a bounded cache.

Defined results: null text counts as empty (no ids, empty decoded text); repeated rows give repeated
results; null ids stay null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from nlimorph.llm._shared import split_batch
from nlimorph.llm.token_counts import load_tokenizer

CACHE_ENTRIES = 300_000
LONGEST_CACHED = 64
LONG = 256
#: The word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1) << 40
_loaded: dict[str, "BytePairs"] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    """A vocabulary as arrays: sorted pair keys with rank and result, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.first = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made_by_rank = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.made = self.made_by_rank[order]
        self.pattern = regex.compile(WORDS)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.path, self.library = path, None

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        long = [k for k, x in enumerate(raw) if len(x) > LONG]
        if not long:
            return self.merge_rounds(raw)
        out = self.merge_rounds([b"" if len(x) > LONG else x for x in raw])
        for k, ids in zip(long, self.merge_by_rank([raw[k] for k in long]), strict=True):
            out[k] = ids
        return out

    def _cut(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
        """The symbols of each of n words, which stand in order of their owners."""
        flat, ends = symbols.astype("<u4").tobytes(), np.searchsorted(owner, np.arange(n + 1)) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def merge_by_rank(self, raw: list[bytes]) -> list[bytes]:
        """Long words end to end: ranks are taken in order, each merged in all places where it is found."""
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols, owner = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.repeat(np.arange(len(raw)), sizes)
        n = len(symbols)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)  # neighbours that are left; n is no place
        rank, alive = np.full(n, NO_RANK), np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places, and note the places by rank."""
            rank[at] = NO_RANK
            at = at[after[at] < n]
            at = at[owner[at] == owner[after[at]]]
            keys = (symbols[at] << 32) | symbols[after[at]]
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[slot] == keys
            at, found = at[known], self.rank[slot[known]]
            rank[at] = found
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            heads = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else found
            for r, part in zip(found[heads].tolist(), np.split(at, heads[1:]), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        look(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # in a run of overlapping hits (the pair of a letter with itself) every second one counts
            new = np.r_[True, after[at[:-1]] != at[1:]]
            at = at[(np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % 2 == 0]
            gone = after[at]
            alive[gone] = False
            symbols[at], after[at] = self.made_by_rank[r], after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            ahead = before[at]
            look(np.unique(np.concatenate([at, ahead[ahead >= 0]])))
        return self._cut(symbols[alive], owner[alive], len(raw))

    def merge_rounds(self, raw: list[bytes]) -> list[bytes]:
        """Words end to end: in every round the lowest-ranked pair of each word is merged."""
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            at = np.full(len(symbols), NO_RANK)
            slot = np.zeros(len(symbols), dtype=np.int64)
            if len(symbols) > 1:
                keys = (symbols[:-1] << 32) | symbols[1:]
                slot[:-1] = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                known = (self.keys[slot[:-1]] == keys) & (owner[:-1] == owner[1:])
                at[:-1] = np.where(known, self.rank[slot[:-1]], NO_RANK)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(at, starts), lengths)
            over = lowest == NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            chosen = (at == lowest) & ~over
            # in a run of overlapping hits (the pair of a letter with itself) every second one counts
            hit = np.flatnonzero(chosen)
            if len(hit):
                run = np.cumsum(np.r_[True, np.diff(hit) != 1]) - 1
                first = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
                chosen[hit[(np.arange(len(hit)) - first[run]) % 2 == 1]] = False
            symbols = np.where(chosen, self.made[slot], symbols)
            keep = ~over
            keep[1:] &= ~chosen[:-1]
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return [b""] * len(raw)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return self._cut(symbols[order], owner[order], len(raw))

    def _split_by_library(self, text: str) -> list[str]:
        if self.library is None:
            self.library = load_tokenizer(self.path).pre_tokenizer
        words: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            words += ["\0" + part] if k % 2 else [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; special strings in a text become their own ids."""
        split: list[list[str]] = []
        for text in texts:
            if self.special is None:
                split.append(self.pattern.findall(text))
                continue
            words: list[str] = []
            for k, part in enumerate(self.special.split(text)):
                if k % 2:
                    words.append("\0" + part)  # marks a special string; no pattern word is longer than \0 with one
                else:
                    words += self.pattern.findall(part)
            split.append(words)
        known = self.cache
        missing = {w for words in split for w in words if w not in known}
        odd = {w for w in missing if not w.isascii() and any(category(c) == "Cn" for c in w)}
        if odd:  # letters newer than this interpreter's tables: the tokenizer's own splitter decides
            split = [self._split_by_library(t) if not odd.isdisjoint(words) else words for t, words in zip(texts, split, strict=True)]
            missing = {w for words in split for w in words if w not in known}
        special = {w for w in missing if w[0] == "\0" and w[1:] in self.added}
        plain = list(missing - special)
        fresh = dict(zip(plain, self.ids_of(plain), strict=True)) if plain else {}
        fresh |= {w: np.array([self.added[w[1:]]], dtype="<u4").tobytes() for w in special}
        out = [b"".join([ids if (ids := known.get(w)) is not None else fresh[w] for w in words]) for words in split]
        if len(known) + len(fresh) > CACHE_ENTRIES:
            known.clear()
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST_CACHED and w not in odd and w not in special)
        return out

    def decode(self, ids: bytes) -> str:
        parts = map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(parts).decode("utf-8", errors="replace")


def load(path: str) -> BytePairs:
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids, decoded) of every row; with ``digests``, the SHA-256 of each instead of its content."""
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, {kinds}"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(tokenizer_path)
        for whole in batches:
            for batch in split_batch(whole, text_col, 1 << 20):
                ids = pairs.encode([t or "" for t in batch.column(1).to_pylist()])
                decoded = [pairs.decode(x) for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    rest = [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
                else:
                    rest = [pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), n, *rest], names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
