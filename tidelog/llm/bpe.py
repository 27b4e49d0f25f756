"""BPE encoding and decoding with forced boundaries.

A merge never makes anything but a vocabulary token. So two neighbouring symbols that stand
side by side inside no token are never joined, directly or through longer tokens: the place
between them is a certain cut. A word is split at its certain cuts, its fragments are encoded
independently (and remembered, as they recur), and the ids are concatenated.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import lean, worker_cache

#: The tokenizer's pre-tokenisation: contractions, letters, single digits, other marks (fixed values).
#: The rank of pairs that are never joined; symbols of a fragment up to which it is merged by scans.
NEVER, SHORT = 1 << 60, 64
#: Characters that any Unicode version may lack.
RARE = re.compile("[^\x00-\u024f]")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Remembered:
    """A dictionary of bounded size: when the younger half is full, the older one is forgotten; what is asked for turns young."""

    HALF = 120_000

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self[key] = found
        return found

    def __setitem__(self, key, value) -> None:
        if len(self.young) >= self.HALF:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def __len__(self) -> int:
        return len(self.young) + len(self.old)


class BoundaryBpe:
    """An encoder and decoder for a tokenizer file of the word-end kind (NFC, lower case, byte level)."""


    def __init__(self, spec: str):
        model = json.loads(spec)
        end = model["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        ids = self.vocab | self.added
        self.strings: list[str | None] = [None] * (max(ids.values()) + 1)
        for t, i in ids.items():
            self.strings[i] = t
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["model"]["merges"])}
        self.end, self.spec, self.library = end, spec, None
        self.symbols = byte_symbols()
        self.split_added = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.inside: set[tuple[str, str]] = set()
        for token in self.vocab:
            s = self._units(token)
            self.inside.update(zip(s, s[1:]))
        self.words, self.fragments = Remembered(), Remembered()

    def _units(self, token: str) -> list[str]:
        """A token's symbols; the word end belongs to the last one."""
        if token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def cuts(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """The fragments between certain cuts."""
        if self.inside.issuperset(zip(symbols, symbols[1:])):
            return [tuple(symbols)]
        out, start = [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.inside:
                out.append(tuple(symbols[start:i]))
                start = i
        out.append(tuple(symbols[start:]))
        return out

    def merge(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The lowest-ranked pair is joined, the leftmost of equals first, until no pair has a rank."""
        if len(fragment) > SHORT:
            return self._merge_long(fragment)
        parts, get = list(fragment), self.ranks.get
        ranks = [get(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
        return tuple(map(self.vocab.__getitem__, parts))

    def _merge_long(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The same with a heap of pairs over a linked list, for fragments in which scans would add up."""
        parts: list[str | None] = list(fragment)
        n, get = len(parts), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1) for i, p in enumerate(zip(fragment, fragment[1:])) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or j >= n or get((parts[i], parts[j])) != rank:
                continue  # one of the two has been joined since
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, k))
            if (h := before[i]) >= 0 and (r := get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, i))
        return tuple(self.vocab[p] for p in parts if p is not None)

    def _word(self, word: str) -> tuple[int, ...]:
        # printable ASCII bytes are their own symbols
        symbols = list(word) if word.isascii() and word.isprintable() else [self.symbols[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.end
        fragments = self.cuts(symbols)
        if len(fragments) == 1:  # remembered as a word
            return self.merge(fragments[0])
        ids: list[int] = []
        for fragment in fragments:
            if (known := self.fragments.get(fragment)) is None:
                known = self.merge(fragment)
                if len(fragment) <= 64:  # what is remembered stays small
                    self.fragments[fragment] = known
            ids.extend(known)
        return tuple(ids)

    def _split(self, piece: str) -> list[str]:
        # the library's Unicode tables may know characters that Python's don't
        if any(unicodedata.category(c) == "Cn" for c in set(RARE.findall(piece))):
            return self._library_split(piece)
        # character by character, so that a final sigma is like any other
        return WORDS.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())

    def _library_split(self, piece: str) -> list[str]:
        """By the library's own normaliser and splitter, which write bytes as symbols already."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.byte_of = {s: b for b, s in enumerate(self.symbols)}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(self.byte_of[c] for c in p).decode("utf-8", "replace") for p, _ in parts]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for i, piece in enumerate(self.split_added.split(text or "")):
            if piece is None or not piece:
                continue
            if i % (len(self.added) + 1):
                ids.append(self.added[piece])
                continue
            words = self.words
            for word in self._split(piece):
                if (known := words.young.get(word)) is None and (known := words.get(word)) is None:
                    known = self._word(word)
                    if len(word) <= 64:
                        words[word] = known
                ids.extend(known)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between, as the library does for a file without a decoder."""
        try:
            return " ".join(map(self.strings.__getitem__, ids))
        except (IndexError, TypeError):  # ids without a token are passed over
            return " ".join(s for i in ids if 0 <= i < len(self.strings) and (s := self.strings[i]) is not None)


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _codec(spec: str) -> BoundaryBpe:
    """One encoder for each Python worker and tokenizer; it goes once the worker turns to another operator."""
    kept = worker_cache("bpe")
    if spec not in kept:
        kept.clear()
        kept[spec] = BoundaryBpe(spec)
    return kept[spec]


def _added_columns(batches: Iterator[pa.RecordBatch], spec, text: str, keep: list[str], full: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(spec.value)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for t in batch.column(text).to_pylist():
                ids = codec.encode(t)
                words = array.array("I", ids)
                if sys.byteorder == "big":
                    words.byteswap()
                back = codec.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(words.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if full:
                    all_ids.append(ids)
                    decoded.append(back)
            out = {c: batch.column(c) for c in keep}
            if full:
                out |= {"token_ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            out |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}
            yield pa.RecordBatch.from_pydict(out)


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", full: bool = True) -> DataFrame:
    """docs without `text`, plus token_ids and decoded (if full), n_tokens, ids_sha256, decoded_sha256.

    The tokenizer file is read on the driver and broadcast; its size does not grow with the data.
    A null text is an empty one: no tokens, an empty decoded string. Whole texts are encoded
    whatever their length; the added tokens' strings in a text give those tokens. Repeated rows
    are encoded each; an empty table gives an empty result. Columns of docs that have the name of
    a new column are replaced.
    """
    new = ["token_ids", "decoded"] * full + ["n_tokens", "ids_sha256", "decoded_sha256"]
    types = {"token_ids": "array<int>", "n_tokens": "long"}
    keep = [c for c in docs.columns if c not in new and c != text]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {types.get(c, 'string')}" for c in new])
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))
    return docs.select(*[F.col(f"`{c}`") for c in [*keep, text]]).mapInArrow(
        lean(lambda it: _added_columns(it, spec, text, keep, full), "bpe"), schema
    )
