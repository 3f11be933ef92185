"""Token ids of whole texts by a public tokenizer file (.json of tokenizers, or .tiktoken ranks)."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from talewind.llm.common import SLICE_BYTES, filled, raw_bytes, slices

#: Different pieces of text whose ids a worker remembers; then it starts anew.
REMEMBERED = 1_000_000
#: Letters up to here are alike in all libraries' tables; texts with others go through the tokenizer itself.
LATIN = 0x250


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts may be cut without any change of their ids: between a visible character and an ASCII space after it.

    No pattern of the tokenizers joins a word with what follows a space, if white space has no ids. No cut is made after what
    might be another kind of space.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[0], data[:-1]])
    two, three = np.concatenate([[0, 0], data[:-2]])[: len(data)], np.concatenate([[0, 0, 0], data[:-3]])[: len(data)]
    visible = ((before > 32) & (before < 127)) | ((before > 127) & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))
    at = space & visible
    at[starts[:-1][starts[:-1] < len(data)]] = True
    return np.flatnonzero(at)


class RankEncoder:
    """Ids from a .tiktoken file of ranks; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        each = [self.encoding.encode_to_numpy(x, disallowed_special=()) for x in filled(texts).to_pylist()]
        return np.concatenate(each or [np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate([[0], np.cumsum(list(map(len, each)))]).astype(np.int64)


class WordEncoder:
    """Ids from a .json file. Pieces of text between spaces are encoded once per worker, as long as they are remembered.

    Where the file has lower-case byte pairs with word ends and drops white space, new pieces of Latin letters are encoded many
    at a time by the same merges: the word end is written as a space, which no word holds, and the vocabulary then is a list of
    byte strings in the order of the merges. Everything else goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self._forget()
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path) as f:
            spec = json.load(f)
        self.drops_space = not self.tokenizer.encode(" \n ", add_special_tokens=False).ids
        lowers = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if self.drops_space and lowers and spec["model"].get("end_of_word_suffix") == "</w>" and split.get("invert"):
            self._prepare(spec, split["pattern"]["Regex"])
        marks = "|".join(re.escape(x["content"]) for x in spec["added_tokens"])
        #: Control characters, spaces and letters that other libraries may see otherwise; special tokens.
        self.odd = re.compile(rf"[^\x21-\x7E\u00C0-\u{LATIN:04X}]" + (f"|{marks}" if marks else ""))

    def _prepare(self, spec: dict, pattern: str) -> None:
        import regex
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            word, end = (token[:-4], b" ") if token.endswith("</w>") else (token, b"")
            if all(c in byte for c in word):
                ranks.setdefault(bytes(byte[c] for c in word) + end, i)
        order = [ranks.get(bytes([b])) for b in range(256)]
        ends = [ranks.get(bytes([b, 32])) for b in range(256)]
        merges = [x if isinstance(x, str) else " ".join(x) for x in spec["model"]["merges"]]
        first = spec["model"]["vocab"].get(merges[0].replace(" ", ""))
        made = [spec["model"]["vocab"].get(x.replace(" ", "", 1)) for x in merges]
        # Ids must be the merges' order, with all single bytes and bytes at a word end before them.
        if None in order or None in ends or max(order) >= min(ends) or max(ends) >= first or made != sorted(made):
            return
        ranks = {k: v for k, v in ranks.items() if v <= made[-1]}
        self.line = ranks[b"\n"]
        self.fast = tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(pattern)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Number new pieces and append their ids to those of the others."""
        plain, other = [], pieces
        if self.fast:
            other = [x for x in pieces if self.odd.search(x)]
            plain = [x for x in pieces if not self.odd.search(x)] if other else pieces
        found, sizes = [self.ids], []
        if plain:
            lines = unicodedata.normalize("NFC", "\n".join(plain)).lower()
            ids = self.fast.encode_to_numpy(self.words.sub(r"\g<0> ", lines), disallowed_special=())
            ends = np.flatnonzero(ids == self.line)
            sizes.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
            found.append(np.delete(ids, ends).astype(np.uint32))
        for x in other:
            found.append(np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32))
            sizes.append([len(found[-1])])
        self.known.update(zip([*plain, *other], range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.ids = np.concatenate(found)
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        if fresh := [x for x in pieces if x not in self.known]:
            self._learn(list(dict.fromkeys(fresh)))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        data, starts = raw_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        at = cuts(data, starts) if self.drops_space else np.unique(starts[:-1][np.diff(starts) > 0])
        bounds = np.append(at, len(data)).astype(np.int32)
        cut = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = (pc.ascii_ltrim_whitespace(cut) if self.drops_space else cut).dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begin, lengths = self.begin[number], self.begin[number + 1] - self.begin[number]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1]) + np.repeat(begin - (ends - lengths), lengths)
        until = np.concatenate([[0], ends])
        return self.ids[take], until[np.searchsorted(at, starts)]


@cache
def encoder(path: str):
    """One per Python worker, so that what it remembers serves all its tasks."""
    return RankEncoder(path) if path.endswith(".tiktoken") else WordEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    own = encoder(path)
    for batch in slices(batches, most=3 * SLICE_BYTES):
        yield batch, *own(batch.column("text"))
