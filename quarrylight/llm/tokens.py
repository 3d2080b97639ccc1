"""Token ids by the tokenizers library, each distinct word encoded once.

A byte-level tokenizer cuts a text before merging, and a space followed by a non-space always starts
a new piece. So texts are cut there, and the library encodes each word only the first time a worker
process meets it; Arrow finds the distinct words of a block, and ids are put together as arrays. Texts with other white space around a space go to the library whole, and so do texts
that hold the string of an added token, which the library's default encodes as that token.
"""

from __future__ import annotations

import gc
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: The pattern of byte-level tokenizers of this family (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memory before it is emptied.
REMEMBERED = 650_000
#: Marks that often end a word; the pattern cuts before them.
ENDS = (".", ",")
#: Characters handled at once.
BLOCK = 3_000_000
#: Pieces spelled in byte letters at once.
GROUP = 5_000

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file; it only remembers, so losing it costs time alone."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        cutter = self.whole.pre_tokenizer
        self.by_word = (
            isinstance(cutter, pre_tokenizers.ByteLevel) and self.whole.normalizer is None
            and not cutter.add_prefix_space and cutter.use_regex
        )
        # The place of each chunk; its ids are ids[starts[place]:starts[place + 1]].
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if not self.by_word:
            return
        self.merge = self.whole.model.tokenize
        self.letters = byte_letters()
        self.spaced = self.letters | {10: "\n"}
        self.cut = regex.compile(PIECES).findall
        self.uneven = re.compile(r" (?=\s|\Z)").search
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]):
        """The ids of each text as little-endian unsigned 32-bit integers, in order."""
        texts = iter(texts)
        while True:
            block, size = [], 0
            for text in texts:
                block.append(text)
                size += len(text)
                if size >= BLOCK:
                    break
            if not block:
                return
            yield from self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._wholly(texts)
        collects = gc.isenabled()
        gc.disable()  # millions of small strings, no cycles
        try:
            return self._cut_block(texts)
        finally:
            if collects:
                gc.enable()

    def _cut_block(self, texts: list[str]) -> list[bytes]:
        found: list[bytes | None] = [None] * len(texts)
        cut, heads, rests, odd = [], [], [], []
        for i, text in enumerate(texts):
            if self.uneven(text) or any(x in text for x in self.added):
                odd.append(i)
            else:
                head, _, rest = text.partition(" ")
                cut.append(i)
                heads.append(" " + head)  # marks the chunk without a space before it
                rests.append(rest or None)
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        head_places, places = self._learned(heads), self._learned(chunks)
        # The chunks of each text in order: its head, then those of its rest.
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        stops = np.cumsum(sizes)
        first = np.zeros(len(heads) + len(coded), bool)
        first[stops - sizes] = True
        order = np.empty(len(first), np.int64)
        order[first] = head_places
        order[~first] = places[coded.indices.to_numpy()]
        ids, lengths = self._ids(order)
        ends = (np.append(0, np.cumsum(lengths))[stops] * 4).tolist()
        raw = ids.tobytes()
        for i, begin, end in zip(cut, [0, *ends], ends):
            found[i] = raw[begin:end]
        for i, ids in zip(odd, self._wholly([texts[i] for i in odd]), strict=True):
            found[i] = ids
        if len(self.known) > REMEMBERED:  # what words make up is soon put together again
            self._keep([x for x in self.known if x.isalpha()])
        if len(self.known) > REMEMBERED * 3 // 4:
            self._keep([])
        return found

    def _learned(self, chunks: list[str]) -> np.ndarray:
        """The places of chunks; new ones are learned."""
        places = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        at = np.flatnonzero(places < 0)
        if len(at):
            new = [chunks[i] for i in at.tolist()]
            self._learn(set(new))
            places[at] = self._places(new)
        return places

    def _places(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def _ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remembered ids at some places, one after another, and how many each has."""
        begins = self.starts[places]
        lengths = self.starts[places + 1] - begins
        stops = np.cumsum(lengths)
        at = np.repeat(begins - stops + lengths, lengths)
        at += np.arange(len(at))
        return self.ids[at], lengths

    def _keep(self, chunks: list[str]) -> None:
        """Remember only these."""
        ids, lengths = self._ids(self._places(chunks))
        self.known, self.ids, self.starts = {}, ids[:0], np.zeros(1, np.int64)
        self._remember(chunks, ids, lengths)

    def _remember(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.starts) - 1
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths))
        self.ids = np.append(self.ids, ids)

    def _wholly(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(x.ids, "<u4").tobytes() for text in texts
            for x in self.whole.encode_batch_fast([text], add_special_tokens=False)
        ]

    def _learn(self, chunks: set[str]) -> None:
        """Remember the ids of each chunk: `x` stands for a space and x, ` x` for x without it."""
        known = self.known
        words, ended, stems, pieces = [], [], [], {}
        for chunk in chunks:
            if chunk.isalpha():
                words.append(chunk)
            elif chunk[-1:] in ENDS and (stem := chunk[:-1]).isalpha():
                ended.append(chunk)
                stems.append(stem)
            else:
                cut = self.cut(chunk[1:] if chunk[:1] == " " else " " + chunk)
                parts = [x[1:] if x[:1] == " " and len(x) > 1 else " " + x for x in cut]
                if parts == [chunk]:
                    words.append(chunk)
                else:
                    pieces[chunk] = parts
        marks = [" " + x for x in ENDS]
        need = {x for parts in (stems, marks, *pieces.values()) for x in parts if x not in known}
        need.update(words)
        self._merge(need)
        if ended:
            places = np.stack([self._places(stems), np.array([known[" " + x[-1]] for x in ended])], 1).ravel()
            self._compose(ended, places, np.full(len(ended), 2))
        if pieces:
            places = self._places([x for parts in pieces.values() for x in parts])
            self._compose(list(pieces), places, np.array([len(parts) for parts in pieces.values()]))

    def _compose(self, chunks: list[str], places: np.ndarray, sizes: np.ndarray) -> None:
        """Remember chunks that are made of remembered pieces, so many for each."""
        ids, lengths = self._ids(places)
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(sizes)]
        self._remember(chunks, ids, np.diff(ends, prepend=0))

    def _merge(self, keys: set[str]) -> None:
        """Let the library's model encode pieces that its cutter would leave whole."""
        plain, lines = [x for x in keys if "\n" not in x], [x for x in keys if "\n" in x]
        spaced = lambda group: [x[1:] if x[:1] == " " else " " + x for x in group]
        for lo in range(0, len(plain), GROUP):
            group = plain[lo:lo + GROUP]
            spelled = "\n".join(spaced(group)).encode().decode("latin-1").translate(self.spaced)
            self._encode(group, spelled.split("\n"))
        self._encode(lines, [x.encode().decode("latin-1").translate(self.letters) for x in spaced(lines)])

    def _encode(self, keys: list[str], spelled: list[str]) -> None:
        found = [[token.id for token in x] for x in map(self.merge, spelled)]
        ids = np.fromiter(chain.from_iterable(found), "<u4")
        self._remember(keys, ids, np.fromiter(map(len, found), np.int64, len(found)))
