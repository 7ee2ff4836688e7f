"""Byte-level BPE ids of whole texts, from the tokenizers library, remembered by word.

The tokenizer's pre-tokens never reach across a single space that stands before a non-space: the space begins the next one.
So texts are cut there, by Arrow, which also tells the distinct words of some megabytes of text. Of these the library encodes
the new ones, once each with its space: many as one text, whose ids are told apart by the bytes that they stand for. The ids
of the texts are then gathered from those of the words. A text in which a space stands between other white space is encoded
whole by the library.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers, with up to 8 times as many ids; when there are more, those of the latest texts are kept.
REMEMBERED = 1_500_000
#: Bytes of the texts whose words are looked up together; a longer text is alone.
GROUP_BYTES = 1 << 23


#: What a word's edges are: white space begins it, white space ends it, it is empty (then both).
_BEGINS, _ENDS, _EMPTY = 1, 2, 4


#: Bytes that are no white space, nor part of it.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True


def _edges(word: str) -> int:
    return word[0].isspace() * _BEGINS | word[-1].isspace() * _ENDS if word else _BEGINS | _ENDS | _EMPTY


def _bytes_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many bytes each word has, its first and its last one (of an empty word: 0)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1]
    data = np.frombuffer(b"\0" if words.buffers()[2] is None else words.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    first, last = (data.take(at, mode="clip") * (sizes > 0) if len(data) else np.zeros(len(words), np.uint8) for at in (offsets[:-1], offsets[1:] - 1))
    return sizes, first, last


def _grown(x: np.ndarray, used: int, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x[:used], np.empty(2 * n - used, x.dtype)))


class _Words:
    """ids of words, one after the other, and the numbers of the words."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.n, self.count = np.empty(1 << 16, np.uint16), 0, 0
        self.start, self.size, self.edges = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32), np.empty(1 << 14, np.uint8)

    def put(self, ids: np.ndarray, sizes: np.ndarray, edges: np.ndarray | int = 0) -> int:
        """The number of the first of the runs that are put behind the others."""
        first, n, count = self.count, self.n + len(ids), self.count + len(sizes)
        self.ids = _grown(self.ids, self.n, n)
        self.start, self.size, self.edges = (_grown(x, first, count) for x in (self.start, self.size, self.edges))
        self.ids[self.n : n] = ids
        self.start[first:count] = np.cumsum(sizes) - sizes + self.n
        self.size[first:count], self.edges[first:count] = sizes, edges
        self.n, self.count = n, count
        return first

    def drop(self, first: int) -> None:
        """Forgets the runs from this number on."""
        self.n, self.count = int(self.start[first]), first

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the runs with these numbers, one after the other, and how many each has."""
        sizes = self.size.take(numbers)
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(self.start.take(numbers) - (ends - sizes), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids.take(at), sizes


class Encoder:
    """ids of texts as unsigned 16-bit numbers (the vocabulary has fewer than 65,536 ids)."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocab = self.tokenizer.get_vocab()
        if len(vocab) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes that each id stands for: byte-level BPE writes one letter for each.
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        #: ids of words with the space before them.
        self.words = _Words()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts, one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint16, sizes.sum()), sizes

    def _spaced(self, words: list[str], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words with a space before each, all of them encoded as one text. held: their bytes."""
        text = " " + " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        have = np.cumsum(self.sizes[ids])
        want = np.cumsum(held + 1)
        cuts = np.searchsorted(have, want)
        if cuts[-1] < len(have) and (have[cuts] == want).all():  # no id goes from one word to the next
            return ids.astype(np.uint16), np.diff(cuts, prepend=-1)
        return self._encode([" " + w for w in words])

    def _numbers(self, words: list[str], coded: pa.StringArray) -> np.ndarray:
        """The number of each word (distinct ones, both ways), after the new ones have been encoded."""
        known = self.words.number
        out = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(out < 0)
        held, first, last = (x[new] for x in _bytes_of(coded))
        edges = np.zeros(len(new), np.uint8)
        odd = np.flatnonzero(~(_PLAIN[first] & _PLAIN[last]))
        edges[odd] = [_edges(words[k]) for k in new[odd].tolist()]
        # white space at a word's edge may join that of its neighbour
        plain, edged = np.flatnonzero(edges == 0), np.flatnonzero(edges)
        for at in [*(plain[s : s + 1000] for s in range(0, len(plain), 1000)), edged]:
            if len(at):
                some = [words[k] for k in new[at].tolist()]
                ids = self._spaced(some, held[at]) if at is not edged else self._encode([" " + w for w in some])
                n = self.words.put(*ids, edges[at])
                out[new[at]] = np.arange(n, n + len(some))
                known.update(zip(some, range(n, n + len(some)), strict=True))
        if len(known) > REMEMBERED or self.words.n > 8 * REMEMBERED:
            kept = _Words()
            kept.put(*self.words.gathered(out), self.words.edges[out])
            kept.number = dict(zip(words, range(len(words)), strict=True))
            self.words, out = kept, np.arange(len(words), dtype=np.int32)
        return out

    def _group(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers, first = self._numbers(words, coded.dictionary).take(at), bounds[:-1]
        # white space at both sides of a space (or the end behind it); an empty word that begins a text has none before it
        edges = self.words.edges.take(numbers)
        edges[first] &= np.where(edges[first] & _EMPTY, 0, _ENDS).astype(np.uint8)
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(bounds, np.flatnonzero(edges[:-1] & _ENDS & (edges[1:] << 1)), "right") - 1] = True
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        # what begins a text has no space before it; a text encoded whole is all there
        heads = [words[k] for k in at[first].tolist()]
        nothing = own = self.words.put(np.zeros(0, np.uint16), np.zeros(1, np.int32))
        for i in np.flatnonzero(whole).tolist():
            heads[i] = texts[i].as_py()
            numbers[bounds[i] : bounds[i + 1]] = nothing
        heads = self.words.put(*self._encode(heads))
        numbers[first] = np.arange(heads, heads + len(texts))
        if end is not None:
            numbers = np.insert(numbers, bounds[1:], self.words.put(np.array([end], np.uint16), np.ones(1, np.int32)))
            first = first + np.arange(len(texts))
        ids, sizes = self.words.gathered(numbers)
        self.words.drop(own)
        return ids, np.add.reduceat(sizes, first)

    def groups(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many each text has) of runs of texts in order; null counts as empty. end: an id to put behind each."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        s = 0
        while s < len(texts):
            t = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + GROUP_BYTES, "right")))
            yield self._group(texts.slice(s, t - s).cast(pa.string()), end)
            s = t

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as little-endian bytes; null counts as empty."""
        out = []
        for ids, sizes in self.groups(pa.array(texts, pa.string())):
            data, cuts = ids.astype("<u2").tobytes(), np.cumsum(2 * sizes).tolist()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out


@functools.cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each Python worker, which keeps what it remembers from task to task."""
    return Encoder(path, special_as_text)
