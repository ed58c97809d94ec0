"""Texts cut into chunks that a byte-level BPE tokenizer never merges across.

The tokenizer's pattern starts a new pre-token at a single space between two characters
that are no white space: what precedes can't end in that space, and ``' x...'`` starts
there. So a text may be cut at each of these spaces and the chunks tokenized apart, with
the same ids. A block of texts is cut and reduced to its distinct chunks by Arrow; the
values of those that recur come from a bounded table.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space of any kind, as a class for Arrow's regular expressions.
_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Texts with a space that isn't between two other characters.
_ODD = f"^ | $| {_SPACE}|{_SPACE} "
#: Chunks of Latin characters whose only white space is a space at the begin and line ends between or behind others.
_PLAIN = "^ ?[!-~¡-ɏ]+(\n[!-~¡-ɏ]+)*\n?$"
#: Those of them that are words with marks (any but the apostrophe) behind: only mark runs and line ends are places to cut, which is cheaper to find.
_MARK = "[!-&(-/:-@\\[-`{-~]"
_SIMPLE, _MARKS = f"^ ?[A-Za-zÀ-ÖØ-öø-ɏ]+{_MARK}*(\n[A-Za-zÀ-ÖØ-öø-ɏ]+{_MARK}*)*$", f"({_MARK}+|\n)"
#: Fixed value: the pre-tokens of a byte-level tokenizer, for text where white space never stands beside white space.
_PRE_TOKEN = r"('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+)"


def text_blocks(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The column as large strings, null as empty, in slices of about ``size`` bytes; a longer text has one of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, before + size, side="right")), at + 1)
        yield texts.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory to the system.

    A Python worker outlives its tasks, and what it keeps counts against its executor's limit.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def strings(array: pa.Array) -> list:
    """As ``to_pylist``, without making a scalar of each value first."""
    return array.to_numpy(zero_copy_only=False).tolist()


def gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``pool[start:start + count]`` of each range, one after the other."""
    ends = np.cumsum(counts)
    shift = np.repeat(starts - (ends - counts), counts)
    shift += np.arange(len(shift))
    return pool[shift]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values[starts[k]:starts[k + 1]]`` for each k; ranges may be empty."""
    total = np.r_[0, np.cumsum(values)]
    return total[starts[1:]] - total[starts[:-1]]


def chunks(text: str) -> list[str]:
    """Chunks of ``text``, in order; joined by single spaces they give the text. Empty for an empty text.

    All but the first stand without the space that they begin with.
    """
    return _CUT.split(text) if text else []


@dataclass
class Chunked:
    """Distinct chunks of a block, with their spaces, and each text's chunks as places in that list.

    The chunks of text ``order[k]`` are ``at[starts[k]:starts[k + 1]]``.
    """

    distinct: list[str]
    at: np.ndarray
    starts: np.ndarray
    order: np.ndarray

    def in_order(self) -> Chunked:
        """The same with texts in the order of the block."""
        if (np.diff(self.order) == 1).all():
            return self
        back = np.argsort(self.order)
        sizes = np.diff(self.starts)[back]
        return Chunked(self.distinct, gather(self.at, self.starts[:-1][back], sizes), np.r_[0, np.cumsum(sizes)], np.arange(len(back)))


def cut_block(texts: pa.Array, odd: str, split: Callable[[str], list[str]], lead: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct units, places, starts, order): texts that ``odd`` matches are cut by ``split``, others at each space.

    ``lead`` is put before each unit that a space begins; ``split`` returns units without it.
    """
    match = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~match & ~empty), np.flatnonzero(match & ~empty)
    lists = [split(t) for t in strings(texts.take(pa.array(rest)))]
    cut = pc.split_pattern(texts if len(plain) == len(texts) else texts.take(pa.array(plain)), " ")
    sizes = np.r_[np.diff(cut.offsets.to_numpy()), np.fromiter(map(len, lists), np.int64, len(lists)), np.zeros(int(empty.sum()), np.int64)].astype(np.int64)
    flat = cut.flatten()
    if len(rest):
        flat = pa.concat_arrays([flat, pa.array([x for parts in lists for x in parts], pa.large_string())])
    coded = flat.dictionary_encode()
    units = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
    return units, coded.indices.to_numpy().astype(np.int64), np.r_[0, np.cumsum(sizes)], np.r_[plain, rest, np.flatnonzero(empty)]


def chunk_block(texts: list[str] | pa.Array) -> Chunked:
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    units, at, starts, order = cut_block(texts, _ODD, chunks, " ")
    distinct = strings(units)
    # A text's first chunk has no space before it, so it is another entry than the same word inside.
    first = starts[:-1][np.diff(starts) > 0]
    begins, place = np.unique(at[first], return_inverse=True)
    at[first] = len(distinct) + place
    distinct += [distinct[i][1:] for i in begins.tolist()]
    return Chunked(distinct, at, starts, order)


class ValueTable:
    """The values of words: a range of a flat array each, made once for words that recur.

    ``make`` takes words and returns (values of all, how many each has). When more than
    ``size`` words are held, those of the last call stay and all others go, so memory is
    bounded by ``size`` words and one call's.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], size: int = 500_000) -> None:
        self.make, self.size = make, size
        self.place: dict[str, int] = {}
        self.pool, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last: tuple[list[str], np.ndarray] = [], np.zeros(0, np.int64)

    def _forget(self) -> None:
        keys, at = self.last
        counts = self.counts[at]
        self.pool = gather(self.pool, self.starts[at], counts)
        self.starts, self.counts = np.cumsum(counts) - counts, counts
        self.place = dict(zip(keys, range(len(keys)), strict=True))

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(starts in ``pool``, counts) of ``keys``; good until the next call."""
        if len(self.counts) > self.size:
            self._forget()
        found = list(map(self.place.get, keys))
        if None in found:
            new = [k for k, i in zip(keys, found, strict=True) if i is None]
            held = len(self.counts)  # a repeated key has an entry each time it is new
            flat, counts = self.make(new)
            self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(counts) - counts]
            self.pool, self.counts = np.concatenate([self.pool, flat.astype(np.int32)]), np.r_[self.counts, counts]
            self.place.update(zip(new, range(held, held + len(new)), strict=True))
            fresh = iter(range(held, held + len(new)))
            found = [next(fresh) if i is None else i for i in found]
        at = np.array(found, np.int64)
        self.last = keys, at
        return self.starts[at], self.counts[at]


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkTokenizer:
    """Ids of chunks by the tokenizers library.

    Where the file has a byte-level pre-tokenizer without a prefix space and no normalizer,
    plain chunks are cut into pre-tokens by Arrow and handed to the library in byte
    letters, many in one call; which ids belong to which chunk follows from the bytes that
    ids stand for. All other chunks go through the whole library one by one.
    """

    #: Chunks handed over in one call: bounds the library's own objects.
    CALL = 20_000

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cut = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.cut):
            t.no_truncation()
            t.no_padding()
        config = json.loads(self.tokenizer.to_str())
        pre = config.get("pre_tokenizer") or {}
        self.added = [a["content"] for a in config.get("added_tokens", [])]
        if any(" " in a for a in self.added):
            raise ValueError("an added token spans chunks")
        self.direct = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not config.get("normalizer")
        # Byte 0 is in no plain chunk: it stands between pre-tokens as a line end, which is no byte letter.
        self.cut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters = np.array([ord(c) for _, c in sorted((_byte_letters() | {0: "\n"}).items())], "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)

    def ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has)."""
        made = [self._some(pa.array(keys[a : a + self.CALL], pa.large_string())) for a in range(0, len(keys), self.CALL)]
        return np.concatenate([np.zeros(0, np.int32), *[i for i, _ in made]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in made]])

    def _some(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        none = pa.array(np.zeros(len(keys), bool))
        plain = pc.match_substring_regex(keys, _PLAIN) if self.direct else none
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(keys, token))
        simple = pc.and_(plain, pc.match_substring_regex(keys, _SIMPLE)) if self.direct else none
        made = [
            (simple, lambda k: self._cut_ids(k, pc.replace_substring_regex(k, _MARKS, "\x00\\1\x00"))),
            (pc.and_not(plain, simple), lambda k: self._cut_ids(k, pc.replace_substring_regex(k, _PRE_TOKEN, "\\1\x00"))),
            (pc.invert(plain), self._whole_ids),
        ]
        places = [np.flatnonzero(mask) for mask, _ in made]
        parts = [run(keys.filter(mask)) for (mask, run), at in zip(made, places, strict=True) if len(at)]
        order, flat, counts = np.concatenate(places), np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts])
        if len(parts) == 1:
            return flat, counts
        back = np.argsort(order)
        return gather(flat, (np.cumsum(counts) - counts)[back], counts[back]), counts[back]

    def _whole_ids(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(strings(keys), add_special_tokens=False)]
        return np.fromiter((i for ids in lists for i in ids), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _cut_ids(self, keys: pa.Array, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``keys`` from ``parts``, the same with byte 0 between pre-tokens."""
        raw = "\x00".join(strings(parts)).encode()
        lettered = self.letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.cut.encode_batch_fast([lettered], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum(pc.binary_length(keys).to_numpy())
        after = np.cumsum(self.bytes[ids])
        place = np.searchsorted(after, ends)
        if after[-1] != ends[-1] or (after[place] != ends).any():
            raise ValueError("ids don't cover the chunks")
        return ids, np.diff(np.r_[-1, place])

    def raw_ids(self, keys: list[str]) -> list[bytes]:
        """Each chunk's ids as little-endian 32-bit integers."""
        flat, counts = self.ids(keys)
        ends = np.cumsum(counts)
        return [flat[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
