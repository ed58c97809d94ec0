"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of many words lie in one flat array. Each round takes the smallest pair rank
of every word (segmented minimum), merges all its occurrences from the left at once,
compacts the array and looks up only the pairs that changed; words without a pair leave.
Merging the occurrences one by one gives the same as long as no pair that a merge makes
ranks before the merged one. Where one does, the word is encoded again, one merge a round.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Chunked, ValueTable, cut_block, gather, give_back, strings, sums, text_blocks

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Texts with a space that isn't between two other characters, or with the sign for spaces.
_ODD = f"^ | $|  |{SPACE}"
_NONE = np.int64(1 << 40)


def words(text: str) -> list[str]:
    """The units within which pieces can merge: spaces, then what follows up to a space."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def word_block(texts: list[str] | pa.Array) -> Chunked:
    """Distinct words of a block, with the sign that each begins with, and each text's words."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    units, *rest = cut_block(texts, _ODD, lambda t: [w[1:] for w in words(t)], SPACE)
    return Chunked(strings(units), *rest)


class PieceModel:
    """Pieces and merge ranks of a sentencepiece BPE file with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        self.control = [lib.is_control(i) for i in range(n)]
        self.unknown = [lib.is_unknown(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not (byte[i] or self.control[i] or self.unknown[i])}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece spans words")
        if len(lib.encode("a  b", out_type=str)) == 0 or lib.decode(lib.encode(" a  b ")) != " a  b ":
            raise ValueError("the model's normalisation isn't the identity")
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_id[int(pieces[i][3:5], 16)] = i
        self.is_byte = np.array(byte)
        # What each id adds to a decoded text. Byte pieces add their byte.
        self.surface = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if self.control[i] else " ⁇ ".encode() if self.unknown[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.leading = [normal.get(p) == i and p.startswith(SPACE) for i, p in enumerate(pieces)]
        self.surfaces, self.lead, self.special = pa.array(self.surface, pa.large_binary()), np.array(self.leading), np.array(byte) | np.array(self.control) | np.array(self.unknown)
        self.decimals = pa.array([str(i).encode() for i in range(n)], pa.large_binary())
        # Symbols: the pieces, then characters that only occur inside pieces, then any other character.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.n, self.base = n, max(symbols.values()) + 1
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.base
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.chars = {i: p for p, i in symbols.items() if i >= n}
        score = {p: lib.get_score(i) for p, i in normal.items()}
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        entries = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    entries[left * self.base + right] = (rank[score[p]], i)
        keys = np.array(sorted(entries), np.int64)
        self._table(keys, np.array([entries[k][0] for k in keys.tolist()], np.int64), np.array([entries[k][1] for k in keys.tolist()], np.int64))

    def _table(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """An open hash table: slots hold a key, its rank and its piece; probes are linear."""
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks, self.merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64), np.zeros(1 << bits, np.int64)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]], self.merged[slot[put]] = keys[put], ranks[put], merged[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        out = np.full(len(left), _NONE, np.int64)
        at = np.flatnonzero((left < self.base) & (right < self.base))
        key = left[at] * self.base + right[at]
        slot = self._slot(key)
        while len(at):
            held = self.keys[slot]
            hit = held == key
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (held != -1)
            at, key, slot = at[go], key[go], (slot[go] + 1) & self.mask
        return out

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes; all pairs are in the table."""
        key = left * self.base + right
        slot = self._slot(key)
        miss = np.flatnonzero(self.keys[slot] != key)
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            miss = miss[self.keys[slot[miss]] != key[miss]]
        return self.merged[slot]

    def encode_words(self, units: list[str], single: bool = False) -> list[np.ndarray]:
        """Ids of each word."""
        flat, counts = self.encode_flat(units, single)
        return np.split(flat, np.cumsum(counts)[:-1]) if units else []

    def encode_flat(self, units: list[str], single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). single: one merge per word and round, exactly as a queue would do it."""
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = "".join(units)
        symbol = self.symbol_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        word = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        done_word, done_symbol, again = [], [], np.zeros(len(units), bool)
        rank = self._pairs_at(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(word)])
            over = least == _NONE
            if over.any():
                out = np.repeat(over, lengths)
                done_word.append(word[out])
                done_symbol.append(symbol[out])
                stay = ~out
                symbol, word, rank = symbol[stay], word[stay], rank[stay]
                lengths, least = lengths[~over], least[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # Overlapping occurrences stand at consecutive places: every other one of a run merges.
            run = np.cumsum(np.r_[True, at[1:] != at[:-1] + 1]) - 1
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            if single:
                at = at[np.r_[True, word[at][1:] != word[at][:-1]]]
            was = rank[at]
            symbol[at] = self._merged(symbol[at], symbol[at + 1])
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            # Only the pairs on both sides of a merged one changed.
            left = np.maximum(new - 1, 0)
            changed = np.zeros(len(symbol), bool)
            changed[new] = changed[left] = True
            changed = np.flatnonzero(changed)
            rank[changed] = self._pairs_at(symbol, word, changed)
            if not single:
                before = (new > 0) & (word[left] == word[new])
                again[word[new[(rank[new] < was) | (before & (rank[left] < was))]]] = True
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        symbol, word = np.concatenate(done_symbol)[order], word[order]
        if (symbol >= self.n).any():
            symbol, word = self._with_bytes(symbol, word)
        counts = np.bincount(word, minlength=len(units))
        redo = np.flatnonzero(again)
        if len(redo):
            other, n = self.encode_flat([units[k] for k in redo], single=True)
            starts = np.cumsum(counts) - counts
            starts[redo], counts[redo] = len(symbol) + np.cumsum(n) - n, n
            symbol = gather(np.r_[symbol, other], starts, counts)
        return symbol, counts

    def _with_bytes(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the pieces of their UTF-8 bytes."""
        unknown, which = np.unique(symbol[symbol >= self.n], return_inverse=True)
        raw = [(self.chars.get(s) or chr(s - self.base)).encode("utf-8", "surrogatepass") for s in unknown.tolist()]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        pool = np.r_[symbol, self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]]
        starts, counts = np.arange(len(symbol)), np.ones(len(symbol), np.int64)
        starts[symbol >= self.n], counts[symbol >= self.n] = (len(symbol) + np.cumsum(sizes) - sizes)[which], sizes[which]
        return gather(pool, starts, counts), np.repeat(word, counts)

    def _pairs_at(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), _NONE, np.int64)
        ok = np.flatnonzero(at + 1 < len(symbol))
        ok = ok[word[at[ok]] == word[at[ok] + 1]]
        out[ok] = self._rank(symbol[at[ok]], symbol[at[ok] + 1])
        return out

    def decode_flat(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The text, in UTF-8, of each ``ids[starts[k]:starts[k + 1]]``, as the library decodes a list of them."""
        lists = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), self.surfaces.take(pa.array(ids, pa.int32())))
        out = strings(pc.binary_join(lists, pa.scalar(b"", pa.large_binary())))
        sizes = np.diff(starts)
        some = np.flatnonzero(sizes > 0)
        for k in some[self.lead[ids[starts[some]]]].tolist():
            out[k] = out[k][1:]
        # Byte pieces may not be UTF-8, and what isn't text doesn't end the beginning.
        special = self.special[ids]
        for k in np.flatnonzero(sums(special, starts)).tolist():
            out[k] = self.decode(ids[starts[k] : starts[k + 1]].tolist()).encode("utf-8", "surrogatepass")
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, as the library decodes a list of them."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        lead = next((i for i in ids if surface[i] or not self.control[i]), None)
        if lead is not None and self.leading[lead]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_slowly(ids)

    def _decode_slowly(self, ids: list[int]) -> str:
        """Byte pieces that aren't UTF-8: each byte that fits no character gives U+FFFD."""
        out, run, bos = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run.extend(self.surface[i])
            else:
                flush()
                x = self.surface[i]
                out.append((x[1:] if bos and self.leading[i] else x).decode())
            bos = bos and self.control[i]
        flush()
        return "".join(out)


class Codec:
    """Encodes whole texts through a table of words."""

    def __init__(self, path: str) -> None:
        self.model = model_of(path)
        self.table = ValueTable(self.model.encode_flat, TABLE_WORDS)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end)."""
        block = word_block(texts).in_order()
        first, sizes = self.table.find(block.distinct)
        starts = np.r_[0, np.cumsum(sums(sizes[block.at], block.starts))]
        return gather(self.table.pool, first[block.at], sizes[block.at]), starts


@functools.lru_cache(maxsize=1)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


@functools.lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """A worker keeps its codec, with the memo of words, from task to task."""
    return Codec(path)


def _blocks(docs: DataFrame, names: list[str], fields: str, run, carry: list[str] | None, text_col: str) -> DataFrame:
    """The columns ``carry`` of ``docs`` and what ``run()`` makes of each block of texts."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in names]
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(fields).fields])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = run()
        for batch in source:
            at = 0
            for texts in text_blocks(batch.column(text_col), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in keep), *step(texts)], names=[*keep, *names])
                at += len(texts)
            give_back()

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(batches, schema)


#: Bytes of text encoded at a time, and rows of ids decoded at a time.
BLOCK_BYTES, DECODE_ROWS = 1_000_000, 256
#: Words that a worker's table holds before it forgets all but those of the last block.
TABLE_WORDS = 100_000


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) plus ``ids`` (array of int), without begin or end ids.

    Null and empty texts have an empty array; a text of any length is encoded whole, so a
    worker holds the longest one. Repeated rows each get a row, an empty table gives none;
    an input column ``ids`` is replaced.
    """

    def run():
        codec = codec_of(path)

        def step(texts: pa.Array) -> list[pa.Array]:
            ids, starts = codec.encode(texts)
            return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))]

        return step

    return _blocks(docs, ["ids"], "ids array<int>", run, carry, text_col)


def decode_pieces(docs: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` plus ``decoded``: the text of the ids.

    Null or empty ids give an empty text. Repeated rows each get a row, an empty table
    gives none; an input column ``decoded`` is replaced.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c != "decoded"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in (whole.slice(at, DECODE_ROWS) for whole in source for at in range(0, whole.num_rows, DECODE_ROWS)):
            lists = batch.column(ids_col)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            made = model.decode_flat(lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x.decode() for x in made], pa.string())], names=[*keep, "decoded"])

    return docs.select(*dict.fromkeys([*keep, ids_col])).mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` plus ``n_tokens, ids_sha256, decoded_sha256`` of a round trip.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the
    UTF-8 of what the ids decode to. Ids and texts stay in the Python worker. Null counts
    as empty; whole texts, repeated rows, empty tables and clashing columns are handled as
    by :func:`encode_pieces`.
    """

    def run():
        codec = codec_of(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def step(texts: pa.Array) -> list[pa.Array]:
            ids, starts = codec.encode(texts)
            decimals = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), codec.model.decimals.take(pa.array(ids)))
            joined = pc.binary_join(decimals, pa.scalar(b",", pa.large_binary()))
            return [pa.array(np.diff(starts)), pa.array(map(sha, strings(joined)), pa.string()), pa.array(map(sha, codec.model.decode_flat(ids, starts)), pa.string())]

        return step

    return _blocks(docs, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run, carry, text_col)
