"""Byte-pair encoding with word ends: numpy merge rounds over many words at once, and decoding.

A tokenizer file (JSON of the tokenizers library, kind BPE with an end-of-word suffix) is read once per worker. Texts
are cut at white space, which no token crosses; each different piece is encoded once and kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import secrets
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quaylight.llm.common import LOWER_ASCII, SPACE, WORKER_TABLES, chunks, flat, release_memory, runs_of, span_hashes

#: Pieces held by a worker; then it starts anew.
CACHE_PIECES = 700_000
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the others in order from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Vocabulary, merge ranks and splitting rules of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in chain(self.vocab.items(), self.added.items())}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int32)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int32), made

    def normal(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        piece = unicodedata.normalize("NFC", piece)
        return "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()

    def words_of(self, piece: str) -> list[str | int]:
        """The words of a piece, and added tokens as their ids."""
        if piece.isalpha():  # all letters: one word, if lowering it makes no mark
            word = self.normal(piece)
            if word.isalpha():
                return [word]
        elif piece[-1] in ".,!?" and piece[0] != "<" and piece[:-1].isalpha():
            word = self.normal(piece[:-1])
            if word.isalpha():
                return [word, piece[-1]]
        out: list[str | int] = []
        for part in self.special.split(piece) if self.special and "<|" in piece else (piece,):
            if part in self.added:
                out.append(self.added[part])
            else:
                out += self.split.findall(self.normal(part))
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers. In a round every word merges all places of its lowest-rank pair, from the left."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE, np.int32)
            key = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(symbols)))
            best = np.repeat(least, span)
            open_ = best != _NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, best = symbols[open_], word[open_], rank[open_], best[open_]
                if not len(symbols):
                    break
            hit = rank == best
            place = np.flatnonzero(hit)
            fresh = np.concatenate(([True], np.diff(place) != 1))
            start = place[fresh][np.cumsum(fresh) - 1]
            place = place[(place - start) % 2 == 0]  # in a run of equal letters every other pair
            symbols[place] = self.made_by_rank[rank[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        every = np.concatenate(done_symbols) if done_symbols else symbols
        of = np.concatenate(done_words) if done_words else word
        order = np.argsort(of, kind="stable")
        return sliced(every[order], np.cumsum(np.bincount(of, minlength=len(words))))

    def encode_pieces(self, new: list[str]) -> list[bytes]:
        """Ids of each piece; every different word inside is merged once."""
        parts = [self.words_of(p) for p in new]
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        plain = [w for w in words if isinstance(w, str)]
        ids: dict[str | int, bytes] = dict(zip(plain, self.merge([w.encode() for w in plain])))
        ids.update((w, w.to_bytes(4, "little")) for w in words if isinstance(w, int))
        get = ids.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def sliced(ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The bytes of consecutive parts that end at the stops."""
    raw, to = ids.astype("<u4").tobytes(), (4 * np.asarray(stops)).tolist()
    return [raw[a:b] for a, b in zip([0, *to], to)]


@lru_cache(4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


@lru_cache(4)
def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """The tokenizers library over different pieces, many to a call; a token that ends a word tells the pieces apart."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def encode(new: list[str]) -> list[bytes]:
        lines = [" ".join(new[i : i + 64]) for i in range(0, len(new), 64)]
        out: list[bytes] = []
        for i, e in enumerate(t.encode_batch(lines, add_special_tokens=False)):
            some, line = new[64 * i : 64 * i + 64], lines[i]
            ids = np.array(e.ids, np.int32)
            begins = np.array([a for a, _ in e.offsets], np.int64)
            stops = np.cumsum([len(p) + 1 for p in some])  # where each piece and the space after it end
            if len(line) != stops[-1] - 1:
                raise ValueError("a piece changed its length")
            out += sliced(ids, np.append(np.searchsorted(begins, stops[:-1]), len(ids)))
        return out

    return encode


#: A cut before one of these is safe after an ASCII letter: no word holds both, but for endings with an apostrophe.
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?*$%&#")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class PieceTable:
    """Ids of the pieces seen last, in an open-addressing table of bounded size.

    A hit has both of the entry's 64-bit hashes. They are seeded at random in each worker, so no text can be made to
    collide, and two of the pieces held at once do so with odds of 2^-87.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = CACHE_PIECES):
        self.encode, self.most = encode, most
        self.seed = secrets.randbits(64)
        self.clear()

    def clear(self, least: int = 0) -> None:
        """An empty table; with room for `least` pieces where one text has more than the table's bound."""
        self.slots = 1 << int(np.ceil(np.log2(1.4 * max(self.most, least))))
        self.keys = np.zeros(self.slots, np.uint64)
        self.values = np.zeros(self.slots, np.int32)
        self.held = np.zeros(self.slots, np.uint64)  # second hash
        self.start = np.zeros(1, np.int64)  # of each entry, and the end
        self.flat = np.zeros(0, np.int32)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where unknown."""
        out = np.full(len(h), -1, np.int32)
        slot, left = (h & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            there = self.keys[slot]
            same = (there == h[left]) & (self.held[slot] == g[left])
            out[left[same]] = self.values[slot[same]]
            on = ~same & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def add(self, h: np.ndarray, g: np.ndarray, ids: list[bytes]) -> None:
        """h: different hashes of unknown pieces."""
        number = np.arange(len(self.start) - 1, len(self.start) - 1 + len(h), dtype=np.int32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
        slot, left = (h & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)  # one piece a place
            won = free[first]
            self.keys[slot[won]], self.held[slot[won]], self.values[slot[won]] = h[left[won]], g[left[won]], number[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, slot = left[on], slot[on]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & (self.slots - 1), slot)

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of UTF-8 text, one after another, and where each row's begin and end."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        if np.any((raw[:-1] == 60) & (raw[1:] == 124)):  # an added token may be here: only white space cuts, letters stay
            low = raw
        else:
            low = LOWER_ASCII[raw]
            cut[1:-1] |= _LETTER[raw[:-1]] & _BREAK[raw[1:]]
        starts, ends, first = runs_of(~SPACE[raw], np.flatnonzero(cut))
        rows = np.searchsorted(starts, offsets)
        h, g = span_hashes(low, starts, ends, self.seed)
        h |= np.uint64(1) << np.uint64(63)
        whole = low.tobytes()
        entry = self.find(h, g)
        lost = np.flatnonzero(entry < 0)
        while len(lost):  # once more only for different pieces with one first hash
            new, at = np.unique(h[lost], return_index=True)
            if len(self.start) - 1 + len(new) > self.most and (len(self.start) > 1 or self.slots < 1.4 * len(new)):
                self.clear(len(new))
                lost = np.arange(len(h))
                continue
            at = lost[at]
            text = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            for i in range(0, len(text), 10_000):
                self.add(new[i : i + 10_000], g[at[i : i + 10_000]], self.encode(text[i : i + 10_000]))
            entry[lost] = self.find(h[lost], g[lost])
            lost = lost[entry[lost] < 0]
        size = self.start[entry + 1] - self.start[entry]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[entry] - (stop - size), size)]
        return ids, np.concatenate(([0], stop))[rows]


_TABLES: dict[tuple[str, bool], PieceTable] = {}


WORKER_TABLES += [_TABLES.clear, library_encoder.cache_clear, word_bpe.cache_clear]


def table_of(path: str, library: bool) -> PieceTable:
    """This worker's table for a tokenizer file, filled by the tokenizers library or by the merge rounds here."""
    if (path, library) not in _TABLES:
        _TABLES[path, library] = PieceTable(library_encoder(path) if library else word_bpe(path).encode_pieces)
        release_memory()  # of reading the file
    return _TABLES[path, library]


def row_ids(column: pa.Array, path: str, library: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows: the first row's number, ids of all rows one after another, and each row's limits there. Null is empty."""
    raw, offsets = flat(column)
    table = table_of(path, library)
    for a, b in chunks(offsets):
        yield a, *table.ids(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        release_memory()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ids (array<int>) of every whole text and what they decode to. A null or empty text has no ids and decodes to ""."""
    from pyspark.sql import types as T

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for a, every, at in row_ids(batch.column("text"), path, False):
                ids = [every[i:j] for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """encode_decode with each row reduced to digests in the worker, so that ids and texts needn't cross to the JVM.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256. One row for each row; a null
    or empty text has 0 tokens and the digests of nothing. A null doc_id stays null; other columns are dropped.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        size = max(bpe.names) + 1
        names = [bpe.names.get(i, "") for i in range(size)]
        decimals = [str(i) for i in range(size)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for a, every, at in row_ids(batch.column("text"), path, False):
                n, said, back = [], [], []
                every, at = every.tolist(), at.tolist()
                for i, j in zip(at, at[1:]):
                    ids = every[i:j]
                    n.append(len(ids))
                    said.append(sha(" ".join([decimals[i] for i in ids])))
                    back.append(sha(" ".join([names[i] for i in ids])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(n)), pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    from pyspark.sql import types as T

    kind = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)
