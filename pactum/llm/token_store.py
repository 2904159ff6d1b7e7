"""Token ids in binary shards whose document boundaries are Elias-Fano encoded.

A shard holds the ids of consecutive documents, concatenated, and the boundary after each
document as an Elias-Fano sequence: of every boundary the low bits are packed, the high bits
are counted in unary in a bit vector. With n documents and u ids that is about
2 + log2(u/n) bits a document, with no table of 64-bit offsets. A select structure, the
position of every 64th one bit of the vector, finds a boundary by reading a few words.

Layout of a shard, little-endian::

    magic 'EFTK'  version u8  id_bytes u8 (2 or 4)  low_bits u8  0
    documents u64  ids u64  high_words u64  samples u64  doc_id_bytes u64  without_id u64
    doc ids of documents after the first ``without_id``: the first, then gaps, as zigzag LEB128
    low bits (padded to 8 bytes)  high words u64  samples u32  ids u16/u32

Shards are rows of a Parquet table in the shared folder, ordered by doc_id: Spark writes them
with its commit protocol, and any store that Spark reads can hold them.

Readers find the boundaries of a run of documents through the select structure: from the sample
before the first to the sample after the last, a few words of the vector at a time.

Defined results: null and empty texts are documents of one id (the end id); rows of equal
doc_id stand one after the other, in the order of a hash of their texts; an empty table gives no
shard and no rows. Rows without doc_id come first and are read back without one. A special
marker that stands in a text gets the id that the library gives it. Other columns play no part.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.common import release, written

MAGIC, VERSION, SAMPLE = b"EFTK", 2, 64
_HEAD = struct.Struct("<4sBBBxQQQQQQ")
#: Documents whose boundaries are looked up at a time.
RUN = 4096
#: Ids of a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1_000_000
#: Bytes of texts that are encoded at a time, about.
GROUP_BYTES = 4_000_000


class Boundaries:
    """An Elias-Fano sequence of non-decreasing integers below or equal to ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> Boundaries:
        n = len(values)
        low_bits = max(0, int(universe // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, dtype=np.uint8)
        vector[ones] = 1
        return cls(n, low_bits, low, np.packbits(vector, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return (chunk >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and the words after that."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = at // 64
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1, from the words between the samples around them."""
        if first >= last:
            return np.empty(0, np.int64)
        block, after = first // SAMPLE, -(-last // SAMPLE)
        start = int(self.samples[block]) // 64
        end = int(self.samples[after]) // 64 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:end].view(np.uint8), bitorder="little")) + 64 * start
        # ones of earlier samples' runs can share the first word
        ones = ones[ones >= int(self.samples[block])][first - block * SAMPLE : last - block * SAMPLE]
        place = np.arange(first, last)
        if not self.low_bits:
            return ones - place
        at = place * self.low_bits
        bits = np.unpackbits(self.low[at[0] // 8 : (at[-1] + self.low_bits + 7) // 8], bitorder="little")[at[0] % 8 :][: len(place) * self.low_bits]
        low = (bits.reshape(len(place), self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((ones - place) << self.low_bits) | low


def _leb128(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        v = v << 1 if v >= 0 else (-v << 1) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _unleb128(raw: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in raw:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v >> 1 if not v & 1 else -((v + 1) >> 1))
            v = shift = 0
    return out


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of consecutive documents; those without an id stand first."""
    id_bytes = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    ends = Boundaries.of(np.cumsum(lengths), len(ids))
    named = [d for d in doc_ids if d is not None]
    names = _leb128([b - a for a, b in zip([0, *named[:-1]], named, strict=True)] if named else [])
    pad = b"\0" * (-len(ends.low) % 8)
    head = _HEAD.pack(MAGIC, VERSION, id_bytes, ends.low_bits, ends.n, len(ids), len(ends.high), len(ends.samples), len(names), len(doc_ids) - len(named))
    return b"".join([head, names, ends.low.tobytes(), pad, ends.high.tobytes(), ends.samples.tobytes(), ids.astype(f"<u{id_bytes}").tobytes()])


class Shard:
    """A packed shard, read in place."""

    def __init__(self, raw: bytes):
        magic, version, id_bytes, low_bits, n, total, words, samples, names, self.without_id = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        self.names = raw[at : at + names]
        at += names
        low = np.frombuffer(raw, np.uint8, -(-n * low_bits // 8), at)
        at += -(-len(low) // 8) * 8
        high = np.frombuffer(raw, "<u8", words, at)
        at += 8 * words
        sampled = np.frombuffer(raw, "<u4", samples, at)
        at += 4 * samples
        self.ids = np.frombuffer(raw, f"<u{id_bytes}", total, at)
        self.ends = Boundaries(n, low_bits, low, high, sampled)

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self) -> list[int | None]:
        return [None] * self.without_id + list(accumulate(_unleb128(self.names)))

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class Memory:
    """Strings with the ids they encode to. When full, it keeps what was asked for more than once."""

    def __init__(self, most: int):
        self.most = most
        self.place: dict[bytes, int] = {}
        self.flat, self.ends, self.asked = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def shrink(self) -> None:
        if len(self.place) <= self.most:
            return
        kept = np.flatnonzero(self.asked > 1)
        kept = kept[-self.most // 2 :] if len(kept) > self.most // 2 else kept
        keep = np.zeros(len(self.asked), bool)
        keep[kept] = True
        lengths = np.diff(self.ends)
        names = list(compress(self.place, keep.tolist()))
        self.flat = self.flat[np.repeat(keep, lengths)]
        self.ends = np.concatenate([[0], np.cumsum(lengths[keep])])
        self.asked = np.zeros(len(names), np.int32)
        self.place = dict(zip(names, range(len(names)), strict=True))

    def find(self, names: list[bytes]) -> np.ndarray:
        """Places of strings, -1 for unknown ones."""
        return np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))

    def add(self, names: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.asked = np.concatenate([self.asked, np.zeros(len(names), np.int32)])

    def get(self, places: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings at distinct places, concatenated, and how many each has. times: how often each is asked for."""
        self.asked[places] += np.minimum(times, 2).astype(np.int32)
        return _gather(self.flat, self.ends, places)


def _gather(flat: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat, concatenated, and their lengths; run i goes from ends[i] to ends[i + 1]."""
    lengths = ends[index + 1] - ends[index]
    total = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.arange(total[-1]) + np.repeat(ends[index] - total[:-1], lengths)], lengths


def _table(of: dict[str, int], rest: int) -> bytes:
    return bytes(next((v for k, v in of.items() if chr(b) in k), rest) for b in range(256))


_SPACE, _LETTER, _DIGIT, _SIGN, _HARD = range(5)
#: Kinds of bytes. Leads C3 to C5 begin letters up to U+017F, but for those of _NOT_LETTERS. An apostrophe can begin a
#: piece together with letters.
_KIND = _table({" \n": _SPACE, string.ascii_letters + "".join(map(chr, [*range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])): _LETTER, string.digits: _DIGIT, string.punctuation.replace("'", ""): _SIGN}, _HARD)
#: The signs of multiplication and division; the dotted capital I, whose lower case is two characters.
_NOT_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
_LOWER = bytes(range(256)).lower()


def _units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Units of texts, all in one array, and how many each text has.

    A unit is a run of letters, a digit or a run of signs, with ASCII in lower case, or a word as it stands where it
    holds anything else. They are cut and told apart as bytes, in numpy and Arrow: Python meets distinct ones only.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]].tobytes()
    bounds = bounds - bounds[0]
    raw, kind = np.frombuffer(whole, np.uint8), np.frombuffer(bytearray(whole.translate(_KIND)), np.uint8)
    for lead, after in _NOT_LETTERS:
        at = np.flatnonzero(raw[:-1] == lead)
        kind[at[raw[at + 1] == after]] = _HARD
    begins = bounds[:-1][np.diff(bounds) > 0]
    start = kind == _DIGIT
    start[1:] |= kind[1:] != kind[:-1]
    start[begins] = True
    low = np.frombuffer(whole.translate(_LOWER), np.uint8)
    hard = np.flatnonzero(kind == _HARD)
    filled = kind != _SPACE
    if len(hard):
        word = filled.copy()
        word[1:] &= ~filled[:-1]
        word[begins] = filled[begins]
        words = np.append(np.flatnonzero(word), len(raw))
        at = np.unique(np.searchsorted(words, hard, side="right"))
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[words[at - 1]] += 1
        inside[words[at]] -= 1
        inside = np.cumsum(inside, dtype=np.int8)[:-1].view(bool)
        start = np.where(inside, word, start)
        low = np.where(inside, raw, low)
    start &= filled
    ends = np.append(np.flatnonzero(start[filled]), np.count_nonzero(filled))
    units = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(low[filled])])
    return units.dictionary_encode(), np.diff(np.searchsorted(np.flatnonzero(start), bounds))


class WordEncoder:
    """The tokenizers library with a memory of what words and their parts encode to.

    For a tokenizer that drops white space and cuts at it before its model runs, the ids of a
    text are those of its words, one after the other; those of a word are those of its pieces
    by the tokenizer's own pattern, most of which are units. Each distinct unit meets the
    library once while it is remembered. Words with characters whose normal form can depend on
    their neighbours are pieces of their own; other tokenizers get whole texts.
    """

    def __init__(self, path: str, remember: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cuts = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        split = cuts[0]
        normal = [n["type"] for n in (kind.get("normalizer") or {}).get("normalizers", [])]
        pattern = split.get("pattern", {}).get("Regex", "") if split.get("type") == "Split" else ""
        # what units stand for: runs of letters, single digits, runs of signs; what else there is begins with an apostrophe
        kinds = {x for x in pattern.split("|") if x[:1] != "'"} == {r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
        self.by_word = kinds and split.get("invert") and split.get("behavior") == "Removed" and normal == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(pattern)
        # added tokens are found before words are cut, some in the normalised text
        self.added = [t["content"].lower() for t in kind.get("added_tokens") or []]
        self.lead = os.path.commonprefix(self.added)
        # fixed and special, and not normalised: it is found in any text as it stands
        special = [t for t in kind.get("added_tokens") or [] if t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]]
        self.mark, self.mark_id = (special[-1]["content"], special[-1]["id"]) if special else (None, -1)
        # for pieces of letters that are in normal form: the same model, cut at spaces only
        self.plain, self.widths = None, np.empty(0, np.int64)
        if self.by_word and cuts[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]:
            at_space = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            self.plain = Tokenizer.from_str(json.dumps({**kind, "normalizer": None, "pre_tokenizer": {**kind["pre_tokenizer"], "pretokenizers": [at_space, *cuts[1:]]}}))
            vocabulary = self.plain.get_vocab()
            ending = kind["model"].get("end_of_word_suffix") or ""
            self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token stands for a byte
            self.widths[list(vocabulary.values())] = [len(t.removesuffix(ending)) for t in vocabulary]
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.words = Memory(self.remember)

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> WordEncoder:
        return cls(path)

    def _by_model(self, part: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces of letters and how many each has, from the bytes that tokens stand for; None if these don't add up."""
        joined = " ".join(part)
        got = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
        raw = np.frombuffer(f"{joined} ".encode(), np.uint8)
        ends = np.flatnonzero(raw == ord(" ")) - np.arange(len(part))
        reached = np.cumsum(self.widths[got])
        last = np.searchsorted(reached, ends)
        if not len(reached) or last[-1] != len(reached) - 1 or (reached[last] != ends).any():
            return None
        return got, np.diff(last, prepend=-1)

    def _by_mark(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has, from one text with the tokenizer's special token between them, whose id no piece can have."""
        got = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, dtype=np.int32)
        cut = np.concatenate([[-1], np.flatnonzero(got == self.mark_id), [len(got)]])
        if len(cut) != len(part) + 1:
            raise ValueError("the tokenizer's special token doesn't part words")
        return got[got != self.mark_id], np.diff(cut) - 1

    def _by_library(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces in another order, their ids, concatenated, and how many each has. Many go to the library as one text."""
        letters = [p for p in pieces if p.isalpha() and (p.isascii() or max(p) < "\u0250")] if self.plain else []
        others = list(set(pieces).difference(letters))
        found = [(np.empty(0, np.int32), np.empty(0, np.int64))]
        for some, encode in ((letters, lambda part: self._by_model(part) or self._by_mark(part)), (others, self._by_mark)):
            found += [encode(some[i : i + 1000]) for i in range(0, len(some), 1000)]
        return [*letters, *others], *map(np.concatenate, zip(*found, strict=True))

    def _has_added(self, text: str) -> bool:
        return any(a in text.lower() for a in self.added)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; no text is null."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        if not self.by_word or self.mark is None:
            whole = np.ones(len(texts), bool)
        else:
            whole = pc.match_substring(texts, self.lead).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(whole)
            whole[at] = [self._has_added(texts[i].as_py()) for i in at.tolist()]
        by_library = iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
        by_words = iter(self._by_words(texts.filter(pa.array(~whole))))
        return [np.array(next(by_library).ids, dtype=np.int32) if w else next(by_words) for w in whole.tolist()]

    def _learn(self, new: list[bytes]) -> None:
        """Remember units."""
        cut = self.pattern.findall
        # a unit of letters is one piece; one of other characters is cut if its lower case can't depend on neighbours
        pieces = [([w.lower()] if w.isalpha() else cut(w.lower())) if w.isascii() or max(w) < "\u0250" else [w] for w in map(bytes.decode, new)]
        names, ids, lengths = self._by_library(list(set().union(*pieces)))
        place = dict(zip(names, range(len(names)), strict=True))
        index = np.fromiter(map(place.__getitem__, chain.from_iterable(pieces)), np.int64)
        ids, lengths = _gather(ids, np.concatenate([[0], np.cumsum(lengths)]), index)
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.words.add(new, ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]))

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        units, counts = _units(texts)
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.words.shrink()
        places = self.words.find(distinct)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = np.arange(len(self.words.place), len(self.words.place) + len(new))
            self._learn([distinct[i] for i in new.tolist()])
        ids, lengths = self.words.get(places, np.bincount(units.indices.to_numpy(), minlength=len(distinct)))
        # ids of a unit as bytes, so that Arrow copies them to where the unit stands
        ends = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
        each = pa.Array.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        found = each.take(units.indices)
        if not len(found):
            return [ids] * len(texts)
        total = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] // ids.itemsize
        flat = np.frombuffer(found.buffers()[2], ids.dtype)[: total[-1]] if total[-1] else ids[:0]
        return np.split(flat, total[np.cumsum(counts)[:-1]])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts and write shards in ascending doc_id order; the table of shards, read back.

    Columns: part, seq (order of shards), n_docs, n_ids, shard (binary).
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names, parts, size, seq = WordEncoder.load(tokenizer), [], [], 0, 0
        part = -1

        def shard() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            row = {"part": part, "seq": seq, "n_docs": len(names), "n_ids": int(lengths.sum()), "shard": pack(names, lengths, np.concatenate(parts))}
            return pa.RecordBatch.from_pylist([row], schema)

        for x in batches:
            sizes = np.cumsum(pc.binary_length(x.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                end = at + 1 + int(np.searchsorted(sizes[at:] - (sizes[at - 1] if at else 0), GROUP_BYTES))
                group = x.slice(at, end - at)
                at = end
                if part < 0:
                    part = group.column("part")[0].as_py()
                for name, without, ids in zip(group.column("doc_id").to_pylist(), group.column("without_id").to_pylist(), encoder.encode(group.column("text")), strict=True):
                    if parts and size + len(ids) + 1 > shard_ids:
                        yield shard()
                        names, parts, size, seq = [], [], 0, seq + 1
                    names.append(None if without else name)
                    parts.append(np.append(ids, np.int32(end_id)))
                    size += len(ids) + 1
        if parts:
            yield shard()
        del names, parts
        release()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("without_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("order"))
    order = [F.desc("without_id"), F.asc("doc_id"), F.asc("order")]  # rows of one id can stand in several tasks
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("order").withColumn("part", F.spark_partition_id())
    return written(rows.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, shard binary"), "token-shards")


def read_documents(shards: DataFrame, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the shards alone.

    start counts the ids of all documents before; it is the running sum of shard sizes, a table
    of one small row for each part, plus the place inside the part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for row in x.itertuples(index=False):
                shard = Shard(row.shard)
                names = shard.doc_ids()
                for first in range(0, len(shard), RUN):
                    last = min(first + RUN, len(shard))
                    ends = shard.ends.select_range(first, last)
                    starts = np.concatenate([[shard.ends.select(first - 1) if first else 0], ends[:-1]])
                    block = shard.ids[starts[0] : ends[-1]].astype("<u4")
                    ids = [block[a:b] for a, b in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)]
                    out = pd.DataFrame({"doc_id": pd.array(names[first:last], dtype="Int64"), "part": row.part, "seq": row.seq, "start": starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(x) for x in ids]})
                    if not digest_only:
                        out["ids"] = [x.astype(np.int32) for x in ids]
                    yield out

    extra = "" if digest_only else ", ids array<int>"
    inside = shards.select("part", "seq", "shard").mapInPandas(run, f"doc_id long, part int, seq int, start long, n_tokens long, ids_crc32 long{extra}")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "seq", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("in_part"))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = written(sizes.join(parts, "part").select("part", "seq", (F.col("in_part") + F.col("before")).alias("base")), "token-bases")
    out = inside.join(base, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *(() if digest_only else ("ids",)))
