"""Token-ID output: one concatenated id array per shard, its document boundaries in Elias-Fano code.

A store is a Parquet table of shards in ascending document order: (part, seq, n_docs, n_tokens, payload). A payload is one binary file of this layout, all
integers little-endian:

    0   4 bytes   "KTS1"
    4   u8        bytes of an id: 2 if every id of the shard is under 65,536, else 4
    5   3 bytes   0
    8   u64       documents n          16  u64  ids m
    24  u64       documents with a null id (they come first)
    32  i64       smallest document id that is not null
    40  ids       m unsigned integers
        bounds    Elias-Fano code of the n ends of documents within the shard
        doc ids   Elias-Fano code of (id - smallest), non-decreasing

An Elias-Fano code of n non-decreasing values below u keeps the ``l = floor(log2(u / n))`` low bits of each value packed, and the high parts as a
unary bitmap with one 1 per value: 2 + l bits a value at most. Beside it stands the position of every 256th 1 (``SELECT_STEP``), so
``select(i)`` reads one sample and counts on in a few words; no table of 64-bit offsets exists in the file or is needed to find one document.
Layout: u64 n, u64 u, u32 l, u32 samples, low words (u64), high words (u64), samples (u32 or u64 by bitmap length).

Writing: documents are dealt by ranges of their id, sorted within the range and encoded in place; a task that is lost is done again and Spark's committer
publishes only whole files. Reading decodes each shard on its own. Shards end after ``shard_tokens`` ids (a longer document makes a longer
shard of its own), so no task holds more than one shard beside its input.

Defined cases: a null text is an empty text: it has only the end id. Rows with equal ids stay, in order of their text. Null ids come first. Ids are integers of any
width; other types are cast to long, and one that does not parse is an error, as the order of the store is that of the numbers. An empty table gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import shared

MAGIC = b"KTS1"
SELECT_STEP = 256
STORE_SCHEMA = "part int, seq int, n_docs long, n_tokens long, payload binary"
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# ---------------------------------------------------------------- Elias-Fano


def ef_encode(values: np.ndarray) -> bytes:
    """Code of non-decreasing unsigned values."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    u = int(v[-1]) + 1 if n else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(high[-1]) // 64 + 1) * 8 if n else 0, np.uint8)
    np.bitwise_or.at(bits, high >> 3, (1 << (high & 7)).astype(np.uint8))
    words = np.zeros((n * low + 63) // 64 + 1, np.uint64)
    if low:
        part = v & np.uint64((1 << low) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), part << (at & np.uint64(63)))
        over = (at & np.uint64(63)) + np.uint64(low) > 64
        np.bitwise_or.at(words, (at[over] >> np.uint64(6)).astype(np.int64) + 1, part[over] >> (np.uint64(64) - (at[over] & np.uint64(63))))
    samples = high[::SELECT_STEP].astype(np.uint32 if len(bits) < 1 << 28 else np.uint64)
    return struct.pack("<QQIIQQ", n, u, low, len(samples), len(words), len(bits) // 8) + words.tobytes() + bits.tobytes() + samples.tobytes()


class EliasFano:
    """A view of a code: ``select(i)`` finds one value, ``all()`` every one."""

    def __init__(self, buf: memoryview | bytes, at: int = 0):
        self.n, self.u, self.low, n_samples, n_words, n_bits = struct.unpack_from("<QQIIQQ", buf, at)
        at += 40
        self.words = np.frombuffer(buf, "<u8", n_words, at)
        at += 8 * n_words
        self.bits = np.frombuffer(buf, np.uint8, 8 * n_bits, at)
        at += 8 * n_bits
        kind = np.dtype("<u4" if 8 * n_bits < 1 << 28 else "<u8")
        self.samples = np.frombuffer(buf, kind, n_samples, at)
        self.end = at + kind.itemsize * n_samples

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.words[w] >> s
        over = s + np.uint64(self.low) > 64
        out[over] |= self.words[w[over] + 1] << (np.uint64(64) - s[over])
        return out & np.uint64((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Value i: from the sample at or before it, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SELECT_STEP])
        left = i % SELECT_STEP  # ones after the one at ``start``
        byte, seen = start >> 3, int(self.bits[start >> 3]) >> (start & 7) << (start & 7)
        while (c := int(_POP[seen])) <= left:
            left -= c
            byte += 1
            seen = int(self.bits[byte])
        for _ in range(left):
            seen &= seen - 1
        at = byte * 8 + (seen & -seen).bit_length() - 1
        return (at - i) << self.low | int(self._lows(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (ones - i).astype(np.uint64) << np.uint64(self.low) | self._lows(i)


# ---------------------------------------------------------------- shard files


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The file of these documents, which come in ascending order of their ids, nulls first."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    wide = len(flat) > 0 and int(flat.max()) > 0xFFFF
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) for x in ids]).astype(np.uint64)
    rel = (known.astype(object) - base).astype(np.uint64) if len(known) and int(known[-1]) - base > 2**62 else (known - base).astype(np.uint64)
    head = MAGIC + struct.pack("<BxxxQQQq", 4 if wide else 2, len(doc_ids), len(flat), len(doc_ids) - len(known), base)
    return head + flat.astype("<u4" if wide else "<u2").tobytes() + ef_encode(ends) + ef_encode(rel)


class Shard:
    """Random access to a packed file."""

    def __init__(self, buf: bytes):
        if bytes(buf[:4]) != MAGIC:
            raise ValueError("not a token shard")
        width, self.n_docs, n_ids, self.nulls, self.base = struct.unpack_from("<BxxxQQQq", buf, 4)
        self.ids = np.frombuffer(buf, f"<u{width}", n_ids, 40)
        self.ends = EliasFano(buf, 40 + width * n_ids)
        self.docs = EliasFano(buf, self.ends.end)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.ids[lo:hi].astype(np.uint32)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.base + int(x) for x in self.docs.all()]


# ---------------------------------------------------------------- encoding

# The split pattern of the vocabulary's own file, written for the characters below U+0250 that the short way takes.
_LETTER = "a-zªµºß-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Characters of the short way: below U+0250 with a small form of one character there; not those that white space of the two sides treats apart.
_USUAL = "".join(chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250)
#: Texts with any other, or with what may be an added token, go through the library whole.
_UNUSUAL = re.compile(f"[^{re.escape(_USUAL)}]|<\\|")


def _usual(text: str) -> bool:
    """Whether the text may go the short way; any other must go through the library whole."""
    try:
        text.isascii() or text.encode("latin-1")  # all of Latin-1 is usual; a few scans for one character each are quicker than the pattern
        return not ("<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"))
    except UnicodeEncodeError:
        return _UNUSUAL.search(text) is None


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first`` and are ``size`` long, end to end."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - size), size)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without null end to end, and their offsets in it."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = words.buffers()
    off = np.frombuffer(off, np.int64)[words.offset : words.offset + len(words) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


#: Words that a worker remembers at most between groups; beyond it half of them are forgotten (results do not change).
MEMO = 600_000
#: Bytes of those words and of their ids, with the same effect.
MEMO_BYTES = 48 << 20
#: Bytes of a word that is remembered at most; a longer one is encoded in each group that holds it.
LONG = 64
#: Characters of text encoded together.
GROUP = 1 << 20
#: Rows that Spark sends a worker at once; both sides hold such a batch or two beside the group.
ROWS = 1_000
#: Pieces given to the library's model in one call, which takes several hundred bytes each.
PIECES = 5_000


class Encoder:
    """The ids that one tokenizer file's ``encode`` gives, with those of words remembered.

    The file splits a lower-cased text into pieces and encodes each alone, so equal pieces have equal ids: a piece is given to the library's model
    when first met. A text with an unusual character is given to the library whole. Remembered words are no Python objects, which would take several times
    the memory: their bytes lie in one array, their ids in another, and a word is found by a sorted array of hashes and then held against its bytes.
    """

    _held: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        #: The model's character of each byte; a space stays, as it parts the pieces.
        self.alphabet = np.arange(256, dtype="<u4")
        self.alphabet[[b for b in range(256) if b not in printable]] = 256 + np.arange(256 - len(printable))
        chars = [chr(c) for c in self.alphabet]
        self.alphabet[32] = 32

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, mark = spec["model"].get("vocab"), spec["model"].get("end_of_word_suffix")
        vocab = vocab if isinstance(vocab, dict) else {}  # a list in other kinds of file
        #: Ids that end a piece: the model marks them, whatever the piece.
        self.last = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.last[[i for x, i in vocab.items() if mark and x.endswith(mark)]] = True
        # the short way is for this kind of file only; any other goes through the library whole
        self.short = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec.get("pre_tokenizer")).replace("\\\\", "\\") and bool(mark) and all(c in vocab and c + mark in vocab for c in chars)
        self._clear()

    def _clear(self) -> None:
        #: Hashes of remembered words, ascending, and the numbers of these words.
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: Bytes and ids of all words by number, and where each ends.
        self.data, self.off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.pool, self.cut = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.memo = np.zeros(0, np.int32)  # groups that held the word, halved whenever words are forgotten

    def _forget(self) -> None:
        """Forget the half of the words that the fewest groups held, and long ones."""
        keep = np.sort(np.argpartition(-self.memo, len(self.memo) // 2)[: len(self.memo) // 2])
        size = np.diff(self.off)
        keep = keep[size[keep] <= LONG]
        size, n_ids, met = size[keep], np.diff(self.cut)[keep], self.memo[keep] // 2
        data, ids = self.data[_spans(self.off[keep], size)], self.pool[_spans(self.cut[keep], n_ids)]
        self._clear()
        self._add(data, np.concatenate([[0], size.cumsum()]), ids, n_ids.cumsum())
        self.memo = met

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of words that may be remembered, and their hashes."""
        size = np.diff(off)
        at = np.flatnonzero((size > 0) & (size <= LONG))
        return at, shared.word_hashes(data, off[at], size[at])

    def _find(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for one that is not remembered, so for one whose hash another word has."""
        found = np.full(len(off) - 1, -1, np.int64)
        at, hashes = self._hashes(data, off)
        place = np.searchsorted(self.keys, hashes)
        hit = place < len(self.keys)
        hit[hit] = self.keys[place[hit]] == hashes[hit]
        at, number = at[hit], self.number[place[hit]]
        size = off[at + 1] - off[at]
        equal = size == self.off[number + 1] - self.off[number]
        at, number, size = at[equal], number[equal], size[equal]
        if len(at):
            same = np.logical_and.reduceat(data[_spans(off[at], size)] == self.data[_spans(self.off[number], size)], size.cumsum() - size)
            found[at[same]] = number[same]
        return found

    def _add(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, stop: np.ndarray) -> None:
        """Remember words, whose ids end at ``stop``."""
        n = len(self.memo)
        at, hashes = self._hashes(data, off)
        order = np.argsort(hashes)
        place = np.searchsorted(self.keys, hashes[order])
        self.keys, self.number = np.insert(self.keys, place, hashes[order]), np.insert(self.number, place, at[order] + n)
        self.off = np.concatenate([self.off, off[1:] + len(self.data)])
        self.data = np.concatenate([self.data, data])
        self.cut = np.concatenate([self.cut, stop + len(self.pool)])
        self.pool = np.concatenate([self.pool, ids])
        self.memo = np.concatenate([self.memo, np.zeros(len(stop), np.int32)])

    def _learn(self, missing: list[str]) -> None:
        """Remember words not met before, with the ids of their pieces; a piece that was met as a word is known. ``new`` has their numbers."""
        letters = list(map(str.isalpha, missing))
        alone = list(compress(missing, letters))
        parts = {w: _PIECE.findall(w) for w, x in zip(missing, letters, strict=True) if not x}
        pieces = list({x for p in parts.values() for x in p}.difference(alone))
        number = dict(zip(pieces, self._find(*_bytes(pa.array(pieces, pa.large_string()))).tolist(), strict=True))
        new = alone + [x for x in pieces if number[x] < 0]
        number.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        got, ends, total = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for lo in range(0, len(new), PIECES):
            # one call for many: the file's own model, each piece a word in the model's byte alphabet
            text = self.alphabet[np.frombuffer(" ".join(new[lo : lo + PIECES]).encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            got.append(ids)
            ends.append(np.flatnonzero(self.last[ids]) + 1 + total)
            total += len(ids)
        self._add(*_bytes(pa.array(new, pa.large_string())), np.concatenate(got), np.concatenate(ends))
        joined = {w: p for w, p in parts.items() if len(p) != 1}
        if joined:
            at = np.array([number[x] for p in joined.values() for x in p], np.int64)
            size = self.cut[at + 1] - self.cut[at]
            number.update(zip(joined, range(len(self.memo), len(self.memo) + len(joined)), strict=True))
            self._add(*_bytes(pa.array(list(joined), pa.large_string())), self.pool[_spans(self.cut[at], size)], np.concatenate([[0], size.cumsum()])[np.cumsum([len(p) for p in joined.values()])])
        self.new = np.fromiter(map(number.__getitem__, missing), np.int64, len(missing))

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. No piece spans white space, so a text's ids are those of its words end to end."""
        short = [self.short and _usual(t) for t in texts]
        if len(self.memo) > MEMO or self.data.nbytes + self.pool.nbytes > MEMO_BYTES:
            self._forget()
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t, s in zip(texts, short, strict=True) if s], pa.large_string()))
        words = split.flatten().dictionary_encode()
        data, off = _bytes(words.dictionary)
        at = self._find(data, off)
        full = np.diff(off) > 0  # white space at a text's ends gives empty words, which have no ids
        if len(new := np.flatnonzero((at < 0) & full)):
            self._learn(words.dictionary.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())  # in C; ``to_pylist`` makes an object more a word
            at[new] = self.new
        self.memo[at[full]] += 1
        first, size = self.cut[at], np.where(full, self.cut[at + 1] - self.cut[at], 0)
        at = words.indices.to_numpy()
        size = size[at]
        ids = self.pool[_spans(first[at], size)]
        stop = np.concatenate([[0], size.cumsum()])[split.offsets.to_numpy()].tolist()
        found = iter([ids[a:b] for a, b in zip(stop[:-1], stop[1:], strict=True)])
        return [next(found) if s else self.whole(t) for t, s in zip(texts, short, strict=True)]

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


shared.keeps("tokens", Encoder._held.clear)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode ``docs`` (id, text) into a store at ``path``, in ascending id order, and return the shards as written."""

    def encode(batches: Iterable[pa.RecordBatch]):
        shared.claim("tokens")
        enc, end = Encoder.of(tokenizer), np.array([end_id], np.uint32)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = seq = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([pack(names, ids)], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "payload"])

        def encoded(batch):
            size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + GROUP, "right")))
                got = enc.many([x or "" for x in batch.column(1)[lo:hi].to_pylist()])
                shared.trim()  # else a worker keeps what its largest group took
                yield from zip(batch.column(0)[lo:hi], got, strict=True)
                lo = hi

        part = 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for name, got in encoded(batch):
                got = np.concatenate([got, end])
                if names and held + len(got) > shard_tokens:
                    yield flush()
                    ids, names, held, seq = [], [], 0, seq + 1
                ids.append(got)
                names.append(name.as_py())
                held += len(got)
        if names:
            yield flush()

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with shared.arrow_rows(docs.sparkSession, ROWS):
        dealt.withColumn("part", F.spark_partition_id()).mapInArrow(encode, STORE_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(STORE_SCHEMA).parquet(path)


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document of the store: id, start (ids of all documents before it), n_tokens, ids_crc32 [, ids].

    Shard starts are a running sum in two levels: within a part by a window, over parts by one number a part.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    # One row a part of the writing job comes to the driver: as many as that job had partitions, whatever the rows.
    parts = sorted((r[0], r[1]) for r in store.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = [], 0
    for part, n in parts:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, part_start long")
    within = store.select("part", "seq", "n_tokens").withColumn("rel", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    starts = within.join(offsets, "part").select("part", "seq", (F.col("rel") + F.col("part_start")).alias("shard_start"))

    def decode(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at, payload in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard(payload.as_py())
                ends = shard.ends.all().astype(np.int64)
                first = np.concatenate([[0], ends[:-1]])
                wide = shard.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(shard.doc_ids(), pa.int64()), pa.array(first + at.as_py()), pa.array(ends - first), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(wide.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return store.join(starts, ["part", "seq"]).select("shard_start", "payload").mapInArrow(decode, schema)
