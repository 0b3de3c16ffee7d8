"""Token-ID output in patched frame-of-reference blocks.

Ids are stored in blocks of BLOCK. A block keeps its minimum and the differences from it, packed at a width that a
percentile of them needs; what is wider is patched from an exception list. A segment is a run of whole documents in
ascending order of doc_id with an index of its block starts; segments are the rows of the files, which Spark's own
writer commits, so any store that Spark writes to will do and a lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import kept, shared_dir

BLOCK, PERCENTILE = 256, 90
#: Ids in a segment, about; a longer document has a segment of its own.
SEGMENT = 1 << 19
#: Characters of text that are encoded at once, and words whose ids a worker remembers.
SLICE, REMEMBERED = 1 << 22, 1_000_000
MAGIC, HEAD = b"PFR1", struct.Struct("<4sIIQ")
SEGMENT_SCHEMA = "part int, seq int, docs int, tokens long, data binary"


def pack(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """A segment: head (magic, documents, blocks, ids), doc_ids, null marks, lengths, then of the blocks the minima,
    widths and numbers of exceptions, the starts, and the blocks: packed bits, exception places, exception values."""
    n, count = len(ids), -(-len(ids) // BLOCK)
    full = np.zeros((count, BLOCK), np.uint32)
    full.ravel()[:n] = ids
    if count:
        full.ravel()[n:] = ids[-1]
    low = full.min(1) if count else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    typical = np.partition(diff, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100] if count else low
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    high = diff >> width[:, None].astype(np.uint32)
    at_block, at_place = np.nonzero(high)
    exceptions = np.bincount(at_block, minlength=count).astype(np.uint16)
    packed: list[bytes] = [b""] * count
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for some in np.array_split(rows, -(-len(rows) // 512)):
            bits = (diff[some][:, :, None] >> np.arange(w, dtype=np.uint32) & 1).astype(np.uint8).reshape(len(some), -1)
            for r, b in zip(some.tolist(), np.packbits(bits, axis=1, bitorder="little"), strict=True):
                packed[r] = b.tobytes()
    places, values = at_place.astype(np.uint8), high[at_block, at_place].astype("<u4")
    ends = np.cumsum(exceptions.astype(np.int64))
    blocks, starts, size = [], np.zeros(count, "<u8"), 0
    for k in range(count):
        lo, hi = int(ends[k]) - int(exceptions[k]), int(ends[k])
        one = packed[k] + places[lo:hi].tobytes() + values[lo:hi].tobytes()
        starts[k] = size
        size += len(one)
        blocks.append(one)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [HEAD.pack(MAGIC, len(doc_ids), count, n), names.tobytes(), nulls.tobytes(), np.array(lengths, "<u8").tobytes(),
         low.astype("<u4").tobytes(), width.tobytes(), exceptions.astype("<u2").tobytes(), starts.tobytes(), *blocks]
    )


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment."""
    magic, docs, count, n = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token blocks")
    at = HEAD.size
    parts = []
    for kind, k in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", count), ("u1", count), ("<u2", count), ("<u8", count)):
        parts.append(np.frombuffer(data, kind, k, at))
        at += parts[-1].nbytes
    names, nulls, lengths, low, width, exceptions, starts = parts
    body = np.frombuffer(data, np.uint8, len(data) - at, at)
    out = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        first, shift = np.arange(BLOCK) * w // 8, (np.arange(BLOCK) * w % 8).astype(np.uint64)
        for some in np.array_split(rows, -(-len(rows) // 512)):
            got = np.zeros((len(some), BLOCK * w // 8 + 5), np.uint8)
            got[:, :-5] = body[starts[some].astype(np.int64)[:, None] + np.arange(BLOCK * w // 8)]
            value = np.zeros((len(some), BLOCK), np.uint64)
            for k in range((w + 14) // 8):  # the bytes over which w bits can lie
                value |= got[:, first + k].astype(np.uint64) << np.uint64(8 * k)
            out[some] = value >> shift & np.uint64((1 << w) - 1)
    for k in np.flatnonzero(exceptions).tolist():
        lo, e = int(starts[k]) + int(width[k]) * BLOCK // 8, int(exceptions[k])
        out[k, body[lo : lo + e]] |= np.frombuffer(body[lo + e : lo + 5 * e].tobytes(), "<u4") << np.uint32(width[k])
    ids = (out + low[:, None]).ravel()[:n]
    return [None if z else d for d, z in zip(names.tolist(), nulls.tolist(), strict=True)], lengths.astype(np.int64), ids


#: Words of these characters alone have one form (no composition, one lower-case letter for each), so they are cut here
#: as the tokenizer would cut them, by its own pattern; all others go to it whole.
PLAIN = regex.compile(r"[\x21-\x7E\xA1-\xFF]+")
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: How a vocabulary file has to normalise and cut texts for that; texts of all other vocabularies go to the library whole.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": CUT.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """Encodes by the tokenizers library and remembers the ids (unsigned 32-bit, little-endian) of words that it met.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of the words between its
    spaces, tabs and line ends. Plain words are cut further into the pieces that the tokenizer keeps apart; new pieces
    are encoded many at a time, and tokens that end a piece tell where one stops. Words with an added token (of the kind
    of <|endoftext|>, without white space) go to it whole, which finds the token anywhere in them."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        config = json.loads(self.tokenizer.to_str())
        added = config.get("added_tokens") or []
        #: Whether words can be encoded on their own.
        self.by_word = all(config.get(k) == v for k, v in KNOWN.items()) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 for t in added)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in tokens.items() if t.endswith(suffix)]] = True
        self.pieces: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Word number i has ids[starts[i]:starts[i + 1]]."""
        self.words: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn_words(self, words: list[str]) -> dict[str, bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, got, strict=True)}

    def learn_pieces(self, pieces: list[str]) -> None:
        groups = [pieces[lo : lo + 64] for lo in range(0, len(pieces), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(group) or len(stops) and stops[-1] != 4 * len(ids):
                self.pieces.update(self.learn_words(group))
                continue
            raw, stops = ids.tobytes(), stops.tolist()
            self.pieces.update(zip(group, [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)], strict=True))

    def learn(self, new: list[str]) -> None:
        got: dict[str, bytes] = {}
        other = [w for w in new if not PLAIN.fullmatch(w) or any(t in w.lower() for t in self.added)]
        for lo in range(0, len(other), 20_000):
            got |= self.learn_words(other[lo : lo + 20_000])
        plain = [w for w in new if w not in got]
        for lo in range(0, len(plain), 50_000):
            some = plain[lo : lo + 50_000]
            cut = [[w.lower()] if w.isalpha() else CUT.findall(w.lower()) for w in some]
            if len(self.pieces) > REMEMBERED // 2:
                self.pieces.clear()
            self.learn_pieces(list(set().union(*cut).difference(self.pieces)))
            find = self.pieces.__getitem__
            got.update((w, find(ps[0]) if len(ps) == 1 else b"".join(map(find, ps))) for w, ps in zip(some, cut, strict=True))
        self.words.update(zip(got, range(len(self.words), len(self.words) + len(got)), strict=True))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(got.values()), "<u4")))
        sizes = np.fromiter(map(len, got.values()), np.int64, len(got)) // 4
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))

    def encode(self, texts: list) -> Iterator[np.ndarray]:
        """The ids of each text."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < SLICE):
                size += len(texts[j] or "")
                j += 1
            if not self.by_word:
                got = self.tokenizer.encode_batch_fast([t or "" for t in texts[i:j]], add_special_tokens=False)
                yield from (np.array(e.ids, "<u4") for e in got)
                i = j
                continue
            split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts[i:j]], pa.large_string()))
            flat = split.flatten().dictionary_encode()
            own = flat.dictionary.to_pylist()
            if len(self.words) > REMEMBERED:
                self.forget()
            new = [w for w in own if w not in self.words]
            if new:
                self.learn(new)
            number = np.fromiter(map(self.words.__getitem__, own), np.int64, len(own))[flat.indices.to_numpy()]
            begins, sizes = self.starts[number], self.starts[number + 1] - self.starts[number]
            ends = np.cumsum(sizes)
            ids = self.ids[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))]
            yield from (ids[lo:hi] for lo, hi in zip(upto, upto[1:], strict=False))
            i = j


def encode_texts(texts: list, vocabulary: str) -> Iterator[np.ndarray]:
    """The ids of each text, by this worker's encoder."""
    return kept((Encoder.__name__, vocabulary), lambda: Encoder(vocabulary)).encode(texts)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes the ids of all texts, each with end_id behind it, as segments in ascending order of doc_id (null first,
    rows of one doc_id in the order of their texts' hashes, so that one doc_id with very many rows is split as well)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4")
        held, names, size = [], [], 0

        def segment() -> pd.DataFrame:
            ids = np.concatenate(held)
            data = pack(ids, names, [len(x) for x in held])
            return pd.DataFrame({"part": [part], "seq": [seq], "docs": [len(names)], "tokens": [len(ids)], "data": [data]})

        for b in batches:
            doc_ids = [None if x is None or x is pd.NA or x != x else int(x) for x in b["doc_id"].astype(object)]
            for doc_id, got in zip(doc_ids, encode_texts(b["text"].tolist(), vocabulary), strict=True):
                held.append(np.concatenate((got, end)))
                names.append(doc_id)
                size += len(held[-1])
                if size >= SEGMENT:
                    yield segment()
                    held, names, size, seq = [], [], 0, seq + 1
        if held:
            yield segment()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(parts, "doc_id", "h")
    rows.sortWithinPartitions("doc_id", "h", "text").mapInPandas(run, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files; start counts the ids of all documents before it."""
    made = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for before, data in zip(b["before"], b["data"], strict=True):
                doc_ids, lengths, ids = unpack(data)
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "doc_id": pd.array(doc_ids, "Int64"), "start": before + ends - lengths, "n_tokens": lengths,
                    "ids": [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)],
                })

    return with_starts(made).mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def with_starts(made: DataFrame) -> DataFrame:
    """Segments with before, the ids of all segments before them. Segments of a part are added up first; the sum over
    parts has a row for each part, as many as the job had tasks, which also bounds what is broadcast."""
    sums = made.groupBy("part").agg(F.sum("tokens").alias("n"))
    ahead = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    own = made.select("part", "seq", (F.sum("tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("tokens")).alias("own"))
    index = own.join(ahead, "part").select("part", "seq", (F.col("own") + F.col("ahead")).alias("before"))
    return made.join(index, ["part", "seq"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files."""
    made = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, seq, data in zip(b["part"], b["seq"], b["data"], strict=True):
                doc_ids, lengths, ids = unpack(data)
                ends, raw = np.cumsum(lengths), ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "part": part, "seq": seq, "local": ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crc, np.int64)})

    rows = made.select("part", "seq", "data").mapInPandas(run, "doc_id long, part int, seq int, local long, n_tokens long, ids_crc32 long")
    index = with_starts(made.select("part", "seq", "tokens")).select("part", "seq", "before")
    return rows.join(index, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text) to path, by default a new folder under spark.checkpoint.dir, and returns for each row
    what the files hold: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone. Repeated rows are written as often as they come. Null doc_ids come
    first. An empty table writes files without a segment and gives no rows."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id)
    return checksums(spark, path)
