"""Removal of byte strings that an earlier document has, over all documents at once.

Documents are packed into blocks. In each 50-byte window the least hashed 26-gram is its anchor; equal windows have equal
anchors, so windows can only be equal where an anchor's 26-gram stands in two documents. First anchors' hashes alone are
dealt out, to find those; then, of windows with such anchors, the stretches of text around them, and equal windows meet
in one place. Each block first settles what its own documents show, and sends no window twice, so that the copies of a
passage travel once for each block that has it.

What is dealt out meets in buckets. Their number follows the measured length of all texts, so a task holds one bucket of
bounded size at a time, however few shuffle partitions there are.

suffix_array() orders suffixes by linear grouping construction; README says why the query does not sort with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import written

#: Length of the strings, of the anchors, text in a block, windows that are hashed at once: their arrays stay in a core's cache.
WINDOW, ANCHOR, BLOCK, SLICE = 50, 26, 2_000_000, 1 << 15
#: Text for each bucket in which windows meet (anchors: four times that), bytes that wait in a task until they are dealt
#: out or found places are sent back, and windows of a bucket that are compared at once.
BUCKET, HELD, COMPARED = 8_000_000, 16 << 20, 4 << 20
#: Results up to so many bytes, measured, are broadcast to the blocks that they belong to; larger ones are joined.
BROADCAST_BYTES = 48 << 20
LAST = (1 << 63) - 1
MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes [i, i + length) for each i where they are within data, made by doubling."""
    count = len(data) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    first, second = MIX[2 * seed], MIX[2 * seed + 1]

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * first
        x += b
        x ^= x >> np.uint64(29)
        x *= second
        return x

    power, n, out, done = (data.astype(np.uint64) + np.uint64(1)) * MIX[3], 1, None, 0
    while True:
        if length & n:
            out = power[:count] if out is None else joined(out[:count], power[done : done + count])
            done += n
        if done == length:
            return out ^ out >> np.uint64(32)
        power = joined(power[: len(power) - n], power[n:])
        n *= 2


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i."""
    count, power, n, out, done = len(x) - width + 1, x, 1, None, 0
    while True:
        if width & n:
            out = power[:count] if out is None else np.minimum(out[:count], power[done : done + count])
            done += n
        if done == width:
            return out
        power = np.minimum(power[: len(power) - n], power[n:])
        n *= 2


class Block:
    """Documents of a block: their keys, and their bytes one after another."""

    def __init__(self, dids: bytes, sizes: bytes, data: bytes, window: int, anchor: int):
        self.dids, self.sizes = np.frombuffer(dids, "<i8"), np.frombuffer(sizes, "<i8")
        self.data, self.window, self.anchor = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), window, anchor
        self.ends = np.cumsum(self.sizes)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of runs of windows with one anchor: the anchor's hash, its place, the first window and the one behind the last.
        Windows lie within documents; of equal hashes the leftmost is the anchor."""
        parts = []
        total = len(self.data)
        inside = np.zeros(max(total, 1), bool)  # whether a window begins here
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            inside[end - size : max(end - self.window + 1, end - size)] = True
        low = np.uint64((1 << 24) - 1)
        for lo in range(0, total - self.window + 1, SLICE):
            hi = min(lo + SLICE, total - self.window + 1)
            h = gram_hashes(self.data[lo : hi + self.window - 1], self.anchor)
            best = least_of((h & ~low) | np.arange(len(h), dtype=np.uint64), self.window - self.anchor + 1)
            starts = np.flatnonzero(inside[lo:hi])
            if not len(starts):
                continue
            best = best[starts]
            place = (best & low).astype(np.int64)
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(starts) != 1)))
            at = np.flatnonzero(new)
            last = np.concatenate((at[1:], [len(starts)])) - 1
            parts.append(((best[at] >> np.uint64(24)), place[at] + lo, starts[at] + lo, starts[last] + lo + 1))
        if not parts:
            return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: all lowest bytes first, then all of the next, which leaves runs of like bytes."""
    parts = []
    for a in map(np.ascontiguousarray, arrays):
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T
        parts.append(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def spread(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(raw[at + 8 : at + 12].decode().strip())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 12 + n * kind.itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending places as differences; np.cumsum takes them back."""
    return np.diff(x, prepend=0).astype("<u4")


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal hashes together, where each group begins in it, and the group of each place of it."""
    order = np.argsort(h)
    a = h[order]
    new = np.concatenate(([True], a[1:] != a[:-1]))
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def shared_hashes(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether another owner has the same hash, for each."""
    out = np.zeros(len(h), bool)
    if len(h):
        order, starts, group = groups(h)
        own = owner[order]
        out[order] = (np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts))[group]
    return out


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of [start, end) for each pair."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers as [start, end) runs."""
    new = np.concatenate(([True], np.diff(at) != 1)) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return at[begin], at[np.concatenate((begin[1:], [len(at)])) - 1] + 1 if len(at) else at


def earlier(h: np.ndarray, did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a smaller did has the same hash, and the first index of the smallest did that has it, for each."""
    late, lead = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    if len(h):
        order, starts, group = groups(h)
        own = did[order]
        low = np.minimum.reduceat(own, starts)[group]
        late[order] = own > low
        lead[order] = np.minimum.reduceat(np.where(own == low, order, len(h)), starts)[group]
    return late, lead


def pack_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows (block, bytes, dids, sizes, data) of consecutive documents, data compressed; a longer document is a block of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, dids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pd.DataFrame:
            sizes = np.fromiter(map(len, texts), "<i8", len(texts))
            return pd.DataFrame({"block": [number], "bytes": [held], "dids": [np.array(dids, "<i8").tobytes()], "sizes": [sizes.tobytes()], "data": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]})

        for b in batches:
            for did, text in zip(b["did"].tolist(), b["text"].tolist(), strict=True):
                raw = text.encode()
                if texts and held + len(raw) > size:
                    yield block()
                    number, dids, texts, held = number + 1, [], [], 0
                dids.append(did)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield block()

    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "block long, bytes long, dids binary, sizes binary, data binary")


class Dealer:
    """Entries of several blocks, cut by bucket: rows (bucket, block, data), where data has the blocks, how many entries each
    has, their places as steps, their other columns and their texts. One row for several blocks keeps rows few and long."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.parts = buckets, 0, []

    def add(self, block: int, bucket: np.ndarray, place: np.ndarray, columns: list[np.ndarray], text: np.ndarray, sizes: np.ndarray) -> None:
        """Entries of a block by ascending place, their texts one after another."""
        part = [bucket.astype("<i4"), place.astype("<u4"), *columns, sizes.astype("<i4")]
        self.parts.append((block, part, text))
        self.held += sum(x.nbytes for x in part) + text.nbytes

    def rows(self) -> pd.DataFrame:
        """All that was added since the last call."""
        blocks, parts, texts = zip(*self.parts, strict=True)
        bucket, place, *columns, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        text, owner = np.concatenate(texts), np.repeat(np.arange(len(blocks)), [len(x[0]) for x in parts])
        self.parts, self.held = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, place, owner = bucket[order], place[order], owner[order]
        step = np.diff(place.astype("<i8"), prepend=0)
        first = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(owner) != 0)))[: len(bucket)])
        step[first] = place[first]
        counts = np.diff(np.concatenate((first, [len(bucket)])))
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        numbers, out = np.array(blocks, "<i8"), []
        present = bucket[np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0))[: len(bucket)])]
        for k in present.tolist():
            lo, hi = np.searchsorted(bucket, (k, k + 1))
            i, j = np.searchsorted(first, (lo, hi))
            pick = order[lo:hi]
            words = text[ranges(begin[pick], begin[pick] + sizes[pick])]
            out.append((k, blocks[0], b"\1" + squeeze(numbers[owner[first[i:j]]], counts[i:j].astype("<u4"), step[lo:hi].astype("<u4"), *[c[pick] for c in columns], words)))
        return pd.DataFrame(out, columns=["bucket", "block", "data"])


def undealt(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a bucket's data: block and place of each entry, and the other columns."""
    block, place, rest = [], [], []
    for x in blobs:
        numbers, counts, step, *columns = spread(x[1:])
        at, ends = np.cumsum(step, dtype=np.int64), np.cumsum(counts, dtype=np.int64)
        place.append(at - np.repeat(np.concatenate(([0], at[ends[:-1] - 1])), counts))
        block.append(np.repeat(numbers, counts))
        rest.append(columns)
    return np.concatenate(block), np.concatenate(place), [np.concatenate(c) for c in zip(*rest, strict=True)]


class Found:
    """Places of blocks, from several buckets: rows (block, data)."""

    def __init__(self, blob):
        self.blob, self.held, self.parts = blob, 0, []

    def add(self, block: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((block, place))
        self.held += block.nbytes + place.nbytes

    def rows(self) -> pd.DataFrame:
        """All that was added since the last call: of each block's ascending distinct places, what blob makes."""
        block, place = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 2
        self.parts, self.held = [], 0
        order = np.lexsort((place, block))
        block, place = block[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(block) != 0))[: len(block)])
        ends = np.append(first[1:], len(block))[: len(first)]
        out = [(int(block[i]), self.blob(np.unique(place[i:j]))) for i, j in zip(first, ends, strict=True)]
        return pd.DataFrame(out, columns=["block", "data"])


def by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """(blocks, blobs) of each bucket, of rows sorted by bucket."""
    now, blocks, blobs = None, [], []
    for b in batches:
        for k, block, data in zip(b["bucket"].tolist(), b["block"].tolist(), b["data"].tolist(), strict=True):
            if k != now and blobs:
                yield blocks, blobs
                blocks, blobs = [], []
            now = k
            blocks.append(block)
            blobs.append(data)
    if blobs:
        yield blocks, blobs


DEALT = "bucket int, block long, data binary"


def meet(rows: DataFrame, function, schema: str) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(function, schema)


def shared_anchors(blocks: DataFrame, buckets: int, window: int, anchor: int) -> DataFrame:
    """(block, data): places of anchors whose 26-gram another block has too."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, none = Dealer(buckets), np.zeros(0, np.uint8)
        for b in batches:
            for row in b.itertuples(index=False):
                h, place, _, _ = Block(row.dids, row.sizes, row.data, window, anchor).anchors()
                # Of one hash in this block one place is sent; if it comes back, it stands for all of them.
                h, first = np.unique(h, return_index=True)
                place = place[first]
                order = np.argsort(place)
                h, place = h[order], place[order]
                # 32 bits within a bucket: two hashes that fall together only ask for text in vain.
                key = (h // np.uint64(buckets) & np.uint64(0xFFFFFFFF)).astype("<u4")
                out.add(row.block, h % np.uint64(buckets), place, [key], none, np.zeros(len(h)))
                if out.held >= HELD:
                    yield out.rows()
        if out.parts:
            yield out.rows()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Found(lambda place: squeeze(steps(place)))
        for _, blobs in by_bucket(batches):
            block, place, (key, _) = undealt(blobs)
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            hit = np.zeros(len(key), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            found.add(block[hit], place[hit])
            if found.held >= HELD:
                yield found.rows()
        yield found.rows()

    return meet(blocks.mapInPandas(send, DEALT), find, "block long, data binary")


def repeated_windows(blocks: DataFrame, places: DataFrame, buckets: int, window: int, anchor: int) -> DataFrame:
    """(block, data): runs of windows that a document with a smaller id has. places: (block, found) of shared anchors."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Dealer(buckets)
        for b in batches:
            for row in b.itertuples(index=False):
                own = Block(row.dids, row.sizes, row.data, window, anchor)
                h, place, start, end = own.anchors()
                hit = shared_hashes(h, own.doc_of(place))
                if row.found is not None and len(row.found):
                    back = np.concatenate([np.cumsum(spread(x)[0], dtype=np.int64) for x in row.found])
                    hit |= np.isin(h, h[np.isin(place, back)])
                h, start, end = h[hit], start[hit], end[hit]
                if not len(h):
                    continue
                at = ranges(start, end)
                run = np.repeat(np.arange(len(h)), end - start)
                hashes = windows_at(own.data, at, window)
                did = own.dids[own.doc_of(at)]
                late, lead = earlier(hashes, did)
                check = np.flatnonzero(late)
                late[check] = same_bytes(own.data, at[check], at[lead[check]], window)
                if late.any():
                    yield pd.DataFrame([(int(row.block % buckets), row.block, b"\0" + squeeze(*runs(np.unique(at[late]))))], columns=["bucket", "block", "data"])
                # One run for each window of the earliest document is sent; what it is told holds for all equal windows.
                sent = np.zeros(len(h), bool)
                sent[run[np.unique(lead)]] = True
                h, start, end = h[sent], start[sent], end[sent]
                sizes = end - start
                out.add(row.block, h % np.uint64(buckets), start, [own.dids[own.doc_of(start)], sizes.astype("<u2")], own.data[ranges(start, end + window - 1)], sizes + window - 1)
                if out.held >= HELD:
                    yield out.rows()
        if out.parts:
            yield out.rows()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Found(lambda place: b"\1" + squeeze(*runs(place)))
        for numbers, blobs in by_bucket(batches):
            own = [(n, x) for n, x in zip(numbers, blobs, strict=True) if x[:1] == b"\0"]
            if own:
                yield pd.DataFrame(own, columns=["block", "data"])
            ask = [x for x in blobs if x[:1] == b"\1"]
            if ask:
                block, begin, (did, counts, text) = undealt(ask)
                counts = counts.astype(np.int64)
                for which, run in late_windows(text, counts, did, window):
                    found.add(block[run], begin[run] + which - (np.cumsum(counts) - counts)[run])
                    if found.held >= HELD:
                        yield found.rows()
        yield found.rows()

    return meet(joined(blocks, places).mapInPandas(send, DEALT), find, "block long, data binary")


def late_windows(text: np.ndarray, counts: np.ndarray, did: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of runs of windows, each with its own text: the number of each window that a smaller did has too, and of its run.
    More than COMPARED windows are compared in several passes over their hashes, so a crowded bucket costs time, not memory."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    passes = max(1, -(-total // COMPARED))
    cuts = np.unique(np.concatenate((np.searchsorted(ends, np.arange(0, total, SLICE), "right"), [len(ends)])))
    for turn in range(passes):
        parts = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            run = np.repeat(np.arange(i, j), counts[i:j])
            number = np.arange(ends[i] - counts[i], ends[j - 1])
            low = number[0] + i * (window - 1)
            h = windows_at(text[low : ends[j - 1] + j * (window - 1)], number + run * (window - 1) - low, window)
            mine = slice(None) if passes == 1 else h % np.uint64(passes) == turn
            parts.append((h[mine], number[mine], run[mine].astype("<i4")))
        if not parts:
            return
        h, number, run = (np.concatenate(x) for x in zip(*parts, strict=True))
        late, lead = earlier(h, did[run])
        at, check = number + run.astype(np.int64) * (window - 1), np.flatnonzero(late)
        late[check] = windows_at(text, at[check], window, 1) == windows_at(text, at[lead[check]], window, 1)
        yield number[late], run[late]


def windows_at(data: np.ndarray, at: np.ndarray, window: int, seed: int = 0) -> np.ndarray:
    """Hashes of the windows that begin at the given places; data is hashed slice by slice."""
    out = np.zeros(len(at), np.uint64)
    order = None if len(at) < 2 or (np.diff(at) >= 0).all() else np.argsort(at, kind="stable")
    places = at if order is None else at[order]
    got = np.zeros(len(at), np.uint64)
    for lo in range(0, max(len(data) - window + 1, 0), SLICE):
        i, j = np.searchsorted(places, (lo, lo + SLICE))
        if i < j:
            got[i:j] = gram_hashes(data[lo : lo + SLICE + window - 1], window, seed)[places[i:j] - lo]
    if order is None:
        return got
    out[order] = got
    return out


def joined(blocks: DataFrame, found: DataFrame, small: int = 0) -> DataFrame:
    """blocks with found, the blobs (block, data) of each: broadcast if they have at most small bytes, which is measured
    first, else dealt by block like the blocks themselves."""
    table = found.groupBy("block").agg(F.collect_list("data").alias("found"))
    if small:
        table = written(table, "op10-found")
        size = table.agg(F.sum(F.expr("aggregate(found, 0L, (a, x) -> a + length(x) + 16)"))).first()[0] or 0
        table = F.broadcast(table) if size <= small else table
    return blocks.join(table, "block", "left")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, and with texts the bytes that are kept.

    A byte goes if a string of window bytes over it also starts in a document with a smaller doc_id; all is judged on
    the input. Null texts are empty; texts shorter than window keep all. Null doc_ids come after all others and not
    before each other; rows that repeat a doc_id don't judge each other, so repeated rows fare alike. What is kept need
    not be valid UTF-8. An empty table gives no rows. Equal windows of one block are held to their bytes, those of several to two
    64-bit hashes."""
    spark = docs.sparkSession
    blocks = written(pack_blocks(docs, block), "op10-blocks")
    total, least = blocks.agg(F.sum("bytes")).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = [max(least, -(-total // size)) for size in (4 * BUCKET, BUCKET)]
    places = shared_anchors(blocks, buckets[0], window, anchor)
    found = repeated_windows(blocks, places, buckets[1], window, anchor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for row in b.itertuples(index=False):
                own = Block(row.dids, row.sizes, row.data, window, anchor)
                gone = np.zeros(len(own.data) + 1, np.int32)
                known = {b"\0": [np.zeros(0, np.int64)], b"\1": [np.zeros(0, np.int64)]}
                for blob in row.found if row.found is not None else []:
                    known[blob[:1]].append(ranges(*spread(blob[1:])))
                here, told = (np.concatenate(x) for x in known.values())
                again = np.unique(np.concatenate((here, told_windows(own, np.unique(told)))))
                starts, ends = runs(again)
                np.add.at(gone, starts, 1)
                np.add.at(gone, ends + window - 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                out = []
                for did, end, size in zip(own.dids.tolist(), own.ends.tolist(), own.sizes.tolist(), strict=True):
                    mask, raw = gone[end - size : end], own.data[end - size : end]
                    kept = raw[~mask].tobytes()
                    spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
                    out.append((None if did == LAST else did, size, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return joined(blocks, found, BROADCAST_BYTES).mapInPandas(run, schema)


def told_windows(own: Block, told: np.ndarray) -> np.ndarray:
    """Windows of the block that are repeated, given the asked ones that are: as the first of the equal windows of its
    smallest id was told, so are all that have its bytes. Those with larger ids were found in the block."""
    if not len(told):
        return told
    h, _, start, end = own.anchors()
    hit = np.isin(h, h[np.searchsorted(start, told, "right") - 1])
    at = ranges(start[hit], end[hit])
    _, lead = earlier(windows_at(own.data, at, own.window), own.dids[own.doc_of(at)])
    ours = np.isin(at[lead], told)
    at, first = at[ours], at[lead][ours]
    return at[same_bytes(own.data, at, first, own.window)]


def same_bytes(data: np.ndarray, at: np.ndarray, lead: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at ascending places have the bytes of those at lead. Windows that follow each other at one distance
    from their leads are compared as one stretch."""
    if not len(at):
        return np.zeros(0, bool)
    off = at - lead
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(off) != 0))))
    sizes = np.diff(np.concatenate((begin, [len(at)]))) + window - 1
    stretch = ranges(at[begin], at[begin] + sizes)
    bad = data[stretch] != data[stretch - np.repeat(off[begin], sizes)]
    if not bad.any():
        return np.ones(len(at), bool)
    upto = np.concatenate(([0], np.cumsum(bad)))
    local = at - np.repeat(at[begin] - (np.cumsum(sizes) - sizes), sizes - window + 1)
    return upto[local + window] == upto[local]


def suffix_array(s: bytes) -> np.ndarray:
    """Suffix array of s by linear grouping construction (Baier, 2016).

    Phase one forms, from the last suffix to the first, groups of suffixes that share the prefix up to the next lexically
    smaller suffix (their Lyndon prefix), going through groups in descending order and moving the suffixes whose prefix
    a group's members extend, found by pointers to previous smaller suffixes. Phase two puts suffixes in order group by
    group, each read suffix placing the one that points to it; nothing is renamed recursively."""
    # A symbol below all others ends the text.
    codes = np.concatenate((np.frombuffer(s, np.uint8).astype(np.int64) + 1, [0]))
    n = len(codes)
    count = np.bincount(codes, minlength=257)
    starts = np.concatenate(([0], np.cumsum(count)))[:257]
    # group: first place of the suffix's group; size: of the group that begins there; sa: suffixes, by group.
    group = starts[codes].tolist()
    size: dict[int, int] = {int(b): int(c) for b, c in zip(starts, count, strict=True) if c}
    sa = np.argsort(codes, kind="stable").tolist()
    place = [0] * n
    for i, x in enumerate(sa):
        place[x] = i
    prev = [-2] * n  # previous suffix of a smaller group; -1: none
    high = n
    while high > 0:
        # groups tile the places; the next group to the left of high ends there
        lead = group[sa[high - 1]]
        members = sa[lead:high]
        high = lead
        pointers: dict[int, int] = {}
        for m in sorted(members, reverse=True):
            p = m - 1
            while p >= 0 and group[p] >= lead:
                p = prev[p] if prev[p] != -2 and group[p] > lead else p - 1
            prev[m] = p
        for m in members:
            if prev[m] >= 0:
                pointers[prev[m]] = pointers.get(prev[m], 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, times in pointers.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_times[times]:
                moved.setdefault(group[p], []).append(p)
            for old, ps in moved.items():
                end = old + size[old]
                for p in ps:  # to the group's end
                    end -= 1
                    q, i = sa[end], place[p]
                    sa[i], sa[end] = q, p
                    place[q], place[p] = i, end
                size[old] -= len(ps)
                size[end] = len(ps)
                for p in ps:
                    group[p] = end
    out = [-1] * n
    fill = {g: g for g in group}
    placed = [False] * n

    def put(x: int) -> None:
        placed[x] = True
        out[fill[group[x]]] = x
        fill[group[x]] += 1

    put(n - 1)
    for i in range(n):
        x = out[i] - 1
        while x >= 0 and not placed[x]:
            put(x)
            x = prev[x]
    return np.array(out[1:], np.int64)
