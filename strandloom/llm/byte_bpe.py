"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Texts are cut by the vocabulary's pattern. A word is a set of token-position rows, at first one for each byte; in each
round of a recursive query the rows join the merge table and every word contracts its leftmost pair of minimum rank,
until no pair is in the table. Decoding joins ids with their bytes and aggregates them in order.

A long word is cut into overlapping windows, which are contracted as words of their own. Tokens are those of a text if and
only if every two neighbours are those of their own bytes: contractions within them are then the text's, in its order,
and none crosses. So where two windows have a token in common, at the same bytes, the first one's tokens up to it and the
second one's behind it are those of both together. Work and memory grow in proportion to the word's length.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import kept

#: Characters of text that are handled at once, words that a worker remembers, words in one query.
SLICE, REMEMBERED, WORDS = 1 << 21, 400_000, 20_000
#: From this many bytes on a word is cut into windows of so many bytes that begin so many bytes apart.
LONG, WINDOW, STRIDE = 128, 64, 32
#: From this many bytes on a word's windows are contracted for it alone, those of shorter words for many words together.
MANY = 1 << 16
#: Rows that a recursion may leave, about: of short words half their squared lengths, of a long one all its rounds.
ROWS = 2_000_000

#: One round for short words. A row has its token and the next one's; best is the minimum of rank and position in each
#: word, and the row behind that position goes.
SHORT_ROUNDS = """
WITH RECURSIVE s(w, pos, tok, after, next, round) AS (
  SELECT *, 0 FROM (SELECT w, pos, tok, lead(pos) OVER o AS after, lead(tok) OVER o AS next FROM start WINDOW o AS (PARTITION BY w ORDER BY pos))
  UNION ALL
  (WITH q AS MATERIALIZED (SELECT s.*, (m.made::BIGINT << 24) | pos AS own FROM s LEFT JOIN merges m ON m.l = tok AND m.r = next),
  b AS MATERIALIZED (SELECT w, min(own) AS best, arg_min(after, own) AS gone FROM q WHERE own IS NOT NULL GROUP BY w),
  g AS MATERIALIZED (SELECT b.w, b.best, b.gone, q.after AS gone_after, q.next AS gone_next FROM q JOIN b ON q.w = b.w AND q.pos = b.gone)
  SELECT w, pos, CASE WHEN own = best THEN (best >> 24)::INTEGER ELSE tok END,
    CASE WHEN own = best THEN gone_after ELSE after END,
    CASE WHEN own = best THEN gone_next WHEN after = (best & 16777215) THEN (best >> 24)::INTEGER ELSE next END, round + 1
  FROM q JOIN g USING (w) WHERE pos <> gone)
)
SELECT w, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(piece, '' ORDER BY pos) AS text
FROM s JOIN (SELECT w, max(round) AS round FROM s GROUP BY w) USING (w, round) JOIN vocabulary ON id = tok GROUP BY w
"""
#: For windows that had to grow: of a calm pair, whose result makes no pair of lower rank, all places that do not overlap
#: contract together, which is what leftmost contractions would come to; places of a run of one token are paired from its
#: left. It stops after some rounds, so that the state it keeps stays small, and is asked again.
LONG_ROUNDS = """
WITH RECURSIVE s(w, pos, tok, round) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN hit THEN made ELSE tok END, round + 1 FROM (
    SELECT *, lag(hit) OVER (PARTITION BY w ORDER BY pos) AS gone FROM (
      SELECT *, best IS NOT NULL AND made = best AND CASE WHEN calm THEN (n - max(edge) OVER (PARTITION BY w ORDER BY pos)) % 2 = 0
          ELSE pos = first END AS hit FROM (
        SELECT *, CASE WHEN made = best AND lag(made) OVER (PARTITION BY w ORDER BY pos) IS NOT DISTINCT FROM best AND l = r
            THEN NULL ELSE n END AS edge, min(CASE WHEN made = best THEN pos END) OVER (PARTITION BY w) AS first FROM (
          SELECT p.*, m.made, m.l, m.r, m.calm, min(m.made) OVER (PARTITION BY p.w) AS best FROM (
            SELECT w, pos, tok, round, row_number() OVER (PARTITION BY w ORDER BY pos) AS n, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS next FROM s WHERE round < {rounds}
          ) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next))))
  WHERE best IS NOT NULL AND gone IS DISTINCT FROM true
)
SELECT tok, round FROM s WHERE round = (SELECT max(round) FROM s) ORDER BY pos
"""
DECODE = """
SELECT d, string_agg(piece, '' ORDER BY pos) AS text FROM
  (SELECT d, unnest(ids)::INTEGER AS id, generate_subscripts(ids, 1) AS pos FROM (SELECT d, string_split(ids, ' ') AS ids FROM units)) JOIN vocabulary USING (id) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file has a line for each token: its bytes in base 64, a space, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f) if t}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """(left, right, made, calm) for each pair of tokens whose bytes make a token."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    low: dict[int, int] = {}
    for left, right, made in rows:
        for side in (left, right):
            low[side] = min(made, low.get(side, made))
    return [(left, right, made, low.get(made, made) >= made) for left, right, made in rows]


def spans(raw: bytes) -> list[tuple[int, int]]:
    return [(lo, min(lo + WINDOW, len(raw))) for lo in range(0, max(len(raw) - STRIDE, 1), STRIDE)]


def groups(words: list[tuple]) -> Iterator[list[tuple]]:
    """Pairs (word, bytes) cut into lists that one recursion can hold; a long word counts as its windows."""
    some, rows = [], 0
    for pair in words:
        if some and (len(some) == WORDS or rows > ROWS):
            yield some
            some, rows = [], 0
        some.append(pair)
        rows += len(pair[1]) * min(len(pair[1]), WINDOW) // 2
    if some:
        yield some


class Coder:
    """Encodes and decodes by the ranks of one file; words that were met are remembered, up to a number that decides on
    memory and speed alone."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": "", "preserve_insertion_order": False})
        left, right, made, calm = zip(*merge_rows(self.ranks), strict=True)
        rows = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "made": pa.array(made, pa.int32()), "calm": list(calm)})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rows")
        # Bytes go through text columns as the characters of the same numbers.
        rows = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM rows")
        #: Runs of ids are decimal, joined by a space: those of a word, and the bytes that they stand for.
        self.words: dict[str, str] = {}
        self.tokens = {str(i): t.encode("latin-1") for i, t in self.db.sql("SELECT id, piece FROM vocabulary").fetchall()}
        self.units: dict[str, bytes] = dict(self.tokens)
        self.sizes = {i: len(t) for t, i in self.ranks.items()}
        #: Long words and their runs, which are remembered for one slice only, and tokens of windows.
        self.long: list[tuple[str, str]] = []
        self.windows: dict[bytes, list[int]] = {}

    def forget(self) -> None:
        self.words, self.units = {}, dict(self.tokens)

    def forget_long(self) -> None:
        for word, run in self.long:
            self.words.pop(word, None)
            self.units.pop(run, None)
        self.long.clear()
        self.windows.clear()

    def contract(self, words: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """(place in words, ids, characters of the bytes that the ids stand for) of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        start = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "tok": tok})  # noqa: F841 (DuckDB reads it)
        got = self.db.sql(SHORT_ROUNDS).to_arrow_table()
        return zip(*(got.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("w", "ids", "text")), strict=True)

    def learn(self, new: list[str]) -> None:
        """Adds the ids of words, and what they decode to, which the same ordered aggregation tells. A word that is a token
        is that token, as in the library whose ranks these are."""
        short, long = [], []
        for w in new:
            raw = w.encode()
            if raw in self.ranks:
                self.words[w] = str(self.ranks[raw])
            else:
                (short if len(raw) < LONG else long).append((w, raw))
        for some in groups(short):
            for i, ids, text in self.contract([raw for _, raw in some]):
                self.words[some[i][0]] = ids
                self.units[ids] = text.encode("latin-1")
        for some in groups(long):
            self.forget_windows()
            self.learn_windows(raw[lo:hi] for _, raw in some if len(raw) < MANY for lo, hi in spans(raw))
            for w, raw in some:
                ids = " ".join(map(str, self.joined(raw)))
                self.words[w] = ids
                self.long.append((w, ids))

    def learn_windows(self, raws: Iterable[bytes]) -> None:
        for some in groups([(raw, raw) for raw in set(raws).difference(self.windows)]):
            for i, ids, _ in self.contract([raw for _, raw in some]):
                self.windows[some[i][0]] = list(map(int, ids.split()))

    def contract_long(self, raw: bytes) -> list[int]:
        if raw in self.windows:
            return self.windows[raw]
        if len(raw) < LONG:
            self.learn_windows([raw])
            return self.windows[raw]
        tok, left = self.single[np.frombuffer(raw, np.uint8)], True
        while left:
            n = len(tok)
            start = pa.table({"w": np.zeros(n, np.int32), "pos": np.arange(n, dtype=np.int32), "tok": tok})  # noqa: F841
            rounds = max(1, ROWS // n)
            got = self.db.sql(LONG_ROUNDS.format(rounds=rounds)).to_arrow_table()
            tok, left = got.column("tok").to_numpy(), got.column("round")[0].as_py() == rounds
        if len(raw) <= 16 * WINDOW:
            self.windows[raw] = tok.tolist()
        return tok.tolist()

    def joined(self, raw: bytes) -> list[int]:
        """The tokens of a long word. out is always the tokens of the bytes before a place; a window is joined to it at a
        common token. Where they have none, a window from one of out's tokens on takes its place, and grows until they have."""
        out: list[tuple[int, int]] = []  # (first byte, token)
        end, reach = 0, WINDOW
        cuts = spans(raw)
        for group in range(0, len(cuts), 4 * WORDS):
            some = cuts[group : group + 4 * WORDS]
            if len(raw) >= MANY:
                self.forget_windows()
            self.learn_windows(raw[lo:hi] for lo, hi in some)
            for lo, hi in some:
                if hi <= end:
                    continue
                if not out or not self.join(out, lo, self.windows[raw[lo:hi]]):
                    while True:
                        at = len(out)
                        while at and end - out[at - 1][0] < reach:
                            at -= 1
                        at = max(at - 1, 0)
                        begin, hi = out[at][0] if out else 0, min(len(raw), hi + reach - WINDOW)
                        ids = self.contract_long(raw[begin:hi])
                        if begin == 0:
                            out.clear()
                            self.append(out, 0, ids)
                            break
                        if self.join(out, begin, ids):
                            break
                        reach *= 2
                end = hi
        return [i for _, i in out]

    def forget_windows(self) -> None:
        if len(self.windows) > 8 * WORDS:
            self.windows.clear()

    def append(self, out: list, begin: int, ids: list[int]) -> None:
        for i in ids:
            out.append((begin, i))
            begin += self.sizes[i]

    def join(self, out: list, begin: int, ids: list[int]) -> bool:
        """Joins the tokens of a window that begins at begin to out, at the first token that both have."""
        at = len(out)
        while at and out[at - 1][0] >= begin:
            at -= 1
        known = {x: k for k, x in enumerate(out[at:], at)}
        for k, i in enumerate(ids):
            hit = known.get((begin, i))
            begin += self.sizes[i]
            if hit is not None:
                del out[hit + 1 :]
                self.append(out, begin, ids[k + 1 :])
                return True
        return False

    def encode(self, texts: list) -> Iterator[list[str]]:
        """The ids of each text, word by word."""
        i = 0
        while i < len(texts):
            cut, size = [], 0
            while i < len(texts) and (not cut or size < SLICE):
                cut.append(self.pattern.findall(texts[i] or ""))
                size += len(texts[i] or "")
                i += 1
            self.forget_long()
            if max(len(self.words), len(self.units) - len(self.tokens)) > self.remembered:
                self.forget()
            self.learn(list(set().union(*cut).difference(self.words)))
            find = self.words.__getitem__
            for ws in cut:
                yield list(map(find, ws))

    def decode(self, texts: Iterable[list[str]]) -> Iterator[bytes]:
        """The bytes of texts given as runs of ids; a run that was met before is not decoded again."""
        texts = iter(texts)
        if len(self.units) - len(self.tokens) > 2 * self.remembered:
            self.forget()
        while some := list(itertools.islice(texts, 512)):
            try:
                yield from [b"".join(map(self.units.__getitem__, runs)) for runs in some]
            except KeyError:
                self.learn_runs(list(set().union(*some).difference(self.units)))
                yield from [b"".join(map(self.units.__getitem__, runs)) for runs in some]

    def learn_runs(self, new: list[str]) -> None:
        units = pa.table({"d": pa.array(range(len(new)), pa.int32()), "ids": pa.array(new, pa.string())})  # noqa: F841
        got = self.db.sql(DECODE).to_arrow_table()
        for d, text in zip(got.column("d").to_pylist(), got.column("text").to_pylist(), strict=True):
            self.units[new[d]] = text.encode("latin-1")


def coder(*key) -> Coder:
    """This worker's coder of a path, a pattern, and how many words it remembers."""
    return kept((Coder.__name__, *key), lambda: Coder(*key))


def numbers(runs: list[str]) -> np.ndarray:
    return np.array(" ".join(runs).split(), np.int32)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """docs with a column of token ids (array of int) for the whole text, null and empty texts: an empty array. A column
    of docs that has its name gives way. Repeated rows are encoded alike; an empty table gives no rows."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([numbers(ws) for ws in coder(path, pattern).encode(texts.tolist())])

    return docs.withColumn(column, ids("text"))


def decode(tokens: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """tokens with a column decoded (binary) of the bytes of its ids; null or no ids: no bytes."""

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        cut = ([" ".join(map(str, x[i : i + 16].tolist())) for i in range(0, len(x), 16)] if x is not None else [] for x in ids)
        return pd.Series(list(coder(path, pattern).decode(cut)))

    return tokens.withColumn("decoded", raw(column))


def coded(texts: list, own: Coder) -> Iterator[tuple[list[str], bytes]]:
    """The runs of ids of each text and the bytes that they decode to, a few texts at a time."""
    for lo in range(0, len(texts), 512):
        runs = list(own.encode(texts[lo : lo + 512]))
        yield from zip(runs, own.decode(runs), strict=True)


def tokens(docs: DataFrame, path: str, pattern: str, carry: list[str], remembered: int = REMEMBERED) -> DataFrame:
    """Columns carry of docs, then ids, n_tokens, and round_trip: whether the ids decode to the text (null: to nothing).
    Edge cases as for encode(); rows leave the worker in small groups, so memory is that of a few texts."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern, remembered)
        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.iloc[lo : lo + 128]
                texts = part["text"].tolist()
                rows = [(numbers(ws), raw == (t or "").encode()) for t, (ws, raw) in zip(texts, coded(texts, own), strict=True)]
                yield part[carry].assign(ids=[x for x, _ in rows], n_tokens=[len(x) for x, _ in rows], round_trip=[ok for _, ok in rows])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "ids array<int>, n_tokens long, round_trip boolean"])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, n_tokens, ids_sha256 of the decimal
    ids joined by a space, decoded_sha256 of the bytes that the ids decode to. Null and empty texts: no tokens, and the
    digests of nothing. Ids and bytes stay in the worker that made them; there is no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern)
        for b in batches:
            rows = []
            for ws, raw in coded(b["text"].tolist(), own):
                ids = " ".join(ws)
                rows.append((ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
