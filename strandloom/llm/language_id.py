"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ORDER is learned; what all models say of an n-gram stands in one row of a table, and
tables are arrays sorted by hash. A text goes to the language of the lowest cross-entropy by character, and is rejected
if that is higher than held-back training texts of that language reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: n-gram length; most training texts of a language and most characters of one; part of them held back to calibrate.
ORDER, TRAIN_TEXTS, TRAIN_CHARS, HELD_BACK = 4, 400, 20_000, 5
#: Characters of training text of all languages together, about, and the fewest of a text where they are many: texts give
#: shorter slices then, so what comes to the driver, and the tables that go to the tasks, stay of a size.
TOTAL_CHARS, LEAST_CHARS = 1 << 26, 500
#: Times the highest cross-entropy of held-back texts from which on a text is rejected.
SLACK = 1.5
#: Characters that are scored at once.
BLOCK = 1 << 18
MIX, TOP = np.uint64(0x9E3779B97F4A7C15), 20
SPACE, OTHER = 0, 1


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts one after another, and the index at which each begins."""
    low = [t.lower() for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), begins


#: Whether a code point is a letter, for all of them.
IS_LETTER: np.ndarray | None = None


def is_letter(points: np.ndarray) -> np.ndarray:
    global IS_LETTER
    if IS_LETTER is None:
        IS_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return IS_LETTER[points]


@dataclass
class Table:
    """Rows found by n-gram: hashes sorted, with the place at which each value of their upper bits, TOP at most, begins."""

    hashes: np.ndarray
    rows: np.ndarray
    begins: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)

    def __post_init__(self):
        bits = min(TOP, len(self.hashes).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        tops = (self.hashes >> self.shift).astype(np.int64)
        self.begins = np.searchsorted(tops, np.arange((1 << bits) + 1)).astype(np.int32)

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Table:
        h = keys * MIX
        order = np.argsort(h)
        return cls(h[order], rows[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where there is none."""
        h = keys * MIX
        top = (h >> self.shift).astype(np.int64)
        at, end = self.begins[top], self.begins[top + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while len(left):
            hit = self.hashes[at] == h
            out[left[hit]] = at[hit]
            go = ~hit & (at + 1 < end)
            left, at, end, h = left[go], at[go] + 1, end[go], h[go]
        return out


def grams(codes: np.ndarray, begins: np.ndarray, order: int, base: int) -> np.ndarray:
    """Keys of the n-grams that end at each code; before a text's begin there are spaces."""
    place = np.arange(len(codes)) - np.repeat(begins[:-1], np.diff(begins))
    key = codes.astype(np.uint64)
    for k in range(1, order):
        back = np.zeros(len(codes), np.uint64)
        back[k:] = codes[:-k]
        back[place < k] = SPACE
        key += back * np.uint64(base**k)
    return key


def squeezed(points: np.ndarray, begins: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with runs of anything but letters made one space, and none at a text's begin."""
    alpha = is_letter(points)
    codes = np.where(alpha, lookup[points], SPACE)
    before = np.concatenate(([False], alpha[:-1]))
    before[begins[:-1][begins[:-1] < len(points)]] = False
    keep = alpha | before
    upto = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], upto[begins]


@dataclass
class Model:
    langs: list[str]
    lookup: np.ndarray
    base: int
    probs: list[Table]  # by order, from 1: log probabilities of each language
    backs: list[Table]  # by order of the n-gram, from 2: log weights of what is shorter, found by its context
    floor: np.ndarray
    limit: np.ndarray = None  # cross-entropy and its variance by character that texts of each language reach
    spread: np.ndarray = None

    def each(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        order = len(self.probs)
        key = grams(codes, begins, order, self.base)
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        left = np.arange(len(codes))
        for n in range(order, 0, -1):
            table = self.probs[n - 1]
            at = table.find(key[left] % np.uint64(self.base**n) if n < order else key)
            hit = at >= 0
            out[left[hit]] += table.rows[at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n > 1:
                back = self.backs[n - 2]
                at = back.find((key[left] % np.uint64(self.base**n)) // np.uint64(self.base))
                out[left[at >= 0]] += back.rows[at[at >= 0]]
        out[left] += self.floor
        return out

    def judge(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Language (und for null texts and those without a letter), score from 0 to 1, and rejection of each text."""
        n = len(texts)
        total, size = np.zeros((n, len(self.langs))), np.zeros(n, np.int64)
        i = 0
        while i < n:
            # as many texts as fill a block; a longer text is a block of its own, cut where memory asks for it
            j, chars = i, 0
            while j < n and (j == i or chars + len(texts[j] or "") <= BLOCK):
                chars += len(texts[j] or "")
                j += 1
            codes, begins = squeezed(*letters([t or "" for t in texts[i:j]]), self.lookup)
            size[i:j] = np.diff(begins)
            if len(codes):
                for lo in range(0, len(codes), 4 * BLOCK):
                    hi = min(lo + 4 * BLOCK, len(codes))
                    first = max(0, lo - len(self.probs) + 1)
                    part = np.clip(begins, first, hi)
                    values = self.each(codes[first:hi], part - first)[lo - first :]
                    sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(values, axis=0, dtype=np.float64)))
                    part = np.clip(begins, lo, hi) - lo
                    total[i:j] += sums[part[1:]] - sums[part[:-1]]
            i = j
        known = size > 0
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        mean = -total / np.maximum(size, 1)[:, None]
        best = mean.argmin(1)
        low = mean[np.arange(n), best]
        share = 1 / np.exp(-(mean - low[:, None]) * np.minimum(size, 40)[:, None]).sum(1)
        over = low > self.limit[best] + 6 * np.sqrt(self.spread[best] / np.maximum(size, 1))
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0), ~known | over


def kneser_ney(key_counts: list[tuple[np.ndarray, np.ndarray]], base: int, union: list[np.ndarray], contexts: list[np.ndarray]) -> tuple[list, list, float]:
    """Of one language. key_counts: its n-grams by order, with counts (continuations below the highest order). Returns
    by order the log probabilities of the n-grams in union, by order from 2 the log weights of contexts, and the log
    probability of an unseen code."""
    flat = 1.0 / base
    probs, backs, below = [], [], None
    for n, (keys, counts) in enumerate(key_counts, 1):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        ctx = keys // np.uint64(base)
        own, at = np.unique(ctx, return_inverse=True)
        whole, kinds = np.bincount(at, counts), np.bincount(at)
        weight = discount * kinds / whole

        def of(asked, n=n, keys=keys, counts=counts, own=own, whole=whole, weight=weight, discount=discount, below=below):
            c = look(own, asked // np.uint64(base))
            k = look(keys, asked)
            shorter = below(asked % np.uint64(base ** (n - 1))) if below else np.full(len(asked), flat)
            direct = np.where(k >= 0, (counts[k] - discount) / whole[np.maximum(c, 0)], 0.0)
            return np.where(c >= 0, direct + weight[np.maximum(c, 0)] * shorter, shorter)

        probs.append(np.log(of(union[n - 1])))
        if n > 1:
            c = look(own, contexts[n - 2])
            backs.append(np.where(c >= 0, np.log(weight[np.maximum(c, 0)]), 0.0))
        else:
            floor = float(np.log(weight[0] * flat)) if len(weight) else float(np.log(flat))
        below = of
    return probs, backs, floor


def look(sorted_keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, asked)
    ok = at < len(sorted_keys)
    ok[ok] = sorted_keys[at[ok]] == asked[ok]
    return np.where(ok, at, -1)


def build(learn: dict[str, list[str]], lookup: np.ndarray, base: int, order: int) -> Model:
    """Model of the texts of each language, without limits."""
    langs, counts = list(learn), {}
    for k in langs:
        codes, begins = squeezed(*letters(learn[k]), lookup)
        highest = np.unique(grams(codes, begins, order, base), return_counts=True)
        counts[k] = [highest]
        for n in range(order - 1, 0, -1):  # an n-gram counts once for each code that it follows
            counts[k].insert(0, np.unique(counts[k][0][0] % np.uint64(base**n), return_counts=True))
    union = [np.unique(np.concatenate([counts[k][n][0] for k in langs])) if langs else np.zeros(0, np.uint64) for n in range(order)]
    contexts = [np.unique(u // np.uint64(base)) for u in union[1:]]
    made = [kneser_ney(counts[k], base, union, contexts) for k in langs]
    stack = lambda part, n: np.stack([m[part][n] for m in made], 1) if langs else np.zeros((0, 0))
    return Model(
        langs, lookup, base,
        [Table.of(union[n], stack(0, n)) for n in range(order)], [Table.of(contexts[n], stack(1, n)) for n in range(order - 1)],
        np.array([m[2] for m in made], np.float32),
    )


def small_language(texts: list[str], lookup: np.ndarray, base: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the codes of texts, each by a model of the others, and the index at which each text begins.
    A text that has no other is cut into halves."""
    parts = texts if len(texts) > 1 else [texts[0][: len(texts[0]) // 2], texts[0][len(texts[0]) // 2 :]]
    values, sizes = [], []
    for i, part in enumerate(parts):
        others = parts[:i] + parts[i + 1 :]
        if any(any(c.isalpha() for c in t) for t in others):
            codes, begins = squeezed(*letters([part]), lookup)
            values.append(build({"": others}, lookup, base, order).each(codes, begins)[:, 0])
            sizes.append(len(codes))
    return np.concatenate(values) if values else np.zeros(0), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def fit(samples: list[tuple[str, str]], order: int = ORDER, held_back: int = HELD_BACK) -> Model:
    """Model of (text, language) samples. Every held_back-th text of a language sets its limit instead of its counts; in
    languages of fewer than 2 * held_back texts all count, and each text is judged for the limit by a model of the others."""
    by = {}
    for text, lang in samples:
        by.setdefault(lang, []).append(text)
    langs = sorted(k for k, v in by.items() if any(any(c.isalpha() for c in t) for t in v))
    learn = {k: [t for i, t in enumerate(by[k]) if i % held_back or len(by[k]) < 2 * held_back] for k in langs}
    points = np.unique(np.concatenate([letters(v)[0] for v in learn.values()])) if langs else np.zeros(0, np.uint32)
    points = points[is_letter(points)] if len(points) else points
    base = len(points) + 2
    lookup = np.full(0x110000, OTHER, np.uint16 if base < 65536 else np.uint32)
    lookup[points] = np.arange(2, base)
    order = min(order, int(62 // np.log2(max(base, 2))))
    model = build(learn, lookup, base, order)
    model.limit, model.spread = np.zeros(len(langs)), np.zeros(len(langs))
    for i, k in enumerate(langs):
        values, begins = small_language(by[k], lookup, base, order) if len(by[k]) < 2 * held_back else (np.zeros(0), None)
        if not len(values):
            codes, begins = squeezed(*letters(by[k][::held_back]), lookup)
            values = model.each(codes, begins)[:, i]
        sums = np.concatenate(([0.0], np.cumsum(-values, dtype=np.float64)))
        size = np.diff(begins)
        means = ((sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(size, 1))[size >= 50]
        model.spread[i] = values.var()
        model.limit[i] = (means.max() if len(means) else -values.mean()) * SLACK
    return model


def training_sample(docs: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> DataFrame:
    """Of each language the texts distinct texts of the least hash, or all if it has fewer (those that share the last
    one's hash come on top). A text of more than chars characters gives chars of them, from a place that its hash says; with
    very many languages chars is less, by TOTAL_CHARS. A label takes a row of the driver and a part of a filter."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text", F.lit(3)).alias("u"))
    # Copies of one text share its hash: each counts once. Of a language only hashes that can be among the least are sorted.
    hashes = rows.select("lang", "u").distinct()
    share = F.col("u").cast("double") / float(1 << 64) + 0.5
    counts = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    low = hashes.join(counts, "lang").where((share * F.col("n") < 2.0 * texts + 100) | (F.col("n") <= texts))
    cuts = low.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("u"))).where(F.col("r") <= texts).groupBy("lang").agg(F.max("u").alias("cut"))
    # A row for each label comes to the driver and goes back as a literal: texts are filtered where they are read.
    found = cuts.collect()
    chars = min(chars, max(LEAST_CHARS, TOTAL_CHARS // (texts * max(len(found), 1))))
    most = [x for r in found for x in (F.lit(r["lang"]), F.lit(r["cut"]))]
    picked = rows.where(F.col("u") <= F.try_element_at(F.create_map(*most), F.col("lang"))) if most else rows
    begin = F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    return picked.withColumn("text", F.when(F.length("text") <= chars, F.col("text")).otherwise(F.substring("text", begin, F.lit(chars)))).select("lang", "text", "u").distinct()


def train(docs: DataFrame, **options) -> Model:
    """Model of the rows of docs (text, lang). The sample, TRAIN_TEXTS texts of a language or all that it has, of TRAIN_CHARS
    characters at most, comes to the driver."""
    rows = training_sample(docs, **options).collect()
    return fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.u, r.text))])


def identify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """Columns carry of docs, then lang_pred, score and rejected, from whole texts.

    Null texts, empty ones and those without a letter are und with score 0, and rejected. So is every text if the model
    has no language. Repeated rows are judged alike; an empty table gives no rows. A carried column named like a result
    gives way to it."""
    carry = [c for c in carry if c not in ("lang_pred", "score", "rejected")]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pred, score, rejected = held.value.judge(b["text"].tolist())
            yield b[carry].assign(lang_pred=pred, score=score, rejected=rejected)

    names = list(dict.fromkeys([*carry, "text"]))
    kinds = docs.select(*carry).schema if carry else None
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in (kinds.fields if kinds else [])] + ["lang_pred string", "score double", "rejected boolean"])
    return docs.select(*names).mapInPandas(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs, all their columns, that the model does not reject."""

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.judge(texts.tolist())[2])

    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.where(~rejected("text"))
