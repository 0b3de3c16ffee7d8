"""Quality rules: a threshold table compiled into one projection, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import words

SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages that the rules are meant for; fixed values.
STOP_WORDS = (
    "the of and to in is that for with was on be as by at or it an are this from not have but "
    "der die das und in zu den mit von ist des dem nicht ein eine auf für im auch sich als es "
    "de la le et les des en un une du que est pour dans par sur il au plus pas avec ne ce "
    "el y los se del las por con para una su al lo como más o pero sus"
).split()
#: Words in a window that counts as repeated.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails if numerator > limit * denominator (most) or numerator < limit * denominator (least)."""

    name: str
    numerator: str
    denominator: str
    kind: str
    limit: float


#: Rules that every text has to pass.
BASE = (
    Rule("few_words", "n_words", "one", "least", 20),
    Rule("repeats", "n_repeat_words", "n_words", "most", 0.30),
)
#: The method's own rules.
TABLE = (
    Rule("too_long", "n_words", "one", "most", 10_000_000),
    Rule("short_words", "word_chars", "n_words", "least", 2.0),
    Rule("long_words", "word_chars", "n_words", "most", 14.0),
    Rule("symbols", "n_symbols", "n_words", "most", 1.0),
    Rule("stop_words", "n_stop_words", "n_words", "least", 0.01),
    Rule("same_lines", "n_dup_lines", "n_lines", "most", 0.50),
)


def failed(rule: Rule) -> Column:
    """Limits of base rules are whole hundredths, compared in whole numbers."""
    left, right = F.col(rule.numerator) * 100, F.col(rule.denominator) * F.lit(rule.limit * 100)
    if float(rule.limit * 100).is_integer():
        right = F.col(rule.denominator) * F.lit(int(rule.limit * 100))
    return left > right if rule.kind == "most" else left < right


def signals(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """docs' doc_id with the counts that rules compare. Windows are compared by 64-bit hashes within their text."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", text.alias("t"), words(text).alias("ws")).withColumn("n_words", F.size("ws"))
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("ws", i, WINDOW)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = cut.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("ws", "")).alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        lines.alias("lines"),
        F.size(F.filter("ws", lambda w: F.lower(w).isin(*stop_words))).alias("n_stop_words"),
        F.when(F.col("n_words") > WINDOW, windows).alias("hs"),
    )
    two = one.withColumn("again", F.size(F.array_distinct("hs")) < F.size("hs")).withColumn(
        "sorted", F.when(F.col("again"), F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    twice = F.filter(
        F.transform(
            "sorted",
            lambda x, k: F.when(
                F.coalesce(F.get("sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("sorted", k + 1)["h"] == x["h"], F.lit(False)), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    three = two.withColumn("at", F.when(F.col("again"), F.sort_array(twice)))
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    count = lambda c: c.cast("long")
    return three.select(
        "doc_id",
        *[count(F.col(c)).alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        count(F.col("n_stop_words")).alias("n_stop_words"),
        count(F.size("lines")).alias("n_lines"),
        F.lit(1).cast("long").alias("one"),
    )


def quality_rules(docs: DataFrame, table=TABLE, base=BASE, stop_words=STOP_WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike; an empty table gives no
    rows. A text of any length is judged whole, in its own row: there is no shuffle."""
    judged = signals(docs, stop_words)
    named = lambda rules: F.filter(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    bad = F.lit(False)
    for r in base:
        bad = bad | failed(r)
    own = F.lit(False)
    for r in table:
        own = own | failed(r)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        bad.alias("base_failed"), (~bad & ~own).alias("kept"), F.array_join(named([*base, *table]), ",").alias("failed_rules"),
    )
