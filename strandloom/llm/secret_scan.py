"""Secret scan with parts that only mean something together, in DataFrame functions only.

Strong patterns are reported wherever they match. Weak candidates (a login name, a random-looking string, an endpoint) are
common in clean text; they are reported only when the parts that complete them lie within SCOPE characters: each span is the
interval that it and its scope cover, and a candidate is joined with the nearest identifier, secret and endpoint whose interval
it meets. As the nearest in each direction decides, that join is a running maximum of ends and a running minimum of starts over
a document's spans in order: no pairs are made, and a document with a million spans costs a million rows.

Texts are read once and never move; only lengths of matches and of the gaps between them leave the scan, no text of a secret."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import written

#: Code points between two parts of one credential, at most.
SCOPE = 200


def either(word: str) -> str:
    """A pattern of word in either case, ASCII letters alone, in any regular-expression dialect."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def assigned(names: str, value: str) -> str:
    return f"""({"|".join(either(n) for n in names.split("|"))})["']? *[:=] *["']?({value}+)"""


@dataclass(frozen=True)
class Kind:
    """A kind of span. A match counts from `least` characters on, those of its group if group is set; mixed asks for a
    digit and letters of both cases. needs: the roles that have to be in scope (strong kinds: none)."""

    name: str
    role: str
    pattern: str
    least: int
    group: int = 0
    mixed: bool = False
    needs: tuple[str, ...] = ()


# Patterns and least lengths of the strong kinds. [0-9a-f]{32,} has the matches of [0-9a-f]+ that are long enough.
KINDS = (
    Kind("assign", "secret", assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]"), 8, group=2),
    Kind("access", "identifier", "AKIA[A-Z0-9]+", 16),
    Kind("hex", "secret", "[0-9a-f]{32,}", 32),
    Kind("login", "identifier", assigned("user|username|user_?id|login|account|client_?id", "[A-Za-z0-9@._+-]"), 3, group=2, needs=("secret",)),
    Kind("key", "secret", "[A-Za-z0-9+/_-]{20,}={0,2}", 20, mixed=True, needs=("identifier",)),
    Kind("endpoint", "endpoint", "[A-Za-z][A-Za-z0-9+.-]{0,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 1, needs=("identifier", "secret")),
)
STRONG = tuple(k.name for k in KINDS if not k.needs)
ROLES = ("identifier", "secret", "endpoint")


def counts(kind: Kind, match: Column) -> Column:
    value = F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match
    long = F.length(value) >= kind.least
    return long & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]") if kind.mixed else long


def _matches(i: int, kind: Kind) -> Column:
    """Array of the matches m<i> of a kind in text t."""
    gaps = F.slice(F.split("t", kind.pattern, -1), F.lit(1), F.size(f"m{i}"))
    spans = F.zip_with(gaps, f"m{i}", lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), counts(kind, m).alias("ok")))
    named = F.transform(spans, lambda s, at: F.struct(F.lit(i).alias("kind"), at.alias("at"), s.gap.alias("gap"), s.len.alias("len"), s.ok.alias("ok")))
    return F.when(F.size(f"m{i}") > 0, named).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,len:int,ok:boolean>>"))


def found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found) for each row of docs: found has every match, in order within its kind, with the characters between it and the
    match before, its length and whether it counts."""
    text = F.coalesce("text", F.lit(""))
    matched = docs.select("doc_id", text.alias("t"), *(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias(f"m{i}") for i, k in enumerate(KINDS)))
    arrays = [_matches(i, k) for i, k in enumerate(KINDS)]
    return matched.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*arrays).alias("found"))


def linked(hits: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans of found() that are reported: row, doc_id, kind, name, start, end (code points), and near_identifier,
    near_secret, near_endpoint: (start, end) of the nearest such part in scope."""
    each = hits.where(F.size("found") > 0).select("row", "doc_id", F.explode("found").alias("f")).select("row", "doc_id", "f.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("at"))
    spans = each.withColumn("end", end).where("ok").select("row", "doc_id", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    roles = F.array(*(F.lit(k.role) for k in KINDS))
    spans = spans.withColumn("weak", F.col("kind") >= len(STRONG)).withColumn("role", F.get(roles, F.col("kind")))
    order = [F.col("start"), F.col("end"), F.col("kind")]
    before = W.partitionBy("row").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("row").orderBy(*(c.desc() for c in order)).rowsBetween(W.unboundedPreceding, -1)
    # A weak candidate that overlaps a strong span is reported as that already.
    left, right = F.max(F.when(~F.col("weak"), F.col("end"))).over(before), F.min(F.when(~F.col("weak"), F.col("start"))).over(behind)
    hidden = F.col("weak") & (F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False)))
    spans = spans.withColumn("hidden", hidden).where("NOT hidden").drop("hidden")
    for role in ROLES:
        of = F.col("role") == role
        spans = spans.withColumn(f"_l_{role}", F.max(F.when(of, F.struct("end", "start"))).over(before)).withColumn(f"_r_{role}", F.min(F.when(of, F.struct("start", "end"))).over(behind))
    for role in ROLES:
        l, r = F.col(f"_l_{role}"), F.col(f"_r_{role}")
        to_left, to_right = (F.when(c < 0, F.lit(0)).otherwise(c) for c in (F.col("start") - l.end, r.start - F.col("end")))  # null where there is none
        nearest = F.when(to_right.isNull() | (to_left <= to_right), F.when(to_left <= scope, F.struct(l.start.alias("start"), l.end.alias("end")))).otherwise(F.when(to_right <= scope, F.struct(r.start.alias("start"), r.end.alias("end"))))
        spans = spans.withColumn(f"near_{role}", nearest).drop(f"_l_{role}", f"_r_{role}")
    complete = ~F.col("weak")
    for i, kind in enumerate(KINDS):
        if kind.needs:
            both = F.lit(True)
            for role in kind.needs:
                both = both & F.col(f"near_{role}").isNotNull()
            complete = complete | ((F.col("kind") == i) & both)
    name = F.get(F.array(*(F.lit(k.name) for k in KINDS)), F.col("kind"))
    return spans.where(complete).select("row", "doc_id", "kind", name.alias("name"), "start", "end", *(f"near_{r}" for r in ROLES))


def credentials(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each span that is reported: see linked()."""
    return linked(written(found(docs), "op11-found"), scope).drop("row", "kind")


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Strong kinds (assign, access, hex) are those of their patterns, leftmost and without overlap within a kind; spans of two
    kinds may overlap. Weak ones (login, key, endpoint) need their complements in scope and no overlap with a strong one.
    spans lists kind:start:end by start, then kind; base_sha256 hashes that list of the strong kinds. Null and empty texts
    have no span; null doc_ids and repeated rows are rows like others. An empty table gives an empty result."""
    hits = written(found(docs), "op11-found")
    spans = linked(hits, scope)
    listed = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "kind", "end", "name"))).alias("s"))
    # Rows whose candidates all went come back here; spans never leave their row, so this joins few rows with few.
    some = hits.where(F.size("found") > 0).select("row", "doc_id").join(listed.select("row", "s"), "row", "left")
    rows = some.select("doc_id", "s").union(hits.where(F.size("found") == 0).select("doc_id", F.lit(None).cast(listed.schema["s"].dataType)))
    all_spans = F.coalesce("s", F.array().cast(listed.schema["s"].dataType))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")
    base = F.filter(all_spans, lambda x: x["kind"] < len(STRONG))
    n = lambda i: F.size(F.filter(all_spans, lambda x: x["kind"] == i)).cast("long")
    return rows.select("doc_id", *(n(i).alias(f"n_{name}") for i, name in enumerate(STRONG)), F.sha2(text(base), 256).alias("base_sha256"), text(all_spans).alias("spans"))
