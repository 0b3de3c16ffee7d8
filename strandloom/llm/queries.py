"""Queries of this subpackage for __spark_entry__.py, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import byte_bpe, exact_dedup, language_id, line_dedup, merkle, mixing, prefix_trie, quality_rules, secret_scan, simhash, substring_dedup, token_blocks, url_filter
from strandloom.llm.common import UPPER, WORD, documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_blocks(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a doc_id is not held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("failed_rules")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the lines that stay (null text: null)."""
    cut = line_dedup.line_dedup(documents(spark, sf_dir))
    return cut.select("doc_id", F.col("n_lines_before").alias("n_lines"), "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_token_blocks, op3_language_id, op4_byte_bpe, op5_mix_sources, op6_simhash_near_dedup, op7_quality_rules, op8_url_filter, op9_line_dedup, op10_substring_dedup, op11_secret_scan, op12_merkle_manifest, op13_prefix_trie, pipeline)}


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    bad = lambda rules: " OR ".join(f"{r.numerator} * 100 {'>' if r.kind == 'most' else '<'} {r.denominator} * {r.limit * 100:.0f}" for r in rules)
    n = quality_rules.WINDOW
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {n - 2})) AS i, ws FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + {n - 1}]) AS times FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range({n}) AS o(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[{quality_rules.SYMBOLS}]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(ls) AS n_lines, 1 AS one
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, {bad(quality_rules.BASE)} AS base_failed, {bad(quality_rules.TABLE)} AS own_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT own_failed AS kept FROM b
"""


def _url_sql() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return f"""
WITH r(h, p, v) AS (VALUES {rows}),
s AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT u.page_id, u.host, u.path, max(struct_pack(n := length(r.h || r.p), k := length(r.h), rule := r.h || r.p, v := r.v)) AS best
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY ALL)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM m
"""


def _mix_sql() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH s AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws('|', '42', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS u FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM s GROUP BY source),
w AS (SELECT *, ([{weights}])[k % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w FROM n),
r AS (SELECT *, {mixing.REPEATS} * n / w AS r FROM w),
o AS (SELECT *, row_number() OVER f AS p, ({mixing.SHARE} * (SELECT sum(n) FROM n) - (sum({mixing.REPEATS} * n) OVER f - {mixing.REPEATS} * n))::DOUBLE / ((SELECT sum(w) FROM w) - (sum(w) OVER f - w)) AS unit FROM r WINDOW f AS (ORDER BY r, k)),
t AS (SELECT source, n, CASE WHEN r < x.unit THEN ({mixing.REPEATS} * n)::DOUBLE ELSE w * x.unit END AS target FROM r, (SELECT coalesce(min_by(unit, p), 1e300) AS unit FROM o WHERE r >= unit) x),
c AS (SELECT s.*, t.n, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER () AS row FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT row, size, u, doc_id, (upto + k * n)::DOUBLE / target AS v FROM c, range({mixing.REPEATS}) x(k) WHERE size > 0),
f AS (SELECT row, sum(size) OVER (ORDER BY v, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM e),
g AS (SELECT row, count(*) AS copies FROM f WHERE upto <= (SELECT floor(sum(target) + 1e-6) FROM t) GROUP BY row)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target, size * coalesce(copies, 0) AS taken, source, coalesce(copies, 0)::INTEGER AS copies FROM c LEFT JOIN g USING (row)
"""


def _substring_sql() -> str:
    n = substring_dedup.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {substring_dedup.LAST}) AS did, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (SELECT r, did, length(hx) // 2 AS n, b, substr(hx, 2 * b + 1, {2 * (256 + n)}) AS t FROM d, LATERAL (SELECT unnest(range(0, length(hx) // 2 - {n - 1}, 256)) AS b)),
w AS (SELECT r, did, b + j AS i, substr(t, 2 * j + 1, {2 * n}) AS s FROM c, range(256) o(j) WHERE b + j <= n - {n}),
m AS (SELECT r, i FROM (SELECT r, did, i, min(did) OVER (PARTITION BY s) AS first FROM w) WHERE first < did),
g AS (SELECT r, i, sum(CASE WHEN i <= before + {n} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM m)),
p AS (SELECT r, min(i) AS s, max(i) + {n} AS e FROM g GROUP BY r, g),
k AS (SELECT p.r, p.s, p.e, substr(hx, 2 * lag(p.e, 1, 0) OVER o + 1, 2 * (p.s - lag(p.e, 1, 0) OVER o)) AS part FROM p JOIN d USING (r) WINDOW o AS (PARTITION BY p.r ORDER BY p.s)),
a AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(part, '' ORDER BY s) AS parts, max(e) AS upto FROM k GROUP BY r)
SELECT doc_id, length(hx) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(parts || substr(hx, 2 * upto + 1), hx))) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    bit = "list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), lambda c, b: {bit}), 4294967295)"


def _secret_sql() -> str:
    kinds = secret_scan.KINDS
    q = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT r, {i} AS kind, regexp_extract_all(t, {q(k.pattern)}) AS ms, string_split_regex(t, {q(k.pattern)}) AS gs FROM d" for i, k in enumerate(kinds))
    mixed = "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"
    counts = " ".join(f"WHEN {i} THEN length(regexp_extract(m, {q(k.pattern)}, {k.group})) >= {k.least}" + (f" AND {mixed}" if k.mixed else "") for i, k in enumerate(kinds))
    pick = lambda f: f"[{', '.join(repr(f(k)) for k in kinds)}][kind + 1]"
    near = lambda role: f"EXISTS (SELECT 1 FROM w o WHERE o.r = w.r AND o.role = '{role}' AND (o.kind, o.s, o.e) <> (w.kind, w.s, w.e) AND greatest(o.s - w.e, w.s - o.e) <= {secret_scan.SCOPE})"
    weak = " OR ".join(f"kind = {i} AND {' AND '.join(map(near, k.needs))}" for i, k in enumerate(kinds) if k.needs)
    n = len(secret_scan.STRONG)
    listed = lambda rule: f"coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({rule}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
m AS (SELECT r, kind, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS k FROM f),
p AS (SELECT r, kind, m, sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY k)::BIGINT AS e FROM m),
s AS (SELECT r, kind, e - length(m) AS s, e FROM p WHERE CASE kind {counts} END),
w AS (SELECT *, {pick(lambda k: k.name)} AS name, {pick(lambda k: k.role)} AS role FROM s WHERE kind < {n} OR NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.kind < {n} AND o.s < s.e AND s.s < o.e)),
x AS (SELECT * FROM w WHERE kind < {n} OR {weak})
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secret_scan.STRONG))},
  sha256({listed(f"kind < {n}")}) AS base_sha256, {listed("kind >= 0")} AS spans FROM d LEFT JOIN x USING (r) GROUP BY r
"""


def _merkle_sql() -> str:
    f, levels = merkle.FANOUT, 8
    value = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in merkle.FIELDS) + ")"

    def tree(n: str, first: str) -> str:
        up = [f"{n}0 AS ({first})"]
        up += [f"{n}{k + 1} AS (SELECT g, i // {f} AS i, (n + {f - 1}) // {f} AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {n}{k} WHERE n > 1 GROUP BY ALL)" for k in range(levels)]
        up += [f"{n}r{k} AS (SELECT g, i // {f} AS p, list(h ORDER BY i) AS hs FROM {n}{k} WHERE n > 1 GROUP BY ALL)" for k in range(levels)]
        return ", ".join(up) + f", {n}t AS (" + " UNION ALL ".join(f"SELECT g, h FROM {n}{k} WHERE n = 1" for k in range(levels + 1)) + ")"

    def way(n: str, name: str, source: str) -> str:
        """Adds the siblings of each level to ps and folds fold, from source (g, i, ps, fold)."""
        out, last = [], source
        for k in range(levels):
            place = f"(i // {f**k} % {f})::INTEGER"
            old, new = f"array_to_string(hs[1:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
            out.append(f"{name}{k} AS (SELECT a.* REPLACE (CASE WHEN hs IS NULL THEN ps ELSE ps || {old} || {new} END AS ps, CASE WHEN hs IS NULL THEN fold ELSE sha256({old} || fold || {new}) END AS fold) FROM {last} a LEFT JOIN {n}r{k} b ON a.g = b.g AND a.i // {f ** (k + 1)} = b.p)")
            last = f"{name}{k}"
        return ", ".join(out)

    return f"""
WITH l AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf("text")} AS h, CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS changed FROM documents),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
{tree("m", "SELECT g, i, n, h FROM z")},
{tree("o", "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM mt")},
s AS (SELECT g AS source, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM mt),
w AS (SELECT doc_id, g, i, h, '' AS ps, coalesce(changed, h) AS fold FROM z),
{way("m", "u", "w")},
v AS (SELECT u.doc_id, u.h AS leaf, s.h AS subroot, s.g, s.i, u.ps, u.fold FROM u{levels - 1} u JOIN s ON u.g = s.source),
{way("o", "y", "v")}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(ps) AS proof_sha256, fold AS folded_root, fold = t.h AS verified FROM y{levels - 1}, ot t
"""


def _trie_sql() -> str:
    none = "''"
    return f"""
WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {prefix_trie.FAMILY} AS b, {_crc32_sql("conv_id::VARCHAR")} % {prefix_trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
x AS (SELECT c.conv_id, 0 AS part, k, d, s FROM c JOIN o ON o.conv_id = c.b AND k <= h UNION ALL SELECT c.conv_id, 1, k, d, s FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
y AS (SELECT conv_id, s, row_number() OVER w AS depth, string_agg(d, '') OVER w AS key FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
p AS (SELECT conv_id, depth, sha256(key) AS key, coalesce(sha256(lag(key) OVER (PARTITION BY conv_id ORDER BY depth)), sha256('')) AS parent, s, max(depth) OVER (PARTITION BY conv_id) AS len FROM y
  UNION ALL SELECT conv_id, 0, sha256(''), NULL, 0, coalesce((SELECT max(depth) FROM y WHERE y.conv_id = c.conv_id), 0) FROM c),
n AS (SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(s) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), {none})) AS ends_sha256 FROM p GROUP BY key, depth),
k AS (SELECT parent, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.key),
u AS (SELECT p.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(m.own)::BIGINT AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.key)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256 FROM m JOIN u USING (key) LEFT JOIN n q ON q.key = m.parent
"""


def oracles() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""",
        "op5_mix_sources": _mix_sql(),
        "op7_quality_rules": _quality_sql(),
        "op8_url_filter": _url_sql(),
        "op10_substring_dedup": _substring_sql(),
        "op11_secret_scan": _secret_sql(),
        "op12_merkle_manifest": _merkle_sql(),
        "op13_prefix_trie": _trie_sql(),
    }
