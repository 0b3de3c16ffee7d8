import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from strandloom.llm import quality_rules as q
from strandloom.llm import queries, url_filter


def brute(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    times = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(ws) < 20 or 100 * len(again) > 30 * len(ws)


def test_odd_rows(odd, empty):
    from odd_rows import ODD

    got = q.quality_rules(odd).collect()
    assert sorted(((r.doc_id, *r[1:7]) for r in got), key=str) == sorted(((d, *brute(t)) for d, t, *_ in ODD), key=str)
    assert not any(r.kept and r.base_failed for r in got) and q.quality_rules(empty).count() == 0
    plan = q.quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_rules_are_data(spark):
    df = spark.createDataFrame([(1, "the " * 30 + "cat sat here with some other words to read today again my friend in peace")], "doc_id long, text string")
    strict = q.quality_rules(df, table=(q.Rule("long", "word_chars", "n_words", "most", 1.0),), base=()).first()
    assert not strict.kept and strict.failed_rules == "long"


URLS = [
    (1, "http://A.Example.NET/en/1?x#y"), (2, "https://net/"), (3, "http://net"), (4, "http://notnet/en/"), (5, None), (6, ""), (7, "no scheme/en/"), (8, "http://x.example.com/de/"), (9, "http://example.com/de"),
    (10, "http://a.org/fr/?q"), (10, "http://a.org/fr/?q"), (None, "http://a.b.c.d.org/fr/x"), (11, "ftp://net:80/"), (12, "http://example.net?/en/"), (13, "a://b://net/"),
]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = host.translate(str.maketrans(url_filter.UPPER, url_filter.UPPER.lower()))
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("rules", [url_filter.RULES, (("org", "/f", "block"), ("d.org", "/fr/x", "allow"), ("net", "", "block")), ()])
def test_urls(spark, monkeypatch, most, rules):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    df = spark.createDataFrame([(*x, "h", 1) for x in URLS], "page_id long, url string, host string, times int")
    got = sorted((tuple(r) for r in url_filter.url_filter(df, rules).collect()), key=str)
    assert got == sorted(((i, *brute_url(u, rules)) for i, u in URLS), key=str)
    assert url_filter.url_filter(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("name", list(queries.oracles()))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, d).toPandas(), con.execute(queries.oracles()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda f: sorted((tuple("" if pd.isna(v) else str(v) if not isinstance(v, float) else f"{v:g}" for v in r) for r in f[cols].astype(object).itertuples(index=False)), key=str)
    assert text(got) == text(want)
