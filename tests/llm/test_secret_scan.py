"""The scan against Python's re and a loop over all spans."""

import hashlib
import random
import re

from strandloom.llm import secret_scan
from strandloom.llm.secret_scan import KINDS, SCOPE, STRONG

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = {
    "assign": lambda t: [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 8],
    "access": lambda t: [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
    "hex": lambda t: [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32],
}


def expected(doc_id, text):
    t = text or ""
    spans = [(s, i, e) for i, k in enumerate(STRONG) for s, e in BASE[k](t)]
    strong = list(spans)
    weak = []
    for i, k in enumerate(KINDS[len(STRONG) :], len(STRONG)):
        for m in re.finditer(k.pattern, t):
            value = m[k.group]
            if len(value) >= k.least and (not k.mixed or all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))):
                if not any(s < m.end() and m.start() < e for s, _, e in strong):
                    weak.append((m.start(), i, m.end()))
    for s, i, e in weak:
        near = {KINDS[j].role for a, j, b in strong + weak if (a, j, b) != (s, i, e) and max(a - e, s - b) <= SCOPE}
        if set(KINDS[i].needs) <= near:
            spans.append((s, i, e))
    spans.sort()
    name = lambda x: f"{KINDS[x[1]].name}:{x[0]}:{x[2]}"
    base = [x for x in spans if x[1] < len(STRONG)]
    return (doc_id, *(sum(x[1] == i for x in base) for i in range(len(STRONG))), hashlib.sha256(",".join(map(name, base)).encode()).hexdigest(), ",".join(map(name, spans)))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(odd, empty):
    assert got(secret_scan.secret_scan(odd)) == sorted((expected(r.doc_id, r.text) for r in odd.collect()), key=str)
    assert secret_scan.secret_scan(empty).count() == 0


PARTS = ["AKIA" + "AB12CD34EF56", "AKIAX", "token='", "password = ", "PassWd:", "api-key=", "api_key=abcdefgh", "SecretK=12345678", "toKen=12345678", "user=", "login: bob", "client_id=", "12345678", "abc", "0123456789abcdef" * 2, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "https://db.example.com:5432/x", "s3://b", "//", " ", "\n", " word" * 30, "é" * 7, "=" * 5, "'", '"', "\U0001f600"]


def test_random_texts(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(PARTS) + rnd.choice(["", " "]) for _ in range(rnd.choice([2, 6, 20, 60])))) for i in range(300)]
    rows += [(1000, "login: bob " + "x" * 300 + " key wJalrXUtnFEMIK7MDENGbPxRfi"), (1001, ("token=abcdefgh1 " * 5000) + "AKIA" * 20000), (1002, "x" * 200_000 + "://"), (1003, "token" + " " * 200_000)]
    out = got(secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert out == sorted((expected(*r) for r in rows), key=str)
    assert sum("key:" in r[-1] for r in out) > 20 and sum("endpoint:" in r[-1] for r in out) > 20


def test_weak_parts_need_each_other(spark):
    key, url = "wJalrXUtnFEMIK7MDENGbPxRfi", "https://db.example.com/x"
    texts = [key, url, "login: bob", f"login: bob {key}", f"login: bob {key} {url}", f"login: bob {url}", f"login: bob {'-' * 50} {'. ' * SCOPE} {key}"]
    rows = secret_scan.credentials(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.name) for r in rows) == [(3, "key"), (3, "login"), (4, "endpoint"), (4, "key"), (4, "login")]
    by = {(r.doc_id, r.name): r for r in rows}
    assert tuple(by[4, "endpoint"].near_identifier) == (0, 10) and tuple(by[3, "login"].near_secret) == (11, 37)


def test_plan_has_no_python(spark):
    plan = secret_scan.secret_scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
