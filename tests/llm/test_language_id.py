import math
import zlib
from collections import Counter

import numpy as np

from strandloom.llm import language_id as li


def test_probabilities_sum_to_one():
    m = li.fit([("the cat sat on the mat and the dog", "en"), ("le chat est sur la table et le chien", "fr"), ("\u65e5\u672c\u8a9e", "ja")] * 12)
    for ctx in ("the", "xq ", "\u65e5"):
        codes = [int(m.lookup[ord(c)]) if c != " " else 0 for c in ctx]
        total = sum(np.exp(m.each(np.array([*codes, n]), np.array([0, len(codes) + 1]))[-1].astype(float)) for n in range(m.base))
        assert np.allclose(total, 1, atol=1e-5)


def test_alone_or_together():
    m = li.fit([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 12)
    texts = ["the dog", "le chien", None, "", "123 !", "the " * 400_000]
    pred, score, rejected = m.judge(texts)
    assert pred[:6] == ["en", "fr", "und", "und", "und", "en"] and list(score[2:5]) == [0, 0, 0] and list(rejected[2:5]) == [True] * 3
    for t, p, s in zip(texts, pred, score, strict=True):
        q = m.judge([t])
        assert q[0][0] == p and abs(q[1][0] - s) < 1e-6


def test_rejects_what_fits_no_language():
    m = li.fit([("the cat sat on the mat and looked at the other cat for a long time", "en")] * 20)
    assert m.judge(["the other cat sat on the mat for a long time and looked", "zqxjk vwzqx qzzkj xxqvw jjqkx zzvvq kqxzj wvxqz"])[2].tolist() == [False, True]


def test_held_out_accuracy(spark):
    from strandloom.llm.queries import op3_language_id

    d = "/root/testdata/sf0.01"
    got = op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.rejected.mean() < 0.01


def test_odd_rows(odd, empty):
    m = li.train(odd)
    got = {(r.doc_id, r.lang_pred) for r in li.identify(odd, m, ["doc_id"]).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (7, "und"), (None, "und")} <= got and all(p in {"en", "fr", "de", "und"} for _, p in got)
    assert li.accepted(odd, m).columns == odd.columns and li.accepted(odd, m).where("doc_id in (2, 3, 4, 7)").count() == 0
    assert li.identify(empty, li.train(empty), ["doc_id"]).count() == li.accepted(empty, li.train(empty)).count() == 0


def test_copies_and_long_texts_leave_a_language_its_sample(spark):
    """Copies of one text take no place in the sample, and a language of long texts only is learned."""
    rows = [("copy of a text", "a")] * 5000 + [(f"own text number {i}", "a") for i in range(300)] + [(f"{i} " + "lang text " * 3000, "b") for i in range(3)]
    got = li.training_sample(spark.createDataFrame(rows, "text string, lang string"), 100, 2000).collect()
    by = {k: [r.text for r in got if r.lang == k] for k in "ab"}
    assert len(by["a"]) == 100 and len(by["b"]) == 3 and all(len(t) == 2000 for t in by["b"])


def test_small_languages_are_calibrated_by_texts_that_they_did_not_learn(spark):
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeiourstlnmkdpgbvz") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(12)]
    for n in (1, 2, 4):
        model = li.fit([(t, "x") for t in texts[:n]])
        assert not any(model.judge(texts[n:])[2])


class Brute:
    """Interpolated Kneser-Ney of one language, from its definition, with dictionaries."""

    def __init__(self, texts, order, letters):
        self.order, self.letters = order, letters
        self.counts = {n: Counter() for n in range(1, order + 1)}
        for t in texts:
            line = " " * (order - 1) + self.plain(t)
            for i in range(order - 1, len(line)):
                self.counts[order][line[i - order + 1 : i + 1]] += 1
        for n in range(order - 1, 0, -1):  # in how many ways an n-gram is continued to the left
            for gram in self.counts[n + 1]:
                self.counts[n][gram[1:]] += 1
        self.discount = {}
        for n, c in self.counts.items():
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def plain(self, text):
        """Letters lower-cased, runs of anything else one space, none at the beginning; letters that no language has are one."""
        out = ""
        for c in text.lower():
            if c.isalpha():
                out += c if c in self.letters else "?"
            elif out and out[-1] != " ":
                out += " "
        return out

    def probability(self, gram):
        n = len(gram)
        if not n:
            return 1 / (len(self.letters) + 2)
        same = {g: v for g, v in self.counts[n].items() if g[:-1] == gram[:-1]}
        shorter = self.probability(gram[1:])
        if not same:
            return shorter
        whole, d = sum(same.values()), self.discount[n]
        return max(same.get(gram, 0) - d, 0) / whole + d * len(same) / whole * shorter

    def logs(self, text):
        line = " " * (self.order - 1) + self.plain(text)
        return [math.log(self.probability(line[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(line))]


def test_probabilities_and_choice_against_the_definition():
    texts = {"en": ["the cat sat on the mat", "a hat, and the bat!", "that cat", ""], "de": ["der hund und die katze", "das ist der hut", "Über die Brücke"], "xx": ["\u043a\u043e\u0442 \u0438 \u043f\u0451\u0441", "\u043a\u043e\u0442"]}
    model = li.fit([(t, k) for k, ts in texts.items() for t in ts])
    letters = {c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha()}
    brute = {k: Brute(ts, li.ORDER, letters) for k, ts in texts.items()}
    asked = ["the hat", "der kater und", "\u043a\u043e\u0442 the", "zzz \u4e2d\u6587 the", "  12 und  der ", "a", "Brücke cat", "the cat sat on the mat"]
    for text in asked:
        codes, begins = li.squeezed(*li.letters([text]), model.lookup)
        got = model.each(codes, begins)
        want = np.array([brute[k].logs(text) for k in model.langs]).T
        assert got.shape == want.shape and np.allclose(got, want, rtol=2e-4, atol=2e-4), text
    chosen, scores, _ = model.judge(asked)
    for text, lang, score in zip(asked, chosen, scores):
        mean = {k: -np.mean(brute[k].logs(text)) for k in model.langs}
        assert mean[lang] <= min(mean.values()) + 1e-4
        n = min(len(brute[lang].plain(text)), 40)
        assert math.isclose(score, 1 / sum(math.exp(-(m - min(mean.values())) * n) for m in mean.values()), rel_tol=1e-2)


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    rows = [(None, "some words in a language", "en"), (1, "other words", "en"), (2, "and more", "en"), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    from strandloom.llm.queries import op3_language_id

    got = {r.doc_id: r.held_out for r in op3_language_id(spark, str(tmp_path)).collect()}
    assert got[None] is False and got == {None: False, **{i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3)}}
