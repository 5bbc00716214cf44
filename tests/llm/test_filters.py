"""Toxicity, personal data and URL filters: brute force on small tables, and held-out accuracy."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import pii, toxicity, urls
from lodestone.llm.common import remainder

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, s: str) -> bool:
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute_spans(text: str | None) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def mixed_texts() -> list[str | None]:
    rng = random.Random(9)
    bits = ["a@b.c", "@", ".", "+49 (30) 1234-567", "+1", "10.0.0.255", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "6011000990139424", "0", "7", " ", "-", "é", "\U0001d4b3", "x_y%z@w-w.co.uk.", "\n", "(", ")", "mail: jo [at] example [dot] org", "call 555-210-0123", "fe80:0:0:0:202:ff:fe00:1", "a@b@c.d"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    return [*out, None, "", "nothing here", "9" * 3000, "a" * 50_000 + "@", "é " * 30_000 + "me@example.org", "1." * 2000]


def test_base_spans(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(mixed_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, spans string")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    for i, t, *_ in rows:
        want = brute_spans(t) if t is None or len(t) < 10_000 or "me@" in t else []
        assert [tuple(s) for s in got[i].base] == want
        spans = [tuple(s) for s in got[i].spans]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        added = [s for s in spans if s not in want]
        for a in added:  # what the trees add overlaps nothing
            assert all(b is a or a[2] <= b[1] or b[2] <= a[1] for b in spans)
    assert pii.detect(df.limit(0)).collect() == []


def test_trees_add_and_leave(spark):
    texts = ["mail me: jane.doe [at] mail.example.org today", "amex card 3782 822463 10005 ok", "call 555-210-0123 now", "server 2001:0db8:85a3:1f00:0000:8a2e:0370:7334 up", "order 1234 5678 9012 1200 shipped", "date 2024-01-02 is fine"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.detect(df).collect()}
    assert got == {0: ["email"], 1: ["card"], 2: ["phone"], 3: ["ip"], 4: [], 5: []}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "\U0001d4b3 me@x.org, +49 30 123456!", "s"), (2, None, "s"), (3, "plain", None), (4, "", "s")], "doc_id long, text string, spans string")
    out = pii.redact(df)
    assert out.columns == ["doc_id", "text"] or out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "\U0001d4b3 [EMAIL], [PHONE]!", 2: None, 3: "plain", 4: ""}


def brute_url(url: str | None) -> tuple:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host, tail = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
        path = re.match(r"(?s)[^?#]*", tail)[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    rng = random.Random(4)
    bits = ["http://", "://", "Example.org", "www.example.org", "org", "a.com", "/es/", "/en/1", "/fr/", "/de/x", "?q=://", "#", "/", "notexample.org", "Ä.net"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "https://EXAMPLE.ORG/en/12"), (904, "x" * 50_000), (905, "http://b.org/\n?"), (900, None)]
    df = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "page_id long, url string, host string, p_block double")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))
    assert urls.judge(df.limit(0)).collect() == []


def test_url_regression_generalises(spark):
    good, bad = ["city-library.net", "www.historymuseum.com", "schoolmaps.example.net"], ["big-casino-bonus.net", "cheap-viagra-pills.com", "m.poker-bets.example.com"]
    df = spark.createDataFrame([(f"http://{h}/x",) for h in good + bad], "url string")
    assert {r.host: r.verdict for r in urls.judge(df).collect()} == {**dict.fromkeys(good, "allow"), **dict.fromkeys(bad, "block")}


CLEAN = ["the river runs past the old mill", "she said the garden is lovely", "nobody was there on monday", "they built a bridge over it", "we read a book about stars"]
TOXIC = ["you are a stupid idiot", "people like you are scum. you moron", "i will destroy you", "what a worthless loser you are"]


def labelled(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(240):
        toxic = i % 3 == 0
        rows.append((i, ". ".join(rng.choice(CLEAN) for _ in range(6)) + (". " + rng.choice(TOXIC) if toxic else ""), 1.0))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_a_small_table(spark):
    docs, labels = labelled(spark)
    lexicon, weights = toxicity.fit(toxicity.training_rows(docs, labels))
    got = toxicity.score(docs, lexicon, weights).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got)
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.95 * len(got)


def test_toxicity_reads_clauses():
    g = toxicity.Grammar()
    weight = lambda s: sum(g.clause([g.read[w] for w in toxicity.WORD.findall(c)]) for c in toxicity.CLAUSE.split(s.lower()))
    assert weight("you are an idiot") > weight("an idiot") > weight("you are not an idiot") > 0
    assert weight("he said you are an idiot") < weight("you are an idiot")
    assert weight("i will kill you") > weight("i will kill time") > 0
    assert weight("i will not kill you") == 0
    assert weight("the river. the mill") == 0


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "the mill " * 20_000), (4, "you are an idiot, you moron. you are scum"), (None, "you"), (4, "you are an idiot, you moron. you are scum")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon, weights = toxicity.fit(toxicity.training_rows(docs, none))
    got = toxicity.score(docs, lexicon, weights).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id == 4} == {1} and {r.predicted for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert toxicity.score(docs.limit(0), lexicon, weights).collect() == []


def test_toxicity_held_out(spark):
    from pathlib import Path

    d = "/root/testdata/sf0.1"  # the smaller tables hold too few toxic documents for a measure
    if not Path(d).is_dir():
        pytest.skip("the test tables are not here")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    lexicon, weights = toxicity.fit(toxicity.training_rows(docs.select("doc_id", "text"), labels))
    held = docs.where(remainder("doc_id", 3) == 1).select("doc_id", "text").join(labels, "doc_id").select("text", "toxic")
    got = toxicity.score(held, lexicon, weights).collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc >= 0.9 and sum(x >= 0.7 for x in neg) <= 0.01 * len(neg)


def test_added_spans_of_unseen_formats(spark):
    """Precision and recall on formats and contexts of neither the training nor the calibration table."""
    good = {"email": (["please mail ", "you can reach "], ["mary.jones (at) city-example.org", "dev [at] tools.example [dot] io"]), "ip": (["blocked ip ", "node "], ["2001:db8:#:1:2:3:4:5"]), "card": (["charge my visa ", "credit card: "], ["4012 8888 8888 1881", "3714-496353-98431"]), "phone": (["please call ", "office phone "], ["(030) 12#-45##", "0171 2## 88##"])}
    bad = {"email": (["value "], ["p(at)q.r", "i [at] 2.0"]), "ip": (["clock "], ["23:59:58:57:56:55:54:5#"]), "card": (["part ", "isbn "], ["7777 8888 99## 11##", "978-0-306-40615-#"]), "phone": (["scores ", "version "], ["200-3##-40##", "20##.1#.05"])}
    score, threshold = pii.fitted(spark)
    rows = pii.spans_table(spark, pii.labelled(good, bad, 3)).withColumn("p", score({n: F.col(n) for n in pii.FEATURES})).toPandas()
    hit, label = rows.p >= rows.kind.map(threshold), rows.label == 1
    assert (hit & label).sum() >= 0.95 * hit.sum() and (hit & label).sum() >= 0.9 * label.sum()


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", "x", 5, None), (2, None, "y", 6, "z"), (3, "", None, None, None)], "doc_id long, text string, base string, spans int, row string")
    got = sorted(map(tuple, pii.redact(df).collect()))
    assert got == [(1, "mail [EMAIL] now", "x", 5, None), (2, None, "y", 6, "z"), (3, "", None, None, None)]
    assert pii.redact(df.limit(0)).collect() == [] and pii.redact(df).columns == df.columns
