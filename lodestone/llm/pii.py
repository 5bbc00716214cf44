"""Personal data in texts: base patterns, and further spans chosen by boosted trees. DataFrame functions only.

Base spans come from fixed patterns with checks (parts of an address, Luhn sums, counts of digits). High-recall generators
then propose overlapping candidates that the base leaves out: obfuscated mail addresses, telephone numbers without a plus,
card numbers in other groupings, IPv6 addresses. Gradient-boosted trees, fitted by Spark ML on a small table of labelled
spans, score a candidate from its format and the words around it; the trees are compiled into one column expression, so
scoring is a map without a shuffle. Each kind has its own threshold: above every negative of a calibration table, whose
formats and contexts are none of the training table's. Of candidates that overlap the best stays; those that touch a base span go.

Positions are code points, ends exclusive. Null and empty texts have no spans. Very long texts are read whole; patterns are
written so that no text makes them backtrack without bound. Repeated rows get equal results. Further columns of the input
stay, but for those named like a result. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The fixed patterns. Possessive repeats and look-behinds change no match; they keep the time in proportion to the text.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERN = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the pattern.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
GENERATOR = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{1,64}}+\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{{1,63}}+|\.[A-Za-z0-9-]{{1,63}}+){{1,8}}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{3,6}(?:[\x20./-]?[0-9]{2,6}){2,5}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2,6}(?![0-9])",
}
GENERATOR_HINT = {"email": r"[\[(](?:at|AT|@)[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{3}[\x20./-]?[0-9]{2}", "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2}"}
CONTEXT = {"email": r"(?i)mail|contact|write|reach|address", "ip": r"(?i)\bip|host|server|address|login", "card": r"(?i)card|visa|amex|mastercard|credit|pay", "phone": r"(?i)call|phone|tel|fax|mobile|contact|whatsapp|number"}
AGAINST = r"(?i)order|invoice|isbn|version|item|sku|ref\b|page|date|score|total|serial|batch|part"
#: Characters of context before and after a candidate.
BEFORE, AFTER = 24, 8
FEATURES = ("digits", "length", "share", "seps", "marks", "luhn", "context", "against", "groups", "first", "rest", "kind_no")


def found(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start,end,s>> of a pattern's matches, leftmost and not overlapping.

    The parts between the matches come from a split by the same pattern; running sums of lengths give the places.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(hits)), F.length).alias("gap"), hits.alias("s"))
    kind = "array<struct<start:int,end:int,s:string>>"
    empty = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s")))).alias("out"))

    summed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(hint)), summed).otherwise(empty)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes; every second digit from the right counts double."""

    def value(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = (F.length(d) - i) % 2 == 1
        return F.when(twice & (x > 4), 2 * x - 9).when(twice, 2 * x).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0)))
    return (F.length(d) > 0) & (total % 10 == 0)


def passes(kind: str, s: Column) -> Column:
    d = digits(s)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, PATTERN[kind], HINT[kind]), lambda x: passes(kind, x["s"]))


def of_kind(kind: str, spans: Column, *names: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), *(x[n].alias(n) for n in names)))


def features(kind: Column, s: Column, left: Column, right: Column) -> dict[str, Column]:
    d = digits(s)
    by_kind = lambda table: F.coalesce(*(F.when(kind == k, left.rlike(p)) for k, p in table.items()))
    groups = F.split(s, r"[^0-9]+")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "digits": F.length(d).cast("double"), "length": F.length(s).cast("double"), "share": F.length(d) / F.greatest(F.length(s), F.lit(1)), "seps": (F.length(s) - F.length(F.regexp_replace(s, r"[\x20()./-]", ""))).cast("double"),
        "marks": flag(s.rlike(r"[\[(](?:at|AT|@|dot|DOT)[\])]")), "luhn": flag(luhn(d)), "context": flag(by_kind(CONTEXT)), "against": flag(left.rlike(AGAINST)), "groups": F.size(groups).cast("double"),
        "first": F.length(groups[0]).cast("double"), "rest": flag(right.rlike(r"^[./-]?[0-9]")), "kind_no": F.coalesce(*(F.when(kind == k, F.lit(float(i))) for i, k in enumerate(KINDS))),
    }


# Templates by kind: what stands before a span, and spans; # stands for a digit, changing with the round.
GOOD = {
    "email": (["mail me: ", "contact ", "reach us at ", "", "address "], ["jane.doe [at] mail.example.org", "sales(at)example.com", "a.b [at] example [dot] net", "office(AT)sub.example.info"]),
    "ip": (["server ", "from host ", "ip ", "", "login from "], ["2001:0db8:85a3:#f00:0000:8a2e:0370:733#", "fe80:0:0:0:20#:ff:fe00:#", "2a02:#10:aaaa:b:c:d:e:f"]),
    "card": (["amex card ", "paid by credit card ", "visa ", "card number "], ["3782 822463 10005", "371449635398431", "4111.1111.1111.1111", "5105/1051/0510/5100", "30569309025904"]),
    "phone": (["call ", "tel. ", "phone: ", "my mobile number is ", "fax "], ["(555) 2##-01##", "555-2##-01##", "0## 2## 44##", "(0##) 44# 2###", "020 79## 0###"]),
}
BAD = {
    "email": (["see figure ", "token ", "in "], ["x(at)y.z", "q [at] 1.2", "f(at)0.5"]),
    "ip": (["at ", "time ", "lap "], ["12:30:45:11:22:33:44:55", "1:2:3:4:5:6:7:#", "00:01:02:03:04:05:06:07"]),
    "card": (["order ", "invoice ", "serial ", "in ", "the ", "version "], ["1234 5678 90## 12##", "20##-01-0# 11", "978-3-16-1484##-0", "49015420323751#", "100 200 3## 400", "0000 0000 00## 0000"]),
    "phone": (["order ", "date ", "score ", "page ", "of ", "in ", "item "], ["20##-0#-12", "12-0#-20##", "100 200 3##", "55-2##-01##", "10 20 30##", "1##/2##/3##"]),
}
#: For the thresholds: formats and contexts of which the trees have seen none.
GOOD_HELD = {
    "email": (["write to ", "e-mail "], ["john_smith [AT] corp.example [DOT] com", "help(at)support.example.co.uk"]),
    "ip": (["the server's address is ", "host: "], ["2620:0:2d0:#00:0:0:0:7", "fd12:3456:789a:1:#:2:3:4"]),
    "card": (["mastercard ", "to pay, use "], ["5555-5555-5555-4444", "6011 1111 1111 1117"]),
    "phone": (["whatsapp ", "contact: "], ["(212) 7##-4###", "069-1##-23##"]),
}
BAD_HELD = {
    "email": (["note ", "by "], ["n(at)k.m", "b [at] 9.9"]),
    "ip": (["from ", "split "], ["10:20:30:40:50:60:70:8#", "3:1:4:1:5:9:2:#"]),
    "card": (["ref ", "batch ", "about "], ["2222 3333 44## 55##", "1000-2000-30##", "35-209900-17614#-1"]),
    "phone": (["total ", "sku ", "near "], ["19##/1#/31", "31.1#.19##", "300-4##-50##"]),
}


def labelled(good: dict, bad: dict, offset: int = 1, rounds: int = 8) -> list[tuple[str, str, str, str, float]]:
    """(kind, left, span, right, label): a small table made from templates."""
    rows = []
    for label, table in ((1.0, good), (0.0, bad)):
        for kind, (lefts, spans) in table.items():
            for i, (a, s) in enumerate((a, s) for a in lefts for s in spans):
                for r in range(rounds):
                    n = offset + 7 * i + 13 * r
                    for at in [m.start() for m in re.finditer("#", s)]:
                        n = n * 31 + 7
                    span = re.sub("#", lambda _, it=iter(range(99)), n=n: str((n >> next(it)) % 10), s)
                    rows.append((kind, a, span, (" ", ", ", ".")[r % 3], label))
    return rows


def spans_table(spark: SparkSession, rows: list[tuple[str, str, str, str, float]]) -> DataFrame:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({', '.join(map(quote, r[:4]))}, {r[4]}D)" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t(kind, a, s, z, label)").coalesce(1)
    return df.select("kind", "label", *(c.alias(n) for n, c in features(F.col("kind"), F.col("s"), F.col("a"), F.col("z")).items()))


def compiled(model) -> callable:
    """The boosted trees as an expression: features by name to the probability of personal data."""
    trees, at = [], None
    for line in model.toDebugString.splitlines():
        if re.search(r"Tree \d+ \(weight", line):
            trees.append([])
        elif trees:
            trees[-1].append(line.strip())

    def node(lines: list[str], x: dict[str, Column]) -> Column:
        line = lines.pop(0)
        if m := re.match(r"Predict: (\S+)", line):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node(lines, x)
        lines.pop(0)  # Else
        return F.when(x[FEATURES[int(m[1])]] <= float(m[2]), yes).otherwise(node(lines, x))

    weights = list(model.treeWeights)

    def score(x: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for w, lines in zip(weights, trees, strict=True):
            total = total + w * node(list(lines), x)
        return 1 / (1 + F.exp(-2 * total))

    return score


def fitted(spark: SparkSession, trees: int = 12, depth: int = 3) -> tuple[callable, dict[str, float]]:
    """The scoring expression and each kind's threshold."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(spans_table(spark, labelled(GOOD, BAD)))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, seed=7).fit(rows)
    score = compiled(model)
    held = spans_table(spark, labelled(GOOD_HELD, BAD_HELD)).withColumn("p", score({n: F.col(n) for n in FEATURES}))
    worst = {r.kind: r.p for r in held.where("label = 0").groupBy("kind").agg(F.max("p").alias("p")).collect()}  # four rows
    return score, {k: max(0.5, min(0.95, worst.get(k, 0.5) + 0.02)) for k in KINDS}


def detect(df: DataFrame, text: str = "text", fit: tuple | None = None) -> DataFrame:
    """df with base (array of kind, start, end) and spans (base and added ones, in the order of kinds and starts)."""
    score, threshold = fit or fitted(df.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kind_struct = "array<struct<kind:string,start:int,end:int>>"
    base = F.concat(*(of_kind(k, base_spans(body, k), "start", "end") for k in KINDS))
    proposed = F.concat(*(of_kind(k, found(body, GENERATOR[k], GENERATOR_HINT[k]), "start", "end", "s") for k in KINDS))
    out = df.drop("base", "spans", "_proposed").withColumns({"base": base, "_proposed": proposed})
    free = F.filter("_proposed", lambda c: ~F.exists("base", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))

    def rated(c: Column) -> Column:
        left = F.substring(body, F.greatest(F.lit(1), c["start"] + 1 - BEFORE), F.least(c["start"], F.lit(BEFORE)))
        x = features(c["kind"], c["s"], left, F.substring(body, c["end"] + 1, F.lit(AFTER)))
        return F.struct((-score(x)).alias("cost"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))

    limit = lambda c: F.coalesce(*(F.when(c["kind"] == k, F.lit(t)) for k, t in threshold.items()))
    chosen = F.array_sort(F.filter(F.transform(free, rated), lambda c: -c["cost"] >= limit(c)))
    apart = F.aggregate(
        chosen, F.array().cast(kind_struct),
        lambda acc, c: F.when(F.exists(acc, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))),
    )
    order = lambda c: F.coalesce(*(F.when(c["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)))
    added = F.when(F.size("_proposed") > 0, apart).otherwise(F.array().cast(kind_struct))
    every = F.array_sort(F.transform(F.concat("base", added), lambda c: F.struct(order(c).alias("no"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    return out.withColumn("spans", F.transform(every, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).drop("_proposed")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", fit: tuple | None = None) -> DataFrame:
    """df with every span of its text replaced by the kind in brackets; null texts stay null. All other columns stay as
    they are, whatever their names; an empty table stays empty."""
    marked = detect(df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text")), "text", fit)
    by_start = F.array_sort(F.transform("spans", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))
    body = F.col("text")

    def step(acc: Column, c: Column) -> Column:
        end = -c["back"]
        inside = c["start"] < acc["at"]
        piece = F.concat(F.substring(body, acc["at"] + 1, c["start"] - acc["at"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    done = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    new = F.when(F.size("spans") > 0, done).otherwise(body)
    return marked.select(*(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns))
