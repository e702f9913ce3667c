"""Personal data: fixed-format spans, and more that boosted trees choose among high-recall candidates.

Base spans are leftmost non-overlapping matches per kind that pass the kind's check. Candidate generators
propose further, overlapping spans: written-out and bracketed addresses, dotted and spaced digit groups,
numbers without a plus. Trees score a candidate by its format (digits, groups, separators, checksum) and
its context (neighbouring characters, hint words before it).

The base formats say what personal data is, not what the trees are to find, so they make the examples: a base
span of the documents is rewritten in a format that no base pattern matches (``REWRITES``) and
put back between its neighbours; a candidate that is the rewritten span is a positive. Rewritten spans with a
false checksum, octet or length, and all candidates of the documents themselves that touch no base span, are
negatives. Per kind, the threshold is the least score at which documents held out of the fit keep the target
precision. Chosen candidates that overlap no base span are added, of overlapping ones the better.

Only built-in column functions are used. Offsets are code points, ends exclusive. Places come from the lengths of
the pieces between matches and overlaps from sorted spans, by running folds over chunks, so that a text of very
many matches costs little more than in proportion; only the choice among overlapping added spans is quadratic in these.

Cases: a null or empty text has no spans; very long runs of digits or address characters are read once
(possessive patterns, starts only at a run's start); a text of very many matches is handled like any other;
repeated rows agree, and count once in the fit; an empty table gives no rows; where the documents have no span of a kind,
no candidate of it is added.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multirun.llm import gbt

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.95
#: Characters of context before a candidate, and kept on either side of a rewritten span.
CONTEXT, AROUND = 24, 60
#: Spans in a chunk of a growing array.
CHUNK = 64

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base formats, written so that each start is tried once: a match starts at a run's start or where the last one ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?: ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?)[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]| \. )[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00|\()?[0-9][0-9() ./-]{7,22}[0-9](?![0-9A-Za-z])",
}
#: Words that announce each kind (fixed values).
HINTS = {"email": "mail|contact|write", "ip": "ip|server|host|addr", "card": "card|visa|pay|credit", "phone": "phone|tel|call|fax|mobile"}
FEATURES = ["kind", "digits", "length", "groups", "plus", "checksum", "letter_before", "letter_after", "hint", "marks", "octets", "distinct"]
_IP = r"^(0*+(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])|0++)$"


SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def grown(items: Column, kind: str, start: dict[str, Column], step) -> Column:
    """Folds an array into another one. ``step(state, x)`` gives the new state and what is put out, or null.

    What is put out goes to a chunk, and full chunks to a list of chunks. A step copies what it holds, so this is for short arrays.
    """
    none = F.lit(None).cast(kind)
    last, full = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    zero = F.struct(full.alias("full"), last.alias("last"), *(v.alias(k) for k, v in start.items()))

    def one(acc, x):
        state, out = step({k: acc[k] for k in start}, x)
        out = F.coalesce(out, none)
        more = F.when(out.isNull(), acc["last"]).otherwise(F.concat(acc["last"], F.array(out)))
        whole = F.size(acc["last"]) >= CHUNK
        return F.struct(
            F.when(whole, F.concat(acc["full"], F.array(acc["last"]))).otherwise(acc["full"]).alias("full"),
            F.when(whole, F.when(out.isNull(), last).otherwise(F.array(out))).otherwise(more).alias("last"), *(state[k].alias(k) for k in start),
        )

    return F.aggregate(items, zero, one, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["last"]))))


def let(x: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is used."""
    return F.transform(F.array(x), body)[0]


def running(items: Column, fold, zero: Column) -> Column:
    """The fold of all items before each one: folds of chunks first, then inside each chunk, so that no step copies an array."""

    def of(a):
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / CHUNK).cast("int")), lambda j: F.slice(a, j * CHUNK + 1, F.lit(CHUNK)))
        inside = lambda c, start: F.transform(c, lambda x, i: F.aggregate(F.slice(c, F.lit(1), i), start, fold))
        each = lambda cs: let(
            F.transform(cs, lambda c: F.aggregate(c, zero, fold)), lambda sums: F.flatten(F.transform(cs, lambda c, j: let(F.aggregate(F.slice(sums, F.lit(1), j), zero, fold), lambda start: inside(c, start))))
        )
        return let(chunks, each)

    return let(items, of)


def found(text: Column, pattern: str, guard: str) -> Column:
    """Matches as an array of SPAN, with the characters around them up to the next match: the pieces between matches give the places."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(gaps):
        pairs = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("h"), F.slice(gaps, 2, F.size(gaps)).alias("n"))

        def placed(p):
            at = running(F.transform(p, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))), lambda a, x: a + x, F.lit(0))

            def one(x):
                s = x["at"] + F.length(x["p"]["g"])
                return F.struct(
                    s.alias("s"), (s + F.length(x["p"]["h"])).alias("e"), x["p"]["h"].alias("m"), F.right(x["p"]["g"], F.lit(AROUND)).alias("before"),
                    F.left(x["p"]["n"], F.lit(AROUND)).alias("after"),
                )

            return F.filter(F.transform(F.arrays_zip(p.alias("p"), at.alias("at")), one), lambda x: x["m"].isNotNull())

        return F.when(F.size(gaps) > 1, let(pairs, placed).cast(f"array<{SPAN}>")).otherwise(none)

    return F.when(text.rlike(guard), let(F.split(text, pattern, -1), spans)).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of at most 19 digits passes the card checksum."""
    n = F.length(d)
    at = lambda i: F.substring(d, n - i + 1, F.lit(1)).cast("int")
    twice = lambda i: F.when(at(i) * 2 > 9, at(i) * 2 - 9).otherwise(at(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(i)).otherwise(at(i)))
    return total % 10 == 0


def _octets(m: Column) -> Column:
    parts = F.split(F.regexp_replace(m, r"[\[\] ]", ""), r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(_IP))


def valid(kind: str, m: Column) -> Column:
    d = digits(m)
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    guard = {"email": "@"}
    check = lambda k: lambda x: valid(k, x["m"])
    return {k: F.filter(found(text, p, guard.get(k, "[0-9]")), check(k)) for k, p in BASE.items()}


CANDIDATE_SPAN = "struct<s:int,e:int,k:int,m:string,before:string,after:string>"
SCORED = "struct<s:int,e:int,k:int,p:double>"


def candidates(text: Column) -> Column:
    """All proposals as an array of CANDIDATE_SPAN, ``k`` the kind's place in KINDS."""
    guard = {"email": r"@|\[at\]|\(at\)| at "}
    named = lambda i: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("k"), *(x[c].alias(c) for c in ("m", "before", "after")))
    each = [F.transform(found(text, p, guard.get(k, "[0-9]")), named(i)) for i, (k, p) in enumerate(CANDIDATE.items())]
    return F.concat(*each)


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, as small integers."""
    m, d = c["m"], digits(c["m"])
    n = F.length(d)
    before = F.lower(F.right(c["before"], F.lit(CONTEXT)))
    hint = reduce(lambda a, x: a.when((c["k"] == x[0]) & before.rlike(HINTS[x[1]]), 1), enumerate(KINDS), F.when(F.lit(False), 1)).otherwise(0)
    return {
        "kind": c["k"], "digits": F.least(n, F.lit(30)), "length": F.least(c["e"] - c["s"], F.lit(80)),
        "groups": F.least(F.size(F.split(m, "[^0-9]+")), F.lit(12)), "plus": m.startswith("+").cast("int"),
        "checksum": F.when(n.between(13, 19), luhn(d).cast("int")).otherwise(-1),
        "letter_before": c["before"].rlike("[A-Za-z]$").cast("int"), "letter_after": F.coalesce(c["after"].rlike("^[A-Za-z]").cast("int"), F.lit(0)),
        "hint": hint, "marks": F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(12)),
        "octets": F.when(c["k"] == 1, _octets(m).cast("int")).otherwise(0), "distinct": F.size(F.array_distinct(F.split(d, ""))),
    }


def apart(spans: Column, base: Column, kind: str) -> Column:
    """Spans that overlap none of the base ones: in order of starts, the furthest end of a base span before and the least start of one after say so."""
    own = f"struct<s:int,o:int,e:int,x:{kind}>"
    both = F.concat(
        F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("o"), b["e"].alias("e"), F.lit(None).cast(kind).alias("x"))),
        F.transform(spans, lambda c: F.struct(c["s"].alias("s"), F.lit(1).alias("o"), c["e"].alias("e"), c.alias("x"))),
    ).cast(f"array<{own}>")
    far = F.lit(2**31 - 1)

    def swept(a):
        reach = running(F.transform(a, lambda x: F.when(x["o"] == 0, x["e"]).otherwise(0)), lambda m, x: F.greatest(m, x), F.lit(0))
        low = F.reverse(running(F.reverse(F.transform(a, lambda x: F.when(x["o"] == 0, x["s"]).otherwise(far))), lambda m, x: F.least(m, x), far))
        free = F.filter(F.arrays_zip(a.alias("a"), reach.alias("r"), low.alias("l")), lambda z: (z["a"]["o"] == 1) & (z["r"] <= z["a"]["s"]) & (z["l"] >= z["a"]["e"]))
        return F.transform(free, lambda z: z["a"]["x"]).cast(f"array<{kind}>")

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(let(F.array_sort(both), swept))


def settled(spans: Column) -> Column:
    """Of SCORED spans, in order of starts, the better of each two that overlap; the one held is compared with the next.

    Work grows with the square of the spans that the trees choose in one text (not of its matches).
    """
    none = F.lit(None).cast(SCORED)
    better = lambda x, y: (x["p"] > y["p"]) | ((x["p"] == y["p"]) & (F.struct(x["s"], x["k"], x["e"]) < F.struct(y["s"], y["k"], y["e"])))

    def step(state, x):
        held = state["held"]
        clash = held.isNotNull() & (x["s"] < held["e"]) & x["p"].isNotNull()
        return {"held": F.when(clash & better(held, x), held).otherwise(x)}, F.when(held.isNotNull() & ~clash, held)

    # one more item, after all others, lets the last one go
    end = F.array(F.struct(F.lit(2**31 - 1).alias("s"), F.lit(2**31 - 1).alias("e"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("p")).cast(SCORED))
    return F.when(F.size(spans) < 2, spans).otherwise(grown(F.concat(F.array_sort(spans), end), SCORED, {"held": none}, step))


#: Formats that a base span is rewritten in, by kind, as (pattern, replacement) steps; the last item of each kind says whether
#: the result is still personal data.
REWRITES = {
    "email": [
        ([(r"\.(?=[^@]*$)", " [dot] "), ("@", " [at] ")], True), ([(r"\.(?=[^@]*$)", "(dot)"), ("@", "(at)")], True), ([(r"\.(?=[^@]*$)", " dot "), ("@", " at ")], True),
        ([("@", " @ ")], True),
    ],
    "ip": [([(r"\.", "[.]")], True), ([(r"\.", " . ")], True), ([(r"\.", "[.]"), (r"^", "9")], False), ([(r"\.", " . "), (r"$", "77")], False)],
    "card": [
        ([("[^0-9]", ""), (r"([0-9]{4})(?=[0-9])", "$1.")], True), ([("[^0-9]", ""), (r"([0-9]{4})(?=[0-9])", "$1/")], True), ([("[^0-9]", ""), (r"([0-9]{4})(?=[0-9])", "$1  ")], True),
        ([("[^0-9]", ""), (r"([0-9]{4})(?=[0-9])", "$1."), (r"^([0-9])([0-9])", "$1$1")], False), ([("[^0-9]", ""), (r"([0-9]{4})(?=[0-9])", "$1/"), (r"([0-9])([0-9])$", "$1$1")], False),
    ],
    "phone": [
        ([(r"^\+", "00")], True), ([(r"^\+[0-9]{1,3}[ .-]?(?=\()", "")], True), ([(r"^\+", ""), (r"[() -]+", ".")], True),
        ([(r"[^0-9]", ""), (r"$", "00000000")], False), ([(r"[^0-9]", ""), (r"^.*(.{7})$", "$1")], False),
    ],
}


def rewritten(kind: str, span: Column) -> Column:
    """Every format of a span, ``array<struct<m, real>>``; one that holds a base span itself, or that changed nothing, does not count."""
    out = []
    for steps, real in REWRITES[kind]:
        m = reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, span)
        out.append(F.struct(m.alias("m"), (F.lit(real) if real else F.lit(False)).alias("real")))
    seen = lambda m: reduce(lambda a, spans: a | (F.size(spans) > 0), base_spans(m).values(), F.lit(False))
    # a false one may have come out true
    false = lambda m: ~(_octets(m) if kind == "ip" else valid(kind, m))
    return F.filter(F.array(*out), lambda x: (x["m"] != span) & ~seen(x["m"]) & (x["real"] | false(x["m"])))


def examples(texts: DataFrame) -> DataFrame:
    """Labelled candidates ``(c, label, held, h, at)`` of texts ``t``: rewritten base spans in their places, and the texts' own candidates.

    ``h`` is the text's hash and ``at`` the candidate's place in it: copies of a text give equal rows.
    """
    t = F.col("t")
    base = base_spans(t)
    held = (F.pmod(F.xxhash64("t"), F.lit(4)) == 0).alias("held")
    rows = texts.select("t", F.xxhash64("t").alias("h"), held, *(base[k].alias(f"b{i}") for i, k in enumerate(KINDS)))
    planted = []
    for i, k in enumerate(KINDS):
        one = rows.select("h", "held", F.explode(f"b{i}").alias("b"))
        one = one.select("h", "held", "b", F.posexplode(rewritten(k, F.col("b")["m"])).alias("v", "r"))
        text = F.concat(F.col("b")["before"], F.col("r")["m"], F.coalesce(F.col("b")["after"], F.lit("")))
        at = F.array(F.lit(i), F.col("b")["s"], "v").alias("at")
        one = one.select("h", "held", at, "r", F.length(F.col("b")["before"]).alias("s"), text.alias("t")).select("h", "held", "at", "r", "s", F.explode(candidates(t)).alias("c"))
        c, e = F.col("c"), F.col("s") + F.length(F.col("r")["m"])
        # what else stands around the span says nothing; a part of it is no span of its own
        one = one.where((c["s"] < e) & (c["e"] > F.col("s")))
        planted.append(one.select("c", (F.col("r")["real"] & (c["k"] == i) & (c["s"] == F.col("s")) & (c["e"] == e)).alias("label"), "held", "h", F.concat("at", F.array(c["s"], c["e"])).alias("at")))
    every = F.concat(*(F.transform(F.col(f"b{i}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for i in range(len(KINDS))))
    own = rows.select("h", "held", F.explode(apart(candidates(t), every, CANDIDATE_SPAN)).alias("c"))
    own = own.select("c", F.lit(False).alias("label"), "held", "h", F.array(F.lit(-1), F.col("c")["s"], F.col("c")["e"]).alias("at"))
    return reduce(DataFrame.unionByName, planted, own)


def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> gbt.Boosted:
    """Trees on examples of all documents, copies once; a quarter of the documents is held out of the trees and sets the thresholds."""
    # a candidate holds a digit or one of these
    texts = docs.where(F.col(text).rlike(r"[0-9@]|\[at\]|\(at\)| at [A-Za-z0-9-]++ dot ")).select(F.col(text).alias("t"))
    rows = examples(texts).select("h", "at", "label", F.col("held").alias("_held"), *(v.alias(k) for k, v in features(F.col("c")).items())).distinct()
    table = gbt.vectors(rows, ["_held", *FEATURES], "label")
    model = gbt.fit_rows(table.where("not _held"), FEATURES)
    found_ = gbt.thresholds(table.where("_held"), model, FEATURES, F.col("kind"), precision)
    model.thresholds = {i: found_.get(i, float("inf")) for i in range(len(KINDS))}
    return model


def added(cands: Column, base: Column, model: gbt.Boosted) -> Column:
    """Candidates over their kind's threshold that overlap no base span, of overlapping ones the better, as SCORED."""
    limits = F.array(*(F.lit(float(model.thresholds.get(i, np.inf))) for i in range(len(KINDS))))
    # features are made once per candidate, then all trees read them
    made = F.transform(apart(cands, base, CANDIDATE_SPAN), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), F.struct(*(v.alias(n) for n, v in features(c).items())).alias("f")))
    score = lambda f: model.column({n: f[n] for n in FEATURES})
    scored = F.transform(made, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), score(c["f"]).alias("p")))
    over = F.filter(scored, lambda c: c["p"] >= F.element_at(limits, c["k"] + 1))
    return settled(over.cast(f"array<{SCORED}>"))


def detect(docs: DataFrame, model: gbt.Boosted, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """The input with ``{prefix}base`` and ``{prefix}spans``: arrays of ``(k, s, e)`` by kind, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    p = lambda n: F.col(f"{prefix}{n}")
    base = base_spans(t)
    named = lambda i: lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    bare = [F.transform(base[k], named(i)) for i, k in enumerate(KINDS)]
    out = docs.withColumn(f"{prefix}base", F.concat(*bare)).withColumn(f"{prefix}c", candidates(t))
    more = F.transform(added(p("c"), p("base"), model), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    more = F.when(F.size(p("c")) > 0, more).otherwise(F.array().cast("array<struct<k:int,s:int,e:int>>"))
    return out.withColumn(f"{prefix}spans", F.array_sort(F.concat(p("base"), more))).drop(f"{prefix}c")


#: Characters in a block of a text that is redacted.
BLOCK = 4096


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by the kind of the first in brackets.

    The text is cut into blocks once, so that no place is looked up from the text's start.
    """
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))
    end = F.array(F.struct(F.length(text).alias("s"), F.length(text).alias("e"), F.lit(len(KINDS)).alias("k")))

    def named(k: Column) -> Column:
        return reduce(lambda a, i: a.when(k == i, f"[{KINDS[i].upper()}]"), range(1, len(KINDS)), F.when(k == 0, f"[{KINDS[0].upper()}]")).otherwise("")

    def piece(held, a, z):
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(z / BLOCK).cast("int")
        block = lambda k: F.element_at(held, k + 1)
        one = F.substring(block(i), a - i * BLOCK + 1, z - a)
        more = F.concat(F.substring(block(i), a - i * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(held, i + 2, j - i - 1), ""), F.substring(block(j), F.lit(1), z - j * BLOCK))
        return F.when(z <= a, "").when(i == j, one).otherwise(more)

    def whole(items):
        at = running(F.transform(items, lambda x: x["e"]), lambda m, x: F.greatest(m, x), F.lit(0))
        zipped = F.arrays_zip(items.alias("x"), at.alias("a"))
        new = lambda z: F.when(z["x"]["s"] >= z["a"], F.lit(True)).otherwise(False)
        return let(blocks, lambda held: F.array_join(F.transform(zipped, lambda z: F.when(new(z), F.concat(piece(held, z["a"], z["x"]["s"]), named(z["x"]["k"]))).otherwise("")), ""))

    return F.when(F.size(spans) > 0, let(F.concat(order, end), whole)).otherwise(text)


def digest(found_: DataFrame, prefix: str = "pii_") -> DataFrame:
    """The contract's columns."""
    names = F.array(*(F.lit(k) for k in KINDS))
    b, s = F.col(f"{prefix}base"), F.col(f"{prefix}spans")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    of = lambda i: lambda x: x["k"] == i
    n = [F.size(F.filter(b, of(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found_.select("doc_id", *n, F.sha2(text(b), 256).alias("base_sha256"), text(s).alias("spans"))
