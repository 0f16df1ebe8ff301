"""Personal data: base spans by fixed patterns, further spans by weak supervision.

Candidates are the base matches of email, ip, card and phone, and looser ones: `secret` (long
runs of letters and digits) and `number` (long digit chains that are none of the base kinds).
Regex, gazetteer and context labelers each vote yes, no or nothing on every candidate. All
candidates of the corpus are counted by (kind, votes, features), a table whose size is bounded
by the number of such combinations; expectation-maximisation on it estimates each labeler's
reliability and the candidates' posteriors, and these train the final span classifier, naive
Bayes on the features. It decides on the looser candidates; base spans always stay.

Everything that touches texts is DataFrame expressions. Patterns are possessive and anchored
by look-behinds so that each runs in linear time without recursion, and texts without the
characters that a kind needs skip its pattern.

Defined results: null and empty texts have no spans; null and repeated ids do no harm, since a row
never leaves its place, and repeated rows get the same spans; an empty table gives no rows, and
without candidates nothing is trained and nothing but base spans is found; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanframe.llm.common import text_or_empty

#: Equal to the base patterns, with the same leftmost non-overlapping matches: look-behinds and \G
#: skip starts that would fail or only repeat work, and no loop ever gives back characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "number": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
}
#: What a text must have for the pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_-]{20}", "number": r"[0-9][\x20-]?[0-9]"}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Gazetteers.
CONTEXT_WORDS = r"(?i)(?:token|key|secret|password|passwd|pwd|auth|bearer|credential|api)[\"']?\s*[=:]\s*[\"']?$"
NUMBER_WORDS = r"(?i)(?:card|account|iban|visa|mastercard|phone|tel|ssn|passport)\b[^0-9]{0,6}$"
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
TOP_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
ACCEPT = 0.9
PRIOR, ROUNDS = 0.5, 30
VOTES = ("pattern", "gazetteer", "context", "checksum", "shape")
LEFT = 24  # code points of left context


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _matches(text: Column, kind: str) -> Column:
    """array<struct<s:int,m:string,l:string,r:string>>: start in code points, match, context on either side.

    Splitting by the pattern gives what lies between the matches; starts are sums of lengths,
    in strides so that a text with very many matches doesn't take quadratic time.
    """
    empty = F.array().cast("array<struct<s:int,m:string,l:string,r:string>>")
    pattern, stride = F.lit(PATTERNS[kind]), 128

    def located(p: Column) -> Column:
        m, seg = p["m"], p["seg"]
        lengths = F.transform(m, lambda x, i: F.char_length(x) + F.char_length(F.get(seg, i)))

        def with_sums(q: Column) -> Column:
            n, by = q["n"], q["by"]

            def start(i: Column) -> Column:
                c = F.floor(i / stride).cast("int")
                return F.get(by, c) + _total(F.slice(n, c * stride + 1, i - c * stride)) + F.char_length(F.get(seg, i))

            return F.transform(m, lambda x, i: F.struct(start(i).alias("s"), x.alias("m"), F.right(F.get(seg, i), F.lit(LEFT)).alias("l"), F.left(F.get(seg, i + 1), F.lit(1)).alias("r")))

        def summed(n: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / stride).cast("int")), lambda c: _total(F.slice(n, c * stride + 1, F.lit(stride))))
            return _let(chunks, lambda s: F.transform(s, lambda _, c: _total(F.slice(s, F.lit(1), c))))

        return _let(lengths, lambda n: _let(F.struct(n.alias("n"), summed(n).alias("by")), with_sums))

    found = _let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("seg")), lambda p: F.when(F.size(p["m"]) > 0, located(p)).otherwise(empty))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    return _let(_digits(m), lambda d: F.when(F.char_length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)))


def _valid(kind: str, m: Column) -> Column:
    """What a match must fulfil beside the pattern to be a candidate."""
    if kind == "ip":
        part = lambda x: _let(F.regexp_replace(x, "^0+", ""), lambda d: (F.char_length(d) < 3) | ((F.char_length(d) == 3) & (d <= "255")))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.char_length(_digits(m)).between(8, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    if kind == "number":
        return F.char_length(_digits(m)).between(9, 19) & ~_luhn(m)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column) -> list[Column]:
    """Votes of the labelers on a candidate, in the order of VOTES."""
    m, left, right = x["m"], x["l"], x["r"]
    none, always = F.lit(False), F.lit(True)
    d = _digits(m)
    share = F.char_length(d) / F.greatest(F.char_length(m), F.lit(1))
    glued = left.rlike(r"[A-Za-z0-9_]$") | right.rlike(r"^[A-Za-z0-9_]")
    pattern = {"secret": _vote(m.rlike("^[0-9a-f]{32,}$") | m.rlike("^[0-9A-F]{32,}$"), m.rlike("^[a-z-]+[0-9]?$")), "number": _vote(none, always)}.get(kind, _vote(always, none))
    gazetteer = {
        "email": _vote(m.rlike(TOP_DOMAINS), none),
        "ip": _vote(none, m.rlike(r"^(?:0|127|255)\.")),
        "card": _vote(d.rlike(ISSUER), none),
        "phone": _vote(m.rlike(r"^\+[1-9]"), m.rlike(r"^\+0")),
        "secret": _vote(left.rlike(CONTEXT_WORDS), none),
        "number": _vote(left.rlike(NUMBER_WORDS), ~d.rlike(ISSUER)),
    }[kind]
    context = _vote(left.rlike(r"[=:\"'(<\[]\s*$"), glued)
    checksum = {"card": _vote(_luhn(m), none), "number": _vote(none, F.char_length(d).between(16, 19)), "secret": _vote(share.between(0.2, 0.85), share < 0.05)}.get(kind, F.lit(0))
    shape = {"number": _vote(none, ~F.char_length(d).between(13, 19)), "secret": _vote(F.char_length(m) >= 32, F.char_length(m) < 24)}.get(kind, _vote(~glued, none))
    return [v.cast("int") for v in (pattern, gazetteer, context, checksum, shape)]


def _features(x: Column) -> Column:
    """The classifier's features as one small number: length, share of digits, what stands before and after."""
    m = x["m"]
    n = F.char_length(m)
    length = F.when(n < 16, 0).when(n < 24, 1).when(n < 40, 2).otherwise(3)
    share = F.char_length(_digits(m)) / F.greatest(n, F.lit(1))
    digits = F.when(share < 0.1, 0).when(share < 0.9, 1).otherwise(2)
    before = F.when(x["l"].rlike(CONTEXT_WORDS), 0).when(x["l"].rlike(NUMBER_WORDS), 1).when(x["l"].rlike(r"[=:\"']\s*$"), 2).otherwise(3)
    after = F.when(x["r"].rlike("^[\"',;.\\s]") | (x["r"] == ""), 0).otherwise(1)
    return (((length * 3 + digits) * 4 + before) * 2 + after).cast("int")


def _of_kind(text: Column, k: int) -> Column:
    """Candidates of one kind."""
    kind = KINDS[k]
    good = F.filter(_matches(text, kind), lambda x: _valid(kind, x["m"]))
    return F.transform(good, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), (x["s"] + F.char_length(x["m"])).alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r")))


def candidates(text: Column) -> Column:
    """array<struct<k:int,s:int,e:int,m,l,r>> of all candidates; looser ones only where no base span is."""
    base = F.concat(*[_of_kind(text, k) for k in range(len(BASE))])
    loose = F.concat(*[_of_kind(text, k) for k in range(len(BASE), len(KINDS))])
    return _let(F.struct(base.alias("b"), loose.alias("o")), lambda p: F.when(F.size(p["o"]) == 0, p["b"]).otherwise(F.concat(p["b"], F.filter(p["o"], lambda x: ~F.exists(p["b"], lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))))


def _by_kind(x: Column, make: Callable[[str], Column]) -> Column:
    out = F.when(x["k"] == 0, make(KINDS[0]))
    for k, kind in enumerate(KINDS[1:], 1):
        out = out.when(x["k"] == k, make(kind))
    return out


def vote_table(docs: DataFrame) -> list[tuple]:
    """(kind, votes..., features, count) over all candidates of all texts: at most 6 x 3^5 x 96 rows."""
    rows = docs.select(F.explode(candidates(text_or_empty())).alias("x"))
    votes = F.coalesce(_by_kind(F.col("x"), lambda kind: F.array(*_votes(kind, F.col("x")))))
    counted = rows.select(F.col("x.k").alias("k"), votes.alias("v"), _features(F.col("x")).alias("f")).groupBy("k", "v", "f").count()
    return sorted((r[0], tuple(r[1]), r[2], r[3]) for r in counted.collect())


def reliabilities(table: list[tuple]) -> tuple[list[float], dict[tuple, float]]:
    """Expectation-maximisation: each labeler's share of right votes, and the posterior of (kind, votes)."""
    right = [0.8] * len(VOTES)
    prior = dict.fromkeys(range(len(KINDS)), PRIOR)
    patterns: dict[tuple, int] = {}
    for k, v, _, n in table:
        patterns[k, v] = patterns.get((k, v), 0) + n
    post: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for k, v in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(x * math.log(r / (1 - r)) for x, r in zip(v, right, strict=True))
            post[k, v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for j in range(len(VOTES)):
            cast = sum(n for (k, v), n in patterns.items() if v[j])
            good = sum(n * (post[k, v] if v[j] > 0 else 1 - post[k, v]) for (k, v), n in patterns.items() if v[j])
            right[j] = min(0.99, max(0.55, (good + 4) / (cast + 5)))
        for kind in prior:
            n = sum(c for (k, _), c in patterns.items() if k == kind)
            yes = sum(c * post[k, v] for (k, v), c in patterns.items() if k == kind)
            prior[kind] = min(0.95, max(0.05, (yes + 1) / (n + 2)))
    return right, post


def train(table: list[tuple]) -> dict[tuple[int, int], float]:
    """The span classifier: probability by (kind, features), naive Bayes on posteriors."""
    _, post = reliabilities(table)
    split = lambda f: (f // 24, f // 8 % 3, f // 2 % 4, f % 2)
    yes: dict[tuple, float] = {}
    no: dict[tuple, float] = {}
    for k, v, f, n in table:
        for part in [(k,), *((k, j, x) for j, x in enumerate(split(f)))]:
            yes[part] = yes.get(part, 0.0) + n * post[k, v]
            no[part] = no.get(part, 0.0) + n * (1 - post[k, v])
    out = {}
    for k, f in {(k, f) for k, _, f, _ in table}:
        odds = math.log((yes[k,] + 1) / (no[k,] + 1))
        for j, x in enumerate(split(f)):
            odds += math.log((yes[k, j, x] + 0.5) / (yes[k,] + 2)) - math.log((no[k, j, x] + 0.5) / (no[k,] + 2))
        out[k, f] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return out


def accepted(model: dict[tuple[int, int], float]) -> set[tuple[int, int]]:
    return {key for key, p in model.items() if p >= ACCEPT and KINDS[key[0]] not in BASE}


def _stays(x: Column, good: set[tuple[int, int]]) -> Column:
    code = x["k"] * 1000 + _features(x)
    loose = code.isin([k * 1000 + f for k, f in sorted(good)]) if good else F.lit(False)
    return (x["k"] < len(BASE)) | loose


def spans(docs: DataFrame, keep: list[str], good: set[tuple[int, int]]) -> DataFrame:
    """The columns in `keep`, and spans: array<struct<k,s,e,...>> by kind, then start."""
    return docs.select(*keep, F.filter(candidates(text_or_empty()), lambda x: _stays(x, good)).alias("spans"))


def _written(xs: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans."""
    found = spans(docs, ["doc_id"], accepted(train(vote_table(docs))))
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    number = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k))
    counts = [number(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _merged(xs: Column) -> Column:
    """Spans in order of start as array<struct<k,s,e>>, overlapping ones as one of the first one's kind."""
    slim = F.sort_array(F.transform(xs, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    slim = F.transform(slim, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["e"]).alias("e")))

    def join(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["k"].alias("k"), last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        overlap = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] > x["s"])
        return F.when(overlap, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    def settle(ys: Column) -> Column:
        # In order of start, spans overlap only if neighbours do.
        clash = F.exists(F.sequence(F.lit(1), F.size(ys) - 1), lambda i: F.get(ys, i)["s"] < F.get(ys, i - 1)["e"])
        return F.when((F.size(ys) > 1) & clash, F.aggregate(ys, F.array().cast("array<struct<k:int,s:int,e:int>>"), join)).otherwise(ys)

    return _let(slim, settle)


def _replaced(text: Column, xs: Column) -> Column:
    """The text with each of its (merged) spans replaced by its kind.

    Four bytes a character, so that a piece is found without walking through the text; one more
    character before each, since a byte order mark in front would be taken for one.
    """
    code = "UTF-32"
    wide = lambda x: F.encode(x, code)
    labels = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])

    def pieces(p: Column) -> Column:
        ys, data = p["ys"], p["data"]

        def piece(start: Column, end: Column | None) -> Column:
            part = F.substring(data, 4 * start + 1, 4 * (end - start)) if end is not None else F.substring(data, 4 * start + 1, F.octet_length(data))
            return F.substring(F.decode(F.concat(wide(F.lit("x")), part), code), F.lit(2), F.length(data))

        before = F.transform(ys, lambda y, i: F.concat(piece(F.when(i == 0, F.lit(0)).otherwise(F.get(ys, i - 1)["e"]), y["s"]), F.get(labels, y["k"])))
        return F.concat(F.array_join(before, ""), piece(F.element_at(ys, -1)["e"], None))

    return _let(F.struct(xs.alias("ys"), wide(text).alias("data")), pieces)


def redact(docs: DataFrame) -> DataFrame:
    """The table with the spans found in each text replaced by their kinds in angle brackets, overlapping ones as one.

    A null text stays null; all columns pass through, whatever their names.
    """
    good = accepted(train(vote_table(docs)))
    found = F.filter(candidates(F.col("text")), lambda x: _stays(x, good))
    return docs.withColumn("text", _let(found, lambda xs: F.when(F.size(xs) > 0, _replaced(F.col("text"), _merged(xs))).otherwise(F.col("text"))))
