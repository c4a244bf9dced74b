"""Personal data by weak supervision, with DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; wider patterns propose further
spans. Three kinds of labelers vote on each span: its own shape (regex), word lists (gazetteer) and the
words around it (context). Expectation-maximisation over the counts of vote patterns estimates how far each
labeler is to be trusted; its posteriors are the targets of the final span classifier, a naive Bayes model
over hashed shape and context features. Base spans always stay; a proposed span is added if the classifier
takes it for personal data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Each equals the plain one (in brackets in the notes), written so that no text makes
#: matching slow: a match can only start where a run starts or where the match before it ended, and runs are possessive.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 digits or more
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns that only propose: addresses in words, numbers without a country code.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?: ?(?:\(at\)|\[at\]) ?| at )[A-Za-z0-9-]{1,64}+(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9-]{1,64}+)+",
    "phone": r"(?<![0-9A-Za-z+.)-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-]?[0-9])",
}
#: A text is searched for a proposing pattern only if it has this (null: any text with a digit); every match has it, so the gate decides nothing.
NEEDS = {"email": r"(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64}+(?: ?(?:\(dot\)|\[dot\])| dot |\.)", "phone": None}
#: Gazetteers.
DOMAINS = "com org net edu gov io info biz de fr es uk it nl eu us ca co".split()
#: Words that stand before personal data of a kind.
BEFORE = {
    "email": "mail email e-mail contact write address reach adresse correo courriel",
    "ip": "ip host server address from addr login client",
    "card": "card visa mastercard amex credit debit payment carte karte tarjeta",
    "phone": "call phone tel telephone mobile cell fax contact ring number telefon appel",
}
#: Cells of the classifier's hashed features; the model's size is bounded by it.
CELLS = 512
#: What a feature cell's counts start from, in spans.
SMOOTH = 0.25
#: Characters of context on either side.
AROUND = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether a text's digits pass the Luhn check."""
    d = F.reverse(F.split(_digits(x), ""))
    total = F.aggregate(
        F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, v: a + v
    )
    return total % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    """Whether a base pattern's match is one."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """The pattern's matches as structs (kind, start, end, span, base), in code points, end exclusive.

    Lengths of what lies between the matches and of the matches themselves add up to their places.
    """
    empty = F.expr("array()").cast("array<struct<kind:string,start:int,end:int,span:string,base:boolean>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))
    both = F.filter(both, lambda x: x["m"].isNotNull())
    ends = F.aggregate(both, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x["b"] + F.length(x["m"])))
    out = F.zip_with(
        both, F.slice(ends, 2, 1_000_000_000),
        lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("span"), F.lit(base).alias("base")),
    )
    out = F.filter(out, lambda s: _holds(kind, s["span"]) if base else F.lit(True))
    return F.coalesce(F.when(F.size(found) > 0, out), empty)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, _found and others): each row of docs as a struct, with base and proposed spans and the characters around them."""
    text = F.col("_text")
    empty = F.expr("array()").cast("array<struct<kind:string,start:int,end:int,span:string,base:boolean>>")
    digit = F.col("_digit")
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).withColumn("_digit", F.rlike("_text", F.lit("[0-9]")))
    guard = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    columns = {f"_base_{k}": F.when(guard[k], _spans(text, k, BASE[k], True)).otherwise(empty) for k in KINDS}
    columns |= {f"_wide_{k}": F.when(F.rlike(text, F.lit(NEEDS[k])) if NEEDS[k] else digit, _spans(text, k, WIDER[k], False)).otherwise(empty) for k in WIDER}
    docs = docs.withColumns(columns)
    base = F.concat(*[F.col(f"_base_{k}") for k in KINDS])
    # a proposed span that touches a base one says nothing new
    wide = F.filter(F.concat(*[F.col(f"_wide_{k}") for k in WIDER]), lambda w: ~F.exists(F.col("_base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    docs = docs.withColumn("_base", base).withColumn("_wide", wide)
    around = lambda s: s.withField("before", F.lower(F.substring(text, F.greatest(s["start"] - AROUND, F.lit(0)) + 1, F.least(s["start"], F.lit(AROUND))))).withField("after", F.lower(F.substring(text, s["end"] + 1, F.lit(AROUND))))
    return docs.withColumn("_found", F.transform(F.concat("_base", "_wide"), around))


def votes(s: Column) -> list[Column]:
    """Each labeler's vote on a span: 1 personal data, 0 not, -1 no opinion."""
    kind, span, before, after = s["kind"], s["span"], s["before"], s["after"]
    digits = F.length(_digits(span))
    tail = F.lower(F.regexp_extract(span, r"([A-Za-z]+)$", 1))
    shape = (
        F.when(kind == "email", F.when(F.contains(span, F.lit("@")) | F.rlike(span, F.lit(r"[\[(]at[\])]")), 1).otherwise(0))
        .when(kind == "phone", F.when(F.startswith(span, F.lit("+")) | F.startswith(span, F.lit("(")), 1).when(digits == 10, -1).otherwise(0))
        .when(kind == "card", F.when(digits.between(16, 19), 1).otherwise(0))
        .otherwise(F.when(F.rlike(span, F.lit(r"^[1-9]")), 1).otherwise(0))
    )
    gazetteer = (
        F.when(kind == "email", F.when(tail.isin(*DOMAINS), 1).otherwise(0))
        .when(kind == "card", F.when(F.rlike(span, F.lit(r"^[2-6]")), 1).otherwise(-1))
        .when(kind == "phone", F.when(F.rlike(span, F.lit(r"^\+|^\(?[2-9][0-9]{2}")), 1).otherwise(0))
        .otherwise(F.when(F.rlike(span, F.lit(r"^(?:10\.|127\.|192\.168\.)")), -1).otherwise(1))
    )
    named = F.lit(None).cast("boolean")
    for k, words in BEFORE.items():
        named = F.when(kind == k, F.rlike(before, F.lit(r"(?:^|[^a-z])(?:" + "|".join(words.split()) + r")[^a-z]{0,6}(?:[a-z]{1,4}[^a-z]{1,3})?$"))).otherwise(named)
    glued = F.rlike(before, F.lit(r"[0-9a-z#$€%=/_]-?$")) | F.rlike(after, F.lit(r"^[0-9a-z%€$/_=]"))
    context = F.when(named, 1).when(glued, 0).otherwise(-1)
    return [v.cast("int") for v in (shape, gazetteer, context)]


def features(s: Column) -> Column:
    """The classifier's hashed features of a span."""
    kind = s["kind"]
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["span"], "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    last = F.regexp_extract(s["before"], r"([^\s]{1,12})\s*$", 1)
    nxt = F.regexp_extract(s["after"], r"^\s*([^\s]{1,12})", 1)
    voted = F.concat_ws(",", *[v.cast("string") for v in votes(s)])
    told = [("kind", F.lit("")), ("shape", shape), ("length", F.length(s["span"]).cast("string")), ("before", F.regexp_replace(last, "[0-9]+", "9")), ("after", F.regexp_replace(nxt, "[0-9]+", "9")), ("votes", voted)]
    return F.array(*[F.pmod(F.xxhash64(F.lit(n), kind, v), F.lit(CELLS)).cast("int") for n, v in told])


def reliabilities(patterns: Iterable[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over counts of vote patterns: how likely a span of each pattern is personal data.

    For each kind: a prior, and for each labeler its chance to vote 1, 0 or -1 on either class, smoothed.
    There are 27 patterns a kind at most, whatever the corpus.
    """
    by_kind: dict[str, dict[tuple[int, ...], float]] = {}
    for kind, pattern, n in sorted(patterns):
        by_kind.setdefault(kind, {})[tuple(pattern)] = float(n)
    out = {}
    for kind, counted in by_kind.items():
        guess = {p: min(0.95, max(0.05, 0.5 + 0.22 * sum(v if v == 1 else -1 if v == 0 else 0 for v in p))) for p in counted}
        for _ in range(rounds):
            total = sum(counted.values())
            yes = sum(n * guess[p] for p, n in counted.items())
            prior = (yes + 1) / (total + 2)
            chance = {}
            for i in range(len(next(iter(counted)))):
                for v, lean in ((1, 3.0), (0, -3.0), (-1, 0.0)):
                    n1 = sum(n * guess[p] for p, n in counted.items() if p[i] == v)
                    n0 = sum(n * (1 - guess[p]) for p, n in counted.items() if p[i] == v)
                    # labelers are better than chance: their prior counts say so
                    chance[i, v] = ((n1 + 4 + max(0.0, lean)) / (yes + 15), (n0 + 4 + max(0.0, -lean)) / (total - yes + 15))
            for p in counted:
                a = math.log(prior) + sum(math.log(chance[i, v][0]) for i, v in enumerate(p))
                b = math.log(1 - prior) + sum(math.log(chance[i, v][1]) for i, v in enumerate(p))
                guess[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
        out |= {(kind, p): g for p, g in guess.items()}
    return out


def learn(found: DataFrame) -> tuple[list[float], float]:
    """The classifier's weight for each feature cell and its threshold-free prior, from all spans of all documents.

    found: rows with a struct column s, one for each span. Two grouped sums, of 108 and CELLS rows at most,
    come to the driver.
    """
    voted = found.select(F.col("s.kind").alias("kind"), F.array(*votes(F.col("s"))).alias("votes"))
    trust = reliabilities((r.kind, tuple(r.votes), r.n) for r in voted.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect())
    if not trust:
        return [0.0] * CELLS, 0.0
    posterior = F.lit(0.5)
    for (kind, pattern), p in sorted(trust.items()):
        posterior = F.when((F.col("kind") == kind) & (F.col("votes") == F.array(*[F.lit(v) for v in pattern])), F.lit(p)).otherwise(posterior)
    told = found.select(F.col("s.kind").alias("kind"), F.array(*votes(F.col("s"))).alias("votes"), features(F.col("s")).alias("f"))
    sums = told.select(posterior.alias("p"), F.explode("f").alias("cell")).groupBy("cell").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    per_span = 6.0
    yes, no = sum(r.yes for r in sums) / per_span, sum(r.no for r in sums) / per_span
    share = (yes + 1) / (yes + no + 2)
    prior = math.log(share) - math.log(1 - share)
    weights = [0.0] * CELLS
    for r in sums:  # smoothed toward the overall share; a span's features say much the same, so each speaks for its part
        told = math.log(r.yes + SMOOTH * share) - math.log(r.no + SMOOTH * (1 - share)) - prior
        weights[r.cell] = told / per_span
    return weights, prior


def _named(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def detect(docs: DataFrame, scratch: Scratch, *, text_col: str = "text") -> DataFrame:
    """(row, _pii) for every row of docs: the row as a struct, and base and spans, arrays of (kind, start, end) by kind and start.

    A null text is empty and has no spans. Repeated rows have equal ones; an empty table stays empty. Rows stay
    whole in their struct, so columns of any name are allowed.
    """
    found = scratch.keep(find(docs.select(text_col), text_col).where(F.size("_found") > 0).select(F.explode("_found").alias("s")))
    weights, prior = learn(found)
    table = F.array(*[F.lit(w) for w in weights])
    taken = lambda s: s["base"] | (F.aggregate(features(s), F.lit(prior), lambda a, c: a + F.element_at(table, c + 1)) > 0)
    rank = F.array(*[F.lit(k) for k in KINDS])
    sorted_spans = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    out = find(docs, text_col)
    pii = F.struct(sorted_spans(F.col("_base")).alias("base"), sorted_spans(F.when(F.size("_found") > 0, F.filter("_found", taken)).otherwise(F.col("_found"))).alias("spans"))
    return out.select("row", pii.alias("_pii"))


def digest(detected: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans."""
    of_kind = lambda k: F.filter("_pii.base", lambda s: s["kind"] == k)
    counted = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return detected.select("row.doc_id", *counted, F.sha2(_named(F.col("_pii.base")), 256).alias("base_sha256"), _named(F.col("_pii.spans")).alias("spans"))


def mask(docs: DataFrame, scratch: Scratch, *, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in capitals and brackets; other texts stay as they are, null ones too."""
    found = detect(docs, scratch, text_col=text_col)
    text = F.col(f"row.`{text_col}`")
    ordered = F.array_sort(F.transform("_pii.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, s: F.struct(  # noqa: E731  an overlapping span's beginning is already masked
        F.greatest(a["at"], s["end"]).alias("at"),
        F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.when(s["end"] > a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))).alias("parts"),
    )
    masked = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    told = F.when(F.size("_pii.spans") > 0, masked).otherwise(text)
    return found.select(*[(told if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
