"""Personal data: strict patterns, and weaker candidates that labelers vote on; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import stage

#: Positions are added up in blocks of this many matches.
BLOCK = 256
#: Hashed features of the span classifier; rounds of expectation-maximisation.
BUCKETS, ROUNDS = 2048, 40
#: A labeler's vote against, no vote, vote for.
AGAINST, SILENT, FOR = 0, 1, 2
#: Characters looked at before and after a span.
BEFORE, AFTER = 40, 16

SPAN = "array<struct<kind:int,start:int,end:int,votes:int,features:array<int>>>"
BETWEEN = r"(?: ?[(\[{<] ?%s ?[)\]}>] ?| %s )"


class Kind(NamedTuple):
    """Patterns are possessive and begin where a run begins, or where the last match ended, which changes no match and takes linear time."""

    name: str
    hint: str  #: no text without a match of this has a strict match
    strict: str
    valid: Callable[[Column], Column]  #: of what strict matches
    loose_hint: str
    loose: str
    shape: Callable[[Column], Column]  #: regex labeler: what a candidate's text speaks for
    known: Callable[[Column], Column]  #: gazetteer labeler
    cue: str  #: context labelers: words before a candidate that speak for it, and against it
    counter_cue: str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    def weighed(number: Column) -> Column:
        def add(total: Column, k: Column) -> Column:
            digit = F.ascii(F.substring(number, k, F.lit(1))) - 48
            return total + F.when(k % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0

    return let(F.reverse(digits(text)), weighed)


def size_within(text: Column, least: int, most: int) -> Column:
    return F.length(digits(text)).between(least, most)


KINDS = [
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True),
         r"(?i) ?\bat\b|＠", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:" + BETWEEN % ("at", "at") + r"| ?＠ ?)[a-z0-9-]++(?:(?:" + BETWEEN % ("dot", "dot") + r"|\.)[a-z0-9-]++)++",
         lambda m: m.rlike(r"(?i)[\[({<] ?(?:at|dot) ?[\])}>]| dot |＠"),
         lambda m: m.rlike(r"(?i)(?:^|[^a-z])(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|us|mail|gmail|outlook|hotmail|yahoo|gmx)$"),
         r"(?i)e-?mail|contact|write to|address|correo|courriel|adresse|kontakt|schreib", r"(?i)\b(?:look|arriv|meet|stay|stop|aim)\w*$|https?:"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
         r"(?i)[0-9](?:\[\.\]|\(\.\)| ?[(\[]? ?dot\b| \. )", r"(?i)(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| ?[(\[] ?dot ?[)\]] ?| dot | \. )[0-9]{1,3}+){3}(?![0-9])",
         lambda m: m.rlike(r"(?i)^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:[^0-9]+|$)){4}$"),
         lambda m: m.rlike(r"^(?:10|127|172|192|8|1)[^0-9]"),
         r"(?i)\bip\b|ipv4|server|host|address|servidor|serveur|adresse|ping", r"(?i)version|\bv$|section|chapter|cap[ií]tulo|chapitre|kapitel|§"),
    Kind("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++", lambda m: size_within(m, 16, 19) & luhn(m),
         r"[0-9]{4}[ ._/-]{1,2}[0-9]{4}|[0-9]{13}", r"(?<![0-9])(?:[0-9]{4}[ ._/-]{1,2}){3}[0-9]{4,7}(?![0-9])|(?<![0-9])[0-9]{4}[ ._/-]{1,2}[0-9]{6}[ ._/-]{1,2}[0-9]{5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
         luhn, lambda m: m.rlike(r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])"),
         r"(?i)card|visa|credit|amex|tarjeta|carte|karte", r"(?i)isbn|order|invoice|serial|pedido|commande|bestell|\bid\b|\bno\.?$|#$"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: size_within(m, 8, 15),
         r"[0-9]{2}[) ./-]+[0-9]{2}", r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[ ./-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])(?:[0-9]{2,4}[ ./-]?){1,4}[0-9]{2,4}(?![0-9])",
         lambda m: size_within(m, 9, 15) & ~m.rlike(r"^[0-9]{1,3}(?:[.,][0-9]{3})+$|^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"),
         lambda m: m.rlike(r"^(?:00|0[1-9]|\()"),
         r"(?i)phone|\btel\b|tel[eé]f|t[eé]l[eé]ph|telefon|mobil|m[oó]vil|call|fax|appel|anruf", r"(?i)version|isbn|page|order|invoice|total|price|\bid\b|[$€£#]$"),
]


def prefix(sizes: Column) -> Column:
    """What comes before each element of an array of integers, in blocks, so that long arrays take far fewer steps than pairs."""
    plus = lambda a, b: a + b
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))

    def block(b: Column) -> Column:
        return F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))

    def inside(own: Column, before: Column) -> Column:
        return F.transform(own, lambda _, i: before + F.aggregate(F.slice(own, F.lit(1), i), F.lit(0), plus))

    return let(F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), plus)), lambda sums: F.flatten(F.transform(
        blocks, lambda b: let(F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), plus), lambda before: let(block(b), lambda own: inside(own, before))))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, match, before, after)> of all matches, leftmost first, in code points. Two passes of the pattern:
    the matches, and what lies between them."""
    def spans(at: Column) -> Column:
        def placed(before: Column) -> Column:
            return F.transform(at["found"], lambda m, i: let(F.get(before, i) + F.length(F.get(at["gaps"], i)), lambda start: F.struct(
                start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"),
                F.right(F.get(at["gaps"], i), F.lit(BEFORE)).alias("before"), F.left(F.get(at["gaps"], i + 1), F.lit(AFTER)).alias("after"))))

        sizes = F.zip_with(at["gaps"], at["found"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        return let(sizes, lambda own: let(prefix(own), placed))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), spans)


def votes_of(kind: Kind, span: Column, strict: bool) -> list[Column]:
    """What the labelers say of a span: strict pattern, shape, gazetteer, words before it that speak for it, and against it."""
    def when(holds: Column, then: int, otherwise: int = SILENT) -> Column:
        return F.when(holds, F.lit(then)).otherwise(F.lit(otherwise))

    return [F.lit(FOR if strict else SILENT), when(kind.shape(span["match"]), FOR, AGAINST), when(kind.known(span["match"]), FOR),
            when(span["before"].rlike(kind.cue), FOR), when(span["before"].rlike(kind.counter_cue), AGAINST)]


def features_of(kind: Kind, span: Column) -> Column:
    """Hashed features of the final classifier: the word before, the character after, the span's shape, its signs, its size."""
    shape = F.left(F.regexp_replace(F.regexp_replace(span["match"], "[0-9]+", "9"), "[A-Za-z]+", "a"), F.lit(24))
    signs = F.left(F.regexp_replace(span["match"], "[A-Za-z0-9]", ""), F.lit(8))
    plain = [F.lower(F.regexp_extract(span["before"], r"(\p{L}+)\P{L}*$", 1)), F.left(span["after"], F.lit(1)), shape, signs,
             F.least(F.length(digits(span["match"])), F.lit(20)).cast("string")]
    return F.array(*[(F.crc32(F.concat(F.lit(f"{kind.name}|{k}|"), f).cast("binary")) % BUCKETS).cast("int") for k, f in enumerate(plain)])


def spans_of(text: Column, number: int, kind: Kind, strict: bool) -> Column:
    """The strict spans of a kind, or the looser candidates that are none of them, as SPAN."""
    if strict:
        found = F.filter(matches(text, kind.strict), lambda s: kind.valid(s["match"]))
    else:
        found = F.filter(matches(text, kind.loose), lambda s: ~F.coalesce(s["match"].rlike(f"^(?:{kind.strict})$") & kind.valid(s["match"]), F.lit(False)))

    def span(s: Column) -> Column:
        votes = F.lit(0)
        for vote in votes_of(kind, s, strict):
            votes = votes * 3 + vote
        return F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), features_of(kind, s).alias("features"))

    return F.when(text.rlike(kind.hint if strict else kind.loose_hint), F.transform(found, span)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def unpacked(votes: int, n: int) -> tuple[int, ...]:
    return tuple(votes // 3 ** (n - 1 - j) % 3 for j in range(n))


def posteriors(counts: Mapping[tuple[int, int], int], labelers: int = 5, rounds: int = ROUNDS) -> dict[tuple[int, int], float]:
    """Expectation-maximisation over (kind, votes) counts: how likely a span with such votes is personal data.

    The labelers are independent given the truth, and share their reliabilities over the kinds; every kind has its own share of
    truths. It starts from the majority of the votes. As many counts as there are kinds and vote patterns, whatever the table's size.
    """
    cases = sorted(counts)
    votes = {c: unpacked(c[1], labelers) for c in cases}
    likely = {c: 1 / (1 + math.exp(-2.0 * sum(v - SILENT for v in votes[c]))) for c in cases}
    for _ in range(rounds):
        share, says = {}, [[[1.0] * 3, [1.0] * 3] for _ in range(labelers)]
        for c in cases:
            own = share.setdefault(c[0], [1.0, 1.0])
            for truth, p in enumerate((1 - likely[c], likely[c])):
                own[truth] += p * counts[c]
                for j, v in enumerate(votes[c]):
                    says[j][truth][v] += p * counts[c]
        for c in cases:
            logs = [math.log(share[c[0]][truth]) + sum(math.log(says[j][truth][v] / sum(says[j][truth])) for j, v in enumerate(votes[c])) for truth in (0, 1)]
            likely[c] = 1 / (1 + math.exp(min(700.0, logs[0] - logs[1])))
    return likely


def label_spans(found: DataFrame) -> tuple[dict[tuple[int, int], float], list[float], float]:
    """What the labelers' votes are worth, the classifier's weight of each feature, and its intercept; found holds strict and loose."""
    spans = found.select(F.explode(F.concat("strict", "loose")).alias("s")).select("s.*")
    counts = {(r["kind"], r["votes"]): r["count"] for r in spans.groupBy("kind", "votes").count().collect()}
    likely = posteriors(counts)
    if not likely:
        return {}, [0.0] * BUCKETS, 0.0
    # Millionths, so that sums are exact and no order of rows changes them.
    parts = {c: round(p * 1e6) for c, p in likely.items()}
    worth = F.lit(0)
    for (kind, votes), p in parts.items():
        worth = F.when((F.col("kind") == kind) & (F.col("votes") == votes), F.lit(p)).otherwise(worth)
    seen = spans.select(F.explode("features").alias("f"), worth.cast("long").alias("p")).groupBy("f").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    yes, no = sum(counts[c] * parts[c] for c in counts) / 1e6 + 1, sum(counts[c] * (1_000_000 - parts[c]) for c in counts) / 1e6 + 1
    weights = [0.0] * BUCKETS
    for r in seen:
        weights[r["f"]] = math.log((r["p"] / 1e6 + 1) / (yes + 2)) - math.log((r["n"] - r["p"] / 1e6 + 1) / (no + 2))
    return likely, weights, math.log(yes / no)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id under its own name, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Strict spans, leftmost and without overlaps within a kind: e-mail addresses, dotted quads with parts up to 255, digit groups
    of 16 to 19 digits with a right check digit, numbers with + and 8 to 15 digits; matches that fail are dropped, not retried.
    base_sha256 is the hash of "kind:start:end" of these (code points, end exclusive) by kind, then start, joined by commas.

    Added spans: looser candidates (spelled-out or bracketed "at" and "dot", other separators, missing plus signs) that overlap no
    strict span. Five labelers (the strict pattern, a shape, a gazetteer, words before the span that speak for it, and against it)
    vote on strict spans and candidates; expectation-maximisation over the counts of vote patterns estimates how far each is right.
    Its beliefs are the soft labels of a classifier over hashed features (the words and characters around, shape, signs, size).
    A candidate is added where both the beliefs and the classifier are above one half. spans lists strict and added ones.

    Null and empty texts have no spans, and the hash of the empty text. Texts are read whole, in time linear in their length but
    for the overlap test, which takes candidates times strict spans of a document. Repeated rows and null ids are judged each, an
    empty table gives an empty result, other columns are not looked at.

    One narrow pass reads the texts and writes the spans; the votes and features are small aggregates of those, of which the
    driver gets at most 4 * 243 counts and 2048 sums.
    """
    text = F.col("text")
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    strict, loose = (F.concat(*[spans_of(text, k, kind, s) for k, kind in enumerate(KINDS)]) for s in (True, False))
    apart = lambda c: ~F.exists("strict", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    found = stage(whole.select("id", strict.alias("strict"), loose.alias("loose")).select("id", "strict", F.filter("loose", apart).alias("loose")), "spans")

    likely, weights, intercept = label_spans(found)
    good = {c for c, p in likely.items() if p > 0.5}
    weight = F.array(*[F.lit(w) for w in weights])

    def added(c: Column) -> Column:
        votes = F.lit(False)
        for kind, v in sorted(good):
            votes = votes | ((c["kind"] == kind) & (c["votes"] == v))
        return votes & (F.aggregate(c["features"], F.lit(intercept), lambda total, f: total + F.get(weight, f)) > 0)

    def listed(spans: Column) -> Column:
        names = F.array(*[F.lit(k.name) for k in KINDS])
        return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))),
                                        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(number: int) -> Column:
        return F.size(F.filter("strict", lambda s: s["kind"] == number)).cast("long")

    out = found.withColumn("added", F.filter("loose", added))
    counts = [of_kind(k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(listed(F.col("strict")).cast("binary"), 256).alias("base_sha256"),
                      listed(F.concat("strict", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
