"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates come from the base patterns (whose valid matches always stay) and from looser ones: spelled-out addresses,
eight-group IP addresses, card numbers grouped by dots, phone numbers without a plus, base matches that failed
their check, and long mixed strings that may be a secret (a key, token or password). Five labelers vote -1, 0 or 1 on
each: the pattern that found it, the shape (checksum, ranges, digits), a gazetteer (top-level domains, reserved ranges,
issuer prefixes, calling codes, lengths of digests and prefixes of keys), the words just before, and the neighbouring
characters. Candidates with the same votes and features are counted; expectation-maximisation over those counts
estimates, per kind, how reliable each labeler is, and its posteriors train a logistic span classifier over votes,
length and neighbours. Accepted looser candidates that overlap no base span of their kind are added.

Positions need no user code: a match starts where the lengths of the pieces and matches before it end. All of a
text's spans are computed in its own row: no shuffle. The counts are one row per combination of votes and features, of
which there are at most 5 * 3**5 * 4 * 3 * 3, so the model is fitted from a table of bounded size.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; matches of one kind are
leftmost and do not overlap, a failed one is not retried; different kinds may overlap; repeated rows give repeated
results; without candidates nothing is fitted; very long texts and runs are scanned in linear time; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.storage import materialize

# Fixed values. The base patterns, written so that a run of characters is scanned once: possessive where greedy means
# the same, and an address only begins where its run does (or where the match before ended).
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}",
    "card": r"[0-9]{4}(?:[.][0-9]{4}){2}[.][0-9]{1,7}",
    "phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "secret": r"(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+.-]{20,}+",
}
#: What a text must hold for a pattern to be tried at all: cheap scans.
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_GATES = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]\.[0-9]{4}\.", "phone": r"[0-9]\)?[ .-][0-9]{3}[ .-]", "secret": r"[0-9][A-Za-z0-9_/+.-]{19}|[A-Za-z0-9_/+.-]{19}[0-9]"}
CUES = {
    "email": r"(?i)(e-?mail|contact|write to|mailto|reply)\W{0,3}(\w+\W{1,2}){0,2}$",
    "ip": r"(?i)\b(ip|host|server|address|login from|client)\W{0,3}(\w+\W{1,2}){0,2}$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|debit|payment)\W{0,3}(\w+\W{1,2}){0,2}$",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|whatsapp)\W{0,3}(\w+\W{1,2}){0,2}$",
    "secret": r"(?i)(token|secret|passw(or)?d|api[_ -]?key|private[_ -]?key|credential|bearer|auth)\w{0,8}\W{0,6}$",
}
NO_SECRET = r"(?i)(https?:\S{0,30}|www\S{0,30}|commit|revision|etag|checksum|sha-?[0-9]{0,3}|md5)\W{0,4}$"
AGAINST = r"(?i)\b(version|release|v|section|chapter|isbn|issn|order|invoice|serial|sku|rfc|build|token|password|hash|id|no)\W{0,3}$"
DOMAINS = r"(?i)\.(com|org|net|edu|gov|info|biz|io|eu|de|fr|es|uk|it|nl|at|ch|be|pl|pt|se|ca|us|au|jp|in|br|mx)$"
RESERVED = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
ISSUERS = r"^(4[0-9]{12,18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14}|6(011|5)[0-9]{12,15}|62[0-9]{12,17})$"
CALLING = r"^\+(1|7|20|27|3[0-4]|36|39|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1-2]|84|86|9[0-5]|98)"

#: Beginnings of published kinds of keys, and hexadecimal strings as long as a digest.
KEYS = r"^(sk-|pk_|sk_|rk_|gh[opsu]_|xox[abp]-|AKIA|ASIA|eyJ|AIza|glpat-)|^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{64}$"

SPAN = "array<struct<start:int,end:int,value:string,before:string,left:string,right:string>>"


def _found(text: Column, pattern: str, gate: str) -> Column:
    """All matches with their places and what stands around them, in order.

    Places and neighbours come from the pieces between the matches, so a text is not walked again for each match; what
    stands before a match reaches back to the match before it at most.
    """

    def build(gaps: Column) -> Column:
        pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, gap: F.struct(m.alias("value"), gap.alias("gap")))
        pairs = F.filter(F.zip_with(pairs, F.slice(gaps, 2, F.size(gaps)), lambda x, after: F.struct(x["value"].alias("value"), x["gap"].alias("gap"), after.alias("after"))), lambda x: x["value"].isNotNull())
        return X.once(pairs, placed)

    def placed(pairs: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def step(done: Column, x: Column) -> Column:
            begin = done["at"] + F.length(x["gap"])
            return F.struct((begin + F.length(x["value"])).alias("at"), F.concat(done["starts"], F.array(begin)).alias("starts"))

        def one(x: Column, start: Column) -> Column:
            left = F.when(x["gap"] == "", F.when(start > 0, "0").otherwise("")).otherwise(F.substring(x["gap"], -1, 1))
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.substring(x["gap"], -40, 40).alias("before"), left.alias("left"), F.substring(x["after"], 1, 1).alias("right"))

        return F.zip_with(pairs, F.aggregate(pairs, none, step, lambda done: done["starts"]), one)

    return F.when(text.rlike(gate), X.once(F.split(text, pattern, -1), build)).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the checksum of a string of digits hold? From the right, every second digit counts twice."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((n - i) % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int") * 2).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return (n > 0) & (F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))


def valid(kind: str, value: Column) -> Column:
    """The check that a match of a base pattern must pass."""
    if kind == "ip":
        return _octets(value)
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, F.lit(1))
    return (vote.when(no, F.lit(-1)) if no is not None else vote).otherwise(F.lit(0))


def _shape(kind: str, value: Column) -> Column:
    if kind == "email":
        return _vote(~value.contains("..") & (F.length(value) <= 254), value.contains("..") | (F.length(value) > 254))
    if kind == "ip":
        eight = value.contains(":")
        fine = eight | (_octets(value) & ~value.rlike(r"(^|\.)0[0-9]"))
        return _vote(fine, ~fine)
    if kind == "secret":
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return _vote(mixed & ~value.rlike(r"[/.]"), ~mixed | value.rlike(r"[/.].*[/.]"))
    digits = _digits(value)
    fine = F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False) if kind == "card" else F.length(digits).between(10, 15)
    return _vote(fine, ~fine)


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        return _vote(value.rlike(DOMAINS), value.rlike(r"\.[0-9]+$"))
    if kind == "ip":
        return _vote(~value.rlike(RESERVED), value.rlike(RESERVED))
    if kind == "card":
        return _vote(_digits(value).rlike(ISSUERS), ~_digits(value).rlike(ISSUERS))
    if kind == "secret":
        return _vote(value.rlike(KEYS), value.rlike(r"\.[a-z]{2,4}$"))
    return _vote(value.rlike(CALLING))


def _candidates(text: Column, kind: str, base: bool) -> Column:
    """The matches of one pattern, each with its labelers' votes and features in one string."""
    order = KINDS.index(kind)

    def describe(x: Column) -> Column:
        value = x["value"]
        strict = valid(kind, value) if base else F.lit(False)
        before, left, right = x["before"], x["left"], x["right"]
        side = lambda c: F.when(c.rlike(r"[A-Za-z0-9]"), "w").when(c.rlike(r"[\s]") | (c == ""), "s").otherwise("p")
        votes = (
            F.lit(1 if base else 0), _shape(kind, value), _gazetteer(kind, value), _vote(before.rlike(CUES[kind]), before.rlike(NO_SECRET if kind == "secret" else AGAINST)),
            _vote((side(left) != "w") & (side(right) != "w"), (side(left) == "w") | (side(right) == "w")),
        )
        long = F.when(F.length(value) < 11, "0").when(F.length(value) < 16, "1").when(F.length(value) < 24, "2").otherwise("3")
        features = F.concat_ws(" ", F.lit(str(order)), *(v.cast("string") for v in votes), long, side(left), side(right))
        return F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end"), strict.alias("base"), features.alias("features"))

    patterns, gates = (BASE, GATES) if base else (LOOSE, LOOSE_GATES)
    return F.transform(_found(text, patterns[kind], gates[kind]), describe)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and all candidate spans of each row: start, kind (its place in KINDS), end, base, features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = F.concat(*(_candidates(text, kind, base) for kind in KINDS for base in (True, False) if not base or kind in BASE))
    return rows.select("id", found.alias("found"))


def estimate(counts: dict[tuple[str, ...], int], rounds: int = 40) -> tuple[dict[tuple[str, ...], float], list[float]]:
    """Expectation-maximisation over (votes) -> count: the posterior of each pattern that its candidates are real, and
    each labeler's reliability (how often its votes, where it votes, agree with the posteriors).

    The first guess is the sign of the sum of votes; shares are smoothed by one vote of each value.
    """
    posterior = {v: 0.95 if sum(map(int, v)) > 1 else 0.05 for v in counts}
    values = ("-1", "0", "1")
    labelers = range(len(next(iter(counts))))
    for _ in range(rounds):
        weight = [sum(n * (q if y else 1 - q) for n, q in ((counts[v], posterior[v]) for v in counts)) for y in (0, 1)]
        share = [(w + 1) / (sum(weight) + 2) for w in weight]
        seen = [[{x: 1.0 for x in values} for _ in labelers] for _ in (0, 1)]
        for v, n in counts.items():
            for i in labelers:
                seen[1][i][v[i]] += n * posterior[v]
                seen[0][i][v[i]] += n * (1 - posterior[v])
        score = lambda v, y: math.log(share[y]) + sum(math.log(seen[y][i][v[i]] / (weight[y] + 3)) for i in labelers)  # noqa: B023, E731
        posterior = {v: 1 / (1 + math.exp(max(-700, min(700, score(v, 0) - score(v, 1))))) for v in counts}
    reliability = []
    for i in labelers:
        voted = sum(n for v, n in counts.items() if v[i] != "0")
        agreed = sum(n * (posterior[v] if v[i] == "1" else 1 - posterior[v]) for v, n in counts.items() if v[i] != "0")
        reliability.append((agreed + 1) / (voted + 2))
    return posterior, reliability


@dataclass
class Model:
    """probability by features, and the reliability of each kind's labelers, in the order of LABELERS."""

    probability: dict[str, float]
    reliability: dict[str, list[float]]


LABELERS = ("pattern", "shape", "gazetteer", "context", "neighbours")


def train(counts: dict[str, int], rounds: int = 300, rate: float = 0.5) -> Model:
    """features -> count; a logistic classifier fitted to the posteriors of the votes."""
    target: dict[str, float] = {}
    reliability: dict[str, list[float]] = {}
    for kind in sorted({f.split(" ")[0] for f in counts}):
        votes: dict[tuple[str, ...], int] = {}
        own = [f for f in counts if f.split(" ")[0] == kind]
        for f in own:
            key = tuple(f.split(" ")[1:6])
            votes[key] = votes.get(key, 0) + counts[f]
        posterior, reliability[KINDS[int(kind)]] = estimate(votes)
        target |= {f: posterior[tuple(f.split(" ")[1:6])] for f in own}
    inputs = {f: [f"{i}{x}" for i, x in enumerate(f.split(" "))] + [f"{f.split(' ')[0]}/{i}{x}" for i, x in enumerate(f.split(" ")[1:6])] for f in counts}
    size = {f: math.log1p(n) for f, n in counts.items()}  # a frequent pattern must not drown the rare ones
    total = sum(size.values()) or 1.0
    weights = {name: 0.0 for names in inputs.values() for name in names}
    probability: dict[str, float] = {}
    for _ in range(rounds):
        probability = {f: 1 / (1 + math.exp(-max(-30, min(30, sum(weights[x] for x in names))))) for f, names in inputs.items()}
        step = dict.fromkeys(weights, 0.0)
        for f, names in inputs.items():
            error = (target[f] - probability[f]) * size[f] / total
            for x in names:
                step[x] += error
        for x in weights:
            weights[x] += rate * (step[x] - 1e-4 * weights[x])
    return Model(probability, reliability)


def fit(spans: DataFrame) -> Model:
    """The model of a table of candidates."""
    counted = spans.select(F.explode("found").alias("c")).groupBy("c.features").agg(F.count(F.lit(1)).alias("n"))
    return train({r.features: r.n for r in counted.toLocalIterator()})


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """One row per input row: id and spans, an array of (start, kind, end, base, probability) by start, then kind.

    sure: the probability from which the classifier adds a looser candidate. probability is the classifier's own for
    added and base spans alike; base spans stay whatever it is.
    """
    spans = materialize(candidates(docs, id_col, text_col), "pii-candidates")
    model = fit(spans)
    rated = F.map_from_arrays(F.array(*(F.lit(f) for f in sorted(model.probability))).cast("array<string>"), F.array(*(F.lit(model.probability[f]) for f in sorted(model.probability))).cast("array<double>"))
    base = F.filter("found", lambda x: x["base"])
    apart = lambda x: ~F.exists(base, lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]))
    probability = lambda x: F.coalesce(F.element_at(rated, x["features"]), F.lit(0.0))
    added = F.filter("found", lambda x: ~x["base"] & (probability(x) >= sure) & apart(x))
    plain = F.transform(F.concat(base, added), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"), probability(x).alias("probability")))
    return spans.select("id", F.array_sort(plain).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: reduce(lambda c, i: c.when(k == i, KINDS[i]), range(1, len(KINDS)), F.when(k == 0, KINDS[0]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
