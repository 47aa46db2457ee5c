"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Labelers vote on each: a strict format, a gazetteer, cue words in
front of the span, and the characters around it. Expectation-maximisation over the table of
vote patterns (Dawid and Skene, 1979) estimates how reliable each labeler is, without
labels; its posteriors train a logistic span classifier on votes and shape. Proposals of
the four base kinds are always kept; others (secrets, names, phone numbers without country
code) are kept if the classifier says so.

Both tables are counts per pattern, of bounded size; the models are fitted on them in the
driver and come back as column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_PLACES = "array<struct<start:bigint,end:bigint,value:string>>"
_CONTEXT = 32  # characters in front of a span that cue words are sought in
ACCEPT = 0.5

# Gazetteers and cue words.
_TLDS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|it|nl|ch|at|be|eu|us|ca|mx|ar|cl"
_GIVEN = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|"
    "Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Daniel|Nancy|Matthew|Lisa|Anna|"
    "Hans|Peter|Klaus|Jürgen|Ursula|Monika|Sabine|Jean|Pierre|Marie|Michel|Claire|François|"
    "José|María|Carmen|Juan|Luis|Ana|Carlos|Antonio|Laura|Pablo|Lucía"
)
_SECRET_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
_CUES = {
    "email": "mail|contact|write to|correo|kontakt|courriel",
    "ip": r"\bip\b|server|host|address|adresse",
    "card": "card|visa|master|amex|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel|llam",
    "secret": f"{_SECRET_NAMES}|credential|login",
    "name": r"\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|señor|señora|name|dear)\b",
    "local_phone": "phone|call|tel|mobile|fax",
}


@dataclass(frozen=True)
class Kind:
    """What proposes spans, which of them stand, and what the labelers look for."""

    name: str
    pattern: str
    needs: Callable[[Column], Column]  # a cheap test; without it the text has none
    strict: str
    known: str
    valid: Callable[[Column], Column] = field(default=lambda value: F.lit(True))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda place: F.when(
            place % 2 == 0,
            F.substr(digits, place, F.lit(1)).cast("int") * 2,
        ).otherwise(F.substr(digits, place, F.lit(1)).cast("int")),
    )
    total = F.aggregate(
        doubled,
        F.lit(0),
        lambda sum_, one: sum_ + F.when(one > 9, one - 9).otherwise(one),
    )
    count = F.length(digits)
    return F.when((count >= 14) & (count <= 19), total % 10 == 0).otherwise(F.lit(False))


def _holds(*marks: str) -> Callable[[Column], Column]:
    return lambda text: reduce(or_, (F.contains(text, F.lit(mark)) for mark in marks))


def _has_digit(text: Column) -> Column:
    return F.rlike(text, F.lit("[0-9]"))


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# The first alternative of a pattern keeps the search linear: a match can only begin where
# a run of its characters begins, or right behind the match before. Groups are repeated
# possessively, as other repeats of a group take stack for every turn.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _holds("@"),
        r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+$",
        rf"(?i)\.(?:{_TLDS})$",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        _has_digit,
        r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
        r"^(?!0\.|255\.|1\.2\.3\.4)",
        lambda value: F.rlike(value, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        _has_digit,
        r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$",
        r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
        _luhn,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        _holds("+"),
        r"^\+[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,4}[0-9]?$",
        r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
        lambda value: F.length(_digits(value)).between(10, 15),
    ),
    Kind(
        "secret",
        rf"(?:AKIA[0-9A-Z]{{16}}|(?i:(?:{_SECRET_NAMES})[\x20]?[=:][\x20]?)\"?"
        r"[A-Za-z0-9+/_-]{8,}+\"?)",
        _holds("AKIA", "=", ":"),
        r"^AKIA[0-9A-Z]{16}$|[=:][\x20]?\"?(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}",
        rf"(?i)^(?:AKIA|(?:{_SECRET_NAMES})\b)",
    ),
    Kind(
        "name",
        rf"\b(?:{_GIVEN})\x20\p{{Lu}}\p{{Ll}}+",
        lambda text: F.rlike(text, F.lit(rf"(?:{_GIVEN})\x20\p{{Lu}}")),
        r"^\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}{2,}$",
        rf"^(?:{_GIVEN})\x20",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+.-])(?<!\+[0-9]{1,3}\x20)\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
        _has_digit,
        r"^(?:\([2-9][0-9]{2}\)\x20|[2-9][0-9]{2}-)[0-9]{3}-[0-9]{4}$",
        r"^\(?[2-9](?:0[1-9]|1[0-9]|[2-9][0-9])",
    ),
)
BASE = ("email", "ip", "card", "phone")
VOTES = ("strict", "known", "cue", "edge")
SHAPE = ("long", "digits", "upper")


def _places(text: Column, pattern: str) -> Column:
    """Start and end (code points, end exclusive) and text of each match.

    The parts between matches give the distances; nothing is searched twice.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(
        between, found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"))
    )
    nothing = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast(_PLACES).alias("places")
    )

    def walk(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        end = start + F.length(step["value"])
        here = F.struct(start.alias("start"), end.alias("end"), step["value"].alias("value"))
        return F.struct(
            end.alias("at"), F.concat(done["places"], F.array(here)).alias("places")
        )

    return F.aggregate(steps, nothing, walk, lambda done: done["places"])


def _vote(test: Column, against: int) -> Column:
    return F.when(test, F.lit(1)).otherwise(F.lit(against))


def _share(value: Column, pattern: str) -> Column:
    """0 to 3: how much of the value the characters are."""
    part = F.length(F.regexp_replace(value, pattern, "")) * 4
    return F.least(F.lit(3), F.floor(part / F.greatest(F.length(value), F.lit(1)))).cast("int")


def _judged(text: Column, place: Column, number: int) -> Column:
    """A proposal with the labelers' votes (1, 0, -1) and its shape."""
    kind, value = KINDS[number], place["value"]
    in_front = F.substr(
        text,
        F.greatest(place["start"] - _CONTEXT + 1, F.lit(1)).cast("int"),
        F.least(place["start"], F.lit(_CONTEXT)).cast("int"),
    )
    around = F.concat(
        F.right(in_front, F.lit(1)), F.substr(text, (place["end"] + 1).cast("int"), F.lit(1))
    )
    return F.struct(
        place["start"].alias("start"),
        F.lit(number).alias("kind"),
        place["end"].alias("end"),
        _vote(F.rlike(value, F.lit(kind.strict)), -1).alias("strict"),
        _vote(F.rlike(value, F.lit(kind.known)), -1).alias("known"),
        _vote(F.rlike(in_front, F.lit(f"(?i)(?:{_CUES[kind.name]})")), 0).alias("cue"),
        _vote(~F.rlike(around, F.lit(r"[\p{L}\p{N}_@]")), -1).alias("edge"),
        F.least(F.lit(3), F.floor(F.length(value) / 8)).cast("int").alias("long"),
        _share(value, "[^0-9]").alias("digits"),
        _share(value, r"[^\p{Lu}]").alias("upper"),
    )


def proposals(text: Column) -> Column:
    """All valid proposals in a text that is not null, with votes and shape."""
    fields = "".join(f",{name}:int" for name in (*VOTES, *SHAPE))
    kind_of = f"array<struct<start:bigint,kind:int,end:bigint{fields}>>"

    def of_kind(number: int, kind: Kind) -> Column:
        valid = F.filter(_places(text, kind.pattern), lambda place: kind.valid(place["value"]))
        judged = F.transform(valid, lambda place: _judged(text, place, number)).cast(kind_of)
        return F.when(kind.needs(text), judged).otherwise(F.array().cast(kind_of))

    return F.concat(*(of_kind(number, kind) for number, kind in enumerate(KINDS)))


@dataclass(frozen=True)
class Model:
    """Log-odds weights of the span classifier: bias, kinds, votes, shapes."""

    weights: dict[str, float]

    def accepts(self, span: Column) -> Column:
        """Base kinds always; others above ``ACCEPT``."""
        odds = F.lit(self.weights["bias"])
        for name, weight in self.weights.items():
            if name != "bias":
                column, _, value = name.partition("=")
                odds = odds + F.when(span[column] == int(value), F.lit(weight)).otherwise(
                    F.lit(0.0)
                )
        return (span["kind"] < len(BASE)) | (odds >= math.log(ACCEPT / (1 - ACCEPT)))


def _presumed(vote: int, truth: int) -> float:
    """A labeler before any data: more often right than wrong."""
    return {0: 0.4, 1: 0.45, -1: 0.15}[vote if truth else -vote]


def expectation_maximisation(
    rows: Iterable[tuple[tuple[int, ...], float]], steps: int = 60
) -> tuple[dict[tuple[int, ...], float], list[dict[tuple[int, int], float]], float]:
    """Posterior per vote pattern, the labelers' reliabilities, and the prior.

    ``rows``: vote pattern and how often it occurs. A reliability is the probability of a
    vote given the truth (0 or 1). Votes start out as mostly right, which fixes which of the
    two classes is which; all estimates are smoothed.
    """
    rows = list(rows)
    width = len(rows[0][0]) if rows else len(VOTES)
    trust = [
        {(vote, truth): _presumed(vote, truth) for vote in (-1, 0, 1) for truth in (0, 1)}
        for _ in range(width)
    ]
    prior, posterior = 0.5, {}
    for _ in range(steps):
        for votes, _ in rows:
            yes = math.log(prior) + sum(
                math.log(trust[j][vote, 1]) for j, vote in enumerate(votes)
            )
            no = math.log(1 - prior) + sum(
                math.log(trust[j][vote, 0]) for j, vote in enumerate(votes)
            )
            posterior[votes] = 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))
        total = sum(count for _, count in rows)
        prior = (1 + sum(count * posterior[votes] for votes, count in rows)) / (2 + total)
        for j in range(width):
            for truth in (0, 1):
                mass = {vote: 4 * _presumed(vote, truth) for vote in (-1, 0, 1)}
                for votes, count in rows:
                    own = posterior[votes] if truth else 1 - posterior[votes]
                    mass[votes[j]] += count * own
                whole = sum(mass.values())
                for vote in (-1, 0, 1):
                    trust[j][vote, truth] = mass[vote] / whole
    return posterior, trust, prior


def _classifier(
    rows: list[tuple[dict[str, int], float, float]], steps: int = 400
) -> dict[str, float]:
    """Logistic regression on (features, posterior, count) rows, one weight per value."""
    weights = {"bias": 0.0}
    named = [
        (["bias", *(f"{name}={value}" for name, value in features.items())], target, count)
        for features, target, count in rows
    ]
    for names, _, _ in named:
        weights.update(dict.fromkeys(names, 0.0))
    total = sum(count for _, _, count in named) or 1.0
    squares = dict.fromkeys(weights, 1e-6)
    for _ in range(steps):
        slope = {name: 1e-4 * weight for name, weight in weights.items()}
        for names, target, count in named:
            z = sum(weights[name] for name in names)
            error = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - target) * count / total
            for name in names:
                slope[name] += error
        for name, value in slope.items():
            squares[name] += value * value
            weights[name] -= 0.5 * value / math.sqrt(squares[name])
    return weights


def learn(documents: DataFrame, text_column: str = "text") -> Model:
    """Fit labeler reliabilities and span classifier on all proposals of ``documents``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    spans = documents.select(F.explode(proposals(text)).alias("s"))
    names = ("kind", *VOTES, *SHAPE)
    table = (
        spans.groupBy(*(F.col(f"s.{name}").alias(name) for name in names)).count().collect()
    )  # at most 7 kinds x 36 vote patterns x 64 shapes
    rows = sorted(([row[name] for name in names], row["count"]) for row in table)
    fitted = []
    for number in range(len(KINDS)):
        own = [(values, count) for values, count in rows if values[0] == number]
        votes: dict[tuple[int, ...], float] = {}
        for values, count in own:
            pattern = tuple(values[1 : 1 + len(VOTES)])
            votes[pattern] = votes.get(pattern, 0.0) + count
        posterior, _, _ = expectation_maximisation(sorted(votes.items()))
        fitted += [
            (
                dict(zip(names, values, strict=True)),
                posterior[tuple(values[1 : 1 + len(VOTES)])],
                float(count),
            )
            for values, count in own
        ]
    return Model(_classifier(fitted))


def spans(text: Column, model: Model) -> Column:
    """Accepted spans of a text as ``start, kind, end``, by start, then kind, then end."""
    whole = F.coalesce(text, F.lit(""))
    accepted = F.filter(proposals(whole), model.accepts)
    return F.array_sort(
        F.transform(
            accepted,
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"]),
        ).cast(_SPANS)
    )


def _written(found: Column) -> Column:
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    return F.concat_ws(
        ",",
        F.transform(
            found,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]),
        ),
    )


def digest(
    documents: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``<id>``, counts of the base kinds, a hash of the base spans, and all spans.

    Null texts are empty: no spans, the hash of the empty string. Repeated rows give
    repeated rows, no rows none; a null id passes through. Other columns are ignored.
    """
    found = documents.select(
        F.col(id_column), spans(F.col(text_column), model).alias("__spans")
    )
    every = F.col("__spans")
    base = F.filter(every, lambda s: s["kind"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == number)).cast("bigint")

    return found.select(
        id_column,
        *(count(number).alias(f"n_{name}") for number, name in enumerate(BASE)),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(every).alias("spans"),
    )


def redacted(text: Column, model: Model) -> Column:
    """The text with every accepted span replaced by its kind in brackets.

    Overlapping spans become one replacement, named after the first. Null stays null.
    """
    names = F.array(*(F.lit(f"[{kind.name.upper()}]") for kind in KINDS))
    begun = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def replace(done: Column, s: Column) -> Column:
        free = s["start"] >= done["at"]
        kept = F.substr(
            text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")
        )
        out = F.concat(done["out"], kept, F.element_at(names, s["kind"] + 1))
        return F.struct(
            F.when(free, out).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    def finish(done: Column) -> Column:
        return F.concat(
            done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text))
        )

    found = spans(text, model)
    return F.when(F.size(found) > 0, F.aggregate(found, begun, replace, finish)).otherwise(text)
