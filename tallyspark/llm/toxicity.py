"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reporting and the like. Six small
transducers read the symbols of a clause: one emits insults; one threats that need a target
soon after ("kill you"); one threats whose target stands in front, with a word of will or
wish ("you should die", "they will be beaten"); one marks whether a target is near, one
whether a negation reaches the word, one whether the clause reports somebody else's words.
Their product is built once as a table, so a clause is read in one walk. A clause with a
match is read once more from its end, by the product of the machines that look there: for a
target behind an insult and for attribution in its last two words ("you idiot, he said").
Verb forms come from stems by a rule. Each match has a kind (threat, targeted, plain,
negated, reported), a clause has the weight of its strongest match, and a document is
described by how many clauses have which kind; each further clause of a kind adds less.

Weights and lexicon come from labelled rows: words that are found in toxic rows almost only
join the built-in insults, and the weight of each kind is fitted by logistic regression on
the table of clause counts by label, with the built-in weights as prior.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import saved

SAMPLE_ROWS = 8000  # labelled rows the lexicon is learned from, about
LEARNED_WORDS = 500  # of them, at most
THRESHOLD = 0.3

# The built-in lexicon (English, German, French, Spanish).
INSULTS = """
idiot idiots moron morons imbecile stupid dumb pathetic worthless disgusting trash scum loser
losers clown clowns garbage vermin filth filthy bastard bastards bitch asshole jerk retard
retarded dumbass degenerate parasite parasites subhuman
dummkopf trottel vollidiot arschloch abschaum missgeburt blödmann
connard connasse salaud imbécile crétin débile ordure
idiota imbécil estúpido estúpida basura pendejo gilipollas escoria
""".split()
THREAT_STEMS = "kill murder stab strangle destroy burn hang rape punish slaughter choke".split()
THREATS = """
hurt hurts hurting beat beats beating shoot shoots shooting
töten umbringen verprügeln tuer frapper matar golpear quemar
""".split()
DOOMS = """
die burn hang hurt suffer perish rot bleed mourir crever brûler morir arder
""".split()
PARTICIPLES = "beaten shot hung hurt burnt dead tué tuée pendu muerto muerta".split()
MODALS = """
will would should must shall gonna going deserve deserves need needs might may
vas va allez vont dois doit devez doivent debes debe deberías merece
""".split()
WISHES = "hope wish want espère espero ojalá".split()
SUBJECTS = "you u he she they ur tu vous ils elles te ustedes".split()
WILLING_SUBJECTS = "you'll he'll she'll they'll you’ll he’ll she’ll they’ll".split()
TARGETS = """
you your yours yourself u ur they them their he him she her these those all
du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos ellas
""".split()
NEGATIONS = """
not no never nobody none neither nor without isn't aren't wasn't weren't don't doesn't didn't
won't wouldn't cannot can't nicht kein keine nie niemals pas jamais ne sans no nunca jamás sin
""".split()
REPORTS = """
said says say saying called calls calling wrote writes written claimed claims quote quoted quotes
reported reports alleged according sagte sagt nannte schrieb dit disait appelle écrit dijo dice
llamó escribió
""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
DOOM, PARTICIPLE, MODAL, WISH, SUBJECT, WILLING_SUBJECT = range(6, 12)
_SYMBOLS = 12
_TARGETS = (TARGET, SUBJECT, WILLING_SUBJECT)
KINDS = ("threat", "targeted", "plain", "negated", "reported")  # strongest first
PRIOR = (3.0, 3.5, 3.0, 0.6, 0.9)  # log odds a clause of the kind adds
PRIOR_BASE = -2.8
_PRIOR_ROWS = 1.0  # precision of the prior
_NEAR, _REACH = 4, 3  # words a target and a negation reach

_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1 from 0; ``step(state, symbol)`` gives the next state and an output."""

    states: int
    step: Callable[[int, int], tuple[int, bool]]


def _insult(state: int, symbol: int) -> tuple[int, bool]:
    return 0, symbol == INSULT


def _threat(state: int, symbol: int) -> tuple[int, bool]:
    """A threat word arms the machine for a few words; a target then completes the threat."""
    if symbol in (THREAT, DOOM):
        return _NEAR, False
    return (0, True) if symbol in _TARGETS and state else (max(0, state - 1), False)


def _doom(state: int, symbol: int) -> tuple[int, bool]:
    """Subject, then will; or wish, then target; then, within a few words, what befalls it.

    The state is phase * _NEAR + words left: phase 0 has a subject, 1 a wish, 2 both.
    """
    phase, left = divmod(state - 1, _NEAR) if state else (0, 0)
    if symbol in (DOOM, PARTICIPLE) and state and phase == 2:
        return 0, True
    if symbol == WILLING_SUBJECT or (
        state and ((phase == 0 and symbol == MODAL) or (phase == 1 and symbol in _TARGETS))
    ):
        return 3 * _NEAR, False
    if symbol == SUBJECT and not (state and phase == 2):
        return _NEAR, False
    if symbol == WISH:
        return 2 * _NEAR, False
    return (state - 1 if left else 0), False


def _near_target(state: int, symbol: int) -> tuple[int, bool]:
    state = _NEAR if symbol in _TARGETS else max(0, state - 1)
    return state, state > 0


def _negated(state: int, symbol: int) -> tuple[int, bool]:
    state = _REACH + 1 if symbol == NEGATION else max(0, state - 1)
    return state, state > 0


def _reported(state: int, symbol: int) -> tuple[int, bool]:
    state = 1 if state or symbol == REPORT else 0
    return state, bool(state)


def _attributed(state: int, symbol: int) -> tuple[int, bool]:
    """Read from the end: a reporting verb among the first two words. State 3 is yes."""
    if state < 2 and symbol == REPORT:
        return 3, True
    return (state, state == 3) if state >= 2 else (state + 1, False)


def _match(
    insult: bool, threat: bool, doom: bool, near: bool, negated: bool, reported: bool
) -> int:
    """The kind of a match as its place in ``KINDS``, or -1."""
    if not (insult or threat or doom):
        return -1
    if reported:
        return 4
    if negated:
        return 3
    if threat or doom:
        return 0
    return 1 if near else 2


def _match_from_end(insult: bool, near: bool, negated: bool, attributed: bool) -> int:
    """Attribution counts for the whole clause, so it is told without a match, too."""
    if attributed:
        return 4
    return 1 if insult and near and not negated else -1


MACHINES = (
    Transducer(1, _insult),
    Transducer(_NEAR + 1, _threat),
    Transducer(3 * _NEAR + 1, _doom),
    Transducer(_NEAR + 1, _near_target),
    Transducer(_REACH + 2, _negated),
    Transducer(2, _reported),
)
MACHINES_FROM_END = (
    Transducer(1, _insult),
    Transducer(_NEAR + 1, _near_target),
    Transducer(_REACH + 2, _negated),
    Transducer(4, _attributed),
)


@cache
def compose(
    machines: tuple[Transducer, ...], match: Callable[..., int]
) -> list[list[tuple[int, int]]]:
    """The product of the machines: per state and symbol the next state and the match.

    Only states that some clause reaches are in it.
    """
    start = (0,) * len(machines)
    number, table, open_states = {start: 0}, [], [start]
    for state in open_states:  # grows while it is read
        row = []
        for symbol in range(_SYMBOLS):
            moves = [m.step(own, symbol) for m, own in zip(machines, state, strict=True)]
            after = tuple(new for new, _ in moves)
            if after not in number:
                number[after] = len(number)
                open_states.append(after)
            row.append((number[after], match(*(output for _, output in moves))))
        table.append(row)
    return table


def inflected(stem: str) -> tuple[list[str], str]:
    """Third person and present participle of an English verb, and its past participle."""
    if stem.endswith("e"):
        return [stem, stem + "s", stem[:-1] + "ing"], stem + "d"
    hissing = stem.endswith(("sh", "ch", "ss", "x"))
    short = len(stem) <= 4 and stem[-1] not in "aeiouwxyl" and stem[-2] in "aeiou"
    doubled = stem + stem[-1] if short and stem[-3] not in "aeiou" else stem
    return [stem, stem + ("es" if hissing else "s"), doubled + "ing"], doubled + "ed"


def lexicon(learned: Iterable[str] = ()) -> dict[str, int]:
    forms = [inflected(stem) for stem in THREAT_STEMS]
    symbols = {}
    for words, symbol in (
        (learned, INSULT),
        (REPORTS, REPORT),
        (NEGATIONS, NEGATION),
        (TARGETS, TARGET),
        (SUBJECTS, SUBJECT),
        (WILLING_SUBJECTS, WILLING_SUBJECT),
        (MODALS, MODAL),
        (WISHES, WISH),
        (PARTICIPLES, PARTICIPLE),
        ([past for _, past in forms], PARTICIPLE),
        ([word for present, _ in forms for word in present], THREAT),
        (THREATS, THREAT),
        (DOOMS, DOOM),
        (INSULTS, INSULT),
    ):
        symbols.update((word, symbol) for word in words)
    return symbols


class Grammar:
    def __init__(self, symbols: dict[str, int]) -> None:
        self._symbols = symbols
        self._table = compose(MACHINES, _match)
        self._from_end = compose(MACHINES_FROM_END, _match_from_end)
        told = (INSULT, THREAT, DOOM, PARTICIPLE)
        self._triggers = frozenset(w for w, s in symbols.items() if s in told)

    def clause(self, words: list[str]) -> int:
        """The strongest match of a clause, as a place in ``KINDS``, or -1."""
        state, strongest = 0, len(KINDS)
        symbols = [self._symbols.get(word, OTHER) for word in words]
        for symbol in symbols:
            state, match = self._table[state][symbol]
            if 0 <= match < strongest:
                strongest = match
        if strongest > 2:  # the end cannot change what is negated or reported already
            return strongest if strongest < len(KINDS) else -1
        state = 0
        for symbol in reversed(symbols):
            state, match = self._from_end[state][symbol]
            if match == 4:
                return 4
            if match == 1:
                strongest = min(strongest, 1)
        return strongest

    def all_counts(self, text: str | None) -> list[int]:
        """Clauses of each kind."""
        found = [0] * len(KINDS)
        if not text:
            return found
        lowered = text.lower()
        if self._triggers.isdisjoint(_TOKEN.findall(lowered)):
            return found
        for part in _CLAUSE.split(lowered):
            words = _TOKEN.findall(part)
            if not self._triggers.isdisjoint(words):
                kind = self.clause(words)
                if kind >= 0:
                    found[kind] += 1
        return found


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, toxic, clean``: documents of a partition that hold the word."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for text, toxic in zip(texts, labels, strict=True):
            for word in set(_TOKEN.findall((text or "").lower())):
                counts.setdefault(word, [0, 0])[0 if toxic else 1] += 1
    if counts:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.string()),
                pa.array([pair[0] for pair in counts.values()], pa.int64()),
                pa.array([pair[1] for pair in counts.values()], pa.int64()),
            ],
            names=["word", "toxic", "clean"],
        )


def learn_insults(labelled: DataFrame, rows: int) -> list[str]:
    """Words of ``text, toxic`` found in toxic rows almost only, best first.

    ``rows`` is the number of labelled rows; a hash of the text thins them to about
    ``SAMPLE_ROWS``.
    """
    if not rows:
        return []
    sample = labelled.where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE_ROWS / rows)
    )
    odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    words = (
        sample.mapInArrow(_word_counts, "word string, toxic long, clean long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= 5) & (F.col("toxic") >= 8 * F.col("clean")))
        .orderBy(odds.desc(), "word")
        .limit(LEARNED_WORDS)
    )
    return [row["word"] for row in words.select("word").collect()]


def _evidence(clauses: int) -> float:
    """One clause counts 1, more of a kind less and less, but never nothing."""
    return float(np.log2(1 + clauses))


def fit(patterns: Iterable[tuple[Sequence[int], int, int]]) -> list[float]:
    """Base log odds and the weight per kind, from rows of (counts, toxic, clean).

    Logistic regression by Newton steps towards the prior; a kind never seen keeps its
    prior weight.
    """
    rows = list(patterns)
    prior = np.array([PRIOR_BASE, *PRIOR])
    if not rows:
        return prior.tolist()
    x = np.array([[1.0, *map(float, counts)] for counts, _, _ in rows])
    toxic = np.array([row[1] for row in rows], dtype=float)
    total = toxic + np.array([row[2] for row in rows], dtype=float)
    weights = prior.copy()

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((total * np.logaddexp(0, z) - toxic * z).sum()) + 0.5 * _PRIOR_ROWS * float(
            ((at - prior) ** 2).sum()
        )

    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ weights))
        gradient = x.T @ (total * p - toxic) + _PRIOR_ROWS * (weights - prior)
        curve = (x * (total * p * (1 - p))[:, None]).T @ x + _PRIOR_ROWS * np.eye(len(prior))
        step, scale = np.linalg.solve(curve, gradient), 1.0
        while scale > 1e-4 and loss(weights - scale * step) > loss(weights):
            scale /= 2
        weights = weights - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return weights.tolist()


def _described(symbols: dict[str, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(symbols)
        for batch in batches:
            counts = np.array(
                [grammar.all_counts(text) for text in batch.column(0).to_pylist()], dtype=np.int32
            ).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(place) for place in range(1, batch.num_columns)),
                    *(pa.array(counts[:, kind]) for kind in range(len(KINDS))),
                ],
                names=[*batch.schema.names[1:], *KINDS],
            )

    return run


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    unseen: Column,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``<id>, held_out, score, predicted`` and the clause counts for every row.

    ``labels`` has the id and ``toxic`` (0, 1; null counts for nothing); ``unseen`` is true
    where a row's label must not be learned. Null and empty texts score like any text
    without a match. Repeated rows are scored alike; a label counts for each row of its id.
    Without labels the built-in weights hold. Other columns are ignored.
    """
    rows = documents.select(
        F.col(text_column).alias("text"), F.col(id_column).alias("id"), unseen.alias("held_out")
    )
    known = labels.where("toxic is not null").select(
        F.col(id_column).alias("id"), (F.col("toxic") == 1).alias("is_toxic")
    )
    seen = rows.where(~F.col("held_out")).join(known, "id").select("text", "is_toxic")
    marked = seen.where("text is not null")
    insults = learn_insults(marked, known.count())
    kind = rows.schema["id"].dataType.simpleString()
    described = saved(
        rows.mapInArrow(
            _described(lexicon(insults)),
            f"id {kind}, held_out boolean, " + ", ".join(f"{name} int" for name in KINDS),
        ),
        "toxicity-clauses",
    ).frame
    bits = [F.when(F.col(name) > 0, F.length(F.bin(name))).otherwise(0) for name in KINDS]
    table = (
        described.where(~F.col("held_out"))
        .join(known, "id")
        .groupBy(*(one.alias(name) for one, name in zip(bits, KINDS, strict=True)))
        .agg(F.count_if("is_toxic").alias("toxic"), F.count_if(~F.col("is_toxic")).alias("clean"))
        .collect()
    )  # counts by their power of two, so a bounded number of rows
    weights = fit(
        ([_evidence(1 << row[name] >> 1) for name in KINDS], row["toxic"], row["clean"])
        for row in sorted(table, key=lambda row: [row[name] for name in KINDS])
    )
    odds = F.lit(weights[0])
    for name, weight in zip(KINDS, weights[1:], strict=True):
        odds = odds + F.lit(weight) * F.log2(F.col(name) + 1.0)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return described.select(
        F.col("id").alias(id_column),
        "held_out",
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
        *KINDS,
    )
