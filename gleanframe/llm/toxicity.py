"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.common import held_out, stage
from gleanframe.llm.words import LOWER, Words, as_bytes, beginnings, word_groups, words_of

# Fixed word lists of the grammar; insults are extended from labelled rows.
INSULTS = """idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless disgusting clown
imbecile coward liar vermin freak dumpster idiota estúpido imbécil idiotisch dumm blöd depp arschloch stupide connard""".split()
THREATS = """kill hurt stab shoot murder strangle destroy crush burn beat smash attack hunt töten umbringen schlagen tuer frapper
matar golpear""".split()
TARGETS = """you your yours yourself u ur he him his she her they them their these those du dich dir dein ihr euch sie tu toi ton te vous
votre ils elles tú ti usted ustedes ellos""".split()
NEGATIONS = """not no never neither nor without hardly isn aren wasn weren don doesn didn won cannot can't nicht kein keine nie
niemals ne pas jamais sans ni nunca jamás sin""".split()
REPORTS = """said says say saying wrote writes claimed claims called calls quoted quotes quote told tells reported reports alleged sagte
sagt schrieb dit disait écrit dijo dice escribió""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: A negation reaches so many words ahead.
REACH = 3
#: Clauses end at these bytes; a zero byte ends a text.
BREAKS = np.zeros(256, dtype=np.uint8)
BREAKS[[ord(c) for c in "\0\n.!?;:"]] = 1

#: Labelled rows of each class that are read at most; beginnings of words, in characters, that are taken as insults; how many at
#: most, in how many toxic texts, in which share of them, and how much more frequent in toxic texts (up to MOST_EACH times in a text).
PER_CLASS, STEM, NEW_INSULTS, LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO, MOST_EACH = 3000, (3, 8), 500, 10, 0.015, 8.0, 10
#: Weight of a listed word; weights of learned beginnings are logarithms of ratios, within these bounds.
LISTED, LIGHTEST, HEAVIEST = 3.0, 2.0, 6.0


class Transducer(NamedTuple):
    """A finite-state transducer without final weights: step(state, symbol) gives (state, output symbol)."""

    start: object
    step: object


def negation() -> Transducer:
    """Marks an insult or threat that stands within REACH words after a negation: symbol (kind, negated)."""
    def step(left: int, symbol: int):
        if symbol == NEGATION:
            return REACH, (OTHER, False)
        return max(0, left - 1), (symbol, left > 0)

    return Transducer(0, step)


def reported() -> Transducer:
    """From a verb of speech to the end of the clause everything is reported: symbol (kind, negated, reported)."""
    def step(on: bool, symbol):
        kind, negated = symbol
        return on or kind == REPORT, (kind, negated, on)

    return Transducer(False, step)


def targeted() -> Transducer:
    """Keeps what a clause has: a target, and for insults and threats the strongest reading met (plain beats negated or reported)."""
    def step(state, symbol):
        target, found = state
        kind, negated, quoted = symbol
        if kind == TARGET:
            return (True, found), None
        if kind in (INSULT, THREAT):
            reading = (kind, negated, quoted)
            found = min(found, reading, key=lambda r: (r is None, r and (r[1], r[2], r[0] == INSULT)))
        return (target, found), None

    return Transducer((False, None), step)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Reads a's input; a's output is b's input."""
    def step(state, symbol):
        sa, out = a.step(state[0], symbol)
        sb, out = b.step(state[1], out)
        return (sa, sb), out

    return Transducer((a.start, b.start), step)


class Grammar(NamedTuple):
    table: list[list[int]]  #: next state by state and word class
    pattern: list[int]  #: the pattern a clause that ends in a state matches, or -1


#: Patterns: kind, negated, reported, with a target. The weights are where the fit starts from.
PATTERNS = [(k, n, r, t) for k in (INSULT, THREAT) for n in (False, True) for r in (False, True) for t in (False, True)]
FEATURES = len(PATTERNS) + 1  #: the last one is the text's length
PRIOR = np.array([(1.0 if k == INSULT else 0.5) * (0.3 if n else 1.0) * (0.5 if r else 1.0) * (1.5 if t else 1.0)
                  for k, n, r, t in PATTERNS] + [-0.2, -1.2])


def compiled() -> Grammar:
    """The composed grammar as a table over its reachable states."""
    whole = compose(compose(negation(), reported()), targeted())
    states, table = [whole.start], []
    for state in states:
        row = []
        for symbol in range(6):
            after, _ = whole.step(state, symbol)
            if after not in states:
                states.append(after)
            row.append(states.index(after))
        table.append(row)
    ends = [(s[1][1] + (s[1][0],)) if s[1][1] else None for s in states]
    return Grammar(table, [PATTERNS.index(e) if e else -1 for e in ends])


class Lexicon(NamedTuple):
    hashes: np.ndarray  #: of whole words, sorted
    classes: np.ndarray
    stems: list[tuple[int, np.ndarray, np.ndarray]]  #: bytes, hashes (sorted) and weights of learned beginnings, by bytes


def lexicon(learned: dict[str, float]) -> Lexicon:
    listed = ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
    value = lambda word: int(words_of(word.encode() + b"\0")[2][0])
    entries = {value(word): kind for words, kind in listed for word in words if "'" not in word}
    keys = sorted(entries)
    stems = []
    for size in sorted({len(s.encode()) for s in learned}):
        own = sorted((value(s), w) for s, w in learned.items() if len(s.encode()) == size)
        stems.append((size, np.array([h for h, _ in own], dtype=np.uint64), np.array([w for _, w in own])))
    return Lexicon(np.array(keys, dtype=np.uint64), np.array([entries[k] for k in keys]), stems)


def classified(group: Words, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Class and weight of every word; a learned beginning makes any word but a listed one an insult."""
    place = np.minimum(np.searchsorted(lex.hashes, group.hashes), len(lex.hashes) - 1)
    kinds = np.where(lex.hashes[place] == group.hashes, lex.classes[place], OTHER)
    weight = np.where((kinds == INSULT) | (kinds == THREAT), LISTED, 0.0)
    for size, hashes, weights in lex.stems:
        long = np.flatnonzero(group.ends - group.starts >= size)
        own = beginnings(group, long, size)
        place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        met = hashes[place] == own
        at, w = long[met], weights[place[met]]
        at, w = at[np.isin(kinds[at], (OTHER, INSULT))], w[np.isin(kinds[at], (OTHER, INSULT))]
        kinds[at] = INSULT
        weight[at] = np.maximum(weight[at], w)
    return kinds, weight


def clause_features(group: Words, lex: Lexicon, grammar: Grammar) -> np.ndarray:
    """For each text of a group the logarithm of the weight that each pattern gathers over the text's clauses, and of its words."""
    n = len(group.bounds) - 1
    out = np.zeros((n, FEATURES))
    out[:, -1] = np.diff(group.bounds) / 50
    kinds, weight = classified(group, lex)
    hits = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    if not len(hits):
        return np.log1p(out)
    clause = np.cumsum(BREAKS[np.frombuffer(group.data, dtype=np.uint8)], dtype=np.int64)[group.starts]
    found = np.unique(clause[hits])
    starts, ends = np.searchsorted(clause, found), np.searchsorted(clause, found, side="right")
    text = np.searchsorted(group.bounds, starts, side="right") - 1
    for s, e, t in zip(starts.tolist(), ends.tolist(), text.tolist()):
        state = 0
        for kind in kinds[s:e].tolist():
            state = grammar.table[state][kind]
        out[t, grammar.pattern[state]] += weight[s:e].sum()
    return np.log1p(out)


def fit(features: np.ndarray, toxic: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression drawn towards the prior weights, by Newton steps; classes weigh alike. One class: the prior."""
    if len(set(toxic.tolist())) < 2:
        return PRIOR
    x = np.column_stack([features, np.ones(len(features))])
    share = np.where(toxic == 1, 0.5 / (toxic == 1).mean(), 0.5 / (toxic == 0).mean())
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - toxic)) + pull * (w - PRIOR)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """(text, toxic) of at most PER_CLASS labelled rows of either class outside the held-out fold, written; equal texts once."""
    marks = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    marks = marks.filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, 4 * PER_CLASS / max(1, counts.get(k, 0))))])
    order = F.xxhash64("id")
    few = marks.filter(F.pmod(order, F.lit(1 << 20)) < share[F.col("toxic")] * (1 << 20)).withColumn(
        "k", F.row_number().over(Window.partitionBy("toxic").orderBy(order, "id"))).filter(F.col("k") <= PER_CLASS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text != ''")
    chosen = texts.join(F.broadcast(few.select("id", "toxic")), "id")  # at most 2 * PER_CLASS ids
    return stage(chosen.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select(
        F.col("text").cast("binary").alias("text"), "toxic"), "labelled")


def _insults(sample: DataFrame) -> dict[str, float]:
    """Beginnings of words that toxic texts have far more often than clean ones, with the logarithm of the ratio as weight.

    Of beginnings that continue one another the one with the largest gain is taken, and the longest of equals.
    """
    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bad, good = Counter(), Counter(), Counter()
            for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                starts, ends, _ = words_of(text + b"\0")
                words = Counter(LOWER[np.frombuffer(text, np.uint8)[s:e]].tobytes() for s, e in zip(starts.tolist(), ends.tolist()))
                own = Counter()
                for word, n in words.items():
                    word = word.decode("utf-8", "replace")
                    for size in range(STEM[0], min(STEM[1], len(word)) + 1):
                        own[word[:size]] += n
                own = {k: min(n, MOST_EACH) for k, n in own.items()}
                (bad if toxic else good).update(own)
                texts.update(own if toxic else ())
            keys = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (texts, bad, good))],
                                             ["stem", "texts", "bad", "good"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    each = sample.mapInArrow(stems, "stem string, texts long, bad long, good long").groupBy("stem").agg(
        F.sum("texts").alias("texts"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = ((F.col("bad") + 0.5) / n[1]) / ((F.col("good") + 0.5) / n[0])
    enough = (F.col("texts") >= max(min(LEAST_TEXTS, n[1] / 10), LEAST_SHARE * n[1])) & (ratio >= LEAST_RATIO)
    gain = F.col("bad") * F.log(ratio)
    rows = each.filter(enough).select("stem", F.log(ratio).alias("w"), gain.alias("gain")).orderBy(
        F.desc("gain"), F.desc(F.length("stem")), "stem").limit(20 * NEW_INSULTS).collect()
    out: dict[str, float] = {}
    for r in rows:
        if len(out) < NEW_INSULTS and not any(r.stem.startswith(s) or s.startswith(r.stem) for s in out):
            out[r.stem] = float(np.clip(r.w, LIGHTEST, HEAVIEST))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
             label_col: str = "toxic") -> DataFrame:
    """One row per document row: its id, held_out, score, predicted, n_patterns (patterns met).

    Words get classes (insult, threat, target, negation, report, other); the transducers negation, reported and targeted are composed to
    one grammar that reads a clause and gives at most one pattern, such as "insult, not negated, not reported, with a target". A
    text's score is the logistic function of the weights its patterns gather, set against its length. Insults beyond the listed ones
    (beginnings of words, so that inflected and compound forms count) and the patterns' weights are learned from at most 2 * PER_CLASS labelled rows outside the held-out fold (a toxic label wins over a
    clean one of the same id); ids and labels are no input of a score. Null and empty texts match nothing and get the base score, below 0.5. Without labels
    of both kinds the listed words and prior weights are used. Repeated rows are scored each; a null id is kept.

    Scoring is a narrow pass over whole texts; only clauses with an insult or threat run through the grammar.
    """
    grammar = compiled()
    sample = _sample(docs, labels, id_col, text_col, label_id, label_col)
    lex = lexicon(_insults(sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in word_groups(as_bytes(batch.column(0))):
                x = clause_features(group, lex, grammar)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(group.first, len(x)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(features, "toxic int, x array<double>").collect()  # at most 2 * PER_CLASS short rows
    rows = sorted((r.toxic, tuple(r.x)) for r in rows)
    weights = fit(np.array([r[1] for r in rows]).reshape(len(rows), FEATURES), np.array([r[0] for r in rows]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in word_groups(as_bytes(batch.column(2))):
                x = clause_features(group, lex, grammar)
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                part = batch.slice(group.first, len(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array((x[:, :-1] > 0).sum(axis=1))],
                    [id_col, "held_out", "score", "predicted", "n_patterns"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").cast("binary")).mapInArrow(
        score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_patterns long")
