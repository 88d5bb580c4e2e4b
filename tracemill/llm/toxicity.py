"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns words into symbols: insults (words and word beginnings, learned from
labels), threats, targets, possessives, predicates, negations, marks of reported speech, and what makes a
threat a figure of speech. Small weighted transducers follow a sentence: one remembers a recent negation, one reported
speech, one whether a target and then a predicate have come, two what stands right before a word, and, from the right, two
a target and a figure of speech close ahead. Composed, they are one automaton that gives each insult or threat a role and a path
weight, the product of the weights of its arcs: negation, reported speech and figures of speech only ever take weight away. An
insult is aimed if it is said of a target (target, predicate, insult) or stands right behind one; it is said of something behind a
predicate alone or a possessive; else it is a bare word, as are the parts of hyphenated words left out altogether. A threat counts
with a target close behind its verb. In a clause a word counts once, by its strongest match, however often it is repeated.
A text's score is a logistic in the sums of its clauses' weights, fitted to
labels with weights that are never negative and keep the roles' order. A clause that is aimed
carries a text over one half whatever the labels say, and a single bare word, repeated or not, never does.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.common import extended, held_out, labelled_sample, text_chunks
from tracemill.llm.shingles import _BYTE, _power_tables, mix, shingle_sets

#: Seed lexicons. Labels add insults, and weigh the seeds; without labels a seed counts SEED_WEIGHT, and nothing counts more.
INSULTS = "idiot idiots moron morons imbecile stupid dumb dumbass fool loser losers scum filth filthy vermin worthless pathetic trash garbage disgusting clown cretin bastard bitch jerk pig coward freak idiote imbécile connard salaud crétin abruti ordure dummkopf trottel arschloch schwein abschaum idiota imbécil estúpido basura escoria cabrón".split()
SEED_WEIGHT = 3.0
TARGETS = "you yourself u he she him them they people tu vous toi te ihr dich dir euch sie usted ustedes ti vosotros ellos ellas".split()
OWNERS = "your yours her his their these those votre vos ton tes dein deine eure tus vuestro".split()
PREDICATES = "is are was were am be been being it's est sont suis était êtes es ist sind bist bin war waren eres son soy somos era fue".split()
ADDRESSES = "you're he's she's they're youre".split()
NEGATIONS = "not no never nobody nor without isn't aren't wasn't don't doesn't didn't won't can't cannot pas jamais ni sans nicht kein keine keinen nie niemals ohne nunca jamás sin".split()
REPORTS = "said says say saying told tells called calls wrote writes claimed claims quoted quote alleged allegedly reported reportedly according dit disait écrit sagte sagt schrieb behauptet dijo dice escribió afirmó".split()
THREATS = "kill killing murder murdering strangle strangling stab stabbing shoot shooting lynch behead beheading exterminate tuer tuerai tuerons töten umbringen erschießen matar mataré mataremos".split()
#: What makes a threat a figure of speech.
MILD = "kindness love laughter darlings joke jokes boredom curiosity gentillesse liebe lachen amabilidad risa".split()
#: Words that a negation reaches over.
REACH = 3
#: Words within which a threat's target follows, and a figure of speech.
AHEAD, FIGURE = 4, 6
PREFIXES = (4, 5, 6, 7, 8)
#: Bound on the training sample, rows of each label.
PER_CLASS = 2500
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PREDICATE, BREAK, OWNER, ADDRESS, FIGURATIVE = range(11)
#: Weights of the arcs that leave a negation behind, reported speech, and a figure of speech ahead.
NEGATED, REPORTED, FIGURED = 0.15, 0.35, 0.15
#: What a text's clauses are summed by; a threat without a target is nothing.
ROLES = ("insult bare", "insult of something", "insult aimed", "threat aimed")
#: The grammar's own weights, before labels, and how strongly they pull.
PRIOR, BIAS, PULL = np.array([1.6, 2.2, 4.2, 4.2]), -5.0, 0.2
#: Log-odds that a single aimed clause of full weight has at least, and a single bare word at most has below zero.
MARGIN = 0.4
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = _INSIDE[39] = True
_STOP, _PAUSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n\r"]] = True
_PAUSE[[ord(c) for c in ",;:"]] = True


# --- transducers -----------------------------------------------------------------------------
# Each maps (state, symbol) to the next state; 0 is the state at a sentence's start. A pause ends a
# clause, but not reported speech.


def _negation(state: int, symbol: int) -> int:
    """Counts down from the last negation; a word is negated in any state but 0."""
    return 0 if symbol == BREAK else REACH if symbol == NEGATION else max(0, state - 1)


def _report(state: int, symbol: int) -> int:
    """Once speech is reported, the rest of the sentence is."""
    return 1 if symbol == REPORT else state


def _said(state: int, symbol: int) -> int:
    """What the clause has had: nothing, a predicate (1), a target (2), a target and then a predicate (3)."""
    if symbol in (BREAK, ADDRESS):
        return 0 if symbol == BREAK else 3
    if symbol == TARGET:
        return max(state, 2)
    return {0: 1, 2: 3}.get(state, state) if symbol == PREDICATE else state


def _beside(state: int, symbol: int) -> int:
    """What stands right before the next word: a target (2), a possessive (1), or neither."""
    return {TARGET: 2, OWNER: 1}.get(symbol, 0)


def _ahead(state: tuple[int, int], symbol: int) -> tuple[int, int]:
    """Read from the right: words within which a target is still close, and a figure of speech."""
    if symbol == BREAK:
        return 0, 0
    target = AHEAD if symbol in (TARGET, OWNER) else max(0, state[0] - 1)
    return target, FIGURE if symbol == FIGURATIVE else max(0, state[1] - 1)


def compose() -> dict[tuple[tuple[int, int, int, int], int], tuple[tuple[int, int, int, int], float]]:
    """The product of the transducers that read from the left: (states, symbol) -> (states, weight of the path)."""
    table = {}
    for n, r, c, d in itertools.product(range(REACH + 1), (0, 1), range(4), range(3)):
        for symbol in range(11):
            weight = (NEGATED if n else 1.0) * (REPORTED if r else 1.0)
            table[(n, r, c, d), symbol] = (_negation(n, symbol), _report(r, symbol), _said(c, symbol), _beside(d, symbol)), weight
    return table


AUTOMATON = compose()


def matches(symbols: list[int], gaps: list[int], weights: list[float]) -> list[tuple[int, int, int, float]]:
    """(place, clause, role, weight) of each insult and threat that counts; gaps are the numbers of other words before each symbol."""
    coming, ahead = [(0, 0)] * len(symbols), (0, 0)
    for k in range(len(symbols) - 1, -1, -1):
        coming[k] = ahead
        ahead = _ahead(ahead, symbols[k])
        for _ in range(min(gaps[k], FIGURE + 1)):
            ahead = _ahead(ahead, OTHER)
    state, out, clause = (0, 0, 0, 0), [], 0
    for k, (s, gap, w, (target, figure)) in enumerate(zip(symbols, gaps, weights, coming)):
        for _ in range(min(gap, REACH + 1)):
            state, _ = AUTOMATON[state, OTHER]
        _, _, said, beside = state
        state, path = AUTOMATON[state, s]
        clause += s == BREAK
        if s == INSULT:
            out.append((k, clause, 2 if said == 3 or beside == 2 else 1 if said == 1 or beside == 1 else 0, w * path))
        elif s == THREAT and target:
            out.append((k, clause, 3, w * path * (FIGURED if figure else 1.0)))
    return out


def run_sentence(symbols: list[int], gaps: list[int], weights: list[float], words: list[int]) -> list[tuple[int, float]]:
    """(role, weight) of each distinct word that matches in each clause: its strongest match, by the grammar's own weights."""
    best: dict[tuple[int, int], tuple[float, int, float]] = {}
    for k, clause, role, w in matches(symbols, gaps, weights):
        at = clause, words[k]
        best[at] = max(best.get(at, (-1.0, 0, 0.0)), (float(PRIOR[role] * np.log1p(w)), role, w))
    return [(role, w) for _, role, w in best.values()]


# --- words -----------------------------------------------------------------------------------


def _hash_word(w: str) -> int:
    raw = np.frombuffer(w.encode(), np.uint8)
    up, _ = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        return int(mix((_BYTE[raw] * up[: len(raw)]).sum(keepdims=True) + np.uint64(len(raw)))[0])


def _words(texts: pa.Array):
    """(first, last, hashes of words, of their beginnings by length, first word of each text, sentence and clause of each word, parts of hyphenated words)."""
    for lo, hi, buf, off in text_chunks(texts):
        inside = _INSIDE[buf]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = off[:-1] < off[1:]
        a, b = off[:-1][full], off[1:][full] - 1
        first[a], last[b] = inside[a], inside[b]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(len(buf) + 1)
        size = (ends - starts).astype(np.uint64)
        with np.errstate(over="ignore"):
            run = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
            word = mix((run[ends] - run[starts]) * down[starts] + size)
            heads = {k: np.where(size > k, mix((run[np.minimum(starts + k, len(buf))] - run[starts]) * down[starts] + np.uint64(k + (1 << 32))), np.uint64(0)) for k in PREFIXES}
        stop, pause = np.cumsum(_STOP[buf]), np.cumsum(_PAUSE[buf])
        at, dash = np.searchsorted(starts, off), np.zeros(len(starts), bool)
        tied = (starts[1:] - ends[:-1] == 1) & (buf[np.minimum(ends[:-1], len(buf) - 1)] == 45) if len(starts) else np.zeros(0, bool)
        dash[1:] |= tied
        dash[:-1] |= tied
        yield lo, hi, word, heads, at, stop[starts], pause[starts], dash


@dataclass
class ToxicityModel:
    """insults: {length of the beginning, 0 for a whole word: (sorted hashes, weights)}; the logistic's weights."""

    insults: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        seeds = {}
        for code, group in ((THREAT, THREATS), (PREDICATE, PREDICATES), (OWNER, OWNERS), (TARGET, TARGETS), (ADDRESS, ADDRESSES), (NEGATION, NEGATIONS), (REPORT, REPORTS), (FIGURATIVE, MILD)):
            seeds |= {_hash_word(w): code for w in group}
        keys = np.array(sorted(seeds), np.uint64)
        self._tables = [(-1, keys, np.array([seeds[int(k)] for k in keys], float)), *((k, *v) for k, v in self.insults.items() if len(v[0]))]
        # a bit for each value of the low 16 bits spares most words the search
        self._maybe = []
        for _, keys, _ in self._tables:
            seen = np.zeros(1 << 16, bool)
            seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self._maybe.append(seen)

    def symbols(self, word: np.ndarray, heads: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and the weight of insults and threats."""
        sym, weight = np.zeros(len(word), np.int64), np.zeros(len(word))
        for (k, keys, values), maybe in zip(self._tables, self._maybe):
            h = word if k <= 0 else heads[k]
            some = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
            hit = keys[at] == h[some]
            some, at = some[hit], at[hit]
            if k < 0:
                sym[some] = values[at].astype(np.int64)
                weight[some] = np.where(sym[some] == THREAT, SEED_WEIGHT, 0)
            else:
                free = (sym[some] == OTHER) | (sym[some] == INSULT)  # the grammar's own words keep their part
                some, at = some[free], at[free]
                sym[some] = INSULT
                weight[some] = np.maximum(weight[some], values[at])
        return sym, weight

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text and role: log(1 + summed weight of what its clauses match)."""
        total = np.zeros((len(texts), len(ROLES)))
        for lo, hi, word, heads, at, stop, pause, dash in _words(texts):
            sym, weight = self.symbols(word, heads)
            sym[dash & (sym == INSULT)] = OTHER
            hits = np.flatnonzero((sym == INSULT) | (sym == THREAT))
            of = np.searchsorted(at, hits, side="right") - 1
            for i, c in sorted(set(zip(of.tolist(), stop[hits].tolist()))):
                a = max(at[i], int(np.searchsorted(stop, c, side="left")))
                b = min(at[i + 1], int(np.searchsorted(stop, c, side="right")))
                symbols, gaps, weights, words, last, part = [], [], [], [], a - 1, pause[a]
                for k in (a + np.flatnonzero(sym[a:b])).tolist():
                    if pause[k] != part:  # a clause ends, and its words are out of reach
                        last, part = max(last, a + int(np.searchsorted(pause[a:b], pause[k])) - 1), pause[k]
                        symbols, gaps, weights, words = [*symbols, BREAK], [*gaps, 0], [*weights, 0.0], [*words, 0]
                    symbols.append(int(sym[k]))
                    gaps.append(k - last - 1)
                    weights.append(float(weight[k]))
                    words.append(int(word[k]))
                    last = k
                for role, w in run_sentence(symbols, gaps, weights, words):
                    total[lo + i, role] += w
        return np.log1p(total)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; without a clause that counts, what such texts have."""
        z = self.bias + self.features(texts) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def describe(self) -> dict:
        return {"insults": {k: len(v[0]) for k, v in self.insults.items()}, "weights": {r: round(float(w), 2) for r, w in zip(ROLES, self.weights)}, "bias": round(self.bias, 2)}


def _gain(t: np.ndarray, c: np.ndarray, prior: float) -> np.ndarray:
    """Log-likelihood ratio of a share t / (t + c) of label 1 against the prior."""
    n = t + c
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(t > 0, t * np.log(t / n / prior), 0) + np.where(c > 0, c * np.log(c / n / (1 - prior)), 0)


def _copies(texts: pa.Array) -> np.ndarray:
    """A group for each text: copies and near copies share one, so that they count once."""
    group = np.arange(len(texts))

    def find(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    seen: dict[int, int] = {}
    for i, s in enumerate(shingle_sets(texts)):
        for h in s[:4].tolist():  # the smallest hashes of a set: unlike texts share none
            j = seen.setdefault(h, i)
            group[find(i)] = find(j)
    return np.array([find(i) for i in range(len(group))])


def _learn_insults(texts: pa.Array, y: np.ndarray, odds: float):
    """Words and word beginnings whose texts are toxic beyond chance, each with its log-odds as weight.

    Near copies count once. odds turns counts of label 0 in the sample into counts at the labels'
    true shares. Returns {length of the beginning, 0 for a whole word: (sorted hashes, weights)}.
    """
    seeds = np.array(sorted(_hash_word(w) for w in INSULTS), np.uint64)
    none = {k: (np.zeros(0, np.uint64), np.zeros(0)) for k in PREFIXES} | {0: (seeds, np.full(len(seeds), SEED_WEIGHT))}
    if not 0 < y.sum() < len(y):
        return none
    group = _copies(texts)
    label = np.zeros(len(y), np.int64)
    np.maximum.at(label, group, y)
    keys, owner = [], []
    for lo, hi, word, heads, at, _, _, _ in _words(texts):
        of = group[np.repeat(np.arange(lo, hi), np.diff(at))]
        for tag, h in ((0, word), *heads.items()):
            ok = h != 0
            keys.append(h[ok])
            owner.append(of[ok] * 16 + tag)
    key, own = np.concatenate(keys), np.concatenate(owner)
    if not len(key):
        return none
    o = np.lexsort((own, key))
    key, own = key[o], own[o]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[once], own[once]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tag = own[edge] % 16
    kinds = label[np.unique(group)]
    ones, zeros = kinds.sum(), len(kinds) - kinds.sum()
    prior = ones / len(kinds)
    n = np.diff(np.append(edge, len(key)))
    t = np.add.reduceat(label[own // 16], edge).astype(float)
    c = n - t
    bar = np.log(len(edge)) + 3
    # a beginning is in many words, so it must be surer than a word
    sure = np.where(tag == 0, 0.4, 0.7)
    good = np.flatnonzero((t / (t + odds * (c + 0.5)) > sure) & (_gain(t, c, prior) > bar))
    weight = np.minimum(np.log(t[good] / ones) - np.log((c[good] + 0.5) / zeros), SEED_WEIGHT)
    out = {k: (key[edge[good]][tag[good] == k], weight[tag[good] == k]) for k in (0, *PREFIXES)}
    # seeds that labels say too little of keep their weight, but for what labels do say
    rest = np.setdiff1d(seeds, out[0][0])
    words, at = key[edge[tag == 0]], np.flatnonzero(tag == 0)
    place = np.minimum(np.searchsorted(words, rest), max(0, len(words) - 1))
    seen = words[place] == rest if len(words) else np.zeros(len(rest), bool)
    a, b = np.where(seen, t[at[place]], 0) if len(words) else 0, np.where(seen, c[at[place]], 0) if len(words) else 0
    told = SEED_WEIGHT + np.log((a + 1) / (b * (ones + 1) / (zeros + 1) + 1))
    every, w = np.concatenate([out[0][0], rest]), np.concatenate([out[0][1], np.clip(told, 0, SEED_WEIGHT)])
    out[0] = every[np.argsort(every)], w[np.argsort(every)]
    return out


def _within(v: np.ndarray) -> np.ndarray:
    """Weights and bias moved to where the grammar allows them."""
    bare, of, aimed, threat, bias = v
    full, bias = np.log1p(SEED_WEIGHT), min(bias, -1.0)
    bare = min(max(bare, 0.0), (-MARGIN - bias) / full)
    of = max(of, bare)
    least = (MARGIN - bias) / full
    return np.array([bare, of, max(aimed, of, least), max(threat, least), bias])


def train(texts: pa.Array, y: np.ndarray, prior: float) -> ToxicityModel:
    """Learn insults and fit the roles' weights around the grammar's own; prior is the labels' share of label 1.

    The labels can't take a weight below zero or below that of a lesser role, nor an aimed clause
    below one half, nor lift a single bare word to it.
    """
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    odds = (1 - prior) / prior * share / (1 - share)
    insults = _learn_insults(texts, y, odds)
    theta = centre = _within(np.append(PRIOR, BIAS))
    if len(y):
        x = np.column_stack([ToxicityModel(insults, PRIOR, BIAS).features(texts), np.ones(len(y))])
        weight = np.where(y == 1, 1.0, odds)
        weight = weight / weight.mean()

        def loss(v):
            z = x @ v
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * PULL * ((v - centre) ** 2).sum())

        now, size = loss(theta), 1.0
        for _ in range(500):  # gradient steps, scaled by the curvature, each moved back to what is allowed
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            g = x.T @ (weight * (p - y)) + PULL * (theta - centre)
            g /= (x * x).T @ (weight * np.maximum(p * (1 - p), 1e-3)) + PULL
            while (then := loss(_within(theta - size * g))) > now and size > 1e-9:
                size /= 2
            if size <= 1e-9 or now - then < 1e-10 * max(1.0, now):
                break
            theta, now, size = _within(theta - size * g), then, min(1.0, size * 2)
    return ToxicityModel(insults, theta[:-1], float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows outside the held-out fold."""
    texts, y = labelled_sample(docs, labels, "toxic", per_class)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return train(texts, y, 0.5 if known is None else known)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score double and predicted int (1 if score >= threshold); every row is kept.

    Null and empty texts have no clause and get the score of such texts, repeated rows alike, and an
    empty table gives an empty one. Columns of docs with the new columns' names are replaced. Nothing but the text is read for the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[c for c in docs.columns if c not in (score, predicted)])
    schema = extended(base, **{score: T.DoubleType(), predicted: T.IntegerType()})

    def run(batches):
        m = shared.value
        for b in batches:
            s = m.score(b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns)], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*b.schema.names, score, predicted])

    return base.mapInArrow(run, schema)
