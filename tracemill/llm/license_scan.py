"""License scans: ordered signature rules over whole texts, as SQL expressions alone.

A text is taken to its words once. The words that some rule waits for (its gate) choose the rules to run on that
text; each of them marks its matches in the text of words, and the places of the marks are the detections. Detections
that overlap better ones go: those of lower priority, and those contained in one as good. Everything is one
projection of a row: nothing is shuffled, joined or collected, and no Python worker runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import own_name
from tracemill.llm.license_rules import BASE, RULES, wrapped
from tracemill.llm.resampling import WORD, lower_ascii

_OPEN, _CLOSE = "\x01", "\x02"  # in no word
_SPAN = "struct<start:int,stop:int,priority:int,rule:int,label:string,base:boolean>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _signatures() -> Column:
    """The rules as an array of structs, folded to a constant."""
    columns = {
        "pattern": F.array(*[F.lit(wrapped(r.pattern)) for r in RULES]),
        "label": F.array(*[F.lit(r.label) for r in RULES]),
        "priority": F.array(*[F.lit(r.priority) for r in RULES]),
        "rule": F.array(*[F.lit(i) for i in range(len(RULES))]),
    }
    return F.arrays_zip(*[c.alias(k) for k, c in columns.items()])


def _gates() -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, r in enumerate(RULES):
        for g in r.gates:
            out.setdefault(g, []).append(i)
    return out


def _marks(words: Column, mark: str) -> Column:
    """Numbers of the words that carry the mark."""
    has = (lambda w: F.startswith(w, F.lit(mark))) if mark == _OPEN else (lambda w: F.endswith(w, F.lit(mark)))
    return F.filter(F.transform(words, lambda w, i: F.when(has(w), i)), lambda i: i.isNotNull())


def _matches(line: Column, rule: Column) -> Column:
    """All matches of one rule in a line of words."""
    marked = F.regexp_replace(line, rule["pattern"], F.lit(f" {_OPEN}$1{_CLOSE} "))

    def places(words: Column) -> Column:
        span = lambda start, stop: F.struct(start.alias("start"), (stop + 1).alias("stop"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), (rule["rule"] < len(BASE)).alias("base"))
        return _let(_marks(words, _CLOSE), lambda stops: F.transform(_marks(words, _OPEN), lambda start, i: span(start, F.get(stops, i))))

    return _let(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), _let(F.split(F.btrim(m), "  "), places)).otherwise(F.array().cast(f"array<{_SPAN}>")))


def _outdone(d: Column, e: Column) -> Column:
    """e overlaps d and takes its place."""
    contains = (e["start"] <= d["start"]) & (e["stop"] >= d["stop"])
    wider = (e["stop"] - e["start"]) > (d["stop"] - d["start"])
    better = (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & contains & (wider | (e["rule"] < d["rule"])))
    return (e["start"] < d["stop"]) & (d["start"] < e["stop"]) & better


def _kept(spans: Column) -> Column:
    """The detections that no other takes the place of, and all base ones; spans are sorted.

    Places are cut into blocks as wide as the longest detection, so what overlaps a detection begins in its
    block or one beside it: the work grows with the detections, not with their square.
    """

    def choose(s: Column) -> Column:
        return _let(F.array_max(F.transform(s, lambda d: d["stop"] - d["start"])), lambda width: blocks(s, width))

    def blocks(s: Column, width: Column) -> Column:
        block = lambda d: F.floor(d["start"] / width)
        first = F.transform(s, lambda d, i: F.when((i == 0) | (block(d) != block(F.get(s, i - 1))), i))
        return _let(F.filter(first, lambda i: i.isNotNull()), lambda at: F.flatten(F.transform(at, lambda b, k: part(s, at, b, k))))

    def part(s: Column, at: Column, b: Column, k: Column) -> Column:
        begin, end, last = F.coalesce(F.get(at, k - 1), b), F.coalesce(F.get(at, k + 1), F.size(s)), F.coalesce(F.get(at, k + 2), F.size(s))
        near = F.slice(s, begin + 1, last - begin)
        return _let(near, lambda c: F.filter(F.slice(s, b + 1, end - b), lambda d: d["base"] | ~F.exists(c, lambda e: _outdone(d, e))))

    return _let(spans, lambda s: F.when(F.size(s) > 0, choose(s)).otherwise(s))


def detections(text: Column) -> Column:
    """struct<n_words, base, kept> of a text: its number of words, all places of base phrases, and what stays of all."""
    gates = _gates()
    known = F.array(*[F.lit(g) for g in gates])
    rules_of = F.map_from_arrays(known, F.array(*[F.array(*[F.lit(i) for i in v]) for v in gates.values()]))

    def scan(words: Column) -> Column:
        chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_intersect(words, known), lambda g: F.element_at(rules_of, g)))))
        line = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
        found = _let(chosen, lambda c: F.when(F.size(c) > 0, _let(line, lambda t: F.array_sort(F.flatten(F.transform(c, lambda i: _matches(t, F.get(_signatures(), i))))))).otherwise(F.array().cast(f"array<{_SPAN}>")))
        return _let(found, lambda s: F.struct(F.size(words).cast("long").alias("n_words"), F.filter(s, lambda d: d["base"]).alias("base"), _kept(s).alias("kept")))

    words = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    return _let(F.transform(words, lower_ascii), scan)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, base, spans and score.

    base and spans are arrays of (start, stop, priority, rule, label, base): word numbers, stop exclusive, by start.
    A detection goes if one of higher priority overlaps it, or one of its own priority contains it (the wider, else the
    earlier rule stays); places of base phrases are in base, all of them, and always in spans. score is
    1 - 2^-n, n the sum of the priorities of the distinct kept labels, each at its highest. A null or empty text has no words,
    empty arrays and score 0; repeated rows are scanned alike, texts whole however long; an empty table gives an
    empty one. Columns named like the new ones give way.
    """
    made = ("n_words", "base", "spans", "score")
    rest = [c for c in docs.columns if c != text and c.lower() not in made]
    at = own_name(docs, "_found")
    found = docs.select(*[F.col(f"`{c}`") for c in rest], detections(F.col(f"`{text}`")).alias(at))
    kept = F.col(f"{at}.kept")
    labels = F.array_distinct(F.transform(kept, lambda d: d["label"]))
    best = F.transform(labels, lambda k: F.array_max(F.transform(F.filter(kept, lambda d: d["label"] == k), lambda d: d["priority"])))
    weight = F.aggregate(best, F.lit(0), lambda a, b: a + b)
    return found.select(*[F.col(f"`{c}`") for c in rest], F.col(f"{at}.n_words").alias("n_words"), F.col(f"{at}.base").alias("base"), kept.alias("spans"), (1 - F.pow(F.lit(2.0), -weight.cast("double"))).alias("score"))
