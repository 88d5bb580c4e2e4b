"""Personal data: base patterns, and a skip-chain conditional random field that extends them.

Base spans are e-mail, ip, card and phone numbers by fixed patterns and checks. The field works on
the tokens of a document that hold a digit, "@" or "+". Each has a potential from its shape and its
neighbours' shapes; neighbours share a transition potential; tokens that are the same, or alike in
all but their marks, are tied to one shared cluster variable however far apart, so that one
occurrence that is sure lifts all others. Tokens of a number that spaces part are tied by the whole number too. All weights, those of
transitions and ties too, are learned together by the pseudo-likelihood of the field, from the base spans of a bounded sample of texts and from
copies of those texts in which further mentions of the same values are disguised, so that no base pattern finds them, among
decoys of the same shape: what a shape alone says of them is little, what a sure mention elsewhere says is much. Inference
is loopy message passing on the graphs of many documents at once. Tokens that it labels with high
probability become further spans; base spans always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.common import bounded_texts, text_chunks

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A word with a digit, "@" or "+"; tried only where a word begins, so linear in long runs.
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@+]*[0-9@+][^\x20\x09-\x0D]*")
#: A run longer than this is taken apart into addresses and numbers, each as long as it is.
LONGEST = 256
_INSIDE = re.compile(r"[A-Za-z0-9._%+@()-]+")
#: Within a part that letters run into: a number between letters, and what follows the "@" of an address.
_NUMBER = re.compile(r"[+(]?[0-9][0-9().+-]*")
_HOST = re.compile(r"@[A-Za-z0-9.-]+")
_WORD_BEFORE = re.compile(r"([^\x20\x09-\x0D]{1,12})[\x20\x09-\x0D]+$")
_WORD_AFTER = re.compile(r"[\x20\x09-\x0D]+([^\x20\x09-\x0D]{1,12})")
_BEGINS, _ENDS = re.compile(r"[A-Za-z0-9+(]"), re.compile(r"[A-Za-z0-9)]")
_MARK = np.zeros(256, bool)
_MARK[48:58] = _MARK[ord("@")] = _MARK[ord("+")] = True
#: Bound on the training sample, texts.
SAMPLE = 6000
BUCKETS = 1 << 12
#: Where the skip potentials of equal and of alike tokens start from, and the range that learning may move them in.
TIES, LOOSEST, TIGHTEST = (2.0, 1.0), 0.25, 8.0
#: Least length of a token, or of a whole number, that ties its mentions.
TIED = 6
#: Gradient steps of a fit.
STEPS = 600
#: The marginal that makes a span.
SURE = 0.8
#: Potential of the label that a base span gives its tokens: those are observed, whatever their shape.
OBSERVED = 12.0
#: Messages are passed until none of a text changes by more than SETTLED; loops that never settle stop at MOST_ROUNDS.
SETTLED, MOST_ROUNDS = 1e-3, 1000
LABELS = 1 + len(KINDS)


def _half(force: float) -> float:
    """Potential of a tie to a cluster variable: two ties in a row act as one potential of force."""
    x = np.sqrt((np.exp(force) - 1) / (np.exp(force) + LABELS - 1))
    return float(np.log((1 + (LABELS - 1) * x) / (1 - x)))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; each kind leftmost and non-overlapping. Linear in the text."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        a = at
        if m:
            while a > last and _LOCAL.match(text[a - 1]):
                a -= 1
        if m and a < at:
            out.append((0, a, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        # a part of many digits is compared by its length first
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 2 * 19:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _shape(s: str) -> str:
    """Runs of digits, letters and marks, with the digits' number up to 20."""
    out, i = [], 0
    while i < len(s):
        j, c = i, s[i]
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        while j < len(s) and ("9" if "0" <= s[j] <= "9" else "a" if s[j].isalpha() else s[j]) == k:
            j += 1
        out.append(f"9{min(20, j - i)}" if k == "9" else k)
        i = j
    return "".join(out)


def _bucket(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=4).digest(), "little") % BUCKETS


@dataclass
class _Graph:
    """Tokens of one text: spans, hashed features, chain edges, and ties to cluster variables, numbered after the tokens.

    A tie is (node, cluster variable, 0 for equal or 1 for alike); groups are each token's groups of equal and of alike ones, or -1.
    """

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skips: list[tuple[int, int, int]]
    hubs: int = 0
    groups: tuple[list[int], list[int]] = ((), ())
    known: np.ndarray | None = None  # labels that base spans give, 0 where they give none


def _tokens(text: str):
    """Spans of the field's tokens, in order; long runs (data, prose without spaces) come in parts.

    Of a run longer than LONGEST the addresses are tokens, each from the last part's end on, and the numbers between them.
    """
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if b - a <= LONGEST:
            yield a, b
            continue
        for run in _INSIDE.finditer(text, a, b):
            last, end = run.span()
            for host in _HOST.finditer(text, last, end):
                begin = host.start()
                while begin > last and _LOCAL.match(text[begin - 1]):
                    begin -= 1
                yield from (n.span() for n in _NUMBER.finditer(text, last, begin))
                yield begin, host.end()
                last = host.end()
            yield from (n.span() for n in _NUMBER.finditer(text, last, end))


def graph(text: str) -> _Graph:
    """The field of one text. All equal tokens are tied to one cluster variable, and so are alike forms, so edges grow with the tokens."""
    spans, shapes, forms = [], [], []
    for a, b in _tokens(text):
        t = text[a:b]
        first, k = _BEGINS.search(t), len(t)
        while first and k > first.start() and not _ENDS.match(t[k - 1]):
            k -= 1
        if not first or k <= first.start():
            continue
        lead, k = t[first.start() : k], first.start()
        spans.append((a + k, a + k + len(lead)))
        shapes.append(_shape(lead))
        forms.append(lead)
    feats, chain, skips = [], [], []
    equal: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(spans):
        t = forms[i]
        beside = i > 0 and a - spans[i - 1][1] <= 3
        nxt = i + 1 < len(spans) and spans[i + 1][0] - b <= 3
        digits = [c for c in t if "0" <= c <= "9"]
        parts = t.split(".")
        octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts)
        before, after = _WORD_BEFORE.search(text[max(0, a - 16) : a]), _WORD_AFTER.match(text[b : b + 16])
        f = [_bucket("shape", shapes[i]), _bucket("n", len(digits)), _bucket("at", "@" in t, "." in t.partition("@")[2]), _bucket("plus", t.startswith("+"), len(digits) > 0)]
        f += [_bucket("left", shapes[i - 1] if beside else "-", shapes[i]), _bucket("right", shapes[i + 1] if nxt else "-", shapes[i])]
        f += [_bucket("octets", octets), _bucket("luhn", 16 <= len(digits) <= 19 and _luhn("".join(digits)), len(digits)), _bucket("letters", any(c.isalpha() for c in t), "@" in t)]
        f += [_bucket("before", before[1].lower() if before and not beside else "-"), _bucket("after", after[1].lower() if after and not nxt else "-")]
        feats.append(f)
        if beside:
            chain.append((i - 1, i))
        if len(t) >= TIED:
            equal.setdefault(t.lower(), []).append(i)
    hubs, alike = 0, {}
    same, near = [-1] * len(spans), [-1] * len(spans)
    for g, (form, members) in enumerate(equal.items()):
        node = members[0]
        if len(members) > 1:
            node = len(spans) + hubs
            hubs += 1
            skips.extend((i, node, 0) for i in members)
            for i in members:
                same[i] = g
        key = re.sub(r"[^0-9a-z]", "", form)
        if len(key) >= TIED:
            alike.setdefault(key, []).append((node, members))
    # numbers that spaces part: each of their tokens is tied by the whole number as well
    i = 0
    while i < len(spans):
        j = i
        while j + 1 < len(spans) and spans[j + 1][0] - spans[j][1] == 1 and not any(c.isalpha() for c in forms[j] + forms[j + 1]):
            j += 1
        if j > i:
            key = re.sub(r"[^0-9]", "", "".join(forms[i : j + 1]))
            if len(key) >= TIED:
                alike.setdefault(key, []).extend((k, [k]) for k in range(i, j + 1))
        i = j + 1
    for g, members in enumerate(alike.values()):
        if len(members) > 1:
            skips.extend((node, len(spans) + hubs, 1) for node in dict.fromkeys(n for n, _ in members))
            hubs += 1
            for _, tokens in members:
                for i in tokens:
                    near[i] = g
    return _Graph(spans, feats, chain, skips, hubs, (same, near))


def _labels(g: _Graph, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each token: the kind of the longest base span that it overlaps, 0 for none."""
    y = np.zeros(len(g.spans), np.int64)
    starts, ends = [a for a, _ in g.spans], [b for _, b in g.spans]
    for kind, a, b in sorted(base, key=lambda s: s[2] - s[1]):
        y[bisect_right(ends, a) : bisect_left(starts, b)] = kind + 1
    return y


def _covers(base: list[tuple[int, int, int]]):
    """A test whether any base span overlaps a range."""
    order = sorted((a, b) for _, a, b in base)
    starts, far = [a for a, _ in order], list(accumulate((b for _, b in order), max))

    def test(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and far[k - 1] > a

    return test


@dataclass
class SkipChainCrf:
    unary: np.ndarray  # BUCKETS x LABELS
    bias: np.ndarray
    transition: np.ndarray  # LABELS x LABELS
    ties: tuple[float, float] = TIES  # of equal and of alike tokens

    def marginals(self, graphs: list[_Graph]) -> list[np.ndarray]:
        """Loopy sum-product over all graphs at once; an isolated token keeps its own potential."""
        sizes = [len(g.spans) + g.hubs for g in graphs]
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(base[-1])
        if not n:
            return [np.zeros((0, LABELS)) for _ in graphs]
        phi = np.zeros((n, LABELS))
        token = np.concatenate([np.arange(b, b + len(g.spans)) for b, g in zip(base, graphs)]).astype(np.int64)
        phi[token] = np.array([self.unary[f].sum(axis=0) for g in graphs for f in g.features]) + self.bias
        for b, g in zip(base, graphs):
            if g.known is not None:
                sure = np.flatnonzero(g.known)
                phi[b + sure, g.known[sure]] += OBSERVED
        src, dst, psi, owner = [], [], [], []
        tied = [_half(force) * np.eye(LABELS) for force in self.ties]
        for k, (b, g) in enumerate(zip(base, graphs)):
            for i, j in g.chain:
                src += [b + i, b + j]
                dst += [b + j, b + i]
                psi += [self.transition, self.transition.T]
            for i, j, kind in g.skips:
                same = tied[kind]
                src += [b + i, b + j]
                dst += [b + j, b + i]
                psi += [same, same]
            owner += [k] * (len(src) - len(owner))
        belief = phi.copy()
        if src:
            src, dst, psi, owner = np.array(src), np.array(dst), np.array(psi), np.array(owner)
            msg = np.zeros((len(src), LABELS))
            live = np.arange(len(src))  # edges of texts that have not settled; pairs of directions stay together
            for _ in range(MOST_ROUNDS):
                s, d, old = src[live], dst[live], msg[live]
                belief = phi.copy()
                np.add.at(belief, d, old)
                out = belief[s] - old[np.arange(len(live)) ^ 1]
                new = np.log(np.exp(out[:, :, None] + psi[live] - out.max(axis=1)[:, None, None]).sum(axis=1))
                new = 0.5 * old + 0.5 * (new - new.mean(axis=1, keepdims=True))
                msg[live] = new
                change = np.zeros(len(graphs))
                np.maximum.at(change, owner[live], np.abs(new - old).max(axis=1))
                live = live[change[owner[live]] > SETTLED]
                if not len(live):
                    break
            belief = phi.copy()
            np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [p[b : b + len(g.spans)] for b, g in zip(base, graphs)]

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text: base spans, and all spans (base ones and the field's), by kind, then start."""
        bases, graphs = [base_spans(t) for t in texts], [graph(t) for t in texts]
        for g, base in zip(graphs, bases):
            g.known = _labels(g, base)
        out = []
        for text, base, g, p in zip(texts, bases, graphs, self.marginals(graphs)):
            more: list[tuple[int, int, int]] = []
            taken, linked = _covers(base), set(g.chain)
            for i in np.flatnonzero(p[:, 1:].max(axis=1) >= SURE) if len(p) else ():
                kind, (a, b) = int(p[i, 1:].argmax()), g.spans[i]
                if taken(a, b):
                    continue
                if more and more[-1][0] == kind and (i - 1, i) in linked and more[-1][2] == g.spans[i - 1][1]:
                    more[-1] = (kind, more[-1][1], b)
                else:
                    more.append((kind, a, b))
            out.append((base, sorted(base + more)))
        return out


def _others(group: np.ndarray, y: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """For each token, the labels' shares among the other tokens of its group (and not of its group in within)."""
    out = np.zeros((len(y), LABELS))
    on = np.flatnonzero(group >= 0)
    if len(on):
        counts = np.zeros((group.max() + 1, LABELS))
        np.add.at(counts, (group[on], y[on]), 1)
        out[on] = counts[group[on]]
        if within is None:
            out[on, y[on]] -= 1
        else:
            own = np.zeros((within.max() + 2, LABELS))
            np.add.at(own, (within[on], y[on]), 1)  # -1 is the last row: tokens that are alone in their form
            alone = on[within[on] < 0]
            out[on] -= np.where(within[on, None] >= 0, own[within[on]], 0)
            out[alone, y[alone]] -= 1
        out[on] /= np.maximum(out[on].sum(axis=1, keepdims=True), 1)
    return out


def _disguise(kind: int, value: str, rng: random.Random) -> str:
    """A value as no base pattern finds it: without its "+", or with another mark in one place."""
    if kind == 3:
        return re.sub(r"[\x20().]", rng.choice(["", "-", "/"]), value[1:])
    if kind == 2:
        digits = re.sub(r"[^0-9]", "", value)
        return rng.choice([f"{digits[:4]}.{digits[4:8]}.{digits[8:]}", f"{digits[:4]}_{digits[4:]}", value.replace(" ", "/").replace("-", "/") if not value.isdigit() else f"{digits[:8]}/{digits[8:]}"])
    k = value.rfind("@" if kind == 0 and rng.random() < 0.5 else ".")
    return value[:k] + rng.choice(["@@"] if value[k] == "@" else [",", "_"]) + value[k + 1 :]


def disguised(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """(text with further mentions of its values, disguised, and as many decoys; the spans of those mentions). The same for equal texts."""
    base = base_spans(text)
    if not base:
        return text, []
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    gaps = [m.start() for m in re.finditer(r"(?<=[a-z.,]) (?=[A-Za-z])", text)]
    gaps = [g for g in gaps if not any(a <= g < b for _, a, b in base)]
    new = []
    for kind, a, b in rng.sample(base, min(3, len(base))) if gaps else ():
        for real in (True, False):
            value = _disguise(kind, text[a:b], rng)
            if not real:
                value = "".join(rng.choice("0123456789") if "0" <= c <= "9" else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and kind == 0 else c for c in value)
            new.append((rng.choice(gaps), kind, value, real))
    out, hidden, at, size = [], [], 0, 0
    for gap, kind, value, real in sorted(new):
        out += [text[at:gap], ", ", value, ","]
        size += gap - at + 2
        if real:
            hidden.append((kind, size, size + len(value)))
        size += len(value) + 1
        at = gap
    said = "".join(out) + text[at:]
    taken = _covers(base_spans(said))
    return said, [h for h in hidden if not taken(h[1], h[2])]


def recovery(model: SkipChainCrf, texts: list[str]) -> dict[str, float]:
    """How many disguised mentions the field finds, and how many of what it adds are such mentions."""
    found = total = added = right = 0
    for t in texts:
        said, hidden = disguised(t)
        if hidden:
            (base, full), = model.spans([said])
            more = [x for x in full if x not in set(base)]
            hit = _covers(hidden)
            total, added = total + len(hidden), added + len(more)
            found += sum(any(k == kind and x < b and a < y for k, x, y in more) for kind, a, b in hidden)
            right += sum(hit(a, b) for _, a, b in more)
    return {"hidden": total, "added": added, "recall": found / max(1, total), "precision": right / max(1, added)}


def train(texts: list[str]) -> SkipChainCrf:
    """Fit unary, transition and tie weights by pseudo-likelihood, each label given all others, to texts and to copies with disguised mentions."""
    graphs, ys = [], []
    for t in texts:
        for said, hidden in [(t, []), *([disguised(t)] if t else [])]:
            if said and (said is t or hidden) and (g := graph(said)).spans:
                graphs.append(g)
                ys.append(_labels(g, base_spans(said) + hidden))
    unary, bias, transition, ties = np.zeros((BUCKETS, LABELS)), np.zeros(LABELS), np.zeros((LABELS, LABELS)), np.array(TIES)
    bias[0] = 2.0
    if not graphs:
        return SkipChainCrf(unary, bias, transition)
    f, y = np.array([r for g in graphs for r in g.features]), np.concatenate(ys)
    base = np.concatenate([[0], np.cumsum([len(g.spans) for g in graphs])])
    chain = np.array([(b + i, b + j) for b, g in zip(base, graphs) for i, j in g.chain], np.int64).reshape(-1, 2)
    # a group's number is made its own across texts by that of its text's first token
    whole = [np.concatenate([np.where(np.array(g.groups[k]) >= 0, np.array(g.groups[k]) + b, -1) for b, g in zip(base, graphs)]) for k in (0, 1)]
    share = [_others(whole[0], y), _others(whole[1], y, whole[0])]
    onehot = np.eye(LABELS)
    left, right = np.zeros((len(y), LABELS)), np.zeros((len(y), LABELS))  # the neighbours' labels
    left[chain[:, 1]], right[chain[:, 0]] = onehot[y[chain[:, 0]]], onehot[y[chain[:, 1]]]
    seen, seen_t, seen_s = np.full(unary.shape, 1e-8), np.full(transition.shape, 1e-8), np.full(2, 1e-8)
    for _ in range(STEPS):
        z = unary[f].sum(axis=1) + bias + left @ transition + right @ transition.T + ties[0] * share[0] + ties[1] * share[1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = np.stack([np.bincount(f.ravel(), np.repeat(p[:, k], f.shape[1]), BUCKETS) for k in range(LABELS)], axis=1) + 0.02 * unary
        seen += g * g
        unary -= 0.5 * g / np.sqrt(seen)
        g = left.T @ p + (right.T @ p).T + 0.5 * transition
        seen_t += g * g
        transition -= 0.2 * g / np.sqrt(seen_t)
        g = np.array([(p * s).sum() for s in share]) + 0.5 * (ties - np.array(TIES))
        seen_s += g * g
        ties = np.clip(ties - 0.5 * g / np.sqrt(seen_s), LOOSEST, TIGHTEST)
    return SkipChainCrf(unary, bias, np.clip(transition, -2, 2), tuple(float(t) for t in ties))


def fit(docs: DataFrame, sample: int = SAMPLE) -> SkipChainCrf:
    """Train on at most sample texts, within FIT_BYTES, which a hash of the id picks; the bounds hold for fitting alone."""
    some = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    ids = some.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", F.lit(13)).alias("_order")).orderBy("_order", "_id").limit(sample).distinct()
    marked = some.where("contains(text, '@') or text rlike '[0-9]'")
    return train(bounded_texts(marked, ids, []).column("text").to_pylist())


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _marked(texts: pa.Array) -> np.ndarray:
    """Texts with a digit, "@" or "+"; no other can hold a span or a token of the field."""
    out = np.zeros(len(texts), bool)
    for lo, hi, buf, off in text_chunks(texts):
        run = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_MARK[buf], out=run[1:])
        out[lo:hi] = run[off[1:]] > run[off[:-1]]
    return out


def _groups(texts: pa.Array, limit: int = 64):
    """Indices of marked texts, a few at a time."""
    at = np.flatnonzero(_marked(texts))
    for a in range(0, len(at), limit):
        yield at[a : a + limit]


def find(docs: DataFrame, model: SkipChainCrf) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs.

    Offsets count code points, ends are exclusive. A null or empty text has no span; its digest is
    that of the empty string. Repeated rows each have their row; an empty table has none. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column("text")
            n = len(texts)
            counts = np.zeros((n, len(KINDS)), np.int64)
            digest, joined, added = [nothing] * n, [""] * n, np.zeros(n, np.int64)
            for part in _groups(texts):
                for i, (base, full) in zip(part, m.spans([texts[int(i)].as_py() for i in part])):
                    for k, _, _ in base:
                        counts[i, k] += 1
                    digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    joined[i] = _joined(full)
                    added[i] = len(full) - len(base)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(joined, pa.string()), pa.array(added)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def masked(text: str, spans) -> str:
    """text with each span replaced by its kind in brackets; where spans overlap, the first of them covers the rest."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SkipChainCrf) -> DataFrame:
    """docs with personal data masked in text, all rows and columns kept, of any name; n_chars, if present, follows.

    Null and empty texts stay, repeated rows are masked alike, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(at)
            new: dict[int, str] = {}
            for part in _groups(texts):
                raw = [texts[int(i)].as_py() for i in part]
                for i, t, (_, full) in zip(part, raw, m.spans(raw)):
                    if full:
                        new[int(i)] = masked(t, full)
            if new:
                texts = pa.array([new.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
