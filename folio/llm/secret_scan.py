"""Secret scan: fixed base patterns plus formats inferred as probabilistic automata.

Credentials that the base patterns find are the labelled examples.  Per kind, a bounded sample of
distinct ones (``PER_KIND``, smallest hash first) is split into formats by separators, alphabet and
fixed beginning.  The examples of a format, as strings of character classes, are put into a prefix
tree; statistically compatible states are merged (Hoeffding bounds on end and branch frequencies),
first those of one depth, then, on the evidence of ``EVIDENCE`` examples, those of different
depths, so a format's length and inner order stay in its states.

A candidate is any run of the format's alphabet, in its lengths and after its fixed beginning,
anywhere in the texts.  Its score is the mean log-likelihood ratio, per character, of the automaton
against the ordinary text of the corpus (character pairs counted over all documents); it is
reported as kind ``format`` if it scores like the format's held-out examples and at least
``LEAST_RATIO``, and does not overlap a base span.  Words and identifiers are likelier under the
text model than under any format.

Spans are code points, end exclusive.  A null text counts as empty and has no spans.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.privacy import Covered
from folio.llm.words import clean, release, slices
from folio.session import materialize

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Distinct examples of a kind, their longest, and the least that make a format.
PER_KIND, LONGEST, LEAST_EXAMPLES = 1000, 1000, 10
#: Confidence of the state compatibility test, and examples behind states of different depths.
ALPHA, EVIDENCE = 0.05, 30
#: Least mean log-likelihood ratio per character, in nats.
LEAST_RATIO = 1.0
#: Examples from which on every ``HELD_OUT``-th sets the threshold instead of being learned from.
SPLIT_FROM, HELD_OUT = 25, 5
MARK = "[SECRET]"
#: Characters whose pairs are counted at once.
SLICE = 1_000_000


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, credential)`` by start, then by kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def symbols(credential: str) -> str:
    """The credential with each letter and digit as the mark of its class."""
    return "".join(
        "d" if c.isdigit() else "h" if c in "abcdef" else "H" if c in "ABCDEF" else "l" if c.islower() else "U" if c.isupper() else c
        for c in credential
    )


@dataclass
class State:
    """Visits, ends, and per symbol the next state and how often it was taken."""

    visits: int = 0
    ends: int = 0
    step: dict[str, int] | None = None
    taken: dict[str, int] | None = None


def prefix_tree(samples: list[str]) -> list[State]:
    states = [State(step={}, taken={})]
    for s in sorted(samples, key=lambda s: (len(s), s)):
        at = 0
        for c in s:
            states[at].visits += 1
            states[at].taken[c] = states[at].taken.get(c, 0) + 1
            if c not in states[at].step:
                states[at].step[c] = len(states)
                states.append(State(step={}, taken={}))
            at = states[at].step[c]
        states[at].visits += 1
        states[at].ends += 1
    return states


def _differs(x: int, n: int, y: int, m: int) -> bool:
    """Whether two frequencies differ by more than their Hoeffding bounds allow."""
    if not n or not m:
        return False
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return abs(x / n - y / m) > bound


class Merger:
    """The states of a prefix tree under merging."""

    def __init__(self, states: list[State]) -> None:
        self.states = states
        self.into = list(range(len(states)))

    def find(self, k: int) -> int:
        while self.into[k] != k:
            self.into[k] = self.into[self.into[k]]
            k = self.into[k]
        return k

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states and all that follows them are statistically alike."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            a, b = self.find(a), self.find(b)
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            p, q = self.states[a], self.states[b]
            if _differs(p.ends, p.visits, q.ends, q.visits):
                return False
            for c in p.taken.keys() | q.taken.keys():
                if _differs(p.taken.get(c, 0), p.visits, q.taken.get(c, 0), q.visits):
                    return False
                if c in p.step and c in q.step:
                    todo.append((p.step[c], q.step[c]))
        return True

    def merge(self, a: int, b: int) -> None:
        """Merges ``b`` into ``a`` and then whatever follows both by one symbol."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            a, b = self.find(a), self.find(b)
            if a == b:
                continue
            p, q = self.states[a], self.states[b]
            self.into[b] = a
            p.visits += q.visits
            p.ends += q.ends
            for c, n in q.taken.items():
                p.taken[c] = p.taken.get(c, 0) + n
                if c in p.step:
                    todo.append((p.step[c], q.step[c]))
                else:
                    p.step[c] = q.step[c]

    def followers(self, k: int) -> list[int]:
        step = self.states[k].step
        return list(dict.fromkeys(self.find(step[c]) for c in sorted(step)))


def merged(samples: list[str]) -> tuple[list[State], Merger, list[int]]:
    """The states left of the examples' prefix tree, in order of their depth."""
    states = prefix_tree(samples)
    m = Merger(states)
    level = [0]
    while level:  # states of one depth
        following: list[int] = []
        for k in [f for s in level for f in m.followers(s)]:
            k = m.find(k)
            if k in following:
                continue
            twin = next((t for t in following if m.compatible(t, k)), None)
            if twin is None:
                following.append(k)
            else:
                m.merge(twin, k)
        level = list(dict.fromkeys(m.find(k) for k in following))
    settled, todo = [0], m.followers(0)
    while todo:  # states of different depths
        k = m.find(todo.pop(0))
        if k in settled:
            continue
        twin = next((t for t in settled if min(states[t].visits, states[k].visits) >= EVIDENCE and m.compatible(t, k)), None)
        if twin is None:
            settled.append(k)
        else:
            m.merge(twin, k)
            settled = list(dict.fromkeys(m.find(t) for t in settled))
        todo = [f for t in settled for f in m.followers(t) if f not in settled]
    return states, m, settled


#: Characters of each class.
CLASSES = {"d": "0123456789", "h": "abcdef", "H": "ABCDEF", "l": "ghijklmnopqrstuvwxyz", "U": "GHIJKLMNOPQRSTUVWXYZ"}
#: Letters and digits as numbers from 1; everything else is 0.
_CODES = np.zeros(256, np.int16)
_CODES[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(1, 63)


def _coded(token: str) -> np.ndarray:
    return _CODES[np.frombuffer(f" {token} ".encode("ascii", "replace"), np.uint8)]


@dataclass(frozen=True)
class Automaton:
    """A format: its fixed beginning, lengths and alphabet, log-probabilities of ends and steps, and
    the least score of a credential."""

    prefix: str
    lengths: tuple[int, int]
    alphabet: str
    ends: tuple[float, ...]
    steps: tuple[dict[str, tuple[int, float]], ...]
    unseen: tuple[float, ...]
    least_score: float

    def likelihood(self, credential: str) -> float:
        """Log-likelihood of the characters; minus infinity outside the format."""
        if not credential.startswith(self.prefix) or not self.lengths[0] <= len(credential) <= self.lengths[1]:
            return -math.inf
        at, total = 0, 0.0
        for c in symbols(credential[len(self.prefix) :]):
            if c in self.steps[at]:
                at, p = self.steps[at][c]
            elif c in CLASSES and self.steps[at] and CLASSES[c][0] in self.alphabet:
                at, p = next(iter(self.steps[at].values()))[0], self.unseen[at]
            else:
                return -math.inf
            total += p - math.log(len(CLASSES.get(c, c)))
        return total + self.ends[at]

    def score(self, credential: str, ordinary: np.ndarray | None = None) -> float:
        """Mean log-likelihood ratio against ordinary text (or mean log-likelihood without it)."""
        found = self.likelihood(credential)
        if found == -math.inf:
            return found
        if ordinary is not None:
            codes = _coded(credential)
            found -= float(ordinary[codes[:-1], codes[1:]].sum())
        return found / (len(credential) + 1)

    def accepts(self, credential: str, ordinary: np.ndarray | None = None) -> bool:
        return self.score(credential, ordinary) >= self.least_score

    @functools.cached_property
    def pattern(self) -> re.Pattern:
        """Runs that can be candidates: not a part of a longer token."""
        inner = "".join(re.escape(c) for c in self.alphabet)
        word = "A-Za-z0-9_"
        if set(self.alphabet) & set("=-+/"):
            word += "".join(re.escape(c) for c in "=-+/" if c in self.alphabet)
        least, most = (n - len(self.prefix) for n in self.lengths)
        return re.compile(
            f"(?<![{word}])(?<![A-Za-z0-9][-.+/]){re.escape(self.prefix)}[{inner}]{{{max(least, 0)},{most}}}(?![{word}]|[-.+/][A-Za-z0-9])")


def shape(credential: str) -> tuple[str, str]:
    """Separators in order and the smallest alphabet of the letters and digits."""
    plain = {c for c in credential if c.isalnum()}
    order = ("".join(CLASSES[k] for k in kinds) for kinds in ("d", "dh", "dH", "dhl", "dHU", "dhHlU"))
    return "".join(c for c in credential if not c.isalnum()), next(x for x in order if plain <= set(x))


def beginning(credentials: list[str]) -> str:
    """What nearly all examples begin with; their separators and digits included."""
    out = ""
    while True:
        following = Counter(c[len(out)] for c in credentials if c.startswith(out) and len(c) > len(out) + 4)
        char, n = following.most_common(1)[0] if following else ("", 0)
        if n < 0.95 * len(credentials):
            return out
        out += char


def formats(credentials: list[str]) -> list[list[str]]:
    """The examples in groups of one format with at least ``LEAST_EXAMPLES`` each.

    Groups are made by shape; one that is too small joins the group of the next larger alphabet
    with the same separators.  Within a group, examples that share their first three characters far
    more often than by chance are a format of their own."""
    groups: dict[tuple[str, str], list[str]] = defaultdict(list)
    for c in credentials:
        groups[shape(c)].append(c)
    for key in sorted(groups, key=lambda k: len(k[1])):
        if len(groups[key]) < LEAST_EXAMPLES:
            wider = [k for k in groups if k[0] == key[0] and set(key[1]) < set(k[1])]
            if wider:
                groups[min(wider, key=lambda k: (len(k[1]), k))] += groups.pop(key)
    # separators at changing places are no structure: what is left over is grouped by alphabet alone
    left: dict[str, list[str]] = defaultdict(list)
    for key in [k for k, v in groups.items() if len(v) < LEAST_EXAMPLES]:
        left["".join(sorted(set(key[0]))) + shape(groups[key][0])[1]] += groups.pop(key)
    out = []
    for group in [*groups.values(), *left.values()]:
        heads = Counter(c[:3] for c in group)
        families = [h for h, n in heads.items() if n >= LEAST_EXAMPLES and n >= 0.05 * len(group)]
        for h in families:
            out.append([c for c in group if c.startswith(h)])
        out.append([c for c in group if c[:3] not in families])
    return [sorted(g) for g in out if len(g) >= LEAST_EXAMPLES]


def infer(credentials: list[str], ordinary: np.ndarray | None = None) -> Automaton:
    """The automaton of one format's examples; every ``HELD_OUT``-th sets the threshold: all but
    one in fifty of them score at least as much."""
    prefix = beginning(credentials)
    ranked = sorted(credentials, key=lambda c: hashlib.sha256(c.encode()).digest())
    held = ranked[::HELD_OUT] if len(ranked) >= SPLIT_FROM else ranked
    learned = [c for k, c in enumerate(ranked) if k % HELD_OUT] if len(ranked) >= SPLIT_FROM else ranked
    states, m, settled = merged([symbols(c[len(prefix) :]) for c in learned])
    number = {s: k for k, s in enumerate(settled)}
    kinds = sorted({c for x in learned for c in symbols(x[len(prefix) :])})
    ends, steps, unseen = [], [], []
    for s in settled:
        q = states[s]
        total = math.log(q.visits + 0.5 * len(kinds))
        # an end that enough examples passed by is none
        ends.append(math.log((q.ends + 0.5) / (q.visits + 1)) if q.ends or q.visits < EVIDENCE else -math.inf)
        steps.append({c: (number[m.find(t)], math.log(q.taken[c] + 0.5) - total) for c, t in q.step.items()})
        unseen.append(math.log(0.5) - total)
    alphabet = "".join(CLASSES.get(c, c) for c in kinds)
    sizes = [len(c) for c in credentials]
    found = Automaton(prefix, (min(sizes), max(sizes)), alphabet, tuple(ends), tuple(steps), tuple(unseen), -math.inf)
    scores = sorted(found.score(c, ordinary) for c in held)
    least = scores[len(scores) // 50] - 1e-9
    return dataclasses.replace(found, least_score=least if ordinary is None else max(least, LEAST_RATIO))


OBSERVED = "kind string, credential string, pair int, n bigint"


def observed(docs: DataFrame) -> DataFrame:
    """One pass over the texts: rows ``(kind, credential)`` of what the base patterns find, and
    ``(pair, n)``, how often each letter, digit or other character follows each in the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(63 * 63, np.int64)
        for batch in batches:
            texts, rows = clean(batch["text"]), set()
            for k, t in enumerate(texts):
                spans = base_spans(t)
                if spans:
                    rows |= {(kind, c) for _, _, kind, c in spans if len(c) <= LONGEST}
                    texts[k] = redact(t, [s[:3] for s in spans], " ")
            for a, b in slices(texts, SLICE):
                codes = _CODES[np.frombuffer("\n".join(texts[a:b]).encode("utf-8", "surrogatepass"), np.uint8)]
                count += np.bincount(codes[:-1] * 63 + codes[1:], minlength=63 * 63)
            yield pd.DataFrame([(k, c, -1, 1) for k, c in sorted(rows)], columns=["kind", "credential", "pair", "n"])
        yield pd.DataFrame([("", "", p, n) for p, n in enumerate(count.tolist()) if n], columns=["kind", "credential", "pair", "n"])
        release()

    return materialize(docs.select("text").mapInPandas(run, OBSERVED), "observed")


def ordinary_text(seen: DataFrame) -> np.ndarray:
    """Log-probabilities of each character class after each; at most 63 x 63 sums."""
    out = np.zeros(63 * 63)
    for r in seen.where("pair >= 0").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    out = out.reshape(63, 63) + 0.5
    return np.log(out / out.sum(axis=1, keepdims=True))


def labelled(seen: DataFrame, per_kind: int = PER_KIND) -> dict[str, list[str]]:
    """At most ``per_kind`` distinct credentials of each kind."""
    found = seen.where("pair < 0").select("kind", "credential").distinct()
    smallest = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("credential").alias("h"), "credential"))), 1, per_kind)
    # thinned by a hash bucket first, so that no group of all credentials meets in one task
    thinned = found.groupBy("kind", F.pmod(F.xxhash64("credential"), F.lit(64)).alias("bucket"))
    parts = thinned.agg(F.expr(f"slice(array_sort(collect_set(struct(xxhash64(credential) as h, credential))), 1, {per_kind})").alias("c"))
    flat = parts.select("kind", F.explode("c").alias("c")).select("kind", "c.credential")
    rows = flat.groupBy("kind").agg(smallest.alias("c")).collect()
    return {r["kind"]: sorted(x["credential"] for x in r["c"]) for r in rows}


@dataclass(frozen=True)
class Model:
    """The formats of each kind and the model of ordinary text."""

    formats: dict[str, list[Automaton]]
    ordinary: np.ndarray


def train(docs: DataFrame, per_kind: int = PER_KIND) -> Model:
    """Automata of the formats with at least ``LEAST_EXAMPLES`` labelled credentials; an empty
    table, or one without credentials, gives none."""
    seen = observed(docs)
    ordinary = ordinary_text(seen)
    return Model({kind: [infer(group, ordinary) for group in formats(found)] for kind, found in sorted(labelled(seen, per_kind).items())}, ordinary)


def all_spans(text: str, model: Model) -> tuple[list, list]:
    """Base spans and all spans of a text, each ``(start, end, kind)``."""
    base = [s[:3] for s in base_spans(text)]
    added, covered = [], Covered([(ADDED, a, b) for a, b, _ in base])
    for automaton in (f for fs in model.formats.values() for f in fs):
        for m in automaton.pattern.finditer(text):
            a, b = m.span()
            token = m[0].rstrip(".=-/+") if not automaton.accepts(m[0], model.ordinary) else m[0]
            b = a + len(token)
            if not covered.meets(a, b) and automaton.accepts(token, model.ordinary):
                added.append((a, b, ADDED))
    if len(added) > 1:  # one token may fit several formats
        kept: list[tuple[int, int, str]] = []
        for span in sorted(set(added), key=lambda s: (s[0], -s[1])):
            if not kept or span[0] >= kept[-1][1]:
                kept.append(span)
        added = kept
    order = (*KINDS, ADDED)
    return base, sorted(base + added, key=lambda s: (s[0], order.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end``, joined by commas."""
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = MARK) -> str:
    """The text with each span (overlapping ones as one) replaced by ``mark``."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the struct column ``secrets``: counts by kind, digest of the base spans, all
    spans, and the redacted text (null where nothing was found).

    One row per row, all other columns kept; a column named ``secrets`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                base, spans = all_spans(t, held.value) if isinstance(t, str) else ([], [])
                kinds = [k for _, _, k in base]
                rows.append((
                    *(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans),
                    redact(t, spans) if spans else None,
                ))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])
        release()

    return docs.withColumn("secrets", of("text"))
