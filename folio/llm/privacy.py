"""Personal data: fixed base patterns, and terms that give a protected entity away.

Addresses and numbers that the base patterns find are the protected entities, each by its
normalised value.  A term is information about an entity if the two occur together: over all
documents, ``PMI(c; t) = log2(p(c, t) / (p(c) p(t)))`` of the information content ``IC(c) =
-log2 p(c)`` is given away by the term ``t``, and ``IC - PMI = -log2 p(c | t)`` bits of doubt are
left.  Joint occurrence is counted in a window of ``REACH`` terms on either side of the entity.

* A term that leaves at most ``REMOVE_DOUBT`` bits is removed from the text.
* One that leaves at most ``DOUBT`` bits is generalised to the class of its written form.

Both need ``SUPPORT`` different windows (copies of one window count once, so a text copied a
thousand times proves nothing) and ``LEAST_BITS`` of pointwise information.  Disclosing terms are
found wherever they stand, also in documents without the entity.

Spans are code points, end exclusive.  A null text counts as empty and has no spans.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.words import ALNUM, clean, hash_spans, slices, word_hashes, word_spans
from folio.session import materialize

KINDS = ("email", "ip", "card", "phone")
REMOVED, GENERALISED = "removed", "generalised"
# The base patterns.  The lookbehind and the possessive runs find the same matches
# in one pass: a match cannot begin inside a run of digits.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

#: Terms on either side of an entity, on its line, and the characters that are looked at for them.
REACH, REACH_CHARS = 8, 160
SUPPORT = 3
DOUBT, REMOVE_DOUBT = 1.0, 0.2
LEAST_BITS = 3.0
#: Terms of fewer characters say nothing.
LEAST_TERM = 3
#: Term hashes that one pass over the texts carries (8 MB).
PASS_TERMS = 1_000_000
SLICE = 4_000_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at, free = 0, text.find("@"), 0
    while at >= 0:
        free = max(free, end)
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        free = at + 1
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` by kind as listed, then by start."""
    found = [("email", a, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span(), ".".join(parts)))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span(), digits))
    for m in PHONE.finditer(text) if "+" in text else ():
        digits = NO_DIGIT.sub("", m[0])
        if 8 <= len(digits) <= 15:
            found.append(("phone", *m.span(), digits))
    return found


class Covered:
    """The union of some spans."""

    def __init__(self, spans: list[tuple]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((s[1], s[2]) for s in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b) - 1  # the last one that begins before b
        return k >= 0 and self.ends[k] > a


def _window(text: str, start: int, end: int, covered: Covered) -> list[str]:
    """The terms around an entity on its line, outside of all entities; one that the reach cuts
    through is left out."""
    a, b = max(0, start - REACH_CHARS), min(len(text), end + REACH_CHARS)
    left, right = text[a:start], text[end:b]
    cut_left, cut_right = left.rfind("\n") + 1, right.find("\n")
    before = [m[0] for m in TERM.finditer(left, cut_left) if (m.start() > 0 or a == 0) and not covered.meets(a + m.start(), a + m.end())]
    stop = cut_right if cut_right >= 0 else len(right)
    after = [m[0] for m in TERM.finditer(right, 0, stop) if (m.end() < len(right) or b == len(text)) and not covered.meets(end + m.start(), end + m.end())]
    return [*before[-REACH:], *after[:REACH]]


def _name(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: In the place of a term where the entity alone is counted.
NO_TERM = 0
OCCURRENCE = "entity bigint, term bigint, context bigint, n bigint"


def occurrences(docs: DataFrame) -> DataFrame:
    """``(entity, term, context, n)``: terms in windows around entities, ``n`` is 1 once for each
    document, entity and term; rows of ``NO_TERM`` count the entity's documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in clean(batch["text"]):
                spans = base_spans(text)
                if not spans:
                    continue
                covered, seen = Covered(spans), set()
                for kind, a, b, value in spans:
                    entity = _name(f"{kind}:{value}")
                    words = [w for w in _window(text, a, b, covered) if len(w) >= LEAST_TERM]
                    if entity not in seen:
                        seen.add(entity)
                        rows.append((entity, NO_TERM, NO_TERM, 1))
                    if words:
                        hashes = np.unique(word_hashes([" ".join(words)], ALNUM)[0]).view(np.int64).tolist()
                        context = _name(" ".join(words).lower())
                        for h in hashes:
                            rows.append((entity, h, context, int((entity, h) not in seen)))
                            seen.add((entity, h))
            yield pd.DataFrame(rows, columns=["entity", "term", "context", "n"])

    return docs.select("text").mapInPandas(run, OCCURRENCE)


def _passes(rows: DataFrame, col: str) -> Iterator[np.ndarray]:
    """The distinct values of a bigint column in ascending arrays of about ``PASS_TERMS``."""
    values = materialize(rows.select(col).distinct(), "terms")
    parts = -(-values.count() // PASS_TERMS)
    for k in range(parts):
        block = values.where(F.pmod(F.xxhash64(col), F.lit(parts)) == k)
        found = np.array([r[0] for r in block.toLocalIterator()], np.int64)
        if len(found):
            yield np.sort(found)


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``(term, in_docs)``: the rows of ``docs`` that hold each of the ``terms``."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(terms.view(np.uint64)))  # at most about PASS_TERMS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        count = np.zeros(len(known), np.int64)
        for batch in batches:
            texts = clean(batch["text"])
            for a, b in slices(texts, SLICE):
                h, owner = word_hashes(texts[a:b], ALNUM)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                pair = np.unique(owner[hit].astype(np.int64) * len(known) + at[hit]) % len(known)
                count += np.bincount(pair, minlength=len(known))
        at = np.flatnonzero(count)
        yield pd.DataFrame({"term": known[at].view(np.int64), "n": count[at]})

    return docs.select("text").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("in_docs"))


def disclosing(docs: DataFrame, support: int = SUPPORT, doubt: float = DOUBT) -> DataFrame:
    """``(term, entity, in_both, in_docs, pmi, ic, action)``: for each term hash that gives some
    entity away, the entity it says most about.  Counted over all rows of ``docs(text)``; pairs
    are counted per window first, so an entity in every document is spread over the tasks."""
    spark = docs.sparkSession
    by_window = occurrences(docs).groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    by_pair = materialize(
        by_window.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
        .where((F.col("contexts") >= support) | (F.col("term") == NO_TERM)), "entity-terms")
    pairs = by_pair.where(F.col("term") != NO_TERM).select("entity", "term", F.col("n").alias("in_both"))
    counts = None
    for terms in _passes(pairs, "term"):
        part = materialize(term_counts(docs, terms), "term-counts")
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return spark.createDataFrame([], "term bigint, entity bigint, in_both bigint, in_docs bigint, pmi double, ic double, action string")
    total = docs.count()
    entities = by_pair.where(F.col("term") == NO_TERM).select("entity", F.col("n").alias("of_entity"))
    told = pairs.join(counts, "term").join(entities, "entity").select(
        "term", "entity", "in_both", "in_docs", F.log2(F.lit(float(total)) / F.col("of_entity")).alias("ic"),
        F.log2(F.col("in_docs") / F.col("in_both")).alias("doubt"))
    told = told.withColumn("pmi", F.col("ic") - F.col("doubt")).where((F.col("doubt") <= doubt) & (F.col("pmi") >= LEAST_BITS))
    most = told.groupBy("term").agg(F.min_by(F.struct("entity", "in_both", "in_docs", "pmi", "ic", "doubt"), F.struct("doubt", "entity")).alias("m"))
    return materialize(most.select(
        "term", "m.entity", "m.in_both", "m.in_docs", "m.pmi", "m.ic",
        F.when(F.col("m.doubt") <= REMOVE_DOUBT, REMOVED).otherwise(GENERALISED).alias("action")), "disclosing")


Span = tuple[str, int, int]


def term_spans(texts: list[str], terms: np.ndarray, removed: np.ndarray) -> list[list[Span]]:
    """For each text the spans of the ``terms`` (ascending hashes); the kind is the action."""
    out: list[list[Span]] = [[] for _ in texts]
    for a, b in slices(texts, SLICE) if len(terms) else ():
        buf, starts, ends, owner = word_spans(texts[a:b], ALNUM)
        h = hash_spans(buf, starts, ends)
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hits = np.flatnonzero(terms[at] == h)
        if not len(hits):
            continue
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        for k in hits:
            t = int(owner[k])
            out[a + t].append((REMOVED if removed[at[k]] else GENERALISED, int(points[starts[k]] - begin[t]), int(points[ends[k]] - begin[t])))
    return out


def written(spans: list[Span]) -> str:
    """``kind:start:end``, joined by commas."""
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _class(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with base spans replaced by their kind (overlapping ones as one, by the first),
    generalised terms by the class of their written form, and removed terms left out."""
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], "" if kind == REMOVED else _class(text[a:b]) if kind == GENERALISED else f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans array<struct<kind: string, start: int, end: int>>"


def _finder(terms: np.ndarray, removed: np.ndarray, spark, base: bool):
    held = spark.sparkContext.broadcast((terms, removed))  # at most about PASS_TERMS

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms, removed = held.value
        for batch in batches:
            texts, rows = clean(batch), []
            for text, added in zip(texts, term_spans(texts, terms, removed)):
                spans = [s[:3] for s in base_spans(text)]
                kinds = [k for k, _, _ in spans]
                covered = Covered(spans) if added else None
                free = [s for s in added if not covered.meets(s[1], s[2])]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(spans).encode()).hexdigest(), [*(spans if base else ()), *free]))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found


def scan(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``personal``: counts by kind, the digest of the base spans,
    and all spans, base ones by kind as listed and start, then disclosing terms by start.

    ``told`` is the result of ``disclosing``.  One row per row, all other columns kept; a column
    named ``personal`` is replaced.  Null and empty texts have no spans; an empty table stays
    empty.  More than ``PASS_TERMS`` terms are looked up in several passes over the texts.
    """
    spark = docs.sparkSession
    parts = max(1, -(-told.count() // PASS_TERMS))
    out = None
    for k in range(parts):
        block = told.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).select("term", "action")
        rows = [(r[0], r[1] == REMOVED) for r in block.toLocalIterator()]
        terms, removed = np.array([t for t, _ in rows], np.int64).view(np.uint64), np.array([x for _, x in rows], bool)
        order = np.argsort(terms)
        found = _finder(terms[order], removed[order], spark, k == 0)
        if out is None:
            out = docs.withColumn("personal", found("text"))
        else:
            more = F.filter(found("text")["spans"], lambda s: s["kind"].isin(REMOVED, GENERALISED))
            out = out.withColumn("personal", F.col("personal").withField("spans", F.concat("personal.spans", more)))
    if parts > 1:
        place = "array_position(array('email', 'ip', 'card', 'phone', 'removed', 'generalised'), {0}.kind)"
        place = f"if({place} > 4, 5, {place})"  # terms in the order of the text
        x, y = place.format("x"), place.format("y")
        rank = F.expr(f"array_sort(personal.spans, (x, y) -> cast(if({x} = {y}, x.start - y.start, {x} - {y}) as int))")
        out = out.withColumn("personal", F.col("personal").withField("spans", rank))
    return out


def sanitise(docs: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``text`` sanitised: base spans and disclosing terms replaced or removed.
    All other columns are kept as they are; null texts stay null."""
    told = disclosing(docs) if told is None else told
    kept = docs.withColumns({f"__in_{c}": F.col(c) for c in docs.columns})

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else sanitised(t, [(s["kind"], s["start"], s["end"]) for s in found]) if len(found) else t
            for t, found in zip(texts, spans)], dtype=object)

    found = scan(kept, told)
    return found.select(*((replaced("__in_text", "personal.spans") if c == "text" else F.col(f"__in_{c}")).alias(c) for c in docs.columns))


def span_list(col: str = "personal") -> Column:
    """The spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(F.col(f"{col}.spans"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
