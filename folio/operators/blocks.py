"""Blocks of scores inside a task: the best rows of each query without a row for each pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

TIE_TOLERANCE = 1e-6
#: Queries x pages scored at once, and products added up at once.
CELLS, PRODUCTS = 1 << 19, 1 << 21
#: A term is common with one in so many queries; so many cells the matrices of common terms have in all.
COMMON_SHARE, COMMON_CELLS = 32, 1 << 22


def prune(qi: np.ndarray, pid: np.ndarray, sc: np.ndarray, k: int):
    """Per query, the rows within the tie tolerance of its k-th best score; of rows with the same
    score (to nine places) the ``k`` smallest ids, as no other can come before them."""
    if len(qi) == 0:
        return qi, pid, sc
    same = np.rint(sc * 1e9)
    order = np.lexsort((pid, -same, qi))
    qi, pid, sc, same = qi[order], pid[order], sc[order], same[order]
    new_query = np.r_[True, qi[1:] != qi[:-1]]
    starts = np.flatnonzero(new_query)
    counts = np.diff(np.r_[starts, len(qi)])
    kth = np.full(len(starts), -np.inf)
    full = counts >= k
    kth[full] = sc[starts[full] + k - 1]
    runs = np.flatnonzero(new_query | np.r_[True, same[1:] != same[:-1]])
    place = np.arange(len(qi)) - np.repeat(runs, np.diff(np.r_[runs, len(qi)]))
    keep = (sc >= np.repeat(kth, counts) - TIE_TOLERANCE) & (place < k)
    return qi[keep], pid[keep], sc[keep]


class Best:
    """The best ``k`` rows of each of ``n`` queries so far, and below which score a row cannot be one."""

    def __init__(self, n: int, k: int):
        self.k, self.low, self.room = k, np.full(n, -np.inf), max(8 * k * n, 100_000)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, qi: np.ndarray, pid: np.ndarray, sc: np.ndarray) -> None:
        if len(qi):
            self.parts.append((qi, pid, sc))
            self.held += len(qi)
            if self.held > self.room:
                self.rows()

    def rows(self):
        """The rows ``(query, id, score)``, pruned."""
        if not self.parts:
            e = np.zeros(0, dtype=np.int64)
            return e, e, np.zeros(0)
        qi, pid, sc = prune(*(np.concatenate(c) for c in zip(*self.parts)), self.k)
        self.parts, self.held = [(qi, pid, sc)], len(qi)
        self.room = max(self.room, 2 * self.held)
        starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        full = np.diff(np.r_[starts, len(qi)]) >= self.k
        first = starts[full]
        self.low[qi[first]] = sc[first + self.k - 1] - TIE_TOLERANCE
        return qi, pid, sc


@dataclass
class QueryBlock:
    """Queries as lists by term: ``who[starts[t]:starts[t + 1]]`` have term ``t`` of weight ``idf[t]``."""

    numbers: np.ndarray
    terms: list[str]
    idf: np.ndarray
    starts: np.ndarray
    who: np.ndarray
    years: np.ndarray | None

    @staticmethod
    def of(pdf: pd.DataFrame) -> QueryBlock:
        """From ``_q``, ``_terms``, ``_idfs`` and, with a filter, ``_year`` (null: none)."""
        lens = np.fromiter((len(t) for t in pdf["_terms"]), dtype=np.int64, count=len(pdf))
        terms = np.concatenate([np.asarray(t, dtype=object) for t in pdf["_terms"]]) if len(pdf) else np.zeros(0, dtype=object)
        idfs = np.concatenate([np.asarray(w, dtype=np.float64) for w in pdf["_idfs"]]) if len(pdf) else np.zeros(0)
        codes, words = pd.factorize(terms)
        idf = np.zeros(len(words))
        idf[codes] = idfs
        order = np.argsort(codes, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(words)))].astype(np.int64)
        who = np.repeat(np.arange(len(pdf)), lens)[order]
        years = pdf["_year"].to_numpy(dtype=np.float64) if "_year" in pdf else None
        return QueryBlock(pdf["_q"].to_numpy(dtype=np.int64), list(words), idf, starts, who, years)


def lists(column: pd.Series, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all values of a column of arrays (null: empty)."""
    arrays = [a if a is not None else () for a in column.to_numpy()]
    lens = np.fromiter((len(a) for a in arrays), dtype=np.int64, count=len(arrays))
    return lens, np.concatenate([np.asarray(a, dtype=dtype) for a in arrays]) if lens.sum() else np.zeros(0, dtype=dtype)


def _scores(block: QueryBlock, lens: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``scores[page, query]``: the sums of the products of the terms that both have."""
    n = len(block.numbers)
    cells = len(lens) * n
    row = np.repeat(np.arange(len(lens)) * n, lens)
    values = weights * block.idf[terms]
    first, many = block.starts[terms], block.starts[terms + 1] - block.starts[terms]
    upto = np.cumsum(many)
    out, at = np.zeros(cells), 0
    while at < len(terms):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PRODUCTS, side="right")))
        m = many[at:end]
        offset = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        cell = np.repeat(row[at:end], m) + block.who[np.repeat(first[at:end], m) + offset]
        out += np.bincount(cell, np.repeat(values[at:end], m), minlength=cells)
        at = end
    return out.reshape(len(lens), n)


@dataclass
class YearQueries:
    """The queries of one year (None: those without one), their places ``rows`` among all: common
    terms as a matrix of idf by query, the others as a block; both numbered by places in their terms."""

    year: float | None
    rows: np.ndarray
    common: np.ndarray
    matrix: np.ndarray
    rare: np.ndarray
    block: QueryBlock


def _by_year(block: QueryBlock) -> list[YearQueries]:
    n = len(block.numbers)
    term = np.repeat(np.arange(len(block.starts) - 1), np.diff(block.starts))
    years = np.full(n, np.nan) if block.years is None else block.years
    groups = [(None, np.flatnonzero(np.isnan(years)))] + [(float(y), np.flatnonzero(years == y)) for y in np.unique(years[~np.isnan(years)])]
    out = []
    for year, rows in groups:
        if len(rows):
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            mine = place[block.who] >= 0
            t, who = term[mine], place[block.who[mine]]
            terms, at, many = np.unique(t, return_inverse=True, return_counts=True)
            most = np.argsort(-many, kind="stable")[:COMMON_CELLS // n]
            common = np.zeros(len(terms), bool)
            common[most[many[most] * COMMON_SHARE >= len(rows)]] = True
            matrix = np.zeros((int(common.sum()), len(rows)))
            often = common[at]
            np.add.at(matrix, ((np.cumsum(common) - 1)[at[often]], who[often]), block.idf[t[often]])  # rows of one key add up
            starts = np.r_[0, np.cumsum(many[~common])].astype(np.int64)
            rare = QueryBlock(block.numbers[rows], [], block.idf[terms[~common]], starts, who[~often], None)
            out.append(YearQueries(year, rows, terms[common], matrix, terms[~common], rare))
    return out


def _places(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``terms`` are known, and their places among the ascending ``known``."""
    if not len(known):
        return np.zeros(len(terms), bool), np.zeros(0, np.int64)
    place = np.searchsorted(known, terms)
    place[place == len(known)] = 0
    hit = known[place] == terms
    return hit, place[hit]


def _bound(s: np.ndarray, k: int) -> np.ndarray:
    """At most the ``k``-th best score of each column: that of the greatest scores of groups of pages."""
    groups = 4 * k
    width = len(s) // groups
    if width > 1:
        s = s[:width * groups].reshape(width, groups, -1).max(axis=0)
    return np.partition(s, len(s) - k, axis=0)[len(s) - k] - TIE_TOLERANCE


def _pages_by_year(years: pd.Series) -> dict[float, np.ndarray]:
    """The places of the pages that list a year."""
    lens, listed = lists(years.map(lambda a: None if a is None else [y for y in a if y is not None]), np.float64)
    pairs = pd.DataFrame({"year": listed, "page": np.repeat(np.arange(len(lens)), lens)}).drop_duplicates()
    return {float(y): pages.to_numpy() for y, pages in pairs.groupby("year")["page"]}


def best_pages(batches: Iterable[pd.DataFrame], block: QueryBlock, k: int) -> Iterator[pd.DataFrame]:
    """``(_q, corpus_id, score)`` of the best pages ``(corpus_id, _t, _w, _years)`` of each query:
    those with a term of the query, those that list its year if it has one.  Queries of a year are
    scored with the pages that list it alone."""
    n = len(block.numbers)
    if n == 0:
        return
    best, groups = Best(n, k), _by_year(block)
    for pdf in batches:
        ids = pdf["corpus_id"].to_numpy(dtype=np.int64)
        lens, terms = lists(pdf["_t"], np.int64)
        weights = lists(pdf["_w"], np.float64)[1]
        first = np.cumsum(lens) - lens
        listing = {} if block.years is None else _pages_by_year(pdf["_years"])
        for q in groups:
            pages, step = np.arange(len(pdf)) if q.year is None else listing.get(q.year, ids[:0]), max(1, CELLS // len(q.rows))
            for at in range(0, len(pages), step):
                part = pages[at:at + step]
                m = lens[part]
                index = np.repeat(first[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                of, t, w = np.repeat(np.arange(len(part)), m), terms[index], weights[index]
                hit, place = _places(q.rare, t)
                s = _scores(q.block, np.bincount(of[hit], minlength=len(part)), place, w[hit])
                hit, place = _places(q.common, t)
                width = len(q.common)
                s += np.bincount(of[hit] * width + place, w[hit], minlength=len(part) * width).reshape(len(part), width) @ q.matrix
                low = best.low[q.rows]
                if len(part) > k and np.isneginf(low).any():
                    low = np.maximum(low, _bound(s, k))
                page, query = np.divmod(np.flatnonzero((s > 0) & (s >= low)), len(q.rows))
                best.add(q.rows[query], ids[part[page]], s[page, query])
    qi, pid, sc = best.rows()
    for at in range(0, len(qi), 100_000):
        cut = slice(at, at + 100_000)
        yield pd.DataFrame({"_q": block.numbers[qi[cut]], "corpus_id": pid[cut], "score": sc[cut]})
