"""Periodic runs of words, by an online sparse dynamic program over diagonals.

Two equal words q apart lie on the diagonal of lag q. Going through a text word by
word, each active diagonal whose earlier word equals the word grows by one; one
that breaks ends, and if it is long enough its run is given out at once.

A frequent word has many earlier occurrences, most of which start nothing. A run
of period q has a diagonal of at least 2q words, and of 16, so a diagonal is
opened only where the last g words occurred before, g the power of two from 16 up
that is at least q and under 2q: within a run those words lie a whole period
apart, never nearer, so their last occurrence has lag q. Each word opens at most
one diagonal per g, and only words in a repeated stretch of 16 are looked at.
Stretches are numbered by doubling, exactly: a stretch of 2g words is the pair of
the numbers of its halves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.words import PLAIN, cut, pieces

#: Words of a run at least, and periods it holds at least.
LEAST, PERIODS = 24, 3
#: The shortest diagonal of a run is of 16 words: max(24 - q, 2q) for q = 8.
_SEED = 16

RUN = "struct<start:long,length:long,period:long>"


def _numbers(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose key occurs again, the number of each one's key)."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[number] > 1
    return at[again], number[again]


def openings(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, matched) of every diagonal to be opened, by place.

    ``codes`` are the words of texts laid end to end, ``counts`` their numbers of words;
    ``matched`` words up to and with ``place`` equal those a lag before.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    at, number = _numbers(text * (int(codes.max(initial=0)) + 1) + codes, np.arange(len(codes)))
    found = []
    g = 1
    while len(at):
        if g >= _SEED:
            order = np.argsort(number, kind="stable")
            place, own = at[order], number[order]
            lag = place[1:] - place[:-1]
            least = 1 if g == _SEED else g // 2 + 1
            near = (own[1:] == own[:-1]) & (lag >= least) & (lag <= g)
            found.append((place[1:][near] + g - 1, lag[near], np.full(int(near.sum()), g)))
        # the stretch of 2g from a place needs both halves, in one text
        here = np.full(len(codes), -1, np.int64)
        here[at] = number
        fits = at + 2 * g <= ends[at]
        at, number = at[fits], number[fits]
        second = here[at + g]
        at, number = at[second >= 0], number[second >= 0] * (int(here.max(initial=0)) + 1) + second[second >= 0]
        at, number = _numbers(number, at)
        g *= 2
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    place, lag, matched = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((lag, place))
    return place[order], lag[order], matched[order]


def text_runs(words: list[int], opened: Iterator[tuple[int, int, int]], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a text, by start, then period; ``opened`` is of ``openings``, in order."""
    n = len(words)
    active: dict[int, int] = {}  # lag -> matches up to the word before
    out: dict[tuple[int, int], int] = {}

    def ended(at: int, lag: int) -> None:
        """The diagonal's last match was before ``at``."""
        length = active.pop(lag) + lag
        if length >= max(least, periods * lag):
            place = (at - length, length)
            # the same stretch under a multiple of its period is the same run
            out[place] = min(lag, out.get(place, lag))

    following = next(opened, None)
    i = 0
    while active or following is not None:
        if not active:
            i = max(i, following[0])
        if i >= n:
            for lag in list(active):
                ended(n, lag)
            break
        for lag in list(active):
            if words[i - lag] == words[i]:
                active[lag] += 1
            else:
                ended(i, lag)
        while following is not None and following[0] <= i:
            at, lag, matched = following
            if lag not in active and at == i:
                k = i - matched
                while k >= lag and words[k] == words[k - lag]:
                    k -= 1
                active[lag] = i - k
            following = next(opened, None)
        i += 1
    return sorted((s, length, q) for (s, length), q in out.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run, or in the first period of every run they are in."""
    mark = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return np.cumsum(mark[:-1]) == 0


def _found(least: int, periods: int, reorder: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            words, counts = cut(batch.column(1), PLAIN)
            if reorder is not None:
                starts = np.cumsum(counts) - counts
                parts = [
                    np.arange(s, s + n) if (own := reorder(i, n)) is None else s + own
                    for i, s, n in zip(ids, starts.tolist(), counts.tolist(), strict=True)
                ]
                words = words.take(pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
                counts = np.array([len(p) for p in parts], np.int64)
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            spelled = coded.dictionary.to_pylist()
            place, lag, matched = openings(codes, counts)
            ends = np.cumsum(counts)
            cuts = np.searchsorted(place, np.append(0, ends))
            rows = []
            for k, doc_id in enumerate(ids):
                low, high = ends[k] - counts[k], ends[k]
                own: list[tuple[int, int, int]] = []
                if cuts[k] < cuts[k + 1]:
                    part = slice(cuts[k], cuts[k + 1])
                    opened = zip((place[part] - low).tolist(), lag[part].tolist(), matched[part].tolist(), strict=True)
                    own = text_runs(codes[low:high].tolist(), opened, least, periods)
                kept = codes[low:high]
                if own:
                    kept = kept[collapsed(len(kept), own)]
                rows.append((doc_id, int(counts[k]), own, strongest(own), b" ".join([spelled[c] for c in kept.tolist()]).decode()))
            one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            shown = [dict(zip(("start", "length", "period"), r[3], strict=True)) if r[3] else None for r in rows]
            listed = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array(listed, pa.list_(one)),
                    pa.array(shown, one),
                    pa.array([r[4] for r in rows], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    return run


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    periods: int = PERIODS,
    reorder: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """The periodic runs of each whole text, and the text with each run cut to its first period.

    Reads ``doc_id`` and ``text`` (null: no words), ignores other columns. A run
    is a stretch of words with smallest period q, of at least ``least`` words and
    ``periods`` periods, that no neighbouring word extends; ``least`` is at least 24
    and ``periods`` at least 3. Returns per row
    doc_id, n_words, runs (start, length, period; by start, then period),
    strongest (greatest length by period, or null) and collapsed, the kept words joined by one
    space. ``reorder`` may give, from a row's id and number of words, the numbers
    of the words to be read in their place; n_words counts these. Repeated rows and null ids are taken row by row; an
    empty table gives an empty result.
    """
    if least < LEAST or periods < PERIODS:
        raise ValueError(f"runs have at least {LEAST} words and {PERIODS} periods")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _found(least, periods, reorder), f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
    )
