"""Periodic runs of a text's words, by the grouping phase of Baier's suffix sorter.

A run is a stretch of consecutive words with smallest period q, at least ``periods`` times q and at least ``shortest`` words
long, that no neighbouring word extends with period q.

1. Grouping: positions are kept in groups, ordered by what they are known to begin with, at first one word. Groups are taken
   from the highest to the lowest. Each member of the group at hand counts for the nearest earlier position that isn't
   taken; positions of one group that are counted equally often move to a new group just above theirs (higher for higher
   counts), and what they are known to begin with grows by as many copies of what the group at hand begins with. When a
   group's turn comes, that is the longest Lyndon word at its members: the Lyndon array, and which of the words are equal,
   are read off directly, and no suffix is sorted.
2. The same with the order of the words reversed. Under one of the two orders each run holds at least ``periods`` - 1 equal
   Lyndon words in a row, its roots (the longest Lyndon word at a root's place is the root, whatever follows the run).
3. Chains of equal Lyndon words are extended word by word to both sides, by less than a period each, since another root
   would be in the chain; a chain that is long enough then is a run.

Only stretches that may hold a run are grouped: after its first period, each pair of a run's words has stood at most a period
earlier. Pairs whose last occurrence is farther back than the stretch of such pairs around them allows are passed over, and
the stretches shrink with them. No run is lost by that, and most texts have no stretch left. Work is linear in the words (but
for sorting them), and a task holds one text's words at a time besides its batch.

Defined results: words are split at the six ASCII blanks alone, in the texts' UTF-8 bytes, with no change of case; a text that
is null or has no word has n_words 0, no runs and an empty collapsed text; rows are worked on one by one, so ids may be null or
repeat, and other columns pass through; an input column with the name of an output is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices

OUTPUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Passes over the stretches; fewer would only leave more to group.
_PASSES = 8


def lyndon(x: list[int]) -> tuple[list[int], list[int]]:
    """For each position of x (values from 0): how long the longest Lyndon word is that begins there, and its group; two
    positions are in one group if and only if these words are equal."""
    n, top = len(x), max(x, default=-1) + 1
    size, group = [1] * n, list(x)
    members: list[list[int]] = [[] for _ in range(top + 1)]  # the last one is an empty group above all
    for i, c in enumerate(x):
        members[c].append(i)
    below, over = list(range(-1, top)), list(range(1, top + 2))
    # the neighbours among the positions that aren't taken; the last entry of each list is for the ends
    before, after = list(range(-1, n)), list(range(1, n + 2))
    at = below[top]
    while at >= 0:
        counted: dict[int, int] = {}
        context = 0
        for i in members[at]:  # in rising order, so that earlier members are unlinked before later ones look back
            if group[i] == at:
                a, b = before[i], after[i]
                after[a], before[b] = b, a
                context = size[i]
                if a >= 0:
                    counted[a] = counted.get(a, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in counted.items():
            size[j] += times * context
            moves.setdefault((times, group[j]), []).append(j)
        for times, g in sorted(moves, reverse=True):
            new, up = len(members), over[g]
            members.append(moves[times, g])
            for j in moves[times, g]:
                group[j] = new
            below.append(g)
            over.append(up)
            below[up] = over[g] = new
        at = below[at]
    return size, group


def stretches(x: np.ndarray, shortest: int, periods: int) -> list[tuple[int, int]]:
    """Disjoint ranges of x that hold all its runs."""
    if len(x) < max(shortest, periods):
        return []
    pairs = x[:-1] * (int(x.max()) + 1) + x[1:]
    order = np.argsort(pairs, kind="stable")
    back = np.full(len(pairs), len(x), np.int64)
    same = pairs[order[1:]] == pairs[order[:-1]]
    back[order[1:][same]] = np.diff(order)[same]
    ok = back < len(x)
    least = min(max(shortest, periods * q) - q - 1 for q in range(1, shortest + 1))
    for _ in range(_PASSES):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        lo, hi = edges[::2], edges[1::2]
        # a run of period q gives periods * q - q - 1 such pairs or more
        most = np.where(hi - lo >= least, (hi - lo + 1) // (periods - 1), 0)
        within = np.zeros(len(pairs), np.int64)
        for a, b, m in zip(lo.tolist(), hi.tolist(), most.tolist(), strict=True):
            within[a:b] = m
        now = ok & (back <= within)
        if (now == ok).all():
            break
        ok = now
    out: list[tuple[int, int]] = []
    for a, b, m in zip(lo.tolist(), hi.tolist(), most.tolist(), strict=True):
        if m:
            a, b = max(0, a - m), b + 1
            if out and a <= out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
    return out


def runs(words: list, shortest: int = 6, periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of words, by start, then period."""
    if periods < 3:
        raise ValueError("runs hold three periods at least")
    names: dict = {}
    x = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    found, whole = set(), None
    for lo, hi in stretches(x, shortest, periods):
        whole = whole if whole is not None else x.tolist()
        ranks = np.unique(x[lo:hi], return_inverse=True)[1]
        for own in (ranks, ranks.max() - ranks):
            found |= _from_roots(whole, lo, *lyndon(own.tolist()), shortest, periods)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _from_roots(x: list[int], lo: int, size: list[int], group: list[int], shortest: int, periods: int) -> set[tuple[int, int, int]]:
    """Runs whose roots are chains of equal Lyndon words among x[lo:], whose lengths and groups are given."""
    n = len(size)
    step, own = np.asarray(size), np.asarray(group)
    nxt = np.arange(n) + step
    goes_on = np.zeros(n + 1, bool)
    goes_on[:n] = (nxt < n) & (own[np.minimum(nxt, n - 1)] == own)
    follows = np.zeros(n + 1, bool)
    follows[nxt[goes_on[:n]]] = True
    heads = np.flatnonzero(goes_on[:n] & ~follows[:n])
    out = set()
    for i in heads.tolist():
        p, links = size[i], 1
        end = i + p
        while goes_on[end - p]:
            links += 1
            end += p
        if links < periods - 1:
            continue
        start, stop = i + lo, end + lo
        while start and x[start - 1] == x[start - 1 + p]:
            start -= 1
        while stop < len(x) and x[stop] == x[stop - p]:
            stop += 1
        if stop - start >= max(shortest, periods * p):
            out.add((start, stop - start, p))
    return out


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]


def find_runs(df: DataFrame, text_col: str = "text", shortest: int = 6, periods: int = 4) -> DataFrame:
    """df with n_words, runs (by start, then period) and collapsed, the text's words without the repetitions of runs."""
    names = ["n_words", "runs", "collapsed"]
    kept = [c for c in df.columns if c not in names]
    source = df.withColumn("collapsed", F.col(text_col)).select(*kept, "collapsed")

    def each(batches):
        for batch in slices(batches):
            n, found, short = [], [], []
            for text in batch["collapsed"].cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                own = runs(words, shortest, periods)
                n.append(len(words))
                found.append([{"start": s, "length": k, "period": p} for s, k, p in own])
                short.append(b" ".join(collapse(words, own)))
            rows = [pa.array(n, pa.int64()), pa.array(found, _RUN), pa.array(short, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *rows], [*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema), OUTPUT])
    return source.mapInArrow(each, schema)
