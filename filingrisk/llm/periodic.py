"""Periodic runs of words: Lyndon arrays from Baier's grouping under both orders, roots extended to runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from filingrisk.llm.common import flat_map, text_or_empty

#: Shortest run in words, and least number of periods in one.
MIN_LENGTH, MIN_PERIODS = 24, 3


def group_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each position by its longest Lyndon word, and that word's length (the Lyndon array).

    Phase one of Baier's suffix sorter. Positions start in groups by their
    symbol, each with that symbol as context. Groups are taken from the greatest
    down; every member points at the nearest earlier position of a smaller
    group. A position takes the group's context behind its own once for each
    pointer, and those of one old group with equally many pointers move together
    into a new group right above the old one. In the end the context of a
    position is the longest Lyndon word that starts there, and two positions
    share a group exactly if those words are equal. Linear time.
    """
    n = len(symbols)
    kinds, ranks = np.unique(symbols, return_inverse=True)
    order = np.argsort(ranks, kind="stable")
    bounds = np.searchsorted(ranks[order], np.arange(len(kinds) + 1))
    members = [order[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    group, length, before, taken = ranks.tolist(), [1] * n, [-1] * n, bytearray(n)
    below = list(range(-1, len(kinds) - 1))
    above = list(range(1, len(kinds) + 1))
    current = len(kinds) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = None
        for i in own:
            taken[i] = 1
        pointed, last = {}, -1
        for i in own:
            j = i - 1
            while j >= 0 and taken[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                if j == last:
                    pointed[j] += 1
                else:
                    pointed[j] = 1
                    last = j
        if pointed:
            width = length[own[0]]
            moves = {}
            for j, count in pointed.items():
                moves.setdefault((count, group[j]), []).append(j)
                length[j] += count * width
            for count, old in sorted(moves, reverse=True):
                new = len(members)
                members.append(moves[count, old])
                for j in members[new]:
                    group[j] = new
                upper = above[old]
                below.append(old)
                above.append(upper)
                above[old] = new
                below[upper] = new
        current = below[current]
    return np.array(group, dtype=np.int64), np.array(length, dtype=np.int64)


def common_extension(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading symbols two sequences share, looked at in pieces that double."""
    at, step, end = 0, 16, min(len(left), len(right))
    while at < end:
        differ = left[at : at + step] != right[at : at + step] if at + step <= end else left[at:end] != right[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return end


def segment_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period.

    Under one of the two orders every Lyndon root of a run is the longest Lyndon
    word at its place, so roots that follow each other stand in one group. Each
    chain of such roots is extended both ways as long as the period holds, by
    the longest common extension of the places one period apart.
    """
    n, found = len(symbols), set()
    if n < min_length:
        return []
    for ordered in (symbols, -symbols):
        group, length = group_suffixes(ordered)
        follows = np.arange(n) + length
        inside = follows < n
        chained = np.zeros(n, dtype=bool)
        chained[inside] = group[follows[inside]] == group[inside]
        # Three periods hold two roots side by side; fewer may hold one only.
        first = chained.copy() if min_periods >= 3 else np.ones(n, dtype=bool)
        first[follows[chained]] = False
        for i in np.flatnonzero(first).tolist():
            p = int(length[i])
            end = i
            while chained[end]:
                end += p
            end += p
            end += common_extension(symbols[end:], symbols[end - p :])
            start = i - common_extension(symbols[:i][::-1], symbols[: i + p][::-1])
            if end - start >= max(min_length, min_periods * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def candidate_segments(symbols: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int]]:
    """Stretches [start, end) outside of which no run can lie; every run lies in one of them whole.

    With g = min_length // 3 a run of period q and length n >= max(3 g, 3 q) has
    n - g + 1 >= 2 q stretches of g symbols, so each of them stands in the run
    a second time, q <= n / min_periods away. A stretch that has no such twin is
    in no run and cuts the sequence. Twins are told by hash: a collision only
    leaves a stretch in. (With fewer than three periods asked for, g is 1.)
    """
    size = max(1, min_length // 3) if min_periods >= 3 else 1
    n = len(symbols) - size + 1
    if len(symbols) < min_length:
        return []
    numbers = (symbols.astype(np.uint64) + np.uint64(1)) * _STEP
    numbers ^= numbers >> np.uint64(29)
    hashes = numbers[:n].copy()
    for k in range(1, size):
        hashes *= _STEP
        hashes += numbers[k : k + n]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    far = np.iinfo(np.int64).max
    step = np.where(same, order[1:] - order[:-1], far)
    gap = np.empty(n, dtype=np.int64)
    gap[order] = np.minimum(np.concatenate([step, [far]]), np.concatenate([[far], step]))
    found, open_ = [], [(0, n)]
    while open_:
        a, b = open_.pop()
        words = b - a + size - 1
        if words < min_length:
            continue
        cuts = np.flatnonzero(gap[a:b] > words // min_periods)
        if not len(cuts):
            found.append((a, b + size - 1))
            continue
        edges = [a - 1, *(cuts + a).tolist(), b]
        open_ += [(x + 1, y) for x, y in zip(edges, edges[1:], strict=False) if y - x - 1 + size - 1 >= min_length]
    return sorted(found)


def word_runs(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word list, by start, then period."""
    if len(words) < min_length:
        return []
    known: dict = {}
    symbols = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == len(words):
        return []
    runs = []
    for a, b in candidate_segments(symbols, min_length, min_periods):
        runs += [(a + s, n, p) for s, n, p in segment_runs(symbols[a:b], min_length, min_periods)]
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document; docs has doc_id and text.

    Words are separated by ASCII white space. A run is a stretch of words with
    smallest period q and at least max(min_length, min_periods * q) words that
    neither neighbour extends with that period; runs may overlap. `runs` has
    their start (word number), length and period by start, then period.
    `collapsed` is the text with only the first period of each run, words joined
    by one space: a word goes if some run holds it behind its first period.

    A null text counts as empty: no words, no runs, empty collapsed text. Every
    row is taken on its own, so repeated rows, repeated or null doc_ids give one
    row each; other columns are ignored. An empty table gives no rows. A text is
    held by one task, whatever its length, in linear time and memory.
    """
    if min_length < 1 or min_periods < 2:
        raise ValueError("a run has at least one word and two periods")

    def make():
        def produce(doc_id, text):
            words = text.encode().split()
            runs = word_runs(words, min_length, min_periods)
            kept = words
            if runs:
                keep = np.ones(len(words), dtype=bool)
                for start, length, period in runs:
                    keep[start + period : start + length] = False
                kept = [words[i] for i in np.flatnonzero(keep).tolist()]
            named = [{"start": s, "length": n, "period": p} for s, n, p in runs]
            yield doc_id, len(words), named, b" ".join(kept).decode()

        return produce

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return flat_map(docs.select("doc_id", text_or_empty().alias("text")), make, ddl)
