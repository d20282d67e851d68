"""Suffix arrays of byte snippets in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by search.

Snippets are rows of one width whose bytes are all raised by one, so that 0 is free as padding and separator."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, where a suffix ends at its first 0 and equal ones are sorted by place.

    Starts from groups by eight bytes; each round splits only the groups that are not yet single, by the group
    of the suffix as many bytes further on as are sorted already."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(8):
        ended |= padded[i : i + n] == 0
        key = (key << np.uint64(8)) | np.where(ended, 0, padded[i : i + n]).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, bool)
    fresh |= ended[order]  # these differ by place
    place = np.flatnonzero(fresh)
    number = np.repeat(place, np.diff(np.r_[place, n]))
    rank = np.empty(n, np.int64)
    rank[order] = number
    done = 8
    while True:
        size = np.diff(np.r_[place, n])
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(at):
            return order
        suffix = order[at]
        pair = (number[at] << np.int64(32)) | rank[np.minimum(suffix + done, n - 1)]
        inner = np.argsort(pair, kind="stable")
        order[at] = suffix[inner]
        pair = pair[inner]
        fresh[at] = np.r_[True, pair[1:] != pair[:-1]]
        place = np.flatnonzero(fresh)
        number = np.repeat(place, np.diff(np.r_[place, n]))
        rank[order[at]] = number[at]
        done *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int, starts: int, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that suffixes at the first ``starts`` places of each row share with the suffix sorted
    before them; Kasai's rule that a suffix shares at least one byte less than its left neighbour did, for all
    rows at once. The result has a row for each row of ``width`` bytes."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    rows = n // width
    out = np.zeros((rows, starts), np.int64)
    padded = np.r_[text, np.zeros(most + 1, text.dtype)]
    shared = np.zeros(rows, np.int64)
    for s in range(starts):
        here = np.arange(rows) * width + s
        there = before[here]
        shared = np.where(there >= 0, np.maximum(shared - 1, 0), 0)
        going = np.flatnonzero(there >= 0)
        while len(going):
            k = shared[going]
            same = (k < most) & (padded[here[going] + np.minimum(k, most)] == padded[np.minimum(there[going] + k, n)])
            going = going[same]
            shared[going] += 1
        out[:, s] = shared
    return out


def first_owners(snippets: np.ndarray, owner: np.ndarray, match: int, per_shard: int) -> np.ndarray:
    """For each row of snippets and each start of ``match`` whole bytes in it: the smallest owner of that string.

    Shards of rows are sorted on their own; each then looks the strings of the others up by binary search.
    Starts without ``match`` bytes before padding get the row's own owner."""
    rows, width = snippets.shape
    starts = width - match + 1
    best = np.repeat(owner[:, None], starts, 1)
    gap = np.cumsum(snippets == 0, 1, dtype=np.int16)
    whole = np.empty((rows, starts), bool)
    whole[:, 0] = gap[:, match - 1] == 0
    whole[:, 1:] = gap[:, match:] == gap[:, : width - match]
    shards = []
    for a in range(0, rows, per_shard):
        part = snippets[a : a + per_shard]
        text = np.concatenate([part, np.zeros((len(part), 1), np.uint8)], 1).ravel()
        order = suffix_array(text)
        shared = common_prefixes(text, order, width + 1, starts, match)
        row, place = np.divmod(order, width + 1)
        use = place < starts
        row, place = row[use], place[use]
        use = whole[a + row, place]
        row, place = row[use], place[use]
        if not len(row):
            continue
        head = shared[row, place] < match
        head[0] = True
        first = np.flatnonzero(head)
        low = np.minimum.reduceat(owner[a + row], first)
        if rows <= per_shard:  # nothing to merge with
            best[row, place] = np.repeat(low, np.diff(np.r_[first, len(row)]))
            return best
        keys = np.lib.stride_tricks.sliding_window_view(text, match)[row[first] * (width + 1) + place[first]]
        keys = np.ascontiguousarray(keys).view(f"S{match}").ravel()
        shards.append([a + row, place, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(row)])), keys, low])
    for i, x in enumerate(shards):
        for y in shards[i + 1 :]:
            at = np.minimum(np.searchsorted(y[3], x[3]), len(y[3]) - 1)
            hit = y[3][at] == x[3]
            low = np.minimum(x[4][hit], y[4][at[hit]])
            x[4][hit] = low
            y[4][at[hit]] = low
    # a later pair may lower what an earlier one has compared: the smallest owner reaches all in one more pass
    for i, x in enumerate(shards):
        for y in shards[i + 1 :]:
            at = np.minimum(np.searchsorted(y[3], x[3]), len(y[3]) - 1)
            hit = y[3][at] == x[3]
            low = np.minimum(x[4][hit], y[4][at[hit]])
            x[4][hit] = low
            y[4][at[hit]] = low
    for row, place, group, _, low in shards:
        best[row, place] = low[group]
    return best
