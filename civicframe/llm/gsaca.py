"""Linear suffix sorting by grouping.

Phase 1 groups suffixes by their Lyndon prefix. Groups are taken in descending
order; each member's pointer to the previous suffix of a smaller group is
found by following pointers already set, and the suffixes pointed at move,
by how often they are pointed at, into a new group right above what stays of
their old one (their prefix grows by the group's). Phase 2 walks the suffix
array from its start and lets each suffix put the one before it, and that
one's chain of previous smaller suffixes, at the front of their groups. No
group is sorted and no suffix is renamed again and again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> list[int]:
    """Suffix array of a sequence of whole numbers; its last symbol must be
    smaller than all others."""
    s = np.asarray(symbols)
    n = len(s)
    if n < 2:
        return list(range(n))
    order = np.argsort(s, kind="stable")
    sa: list[int] = order.tolist()
    at = [0] * n                       # place of each suffix in sa
    for i, x in enumerate(sa):
        at[x] = i
    ranked = s[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(first)
    of = np.empty(n, np.int64)
    of[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    group: list[int] = of.tolist()     # first place of each suffix's group
    size = [0] * n                     # members, at the group's first place
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist()):
        size[a] = b - a
    prev = [-2] * n                    # previous suffix of a smaller group, -1: none

    end = n - 1
    while end > 0:
        g = group[sa[end]]
        members = sa[g:end + 1]
        pointed: dict[int, int] = {}
        if len(members) == 1:
            i = members[0]
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = 1
        else:
            members.sort()             # whole numbers; lets pointers inside the group be reused
            for i in members:
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            times = sorted(set(pointed.values()), reverse=True)
            for k in times:
                some = pointed if len(times) == 1 else [p for p, c in pointed.items() if c == k]
                moved = []
                for p in some:
                    h = group[p]
                    size[h] -= 1
                    last = h + size[h]
                    i, q = at[p], sa[last]
                    sa[i], sa[last] = q, p
                    at[q], at[p] = i, last
                    moved.append((p, h))
                # all moved out of h stand behind what stays of it; a group that
                # moved as a whole stays one group at its old place
                news = {h: h + size[h] for _, h in moved}
                for p, h in moved:
                    new = news[h]
                    group[p] = new
                    size[new] += 1
        end = g - 1

    # phase 2
    front = group
    nxt = list(range(n))               # next free place of the group starting here
    done = [False] * n
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = True
    nxt[0] = 1
    for i in range(n):
        x = out[i] - 1
        while x >= 0 and not done[x]:
            f = front[x]
            out[nxt[f]] = x
            nxt[f] += 1
            done[x] = True
            x = prev[x]
    return out
