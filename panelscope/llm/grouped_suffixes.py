"""Linear suffix sorting by grouping (small helper, runs inside a task).

Phase 1 sorts suffixes into groups that share a Lyndon prefix. Groups are
processed in descending order; each member's previous smaller pointer leads to
the nearest suffix before it in a lower group. A suffix pointed at by l members
of the group has its own prefix followed by l copies of the group's prefix, so
it moves to a new group directly above its old one; larger l come higher.

Phase 2 walks over the order from the smallest suffix on: the suffix before each
placed one, and those on its chain of pointers, take the next free place of
their groups. Nothing is renamed and nothing recursive is solved.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: np.ndarray) -> tuple[list[int], list[int]]:
    """For each suffix the first place of its group in the order, and its
    previous smaller pointer (-1: none). The text's last symbol must be
    smaller than all others and occur once."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    first = np.empty(n, np.int64)
    first[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    sizes = np.zeros(n, np.int64)
    sizes[heads] = np.diff(np.append(heads, n))

    members, group, place, size = order.tolist(), first.tolist(), place_of.tolist(), sizes.tolist()
    pointer = [-1] * n
    end = n
    while end > 0:
        at = group[members[end - 1]]
        if end - at == 1:
            i = members[at]
            p = i - 1
            while p >= 0 and group[p] > at:
                p = pointer[p]
            pointer[i] = p
            end = at
            if p >= 0:  # the one suffix it points at moves to the top of its group
                g = group[p]
                k = size[g] - 1
                if k:
                    size[g] = k
                    top = g + k
                    q = members[top]
                    here = place[p]
                    members[here], place[q] = q, here
                    members[top], place[p] = p, top
                    group[p] = top
                    size[top] = 1
            continue
        counts: dict[int, int] = {}
        for i in sorted(members[at:end]):
            p = i - 1
            while p >= 0 and group[p] > at:
                p = pointer[p]
            if p >= 0 and group[p] == at:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        end = at
        moves: dict[tuple[int, int], list[int]] = {}
        for p, c in counts.items():
            moves.setdefault((-c, group[p]), []).append(p)
        for key in sorted(moves) if len(moves) > 1 else moves:
            moving, g = moves[key], key[1]
            k = size[g] - len(moving)
            if not k:
                continue
            size[g] = k
            top = g + k
            size[top] = len(moving)
            slot = top
            for p in moving:
                q = members[slot]
                here = place[p]
                members[here], place[q] = q, here
                members[slot], place[p] = p, slot
                slot += 1
                group[p] = top
    return group, pointer


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order. The text's last
    symbol must be smaller than all others and occur once."""
    n = len(text)
    free, pointer = lyndon_groups(text)
    group = list(free)
    free = list(range(n))  # next free place of the group that starts there
    order = [-1] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = pointer[j]
    return np.array(order, np.int64)
