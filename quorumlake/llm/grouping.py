"""Linear suffix sorting by grouping.

Suffixes with the same Lyndon prefix form a group, and groups are ordered by
that prefix. Groups are made from the highest down: a group's suffixes find their
previous smaller ones (the nearest to the left in a lower group, by pointers
already set), and those, parted by how many of the group point to them, move to
new groups right above their old ones. Then each suffix in its final order places
the ones before it at the front of their groups; nothing is renamed or sorted
again.
"""

from __future__ import annotations

from array import array


def suffix_array(text: bytes) -> array:
    """Start positions of text's suffixes in their order; a suffix before its own extensions."""
    n = len(text)
    if n < 2:
        return array("l", range(n))
    # slots holds the suffixes, group by group; first[i] is the slot where i's group begins.
    counts = [0] * 257
    for c in text:
        counts[c + 1] += 1
    for c in range(256):
        counts[c + 1] += counts[c]
    start = counts[:256]
    first = [start[c] for c in text]
    size = [0] * (n + 1)
    slots, slot_of, fill = [0] * n, [0] * n, start[:]
    for i in range(n):
        c = text[i]
        k = fill[c]
        slots[k], slot_of[i] = i, k
        fill[c] = k + 1
    for c in range(256):
        if fill[c] > start[c]:
            size[start[c]] = fill[c] - start[c]
    prev = [-1] * n
    end = n
    while end > 0:
        g = first[slots[end - 1]]
        members = slots[g:end]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and first[j] > g:
                j = prev[j]
            if j >= 0 and first[j] == g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            if len(times) == 1:
                ordered = [list(times)]
            else:
                by_times: dict[int, list[int]] = {}
                for j, k in times.items():
                    by_times.setdefault(k, []).append(j)
                ordered = [by_times[k] for k in sorted(by_times, reverse=True)] if len(by_times) > 1 else list(by_times.values())
            for part in ordered:
                moved: dict[int, int] = {}
                for j in part:
                    f = first[j]
                    m = moved.get(f, 0)
                    moved[f] = m + 1
                    # To the tail of its old group.
                    k = f + size[f] - 1 - m
                    a, other = slot_of[j], slots[k]
                    slots[a], slots[k] = other, j
                    slot_of[other], slot_of[j] = a, k
                for f, m in moved.items():
                    left = size[f] - m
                    size[f] = left
                    new = f + left
                    size[new] = m
                    if left:
                        for k in range(new, new + m):
                            first[slots[k]] = new
        end = g
    # The empty suffix comes first and places the last position and those it closes.
    order = array("l", bytes(array("l").itemsize * n))
    taken = bytearray(n)
    free = first  # next free slot by group, kept at the group's first slot
    at = list(range(n + 1))
    j = n - 1
    while j >= 0 and not taken[j]:
        k = at[free[j]]
        at[free[j]] = k + 1
        order[k], taken[j] = j, 1
        j = prev[j]
    for s in range(n):
        j = order[s] - 1
        while j >= 0 and not taken[j]:
            k = at[free[j]]
            at[free[j]] = k + 1
            order[k], taken[j] = j, 1
            j = prev[j]
    return order
