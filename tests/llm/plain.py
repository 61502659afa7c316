"""Plain versions of the corpus operators, in loops."""

import re
from collections import Counter


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def jaccard_classes(rows, k, percent, by_row=False):
    """(id, set size, smallest id of its class) of each row, counted; or the number of each row's class."""
    sets = []
    for i, text in rows:
        w = words(text)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    if by_row:
        return group
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return Counter((i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(rows, sets, group, strict=True))


def plain_coverage(text, item, run):
    """Words of item that the plain greedy tiling covers, and its tiles."""
    a, b = (words(x, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for x in (text, item))
    run = min(run, len(b))
    used_a, used_b, out = set(), set(), []
    while run:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < run:
            break
        out.append(best[0])
        used_a |= set(range(best[1], best[1] + best[0]))
        used_b |= set(range(best[2], best[2] + best[0]))
    return sum(out), len(out), len(b)


def plain_difference(sizes, shards):
    """Sums by Karmarkar-Karp differencing: of the partial partitions, the two of largest spread are added, largest to smallest."""
    held = [[z] + [0] * (shards - 1) for z in sizes]
    total = [0] * shards
    while len(held) > 1:
        # the largest spread, of equal ones the oldest
        a = held.pop(max(range(len(held)), key=lambda i: (held[i][0] - held[i][-1], -i)))
        b = held.pop(max(range(len(held)), key=lambda i: (held[i][0] - held[i][-1], -i)))
        held.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return held[0] if held else total
