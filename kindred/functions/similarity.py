"""String similarities in 0..1: scalar forms, and forms that score one string against many at once with numpy bit masks."""

from __future__ import annotations

import numpy as np

ALIASES = {
    "jw": "jarowinkler", "jarowinkler": "jarowinkler", "jaro winkler": "jarowinkler", "jaro-winkler": "jarowinkler", "jaro": "jaro",
    "dl": "dl", "dameraulevenshtein": "dl", "damerau levenshtein": "dl", "damerau-levenshtein": "dl", "lv": "levenshtein", "levenshtein": "levenshtein",
    "ro": "ro", "ratcliffobershelp": "ro", "ratcliff obershelp": "ro", "ratcliff-obershelp": "ro", "osa": "osa", "optimal string alignment": "osa",
    "optimalstringalignment": "osa", "hamming": "hamming", "ham": "hamming",
}
WIDTH = 64  # longest string that a mask holds; longer ones are scored one by one


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            left.append(c)
    if not left:
        return 0.0
    m = len(left)
    moved = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _boost(score: float, a: str, b: str, w: float) -> float:
    if score < 0.7:
        return score
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return score + same * w * (1 - score)


def jaro_winkler(a: str, b: str, w: float = 0.1) -> float:
    return _boost(jaro(a, b), a, b, w)


def _normal(distance: int, a: str, b: str) -> float:
    return 1 - distance / max(len(a), len(b)) if a or b else 1.0


def osa_distance(a: str, b: str, swaps: bool = True) -> int:
    """Optimal string alignment; plain Levenshtein without swaps."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def dl_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein: a swapped pair may be edited again."""
    far, last = len(a) + len(b), {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[len(a), len(b)]


def hamming_distance(a: str, b: str) -> int:
    """Differing places; what one string is longer counts in full."""
    return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))


def ratcliff_obershelp(a: str, b: str) -> float:
    def common(a: str, b: str) -> int:
        best = (0, 0, 0)
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x == y:
                    new[j + 1] = row[j] + 1
                    if new[j + 1] > best[0]:
                        best = (new[j + 1], i - new[j + 1] + 1, j - new[j + 1] + 1)
            row = new
        n, i, j = best
        return n + common(a[:i], b[:j]) + common(a[i + n :], b[j + n :]) if n else 0

    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


SCALAR = {
    "jarowinkler": jaro_winkler,
    "jaro": lambda a, b, w=0.1: jaro(a, b),
    "levenshtein": lambda a, b, w=0.1: _normal(osa_distance(a, b, False), a, b),
    "osa": lambda a, b, w=0.1: _normal(osa_distance(a, b), a, b),
    "dl": lambda a, b, w=0.1: _normal(dl_distance(a, b), a, b),
    "hamming": lambda a, b, w=0.1: _normal(hamming_distance(a, b), a, b),
    "ro": lambda a, b, w=0.1: ratcliff_obershelp(a, b),
}


class Many:
    """Strings to be scored against one query at a time."""

    def __init__(self, words: list[str], width: int = WIDTH):
        self.words = words
        self.size = np.array([len(x) for x in words], np.int64)
        self.long = np.flatnonzero(self.size > width)
        n = int(min(width, self.size.max(initial=1)))
        self.chars = np.zeros((len(words), max(n, 1)), np.uint32)
        for i, x in enumerate(words):
            self.chars[i, : min(n, len(x))] = np.frombuffer(x[:n].encode("utf-32-le", "surrogatepass"), np.uint32)
        self.masks: dict[int, np.ndarray] = {}

    def mask(self, char: str) -> np.ndarray:
        """By string: bits of the places where it has the character."""
        c = ord(char)
        if c not in self.masks:
            bits = np.left_shift(np.uint64(1), np.arange(self.chars.shape[1], dtype=np.uint64))
            self.masks[c] = ((self.chars == c) * bits).sum(1, dtype=np.uint64)
        return self.masks[c]

    def jaro(self, a: str) -> np.ndarray:
        n, one = len(self.words), np.uint64(1)
        reach = np.maximum(0, np.maximum(len(a), self.size) // 2 - 1)
        full = np.uint64(2**64 - 1)
        used, got = np.zeros(n, np.uint64), np.zeros((len(a), n), bool)
        masks = [self.mask(c) for c in a]
        for i, m in enumerate(masks):
            if not m.any():
                continue
            low, high = np.maximum(0, i - reach), i + reach + 1
            window = np.where(high >= 64, full, (one << np.minimum(high, 63).astype(np.uint64)) - one)
            window &= np.where(low >= 64, np.uint64(0), full << np.minimum(low, 63).astype(np.uint64))
            free = m & window & ~used
            bit = free & (~free + one)
            used |= bit
            got[i] = bit != 0
        matches, rest, moved = got.sum(0), used.copy(), np.zeros(n, np.int64)
        for i, m in enumerate(masks):
            bit = np.where(got[i], rest & (~rest + one), np.uint64(0))
            moved += got[i] & ((bit & m) == 0)
            rest ^= bit
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (matches / len(a) + matches / self.size + (matches - moved // 2) / matches) / 3 if a else np.zeros(n)
        return np.where(matches > 0, score, np.where(self.size == 0, float(not a), 0.0))

    def jarowinkler(self, a: str, w: float) -> np.ndarray:
        score, same, going = self.jaro(a), np.zeros(len(self.words)), np.ones(len(self.words), bool)
        for i, c in enumerate(a[:4]):
            if i >= self.chars.shape[1]:
                break
            going &= (self.chars[:, i] == ord(c)) & (self.size > i)
            same += going
        return np.where(score < 0.7, score, score + same * w * (1 - score))

    def edits(self, a: str, swaps: bool) -> np.ndarray:
        n, width = self.chars.shape
        rows = [np.tile(np.arange(width + 1, dtype=np.int16), (n, 1))]
        for i, x in enumerate(a, 1):
            differ = self.chars != ord(x)
            row = np.empty_like(rows[-1])
            row[:, 0] = i
            old = rows[-1]
            for j in range(1, width + 1):
                best = np.minimum(np.minimum(old[:, j], row[:, j - 1]) + 1, old[:, j - 1] + differ[:, j - 1])
                if swaps and i > 1 and j > 1:
                    swap = (self.chars[:, j - 2] == ord(x)) & (self.chars[:, j - 1] == ord(a[i - 2]))
                    best = np.where(swap, np.minimum(best, rows[-2][:, j - 2] + 1), best)
                row[:, j] = best
            rows.append(row)
        return rows[-1][np.arange(n), np.minimum(self.size, width)]

    def dl(self, a: str, part: int = 4096) -> np.ndarray:
        """Unrestricted Damerau-Levenshtein distances, `part` words at a time."""
        out = np.empty(len(self.words), np.int64)
        for begin in range(0, len(self.words), part):
            chars, size = self.chars[begin : begin + part], self.size[begin : begin + part]
            n, width = chars.shape
            width = int(min(width, size.max(initial=0)))
            rows, every = np.full((len(a) + 2, n, width + 2), 1 << 14, np.int16), np.arange(n)
            rows[1:, :, 1] = np.arange(len(a) + 1)[:, None]
            rows[1, :, 1:] = np.arange(width + 1)
            last = np.zeros((n, max(width, 1)), np.int64)  # row in which the query last had each character
            for i, x in enumerate(a, 1):
                same, match = chars[:, :width] == ord(x), np.zeros(n, np.int64)
                for j in range(1, width + 1):
                    k, eq = last[:, j - 1], same[:, j - 1]
                    swap = rows[k, every, match] + (i - k) + (j - match - 1)
                    plain = np.minimum(rows[i, :, j] + ~eq, np.minimum(rows[i + 1, :, j], rows[i, :, j + 1]) + 1)
                    rows[i + 1, :, j + 1] = np.minimum(plain, swap)
                    match = np.where(eq, j, match)
                last[:, :width][same] = i
            out[begin : begin + part] = rows[len(a) + 1, every, np.minimum(size, width) + 1]
        return out

    def ro_bound(self, a: str) -> np.ndarray:
        """What no Ratcliff-Obershelp score exceeds: that of the characters in common, in any order."""
        common = sum((np.minimum((self.chars == ord(c)).sum(1), a.count(c)) for c in set(a)), np.zeros(len(self.words), np.int64))
        out = np.where(len(a) + self.size > 0, 2 * common / np.maximum(len(a) + self.size, 1), 1.0)
        out[self.long] = 1.0
        return out

    def hamming(self, a: str) -> np.ndarray:
        n = min(len(a), self.chars.shape[1])
        q = np.frombuffer(a[:n].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(n) < self.size[:, None]
        return ((self.chars[:, :n] != q) & inside).sum(1) + np.abs(self.size - len(a))

    def score(self, method: str, a: str, w: float = 0.1, least: float = 0.0) -> np.ndarray:
        """Scores of all words; of one that can't reach `least`, rounded to four digits, a value below it may be given instead."""
        one_by_one = SCALAR[method]
        if method == "ro":
            out = self.ro_bound(a)
            for i in np.flatnonzero(np.round(out, 4) >= least).tolist():
                out[i] = one_by_one(a, self.words[i], w)
            return out
        if len(a) > WIDTH:
            return np.array([one_by_one(a, b, w) for b in self.words])
        if method == "jaro":
            out = self.jaro(a)
        elif method == "jarowinkler":
            out = self.jarowinkler(a, w)
        else:
            distance = self.hamming(a) if method == "hamming" else self.dl(a) if method == "dl" else self.edits(a, method == "osa")
            longest = np.maximum(len(a), self.size)
            out = np.where(longest > 0, 1 - distance / np.maximum(longest, 1), 1.0)
        for i in self.long.tolist():
            out[i] = one_by_one(a, self.words[i], w)
        return out


class Fuzzy:
    """The bit-mask 'fuzzy' score of one query against many candidates; it isn't symmetric.

    Letters are A-Z and space (a-z and space if not upper). Query letters are numbered after all others are left out; candidates keep their
    places, up to 16. A letter takes the lowest free place in its window; a match at or before the letter's number counts as exact,
    and one below the places taken so far as a transposition, as does a letter that finds none though the candidate has it.
    """

    LIMIT = 16

    def __init__(self, words: list[str], upper: bool = True):
        first = 0x41 if upper else 0x61
        self.alphabet, self.space = range(first, first + 26), first - 1
        raw = [x.encode() for x in words]
        self.size = np.array([min(len(x), self.LIMIT) for x in raw], np.int64)
        self.masks = {c: np.zeros(len(words), np.int64) for c in (self.space, *self.alphabet)}
        for i, x in enumerate(raw):
            for k, c in enumerate(x[: self.LIMIT]):
                c = self.space if c == 0x20 else c
                if c in self.masks:
                    self.masks[c][i] |= 1 << k

    def score(self, a: str, w: float = 0.1) -> np.ndarray:
        raw, n = a.encode(), len(self.size)
        letters = [c for c in (self.space if c == 0x20 else c for c in raw) if c in self.masks]
        size = min(len(raw), self.LIMIT)
        if not size:
            return np.full(n, np.nan)
        least = size // 2 - 1 if size > 3 else 0
        wide = np.where((self.size <= 3) | (self.size // 2 - 1 <= least), least, self.size // 2 - 1)
        used, matches, exact, moved = (np.zeros(n, np.int64) for _ in range(4))
        for i, c in enumerate(letters, 1):
            here = self.masks[c]
            has = here != 0
            # 0-based places i - wide - 1 to i + wide + 1
            low, high = np.maximum(0, i - wide - 1), np.minimum(self.LIMIT - 1, i + wide + 1)
            window = ((1 << (high + 1)) - (1 << low)) if i < self.LIMIT else np.zeros(n, np.int64)
            free = here & np.maximum(window, 0) & ~used
            bit = free & -free
            moved += has & (bit - 1 < used)
            matches += bit != 0
            exact |= bit & ((1 << i) - 1)
            used |= bit
        turned = np.where(moved > matches / 2, moved - 1, moved)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = matches * (1024 // np.maximum(self.size, 1) + 1024 // size) / 1024
            base = (share + 1 - turned / matches) / 3
        head = np.zeros(n, np.int64)
        run = np.ones(n, bool)
        for k in range(4):
            run &= (exact >> k & 1) == 1
            head += run
        base = np.where(matches > 0, base, np.nan)
        return base + w * head * (1 - base)
