"""What the operators compute, letter by letter."""

from __future__ import annotations

TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def turned(s: str) -> str:
    return s.translate(TURN)[::-1]


def windows(seqs: list[str], k: int = 31) -> list[tuple[int, int, str]]:
    return [(c, i, s[i : i + k].upper()) for c, s in enumerate(seqs) for i in range(len(s) - k + 1) if not set(s[i : i + k].upper()) - set("ACGT")]


def distance(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=True))


def hits(seqs: list[str], q: str, n: int) -> set[tuple[int, int, str, str, int]]:
    out = set()
    for c, i, w in windows(seqs):
        for strand, v in (("+", w), ("-", turned(w))):
            if (d := distance(v, q)) <= n:
                out.add((c, i, strand, v, d))
    return out


def stack_clades(keys: list[list[int]]) -> set[tuple[int, int, int]]:
    lcp = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:], strict=False)] + [0]
    out, stack = {(0, 0, len(keys))}, []
    for i in range(1, len(keys) + 1):
        start = i - 1
        while stack and stack[-1][0] > lcp[i]:
            d, start = stack.pop()
            out.add((d, start, i))
        if lcp[i] and (not stack or stack[-1][0] < lcp[i]):
            stack.append((lcp[i], start))
    return out
