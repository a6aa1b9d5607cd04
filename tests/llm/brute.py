"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(LOWER) if lower else text) if w]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    parent = {i: i for i in ids}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    w = words(text, lower=True)
    return ({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if w else set()


def near_duplicates(docs: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(t) for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def remove_repeats(docs: dict[int, str | None], window: int = 20) -> dict[int, tuple[int, list[str]]]:
    seen: set[tuple[str, ...]] = set()
    out = {}
    for i in sorted(docs):
        w = words(docs[i])
        gone = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in seen:
                gone.update(range(s, s + window))
            seen.add(g)
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def bench_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def contamination(docs: dict[int, str | None], items: dict[int, str | None]) -> dict[int, tuple[int, int, str, bool]]:
    windows = defaultdict(set)
    for i, t in items.items():
        w = bench_words(t)
        for s in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[s : s + 13])].add(str(i))
    out = {}
    for d, t in docs.items():
        w, hit, found = bench_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        out[d] = (len(w), len(hit), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def unigrams(docs: dict[int, str | None], held_out: set[int]) -> tuple[Counter, int, int]:
    c = Counter(w for i, t in docs.items() if i not in held_out for w in [*words(t, lower=True), None])
    return c, sum(c.values()), len(c)
