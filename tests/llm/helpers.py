"""Small tables and brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(lower)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, percent: int = 80) -> dict:
    """Component of each id, from all pairs."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in parent}
