"""Small hard tables and plain versions of what the operators do."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, t string, uid long, row_no int, label string, cid long, shard int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n))


def hard_rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 90)
    words = base.split()
    words[40] = "Changed"
    texts = [
        None, "", " \n\t ", "one", "a b c d", "It's  we'll\n\n they've 12³ ٣ 中文 <|endoftext|> x y 　 z 🙂\r\n", "#$% || && ***", "x" * 5000, "the " * 6000, prose(rng, 9000),
        base, base, base.upper(), " ".join(words), "Once\n" + base, prose(rng, 60) + "\n" + base + "\n" + prose(rng, 40), prose(rng, 80), prose(rng, 30) + "\nsame line here\nsame line here",
    ]
    rows = [(i if i != 4 else None, t, ["en", "fr", None][i % 3], ["s0", None][i % 2], None, 1, "t", 2, 3, "l", 4, 5) for i, t in enumerate(texts)]
    return [*rows, rows[10], rows[0]]


def hard(spark, rows=None):
    return spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA).repartition(3)


def shingles(text: str | None, n: int = 5) -> frozenset:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lower)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(texts: list[str | None]) -> list[int]:
    """Least position that links reach, by comparing all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    x = text or ""
    w = WORDS.findall(x)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    marked = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    seen: Counter = Counter()
    again = 0
    for line in x.split("\n"):
        again += bool(WORDS.search(line)) and seen[line] > 0
        seen[line] += 1
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), again, len(marked)
