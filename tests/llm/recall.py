"""Recall of problem 3's query against brute force: python -m tests.llm.recall [table folder] [divisor].

Every posting whose id is divisible by `divisor` (100) is compared with all postings on their whole texts; what
p3_found gives for these ids is counted by similarity.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

from marlinspike.llm import queries
from marlinspike.session import local_session, table


def runs(title: str | None, body: str, width: int) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\W_]+", (f"{title}\n{body}" if title is not None else body).lower())
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def brute_force(spark, folder: str, divisor: int = 100) -> dict[tuple[int, int], float]:
    """(id_a, id_b) -> similarity of all pairs at or above the threshold with an id divisible by `divisor`."""
    how = queries.POSTINGS_ALIKE
    rows = table(spark, folder, "normalized_opportunities").select("id", "title", "description").distinct().where("description is not null").collect()
    sets = {r.id: runs(r.title, r.description, how["width"]) for r in rows if len(re.findall(r"[^\W_]+", r.description)) >= 30}
    holders: dict[tuple[str, ...], list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    out = {}
    for i in (i for i in sets if i % divisor == 0):
        for j, both in Counter(j for x in sets[i] for j in holders[x] if j != i).items():
            alike = both / (len(sets[i]) + len(sets[j]) - both)
            if alike >= how["threshold"]:
                out[min(i, j), max(i, j)] = alike
    return out


def recall(spark, folder: str, divisor: int = 100) -> tuple[dict[str, tuple[int, int]], int]:
    """By similarity (all, found), and how many found pairs are false."""
    want = brute_force(spark, folder, divisor)
    got = {tuple(r) for r in queries.p3_found(spark, folder).where(f"id_a % {divisor} = 0 or id_b % {divisor} = 0").collect()}
    out = {}
    for low, high in ((0.5, 0.55), (0.55, 0.6), (0.6, 0.7), (0.7, 1.0), (1.0, 1.1)):
        pairs = [p for p, s in want.items() if low <= s < high]
        out[f"{low} to {high}" if high <= 1 else "1.0"] = (len(pairs), len(got & set(pairs)))
    return out, len(got - want.keys())


if __name__ == "__main__":
    found, wrong = recall(local_session(8), sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", int(sys.argv[2]) if len(sys.argv) > 2 else 100)
    for name, (n, hit) in found.items():
        print(f"similarity {name}: {hit} of {n}")
    print(f"false: {wrong}")
