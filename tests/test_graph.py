from __future__ import annotations

import random

import pytest

from memloom.operators.graph import traverse


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walks_agree_with_a_plain_one(spark, seed):
    r = random.Random(seed)
    rows = [(f"r{r.randrange(25)}", f"w{r.randrange(30)}") for _ in range(60)]
    wings: dict[str, set[str]] = {}
    for room, wing in rows:
        wings.setdefault(room, set()).add(wing)
    start = max(wings, key=lambda x: (len(wings[x]), x))
    want, frontier = {start: (0, None)}, [start]
    for hop in range(1, 5):
        found = []
        for at in frontier:
            for room in sorted(wings):
                if room not in want and (shared := wings[at] & wings[room]):
                    want[room] = (hop, ",".join(sorted(shared)))
                    found.append(room)
        frontier = found
    got = {x["room"]: (x["hop"], x["via"]) for x in traverse(spark.createDataFrame(rows, "room string, wing string"), start, 4).collect()}
    assert got == want and max(h for h, _ in want.values()) >= 2
