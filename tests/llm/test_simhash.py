import random
import re

import numpy as np
import pytest
import xxhash

from arkose.llm import simhash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprint_equals_the_definition():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "A b C", "a b c d", "É É é\x0bB \x1c x y z", "ab " * 1000]
    texts += [" ".join(rng.choices(["ab", "cd", "Ef", "ñ", "x."], k=rng.randint(1, 300))) for _ in range(30)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_links_equal_all_pairs(radius):
    rng = np.random.default_rng(radius)
    sizes = [1, 2, 3, 64, 65, 130, 1]
    group = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 1 << 63, len(sizes)).astype(np.uint64)[group]
    flips = np.zeros(len(group), np.uint64)
    for _ in range(4):
        flips ^= np.where(rng.random(len(group)) < 0.7, np.uint64(1) << rng.integers(0, 64, len(group)).astype(np.uint64), np.uint64(0))
    fps = base ^ flips
    side = np.zeros(len(group), np.int8)
    side[group == 5] = np.arange(130) >= 70
    got = {tuple(sorted(x)) for x in zip(*map(np.ndarray.tolist, simhash.links(fps, group, side, radius)))}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if group[i] == group[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius and (group[i] != 5 or side[i] != side[j])}
    assert got == want


def test_each_near_pair_shares_a_bucket():
    rng = random.Random(5)
    tables = simhash.masks(4, 6)
    for _ in range(500):
        flips = sum({1 << rng.randrange(64) for _ in range(4)})
        assert any(not flips & m for m in tables)


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_components_equal_brute_force(spark, block_rows):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, "  "), (None, ""), (3, "one"), (3, "one"), (None, "alone here")]
    for g in range(8):
        text = rng.choices(words, k=120)
        for _ in range(9):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fp string, component_id int, id int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, block_rows=block_rows).collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps))]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
