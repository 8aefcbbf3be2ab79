"""HyperMinHash near-duplicates against all pairs of plain Python sets."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from querywarden.llm import hyperminhash as hm
from querywarden.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def brute(rows):
    """rows: (id, text). (id, n, component, kept) of each, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        low.setdefault(find(i), []).append(key)
    names = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((key, len(sets[i]), names[find(i)], key == names[find(i)]) for i, (key, _) in enumerate(rows)), key=repr)


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def family(rng, size, change, words=160):
    """Copies of one text, each with `change` of its words drawn anew."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    return [" ".join(w if rng.random() > change else f"n{rng.randrange(10**6)}" for w in base) for _ in range(size)]


def test_families_and_chains(spark):
    rng = random.Random(8)
    texts = [t for change in (0.0, 0.02, 0.05, 0.08, 0.11) for t in family(rng, 14, change)]
    chain = [f"c{rng.randrange(10**6)}" for _ in range(100)]
    for step in range(25):  # neighbours link, the ends do not
        texts.append(" ".join(chain))
        chain[step * 3 : step * 3 + 3] = [f"c{rng.randrange(10**6)}" for _ in range(3)]
    texts += [" ".join(rng.choices("abcdefg", k=n)) for n in range(1, 14) for _ in range(6)]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    assert result(hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_blocks_find_what_the_star_misses(spark, monkeypatch):
    """With tiny blocks, groups of several components in one band value go through many units."""
    monkeypatch.setattr(hm, "BLOCK", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a common part that makes pairs similar at 0.55 to 0.85
        own = [f"g{i % 9}x{k}" for k in range(28)]
        tail = [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(16))]
        rows.append((i, " ".join(base + own + tail)))
    assert result(hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"long{i % 5000}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (9, "one"), (10, "one one"), (3, "One one"), (3, "One one"), (None, "one ONE"), (None, "alone here"), (11, long), (12, long + " end"), (13, "é É"), (14, "É é")]
    df = spark.createDataFrame([(i, t, 1, 2, "x", b"") for i, t in rows], "doc_id long, text string, n int, key int, label string, digest binary")
    assert result(hm.near_duplicates(df)) == brute(rows)
    assert result(hm.near_duplicates(df.limit(0))) == []


def test_registers_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(5)
    for n in (6, 40, 700, 9000):
        common, rates = int(n * 0.8), []
        for _ in range(60):
            values = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            sides = [np.sort(values[: common + (n - common) // 2]), np.sort(np.concatenate([values[:common], values[common + (n - common) // 2 :]]))]
            rows = hm.registers(np.array([len(s) for s in sides]), np.concatenate(sides))
            assert (rows > 0).all()
            size = np.array([float(len(s)) for s in sides])
            rates.append(hm.estimate((rows[0] == rows[1]).sum(), size[:1], size[1:])[0])
        assert abs(np.mean(rates) - common / n) < 0.03
    other = rng.integers(0, 2**63, (2, 200_000), dtype=np.uint64)
    rows = hm.registers(np.array([200_000, 200_000]), np.concatenate([np.sort(x) for x in other]))
    assert (rows[0] == rows[1]).mean() < 0.02


def test_counts_of_common_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90))).astype("<u8") for _ in range(30)]
    got = hm.common_counts(sets[:11], sets[11:], width=64)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[11:]] for a in sets[:11]]).all()


def test_sets_of_a_batch():
    texts = ["A b a B a", None, "x", "", "one two"]
    out = [(low, sizes.tolist()) for low, sizes, _ in hm.shingle_sets(pa.array(texts))]
    assert out == [(0, [len(shingles(t)) for t in texts])]


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_registered_query(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op13_hyperminhash"](spark, path)) == brute(rows)
