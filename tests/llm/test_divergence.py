"""The source audit against plain Python, on odd rows and on counts that need runs of several rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from querywarden.llm import divergence
from querywarden.llm.queries import ORACLE, QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """rows: (text, lang, source). The contract word for word, in Python's integers."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall(text.translate(UPPER))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        terms = [t for t, n in held[lang].items() if n >= 10]
        v, total = len(terms), sum(counts[lang, s][t] for s in sources for t in terms)
        own = {s: sum(counts[lang, s][t] for t in terms) for s in sources}

        def p(n, size, v=v):
            return 1 + 10**9 * (n + 2) // (size + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p(counts[lang, s][t], own[s]), p(counts[lang, o][t], own[o])) for t in terms), o) for o in sources if o != s]
            marks = []
            for t in terms:
                a, q = p(counts[lang, s][t], own[s]), p(sum(counts[lang, o][t] for o in sources), total)
                if counts[lang, s][t] and a > q:
                    marks.append((f(a, q), t))
            for part, items, limit in (("pair", pairs, None), ("term", marks, 10)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items[:limit], 1)}
    return out


def audit(spark, rows, schema="text string, lang string, source string"):
    df = divergence.source_audit(spark.createDataFrame(rows, schema))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_corpora(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta", "Übung", "übung", "ß", "x-y", "don't", "日本", "a1b", " ", "tail"]
    rows = []
    for _ in range(160):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "", None, "Ä"])
        rows.append((" ".join(rng.choices(words, k=rng.randrange(12))), lang, source))
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("", "xx", "two"), ("few words", "yy", None)] + [("same text again", "en", "s1")] * 12
    assert audit(spark, rows) == brute(rows)


def test_counts_beyond_64_bits_and_long_texts(spark):
    rows = [("word " * 300_000 + "other", "en", "long")] + [("word other", "en", "short")] * 12 + [("x" * 5_000_000, "en", "short")]
    assert audit(spark, rows) == brute(rows)
    big = spark.sql("SELECT 60000000000L AS n, 70000000000L AS total, 5L AS size")
    assert big.select(divergence.probability(big.n, big.total, big.size)).first()[0] == 1 + 10**9 * (60_000_000_002) // 70_000_000_010


def test_runs_equal_the_plain_sum():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(1, 4, (60, 5)), axis=0)
    lengths = rng.integers(1, 9, len(rows))
    got = divergence._stretch(rows, lengths)
    for s in range(5):
        for t in range(s + 1, 5):
            p, q = rows[:, s], rows[:, t]
            assert got[s, t] == sum(int(n) * int((a - b) ** 2 // (a + b)) for a, b, n in zip(p, q, lengths, strict=True))


def test_counts_are_handed_on_early(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    batches = [pa.RecordBatch.from_pylist([{"lang": "a", "source": "s", "text": f"w{'x' * i} both W"}]) for i in range(6)]
    total = Counter()
    for batch in divergence._counts(iter(batches)):
        for r in batch.to_pylist():
            if r["term"]:
                total[r["term"]] += r["n"]
    assert total["w"] == 7 and total["both"] == 6 and total["wxxxxx"] == 1


def test_empty_tables_and_clashing_columns(spark):
    schema = "text string, lang string, source string, value int, part string, row int, a int, counts int"
    assert audit(spark, [], schema) == set()
    rows = [("one two", "en", s, 1, "x", 2, 3, 4) for s in ("a", "b") for _ in range(6)]
    assert audit(spark, rows, schema) == brute([r[:3] for r in rows])


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_registered_query(spark, folder):
    import check_oracle

    path = f"/root/testdata/{folder}"
    assert check_oracle.compare(spark, check_oracle.connect(path), path, "op12", QUERIES["op12_source_audit"], ORACLE["op12_source_audit"]) is None
