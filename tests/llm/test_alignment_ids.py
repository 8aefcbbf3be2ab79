"""Token alignment against a plain Python version that encodes every text whole."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from querywarden.llm import alignment_ids
from querywarden.llm.queries import QUERIES
from tokenizers import Tokenizer

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  two  blanks ", "tab\tand\nline\r\n\n end", "Grüße, naïve café", "日本語 テキスト 混ざる text", "a▁b", "<s> </s> <|endoftext|>", "<unk>x",
    "emoji 👩‍👩‍👧 flag", "don't we'll I'd", "x" * 3000, "12345 678,90 3.14", "nbsp here em \u0085 nel", "é combining", "a ́b", "null\x00byte", "word " * 2000,
    "﻿bom ​ zero", "_ under _score_ ", "!? ... --- ==", "ﬁ ligature ½", "  ogham", "A B\tC D",
]


@pytest.fixture(scope="module")
def plain():
    byte, piece = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte.encode_special_tokens = True
    letters = alignment_ids.byte_alphabet()
    names = {i: t for t, i in byte.get_vocab().items()}

    def spell_a(i):
        return bytes(letters[c] for c in names[i])

    def spell_b(i):
        p = piece.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        a, b, whole = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text), (" " + text).encode()
        sa, sb = [spell_a(i) for i in a], [spell_b(i) for i in b]
        if b"".join(sa) != whole or b"".join(sb) != whole:
            return []
        out, i, j = [], 0, 0
        while i < len(a):
            left, right, x, y = [a[i]], [b[j]], len(sa[i]), len(sb[j])
            while x != y:
                if x < y:
                    i += 1
                    left.append(a[i])
                    x += len(sa[i])
                else:
                    j += 1
                    right.append(b[j])
                    y += len(sb[j])
            out.append((left, right))
            i, j = i + 1, j + 1
        return out

    return groups


def brute(plain, rows):
    found = [plain(t) for _, t in rows]
    counts = Counter(p for g in found for p in {(a, b) for left, right in g for a in left for b in right})
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for (key, _), g in zip(rows, found, strict=True):
        links = [(a, b) for left, right in g for a in left for b in right]
        line = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        digest = hashlib.sha256(line.encode()).hexdigest() if g else ""
        sums = sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links)
        out.append((key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), *sums, digest))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_texts_and_rows(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "x", False) for i, t in rows], "doc_id long, text string, block int, a int, pairs string, listing boolean")
    got = result(alignment_ids.token_alignment(df, BYTE, PIECE))
    assert got == brute(plain, rows)
    assert {r[0] for r in got if r[1] == 0} >= {0, 1, 7}
    assert result(alignment_ids.token_alignment(df.limit(0), BYTE, PIECE)) == []


def test_stretches_give_the_ids_of_the_whole(plain):
    rng = random.Random(6)
    chars = ["a", "B", "é", "日", " ", "  ", "\n", "\t", ".", "'s", "1", "_", " ", "👍", "-", "wörter", "the", "́", "‍"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(1, 40))) for _ in range(3000)]
    texts = [t for t in texts if t]
    tokenizers = alignment_ids.Tokenizers(BYTE, PIECE)
    counts, digests, _, _ = alignment_ids.aligned(tokenizers, texts)
    for i, text in enumerate(texts):
        groups = plain(text)
        assert counts["n_groups"][i] == len(groups), text
        line = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        assert digests[i] == (hashlib.sha256(line.encode()).hexdigest() if groups else ""), text


def test_many_blocks_and_a_small_store(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment_ids, "CACHED", 50)
    rows = [(i, f"common words of all {'x' * (i % 7)} and number {i} " * (1 + i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert result(alignment_ids.token_alignment(df, BYTE, PIECE)) == brute(plain, rows)
    one, two = alignment_ids.Tokenizers(BYTE, PIECE), [t for _, t in rows]
    assert alignment_ids.aligned(one, two[:9])[1] + alignment_ids.aligned(one, two[9:])[1] == alignment_ids.aligned(one, two)[1]


def test_pairs_can_be_unpacked():
    import numpy as np

    place, m = alignment_ids._unpacked(alignment_ids._packed(np.array([900_000, 0, 7]), np.array([3, 1, 70_000])))
    assert place.tolist() == [0, 7, 900_000] and m.tolist() == [1, 70_000, 3]
    assert isinstance(pa.array([1]), pa.Array)


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_registered_query(spark, plain, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op11_token_alignment"](spark, path)) == brute(plain, rows)
