import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import collocations as C
from quern.llm.collocations import collocations


def brute(rows, least=10, longest=3, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in chosen.items():
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in chosen.items())
            if not inside:
                score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(docs, **how):
    return sorted(map(tuple, collocations(docs, **how).collect()))


def some_texts(n=200, seed=4):
    rnd = random.Random(seed)
    words = ["of", "the", "New", "york", "city", "é", "ﬁn", "a b", "x\x01", "x", "a-b", "a"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", ";"]) for _ in range(rnd.randrange(60)))
        rows.append((text + " new york city " * rnd.randrange(3), rnd.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equals_brute_force(spark, longest):
    rows = some_texts()
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = found(docs, longest=longest)
    assert got == brute(rows, longest=longest) and len(got) > 20


def test_small_blocks_and_sorts(spark, monkeypatch):
    rows = some_texts(seed=8)
    want = brute(rows, top=15)
    monkeypatch.setattr(C, "BLOCK_CODES", 50)
    monkeypatch.setattr(C, "OPEN_BLOCKS", 1)
    monkeypatch.setattr(C, "SORTED_AT_ONCE", 40)
    monkeypatch.setattr(C, "RANGE", 100)
    monkeypatch.setattr("quern.llm.skew.FLOOR", 5)
    monkeypatch.setattr("quern.llm.skew.KEYS", 10)
    assert found(spark.createDataFrame(rows, "text string, lang string"), top=15) == want


def test_counts_at_the_limit(spark):
    rows = [("p q r", "en")] * 9 + [("s t", "en")] * 10 + [("u u u", "en")] * 5 + [("v w x y", "en")] * 12 + [("v w", "en")] * 13
    got = found(spark.createDataFrame(rows, "text string, lang string"))
    assert got == brute(rows)
    assert "v w" in [r[2] for r in got] and "w x" not in [r[2] for r in got]


def test_odd_rows(spark, odd, no_docs):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    many = odd
    for _ in range(3):
        many = many.union(many)
    assert found(many) == brute(rows * 8)
    assert found(no_docs) == []
    assert found(spark.createDataFrame([("rare words only", "en")], "text string, lang string")) == []


def test_long_piece(spark):
    rows = [("a b c " * 200_000, "en"), ("d", "en")]
    got = found(spark.createDataFrame(rows, "text string, lang string"))
    assert got == brute(rows)


def test_exact_products(spark):
    """Scores of counts whose products pass 64 bits."""
    width, big = 12, 10**14
    key = lambda *ids: b"".join(i.to_bytes(4, "big") for i in ids).ljust(width, b"\0")
    counts = spark.createDataFrame([(key(1), big + 7), (key(2), 3 * big), (key(1, 2), big + 1)], "key binary, n long")
    row = C.scored(spark.createDataFrame([(key(1, 2), 2, big + 1)], "key binary, size int, n long"), counts, 3).first()
    assert (row["l"], row["r"], row["score"]) == (big + 7, 3 * big, 10**6 * (big + 1) ** 2 // ((big + 7) * 3 * big))


def test_radix_sort():
    rows = np.random.default_rng(1).integers(0, 1 << 20, (5000, 3)).astype(np.uint32)
    rows = np.concatenate([rows, rows[:500], np.array([[0xFFFFFFFF, 0, 1]] * 7, np.uint32)])
    got, n = C.counted_runs(rows)
    want, m = np.unique(rows, axis=0, return_counts=True)
    assert (got == want).all() and (n == m).all()
