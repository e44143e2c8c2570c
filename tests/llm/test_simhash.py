import itertools
import random
import re

import pytest
import xxhash

from quern.llm import queries, simhash
from quern.llm.simhash import near_fingerprints
from quern.storage import Scratch


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """By (doc_id, text): fingerprint in hex and component, all pairs compared."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def found(docs):
    return sorted(map(tuple, near_fingerprints(docs).collect()), key=repr)


def near_texts(n=60, seed=3):
    """Long texts that differ in a word or two, so their fingerprints differ in few bits."""
    rnd = random.Random(seed)
    rows = []
    for g in range(6):
        words = [f"g{g}w{rnd.randrange(300)}" for _ in range(400)]
        for _ in range(n // 6):
            words = words.copy()
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            rows.append(" ".join(words))
    return rows


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_set_of_bits(radius):
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rnd = random.Random(1)
    tried = itertools.combinations(range(64), radius) if radius < 3 else (rnd.sample(range(64), 3) for _ in range(5000))
    for bits in tried:
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_equals_brute_force(spark):
    texts = [*near_texts(), "", None, " \t", "one", "two words", "TWO Words", "two words", "a b c a b c a b c", "x " * 5000]
    rows = list(enumerate(texts * 2))
    random.Random(5).shuffle(rows)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len({p for _, p, _ in got})


def test_links_connect_what_is_near(spark):
    """Fingerprints near each other at random, hot buckets and chains of single bits among them."""
    rnd = random.Random(11)
    nodes = {rnd.getrandbits(64) for _ in range(40)}
    for base in [*nodes][:6]:
        for _ in range(40):
            base ^= 1 << rnd.randrange(64)
            nodes.add(base)
    low = rnd.getrandbits(64)
    nodes |= {low ^ sum(1 << b for b in rnd.sample(range(20), 3)) for _ in range(300)}  # one bucket of a table
    nodes = sorted(nodes)
    signed = [(simhash._signed(x),) for x in nodes]
    links = simhash.links(spark.createDataFrame(signed, "node long"), Scratch(spark, "t")).collect()
    assert all(0 < ((r["u"] ^ r["v"]) & simhash._ALL).bit_count() <= 2 for r in links)

    def groups(pairs):
        root = {x: x for (x,) in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(x for x in root if find(x) == r) for r in map(find, root)}

    near = ((a, b) for (a,), (b,) in itertools.combinations(signed, 2) if ((a ^ b) & simhash._ALL).bit_count() <= 2)
    assert groups((r["u"], r["v"]) for r in links) == groups(near)


def test_odd_rows(spark, odd, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == brute(rows)
    assert near_fingerprints(no_docs).collect() == []
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert {r["component_id"] for r in near_fingerprints(alone).collect()} == {None}


def test_common_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr("quern.llm.skew.FLOOR", 5)
    monkeypatch.setattr("quern.llm.skew.KEYS", 10)
    rows = list(enumerate(near_texts(30) + ["the same text for all of these"] * 40))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.op11_simhash(spark, sf)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, df.collect()), key=repr) == brute(rows)
