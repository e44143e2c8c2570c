import hashlib

import numpy as np

from quern.llm import order_minhash as o


def test_occurrences_both_ways(monkeypatch):
    h = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64) << np.uint64(30)
    seen, direct = {}, []
    for x in h.tolist():
        direct.append(seen.get(x, 0))
        seen[x] = seen.get(x, 0) + 1
    assert o.occurrences(h).tolist() == direct
    monkeypatch.setattr(o, "_POSITION", 4)
    assert o.occurrences(h).tolist() == direct


def test_blocks_change_nothing(monkeypatch):
    text = " ".join(str(i * 7919 % 1009) for i in range(3000))
    whole = o.fingerprint(text)
    monkeypatch.setattr(o, "_BLOCK", 77)
    assert (o.fingerprint(text) == whole).all()


def test_order_matters_and_edits_are_felt():
    a, b = "alpha beta gamma delta epsilon zeta eta theta " * 4, "one two three four five six seven eight nine " * 4
    ab, ba = o.fingerprint(a + b), o.fingerprint(b + a)
    assert o.likeness(ab, o.fingerprint(a + b)) == 1
    assert o.likeness(ab, ba) < 1
    small = o.fingerprint((a + b).replace("zeta", "zota", 1))
    assert o.likeness(ab, small) > o.likeness(ab, o.fingerprint(a + a))


def test_documents_follow_each_other(spark, odd, no_docs):
    rows = odd.select("doc_id", "text").collect()
    order = sorted(
        ((r["doc_id"], r["text"] or "") for r in rows),
        key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()),
    )
    expected = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        edited = o.half_replaced(text, following)
        a, b, c = o.fingerprint(text), o.fingerprint(edited), o.fingerprint(following)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((doc, len(text), digest, o.written(a).hex(), o.written(b).hex(), o.likeness(a, b), o.likeness(a, c)))
    for width in (1, 3, 7):
        got = [tuple(r) for r in o.fingerprint_documents(odd, width).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert o.fingerprint_documents(no_docs).count() == 0


def told(text):
    """Order MinHash one k-mer at a time, with whole numbers instead of arrays."""
    top = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & top
        return x ^ (x >> 31)

    def value(gram):
        h = len(gram)
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & top
        return mix(h)

    if not text:
        return [0] * o.SKETCHES
    k = min(o.K, len(text))
    grams, seen, marked = [text[i : i + k] for i in range(len(text) - k + 1)], {}, []
    for at, gram in enumerate(grams):
        n = seen.get(gram, 0)
        seen[gram] = n + 1
        marked.append((mix((value(gram) + n * 0x9E3779B97F4A7C15) & top), at))
    out = []
    for j, (a, b) in enumerate(zip(o._A.tolist(), o._B.tolist(), strict=True)):
        chosen = sorted(((a * x + b) & top, at) for x, at in marked)[: o.TUPLE]
        h = j
        for at in sorted(at for _, at in chosen):
            h = mix((h * 0x9E3779B97F4A7C15 + value(grams[at])) & top)
        out.append(h >> 48)
    return out


def test_fingerprints_equal_brute_force():
    rnd = np.random.default_rng(6)
    texts = ["", "a", "abc", "abcdef", "aaaaaaaaaaaaaaaa", "é😀" * 9, " ".join(map(str, rnd.integers(0, 40, 120).tolist())), "the same words " * 20]
    for text in texts:
        assert o.fingerprint(text).tolist() == told(text)


def test_rows_without_ids_are_dealt_out(spark):
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('text number ', id) as text")
    rows = o.fingerprint_documents(docs, 8).collect()
    assert len(rows) == 400 and all(r["n_chars"] > 0 for r in rows)
    big = spark.createDataFrame([((1 << 60) + 1, "x"), (None, "y"), ((1 << 60) + 2, "z")], "doc_id long, text string")
    assert {r["doc_id"] for r in o.fingerprint_documents(big, 1).collect()} == {(1 << 60) + 1, (1 << 60) + 2, None}
