import random
import re
import time

from quern.llm import secrets as s
from quern.llm.trigrams import trigram_query


def brute(text):
    out = []
    for order, rule in enumerate(s.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, rule.kind, m.end()))
    return sorted(out)


def test_queries_of_patterns():
    assert trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert trigram_query("(abc|xyz)+q") == [frozenset({"abc"}), frozenset({"xyz"})]
    assert trigram_query("ab?cde") == [frozenset({"abc", "bcd", "cde"}), frozenset({"acd", "cde"})]
    assert trigram_query("[0-9]+") is None and trigram_query("(abc)?") is None and trigram_query("ab|cde") is None


def test_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    bits = ["token", "=", ": ", '"', "secret", "API_KEY", "apikey", "abcdef", "short", "AKIA", "ABCDEFGH12345678", "é😀", "\n", " ",
            "0123456789abcdef" * 2, "ghp_" + "a" * 36, "xoxb-1234567890ab", "eyJabcdefghi.eyJabcdefghi.sig", "-----BEGIN RSA PRIVATE KEY-----", "passwd"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = s.scan(df).collect()
    assert len(rows) == len(texts)
    assert all([tuple(x) for x in r["spans"]] == brute(r["text"]) for r in rows)
    assert sum(len(r["spans"]) for r in rows) > 200


def test_index_loses_no_candidate(spark, odd):
    named = odd.select("doc_id", s.row_key().alias("_k"))
    found = {r["doc_id"]: set(r["kinds"]) for r in named.join(s.candidates(odd), s.F.col("_k") == s.F.col("key")).collect()}
    assert {"assign", "access"} <= found[7] and 1 not in found


def test_many_candidates_come_back_through_the_bit_filter(spark, odd, monkeypatch):
    more = odd.unionByName(odd.select(*(s.F.lit(None).cast(t).alias(c) if c == "doc_id" else s.F.col(c) for c, t in odd.dtypes)))
    want = sorted(map(repr, s.scan(more).collect()))
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, s.scan(more).collect())) == want and len(want) == 2 * odd.count()


def test_twenty_thousand_secrets_in_a_text(spark):
    text = " ".join(f"token=abcdef{i:06d}" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    s.scan(df).collect()  # compiled
    began = time.perf_counter()
    row = s.scan(df).withColumn("clean", s.redact(s.F.col("text"), s.F.col("spans"))).first()
    assert [tuple(x) for x in row["spans"]] == brute(text) and len(row["spans"]) == 20_000
    assert row["clean"] == " ".join(["[SECRET:assign]"] * 20_000)
    assert time.perf_counter() - began < 20  # two seconds on an idle core; quadratic work takes minutes


def test_redaction_equals_brute_force(spark):
    rnd = random.Random(9)
    bits = ["token=", "AKIA" + "Q" * 20, "a1" * 15, " plain é😀 text ", "\n", "secret: ", "0123456789abcdef" * 3, "x" * 700]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(120)]

    def cleaned(text):
        out, at = "", 0
        for start, _, kind, end in brute(text):
            if start >= at:
                out += text[at:start] + f"[SECRET:{kind}]"
            at = max(at, end)
        return out + text[at:]

    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["clean"] for r in s.scan(df).withColumn("clean", s.redact(s.F.col("text"), s.F.col("spans"))).collect()}
    assert got == {i: cleaned(t) for i, t in enumerate(texts)}


def test_odd_rows_and_redaction(odd, no_docs):
    rows = s.scan(odd).withColumn("clean", s.redact(s.F.col("text"), s.F.col("spans"))).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["clean"] == "[SECRET:assign] [SECRET:access] [SECRET:hex]".replace("[SECRET:assign]", "[SECRET:assign]" + '"')
    assert by_id[2]["clean"] is None and by_id[6]["clean"] == by_id[6]["text"]
    assert s.scan(no_docs).count() == 0
