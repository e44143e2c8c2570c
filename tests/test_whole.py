"""Registered queries give every part of their input: no text or component is left out."""

import hashlib
import os

import duckdb
import pytest

from quern.operators import tokens as K
from quern.plans import text_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_repack_lays_every_window_into_the_stream(spark, tables):
    sql = f"""WITH {Q._WIN} SELECT input_ids, trust_score FROM w ORDER BY doc_id, win"""
    stream, trusts = [], []
    for ids, trust in tables.execute(sql).fetchall():
        stream += ids
        trusts += [trust] * len(ids)
    width, want = Q.LENGTH + 1, {}
    text = lambda ids: hashlib.md5(" ".join(map(str, ids)).encode()).hexdigest()
    for n in range(len(stream) // width):
        t = stream[n * width : (n + 1) * width]
        want[n] = (text(t[:-1]), text([-100 if x == 0 else x for x in t[1:]]), trusts[n * width])
    got = {r["batch_id"] * Q.BATCH + r["slot"]: (r["ids"], r["labels"], r["trust"]) for r in Q.repack(spark, SF).collect()}
    assert got == want and len(want) > 1_000


@pytest.fixture
def short_and_long(spark, tmp_path):
    texts = ["", " ab ", "x" * 49, "yz" * 40_000 + "end"]
    rows = [(i, t, "source1") for i, t in enumerate([*texts, None])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), dict(enumerate([*(t.strip() for t in texts), ""]))


def test_encode_char_takes_every_text_whole(spark, short_and_long):
    path, texts = short_and_long
    ids = {c: 4 + i for i, c in enumerate(sorted(set("".join(texts.values()))))}
    want = {d: (len(t) + 2, hashlib.md5(" ".join(map(str, [2, *(ids[c] for c in t), 3])).encode()).hexdigest()) for d, t in texts.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["digest"]) for r in Q.encode_char(spark, path).collect()} == want


def test_decode_roundtrip_gives_every_text_whole(spark, short_and_long):
    path, texts = short_and_long
    assert {r["doc_id"]: r["digest"] for r in Q.decode_roundtrip(spark, path).collect()} == {d: hashlib.md5(t.encode()).hexdigest() for d, t in texts.items()}


def test_bpe_is_trained_as_far_as_the_word_table_allows(spark):
    rows = Q.bpe_merges(spark, SF).orderBy("rank").collect()
    assert len(rows) > 60 and [r["rank"] for r in rows] == [*range(len(rows))]
    freqs = {r["word"]: r["freq"] for r in K.word_freq(Q._sample(spark, SF, 500_000)).collect()}
    merged = {K.FIRST_ID + len({c for w in freqs for c in w}) + r["rank"] for r in rows}
    assert {r["id"] for r in rows} <= merged and max(merged) < 32_768
    if max(merged) < 32_767:  # no pair is left that occurs twice
        ranks, left, pairs = {}, {}, [(r["a"], r["b"]) for r in rows]
        for r in rows:
            ranks.setdefault((r["a"], r["b"]), []).append(r["rank"])
        for w, n in freqs.items():
            symbols = K.encode_word(w, pairs, ranks) if len(w) > 1 else [w]
            for pair in zip(symbols, symbols[1:]):  # noqa: B905
                left[pair] = left.get(pair, 0) + n
        assert max(left.values(), default=0) < 2


def test_encode_bpe_takes_every_text_whole(spark, short_and_long):
    path, texts = short_and_long
    vocab, merges, _ = Q._trained(spark, path)
    ids = {d: K.encode_text(t, vocab, merges) for d, t in texts.items()}
    want = {d: (len(x), hashlib.md5(" ".join(map(str, x)).encode()).hexdigest()) for d, x in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["digest"]) for r in Q.encode_bpe(spark, path).collect()} == want
