import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe, skew
from quern.llm.queries import tokenizer_path

PARTS = ["a", "'s", "'", " ", "  ", "\n", "1", "é", "\x1c", "\x85", "\u2003", "<|endoftext|>", "!", " the", "日本", "😀", "'ve", "'ll", "x" * 40, " " * 70]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def expected(library, text):
    ids = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")
    back = library.decode(ids.tolist(), skip_special_tokens=False)
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_joints_are_exact(library):
    tok, rnd = bpe.Tokenizer.of(tokenizer_path()), random.Random(2)
    for _ in range(400):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(1, 50))).replace("<|endoftext|>", "<|end")
        cut = sorted({0, len(text), *(rnd.randrange(len(text)) for _ in range(rnd.randrange(5)))})
        parts = [text[a:b] for a, b in zip(cut, cut[1:])]  # noqa: B905
        got = bpe.join_chunks(tok, [(p, tok.pieces(p)) for p in parts])
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_depend_on_content():
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ijkl") for _ in range(9000))
    a, b = bpe.chunks("head " * 100 + passage), bpe.chunks("another beginning " * 90 + passage)
    assert "".join(a) == "head " * 100 + passage
    assert len(set(a) & set(b)) > 5


def test_documents_equal_the_library(spark, library):
    rnd = random.Random(6)
    passage = "".join(rnd.choice(PARTS[:11] + ["word", " more"]) for _ in range(1500))
    texts = [None, "", "x", passage, passage, "start " + passage, passage[50:] + " end", passage * 3, "<|endoftext|>" + passage]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_tokens int")
    rows = bpe.encode_documents(df, tokenizer_path()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]])
        assert len(r["ids"]) == 4 * r["n_tokens"] and r["text"] == texts[r["doc_id"]] and r["key"] == "x"


def test_odd_rows(odd, no_docs, library):
    rows = bpe.encode_documents(odd, tokenizer_path(), keep_ids=False, keep_text=False).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count() and all(r["n_tokens"] == expected(library, texts[r["doc_id"]])[0] for r in rows)
    assert bpe.encode_documents(no_docs, tokenizer_path()).count() == 0


def test_common_passages_and_thousands_of_copies(spark, library, monkeypatch):
    """One passage in most texts, one text in most rows, and a filter that is far too small."""
    monkeypatch.setattr(skew, "FLOOR", 20)
    rnd = random.Random(11)
    passage = "".join(rnd.choice(PARTS[:11] + ["word", " more"]) for _ in range(900))
    texts = [f"{i} begins " * 12 + passage + f" ends {i}" for i in range(120)] + [passage + " copy"] * 2_000 + [None, ""] * 60
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = {t: expected(library, t) for t in set(texts)}
    for least in (bpe.FILTER_LEAST, 5):
        monkeypatch.setattr(bpe, "FILTER_LEAST", least)
        monkeypatch.setattr(bpe, "FILTER_MOST", max(least, 16))
        if least == 5:
            monkeypatch.setattr(bpe, "FILTER_MOST", 5)
        rows = bpe.encode_documents(df, tokenizer_path(), keep_text=False).collect()
        assert len(rows) == len(texts)
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[texts[r["doc_id"]]] for r in rows)


def test_the_filter_grows_with_what_it_holds():
    assert bpe.filter_power(0) == bpe.FILTER_LEAST and bpe.filter_power(10**12) == bpe.FILTER_MOST
    assert 2 ** bpe.filter_power(100_000) >= bpe.FILTER_EACH * 100_000


LONG = {
    "spaces": " " * 2_000_000, "tabs": "\t" * 2_000_000, "lines": "\n" * 2_000_000, "wide": "\u2003" * 400_000,
    "mixed": " \n\t" * 700_000, "letters": "a" * 300_000,
}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_long_runs_inside_and_at_both_ends(library, kind):
    tok, run = bpe.Tokenizer.of(tokenizer_path()), LONG[kind]
    for text in (run, run + "x", "x" + run, "some words" + run + "and 12 more <|endoftext|>" + run[:100_000] + "!"):
        assert tok.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_runs_in_shared_chunks(spark, library):
    texts = ["left " + LONG["spaces"] + "x", "other " * 30 + LONG["spaces"] + " y", "z" + LONG["lines"], "w" + LONG["lines"], LONG["mixed"] + "end", LONG["mixed"]]
    rows = bpe.encode_documents(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), tokenizer_path(), keep_text=False).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]])


def test_order_is_kept_on_request(spark, tmp_path):
    rnd = random.Random(3)
    texts = [f"text {i} " * 40 for i in range(20)]
    rows = [(i, texts[rnd.randrange(20)], i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, _place0 long").repartition(7).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    before = [r["doc_id"] for r in docs.collect()]
    done = bpe.encode_documents(docs, tokenizer_path(), in_order=True)
    assert before != sorted(before) and [r["doc_id"] for r in done.collect()] == before and "_place0" in done.columns
