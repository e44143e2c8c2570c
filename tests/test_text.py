"""Extraction, pre-tokens and byte-pair encoding: worked cases."""

import random
import tracemalloc

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import tokens as K
from quern.sources import jsonl


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw", ["\u0085a ", "\x1c a \x1f", " x\r", "  ", "", "é ", "　日 ", "a\n\n", "\ta b\x0b", "😀 "]
)
def test_strip_is_pythons(spark, raw):
    assert value(spark, T.strip(F.lit(raw))) == raw.strip()


def test_truthiness_is_tested_before_stripping(spark):
    assert value(spark, T.plain_text(F.lit("  "), F.lit("content"))) == ""
    assert value(spark, T.plain_text(F.lit(""), F.lit(" content "))) == "content"
    assert value(spark, T.plain_text(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ""


def test_formats_differ_in_precedence(spark):
    r = {"problem": F.lit("p"), "solution": F.lit("s"), "generated_solution": F.lit("g"), "lang": F.lit("py")}
    got = {f: value(spark, T.extract(F.lit(f), r)) for f in ("problem_solution", "math_instruct", "magicoder", "other")}
    assert got == {
        "problem_solution": "Problem: p\n\nSolution:\ns",
        "math_instruct": "Problem: p\n\nSolution:\ng",
        "magicoder": "# py\nProblem: p\n\nSolution:\ns",
        "other": "",
    }


def test_conversations_drop_empty_turns(spark):
    turns = F.expr("array(named_struct('value', ' a ', 'content', 'x'), named_struct('value', '', 'content', 'b'), named_struct('value', ' ', 'content', 'c'))")
    assert value(spark, T.conversation(turns)) == "a\n\nb"


@pytest.mark.parametrize(
    ("raw", "pieces"),
    [
        ("x_1 **= 0x1F//=2", ["x_1", " ", "**", "=", " ", "0x1F", "//", "=", "2"]),
        ("0b102", ["0b10", "2"]),
        ("1é", ["1", "é"]),
        ("a\r\nb\t c", ["a", "\r\n", "b", "\t ", "c"]),
        ("1.5e-3->::...", ["1.5e-3", "->", "::", "..."]),
    ],
)
def test_pretokens(spark, raw, pieces):
    assert value(spark, T.pretokens(F.lit(raw))) == pieces


def test_bpe_worked_example():
    vocab, merges, size = K.train_bpe({"aaab": 2, "ab": 1}, 100)
    assert merges == [("a", "a"), ("a", "b"), ("aa", "ab")]
    assert size == 4 + 2 + 3 and vocab["aaab"] == 8


def test_bpe_ties_go_to_the_larger_pair():
    assert K.train_bpe({"ab": 2, "cd": 2}, 9)[1] == [("c", "d")]


def test_bpe_stops():
    assert K.train_bpe({"abc": 1}, 100)[1] == []
    assert len(K.train_bpe({"abcdef": 9}, 5)[0]) == 4 + 6
    with pytest.raises(ValueError):
        K.train_bpe({"a": 1}, 3)


def slow_train(freqs, size):
    """All pairs counted anew for every merge."""
    words, merges = {tuple(w): n for w, n in freqs.items()}, []
    have = 4 + len({c for w in freqs for c in w})
    while have < size:
        counts = {}
        for w, n in words.items():
            for p in zip(w, w[1:]):  # noqa: B905
                counts[p] = counts.get(p, 0) + n
        best = max(counts, key=lambda p: (counts[p], p), default=None)
        if best is None or counts[best] < 2:
            break
        merges.append(best)
        have += 1
        merged = {}
        for w, n in words.items():
            merged[tuple(K.merge_pair(list(w), best))] = merged.get(tuple(K.merge_pair(list(w), best)), 0) + n
        words = merged
    return merges


def test_incremental_training_equals_recounting():
    freqs = {f"{a}{b}{a}{c}{b}": 1 + (i * 7) % 5 for i, (a, b, c) in enumerate((x, y, z) for x in "abc" for y in "bca" for z in "cab")}
    assert K.train_bpe(freqs, 60)[1] == slow_train(freqs, 60)


def test_encoding_is_one_pass_in_merge_order():
    merges = [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c")]
    ranks = {m: [i] for i, m in enumerate(merges)}

    def one_pass(word):
        symbols = list(word)
        for m in merges:
            symbols = K.merge_pair(symbols, m)
        return symbols

    for word in ("abc", "bcab", "aabcc", "cba", ""):
        assert K.encode_word(word, merges, ranks) == one_pass(word)


def test_columns_encode_and_decode(spark):
    docs = spark.createDataFrame([(1, "ab 😀\n"), (2, ""), (3, None)], "doc_id int, text string")
    vocab = K.char_vocab(docs)
    names = [""] * 4 + [r["ch"] for r in vocab.orderBy("id").collect()]
    ids = K.encode_texts(docs, vocab, "text")
    back = {r["doc_id"]: r["t"] for r in ids.select("doc_id", K.decode(F.col("ids"), F.array(*map(F.lit, names))).alias("t")).collect()}
    assert back == {1: "ab 😀\n", 2: "", 3: ""}
    unknown = K.encode_texts(spark.createDataFrame([("aZ",)], "text string"), vocab, "text").first()["ids"]
    assert unknown[1] == K.UNK and unknown[0] >= 4


def test_tokenizer_file(spark, tmp_path):
    vocab, merges, size = K.train_bpe({"abab": 3}, 9)
    jsonl.save_tokenizer(spark, str(tmp_path / "t.json"), vocab, merges, size)
    assert jsonl.load_tokenizer(spark, str(tmp_path / "t.json")) == (vocab, merges, size)
    assert jsonl.load_tokenizer(spark, f"file://{tmp_path}/t.json") == (vocab, merges, size)
    with pytest.raises(FileNotFoundError):
        jsonl.load_tokenizer(spark, str(tmp_path / "none.json"))


@pytest.mark.parametrize("chars", [4_000_000, 40, 1])
def test_words_encoded_once_give_what_texts_encoded_alone_do(spark, monkeypatch, chars):
    monkeypatch.setattr(K, "BLOCK_CHARS", chars)
    texts = ["the cat the", "", None, " \n", "the cat the", "catcat 0x1F -> the\r\n", "the " * 30_000, "w" * 5_000 + " end", "é😀 cat\u2028", "Z"]
    rows = [(i % 9, t, "x" if i % 2 else None) for i, t in enumerate(texts)]  # an id twice
    vocab, merges, _ = K.train_bpe({"the": 9, "cat": 5, "catcat": 2, "ww": 3, " ": 20}, 30)
    docs = spark.createDataFrame(rows, "doc_id int, txt string, word string").repartition(3)
    made = K.encode_words(docs, vocab, merges)
    assert made.columns == ["doc_id", "word", "ids"]
    want = sorted(((d, w or "", K.encode_text(t or "", vocab, merges)) for d, t, w in rows), key=repr)
    assert sorted(((r["doc_id"], r["word"] or "", r["ids"]) for r in made.collect()), key=repr) == want


def test_rare_and_common_words_and_no_words(spark, monkeypatch):
    vocab, merges, _ = K.train_bpe({"the": 9, "cat": 5}, 30)
    docs = spark.createDataFrame([(i, f"the cat{i} the") for i in range(300)], "doc_id int, txt string").repartition(8)
    for common in (2, 10_000):  # nearly all words by the shuffle; all of them broadcast
        monkeypatch.setattr(K, "COMMON", common)
        got = {r["doc_id"]: r["ids"] for r in K.encode_words(docs, vocab, merges).collect()}
        assert got == {i: K.encode_text(f"the cat{i} the", vocab, merges) for i in range(300)}
    assert K.encode_words(docs.limit(0), vocab, merges).collect() == []
    assert [r["ids"] for r in K.encode_words(docs.select("doc_id", F.lit("").alias("txt")).limit(2), vocab, merges).collect()] == [[], []]


LINES = [
    '{"input_ids": [1, 2], "labels": [2, -100], "trust_score": 90, "source": "a"}', "", "  ", '{"input_ids": [1', '{"input_ids": [], "source": "a"}',
    '{"input_ids": [5, 6, 7]}', '{"input_ids": [5], "trust_score": null}', '{"input_ids": [5], "trust_score": "x"}', '{"input_ids": [5], "source": 3}',
]


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(LINES) + "\n")
    rows = jsonl.read(spark, str(tmp_path / "r.jsonl")).collect()
    assert sorted((r["input_ids"], r["trust_score"]) for r in rows) == [([1, 2], 90.0), ([5, 6, 7], 1.0)]
    with pytest.raises(Exception, match="invalid record"):
        jsonl.read_strict(spark, str(tmp_path / "r.jsonl")).collect()
    assert jsonl.enough(spark, str(tmp_path / "r.jsonl"), 9) and not jsonl.enough(spark, str(tmp_path / "none"), 1)


def test_sinks_and_helpers(spark, tmp_path):
    made = jsonl.bootstrap(spark, 5, 16)
    jsonl.write(made, str(tmp_path / "b"))
    back = jsonl.read_strict(spark, str(tmp_path / "b"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, made.collect()))
    row = made.first()
    assert row["labels"] == [*row["input_ids"][1:], -100] and all(10 <= x <= 32_000 for x in row["input_ids"])
    (tmp_path / "l.txt").write_text("a\n\n \nb c\x0bd\n")
    assert [r["text"] for r in jsonl.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b", "c", "d"]
    assert jsonl.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "b")]) == str(tmp_path / "b")


def test_training_with_few_pairs_in_order_equals_recounting(monkeypatch):
    monkeypatch.setattr(K, "FRONT", 3)
    for seed in range(150):
        rnd = random.Random(seed)
        freqs = {"".join(rnd.choice("abc"[: 2 + seed % 2]) for _ in range(rnd.randrange(1, 14))): rnd.choice([1, 1, 2, 5]) for _ in range(30)}
        assert K.train_bpe(freqs, 200)[1] == slow_train(freqs, 200)


def test_training_does_not_keep_pairs_that_occur_once():
    rnd = random.Random(1)
    freqs = {"".join(rnd.choice("0123456789abcdef") for _ in range(32)): 1 for _ in range(1_000)}
    tracemalloc.start()
    K.train_bpe(freqs, 600)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6


@pytest.mark.parametrize(("once", "strip"), [(0, 7), (3, 1 << 18)])
def test_training_by_arrays_equals_recounting(monkeypatch, once, strip):
    monkeypatch.setattr(K, "AT_ONCE", once)
    monkeypatch.setattr(K, "STRIP", strip)
    for seed in range(100):
        rnd = random.Random(seed)
        freqs = {"".join(rnd.choice("abc"[: 2 + seed % 2]) for _ in range(rnd.randrange(1, 14))): rnd.choice([1, 1, 2, 5]) for _ in range(30)}
        assert K.train_bpe(freqs, 200)[1] == slow_train(freqs, 200)


def test_pieces_have_the_pretokens_of_their_texts():
    rnd = random.Random(5)
    parts = [*"abcXe_019. \t\r\n->:*/<=+%!\"#é٠日😀\x00\x1f'(),", "...", "<<=", "0x1F", "1e+5", "1.5e-3", "\r\n", "  \t", "\u2028"]
    for _ in range(500):
        texts = [None, "", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(5))]
        rnd.shuffle(texts)
        pieces, ends = K._pieces(pa.array(texts).slice(1))
        pieces = pieces.to_pylist()
        for i, text in enumerate(texts[1:]):
            found = [w for p in pieces[ends[i] : ends[i + 1]] for w in regex.findall(T.PRETOKEN, p)]
            assert found == regex.findall(T.PRETOKEN, text or "")


def test_words_of_a_block_are_encoded_as_each_alone():
    for seed in range(100):
        rnd = random.Random(seed)
        freqs = {"".join(rnd.choice("abc"[: 2 + seed % 2]) for _ in range(rnd.randrange(1, 14))): rnd.choice([1, 2, 5]) for _ in range(30)}
        vocab, merges, _ = K.train_bpe(freqs, 200)
        words = ["", *("".join(rnd.choice("abcz") for _ in range(rnd.randrange(1, 30))) for _ in range(40))]
        assert K._Encoder(vocab, merges).words(words).to_pylist() == [K.encode_text(w, vocab, merges) for w in words]


def test_encoding_words_shuffles_nothing(spark):
    vocab, merges, _ = K.train_bpe({"the": 9, "cat": 5}, 30)
    docs = spark.range(5).select("id", F.lit("the cat").alias("txt"))
    made = K.encode_words(docs, vocab, merges)
    assert "Exchange" not in made._jdf.queryExecution().toString()
    assert [r["id"] for r in made.collect()] == [*range(5)]
