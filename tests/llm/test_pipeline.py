import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import secrets, toxicity
from quern.llm.queries import MIX_SEED, tokenizer_path
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_secrets import brute as spans

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for start, _, kind, end in spans(text):
        if start >= at:
            out += text[at:start] + f"[SECRET:{kind}]"
        at = max(at, end)
    return out + text[at:]


def copies(doc_id, rate):
    unit = int(hashlib.md5(f"{MIX_SEED}:{doc_id}".encode()).hexdigest()[:12], 16) / 2**48
    k, log_p, cum = 0, -rate, math.exp(-rate)
    while cum <= unit:
        k += 1
        log_p += math.log(rate) - math.log(k)
        cum += math.exp(log_p)
    return k


def test_run_equals_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.is_held_out(F.col("doc_id"))).collect()
    train = sorted((r["doc_id"], r["toxic"], docs[r["doc_id"]]["text"]) for r in labels if r["doc_id"] in docs)
    scorer = toxicity.Scorer(toxicity.fit([t for _, _, t in train], [y for _, y, _ in train]))
    clean = sorted(d for d, r in docs.items() if scorer.score(r["text"]) < toxicity.THRESHOLD)
    judged = components([(d, docs[d]["text"]) for d in clean], 5, 80)
    kept = [d for d in clean if judged[d][2]]
    assert 0 < len(kept) < len(clean) < len(docs)
    sizes = Counter(docs[d]["source"] for d in kept)
    library = Tokenizer.from_file(tokenizer_path())
    expected = []
    for d in kept:
        text = redacted(docs[d]["text"])
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        row = (d, docs[d]["source"], len(text), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), ids.tobytes())
        expected += [row] * copies(d, len(kept) / len(sizes) / sizes[docs[d]["source"]])
    got = corpus_pipeline.run(spark, SF)
    rows = [tuple(r) for r in got.select("doc_id", "source", "n_chars", "n_tokens", "ids_sha256", "ids").collect()]
    assert sorted(rows) == sorted(expected)


def test_odd_rows_pass_through_every_stage(spark, odd, no_docs):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, no_docs):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            done = stage(spark, docs, SF)
            assert i == len(corpus_pipeline.STAGES) - 1 or done.columns == names
            done.collect()
    once = corpus_pipeline.drop_near_duplicates(spark, odd, SF).collect()
    assert Counter(r["doc_id"] for r in once)[1] == 1 and 5 not in {r["doc_id"] for r in once} and None in {r["doc_id"] for r in once}
    assert secrets.RULES[0].kind in next(r["text"] for r in corpus_pipeline.redact_secrets(spark, odd, SF).collect() if r["doc_id"] == 7)


def test_the_last_stage_keeps_the_mixed_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    before = [r["doc_id"] for r in mixed.collect()]
    after = [r["doc_id"] for r in corpus_pipeline.encode(spark, mixed, SF).collect()]
    assert after == before and after != sorted(after)
    together = sum(a == b for a, b in zip(after, after[1:]))  # noqa: B905
    assert len(set(after)) < len(after) and together < 0.05 * len(after)
