import hashlib
import math
import time
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import mixing
from quern.llm.mixing import mix, poisson_cdf


def test_cdf_is_poissons(spark):
    for rate in (0.01, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        k = int(rate)
        direct = sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1))
        assert abs(cdf[k] - direct) < 1e-9 and abs(cdf[-1] - 1) < 1e-9


def test_rates_are_met(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6 == 0, "rare").otherwise("hot").alias("source"))
    got = {r["source"]: r["count"] for r in mix(docs, {"rare": 1.0, "hot": 1.0}).groupBy("source").count().collect()}
    assert all(abs(got[s] - 3000) < 5 * math.sqrt(3000 * (3 if s == "rare" else 1)) for s in got)
    assert {r["source"] for r in mix(docs, {"hot": 1.0}).select("source").distinct().collect()} == {"hot"}


def test_odd_rows(odd, no_docs):
    rows = mix(odd).collect()
    assert rows and {"replica", "rate", "shuffle_key", "score", "spans"} <= set(rows[0].asDict())
    again = mix(odd.repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mix(no_docs).count() == 0


def test_shuffled_rates_agree(odd, monkeypatch):
    before = sorted(map(repr, mix(odd).collect()))
    monkeypatch.setattr("quern.llm.mixing.BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mix(odd).collect())) == before


def test_order_is_the_key(odd):
    keys = [r["shuffle_key"] for r in mix(odd, partitions=1).collect()]
    assert keys == sorted(keys)


def drawn(seed, name, rate):
    """Copies of a name, part by part, with plain floating point."""
    parts = max(1, math.ceil(rate / mixing.PART_RATE))
    total = 0
    for i in range(parts):
        told = f"{seed}:{name}" + (f":part:{i}" if i else "")
        unit = int(hashlib.md5(told.encode()).hexdigest()[:12], 16) / 2**48
        k, log_p, cum, r = 0, -rate / parts, math.exp(-rate / parts), rate / parts
        while cum <= unit:
            k += 1
            log_p += math.log(r) - math.log(k)
            cum += math.exp(log_p)
        total += k
    return total


def test_rows_without_or_with_repeated_ids_draw_one_by_one(spark):
    docs = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("text"), F.lit("a").alias("source"))
    rows = mix(docs).collect()
    assert abs(len(rows) - 600) < 5 * math.sqrt(600) and len({r["shuffle_key"] for r in rows}) == len(rows)
    assert sorted(map(repr, mix(docs.repartition(7)).collect())) == sorted(map(repr, rows))
    same = spark.range(600).select((F.col("id") % 2).alias("doc_id"), F.lit("x").alias("text"), F.lit("a").alias("source"))
    rows = mix(same).collect()
    assert abs(len(rows) - 600) < 5 * math.sqrt(600) and len({r["shuffle_key"] for r in rows}) == len(rows)
    assert max(Counter((r["doc_id"], r["replica"]) for r in rows).values()) > 1


def test_rare_sources(spark):
    """A rate of thousands, in parts and blocks, equals the draws one by one."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "rare").when(F.col("id") < 100, "few").otherwise("hot").alias("source"))
    rates = {"rare": 20_000 / 3 / 3, "few": 20_000 / 3 / 97, "hot": 20_000 / 3 / 19_900}
    got = {r["doc_id"]: (r["n"], r["last"]) for r in mix(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("replica").alias("last")).collect()}
    for doc in [*range(110), *range(19_990, 20_000)]:
        want = drawn(7, doc, rates["rare" if doc < 3 else "few" if doc < 100 else "hot"])
        assert got.get(doc, (0, -1)) == (want, want - 1)


def test_a_rate_of_a_million_is_soon_drawn(spark):
    rows = spark.createDataFrame([("x",)], "source string").select("source", F.lit(1e6).alias("rate"), F.lit(15_625).alias("_parts"), F.lit("9").alias("name"))
    rows = rows.withColumn("_cdf", poisson_cdf(F.col("rate") / F.col("_parts")))
    began = time.perf_counter()
    n = rows.select(mixing.drawn_copies(7, F.col("name")).alias("n")).first()["n"]
    assert abs(n - 1e6) < 6e3 and time.perf_counter() - began < 10
