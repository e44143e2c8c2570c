"""Secret scans: a trigram inverted index narrows down which rules a text is tried with.

Every rule's regular expression yields a Boolean trigram query. Posting lists are
built and stored for the trigrams that the rules mention; each clause looks its lists
up and intersects them, and only candidates are verified with the expression itself.
Rules without mandatory trigrams scan every text. Everything is a built-in expression.

Candidates are named by a hash of doc_id and text, and brought back to their texts:
broadcast where they are few, else through a bit filter of bounded size that lets all
other texts stay where they are, so that only texts it may mean are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.trigrams import trigram_query
from quern.storage import Scratch

#: Candidates of at most this many texts are broadcast.
BROADCAST_ROWS = 200_000
#: Bits of the filter over more of them, at most (8 MiB), as a power of two.
FILTER_POWER = 26
#: Code points of the blocks that a text is cut into where spans are replaced.
BLOCK = 1024
SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, kept where ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The rules that the result counts by kind.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter matches need not be formed
)
#: Further well-known credential formats.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = (*BASE, *EXTRA)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def scanned(xs: Column, step, out: str) -> Column:
    """The outputs (of type ``out``) of ``step(state, x) -> (state, output)`` over an array; the state is an int from 0.

    Arrays grow by copying, so outputs are gathered in blocks of about as many elements
    as there are blocks: n elements cost n to the power of one and a half, not n squared.
    """
    none = F.array().cast(f"array<{out}>")

    def inner(acc: Column, x: Column) -> Column:
        state, made = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(made)).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["all"], F.array(d["out"])).alias("all")))

    def run(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))), F.lit(1)).cast("int")
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), width)
        blocks = F.transform(starts, lambda at: F.slice(v, at, width))
        first = F.struct(F.lit(0).alias("state"), F.array().cast(f"array<array<{out}>>").alias("all"))
        return F.flatten(F.aggregate(blocks, first, outer)["all"])

    return let(xs, run)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches in code points, end exclusive."""
    order = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def match(w: Column) -> Column:
        own = F.regexp_extract(w, rule.pattern, rule.group) if rule.group else w
        return F.struct(F.length(w).alias("all"), F.length(own).alias("own"))

    gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    found = F.zip_with(gaps, F.transform(whole, match), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.coalesce(x["m"]["all"], F.lit(0))
        keep = F.coalesce(x["m"]["own"] >= rule.least, F.lit(False))
        return end, F.struct(begin.alias("start"), end.alias("end"), keep.alias("keep"))

    kept = F.filter(scanned(found, step, "struct<start:int,end:int,keep:boolean>"), lambda x: x["keep"])
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), x["end"].alias("end"))).cast(SPANS)


def row_key() -> Column:
    """What a text is called in posting lists: rows that differ in id or text differ in it, but for chance."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index over the rules' trigrams: gram, key (see ``row_key``), once per row that holds it."""
    lowered = docs.where("text is not null").select(row_key().alias("key"), F.lower("text").alias("_low"))
    held = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams)))
    return lowered.select(F.explode(held).alias("gram"), "key")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """key, kinds: the rules whose trigram query a text's postings satisfy, as a written table.

    Clauses look up the posting lists of their trigrams; a text in all lists of a
    clause satisfies it. Lists meet by text, in partial sums, so no list is ever whole
    in one task. Null texts are in no list; an empty table has no candidates.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    queries = {r.kind: trigram_query(r.pattern) or [] for r in rules}
    clauses = [(kind, n, gram, len(clause)) for kind, query in queries.items() for n, clause in enumerate(query) for gram in sorted(clause)]
    if not clauses:
        return docs.select(row_key().alias("key"), F.array().cast("array<string>").alias("kinds")).limit(0)
    index = scratch.save(postings(docs, sorted({c[2] for c in clauses})), "postings")
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("clause"), F.lit(g).alias("_gram"), F.lit(size).alias("size")) for k, n, g, size in clauses]
    asked = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))  # one row for each trigram of a clause
    met = index.join(F.broadcast(asked), F.col("gram") == F.col("_gram")).groupBy("key", "kind", "clause", "size")
    met = met.agg(F.size(F.collect_set("gram")).alias("n")).where("n = size")
    return scratch.save(met.groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds")), "candidates")


def _may_be(found: DataFrame, n: int, scratch: Scratch):
    """A test of a key against a bit filter over ``found``, and the filter as one row to join with."""
    power = min(FILTER_POWER, max(16, (16 * n).bit_length()))
    slot = F.pmod(F.col("_key"), F.lit(1 << power))
    words = found.select(slot.alias("s")).groupBy(F.expr("s div 32").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("mask"))
    # As many entries as the filter has words, whatever the table: a map from word to mask would be searched through.
    dense = scratch.save(words, "filter")
    held = found.sparkSession.range(1 << (power - 5)).join(dense, F.col("id") == F.col("word"), "left")
    bits = held.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("m")))).alias("b"))
    row = scratch.save(bits.select(F.transform("b", lambda x: x["m"]).alias("_bits")), "bits")
    key = F.pmod(row_key(), F.lit(1 << power))
    bit = F.expr("element_at(_bits, cast(_slot div 32 as int) + 1) & shiftleft(1L, cast(_slot % 32 as int))")
    return key, bit != 0, row


def with_candidates(rows: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` plus _kinds, null where a row is no candidate."""
    found = found.select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds"))
    n = found.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), row_key() == F.col("_key"), "left").drop("_key")
    slot, hit, bits = _may_be(found, n, scratch)
    judged = rows.crossJoin(F.broadcast(bits)).withColumn("_slot", slot).withColumn("_hit", hit).drop("_bits", "_slot")
    here = judged.where(~F.col("_hit")).withColumn("_kinds", F.lit(None).cast("array<string>"))
    there = judged.where("_hit").join(found.hint("shuffle_hash"), row_key() == F.col("_key"), "left").drop("_key")
    return here.unionByName(there).drop("_hit")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` plus ``spans``: array<struct<start, order, kind, end>> by start, then rule.

    Null and empty texts hold no secret. Each row's spans depend on its text alone:
    repeated rows repeat them, and a row without doc_id is a row like others. A column
    already called spans is replaced; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != "spans"]
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = with_candidates(docs.select(*kept), candidates(docs.select("doc_id", "text"), rules, scratch), scratch)
    text = F.coalesce("text", F.lit(""))
    nothing = F.array().cast(SPANS)
    parts = []
    for rule in rules:
        full = trigram_query(rule.pattern) is None
        tried = text.rlike(rule.pattern) if full else F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
        parts.append(F.when(tried, spans(text, rule)).otherwise(nothing))
    return rows.select(*kept, F.array_sort(F.concat(*parts)).alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by ``[SECRET:kind]``; spans that overlap are replaced as one, by the first.

    ``found`` is sorted by start, as ``scan`` gives it. Null texts and texts without
    spans stay. The text is cut into blocks once, and gaps are put together from them,
    so the work is in proportion to text and spans.
    """

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        fresh = F.struct(at.alias("gap"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.greatest(at, s["end"]), fresh

    def done(blocks: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.when(b > a, F.substring(near, a % BLOCK + 1, b - a)).otherwise("")

        fresh = F.filter(scanned(found, step, "struct<gap:int,start:int,kind:string>"), lambda x: x["start"] >= x["gap"])
        pieces = F.transform(fresh, lambda x: F.concat(part(x["gap"], x["start"]), F.lit("[SECRET:"), x["kind"], F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part(F.array_max(F.transform(found, lambda s: s["end"])), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(found) > 0, let(blocks, done)).otherwise(text)
