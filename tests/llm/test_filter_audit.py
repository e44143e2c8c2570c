import itertools
import random
import re
from collections import Counter

from quern.llm import filter_audit
from quern.llm.filter_audit import METRICS, audit, interactions

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels, filters="ABCDE"):
    """Every order applied to every row, one filter after the other."""
    masks = []
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and least[text] < d,
        }
        masks.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations(filters)):
            left = list(own)
            for i, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                out[part, order, i + 1] = [
                    len(left), len(gone), sum(f in m[1] and bool(m[1] & set(order[:i])) for m in own), sum(m[1] == {f} for m in own),
                    sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[key[1][key[2] - 1]])
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[m] for m in (*METRICS, "shapley")] for r in df.collect()}


def some_rows(n=120, seed=2):
    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        words = [f"w{rnd.randrange(rnd.choice([20, 4000]))}" for _ in range(rnd.choice([5, 150, 250, 400]))]
        text = " ".join(words) + rnd.choice(["", "", " #", " $ | %"]) + rnd.choice(["", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3])
        rows.append((d, rnd.choice([text, "one text of many"]), rnd.choice(["a", "b", None, ""])))
    labels = [(d, rnd.randrange(2), rnd.randrange(2)) for d in range(0, n, 2)] + [(0, 1, 1), (None, 1, 1), (10**6, 1, 1), (4, None, None)]
    return rows, labels


def test_equals_brute_force(spark, monkeypatch):
    rows, labels = some_rows()
    rows += [(None, "one text of many", "a"), (None, None, "a"), (3, rows[3][1], "c"), (3, rows[3][1], "c")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = spark.createDataFrame(labels, LABELS)
    got = audit(df, told).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    assert found(audit(df, told)) == want
    monkeypatch.setattr("quern.llm.skew.FLOOR", 1)
    monkeypatch.setattr("quern.llm.skew.KEYS", 1000)
    assert found(audit(df, told)) == want


def test_odd_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1)], LABELS)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert found(audit(odd, labels)) == brute(rows, [tuple(r) for r in labels.collect()])
    assert audit(no_docs, labels).collect() == []
    none = spark.createDataFrame([], LABELS)
    assert found(audit(odd, none)) == brute(rows, [])


def test_boundaries(spark):
    exact = " ".join(f"w{i}" for i in range(200))
    half = " ".join(f"w{i % 100}" for i in range(200))
    capitals = "A" * 2 + "b" * 98
    rows = [(0, exact, "a"), (1, exact.rpartition(" ")[0], "a"), (2, half, "a"), (3, half.replace("w99", "w98"), "a"), (4, capitals, "a"), (5, capitals + "A", "a"), (6, "Ä" * 50, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    masks = {r["doc_id"]: r["mask"] for r in filter_audit.masked(df).collect()}
    assert masks == {0: 0, 1: 1, 2: 0, 3: 2, 4: 1, 5: 5, 6: 1}


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("x", 0, 3, 1, 0), ("x", 1, 2, 2, 0), ("x", 3, 5, 0, 4), ("x", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = found(interactions(cells, "AB"))
    assert got == {
        ("x", "AB", 1): [3, 8, 0, 2, 2, 4, 10], ("x", "AB", 2): [3, 0, 6, 0, 0, 0, 6],
        ("x", "BA", 1): [5, 6, 0, 0, 0, 4, 6], ("x", "BA", 2): [3, 2, 6, 2, 2, 0, 10],
    }
