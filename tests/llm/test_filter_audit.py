import itertools
import random
import re

import pytest


def plain(docs, labels):
    """Each order run filter by filter over the documents, as the contract says it."""
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails.append((i, s or "", {f for f, bad in (
            ("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)),
            ("D", re.search("[#$%&*|]", t)), ("E", i is not None and min(texts[t]) < i)) if bad}))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s for _, s, _ in fails}:
        rows = [(i, bad) for i, s, bad in fails if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for o in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(o):
                gone = [r for r in left if f in r[1]]
                before = len([1 for _, bad in rows if f in bad]) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(o), k + 1] = [len(left), len(gone), before, sum(bad == {f} for _, bad in rows), sum(i in good for i, _ in gone),
                                                sum(i in toxic for i, _ in gone)]
        for o in itertools.permutations("ABCDE"):
            for k, f in enumerate(o):
                out[part, "".join(o), k + 1].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("counters", [None, 64])
def test_audit(spark, counters):
    """64 counters are all full, so that every text is a possible repeat; the result is the same."""
    from landtally.llm.filter_audit import audit
    rng = random.Random(5)
    words = ["word", "Wort", "MOT", "a|b", "é", "x1", "#"] + [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(rng.choices(words[rng.choice((0, 3, 7)):], k=rng.choice((0, 10, 49, 50, 51, 90)))), rng.choice(("web", "code", None))) for k in range(300)]
    docs += [(1000 + k, docs[k % 9][1], "web") for k in range(200)] + [(None, docs[0][1], "web"), (5, docs[5][1], docs[5][2]), (-1, docs[3][1], "late")]
    docs += [(2000, None, "n"), (2001, "", "n"), (2002, "A" * 3 + "a" * 57, ""), (2003, "\x0b\x0c\x1c\x85 x ", "n"), (2004, "long " * 400_000 + "Z", "n")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 1200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*r, 1, "h") for r in docs], "doc_id long, text string, source string, mask int, h string").repartition(5)
    given = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = {tuple(r[:3]): tuple(r[3:]) for r in audit(table, given, counters=counters).collect()}
    assert got == plain(docs, labels)


def test_audit_of_empty_tables(spark):
    from landtally.llm.filter_audit import audit
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s")], none.schema)
    assert {r.removed for r in audit(one, labels).filter("filter_order like 'A%'").collect()} == {0, 1}


def test_unique_texts_are_cleared(spark):
    from landtally.llm.sketch import met
    from pyspark.sql import functions as F
    rows = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") < 100, F.lit(0)).otherwise(F.col("id"))).alias("h"))
    left = rows.filter(met(rows, times=2)(F.col("h"))).count()
    assert 100 <= left < 400
