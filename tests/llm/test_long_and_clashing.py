"""Texts with a hundred thousand spans, and columns with the names that the operators use themselves."""

import random
import time

import pytest
from pyspark.sql import functions as F

NAMES = ["_key", "_n", "_gone", "_i", "_h", "_all", "_id", "_row", "row", "_hash", "_doc", "_twin", "_source", "id", "n_lines_", "found", "_text", "key"]


def test_running_and_matches(spark):
    from landtally.llm.spans import between, matches, running, segments
    rng = random.Random(1)
    rows = [([rng.randrange(-5, 50) for _ in range(n)], "".join(rng.choice("ab1é𝄞\n") for _ in range(n * 7))) for n in (0, 1, 2, 3, 10, 57, 400, 1000)]
    got = spark.createDataFrame(rows, "v array<long>, t string").select(
        "v", "t", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m"), matches(F.col("t"), "1+").alias("hits"),
        F.transform(F.sequence(F.lit(0), F.length("t"), F.lit(311)), lambda i: between(segments(F.col("t")), i, F.least(i + 1500, F.length("t")))).alias("parts")).collect()
    import itertools
    import re
    for r in got:
        assert r.s == list(itertools.accumulate(r.v)) and r.m == list(itertools.accumulate(r.v, max))
        assert [(h.start, h.value) for h in r.hits] == [(m.start(), m.group()) for m in re.finditer("1+", r.t)]
        assert r.parts == [r.t[i:i + 1500] for i in range(0, len(r.t) + 1, 311)]


def test_hundred_thousand_addresses(spark):
    from landtally.llm.pii import find, masked, report
    piece = "é mail a1@b.co, "
    table = spark.createDataFrame([(1, piece * 100_000)], "doc_id long, text string")
    began = time.time()
    row = report(find(table)).first()
    starts = [16 * k + 7 for k in range(100_000)]
    assert row.n_email == 100_000 and row.spans == ",".join(f"email:{s}:{s + 7}" for s in starts)
    assert masked(table).first().text == "é mail <email>, " * 100_000
    assert time.time() - began < 90


def test_twenty_thousand_candidates(spark):
    from landtally.llm.secrets import findings
    rng = random.Random(2)
    text = " ".join(f"key{k} = {''.join(rng.choices('abcdefGHIJ0123456789', k=20))}" for k in range(20_000))
    began = time.time()
    rows = findings(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).select("start", "end", "value").collect()
    assert len(rows) >= 20_000 and all(text[r.start:r.end] == r.value for r in rows)
    assert time.time() - began < 90


@pytest.mark.parametrize("names", [NAMES[:9], NAMES[9:]])
def test_clashing_columns(spark, names):
    import corpus_pipeline
    from landtally.llm.line_dedup import without_repeats
    from landtally.llm.near_dedup import keep_one
    from landtally.llm.decontaminate import clean
    from landtally.llm.mixing import mix
    from landtally.llm.pii import masked
    words = [f"w{k}" for k in range(300)]
    line, other = " ".join(words[:60]), " ".join(f"other{k}" for k in range(90))
    rows = [(1, f"{line}\none", "a"), (2, f"{line}\n{other}", "a"), (3, " ".join(words[100:160]), "b"), (4, " ".join(words[100:160]), "b"),
            (5, "the bench item of ten words that stands in a text here", "b"), (6, "mail x@y.org", None), (None, None, "b"), (7, "", "a")]
    table = spark.createDataFrame([(*r, *[f"{n}{k}" for n in names]) for k, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "bench item of ten words that stands in a text")], "item_id long, text string")
    extra = {r[0]: [f"{n}{k}" for n in names] for k, r in enumerate(rows)}

    def same(out, ids):
        got = out.collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
        assert all([r[n] for n in names] == extra[r.doc_id] for r in got)
        return {r.doc_id: r for r in got}

    everything = [r[0] for r in rows]
    assert same(without_repeats(table), everything)[2].text == other
    same(keep_one(table), [i for i in everything if i != 4])
    same(clean(table, bench), [i for i in everything if i != 5])
    assert same(masked(table), everything)[6].text == "mail <email>"
    mixed = mix(table).collect()
    assert mixed and all([r[n] for n in names] == extra[r.doc_id] for r in mixed) and corpus_pipeline.STAGES
