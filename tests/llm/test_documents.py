"""The document operators against plain versions, with awkward rows."""

import hashlib
import re

import brute
import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and then some more words follow here today"
LINE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, PASSAGE + " tail one two three", "a", "x"), (2, PASSAGE + " tail one two four", "a", "x"), (3, PASSAGE.upper() + " tail one two three", "b", "x"),
    (4, None, None, "x"), (5, "", "b", "x"), (6, "   \n\t ", "b", "x"), (7, "few words", "b", "x"), (8, "FEW  words", None, "x"),
    (9, LONG, "a", "x"), (10, LONG + " more", "a", "x"), (11, "été naïve 日本語 " * 3, "c", None),
    (12, f"{LINE}\nown line", "c", "x"), (13, f"first\n{LINE}\nlast", "c", "x"), (14, f"{LINE}\nshort\n{LINE}", "c", "x"),
    (15, "mail a.b@c.de or +49 (30) 1234-5678 card 4111 1111 1111 1111 at 10.0.0.256 and 10.0.0.25", "c", "x"),
    (16, "1" * 5000 + " " + "1.1" * 2000 + " a@" + "b." * 2000 + " " + "4 " * 4000, "c", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with the names that operators use or add.
    return spark.createDataFrame([(i, t, s, e, 0, "k") for i, t, s, e in ROWS],
                                 "doc_id long, text string, source string, node string, copy int, log_weight string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_duplicates(spark, docs):
    from landtally.llm.near_dedup import keep_one, near_duplicates
    got = by_id(near_duplicates(docs))
    want = brute.near([(i, t) for i, t, _, _ in ROWS])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    left = keep_one(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_of_odd_rows(spark, docs):
    from landtally.llm.near_dedup import near_duplicates
    assert near_duplicates(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (3, "other text"), (None, "alone here")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(rows).collect())
    n = len(brute.shingles(PASSAGE))
    assert got == sorted([("None", n, "3", False), ("3", n, "3", True), ("3", n, "3", True), ("3", 1, "3", True), ("None", 1, "None", True)])


def test_estimate_follows_similarity(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from landtally.llm import near_dedup as N, words as W
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    for shared in (0, 400, 800, 1000):
        a, b = base[:1000], np.concatenate((base[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)))
        packed = [W.signed(N.packed_bits(N.minima(x)[None]))[0].tolist() for x in (a, b)]
        got = spark.createDataFrame([tuple(packed)], "a array<long>, b array<long>").select(N.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - shared / (2000 - shared)) < 0.15


def test_decontamination(spark, docs):
    from landtally.llm.decontaminate import clean, contamination, report
    items = [(1, "brown fox jumps over the lazy dog and then some more words"), (2, "FEW words"), (3, None), (4, "..."), (5, "été NAÏVE"),
             (6, " ".join(f"w{i % 977}" for i in range(970, 990))), (6, "tail one two four"), (7, "zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contaminated([(i, t) for i, t, _, _ in ROWS], items)
    got = by_id(report(contamination(docs, bench)))
    assert {i: (r.n_words, r.n_hit, r.items_sha256) for i, r in got.items()} == {
        i: (n, h, hashlib.sha256(s.encode()).hexdigest()) for i, (n, h, s) in want.items()}
    left = clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, w in want.items() if not w[1]}
    assert by_id(report(contamination(docs, bench.limit(0))))[1].n_hit == 0
    assert report(contamination(docs.limit(0), bench)).count() == 0


def test_decontamination_in_several_blocks(spark, docs, monkeypatch):
    from landtally.llm import decontaminate as D
    bench = spark.createDataFrame([(i, " ".join(PASSAGE.split()[i:i + 11])) for i in range(6)], "item_id long, text string")
    whole = sorted(D.report(D.contamination(docs, bench)).collect())
    monkeypatch.setattr(D, "ITEM_BLOCK_BYTES", 60)
    monkeypatch.setattr(D, "PASS_BLOCKS", 2)
    monkeypatch.setattr(D, "MATCHES", 3)
    table, blocks = D.item_blocks(bench, "item_id", "text")
    assert blocks > 4 and table.select("block").distinct().count() > 2
    parts = sorted(D.report(D.contamination(docs, bench)).collect())
    assert [r[:6] for r in parts] == [r[:6] for r in whole]


def test_suffix_array_finds_every_place():
    import numpy as np
    from landtally.llm.decontaminate import SuffixArray
    rng = np.random.default_rng(2)
    line = rng.integers(0, 4, 3000)
    array = SuffixArray(line, 4, 10)
    for n in (1, 3, 7, 10):
        for at in (0, 17, 900):
            word = line[at:at + n]
            if (word > 0).all():
                want = [k for k in range(len(line) - n + 1) if (line[k:k + n] == word).all()]
                padded = np.zeros((2, 10), np.int64)
                padded[0, :n], padded[1, 0] = word, word[0]
                lo, hi = array.ranges(padded)
                assert sorted(array.order[lo[0]:hi[0]]) == want
                assert sorted(array.order[lo[1]:hi[1]]) == np.flatnonzero(line == word[0]).tolist()


def repeats(rows, words=50):
    """Plain version: lines of a run of at least ``words`` words that stood earlier without overlap."""
    texts = {i: [(k, ln.rstrip(" ")) for k, ln in enumerate((t or "").split("\n")) if brute.SPACED.search(ln)] for i, t in rows}
    size = lambda ln: len(brute.SPACED.findall(ln))
    seen, out = {}, {i: set() for i in texts}
    spans = []
    for i in sorted(texts):
        lines = texts[i]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += size(lines[b][1])
                if total >= words:
                    spans.append((i, lines[a][0], lines[b][0], tuple(x for _, x in lines[a:b + 1])))
    for i, a, b, content in sorted(spans, key=lambda s: s[:3]):
        first = seen.setdefault(content, (i, a, b))
        if first[0] != i or a > first[2]:
            out[i] |= set(range(a, b + 1))
    return {i: {k for k, _ in texts[i] if k in gone} for i, gone in out.items()}


def test_line_dedup(spark, docs):
    from landtally.llm.line_dedup import without_repeats
    short = "\n".join(f"run line number {i} of the block" for i in range(10))
    more = ROWS + [(20, f"a\n{short}\nb", "d", "x"), (21, f"c\n\n{short}\n\nd", "d", "x"), (22, "\n".join(["same line of six words here"] * 40), "d", "x"),
                   (23, "\n".join(f"run line number {i} of the block" for i in range(3)), "d", "x")]
    table = spark.createDataFrame([(i, t, 0) for i, t, _, _ in more], "doc_id long, text string, n_lines int")
    got = by_id(without_repeats(table))
    want = repeats([(i, t) for i, t, _, _ in more])
    for i, t, _, _ in more:
        if t is None:
            assert got[i].text is None and got[i].n_deleted == 0
            continue
        kept = [ln for k, ln in enumerate(t.split("\n")) if k not in want[i]]
        assert got[i].text.split("\n") == (kept or [""]), i
    assert without_repeats(table.limit(0)).count() == 0


def test_pii(spark, docs):
    from landtally.llm.pii import find, masked, report
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 0,
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    more = [(30, "x@y@z.com a@b.c_d@e.f a..b@c.de. @x.y +1234567890 +12 34 (56) 78 90.", "", ""), (31, "4111-1111-1111-1111 41111111111111112 5 5", "", ""),
            (32, "01.002.3.4 1.2.3.4.5.6.7.8 256.1.1.1 999.1.1.1.1", "", ""), (33, "naïve é 10.1.1.1 😀 a@b.co", "", ""), (34, "a@b.c+1 (2) 3456789", "", "")]
    rows = [(i, t) for i, t, _, _ in ROWS + more]
    got = by_id(report(find(spark.createDataFrame(rows, "doc_id long, text string"))))
    for i, t in rows:
        spans = sorted((m.start(), r, f"{k}:{m.start()}:{m.end()}") for r, (k, p) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(k, m.group()))
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for _, _, s in spans).encode()).hexdigest(), i
    extra = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 and ssn 123-45-6789, far from there and with nothing about it near 123-45-6780", "z")], "doc_id long, text string, found string")
    assert by_id(report(find(extra)))[1].spans == "iban:5:32,ssn:41:52"
    assert masked(extra).first().text == "IBAN <iban> and ssn <ssn>, far from there and with nothing about it near 123-45-6780"
    assert report(find(docs.limit(0))).count() == 0


def test_token_counts(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    from landtally.llm.tokens import token_counts
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    odd = [" ", "  a", "a  b", "a \n b", "<|endoftext|> hi<|endoftext|>", "it's we'll  DON'T", "日本語 テキスト", "a　b c", "😀 😀x", "\n\n a", "t ", "a\x1cb c",
           "x² ½ ١٢", "a_b __c", "١٢ ٣", "a​ b", "tab\tsep  x"]
    rows = [(i, t) for i, t, _, _ in ROWS] + [(100 + k, t) for k, t in enumerate(odd)]
    got = by_id(token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path))
    for i, t in rows:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), (i, t and t[:20])
        assert got[i].n_bytes == len((t or "").encode())


def test_backoff_scores(spark, docs, monkeypatch):
    from landtally.llm import lm_score
    monkeypatch.setattr(lm_score, "PARTITION_GRAMS", 20_000)
    want = brute.backoff([(i, t) for i, t, _, _ in ROWS])
    got = by_id(lm_score.backoff_scores(docs))
    for i, (n, full, score) in want.items():
        assert (got[i].n_words, got[i].n_full) == (n, full)
        assert got[i].score == pytest.approx(score)
    assert lm_score.backoff_scores(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    from landtally.llm.mixing import copies, mix, report, targets
    table = spark.createDataFrame([("a", 100), ("b", 1000), (None, 50), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in targets(table).collect()}
    # Weights 5, 2, 1 and, last, 5 for NULL: a and NULL stop at three times their size; b takes the rest.
    assert got == {"a": 300.0, None: 150.0, "b": 700.0, "c": 0.0}
    rows = [(k, " ".join(["w"] * (k % 37 + 1)), "s%d" % (k % 4)) for k in range(1500)] + [(7, "w w", None), (7, "w w", None), (None, "w", None)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = report(copies(many))
    assert sorted(map(str, out.collect())) == sorted(map(str, report(copies(many.repartition(5))).collect()))
    groups = {}
    for r in copies(many).collect():
        groups.setdefault(r.source, []).append(r)
        assert 0 <= r.copies <= 3
    for rs in groups.values():
        assert abs(sum(r.size * r.copies for r in rs) - rs[0].target) <= max(r.size for r in rs)
    mixed = mix(many)
    assert mixed.columns == ["doc_id", "text", "source", "copy"]
    assert mixed.count() == sum(r.copies for rs in groups.values() for r in rs)
    assert mix(docs).count() > 0 and mix(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    from landtally.llm.quality import draw, fit
    good, bad = "calm plain sentence about gardens", "utter rubbish nonsense garbage"
    rows = [(k, f"{good} number{k}. " * 4 + (bad if k % 4 == 0 else "") , "s") for k in range(400)] + [(900, None, "s"), (901, "", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, log_weight string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(0, 300)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit(table, labels)
    kept = draw(table, model)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    held_out = [k for k in range(300, 400)]
    right = sum((k in ids) == (k % 4 != 0) for k in held_out)
    assert right >= 95 and {900, 901} <= ids
    assert draw(table, fit(table, labels.limit(0))).count() == len(rows)
    assert draw(table.limit(0), fit(table.limit(0), labels)).count() == 0
    assert draw(docs, model, weight_col="log_weight").columns[-1] == "log_weight"


def test_secrets(spark, docs):
    from landtally.llm.secrets import findings, scan
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'set token = "{key(k)}" now', "src/a") for k in range(60)] + [(100 + k, f"order {key(k)[:20].translate(str.maketrans('abcdef', '123456'))} shipped", "b") for k in range(60)]
    rows += [(500, f"see {key('z')} here", None), (501, None, "b"), (502, "", "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Held out: labels of even documents only.
    labelled = findings(table).filter("doc_id % 2 = 0")
    got = {r.doc_id: r for r in scan(table, labelled).collect()}
    assert all(got[k].secret for k in range(60)) and not any(got[100 + k].secret for k in range(60))
    assert rows[3][1][got[3].start:got[3].end] == key(3)
    assert scan(docs.limit(0)).count() == 0 and scan(docs).count() >= 1


def test_short_texts_at_the_threshold(spark, monkeypatch):
    """The last pass alone links all pairs of short texts at exactly 75 %."""
    from landtally.llm import near_dedup as N
    likely = N._likely
    monkeypatch.setattr(N, "_likely", lambda *given: likely(*given).limit(0))
    rows = []
    for k in range(400):
        shingles = (4, 8, 12)[k % 3]
        words = [f"k{k}w{j}" for j in range(shingles + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-shingles // 4]))]
    got = by_id(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.near(rows)
    assert len({r.component_id for r in got.values()}) == 400


def test_secrets_in_assignments(spark):
    from landtally.llm.secrets import findings
    aws, google, github = "AKIA" + "ABCD1234EFGH5678", "AIza" + "Sy0aB1cD2eF" * 3 + "xY", "ghp_" + "a1B2c3" * 6
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl-_x"
    plain = "Zm9vYmFyYmF6MTIz"
    cases = [(f"API_KEY={aws}", aws), ("password=hunter2hunter2 next", "hunter2hunter2"), (f"token={github}\n", github), (f"http://x.org/?key={google}&a=1", google),
             (f"see /{aws}/ there", aws), (f"auth {jwt}.", jwt), ("password = p@ss.w0rd!$x", "p@ss.w0rd!$x"), ("PASSWORD: 'a b'", "a b"), ("pwd=abc", "abc"),
             (f"plain {plain}== here", plain + "=="), (f"{plain}x={plain}", plain + "x"), (f"/{aws}/{plain}", aws)]
    table = spark.createDataFrame([(k, t, "s") for k, (t, _) in enumerate(cases)], "doc_id long, text string, source string")
    found = {(r.doc_id, r.value): r for r in findings(table).collect()}
    for k, (text, value) in enumerate(cases):
        assert (k, value) in found, text
        row = found[k, value]
        assert text[row.start:row.end] == value
        assert k > 6 or row.label == 1.0, text
    assert (10, plain) in found and (11, f"/{plain}") in found and len(found) == len(cases) + 2
