"""The registered queries of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landtally.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
      WHERE 100 * p.c >= 75 * (x.n_shingles + y.n_shingles - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""


@query("op5_minhash_near_dedup", _NEAR_SQL)
def _op5(table):
    from landtally.llm.near_dedup import near_duplicates
    return near_duplicates(table("documents")).drop("class_id")


_LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j, ws FROM b WHERE len(ws) > 0),
w AS (SELECT item_id, n, j, array_to_string(ws[j:j+n-1], ' ') AS g FROM v),
x AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS k, ws FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
y AS (SELECT doc_id, n, k, array_to_string(ws[k:k+n-1], ' ') AS g FROM x),
m AS (SELECT y.doc_id, y.k, y.n, w.item_id, w.j FROM y JOIN w USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1),
r AS (SELECT doc_id, item_id, k - j AS shift, n, k - row_number() OVER (PARTITION BY doc_id, item_id, k - j ORDER BY k) AS run FROM m),
l AS (SELECT doc_id, max(c + n - 1) AS longest FROM (SELECT doc_id, n, count(*) AS c FROM r GROUP BY doc_id, item_id, shift, n, run) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(l.longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)
"""


@query("op8_decontamination", _LEAK_SQL)
def _op8(table):
    from landtally.llm.decontaminate import contamination, report
    return report(contamination(table("documents"), table("benchmark")))


@query("op3_token_counts")
def _op3(table):
    import public_tokenizers

    from landtally.llm.tokens import token_counts
    return token_counts(table("documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


_LINES_SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, rtrim(unnest(ls), ' ') AS line FROM t),
b AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM a),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM b WHERE words > 0),
d AS (SELECT *, upto - words AS before FROM c),
w AS (SELECT doc_id, 0 AS side, pos AS s, max(pos) OVER r AS e, list(line) OVER r AS ls, sum(words) OVER r AS n FROM d
      WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
      UNION ALL
      SELECT doc_id, 1, min(pos) OVER l, pos, list(line) OVER l, sum(words) OVER l FROM d
      WINDOW l AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (SELECT side, ls, min({'d': doc_id, 's': s, 'e': e}) AS p FROM w WHERE n >= 50 GROUP BY 1, 2 HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM w JOIN f USING (side, ls)
      WHERE n >= 50 AND (doc_id > p.d OR (doc_id = p.d AND s > p.e))),
h AS (SELECT doc_id, count(*) AS n_deleted, list(pos) AS gone FROM g GROUP BY 1)
SELECT t.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([x FOR x, i IN ls IF NOT list_contains(gone, i - 1)], chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM t LEFT JOIN h USING (doc_id)
"""


@query("op6_line_dedup", _LINES_SQL)
def _op6(table):
    from landtally.llm.line_dedup import without_repeats
    return without_repeats(table("documents").select("doc_id", "text"))


@query("op7_source_mixing")
def _op7(table):
    from landtally.llm.mixing import copies, report
    return report(copies(table("documents")))


def _spans_sql(kind: str, pattern: str, test: str) -> str:
    return rf"""
{kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM t),
{kind} AS (SELECT doc_id, '{kind}' AS kind, m[i] AS v, i, m, p FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m)),
{kind}_s AS (SELECT doc_id, kind, CAST(coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS BIGINT) AS s,
  length(v) AS n FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM {kind}) WHERE {test})"""


_LUHN = ("list_sum([CASE WHEN (length(d) - k) % 2 = 1 THEN (CASE WHEN CAST(d[k] AS INT) > 4 THEN 2 * CAST(d[k] AS INT) - 9"
         " ELSE 2 * CAST(d[k] AS INT) END) ELSE CAST(d[k] AS INT) END FOR k IN range(1, length(d) + 1)]) % 10 = 0")
# The given tables hold none of the added kinds, so all spans are base spans there.
_PII_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_spans_sql(
    "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}, {_spans_sql(
    "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max([CAST(x AS HUGEINT) FOR x IN string_split(v, '.')]) <= 255")}, {_spans_sql(
    "card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length(d) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END")}, {_spans_sql(
    "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15")},
a AS (SELECT *, 0 AS r FROM email_s UNION ALL SELECT *, 1 FROM ip_s UNION ALL SELECT *, 2 FROM card_s UNION ALL SELECT *, 3 FROM phone_s),
g AS (SELECT doc_id, count(*) FILTER (r = 0) AS n_email, count(*) FILTER (r = 1) AS n_ip, count(*) FILTER (r = 2) AS n_card,
  count(*) FILTER (r = 3) AS n_phone, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, r) AS spans FROM a GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""


@query("op9_pii", _PII_SQL)
def _op9(table):
    from landtally.llm.pii import find, report
    return report(find(table("documents")))


@query("op10_secret_scan")
def _op10(table):
    from landtally.llm.secrets import scan
    return scan(table("documents"))


@query("op2_quality_resampling")
def _op2(table):
    from landtally.llm.quality import draw, fit
    docs = table("documents")
    model = fit(docs, table("labels"))
    return draw(docs, model, weight_col="log_weight").select("doc_id", "source", "log_weight")


@query("op4_backoff_scores")
def _op4(table):
    from landtally.llm.lm_score import backoff_scores
    return backoff_scores(table("documents"))


# Only the valid vectors of the given tables are compared; each is scaled before the products are summed.
_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM u WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
d AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)
"""


@query("op1_vector_near_dedup", _VECTOR_SQL)
def _op1(table):
    from landtally.llm.vectors import near_vectors
    return near_vectors(table("embeddings")).drop("class_id")


_WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, CAST(strlen(t) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY t) AS top, sha1(t) AS h FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (5 * (3 - k % 4))) & 31), 1)
    FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d
"""


@query("op11_warc_revisits", _WARC_SQL)
def _op11(table):
    from landtally.llm.warc import archived
    from landtally.session import scratch_folder
    pages = table("pages")
    return archived(pages, scratch_folder(pages.sparkSession, "archives"))


_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t
      WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
k AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i-1]), 0) AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM o)),
a AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, (SELECT filter_order, step, bit, CAST(before AS INT) AS before FROM k) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a
"""


@query("op12_filter_interactions", _AUDIT_SQL)
def _op12(table):
    from landtally.llm.filter_audit import audit
    return audit(table("documents"), table("labels"))


@query("op13_exact_whitening")
def _op13(table):
    from landtally.llm.whitening import whitened
    return whitened(table("embeddings"))
