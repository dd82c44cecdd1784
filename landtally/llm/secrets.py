"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are issuers' formats, values assigned to secret names, and runs of key characters that hold a digit. Their features are length, transitions between
character classes, the share that words of the text cover, the path (source) and neighbouring
words. The forest is trained from labelled findings; where none are given, findings whose format
or assignment settles the matter are the labels and the forest decides the others too. Only DataFrame
functions and Spark ML run here.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from landtally.llm.spans import between, matches, segments
from landtally.llm.store import stored

_KEY = r"A-Za-z0-9+/_\-"
NEAR = 40

#: Formats of well-known issuers, assignments to secret names, and what placeholders hold.
_FORMATS = (r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|sk-[A-Za-z0-9_\-]{20,}+|AIza[0-9A-Za-z_\-]{35}"
            r"|eyJ[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]*+)")
ISSUED = rf"^{_FORMATS}$"
_NAMED = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_\-]?key|access[_\-]?key|credential)s?[\"']?\s{0,16}[=:]{1,3}>?\s{0,16}[\"']?"
ASSIGNED = rf"(?i){_NAMED}$"
#: A value after a secret name: up to the quote that ends it, or without quotes up to white space or a sign that ends a value.
_VALUE = r"(?:(?<=[\"'])[^\"'\r\n]++(?=[\"'])|(?![=:>])[^\s\"'&<>]*[^\s\"'&<>,;.)\]}])"
_GIVEN = rf"(?<=[=:>]\s{{0,16}}[\"']?)(?<=(?i:{_NAMED})){_VALUE}"
_ISSUED_HERE = rf"(?<![A-Za-z0-9]){_FORMATS}(?![A-Za-z0-9])"
#: A run of at least 12 key characters with a digit, from its start or where the last candidate ends; "=" belongs to it as padding only.
_RUN = (rf"(?:(?<![{_KEY}])|\G)(?=[A-Za-z+/_\-]*+[0-9])(?:(?!{_ISSUED_HERE})[{_KEY}]){{12,}}+(?:={{1,2}}(?![{_KEY}=]))?")
CANDIDATE = rf"(?:{_ISSUED_HERE}|{_GIVEN}|{_RUN})"
#: What an assignment settles; whether a shorter or plain value is a secret is left to the forest.
STRONG = r"^(?=.*[0-9])\S{12,}$"

HARMLESS = r"(?i)^[0-9\-+/=_]+$|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$|example|placeholder|dummy|changeme|x{6,}|(.)\1{7,}"
SECRET_WORDS = r"(?i)\b(?:token|secret|password|passwd|key|credential|auth|bearer|login)\b"
CALM_WORDS = r"(?i)\b(?:example|sample|test|dummy|sha|commit|hash|version|isbn|order|number|id)\b"

FEATURES = ("length", "transitions", "digits", "uppers", "symbols", "distinct", "hex", "coverage", "path", "slashes",
            "quoted", "assigned", "secret_words", "calm_words")
#: Labelled findings that the forest is fitted on at most; all findings are scored.
LABELS, TREES, DEPTH, SEED = 20_000, 24, 6, 10



def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, ``start``, ``end`` (code points), ``value``, ``label`` where settled, and the features."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(path_col).cast("string").alias("_path"))
    rows = rows.filter(text.rlike(CANDIDATE))
    rows = rows.withColumn("_found", matches(text, CANDIDATE)).withColumn("_hits", F.col("_found.value")).withColumn("_pieces", segments(text))
    pieces = F.split(text, CANDIDATE, -1)
    # The dictionary of a text: its words outside candidates that are also parts of candidates.
    parts = F.flatten(F.transform("_hits", lambda v: F.regexp_extract_all(F.lower(v), F.lit("[a-z]{4,}"), F.lit(0))))
    words = F.flatten(F.transform(pieces, lambda p: F.split(F.lower(p), r"[^a-z]+")))
    rows = rows.withColumn("_known", F.array_intersect(parts, words))

    def covered(value: Column) -> Column:
        own = F.regexp_extract_all(F.lower(value), F.lit("[a-z]{4,}"), F.lit(0))
        return F.aggregate(F.filter(own, lambda p: F.array_contains("_known", p)), F.lit(0), lambda a, p: a + F.length(p))

    around = rows.select(id_col, "_path", F.explode(F.transform("_found", lambda s: F.struct(
        s["start"].alias("start"), s["value"].alias("value"), covered(s["value"]).alias("covered"),
        between(F.col("_pieces"), F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]).alias("before"),
        between(F.col("_pieces"), s["start"] + F.length(s["value"]), s["start"] + F.length(s["value"]) + NEAR).alias("after")))).alias("f")).select(id_col, "_path", "f.*")
    value, before = F.col("value"), F.col("before")
    n = F.length(value).cast("double")
    # A transition is a place between two classes; deleting all but one of each run leaves one more.
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), r"[+/=_\-]+", "-")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    flag = lambda condition: condition.cast("double")
    features = {
        "length": n, "transitions": (F.length(shape) - 1) / n, "digits": share("[^0-9]"), "uppers": share("[^A-Z]"), "symbols": share("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n, "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "coverage": F.col("covered") / n, "path": F.coalesce(F.pmod(F.xxhash64("_path"), F.lit(16)).cast("double"), F.lit(-1.0)),
        "slashes": share("[^/]"), "quoted": flag(before.rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "assigned": flag(before.rlike("[=:]\\s*[\"']?$")), "secret_words": flag(before.rlike(SECRET_WORDS)),
        "calm_words": flag(before.rlike(CALM_WORDS))}
    settled = F.when(value.rlike(HARMLESS), 0.0).when(value.rlike(ISSUED) | (before.rlike(ASSIGNED) & value.rlike(STRONG)), 1.0).when(
        before.rlike(CALM_WORDS) & ~before.rlike(SECRET_WORDS), 0.0)
    return around.select(id_col, "start", (F.col("start") + F.length(value)).alias("end"), "value", settled.alias("label"),
                         *[features[f].cast("double").alias(f) for f in FEATURES])


def fit(labelled: DataFrame, labels: int = LABELS):
    """A forest on at most about ``labels`` labelled findings, chosen by hash; None if they are of one kind only.

    Equal values count once, so that a copied finding has no more say than another.
    """
    pool = labelled.filter("label is not null").dropDuplicates(["value", "label"])
    n = pool.groupBy("label").count().collect()
    if len(n) < 2:
        return None
    cut = labels / max(labels, sum(r["count"] for r in n))
    chosen = pool.filter(F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < int(cut * (1 << 20)))
    balance = {r["label"]: sum(x["count"] for x in n) / (2.0 * r["count"]) for r in n}
    chosen = chosen.withColumn("weight", F.when(F.col("label") == 1, balance.get(1.0, 1.0)).otherwise(balance.get(0.0, 1.0)))
    # The sample is bounded; one ordered partition makes the bagging repeatable.
    chosen = stored(chosen.repartition(1).sortWithinPartitions("value", "label"), "labels")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(chosen))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, ``start``, ``end``, ``value_sha256``, ``score``, ``secret``.

    ``labelled`` has the columns of ``findings`` with a ``label`` of 1.0 or 0.0. Without two kinds of labels the settled label,
    else 0, is the score. NULL and empty texts have no candidates; a NULL id or path is allowed;
    repeated rows each return theirs; other columns are ignored. The value itself is not returned.
    """
    found = stored(findings(docs, id_col, text_col, path_col), "findings")
    model = fit(found if labelled is None else labelled)
    if model is None:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(found)
        scored = model.transform(table).withColumn("score", vector_to_array("probability")[1])
    return scored.select(id_col, "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"),
                         (F.col("score") >= threshold).alias("secret"))
