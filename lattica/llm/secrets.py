"""Secret scanning with DataFrame functions only.

A pattern finds long tokens with a digit, of mixed case or with dots, published key formats, and
whole values that a telling name or the login of an address is given; a random forest over length,
character transitions, dictionary coverage, path signs and neighbouring words removes false
positives.  It is fitted by Spark ML on labelled findings.  Where there are none, formats and assignments to telling names
label findings, except for what looks like a placeholder, an identifier, a path or a word; such a
fit does not see the signs that labelled its rows, so it judges by the tokens' own shape.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import common as C

BEFORE, AFTER = 60, 20
"""Code points of context that features see."""
SAMPLE_ROWS = 20_000
"""Most labelled findings that a fit reads: those with the smallest hash."""
LONG = 12
"""Least code points of a secret that is replaced wherever it stands."""
WORD_LEAST = 2
"""Documents that a word must occur in to count as a dictionary word."""
_NAME = (r"(?i:p(?:ass(?:word|wd|phrase)?|wd|rivate[_-]?key)|secret|token|a(?:pi[_-]?key|ccess[_-]?key|uth)|credentials?|bearer)")
NAMES = _NAME
TOLD = _NAME + r"[\"'`]?\s*+[:=]{1,2}>?\s*+"
"""What stands before a value that a telling name is given, up to a quote."""
LOGIN = r"://[^\s/:@]*+:"
"""What stands before the password in an address."""
PUBLISHED = r"(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|sk_(?:live|test)_[0-9A-Za-z]{16,}+)"
FORMATS = f"^{PUBLISHED}$"
"""Fixed values: published formats of well-known keys."""
CANDIDATE = (r"(?<![A-Za-z0-9+/_-])(?:" + PUBLISHED + r"(?![A-Za-z0-9+/_-])"
             r"|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
             r"|(?=[A-Za-z+/_-]*?[a-z][A-Z])[A-Za-z+/_-]{20,}+={0,2}"
             r"|(?=[A-Za-z0-9._-]{12})(?=[A-Za-z._-]*+[0-9])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)+)")
"""By their own looks: published formats, 12 characters with a digit, 20 letters of mixed case, 12 characters with dots and a digit."""
_GIVEN = f"(?:{TOLD}(?:" + "|".join(f"{q}[^{q}\\r\\n]++(?={q})" for q in "\"'`") + r"|[\"'`]?[^\s\"'`]*[^\s\"'`.,;:)\]}>]))"
SEARCH = f"{_GIVEN}|(?:{LOGIN}" + r"[^\s/@]++(?=@))|" + CANDIDATE
"""Also whole values with what gives them: in quotes, or up to white space without a closing mark."""
LEAD = f"^(?:{TOLD}[\"'`]?|{LOGIN})"
"""The part of a match before its value."""
SIGNS = ["assigned", "named", "format"]
"""What labels findings where nobody has reviewed any."""
SHAPE = ["length", "changes", "digits", "upper", "distinct", "consonants", "marks", "coverage", "path", "quoted", "prose"]
FEATURES = [*SHAPE, *SIGNS]
LOOKALIKE = (r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|x{3,}|\*{3,}|\.{3,}|<[^>]*>|\$\{?\w+\}?|[~.]?(?:/[\w.-]+)+/?"
             r"|(?:your|my|an?|the|some|change|example|sample|dummy|test|insert|none|null|true|false|todo)[-_ a-z]*)$")
"""Identifiers, masks, references to variables, paths and placeholders."""
# Tokens that stand after telling names and are no secrets, as (token, how many hexadecimal digits follow).
HARD = [("changeme", 0), ("your-api-key-here", 0), ("example", 0), ("xxxxxxxxxxxx", 0), ("/run/secrets/db-password", 0), ("/etc/app/token.txt", 0), ("everyone", 0),
        ("placeholder_value", 0), ("${DB_PASSWORD}", 0), ("<your-token>", 0), ("none", 0), ("build-", 6), ("node/", 4)]
VARIANTS = 8
"""Training rows of each look-alike; four times as many identifiers and eight times as many passwords."""


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, k, token, start, before, after): every candidate of every distinct (id, text).

    ``mark`` is the text's hash, ``k`` counts a text's candidates from 0, ``start`` is in code points.
    """
    text = F.col("text")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.rlike(text, F.lit(SEARCH)))
    cut = src.select("doc_id", F.xxhash64("text").alias("mark"), F.regexp_extract_all(text, F.lit(SEARCH), F.lit(0)).alias("found"), F.split(text, SEARCH, -1).alias("gaps"))
    each = cut.select("doc_id", "mark", F.posexplode(F.arrays_zip("found", "gaps", F.slice("gaps", F.lit(2), F.size("gaps")).alias("next"))).alias("k", "x"))
    led = each.where(F.col("x.found").isNotNull()).select(
        "doc_id", "mark", "k", F.col("x.found").alias("found"), F.length("x.gaps").alias("gap"), F.regexp_extract("x.found", LEAD, 0).alias("lead"),
        F.right("x.gaps", F.lit(BEFORE)).alias("ahead"), F.left("x.next", F.lit(AFTER)).alias("after"))
    once = led.dropDuplicates(["doc_id", "mark", "k"])
    w = Window.partitionBy("doc_id", "mark").orderBy("k")
    upto = F.sum(F.col("gap") + F.length("found")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    token = F.substr("found", F.length("lead") + 1)
    return once.withColumns({"token": token, "start": (upto - F.length(token)).cast("bigint"), "before": F.right(F.concat("ahead", "lead"), F.lit(BEFORE))}).drop(
        "gap", "found", "lead", "ahead")


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): words of at least four letters of all documents, and how many documents have each."""
    of = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?<![\p{L}\p{N}_])\p{L}{4,}+(?![\p{L}\p{N}_])"), F.lit(0))
    return docs.select(F.explode(F.array_distinct(of)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= WORD_LEAST)


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add the columns FEATURES to candidates."""
    t = F.col("token")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / F.length(t)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    key = ["doc_id", "mark", "k"]
    pieces = found.select(*key, F.explode(F.regexp_extract_all(F.lower("token"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    known = pieces.join(words.select("word"), "word").groupBy(*key).agg(F.sum(F.length("word")).alias("known"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in key]
    joined = found.alias("f").join(known.alias("w"), same[0] & same[1] & same[2], "left").select("f.*", "w.known")
    return joined.withColumns({
        "length": F.length(t).cast("double"),
        "changes": share(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"),
        "digits": share("[0-9]"), "upper": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.length(t),
        "consonants": share(r"(?i)[bcdfghjklmnpqrstvwxz]{3,}"),
        "marks": share("[^A-Za-z0-9]"),
        "prose": F.regexp_count(F.concat_ws(" ", "before", "after"), F.lit(r"(?<![^\s])\p{L}{2,}+(?=[\s,.;!?]|$)")).cast("double"),
        "coverage": F.coalesce(F.col("known"), F.lit(0)) / F.length(t),
        "path": flag(t.contains("/") | F.rlike("before", F.lit(r"[/\\.@#?&-]$")) | F.rlike("after", F.lit(r"^[/\\@]|^\.\w"))),
        "assigned": flag(F.rlike("before", F.lit(r"[:=]\s*[\"'`]?$"))),
        "quoted": flag(F.rlike("before", F.lit("[\"'`]$")) & F.rlike("after", F.lit("^[\"'`]"))),
        "named": flag(F.rlike("before", F.lit(NAMES + r"\W*$"))),
        "format": flag(F.rlike(t, F.lit(FORMATS))),
    }).drop("known")


def format_label() -> Column:
    """1 where a published format or an assignment to a telling name says secret, 0 elsewhere and for look-alikes.

    Null, so no label, for other values of one dictionary word or of letters alone that a telling name is given.
    """
    told = F.rlike("before", F.lit(f"{TOLD}[\"'`]?$")) | (F.rlike("before", F.lit(LOGIN + "$")) & F.startswith("after", F.lit("@")))
    plain = F.rlike("token", F.lit(LOOKALIKE)) | ((F.col("coverage") >= 0.999) & ~F.col("quoted").cast("boolean"))
    return (F.when(F.rlike("token", F.lit(FORMATS)), 1.0).when(~F.coalesce(told, F.lit(False)), 0.0).when(plain, 0.0)
            .when(F.rlike("token", F.lit(r"^\p{L}+$")), F.lit(None)).otherwise(1.0))


def planted(like: DataFrame) -> DataFrame:
    """Look-alikes and passwords after a telling name, as findings of ``like``'s columns that format_label labels."""
    spark = like.sparkSession
    draw = lambda i: (i * 0x9E3779B97F4A7C15) % (1 << 64) << 64 | (i * 0xD1342543DE82EF95) % (1 << 64)
    mark = lambda i, n: f"{draw(i):032x}"[:n]
    tokens = [t + mark(i + 1, n) for t, n in HARD for i in range(VARIANTS)]
    tokens += ["-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32])) for h in (mark(i + 99, 32) for i in range(4 * VARIANTS))]
    letters = string.ascii_letters + string.digits + "!#%&"
    tokens += ["".join(letters[draw(i + 999) >> 7 * k & 63] for k in range(7 + i % 9)) + str(i % 10) for i in range(8 * VARIANTS)]
    rows = [(None, i, 0, t, 0, ("secret: ", "token = ", "password=")[i % 3], " and") for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "doc_id bigint, mark bigint, k int, token string, start bigint, before string, after string").select(*like.columns)


def fit(featured: DataFrame, label: Column | None = None, inputs: list[str] | None = None, trees: int = 20, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel | float:
    """A forest over ``inputs`` on at most SAMPLE_ROWS labelled findings; with one class, the share of secrets.

    Without a label column, signs label the findings and are no inputs.
    """
    inputs = inputs or (SHAPE if label is None else FEATURES)
    known = featured.withColumn("label", format_label() if label is None else label.cast("double")).where("label is not null")
    by = F.xxhash64("doc_id", "mark", "k")
    # one partition of bounded size in a fixed order: reruns draw the same trees
    rows = C.settle(known.orderBy(by, "doc_id", "mark", "k").limit(SAMPLE_ROWS).select("label", *inputs).coalesce(1))
    n, s = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or s in (0, n):
        return float(s / n) if n else 0.0
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2)
    return forest.fit(VectorAssembler(inputCols=inputs, outputCol="x").transform(rows))


def score(featured: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """Add ``score``, the forest's share for secret."""
    if isinstance(model, float):
        return featured.withColumn("score", F.lit(model))
    put = model.setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("")
    inputs = SHAPE if model.numFeatures == len(SHAPE) else FEATURES
    return put.transform(VectorAssembler(inputCols=inputs, outputCol="__x").transform(featured)).withColumn(
        "score", vector_to_array("__p")[1]).drop("__x", "__p")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, token, start, score, secret) for every candidate of every text.

    ``labelled`` has (token, before, after, label) of reviewed findings.  Null and empty texts have
    no candidates; rows equal in id and text have one set of findings.
    """
    found = C.settle(candidates(docs, id_col, text_col))
    words = C.settle(dictionary(docs, text_col))
    featured = with_features(found, words)
    if labelled is None:
        model = fit(with_features(found.unionByName(planted(found)), words))
    else:
        given = labelled.select(F.lit(None).cast("bigint").alias("doc_id"), F.xxhash64("token", "before", "after").alias("mark"), F.lit(0).alias("k"),
                                "token", "before", "after", F.lit(0).cast("bigint").alias("start"), F.col("label").cast("double").alias("given"))
        model = fit(with_features(given.dropDuplicates(["mark"]), words), F.col("given"))
    return score(featured, model).select("doc_id", "mark", "token", "start", "score", (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, found: DataFrame, by: str = "<secret>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every found secret replaced in its text; all rows stay.

    A secret is replaced where it was found, one of LONG code points wherever it stands in the text.
    """
    tokens = found.where("secret").groupBy("doc_id", "mark").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), "token")).alias("__tokens")).withColumnsRenamed(
        {"doc_id": "__id", "mark": "__mark"})
    last_first = F.reverse(F.array_sort("__tokens"))
    cut = F.aggregate(last_first, F.col(text_col), lambda a, x: F.concat(
        F.substr(a, F.lit(1), x["start"]), F.lit(by), F.substr(a, x["start"] + F.length(x["token"]) + 1)))
    long = F.array_distinct(F.filter(F.transform("__tokens", lambda x: F.struct(F.length(x["token"]).alias("n"), x["token"].alias("t"))), lambda x: x["n"] >= LONG))
    text = F.aggregate(F.reverse(F.array_sort(long)), cut, lambda a, x: F.replace(a, x["t"], F.lit(by)))
    keyed = docs.withColumn("__m", F.xxhash64(text_col))
    out = keyed.join(tokens, F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    return out.withColumn(text_col, F.when(F.col("__tokens").isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)
