"""Secret scan: candidate words, features, and a random forest that takes out false positives. DataFrame functions only.

A candidate is a word of at least 12 characters with a digit, or of at least 8 that follows or holds a key word and `=` or
`:`, or that holds an access key id. Its value is the word without the key, quotes and closing punctuation. Features: length, kinds of characters and the
transitions between them, distinct characters, the share of the value's letter trigrams that occur in dictionary words,
whether the path looks like tests or documentation, and whether the neighbouring words name a secret or an example. The
dictionary is the corpus's own: all words of letters that make up at least FREQUENT of its words (so at most 1 / FREQUENT).

The forest (pyspark.ml) is fitted on labelled findings: of each label those distinct feature rows whose hash lies under a
share that lets about FIT_FINDINGS of them in.
`format_labels` labels findings whose format leaves no doubt; findings without a label take no part in the fit but are
judged like all others. The formats themselves are no features.

Defined cases: null text has no candidates; null path looks like neither; repeated rows give repeated findings; if only one
label (or none) is there to learn from, every finding is kept and has score null; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .store import stage

FIT_FINDINGS = 20_000
FREQUENT = 1e-5
TREES, DEPTH = 20, 6
KEY_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|auth|credential|private_?key)"
ACCESS_KEY = "(AKIA|ASIA)[A-Z0-9]{16}"
EXAMPLE_WORDS = r"(?i)(example|sample|dummy|placeholder|test|fake|changeme)"
EXAMPLE_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|mocks?|docs?|fixtures?|vendor)([/_.-]|$)"

# Formats that leave no doubt.
SECRET_FORMATS = [
    r"^(AKIA|ASIA)[A-Z0-9]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36,}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$", r"^sk_live_[A-Za-z0-9]{16,}$",
    r"^AIza[A-Za-z0-9_-]{35}$", r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$",
]
HARMLESS_FORMATS = [
    r"^[0-9]+$", r"^[^@]+@[^@]+\.[A-Za-z]+$", r"^\d{1,3}(\.\d{1,3}){3}$", r"^\d{4}-\d{2}-\d{2}", r"^(https?:)?//", r"^\+?[0-9() .-]+$",
    r"^[A-Za-z]+[0-9]{1,4}$",
]
KEYED_VALUE = r"^([0-9a-fA-F]{16,}|[A-Za-z0-9+/_-]{24,}=*)$"
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "transitions", "distinct_share", "hex_only", "coverage", "keyed", "key_before",
    "example_near", "example_path",
]


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """(id, path, place, word, value, before, after): place counts words from 0."""
    words = F.split(F.trim(F.regexp_replace(F.col(text_column), r"[\x20\x09-\x0D]+", " ")), " ")
    told = docs.filter(F.col(text_column).rlike(f"[0-9=:]|{ACCESS_KEY}")).select(
        F.col(id_column).alias("id"), F.col(path_column).cast("string").alias("path"), words.alias("words")
    )
    w, key_end = F.col("words"), KEY_WORDS + r"\w*[\"']?\s*[=:]"

    def chosen(i: Column) -> Column:
        word, one, two = F.get(w, i), F.coalesce(F.get(w, i - 1), F.lit("")), F.coalesce(F.get(w, i - 2), F.lit(""))
        keyed = word.rlike(key_end + ".{6,}") | one.rlike(key_end + "$") | (one.rlike(r"^[=:]$") & two.rlike(KEY_WORDS + r"\w*$"))
        return (F.length(word) >= 8) & (((F.length(word) >= 12) & word.rlike(f"[0-9]|{ACCESS_KEY}")) | keyed)

    found = told.select(
        "id", "path",
        F.explode(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(w) - 1), chosen),
                lambda i: F.struct(
                    i.alias("place"), F.get(w, i).alias("word"),
                    F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1)).alias("before"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("after"),
                ),
            )
        ).alias("one"),
    ).select("id", "path", "one.*")
    bare = F.regexp_replace("word", r"^[\"'(\[<]*([A-Za-z_][\w-]*[=:])?[\"'(\[<]*", "")
    return found.withColumn("value", F.regexp_replace(bare, r"[\"')\],;.!?|*$%&#<>]+$", ""))


def dictionary(docs: DataFrame, text_column: str = "text", frequent: float = FREQUENT) -> DataFrame:
    """(gram): letter trigrams of the frequent words of all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_column)), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    counts = stage(words.groupBy("word").agg(F.count("*").alias("n")), "dictionary")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") >= frequent * total).select(F.explode(grams("word")).alias("gram")).distinct()


def grams(text: str) -> Column:
    """All trigrams of letters of a column, lower-cased."""
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3)))
    return F.filter(every, lambda g: g.rlike(r"^\p{L}{3}$"))


def features(found: DataFrame, known_grams: DataFrame) -> DataFrame:
    """found (a written table with a unique row_no) with the columns of FEATURES."""
    v = F.col("value")
    covered = (
        found.select("row_no", F.explode(grams("value")).alias("gram")).join(known_grams.withColumn("known", F.lit(1)), "gram", "left")
        .groupBy("row_no").agg((F.count("known") / F.count("*")).alias("share"))
    )
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^a-zA-Z0-9]", "_"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double") / F.greatest(F.length(v), F.lit(1))
    near = F.concat_ws(" ", "before", "word", "after")
    return found.join(covered, "row_no", "left").select(
        *found.columns,
        F.length(v).cast("double").alias("length"), count("[0-9]").alias("digits"), count("[A-Z]").alias("uppers"), count("[a-z]").alias("lowers"),
        count("[^a-zA-Z0-9]").alias("others"),
        F.regexp_count(kinds, F.lit("a(?=[^a])|A(?=[^A])|9(?=[^9])|_(?=[^_])")).cast("double").alias("transitions"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.length(v), F.lit(1))).cast("double").alias("distinct_share"),
        flag(v.rlike("^[0-9a-fA-F]+$") & v.rlike("[a-fA-F]")).alias("hex_only"), F.coalesce("share", F.lit(0.0)).alias("coverage"),
        flag(F.col("word").rlike(KEY_WORDS + r"\w*[\"']?[=:]")).alias("keyed"), flag(F.col("before").rlike(KEY_WORDS)).alias("key_before"),
        flag(near.rlike(EXAMPLE_WORDS)).alias("example_near"), flag(F.col("path").rlike(EXAMPLE_PATH)).alias("example_path"),
    )


def format_labels(found: DataFrame) -> Column:
    """1 for a certain secret, 0 for a certain false positive, null for all others."""
    v = F.col("value")
    named = (F.col("keyed") + F.col("key_before") > 0) & v.rlike(KEYED_VALUE) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    any_of = lambda patterns: F.greatest(*[v.rlike(p) for p in patterns])
    return F.when(any_of(SECRET_FORMATS) | named, 1).when(any_of(HARMLESS_FORMATS), 0).cast("double")


def fit(labelled: DataFrame, most: int = FIT_FINDINGS, seed: int = 11) -> RandomForestClassificationModel | None:
    """labelled: columns of FEATURES and label. None if there are not two labels."""
    distinct = stage(labelled.filter("label is not null").select("label", *FEATURES).distinct(), "findings")
    counts = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(most / n)) for k, n in counts.items()])
    sample = distinct.filter(place < share)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, labelCol="label").fit(ready)


def judge(found: DataFrame, model: RandomForestClassificationModel | None, least: float = 0.5) -> DataFrame:
    """found with score (probability of a secret) and is_secret."""
    if model is None:
        return found.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    told = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    scored = told.withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= least).select(*found.columns, "score", "is_secret")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """Findings of all documents: id, path, place, word, value, before, after, FEATURES, label, score, is_secret."""
    found = stage(
        candidates(docs, id_column, text_column, path_column).withColumn("row_no", F.monotonically_increasing_id()), "candidates"
    )
    told = features(found, dictionary(docs, text_column))
    told = stage(told.withColumn("label", format_labels(told)), "findings")
    return judge(told, fit(told)).drop("row_no").withColumnRenamed("id", id_column)
