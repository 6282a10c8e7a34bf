"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions throughout.

Candidates are private-key headers, what follows an assignment sign, and runs of key-like characters with a digit. The
forest (Spark ML) is trained from labelled findings: columns value, before, after, path, label. It sees length, shares
and transitions of character classes, entropy, dictionary coverage, the path and the neighbouring words. A fitted forest
is one SQL expression, the share of trees that vote for a secret, so a scan is a projection: one pass over the texts, no
shuffle, no row for each candidate until the caller asks for it.

Defined cases: null or empty texts have no findings; a null path is empty; every place where a candidate
is found is a finding of its own, judged by the words around it, with a count of the string in the text; a string that is
a secret in one place is replaced in all; repeated rows have equal findings; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table

TREES, DEPTH, SEED, THRESHOLD = 25, 6, 42, 0.5
#: Rows of the default labelled findings.
EXAMPLES = 6000
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?<=[=:]|[=:][\"']|[=:] |[=:] [\"'])[^\s\"'<>,;=:]{8,}+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
#: Forms of well-known keys.
KINDS = {"private_key": r"^-----BEGIN", "access_key": r"^(AKIA|ASIA)[0-9A-Z]{16}$", "provider_token": r"^(gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|glpat-|npm_)"}
#: Words that stand in placeholders, identifiers and prose.
DICTIONARY = "example sample test demo dummy change placeholder your here insert password secret token key user name admin default none null true false value string config path file image version build release page index data table column order item test foo bar baz lorem ipsum hello world http https www com org the and for with from this that".split()
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|credential|private|bearer)[^\n]{0,12}$"
OTHER_WORDS = r"(?i)(sha\d*|md5|commit|checksum|digest|hash|uuid|guid|version|revision|integrity|etag|card|phone|tel|order|invoice|isbn|serial|build|ref|https?)\W{0,4}$"
QUIET_PATHS = r"(?i)(test|spec|example|sample|fixture|mock|doc|vendor|lock|readme|dist)"


def share(pattern: str) -> str:
    return f"regexp_count($v, r'{pattern}') / length($v)"


#: Name and SQL over $v (value), $before, $after, $path.
FEATURES = {
    "length": "length($v)",
    "digits": share("[0-9]"),
    "upper": share("[A-Z]"),
    "lower": share("[a-z]"),
    "letter_to_digit": share("[A-Za-z](?=[0-9])"),
    "digit_to_letter": share("[0-9](?=[A-Za-z])"),
    "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
    "vowel_changes": share("(?i)[aeiou](?=[bcdfghj-np-tv-z])|[bcdfghj-np-tv-z](?=[aeiou])"),
    "repeats": share(r"(.)(?=\1)"),
    "separators": share("[-_./]"),
    "hex_only": "CAST($v RLIKE '^[0-9a-fA-F]+$' AS INT)",
    "digits_only": "CAST($v RLIKE '^[0-9-]+$' AS INT)",
    "uuid": "CAST($v RLIKE '^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$' AS INT)",
    "distinct": "size(array_distinct(split($v, ''))) / length($v)",
    "entropy": "-aggregate(transform(array_distinct(split($v, '')), c -> (length($v) - length(replace($v, c, ''))) / length($v)), 0D, (s, p) -> s + IF(p > 0, p * log2(p), 0))",
    "dictionary": f"1 - length(regexp_replace(lower($v), '{'|'.join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))}', '')) / length($v)",
    "known_form": f"CAST($v RLIKE '{'|'.join(KINDS.values())}' AS INT)",
    "secret_word": f"CAST($before RLIKE r'{SECRET_WORDS}' AS INT)",
    "other_word": f"CAST($before RLIKE r'{OTHER_WORDS}' AS INT)",
    "assigned": r"""CAST($before RLIKE r'[=:]\s*["\x27]?$' AS INT)""",
    "quoted": r"""CAST($before RLIKE r'["\x27]$' AND $after RLIKE r'^["\x27]' AS INT)""",
    "quiet_path": f"CAST($path RLIKE '{QUIET_PATHS}' AS INT)",
}


def features_sql(source: str, path: str = "path") -> str:
    """named_struct of all features of a struct with value, before, after; path is a column."""
    sql = ", ".join(f"'{name}', CAST({sql} AS DOUBLE)" for name, sql in FEATURES.items())
    return f"named_struct({sql})".replace("$before", f"{source}.before").replace("$after", f"{source}.after").replace("$path", path).replace("$v", f"{source}.value")


def labelled_examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Labelled findings made by rule: keys of usual forms in their usual places, and what is often mistaken for them."""
    base = spark.range(n, numPartitions=2).select("id", F.sha2(F.concat(F.lit("finding"), "id"), 512).alias("h"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("r"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)).alias("s"))
    words = F.array(*map(F.lit, DICTIONARY))
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    alnum = F.translate(F.base64(F.unhex("h")), "+/=", "xY7")
    positive = [
        (F.substring("h", 1, 40), ['token = "', "token: ", "secret=", "auth_token=", "password="]),
        (F.substring("h", 1, 32), ["api_key=", "password=", "secret: ", 'passwd = "']),
        (F.substring("h", 1, 12), ["password=", "passwd=", "pwd: ", 'password = "']),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), ["", "aws_access_key_id = ", "key: ", "the of "]),
        (F.substring(alnum, 1, 40), ["aws_secret_access_key = ", 'secret = "', "token=", "Bearer "]),
        (F.concat(F.lit("ghp_"), F.substring(alnum, 3, 36)), ["", "token: ", 'auth = "']),
        (F.substring(alnum, 5, 14), ["password: ", 'password="', "pwd="]),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), ["", "key: ", "\n"]),
    ]
    digits = F.translate("h", "abcdef", "314159")
    negative = [
        (F.substring(digits, 1, 16), ["", "card ", "order: ", "id="]),
        (F.substring("h", 1, 40), ["commit ", "sha1: ", "revision=", "checksum: "]),
        (F.substring("h", 1, 64), ["sha256:", "digest: ", "integrity="]),
        (F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), ["uuid: ", "id=", "", "guid="]),
        (F.concat_ws("_", word(3), word(4), F.pmod("r", F.lit(9))), ["password=", "token = ", "name: ", "api_key: "]),
        (F.concat_ws("-", F.lit("your"), word(5), F.lit("here"), F.pmod("r", F.lit(9))), ['token = "', "secret=", "api_key: "]),
        (F.concat(word(3), word(4), word(5), word(6)), ["note: ", "title=", "see: ", "password: "]),
        (F.concat(F.lit("//www."), word(3), F.lit(".com/"), word(4), F.lit("/"), F.substring(digits, 1, 5)), ["https:", "http:"]),
        (F.concat(word(3), F.lit("/"), word(4), F.lit("/"), word(5), F.pmod("s", F.lit(100))), ["path=", "file: ", ""]),
        (F.concat(F.repeat(F.lit("x"), 12), F.pmod("r", F.lit(10))), ["password=", "key: "]),
        (F.concat(word(3), F.substring(digits, 1, 4), word(4), word(6)), ["", "id=", "name: "]),
        (F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 8)), ["", "tel ", "phone: "]),
    ]

    def pick(forms):
        value = F.lit(None).cast("string")
        before = F.lit(None).cast("string")
        for i, (v, places) in enumerate(forms):
            here = F.pmod("r", F.lit(len(forms))) == i
            value = F.when(here, v).otherwise(value)
            before = F.when(here, F.element_at(F.array(*map(F.lit, places)), (F.pmod("s", F.lit(len(places))) + 1).cast("int"))).otherwise(before)
        return value, before

    (pv, pb), (nv, nb) = pick(positive), pick(negative)
    secret = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)) == 1
    out = base.select("id", F.when(secret, pv).otherwise(nv).alias("value"), F.concat(word(7), F.lit(" "), F.when(secret, pb).otherwise(nb)).alias("before"), secret.cast("double").alias("label"), F.when(~secret & (F.pmod("s", F.lit(3)) == 0), F.concat(F.lit("tests/"), word(8))).otherwise(F.concat(F.lit("src"), F.pmod("r", F.lit(20)))).alias("path"))
    return out.withColumn("after", F.when(F.col("before").rlike('"$'), F.lit('"')).otherwise(F.concat(F.lit(" "), word(8)))).drop("id")


@dataclass
class Forest:
    """A fitted forest as SQL: the votes for a secret over a struct `f` of features, as a share."""

    sql: str

    @classmethod
    def train(cls, examples: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rows = examples.select("label", F.coalesce("path", F.lit("")).alias("path"), F.struct(F.coalesce("value", F.lit("")).alias("value"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after")).alias("x")).where(F.length("x.value") > 0)
        table = rows.select("label", F.expr(features_sql("x")).alias("f")).select("label", "f.*")
        fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table))
        names = list(FEATURES)
        return cls(f"({' + '.join(tree_sql(t.toDebugString, names) for t in fitted.trees)}) / {trees}D")


def tree_sql(description: str, names: list[str]) -> str:
    """SQL of one tree from its printed form."""
    lines = [x.strip() for x in description.splitlines()[1:] if x.strip()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return f"{float(line.split(':')[1])}D"
        feature, bound = line.removeprefix("If (feature ").rstrip(")").split(" <= ")
        yes = node()
        at += 1  # the line of Else
        return f"IF(y.f.{names[int(feature)]} <= {float(bound)!r}D, {yes}, {node()})"

    return node()


def scan(docs: DataFrame, forest: Forest, out: str, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs with a column `out`: array of (value, kind, at, n_found, score, is_secret), one for each place of a candidate."""
    text, path, strings = fresh(docs, "scanned_text"), fresh(docs, "scanned_path"), fresh(docs, "scanned_strings")
    kind = "CASE " + " ".join(f"WHEN o.c RLIKE '{p}' THEN '{k}'" for k, p in KINDS.items()) + " ELSE 'token' END"
    gaps = F.split(text, CANDIDATE, -1)
    # Each match begins where the gaps and matches before it end.
    added = F.zip_with(F.slice(gaps, F.lit(1), F.size(strings)), F.col(strings), lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("v")))
    state = lambda end, at: F.struct(end.alias("end"), at.alias("at"))
    places = F.aggregate(added, state(F.lit(0), F.array().cast("array<int>")), lambda s, x: state(s["end"] + x["g"] + x["v"], F.concat(s["at"], F.array(s["end"] + x["g"] + 1))), lambda s: s["at"])
    one = f"named_struct('value', o.c, 'kind', {kind}, 'at', o.at, 'n_found', CAST((length({text}) - length(replace({text}, o.c, ''))) / length(o.c) AS INT), 'before', substring({text}, greatest(1, o.at - 40), least(40, o.at - 1)), 'after', substring({text}, o.at + length(o.c), 16))"
    found = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(path, F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit(""))
    found = found.withColumn(strings, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    found = found.withColumn(out, F.zip_with(strings, places, lambda c, at: F.struct(c.alias("c"), at.alias("at"))))
    featured = f"named_struct('value', x.value, 'kind', x.kind, 'at', x.at, 'n_found', x.n_found, 'f', {features_sql('x', path)})"
    scored = f"named_struct('value', y.value, 'kind', y.kind, 'at', y.at, 'n_found', y.n_found, 'score', {forest.sql})"
    judged = f"named_struct('value', z.value, 'kind', z.kind, 'at', z.at, 'n_found', z.n_found, 'score', z.score, 'is_secret', z.score >= {THRESHOLD})"
    sql = f"transform(transform(transform(transform({out}, o -> {one}), x -> {featured}), y -> {scored}), z -> {judged})"
    return found.withColumn(out, F.expr(sql)).drop(text, path, strings)


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs with every secret replaced by its kind in brackets, longest first; n_chars follows where there is such a column."""
    found = fresh(docs, "findings")
    longest = f"array_sort(array_distinct(transform(filter({found}, x -> x.is_secret), x -> named_struct('value', x.value, 'kind', x.kind))), (a, b) -> IF(length(a.value) <> length(b.value), length(b.value) - length(a.value), IF(a.value < b.value, -1, IF(a.value > b.value, 1, 0))))"
    clean = f"aggregate({longest}, {text_col}, (t, x) -> replace(t, x.value, concat('[', x.kind, ']')))"
    out = scan(docs, forest, found, text_col, path_col).withColumn(text_col, F.expr(clean)).drop(found)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_col)).cast(kind))
    return out.select(*docs.columns)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, at (1-based character), length, n_found, value_sha256, score, is_secret for each place of a candidate; values are not shown."""
    docs = read_table(spark, sf_dir, "documents")
    found = scan(docs, Forest.train(labelled_examples(spark)), "findings").select(F.col("doc_id").cast("long"), F.explode("findings").alias("x"))
    return found.select("doc_id", "x.kind", F.col("x.at").cast("long").alias("at"), F.length("x.value").cast("long").alias("length"), "x.n_found", F.sha2("x.value", 256).alias("value_sha256"), "x.score", "x.is_secret")


def stage_redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return redact(docs, Forest.train(labelled_examples(spark)))
