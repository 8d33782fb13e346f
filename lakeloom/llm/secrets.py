"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything here is DataFrame or SQL functions.  The forest is trained with Spark's own learner on
labelled findings and then written out as one column expression, so it is applied inside the scan:
no shuffle, no row leaves its document.
"""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import unused

CONTEXT = 48
KEYWORDS = "token|secret|passwd|password|passphrase|pwd|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|signature"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abpr]-|sk_live_|rk_live_|sk-|AIza|eyJ|npm_|pypi-"
#: Passwords in URLs, quoted values of assignments, values assigned to a keyword, quoted or not, and runs of token
#: characters.  No candidate starts behind a token character, so most places of a text cost one short look back.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?:"
    r"(?<=:)(?<=://[^\s:/@\"']{0,40}:)[^\s/\"']{3,}(?=@)"
    r"|(?<=[=:>]\s{0,1}[\"'])[^\s\"']{8,}+"
    rf"|(?<=[=:>]\s{{0,2}}[\"'`]?)(?<=(?i:{KEYWORDS})s?(?:[_-]\w{{0,16}})?[\"'`]?\s{{0,2}}(?:=>|:=|=|:)\s{{0,2}}[\"'`]?)[^\s\"'`]{{5,}}[^\s\"'`,;.)\]}}>]"
    r"|[A-Za-z0-9+/_-]{16,}+={0,2})"
)
#: Words whose share of a candidate speaks for a name, a path or a placeholder.
DICTIONARY = "example|sample|test|dummy|changeme|change|your|here|placeholder|insert|replace|default|foo|bar|xxx|todo|none|null|undefined|user|name|file|path|home|index|page|version|build|config|static|image|content|document|article|service|server|client|manager|factory|handler|value|string|number|data|code|public|local|http|www|com|org|net|html|the|and|ing|tion|ment|heit|keit|lich|ung|eau|eux|con|ent|est|ter|ver|ist|ble|her|ate|all"
FEATURES = ("length", "digits", "uppers", "transitions", "distinct", "vowels", "dictionary", "hex", "longest_letters", "path", "url", "assigned", "keyword", "quoted", "prefix", "commit", "separators", "in_url")
TREES, DEPTH, THRESHOLD = 24, 6, 0.5


def feature_columns(value: Column, left: Column, right: Column) -> list[Column]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of a candidate."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    low = F.lower(value)
    share = lambda pattern: 1.0 - F.length(F.regexp_replace(value, F.lit(pattern), F.lit(""))) / size
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    runs = F.regexp_extract_all(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))
    letters = F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    return [
        size,
        share("[0-9]"),
        share("[A-Z]"),
        F.size(runs) / size,
        F.size(F.array_distinct(F.split(low, ""))) / size,
        share("[aeiouAEIOU]"),
        1.0 - F.length(F.regexp_replace(low, F.lit(DICTIONARY), F.lit(""))) / size,
        flag(value.rlike("^[0-9a-fA-F]+$")),
        F.coalesce(F.array_max(F.transform(letters, lambda x: F.length(x))), F.lit(0)).cast("double"),
        flag(value.contains("/") | left.rlike(r"[/\\]$") | right.rlike(r"^[/\\.]\w")),
        flag(left.rlike(r"(?i)(https?:|www\.)\S*$")),
        flag(left.rlike(r"[=:]>?\s{0,2}[\"'`]?$")),
        flag(left.rlike(rf"(?i)({KEYWORDS})s?(?:[_-]\w{{0,16}})?\W{{0,6}}$")),
        flag(right.rlike("^[\"'`]")),
        flag(value.rlike(f"^({PREFIXES})")),
        flag(left.rlike(r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|rev|revision|uuid|guid|id|etag|version|blob|tree)\W{0,4}$")),
        share("[/_=+-]"),
        flag(left.rlike(r"://[^\s:/@]{0,40}:$") & right.startswith("@")),
    ]


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(candidate, text before, text after, 1 for a secret): made by rule, half of them false positives."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "the and ing tion ent er re on an in es en heit keit lich ung eau eux ment ci le ver ra do".split()
    take = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 5)))
    hexes = lambda k: hashlib.sha512(str(r.random()).encode()).hexdigest()[:k]
    prose = lambda: " ".join(word() for _ in range(4)) + r.choice([" ", " ", ": ", "\n"])
    out = []
    for i in range(n):
        quote = r.choice(['"', '"', "'", ""])
        key = r.choice(["token", "secret", "password", "api_key", "apiKey", "ACCESS_KEY", "auth_token", "client_secret", "db_password", "TOKEN"])
        assign = prose() + key + r.choice([" = ", "=", ": ", ' => "'[:4], ":"]) + quote
        after = quote + r.choice([" ", "\n", "", "### ", ", "]) + word()
        if i % 2:
            kind = r.randrange(7)
            if kind == 0:
                value = hexes(r.choice([32, 40, 40, 64]))
            elif kind == 1:
                value = take(alnum, r.randint(20, 48))
            elif kind == 2:
                value = take(alnum + "+/", r.choice([28, 40, 44, 64])) + r.choice(["", "=", "=="])
            elif kind == 3:
                value = r.choice(["AKIA" + take(alnum[:26] + alnum[52:], 16), "ghp_" + take(alnum, 36), "sk_live_" + take(alnum, 24), "xoxb-" + take("0123456789", 12) + "-" + take(alnum, 24), "AIza" + take(alnum + "_-", 35)])
                if r.random() < 0.5:
                    assign, after = prose(), " " + word()
            elif kind == 4:
                value = take(alnum + "!@#$%^&*", r.randint(10, 18))
            else:
                value = r.choice([word()[: r.randint(4, 8)] + take("0123456789", r.randint(1, 4)) + take(alnum[26:], r.randint(1, 4)), word()[:3].capitalize() + take("0123456789", 2) + word()[:4] + r.choice("!@#$%^&*") + take("0123456789", 1), take(alnum, r.randint(8, 15))])
                if kind == 6:
                    assign, after = prose() + r.choice(["postgres", "mysql", "redis", "https", "amqp", "mongodb+srv"]) + "://" + r.choice(["user", "admin", word()]) + ":", "@" + word() + r.choice([".example.org/", ":5432/", "/"]) + word()
            if kind < 3 and r.random() < 0.25:
                value, assign = value.upper() if kind == 0 else value, assign.upper()
            out.append((value, assign[-CONTEXT:], after[:CONTEXT], 1))
            continue
        kind = r.randrange(11)
        left, right = prose(), " " + word()
        if kind == 0:
            value, left = hexes(40), prose() + r.choice(["commit ", "rev ", "sha1: ", "blob/"])
        elif kind == 1:
            value, left = hexes(r.choice([32, 64])), prose() + r.choice(["sha256:", "md5 = ", "checksum: ", "etag: ", "digest="])
        elif kind == 2:
            h = hexes(32)
            value, left = "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]]), prose() + r.choice(["id ", "uuid: ", ""])
        elif kind == 3:
            value = take("0123456789", r.choice([16, 16, 17, 19, 20]))
        elif kind == 4:
            value, left = "/".join([word(), word(), word() + str(r.randint(1, 99))]), prose() + r.choice(["/", "https://www.", "../", "src/"])
        elif kind == 5:
            value = word() + word() + word()
            value = value if len(value) >= 16 else value + word() + "lichkeit"
            value = r.choice([value, value.capitalize(), value.upper(), value + r.choice(["_2", "-v1", "2024"])])
        elif kind == 6:
            value, left, right = r.choice(["your_api_key_here", "example_token_1234", "changeme-placeholder", "xxxxxxxxxxxxxxxxxxxx", "insert-your-secret-here", "test_test_test_1234", "dummy-password-value"]), assign[-CONTEXT:], after
        elif kind == 7:
            value, left = "-".join(word() for _ in range(4)), prose() + "https://example.org/en/" + str(r.randint(1, 9999)) + "/"
        elif kind == 8:
            value, left, right = r.choice([word(), word() + r.choice(["-", "_", "/"]) + word(), word().capitalize()]) + r.choice(["", "", "ing", "tion"]), assign[-CONTEXT:], after
            value = value if len(value) >= 6 else value + "lichkeit"
        elif kind == 9:
            value, left, right = r.choice(["os.environ[", "${" + word().upper() + "}", "$" + word().upper(), "config." + word(), "get_" + word() + "(", "self." + word() + "_" + word(), "process.env." + word().upper(), "<" + word() + ">", "{{" + word() + "}}"]), assign[-CONTEXT:], after
        else:
            value = r.choice(["----", "====", "____"]) * r.randint(4, 12) if r.random() < 0.5 else "_".join([word(), word(), word()])
        out.append((value, left[-CONTEXT:], right[:CONTEXT], 0))
    return out


@lru_cache(maxsize=4)
def _trees(app: str, trees: int, depth: int, seed: int) -> tuple:
    """The fitted trees as nested tuples: (feature, threshold, left, right) or a leaf's probability."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(labelled_findings(), "value string, left string, right string, label int").coalesce(1)
    named = rows.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in zip(FEATURES, feature_columns(F.col("value"), F.col("left"), F.col("right")))])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(named).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(data)

    def walk(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return (stats[1] + 0.0) / (stats[0] + stats[1])
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return tuple(walk(t._call_java("rootNode")) for t in model.trees)


def forest(spark: SparkSession, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> tuple:
    return _trees(spark.sparkContext.applicationId, trees, depth, seed)


def evaluate(model: tuple, x: list[float]) -> float:
    """Plain evaluation of a forest, for tests."""
    total = 0.0
    for node in model:
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        total += node
    return total / len(model)


def forest_column(model: tuple, features: Column) -> Column:
    """Mean leaf probability of all trees over an array of feature values."""

    def walk(node):
        if not isinstance(node, tuple):
            return F.lit(float(node))
        return F.when(features[node[0]] <= float(node[1]), walk(node[2])).otherwise(walk(node[3]))

    total = walk(model[0])
    for tree in model[1:]:
        total = total + walk(tree)
    return total / float(len(model))


def running_sum(sizes: Column) -> Column:
    """Sums of an array up to each place, by doubling: n log n steps, where a fold that appends takes n squared."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(2)))).cast("int") - 1)

    def add(sums: Column, k: Column) -> Column:
        ahead = F.concat(F.array_repeat(F.lit(0), F.call_function("shiftleft", F.lit(1), k)), sums)
        return F.zip_with(sums, F.slice(ahead, F.lit(1), F.size(sums)), lambda a, b: a + b)

    return F.aggregate(steps, sizes, add)


def candidates(docs: DataFrame, text: str, found: str, tail: str) -> DataFrame:
    """``docs`` with ``found``, the array of (start, value, before, left, right) of each candidate of a text, and the text after the last.

    ``before`` is the text since the candidate before it; start counts characters from 0.  A null or
    empty text has no candidates.  Work and memory follow the text: each array is made once.
    """
    parts = docs.select("*", F.coalesce(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>")).alias(found))
    some = F.size(found) > 0
    between = unused(parts, "__between")
    parts = parts.withColumn(between, F.when(some, F.split(F.col(f"`{text}`"), CANDIDATE, -1)))
    ends = unused(parts, "__ends")
    parts = parts.withColumn(ends, F.when(some, running_sum(F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.col(found), lambda b, v: F.length(b) + F.length(v)))))
    rows = F.arrays_zip(F.col(found).alias("value"), F.slice(between, F.lit(1), F.size(found)).alias("before"), F.slice(between, F.lit(2), F.size(found)).alias("after"), F.col(ends).alias("ends"))
    made = F.transform(rows, lambda r: F.struct((r["ends"] - F.length(r["value"])).alias("start"), r["value"].alias("value"), r["before"].alias("before"), F.right(r["before"], F.lit(CONTEXT)).alias("left"), F.left(r["after"], F.lit(CONTEXT)).alias("right")))
    kept = [c for c in docs.columns]
    return parts.select(*[F.col(f"`{c}`") for c in kept], F.when(some, made).alias(found), F.when(some, F.element_at(between, -1)).alias(tail))


def scored(docs: DataFrame, text: str, found: str, tail: str) -> DataFrame:
    """``candidates`` with the forest's probability as ``score`` of each candidate, and its features as ``x``."""
    model = forest(docs.sparkSession)
    rows = candidates(docs, text, found, tail)
    featured = rows.withColumn(found, F.transform(found, lambda c: c.withField("x", F.array(*feature_columns(c["value"], c["left"], c["right"])))))
    return featured.withColumn(found, F.transform(found, lambda c: c.withField("score", F.round(forest_column(model, c["x"]), 6))))


def secret_scan(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each candidate: ``(doc_id, start, length, score, is_secret, secret_sha256)``.

    Null and empty texts have no candidates; repeated rows give repeated findings; null ids stay null;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # an outer explode: for another the optimiser would put a filter on the candidates, and all their work once more, at the scan
    each = scored(source, "text", "found", "tail").select("doc_id", F.explode_outer("found").alias("f")).where("f IS NOT NULL")
    return each.select("doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.value").cast("long").alias("length"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).alias("is_secret"), F.sha2("f.value", 256).alias("secret_sha256"))


def redact(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found secret replaced by ``mask``; other texts, and all other columns, are as they were.

    Null and empty texts stay so; repeated rows stay; an empty table stays empty; columns of any name
    may stand beside the text.
    """
    found = unused(docs, "__found")
    tail = unused(docs, "__tail")
    parts = F.transform(found, lambda f: F.concat(f["before"], F.when(f["score"] >= threshold, F.lit(mask)).otherwise(f["value"])))
    cut = F.when(F.exists(found, lambda f: f["score"] >= threshold), F.concat(F.array_join(parts, ""), F.col(tail))).otherwise(F.col(f"`{text}`"))
    rows = scored(docs, text, found, tail)
    return rows.select(*[(cut if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
