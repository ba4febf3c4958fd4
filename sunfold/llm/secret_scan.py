"""Secret scans with a random forest against false positives, in DataFrame and ML operations only.

Words that look like credentials, by a known format, by the name they are assigned to, as a password in an address, as the
start of a private key, or by their mixture of letters and digits, are candidates, found in every whole text. Each is
described by its length, the transitions between kinds of characters, the share that a dictionary covers, the path it was
found at and the words around it. The dictionary has some words of made-up credentials and code, and the corpus' own most
frequent words. A random forest trained on labelled findings says which are secrets. Texts are scanned where they lie; only
words with their counts are shuffled, and the model has a fixed number of trees of a fixed depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that credentials are assigned to, formats of issuers, words of made-up credentials.
_NAMES = r"(?i)(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)"
_FORMATS = r"(?:A3T[A-Z0-9]|AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*|glpat-[A-Za-z0-9_-]{20}"
_DICTIONARY = "example sample test dummy fake placeholder changeme change your here password secret token key user admin root default none null true false name path file version release build commit merge branch http https www com org net lib usr local home share python java node class method value string index config update service server client data date time"
_ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://[^/\s:@]*:([^/\s@]{3,})@"
_MIXED = r"[A-Za-z0-9+/_=-]{16,}"
_SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("length", "transitions", "coverage", "distinct", "digits", "capitals", "letters_only", "path_is_test", "named", "assigned", "known_format", "made_up_nearby", "hex_only")


def _rough() -> str:
    """What a text must hold to be looked at word by word."""
    return f"{_NAMES}|{_MIXED}|{_ADDRESS}|PRIVATE KEY-----|(?i:bearer)"


def corpus_words(docs: DataFrame, text: str, most: int = 400) -> list[str]:
    """The `most` words, of 4 to 12 letters in lower case, that most texts have; of ties the first by code point. A setting of
    the model like its trees: words are counted in all whole texts, combined before the shuffle."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{4,12})\b"), F.lit(1)))).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def candidates(docs: DataFrame, text: str, path: str | None, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns, at (number of the word), value, before (two words), after, path: one row for each candidate."""
    words = F.split(F.trim(F.regexp_replace(text, _SPACE, " ")), " ")
    looks = docs.filter(F.col(text).rlike(_rough())).select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry)), (F.col(path).cast("string") if path else F.lit("")).alias("path"), words.alias("w"))

    def near(i: Column, step: int) -> Column:
        return F.coalesce(F.get(F.col("w"), i + step), F.lit(""))

    def hit(i: Column) -> Column:
        word = near(i, 0)
        mixed = word.rlike(_MIXED) & word.rlike(r"[0-9]")
        named = word.rlike(_NAMES + r"[\w.-]*[\"']?[:=]+[\"']?[^\s\"']{6,}")
        given = (F.length(word) >= 6) & ((near(i, -1).rlike(r"^(?:=|:|:=|=>)$") & near(i, -2).rlike(_NAMES)) | near(i, -1).rlike(_NAMES + r"[\w.-]*[\"']?[:=]+$"))
        key = near(i, -1).rlike("KEY-----$") & near(i, -2).rlike("PRIVATE$") & (F.length(word) >= 16)
        bearer = near(i, -1).rlike(r"(?i)^[\"']?bearer$") & (F.length(word) >= 8)
        return ~word.rlike(r"(?i)^[\"']?(?:bearer|basic|digest)$") & (mixed | named | given | key | bearer | word.rlike(_ADDRESS))

    found = F.filter(F.sequence(F.lit(0), F.size("w") - 1), hit)
    found = F.transform(found, lambda i: F.struct(i.alias("at"), near(i, 0).alias("word"), F.concat_ws(" ", near(i, -2), near(i, -1)).alias("before"), near(i, 1).alias("after")))
    names = [f"c{i}" for i in range(len(carry))]
    out = looks.select(*names, "path", F.explode(found).alias("f")).select(*names, "path", "f.*")
    inner = F.regexp_extract("word", _ADDRESS, 1)
    assigned = F.when(inner != "", inner).otherwise(F.regexp_extract("word", r"^[\"']?([A-Za-z_][\w.-]*)[\"']?[:=]+(?!//)[\"']?(.{6,})$", 2))
    value = F.regexp_replace(F.when(assigned != "", assigned).otherwise(F.col("word")), r"^[^A-Za-z0-9+/_$-]+|[^A-Za-z0-9+/=_-]+$", "")
    name = F.when(inner != "", "password =").otherwise(F.regexp_extract("word", r"^[\"']?([A-Za-z_][\w.-]*[\"']?[:=]+)(?!//)[\"']?.{6,}$", 1))
    return out.select(*names, "path", "at", value.alias("value"), F.trim(F.concat_ws(" ", "before", name)).alias("before"), "after").filter("value <> ''")


def described(found: DataFrame, words: Sequence[str] = ()) -> DataFrame:
    """The candidates with FEATURES; `words` are added to the dictionary."""
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    same = F.regexp_count(kinds, F.lit("(?=aa|AA|00|--)"))
    covered = F.length(F.regexp_replace(F.lower(value), "|".join(sorted({*_DICTIONARY.split(), *words}, key=lambda w: (-len(w), w))), ""))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    made_up = F.concat_ws(" ", F.lower("before"), F.lower("after"), F.lower(value)).rlike(r"example|sample|dummy|fake|placeholder|changeme|your[_-]|commit|sha1|checksum|md5|version|xxxx|1234567")
    out = {
        "length": n,
        "transitions": F.greatest(n - 1 - same, F.lit(0.0)) / n,
        "coverage": 1 - covered / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / n,
        "capitals": F.length(F.regexp_replace(value, "[^A-Z]", "")) / n,
        "letters_only": flag(value.rlike("^[A-Za-z]+$")),
        "path_is_test": flag(F.lower("path").rlike("test|example|sample|fixture|doc|spec")),
        "named": flag(F.col("before").rlike(_NAMES + "|PRIVATE KEY-----|(?i:bearer)")),
        "assigned": flag(F.col("before").rlike(r"[=:]$")),
        "known_format": flag(value.rlike(_FORMATS)),
        "made_up_nearby": flag(made_up),
        "hex_only": flag(value.rlike("^[0-9a-f]{16,}$")),
    }
    return found.withColumns(out)


def labelled_findings(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """Labelled findings by rule: (path, value, before, after, label). Half are credentials as issuers and people write
    them, half what scanners take for credentials: digests, identifiers, paths, numbers, placeholders."""
    a, b = F.sha2(F.concat(F.lit("a"), F.col("id")), 256), F.sha2(F.concat(F.lit("b"), F.col("id")), 256)
    base64 = F.base64(F.unhex(a))
    upper = F.upper(F.translate(F.substring(base64, 1, 24), "+/=", "QZK"))
    plain = F.translate(base64, "+/=", "kq7")
    word = F.element_at(F.split(F.lit("river stone garden window market letter winter bridge forest harbour"), " "), (F.col("id") / 16 % 10).cast("int") + 1)
    number = F.conv(F.substring(b, 1, 10), 16, 10)
    shapes = [  # value, before, after, label
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), word, word, 1),
        (F.substring(a, 1, 40), F.lit("token ="), word, 1),
        (F.substring(a, 1, 18), F.concat(word, F.lit(" password")), word, 1),
        (F.substring(plain, 1, 40), F.lit("aws_secret_access_key ="), word, 1),
        (F.concat(F.lit("ghp_"), F.substring(plain, 1, 36)), word, F.lit(""), 1),
        (F.concat(F.initcap(word), F.substring(number, 1, 4), F.lit("!"), F.substring(plain, 1, 4)), F.lit("db password:"), word, 1),
        (F.substring(plain, 1, 32), F.lit("the api_key"), word, 1),
        (F.concat(F.lit("sk_live_"), F.substring(plain, 1, 24)), F.lit("auth_token :"), word, 1),
        (F.substring(a, 1, 40), F.lit("commit"), word, 0),
        (F.concat_ws("-", F.substring(a, 1, 8), F.substring(a, 9, 4), F.substring(a, 13, 4), F.substring(a, 17, 4), F.substring(a, 21, 12)), F.concat(word, F.lit(" id")), word, 0),
        (F.concat(F.lit("/usr/lib/"), word, F.lit("/python3/"), word, F.substring(number, 1, 2)), word, word, 0),
        (F.concat(word, F.initcap(word), F.lit("From"), F.initcap(word), F.substring(number, 1, 1)), word, word, 0),
        (F.element_at(F.split(F.lit("YOUR_API_KEY_HERE1 example-token-123 changeme12345 xxxxxxxxxxxxxxxx1 password1234567 dummy_secret_0"), " "), (F.col("id") / 16 % 6).cast("int") + 1), F.lit("api_key ="), word, 0),
        (F.rpad(number, 20, "0"), word, word, 0),
        (a, F.lit("sha256 checksum"), word, 0),
        (F.substring(a, 1, 40), F.concat(F.element_at(F.split(F.lit("sha1 commit digest checksum"), " "), (F.col("id") / 32 % 4).cast("int") + 1), F.lit(" token =")), word, 0),
        (F.concat(word, F.element_at(F.split(F.lit("horse battery staple dragon monkey falcon velvet cactus"), " "), (F.col("id") / 48 % 8).cast("int") + 1)), F.lit("password:"), word, 1),
        (F.element_at(F.split(F.lit("required optional string default username changeme yourpassword undefined"), " "), (F.col("id") / 16 % 8).cast("int") + 1), F.lit("password:"), word, 0),
        (F.concat(word, F.substring(number, 1, 3)), F.lit("password ="), word, 1),
        (F.concat(F.lit("MIIE"), F.substring(plain, 1, 36)), F.lit("PRIVATE KEY-----"), word, 1),
        (F.concat(F.lit("eyJ"), F.substring(plain, 1, 17), F.lit("."), F.substring(plain, 5, 30)), F.lit("Authorization: Bearer"), word, 1),
        (F.concat(F.lit("https://"), word, F.lit(".example.com/"), F.substring(a, 1, 20)), word, word, 0),
        (F.concat(F.lit("sk-"), F.substring(plain, 3, 38)), F.concat(F.upper(word), F.lit("_API_KEY=")), word, 1),
        (F.concat(word, F.lit("-"), word, F.lit("_2024-0"), F.substring(number, 1, 1), F.lit("-release")), F.lit("version"), word, 0),
    ]
    kind = F.col("id") % len(shapes)

    def pick(at: int) -> Column:
        out = F.lit(None)
        for i, s in enumerate(shapes):
            out = F.when(kind == i, F.lit(s[at]) if at == 3 else s[at]).otherwise(out)
        return out

    path = F.when(F.col("id") % 7 == 0, F.lit("tests/fixtures")).otherwise(F.lit("src"))
    return spark.range(0, rows, 1, 2).select(path.alias("path"), pick(0).alias("value"), pick(1).alias("before"), pick(2).alias("after"), pick(3).cast("double").alias("label"))


def _vectors(found: DataFrame, words: Sequence[str] = ()) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(found, words))


def train(findings: DataFrame, trees: int = 20, depth: int = 8, seed: int = 7, words: Sequence[str] = ()) -> RandomForestClassificationModel:
    """A random forest on findings as of labelled_findings."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(_vectors(findings, words))


def find_secrets(docs: DataFrame, text: str = "text", path: str | None = "source", carry: tuple[str, ...] = ("doc_id",), findings: DataFrame | None = None, least: float = 0.5, words: Sequence[str] | None = None) -> DataFrame:
    """One row for each candidate of each whole text: the carried columns, at (number of its word, from 0), value, before,
    after, score (odds that it is a secret) and secret (score of at least `least`).

    Nulls and empty texts have no candidates. Repeated rows each give theirs. A null path is an empty one. An empty
    table gives no rows. Carried columns may have any names but those of the result's other columns. `words` takes the
    place of the corpus' frequent words.
    """
    words = corpus_words(docs, text) if words is None else words
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings, words=words)
    found = model.transform(_vectors(candidates(docs, text, path, carry), words))
    score = vector_to_array("probability")[1]
    out = found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), F.col("at").cast("long").alias("at"), "value", "before", "after", score.alias("score"))
    return out.withColumn("secret", F.col("score") >= least)
