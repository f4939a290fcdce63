"""Secret scans: candidate strings, and a random forest that removes false positives, in DataFrame functions only.

A candidate is one of these: the body of a private key block; the password in
``scheme://user:password@host``; a value of six or more characters that is
assigned (``=`` or ``:``, with at most two blanks on either side) to a key with a
secret word, in quotes with any characters, or without quotes up to the next
space, quote, comma or semicolon; a value of six or more characters with a digit
after ``KEY=``; the path of a URL of twelve or more characters with a digit; or a
run of letters, digits and ``+ / _ -`` (and ``=`` at its end) of twelve or more
characters that holds a digit, isn't itself a key and doesn't begin in a URL's
host. Shorter values are no candidates. Context is the LEFT characters before
and the RIGHT ones after; words of over 20 letters are not counted in the
dictionary. Its features (``FEATURES``) are its length, shares of character
classes, transitions between classes, entropy, coverage by dictionary words,
the document's path, and the words before and after it. The dictionary holds a
fixed list and the words that at least ``COMMON`` of all documents hold, which
Spark counts (``dictionary``). The forest is trained on labelled findings: rows
of value, before, after, path and label. ``builtin_findings`` makes them from
fixed lists and hashes; pass your own where there are any. At most
``TRAINING_ROWS`` of them are used.

Defined cases: a null text counts as empty, a null path as the empty path;
texts without candidates give no findings; equal candidates in equal contexts
get equal probabilities; a null ``doc_id`` is carried; rows that repeat each
give their findings; an empty table gives none; other columns, whatever their
names, are not read. ``redacted`` keeps every column and row, and changes only
texts with secrets (and ``n_chars``, where it is).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed

THRESHOLD = 0.5
TRAINING_ROWS = 20_000
TREES, DEPTH = 40, 7
MASK = "[SECRET]"
LEFT, RIGHT = 60, 20
#: The share of all documents that hold a dictionary word, and the least length of such words.
COMMON, WORD_LENGTH = 0.001, 4

# Words that stand near secrets, near harmless identifiers, in paths of tests, and in made-up names.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "credentials", "client_secret", "passwort", "passphrase", "pass", "kennwort", "contrasena", "motdepasse", "secret_key", "signing_key")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "revision", "uuid", "guid", "etag", "version", "order", "invoice", "isbn", "serial", "phone", "card", "account", "build", "hash", "integrity")
#: A key may go on after its secret word, as in ``password_2`` or ``token-value``.
_KEY = "(?i:" + "|".join(sorted(SECRET_WORDS, key=len, reverse=True)) + r")(?:[_-][A-Za-z0-9_-]{1,12}|s|[0-9]{1,2})?+"
_ASSIGNED = r"(?<=[=:]\s{0,2}[\"'`]?)(?<=" + _KEY.replace("?+", "?") + r"[\"'`]?\s{0,2}[=:]\s{0,2}%s)"
_NO_KEY = r"(?![A-Za-z0-9+/_-]*" + _KEY + r"[\"'`]?\s{0,2}[=:])"
#: A run of twelve or more characters; the test for a digit comes first, as it fails soonest.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?<!://[A-Za-z0-9.-]{0,80})" + _NO_KEY + r"[A-Za-z0-9+/_-]{12,}+(?:={1,2}(?![A-Za-z0-9+/_=-])|(?!=[A-Za-z0-9+/_-]))"
CANDIDATE = "|".join(
    [
        r"(?<=-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)[A-Za-z0-9+/=\s]{16,}+(?=-----END)",
        r"(?<=://[^\s/:@]{1,64}:)[^\s/@]{4,}+(?=@)",
        *(_ASSIGNED % q + rf"[^{q}\r\n]{{6,}}+(?={q})" for q in "\"'`"),
        _ASSIGNED % "" + r"[^\s\"'`,;]{5,}(?<![)\]}])[^\s\"'`,;)\]}]",
        r"(?<=[A-Za-z0-9_-]=)(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{6,}+={0,2}",
        r"(?<=://[^\s/\"'`<>]{1,80}/)(?=[^\s\"'`<>?#]*[0-9])[A-Za-z0-9+/_.~-]{12,}+",
        RUN,
    ]
)
TEST_WORDS = ("test", "tests", "example", "examples", "fixture", "fixtures", "sample", "docs", "mock", "demo")
DICTIONARY = ("user", "name", "file", "data", "test", "example", "sample", "your", "here", "placeholder", "default", "config", "value", "index", "table", "page", "image", "version", "release", "build", "report", "model", "number", "order", "item", "group", "server", "client", "service", "module", "section", "chapter", "figure", "update", "backup", "change", "token", "secret", "password", "redacted", "dummy", "the", "and", "ing", "tion")
#: What stands in place of a secret in prose, templates and code.
PLACEHOLDERS = ("required", "optional", "string", "none", "null", "undefined", "true", "false", "enter", "please", "must", "missing", "invalid", "expired", "example", "redacted", "secret", "masked", "hidden", "placeholder", "changed", "should", "which", "access", "refresh", "default", "process", "config", "value", "the", "your", "this", "they", "what", "with", "for", "number", "boolean", "integer", "object")

FEATURES = ("length", "digits", "upper", "lower", "signs", "hex", "transitions", "letter_digit", "distinct", "entropy", "repeats", "vowels", "dictionary", "corpus_words", "slashes", "test_path", "secret_before", "harmless_before", "assigned", "quoted", "secret_after", "harmless_after", "spaces", "others", "template", "placeholder", "in_url", "key_block")


def _count(text: Column, rule: str) -> Column:
    return F.regexp_count(text, F.lit(rule)).cast("double")


def _any(words: tuple[str, ...]) -> str:
    return r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])"


def dictionary(docs: DataFrame, common: float = COMMON) -> DataFrame:
    """The words (``word``, lower-case Latin letters) that at least ``common`` of all documents hold, and five at least; at most (mean words per document) / common rows."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{WORD_LENGTH},20}}"), F.lit(0)))
    held = docs.where("text is not null").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return held.where(F.col("n") >= max(5, docs.count() * common)).select("word")


def _with_coverage(findings: DataFrame, words: DataFrame | None) -> DataFrame:
    """Add ``corpus_words``, the share of a value's characters in runs of letters that are words of ``words``."""
    if words is None:
        return findings.withColumn("corpus_words", F.lit(0.0))
    runs = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(f"[a-z]{{{WORD_LENGTH},}}"), F.lit(0)))
    values = findings.select("value").distinct()
    met = values.select("value", F.explode(runs).alias("word")).join(words.select("word"), "word", "left_semi")
    times = F.size(F.filter(F.regexp_extract_all(F.lower("value"), F.lit(f"[a-z]{{{WORD_LENGTH},}}"), F.lit(0)), lambda w: w == F.col("word")))
    covered = met.groupBy("value").agg((F.sum(F.char_length("word") * times) / F.first(F.char_length("value"))).alias("corpus_words"))
    return findings.join(covered, "value", "left").withColumn("corpus_words", F.coalesce("corpus_words", F.lit(0.0)))


def with_features(findings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Add FEATURES to rows of value, before, after and path, with a dictionary of ``words``."""
    findings = _with_coverage(findings, words)
    v, before, after = F.col("value"), F.lower("before"), F.lower("after")
    n = F.char_length(v).cast("double")
    chars = F.split(F.col("value"), "")
    each = F.transform(F.array_distinct(chars), lambda c: F.regexp_count(v, F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))).cast("double"))
    made = {
        "length": F.log2(n),
        "digits": _count(v, "[0-9]") / n,
        "upper": _count(v, "[A-Z]") / n,
        "lower": _count(v, "[a-z]") / n,
        "signs": _count(v, "[+/_=-]") / n,
        "hex": _count(v, "[0-9a-fA-F]") / n,
        "transitions": _count(v, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "letter_digit": _count(v, "(?<=[A-Za-z])(?=[0-9])") / n,
        "distinct": F.size(F.array_distinct(chars)) / F.least(n, F.lit(64.0)),
        "entropy": F.aggregate(each, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n)),
        "repeats": _count(v, r"(.)(?=\1\1)") / n,
        "vowels": _count(v, "[aeiouAEIOU]") / n,
        "dictionary": F.char_length(F.array_join(F.regexp_extract_all(F.lower(v), F.lit("(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"), F.lit(0)), "")) / n,
        "slashes": _count(v, "/"),
        "test_path": F.lower("path").rlike(_any(TEST_WORDS)).cast("double"),
        "secret_before": before.rlike(_any(SECRET_WORDS)).cast("double"),
        "harmless_before": before.rlike(_any(HARMLESS_WORDS)).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "quoted": before.rlike("[\"'`]$").cast("double"),
        "secret_after": after.rlike(_any(SECRET_WORDS)).cast("double"),
        "harmless_after": after.rlike(_any(HARMLESS_WORDS)).cast("double"),
        "spaces": _count(v, " "),
        "others": _count(v, "[^A-Za-z0-9+/_= -]") / n,
        "template": v.rlike(r"[{}<>()\[\]]|\$[A-Za-z]|^%|::|://").cast("double"),
        "in_url": before.rlike(r"://[^\s/:@]*:$").cast("double"),
        "key_block": before.rlike(r"private key-----$").cast("double"),
        "placeholder": F.lower(v).rlike(r"^[\W_]*(?:" + "|".join(PLACEHOLDERS) + r")(?![a-z0-9])|\*{3}|(?:^|[_ -])here$|^your|[a-z]\.[a-z]").cast("double"),
    }
    return findings.withColumns({k: made[k] for k in FEATURES if k != "corpus_words"})


def builtin_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """Labelled findings made from fixed lists and hashes of row numbers, the same on every run."""
    i = F.col("id")
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(of))) + 1).cast("int"))
    number = lambda salt, low, high: (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(high - low + 1)) + low).cast("int")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 512)
    hexed = lambda salt: digest(salt).substr(F.lit(1), pick(salt + "n", 32, 40, 40, 40, 48, 64))
    mixed = lambda salt: F.regexp_replace(F.base64(F.unhex(digest(salt))), "[+/=\r\n]", "").substr(F.lit(1), number(salt + "n", 20, 44))
    numbers = lambda salt, low, high: F.regexp_replace(digest(salt), "[a-f]", "").substr(F.lit(1), number(salt + "n", low, high))
    word = lambda salt: pick(salt, "the", "and", "report", "ready", "see", "value", "was", "with", "from", "section", "der", "les", "para", "server", "reading", "update")
    filler = F.concat(word("f1"), F.lit(" "), word("f2"), F.lit(" "), word("f3"), F.lit(" "))
    key = pick("key", *SECRET_WORDS)
    key = F.when(number("case", 0, 3) == 0, F.upper(key)).otherwise(key)
    assign = pick("assign", ' = "', '="', ": ", ' = "', "='", "=")
    name = lambda salt: pick(salt, *DICTIONARY)
    phrase = [pick(f"w{k}", "correct", "horse", "battery", "staple", "river", "orange", "candle", "velvet", "planet", "winter", "copper", "jazz") for k in range(1, 5)]
    in_url = F.concat(filler, pick("ua", "postgres", "mysql", "https", "redis", "amqp", "ftp"), F.lit("://"), pick("ub", "admin", "root", "app", "deploy", "svc"), F.lit(":"))
    kinds = [
        (1, hexed("a"), F.concat(filler, key, assign)),
        (1, mixed("b"), F.concat(filler, key, assign)),
        (1, F.upper(hexed("c")), F.concat(F.upper(filler), F.upper(key), assign)),
        (1, F.concat(pick("p", "ghp_", "sk-", "AKIA", "xoxb-", "glpat-"), mixed("d")), filler),
        (1, hexed("e"), F.concat(filler, key, assign)),
        (0, numbers("g", 12, 19), filler),
        (0, numbers("h", 12, 19), F.concat(filler, pick("hw", *HARMLESS_WORDS), F.lit(" "))),
        (0, digest("i").substr(1, 40), F.concat(filler, pick("iw", "commit ", "sha1: ", "revision ", "build ", "commit: "))),
        (0, digest("j").substr(1, 64), F.concat(filler, pick("jw", "sha256:", "checksum = ", "digest: ", 'integrity="', "sha256 "))),
        (0, F.concat_ws("-", *(digest("k").substr(a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.concat(filler, pick("kw", "uuid ", "guid: ", "id ", ""))),
        (0, F.concat_ws("_", name("l1"), name("l2"), name("l3"), number("l4", 1, 9999).cast("string")), F.concat(filler, pick("lw", "", key, "see "))),
        (0, F.concat(F.lit("your_"), pick("mw", "token", "secret", "password", "api_key"), pick("mx", "_here_123", "_goes_here_1", "_xxxxxxxx1")), F.concat(filler, key, assign)),
        (0, F.concat(F.repeat(pick("nc", "x", "0", "1", "a", "ab", "12"), number("nn", 12, 20)), F.lit("1")), F.concat(filler, key, assign)),
        (0, F.concat_ws("/", name("o1"), name("o2"), F.concat(name("o3"), number("o4", 1, 99).cast("string"))), filler),
        (0, F.concat_ws("-", F.lit("2024"), number("q1", 10, 12).cast("string"), number("q2", 10, 28).cast("string"), name("q3"), name("q4")), filler),
        (0, F.concat(pick("r1", "thererstan", "ountheren", "lesauxment", "einheitung"), number("r2", 10, 9999).cast("string")), filler),
        (1, F.concat(name("s1"), number("s2", 1, 9999).cast("string")), F.concat(filler, key, assign)),
        (1, F.concat(pick("t1", "hunter", "dragon", "Monkey", "qwerty", "Winter", "letmein", "shadow", "Sommer", "soleil"), number("t2", 1, 2030).cast("string"), pick("t3", "", "", "!", "#", "$", "@x")), F.concat(filler, key, assign)),
        (1, F.concat(mixed("u1").substr(F.lit(1), number("u2", 3, 9)), pick("u3", "!", "@", "#", "$", ".", "&", "!!"), mixed("u4").substr(F.lit(1), number("u5", 3, 9))), F.concat(filler, key, assign)),
        (1, F.translate(mixed("v"), "0123456789", "kQzvXwpJhb"), F.concat(filler, key, assign)),
        (1, F.when(number("w0", 0, 2) == 0, F.concat_ws("-", *phrase)).otherwise(F.concat_ws(" ", *phrase)), F.concat(filler, key, pick("wa", ' = "', '="', ': "', "='"))),
        (0, F.concat(pick("x1", *PLACEHOLDERS), pick("x2", "", "", "", ".", "!")), F.concat(filler, key, assign)),
        (0, F.concat_ws(" ", pick("y1", *PLACEHOLDERS), word("y2"), word("y3"), name("y4")), F.concat(filler, key, pick("ya", ' = "', '="', ': "'))),
        (0, F.concat(pick("z1", "${", "{{ ", "<", "$(", "os.environ[", "getenv(", "process.env."), F.upper(key), pick("z2", "}", " }}", ">", ")", "]", "")), F.concat(filler, key, assign)),
        (0, F.concat(pick("k1", "config.", "self.", "settings.", "request.", "args."), name("k2")), F.concat(filler, key, assign)),
        (0, F.repeat(pick("b1", "*", "x", ".", "-"), number("b2", 6, 14)), F.concat(filler, key, assign)),
        (0, F.concat(numbers("c1", 6, 11), pick("c2", "", "", "px", "ms")), F.concat(filler, pick("c3", "id", "width", "size", "page", "order", "time", "v"), F.lit("="))),
        (0, F.concat(name("d1"), number("d2", 1, 999).cast("string")), F.concat(filler, pick("d3", "name", "ref", "src", "utm", "lang", "class"), F.lit("="))),
        (1, F.concat(phrase[0], phrase[1], phrase[2]), F.concat(filler, key, assign)),
        (1, F.concat(pick("m1", "garden", "tiger", "Berlin", "summer", "guitar", "Paris", "coffee"), pick("m2", "", "light", "house", "moon", "bird"), number("m3", 1, 99).cast("string")), F.concat(filler, key, assign)),
        (1, F.when(number("n1", 0, 1) == 0, mixed("n2").substr(1, 14)).otherwise(F.concat(phrase[1], number("n3", 1, 99).cast("string"), phrase[3])), in_url),
        (0, F.concat(pick("o5", "password", "pass", "secret", "pwd", "xxxx", "****", "<pw>", "${PW}")), in_url),
        (1, F.concat(F.lit("\n"), mixed("p1"), mixed("p2"), F.lit("\n"), mixed("p3"), F.lit("==\n")), F.concat(filler, pick("p4", "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"))),
        (1, F.concat(pick("q5", "services/", "hook/", "api/v1/"), F.upper(hexed("q6").substr(1, 9)), F.lit("/"), mixed("q7")), F.concat(filler, F.lit("https://hooks."), name("q8"), F.lit(".com/"))),
        (0, F.concat(name("r3"), F.lit("/"), name("r4"), pick("r5", "/2024/", "-12/", "/v2/", "/page/"), name("r6"), pick("r7", ".html", "/", "", ".pdf")), F.concat(filler, F.lit("https://www."), name("r8"), F.lit(".org/"))),
        (0, F.concat(name("t4"), F.lit("-"), name("t5"), F.lit("-"), number("t6", 100, 99999).cast("string")), F.concat(filler, F.lit("https://"), name("t7"), F.lit(".net/"))),
    ]
    path = pick("path", "src0", "src7", "app/config.py", "deploy/values.yaml", "src/main.rs", "tests/test_auth.py", "docs/example.md", "", "web/index.html")
    after = F.concat(pick("after", '"', "' ", " ", "\n", "!! ", "### "), word("af"))
    # what follows a URL's password or a key block is given by the rule that found it
    after = F.when(F.pmod(i, F.lit(len(kinds))).isin([k for k, x in enumerate(kinds) if x[2] is in_url]), F.concat(F.lit("@"), word("ah"))).otherwise(after)
    made, some = None, 7  # a projection of all kinds at once is too long to compile
    for first in range(0, len(kinds), some):
        kind = F.pmod(i, F.lit(len(kinds)))
        value, before, label = F.lit(""), F.lit(""), F.lit(0)
        for k, (l, v, b) in enumerate(kinds[first : first + some], first):
            value, before, label = F.when(kind == k, v).otherwise(value), F.when(kind == k, b).otherwise(before), F.when(kind == k, l).otherwise(label)
        part = spark.range(rows).where(kind.between(first, first + some - 1)).select(value.alias("value"), before.alias("before"), after.alias("after"), path.alias("path"), label.cast("double").alias("label"))
        made = part if made is None else made.unionByName(part)
    return made


def train(findings: DataFrame, words: DataFrame | None = None) -> PipelineModel:
    """A forest over FEATURES, from at most TRAINING_ROWS labelled findings (those of least hash)."""
    rows = checkpointed(findings.select("value", "before", "after", "path", "label").orderBy(F.xxhash64("value", "before", "after", "path")).limit(TRAINING_ROWS))
    forest = RandomForestClassifier(labelCol="label", featuresCol="_features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7)
    table = checkpointed(with_features(rows, words).select(*FEATURES, "label").orderBy(F.xxhash64(*FEATURES, "label")))
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), forest]).fit(table)


def _by_rule(text: Column, of) -> Column:
    """``of`` the rule for candidates; a text without ``=`` and ``:`` can only hold runs, which are looked for faster."""
    return F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), of(F.lit(CANDIDATE))).otherwise(of(F.lit(RUN)))


def _holds_candidate(text: Column) -> Column:
    return F.coalesce(_by_rule(text, lambda rule: F.regexp_like(text, rule)), F.lit(False))


def _split(text: Column) -> tuple[Column, Column]:
    """The parts of a text between candidates, and the candidates."""
    return _by_rule(text, lambda rule: F.split(text, rule, -1)), _by_rule(text, lambda rule: F.regexp_extract_all(text, rule, F.lit(0)))


def _numbered(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, path and text of the documents with candidates, and the whole row in ``doc``."""
    at = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    some = docs.where(_holds_candidate(F.col("text")))
    return some.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), at.alias("path"), F.col("text").alias("text"), F.struct(*docs.columns).alias("doc"))


def _candidates(rows: DataFrame) -> DataFrame:
    """One row per candidate of rows of row, doc_id, path and text."""
    text = F.col("text")
    gaps, found = _split(text)
    both = F.transform(F.arrays_zip(found.alias("f"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("h")), lambda x: F.when(x["f"].isNotNull(), F.struct(x["f"].alias("value"), F.char_length(x["g"]).alias("gap"), F.right(x["g"], F.lit(LEFT)).alias("before"), F.left(x["h"], F.lit(RIGHT)).alias("after"))))
    hits = rows.select("row", "doc_id", "path", F.filter(both, lambda m: m.isNotNull()).alias("_m"))
    each = checkpointed(hits.select("row", "doc_id", "path", F.posexplode("_m").alias("nth", "m")))
    end = F.sum(F.col("m.gap") + F.char_length("m.value")).over(Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", end).select("row", "doc_id", "nth", (F.col("end") - F.char_length("m.value")).alias("start"), "end", "m.value", "m.before", "m.after", "path")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """One row per candidate: row, doc_id, nth, start, end, value, before, after, path."""
    return _candidates(_numbered(docs, path).drop("doc"))


def scored(found: DataFrame, model: PipelineModel, words: DataFrame | None = None) -> DataFrame:
    """Add ``probability`` and ``is_secret`` to candidates."""
    told = model.transform(with_features(found, words)).withColumn("probability", vector_to_array("probability")[1])
    return told.withColumn("is_secret", F.col("probability") >= THRESHOLD).drop(*FEATURES, "_features", "rawPrediction", "prediction")


def _trained(docs: DataFrame, labelled: DataFrame | None) -> tuple[PipelineModel, DataFrame]:
    words = checkpointed(dictionary(docs))
    return train(builtin_findings(docs.sparkSession) if labelled is None else labelled, words), words


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate in every whole text: where it is, the digest of its value, its probability of being a secret, and the verdict."""
    model, words = _trained(docs, labelled)
    return scored(candidates(docs), model, words).select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by MASK. Only texts with candidates are shuffled."""
    model, words = _trained(docs, labelled)
    some = checkpointed(_numbered(docs, "source"))
    verdicts = scored(_candidates(some.select("row", "doc_id", "path", "text")), model, words).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "is_secret"))), lambda s: s["is_secret"]).alias("verdicts"))
    gaps, found = _split(F.col("text"))
    parts = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("f"), F.col("verdicts").alias("v")), lambda x: F.concat(x["g"], F.when(x["v"], F.lit(MASK)).otherwise(F.coalesce(x["f"], F.lit("")))))
    changed = some.join(verdicts, "row").select("doc", F.array_join(parts, "").alias("text"), F.exists("verdicts", lambda v: v).alias("any"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("any"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    whole = changed.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
    return docs.where(~_holds_candidate(F.col("text"))).unionByName(whole)
