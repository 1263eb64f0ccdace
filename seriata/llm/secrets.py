"""Secret scan: candidates by pattern, false positives removed by a random forest; JVM expressions only.

Candidates are runs of 16 characters or more of [A-Za-z0-9+/_-] with a digit, access-key ids,
and values after words such as password or token. Features: length, character classes and
transitions between them, the likelihood of the characters' transitions among dictionary
words, entropy, dictionary coverage, path marks, and the odds of the neighbouring words. The
dictionary is the SIZE words that most documents hold, counted over all documents; the
forest and the words' odds are learnt from labelled findings (value, before, after, label).
The tables hold none, so `example_findings` makes some from hashes of row numbers and the
dictionary; give `train` your own.

Null and empty texts give no finding; a text's repeated candidates are findings each, in
order k, and repeated rows give their findings each. Texts and candidates of any length are
read whole: a candidate of more than LONGEST characters is scored by overlapping windows of
WINDOW characters, a new one every STEP, and by the access-key ids in it; its probability is
the greatest of theirs. A probability of exactly the threshold counts as a secret. The
control characters 1 and 2 count as white space, like 11. An empty table gives no findings; without
documents the dictionary is empty and coverage 0. Columns besides text and the keys are not
read by the scan, whatever their names; `redact` returns them unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.llm.common import materialize, tidy

LONGEST = 200
WINDOW = 48
STEP = 8
WORDS_BEFORE, WORDS_AFTER = 3, 2
SIZE = 4096
MOST_ODDS = 300
THRESHOLD = 0.5
_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
_KEY = r"AKIA[A-Z0-9]{16}"
#: Each looks first for what is rare, so most positions cost one comparison.
_ASSIGNED = rf"[:=](?<={_NAME}[:=])[ \t]{{0,3}}[\"']?[^\s\"',;]{{6}}"
_VALUE = rf"(?<=[:=][ \t]{{0,3}}[\"']?)(?<={_NAME}[:=][ \t]{{0,3}}[\"']?)[^\s\"',;]{{6,}}+"
CANDIDATE = f"(?:{_VALUE}|{_RUN}|{_KEY})"
_OPEN, _CLOSE, _LEAD = "\x01", "\x02", "\x0b"
_ESCAPES = ((_LEAD, _LEAD + " "), (_OPEN, _LEAD + "\t"), (_CLOSE, _LEAD + "\n"))
_CODES = "abcdefghijklmnopqrstuvwxyz0123456789"
_N = len(_CODES) + 1
FEATURES = ("length", "digits", "capitals", "hex", "variety", "entropy", "transitions", "likelihood", "coverage", "path", "before_odds", "after_odds", "assigned", "quoted", "access_id", "spaced_number", "repeats")


def marked(text: Column) -> Column:
    """The text with marks about each candidate; what looks like a mark is escaped by white space, which no candidate holds."""
    for plain, escape in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return F.regexp_replace(text, f"({CANDIDATE})", f"{_OPEN}$1{_CLOSE}")


def candidates(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys..., k (from 0 in the text), value, before, after (the neighbouring words, with what is glued to the value). Texts without candidates drop out by three linear patterns; in the others one pass marks the candidates, and the text is split at the marks."""
    text = F.col("text")
    some = docs.where(text.rlike(_ASSIGNED) | text.rlike(_RUN) | text.rlike(_KEY)).select(*keys, "text")
    parts = some.select(*keys, F.split(marked(text), _OPEN).alias("parts"))
    n = F.size("parts")
    pairs = F.arrays_zip(F.slice("parts", 1, n - 1).alias("left"), F.slice("parts", 2, n - 1).alias("right"))
    rows = parts.where(n > 1).select(*keys, F.posexplode(pairs).alias("k", "p")).select(*keys, "k", F.translate("p.left", _CLOSE, "").alias("left"), F.col("p.right").alias("right"))
    left, right = F.split("left", r"\s+"), F.split(F.substring_index("right", _CLOSE, -1), r"\s+")
    before = F.array_join(F.slice(left, F.greatest(F.size(left) - WORDS_BEFORE, F.lit(1)), WORDS_BEFORE + 1), " ")
    after = F.array_join(F.slice(right, 1, WORDS_AFTER + 1), " ")
    return rows.select(*keys, "k", F.substring_index("right", _CLOSE, 1).alias("value"), before.alias("before"), after.alias("after"))


def dictionary(docs: DataFrame, size: int = SIZE) -> list[str]:
    """The `size` words of 3 to 24 letters that most documents hold, lower-case, over all documents; a word of one document only is left out. The words reach the driver, the counts do not."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), lambda w: w.rlike(r"^\p{L}{3,24}$"))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def transition_table(words: Sequence[str]) -> list[float]:
    """Log-probability of each character after each other among the words, of lower-case letters, digits and anything else; with nothing known all are equal."""
    counts = [[1.0] * _N for _ in range(_N)]
    code = {c: i + 1 for i, c in enumerate(_CODES)}
    for w in words:
        for a, b in zip(w, w[1:]):
            counts[code.get(a, 0)][code.get(b, 0)] += 1
    return [math.log(x / sum(row)) for row in counts for x in row]


@dataclass(frozen=True)
class SecretModel:
    """The forest with all that its features need; of fixed size whatever the corpus."""

    forest: RandomForestClassificationModel | None
    words: tuple[str, ...]
    odds: dict[str, float]


def _neighbours(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _last(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n)


def word_odds(findings: DataFrame, most: int = MOST_ODDS) -> dict[str, float]:
    """Logarithm of how much likelier a neighbouring word is beside a secret, for the `most` telling words of the findings."""
    words = F.concat(_last(_neighbours("before"), WORDS_BEFORE), F.slice(_neighbours("after"), 1, WORDS_AFTER))
    counts = findings.select("label", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    odds = F.log((F.col("yes") + 1) / (F.col("no") + 1))
    top = counts.select("word", odds.alias("odds"), "yes", "no").orderBy(F.desc(F.abs("odds")), "word").limit(most).collect()
    return {r["word"]: r["odds"] for r in top}


def _sum_odds(words: Column, odds: dict[str, float]) -> Column:
    if not odds:
        return F.lit(0.0)
    table = F.str_to_map(F.lit(" ".join(f"{w}:{x!r}" for w, x in odds.items())), F.lit(" "), F.lit(":"))  # one constant: few nodes in the plan
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w).cast("double"), F.lit(0.0)))


def features(rows: DataFrame, model: SecretModel) -> DataFrame:
    """rows (value, before, after) with FEATURES; narrow."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / n
    kinds = F.translate(v, "bcdefghijklmnopqrstuvwxyzBCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "a" * 25 + "A" * 25 + "0" * 9)
    changes = F.greatest(F.length(F.regexp_replace(kinds, r"(?s)(.)(?=\1)", "")) - 1, F.lit(0))
    chars = F.array_distinct(F.split(v, ""))
    p = lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - p(c) * F.log2(p(c)))
    codes = F.transform(F.filter(F.split(F.lower(v), ""), lambda c: c != ""), lambda c: F.instr(F.lit(_CODES), c))
    table = F.split(F.lit(" ".join(map(repr, transition_table(model.words)))), " ").cast("array<double>")
    pairs = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.element_at(table, a * _N + b + 1))
    likelihood = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(codes) - 1, F.lit(1))
    pieces = F.split(F.lower(F.regexp_replace(v, "(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{L}]+")
    words = F.split(F.lit(" ".join(model.words)), " ")  # one constant
    known = F.filter(pieces, lambda w: (w != "") & F.array_contains(words, w))
    covered = F.aggregate(known, F.lit(0), lambda s, w: s + F.length(w))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    glued = F.concat(F.substring_index("before", " ", -1), v, F.substring_index("after", " ", 1))
    return rows.withColumns({
        "length": F.length("value").cast("double"),
        "digits": 1 - share("[0-9]"),
        "capitals": 1 - share("[A-Z]"),
        "hex": 1 - share("[0-9a-f]"),
        "variety": F.size(chars) / n,
        "entropy": entropy,
        "transitions": changes / n,
        "likelihood": likelihood,
        "coverage": covered / n,
        "path": flag(glued.rlike(r"(?i)[/\\][^/\\]+[/\\]|https?:|\.(html?|png|jpe?g|js|css)$")),
        "before_odds": _sum_odds(_last(_neighbours("before"), WORDS_BEFORE), model.odds),
        "after_odds": _sum_odds(F.slice(_neighbours("after"), 1, WORDS_AFTER), model.odds),
        "assigned": flag(F.col("before").rlike(r"[:=] ?[\"']?$")),
        "quoted": flag(F.col("before").rlike(r"[\"']$")),
        "access_id": flag(v.rlike("^AKIA[A-Z0-9]{16}$")),
        "spaced_number": flag(v.rlike("^[0-9+/_-]+$")),
        "repeats": flag(v.rlike(r"(.)\1{4,}")),
    })


#: Used where the corpus gives no words.
_SYLLABLES = ("tion", "ther", "ing", "ment", "en", "sch", "ou", "re", "la", "ble")
_YES = ("password=", 'token = "', "api_key: ", "secret='", "pwd: ", "Authorization: Bearer ", "access_key=", "key ", "")
_NO = ("commit ", "sha256: ", "md5 ", "checksum ", "order ", "invoice no. ", "phone ", "card ", "isbn ", "uuid ", "id ", "version ", "")


def example_findings(spark: SparkSession, words: Sequence[str] = (), n: int = 8000) -> DataFrame:
    """Labelled findings (value, before, after, label) made from hashes: access-key ids, prefixed and assigned random values of several alphabets and lengths are secrets; numbers, digests, paths, joined words of the dictionary and placeholders are not."""
    words = list(words[:1000]) or [a + b for a in _SYLLABLES for b in _SYLLABLES]
    h = lambda k: F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(k)))
    number = lambda k, m: F.pmod(F.conv(F.substr(h(k), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(m)).cast("int")
    # the words, characters and lengths of each row are written first: the cases below then are small expressions
    vocabulary = F.split(F.lit(" ".join(words)), " ")
    pick = F.transform(F.array(*[number(k, len(words)) for k in "pqstuvwx"]), lambda i: F.element_at(vocabulary, i + 1))
    rows = spark.range(n).select("id", pick.alias("w"), F.concat(h("a"), h("b")).alias("hexes"), F.translate(F.base64(F.unhex(F.concat(h("m"), h("n"), h("o")))), "=", "").alias("mixed"), F.regexp_replace(F.concat(h("d"), h("e"), h("f"), h("g")), "[^0-9]", "").alias("digits"), F.array(*[number(k, 5040) for k in "1234567"]).alias("r"))
    rows = materialize(rows, "secrets-parts")
    col, lit = F.col, F.lit
    word = lambda k: col("w")["pqstuvwx".index(k)]
    of = lambda options, k: F.element_at(F.array(*[lit(x) for x in options]), col("r")[k] % len(options) + 1)
    cut = lambda text, low, high: F.substr(text, lit(1), lit(low) + col("r")[0] % (high - low + 1))
    up = F.translate(F.upper("hexes"), "0189", "XQZW")
    prose = F.concat_ws(" ", word("p"), of(("", "", "mail@mail.example.com", "https://www.example.com/page"), 1), word("q"), of(("", "", "", "", "user.1@mail.example.com", "www.example.com", "(example)", "97.51.17.173"), 2), lit(""))
    first, digits = F.substr("digits", lit(1), lit(4)), col("digits")
    slug = F.concat_ws("-", word("s"), word("t"), word("u"), word("v"), F.substr(digits, lit(1), lit(2)))
    yes, no, assigned, bare, url = 1, 2, 3, 4, 5  # what stands before: a likely mark or none, a harmless one, an assignment, prose, the start of an address
    cases = [
        (F.concat(lit("AKIA"), F.substr(up, lit(1), lit(16))), yes, 1),
        (F.concat(lit("AKIA"), F.substr(up, lit(9), lit(16))), bare, 1),
        (cut(col("hexes"), 18, 64), assigned, 1),
        (F.upper(cut(col("hexes"), 18, 64)), assigned, 1),
        (cut(col("mixed"), 20, 62), yes, 1),
        (cut(col("mixed"), 40, 62), bare, 1),
        (F.concat(of(("ghp_", "sk_live_", "xoxb-", "glpat-"), 3), cut(F.translate("mixed", "+/", "xx"), 24, 40)), yes, 1),
        (F.concat(cut(col("mixed"), 8, 14), lit("1")), assigned, 1),
        (cut(digits, 12, 20), no, 0),
        (cut(col("hexes"), 32, 64), no, 0),
        (cut(col("hexes"), 32, 40), bare, 0),
        (F.concat_ws("/", lit("com"), word("s"), first, word("t")), url, 0),
        (slug, no, 0),
        (F.concat(word("s"), word("t"), word("u"), F.substr(digits, lit(1), lit(3))), no, 0),
        (F.concat(F.initcap(word("s")), F.initcap(word("t")), F.initcap(word("u")), F.initcap(word("v")), lit("2")), no, 0),
        (F.concat(of(("changeme-example-", "your-password-here-", "dummy-token-value-"), 3), F.substr(digits, lit(1), lit(3))), assigned, 0),
        (F.repeat(F.substr(digits, lit(1), lit(1)), lit(20)), assigned, 0),
        (F.substr(slug, lit(3), lit(48)), bare, 0),
    ]
    kind = (col("id") % len(cases)).cast("int")
    value = F.coalesce(*[F.when(kind == i, c) for i, (c, _, _) in enumerate(cases)])
    place = F.element_at(F.array(*[lit(b) for _, b, _ in cases]), kind + 1)
    label = F.element_at(F.array(*[lit(float(y)) for _, _, y in cases]), kind + 1)
    mark = F.when(col("place") == yes, of(_YES, 4)).when(col("place") == no, of(_NO, 5)).when(col("place") == assigned, of(_YES[:7], 4)).when(col("place") == url, "https://www.example.").otherwise("")
    rows = rows.select("w", "r", "id", value.alias("value"), place.alias("place"), label.alias("label"), prose.alias("prose"))
    rows = materialize(rows.withColumn("mark", F.when(kind == 3, F.upper(mark)).otherwise(mark)), "secrets-cases")
    quote = F.substr("mark", F.greatest(F.length("mark"), lit(1)), lit(1))
    after = F.concat(F.when(quote.isin('"', "'"), quote).otherwise(""), lit(" "), word("w"), lit(" "), word("x"))
    return rows.select("value", F.concat("prose", "mark").alias("before"), after.alias("after"), "label")


def _vectors(rows: DataFrame, model: SecretModel) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(features(rows, model))


def train(findings: DataFrame, words: Sequence[str] = (), trees: int = 20, depth: int = 8, seed: int = 7) -> SecretModel:
    """findings: value, before, after, label (1: a secret), a bounded table; words: the dictionary."""
    findings = materialize(findings.select("value", "before", "after", F.col("label").cast("double").alias("label")), "secrets-findings")
    model = SecretModel(None, tuple(words), word_odds(findings))
    vectors = materialize(_vectors(findings, model).select("features", "label"), "secrets-vectors", instead_of=findings)  # the fit reads them several times
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(vectors)
    return SecretModel(forest, model.words, model.odds)


def train_for(docs: DataFrame, findings: DataFrame | None = None) -> SecretModel:
    """A model with the dictionary of docs; findings are the example ones by default."""
    tidy(docs.sparkSession)
    words = dictionary(docs)
    model = train(example_findings(docs.sparkSession, words) if findings is None else findings, words)
    tidy(docs.sparkSession)
    return model


def scored(rows: DataFrame, model: SecretModel) -> DataFrame:
    return model.forest.transform(_vectors(rows, model)).withColumn("probability", vector_to_array("probability")[1])


def windows(value: Column) -> Column:
    """Overlapping windows up to the value's end, and its access-key ids: linear in its length."""
    cut = F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{WINDOW - STEP + 1},{WINDOW}}})).{{{STEP}}}"), F.lit(1))
    return F.concat(cut, F.regexp_extract_all(value, F.lit(f"({_KEY})"), F.lit(1)))


def scan(docs: DataFrame, model: SecretModel, threshold: float = THRESHOLD, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys..., k, value, before, after, probability, secret: a row per candidate."""
    found = materialize(candidates(docs, keys).withColumn("rid", F.monotonically_increasing_id()), "secrets-candidates")
    value = F.col("value")
    parts = found.select("rid", "before", "after", F.explode(F.when(F.length(value) > LONGEST, windows(value)).otherwise(F.array(value))).alias("value"))
    best = materialize(scored(parts, model).groupBy("rid").agg(F.max("probability").alias("probability")), "secrets-scores")
    return found.join(best, "rid").select(*keys, "k", "value", "before", "after", "probability", (F.col("probability") >= threshold).alias("secret"))


def redact(docs: DataFrame, model: SecretModel, mark: str = "[SECRET]") -> DataFrame:
    """docs with every candidate found secret replaced in text where it was found, and n_chars, where there is one, set anew; equal strings elsewhere stay. A document keeps its row; rows are told apart by doc_id, which may be null or repeated, and a hash of the text."""
    own = docs.withColumn("_redact_hash", F.xxhash64("text"))
    found = scan(own, model, keys=("doc_id", "_redact_hash")).where("secret")
    found = found.groupBy(F.col("doc_id").alias("_redact_id"), F.col("_redact_hash").alias("_redact_of")).agg(F.collect_set("k").alias("_redact_at"))
    found = materialize(found, "secrets-found")
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("_redact_id")) & (F.col("_redact_hash") == F.col("_redact_of")), "left")
    parts = F.split(marked(F.col("text")), _OPEN)
    shown = F.transform(parts, lambda p, i: F.when(i == 0, p).when(F.array_contains("_redact_at", i - 1), F.concat(F.lit(mark), F.substring_index(p, _CLOSE, -1))).otherwise(F.translate(p, _CLOSE, "")))
    text = F.array_join(shown, "")
    for plain, escape in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escape), F.lit(plain))
    hit = F.col("_redact_at").isNotNull()
    joined = joined.withColumn("text", F.when(hit, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
