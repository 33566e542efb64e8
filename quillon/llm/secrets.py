"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two second-order Markov chains over the 67 characters of identifiers are counted from labelled samples (text, random or not),
each smoothed by its first-order chain; their log ratios form one array of fixed size. A token of 20 or more such characters that
no pattern has taken is a secret if the sum of its transitions' log-likelihood ratios exceeds `least` and `per_char` times its length.
Everything is DataFrame functions: a scan of the texts without a shuffle, with the array as a scalar subquery.

The default samples are random strings made by hashing numbers (base64 in three alphabets, upper and lower case, base32, upper-case hexadecimal)
and three kinds of ordinary strings: the distinct words seen twice or more in a bounded number of documents (`sample`, first by hash of
the id) without their pattern matches, alone and joined; names made of words of programming in the usual styles (with _, -, /, capitals,
dates, numbers); and what looks random by rule (UUIDs, times, long numbers, rules of one character). The thresholds were chosen on
other strings: see the README for what is found and what is a false alarm, by kind.
Offsets are code points, ends exclusive. Defined results: a null text is empty; an empty text has no spans;
repeated rows are scanned each; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds' patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET)
_CODES = [max(ALPHABET.find(chr(i)), 0) for i in range(128)]

# Words that names in programs are made of.
WORDS = """
account action active address admin agent alert array async attribute audit auth backup balance batch block boolean border bottom buffer build button
byte cache callback cancel category change channel character check child class clean client close cluster code collection color column command commit
config connection console container content context control cookie copy count create currency current data database debug default delete description
device directory document domain download element email empty enable encoding entry environment error event example exception execute export
expression external factory failure feature field file filter flag folder format frame function gateway generate global graph group handler header
height history image import index input insert instance internal invalid iterator job key label language layout length level library license limit
listener location lock login manager map match matrix memory message method metric mode model module monitor name network node notification number
object offset operation option order output owner package parameter parent parse path payment permission pipeline plugin point policy position
previous primary process profile property provider public query queue range reader record region remote request response result schedule service value
""".split()


_NONE = "CAST(array() AS array<struct<s: bigint, k: int, e: bigint, v: string>>)"
_BLOCK = 256


def folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column]) -> Column:
    """The spans that step(state, item) -> (state, spans) and last(state) give over an array. Arrays grow by blocks of items, so that time is linear in them."""
    none = F.expr(_NONE)
    def one(acc: Column, x: Column) -> Column:
        state, found = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], found).alias("out"))

    def many(acc: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), one, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    def all_of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))
        out = F.aggregate(blocks, F.struct(start.alias("state"), F.array(none).alias("out")), many, lambda acc: F.concat(F.flatten(acc["out"]), last(acc["state"])))
        return F.when(F.size(x) > 0, out).otherwise(none)

    # As an element, so that the lambda has the array's value and the expression isn't run for each block.
    return F.element_at(F.transform(F.array(items), all_of), 1)


def spans(text: Column, pattern: str, kind: str, value_length: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind's place, end, matched text).

    The text before each match comes from splitting at the pattern, so positions are running sums of lengths. A match with
    value_length stays only if the pattern's group 2 has that many characters.
    """
    match, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    sizes = F.zip_with(match, F.slice(between, 1, F.size(match)), lambda m, b: F.struct(F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("value")))
    none = F.expr(_NONE)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        found = F.struct(start.alias("s"), F.lit(KINDS.index(kind)).alias("k"), (start + x["size"]).alias("e"), x["value"].alias("v"))
        return start + x["size"], F.array(found)

    out = folded(sizes, F.lit(0).cast("long"), step, lambda at: none)
    if value_length:
        out = F.filter(out, lambda x: F.length(F.regexp_extract(x["v"], pattern, 2)) >= value_length)
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(none)


def free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: one pass over both by start."""
    none, nothing = F.expr(_NONE), F.expr("CAST(NULL AS struct<s: bigint, k: int, e: bigint, v: string>)")
    kept = lambda held: F.when(held.isNotNull(), F.array(held)).otherwise(none)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        held, until, token = state["held"], state["until"], x["k"] == KINDS.index("markov")
        next_held = F.when(token, F.when(until <= x["s"], x).otherwise(nothing)).otherwise(F.when(held["e"] > x["s"], nothing).otherwise(held))
        return F.struct(F.when(token, until).otherwise(F.greatest(until, x["e"])).alias("until"), next_held.alias("held")), F.when(token, kept(held)).otherwise(none)

    both = F.array_sort(F.concat(base, tokens))
    return folded(both, F.struct(F.lit(0).cast("long").alias("until"), nothing.alias("held")), step, lambda state: kept(state["held"]))


def base_spans(text: Column) -> Column:
    return F.concat(spans(text, ASSIGN, "assign", 6), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))


def digest(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["s"], x["k"], x["e"]))), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def random_samples(spark: SparkSession, count: int = 6000) -> DataFrame:
    """(text) of strings without structure, in the alphabets that keys come in."""
    hashed = spark.range(count).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    wide = F.replace(F.base64(F.unhex("h")), F.lit("="), F.lit(""))
    digits = F.concat(*(F.lpad(F.conv(F.substring("h", i, 15), 16, 32), 12, "0") for i in (1, 16, 31)))
    base32 = F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    kinds = wide, F.translate(wide, "+/", "-_"), F.translate(wide, "+/", "xY"), F.upper(F.translate(wide, "+/", "QZ")), F.lower(F.translate(wide, "+/", "qz")), F.upper("h"), base32
    return hashed.select(F.explode(F.array(*kinds)).alias("text"))


def word_samples(documents: DataFrame, sample: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text) of the distinct words seen twice or more in at most `sample` documents, without pattern matches: alone in each case, and joined."""
    rows = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    first = rows.select(key).orderBy(F.xxhash64(key), key).limit(sample).distinct()
    clean = F.col(text)
    for pattern in (ASSIGN, ACCESS, HEX):
        clean = F.regexp_replace(clean, F.lit(pattern), F.lit(" "))
    words = rows.join(first, key, "left_semi").select(F.explode(F.split(clean, "[^A-Za-z0-9+/_=-]+")).alias("w")).where(F.length("w").between(2, 60))
    w = F.col("w")
    up, title = F.upper(w), F.initcap(w)
    joined = F.concat_ws("_", w, w, w), F.concat_ws("-", w, w), F.concat_ws("/", w, w), F.concat(title, title), F.concat(w, title), F.concat_ws("_", up, up), F.concat(w, w)
    return words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select(F.explode(F.array(w, up, title, *joined)).alias("text"))


def name_samples(spark: SparkSession, count: int = 6000) -> DataFrame:
    """(text) of names of two to six of WORDS, drawn by hash, in the usual styles."""
    rows = spark.range(count)
    draw = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most)).cast("int")
    # Filled up as one array, so that words is a column and not an expression repeated in each style.
    words = F.slice(F.array(*(F.element_at(F.lit(WORDS), draw(j, len(WORDS)) + 1) for j in range(6))), F.lit(1), draw(6, 5) + 2)
    w = F.col("w")
    titles = F.array_join(F.transform(w, F.initcap), "")
    camel = F.concat(w[0], F.array_join(F.transform(F.slice(w, F.lit(2), F.size(w)), F.initcap), ""))
    day = F.concat(F.lit("/"), F.lpad((draw(7, 12) + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((draw(8, 28) + 1).cast("string"), 2, "0"), F.lit("/"))
    dated = F.concat((draw(9, 60) + 1990).cast("string"), day, F.array_join(w, "-"))
    numbered = F.concat_ws("_", F.array_join(w, "_"), draw(10, 100_000).cast("string"))
    styles = F.array_join(w, "_"), F.upper(F.array_join(w, "_")), titles, camel, F.array_join(w, "-"), F.concat(F.lit("/"), F.array_join(w, "/")), F.array_join(w, ""), dated, numbered
    return rows.select("id", words.alias("w")).select(F.explode(F.array(*styles)).alias("text"))


def rule_samples(spark: SparkSession, count: int = 3000) -> DataFrame:
    """(text) of UUIDs, times, long numbers and rules of one character."""
    h = F.col("h")
    uuid = F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    at = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(2_500_000_000)))
    times = F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss"), F.date_format(at, "yyyyMMdd_HHmmss"), F.date_format(at, "yyyyMMddHHmmssSSSSSS")
    number = F.substring(F.translate(h, "abcdef", "902846"), 1, 24)
    line = F.repeat(F.substring(F.lit("=-_/+"), F.pmod("id", F.lit(5)).cast("int") + 1, F.lit(1)), F.pmod(F.xxhash64("id"), F.lit(50)).cast("int") + 10)
    return spark.range(count).withColumn("h", F.md5(F.col("id").cast("string").cast("binary"))).select(F.explode(F.array(uuid, uuid, *times, number, line)).alias("text"))


def ordinary_samples(documents: DataFrame, sample: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text) of ordinary strings: words of the documents, names of programs, and what looks random by rule."""
    spark = documents.sparkSession
    return word_samples(documents, sample, key, text).unionByName(name_samples(spark)).unionByName(rule_samples(spark))


def _grams(samples: DataFrame, size: int, name: str) -> DataFrame:
    """(i, count) of runs of `size` characters of the alphabet; i is the run read as a number."""
    runs = samples.where(F.length("text") >= size).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.substring("text", i, F.lit(size)))).alias("g"))
    counts = runs.where(F.regexp_like("g", F.lit("^[A-Za-z0-9+/_=-]+$"))).groupBy("g").agg(F.count("*").cast("double").alias(name))
    place = sum((F.element_at(F.lit(_CODES), F.ascii(F.substring("g", i + 1, 1)) + 1) * WIDTH ** (size - 1 - i) for i in range(size)), F.lit(0))
    return counts.select(place.cast("long").alias("i"), name)


def _chain(samples: DataFrame, smooth: float, weight: float, name: str) -> DataFrame:
    """(i, log probability of the third character after the first two) of every triple."""
    spark = samples.sparkSession
    pairs = spark.range(WIDTH**2).withColumnRenamed("id", "i").join(_grams(samples, 2, "n"), "i", "left").na.fill(0.0).withColumn("b", F.expr(f"i div {WIDTH}"))
    firsts = pairs.groupBy("b").agg(F.sum("n").alias("m"))
    first = pairs.join(firsts, "b").select(F.col("i").alias("bc"), ((F.col("n") + smooth) / (F.col("m") + smooth * WIDTH)).alias("p"))
    triples = spark.range(WIDTH**3).withColumnRenamed("id", "i").join(_grams(samples, 3, "n"), "i", "left").na.fill(0.0)
    triples = triples.withColumn("ab", F.expr(f"i div {WIDTH}")).withColumn("bc", F.expr(f"i % {WIDTH**2}"))
    seconds = triples.groupBy("ab").agg(F.sum("n").alias("m"))
    return triples.join(seconds, "ab").join(first, "bc").select("i", F.log((F.col("n") + weight * F.col("p")) / (F.col("m") + weight)).alias(name))


def train(random: DataFrame, ordinary: DataFrame, smooth: float = 0.5, weight: float = 8.0) -> DataFrame:
    """One row: `model`, the log ratios P(c | ab, random) / P(c | ab, ordinary) of all triples of the alphabet in order.

    A chain's first-order probabilities have `smooth` added to each count; they are the prior of its second-order ones, worth `weight` counts.
    """
    rows = _chain(random, smooth, weight, "r").join(_chain(ordinary, smooth, weight, "o"), "i").select("i", (F.col("r") - F.col("o")).alias("x"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("model"))


def log_ratio(token: Column, model: Column) -> Column:
    """The sum of the model's log ratios over the token's triples; the token has three characters or more, all of the alphabet."""
    codes = F.transform(F.split(token, ""), lambda c: F.element_at(F.lit(_CODES), F.ascii(c) + 1))

    def total(v: Column) -> Column:
        n = F.size(v) - 2
        ends = F.zip_with(F.slice(v, F.lit(2), n), F.slice(v, F.lit(3), n), lambda b, c: b * WIDTH + c + 1)
        return F.aggregate(F.zip_with(F.slice(v, F.lit(1), n), ends, lambda a, bc: F.element_at(model, a * WIDTH * WIDTH + bc)), F.lit(0.0), lambda s, x: s + x)

    # As an element, so that the codes are computed once.
    return F.element_at(F.transform(F.array(codes), total), 1)


def scan_secrets(documents: DataFrame, random: DataFrame | None = None, ordinary: DataFrame | None = None, least: float = 24.0, per_char: float = 1.7, sample: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans (digest of all spans) and n_markov of each row."""
    random = random_samples(documents.sparkSession) if random is None else random
    ordinary = ordinary_samples(documents, sample, key, text) if ordinary is None else ordinary
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", base_spans(F.col("text")).alias("base"), spans(F.col("text"), TOKEN, "markov").alias("tokens"))

    rows = rows.withColumn("model", train(random, ordinary).scalar())

    def secret(x: Column) -> Column:
        return log_ratio(x["v"], F.col("model")) > F.greatest(F.lit(least), per_char * F.length(x["v"]))

    alone = F.when(F.size("base") > 0, free(F.col("tokens"), F.col("base"))).otherwise(F.col("tokens"))
    rows = rows.withColumn("more", F.when(F.size("tokens") > 0, F.filter(alone, secret)).otherwise(F.col("tokens")))
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long")
    return rows.select(
        F.col("key").alias(key),
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_markov"),
    )
