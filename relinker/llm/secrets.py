"""Secrets in texts: fixed patterns, and two character Markov models (random strings, ordinary identifiers) beside them.

Everything is made of DataFrame functions: patterns find matches, the text between them gives their places, and the models are one
array of log-likelihood ratios, looked up for every two neighbouring characters of a long token.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relinker.functions import urls

# Kinds in order, their patterns and least lengths. Failing matches are dropped after matching.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGNED = 8
# Runs of one class of characters that are too short fail as a whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"

# Tokens that the models judge: runs of these characters, of at least this many.
LETTERS = "A-Za-z0-9+/_=-"
LEAST = 16
TOKEN = rf"(?<![{LETTERS}])[{LETTERS}]{{{LEAST},}}+"
# Log-likelihood ratio from which a token counts as random.
RATIO = 8.0
# Rows of random samples, and the weight of what classes of characters say beside counted neighbours.
SAMPLES = 200
PRIOR = 8.0

# Character codes from + to z.
LOW, WIDE = ord("+"), ord("z") - ord("+") + 1

# Labelled samples of the ordinary class. Those of the random class are made by a rule, so that no invented secret stands here.
ORDINARY = """
user_account_settings getElementById application-context max_connection_count MAX_BUFFER_SIZE DEFAULT_TIMEOUT_SECONDS
src/main/resources/application path/to/some/file /usr/local/share/doc com/example/project/util include_subdirectories
internationalization responsibilities characteristically Geschwindigkeitsbegrenzung Bundesverfassungsgericht
anticonstitutionnellement responsabilidades extraordinariamente Verantwortlichkeiten unterschiedliche Zusammenarbeit
thisIsALongVariableName parseHttpResponseBody createNewSession updateUserProfile deleteExpiredTokens HTMLParserError
2024-01-31 1999-12-31 20240131 2021-06-15-10-30 4111111111111111 5500005555555559 1234567890123456 0123456789
9807915762804491 4465758382889437 212-555-0187 49-30-1234567 000000000000 123-456-789 978-3-16-148410-0 3000000
test_results_2023 version-1-2-3 chapter_12_section_4 release-2024-05 image_0001 figure-12 page_100 build-4711 v2_final
some-long-page-title-with-words how-to-write-good-tests the-quick-brown-fox-jumps customer_order_line_items
order_id customer_name created_at updated_at is_active total_amount line_number shipping_address billing_address
README_FIRST LICENSE_AGREEMENT IMPORTANT_NOTICE TABLE_OF_CONTENTS WEITERE_INFORMATIONEN CONDITIONS_GENERALES
aaaaaaaaaaaaaaaa xxxxxxxxxxxx ---------------- ================ ________________ abcdefghijklmnop hahahahahaha
understanding information development environment government international organization administration
nevertheless notwithstanding straightforward misunderstanding representative approximately relationship
und/oder entweder/oder and/or either/or his/her w/o input/output read/write on/off true/false
loremipsumdolorsitamet consecteturadipiscing seddoeiusmodtempor incididuntutlabore etdoloremagnaaliqua
ofthepeopleandforthe whichwouldhavebeen thereforeitshouldbe dasistnichtmehrso einegrossemenge lesgrandesvilles
"""


def labelled(spark: SparkSession, samples: int = SAMPLES) -> DataFrame:
    """(random, text): the samples above, and random ones in four alphabets, cut from digests of numbers."""
    words = ",".join(ORDINARY.split())
    ordinary = spark.range(1).select(F.lit(False).alias("random"), F.explode(F.split(F.lit(words), ",")).alias("text"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.base64(F.unhex(digest))
    alphabets = F.array(digest, base64, F.regexp_replace(base64, "[+/=]", ""), F.upper(F.regexp_replace(base64, "[+/=]", "")))
    return ordinary.unionByName(spark.range(samples).select(F.lit(True).alias("random"), F.explode(alphabets).alias("text")))


def _class(code: Column) -> Column:
    """0 digits, 1 capitals, 2 small letters, 3 other signs."""
    at = code + LOW
    return F.when(at.between(48, 57), 0).when(at.between(65, 90), 1).when(at.between(97, 122), 2).otherwise(3)


# Fixed value: characters of each class among the codes.
CLASS_SIZES = (10, 26, 26, 5)


def _codes(text: Column) -> Column:
    return F.transform(urls.chars(text), lambda c: F.ascii(c) - LOW)


def _neighbours(codes: Column) -> Column:
    """Numbers of the cells (first, second) of all two neighbouring characters."""
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * WIDE + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random to ordinary) of each cell, from ``samples(random, text)``.

    A model gives the chance of a character after another: counted neighbours, weighed against how often a character of that class
    follows one of that class. The result has a fixed size. Characters beyond the codes are left out; a null text or label is none.
    """
    spark = samples.sparkSession
    text = F.regexp_replace("text", f"[^{LETTERS}]", "")
    found = samples.where("random IS NOT NULL").select(
        F.col("random").cast("int").alias("model"), F.explode(_neighbours(_codes(text))).alias("cell"))
    counted = found.groupBy("model", "cell").agg(F.count("*").alias("n"))
    # One row per model and cell, whatever the samples.
    cells = spark.range(2 * WIDE * WIDE).select(
        (F.col("id") % 2).cast("int").alias("model"), F.floor(F.col("id") / 2).cast("int").alias("cell"))
    a, b = F.floor(F.col("cell") / WIDE), F.col("cell") % WIDE
    full = cells.join(counted, ["model", "cell"], "left").select(
        "model", "cell", a.alias("a"), _class(a).alias("ca"), _class(b).alias("cb"), F.coalesce("n", F.lit(0)).alias("n"))
    after = full.groupBy("model", "a").agg(F.sum("n").alias("n_a"))
    classes = full.groupBy("model", "ca", "cb").agg(F.sum("n").alias("n_cc"))
    after_class = full.groupBy("model", "ca").agg(F.sum("n").alias("n_c"))
    size = F.get(F.array(*map(F.lit, CLASS_SIZES)), F.col("cb"))
    by_class = (F.col("n_cc") + 1) / (F.col("n_c") + len(CLASS_SIZES)) / size
    chance = F.log((F.col("n") + PRIOR * by_class) / (F.col("n_a") + PRIOR))
    ratios = (
        full.join(after, ["model", "a"]).join(classes, ["model", "ca", "cb"]).join(after_class, ["model", "ca"])
        .groupBy("cell").agg(F.sum(F.when(F.col("model") == 1, chance).otherwise(-chance)).alias("ratio")))
    return [r["ratio"] for r in ratios.orderBy("cell").collect()]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of ``LETTERS``."""
    cells = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    return F.aggregate(_neighbours(_codes(token)), F.lit(0.0), lambda total, cell: total + F.get(cells, cell))


SPAN = "array<struct<begin:bigint,kind:int,end:bigint>>"


def _spans(hits: Column, gaps: Column, kind: int, passes) -> Column:
    """Places of the hits that pass, from the lengths of all hits and of the text before each."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["hit"])
        span = F.array(F.struct(begin.cast("bigint").alias("begin"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end"))).cast(SPAN)
        return F.struct(
            end.cast("bigint").alias("at"),
            F.when(passes(x["hit"]), F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda state: state["found"])).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of (begin, kind, end) in code points, to documents; kinds are numbers into ``KINDS``.

    ``base`` holds what the patterns find, by start, then kind; ``spans`` also random tokens that touch no base span. A null or empty
    text has none. Long texts are searched whole. Rows stay as they are, repeated ones get equal results; an empty table gives no
    rows. Columns named base or spans are replaced, all others stay, whatever their names.
    """
    model = train(labelled(docs.sparkSession)) if model is None else model
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    rows = docs.drop("base", "spans")
    # The other columns travel in one struct, so that working names cannot clash with theirs.
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    hits = kept.select("row", "text", *[
        F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"hits{i}") for i, p in enumerate(patterns)])
    gaps = hits.select("row", *[f"hits{i}" for i in range(4)], *[
        F.when(F.size(f"hits{i}") > 0, F.split("text", p, -1)).alias(f"gaps{i}") for i, p in enumerate(patterns)])
    passes = (
        lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGNED,
        lambda h: F.lit(True), lambda h: F.lit(True),
        lambda h: ratio(h, model) >= RATIO)
    placed = gaps.select("row", *[
        _spans(F.col(f"hits{i}"), F.col(f"gaps{i}"), i, p).alias(f"spans{i}") for i, p in enumerate(passes)])
    based = placed.select("row", F.sort_array(F.concat("spans0", "spans1", "spans2")).alias("base"), "spans3")
    free = F.filter("spans3", lambda x: ~F.exists("base", lambda b: (b["begin"] < x["end"]) & (x["begin"] < b["end"])))
    spans = F.when(F.size("spans3") > 0, F.sort_array(F.concat("base", free))).otherwise(F.col("base"))
    return based.select("row", "base", spans.alias("spans")).select("row.*", "base", "spans")


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added); the counts and the digest are of base spans."""
    found = find(docs.select("doc_id", "text"), model)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))
