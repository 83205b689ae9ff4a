"""Secret scans: three patterns, and character Markov models compared by log-likelihood ratio; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import unused

#: Fixed values of the contract: kinds in the order of the digest, each with its pattern, the part that is measured, and that part's least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Values that a scan gathers at a time.
BLOCK = 128
#: `[0-9a-f]+` meets a short run in most words; runs are maximal, so asking for the least length finds the same spans.
FAST = {"hex": r"[0-9a-f]{24,}"}
MARKOV = "markov"
#: Runs of 20 characters and more; and for texts with assignments also the runs that these begin in, so that they aren't taken for runs of their own.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
BESIDE_ASSIGNMENTS = rf"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_=-]*?{BASE[0][1]}|{CANDIDATE})"
#: Made samples of each class that the Markov models are trained on.
TRAINING_TOKENS = 4000
#: Documents whose words are samples of the ordinary class: those with the smallest hash of their id.
TRAINING_DOCUMENTS = 2000
#: What counts as an ordinary identifier of a text: words, joined or not, with a short number behind them at most.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?:[_/-][A-Za-z]+)*[0-9]{0,3}(?![A-Za-z0-9+/_=-])"
#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "account action address agent album alert amount answer array author balance batch block board body book branch buffer build button cache call card case channel chart check child city class client "
    "close cloud code color column command comment config content context control copy count country create current customer daily data date default delete detail device display document domain driver "
    "email entry error event example export factor field file filter first folder format frame function gateway group handle header height history image import index input insert instance invoice item "
    "label language last layer layout length level library limit line link list local location lower manager market master match member memory message method minute model module month name network node "
    "number object offset option order output owner package page parent path payment person phone place plan point policy position price primary process product profile project property query queue random "
    "range record region release remote report request reset result return review role route sample schema search second section select server session setting shape signal simple single size source stage"
)
#: Bytes 0x20 to 0x7F; whatever else is counted with the first of them.
ALPHABET = 96


def let(value: Column, f) -> Column:
    """f(value), with value worked out once a row, even where f uses it inside a function of arrays."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scanned(values: Column, start: Column, step, kind: str) -> Column:
    """An array of what step(state, value) gives for each value in turn: a struct of the next state and an out of type `kind`.

    An array can't grow in place, so a scan that appends to one array would take time with the square of its length. The
    values go block by block: outs are gathered for a block, blocks for the array.
    """
    none = F.array().cast(f"array<{kind}>")
    each = lambda acc, v: F.transform(F.array(step(acc["state"], v)), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["outs"], F.array(s["out"])).alias("outs")))[0]
    inner = lambda acc, block: F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("outs")), each)
    outer = lambda acc, block: F.transform(F.array(inner(acc, block)), lambda x: F.struct(x["state"].alias("state"), F.concat(acc["blocks"], F.array(x["outs"])).alias("blocks")))[0]
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    whole = lambda v: F.aggregate(blocks(v), F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks")), outer, lambda acc: F.flatten(acc["blocks"]))
    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost, non-overlapping matches as an array of (start, end, match), in code points: what lies between them, from split, gives the places."""
    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("state"), F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")).alias("out"))

    kind = "struct<start:int,end:int,match:string>"

    def of(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
        return F.when(F.size(found) > 0, scanned(pairs, F.lit(0), step, kind)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def long_enough(spans: Column, kind: str) -> Column:
    """The spans of a kind of BASE whose measured part has its least length."""
    _, pattern, part, least = next(b for b in BASE if b[0] == kind)
    measured = (lambda m: F.length(F.regexp_extract(m, pattern, part))) if part else F.length
    return F.filter(spans, lambda s: measured(s["match"]) >= least)


def labelled_tokens(spark: SparkSession, n: int = TRAINING_TOKENS) -> DataFrame:
    """n random strings (is_random) and n ordinary identifiers, made from hashes of their number: (token, is_random)."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    length = (F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(21))).cast("int")
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 64)).when(F.col("id") % 4 == 1, F.upper(base64)).otherwise(base64)
    pick = lambda salt: F.element_at(F.split(F.lit(IDENTIFIER_WORDS), " "), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(IDENTIFIER_WORDS.split()))) + 1).cast("int"))
    a, b, c, number = pick(1), pick(2), pick(3), F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")
    identifier = (
        F.when(F.col("id") % 5 == 0, F.concat_ws("_", a, b, c))
        .when(F.col("id") % 5 == 1, F.concat(a, F.initcap(b), F.initcap(c), number))
        .when(F.col("id") % 5 == 2, F.upper(F.concat_ws("_", a, b, number)))
        .when(F.col("id") % 5 == 3, F.concat_ws("-", a, b, c, number))
        .otherwise(F.concat_ws("/", a, b, c))
    )
    ids = spark.range(n)
    return ids.select(random.substr(F.lit(1), length).alias("token"), F.lit(True).alias("is_random")).unionAll(ids.select(identifier.alias("token"), F.lit(False).alias("is_random")))


def ordinary_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(token, is_random) of the identifiers in at most `most` of the texts, eight characters and more: each once, none of them random.

    Documents are chosen by the smallest hash of their id; of rows that share an id the first by text counts, null ids and
    texts are passed over. Values that are assigned to a name of BASE are no samples.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id IS NOT NULL AND _text IS NOT NULL")
    chosen = rows.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = rows.join(F.broadcast(chosen), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))
    clean = F.regexp_replace("_text", BASE[0][1], " ")
    tokens = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(ORDINARY), F.lit(0)))).alias("token"))
    return tokens.filter("length(token) >= 8").distinct().withColumn("is_random", F.lit(False))


def trained_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """A model from made random strings and identifiers, and from the identifiers of the table's own texts."""
    return train(labelled_tokens(docs.sparkSession).unionByName(ordinary_tokens(docs, id_col, text_col)))


def code_of(token: Column, at: Column) -> Column:
    code = F.ascii(token.substr(at, F.lit(1))) - 32
    return F.when((code >= 0) & (code < ALPHABET), code).otherwise(0)


def train(samples: DataFrame) -> list[float]:
    """log P(next | last, random) - log P(next | last, identifier) for each pair of characters, as a list of ALPHABET ** 2 numbers.

    samples: (token, is_random), a row each; a null token or label is passed over. What reaches the driver is one row for each
    pair of characters at most. Pairs that a class has never shown count half a time.
    """
    pairs = samples.filter("token IS NOT NULL AND is_random IS NOT NULL AND length(token) > 1").select(
        "is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: code_of(F.col("token"), i) * ALPHABET + code_of(F.col("token"), i + 1))).alias("pair")
    )
    counts = {(r["is_random"], r["pair"]): r["n"] for r in pairs.groupBy("is_random", "pair").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(ALPHABET):
        row = {kind: [counts.get((kind, a * ALPHABET + b), 0) + 0.5 for b in range(ALPHABET)] for kind in (True, False)}
        sums = {kind: math.log(sum(row[kind])) for kind in row}
        out += [math.log(x) - sums[True] - math.log(y) + sums[False] for x, y in zip(row[True], row[False])]
    return out


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions: above 0, it is likelier a random string than an identifier."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")  # folded into one constant
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, (code_of(token, i) * ALPHABET + code_of(token, i + 1) + 1).cast("int")))
    return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(0.0)


def secret_spans(docs: DataFrame, text_col: str = "text", out_col: str = "_spans", model: list[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with a column out_col: array of (start, end, kind), in order of start, then kind as BASE lists them, the method's own last.

    Base spans are the matches of BASE whose measured part is long enough. The method adds the runs of 20 characters that hold a
    letter and a digit, touch no assignment, hold no access key or long hex run, and whose mean log-likelihood ratio is at
    least threshold; each of these is seen from the run itself. Null counts as empty. All columns of docs stay, but for one
    that has out_col's name.
    """
    of_assign, of_base = unused(docs, "_assign", "_base")
    model = model or train(labelled_tokens(docs.sparkSession))
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = {kind: k for k, kind in enumerate([*(b[0] for b in BASE), MARKOV])}
    tagged = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order[kind]).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    patterns = {kind: FAST.get(kind, pattern) for kind, pattern, *_ in BASE}
    assigned = docs.withColumn(of_assign, spans_of(text, patterns["assign"]))
    spans = {kind: F.col(of_assign) if kind == "assign" else spans_of(text, pattern) for kind, pattern in patterns.items()}
    base = assigned.withColumn(of_base, F.concat(*(tagged(long_enough(spans[kind], kind), kind) for kind in patterns)))
    clear = lambda m: m.rlike("^[A-Za-z0-9+/_=-]+$") & ~m.rlike(BASE[0][1]) & ~m.rlike(r"AKIA[A-Z0-9]{16}") & ~m.rlike(r"[0-9a-f]{24}")
    likely = lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]") & clear(s["match"])
    runs = F.when(F.size(of_assign) > 0, spans_of(text, BESIDE_ASSIGNMENTS)).otherwise(spans_of(text, CANDIDATE))
    more = F.filter(F.filter(runs, likely), lambda s: log_ratio(s["match"], model) >= threshold)
    every = F.array_sort(F.concat(of_base, tagged(more, MARKOV)))
    return base.withColumn(out_col, F.transform(every, lambda s: F.struct(s["start"], s["end"], s["kind"]))).drop(of_base, of_assign)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans per row: a row-wise scan of the whole text, without a shuffle.

    Null and empty texts have no spans (the digest is that of the empty string); rows that repeat give repeated rows, and
    extra columns are ignored. Without a model, one is trained by trained_on(): a constant of ALPHABET ** 2 numbers, whatever
    the table's size.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = secret_spans(rows, "_text", "_spans", model or trained_on(rows, "_id", "_text"), threshold).select("_id", "_spans")
    of = lambda kind: F.filter("_spans", lambda s: s["kind"] == kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("_id").alias(id_col),
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE),
        F.sha2(joined(F.filter("_spans", lambda s: s["kind"] != MARKOV)), 256).alias("base_sha256"),
        joined("_spans").alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", model: list[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs, with each secret in text_col replaced by mark (overlapping spans by one). A text without secrets, or null, stays as it is.

    Rows that repeat give repeated rows, an empty table none; the other columns stay, whatever their names.
    """
    (out,) = unused(docs, "_spans")
    found = secret_spans(docs, text_col, out, model or trained_on(docs, id_col, text_col), threshold)
    # The state is the place up to which the text is told: what lies before a span is copied, a span that begins inside the last one adds no mark.
    text = F.col(text_col)

    def step(at: Column, s: Column) -> Column:
        told = F.when(s["start"] < at, "").otherwise(F.concat(text.substr(at + 1, s["start"] - at), F.lit(mark)))
        return F.struct(F.greatest(at, s["end"]).alias("state"), told.alias("out"))

    whole = F.concat(F.array_join(scanned(F.col(out), F.lit(0), step, "string"), ""), text.substr(F.array_max(F.transform(out, lambda s: s["end"])) + 1, F.length(text)))
    return found.withColumn(text_col, F.when(F.size(out) > 0, whole).otherwise(text)).drop(out)
