"""Secret scans in DataFrame expressions only.

Base rules name three kinds of spans (assignments, access keys, long hexadecimal runs). The Markov part
adds spans of the kind ``random``: runs of ``RUN_CHARS`` key characters or more, outside of base spans,
whose characters follow each other as in random strings rather than as in ordinary identifiers.
Character Markov models are trained from labelled samples: one on identifiers (``IDENTIFIER_SAMPLES``
names made of ``WORDS`` in the usual styles, with numbers, dates and paths, and the words of sampled
documents), and one on random strings of each alphabet that keys are written in (digests in base 64,
base 32 and hexadecimal, both cases). A run is a secret when the log-likelihood ratio of the likeliest
random model to the identifier model, summed over its character pairs, reaches ``LEAST_RATIO`` and
``LEAST_MEAN`` a pair. Runs of digits alone are numbers, not secrets.

Training reads a bounded sample: the ``TRAINING_DOCUMENTS`` documents with the least hashes of their
id. The model is a few numbers per pair of 66 characters, whatever the corpus. Scanning is one pass over
whole texts without a shuffle; expensive expressions run only for texts that can match. Matches are
placed and texts are masked in chunks (``CHUNK_SPANS`` matches, ``CHUNK_CHARS`` characters), so that the
work grows with the text and its matches, not with their square.

Spans are code points, end exclusive. Defined cases: null text has no spans and stays null; no documents
to train on leave the built names as identifiers; of overlapping spans all are listed, and masked as one;
repeated rows are each returned, whatever their ids; other columns pass through ``redact``, whatever
their names; texts of any length are scanned whole; no rows, no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held, packed_rows, unpacked

# The base patterns.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
ASSIGN_CHARS = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Least length of a run of key characters that the models judge.
RUN_CHARS = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_CHARS},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RATIO = 12.0
#: And the ratio a character pair must have on average.
LEAST_MEAN = 0.6
#: A run of fewer different characters is a rule or a filler.
LEAST_LETTERS = 8
#: Log-ratios are kept as whole thousandths, so that sums don't depend on their order.
SCALE = 1000

TRAINING_DOCUMENTS = 2000
IDENTIFIER_SAMPLES = 6000
RANDOM_SAMPLES = 3000
IDENTIFIER = r"[A-Za-z]{3,}"
#: Words that ordinary identifiers are made of.
WORDS = (
    "abstract access account action address agent align amount archive array attribute author backup balance batch binary border bridge buffer button byte"
    " cache calendar catalog channel check class client code column command comment config connection context control convert cookie count custom data"
    " database date debug decode default delete depth detail device directory document domain driver dynamic editor element email encode engine entity error"
    " event example exception execute export factory feature field file filter flag format frame function gateway global graph group handler hash header"
    " height history host http identifier image index info input insert interface invalid item json kernel key keyword language layout length level library"
    " link list load lock logger machine manager mapping memory message method model module monitor name network node normalize notify number object option"
    " order output package parameter parse path pattern pixel plugin policy pool port prefix process project property protocol proxy query queue random range"
    " record reference registry remote request reset resource response result return route schema search select sequence server service session setting"
    " shape signal size socket source stack state status stream string subject switch symbol system table target task template test text thread time timeout"
    " token transform tree type unique update upload user utility value variable vector version video view warning window wrapper write xml year zone"
).split()
#: Labels of the samples: identifiers, then random strings by alphabet.
MODELS = ("identifier", "base64", "hex", "HEX", "base32", "BASE32")

CHUNK_SPANS = 512
CHUNK_CHARS = 32_768
MASK = "[SECRET]"


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, hint: str | None = None, value_chars: int = 0) -> Column:
    """Spans (start, kind, end, value) of the matches of a pattern, leftmost and non-overlapping.

    Starts are sums of the lengths of the matches and of the stretches between them, made within chunks
    of matches first and then over the chunks.
    """
    p = F.lit(pattern)
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(2)) if value_chars else found
    rows = F.arrays_zip(between.alias("gap"), F.transform(found, lambda x: F.length(x)).alias("size"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.when(
            x["size"].isNotNull(), F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
        ).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(f"struct<at:int,out:{_SPANS}>")
    outer = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(f"struct<at:int,out:array<struct<at:int,own:{_SPANS}>>>")
    shift = lambda acc, c: F.struct(
        (acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), c["out"].alias("own")))).alias("out")
    )
    moved = lambda c: F.transform(
        c["own"], lambda s: F.struct((s["start"] + c["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + c["at"]).alias("end"), s["value"].alias("value"))
    )

    def placed(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK_SPANS).cast("int"))
        own = F.transform(numbers, lambda c: F.aggregate(F.slice(rows, c * CHUNK_SPANS + 1, CHUNK_SPANS), start, step))
        return F.flatten(F.transform(F.aggregate(own, outer, shift)["out"], moved))

    # A variable of a lambda is computed once, an expression at each use.
    out = F.flatten(F.transform(F.array(rows), placed))
    if value_chars:
        out = F.filter(out, lambda s: F.length(s["value"]) >= value_chars)
    fits = text.rlike(pattern) if hint is None else text.rlike(hint) & text.rlike(pattern)
    return F.when(fits, out).otherwise(F.array().cast(_SPANS))


def _masked(text: Column, spans: Column, mask) -> Column:
    """``text`` with sorted spans replaced by what ``mask`` gives for their length, overlapping ones as one; chunk by chunk."""

    def chunk(x: Column) -> Column:
        low, own = x["low"], x["own"]
        high = low + F.length(own)

        def step(acc: Column, s: Column) -> Column:
            end = F.least(s["end"], high)
            new = F.greatest(s["start"], acc["at"])
            clear = F.substring(own, acc["at"] - low + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            shown = F.when(s["start"] >= acc["at"], mask(end - new, True)).otherwise(mask(end - new, False))
            return F.when(end > acc["at"], F.struct(end.alias("at"), F.concat(acc["out"], clear, shown).alias("out"))).otherwise(acc)

        here = F.filter(spans, lambda s: (s["start"] < high) & (s["end"] > low))
        done = lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] - low + 1, F.lit(CHUNK_CHARS)))
        return F.aggregate(here, F.struct(low.alias("at"), F.lit("").alias("out")), step, done)

    numbers = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / CHUNK_CHARS).cast("int"))
    # A variable of a lambda is computed once, an expression at each use.
    chunks = F.transform(numbers, lambda c: F.struct((c * CHUNK_CHARS).alias("low"), F.substring(text, c * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("own")))
    return F.array_join(F.transform(chunks, chunk), "")


def with_base_spans(documents: DataFrame) -> DataFrame:
    """``documents`` (text and columns without a leading underscore) with the arrays _assign, _access and _hex of spans (start, kind, end, value)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumn("_text", text)
    return held(
        rows,
        _assign=_spans(F.col("_text"), ASSIGN, 0, ASSIGN_HINT, ASSIGN_CHARS),
        _access=_spans(F.col("_text"), ACCESS, 1),
        _hex=_spans(F.col("_text"), HEX, 2),
    )


def _pairs(samples: DataFrame) -> DataFrame:
    """(label, a, b, n): counts of character pairs of labelled strings; other characters are 0."""
    codes = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    coded = samples.select("label", codes.alias("c")).filter(F.size("c") >= 2)
    pairs = coded.select("label", F.inline(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))))
    return pairs.groupBy("label", "a", "b").agg(F.count("*").alias("n"))


def _built_names(spark) -> DataFrame:
    """(value): identifiers of two to five words in the usual styles, drawn by hashes."""
    words = F.array(*map(F.lit, WORDS))
    draw = lambda n, of: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(of)).cast("int")
    own = F.transform(F.sequence(F.lit(0), draw(0, 4) + 1), lambda i: F.get(words, F.pmod(F.xxhash64(F.col("id"), i + 100), F.lit(len(WORDS))).cast("int")))
    rows = spark.range(IDENTIFIER_SAMPLES).select("id", own.alias("w"))
    large = F.transform("w", lambda x: F.initcap(x))
    mark = F.get(F.array(*map(F.lit, ("", "-", "_", "/"))), draw(1, 4))
    two = lambda n, of: F.lpad((draw(n, of) + 1).cast("string"), 2, "0")
    date = F.concat((draw(2, 46) + 1990).cast("string"), mark, two(3, 12), mark, two(4, 28))
    number = draw(5, 10_000).cast("string")
    joined = lambda by, words=F.col("w"): F.array_join(words, by)
    camel = F.concat(F.get("w", F.lit(0)), F.array_join(F.slice(large, 2, F.size("w") - 1), ""))
    styles = (
        joined("_"), camel, joined("", large), joined("-"), joined("/"), F.upper(joined("_")), F.concat(joined("/"), F.lit("/"), F.get(large, F.lit(0)), F.get(large, F.lit(1))),
        F.concat(joined("-"), F.lit("-"), number), F.concat(date, F.lit("-"), joined("-")), F.concat(joined("_"), number), F.concat(joined("", large), F.substring(number, 1, 2)),
        F.concat(F.get("w", F.lit(0)), F.lit("/"), date, F.lit("/"), joined("-")),
    )
    return rows.select(F.get(F.array(*styles), draw(6, len(styles))).alias("value"))


def _drawn_strings(spark) -> DataFrame:
    """(label, value): digests in every alphabet that keys are written in."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    lower = F.lower(F.hex(digest))
    # Base 32: five bits a letter, from the bits of the digest.
    bits = F.array_join(F.transform(F.split(lower, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    letters = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    upper32 = F.array_join(letters, "")
    by_label = {"base64": F.base64(digest), "hex": lower, "HEX": F.upper(lower), "base32": F.lower(upper32), "BASE32": upper32}
    plain = F.struct(F.lit(1).alias("label"), F.translate(F.base64(digest), "+/=", "").alias("value"))
    rows = F.array(plain, *(F.struct(F.lit(MODELS.index(k)).alias("label"), v.alias("value")) for k, v in by_label.items()))
    return spark.range(RANDOM_SAMPLES).select(F.inline(rows))


def training_samples(documents: DataFrame) -> DataFrame:
    """(label, value): identifiers (0) and random strings (numbers of MODELS)."""
    spark = documents.sparkSession
    # Ids alone are ranked; the broadcast holds TRAINING_DOCUMENTS of them at most.
    chosen = documents.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCUMENTS)
    few = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), ASSIGN, " "), RUN, " ")
    words = few.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(plain, F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    return _drawn_strings(spark).union(_built_names(spark).select(F.lit(0), "value")).union(words)


def train(documents: DataFrame) -> list[int]:
    """Log-likelihood ratios to identifiers of all pairs of characters, in thousandths, for one random model after the other."""
    width = len(ALPHABET) + 1
    counts = [[0] * (width * width) for _ in MODELS]
    for label, a, b, n in _pairs(training_samples(documents)).collect():  # at most len(MODELS) * width ** 2 rows
        counts[label][a * width + b] = n
    totals = [[sum(c[a * width : (a + 1) * width]) for a in range(width)] for c in counts]
    chance = lambda k, a, b: (counts[k][a * width + b] + 0.5) / (totals[k][a] + 0.5 * width)
    return [round(SCALE * math.log(chance(k, a, b) / chance(0, a, b))) for k in range(1, len(MODELS)) for a in range(width) for b in range(width)]


def _ratio(run: Column, ratios: list[int]) -> Column:
    """Summed log-likelihood ratio of a string under the random model that gives it the greatest."""
    width = len(ALPHABET) + 1
    table = F.from_json(F.lit(str(ratios)), "array<int>")
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * width + b)
    add = lambda k: lambda acc, p: acc + F.get(table, p + k * width * width)
    return F.greatest(*(F.aggregate(pairs, F.lit(0), add(k)) for k in range(len(MODELS) - 1)))


def with_spans(documents: DataFrame, ratios: list[int]) -> DataFrame:
    """``documents`` with base spans, ``_random`` spans and ``_spans``: all of them by start, then kind."""
    rows = held(with_base_spans(documents), _base=F.sort_array(F.concat("_assign", "_access", "_hex")))
    # Outside of base spans: these are blanked, which keeps all places.
    blank = _masked(F.col("_text"), F.col("_base"), lambda size, new: F.repeat(F.lit(" "), size))
    rows = held(rows, _blank=F.when(F.size("_base") > 0, blank).otherwise(F.col("_text")))
    rows = held(rows, _runs=_spans(F.col("_blank"), RUN, 3))

    def secret(s: Column) -> Column:
        pairs = s["end"] - s["start"] - 1
        varied = F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_LETTERS
        return s["value"].rlike("[A-Za-z]") & varied & (_ratio(s["value"], ratios) >= F.greatest(F.lit(LEAST_RATIO * SCALE), LEAST_MEAN * SCALE * pairs))

    rows = held(rows, _random=F.when(F.size("_runs") > 0, F.filter("_runs", secret)).otherwise(F.array().cast(_SPANS)))
    spans = F.when(F.size("_random") > 0, F.sort_array(F.concat("_base", "_random"))).otherwise(F.col("_base"))
    return rows.withColumn("_spans", spans).drop("_runs", "_blank")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(documents: DataFrame, ratios: list[int] | None = None) -> DataFrame:
    """``documents`` with every span of their texts replaced by a mask; same columns."""
    rows = with_spans(packed_rows(documents, "text"), train(documents) if ratios is None else ratios)
    mask = _masked(F.col("_text"), F.col("_spans"), lambda size, new: F.lit(MASK if new else ""))
    masked = held(rows, _done=F.when(F.size("_spans") > 0, mask))
    changed = {"text": F.coalesce("_done", "text")}
    if "n_chars" in documents.columns:
        size = F.length("_done").cast(documents.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_done").isNotNull(), size).otherwise(F.col("_row.n_chars"))
    return unpacked(masked, documents, **changed)
