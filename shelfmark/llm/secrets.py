"""Secret scans, with DataFrame and SQL functions only.

Three base kinds are patterns (assign, access, hex). The method adds a fourth, markov: runs of key characters whose letter
pairs are likelier under a character Markov model of random strings than under one of ordinary identifiers. Both models are
counted from labelled samples: the values that the base patterns match (at most `sample` of them, those with the smallest
hash, out of all documents), and the words of at most `sample` documents that they do not match. Each pair of the random
model starts at `PRIOR`, so without any secret to learn from that model is the even one.

Runs are looked for where the base matches are blanked out, one kind after the other. `/`, `_`, `=` and `-` are no part of
the models: pairs with them say nothing. A run is a secret when the log-likelihood ratio of its pairs is `THRESHOLD` on
average, so length alone proves nothing, and one part between such signs has `PART` characters, which those of paths and
UUIDs do not have.

Spans are in code points, end exclusive, in order of begin, then kind; a markov span may overlap a base span that another
base span cuts into. Positions are sums in blocks and texts are taken apart once, so time grows with the text's length alone.
A null text is an empty one and has no spans; repeated rows give repeated results; an empty table gives an empty result;
further columns are kept, as they are and whatever their names, by `redact` alone.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: The base patterns, and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge, the alphabet of their pairs, and the models' parameters.
RUN = "[A-Za-z0-9+/_=-]{16,}"
PART = 13
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+"
SAMPLE, PRIOR, THRESHOLD = 4000, 4, 1.7
REPLACEMENT = "[SECRET]"

_SPANS = "array<struct<begin:int,kind:int,end:int>>"
#: The pattern as it is looked for: a run begins where the character before is none of its own, which spares tries within.
_RUN = f"(?<![A-Za-z0-9+/_=-]){RUN}"
#: One of these is in every text that ASSIGN matches, in lower case.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Elements of an array that one fold takes: a fold copies what it has at each step.
_FOLD = 256


def _bind(value: Column, use) -> Column:
    """What `use` makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(values: Column) -> Column:
    return F.coalesce(F.get(values, F.size(values) - 1), F.lit(0))


def _running(values: Column, join) -> Column:
    """Each element joined with all before it (`join` of two, from 0): folds of blocks, then of the blocks' last ones."""
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / _FOLD).cast("int") - 1, F.lit(0)))
    fold = lambda x: F.aggregate(x, F.array().cast("array<int>"), lambda had, v: F.concat(had, F.array(join(_last(had), v))))
    blocks = F.transform(numbers, lambda b: fold(F.slice(values, b * _FOLD + 1, _FOLD)))

    def whole(parts: Column) -> Column:
        before = fold(F.transform(parts, _last))
        return _bind(before, lambda had: F.flatten(F.transform(parts, lambda part, i: F.transform(part, lambda v: F.when(i > 0, join(F.coalesce(F.get(had, i - 1), F.lit(0)), v)).otherwise(v)))))

    return _bind(blocks, whole)


def _has(text: Column, pattern: str) -> Column:
    """Whether a pattern matches; plain words are looked for first, where it needs one."""
    if pattern != ASSIGN:
        return text.rlike(pattern)
    low = F.lower(text)
    return reduce(or_, (F.contains(low, F.lit(w)) for w in _WORDS)) & text.rlike(pattern)


def _taken_apart(text: Column, pattern: str, value_group: int | None, use) -> Column:
    """What `use` makes of a text's matches (text, value) and gaps, one more."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if value_group:
        pairs = F.arrays_zip(found.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"))
    else:
        pairs = F.transform(found, lambda m: F.struct(m.alias("text"), m.alias("value")))
    return _bind(F.struct(pairs.alias("found"), F.split(text, pattern, -1).alias("gaps")), use)


def _counts(value_group: int | None, value: Column) -> Column:
    return F.char_length(value) >= (ASSIGN_LEAST if value_group else 0)


def _places(parts: Column) -> Column:
    """Begin, end, text and value of each match."""
    sizes = F.transform(parts["found"], lambda m, i: F.char_length(F.get(parts["gaps"], i)) + F.char_length(m["text"]))
    ends = _running(sizes, lambda a, b: a + b)
    return F.transform(F.arrays_zip(ends.alias("end"), parts["found"].alias("m")), lambda x: F.struct((x["end"] - F.char_length(x["m"]["text"])).alias("begin"), x["end"].alias("end"), x["m"]["text"].alias("text"), x["m"]["value"].alias("value")))


def _span(kind: str, place: Column) -> Column:
    return F.struct(place["begin"].alias("begin"), F.lit(KINDS.index(kind)).alias("kind"), place["end"].alias("end"))


def _matches(text: Column, pattern: str, kind: str, value_group: int | None = None) -> Column:
    spans = lambda parts: F.transform(F.filter(_places(parts), lambda m: _counts(value_group, m["value"])), lambda m: _span(kind, m))
    return F.when(_has(text, pattern), _taken_apart(text, pattern, value_group, spans)).otherwise(F.array().cast(_SPANS))


def _blanked(text: Column, pattern: str, value_group: int | None = None) -> Column:
    """The text with spaces in place of the matches that count."""
    blank = lambda m: F.when(_counts(value_group, m["value"]), F.repeat(F.lit(" "), F.char_length(m["text"]))).otherwise(m["text"])
    made = lambda parts: F.concat(F.array_join(F.transform(parts["found"], lambda m, i: F.concat(F.get(parts["gaps"], i), blank(m))), ""), F.element_at(parts["gaps"], -1))
    return _bind(text, lambda t: F.when(_has(t, pattern), _taken_apart(t, pattern, value_group, made)).otherwise(t))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, ordered by begin, then kind."""
    return F.array_sort(F.concat(_matches(text, ASSIGN, "assign", 2), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex")))


def train(docs: DataFrame, sample: int = SAMPLE) -> str:
    """The log-likelihood ratio of each ordered pair of characters, comma-separated, row by row of the alphabet: some four
    thousand numbers, whatever the corpus."""
    every = id_text(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = every.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # at most `sample` ids
    all_of = lambda pattern, group: F.when(_has(F.col("text"), pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
    secret = every.select(F.explode(F.concat(all_of(ASSIGN, 2), all_of(ACCESS, 0), all_of(HEX, 0))).alias("run")).where("char_length(run) >= 8").orderBy(F.xxhash64("run"), "run").limit(sample)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = texts.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("run"))
    samples = secret.select("run", F.lit(1).alias("random")).unionByName(words.select("run", F.lit(0).alias("random")))
    pairs = samples.select("random", F.split("run", "").alias("c")).select("random", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    chars = F.split(F.lit(ALPHABET), "")
    every_pair = docs.sparkSession.range(1).select(F.explode(chars).alias("a")).select("a", F.explode(chars).alias("b")).select("a", "b", F.concat("a", "b").alias("pair"))
    n = len(ALPHABET)
    both = every_pair.join(counts, "pair", "left").fillna(0, ["r", "o"])
    sums = both.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    ratio = F.log((F.col("r") + PRIOR) / (F.col("ra") + PRIOR * n)) - F.log((F.col("o") + 1) / (F.col("oa") + n))
    place = F.instr(F.lit(ALPHABET), F.col("a")) * n + F.instr(F.lit(ALPHABET), F.col("b"))
    # The alphabet's own instr takes a substring; single characters find their place.
    table = both.join(sums, "a").select(place.alias("at"), F.round(ratio, 4).cast("string").alias("x")).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]), ",").alias("t"))
    return table.first()[0]


def ratio(run: Column, table: str) -> Column:
    """The average log-likelihood ratio of a run's pairs of the alphabet; 0 without any."""
    n = len(ALPHABET)
    ratios = F.split(F.lit(table), ",").cast("array<double>")  # folded once into a constant
    codes = F.split(F.lit(",".join(str(ALPHABET.find(chr(i))) for i in range(128))), ",").cast("array<int>")
    letters = F.transform(F.split(run, ""), lambda c: F.get(codes, F.ascii(c)))

    def step(had: Column, code: Column) -> Column:
        counted = (had["before"] >= 0) & (code >= 0)
        return F.struct(code.alias("before"), (had["sum"] + F.when(counted, F.get(ratios, had["before"] * n + code)).otherwise(0.0)).alias("sum"), (had["n"] + counted.cast("int")).alias("n"))

    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(letters, start, step, lambda x: x["sum"] / F.greatest(x["n"], F.lit(1)))


def _markov(text: Column, table: str) -> Column:
    rest = _blanked(_blanked(_blanked(text, ASSIGN, 2), ACCESS), HEX)
    secret = lambda m: m["text"].rlike(f"[A-Za-z0-9+]{{{PART},}}") & (ratio(m["text"], table) >= THRESHOLD)
    found = lambda t: F.when(t.rlike(_RUN), _taken_apart(t, _RUN, None, lambda parts: F.transform(F.filter(_places(parts), secret), lambda m: _span("markov", m)))).otherwise(F.array().cast(_SPANS))
    return _bind(rest, found)


def find(docs: DataFrame, table: str | None = None) -> DataFrame:
    """doc_id, text, base (spans) and spans (base ones and those of the models); no shuffle."""
    table = train(docs) if table is None else table
    rows = id_text(docs).withColumn("base", base_spans(F.col("text")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", _markov(F.col("text"), table))))


def _joined(spans: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, table: str | None = None) -> DataFrame:
    """The documents with every secret replaced; n_chars, where there is such a column, follows. No document goes."""
    table = train(docs) if table is None else table
    own = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("text"), F.array_sort(F.concat(base_spans(own), _markov(own, table))).alias("spans"))

    def cleaned(x: Column) -> Column:
        reach = lambda i: F.coalesce(F.get(x["reach"], i), F.lit(0))
        between = lambda a, b: F.array_join(F.slice(x["chars"], a + 1, F.greatest(b - a, F.lit(0))), "")
        pieces = F.transform("spans", lambda s, i: F.when(s["begin"] >= reach(i - 1), F.concat(between(reach(i - 1), s["begin"]), F.lit(REPLACEMENT))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), between(reach(F.size("spans") - 1), F.size(x["chars"])))

    # How far the spans up to each one reach; the text's characters are cut out of one array.
    parts = F.struct(_running(F.transform("spans", lambda s: s["end"]), F.greatest).alias("reach"), F.split("text", "").alias("chars"))
    rows = rows.select("row", "spans", F.when(F.size("spans") == 0, F.col("row.text")).otherwise(_bind(parts, cleaned)).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
