"""Search over names and paths: one scan whatever the number of patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import LOWER, UPPER, ascii_lower
from ..functions.regex import parse, to_java
from ..session import cut

_FOLD = str.maketrans(UPPER, LOWER)


def contains(column: Column, pattern: str, literal: bool = False) -> Column:
    """Substring in any ASCII case. % and _ are wildcards unless `literal`."""
    p = pattern.translate(_FOLD)
    if literal:
        return F.contains(ascii_lower(column), F.lit(p))
    escape = next(c for c in "|!#~^`\x01" if c not in p)
    return F.like(ascii_lower(column), F.lit(f"%{p}%"), F.lit(escape))


def glob_to_like(glob: str) -> str:
    return re.sub(r"[%_\\]", r"\\\g<0>", glob).replace("*", "%").replace("?", "_")


def matches_glob(column: Column, glob: str) -> Column:
    return F.like(ascii_lower(column), F.lit(glob_to_like(glob.translate(_FOLD))))


def matches_regex(column: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Unanchored; an invalid pattern, or one with look-around or back-references, is an error here and now."""
    return F.rlike(column, F.lit(to_java(pattern, case_sensitive)))


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def predicate(pattern: str, kind: str = "auto", case_sensitive: bool = False, literal: bool = False, folded: str | None = None) -> Column:
    """`folded`: the column that holds names folded, where there is one; equality on it reaches the files."""
    name = F.col("name")
    if kind == "regex":
        return matches_regex(name, pattern, case_sensitive)
    if kind == "exact":
        return (F.col(folded) if folded else ascii_lower(name)) == pattern.translate(_FOLD)
    if kind == "path":
        return contains(F.col("full_path"), pattern, literal)
    if kind == "glob" or kind == "auto" and is_glob(pattern):
        return matches_glob(name, pattern)
    return contains(name, pattern, literal)


def expand_patterns(patterns: list[str]) -> list[str]:
    """Also looks for a pattern's dots as spaces and left out, or, where it has none, its spaces as dots and left out; several
    plain patterns also joined as one."""
    plain = [p for p in (x.strip() for x in patterns) if p]
    out: list[str] = []
    add = lambda *xs: out.extend(x for x in xs if x not in out)
    for p in plain:
        add(p)
        if is_glob(p):
            continue
        if "." in p:
            add(*(x for x in (p.replace(".", " "), p.replace(".", "")) if x))
        elif " " in p:
            add(p.replace(" ", "."), p.replace(" ", ""))
    simple = [p for p in plain if not is_glob(p) and "." not in p and " " not in p]
    if len(simple) > 1:
        add("".join(simple), ".".join(simple))
    return out


def search(files: DataFrame, patterns: list[str], mode: str = "any", kind: str = "auto", expand: bool = False, case_sensitive: bool = False, literal: bool = False, drives: tuple[str, ...] = (), only: str | None = None, sort: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose name (or path) matches any or all patterns; no pattern, no row."""
    wanted = expand_patterns(patterns) if expand and mode == "any" and kind != "regex" else patterns
    tests = [predicate(p, kind, case_sensitive, literal, "name_lc" if "name_lc" in files.columns else None) for p in wanted]
    out = files.where(reduce(or_ if mode == "any" else and_, tests) if tests else F.lit(False))
    out = filter_type(filter_drives(out, drives), only)
    if sort:
        out = out.orderBy(*([F.desc("size"), "full_path"] if sort == "size" else [sort, "full_path"]))
    return out if limit is None else out.limit(limit)


def filter_drives(files: DataFrame, drives: tuple[str, ...]) -> DataFrame:
    letters = [d[:1].upper() for d in drives if d]
    return files.where(F.upper(F.substring("full_path", 1, 1)).isin(letters)) if letters else files


def filter_type(files: DataFrame, only: str | None) -> DataFrame:
    return files if only is None else files.where(F.col("is_directory") if only == "dirs" else ~F.col("is_directory"))


def filter_path_prefix(files: DataFrame, roots: list[str]) -> DataFrame:
    return files.where(reduce(or_, (F.lower("full_path").startswith(r.lower()) for r in roots), F.lit(False)))


def filter_ignored(files: DataFrame) -> DataFrame:
    return files.where(~(F.contains("full_path", F.lit("$Recycle")) | F.contains("full_path", F.lit("#Recycle"))))


def excluded(path: Column, patterns: list[str]) -> Column:
    def one(p: str) -> Column:
        if p.startswith("*") and not p.endswith("*"):
            return path.endswith(p[1:])
        if p.endswith("*") and not p.startswith("*"):
            return path.startswith(p[:-1])
        return path.contains(p.strip("*"))

    return reduce(or_, (one(p) for p in patterns if p.strip("*")), F.lit(False))


def filter_excludes(files: DataFrame, patterns: list[str], ancestors: Column) -> DataFrame:
    """Without excluded rows and what is below excluded directories."""
    return files.where(~(excluded(F.col("full_path"), patterns) | F.exists(ancestors, lambda a: excluded(a, patterns))))


def filter_hidden(files: DataFrame, ancestors: Column) -> DataFrame:
    """Without names that start with a dot, unless with .tmp, and without what is below them."""
    base = lambda p: F.element_at(F.split(p, r"[\\/]"), -1)
    hidden = lambda n: n.startswith(".") & ~n.startswith(".tmp")
    return files.where(~(hidden(F.col("name")) | F.exists(ancestors, lambda a: hidden(base(a)))))


def filter_event_excludes(events: DataFrame, parts: list[str], column: str = "path") -> DataFrame:
    return events.where(~reduce(or_, (F.contains(column, F.lit(p)) for p in parts), F.lit(False)))


#: Letters of a gram; tasks among which names are dealt that patterns without any gram ask for.
GRAM, SPREAD = 3, 64
#: Letters that case-insensitive expressions take for ASCII ones (fixed values).
ALIKE, ASCII = "\u017f\u212a\u0131\u0130", "skii"
_ALIKE = str.maketrans(ALIKE, ASCII)


def _grams(needs: list[frozenset[str]]) -> list[list[str]]:
    """Sets of grams of which a match holds one each, of the greatest length there is: every gram of a text that is needed, or
    one of each of several texts. Without any, the empty gram, which all names hold."""
    for n in range(GRAM, 0, -1):
        sets = []
        for texts in needs:
            if min(map(len, texts)) >= n:
                cuts = [[t[i : i + n] for i in range(len(t) - n + 1)] for t in (x.translate(_ALIKE) for x in texts)]
                sets += [(g,) for g in cuts[0]] if len(cuts) == 1 else [tuple(sorted({c[0] for c in cuts}))]
        if sets:
            return [list(x) for x in dict.fromkeys(sets)]
    return [[""]]


def _test(pattern: str, kind: str, case_sensitive: bool) -> tuple[str, str, list[list[str]]]:
    """How a name is tested, with what, and the sets of grams."""
    p = pattern.translate(_FOLD)
    if kind == "auto":
        kind = "glob" if is_glob(pattern) else "plain"
    if kind == "regex":
        test, needs = parse(pattern, case_sensitive)
    elif kind == "glob":
        test, needs = glob_to_like(p), [frozenset((x,)) for x in re.split(r"[*?]+", p) if x]
    elif kind in ("plain", "exact"):
        test, needs = p, [frozenset((p,))] if p else []
    else:
        raise ValueError(f"kind {kind!r} of pattern {pattern!r}")
    return kind, test, _grams(needs)


def _tests(case_sensitive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_test(p, k, case_sensitive) for p, k in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([*batch.columns, *(pa.array([t[i] for t in told], t_) for i, t_ in enumerate((pa.string(), pa.string(), pa.list_(pa.list_(pa.string())))))], names=["_p", "_k", "_how", "_test", "_sets"])

    return run


def multi_query_search(files: DataFrame, queries: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """query_id and rows for a table of saved searches of any size: query_id, pattern, and a kind (plain, glob, regex, exact,
    or auto: glob where it has a wildcard; without one, plain). `case_sensitive` is about regular expressions.

    Distinct names and patterns meet by grams and are compared then. A pattern tells sets of grams of which each match holds
    one: those of its literal text, of a glob's pieces, of the texts that an expression needs. The grams are counted in the
    names, and the set that fewest names hold is the one to meet by. Patterns without any gram, such as an empty one, meet
    every name, dealt among tasks. Only names travel; rows come by their names in the end. Rows without a name, and null
    patterns, find nothing; repeated searches give repeated rows. A pattern that is none is an error at the call.
    """
    kind = F.coalesce("kind", F.lit("plain")) if "kind" in queries.columns else F.lit("plain")
    asked = queries.select("query_id", F.col("pattern").alias("_p"), kind.alias("_k")).where("_p IS NOT NULL")
    told = cut(asked.select("_p", "_k").distinct().mapInArrow(_tests(case_sensitive), "_p string, _k string, _how string, _test string, _sets array<array<string>>"))
    wanted = told.select("_p", "_k", F.posexplode("_sets").alias("_c", "_set")).select("_p", "_k", "_c", F.explode("_set").alias("_g"))
    sizes = sorted(r[0] for r in wanted.select(F.length("_g")).distinct().collect())  # GRAM + 1 at most

    low, folded = ascii_lower(F.col("name")), F.translate("name", UPPER + ALIKE, LOWER + ASCII)
    none = F.array().cast("array<string>")
    grams_of = lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.substring(folded, i, F.lit(n)))
    cuts = [F.when(F.length("name") >= n, grams_of(n)).otherwise(none) if n else F.array(F.lit("")) for n in sizes]
    names = files.select("name").where("name IS NOT NULL").distinct()
    grams = names.select("name", F.explode(F.array_distinct(F.concat(none, *cuts))).alias("_g"))

    held = grams.join(wanted.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    cost = wanted.join(held, "_g", "left").groupBy("_p", "_k", "_c").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_n"))
    best = cost.groupBy("_p", "_k").agg(F.min(F.struct("_n", "_c"))["_c"].alias("_c"))
    chosen = told.join(best, ["_p", "_k"]).select("_p", "_k", "_how", "_test", F.col("_sets")[F.col("_c")].alias("_set"))

    every = F.col("_g") == ""
    keys = chosen.withColumn("_g", F.explode("_set")).withColumn("_s", F.explode(F.when(every, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    met = grams.withColumn("_s", F.when(every, F.pmod(F.hash("name"), F.lit(SPREAD))).otherwise(F.lit(0))).join(keys, ["_g", "_s"])
    # A name that holds several grams of a set is looked at with the first of them alone.
    first = F.filter("_set", lambda g: F.contains(folded, g))[0] == F.col("_g")
    fits = F.when(F.col("_how") == "plain", F.contains(low, F.col("_test"))).when(F.col("_how") == "exact", low == F.col("_test")).when(F.col("_how") == "glob", F.like(low, F.col("_test"))).otherwise(F.rlike("name", F.col("_test")))
    found = met.where(first & fits).select("_p", "_k", "name").join(asked, ["_p", "_k"]).select("query_id", "name")
    return files.join(found, "name").select("query_id", *files.columns)


def union_dedupe(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results).dropDuplicates(["full_path"])


def intersect_on_path(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("full_path"), "full_path", "left_semi"), others, first)
