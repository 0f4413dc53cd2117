"""Text expressions: tokens, titles, ids, markup and globs, as Columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as an identifier or number, where identifiers part, and runs of CJK characters.
TOKEN = r"@?[A-Za-z_$][A-Za-z0-9_$]*(?:[.\-/:\\][A-Za-z0-9_$*]+)*|[0-9]+(?:\.[0-9]+)*"
CAMEL = r"([a-z0-9])([A-Z])"
PARTS = r"[.\-/:\\_$@*\s]+"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]+"


def pieces(raw: Column) -> Column:
    """A raw identifier's full form and its separator and camel-case pieces, lower-cased."""
    split = F.split(F.lower(F.regexp_replace(raw, CAMEL, "$1 $2")), PARTS)
    return F.concat(F.array(F.lower(raw)), F.filter(split, lambda x: x != ""))


def cjk_pieces(run: Column) -> Column:
    """A CJK run of up to 32 characters (twice if it is one character), its pairs and its triples."""
    n = F.length(run)

    def grams(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(run, i, k))).otherwise(F.array().cast("array<string>"))

    whole = F.when(n <= 32, F.array(run)).otherwise(F.array().cast("array<string>"))
    return F.concat(whole, F.when(n == 1, F.array(run)).otherwise(F.array().cast("array<string>")), grams(2), grams(3))


def tokens(text: Column) -> Column:
    """All tokens with repeats (Unicode-normalised text is expected)."""
    latin = F.flatten(F.transform(F.regexp_extract_all(F.regexp_replace(text, CJK, " "), F.lit(f"({TOKEN})"), 1), pieces))
    return F.concat(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({CJK})"), 1), cjk_pieces)), latin)


def _raw_tokens(text: Column) -> Column:
    return F.concat(F.regexp_extract_all(F.regexp_replace(text, CJK, " "), F.lit(f"({TOKEN})"), 1), F.regexp_extract_all(text, F.lit(f"({CJK})"), 1))


def _expanded(counted: DataFrame) -> DataFrame:
    made = F.when(F.col("raw").rlike(CJK), cjk_pieces(F.col("raw"))).otherwise(pieces(F.col("raw")))
    return counted.select("doc_id", "n", F.explode(made).alias("token")).groupBy("doc_id", "token").agg(F.sum("n").alias("tf"))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, token, tf``: identical raw tokens are counted per document before their pieces are made."""
    raw = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(_raw_tokens(F.col(text))).alias("raw"))
    return _expanded(raw.groupBy("doc_id", "raw").agg(F.count("*").alias("n")))


def field_postings(docs: DataFrame, doc_id: str, fields: list[tuple[Column, int]]) -> DataFrame:
    """As :func:`postings`, over several texts each of which counts a number of times."""

    def weighted(text: Column, n: int) -> Column:
        return F.transform(_raw_tokens(F.coalesce(text, F.lit(""))), lambda x: F.struct(x.alias("raw"), F.lit(n).alias("n")))

    parts = [weighted(text, n) for text, n in fields]
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.concat(*parts)).alias("x")).select("doc_id", "x.raw", "x.n")
    return _expanded(raw.groupBy("doc_id", "raw").agg(F.sum("n").alias("n")))


def normalised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with Unicode's NFKC form in the named string columns: the ingest step before tokens, markup and ids."""
    at = [rows.columns.index(c) for c in columns]

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            for i in at:
                values = arrays[i].to_pylist()
                if not all(v is None or v.isascii() for v in values):
                    arrays[i] = pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values], arrays[i].type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return rows.mapInArrow(normal, rows.schema)


def folded(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: the NFKC form of ``column`` in Unicode's case folding (``lower`` keeps ß and final sigma)."""

    at = rows.columns.index(column)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else unicodedata.normalize("NFKC", v).casefold() for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` string"
    return rows.mapInArrow(fold, schema)


#: What plain text loses, in order. Generic types and comparisons stay; a table's bars become full-width semicolons.
MARKUP = ((r"<!--.*?-->", " "), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<https?://[^>]+>", " "), (r"[`*_~]", ""), (r"^\s*>+\s?", ""), (r"\s*\|\s*", "；"), (r"^[； ]+|[； ]+$", ""), (r"\s+", " "))


def strip_markup(text: Column) -> Column:
    """Plain text of normalised Markdown: comments, images, links, autolinks, emphasis marks, quotes and bars go, white space is single."""
    for pattern, new in MARKUP:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def title(section: Column, statement: Column) -> Column:
    """Leaf of the section path and the statement's first sentence, cut to 41 characters and a dot, 80 in all; the leaf isn't repeated."""
    leaf = F.when(F.coalesce(section, F.lit("")) == "", "规范候选").otherwise(F.element_at(F.split(section, " / "), -1))
    first = F.trim(F.element_at(F.split(statement, "[。；;！？!?]", 2), 1))
    short = F.when(F.length(first) > 42, F.concat(F.rtrim(F.substring(first, 1, 41)), F.lit("…"))).otherwise(first)
    both = F.when((leaf != "") & ~F.contains(short, leaf), F.concat(leaf, F.lit("："), short)).when(short != "", short).otherwise(leaf)
    return F.substring(both, 1, 80)


def plain_text(value: str) -> str:
    """:func:`strip_markup` of one string that isn't normalised yet, for parsers that run per document."""
    value = unicodedata.normalize("NFKC", value)
    for pattern, new in MARKUP:
        value = re.sub(pattern, new.replace("$1", r"\1"), value)
    return value.strip()


def stem(document: Column) -> Column:
    """The file name of a path without its folders and last suffix."""
    name = F.element_at(F.split(F.replace(document, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(name.rlike(r".\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def rule_id(prefix: Column, document: Column, section: Column, statement: Column) -> Column:
    """PREFIX-SLUG-HASH: up to 18 characters of the document's name and ten hex digits of all parts' SHA-256."""

    def slug(text: Column, default: str) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.upper(text), r"[^A-Z0-9]+", "-"), r"^-+|-+$", "")
        return F.when(clean == "", default).otherwise(clean)

    digest = F.upper(F.substring(F.sha2(F.concat_ws("\x1f", F.trim(document), F.trim(section), F.trim(statement)), 256), 1, 10))
    return F.concat_ws("-", slug(prefix, "AUTO"), F.substring(slug(stem(document), "POLICY"), 1, 18), digest)


def namespace(document: Column) -> Column:
    """A document's name as the first part of an id: letters, digits, dots and dashes, 96 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(stem(document), r"(?U)[^\w.-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.substring(F.when(clean == "", "document").otherwise(clean), 1, 96)


def qualified_id(space: Column, original: Column, most: int = 240) -> Column:
    """``space::original``; one that is too long is cut on both sides and gets ten hex digits of its SHA-256."""
    whole = F.concat_ws("::", space, original)
    short = F.substring(original, 1, 120)
    room = F.greatest(F.lit(12), F.lit(most - 10 - 3) - F.length(short))
    cut = F.concat(F.substring(space, F.lit(1), room), F.lit("-"), F.substring(F.sha2(whole, 256), 1, 10), F.lit("::"), short)
    return F.when(F.length(whole) <= most, whole).otherwise(cut)


def normal_path(path: Column) -> Column:
    """Forward slashes, single, without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/"), r"^\./", "")


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob over lower-cased paths: ``*`` crosses ``/``, a leading ``**/`` may match nothing."""
    glob = re.sub(r"^\./", "", re.sub("/{2,}", "/", glob.replace("\\", "/"))).lower()
    tail, out, i = glob.removeprefix("**/"), "", 0
    while i < len(tail):
        c, close = tail[i], tail.find("]", i + 2)
        if c == "[" and close > 0:
            inner = tail[i + 1 : close].replace("\\", r"\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.+(){}|^$\[\]])", r"\\\1", c)
        i += 1
    return f"(?s)^(.*/)?{out}$" if glob.startswith("**/") else f"(?s)^{out}$"


def glob_pattern(glob: Column) -> Column:
    """:func:`glob_regex` of a column of globs."""
    whole = F.lower(normal_path(glob))
    pieces_ = F.regexp_extract_all(F.regexp_replace(whole, r"^\*\*/", ""), F.lit(r"(?s)(\[!?+\]?+[^\]]*+\]|.)"), 1)

    def piece(x: Column) -> Column:
        escaped = lambda t: F.regexp_replace(t, r"([\\.+(){}|^$\[\]&])", r"\\$1")
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        chosen = F.when(F.startswith(inner, F.lit("!")), F.concat(F.lit("[^"), escaped(F.substring(inner, F.lit(2), F.length(inner))), F.lit("]"))).otherwise(F.concat(F.lit("["), escaped(inner), F.lit("]")))
        return F.when(F.length(x) > 1, chosen).when(x == "*", ".*").when(x == "?", ".").otherwise(escaped(x))

    body = F.array_join(F.transform(pieces_, piece), "")
    return F.concat(F.when(F.startswith(whole, F.lit("**/")), "(?s)^(.*/)?").otherwise("(?s)^"), body, F.lit("$"))


def ascii_bounds(pattern: str) -> str:
    r"""``pattern`` with its ``\b`` and ``\B`` spelled out by ``\w``: up to version 18, Java's bounds count letters beyond ASCII as parts of words, SQL's don't."""
    spelled = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}
    # A backslash and what it escapes are read together, so an escaped backslash before a b stays.
    return re.sub(r"(?s)\\(.)", lambda m: spelled.get(m[1], m[0]), pattern)


def path_matches(path: Column, globs: list[str]) -> Column:
    """Whether a path, or its last part, matches any of the globs; false for none."""
    whole = F.lower(normal_path(path))
    name = F.element_at(F.split(whole, "/"), -1)
    hits = [whole.rlike(p) | name.rlike(p) for p in map(glob_regex, globs)]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out
