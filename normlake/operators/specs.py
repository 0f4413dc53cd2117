"""Check declarations as a typed table: rule records (JSON) become one row for each check, with its own id.

Records are VARIANT values; aliases, lists of one, defaults and drafts' errors are all expressions over them, so a rule set of any size is read where it
is. A name that is null counts as absent. Of what is declared, a text names a kind, an object is a check, anything else is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import compiled, pattern_problem

# The kinds of checks, where records declare them, and the names that each field goes by, the first present one wins.
KINDS = ("regex_forbid", "regex_require", "path_allow", "path_forbid", "companion_change", "ai_review")
CONTAINERS = ("check", "checks", "checkers", "checker", "enforcement")
NAMES = {
    "when_pattern": ("when_pattern", "trigger_regex", "content_trigger"),
    "regex": ("patterns", "pattern", "regex", "required_regex"),
    "allowed": ("allow", "allowed", "allowed_paths", "patterns", "paths"),
    "forbidden": ("forbid", "forbidden", "forbidden_paths", "patterns", "paths"),
    "trigger_paths": ("trigger_paths", "trigger", "when_changed", "changed"),
    "required_paths": ("requires", "required_paths", "companion_paths"),
    "include": ("include_paths", "applies_to_paths", "path_globs", "path_glob"),
    "exclude": ("exclude_paths", "excluded_paths"),
}
RULE_INCLUDE = ("include_paths", "applies_to_paths")
PATTERNS_OF = {"regex_forbid": "regex", "regex_require": "regex", "path_allow": "allowed", "path_forbid": "forbidden", "companion_change": "required_paths"}
FLAGS = {"i": "i", "ignorecase": "i", "m": "m", "multiline": "m", "s": "s", "dotall": "s", "x": "x", "verbose": "x"}
FLAG_BITS = {"i": 2, "m": 8, "s": 16, "x": 64}
PHASES = ("post", "stop")
UNNAMED = "UNKNOWN-RULE"


def field(value: Column, name: str) -> Column:
    """A field as a variant; SQL's null if there is none."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def present(value: Column, names: tuple[str, ...]) -> Column:
    """The first of several fields that isn't null."""
    return F.get(F.filter(F.array(*[field(value, n) for n in names]), lambda v: v.isNotNull() & ~F.is_variant_null(v)), F.lit(0))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once, however often it stands in ``of``."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def is_a(value: Column, kind: str) -> Column:
    """Whether a variant's type is STRING, OBJECT, ARRAY..."""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def filled(value: Column) -> Column:
    """Whether a variant counts as true: not null, false, zero, or empty."""
    shown, number = F.coalesce(F.to_json(value), F.lit("null")), F.try_variant_get(value, "$", "double")
    return F.when(is_a(value, "STRING"), shown != '""').otherwise(~shown.isin("null", "false", "[]", "{}") & ~F.coalesce(number == 0, F.lit(False)))


def text(value: Column) -> Column:
    """A variant as trimmed text; what doesn't count as true is empty."""
    return bound(value, lambda v: F.when(filled(v), F.regexp_replace(F.coalesce(v.try_cast("string"), F.lit("")), r"^\s+|\s+$", "")).otherwise(""))


def listed(value: Column) -> Column:
    """A variant's elements: those of an array, else the value itself; null has none."""
    none = F.array().cast("array<variant>")
    return bound(value, lambda v: F.when(v.isNull() | F.is_variant_null(v), none).when(is_a(v, "ARRAY"), F.coalesce(v.try_cast("array<variant>"), none)).otherwise(F.array(v)))


def texts(value: Column) -> Column:
    """The non-empty texts among a variant's elements."""
    return F.filter(F.transform(listed(value), text), lambda t: t != "")


def first_filled(*values: Column) -> Column:
    """The first text that is neither null nor empty; the last is the default."""
    return F.coalesce(F.get(F.filter(F.array(*values[:-1]), lambda t: t != ""), F.lit(0)), values[-1])


def flag_letters(value: Column) -> Column:
    """Java's letters for flags given as names, letters, lists with commas, or a number of bits; unknown ones count for nothing."""
    number = F.coalesce(F.try_variant_get(value, "$", "long"), F.lit(0))
    by_bits = F.concat(*[F.when(number.bitwiseAND(F.lit(bit)) != 0, letter).otherwise("") for letter, bit in FLAG_BITS.items()])
    names = F.flatten(F.transform(texts(value), lambda t: F.split(F.lower(t), r"\s*,\s*")))
    table = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    by_names = F.array_join(F.array_distinct(F.filter(F.transform(names, lambda n: table[n]), lambda x: x.isNotNull())), "")
    return F.when(is_a(value, "STRING") | is_a(value, "ARRAY"), by_names).otherwise(by_bits)


def _parsed(records: DataFrame) -> DataFrame:
    """``record`` (JSON text or variant) as ``r``, its metadata as ``m``, and whether and what it declares (``explicit, items``)."""
    given = records.select(F.col("record") if dict(records.dtypes)["record"] == "variant" else F.try_parse_json("record").alias("record")).where(is_a(F.col("record"), "OBJECT"))
    rows = given.select(F.col("record").alias("r"), F.when(is_a(field(F.col("record"), "metadata"), "OBJECT"), field(F.col("record"), "metadata")).otherwise(F.parse_json(F.lit("{}"))).alias("m"))
    held = [field(F.col(c), k) for c in ("r", "m") for k in CONTAINERS]
    explicit = held[0].isNotNull()
    for h in held[1:]:
        explicit = explicit | h.isNotNull()
    return rows.select("*", first_filled(text(field(F.col("r"), "id")), F.lit(UNNAMED)).alias("rule_id"), explicit.alias("explicit"), F.concat(*map(listed, held)).alias("items"))


def _kind(item: Column) -> Column:
    return F.lower(F.when(is_a(item, "STRING"), text(item)).otherwise(first_filled(text(field(item, "type")), text(field(item, "checker")), F.lit(""))))


def _spec(item: Column) -> Column:
    return F.when(is_a(item, "OBJECT"), item).otherwise(F.parse_json(F.lit("{}")))


def declared(records: DataFrame) -> DataFrame:
    """One row for each check of each record, whatever its status: ``rule_id, check_no`` (from 1), ``kind, spec, r, m``.

    Checks are those that a record declares, else its candidates of a known kind (described by its metadata), else a review (in no phase if enforcement is disabled).
    """
    rows = _parsed(records)
    item = F.transform("items", lambda x: F.struct(_kind(x).alias("kind"), _spec(x).alias("spec"), (is_a(x, "STRING") | is_a(x, "OBJECT")).alias("usable")))
    good = F.filter(item, lambda x: x["usable"] & x["kind"].isin(*KINDS))
    own = F.transform(good, lambda x: F.struct(x["kind"].alias("kind"), x["spec"].alias("spec")))
    candidates = F.when(filled(field(F.col("r"), "enforcement_candidates")), field(F.col("r"), "enforcement_candidates")).otherwise(field(F.col("m"), "enforcement_candidates"))
    named = F.transform(F.filter(F.transform(texts(candidates), F.lower), lambda k: k.isin(*KINDS)), lambda k: F.struct(k.alias("kind"), F.col("m").alias("spec")))
    # A disabled rule is still shown where its triggers stand, but no phase reviews it.
    asked = F.when(filled(field(F.col("m"), "enforcement_disabled")), F.parse_json(F.lit('{"phases": ["never"]}'))).otherwise(F.parse_json(F.lit("{}")))
    review = F.array(F.struct(F.lit("ai_review").alias("kind"), asked.alias("spec")))
    found = rows.select("rule_id", "r", "m", own.alias("own"), named.alias("named"), review.alias("review"))
    chosen = F.when(F.size("own") > 0, F.col("own")).when(F.size("named") > 0, F.col("named")).otherwise(F.col("review"))
    return found.select("rule_id", "r", "m", F.posexplode(chosen).alias("p", "c")).select("rule_id", (F.col("p") + 1).alias("check_no"), "c.kind", "c.spec", "r", "m")


def rules_table(records: DataFrame, block_severities: tuple[str, ...] = ("blocker",)) -> DataFrame:
    """The compiled checks (as :func:`checks.compiled`) of the approved records; a record without a status is approved."""
    r, m, spec = F.col("r"), F.col("m"), F.col("spec")
    status = F.lower(first_filled(text(field(r, "status")), F.lit("approved")))
    rows = declared(records).where(status == "approved")
    patterns = F.coalesce(*[F.when(F.col("kind") == k, texts(present(spec, NAMES[n]))) for k, n in PATTERNS_OF.items()], F.array().cast("array<string>"))
    severity = F.lower(first_filled(text(field(spec, "severity")), text(field(r, "severity")), F.lit("major")))
    source = field(r, "source")
    label = F.when(is_a(source, "OBJECT"), F.array_join(F.filter(F.array(text(field(source, "document")), text(field(source, "section"))), lambda x: x != ""), " / ")).otherwise(text(source))
    triggers = F.when(field(m, "direct_triggers").isNotNull(), texts(field(m, "direct_triggers"))).otherwise(F.concat(texts(field(r, "trigger_terms")), texts(field(r, "tags"))))
    said = first_filled(F.when(F.col("kind") == "ai_review", text(field(spec, "prompt"))), text(field(spec, "message")), text(field(r, "statement")), F.lit(""))
    blocking, all_of, phases = field(spec, "blocking"), field(spec, "require_all"), field(spec, "phases")
    most = F.coalesce(F.try_variant_get(spec, "$.max_findings", "int"), F.lit(3))
    raw = rows.select(
        "rule_id", "check_no", "kind", patterns.alias("patterns"), texts(F.coalesce(present(spec, NAMES["include"]), present(m, NAMES["include"]), present(r, RULE_INCLUDE))).alias("include"), texts(F.coalesce(present(spec, NAMES["exclude"]), present(m, NAMES["exclude"]))).alias("exclude"),
        text(present(spec, NAMES["when_pattern"])).alias("when_pattern"), texts(field(spec, "when_terms")).alias("when_terms"), triggers.alias("triggers"), severity.alias("severity"), F.lower(text(field(r, "severity"))).alias("rule_severity"), F.when(blocking.isNull(), severity.isin(*block_severities)).when(~F.is_variant_null(blocking), filled(blocking)).alias("blocking"),
        F.when(all_of.isNull(), F.lit(True)).otherwise(filled(all_of)).alias("require_all"), F.greatest(F.lit(1), F.when(most == 0, 3).otherwise(most)).alias("most_findings"), flag_letters(field(spec, "flags")).alias("flags"), said.alias("message"),
        F.when(F.col("kind") == "companion_change", texts(present(spec, NAMES["trigger_paths"]))).otherwise(F.array().cast("array<string>")).alias("trigger_paths"), F.when(filled(phases), texts(phases)).otherwise(F.array(*map(F.lit, PHASES))).alias("phases"), label.alias("source"), filled(field(m, "global_core")).alias("core"),
    )
    return compiled(raw)


def configured(records: DataFrame) -> DataFrame:
    """``rule_id, configured``: whether each record has a check other than a review."""
    return declared(records).groupBy("rule_id").agg(F.bool_or(F.col("kind") != "ai_review").alias("configured"))


def draft_errors(records: DataFrame) -> DataFrame:
    """Everything that is wrong with declared checks, a row each: ``rule_id, check_no`` (0: the whole record), ``problem``.

    A draft that would silently become a review is an error, and so is a pattern that Spark's regular expressions refuse.
    """
    rows = _parsed(records).where("explicit")
    empty = rows.where(F.size("items") == 0).select("rule_id", F.lit(0).alias("check_no"), F.lit("no check declared").alias("problem"))
    each = rows.select("rule_id", F.posexplode("items").alias("p", "item")).select("rule_id", (F.col("p") + 1).alias("check_no"), "item", _kind(F.col("item")).alias("kind"), _spec(F.col("item")).alias("spec"), (is_a(F.col("item"), "STRING") | is_a(F.col("item"), "OBJECT")).alias("usable"))
    kind, spec = F.col("kind"), F.col("spec")
    own = F.coalesce(*[F.when(kind == k, texts(present(spec, NAMES[n]))) for k, n in PATTERNS_OF.items()], F.array().cast("array<string>"))
    lacks = kind.isin(*PATTERNS_OF) & (F.size(own) == 0) | (kind == "companion_change") & (F.size(texts(present(spec, NAMES["trigger_paths"]))) == 0)
    flags = flag_letters(field(spec, "flags"))
    when = F.filter(F.array(text(present(spec, NAMES["when_pattern"]))), lambda t: t != "")
    regexes = F.concat(when, F.when(F.startswith(kind, F.lit("regex")), own).otherwise(F.array().cast("array<string>")))
    known = F.concat(F.when(lacks, F.array(F.concat(kind, F.lit(" lacks its patterns")))).otherwise(F.array().cast("array<string>")), F.filter(F.transform(regexes, lambda p: pattern_problem(p, flags)), lambda why: why != ""))
    unknown = F.array(F.concat(F.lit("unknown type "), F.when(kind == "", "(none)").otherwise(kind)))
    problems = F.when(~F.col("usable"), F.array(F.lit("neither a name nor an object"))).when(~kind.isin(*KINDS), unknown).otherwise(known)
    return empty.unionByName(each.select("rule_id", "check_no", F.explode(problems).alias("problem")))
