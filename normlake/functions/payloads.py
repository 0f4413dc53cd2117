"""Fields of tool events, as Columns over their JSON: names, paths, sessions, flags, and whether a command writes managed files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools that write, tools that run commands, file types that are managed, other names of events, and words that mean no.
WRITE_TOOLS = ("edit", "write", "multiedit", "notebookedit")
SHELL_TOOLS = ("bash", "shell", "powershell", "command", "exec_command", "exec-command")
MANAGED = (".java", ".xml", ".yml", ".yaml", ".properties")
EVENT_NAMES = {"pre": "pre-edit", "pretooluse": "pre-edit", "pre-tool-use": "pre-edit", "post": "post-edit", "posttooluse": "post-edit", "post-tool-use": "post-edit", "stop": "stop"}
NO = ("", "0", "false", "no", "off", "none")
PATH_KEYS, COMMAND_KEYS = ("file_path", "filePath", "path", "notebook_path"), ("command", "cmd", "script", "code")
# Commands and calls that change files.
COMMANDS = r"(?:^|[\s;&|])(?:set-content|add-content|out-file|copy-item|move-item|remove-item|rename-item|tee|sed\s+-i|perl\s+-p?i|cp|mv|rm|del|erase|copy|move|apply_patch)(?:\s|$)"
CALLS = (".write(", ".write_text(", ".write_bytes(", "writefile(", "writefilesync(", "set-content", "add-content", "out-file")
GIT = r"(?:^|\s)git\s+(?:checkout|restore|apply)\b"


def trimmed(text: Column) -> Column:
    """White space of any kind off both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def first_of(payload: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds a non-empty text; empty if none does."""
    return F.coalesce(*[F.nullif(trimmed(F.get_json_object(payload, f"$.{p}")), F.lit("")) for p in paths], F.lit(""))


def permissive_bool(value: Column, default: bool = False) -> Column:
    """False for null (or ``default``), empty, 0, false, no, off, none; true for anything else."""
    return F.when(value.isNull(), F.lit(default)).otherwise(~F.lower(trimmed(value)).isin(*NO))


def event_name(value: Column) -> Column:
    """The event's usual name: case, underscores and known variants apart."""
    low = F.replace(F.lower(trimmed(value)), F.lit("_"), F.lit("-"))
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair]), lambda k, _: k == low)), F.lit(0)), low)


def safe_session(value: Column) -> Column:
    """A session's id as a file name: letters, digits, dots and dashes, 120 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(F.when(F.coalesce(value, F.lit("")) == "", "session").otherwise(trimmed(value)), r"[^A-Za-z0-9_.-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(clean == "", "session").otherwise(F.substring(clean, 1, 120))


def session_id(payload: Column, process: Column | None = None) -> Column:
    """The payload's session; without one, a name made of its transcript's path, or else of its folder and ``process``."""
    explicit, transcript = first_of(payload, "session_id", "sessionId"), first_of(payload, "transcript_path", "transcriptPath")
    place = F.concat_ws("|", F.coalesce(F.get_json_object(payload, "$.cwd"), F.lit("")), F.coalesce(process.cast("string") if process is not None else F.lit(None).cast("string"), F.lit("")))
    seed = F.when(transcript != "", transcript).otherwise(place)
    return F.when(explicit != "", safe_session(explicit)).otherwise(F.concat(F.lit("session-"), F.substring(F.sha2(seed, 256), 1, 16)))


def tool_name(payload: Column) -> Column:
    return F.lower(first_of(payload, "tool_name", "toolName"))


def _input(payload: Column, keys: tuple[str, ...]) -> Column:
    return first_of(payload, *[f"tool_input.{k}" for k in keys], *[f"toolInput.{k}" for k in keys])


def target_path(payload: Column) -> Column:
    """The file that a tool call names, below the call's folder if it is relative; empty if it names none."""
    raw, cwd = _input(payload, PATH_KEYS), F.regexp_replace(first_of(payload, "cwd"), "/+$", "")
    return F.when((raw == "") | raw.startswith("/") | (cwd == ""), raw).otherwise(F.concat_ws("/", cwd, raw))


def managed_write(payload: Column, extensions: tuple[str, ...] = MANAGED) -> Column:
    """Whether a call of a writing tool (or of none that is named) has a managed file as its target."""
    tool, suffix = tool_name(payload), F.regexp_extract(F.lower(target_path(payload)), r"[^/](\.[^./]*)$", 1)
    return ((tool == "") | tool.isin(*WRITE_TOOLS)) & suffix.isin(*extensions)


def shell_write(payload: Column, extensions: tuple[str, ...] = MANAGED) -> Column:
    """Whether a shell command that mentions a managed file type looks like one that writes: by redirection, by name, by call, or by git."""
    command = F.lower(_input(payload, COMMAND_KEYS))
    types = "|".join(re.escape(x.lower()) for x in extensions)
    # Fixed value: a redirection into a file of a managed type, quoted or not.
    redirected = rf">{{1,2}}\s*(?:\"[^\"]*(?:{types})\"|'[^']*(?:{types})'|[^\s\"']*(?:{types})(?:\s|$))"
    mentions, calls = F.lit(False), F.lit(False)
    for x in extensions:
        mentions = mentions | F.contains(command, F.lit(x.lower()))
    for x in CALLS:
        calls = calls | F.contains(command, F.lit(x))
    return tool_name(payload).isin(*SHELL_TOOLS) & mentions & (command.rlike(redirected) | command.rlike(COMMANDS) | calls | command.rlike(GIT))


def tool_failed(payload: Column) -> Column:
    """Whether a call says that it failed, in any of the places where tools say so."""
    said = [permissive_bool(F.get_json_object(payload, f"$.{p}")) for p in ("is_error", "tool_response.is_error", "tool_response.isError", "toolResponse.is_error", "toolResponse.isError")]
    out = first_of(payload, "tool_error") != ""
    for one in said:
        out = out | one
    return out


def cell(value: Column, most: int = 220) -> Column:
    """A Markdown table's cell: single white space, bars escaped, an ellipsis where it is cut, a dash if it is empty."""
    flat = F.replace(trimmed(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)
    return F.when(cut == "", "—").otherwise(cut)


def canonical(fields: dict[str, Column]) -> Column:
    """Fields as JSON, names in order, nulls kept: equal texts mean equal fields."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def review_signature(reviews: Column) -> Column:
    """One hash for an array of ``struct<rule_id, path, content>``, whatever its order."""
    parts = F.transform(reviews, lambda r: F.concat_ws(":", r["rule_id"], r["path"], F.sha2(F.coalesce(r["content"], F.lit("")), 256)))
    return F.sha2(F.array_join(F.array_sort(parts), "\x1f"), 256)
