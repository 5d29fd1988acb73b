"""Robot plans as text: one tool call a line, and the plainer grammars, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = r"^\s*(\w+)\s*\(\s*(.*?)\s*\)\s*$"
# fixed values: tools that end a plan's check at once, and those that only speak or look
FORBIDDEN = {"show": "show() is not allowed in CV mode.", "pass": "pass() is not allowed in CV mode; use nav() only."}
TALK = ("speak", "vqa", "face", "greet", "place")


def lines(text: Column) -> Column:
    """The trimmed lines of a text, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def argument(inside: Column) -> Column:
    """The first quoted argument (double quotes before single ones), else what stands before the first comma."""
    double, single = F.regexp_extract(inside, '"([^"]+)"', 1), F.regexp_extract(inside, "'([^']+)'", 1)
    plain = F.trim(F.substring_index(inside, ",", 1))
    return F.when(double != "", F.trim(double)).when(single != "", F.trim(single)).otherwise(plain)


def calls(text: Column) -> Column:
    """``array<struct<tool, arg>>`` of the lines that are calls, tools in lower case; other lines are no calls."""
    found = F.filter(lines(text), lambda x: F.regexp_like(x, F.lit(CALL)))
    return F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, CALL, 1)).alias("tool"), argument(F.regexp_extract(x, CALL, 2)).alias("arg")))


def _call_error(call: Column) -> Column:
    banned = F.coalesce(*[F.when(call["tool"] == tool, F.lit(said)) for tool, said in FORBIDDEN.items()])
    empty = F.when(call["tool"].isin("nav", "grasp") & (call["arg"] == ""), F.concat(F.lit("Missing argument for "), call["tool"], F.lit("()")))
    return F.coalesce(banned, empty)


def parsed(text: Column) -> Column:
    """``struct<stops, grasps, talks, error>`` of a plan of tool calls.

    The first faulty line is the error; a plan with no nav() is in error unless another tool is called.
    """
    made = calls(text)
    faults = F.array_compact(F.transform(made, _call_error))
    args = lambda tool: F.transform(F.filter(made, lambda c: c["tool"] == tool), lambda c: c["arg"])
    talks = F.exists(made, lambda c: c["tool"].isin("grasp", *TALK))
    missing = F.when((F.size(args("nav")) == 0) & ~talks, F.lit("Missing nav()"))
    return F.struct(args("nav").alias("stops"), args("grasp").alias("grasps"), talks.alias("talks"), F.coalesce(F.get(faults, F.lit(0)), missing).alias("error"))


def comma_steps(text: Column) -> Column:
    """``array<struct<action, rest>>`` of lines ``nav, place`` and ``arm, instruction``; other lines are left out."""
    split = F.transform(lines(text), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ",", 1))).alias("action"), F.trim(F.regexp_extract(x, r"^[^,]*,(.*)$", 1)).alias("rest")))
    return F.filter(split, lambda s: s["action"].isin("nav", "arm") & (s["rest"] != ""))


def action_steps(text: Column) -> Column:
    """``array<struct<action, args>>`` of lines that begin with ``action(args)``: quotes go, no argument is null."""
    whole = r"^(\w+)\((.*)\)"
    found = F.filter(lines(text), lambda x: F.regexp_like(x, F.lit(whole)))
    bare = lambda x: F.translate(F.trim(F.regexp_extract(x, whole, 2)), "'\"", "")
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, whole, 1).alias("action"), F.nullif(bare(x), F.lit("")).alias("args")))


def spoken(text: Column) -> Column:
    """Text for a speaker: typographic quotes, dashes, the ellipsis and hard blanks made plain, white space single."""
    # fixed values: characters and what is said for them
    plain = F.translate(text, "‘’“” ", "''\"\" ")
    for mark, said in (("—", " - "), ("–", " - "), ("…", "...")):
        plain = F.replace(plain, F.lit(mark), F.lit(said))
    return F.coalesce(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))
