"""Tool-call expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeharbor.functions import rules

# group -> member tools; one tool can be in several groups
GROUPS = {
    "core": rules.CORE_TOOLS,
    "bundle": rules.BUNDLE_TOOLS,
    "workspace": rules.WORKSPACE_TOOLS,
    "agent:analyst": rules.ANALYST_TOOLS,
    "agent:builder": rules.BUILDER_TOOLS,
    "agent:deployer": rules.DEPLOYER_TOOLS,
}


def clean_tool(name: Column) -> Column:
    """The tool name without its known prefix."""
    prefixes = "|".join(rules.TOOL_PREFIXES)
    return F.regexp_replace(name, f"^(?:{prefixes})", "")


def is_subagent(name: Column) -> Column:
    return name == rules.SUBAGENT_TOOL


def subagent(tool_input: Column) -> Column:
    """struct(subagent_type, description) of a call's input, with defaults."""
    return F.struct(
        F.coalesce(F.get_json_object(tool_input, "$.subagent_type"), F.lit("unknown")).alias("subagent_type"),
        F.coalesce(F.get_json_object(tool_input, "$.description"), F.lit("")).alias("description"),
    )


def call_label(name: Column, tool_input: Column) -> Column:
    """How a call is listed: 'subagent:<type>' or the clean tool name."""
    return F.when(is_subagent(name), F.concat(F.lit("subagent:"), subagent(tool_input)["subagent_type"])).otherwise(
        clean_tool(name)
    )


def tool_groups(tool: Column) -> Column:
    """The groups a clean tool name belongs to, from the fixed registry."""
    return F.array_compact(F.array(*[F.when(tool.isin(members), group) for group, members in GROUPS.items()]))


def is_destructive(tool: Column, mode: str = "mcp") -> Column:
    return tool.isin(rules.DESTRUCTIVE_TOOLS[mode])


def rate_limit(tool: Column) -> Column:
    """Declared calls per minute."""
    limit = F.lit(rules.DEFAULT_RATE_LIMIT)
    for name, value in rules.RATE_LIMITS.items():
        limit = F.when(tool == name, value).otherwise(limit)
    return limit.cast("long")
