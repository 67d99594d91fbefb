"""Tool-event payloads of three host formats brought to one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _field(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)


def is_object(payload: Column) -> Column:
    """Whether the payload parses as a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def _input(payload: Column, base: str) -> Column:
    return F.struct(
        _field(payload, f"{base}.command").alias("command"),
        _field(payload, f"{base}.file_path").alias("file_path"),
        _field(payload, f"{base}.content").alias("content"),
        _field(payload, f"{base}.new_string").alias("new_string"),
    )


def _command_input(command: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(command, F.lit("")).alias("command"), none.alias("file_path"),
        none.alias("content"), none.alias("new_string"),
    )


def tool_request(fmt: Column, payload: Column) -> Column:
    """Struct (tool, input) of an event sent before a tool runs.

    ``cursor`` and ``windsurf`` have shapes of their own; all others share one.
    """
    p = payload
    event = F.coalesce(_field(p, "$.hook_event_name"), F.lit(""))
    action = F.coalesce(_field(p, "$.agent_action_name"), F.lit(""))

    def pair(tool: Column, data: Column) -> Column:
        return F.struct(tool.alias("tool"), data.alias("input"))

    cursor = (
        F.when(event == "beforeShellExecution", pair(F.lit("Bash"), _command_input(_field(p, "$.command"))))
        .when(event == "beforeReadFile", pair(F.lit("Read"), _input(p, "$.tool_input")))
        .when(event == "afterFileEdit", pair(F.lit("Write"), _input(p, "$.tool_input")))
        .otherwise(pair(F.coalesce(_field(p, "$.tool_name"), F.lit("unknown")), _input(p, "$.tool_input")))
    )
    windsurf = (
        F.when(action.contains("run_command"), pair(F.lit("Bash"), _command_input(_field(p, "$.tool_info.command_line"))))
        .when(action.contains("write_code"), pair(F.lit("Write"), _input(p, "$.tool_info")))
        .when(action.contains("read_code"), pair(F.lit("Read"), _input(p, "$.tool_info")))
        .otherwise(pair(F.coalesce(_field(p, "$.tool_info.mcp_tool_name"), F.lit("unknown")), _input(p, "$.tool_info")))
    )
    common = pair(F.coalesce(_field(p, "$.tool_name"), F.lit("")), _input(p, "$.tool_input"))
    return F.when(fmt == "cursor", cursor).when(fmt == "windsurf", windsurf).otherwise(common)


def tool_response(fmt: Column, payload: Column) -> Column:
    """Struct (tool, output, content) of an event sent after a tool ran."""
    p = payload
    none = F.lit(None).cast("string")

    def triple(tool: Column, output: Column, content: Column) -> Column:
        return F.struct(tool.alias("tool"), output.alias("output"), content.alias("content"))

    name = F.coalesce(_field(p, "$.tool_name"), F.lit("unknown"))
    windsurf = triple(
        F.when(F.coalesce(_field(p, "$.agent_action_name"), F.lit("")).contains("run_command"), "Bash")
        .otherwise(F.coalesce(_field(p, "$.tool_info.mcp_tool_name"), F.lit("unknown"))),
        _field(p, "$.tool_info.stdout"), none,
    )
    cursor = triple(
        F.when(_field(p, "$.hook_event_name") == "afterShellExecution", "Bash").otherwise(name),
        F.coalesce(_field(p, "$.output"), _field(p, "$.tool_response.output")),
        F.coalesce(_field(p, "$.content"), _field(p, "$.tool_response.content")),
    )
    common = triple(name, _field(p, "$.tool_response.output"), _field(p, "$.tool_response.content"))
    return F.when(fmt == "cursor", cursor).when(fmt == "windsurf", windsurf).otherwise(common)
