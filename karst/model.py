"""Declared schemas of the engine's tables (nothing is inferred)."""

from __future__ import annotations

GEO = "country_code string, country_name string, region string, pos int"
OBSERVATIONS = "indicator_code string, country_code string, year int, value double"
INDICATORS = "id string, name string, description string"
PARAPHRASES = "id string, name string, description string, paraphrase array<string>"
ACTION = "struct<name: string, arguments: map<string,string>, result: string, id: string>"
EXAMPLE = (
    f"id string, question_template string, question string, actions array<{ACTION}>, answer string, "
    "slot_values map<string,string>, answerable boolean, data_availability string, answer_format string"
)
CALL = "struct<id: string, type: string, function: struct<name: string, arguments: map<string,string>>>"
MESSAGE = f"struct<role: string, content: string, tool_call_id: string, tool_calls: array<{CALL}>>"
RUN = f"{EXAMPLE}, messages array<{MESSAGE}>, tokens int, pred string, correct boolean, error double"
NODES = "graph_id string, node_id string, label string, type string, call_order int, result string, args map<string,string>"
EDGES = "graph_id string, src string, dst string, label string"
