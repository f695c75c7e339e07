"""Turn a YAML data contract into rules."""

from __future__ import annotations

from collections.abc import Sequence

import yaml
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators import rules as r

# Contract severities and our criticality levels.
CRITICALITY = {"error": "critical", "warn": "important", "info": "informational"}


def _known(where: str, given: dict, *names: str) -> dict:
    """The section, if it holds no other keys: a key that no rule takes would be read over."""
    unknown = set(given) - set(names)
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)} in {where}")
    return given


# What a column definition may hold: keys that make rules or types, and notes for people.
COLUMN_RULES = ("name", "type", "required", "primaryKey", "unique", "pattern", "minimum", "maximum", "allowedValues", "enum", "references")
COLUMN_NOTES = ("description", "businessName", "title", "examples", "tags", "classification")


def column_rules(columns: Sequence[dict], linked: Sequence[str] = ()) -> list:
    """Rules implied by column definitions: required, key, pattern, bounds, values, length, reference.

    A reference is left to the table's foreign keys for the columns in ``linked``.
    """
    out: list = []
    for spec in columns:
        _known(f"column {spec.get('name')}", spec, *COLUMN_RULES, *COLUMN_NOTES)
        name, kind = spec["name"], str(spec.get("type", "")).upper()
        if spec.get("required"):
            out += r.not_null([name])
        if spec.get("primaryKey") or spec.get("unique"):
            out.append(r.unique([name]))
        if spec.get("pattern"):
            out.append(r.pattern(name, spec["pattern"]))
        if spec.get("minimum") is not None or spec.get("maximum") is not None:
            out.append(r.in_range(name, spec.get("minimum"), spec.get("maximum")))
        values = spec.get("allowedValues") or spec.get("enum")
        if values:
            out.append(r.accepted(name, values))
        if kind.startswith("VARCHAR("):
            out.append(r.max_length(name, int(kind[8:-1])))
        if spec.get("references") and name not in linked:
            parent, column = spec["references"].split(".")[-2:]
            out.append(r.foreign_key(name, parent, column, True))
    return out


# Spark's names of the type names that contracts use beside its own.
TYPE_NAMES = {"VARCHAR": "string", "CHAR": "string", "TEXT": "string", "INTEGER": "int", "NUMERIC": "decimal", "DOUBLE PRECISION": "double"}


def locked_schema(columns: Sequence[dict]) -> T.StructType:
    """The schema that column definitions state; a column without a type is left out."""
    fields = []
    for spec in columns:
        kind = str(spec.get("type") or "").upper()
        if not kind:
            continue
        base, _, rest = kind.partition("(")
        name = TYPE_NAMES.get(base.strip(), base.strip().lower())
        fields.append(T.StructField(spec["name"], T.DataType.fromDDL(name if name == "string" or not rest else f"{name}({rest}"), not spec.get("required")))
    return T.StructType(fields)


def schema_changes(df: DataFrame, columns: Sequence[dict]) -> DataFrame:
    """How the table's columns and types differ from the contract: column, change, severity (see ``rules.schema_diff``).

    Files don't keep NOT NULL, so a required column is a matter of its rule, not of the type.
    """
    return r.schema_diff(df, locked_schema(columns)).filter("change <> 'became_nullable'")


# Keys that describe a check for people or other tools and decide nothing.
NOTES = ("sql", "source_query", "expected_result_type", "sla_metric", "manual_acknowledgement_required", "notify_data_steward_on_fail")


def quality_rule(rule: dict, as_of: str | None = None, key: Sequence[str] = ()) -> list:
    """One entry of the contract's quality section as rules; ``key`` is the table's primary key."""
    _known(rule.get("id", "a rule"), rule, "id", "description", "type", "params", "severity", "checks")
    kind, ident = rule["type"], rule["id"]
    level = CRITICALITY[rule.get("severity", "error")]

    def params(*names: str) -> dict:
        return _known(f"params of {ident}", rule.get("params", {}), *names)

    def checks(*names: str) -> dict:
        return _known(f"checks of {ident}", rule.get("checks", {}), *names, *NOTES)

    if kind == "freshness":
        p = params("timestampColumn", "loadedAtColumn", "toleranceMinutes", "percentagePass")
        most = checks("max_allowed_failed").get("max_allowed_failed")
        return [r.freshness_pct(p["timestampColumn"], p["loadedAtColumn"], p["toleranceMinutes"], p["percentagePass"], level, most)]
    if kind == "partition_availability":
        p = params("partitionColumn", "partitionGranularity", "readyByTime", "lookbackDays", "expectedMinRowsPerPartition", "loadedAtColumn")
        checks()
        if p.get("partitionGranularity", "day") != "day":
            raise ValueError(f"only days are known as partitions, not in {ident}")
        if as_of is None:
            raise ValueError("partition rules need as_of, the first day of the look-back window")
        if p.get("readyByTime") and not p.get("loadedAtColumn"):
            raise ValueError(f"readyByTime needs loadedAtColumn in {ident}")
        rows, days = p["expectedMinRowsPerPartition"], int(p["lookbackDays"])
        return [r.partition_ready(p["partitionColumn"], rows, as_of, days, level, p.get("loadedAtColumn"), p.get("readyByTime"))]
    if kind == "uniqueness":
        most = checks("duplicate_count_max").get("duplicate_count_max", 0)
        return [r.unique(params("columns")["columns"], criticality=level, max_duplicates=most)]
    if kind == "not_null":
        return r.not_null(params("columns")["columns"], level, checks("null_pct_per_column_max").get("null_pct_per_column_max", 0.0))
    if kind == "foreign_key":
        p = params("childColumn", "parentTable", "parentColumn", "ignoreNullChild")
        parent, most = p["parentTable"].split(".")[-1], checks("orphan_count_max").get("orphan_count_max", 0)
        return [r.foreign_key(p["childColumn"], parent, p["parentColumn"], p.get("ignoreNullChild", False), most, level)]
    if kind == "expression_match":
        p = params("leftExpression", "rightExpression", "toleranceAbsolute")
        left, right = F.expr(p["leftExpression"]), F.expr(p["rightExpression"])
        return [r.expression_match(ident, left, right, p["toleranceAbsolute"], checks("failed_pct_max").get("failed_pct_max", 0.0), level)]
    if kind == "threshold_range":
        p = params("column", "minValue", "maxValue")
        return [r.in_range(p["column"], p.get("minValue"), p.get("maxValue"), checks("outlier_pct_max").get("outlier_pct_max", 0.0), level)]
    if kind == "grouped_statistical_range":
        p = params("valueColumn", "groupByColumn", "filterClause", "expectedRanges")
        checks()
        bands = {k: (v["minMean"], v["maxMean"], v["minRowsPerGroup"]) for k, v in p["expectedRanges"].items()}
        where = F.expr(p["filterClause"]) if p.get("filterClause") else None
        return [r.group_mean_range(p["valueColumn"], p["groupByColumn"], bands, level, where)]
    if kind == "ordered":
        return [r.ordered(params("columns")["columns"], checks("failed_rows_max").get("failed_rows_max"), level)]
    if kind == "custom_sql":
        p, c = params("sql", "entityColumn"), checks("failed_rows_max", "affected_entity_pct_max")
        share, entity = c.get("affected_entity_pct_max"), p.get("entityColumn") or (key[0] if key else None)
        if share is not None and entity is None:
            raise ValueError(f"affected_entity_pct_max needs entityColumn or a primary key in {ident}")
        most = c.get("failed_rows_max", 0 if share is None else None)
        return [r.custom_sql(ident, p["sql"], most, level, share, entity)]
    raise ValueError(f"unknown rule type {kind!r} in {ident}")


def table_rules(table: dict, columns: Sequence[dict], quality, as_of: str | None) -> list:
    key = list(table.get("primaryKey") or [])
    found = column_rules(columns, [link["column"] for link in table.get("foreignKeys") or []])
    if key:
        found += r.not_null(key) + [r.unique(key)]
    for link in table.get("foreignKeys") or []:
        parent, column = link["references"].split(".")[-2:]
        found.append(r.foreign_key(link["column"], parent, column))
    for section in quality.values() if isinstance(quality, dict) else [quality or []]:
        for rule in section:
            found += quality_rule(rule, as_of, key)
    return found


def rules_from_contract(text: str, as_of: str | None = None) -> dict[str, list]:
    """``{table: rules}`` from a contract document.

    It may nest one table below ``spec`` (``schema.table``, ``schema.columns``,
    ``quality``), hold a list of ``tables``, or be one table itself.
    """
    doc = yaml.safe_load(text)
    if "spec" in doc:
        spec = doc["spec"]
        table = spec["schema"]["table"]
        name = table if isinstance(table, str) else table["table"]
        return {name: table_rules({} if isinstance(table, str) else table, spec["schema"].get("columns", []), spec.get("quality", {}), as_of)}
    return {t["name"]: table_rules(t, t.get("columns", []), t.get("quality", {}), as_of) for t in doc.get("tables", [doc])}
