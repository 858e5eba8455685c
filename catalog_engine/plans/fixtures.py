"""Small tables that the queries hand to the rule operators; a user brings their own."""

from __future__ import annotations

from catalog_engine import schema as S

TIER_GUIDE_SCHEMA = f"{S.TIER} string, shelf string, review_days int, margin_floor double"
TIER_GUIDE = [("Low", "entrance", 7, 0.0625), ("Medium", "aisle", 14, 0.125), ("High", "counter", 30, 0.25)]

TIER_NOTES = {"Low": "count this shelf weekly", "Medium": "count this shelf twice a month", "High": "count this shelf monthly"}

FAMILY_NOTES = {"structured": "reads columns", "text": "reads names", "transfer": "reads columns and names", "ensemble": "counts votes"}


def sql_text(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values_sql(rows) -> str:
    """Rows as the list of a VALUES clause."""
    return ", ".join("(" + ", ".join(map(sql_text, row)) + ")" for row in rows)


def case_sql(column: str, notes: dict) -> str:
    """A CASE expression that looks a column up."""
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in notes.items()) + " END"
