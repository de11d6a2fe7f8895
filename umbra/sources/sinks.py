"""Reports and mappings as files; figures as Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_json(report: DataFrame) -> str:
    """The one row of a report as JSON text."""
    return report.select(F.to_json(F.struct("*")).alias("j")).first().j


def write_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_mapping(found: DataFrame, hosts: DataFrame, path: str) -> None:
    """Type to key to fake, and hosts, as one JSON object in a local file; only for those who ask for it. Rows pass the driver
    a partition at a time."""
    rows = found.select("scope_id", "entity_type", "key", "fake").union(hosts.select("scope_id", F.lit("DOMAIN"), "host", "fake_host"))
    name = F.when(F.col("scope_id") == "corpus", F.col("entity_type")).otherwise(F.concat_ws(":", "scope_id", "entity_type"))
    text = lambda x: json.dumps(x, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as f:
        now = None
        for r in rows.select(name.alias("name"), "key", "fake").orderBy("name", "key").toLocalIterator():
            f.write("{" if now is None else "" if r.name == now else "},\n")
            f.write(f"{text(r.name)}: {{" if r.name != now else ", ")
            f.write(f"{text(r.key)}: {text(r.fake)}")
            now = r.name
        f.write("{}" if now is None else "}}")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table (of figures) as Markdown; if it has more rows than that, a last line says so."""
    rows = df.limit(most + 1).collect()
    more = ["", f"Only the first {most} rows are shown."] if len(rows) > most else []
    rows = rows[:most]
    show = lambda v: "–" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows), *more])
