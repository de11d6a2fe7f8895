"""Command line: redact Word documents below a path."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as C


def hook(name: str | None):
    """A function named as module:function; none if there's no name."""
    if not name:
        return None
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"{name}: no such function") from e


def redact_documents(spark: SparkSession, source: str, target: str, config: C.RunConfig, report_path: str | None = None, mapping_path: str | None = None, *, reader=None, faces=None, codes=None) -> dict:
    """Reads documents, writes redacted ones below target, at their paths below source, and returns the report. reader,
    faces, codes: hooks for what is in images (see ``plans.pictures``)."""
    from .operators import replace
    from .plans import pictures, pipeline
    from .sources import docx, sinks
    from .staging import WRITTEN, dropped, saved

    before = len(WRITTEN)
    docs = docx.read_binary(spark, source)
    units = saved(docx.text_units(docs), "units")
    redacted, found, made = pipeline.redact(units, config)
    redacted = saved(redacted, "redacted")
    spans = replace.spans_of(found.units, config)
    scope = docs.select("doc_id", (F.col("doc_id").cast("string") if config.scope == "document" else F.lit("corpus")).alias("scope_id"))
    mails = scope.join(made.where("entity_type = 'EMAIL_ADDRESS'"), "scope_id").select("doc_id", "key", "fake")
    hosts = replace.site_hosts(spans, config.seed)
    by_host = scope.join(hosts, "scope_id").select("doc_id", F.col("host").alias("key"), F.col("fake_host").alias("fake"))
    shown = pictures.redact(docs, found.known, config, reader=reader, faces=faces, codes=codes)
    changed = saved(docx.rewritten(docs, redacted, mails, by_host, shown.changed), "rewritten")
    here = lambda path: path if "://" in path else str(Path(path).resolve())
    written = docx.save(changed, here(target), None if source.lower().endswith(".docx") else here(source))
    report = json.loads(sinks.report_json(pipeline.report(redacted, config))) | {"documents": written.count(), "images_read": reader is not None} | shown.figures()
    if report_path:
        Path(report_path).write_text(json.dumps(report, indent=2, sort_keys=True))
    if mapping_path:
        sinks.write_mapping(made, hosts, mapping_path)
    dropped(spark, before)
    return report


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the run failed; 2: wrong arguments."""
    parser = argparse.ArgumentParser(prog="umbra", description="Replace personal data in Word documents.")
    parser.add_argument("source", help="a .docx file or a folder of them")
    parser.add_argument("target", help="the folder for redacted documents")
    parser.add_argument("--report", help="where to write the report (JSON)")
    parser.add_argument("--mapping", help="where to write what replaced what (JSON); holds personal data")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--scope", choices=("document", "corpus"), default="document")
    parser.add_argument("--reader", help="module:function that reads the words of images; without one, images aren't read")
    parser.add_argument("--faces", help="module:function that finds faces in images")
    parser.add_argument("--codes", help="module:function that finds and reads codes in images")
    args = parser.parse_args(argv)
    if Path(args.target).resolve() in (Path(args.source).resolve(), Path(args.source).resolve().parent):
        print("source and target must differ", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("umbra").getOrCreate()
    try:
        hooks = {k: hook(getattr(args, k)) for k in ("reader", "faces", "codes")}
        report = redact_documents(spark, args.source, args.target, C.RunConfig(seed=args.seed, scope=args.scope), args.report, args.mapping, **hooks)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps({k: report[k] for k in ("documents", "units", "units_with_pii", "by_entity_type", "unique_values_replaced", "images", "images_modified", "images_read")}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
