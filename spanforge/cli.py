"""Command line: mask a text, a file's lines, or a folder; evaluate; restore from a vault."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanforge.config import Config, MaskingMode
from spanforge.operators.detectors import Factory
from spanforge.operators.evaluate import report_lines, synthetic_cases
from spanforge.operators.masking import entity_map, vault
from spanforge.plans.engine import Engine
from spanforge.sources.formats import supported_extensions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanforge", description=__doc__)
    p.add_argument("path", nargs="?", help="folder to process")
    p.add_argument("--text", help="mask this text")
    p.add_argument("--output-dir", help="where masked files go")
    p.add_argument("--mode", default="replace", choices=[m.value for m in MaskingMode])
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--keep-metadata", action="store_true")
    p.add_argument("--show-map", action="store_true", help="placeholders and labels, never values")
    p.add_argument("--report", action="store_true", help="the lines of the compliance report")
    p.add_argument("--export-vault", metavar="FILE")
    p.add_argument("--restore", metavar="FILE", help="restore this masked text file from --vault")
    p.add_argument("--vault", metavar="FILE")
    p.add_argument("--evaluate", metavar="FILE", help="JSON lines of text and labels")
    p.add_argument("--write-synthetic", metavar="FILE")
    p.add_argument("--json", action="store_true")
    p.add_argument("--supported-formats", action="store_true")
    p.add_argument("--disable-layer", action="append", choices=["opf", "gliner", "pattern"], default=[])
    p.add_argument("--pattern-only", action="store_true", help="only the pattern layer")
    p.add_argument("--recall-mode", choices=["conservative", "balanced", "aggressive"], default="aggressive")
    p.add_argument("--gliner-threshold", type=float, default=0.3)
    p.add_argument("--chunk-long-text", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--chunk-threshold", type=int, default=4000)
    p.add_argument("--chunk-size", type=int, default=1500)
    p.add_argument("--chunk-overlap", type=int, default=100)
    p.add_argument("--spread-windows", action="store_true", help="windows of long texts as rows, dealt to all tasks")
    p.add_argument("--ml-skip-extensions", default=".log", help="suffixes, by commas, of long files that skip the models")
    p.add_argument("--ml-skip-min-chars", type=int, default=8000)
    p.add_argument("--low-memory", action="store_true")
    return p


def config_of(args: argparse.Namespace) -> Config:
    """The settings that the arguments say."""
    off = {"opf", "gliner"} if args.pattern_only else set(args.disable_layer)
    suffixes = (e.strip().lower() for e in args.ml_skip_extensions.split(",") if e.strip())
    return Config(
        opf_enabled="opf" not in off,
        gliner_enabled="gliner" not in off,
        pattern_enabled="pattern" not in off,
        opf_recall_mode=args.recall_mode,
        gliner_threshold=args.gliner_threshold,
        masking_mode=args.mode,
        keep_metadata=args.keep_metadata,
        recursive=not args.no_recursive,
        low_memory=args.low_memory,
        chunk_long_text=args.chunk_long_text,
        chunk_threshold=args.chunk_threshold,
        chunk_size=args.chunk_size,
        chunk_overlap=args.chunk_overlap,
        spread_windows=args.spread_windows,
        ml_skip_extensions=tuple(e if e.startswith(".") else f".{e}" for e in suffixes),
        ml_skip_min_chars=args.ml_skip_min_chars,
    )


def restore(masked: str, entries: dict) -> str:
    """Originals for placeholders, longer placeholders first; entries without a text original are passed over."""
    for name in sorted(entries, key=len, reverse=True):
        original = entries[name].get("original")
        if isinstance(original, str):
            masked = masked.replace(name, original)
    return masked


def main(argv: list[str] | None = None, spark: SparkSession | None = None, detectors: dict[str, Factory] | None = None) -> int:
    """Run a command; ``detectors`` are the statistical layers' factories, of layers without one nothing is found."""
    args = parser().parse_args(argv)
    if args.supported_formats:
        print("\n".join(supported_extensions()))
        return 0
    if args.restore:
        if not args.vault:
            print("--restore richiede --vault", file=sys.stderr)
            return 2
        source = Path(args.restore)
        target = source.with_name(f"{source.stem}_restored{source.suffix}")
        target.write_text(restore(source.read_text("utf-8"), json.loads(Path(args.vault).read_text("utf-8"))), "utf-8")
        print(target)
        return 0
    spark = spark or SparkSession.builder.appName("spanforge").getOrCreate()
    engine = Engine(spark, config_of(args), detectors)
    if args.write_synthetic:
        rows = [json.dumps(r.asDict(), ensure_ascii=False) for r in synthetic_cases(spark).collect()]
        Path(args.write_synthetic).write_text("\n".join(rows) + "\n", "utf-8")
        return 0
    if args.evaluate:
        print(json.dumps(engine.evaluate_file(args.evaluate).first().asDict()))
        return 0
    if args.text is not None:
        done = engine.analyze(spark.createDataFrame([(args.text,)], "text string"))
        row = done.select("masked_text", "counts", F.to_json(vault(F.col("replacements"))).alias("vault"), entity_map(F.col("replacements")).alias("map"), report_lines(F.col("audit")).alias("report"), F.to_json("audit", {"ignoreNullFields": "false"}).alias("audit")).first()
        print(json.dumps({"text": row["masked_text"], "counts": row["counts"], "audit": json.loads(row["audit"])}, ensure_ascii=False) if args.json else row["masked_text"])
        if args.show_map:
            print("\n".join(f"{e['placeholder']} -> {e['label']}" for e in row["map"]))
        if args.report:
            print("\n".join(row["report"]))
        if args.export_vault:
            Path(args.export_vault).write_text(row["vault"], "utf-8")
        return 0
    if args.path:
        with engine.process_folder(args.path, args.output_dir, dry_run=args.dry_run) as batch:
            if args.json:
                for row in engine.audits(batch).toLocalIterator():
                    print(json.dumps({"path": row["path"], **({"reason": row["reason"]} if row["audit"] is None else {"audit": json.loads(row["audit"])})}, ensure_ascii=False))
            print(json.dumps(batch.totals))
            for row in engine.summary(batch.results).toLocalIterator():
                print(f"- {row['label']}: {row['n_spans']}")
            for row in batch.skipped.orderBy("path").toLocalIterator():
                print(f"skipped {row['path']}: {row['reason']}")
        return 0
    parser().print_usage()
    return 2


if __name__ == "__main__":
    raise SystemExit(main())
