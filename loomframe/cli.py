"""Command line: translate an utterance, show a model or the folder of models, make a corpus.

A model is a folder of JSON lines with examples (``loomframe make-corpus``), read by ``Lookup``.
"""

from __future__ import annotations

import argparse
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomframe.functions.text import two_places
from loomframe.operators import generation
from loomframe.sources import files
from loomframe.translate import Lookup, Translator


def cache_dir() -> Path:
    """Where models are kept: below XDG_CACHE_HOME or the home folder's .cache."""
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "loomframe" / "models"


def models(folder: Path) -> list[tuple[str, float]]:
    """Name and size in MiB of each model in a folder."""
    found = [p for p in sorted(folder.glob("*")) if p.is_dir() and any(p.glob("*.json"))] if folder.is_dir() else []
    return [(p.name, round(sum(f.stat().st_size for f in p.glob("*.json")) / 1048576, 2)) for p in found]


def model_info(folder: Path, tool: str) -> list[tuple[str, str]]:
    """What is known of a tool's model."""
    size = dict(models(folder)).get(tool)
    return [
        ("Status", "available" if size is not None else "not found"),
        ("Tool", tool),
        ("Path", str(folder / tool) if size is not None else "none"),
        ("Size (MiB)", "0" if size is None else f"{size:.2f}"),
    ]


def session() -> SparkSession:
    spark = SparkSession.builder.appName("loomframe").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_corpus(spark: SparkSession, kind: str, path: str) -> int:
    """Writes a corpus of container commands (574 examples) or of the tool's (1,500); their count."""
    if kind == "docker":
        shares = spark.createDataFrame(list(generation.CONTAINER_SHARES), "kind string, share double")
        rows = generation.sample_pools(generation.pool(spark), shares, 600, "d4")
        rows = rows.select("kind", "k", F.concat(F.lit("Translate this to a docker command: "), "instruction").alias("instruction"), F.lit("").alias("input"), F.col("command").alias("output"))
        generation.write_corpus(rows, path, "s9", "kind", "k")
    else:
        templates = spark.createDataFrame(generation.tool_templates(), "kind string, t int, pattern string, command string, base double, explanation string")
        shares = spark.createDataFrame(list(generation.TOOL_SHARES), "kind string, share double")
        rows = generation.draw_templates(templates, shares, 1500)
        output = F.concat(F.lit("COMMAND: "), "command", F.lit("\nCONFIDENCE: "), two_places(F.col("confidence")), F.lit("\nEXPLANATION: "), "explanation", F.lit("\n"))
        rows = rows.select("kind", "i", F.concat(F.lit("Translate to tool command: "), "instruction").alias("instruction"), F.lit("").alias("input"), output.alias("output"))
        generation.write_corpus(rows, path, "s9", "kind", "i")
    return files.read_jsonl(spark, path).count()


def translate(spark: SparkSession, folder: Path, tool: str, utterance: str) -> str:
    """The translation as lines to show."""
    answer = Lookup.load(spark, str(folder / tool)).answer(utterance)
    shown = Translator(tool, lambda prompt: F.col("answer")).translate(answer, "utterance").first()
    return f"Input: {utterance}\n{shown['preview']}" if shown else f"Input: {utterance}\nNo command found"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomframe", description="Instruction corpora and translations on Spark.")
    parser.add_argument("--models", type=Path, default=None, help="folder of models (default: the cache folder)")
    sub = parser.add_subparsers(dest="command", required=True)
    t = sub.add_parser("translate", help="translate an utterance to a command")
    t.add_argument("--tool", default="tool")
    t.add_argument("utterance", nargs="+")
    i = sub.add_parser("model-info", help="show what is known of a model")
    i.add_argument("--tool", default="tool")
    sub.add_parser("cache-dir", help="show the folder of models and what it holds")
    m = sub.add_parser("make-corpus", help="write a corpus as the model of a tool")
    m.add_argument("kind", choices=("docker", "tool"))
    given = parser.parse_args(argv)
    folder = given.models or cache_dir()
    if given.command == "cache-dir":
        print(f"Models: {folder}")
        print("\n".join(f"  {name} ({size:.2f} MiB)" for name, size in models(folder)) or ("No models yet." if folder.is_dir() else "The folder does not exist yet."))
    elif given.command == "model-info":
        rows = model_info(folder, given.tool)
        width = max(len(k) for k, _ in rows)
        print("\n".join(f"{k:<{width}}  {v}" for k, v in rows))
    elif given.command == "make-corpus":
        print(f"{make_corpus(session(), given.kind, str(folder / given.kind))} examples in {folder / given.kind}")
    elif given.tool not in dict(models(folder)):
        print(f"No model of {given.tool} in {folder}; make-corpus writes one.")
        return 1
    else:
        print(translate(session(), folder, given.tool, " ".join(given.utterance)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
