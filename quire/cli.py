"""The command line: conversion, checks, and turns of edits of Word documents.

``python -m quire.cli COMMAND ...``; SOURCE is a file, a folder or a pattern in any file system
that Spark reads, and every document of it is converted in one job. TARGET is a Parquet table, or
one file where its name ends in .docx or .tex and there is one document.

A workspace is a folder: ``documents`` holds the generations, ``turn=N`` the block maps and the
texts to edit of generation N, ``log`` the failures. EDITED is a Parquet table of (path, text).

Exit codes: 0; 1 where some documents couldn't be converted or break the rules; 2 where a command
fails, with nothing published; 130 where it is interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import documents as D
from quire.operators import workspace as W
from quire.sources import files, word

SCHEMA = "quire-cli/1"
KEYS = ["path"]


class CommandError(Exception):
    """A command that can't go on; code says why in a word."""

    def __init__(self, code: str, reason: str):
        super().__init__(reason)
        self.code = code


class Progress:
    """Stage lines on stderr: start, then done or failed with the seconds taken."""

    def __init__(self, quiet: bool = False):
        self.quiet, self.stage_name = quiet, None

    def say(self, state: str, seconds: float | None = None) -> None:
        if not self.quiet:
            print(f"stage={self.stage_name} state={state}" + (f" seconds={seconds:.2f}" if seconds is not None else ""), file=sys.stderr)

    @contextmanager
    def stage(self, name: str):
        self.stage_name, began = name, time.monotonic()
        self.say("start")
        try:
            yield
        except BaseException:
            self.say("failed", time.monotonic() - began)
            raise
        self.say("done", time.monotonic() - began)


def _filesystem(spark: SparkSession, target: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _save(rows: DataFrame, value: str, target: str) -> dict:
    """Writes (path, value, error) rows to a table, or the value of a single row to a file."""
    spark = rows.sparkSession
    if not target.endswith((".docx", ".tex")):
        rows.write.parquet(target)
        done = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
        return {"documents": done["n"], "failed": done["failed"], "target": target}
    found = rows.select(value, "error").limit(2).collect()
    if len(found) != 1:
        raise CommandError("not-one-document", f"{target} takes one document")
    if found[0]["error"]:
        return {"documents": 1, "failed": 1, "error": found[0]["error"], "target": target}
    raw = found[0][value]
    fs, at = _filesystem(spark, target)
    out = fs.create(at, True)
    try:
        out.write(raw.encode() if isinstance(raw, str) else raw)
    finally:
        out.close()
    return {"documents": 1, "failed": 0, "target": target}


def to_word(spark: SparkSession, source: str, target: str, template: str | None = None) -> dict:
    """Word documents of LaTeX files, formatted as a template is."""
    look = None
    if template:
        found = files.package_files(spark, template).limit(2).collect()
        if len(found) != 1:
            raise CommandError("not-one-document", f"{template} isn't one Word document")
        look = bytes(found[0]["content"])
    try:
        rows = word.word_documents(files.latex_files(spark, source), KEYS, "text", look)
    except (ValueError, *word.BROKEN) as e:
        raise CommandError("template", f"{template}: {e}") from e
    return _save(rows, "content", target)


def to_latex(spark: SparkSession, source: str, target: str) -> dict:
    """LaTeX documents of Word files, with the packages that they need."""
    read = word.word_latex(files.package_files(spark, source), KEYS, "content")
    whole = word.enveloped(read.withColumn("none", F.lit(None).cast("string")), KEYS, "latex", "none", "none")
    column = next(c for c in whole.columns if c not in KEYS)
    return _save(read.select(*KEYS, "warnings", "error").join(whole.withColumnRenamed(column, "text"), KEYS), "text", target)


def check(spark: SparkSession, source: str, fragment: str = "document") -> dict:
    """What breaks the profile in LaTeX files: numbers, and the first finding of the first ten files that have one."""
    rows = D.check_files(files.latex_files(spark, source).withColumn("fragment", F.lit(fragment)), KEYS, "text", "fragment")
    counts = rows.agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("ok")).alias("failed"), F.sum("n_findings").alias("findings")).first()
    first = rows.filter("not ok").sort("path").limit(10).select("path", F.col("first_code").alias("code"), F.col("first_line").alias("line")).collect()
    return {"files": counts["files"], "failed": counts["failed"], "findings": counts["findings"] or 0, "first": [r.asDict() for r in first]}


def _documents(spark: SparkSession, workspace: str) -> DataFrame:
    """Path, content and generation of the newest documents."""
    if not W.generations(spark, f"{workspace}/documents"):
        raise CommandError("no-workspace", f"{workspace} holds no documents")
    return W.published(spark, f"{workspace}/documents", KEYS).select(*KEYS, "content", "generation")


def create(spark: SparkSession, source: str, workspace: str) -> dict:
    """A workspace of Word files; they are its first generation."""
    fs, at = _filesystem(spark, workspace)
    if fs.exists(at):
        raise CommandError("exists", f"{workspace} is there already")
    number = W.publish(files.package_files(spark, source), f"{workspace}/documents")
    return {"workspace": workspace, "generation": number} | turn_start(spark, workspace)


def turn_start(spark: SparkSession, workspace: str) -> dict:
    """Block maps and texts to edit of the newest documents."""
    documents = _documents(spark, workspace)
    number = W.generations(spark, f"{workspace}/documents")[-1]
    at = f"{workspace}/turn={number}"
    rows = W.block_map(documents, KEYS)
    W.to_json(rows, KEYS, number).write.mode("overwrite").parquet(f"{at}/maps")
    maps = W.from_json(spark.read.parquet(f"{at}/maps"), KEYS)
    W.shadow(maps, KEYS).write.mode("overwrite").parquet(f"{at}/texts")
    return {"turn": number, "texts": f"{at}/texts", "documents": spark.read.parquet(f"{at}/texts").count(), "blocks": maps.count()}


def _turn(spark: SparkSession, workspace: str, edited: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Map rows of the newest turn, the edited texts, and their blocks."""
    number = W.generations(spark, f"{workspace}/documents")
    fs, at = _filesystem(spark, f"{workspace}/turn={number[-1]}/maps" if number else workspace)
    if not number or not fs.exists(at):
        raise CommandError("no-turn", f"{workspace} has no turn of its newest generation")
    texts = spark.read.parquet(edited).select(*KEYS, "text")
    return W.from_json(spark.read.parquet(f"{workspace}/turn={number[-1]}/maps"), KEYS), texts, D.latex_blocks(texts, KEYS, "text")


def diff(spark: SparkSession, workspace: str, edited: str) -> dict:
    """How many blocks an edit keeps, changes, adds and takes out."""
    rows, texts, blocks = _turn(spark, workspace, edited)
    actions = W.edit_actions(rows.join(texts.select(*KEYS), KEYS, "left_semi"), blocks, KEYS)
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    return {"actions": counts, "label_errors": W.edit_errors(rows.join(texts.select(*KEYS), KEYS, "left_semi"), blocks, KEYS).count()}


def apply(spark: SparkSession, workspace: str, edited: str) -> dict:
    """Publishes the edited documents as a generation; nothing, where a map is stale or an edit can't be applied."""
    rows, texts, blocks = _turn(spark, workspace, edited)
    documents = _documents(spark, workspace)
    rows = rows.join(texts.select(*KEYS), KEYS, "left_semi")
    stale, wrong = W.integrity(rows, documents, KEYS).first(), W.edit_errors(rows, blocks, KEYS).first()
    if stale:
        raise CommandError("conflict", f"{stale['path']}: {stale['code']}")
    if wrong:
        raise CommandError("labels", ", ".join(str(x) for x in wrong))
    number = W.publish(W.candidates(documents, texts, KEYS), f"{workspace}/documents")
    made = spark.read.parquet(f"{workspace}/documents/generation={number}")
    failed = made.filter("error is not null").select("path", "error").first()
    if failed:
        W.undo(spark, f"{workspace}/documents")
        raise CommandError("not-applied", f"{failed['path']}: {failed['error']}")
    return {"generation": number, "documents": made.count()}


def undo(spark: SparkSession, workspace: str) -> dict:
    """Takes the newest generation back; the first one stays."""
    if len(W.generations(spark, f"{workspace}/documents")) < 2:
        raise CommandError("nothing-to-undo", f"{workspace} has one generation at most")
    return {"undone": W.undo(spark, f"{workspace}/documents")}


def publish(spark: SparkSession, workspace: str, target: str) -> dict:
    """The newest documents as a table, or the one there is as a file."""
    return _save(_documents(spark, workspace).withColumn("error", F.lit(None).cast("string")), "content", target)


COMMANDS = {
    "to-word": (to_word, "source", "target"), "to-latex": (to_latex, "source", "target"), "check": (check, "source"),
    "workspace-create": (create, "source", "workspace"), "turn-start": (turn_start, "workspace"), "diff": (diff, "workspace", "edited"),
    "apply": (apply, "workspace", "edited"), "undo": (undo, "workspace"), "publish": (publish, "workspace", "target"),
}


def log(spark: SparkSession, workspace: str, command: str, reason: str) -> None:
    """Appends a failure to a workspace's log, on one line."""
    fs, at = _filesystem(spark, f"{workspace}/documents")
    if fs.exists(at):
        spark.createDataFrame([(time.time(), command, " ".join(reason.split()))], "at double, command string, reason string").coalesce(1).write.mode("append").json(f"{workspace}/log")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description="LaTeX and Word documents as tables.")
    top.add_argument("--json", action="store_true", help="the result as one JSON object")
    top.add_argument("--quiet", action="store_true", help="no stage lines")
    of = top.add_subparsers(dest="command", required=True)
    for name, (function, *arguments) in COMMANDS.items():
        one = of.add_parser(name, help=function.__doc__)
        for a in arguments:
            one.add_argument(a)
    of.choices["to-word"].add_argument("--template", help="a Word document that formats the others")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    function, *arguments = COMMANDS[args.command]
    progress = Progress(args.quiet)

    def failed(code: str, reason: str, status: int) -> int:
        if "workspace" in arguments:
            log(spark, args.workspace, args.command, reason)
        if args.json:
            print(json.dumps({"schema": SCHEMA, "ok": False, "command": args.command, "error": {"category": code, "reason": reason}}, ensure_ascii=False))
        else:
            print(f"stage={progress.stage_name} category={code} reason={reason}", file=sys.stderr)
        return status

    try:
        with progress.stage("session"):
            spark = spark or SparkSession.builder.appName("quire").getOrCreate()
        with progress.stage(args.command):
            options = {"template": args.template} if args.command == "to-word" else {}
            result = function(spark, *(getattr(args, a) for a in arguments), **options)
    except CommandError as e:
        return failed(e.code, str(e), 2)
    except PySparkException as e:
        return failed(type(e).__name__, str(e).splitlines()[0], 2)
    except KeyboardInterrupt:
        return failed("interrupted", "interrupted; nothing was published", 130)
    if args.json:
        print(json.dumps({"schema": SCHEMA, "ok": True, "command": args.command, "result": result}, ensure_ascii=False))
    else:
        print("\n".join(f"{k}: {v}" for k, v in result.items()))
    return 1 if result.get("failed") else 0


if __name__ == "__main__":
    sys.exit(main())
