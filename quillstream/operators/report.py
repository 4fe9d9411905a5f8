"""Summaries of a run: per-language counts, token totals, event lists, reports, outputs, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.functions.text import annotation
from quillstream.model import SECTIONS
from quillstream.sources.shared import ensure_checkpoint_dir


def lang_summary(translated: DataFrame, langs: list[str], lang: str = "target_lang", hit: str = "from_cache") -> DataFrame:
    """target_lang, chunks_translated (cached ones included), chunks_from_cache; languages without rows stay, with zeros."""
    spark = translated.sparkSession
    counts = translated.groupBy(F.col(lang).alias("target_lang")).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("bigint")).alias("h"))
    asked = spark.createDataFrame([(x,) for x in langs], "target_lang string")
    return asked.join(counts, "target_lang", "left").select("target_lang", F.coalesce("n", F.lit(0)).alias("chunks_translated"), F.coalesce("h", F.lit(0)).alias("chunks_from_cache"))


def token_totals(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of prompt, completion and all tokens; null counts are none."""
    prompt, completion = (F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for c in ("prompt_tokens", "completion_tokens"))
    return usage.groupBy(*(keys or [])).agg(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"))


def event_messages(events: DataFrame) -> DataFrame:
    """category, message, times: every message of every category."""
    return events.groupBy("category", "message").agg(F.count("*").alias("times"))


#: Lines of a report that one value may hold.
LINES = 10_000


def event_lists(messages: DataFrame, part: int = LINES) -> DataFrame:
    """category, part_no (from 1), messages: all in order, each as often as it came, in parts of ``part`` lines.

    Messages are numbered within ranges; only the ranges' counts by category meet on the driver.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    ranged = messages.repartitionByRange("category", "message").withColumn("range_no", F.spark_partition_id()).checkpoint()
    before, totals = [], {}
    for r in sorted(ranged.groupBy("category", "range_no").agg(F.sum("times").alias("n")).collect(), key=lambda r: (r.category, r.range_no)):
        before.append((r.category, r.range_no, totals.get(r.category, 0)))
        totals[r.category] = totals.get(r.category, 0) + r.n
    offsets = messages.sparkSession.createDataFrame(before, "category string, range_no int, before long")
    own = F.sum("times").over(Window.partitionBy("category", "range_no").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(offsets), ["category", "range_no"]).withColumn("start", F.col("before") + F.col("own"))
    number = lambda line: F.floor(line / part).cast("int")
    dealt = placed.withColumn("part_no", F.explode(F.sequence(number(F.col("start")), number(F.col("start") + F.col("times") - 1))))
    first, last = F.greatest("start", F.col("part_no") * F.lit(part).cast("long")), F.least(F.col("start") + F.col("times"), (F.col("part_no") + 1) * F.lit(part).cast("long"))
    counted = dealt.select("category", (F.col("part_no") + 1).alias("part_no"), F.struct("message", (last - first).cast("int").alias("n")).alias("line"))
    return counted.groupBy("category", "part_no").agg(F.flatten(F.transform(F.sort_array(F.collect_list("line")), lambda x: F.array_repeat(x["message"], x["n"]))).alias("messages"))


def reports(messages: DataFrame, title: str, files: int, dry_run: bool, url: str | None, langs: list[tuple[str, int, int]], usage: tuple[int, int], part: int = LINES) -> DataFrame:
    """report, section, part_no, text: the three reports over all ``messages`` (category, message, times), whole.

    The texts of a report in order of section and part are what job_report, console_report and comment_report give.
    """
    spark = messages.sparkSession
    lines = event_lists(messages, part).checkpoint().withColumn("markdown", F.concat(F.lit("- "), F.array_join("messages", "\n- "), F.lit("\n")))
    args = (title, files, dry_run, url, langs, usage, {})
    fixed = [("job", 0, 0, job_report(*args)), ("comment", 0, 0, comment_report(title, langs, {})), ("console", 0, 0, "\n".join(_console_head(title, files, langs, usage)) + "\n")]
    fixed += [("console", len(SECTIONS) + 1, 0, "\n".join(_console_tail(dry_run, url)) + "\n")] if _console_tail(dry_run, url) else []
    parts = []
    for n, (category, heading) in enumerate(SECTIONS.items(), 1):
        own = lines.where(F.col("category") == category)
        top, end = F.when(F.col("part_no") == 1, f"### {heading}\n\n").otherwise(""), F.when(F.col("part_no") == F.max("part_no").over(Window.partitionBy("category")), "\n").otherwise("")
        for report in ("job", "comment"):
            parts.append(own.select(F.lit(report).alias("report"), F.lit(n).alias("section"), "part_no", F.concat(top, "markdown", end).alias("text")))
    for n, (category, name) in enumerate(CONSOLE.items(), 1):
        parts.append(lines.where(F.col("category") == category).select(F.lit("console").alias("report"), F.lit(n).alias("section"), "part_no", F.concat(F.lit(f"  {name}: "), F.array_join("messages", f"\n  {name}: "), F.lit("\n")).alias("text")))
    out = spark.createDataFrame(fixed, "report string, section int, part_no int, text string")
    for p in parts:
        out = out.unionByName(p)
    return out


def run_outputs(pr_url: Column, translated_files: Column, stale: Column) -> list[Column]:
    """The three key=value lines that a run leaves."""
    return [F.concat(F.lit("pr-url="), F.coalesce(pr_url, F.lit(""))).alias("pr_url"), F.concat(F.lit("translated-files-count="), translated_files.cast("string")).alias("files"), F.concat(F.lit("stale-translations-count="), stale.cast("string")).alias("stale")]


def exit_code(fail_on_stale: bool, stale: Column) -> Column:
    return F.when(F.lit(fail_on_stale) & (stale > 0), 1).otherwise(0)


def log_line(level: str, message: Column, path: Column) -> Column:
    """A workflow log line about a file."""
    return F.concat(F.lit(f"::{level} file="), annotation(path), F.lit("::"), annotation(message))


def _section(title: str, items: list[str]) -> str:
    return f"### {title}\n\n" + "".join(f"- {x}\n" for x in items) + "\n" if items else ""


def _languages(langs: list[tuple[str, int, int]]) -> str:
    if not langs:
        return ""
    return "| Language | Chunks translated | From cache |\n| --- | --- | --- |\n" + "".join(f"| {a} | {b} | {c} |\n" for a, b, c in langs) + "\n"


def comment_report(title: str, langs: list[tuple[str, int, int]], lists: dict[str, list[str]]) -> str:
    """The short report: the languages, then each list that has items."""
    return f"## {title} summary\n\n" + _languages(langs) + "".join(_section(t, lists.get(k, [])) for k, t in SECTIONS.items())


def job_report(title: str, files: int, dry_run: bool, url: str | None, langs: list[tuple[str, int, int]], usage: tuple[int, int], lists: dict[str, list[str]]) -> str:
    """The long report: also what was written, in which mode, and the tokens used."""
    head = f"## {title}\n\n**Files translated:** {files}  \n**Mode:** {'dry run' if dry_run else 'push + pull request'}\n" + (f"**Pull request:** {url}\n" if url else "") + "\n"
    tokens = f"### Token usage\n\n| Prompt | Completion | Total |\n| --- | --- | --- |\n| {usage[0]} | {usage[1]} | {sum(usage)} |\n\n"
    return head + _languages(langs) + tokens + "".join(_section(t, lists.get(k, [])) for k, t in SECTIONS.items())


# Event categories in the order of the console with their names there, and its last line of a dry run.
DRY_RUN = "Dry run - no branch was pushed and no pull request was opened."
CONSOLE = {"glossary": "glossary warning", "stale": "drift warning", "healed": "self-healed", "untranslated": "left untranslated", "skipped": "skipped (unexpected reconstruction failure)"}


def _console_head(title: str, files: int, langs: list[tuple[str, int, int]], usage: tuple[int, int]) -> list[str]:
    out = ["", f"=== {title} summary ===", f"Files translated: {files}"]
    out += [f"  [{a}] {b} chunk(s) translated, {c} from cache" for a, b, c in langs]
    if sum(usage):
        out.append(f"Token usage: {usage[0]} prompt + {usage[1]} completion = {sum(usage)} total")
    return out


def _console_tail(dry_run: bool, url: str | None) -> list[str]:
    if dry_run:
        return [DRY_RUN]
    return [f"Pull request: {url}"] if url else []


def console_report(title: str, files: int, dry_run: bool, url: str | None, langs: list[tuple[str, int, int]], usage: tuple[int, int], lists: dict[str, list[str]]) -> str:
    items = [f"  {name}: {x}" for key, name in CONSOLE.items() for x in lists.get(key, [])]
    return "\n".join([*_console_head(title, files, langs, usage), *items, *_console_tail(dry_run, url)]) + "\n"
