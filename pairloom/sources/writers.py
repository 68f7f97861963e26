"""Writers: CSV, one folder per method, and Markdown reports from aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import describe


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that read_csv reads back whole; arrays and maps must be joined to text before."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def write_by_method(long: DataFrame, path: str) -> None:
    """One folder per value of ``method``."""
    long.write.mode("overwrite").partitionBy("method").parquet(path)


def count_lines(df: DataFrame, by: str, title: str) -> DataFrame:
    """(position, line): a heading and a Markdown line per value, the most frequent first, ties by name."""
    counts = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    ordered = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "k", "n"))).alias("all"))
    lines = F.concat(F.array(F.lit(f"## {title}"), F.lit("")), F.transform("all", lambda x: F.concat(F.lit("- "), x["k"], F.lit(": "), F.format_number(x["n"], 0))))
    return ordered.select(F.posexplode(lines).alias("position", "line"))


def score_summary(results: DataFrame, scores: list[str], label: str | None = None, errors: str | None = None) -> list[DataFrame]:
    """Parts of a report on scored pairs: rows by label, a table of each score's figures, and rows by error text."""
    figures = describe(results, *scores)
    columns = ["n", "mean", "std", "min", "p25", "p50", "p75", "max"]
    place = F.array_position(F.array(*map(F.lit, scores)), F.col("name")).cast("int")
    cells = [F.coalesce(F.col(c).cast("string") if c == "n" else F.format_string("%.4f", c), F.lit("")) for c in columns]
    head = results.sparkSession.createDataFrame([(-3, "## Scores"), (-2, ""), (-1, "| score | " + " | ".join(columns) + " |"), (0, "|-" * (len(columns) + 1) + "|")], "position int, line string")
    table = figures.select(place.alias("position"), F.concat(F.lit("| "), F.concat_ws(" | ", F.col("name"), *cells), F.lit(" |")).alias("line"))
    parts = [count_lines(results, label, "Labels")] if label else []
    parts.append(head.unionByName(table))
    if errors:
        parts.append(count_lines(results.filter(F.trim(F.coalesce(errors, F.lit(""))) != ""), errors, "Errors"))
    return parts


def markdown(parts: list[DataFrame], title: str) -> str:
    """A report from parts of bounded size (position, line), such as counts by group."""
    out = [f"# {title}"]
    for p in parts:
        out += ["", *(r.line for r in p.orderBy("position").collect())]
    return "\n".join(out) + "\n"
