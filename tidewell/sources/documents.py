"""Nested documents: TOML in, typed rows, HTML out."""

from __future__ import annotations

import argparse
import sys
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "STRUCT<title: STRING, organization: STRING, location: STRING, start: STRING, end: STRING, details: ARRAY<STRING>>"
SCHEMA = f"name STRING, contact MAP<STRING, STRING>, education ARRAY<{_ENTRY}>, experience ARRAY<{_ENTRY}>, projects ARRAY<{_ENTRY}>, skills ARRAY<STRING>"
_FIELDS = ("title", "organization", "location", "start", "end")


def load_toml(path: str) -> dict:
    """A TOML file as a dict; FileNotFoundError if there is none."""
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def _entry(d: dict) -> tuple:
    return (*(str(d.get(f) or "") for f in _FIELDS), [str(x) for x in d.get("details") or []])


def resume(d: dict) -> tuple:
    """A document as a row: the name is needed (at the top or under personal), all else has defaults."""
    personal = d.get("personal") or {}
    name = d.get("name") or personal.get("name")
    if not name:
        raise ValueError("a resume needs a name")
    contact = {k: str(v) for k, v in (d.get("contact") or {k: v for k, v in personal.items() if k != "name"}).items()}
    return (name, contact, *([_entry(e) for e in d.get(k) or []] for k in ("education", "experience", "projects")), [str(s) for s in d.get("skills") or []])


def resumes(spark: SparkSession, documents: list[dict]) -> DataFrame:
    return spark.createDataFrame([resume(d) for d in documents], SCHEMA)


def parse_json(documents: DataFrame, column: str) -> DataFrame:
    """Rows of a JSON text column: nulls become defaults, a missing name is an error."""
    d = F.from_json(column, SCHEMA)
    name = F.coalesce(d["name"], F.raise_error(F.lit("a resume needs a name")).cast("string"))
    lists = [F.coalesce(d[k], F.expr(f"cast(array() as array<{_ENTRY}>)")).alias(k) for k in ("education", "experience", "projects")]
    return documents.select(name.alias("name"), F.coalesce(d["contact"], F.expr("cast(map() as map<string,string>)")).alias("contact"), *lists, F.coalesce(d["skills"], F.expr("cast(array() as array<string>)")).alias("skills"))


def escape_html(x: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(coded))
    return x


def render_html(rows: DataFrame) -> DataFrame:
    """name and html: heading, contact, education and experience (projects and skills are kept, not rendered)."""

    def lines(entries: Column) -> Column:
        def one(e: Column) -> Column:
            head = F.concat_ws(", ", *(F.nullif(escape_html(e[f]), F.lit("")) for f in ("title", "organization", "location")))
            dates = F.concat_ws(" - ", *(F.nullif(escape_html(e[f]), F.lit("")) for f in ("start", "end")))
            items = F.array_join(F.transform(e["details"], lambda x: F.concat(F.lit("<li>"), escape_html(x), F.lit("</li>"))), "")
            return F.concat(F.lit("<div><b>"), head, F.lit("</b> <i>"), dates, F.lit("</i><ul>"), items, F.lit("</ul></div>"))

        return F.array_join(F.transform(entries, one), "")

    contact = F.array_join(F.transform(F.array_sort(F.map_entries("contact")), lambda x: escape_html(x["value"])), " | ")
    html = F.concat(
        F.lit("<html><body><h1>"), escape_html(F.col("name")), F.lit("</h1><p>"), contact, F.lit("</p><h2>Education</h2>"), lines(F.col("education")), F.lit("<h2>Experience</h2>"), lines(F.col("experience")), F.lit("</body></html>")
    )
    return rows.select("name", html.alias("html"))


def main(args: list[str] | None = None) -> int:
    """Command line: a TOML file to an HTML file; 2 if the input can't be read."""
    parser = argparse.ArgumentParser(prog="tidewell-resume")
    parser.add_argument("input")
    parser.add_argument("--html")
    parser.add_argument("--pdf", help="ignored")
    parser.add_argument("--template", help="ignored: there is one layout")
    found = parser.parse_args(args)
    try:
        row = resume(load_toml(found.input))
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    html = render_html(spark.createDataFrame([row], SCHEMA)).first()["html"]
    if found.html:
        Path(found.html).write_text(html, encoding="utf-8")
    else:
        print(html)
    return 0


if __name__ == "__main__":
    sys.exit(main())
