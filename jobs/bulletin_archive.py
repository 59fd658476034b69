"""Archives issued texts by office, checks their layout, marks repeated wording and lists the newest of each office.

    python -m jobs.bulletin_archive --source DIR --output DIR [--config FILE]

``output/texts`` (by office) has a row for each text: lines, the widest line in columns of a terminal, on which Chinese
characters take two, lines wider than allowed, the heading and the wording's key.  ``output/wordings`` (by office) names
for each text the first one of all offices with the same wording, case and white space aside, and how many texts
share it.  ``output/newest`` (by office) lists the newest texts of each office by place.

A run replaces the partitions of the offices that it reads, so that it may be run again at any time.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import align
from gridloom.operators import products as P
from gridloom.sources import stores
from jobs.common import main, write

log = logging.getLogger("bulletin_archive")

TEXTS = "doc_id long, lang string, lines int, widest int, too_wide int, heading string, wording string, office string"
WORDINGS = "doc_id long, wording string, first_id long, copies long, office string"
NEWEST = "doc_id long, place int, latest boolean, heading string, office string"


def layout(docs: DataFrame, width: int) -> DataFrame:
    """A row for each text with an id: its office, the measures of its layout, its heading and the key of its wording.

    A null text is an empty one, and a null source the office ``unknown``.  The heading is the first line that is not blank.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split("body", "\n", -1)
    d = docs.where("doc_id IS NOT NULL").select("doc_id", "lang", P.slug(F.coalesce("source", F.lit("unknown"))).alias("office"), text.alias("body")).withColumn("_lines", lines)
    d = d.withColumn("_widths", F.transform("_lines", P.display_width))
    bare = F.lower(F.btrim(F.regexp_replace("body", "[ \t\n\x0b\f\r]+", " ")))
    heading = F.btrim(F.regexp_extract("body", r"[^ \t\n\x0b\f\r][^\n]*", 0), F.lit(" \t\n\x0b\f\r"))
    return d.select(
        "doc_id", "lang", F.size("_lines").alias("lines"), F.array_max("_widths").alias("widest"), F.size(F.filter("_widths", lambda w: w > width)).alias("too_wide"),
        heading.alias("heading"), F.sha2(bare.cast("binary"), 256).alias("wording"), "office",
    )


def run(spark: SparkSession, source: str, output: str, width: int = 80, keep: int = 20) -> dict[str, int]:
    """Archives the texts of ``source`` (doc_id, text, lang, source); gives the numbers of rows written to the three tables.

    Of rows that repeat an id within an office one is archived: that of the greatest wording's key.
    """
    docs = spark.read.parquet(source)
    once = stores.last_wins(layout(docs, width), ["office", "doc_id"], [F.col("wording"), F.col("lang")])
    written = {"texts": write(once, f"{output}/texts", ["office"])}
    texts = spark.read.schema(TEXTS).parquet(f"{output}/texts")
    shared = texts.groupBy("wording").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    found = align.lookup(texts.select("doc_id", "wording", "office"), shared, ["wording"], "copies")
    written["wordings"] = write(found.select(*[f.split()[0] for f in WORDINGS.split(", ")]), f"{output}/wordings", ["office"])
    newest = stores.newest(texts.select("doc_id", "heading", "office"), ["office"], [F.desc("doc_id"), F.col("heading")], keep)
    written["newest"] = write(newest.select("doc_id", "place", (F.col("place") == 1).alias("latest"), "heading", "office"), f"{output}/newest", ["office"])
    log.info("read %d texts of %s; wrote %s", written["texts"], source, ", ".join(f"{n} rows to {output}/{t}" for t, n in written.items()))
    return written


def archive(spark: SparkSession, output: str) -> DataFrame:
    """The archive as it stands: each text with its wording's first text, and its place among the newest of its office."""
    texts, wordings, newest = (spark.read.schema(s).parquet(f"{output}/{t}") for t, s in (("texts", TEXTS), ("wordings", WORDINGS), ("newest", NEWEST)))
    return texts.join(wordings.drop("wording"), ["office", "doc_id"]).join(newest.drop("heading"), ["office", "doc_id"], "left")


if __name__ == "__main__":
    main(run, __doc__, f"{os.path.dirname(os.path.abspath(__file__))}/bulletin_archive.json", ("source", "output"))
