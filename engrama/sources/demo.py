"""A small synthetic store to look around in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.schema import MEMORY
from engrama.sources.embedding import Embed, embedding

#: Who the memories are about, and what is said of each.
THEMES = {
    "the garden": ("has tomatoes along the south wall", "needs water every second evening", "lost two rose bushes to frost", "gets compost in spring"),
    "the boat": ("is moored at the small harbour", "got a new sail last summer", "leaks a little near the bow", "is called Kittiwake"),
    "the choir": ("rehearses on Thursdays", "is preparing a requiem", "has too few tenors", "sings in the old chapel"),
    "the course": ("covers linear algebra this term", "ends with an oral exam", "meets in room twelve", "sets a problem sheet each week"),
    "the cat": ("is called Pepper", "sleeps on the radiator", "is afraid of the vacuum cleaner", "may not eat dairy"),
    "the bread": ("is baked on Saturdays", "needs a night to rise", "turned out too dense with rye", "is shared with the neighbours"),
}
FIRST_ID = 1000


def texts() -> list[str]:
    return [f"{theme[0].upper()}{theme[1:]} {fact}." for theme, facts in THEMES.items() for fact in facts]


def demo(spark: SparkSession, now: datetime, embed: Embed | None = None) -> DataFrame:
    """The demo memories in MEMORY's columns and _pos, ids from FIRST_ID, embedded if there is an embedder."""
    rows = [(str(FIRST_ID + i), now, now, t, None, 0.0, 0, None, now, None, now, None, None, 1, False, "user_stated", False, False) for i, t in enumerate(texts())]
    out = spark.createDataFrame(rows, MEMORY).withColumn("_pos", F.col("id").cast("long") - FIRST_ID + 1)
    from engrama.functions.text import is_constraint

    out = out.withColumn("is_constraint", is_constraint(F.col("text")))
    return out.withColumn("embedding", embedding(embed, F.col("text"))) if embed else out
