"""Deliveries to messages: canonical identifiers and the first delivery of each.

Null identifiers never match each other. Rows without an arrival (`ingest_ts`, `kafka_partition`,
`kafka_offset`) cannot be ranked and are left out. An empty input gives an empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelot.session import spread

BLANKS = " \t\r\n\f\x0b"

#: Ranks the deliveries of one identifier: earliest arrival, then lowest offset, then lowest partition.
RANK = ("ingest_ts", "kafka_offset", "kafka_partition")


def canonical_word(c: str | Column) -> Column:
    """Upper case without outer blanks, as spellings of `event_type` and `status` are compared."""
    return F.upper(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)))


def canonical_id(c: str | Column, digits: int = 32) -> Column:
    """The number behind a hexadecimal identifier as binary, whatever its case, braces, dashes, prefix or leading zeros.

    Numbers of up to `digits` digits are written with that many. Text that is no hexadecimal number
    stands for itself; text without any sign but blanks and punctuation is null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.translate(c, BLANKS + "{}()-_", "")
    # Nearly all identifiers have all their digits and no prefix; only the others pay for a pattern.
    whole = F.when(F.length(bare) == digits, F.unhex(bare))
    number = F.regexp_replace(F.lower(bare), "^(urn:uuid:|0x)?0*(?=.)", "")
    padded = F.unhex(F.lpad(number, F.greatest(F.length(number), F.lit(digits)), F.lit("0")))
    text = F.encode(F.concat(F.lit("not-a-number:"), number), "utf-8")
    return F.when(bare != "", F.coalesce(whole, padded, text))


def own_key(id_col: str) -> Column:
    """Null beside an identifier, else the delivery's position: null identifiers match nothing and spread over all tasks."""
    return F.when(F.col(id_col).isNull(), F.concat_ws(":", "kafka_partition", "kafka_offset"))


def ranked(df: DataFrame) -> DataFrame:
    """Deliveries that have an arrival."""
    return df.filter(F.col("ingest_ts").isNotNull() & F.col("kafka_partition").isNotNull() & F.col("kafka_offset").isNotNull())


def first_delivered(df: DataFrame, payload: Sequence[str], id_col: str = "event_id") -> DataFrame:
    """`id` (null where there is none), arrival and `payload` of the first delivery of each identifier.

    A minimum over (arrival, payload) structs: partial aggregation keeps one row per identifier and
    map task, so an identifier delivered any number of times never gathers in one task.
    """
    cols = [*RANK, *(c for c in payload if c not in RANK)]
    rows = spread(df.select(F.col(id_col).alias("_id"), *cols), "kafka_partition", "kafka_offset")
    rows = ranked(rows).withColumn("_id", canonical_id("_id")).withColumn("_own", own_key("_id"))
    best = rows.groupBy("_id", "_own").agg(F.min(F.struct(*cols)).alias("_first"))
    return best.select(F.col("_id").alias("id"), "_first.*")


def messages(df: DataFrame, payload: Sequence[str]) -> DataFrame:
    """`first_delivered` over events, with `event_type` and `status` in canonical spelling."""
    words = {c: canonical_word(c) for c in ("event_type", "status") if c in payload}
    return first_delivered(df.withColumns(words), payload)

