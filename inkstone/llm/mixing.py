"""Time-varying curriculum: every source has a schedule of weights over training, and every document a position in it.

A source's share of the mixture is given at knots in training time 0 to 1 and runs linearly between them. Its integral,
times the tokens of all sources, is the source's cumulative token demand. A document is due at the time by which its
source has been asked for all tokens up to the document's last: the inverse of the demand, a square root on each piece.
Documents are range-sorted by that time. A source that offers less than it is asked for ends before time 1; one that
offers more goes on after it at its last share, so each document is placed once and none is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed, n_words, written
from .rows import keyed, ranked, running_sum

#: (training time, exponent): at that time a source's share is its number of tokens to the power of the exponent, of all sources'.
#: Small sources come early, and the mixture ends near the natural one.
SCHEDULE = ((0.0, 0.3), (0.5, 0.7), (1.0, 0.95))


def shares(totals: DataFrame, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> DataFrame:
    """totals (of, total) with p0, p1, ..: the source's share of the mixture at each knot; at each they sum to 1."""
    power = [F.pow(F.greatest("total", F.lit(1)).cast("double"), F.lit(float(a))) for _, a in schedule]
    sums = totals.agg(*(F.sum(x) for x in power)).first()
    return totals.select("of", *((x / F.lit(s or 1.0)).alias(f"p{i}") for i, (x, s) in enumerate(zip(power, sums, strict=True))))


def _due(sent: Column, tokens: float, knots: list[float]) -> Column:
    """The time at which the cumulative demand reaches `sent`, by the shares p0, p1, .. of the row."""
    p = [F.col(f"p{i}") for i in range(len(knots))]
    demand: list[Column] = [F.lit(0.0)]
    for i in range(len(knots) - 1):
        demand.append(demand[-1] + F.lit(tokens * (knots[i + 1] - knots[i]) / 2) * (p[i] + p[i + 1]))
    due = F.lit(knots[-1]) + (sent - demand[-1]) / (F.lit(tokens) * p[-1])
    for i in reversed(range(len(knots) - 1)):
        rest, slope = sent - demand[i], (p[i + 1] - p[i]) * F.lit(tokens / (knots[i + 1] - knots[i]))
        start = F.lit(tokens) * p[i]
        inside = F.lit(knots[i]) + 2 * rest / (start + F.sqrt(F.greatest(start * start + 2 * slope * rest, F.lit(0.0))))
        due = F.when(sent <= demand[i + 1], inside).otherwise(due)
    return due


def _placed(rows: DataFrame, schedule: tuple[tuple[float, float], ...]) -> DataFrame:
    """(__key, __copy, n_tokens, due, position) of keyed rows."""
    source = F.coalesce(F.concat(F.lit("="), F.col("`source`")), F.lit("-"))
    slim = written(rows.select("__key", "__copy", source.alias("of"), n_words(F.col("`text`")).alias("n_tokens"), F.md5(F.concat_ws("|", F.col("`doc_id`").cast("string"), F.col("__copy").cast("string"), n_words(F.col("`text`")).cast("string"))).alias("draw")))
    totals = written(slim.groupBy("of").agg(F.sum("n_tokens").alias("total")))
    tokens = float(totals.agg(F.sum("total")).first()[0] or 1)
    order = ["draw", "__key", "__copy"]
    sent = running_sum(slim, "of", order, F.col("n_tokens"), "sent", "draw").join(shares(totals, schedule), "of")
    due = sent.withColumn("due", _due(F.col("sent").cast("double"), tokens, [t for t, _ in schedule])).select(*order, "n_tokens", "due")
    return ranked(due, ["due", *order], "position").drop("draw")


def mixed(documents: DataFrame, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> DataFrame:
    """Every row of documents with n_tokens (words), due (training time, 9 decimals) and position (1 on, without gaps).

    A source's documents come in the order of md5(doc_id|copy|n_tokens), copy being 1 but for equal rows. A null source
    counts as a source. A null or empty text has no words and is due with the document before it. Ties in time go by that hash.
    Repeated rows are placed apiece. An empty table gives no rows. Further columns are kept; columns of the added
    names, and __key and __copy, are replaced. Texts are moved once.
    """
    rows = keyed(documents.drop("n_tokens", "due", "position"))
    placed = _placed(rows, schedule).withColumn("due", F.round("due", 9))
    return rows.join(placed, ["__key", "__copy"]).drop("__key", "__copy")


def placed(documents: DataFrame, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> DataFrame:
    """mixed() without the texts: (doc_id, source, n_tokens, due, position), for which no text is moved."""
    rows = keyed(documents)
    at = _placed(rows, schedule).withColumn("due", F.round("due", 9))
    return rows.select("__key", "__copy", *fixed("doc_id", "source")).join(at, ["__key", "__copy"]).drop("__key", "__copy")


ORACLE_SQL = """
WITH docs AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS n_tokens FROM documents
), drawn AS (
    SELECT *, coalesce('=' || source, '-') AS of, md5(CAST(doc_id AS VARCHAR) || '|1|' || CAST(n_tokens AS VARCHAR)) AS draw FROM docs
), totals AS (
    SELECT of, CAST(sum(n_tokens) AS DOUBLE) AS total FROM drawn GROUP BY of
), powers AS (
    SELECT of, pow(greatest(total, 1), 0.3) AS a, pow(greatest(total, 1), 0.7) AS b, pow(greatest(total, 1), 0.95) AS c FROM totals
), shares AS (
    SELECT of, a / (SELECT sum(a) FROM powers) AS p0, b / (SELECT sum(b) FROM powers) AS p1, c / (SELECT sum(c) FROM powers) AS p2,
        (SELECT sum(total) FROM totals) AS t FROM powers
), sent AS (
    SELECT doc_id, source, n_tokens, draw, p0, p1, p2, t, t * 0.25 * (p0 + p1) AS d1, t * 0.25 * (p0 + p1) + t * 0.25 * (p1 + p2) AS d2,
        CAST(sum(n_tokens) OVER (PARTITION BY of ORDER BY draw ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS s
    FROM drawn JOIN shares USING (of)
), due AS (
    SELECT doc_id, source, n_tokens, draw, CASE
        WHEN s <= d1 THEN 2 * s / (t * p0 + sqrt(greatest(t * p0 * t * p0 + 4 * t * (p1 - p0) * s, 0)))
        WHEN s <= d2 THEN 0.5 + 2 * (s - d1) / (t * p1 + sqrt(greatest(t * p1 * t * p1 + 4 * t * (p2 - p1) * (s - d1), 0)))
        ELSE 1 + (s - d2) / (t * p2) END AS due FROM sent
)
SELECT doc_id, source, n_tokens, round(due, 9) AS due, CAST(row_number() OVER (ORDER BY due, draw) AS BIGINT) AS position FROM due
"""
