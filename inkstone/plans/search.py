"""Quotation search: tiers, cascade, ranking, duplicates, context, postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stored
from ..functions import compact, norm, plain, plain_at_once
from ..operators import grams as g
from ..operators import quotes as q
from ..registry import both, given, query
from ..sources import plains, views
from .dialect import DUCK, SPARK, Spark

SCORE = "CASE tier WHEN 1 THEN CAST(1.0 AS DOUBLE) WHEN 2 THEN CAST(0.985 AS DOUBLE) WHEN 3 THEN CAST(0.96 AS DOUBLE) ELSE CAST(0.92 AS DOUBLE) END"


def quote_views(d: Spark) -> str:
    return f"quoted AS (SELECT item_id, text AS text_raw, {norm(d, 'text')} AS norm FROM benchmark), quotes AS (SELECT *, {compact(d, 'norm')} AS compact, {plain(d, 'norm')} AS plain FROM quoted)"


_DUCK_HITS = """hits AS (SELECT q.item_id, p.paragraph_id, CASE WHEN strpos(p.text_raw, q.text_raw) > 0 THEN 1 WHEN strpos(p.norm, q.norm) > 0 THEN 2 WHEN strpos(p.compact, q.compact) > 0 THEN 3 ELSE 4 END AS tier
    FROM paragraphs p JOIN quotes q ON strpos(p.plain, q.plain) > 0 WHERE p.eligible AND length(q.plain) > 0)"""


def of_documents(spark: SparkSession, ids: DataFrame) -> None:
    """View `documents`: from now on only the rows that have one of these numbers. Two million numbers are sent about, more are shuffled."""
    ids, documents = stored(ids.toDF("own").distinct()), spark.table("documents")
    few = F.broadcast(ids) if ids.count() <= 2_000_000 else ids
    stored(documents.join(few, documents.doc_id == ids.own, "left_semi")).createOrReplaceTempView("documents")


def searched(text):
    """Register a query over the paragraphs of documents that hold a quote, quotes and hits (item_id, paragraph_id, tier).

    Every document is searched as a whole first; only those that hold a quote are cut into paragraphs, so each is normalised once.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given(spark, sf_dir, "documents", "benchmark")
        held = f"WITH {views(SPARK)}, {quote_views(SPARK)}"
        whole = f"SELECT doc_id, CASE WHEN NOT contains(text, 'Σ') THEN {plain_at_once(SPARK, 'text')} END AS plain FROM documents WHERE text IS NOT NULL"
        of_documents(spark, q.holding(spark.sql(whole), spark.sql(f"{held} SELECT item_id, plain FROM quotes")))
        paragraphs = spark.sql(f"{held} SELECT paragraph_id, text_raw, norm, compact, plain FROM paragraphs WHERE eligible")
        stored(q.hits(paragraphs, spark.sql(f"{held} SELECT * FROM quotes"))).createOrReplaceTempView("hits")
        return spark.sql(f"{held} {text(SPARK)}")

    run.__name__ = text.__name__
    query(f"WITH {views(DUCK)}, {quote_views(DUCK)}, {_DUCK_HITS} {text(DUCK)}")(run)
    return text


def _tier(tier: int, name: str):
    def text(d: Spark) -> str:
        return f"SELECT item_id, paragraph_id, '{name}' AS match_type, {SCORE} AS match_score FROM hits WHERE tier <= {tier}".replace("tier <= 1", "tier = 1")

    return text


def _named(name: str, text):
    text.__name__ = name
    return text


searched(_named("exact_quote", lambda d: f"SELECT h.item_id, h.paragraph_id, CASE WHEN tier = 1 THEN 'exact' ELSE 'normalized_exact' END AS match_type, {SCORE} AS match_score, CAST(CASE WHEN tier = 1 THEN {d.find('p.text_raw', 'q.text_raw')} ELSE {d.find('p.norm', 'q.norm')} END - 1 AS BIGINT) AS match_start, CAST(CASE WHEN tier = 1 THEN {d.find('p.text_raw', 'q.text_raw')} + length(q.text_raw) ELSE {d.find('p.norm', 'q.norm')} + length(q.norm) END - 1 AS BIGINT) AS match_end FROM hits h JOIN paragraphs p ON h.paragraph_id = p.paragraph_id JOIN quotes q ON h.item_id = q.item_id WHERE tier <= 2"))
searched(_named("compact_quote", lambda d: "SELECT item_id, paragraph_id, 'space_insensitive' AS match_type, CAST(0.96 AS DOUBLE) AS match_score FROM hits WHERE tier <= 3"))
searched(_named("punct_quote", lambda d: "SELECT item_id, paragraph_id, 'punctuation_insensitive' AS match_type, CAST(0.92 AS DOUBLE) AS match_score FROM hits"))

_CASCADE = f"best AS (SELECT item_id, CASE WHEN min(tier) <= 2 THEN 2 ELSE min(tier) END AS upto FROM hits GROUP BY item_id), cascade AS (SELECT h.item_id, h.paragraph_id, tier, {SCORE} AS match_score FROM hits h JOIN best b ON h.item_id = b.item_id WHERE h.tier <= b.upto)"
_RANKED = f"{_CASCADE}, ranked AS (SELECT c.item_id, c.tier, c.match_score, p.*, row_number() OVER (PARTITION BY c.item_id ORDER BY match_score DESC, CASE WHEN is_cross THEN 1 ELSE 0 END, source_type, source, p.doc_id, p.paragraph_index) AS place FROM cascade c JOIN paragraphs p ON c.paragraph_id = p.paragraph_id)"
_FIRST = f"{_RANKED}, deduped AS (SELECT *, row_number() OVER (PARTITION BY item_id, source, doc_id, substr(plain, 1, 180) ORDER BY place) AS again FROM ranked)"
#: A window is dropped where a page of its own has the hit too.
_MERGED = f"{_FIRST}, real AS (SELECT item_id, doc_id, page_start FROM deduped WHERE again = 1 AND source_type = 'pdf' AND NOT is_cross), merged AS (SELECT f.* FROM deduped f LEFT JOIN real a ON f.is_cross AND f.item_id = a.item_id AND f.doc_id = a.doc_id AND f.page_start = a.page_start LEFT JOIN real b ON f.is_cross AND f.item_id = b.item_id AND f.doc_id = b.doc_id AND f.page_end = b.page_start WHERE f.again = 1 AND a.item_id IS NULL AND b.item_id IS NULL)"


@searched
def auto_cascade(d: Spark) -> str:
    """Each quote's hits by the strictest form in which anything holds it, ranked, without repeats."""
    return f", {_MERGED} SELECT item_id, concat('doc-', CAST(doc_id AS {d.text})) AS source_file_id, paragraph_id, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'normalized_exact' WHEN 3 THEN 'space_insensitive' ELSE 'punctuation_insensitive' END AS match_type, match_score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY place) AS BIGINT) AS place FROM merged"


@searched
def quote_topk(d: Spark) -> str:
    return f", {_RANKED} SELECT item_id, paragraph_id, match_score, CAST(place AS BIGINT) AS place FROM ranked WHERE place <= 10"


@searched
def merge_dedup(d: Spark) -> str:
    return f", {_FIRST} SELECT item_id, paragraph_id, CAST(place AS BIGINT) AS place FROM deduped WHERE again = 1"


@searched
def cross_dup(d: Spark) -> str:
    return f", {_MERGED} SELECT item_id, paragraph_id, is_cross FROM merged"


@searched
def candidate_merge(d: Spark) -> str:
    return f", {_CASCADE} SELECT paragraph_id, max(match_score) AS best_score, count(*) AS n_quotes FROM cascade GROUP BY paragraph_id"


@searched
def quote_totals(d: Spark) -> str:
    return f", {_MERGED} SELECT q.item_id, count(m.item_id) AS total, count(m.item_id) > 10 AS has_more FROM quotes q LEFT JOIN merged m ON q.item_id = m.item_id GROUP BY q.item_id"


@searched
def quote_format(d: Spark) -> str:
    """Result rows: what is shown of a hit."""
    short = f"CASE WHEN length(q.text_raw) > 50 THEN concat(substr(q.text_raw, 1, 49), '…') ELSE q.text_raw END"
    return f", {_MERGED} SELECT m.item_id, m.paragraph_id, {short} AS match_quote, round(match_score, 4) AS score, CASE WHEN m.source_type = 'word' THEN NULL WHEN is_cross THEN concat(CAST(page_start + 1 AS {d.text}), '-', CAST(page_end + 1 AS {d.text})) ELSE CAST(page_start + 1 AS {d.text}) END AS page_display, concat('w-', CAST(m.doc_id AS {d.text})) AS work_id, m.source AS volume_id FROM merged m JOIN quotes q ON m.item_id = q.item_id"


@searched
def page_spans(d: Spark) -> str:
    """Which characters of which page an exact hit covers, in windows across pages too."""
    at = f"({d.find('m.text_raw', 'q.text_raw')} - 1)"
    return f""", {_CASCADE}, found AS (SELECT c.item_id, m.paragraph_id, m.doc_id, m.is_cross, m.page_start, m.page_end, {at} AS a, {at} + length(q.text_raw) AS b, length(l.text) AS n FROM cascade c JOIN paragraphs m ON c.paragraph_id = m.paragraph_id JOIN quotes q ON c.item_id = q.item_id JOIN leaves l ON m.doc_id = l.doc_id AND m.page_start = l.page_index WHERE c.tier = 1 AND m.source_type = 'pdf')
SELECT item_id, paragraph_id, CAST(page_start AS BIGINT) AS page_index, CAST(CASE WHEN is_cross THEN n - least(n, 900) + a ELSE a END AS BIGINT) AS page_char_start, CAST(CASE WHEN is_cross THEN n - least(n, 900) + least(b, least(n, 900)) ELSE b END AS BIGINT) AS page_char_end FROM found WHERE NOT is_cross OR a < least(n, 900)
UNION ALL SELECT item_id, paragraph_id, CAST(page_end AS BIGINT), CAST(greatest(0, a - least(n, 900) - 1) AS BIGINT), CAST(b - least(n, 900) - 1 AS BIGINT) FROM found WHERE is_cross AND b > least(n, 900) + 1"""


@searched
def context_neighbors(d: Spark) -> str:
    """The nearest real paragraph before and after each hit."""
    return f""", {_CASCADE}, real AS (SELECT doc_id, paragraph_id, paragraph_index, text_raw, lag(paragraph_id) OVER w AS before, lead(paragraph_id) OVER w AS after FROM paragraphs WHERE coalesce(NOT is_cross, TRUE) AND length(trim(text_raw)) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_index))
SELECT c.item_id, c.paragraph_id, r.before AS context_before, r.after AS context_after FROM cascade c JOIN real r ON c.paragraph_id = r.paragraph_id"""


def postings(d: Spark) -> str:
    return f"postings AS (SELECT gram, paragraph_id FROM (SELECT paragraph_id, plain FROM paragraphs WHERE eligible AND length(plain) >= 3) p {d.unnest(d.distinct(d.grams('plain', 3)), 'gram')})"


def asked(d: Spark) -> str:
    """All distinct trigrams of each quote."""
    return f"asked AS (SELECT DISTINCT item_id, gram FROM (SELECT item_id, plain FROM quotes WHERE length(plain) >= 3) q {d.unnest(d.grams('plain', 3), 'gram')})"


def _over(d: Spark) -> str:
    return f"WITH {views(d)}, {quote_views(d)}, {postings(d)}, {asked(d)}, df AS (SELECT gram, count(*) AS df FROM postings WHERE gram IN (SELECT gram FROM asked) GROUP BY gram), size AS (SELECT count(*) AS n FROM paragraphs WHERE eligible AND length(plain) >= 3), met AS (SELECT a.item_id, p.paragraph_id, count(*) AS n_grams, round(sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1)), 6) AS idf_sum FROM asked a JOIN df f ON a.gram = f.gram JOIN postings p ON a.gram = p.gram CROSS JOIN size s GROUP BY a.item_id, p.paragraph_id)".replace("0.5", "CAST(0.5 AS DOUBLE)")


@query(f"WITH {views(DUCK)}, {postings(DUCK)} SELECT gram, count(*) AS n_paragraphs FROM postings GROUP BY gram")
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given(spark, sf_dir, "documents")
    return g.gram_counts(spark.sql(f"WITH {views(SPARK)} {plains()}"), 3, each=True).withColumnRenamed("n", "n_paragraphs")


def searchable(spark: SparkSession) -> DataFrame:
    """Every paragraph once as (paragraph_id, plain, least); those that share an id are parts of one, with line feeds between them."""
    documents = spark.table("documents")
    again = documents.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return spark.sql(f"WITH {views(SPARK)} {plains()}")
    stored(again).createOrReplaceTempView("repeated")
    once, more = (spark.sql(f"WITH documents AS (SELECT * FROM documents {kind} JOIN repeated ON doc_id = again), {views(SPARK)} {plains()}") for kind in ("LEFT ANTI", "LEFT SEMI"))
    parts = more.withColumn("length", F.length("plain")).where("length >= greatest(least, 3)")
    return once.select("paragraph_id", "plain", "least").unionByName(parts.groupBy("paragraph_id").agg(F.array_join(F.collect_list("plain"), "\n").alias("plain"), F.lit(0).alias("least")))


def _asked(spark: SparkSession, sf_dir: str) -> dict:
    given(spark, sf_dir, "documents", "benchmark")
    return g.asked_grams(spark.sql(f"WITH {quote_views(SPARK)} SELECT item_id, plain FROM quotes"))


def _most(spark: SparkSession, sf_dir: str) -> None:
    """View `top`: the 700 paragraphs that have the most trigrams of each quote."""
    asked = _asked(spark, sf_dir)
    g.most_grams(searchable(spark), asked, 700).createOrReplaceTempView("met")
    spark.sql("SELECT * FROM (SELECT item_id, paragraph_id, CAST(value AS BIGINT) AS n_grams, CAST(row_number() OVER (PARTITION BY item_id ORDER BY value DESC, paragraph_id) AS BIGINT) AS place FROM met) r WHERE place <= 700").createOrReplaceTempView("top")


@query(f"{_over(DUCK)}, sizes AS (SELECT item_id, count(*) AS n FROM asked GROUP BY item_id) SELECT m.item_id, m.paragraph_id FROM met m JOIN sizes z ON m.item_id = z.item_id AND m.n_grams = z.n")
def trigram_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    return g.holders(searchable(spark), asked)


@query(f"{_over(DUCK)} SELECT item_id, paragraph_id, CAST(n_grams AS BIGINT) AS n_grams, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_grams DESC, paragraph_id) AS place FROM met) r WHERE place <= 700")
def trigram_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _most(spark, sf_dir)
    return spark.table("top")


_K1, _B = "CAST(1.2 AS DOUBLE)", "CAST(0.75 AS DOUBLE)"


@query(f"{_over(DUCK)}, long AS (SELECT paragraph_id, CAST(length(plain) AS DOUBLE) AS len, (SELECT avg(length(plain)) FROM paragraphs WHERE eligible AND length(plain) >= 3) AS mean FROM paragraphs WHERE eligible AND length(plain) >= 3), scored AS (SELECT m.item_id, m.paragraph_id, round(idf_sum * ({_K1} + 1) / (1 + {_K1} * (1 - {_B} + {_B} * len / mean)), 4) AS score FROM met m JOIN long l ON m.paragraph_id = l.paragraph_id) SELECT item_id, paragraph_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paragraph_id) AS place FROM scored) r WHERE place <= 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate order by BM25 over distinct trigrams (frequency 1 each), k1 = 1.2, b = 0.75."""
    asked = _asked(spark, sf_dir)
    met, mean = g.best_bm25(searchable(spark), asked, 50)
    met.createOrReplaceTempView("met")
    return spark.sql(f"SELECT item_id, paragraph_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paragraph_id) AS place FROM (SELECT item_id, paragraph_id, round(round(value, 6) * ({_K1} + 1) / (1 + {_K1} * (1 - {_B} + {_B} * len / CAST({mean!r} AS DOUBLE))), 4) AS score FROM met) s) r WHERE place <= 50")


@query()
def fuzzy_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 700 best trigram candidates of each quote, verified by window ratio; no SQL has that ratio."""
    _most(spark, sf_dir)
    top = stored(spark.table("top"))
    top.createOrReplaceTempView("top")
    of_documents(spark, top.select(F.regexp_extract("paragraph_id", "^doc-(-?[0-9]+)-", 1).cast("long")))
    found = spark.sql(f"WITH {views(SPARK)}, {quote_views(SPARK)} SELECT t.item_id, t.paragraph_id, q.plain AS query, p.plain FROM top t JOIN quotes q ON t.item_id = q.item_id JOIN ({plains()}) p ON t.paragraph_id = p.paragraph_id")
    return q.fuzzy(found.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


@both
def flt_scope(d: Spark) -> str:
    return f"WITH {views(d)} SELECT source_type, source AS volume_id, count(*) AS n FROM paragraphs WHERE eligible AND source_type = 'pdf' AND source IN ('src1', 'src2', 'src3') GROUP BY source_type, source"


@both
def flt_substring(d: Spark) -> str:
    return f"WITH {views(d)} SELECT paragraph_id FROM paragraphs WHERE eligible AND ({d.find('text_raw', chr(39) + 'tion the' + chr(39))} > 0 OR {d.find('norm', chr(39) + 'tion the' + chr(39))} > 0)"


def _overlap(d: Spark) -> str:
    return f"{quote_views(d)}, a AS (SELECT item_id, gram FROM quotes q {d.unnest(d.distinct(d.grams('plain', 2)), 'gram')}), b AS (SELECT paragraph_id, doc_id, gram FROM (SELECT paragraph_id, doc_id, plain FROM paragraphs) p {d.unnest(d.distinct(d.grams('plain', 2)), 'gram')}) SELECT a.item_id, b.paragraph_id, count(*) AS overlap FROM a JOIN b ON a.item_id = b.doc_id AND a.gram = b.gram GROUP BY a.item_id, b.paragraph_id"


@query(f"WITH {views(DUCK)}, {_overlap(DUCK)}")
def gram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of each quote's bigrams that each paragraph of the document with its number has; no other document is cut into grams."""
    given(spark, sf_dir, "documents", "benchmark")
    of_documents(spark, spark.table("benchmark").select("item_id"))
    return spark.sql(f"WITH {views(SPARK)}, {_overlap(SPARK)}")
