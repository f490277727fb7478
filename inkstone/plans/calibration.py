"""Page calibration: from page-number evidence to citable page labels."""

from __future__ import annotations

from ..functions import ROMAN, int_to_roman, roman
from ..registry import both
from ..sources import views
from .dialect import Spark

#: Evidence as SURVEY 7.2 makes it, with a second piece of lower score on every seventh page.
EVIDENCE = """evidence AS (
    SELECT doc_id, page_index, page_index + 1 + doc_id % 5 + CASE WHEN (doc_id + page_index) % 11 = 0 THEN 7 ELSE 0 END AS number, 'arabic' AS family, CAST(0.82 AS DOUBLE) AS score, 0 AS ordinal FROM leaves WHERE (doc_id + page_index) % 4 <> 0
    UNION ALL SELECT doc_id, page_index, page_index + 40, 'arabic', CAST(0.48 AS DOUBLE), 1 FROM leaves WHERE page_index % 7 = 0
),
best AS (SELECT doc_id, family, page_index, number, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, family, page_index ORDER BY score DESC, ordinal) AS place FROM evidence) e WHERE place = 1),
grouped AS (SELECT *, number - page_index AS shift, lag(page_index) OVER (PARTITION BY doc_id, family, number - page_index ORDER BY page_index) AS before FROM best),
clustered AS (SELECT *, sum(CASE WHEN before IS NULL OR page_index - before > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, family, shift ORDER BY page_index) AS cluster FROM grouped),
stepped AS (SELECT *, lag(page_index) OVER (PARTITION BY doc_id, family, shift, cluster ORDER BY page_index) AS last_page, lag(number) OVER (PARTITION BY doc_id, family, shift, cluster ORDER BY page_index) AS last_number FROM clustered),
stats AS (SELECT doc_id, family, shift, cluster, count(*) AS support, min(page_index) AS first_page, max(page_index) AS last_page, min(number) AS first_number, avg(score) AS mean_score, coalesce(avg(CASE WHEN page_index > last_page THEN CASE WHEN number - last_number = page_index - last_page THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END), CAST(0.0 AS DOUBLE)) AS consistency FROM stepped GROUP BY doc_id, family, shift, cluster HAVING count(*) >= 2),
confident AS (SELECT *, round(least(CAST(0.99 AS DOUBLE), CAST(0.28 AS DOUBLE) + least(CAST(0.36 AS DOUBLE), CAST(0.055 AS DOUBLE) * support) + CAST(0.28 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), 2 * consistency) + CAST(0.22 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), mean_score)), 4) AS confidence FROM stats),
levels AS (SELECT *, CASE WHEN confidence >= 0.86 AND support >= 4 THEN 'high' WHEN confidence >= 0.68 AND support >= 3 THEN 'medium' ELSE 'low' END AS level FROM confident)"""


def over(d: Spark, select: str) -> str:
    return f"WITH {views(d)}, {EVIDENCE} {select}"


@both
def page_candidates(d: Spark) -> str:
    return over(d, "SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, CAST(number AS BIGINT) AS number, score FROM best")


@both
def page_offset_groups(d: Spark) -> str:
    return over(d, "SELECT doc_id, family, CAST(shift AS BIGINT) AS shift, count(*) AS n, count(DISTINCT page_index) AS n_pages FROM grouped GROUP BY doc_id, family, shift HAVING count(*) >= 2")


@both
def page_clusters(d: Spark) -> str:
    return over(d, "SELECT doc_id, CAST(shift AS BIGINT) AS shift, CAST(cluster AS BIGINT) AS cluster, CAST(support AS BIGINT) AS support, CAST(first_page AS BIGINT) AS first_page, CAST(last_page AS BIGINT) AS last_page FROM stats")


@both
def page_consistency(d: Spark) -> str:
    return over(d, "SELECT doc_id, CAST(shift AS BIGINT) AS shift, CAST(cluster AS BIGINT) AS cluster, round(consistency, 6) AS consistency, round(mean_score, 6) AS mean_score FROM stats")


@both
def segment_confidence(d: Spark) -> str:
    return over(d, "SELECT doc_id, CAST(shift AS BIGINT) AS shift, CAST(cluster AS BIGINT) AS cluster, confidence, level FROM levels")


@both
def stride_support(d: Spark) -> str:
    return over(d, "SELECT doc_id, CAST(max(n) AS BIGINT) AS support FROM (SELECT doc_id, number - 2 * page_index AS shift, count(DISTINCT page_index) AS n FROM best GROUP BY doc_id, number - 2 * page_index) s GROUP BY doc_id")


@both
def spread_pairs(d: Spark) -> str:
    return over(d, "SELECT a.doc_id, CAST(a.page_index AS BIGINT) AS page_index, CAST(a.number AS BIGINT) AS left_number, CAST(b.number AS BIGINT) AS right_number FROM evidence a JOIN evidence b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.ordinal < b.ordinal AND abs(a.number - b.number) <= 40 AND (a.number + b.number) % 2 = 1")


@both
def map_page_range_join(d: Spark) -> str:
    """Each page's label by the best confident segment that holds it; ranges become pages, so the join is an equality."""
    spread = "explode(sequence(first_page, last_page))" if d.name == "spark" else "unnest(range(first_page, last_page + 1))"
    return over(d, f", held AS (SELECT doc_id, shift, confidence, support, first_page, {spread} AS page FROM levels WHERE level = 'high') SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, CAST(page_index + shift AS {d.text}) AS label, CASE WHEN shift IS NULL THEN 'uncalibrated' ELSE 'auto_mapped_high' END AS method, confidence FROM (SELECT l.doc_id, l.page_index, h.shift, h.confidence, row_number() OVER (PARTITION BY l.doc_id, l.page_index ORDER BY h.confidence DESC, h.support DESC, h.first_page, h.shift) AS place FROM leaves l LEFT JOIN held h ON l.doc_id = h.doc_id AND l.page_index = h.page) r WHERE place = 1")


@both
def exception_pages(d: Spark) -> str:
    spread = "explode(sequence(first_page, last_page))" if d.name == "spark" else "unnest(range(first_page, last_page + 1))"
    return over(d, f", held AS (SELECT DISTINCT doc_id, {spread} AS page FROM levels WHERE level = 'high') SELECT b.doc_id, CAST(b.page_index AS BIGINT) AS page_index FROM best b LEFT JOIN held h ON b.doc_id = h.doc_id AND b.page_index = h.page WHERE h.page IS NULL AND b.score >= 0.6")


@both
def mapping_status(d: Spark) -> str:
    return over(d, "SELECT l.doc_id, CASE WHEN count(CASE WHEN v.level = 'high' THEN 1 END) > 0 THEN 'auto_mapped_high' WHEN count(CASE WHEN v.level = 'medium' THEN 1 END) > 0 THEN 'needs_review' ELSE 'auto_mapping_failed' END AS status FROM (SELECT DISTINCT doc_id FROM leaves) l LEFT JOIN levels v ON l.doc_id = v.doc_id GROUP BY l.doc_id")


@both
def roman_labels(d: Spark) -> str:
    """Numerals of 1 to 4,000 and back."""
    n = "CAST(1 + l_orderkey % 4000 AS INT)"
    return f"SELECT n, label, {d.has('label', ROMAN)} AS canonical, {roman(d, 'label')} AS back FROM (SELECT n, {int_to_roman(d, 'n')} AS label FROM (SELECT DISTINCT {n} AS n FROM lineitem) k) x"


@both
def normalize_page_number(d: Spark) -> str:
    """Decorated and misread numbers to digits."""
    raw = f"concat(CASE item_id % 4 WHEN 0 THEN 'Page ' WHEN 1 THEN '- ' WHEN 2 THEN 'P.' ELSE '' END, replace(replace(CAST(item_id + 100 AS {d.text}), '0', 'O'), '1', 'l'), CASE item_id % 4 WHEN 1 THEN ' -' ELSE '' END)"
    core = f"lower(trim({d.every('raw', '^(Page |P[.]|[-] )|( [-])$')}))"
    digits = f"translate({core}, 'ilo|', '1101')"
    return f"SELECT item_id, raw, CASE WHEN length(raw) <= 18 AND {d.has(digits, '^[0-9]{1,5}$')} THEN {d.number(digits)} END AS number FROM (SELECT item_id, {raw} AS raw FROM benchmark) x"


@both
def page_display_rules(d: Spark) -> str:
    """What is shown for a page, and whether it may be cited, by a record's provenance."""
    return over(d, f"""SELECT doc_id, page_index, CASE WHEN kind = 0 THEN 'unverified' WHEN kind = 1 THEN concat('p. ', CAST(page_index + 1 AS {d.text})) WHEN kind = 2 THEN concat('candidate ', CAST(page_index + 1 AS {d.text})) WHEN kind = 3 THEN concat('label ', CAST(page_index + 1 AS {d.text})) ELSE concat('physical ', CAST(page_index + 1 AS {d.text})) END AS display, kind = 1 AS verified, CASE WHEN kind = 1 THEN CAST(page_index + 1 AS {d.text}) END AS citation_page
FROM (SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, CAST((doc_id + page_index) % 5 AS INT) AS kind FROM leaves) x""")


@both
def layout_decision(d: Spark) -> str:
    return over(d, ", weighed AS (SELECT doc_id, page_index, least(length(text), 1000) AS weight, CAST(CASE WHEN doc_id % 3 = 0 THEN 1.4 ELSE 0.7 END AS DOUBLE) AS aspect FROM leaves) SELECT doc_id, count(CASE WHEN weight >= 80 THEN 1 END) AS n_eligible, round(avg(CASE WHEN weight >= 80 THEN CASE WHEN aspect >= 1.05 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END), 6) AS landscape, round(median(aspect), 6) AS aspect, CASE WHEN count(CASE WHEN weight >= 80 AND aspect >= 1.05 THEN 1 END) >= 4 THEN 'spread' ELSE 'single' END AS layout FROM weighed GROUP BY doc_id")
