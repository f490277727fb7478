"""The corpus as views over the given tables: lines, pages, cross-page windows, paragraphs.

Documents with an even number are paged sources: three lines make a page, a page makes a paragraph, and the ends of
neighbouring pages make a cross window. The others are word sources, of which each line is a paragraph. Pages and windows are cut
inside the document's row, so none of it takes a shuffle.
"""

from __future__ import annotations

from ..functions import compact, norm, plain, plain_at_once
from ..plans.dialect import SPARK, Spark


def views(d: Spark) -> str:
    """Common table expressions, to be put before a query's SELECT."""
    n = d.newline
    if d.name == "spark":
        lines = f"SELECT doc_id, source, lang, pos, line FROM documents LATERAL VIEW posexplode(split(text, {n})) AS pos, line"
        pages = f"""SELECT doc_id, source, lang, page_index, text, next_text FROM (
            SELECT doc_id, source, lang, transform(sequence(0, (size(a) - 1) DIV 3), i -> array_join(slice(a, i * 3 + 1, 3), {n})) AS p FROM (SELECT *, split(text, {n}) AS a FROM documents WHERE text IS NOT NULL)
        ) LATERAL VIEW inline(transform(p, (x, i) -> struct(i AS page_index, x AS text, try_element_at(p, i + 2) AS next_text))) AS page_index, text, next_text"""
    else:
        lines = f"SELECT doc_id, source, lang, generate_subscripts(string_split(text, {n}), 1) - 1 AS pos, unnest(string_split(text, {n})) AS line FROM documents"
        pages = f"""SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY page_index) AS next_text FROM (
            SELECT doc_id, source, lang, pos // 3 AS page_index, string_agg(line, {n} ORDER BY pos) AS text FROM lines GROUP BY doc_id, source, lang, pos // 3)"""
    pid = lambda kind, i: f"concat('doc-', CAST(doc_id AS {d.text}), '-{kind}', lpad(CAST({i} AS {d.text}), 6, '0'))"
    return f"""lines AS ({lines}),
leaves AS ({pages}),
raw AS (
    SELECT doc_id, source, lang, {pid('P', '2 * page_index')} AS paragraph_id, 'pdf' AS source_type, CAST(2 * page_index AS INT) AS paragraph_index, CAST(page_index AS INT) AS page_start, CAST(page_index AS INT) AS page_end, text AS text_raw FROM leaves WHERE doc_id % 2 = 0 AND length(trim(text)) > 0
    UNION ALL
    SELECT doc_id, source, lang, {pid('CROSS-', 'page_index')}, 'pdf', CAST(2 * page_index + 1 AS INT), CAST(page_index AS INT), CAST(page_index + 1 AS INT), concat(right(text, 900), {n}, left(next_text, 900)) FROM leaves WHERE doc_id % 2 = 0 AND next_text IS NOT NULL AND length(trim(text)) > 0 AND length(trim(next_text)) > 0
    UNION ALL
    SELECT doc_id, source, lang, {pid('P', 'pos')}, 'word', CAST(pos AS INT), CAST(NULL AS INT), CAST(NULL AS INT), line FROM lines WHERE doc_id % 2 = 1
),
forms AS (SELECT *, {norm(d, 'text_raw')} AS norm FROM raw),
paragraphs AS (
    SELECT *, {compact(d, 'norm')} AS compact, {plain(d, 'norm')} AS plain, page_start <> page_end AS is_cross,
        CASE WHEN source_type = 'pdf' THEN length({plain(d, 'norm')}) >= CASE WHEN page_start <> page_end THEN 80 ELSE 20 END ELSE length(norm) > 0 END AS eligible FROM forms
)"""


def plains() -> str:
    """Spark's text for (doc_id, paragraph_id, plain, least) of all paragraphs: one is eligible where plain has `least` characters or more.

    Filters aren't part of the text, since Spark would repeat plain in them. A line without characters at all has no plain.
    """
    d, bare = SPARK, "coalesce(source_type = 'word' AND length(plain) = 0 AND length(" + norm(SPARK, "text_raw") + ") = 0, FALSE)"
    return f"SELECT doc_id, paragraph_id, CASE WHEN {bare} THEN NULL ELSE plain END AS plain, CASE WHEN source_type = 'word' THEN 0 WHEN page_start <> page_end THEN 80 ELSE 20 END AS least FROM (SELECT *, {plain_at_once(d, 'text_raw')} AS plain FROM raw) x"
