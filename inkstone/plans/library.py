"""Library, reader, job log and index maintenance."""

from __future__ import annotations

from ..registry import both
from ..sources import views
from .dialect import Spark


@both
def works_volumes(d: Spark) -> str:
    return f"WITH works AS (SELECT concat('w-', CAST(doc_id AS {d.text})) AS work_id, source AS volume_id, n_chars FROM documents), volumes AS (SELECT source AS volume_id, count(*) AS n_works, sum(n_chars) AS n_chars FROM documents GROUP BY source) SELECT w.work_id, w.volume_id, v.n_works, CAST(v.n_chars AS BIGINT) AS n_chars FROM works w JOIN volumes v ON w.volume_id = v.volume_id"


@both
def citation_meta(d: Spark) -> str:
    """Paragraph to work to volume to source: the nearest value that isn't empty wins."""
    return f"WITH {views(d)} SELECT p.paragraph_id, coalesce(CASE WHEN l.quality = 1 THEN 'work' END, CASE WHEN length(doc.source) > 4 THEN 'volume' END, 'source') AS author_from, l.quality FROM paragraphs p JOIN documents doc ON p.doc_id = doc.doc_id LEFT JOIN labels l ON p.doc_id = l.doc_id WHERE p.eligible"


@both
def library_build(d: Spark) -> str:
    return f"WITH {views(d)}, pages_ AS (SELECT doc_id, count(*) AS n_pages FROM leaves GROUP BY doc_id) SELECT doc.doc_id, doc.source, p.n_pages, l.quality, CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'calibrated' WHEN l.quality = 0 THEN 'review' ELSE 'pending' END AS status_group FROM documents doc LEFT JOIN pages_ p ON doc.doc_id = p.doc_id LEFT JOIN labels l ON doc.doc_id = l.doc_id"


@both
def library_stats(d: Spark) -> str:
    return "SELECT CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'calibrated' WHEN l.quality = 0 THEN 'review' ELSE 'pending' END AS status_group, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"


@both
def library_filter(d: Spark) -> str:
    return "SELECT doc_id, source, lang FROM documents WHERE lang = 'de' AND contains(lower(concat(source, lang, substr(text, 1, 200))), 'ein')"


@both
def library_sort(d: Spark) -> str:
    return "SELECT doc_id, CAST(row_number() OVER (ORDER BY nullif(lang, 'en') ASC NULLS LAST, source, doc_id) AS BIGINT) AS place FROM documents"


@both
def batch_metadata(d: Spark) -> str:
    return "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 2 = 0 AND (l.quality IS NULL OR d.n_chars > 3000)"


@both
def reader_window(d: Spark) -> str:
    """The window of 100 rows of each source that starts at position 50, and where the next one starts."""
    return f"WITH {views(d)}, placed AS (SELECT doc_id, paragraph_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS position, count(*) OVER (PARTITION BY doc_id) AS total FROM paragraphs) SELECT doc_id, paragraph_id, CAST(position AS BIGINT) AS position, CASE WHEN total >= 150 THEN 150 END AS next_start FROM placed WHERE position >= 50 AND position < 150"


@both
def reader_prev_cursor(d: Spark) -> str:
    return f"WITH {views(d)} SELECT doc_id, CAST(greatest(0, max(paragraph_index) - 100) AS BIGINT) AS previous_start FROM paragraphs GROUP BY doc_id"


@both
def page_start(d: Spark) -> str:
    return f"WITH {views(d)}, marked AS (SELECT doc_id, paragraph_id, page_start, lag(page_start) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS before FROM paragraphs WHERE source_type = 'pdf') SELECT doc_id, paragraph_id FROM marked WHERE before IS NULL OR before <> page_start"


@both
def anchor_position(d: Spark) -> str:
    return f"WITH {views(d)} SELECT paragraph_id, {d.number(d.part('paragraph_id', '([0-9]+)$', 1))} AS hint, count(*) OVER (PARTITION BY paragraph_id) = 1 AS is_unique FROM paragraphs"


@both
def continuity(d: Spark) -> str:
    return f"WITH {views(d)}, steps AS (SELECT doc_id, page_index, page_index - lag(page_index) OVER (PARTITION BY doc_id ORDER BY page_index) AS step FROM leaves) SELECT doc_id, min(CASE WHEN step IS NULL OR step IN (0, 1) THEN 1 ELSE 0 END) = 1 AS continuous, count(*) AS n FROM steps GROUP BY doc_id"


@both
def delete_sources(d: Spark) -> str:
    """What is left of the paragraphs when every tenth source goes."""
    return f"WITH {views(d)}, gone AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 0) SELECT source_type, count(*) AS n FROM paragraphs p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id) GROUP BY source_type"


@both
def replace_source(d: Spark) -> str:
    """The index with one source replaced by a new text: only its rows change."""
    return f"WITH {views(d)}, kept AS (SELECT doc_id, paragraph_id, length(text_raw) AS n FROM paragraphs WHERE doc_id <> 7), new_rows AS (SELECT CAST(7 AS BIGINT) AS doc_id, concat('doc-7-P', lpad(CAST(pos AS {d.text}), 6, '0')) AS paragraph_id, length(line) AS n FROM lines WHERE doc_id = 9) SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(n) AS BIGINT) AS n_chars FROM (SELECT * FROM kept UNION ALL SELECT * FROM new_rows) x GROUP BY doc_id"


@both
def index_counts(d: Spark) -> str:
    return f"WITH {views(d)} SELECT count(DISTINCT doc_id) AS n_sources, count(*) AS n_paragraphs, count(CASE WHEN eligible THEN 1 END) AS n_eligible FROM paragraphs"


@both
def union_sources(d: Spark) -> str:
    return f"WITH {views(d)} SELECT doc_id, 'line' AS kind, count(*) AS n FROM lines WHERE doc_id % 2 = 1 GROUP BY doc_id UNION ALL SELECT doc_id, 'page', count(*) FROM leaves WHERE doc_id % 2 = 0 GROUP BY doc_id"


@both
def set_difference(d: Spark) -> str:
    return "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"


@both
def distinct_ids(d: Spark) -> str:
    return "SELECT source, lang, count(*) AS n FROM (SELECT DISTINCT source, lang, n_chars FROM documents) x GROUP BY source, lang"


@both
def duplicate_files(d: Spark) -> str:
    """Sources with equal content: the first is kept."""
    return f"SELECT file_hash, min(doc_id) AS kept, count(*) AS n FROM (SELECT doc_id, {d.sha256('text')} AS file_hash FROM documents) x GROUP BY file_hash HAVING count(*) > 1"


@both
def imported_files(d: Spark) -> str:
    return "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.n_chars % 2 = 0 THEN 'imported' ELSE 'name_conflict' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@both
def latest_run(d: Spark) -> str:
    return "SELECT user_id AS source, event_id AS run, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) x WHERE place = 1"


@both
def job_journal(d: Spark) -> str:
    """Jobs' last states; those that were running when the log ends come back paused, or failed after an error."""
    return "WITH last AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events), errors AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT l.user_id AS job_id, CASE WHEN l.event_type = 'purchase' THEN 'completed' WHEN coalesce(e.n, 0) > 0 THEN 'failed' ELSE 'paused' END AS status FROM last l LEFT JOIN errors e ON l.user_id = e.user_id WHERE place = 1"


@both
def job_progress(d: Spark) -> str:
    return "SELECT job_id, n_done, n_failed, CASE WHEN n_done >= 20 THEN 'completed' WHEN n_failed > 0 THEN 'failed' WHEN n_done > 0 THEN 'processing' ELSE 'pending' END AS status FROM (SELECT user_id AS job_id, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_id % 20 END) AS n_done, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id % 20 END) AS n_failed FROM events GROUP BY user_id) x"


@both
def job_resume(d: Spark) -> str:
    return "SELECT a.event_id, min(b.event_id) AS resumes FROM events a JOIN events b ON a.user_id = b.user_id AND a.props = b.props AND a.event_type = b.event_type AND a.event_id < b.event_id GROUP BY a.event_id"


@both
def best_parser(d: Spark) -> str:
    return "SELECT user_id AS source, event_id AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END DESC, value DESC, event_id) AS place FROM events) x WHERE place = 1"


@both
def overall_method(d: Spark) -> str:
    return "SELECT user_id AS source, CASE WHEN count(DISTINCT event_type) = 1 THEN max(event_type) ELSE 'combined_sequence' END AS method FROM events GROUP BY user_id"


@both
def failure_reasons(d: Spark) -> str:
    return "SELECT user_id AS source, concat_ws(',', CASE WHEN count(CASE WHEN event_type = 'click' THEN 1 END) = 0 THEN 'no_labels' END, CASE WHEN count(CASE WHEN event_type = 'view' THEN 1 END) = 0 THEN 'no_numbers' END, CASE WHEN max(value) < 50 THEN 'weak_evidence' END) AS reasons FROM events GROUP BY user_id"


@both
def import_settings(d: Spark) -> str:
    key = "try_cast(get_json_object(props, '$.k') AS INT)" if d.name == "spark" else "TRY_CAST(json_extract_string(props, '$.k') AS INT)"
    return f"SELECT {key} AS k, count(*) AS n FROM events WHERE {key} % 2 = 0 GROUP BY {key}"
