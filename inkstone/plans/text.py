"""Normalisation and extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import compact, invisible, norm, pdf, plain
from ..operators.grams import gram_counts
from ..registry import both, given, query
from ..sources import plains, views
from .dialect import DUCK, SPARK, Spark


def every_line(d: Spark, columns: str, where: str = "TRUE") -> str:
    return f"WITH {views(d)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, {columns} FROM lines WHERE {where}"


@both
def norm_invisible(d: Spark) -> str:
    soft = "replace(line, 'e', concat('e', '­'))"
    return every_line(d, f"{invisible(d, soft)} = line AS same, length({soft}) - length(line) AS n_soft")


@both
def norm_text(d: Spark) -> str:
    return every_line(d, f"{norm(d, 'line')} AS norm")


@both
def norm_compact(d: Spark) -> str:
    return every_line(d, f"{compact(d, norm(d, 'line'))} AS compact")


@both
def norm_plain(d: Spark) -> str:
    return every_line(d, f"{plain(d, norm(d, 'line'))} AS plain")


@both
def norm_pdf(d: Spark) -> str:
    return every_line(d, f"{pdf(d, 'replace(line, chr(44), chr(45))')} AS norm")


@both
def norm_forms(d: Spark) -> str:
    return f"WITH {views(d)} SELECT paragraph_id, source_type, length(norm) AS n_norm, length(compact) AS n_compact, length(plain) AS n_plain, eligible FROM paragraphs"


@query(f"WITH {views(DUCK)} SELECT gram, count(*) AS n FROM (SELECT plain FROM paragraphs WHERE eligible) p {DUCK.unnest(DUCK.grams('plain', 3), 'gram')} GROUP BY gram")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given(spark, sf_dir, "documents")
    return gram_counts(spark.sql(f"WITH {views(SPARK)} {plains()}"), 3, each=False)


@both
def sentence_split(d: Spark) -> str:
    marked = d.every("line", "([。！？!?；;.]['\"”’」』）)\\]]*)" if d.name == "spark" else "([。！？!?；;.]['\"”’」』）)\\]]*)", "$1|")
    pieces = f"split({marked}, '[|]')" if d.name == "spark" else f"string_split({marked}, '|')"
    return f"WITH {views(d)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, trim(sentence) AS sentence, count(*) AS n FROM (SELECT doc_id, pos, line FROM lines WHERE {d.find('line', chr(39) + '|' + chr(39))} = 0) l {d.unnest(pieces, 'sentence')} WHERE length(trim(sentence)) > 0 GROUP BY doc_id, pos, sentence"


@both
def trim_display(d: Spark) -> str:
    flat = f"trim({d.every('line', r'\s+', ' ')})"
    return every_line(d, f"CASE WHEN length({flat}) > 60 THEN concat(rtrim(substr({flat}, 1, 59)), '…') ELSE {flat} END AS shown")


@both
def cn_number(d: Spark) -> str:
    digits = "一二三四五六七八九"
    one = lambda n: f"substr('{digits}', {n}, 1)"
    n = "CAST(item_id % 50 + 1 AS INT)"
    tens, units = f"CAST(floor({n} / 10) AS INT)", f"({n} % 10)"
    name = f"concat(CASE WHEN {n} < 20 THEN '' ELSE {one(tens)} END, CASE WHEN {n} < 10 THEN '' ELSE '十' END, CASE WHEN {units} = 0 THEN '' ELSE {one(units)} END)"
    at = lambda x: d.find(f"'{digits}'", x)
    lead, tail = f"substr(name, 1, {d.find('name', chr(39) + '十' + chr(39))} - 1)", f"substr(name, {d.find('name', chr(39) + '十' + chr(39))} + 1)"
    back = f"CASE WHEN {d.find('name', chr(39) + '十' + chr(39))} = 0 THEN {at('name')} ELSE 10 * CASE WHEN {lead} = '' THEN 1 ELSE {at(lead)} END + CASE WHEN {tail} = '' THEN 0 ELSE {at(tail)} END END"
    return f"SELECT item_id, n, name, CAST({back} AS INT) AS parsed FROM (SELECT item_id, {n} AS n, {name} AS name FROM benchmark) x"


@both
def parse_int_label(d: Spark) -> str:
    return every_line(d, f"{d.number(d.part('line', '[0-9]+'))} AS label")


@both
def text_hashes(d: Spark) -> str:
    sha1 = "sha1(text)" if d.name == "spark" else "sha1(text)"
    return f"SELECT doc_id, {sha1} AS text_hash, substr({d.sha256('text')}, 1, 16) AS page_hash, {d.sha256('text')} AS file_hash FROM documents"


@both
def strip_bounds(d: Spark) -> str:
    padded = "concat(repeat(' ', CAST(doc_id % 4 AS INT)), line, '  ')"
    return every_line(d, f"length({padded}) - length(ltrim({padded})) AS first, length(rtrim({padded})) AS stop")


@both
def garbled_ratio(d: Spark) -> str:
    body = d.every("line", r"\s+")
    hard = d.every(body, "[^�\u0000-\u001f]") if d.name == "duck" else d.every(body, r"[^�\x00-\x1f]")
    soft = d.every(body, "[ -~一-鿿㐀-䶿“”‘’，。；：？！、（）《》…—�]")
    return every_line(d, f"CASE WHEN length({body}) = 0 THEN 1.0 ELSE round(least(1.0, (length({hard}) + 0.45 * length({soft})) / length({body})), 6) END AS ratio").replace("1.0 ", "CAST(1.0 AS DOUBLE) ").replace("0.45", "CAST(0.45 AS DOUBLE)")


@both
def highlight_html(d: Spark) -> str:
    def safe(x: str) -> str:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("chr(39)", "&#x27;")):
            x = f"replace({x}, {a if a.startswith('chr') else chr(39) + a + chr(39)}, '{b}')"
        return x

    return every_line(d, f"concat({safe('substr(line, 1, 10)')}, '<mark>', {safe('substr(line, 11, 20)')}, '</mark>', {safe('substr(line, 31)')}) AS html")


@both
def utf16_offset(d: Spark) -> str:
    odd = "replace(line, 'o', '😀')"
    return every_line(d, f"length({odd}) AS n_points, 2 * length({odd}) - length({d.every(odd, '😀')}) AS n_units")


@both
def cjk_language(d: Spark) -> str:
    return f"SELECT doc_id, CASE WHEN {d.has('title', '[㐀-鿿]')} THEN 'chinese' WHEN length(trim(title)) > 0 THEN 'foreign' WHEN {d.has('source', '[㐀-鿿]')} THEN 'chinese' ELSE 'foreign' END AS language FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN concat('论', substr(text, 1, 8)) WHEN 1 THEN substr(text, 1, 8) ELSE '' END AS title FROM documents) x"


@both
def page_build(d: Spark) -> str:
    return f"WITH {views(d)} SELECT paragraph_id, doc_id, page_start AS page_index, length(text_raw) AS n_chars, substr({d.sha256('text_raw')}, 1, 16) AS page_hash FROM paragraphs WHERE source_type = 'pdf' AND NOT is_cross"


@both
def cross_windows(d: Spark) -> str:
    return f"WITH {views(d)} SELECT paragraph_id, page_start, page_end, text_raw FROM paragraphs WHERE is_cross AND eligible"


@both
def span_map(d: Spark) -> str:
    """Spans of cross windows: which characters come from which page, half-open."""
    return f"""WITH {views(d)}, sized AS (SELECT doc_id, page_index, length(text) AS n, length(next_text) AS m FROM leaves WHERE doc_id % 2 = 0 AND next_text IS NOT NULL)
SELECT doc_id, page_index AS left_page, 0 AS left_start, least(n, 900) AS left_end, n - least(n, 900) AS left_page_start, n AS left_page_end, least(n, 900) + 1 AS right_start, least(n, 900) + 1 + least(m, 900) AS right_end, 0 AS right_page_start, least(m, 900) AS right_page_end FROM sized""".replace("page_index AS left_page", "CAST(page_index AS BIGINT) AS left_page")


@both
def eligibility_counts(d: Spark) -> str:
    return f"WITH {views(d)} SELECT source_type, count(*) AS n, count(CASE WHEN eligible THEN 1 END) AS n_eligible, count(CASE WHEN is_cross THEN 1 END) AS n_cross, max(page_end) AS last_page FROM paragraphs GROUP BY source_type"


@both
def page_anchors(d: Spark) -> str:
    return f"WITH {views(d)} SELECT doc_id, page_start AS page_index, min(paragraph_id) AS first_paragraph, max(paragraph_id) AS last_paragraph, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_start) AS ordinal FROM paragraphs WHERE source_type = 'pdf' GROUP BY doc_id, page_start"


@both
def index_entry_flag(d: Spark) -> str:
    return every_line(d, f"{d.has('line', 'ndex|索引|注释|插图|目录')} AS is_index")


@both
def title_candidate(d: Spark) -> str:
    return every_line(d, "length(line) <= 100 AND (pos = 0 OR (length(line) <= 80 AND pos % 7 = 0)) AS is_title")


@both
def pdf_type(d: Spark) -> str:
    return f"""WITH {views(d)}, sampled AS (SELECT doc_id, avg(length(text)) AS avg_chars, avg(length({d.every('text', '[a-zA-Z0-9 .,]')}) * 1.0 / greatest(length(text), 1)) AS garbled FROM leaves WHERE page_index < 12 GROUP BY doc_id)
SELECT doc_id, CASE WHEN avg_chars < 30 THEN 'scanned' WHEN garbled > 0.3 THEN 'broken_text' WHEN avg_chars < 120 THEN 'complex_layout' ELSE 'native_text' END AS pdf_type FROM sampled"""


@both
def page_segments(d: Spark) -> str:
    starts = "sequence(0, last, 20)" if d.name == "spark" else "range(0, last + 1, 20)"
    return f"WITH {views(d)}, sized AS (SELECT doc_id, CAST(max(page_index) AS INT) AS last FROM leaves GROUP BY doc_id) SELECT doc_id, CAST(first AS INT) AS first_page, CAST(least(first + 19, last) AS INT) AS last_page FROM sized {d.unnest(starts, 'first')}"


@both
def parse_page_range(d: Spark) -> str:
    label = f"CASE item_id % 3 WHEN 0 THEN concat(CAST(item_id AS {d.text}), '-', CAST(item_id + 9 AS {d.text})) WHEN 1 THEN CAST(item_id AS {d.text}) ELSE 'x' END"
    first = d.number(d.part("label", "^([0-9]+)", 1))
    return f"SELECT item_id, label, {first} AS first_page, coalesce({d.number(d.part('label', '-([0-9]+)$', 1))}, {first}) AS last_page FROM (SELECT item_id, {label} AS label FROM benchmark) x"


@both
def source_sort(d: Spark) -> str:
    n = d.number(d.part("source", "[0-9]+$"))
    return f"SELECT source, row_number() OVER (ORDER BY CASE WHEN volume < 10 THEN 0 ELSE 1 END, CASE WHEN volume < 10 THEN volume ELSE 0 END, lower(source)) AS place FROM (SELECT DISTINCT source, {n} AS volume FROM documents) x"


@both
def strip_header(d: Spark) -> str:
    """Length of a page without up to eight leading lines that are page numbers, numerals or short and in capitals."""
    head = d.every("concat(CASE WHEN doc_id % 3 = 0 THEN concat('12', chr(10), 'XIV', chr(10)) ELSE '' END, text)", "^(([0-9]{1,5}|[ivxlcdmIVXLCDM]+|[A-Z !.,]{1,40})\n){1,8}" if d.name == "duck" else r"^(([0-9]{1,5}|[ivxlcdmIVXLCDM]+|[A-Z !.,]{1,40})\n){1,8}")
    return f"WITH {views(d)} SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, length({head}) AS n_left FROM leaves"


@both
def toc_parse(d: Spark) -> str:
    entry = "concat(substr(line, 1, 20), ' ......... ', CAST(pos + 1 AS " + d.text + "))"
    return every_line(d, f"trim({d.part(entry, '^(.*?)[ .·…]{4,}([0-9]+)$', 1)}) AS title, {d.number(d.part(entry, '([0-9]+)$', 1))} AS page", "length(line) > 0")


@both
def docx_sections(d: Spark) -> str:
    """Running page numbers over section breaks: an explicit start resets, any other break adds one."""
    return f"""WITH {views(d)}, breaks AS (SELECT doc_id, pos, pos % 5 = 0 AS reset FROM lines), islands AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM breaks)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(island AS BIGINT) AS section, CAST(row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS BIGINT) AS page FROM islands"""


@both
def assign_work_by_page(d: Spark) -> str:
    """The last of the works whose range holds a page; ranges overlap by two pages. Ranges become pages, so the join is an equality."""
    spread = "explode(sequence(first, first + 11))" if d.name == "spark" else "unnest(range(first, first + 12))"
    return f"""WITH {views(d)}, works AS (SELECT DISTINCT doc_id, CAST(10 * floor(page_index / 10) AS INT) AS first FROM leaves), held AS (SELECT doc_id, first, {spread} AS page FROM works)
SELECT l.doc_id, CAST(l.page_index AS BIGINT) AS page_index, concat('w-', CAST(max(first) AS {d.text})) AS work_id FROM leaves l LEFT JOIN held h ON l.doc_id = h.doc_id AND l.page_index = h.page GROUP BY l.doc_id, l.page_index"""


@both
def assign_work_by_title(d: Spark) -> str:
    """The latest title so far, carried forward."""
    nulls = "last(CASE WHEN length(line) <= 40 THEN line END, true) OVER w" if d.name == "spark" else "last_value(CASE WHEN length(line) <= 40 THEN line END IGNORE NULLS) OVER w"
    return f"WITH {views(d)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, {nulls} AS work FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@both
def doc_body_select(d: Spark) -> str:
    return f"WITH {views(d)}, marked AS (SELECT doc_id, min(CASE WHEN length(line) > 60 THEN pos END) AS body FROM lines GROUP BY doc_id) SELECT l.doc_id, count(*) AS n_lines, CAST(min(l.pos) AS BIGINT) AS first FROM lines l JOIN marked m ON l.doc_id = m.doc_id AND l.pos >= m.body GROUP BY l.doc_id"


@both
def html_text(d: Spark) -> str:
    body = d.every(d.every("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    text = f"trim({d.every(body, r'\s+', ' ')})"
    return f"SELECT page_id, {d.part('html', '<title>([^<]*)</title>', 1)} AS title, length({text}) AS n_chars, sha1({text}) AS text_hash FROM pages"


@both
def html_links(d: Spark) -> str:
    found = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
    return f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, html FROM pages) p {d.unnest(found, 'href')} GROUP BY page_id, href"
