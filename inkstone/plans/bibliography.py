"""Bibliography: identifiers, required fields, votes, citation styles, catalogue matching."""

from __future__ import annotations

from ..registry import both
from .dialect import Spark


def records(d: Spark) -> str:
    """Bibliographic records made from the order tables, some with fields missing."""
    t = d.text
    return f"""records AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'journal_article' WHEN 2 THEN 'thesis' ELSE 'translated_book' END AS kind,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('Author ', CAST(o_custkey AS {t})) END AS author, concat('Title ', CAST(o_orderkey AS {t})) AS title,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Press ', CAST(o_custkey % 50 AS {t})) END AS publisher, CASE WHEN o_orderkey % 3 = 0 THEN 'Berlin' ELSE '' END AS place,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(1900 + o_orderkey % 120 AS {t}) END AS year, concat('Journal ', CAST(o_custkey % 20 AS {t})) AS journal,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(1 + o_orderkey % 12 AS {t}) END AS issue, CAST(1 + o_orderkey % 40 AS {t}) AS volume, CASE WHEN o_orderkey % 2 = 0 THEN concat('Translator ', CAST(o_orderkey % 9 AS {t})) ELSE '' END AS translator,
    CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(1 + o_orderkey % 300 AS {t}) END AS page FROM orders)"""


def joined(parts: list[str], by: str) -> str:
    """Parts that are not empty, put together; each is an expression that may be ''."""
    return f"concat_ws('{by}', {', '.join(f'nullif({p}, ' + chr(39) * 2 + ')' for p in parts)})"


def _missing(style: str) -> list[tuple[str, str]]:
    book, journal = "kind IN ('book', 'translated_book')", "kind = 'journal_article'"
    out = [("author", "author = ''"), ("title", "title = ''"), ("publisher", f"kind <> 'journal_article' AND publisher = ''"), ("year", "year = ''")]
    if style == "gb":
        out.append(("place", f"{book} AND place = ''"))
    out.append(("translator", "kind = 'translated_book' AND translator = ''"))
    if style in ("gb", "chinese"):
        out.append(("issue", f"{journal} AND issue = ''"))
    if style not in ("apa", "mla"):
        out.append(("page", "kind <> 'thesis' AND page = ''"))
    return out


def _status(style: str):
    def text(d: Spark) -> str:
        fields = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _missing(style))
        return f"WITH {records(d)} SELECT id, missing, CASE WHEN missing = '' THEN 'complete' ELSE 'metadata_incomplete' END AS status FROM (SELECT id, concat_ws(',', {fields}) AS missing FROM records) x"

    text.__name__ = f"cite_status_{style}"
    return both(text)


for _style in ("chinese", "gb", "chicago", "apa", "mla"):
    _status(_style)


@both
def cite_gb(d: Spark) -> str:
    mark = "CASE kind WHEN 'journal_article' THEN '[J]' WHEN 'thesis' THEN '[D]' ELSE '[M]' END"
    journal = joined(["journal", "year", "concat(volume, CASE WHEN issue = '' THEN '' ELSE concat('(', issue, ')') END)"], ", ")
    pages = "CASE WHEN page = '' THEN '' ELSE concat(': ', page) END"
    book = joined([joined(["place", "publisher"], ": "), "year"], ", ")
    return f"WITH {records(d)} SELECT id, concat({joined(['author', f'concat(title, {mark})', f'concat(CASE WHEN kind = {chr(39)}journal_article{chr(39)} THEN {journal} ELSE {book} END, {pages})'], '. ')}, '.') AS citation FROM records"


@both
def cite_chinese(d: Spark) -> str:
    title = "concat('《', title, '》')"
    tail = "CASE WHEN page = '' THEN '' ELSE concat('第', page, '页') END"
    source = f"CASE WHEN kind = 'journal_article' THEN concat('《', journal, '》', year, '年', CASE WHEN issue = '' THEN '' ELSE concat('第', issue, '期') END) ELSE concat(publisher, CASE WHEN year = '' THEN '' ELSE concat(year, '年版') END) END"
    translator = "CASE WHEN kind = 'translated_book' AND translator <> '' THEN concat(translator, '译') ELSE '' END"
    return f"WITH {records(d)} SELECT id, concat(CASE WHEN author = '' THEN '' ELSE concat(author, '：') END, {joined([title, translator, source, tail], '，')}, '。') AS citation FROM records"


@both
def cite_chicago(d: Spark) -> str:
    book = f"concat('(', {joined([joined(['place', 'publisher'], ': '), 'year'], ', ')}, ')')"
    source = f"CASE WHEN kind = 'journal_article' THEN concat(journal, ' ', volume, CASE WHEN issue = '' THEN '' ELSE concat(', no. ', issue) END, ' (', year, ')') ELSE {book} END"
    return f"WITH {records(d)} SELECT id, concat({joined(['author', 'title', source, 'page'], ', ')}, '.') AS citation FROM records"


@both
def cite_apa(d: Spark) -> str:
    source = "CASE WHEN kind = 'journal_article' THEN concat(journal, ', ', volume, CASE WHEN issue = '' THEN '' ELSE concat('(', issue, ')') END) ELSE publisher END"
    return f"WITH {records(d)} SELECT id, concat({joined(['author', 'CASE WHEN year = ' + chr(39) * 2 + ' THEN ' + chr(39) + '(n.d.)' + chr(39) + ' ELSE concat(' + chr(39) + '(' + chr(39) + ', year, ' + chr(39) + ')' + chr(39) + ') END'], ' ')}, '. ', {joined(['title', source], '. ')}, '.') AS citation FROM records"


@both
def cite_mla(d: Spark) -> str:
    source = "CASE WHEN kind = 'journal_article' THEN concat(journal, ', vol. ', volume, CASE WHEN issue = '' THEN '' ELSE concat(', no. ', issue) END) ELSE publisher END"
    return f"WITH {records(d)} SELECT id, concat({joined(['author', 'title', joined([source, 'year'], ', ')], '. ')}, '.') AS citation FROM records"


@both
def cite_doc_type(d: Spark) -> str:
    return f"WITH {records(d)} SELECT id, CASE WHEN kind = 'journal_article' OR (issue <> '' AND publisher = '') THEN 'journal_article' WHEN kind = 'translated_book' AND translator <> '' THEN 'translated_book' WHEN kind = 'thesis' THEN 'thesis' ELSE 'book' END AS document_type FROM records"


@both
def cite_range(d: Spark) -> str:
    """Ranges of consecutive page labels on neighbouring positions, of a thousand items at most each."""
    return "WITH steps AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS page, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before, lag(l_partkey % 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS last FROM lineitem) SELECT l_orderkey AS doc_id, count(*) AS n, min(CASE WHEN before IS NULL OR (l_linenumber - before = 1 AND page - last IN (0, 1)) THEN 1 ELSE 0 END) = 1 AND count(*) <= 1000 AS continuous, min(page) AS first_page, max(page) AS last_page FROM steps GROUP BY l_orderkey"


@both
def biblio_missing(d: Spark) -> str:
    return f"WITH {records(d)} SELECT kind, count(CASE WHEN author = '' THEN 1 END) AS no_author, count(CASE WHEN publisher = '' THEN 1 END) AS no_publisher, count(CASE WHEN year = '' THEN 1 END) AS no_year, count(*) AS n FROM records GROUP BY kind"


@both
def biblio_valid(d: Spark) -> str:
    odd = f"length({d.every('value', '[^?？]')})"
    return f"WITH values_ AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '???a' WHEN 2 THEN concat('x', '�') WHEN 3 THEN '--' ELSE substr(text, 1, 20) END AS value FROM benchmark) SELECT item_id, value, NOT (lower(value) IN ('unknown', 'untitled', 'n/a') OR {d.has('value', '�')} OR ({odd} >= 2 AND {odd} * 1.0 / length(value) >= 0.3) OR NOT {d.has('value', '[A-Za-z0-9㐀-鿿]')}) AS valid FROM values_"


@both
def vote_value(d: Spark) -> str:
    """Per field the value with the best score: highest confidence plus 0.015 a further vote, 0.04 at most; a close second is a conflict."""
    return """WITH candidates AS (SELECT l_orderkey AS doc_id, l_returnflag AS field, l_linestatus AS value, CAST(0.6 AS DOUBLE) + CAST(l_quantity AS DOUBLE) / 200 AS confidence, l_linenumber AS page FROM lineitem),
votes AS (SELECT doc_id, field, value, round(max(confidence) + least(CAST(0.04 AS DOUBLE), CAST(0.015 AS DOUBLE) * (count(*) - 1)), 6) AS score, count(*) AS n, min(page) AS page FROM candidates GROUP BY doc_id, field, value),
placed AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM votes WINDOW w AS (PARTITION BY doc_id, field ORDER BY score DESC, n DESC, page, value))
SELECT doc_id, field, value, score, n AS support, coalesce(score - second < CAST(0.015 AS DOUBLE), FALSE) AS conflict FROM placed WHERE place = 1"""


@both
def confidence_mean(d: Spark) -> str:
    return "SELECT l_orderkey AS doc_id, round(CAST(0.600000001 AS DOUBLE) + sum(CAST(l_quantity AS INT)) / CAST(count(*) AS DOUBLE) / 200, 4) AS confidence FROM lineitem GROUP BY l_orderkey"


@both
def latest_edition(d: Spark) -> str:
    return "SELECT o_custkey AS work, edition, year FROM (SELECT o_custkey, o_orderkey % 5 AS edition, 1950 + o_orderkey % 70 AS year, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, 1950 + o_orderkey % 70 DESC) AS place FROM orders) x WHERE place = 1"


@both
def merge_missing_fields(d: Spark) -> str:
    """The first record of a work wins; later ones fill what it lacks."""
    first = (lambda c: f"first(nullif({c}, ''), true) OVER w") if d.name == "spark" else (lambda c: f"first_value(nullif({c}, '') IGNORE NULLS) OVER w")
    return f"WITH {records(d)}, filled AS (SELECT author, id, {first('publisher')} AS publisher, {first('place')} AS place, {first('year')} AS year, count(*) OVER w AS n, row_number() OVER (PARTITION BY author ORDER BY id) AS ordinal FROM records WHERE author <> '' WINDOW w AS (PARTITION BY author ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT author, id, publisher, place, year, n FROM filled WHERE ordinal = 1"


@both
def doi_issn(d: Spark) -> str:
    """Identifiers in their usual form, and whether the serial number's check digit is right."""
    t = d.text
    issn = f"concat(lpad(CAST(o_orderkey * 7 % 10000 AS {t}), 4, '0'), lpad(CAST(o_orderkey * 13 % 1000 AS {t}), 3, '0'), CASE WHEN o_orderkey % 11 = 10 THEN 'X' ELSE CAST(o_orderkey % 11 AS {t}) END)"
    total = " + ".join(f"{8 - i} * CAST(substr(issn, {i + 1}, 1) AS INT)" for i in range(7))
    check = "(11 - total % 11) % 11"
    doi = f"concat('https://doi.org/10.', CAST(1000 + o_orderkey % 9000 AS {t}), '/ABC.', CAST(o_orderkey AS {t}), '.')"
    clean = d.every(f"lower({d.every('doi', '^https?://(dx[.])?doi[.]org/')})", "[.,;]+$")
    return f"SELECT id, {clean} AS doi, concat(substr(issn, 1, 4), '-', substr(issn, 5)) AS issn, CASE WHEN {check} = 10 THEN 'X' ELSE CAST({check} AS {t}) END = substr(issn, 8, 1) AS issn_valid, {d.every('isbn', '[^0-9X]')} AS isbn FROM (SELECT id, doi, issn, isbn, {total} AS total FROM (SELECT o_orderkey AS id, {doi} AS doi, {issn} AS issn, concat('978-3-', CAST(o_orderkey AS {t}), '-0') AS isbn FROM orders) x) y"


@both
def biblio_filename(d: Spark) -> str:
    name = f"concat(author, ' - ', title, ' (', year, ').pdf')"
    return f"WITH {records(d)} SELECT id, {d.part('name', '^(.*?) - ', 1)} AS author, {d.part('name', ' - (.*?) [(]', 1)} AS title, {d.part('name', '[(]([0-9]{4})[)]', 1)} AS year FROM (SELECT id, {name} AS name FROM records) x"


@both
def parse_citation(d: Spark) -> str:
    text = "concat(author, '. ', title, '[J]. ', journal, ',', year, ',', volume, '(', issue, '):', page, '.')"
    return f"WITH {records(d)} SELECT id, {d.part('c', '^(.*?)[.] ', 1)} AS author, {d.part('c', '[.] (.*?)[^A-Za-z0-9 ]J', 1)} AS title, {d.part('c', ',([0-9]{4}),', 1)} AS year, {d.part('c', '[(]([0-9]*)[)]:', 1)} AS issue, {d.part('c', ':([0-9-]+)[.]$', 1)} AS pages FROM (SELECT id, {text} AS c FROM records WHERE kind = 'journal_article') x"


@both
def match_catalogue(d: Spark) -> str:
    """Catalogue records of the same block (author) scored by title, author and year; the best five of each."""
    return f"WITH {records(d)}, pairs AS (SELECT a.id, b.id AS other, CASE WHEN lower(a.title) = lower(b.title) THEN CAST(0.75 AS DOUBLE) WHEN substr(a.title, 1, 8) = substr(b.title, 1, 8) THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END + CAST(0.2 AS DOUBLE) + CASE WHEN a.year = b.year THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score FROM records a JOIN records b ON a.author = b.author AND a.id <> b.id WHERE a.author <> '') SELECT id, other, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM pairs) r WHERE place <= 5"


@both
def lookup_fallback(d: Spark) -> str:
    return f"WITH {records(d)} SELECT id, coalesce(nullif(publisher, ''), nullif(place, ''), journal) AS found, CASE WHEN publisher <> '' THEN 'first' WHEN place <> '' THEN 'second' ELSE 'third' END AS by_source FROM records"


@both
def front_matter(d: Spark) -> str:
    """The first twenty and last eight pages of each source."""
    from ..sources import views

    return f"WITH {views(d)}, sized AS (SELECT doc_id, page_index, max(page_index) OVER (PARTITION BY doc_id) AS last FROM leaves) SELECT doc_id, CAST(page_index AS BIGINT) AS page_index FROM sized WHERE page_index < 20 OR page_index > last - 8"
