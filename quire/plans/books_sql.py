"""DuckDB SQL for the queries of quire.plans.books, written from the rules and apart from the Spark code."""

from __future__ import annotations

from quire.plans.oracle import _BLOCKS, _ITEMS, _LITE, _MARKED, _PLAIN, _big, _collapse, _grouped, _lines, _paragraphs, _split, _tokens, _translatable, _trim

_VOLUMES = f"""
        {_BLOCKS},
        vols AS (SELECT book || '/' || CAST(d // 500 AS VARCHAR) AS book, d, b, text FROM blocks),
        chapters AS (SELECT book, d, row_number() OVER (PARTITION BY book ORDER BY d) AS k FROM (SELECT DISTINCT book, d FROM vols))"""

_ITEM_VOLUMES = """
        vols AS (SELECT 'items-' || CAST(item_id // 25 AS VARCHAR) AS book, item_id % 25 AS i, text FROM benchmark),
        kept AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY i) - 1 AS d FROM vols WHERE i % 7 <> 6)"""

_DOC_VOLUMES = "vols AS (SELECT concat_ws('/', source, lang, CAST(doc_id // 500 AS VARCHAR)) AS book, doc_id AS d, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source, lang, doc_id // 500 ORDER BY doc_id) - 1 AS page FROM documents)"

_TURN_ITEMS = f"""
        turns AS (SELECT conv_id, turn, role, {_collapse("text")} AS text FROM conversations),
        eligible AS (SELECT * FROM turns WHERE {_translatable("text")}),
        sized AS (SELECT *, {_big("length(text)")} AS chars, {_big(_tokens("text"))} AS tokens FROM eligible),
        {_grouped("sized", "conv_id", "turn", "tokens", _LITE, 100)}"""

_DAY = "(CAST(floor(epoch(ts)) AS BIGINT) + 57600) // 86400"


def _quoted(x: str) -> str:
    """A name with all bytes but letters, digits and / - . _ ~ as escapes."""
    return f"replace(url_encode({x}), '%2F', '/')"


_KNOWN_TAGS = ["p", "h1", "li", "blockquote", "td", "figcaption", "dd"]

#: Tokens of a page, and a fold over them: open elements with the number of the block each is (or -1).
_HTML_TOKEN = r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<[^>]*>|[^<]+"
_BLOCK_TAGS = "['p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li', 'blockquote', 'td', 'th', 'dd', 'dt', 'figcaption']"
_VOID_TAGS = "['area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr']"
_NAME = "lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1))"
_IS_TEXT = "(NOT starts_with(t, '<'))"
_IS_RAW = "(regexp_matches(t, '^(<!|<script|<style|<title)'))"
_IS_END = "(starts_with(t, '</'))"
_IS_START = f"(NOT {_IS_TEXT} AND NOT {_IS_RAW} AND NOT {_IS_END} AND NOT list_contains({_VOID_TAGS}, {_NAME}))"
_IS_BLOCK = f"({_IS_START} AND list_contains({_BLOCK_TAGS}, {_NAME}))"
_UP_TO = f"(len(acc.tags) - coalesce(list_position(list_reverse(acc.tags), {_NAME}), 0))"
_CLOSES = f"({_IS_END} AND list_contains(acc.tags, {_NAME}))"
_Q03 = f"""
        WITH tokens AS (SELECT page_id AS d, list_prepend('', regexp_extract_all(html, '{_HTML_TOKEN}')) AS ts FROM pages),
        folded AS (SELECT d, list_reduce(list_transform(ts, lambda t: {{'t': t, 'tags': CAST([] AS VARCHAR[]), 'nums': CAST([] AS BIGINT[]), 'n': CAST(0 AS BIGINT), 'starts': CAST([] AS VARCHAR[]), 'said': CAST([] AS STRUCT(b BIGINT, x VARCHAR)[])}}), lambda acc, y: list_transform([y.t], lambda t: {{
            't': '',
            'tags': CASE WHEN {_IS_START} THEN list_append(acc.tags, {_NAME}) WHEN {_CLOSES} THEN acc.tags[:{_UP_TO}] ELSE acc.tags END,
            'nums': CASE WHEN {_IS_START} THEN list_append(acc.nums, CASE WHEN {_IS_BLOCK} THEN acc.n ELSE -1 END) WHEN {_CLOSES} THEN acc.nums[:{_UP_TO}] ELSE acc.nums END,
            'n': acc.n + CASE WHEN {_IS_BLOCK} THEN 1 ELSE 0 END,
            'starts': CASE WHEN {_IS_BLOCK} THEN list_append(acc.starts, {_NAME}) ELSE acc.starts END,
            'said': CASE WHEN {_IS_TEXT} AND t <> '' AND len(list_filter(acc.nums, lambda k: k >= 0)) > 0 THEN list_append(acc.said, {{'b': list_filter(acc.nums, lambda k: k >= 0)[-1], 'x': t}}) ELSE acc.said END
        }})[1]) AS s FROM tokens),
        blocks AS (SELECT d, unnest(range(len(s.starts))) AS b, unnest(s.starts) AS tag FROM folded),
        said AS (SELECT d, unnest(s.said, recursive := true), unnest(range(len(s.said))) AS k FROM folded),
        texts AS (SELECT d, b, string_agg(x, '' ORDER BY k) AS raw FROM said GROUP BY d, b),
        plain AS (SELECT d, b, tag, {_collapse("replace(replace(replace(replace(replace(replace(coalesce(raw, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')")} AS text FROM blocks LEFT JOIN texts USING (d, b))
        SELECT d, b, tag, text, NOT {_translatable("text")} AS skipped FROM plain"""

SQL: dict[str, str] = {
    "q03_html_blocks": _Q03,
    "q30_file_sniff": """
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 0 ELSE 2 END AS head FROM documents),
        sized AS (SELECT doc_id, head + CASE WHEN doc_id % 3 > 0 THEN strlen(text) ELSE 0 END AS bytes, CASE WHEN doc_id % 3 > 0 THEN text ELSE '' END AS body FROM docs)
        SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CASE
            WHEN bytes > 4 AND doc_id % 5 = 0 THEN 'epub' WHEN doc_id % 5 = 1 THEN 'pdf'
            WHEN doc_id % 5 = 4 AND starts_with(body, 'F-') THEN 'pdf' WHEN doc_id % 5 = 3 AND starts_with(body, '%PDF-') AND bytes > 4 THEN 'pdf' END AS format FROM sized""",
    "q31_new_book_round_trip": f"""
        WITH {_VOLUMES},
        said AS (SELECT book, d, count(*) AS blocks, sha256(string_agg(text, chr(10) ORDER BY b)) AS digest FROM vols WHERE text <> '' GROUP BY book, d)
        SELECT book, 'Volume ' || book AS book_title, 'Author of ' || split_part(book, '/', 1) AS author, k - 1 AS d, 'OEBPS/ch' || lpad(CAST(k AS VARCHAR), 3, '0') || '.xhtml' AS path,
            'Chapter ' || CAST(d AS VARCHAR) AS chapter, coalesce(blocks, 0) AS blocks, digest FROM chapters LEFT JOIN said USING (book, d)""",
    "q32_rewritten_books": f"""
        WITH {_VOLUMES},
        told AS (SELECT book, d, b, text, {_translatable("text")} AS goes FROM vols WHERE text <> ''),
        goers AS (SELECT DISTINCT book, d FROM told WHERE goes),
        both_modes AS (
            SELECT book, d, 'bilingual' AS mode, 2 * b AS b, text FROM told UNION ALL SELECT book, d, 'bilingual', 2 * b + 1, '[MY] ' || text FROM told WHERE goes
            UNION ALL SELECT book, d, 'translated', 2 * b, CASE WHEN goes THEN '[MY] ' || text ELSE text END FROM told
        ),
        said AS (SELECT book, d, mode, count(*) AS blocks, sha256(string_agg(text, chr(10) ORDER BY b)) AS digest FROM both_modes GROUP BY book, d, mode)
        SELECT book, k - 1 AS d, blocks, digest, mode = 'bilingual' AND goers.d IS NOT NULL AS styled, CAST(0 AS BIGINT) AS missed, mode
        FROM said JOIN chapters USING (book, d) LEFT JOIN goers USING (book, d) WHERE book IN (SELECT book FROM goers)""",
    "q33_awkward_books": f"""
        WITH {_ITEM_VOLUMES},
        about AS (SELECT book, 1 - 1 + CAST(count(*) FILTER (i % 7 = 6) AS BIGINT) AS warnings, sha256('data:image/png;base64,' || base64(encode(min_by(text, i)))) AS cover FROM vols GROUP BY book)
        SELECT book, d, 'OPS/text/part ' || CAST(i AS VARCHAR) || '_é.xhtml' AS path, CASE i % 3 WHEN 0 THEN 'Nav ' || CAST(i AS VARCHAR) WHEN 1 THEN 'Ncx ' || CAST(i AS VARCHAR) ELSE 'part ' || CAST(i AS VARCHAR) || ' é' END AS title,
            sha256({_collapse("text")}) AS digest, book AS book_title, warnings, cover FROM kept JOIN about USING (book)""",
    "q33b_damaged_books": f"""
        WITH {_ITEM_VOLUMES}, counted AS (SELECT book, count(*) AS n, CAST(split_part(book, '-', 2) AS INT) % 3 AS k FROM kept GROUP BY book)
        SELECT book, CASE WHEN k = 0 THEN n ELSE 0 END AS docs, k <> 0 AS failed FROM counted""",
    "q34_pdf_pages": f"""
        WITH {_DOC_VOLUMES}
        SELECT book, page, sha256(array_to_string(list_filter({_lines("text")}, lambda x: x <> ''), chr(10))) AS digest, 'Volume ' || book AS title, 'A (\\) of ' || book AS author, CAST(NULL AS VARCHAR) AS error FROM vols""",
    "q35_form_feed_dumps": f"WITH {_DOC_VOLUMES} SELECT book, page, sha256(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM vols",
    "q35b_dump_tables": f"""
        WITH {_DOC_VOLUMES}
        SELECT book, page, sha256(text) AS digest FROM vols WHERE NOT ends_with(book, '/0')
        UNION ALL SELECT DISTINCT book, CAST(0 AS BIGINT), sha256('from another reader') FROM vols WHERE ends_with(book, '/0')""",
    "q36_markdown_pages": f"""
        WITH dressed AS (SELECT doc_id AS id, {_MARKED} AS md FROM documents),
        rows AS (SELECT id, list_filter(list_transform({_lines("md")}, lambda x: {_trim("x")}), lambda t: NOT starts_with(t, '```') AND NOT (starts_with(t, '|') AND contains(t, '---'))) AS ls FROM dressed)
        SELECT id, sha256(array_to_string(list_transform(ls, lambda t: {_trim(f"(CASE WHEN starts_with(t, '|') THEN replace({_PLAIN}, '|', ' ') ELSE {_PLAIN} END)")} || chr(10)), '')) AS digest FROM rows""",
    "q37_pdf_strings": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    "q38_resume_log": """
        SELECT 'key' AS key, item_id // 10 AS batch_id, item_id % 10 AS b, CAST(-1 AS BIGINT) AS part, sha256(CASE WHEN item_id // 10 % 4 = 3 THEN 'old' ELSE text END) AS digest FROM benchmark""",
    "q40_settings": """
        SELECT * FROM (VALUES ('absent', 'gemini-3.5-flash-lite', 'bilingual', '', true), ('saved', 'm', 'translated', 'ä' || chr(10), false), ('partial', 'other', 'bilingual', '', true),
            ('broken', NULL, NULL, NULL, NULL), ('after broken', 'gemini-3.5-flash-lite', 'bilingual', '', true)) AS t(moment, model, mode, instructions, switches)""",
    "q41_usage_today": f"""
        SELECT day, event_type AS model, count(*) AS requests, bool_or(value > 90) AS exhausted, (day + 1) * 86400 - 57600 AS reset_at
        FROM (SELECT *, {_DAY} AS day FROM events) WHERE day = (SELECT max({_DAY}) FROM events) GROUP BY day, event_type""",
    "q41b_usage_stream": f"SELECT {_DAY} AS day, event_type AS model, count(*) AS requests, bool_or(value > 90) AS exhausted FROM events GROUP BY 1, 2",
    "q42_delays": """
        SELECT n, model, least(5 * n, 30) AS pause, CAST(1000 * pow(2, least(n, 5)) AS BIGINT) AS backoff, CAST(CASE WHEN model LIKE '%lite%' THEN 500 ELSE 20 END AS BIGINT) AS rpm, CAST(CASE WHEN model LIKE '%lite%' THEN 5000 ELSE 10000 END AS BIGINT) AS budget
        FROM (SELECT CAST(unnest(range(1, 15)) AS BIGINT) AS n), (SELECT unnest(['gemini-3.5-flash-lite', 'gemini-3.6-flash', 'other']) AS model)""",
    "q43_job_outcomes": f"""
        WITH {_TURN_ITEMS},
        bad AS (SELECT conv_id, batch_id, bool_or(contains(text, 'ß')) AS failed FROM batched GROUP BY conv_id, batch_id),
        sums AS (SELECT count(*) AS batches, count(*) FILTER (failed) AS failed FROM bad)
        SELECT conv_id, turn, NOT contains(text, 'ß') AS answered, CASE WHEN NOT contains(text, 'ß') THEN 'gemini-3.5-flash-lite' END AS model, CASE WHEN bad.failed THEN 'failed' ELSE 'done' END AS outcome,
            sums.batches AS batches, sums.batches AS done, sums.failed AS failed, CASE WHEN sums.failed > 0 THEN 'cut off' END AS error
        FROM batched JOIN bad USING (conv_id, batch_id), sums""",
    "q44_job_plan": f"""
        WITH {_TURN_ITEMS},
        marked AS (SELECT *, conv_id % 3 = 0 OR (conv_id % 3 = 1 AND turn % 2 = 0) AS logged, text IN (SELECT text FROM turns WHERE role = 'user') AS known FROM batched),
        whole AS (SELECT *, bool_and(logged) OVER (PARTITION BY conv_id, batch_id) AS resumed FROM marked)
        SELECT conv_id, count(*) AS items, count(*) FILTER (logged) AS logged, count(*) FILTER (known AND NOT logged) AS cached, bool_and(resumed) AS resumed,
            CAST(sum(chars) AS BIGINT) AS chars_total, CAST(coalesce(sum(chars) FILTER (logged OR known), 0) AS BIGINT) AS chars_start FROM whole GROUP BY conv_id""",
    "q45_job_counters": """
        WITH batches AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS h, bool_or(event_type = 'error') AS bad, count(*) FILTER (event_type = 'click') AS hits, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY 1)
        SELECT count(*) AS done, count(*) FILTER (bad) AS failed, CAST(coalesce(sum(tokens) FILTER (NOT bad), 0) AS BIGINT) AS tokens, CAST(sum(hits) AS BIGINT) AS cached FROM batches""",
    "q46_debug_export": f"""
        WITH {_ITEMS},
        splits AS (SELECT book, n_parts, row_number() OVER (PARTITION BY book ORDER BY d, b) - 1 AS k FROM (SELECT DISTINCT book, d, b, n_parts FROM parts))
        SELECT book, 'batch' AS what, batch_id AS number, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens FROM batched WHERE batch_id < 5 GROUP BY book, batch_id
        UNION ALL SELECT book, 'split', k, n_parts, NULL FROM splits WHERE k < 12""",
    "q47_engine_job": f"""
        WITH {_ITEM_VOLUMES},
        epubs AS (SELECT book, i, {_collapse("text")} AS text, d FROM kept),
        pdf_pages AS (SELECT book, i AS page, array_to_string(list_filter({_lines("text")}, lambda x: x <> ''), chr(10)) AS text FROM vols),
        {_paragraphs("pdf_pages", "book, page")},
        sized AS (SELECT *, {_big("length(text)")} AS chars FROM paras),
        {_grouped("sized", "book", "page, paragraph", "chars", 8000, None, "told", "chapter")},
        blocks AS (
            SELECT book || '.epub' AS file, 'epub' AS format, book AS title, '' AS author, d, i AS page, CAST(0 AS BIGINT) AS paragraph, text FROM epubs
            UNION ALL SELECT book || '.pdf', 'pdf', 'PDF of ' || book, 'Nobody', chapter, page, paragraph, text FROM told
        ),
        eligible AS (SELECT *, {_big("length(text)")} AS chars, {_big(_tokens("text"))} AS tokens FROM blocks WHERE {_translatable("text")}),
        {_grouped("eligible", "file", "d, page, paragraph", "tokens", _LITE, 100, "packed")},
        files AS (SELECT file, any_value(format) AS format, any_value(title) AS title, any_value(author) AS author, sum(chars) AS total_chars, count(DISTINCT d) AS segments, count(DISTINCT batch_id) AS requests, count(*) AS total FROM packed GROUP BY file),
        sums AS (SELECT sum(requests) AS batches, sum(total_chars) AS chars FROM files),
        texts AS (SELECT count(DISTINCT text) AS n FROM eligible)
        SELECT file AS file_name, format, title, author, CAST(total_chars AS BIGINT) AS total_chars, segments, requests, total AS done, total, true AS saved, total AS told, 'completed' AS status,
            CAST(batches AS BIGINT) AS batches, CAST(0 AS BIGINT) AS requests_after, CAST(batches AS BIGINT) AS used, n AS cached, CAST(chars AS BIGINT) AS chars FROM files, sums, texts""",
    "q48_incremental": f"""
        WITH turns AS (SELECT conv_id, turn, {_collapse("text")} AS text FROM conversations),
        told AS (SELECT *, CASE WHEN {_translatable("text")} THEN '[MY] ' || text END AS t FROM turns)
        SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS book, turn, t IS NOT NULL AS told, sha256(t) AS digest FROM told, (SELECT unnest([0, 1]) AS k)""",
    "q49_preconditions": """
        SELECT mode, language, mode IN ('bilingual', 'translated') AND trim(language) <> '' AS taken
        FROM (SELECT unnest(['bilingual', 'translated', 'Bilingual', '']) AS mode), (SELECT unnest(['Thai', '  ', '']) AS language)""",
    "q50_prompt": """
        SELECT conv_id, turn, sha256('{"paragraphs": [{"i": 1, "t": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}]}') AS input, true AS language, true AS wish, 'gemini-3.5-flash-lite' AS model FROM conversations""",
    "q51_preview_estimate": f"""
        WITH {_BLOCKS}, sums AS (SELECT book, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks WHERE {_translatable("text")} GROUP BY book)
        SELECT book, chars, CAST(ceil(CAST(chars AS DOUBLE) / 2.3 / 5000) AS BIGINT) AS lite, CAST(ceil(CAST(chars AS DOUBLE) / 2.3 / 10000) AS BIGINT) AS "full" FROM sums""",
    "q52_entities": "SELECT doc_id, sha256(coalesce(text, '') || '&lt;' || chr(160) || '&copy;&#xD800;&#1114112;&#;&lt') AS digest FROM documents",
    "q53_percent_names": f"""
        WITH names AS (SELECT unnest(string_split(text, ' ')) AS name FROM benchmark UNION SELECT url FROM pages)
        SELECT name, {_quoted("name || ' é+%/~'")} AS coded, name || ' é+%/~' AS back, url_decode(name) || '%zz%4' AS broken FROM names""",
    "q54_sibling_tag": """
        SELECT tag, CASE WHEN tag IN ('li', 'dt', 'dd', 'td') THEN tag WHEN tag = 'th' THEN 'td' ELSE 'p' END AS sibling
        FROM (SELECT unnest(['p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li', 'blockquote', 'td', 'th', 'dd', 'dt', 'figcaption']) AS tag)""",
    "q55_resume_key": """
        SELECT doc_id, sha256(coalesce(text, '')) || '-gemini-3.5-flash-lite-Burmese-5000-100-' || substring(sha256('keep names'), 1, 8) || '-v2' AS key FROM documents""",
    "q56_file_titles": r"""
        WITH named AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '_a-b.xhtml' AS path FROM pages)
        SELECT page_id, string_split(path, '/')[-1] AS file, regexp_extract(path, '^(.*)/', 1) AS folder, translate(regexp_replace(string_split(path, '/')[-1], '(\.xhtml)+$', ''), '_-', '  ') AS title FROM named""",
    "q57_known_html": f"""
        WITH {_BLOCKS},
        told AS (SELECT book || '|' || CAST(d AS VARCHAR) AS d, row_number() OVER (PARTITION BY book, d ORDER BY b) - 1 AS b, {[*_KNOWN_TAGS]}[b % 7 + 1] AS tag, {_collapse("' ' || text || ' if (a<b) x(''</p'')'")} AS text FROM blocks WHERE text <> ''),
        ends AS (SELECT d, max(b) + 1 AS b, 'li' AS tag, 'open end' AS text FROM told GROUP BY d)
        SELECT *, NOT {_translatable("text")} AS skipped FROM (SELECT * FROM told UNION ALL SELECT * FROM ends)""",
}

_CACHE_KEY = "sha256(encode(substring(sha256(encode('gemini-3.5-flash-lite') || '\\x00'::BLOB || encode('Burmese') || '\\x00'::BLOB || unhex(substring(sha256(encode('keep names')), 1, 8)) || '\\x02'::BLOB), 1, 16)) || '\\x00'::BLOB || encode(text))"
SQL["q39_cache_log"] = f"""
        WITH keyed AS (SELECT DISTINCT {_CACHE_KEY} AS k, text FROM conversations)
        SELECT k, sha256(CASE WHEN k < '8' THEN 'again ' ELSE '[MY] ' END || text) AS digest, (SELECT count(*) FROM keyed) AS entries, CAST(0 AS BIGINT) AS after_clearing FROM keyed"""
