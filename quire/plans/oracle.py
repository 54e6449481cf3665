"""DuckDB SQL for the registered queries, written from the rules and apart from the Spark expressions."""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values, listed here again so that an error in the engine's lists shows
NOT_PAGE_NUMBERS = "di mi ci li mix lo yo jo ill oil oily lily joy lol loll jill yoyo".split()
FLASH = [f"gemini-3.{k}-flash" for k in (5, 6, 7, 8)]
LITE = [f"gemini-3.{k}-flash-lite" for k in (5, 1)]
LANGUAGE_CODES = [x.split("=") for x in "burmese=my myanmar=my english=en chinese=zh-CN japanese=ja korean=ko thai=th vietnamese=vi french=fr german=de spanish=es hindi=hi indonesian=id arabic=ar russian=ru".split()]

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _translatable(x: str) -> str:
    return rf"(length({_trim(x)}) >= 2 AND regexp_matches({x}, '[\p{{L}}\p{{Nl}}\p{{M}}]'))"


def _lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace({x}, '\r?\n$', ''), '\r?\n') END)"


def _tokens(x: str) -> str:
    a = rf"length(regexp_replace({x}, '[^\x00-\x7F]', '', 'g'))"
    return f"({a} // 4 + ((length({x}) - {a}) * 10) // 23)"


def _big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


_NAMES = ", ".join(f"'{w}'" for w in NOT_PAGE_NUMBERS)
_ROMAN = "^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def _numberish(t: str) -> str:
    mapped = f"translate(translate({t}, '*<>,.-–—', ''), 'iIlLjJoOyY', '1111110077')"
    return (
        f"(lower({t}) NOT IN ({_NAMES}) AND ("
        f"(regexp_matches({t}, '[0-9]') AND regexp_full_match({t}, '[0-9iIlLoOjJyY*<>,.\\-–—]+'))"
        f" OR (regexp_full_match({mapped}, '[0-9]{{2,4}}') AND regexp_matches({mapped}, '[1-9]'))"
        f" OR (lower({t}) <> '' AND regexp_matches(lower({t}), '{_ROMAN}'))))"
    )


def _page_number(x: str) -> str:
    core = rf"regexp_replace(lower({_trim(x)}), '^(page |page, |p\. |p )', '')"
    compact = f"regexp_replace({core}, '{_WS}+', '', 'g')"
    bare = f"regexp_replace({compact}, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g')"
    return f"(length({compact}) <= 10 AND {_numberish(bare)})"


def _peeled(source: str) -> str:
    """CTEs from source (…, line) to keyed (…, key): up to two numberish words off either end."""
    one = lambda w, i: f"coalesce({w}[{i}], '')"
    head = f"CASE WHEN {_numberish(one('w', 1))} THEN CASE WHEN {_numberish(one('w', 2))} THEN 2 ELSE 1 END ELSE 0 END"
    tail = f"CASE WHEN {_numberish(one('v', -1))} THEN CASE WHEN {_numberish(one('v', -2))} THEN 2 ELSE 1 END ELSE 0 END"
    return f"""
        worded AS (SELECT *, list_filter(string_split_regex(line, '{_WS}+'), lambda x: x <> '') AS w FROM {source}),
        headed AS (SELECT *, w[({head}) + 1:] AS v FROM worded),
        keyed AS (SELECT *, nullif(lower(array_to_string(v[:len(v) - ({tail})], ' ')), '') AS key FROM headed)"""


_BLOCKS = f"""
        ruled AS (SELECT concat_ws('/', source, lang) AS book, doc_id AS d, {_lines("text")} AS ls FROM documents),
        lined AS (SELECT book, d, CAST(unnest(range(len(ls))) AS BIGINT) AS b, unnest(ls) AS line FROM ruled),
        blocks AS (SELECT book, d, b, {_collapse("line")} AS text FROM lined)"""


def _split(source: str, keys: str, budget: int) -> str:
    """CTE parts (keys, part, n_parts, text) of the rows of source whose text is over the budget."""
    target = max(budget // 2, 200)
    plain = "CASE WHEN ascii(c) < 128 THEN 1 ELSE 0 END"
    full = f"((acc.a + {plain}) // 4 + ((acc.o + 1 - ({plain})) * 10) // 23 >= {target} AND (regexp_full_match(c, '{_WS}') OR acc.run + 1 >= {4 * target}))"
    return f"""
        folded AS (
            SELECT {keys}, text, list_reduce(string_split(text, ''), lambda acc, c: {{
                'a': CASE WHEN {full} THEN 0 ELSE acc.a + {plain} END,
                'o': CASE WHEN {full} THEN 0 ELSE acc.o + 1 - ({plain}) END,
                'run': CASE WHEN {full} THEN 0 ELSE acc.run + 1 END,
                'pos': acc.pos + 1,
                'cuts': CASE WHEN {full} THEN list_append(acc.cuts, acc.pos + 1) ELSE acc.cuts END
            }}, {{'a': CAST(0 AS BIGINT), 'o': CAST(0 AS BIGINT), 'run': CAST(0 AS BIGINT), 'pos': CAST(0 AS BIGINT), 'cuts': CAST([] AS BIGINT[])}}).cuts AS cuts
            FROM {source} WHERE {_tokens("text")} > {budget}
        ),
        bounds AS (SELECT {keys}, text, list_concat([CAST(0 AS BIGINT)], CASE WHEN coalesce(cuts[-1], 0) < length(text) THEN list_append(cuts, CAST(length(text) AS BIGINT)) ELSE cuts END) AS ends FROM folded),
        parts AS (
            SELECT {keys}, CAST(i AS BIGINT) AS part, CAST(len(ends) - 1 AS BIGINT) AS n_parts, substring(text, ends[i + 1] + 1, ends[i + 2] - ends[i + 1]) AS text
            FROM (SELECT *, unnest(range(len(ends) - 1)) AS i FROM bounds)
        )"""


def _grouped(source: str, key: str, order: str, size: str, limit: int, most: int | None, out: str = "batched", name: str = "batch_id") -> str:
    """CTE out: rows of source with the number of their greedy group."""
    over = f"acc.n > 0 AND (acc.total + x > {limit}" + (f" OR acc.n >= {most})" if most else ")")
    return f"""
        {out}_lists AS (SELECT {key}, list(s ORDER BY {order}) AS rows, list(CAST({size} AS BIGINT) ORDER BY {order}) AS sizes FROM (SELECT *, s FROM {source} AS s) GROUP BY {key}),
        {out}_folds AS (
            SELECT {key}, rows, list_reduce(sizes, lambda acc, x: {{
                'total': CASE WHEN {over} THEN x ELSE acc.total + x END,
                'n': CASE WHEN {over} THEN 1 ELSE acc.n + 1 END,
                'g': CASE WHEN {over} THEN acc.g + 1 ELSE acc.g END,
                'ids': list_append(acc.ids, CASE WHEN {over} THEN acc.g + 1 ELSE acc.g END)
            }}, {{'total': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'g': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[])}}).ids AS ids FROM {out}_lists
        ),
        {out} AS (SELECT r.*, {name} FROM (SELECT unnest(rows) AS r, unnest(ids) AS {name} FROM {out}_folds))"""


_LITE = 5000
_ITEMS = f"""
        {_BLOCKS},
        eligible AS (SELECT * FROM blocks WHERE {_translatable("text")}),
        {_split("eligible", "book, d, b", _LITE)},
        items AS (
            SELECT book, d, b, part, text, {_big("length(text)")} AS chars, {_big(_tokens("text"))} AS tokens FROM (
                SELECT book, d, b, CAST(-1 AS BIGINT) AS part, text FROM eligible WHERE {_tokens("text")} <= {_LITE}
                UNION ALL SELECT book, d, b, part, text FROM parts
            )
        ),
        {_grouped("items", "book", "d, b, part", "tokens", _LITE, 100)}"""

_PREFIX = r"""(substring(sha256(encode('gemini-3.5-flash-lite') || '\x00'::BLOB || encode('Burmese') || '\x00'::BLOB || unhex(substring(sha256(encode('keep names')), 1, 8)) || '\x02'::BLOB), 1, 16))"""


def _key(x: str) -> str:
    return rf"sha256(encode({_PREFIX}) || '\x00'::BLOB || encode({x}))"


_TOTALS = "SELECT book, batch_id, count(*) AS items, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens"

_TURN_PARTS = f"""
        ruled AS (SELECT conv_id, turn, {_lines("text")} AS ls FROM conversations),
        lined AS (SELECT conv_id, turn, len(ls) AS n, unnest(range(len(ls))) AS part, unnest(ls) AS line FROM ruled),
        answered AS (SELECT *, CASE WHEN {_translatable("line")} THEN '[MY] ' || line END AS t FROM lined),
        joined AS (
            SELECT conv_id, turn, CASE WHEN count(t) = max(n) THEN string_agg(t, '' ORDER BY part) END AS translation
            FROM answered GROUP BY conv_id, turn
        )"""

_EMPTY = "CAST([] AS VARCHAR[])"


def _resolve(x: str) -> str:
    return f"array_to_string(list_reduce(string_split({x}, '/'), lambda acc, s: CASE WHEN s IN ('', '.') THEN acc WHEN s = '..' THEN acc[:len(acc) - 1] ELSE list_append(acc, s) END, {_EMPTY}), '/')"


_ENTRIES = f"""
        linked AS (
            SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS base,
                'text/../././' || split_part(regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1), '?', 1) AS href FROM pages
        ),
        entries AS (
            SELECT page_id, {_resolve("CASE WHEN base = '' THEN split_part(href, '#', 1) ELSE base || '/' || split_part(href, '#', 1) END")} AS entry,
                {_resolve("'/../' || href")} AS key FROM linked
        )"""

_PAGE_LINES = f"""
        trimmed AS (SELECT source AS book, doc_id AS page, list_transform({_lines("text")}, lambda x: {_trim("x")}) AS ls FROM documents),
        filled AS (SELECT *, list_filter(ls, lambda x: x <> '') AS f FROM trimmed)"""

_HEADER_COUNTS = f"""
        {_PAGE_LINES},
        edges AS (
            SELECT book, page, 'top' AS edge, 1 AS k, f[1] AS line FROM filled WHERE len(f) >= 2
            UNION ALL SELECT book, page, 'bottom', 1, f[-1] FROM filled WHERE len(f) >= 2
            UNION ALL SELECT book, page, 'top', 2, f[2] FROM filled WHERE len(f) >= 2
            UNION ALL SELECT book, page, 'bottom', 2, f[-2] FROM filled WHERE len(f) >= 2
        ),
        {_peeled("edges")},
        counts AS (SELECT book, edge, key, count(*) AS n FROM keyed WHERE k = 1 AND key IS NOT NULL GROUP BY book, edge, key)"""


def _paragraphs(source: str, keys: str, out: str = "paras") -> str:
    return f"""
        {out}_ruled AS (SELECT {keys}, list_transform({_lines("text")}, lambda x: {_trim("x")}) AS ls FROM {source}),
        {out}_lined AS (SELECT {keys}, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM {out}_ruled),
        {out}_marked AS (SELECT *, sum(CAST(line = '' AS INT)) OVER (PARTITION BY {keys}) AS blanks, sum(CAST(line = '' AS INT)) OVER (PARTITION BY {keys} ORDER BY no) AS before FROM {out}_lined),
        {out}_joined AS (
            SELECT {keys}, CASE WHEN blanks > 0 THEN before ELSE no // 6 END AS grp, {_collapse("string_agg(line, ' ' ORDER BY no)")} AS text
            FROM {out}_marked WHERE line <> '' GROUP BY {keys}, grp
        ),
        {out} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY grp) - 1 AS paragraph, text FROM {out}_joined WHERE text <> '')"""


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _turn(names: list[str]) -> str:
    tier = _list(names)
    at = f"coalesce(list_position({tier}, model), 0)"
    return f"CASE WHEN {at} = 0 THEN {tier} ELSE list_concat({tier}[{at} + 1:], {tier}[:{at} - 1]) END"


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
_UNESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
_escape = lambda x: _replaced(x, *_ESCAPES)
_unescape = lambda x: _replaced(x, *_UNESCAPES)

_CODES = " ".join(f"WHEN lower(language) LIKE '%{part}%' THEN " + (f"CASE WHEN lower(language) LIKE '%traditional%' THEN 'zh-TW' ELSE '{code}' END" if part == "chinese" else f"'{code}'") for part, code in LANGUAGE_CODES)
_LANGUAGES = ["Burmese (မြန်မာ)", "Myanmar", "English", "Chinese (Traditional)", "Chinese (Simplified)", "Japanese", "Korean", "Thai", "Vietnamese", "French", "German", "Spanish", "Hindi", "Indonesian", "Arabic", "Russian", "Klingon", ""]

_TENTHS = "CAST(({n} * 10 + {half}) // {unit} // 10 AS VARCHAR) || '.' || CAST(({n} * 10 + {half}) // {unit} % 10 AS VARCHAR)"


def _amount(n: str, big: int, small: int, words: tuple[str, str, str]) -> str:
    tenths = _TENTHS.format(n=f"({n})", unit=big, half=big // 2)
    return f"CASE WHEN {n} >= {big} THEN {tenths} || '{words[0]}' WHEN {n} >= {small} THEN CAST(({n} + {small // 2}) // {small} AS VARCHAR) || '{words[1]}' ELSE CAST({n} AS VARCHAR) || '{words[2]}' END"


_MARKED = r"chr(35) || ' A **head**' || chr(10) || chr(10) || '|a|b|' || chr(10) || '|---|---|' || chr(10) || '```' || chr(10) || replace(text, '. ', '.* [see __this__](x/y) ') || chr(10) || '```' || chr(10)"
_PLAIN = rf"replace(replace(replace(regexp_replace({_trim("regexp_replace(t, '^#+', '')")}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '**', ''), '__', ''), '*', '')"

ORACLE_SQL: dict[str, str] = {
    "q01_translatable_filter": f"""
        SELECT origin, id, part, {_big("length(text)")} AS chars, {_translatable("text")} AS translatable FROM (
            SELECT 'documents' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents
            UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations)""",
    "q02_segment_stats": f"""
        WITH {_BLOCKS}
        SELECT book, d, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks WHERE {_translatable("text")} GROUP BY ROLLUP (book, d)""",
    "q04_batch_packing": f"WITH {_ITEMS} {_TOTALS} FROM batched GROUP BY book, batch_id",
    "q05_token_estimate": f"""
        SELECT doc_id, tokens, tokens > 5000 AS over_lite, tokens > 10000 AS over_full FROM (SELECT doc_id, {_big(_tokens("text"))} AS tokens FROM documents)""",
    "q05b_split_oversized": f"""
        WITH {_split("documents", "doc_id", _LITE)}
        SELECT doc_id, part, n_parts, {_big("length(text)")} AS chars, sha256(text) AS digest FROM parts""",
    "q06_cache_key": f"""
        WITH turns AS (SELECT conv_id, turn, role, {_key("text")} AS k FROM conversations)
        SELECT conv_id, turn, k, k IN (SELECT k FROM turns WHERE role = 'user') AS hit FROM turns""",
    "q07_pending_requests": f"""
        WITH {_ITEMS},
        known AS (SELECT DISTINCT text FROM items WHERE book LIKE '%/en'),
        by_batch AS (SELECT book, batch_id, bool_and(text IN (SELECT text FROM known)) AS cached FROM batched GROUP BY book, batch_id)
        SELECT book, count(*) FILTER (NOT (cached OR batch_id = 0)) AS requests, count(*) FILTER (cached OR batch_id = 0) AS done FROM by_batch GROUP BY book""",
    "q08_part_join": f"WITH {_TURN_PARTS} SELECT * FROM joined",
    "q08b_segment_progress": f"""
        WITH {_TURN_PARTS},
        marked AS (SELECT c.conv_id, {_translatable("c.text")} AS counts, j.translation FROM conversations c LEFT JOIN joined j USING (conv_id, turn)),
        summed AS (SELECT conv_id, count(*) FILTER (counts AND translation IS NOT NULL) AS done, count(*) FILTER (counts) AS total FROM marked GROUP BY conv_id)
        SELECT conv_id, done, total, CASE WHEN done = 0 THEN 'pending' WHEN done >= total THEN 'done' ELSE 'active' END AS state FROM summed""",
    "q09_job_status": """
        SELECT user_id, day, batches, failed, CASE WHEN fatal THEN 'failed' WHEN cancelled THEN 'cancelled' WHEN batches > 0 AND failed >= batches THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status
        FROM (SELECT user_id, (CAST(floor(epoch(ts)) AS BIGINT) + 57600) // 86400 AS day, count(*) AS batches, count(*) FILTER (event_type = 'purchase') AS failed, bool_or(event_type = 'error') AS fatal, bool_or(event_type = 'signup') AS cancelled FROM events GROUP BY 1, 2)""",
    "q10_sample_prefix": f"""
        WITH {_ITEMS},
        first AS (SELECT * FROM batched QUALIFY row_number() OVER (PARTITION BY book ORDER BY d, b, part) <= 25)
        {_TOTALS} FROM first GROUP BY book, batch_id""",
    "q11_paragraphs": f"""
        WITH both_ways AS (
            SELECT doc_id AS page, false AS spaced, text FROM documents
            UNION ALL SELECT doc_id, true, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) FROM documents
        ), {_paragraphs("both_ways", "page, spaced")}
        SELECT * FROM paras""",
    "q12_path_normalize": f"WITH {_ENTRIES} SELECT page_id, entry, key FROM entries",
    "q12b_toc_title": rf"""
        WITH {_ENTRIES},
        labels AS (SELECT entry, min_by(split_part(text, '.', 1), page_id) AS label FROM entries JOIN benchmark ON item_id = page_id GROUP BY entry)
        SELECT page_id, entry, coalesce(label, translate(regexp_replace(regexp_replace(regexp_replace(string_split(entry, '/')[-1], '(\.xhtml)+$', ''), '(\.html)+$', ''), '(\.htm)+$', ''), '_-', '  ')) AS title
        FROM entries LEFT JOIN labels USING (entry)""",
    "q13_header_counts": f"WITH {_HEADER_COUNTS} SELECT book, edge, key, n FROM counts",
    "q13b_strip_furniture": f"""
        WITH {_HEADER_COUNTS},
        numbers AS (
            SELECT book, count(*) FILTER (numbered) AS hits, count(*) AS pages FROM (
                SELECT book, len(f) >= 2 AND ({_page_number("f[1]")} OR {_page_number("f[-1]")}) AS numbered FROM filled
            ) GROUP BY book
        ),
        gates AS (SELECT book, hits >= 3 OR hits * 3 >= pages AS strip FROM numbers),
        hits AS (
            SELECT e.book, e.page, e.edge, e.k, coalesce(c.n >= 3, false) OR (g.strip AND {_page_number("e.line")}) AS hit
            FROM keyed e LEFT JOIN counts c ON c.book = e.book AND c.edge = e.edge AND c.key = e.key JOIN gates g ON g.book = e.book
        ),
        marks AS (
            SELECT book, page,
                CASE WHEN bool_or(hit) FILTER (edge = 'top' AND k = 1) THEN CASE WHEN bool_or(hit) FILTER (edge = 'top' AND k = 2) THEN 2 ELSE 1 END ELSE 0 END AS t,
                CASE WHEN bool_or(hit) FILTER (edge = 'bottom' AND k = 1) THEN CASE WHEN bool_or(hit) FILTER (edge = 'bottom' AND k = 2) THEN 2 ELSE 1 END ELSE 0 END AS u
            FROM hits GROUP BY book, page
        ),
        cut AS (SELECT f.book, f.page, f.ls, len(f.f) AS m, coalesce(t, 0) AS t, least(coalesce(u, 0), len(f.f) - coalesce(t, 0)) AS u FROM filled f LEFT JOIN marks USING (book, page)),
        numbered AS (SELECT book, page, m, t, u, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM cut),
        ranked AS (SELECT *, sum(CAST(line <> '' AS INT)) OVER (PARTITION BY book, page ORDER BY no) AS rank FROM numbered),
        texts AS (SELECT book, page, string_agg(line, chr(10) ORDER BY no) AS text FROM ranked WHERE line = '' OR (rank > t AND rank <= m - u) GROUP BY book, page)
        SELECT book, page, {_big("t + u")} AS stripped, sha256(coalesce(text, '')) AS digest FROM cut LEFT JOIN texts USING (book, page)""",
    "q14_roman": f"""
        WITH numbers AS (
            SELECT n, repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1]
                || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS roman
            FROM (SELECT unnest(range(1, 4000)) AS n)
        )
        SELECT n, roman, n AS value, CASE WHEN regexp_matches(roman || 'i', '{_ROMAN}') THEN n + 1 END AS with_i FROM numbers""",
    "q15_page_number": f"""
        WITH {_BLOCKS},
        said AS (SELECT unnest(string_split(text, ' ')) AS line FROM blocks UNION SELECT text FROM blocks)
        SELECT line, {_page_number("line")} AS is_number FROM said""",
    "q16_quota_usage": """
        SELECT day, model, requests, exhausted, (day + 1) * 86400 - 57600 AS reset_at FROM (
            SELECT (CAST(floor(epoch(ts)) AS BIGINT) + 57600) // 86400 AS day, event_type AS model, count(*) AS requests, bool_or(value > 90) AS exhausted FROM events GROUP BY 1, 2)""",
    "q17_chapters": f"""
        WITH source_pages AS (SELECT source AS book, doc_id AS page, text FROM documents),
        {_paragraphs("source_pages", "book, page")},
        sized AS (SELECT *, {_big("length(text)")} AS chars FROM paras),
        {_grouped("sized", "book", "page, paragraph", "chars", 8000, None, "told", "chapter")}
        SELECT book, chapter + 1 AS chapter, 'ch' || lpad(CAST(chapter + 1 AS VARCHAR), 3, '0') AS chapter_id, 'Part ' || CAST(chapter + 1 AS VARCHAR) AS title, count(*) AS paragraphs, CAST(sum(chars) AS BIGINT) AS chars
        FROM told GROUP BY book, chapter""",
    "q18_fallback_chain": f"""
        WITH names AS (SELECT unnest({_list([*FLASH, *LITE, "custom-lite", "custom"])}) AS model),
        gone AS (SELECT unnest({_list(["", FLASH[1], LITE[0]])}) AS dead),
        chains AS (SELECT model, dead, list_filter(CASE WHEN model LIKE '%lite%' THEN {_turn(LITE)} ELSE {_turn(FLASH)} END, lambda m: m <> dead) AS c FROM names, gone)
        SELECT model, dead, array_to_string(c, ',') AS chain, c[1] AS next_model FROM chains""",
    "q19_strip_markdown": f"""
        WITH dressed AS (
            SELECT 'documents' AS origin, doc_id AS id, {_MARKED} AS md FROM documents
            UNION ALL SELECT 'benchmark', item_id, {_MARKED} FROM benchmark
        ),
        rows AS (SELECT origin, id, list_filter(list_transform({_lines("md")}, lambda x: {_trim("x")}), lambda t: NOT starts_with(t, '```') AND NOT (starts_with(t, '|') AND contains(t, '---'))) AS ls FROM dressed)
        SELECT origin, id, sha256(array_to_string(list_transform(ls, lambda t: {_trim(f"(CASE WHEN starts_with(t, '|') THEN replace({_PLAIN}, '|', ' ') ELSE {_PLAIN} END)")} || chr(10)), '')) AS digest FROM rows""",
    "q20_reply_parse": """
        SELECT conv_id, turn, role <> 'system' AS accepted, CASE WHEN role <> 'system' THEN turn END AS i, CASE WHEN role <> 'system' THEN CAST(length(text) AS BIGINT) END AS chars FROM conversations""",
    "q21_output_status": """
        SELECT event_id, k % 3 < 2 AS complete, event_type || CAST(k AS VARCHAR) AS said FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "q22_http_class": """
        WITH codes AS (SELECT CAST(unnest([200, 204, 400, 401, 403, 404, 408, 409, 429, 500, 503]) AS INTEGER) AS status),
        said AS (SELECT unnest(['resource exhausted', 'Quota ''RequestsPerMinute'' exceeded', 'GenerateRequestsPerDayPerModel', 'limit: 200 requests per day', 'API key not valid. Please pass', 'API_KEY_INVALID']) AS message),
        waits AS (SELECT CAST(unnest([NULL, 1, 600, 601, 1800]) AS BIGINT) AS retry_after),
        places AS (SELECT unnest([false, true]) AS in_array)
        SELECT status, message, retry_after, in_array, CASE
            WHEN status = 429 THEN CASE WHEN lower(message) LIKE '%per day%' OR lower(message) LIKE '%perday%' THEN 'daily_confirmed' WHEN retry_after > 600 THEN 'daily_suspected' ELSE 'rate_limit' END
            WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 408 OR status >= 500 THEN 'transient'
            WHEN message LIKE '%API key not valid%' OR message LIKE '%API_KEY_INVALID%' THEN 'invalid_key'
            WHEN status = 400 THEN 'rejected' WHEN status IN (401, 403) THEN 'unauthorized' WHEN status = 404 THEN 'not_found' ELSE 'other' END AS kind,
            CAST(CASE WHEN retry_after IS NULL THEN 8000 ELSE least(retry_after, 120) * 1000 END AS BIGINT) AS wait_ms
        FROM codes, said, waits, places""",
    "q23_escape": f"""
        SELECT page_id, sha256({_escape("html")}) AS escaped, sha256({_unescape("html")}) AS unescaped, {_unescape(_escape("html"))} = html AS reversible FROM pages""",
    "q24_collapse_ws": f"""
        SELECT doc_id, sha256({_collapse("'  ' || chr(9) || replace(text, '. ', '.   ' || chr(10)) || '　'")}) AS digest FROM documents""",
    "q25_lang_code": f"""
        WITH names AS (
            SELECT unnest({_list(_LANGUAGES)}) AS language
            UNION ALL SELECT DISTINCT CASE lang WHEN 'en' THEN 'English (US)' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END FROM documents
        )
        SELECT language, CASE {_CODES} ELSE 'en' END AS code, split_part(language, ' (', 1) AS label FROM names""",
    "q26_presentation": rf"""
        SELECT doc_id, {_amount("n_chars * 37", 1_000_000, 1000, ("M chars", "k chars", " chars"))} AS chars,
            {_amount("strlen(text) * 97", 1_048_576, 1024, (" MB", " KB", " B"))} AS bytes,
            coalesce(nullif({_trim("regexp_replace(substring(text, 1, 12) || ': \"a/b\"?', '[\\\\/:*?\"<>|]', '', 'g')")}, ''), 'book') AS file_name,
            CASE WHEN n_chars > 0 THEN least(100, CAST(floor(CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS DOUBLE) / n_chars * 100 + 0.5) AS BIGINT)) ELSE 0 END AS percent
        FROM documents""",
    "q26b_log_tail": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 41",
    "q27_end_to_end_stub": f"""
        WITH turns AS (SELECT CAST(conv_id AS VARCHAR) AS book, CAST(0 AS BIGINT) AS d, turn AS b, {_collapse("text")} AS text FROM conversations)
        SELECT book, d, b, CAST(0 AS BIGINT) AS k, text FROM turns
        UNION ALL SELECT book, d, b, CAST(1 AS BIGINT), '[MY] ' || text FROM turns WHERE {_translatable("text")}""",
    "q28_layout_stats": f"""
        WITH {_BLOCKS}
        SELECT book, count(*) FILTER ({_translatable("text")}) AS translatable, count(*) FILTER (NOT {_translatable("text")}) AS skipped,
            count(*) FILTER ({_translatable("text")} AND {_tokens("text")} > {_LITE}) AS split_blocks, {_big("max(length(text))")} AS longest FROM blocks GROUP BY book""",
    "q29_usage_line": """
        SELECT day, model, CASE WHEN exhausted THEN 'quota exhausted for today — resets 08:00' ELSE CAST(n AS VARCHAR) || CASE WHEN n = 1 THEN ' request' ELSE ' requests' END || ' on this model today · resets 08:00' END AS line FROM (
            SELECT (CAST(floor(epoch(ts)) AS BIGINT) + 57600) // 86400 AS day, event_type AS model, count(*) AS n, bool_or(value > 90) AS exhausted FROM events GROUP BY 1, 2)""",
}
