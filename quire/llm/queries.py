"""The registered queries of the operators here, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import score, train

    docs = _read(spark, sf_dir, "documents")
    return score(docs, train(docs, _read(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_text import extract

    return extract(_read(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quire.llm import chat

    own = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.format_trees(chat.chain(rows, "conv_id", ["turn"], "role", "text"))
    turns = done.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substrings import removal

    return removal(_read(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.media import inspect, store

    out = inspect(store(_read(spark, sf_dir, "documents")))
    return out.selectExpr("media_id as doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "size(carved) as n_carved")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.neardup import classes

    return classes(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quire.llm.decontaminate import find

    found = find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label documents, not URLs; the labelled URLs are those that a rule judges."""
    from quire.llm.urls import judge, label_by_rules, train

    pages = _read(spark, sf_dir, "pages")
    return judge(pages, train(label_by_rules(pages)))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_media_columns": op4_media_columns,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
}

_ESCAPED = "length({0}) + length(regexp_replace({0}, '[^\\\\<\\[\\]]', '', 'g'))"

def _crc_steps() -> list[int]:
    """What a byte does to the checksum of zlib, by the rule of its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _little(n: str, size: int) -> str:
    """A whole number's bytes, lowest first, as hex digits."""
    return " || ".join(f"printf('%02X', ({n}) // {1 << 8 * k} % 256)" for k in range(size))


def _ascii(text: str) -> str:
    return f"'{text.encode().hex().upper()}'"


#: Rows of documents, numbered, with their words as operators 3 and 8 take them.
_WORDED = r"""
        worded AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""
_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": f"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(13 + 2 * ({_ESCAPED.format("role")}) + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
        FROM said GROUP BY conv_id""",
    "op3_substring_dedup": f"""
        WITH {_WORDED},
        windows AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM worded)),
        twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
        covered AS (SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i, unnest(range(35)) AS k FROM windows WHERE s IN (SELECT s FROM twice))),
        each AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM worded),
        kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS said FROM each ANTI JOIN covered USING (rid, i) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM worded LEFT JOIN kept USING (rid)""",
    "op8_ngram_jaccard_join": f"""
        WITH RECURSIVE {_WORDED},
        texts AS (SELECT rid, doc_id, w, array_to_string(w, ' ') AS said FROM worded WHERE len(w) > 0),
        shingles AS (SELECT DISTINCT rid, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts)),
        sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
        common AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.rid <> y.rid GROUP BY x.rid, y.rid),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE c * 10 >= 8 * (x.n + y.n - c)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least_of AS (SELECT a AS rid, min(t.doc_id) AS first FROM reach JOIN texts t ON t.rid = b GROUP BY a),
        counted AS (SELECT a AS rid, count(*) AS n_links, count(DISTINCT y.said) FILTER (y.said <> x.said) AS n_texts FROM links JOIN texts x ON x.rid = a JOIN texts y ON y.rid = b GROUP BY a)
        SELECT doc_id, least(doc_id, coalesce(first, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts
        FROM worded LEFT JOIN least_of USING (rid) LEFT JOIN counted USING (rid)""",
    "op9_decontamination": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS size FROM (SELECT item_id, {_LOW} AS w FROM benchmark)),
        phrases AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items WHERE size > 0)),
        sizes AS (SELECT DISTINCT size FROM phrases),
        worded AS (SELECT row_number() OVER () AS rid, doc_id, {_LOW} AS w FROM documents),
        windows AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, sizes)),
        hits AS (SELECT rid, i, size, item FROM windows JOIN phrases USING (size, s)),
        words AS (SELECT rid, count(DISTINCT i) AS n FROM (SELECT rid, i + unnest(range(size)) AS i FROM hits) GROUP BY rid),
        found AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM worded LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)""",
    "op4_media_columns": f"""
        WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        padded AS (SELECT doc_id, n, h || repeat('00', CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END) AS p FROM raw),
        sized AS (SELECT *, length(p) // 2 AS m FROM padded),
        stored AS (SELECT *, {_ascii("RIFF")} || {_little("m + 52", 4)} || {_ascii("WAVE")} || {_ascii("fmt ")} || {_little("16", 4)} || {_little("1", 2)} || {_little("1", 2)} || {_little("8000", 4)} || {_little("8000", 4)} || {_little("1", 2)} || {_little("8", 2)}
            || {_ascii("size")} || {_little("8", 4)} || {_little("n", 6)} || '0000' || {_ascii("data")} || {_little("m", 4)} || p AS media FROM sized),
        tails AS (SELECT *, list_transform(range(64), lambda i: 16 * (instr('0123456789ABCDEF', substr(right(p, 128), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(right(p, 128), 2 * i + 2, 1)) - 1) AS tail FROM stored)
        SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(p)) AS payload_sha256,
            xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), tail), lambda acc, x: xor(acc >> 8, CAST({_crc_steps()}[(xor(acc, x) & 255) + 1] AS BIGINT))), 4294967295) AS tail_crc32,
            length(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256, 'audio/wav;rate=8000;channels=1;bits=8;samples=' || CAST(m AS VARCHAR) || ';carved=' AS feature,
            'audio/wav' AS media_type, true AS corrected, CAST(0 AS INTEGER) AS n_carved FROM tails""",
}
