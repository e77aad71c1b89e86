"""The registered queries of the text operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.llm import (
    byte_bpe,
    chat_format,
    collocations,
    decontamination,
    exact_dedup,
    language_id,
    lexical_search,
    line_dedup,
    lm_scoring,
    quality,
    simhash,
    token_counts,
    toxicity,
)
from pricelens.llm.common import remainder

RANKS = "byte_bpe_multi_50k.tiktoken"
MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid4().hex}")
    return index.add(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.prefix_counts(docs, vocabulary(MODEL)).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        token_counts.n_tokens().alias("n_tokens"),
        (token_counts.n_tokens() > TOKEN_LIMIT).alias("over_limit"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    turns = chat_format.turns_of(F.col("formatted"))
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        chat_format.formatted(rows)
        .withColumns({"turns": turns, "loss": loss})
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = vocabulary(RANKS), public_tokenizers.PATTERN
    ids = byte_bpe.encode(docs, ranks, pattern).drop("text")
    return byte_bpe.decode(ids, ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    held_out = remainder("doc_id", language_id.MODULUS) == language_id.HELD_OUT
    return language_id.predictions(docs.drop("lang"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_lm_scoring,
        op3_simhash,
        op4_quality,
        op5_exact_dedup,
        op6_toxicity,
        op7_token_counts,
        op8_line_dedup,
        op9_chat_format,
        op10_byte_bpe,
        op11_lexical_search,
        op12_collocations,
        op13_language_id,
    )
}

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_decontamination": rf"""
        WITH item_words AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram
            FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
                  FROM item_words WHERE len(w) > 0)
        ), doc_words AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), grams AS (
            SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
                  FROM doc_words, (SELECT DISTINCT m FROM windows))
        ), hits AS (
            SELECT doc_id, item_id, g.m, i FROM grams g JOIN windows v ON g.m = v.m AND g.gram = v.gram
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op5_exact_dedup": rf"""
        WITH digests AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS d,
                length(coalesce(text, '')) AS n FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY d)::BIGINT AS group_size,
            doc_id = first_value(doc_id) OVER w AS kept, d AS text_sha256
        FROM digests WINDOW w AS (PARTITION BY d ORDER BY n DESC, doc_id)
    """,
    "op8_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT doc_id, line, pos,
                {_LOWER.format(rf"regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')")} AS k FROM lines
        ), repeated AS (
            SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
            GROUP BY k HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT doc_id, line, pos, last_doc IS NOT NULL AND doc_id <> last_doc AS gone
            FROM keyed LEFT JOIN repeated USING (k)
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op9_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS n,
                CASE WHEN role = lag(role) OVER w THEN 5
                    ELSE length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;'))
                        + 4 + 8 END AS marks
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(n + marks)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op11_lexical_search": rf"""
        WITH doc_terms AS (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS term FROM documents
        ), wanted AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS term FROM benchmark)
            GROUP BY ALL
        ), tfs AS (
            SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
        ), lengths AS (
            SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
        ), totals AS (
            SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM lengths
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * max(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM tfs, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term
        ), sized AS (
            SELECT doc_id, 100 - 75 + (75 * n * all_docs) // all_terms AS m FROM lengths, totals
        ), scored AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN sized USING (doc_id) GROUP BY item_id, doc_id
        )
        SELECT item_id, rank, doc_id, score
        FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
              FROM scored WHERE score > 0)
        WHERE rank <= 10
    """,
    "op12_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), counts AS (
            SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m))
            GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30
        ), held AS (
            SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS most
            FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM candidates))
            GROUP BY ALL
        ), parted AS (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
        ), cuts AS (
            SELECT p.lang, p.phrase, a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score
            FROM parted p JOIN counts h ON h.lang = p.lang AND h.phrase = head JOIN counts t ON t.lang = p.lang AND t.phrase = tail
        ), scored AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
            FROM scored LEFT JOIN held USING (lang, phrase) WHERE coalesce(100 * most < 80 * a, true)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
