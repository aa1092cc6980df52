"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import simhash_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# DuckDB's strings keep every code point; its regexes are RE2.
@query(
    "op10_exact_dedup",
    r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
)
def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.content_sort import exact_dedup

    return exact_dedup(_table(spark, d, "documents"))


@query("op7_simhash_near_dedup", simhash_sql.groups())
def op7_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.simhash import near_groups

    found = near_groups(_table(spark, d, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_token_stream")
def op8_token_stream(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from citeloom.llm.token_stream import read_digests, write_sequences

    return read_digests(write_sequences(_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Per document the ids' number and digest, and the digest of the text decoded from them."""
    import public_tokenizers

    from citeloom.llm.piece_viterbi import encode

    back = encode(_table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.ppm_language import fit, fold, identify

    docs = _table(spark, d, "documents")
    model = fit(docs.filter(fold() != 1))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


# Each five hexadecimal digits of a SHA-1 are four of base32.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[{k}] >> {s}) & 31 AS INTEGER) + 1, 1)" for k in range(1, 9) for s in (15, 10, 5, 0))


@query(
    "op6_warc",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS own, list_transform(range(0, 8), lambda k: CAST('0x' || substr(sha1(html), CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = own THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> own THEN own END AS refers_to FROM d""",
)
def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.warc import read_selected, write_archives

    return read_selected(write_archives(_table(spark, d, "pages")))


# Exact neighbours, their squares summed in the order of the components.
@query(
    "op4_nearest_neighbours",
    """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND len(q.e) = len(c.e) AND (q.vec_id <> c.vec_id OR q.e <> c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d QUALIFY rank <= 10""",
)
def op4_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.anisotropic import search

    return search(_table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, k=10).drop("mark")


@query("op1_kd_shards")
def op1_kd_shards(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.kd_shards import shard

    return shard(_table(spark, d, "documents"), shards=40)


@query("op3_entropy_mix")
def op3_entropy_mix(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.entropy_mix import mix

    return mix(_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


# The template's lengths are known; the digests are those of the table itself.
@query(
    "op2_chat_format",
    r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(text, '\', '\b')) + length(regexp_replace(text, '<(/?turn|image|audio|document)', '\\l\1', 'g')) - length(text) AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + length(role) + 15) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens FROM e GROUP BY conv_id""",
)
def op2_chat_format(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import chat_format as C

    turns = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema))
    chats = C.format_chats(turns.select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts")))
    back, loss = C.read_turns(F.col("formatted")), C.read_loss(F.col("formatted"), F.col("spans"))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    whole = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), tokens.alias("attachment_tokens"))


@query(
    "chat_typed_parts",
    r"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN page_id % 5 = 0 THEN 85 ELSE 85 * (page_id % 5) END AS image FROM pages)
SELECT page_id AS conv_id, '<turn user>' || regexp_replace(replace(url, '\', '\b'), '<(/?turn|image|audio|document)', '\\l\1', 'g') || '<image 0><document 1></turn>' || chr(10) || '<turn assistant><audio 2>ok \limage 0></turn>' || chr(10) AS formatted,
  '0:image:' || url || ':' || CAST(image AS VARCHAR) || ' 1:document:' || url || ':600 2:audio:' || url || ':38' AS attachments, CAST(image + 638 AS BIGINT) AS attachment_tokens, '<audio 2>ok <image 0>' AS loss FROM p""",
)
def chat_typed_parts(spark: SparkSession, d: str) -> DataFrame:
    """The visitor over text, image, document and audio parts: a conversation about each page."""
    from citeloom.llm import chat_format as C

    url = F.coalesce("url", F.lit(""))

    def part(kind: str, text: Column | None = None, ref: Column | None = None, units: Column | None = None) -> Column:
        given = lambda c, name, to: (F.lit(None) if c is None else c).cast(to).alias(name)
        return F.struct(F.lit(kind).alias("kind"), given(text, "text", "string"), given(ref, "ref", "string"), given(units, "units", "double"))

    user = F.array(part("text", url), part("image", ref=url, units=F.col("page_id") % 5), part("document", ref=url))
    answer = F.array(part("audio", ref=url, units=F.lit(1.5)), part("text", F.lit("ok <image 0>")))
    pages = _table(spark, d, "pages")
    turns = pages.select(F.col("page_id").alias("conv_id"), F.posexplode(F.array(F.struct(F.lit("user").alias("role"), user.alias("parts")), F.struct(F.lit("assistant").alias("role"), answer.alias("parts")))).alias("turn", "t")).select("conv_id", "turn", "t.role", "t.parts")
    chats = C.format_chats(turns)
    shown = F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["number"].cast("string"), a["kind"], a["ref"], a["tokens"].cast("string"))), " ")
    return chats.select("conv_id", "formatted", shown.alias("attachments"), F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"), C.read_loss(F.col("formatted"), F.col("spans")).alias("loss"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from citeloom.llm.token_alignment import align, pair_counts, scored

    found = align(_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return scored(found, pair_counts(found)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(
    "op12_collocations",
    r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS MATERIALIZED (SELECT lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
x AS MATERIALIZED (SELECT lang, w, lead(w, 1) OVER q AS w2, lead(w, 2) OVER q AS w3, lead(w, 3) OVER q AS w4 FROM o WINDOW q AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, 1 AS k, w AS phrase FROM x UNION ALL SELECT lang, 2, w || ' ' || w2 FROM x WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.k, a, cut, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS score FROM c, (VALUES (1), (2), (3)) AS s(cut)
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:c.k], ' ') WHERE cut < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (2), (3)) AS s(n), (VALUES (1), (2), (3)) AS t(i) WHERE n < k AND i + n - 1 <= k GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN n ON n.lang = best.lang LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000""",
)
def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.collocations import collocations

    return collocations(_table(spark, d, "documents"))


@query("op13_document_fingerprints")
def op13_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm.multiset_hash import edited_fingerprints

    return edited_fingerprints(_table(spark, d, "documents"))
