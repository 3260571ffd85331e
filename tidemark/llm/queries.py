"""The registered queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_decode
from tidemark.llm.conversation_trie import prefix_trie, read_turns, share_openings
from tidemark.llm.embeddings import near_vectors
from tidemark.llm.fill_in_middle import fill_in_middle, restore
from tidemark.llm.html_text import extract_text
from tidemark.llm.language import Model, identify_language, learn_languages
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.media import read_media, store_media
from tidemark.llm.near_documents import near_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.passages import repeated_passages
from tidemark.llm.token_rollup import Ledger, count_tokens, deletes, inserts, revisions
from tidemark.llm.url_rules import Rule, host_of, judge_urls, path_of, site_rule
from tidemark.llm.vocabulary import read_added
from tidemark.sources.scratch import new_folder, written

SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Below every site rule: host names that advertise what they are.
SPAM_TOKENS = ["casino", "pills", "spam", "viagra"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), host_of(F.col("url")), path_of(F.col("url")))


def held_out() -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> Model:
    return learn_languages(docs.where(~held_out()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = identify_language(docs, language_model(docs))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over documents: all are inserted; rows whose text another row with a smaller id has are deleted;
    the others' byte-level counts are revised to include the id that ends a document. The second batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    counts = written(count_tokens(docs, {"byte_bpe_50k": vocabulary("byte_bpe_50k.tiktoken")}, pattern()), "token-counts")
    first = counts.where("text_key is not null").groupBy("text_key").agg(F.min("doc_id").alias("first"))
    marked = written(counts.join(first, "text_key", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))), "token-counts")
    gone, live = marked.where("copy"), marked.where("not copy")
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    ledger.commit("1-insert", inserts(counts))
    ledger.commit("2-delete", deletes(gone))
    old = live.where("version = 'byte_bpe_50k'")
    ledger.commit("3-revise", revisions(old, old.withColumn("tokens", F.col("tokens") + 1)))
    ledger.commit("2-delete", deletes(gone))
    return ledger.totals()


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """byte_bpe_50k's ids, by the rank file of the same vocabulary and the added tokens of its JSON file; 1 ends a document."""
    pieces = pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), end_id=1, added=read_added(vocabulary("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [site_rule(*r) for r in SITE_RULES] + [Rule(f"~{t}", rf"^([^/]*[^/a-z0-9])?{t}([^a-z0-9]|$)", "block", 0, [t]) for t in SPAM_TOKENS]
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    site = [name for name, _ in SITE_RULES]
    return judged.select("page_id", "judged.host", "judged.path", F.when(F.col("judged.rule").isin(site), F.col("judged.rule")).alias("rule"), "judged.verdict")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(written(store_media(table(spark, sf_dir, "documents")), "media"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*share_openings(read_turns(table(spark, sf_dir, "conversations")), every=5, most=9))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_token_rollup": op3_token_rollup,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_url_rules": op5_url_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_media_webp": op7_media_webp,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op5_url_rules": """
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(name, host, path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
j AS (
  SELECT u.page_id, u.host, u.path, r.name, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.name) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, name AS rule,
  coalesce(verdict, CASE WHEN list_has_any(regexp_split_to_array(host, '[^a-z0-9]+'), ['casino', 'pills', 'spam', 'viagra']) THEN 'block' ELSE 'allow' END) AS verdict
FROM j WHERE k = 1
""",
    "op11_conversation_trie": """
WITH o AS MATERIALIZED (
  SELECT c, sha256(strlen(r)::VARCHAR || ':' || r || t) AS k, strlen(t) AS b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || t)) AS i
  FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
-- crc32, bit by bit
h AS MATERIALIZED (
  SELECT c, max(i) AS own, c - c % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [256 + ascii(x)::UBIGINT, 512, 512, 512, 512, 512, 512, 512, 512]))),
      lambda s, x: CASE WHEN x < 512 THEN xor(s, x - 256) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384::UBIGINT) ELSE s >> 1 END), 4294967295::UBIGINT) % 9 AS h
  FROM o GROUP BY c),
t AS MATERIALIZED (
  SELECT h.c, o.i, o.k, o.b FROM h JOIN o ON o.c = h.base AND o.i <= h.h
  UNION ALL
  SELECT h.c, o.i - h.h + least(h.h, coalesce(g.own, 0)), o.k, o.b FROM h JOIN o ON o.c = h.c AND o.i > h.h LEFT JOIN h AS g ON g.c = h.base),
p AS MATERIALIZED (
  SELECT c, i AS d, sha256(string_agg(k, '' ORDER BY i) OVER (PARTITION BY c ORDER BY i)) AS x, b FROM t
  UNION ALL SELECT c, 0, '', 0 FROM h),
n AS MATERIALIZED (SELECT x, d, min(c) AS c, count(*) AS n, any_value(b) AS b FROM p GROUP BY x, d),
up AS MATERIALIZED (SELECT n.x, q.x AS above, q.d AS pos FROM n JOIN p AS q ON q.c = n.c AND q.d <= n.d),
kids AS (SELECT above AS x, count(*) AS kids FROM up JOIN n USING (x) WHERE pos = n.d - 1 GROUP BY 1),
sums AS (
  SELECT above AS x, sum((n.n - 1) * n.b) AS saved, count(*) FILTER (WHERE kids.kids IS NULL) AS leaves
  FROM up JOIN n USING (x) LEFT JOIN kids USING (x) GROUP BY 1),
ends AS (SELECT x, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(x, d) AS x FROM p GROUP BY c) GROUP BY x)
SELECT n.c AS conv_id, n.d AS depth, m.c AS parent_conv_id, n.n AS n_convs, coalesce(kids.kids, 0) AS n_children, sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM n JOIN sums USING (x) LEFT JOIN kids USING (x) LEFT JOIN ends USING (x)
  LEFT JOIN up ON up.x = n.x AND up.pos = n.d - 1 LEFT JOIN n AS m ON m.x = up.above AND m.d = up.pos
""",
    "op12_fill_in_middle": r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS i, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(i, j)::BIGINT], '') AS p, array_to_string(u[least(i, j)::BIGINT + 1:greatest(i, j)::BIGINT], '') AS m, array_to_string(u[greatest(i, j)::BIGINT + 1:], '') AS s
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
    "op13_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS MATERIALIZED (
  SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS MATERIALIZED (
  SELECT r, doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, min(doc_id) AS doc FROM k WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
g AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> f.doc AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM g GROUP BY r
""",
}
