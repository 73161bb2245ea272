"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.llm import align, byteident, merkle, minhash, mixing, pieces, pq, quality, quotes, sharding, topk, toxicity, warc
from linkloom.llm.common import table
from linkloom.llm.registry import ORACLES, QUERIES, query  # noqa: F401


@query("op1_toxicity")
def op1(spark, sf):
    return toxicity.scored_with_split(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_quality_classifier")
def op7(spark, sf):
    return quality.scored_with_split(table(spark, sf, "documents"), table(spark, sf, "labels"))


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op3_sentencepiece_coding")
def op3(spark, sf):
    out = pieces.encode_decode(table(spark, sf, "documents"), pieces.load(public_model()))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_source_mixing")
def op10(spark, sf):
    out = mixing.mix(table(spark, sf, "documents"), mixing.five_two_one)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op5_warc_round_trip", """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id < top THEN top END AS refers_to FROM p LEFT JOIN m USING (payload_digest)""")
def op5(spark, sf):
    def page(c):
        return F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("bigint")

    return warc.round_trip(table(spark, sf, "pages")).filter(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


@query("op6_sharding")
def op6(spark, sf):
    out = sharding.place(table(spark, sf, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"


@query("op4_exact_top_k", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op4(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_embedding_near_dedup", """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE """ + _USABLE + """ AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.a AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)""")
def op8(spark, sf):
    return pq.near_duplicates(table(spark, sf, "embeddings"))


@query("op2_minhash_near_dedup", r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY doc_id""")
def op2(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), width=2)


def quoted_mail(conversations):
    """Messages as mail programs send them: each turn below a quotation of the turn before, with what that one quotes.

    Ids are conv_id * 2^20 + turn; turns that are NULL or do not fit have the id NULL and are quoted by none. One turn of each
    number is quoted, should a conversation hold several.
    """
    ids = conversations.select(
        F.col("conv_id"), F.col("turn"), F.when(F.col("turn").between(0, (1 << 20) - 1), F.col("conv_id") * (1 << 20) + F.col("turn")).alias("message_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    before = ids.filter("message_id is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said")).withColumns({"_conv": F.col("conv_id"), "_turn": F.col("turn") + 1}).drop("conv_id", "turn")
    second = before.select("_conv", (F.col("_turn") + 1).alias("_turn"), F.col("said").alias("said2"))

    def marked(c, marks):
        return F.regexp_replace(c, "(?m)^", marks)

    history = before.join(second, ["_conv", "_turn"], "left").select(
        "_conv", "_turn",
        F.concat(marked(F.col("said"), "> "), F.coalesce(F.concat(F.lit("\n"), marked(F.col("said2"), ">> ")), F.lit("")), F.lit("\n\n")).alias("history"),
    )
    joined = ids.join(history, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return joined.select("conv_id", "turn", "message_id", F.concat(F.coalesce("history", F.lit("")), "text").alias("text"))


@query("op9_quotation_linking", r"""WITH RECURSIVE m AS (SELECT conv_id, turn, conv_id * 1048576 + turn AS message_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM conversations),
o AS (SELECT t, min(message_id) AS original FROM m WHERE t <> '' GROUP BY 1),
p AS (SELECT m.*, CASE WHEN original < m.message_id THEN original END AS parent_id FROM m LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1 LEFT JOIN o ON o.t = b.t),
up AS (SELECT message_id, message_id AS node, parent_id, 0 AS depth FROM p UNION ALL SELECT u.message_id, p.message_id, p.parent_id, u.depth + 1 FROM up u JOIN p ON p.message_id = u.parent_id),
r AS (SELECT message_id, node AS thread_id, depth FROM up WHERE parent_id IS NULL)
SELECT message_id, p.parent_id, thread_id, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY thread_id ORDER BY message_id) AS position, md5(t) AS own_md5
FROM p JOIN r USING (message_id)""")
def op9(spark, sf):
    out = quotes.link(quoted_mail(table(spark, sf, "conversations")))
    even = F.trim(F.regexp_replace(F.lower("own"), r"\s+", " "))
    return out.select("message_id", "parent_id", "thread_id", "depth", "position", F.md5(even).alias("own_md5"))


def _field(c):
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _leaf(text):
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc(text):
    """crc32 of an ASCII text: eight shifts for each byte."""
    shifts = "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END"
    return f"""xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::UBIGINT),
lambda a, b: list_reduce(range(8)::UBIGINT[], {shifts}, xor(a, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""


def _tree(name, nodes):
    """All levels above ``nodes`` (g, i, h, m), each node with what stands left and right of it among its siblings."""
    return f"""{name} AS (SELECT g, i, h, m, 0 AS level FROM {nodes} UNION ALL
SELECT g, i // 16, sha256(string_agg(h, '' ORDER BY i)), (m + 15) // 16, level + 1 FROM {name} WHERE m > 1 GROUP BY g, i // 16, (m + 15) // 16, level + 1),
{name}_sides AS (SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WINDOW w AS (PARTITION BY g, level, i // 16 ORDER BY i))"""


def _up(name, start, tree):
    return f"""{name} AS ({start} UNION ALL
SELECT f.id, f.g, f.i // 16, f.level + 1, f.m, f.sides || s.l || s.r, sha256(s.l || f.node || s.r)
FROM {name} f JOIN {tree}_sides s ON s.g = f.g AND s.level = f.level AND s.i = f.i WHERE s.m > 1)"""


@query("op11_merkle_manifest", f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || source, '') AS g, {_leaf("text")} AS leaf,
CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
leaves AS (SELECT g, i, leaf AS h, m FROM p),
{_tree("lv", "leaves")},
subs AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS m, g AS name FROM lv WHERE m = 1),
{_tree("sv", "subs")},
{_up("f", "SELECT i AS id, g, i, 0 AS level, m, '' AS sides, coalesce(changed, leaf) AS node FROM p", "lv")},
f1 AS (SELECT id, g, arg_max(sides, level) AS sides, arg_max(node, level) AS node FROM f GROUP BY ALL),
{_up("u", "SELECT f1.id || f1.g AS id, '' AS g, s.i, 0 AS level, s.m, f1.sides, f1.node FROM f1 JOIN subs s ON s.name = f1.g", "sv")},
u1 AS (SELECT id, arg_max(sides, level) AS sides, arg_max(node, level) AS node FROM u GROUP BY ALL)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM sv WHERE m = 1) AS root, sha256(sides) AS proof_sha256, node AS folded_root,
node = (SELECT h FROM sv WHERE m = 1) AS verified
FROM p JOIN u1 ON u1.id = p.i || p.g JOIN subs s ON s.name = p.g""")
def op11(spark, sf):
    return merkle.manifest(table(spark, sf, "documents")).drop("copied")


@query("op12_tokenizer_alignment")
def op12(spark, sf):
    import public_tokenizers

    a = align.ByteLevel.load(public_tokenizers.path("byte_bpe_50k.json"))
    return align.linked(table(spark, sf, "documents"), a, align.Pieces.load(public_model()))


@query("op13_language_id")
def op13(spark, sf):
    return byteident.identified_with_split(table(spark, sf, "documents"))
