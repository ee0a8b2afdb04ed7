"""The queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, language, line_dedup, mixing, near_dedup, secret_scan, sharding, token_count, token_file, topk, url_filter, vector_codes
from .common import materialise, read


def fold(doc_id: str = "doc_id"):
    """Rows with 0 are held out from fitting; null for a null id, which is neither held out nor learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialise(near_dedup.with_fingerprint(docs).drop("text"), "fingerprints")
    return near_dedup.near_groups(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


#: The site rules, and patterns for what no site rule covers.
URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
    url_filter.Rule("block", "advert-host", r"^ads\."),
    url_filter.Rule("block", "advert-path", r"/ads/"),
    url_filter.Rule("block", "login", r"/login/"),
    url_filter.Rule("block", "script-folder", r"/cgi-bin/"),
    url_filter.Rule("block", "archive", r"\.(?:zip|exe|iso)$"),
    url_filter.Rule("block", "bare-listing", r"/[a-z][a-z]/[0-9]+/$"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
j AS (SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
        regexp_matches(p.host || p.path, '^ads\.|/ads/|/login/|/cgi-bin/|\.(?:zip|exe|iso)$|/[a-z][a-z]/[0-9]+/$') AS junk,
        row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS n
      FROM p LEFT JOIN r ON (p.host = split_part(r.rule, '/', 1) OR p.host LIKE '%.' || split_part(r.rule, '/', 1))
        AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN junk THEN 'block' ELSE 'allow' END) AS verdict FROM j WHERE n = 1
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold() != 0))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"), "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    found = line_dedup.line_decisions(docs, "uid")
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.digest(secret_scan.scan_secrets(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


#: mixing.mix's defaults: weights are square roots of row counts, as whole numbers out of about 720; 16
#: rows a block, 16 blocks a bucket; every source a class of its own (the operator's, up to 512).
OP5_SQL = """
WITH RECURSIVE k AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key,
    coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 0) AS hash FROM documents),
g AS (SELECT key AS class, count(*) AS n FROM k GROUP BY 1),
s AS (SELECT class, n, greatest(1, round(sqrt(n) / sum(sqrt(n)) OVER () * 720))::BIGINT AS share,
    row_number() OVER (ORDER BY class) - 1 AS i FROM g),
one AS (SELECT list(share ORDER BY i) AS shares, sum(share)::BIGINT AS period FROM s),
run(t, pick, done) AS (
  SELECT -1::BIGINT, -1::BIGINT, list_transform(shares, lambda x: 0::BIGINT) FROM one
  UNION ALL
  SELECT t + 1, p, list_transform(done, lambda x, j: CASE WHEN j = p + 1 THEN x + 1 ELSE x END) FROM (
    SELECT t, done, list_min(list_filter(list_transform(done, lambda x, j:
        CASE WHEN x < shares[j] AND x * period // shares[j] <= t + 1
             THEN ((x + 1) * period + shares[j] - 1) // shares[j] * 100000 + j - 1 END), lambda y: y IS NOT NULL)) % 100000 AS p, period
    FROM run, one WHERE t + 1 < period)),
turns AS (SELECT pick AS i, t AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM run WHERE t >= 0),
d AS (SELECT k.doc_id, k.source, s.class, s.share, s.i, k.hash, k.hash % ceil(s.n / 256)::BIGINT AS bucket
      FROM k JOIN s ON s.class = k.key),
q AS (SELECT *, row_number() OVER (PARTITION BY class, bucket ORDER BY hash, doc_id) - 1 AS j FROM d),
b AS (SELECT class, bucket, sum(k) OVER (PARTITION BY class ORDER BY bucket) - k AS before
      FROM (SELECT class, bucket, ceil(count(*) / 16)::BIGINT AS k FROM d GROUP BY 1, 2)),
n AS (SELECT q.*, (before + j // 16)::BIGINT AS block FROM q JOIN b USING (class, bucket))
SELECT doc_id, source, n.class AS mix_class, block AS mix_block, block * period // share AS mix_release,
  ((block + 1) * period + share - 1) // share AS mix_deadline, block // share * period + place AS mix_slot, (j % 16)::INTEGER AS mix_place
FROM n JOIN turns ON turns.i = n.i AND turns.turn = block % share, one
"""


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    sized = docs.select("doc_id", "source", "lang", sharding.size_of("text").alias("size"), crc.alias("text_crc32"))
    return sharding.curve_shards(sized, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.encode(read(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _op11_sql() -> str:
    steps = ["""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, len(embedding) // 8 AS d,
    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
    "p AS MATERIALIZED (SELECT r, vec_id, label, k, v[k * d + 1 : (k + 1) * d] AS part FROM v, range(8) t(k))",
    "b0 AS MATERIALIZED (SELECT k, r - 1 AS j, part AS entry FROM p WHERE r <= 16)"]
    for i in range(7):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, label, k, part, min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + j) AS m
    FROM p JOIN b{i} USING (k) GROUP BY ALL)""")
        if i < 6:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT k, j, coalesce(moved, entry) AS entry FROM b{i} LEFT JOIN (
    SELECT k, j, list(mean ORDER BY c) AS moved FROM (SELECT k, m % 16 AS j, c, floor(sum(part[c]) / count(*))::BIGINT AS mean
        FROM a{i}, range(1, 100) t(c) WHERE c <= len(part) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (k, j))""")
    return f"""WITH {", ".join(steps)},
e AS (SELECT vec_id, label, string_agg(printf('%02x', m % 16), '' ORDER BY k) AS code, sum(m // 16)::BIGINT AS error FROM a6 GROUP BY r, vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h"""


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_file.fresh_path(spark)
    token_file.write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path, end=2)
    return token_file.read_tokens(spark, path, digest=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversation_repair.as_rows(*conversation_repair.damage(conversations))
    plans = conversation_repair.plans(rows)
    found = plans.join(conversation_repair.hashes(conversation_repair.repaired(rows, plans)).withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _op13_sql() -> str:
    """States 0 to 3 hold the best {c: cost, a: audit, t: text} so far; s, u and a are the columns of a row."""

    def add(state: str, cost: str, edit: str, line: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} END"

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    inserts_u = best("s2", *(add(f"s{k}", "3", "I", user) for k in (0, 1, 3)))
    inserts_a = best("s3", add("s2", "3", "I", assistant))
    more, own = "3 * (fault = 'truncated')::BIGINT", "chr(10) || role || ':' || text"
    stays = "CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {} END"
    keep = "CASE WHEN initial = '{}' THEN {} END"
    gone = [add(f"s{k}", "4", "D", "''") for k in range(4)]
    to_u = [x for k in (0, 1, 3) for x in (stays.format(keep.format("u", add(f"s{k}", more, "K", own))), stays.format(add(f"s{k}", f"3 + {more}", "R", f"{user} || text")))]
    to_a = [stays.format(keep.format("a", add("s2", more, "K", own))), stays.format(add("s2", f"3 + {more}", "R", f"{assistant} || text"))]
    to_s = [stays.format(keep.format("s", add("s0", more, "K", own)))]

    def closed(rows: str) -> str:
        return f"SELECT * REPLACE ({inserts_a} AS s3) FROM (SELECT * REPLACE ({inserts_u} AS s2) FROM ({rows}))"

    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
m AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS mark FROM k, tab),
d AS (SELECT conv_id, turn, CASE mark WHEN 4 THEN 'user' ELSE role END AS role, CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM m, range(2) r(copy) WHERE mark <> 0 AND (copy = 0 OR mark = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM d),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, n, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed,
    CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
         WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM f) GROUP BY conv_id),
walk(conv_id, n, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) FROM c
  UNION ALL
  SELECT conv_id, n, {gone[0]}, {best(gone[1], *to_s)}, {best(gone[2], *to_u)}, {best(gone[3], *to_a)}
  FROM ({closed("SELECT w.conv_id, f.n, role, text, initial, fault, s0, s1, s2, s3 FROM walk w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1")})),
done AS (SELECT conv_id, {best("s0", "s3")} AS b FROM ({closed("SELECT walk.* FROM walk JOIN c ON walk.conv_id IS NOT DISTINCT FROM c.conv_id AND walk.n = c.rows")}))
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON i.conv_id IS NOT DISTINCT FROM done.conv_id
"""


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_token_counts": op7_token_counts,
    "op8_url_filter": op8_url_filter,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_file": op12_token_file,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL = {"op5_mix_sources": OP5_SQL, "op8_url_filter": OP8_SQL, "op9_exact_top_k": OP9_SQL, "op11_vector_codes": _op11_sql(), "op13_conversation_repair": _op13_sql()}
