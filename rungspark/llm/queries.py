"""The queries of this subpackage over the synthetic tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, decontaminate, jaccard, langid, mixing, ngram, quality, repeats, secrets, sharding, tokens, veccodes
from .common import crc_mod, read


def op1_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    vectors, idf = quality.word_vectors(docs)
    network = quality.fit(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0), vectors, idf)
    out = quality.scored(docs, network, vectors, idf)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every whole text, then applies two edits to it (places from a hash of the id) and updates the counts."""
    counted = tokens.trees(read(spark, sf_dir, "documents"))
    edit = lambda k, words: F.struct(
        F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length(F.coalesce("text", F.lit(""))) + 1).alias("start"),
        (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length(F.coalesce("text", F.lit(""))) + 1) + F.pmod(F.xxhash64("doc_id", F.lit(k + 100)), F.lit(60))).alias("stop"),
        F.lit(words).alias("insert"),
    )
    out = tokens.with_edits(counted.withColumn("edits", F.array(edit(1, " a corrected phrase"), edit(2, ""))))
    return out.select("doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "chars_encoded", F.size("leaf_tokens").alias("n_leaves"))


def op3_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version")
    )


def op4_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = crc_mod(F.col("doc_id"), 4)
    dictionaries = langid.fit(docs.filter(remainder != 2))
    found = langid.classify(docs, dictionaries)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = ngram.scored(docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) != 2).alias("train")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes_of(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(read(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.filter(F.pmod("id", F.lit(20)) == 0))


def op11_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = veccodes.coded(veccodes.usable(read(spark, sf_dir, "embeddings")))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["nth"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE], F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op13_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(read(spark, sf_dir, "documents"))
    return found.select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "score", "n")


OP9_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most FROM s),
x AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w),
f AS (SELECT min_by((total - capped) / rest, most / weight) AS final FROM x WHERE (total - capped) / rest <= most / weight),
p AS (SELECT source, source_size, least(most, weight * final) AS target, CASE WHEN source_size > 0 THEN least(least(most, weight * final) / source_size, 3.0) ELSE 0 END AS rate FROM x, f),
u AS (SELECT d.doc_id, d.source, d.size, k.seed, CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '#' || k.seed), 1, 8) AS BIGINT) / 4294967296.0 AS u
      FROM d, (SELECT unnest(range(32)) AS seed) k),
c AS (SELECT u.*, p.source_size, p.target, floor(p.rate) + CASE WHEN u.u < p.rate - floor(p.rate) THEN 1 ELSE 0 END AS copies FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM (SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS off FROM c GROUP BY source, seed) GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.copies * c.size AS BIGINT) AS taken, CAST(c.copies AS BIGINT) AS copies
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.seed = b.seed
"""

# Every pair of documents that share a shingle is counted, so this is for small tables. Shingles are lists of words.
OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)), u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS node, x AS seen FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

# Bytes as pairs of hexadecimal digits; every string of 200 bytes is listed, so this is for small tables.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), e AS (SELECT doc_id, j, substr(h, 2000 * j + 1, 2398) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS j FROM d)),
s AS (SELECT doc_id, i, md5(substr(h, 2 * o + 1, 400)) AS k FROM (SELECT doc_id, 1000 * j + o AS i, o, h FROM (SELECT doc_id, j, h, unnest(range(0, least(greatest(len(h) // 2 - 199, 0), 1000))) AS o FROM e))),
t AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1), c AS (SELECT doc_id, i FROM s SEMI JOIN t USING (k)),
m AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM c),
x AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY doc_id, g),
y AS (SELECT x.doc_id, a, b, h, coalesce(lag(b) OVER (PARTITION BY x.doc_id ORDER BY a), 0) AS before FROM x JOIN d USING (doc_id)),
z AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, (2 * (a - before))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS kept FROM y GROUP BY 1)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)
"""

# Six rounds, written out. Integer division rounds to zero in this dialect, so remainders are taken off first.
_OP11_START = """
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[8 * part + 1:8 * part + 8] AS x FROM (SELECT *, unnest(range(8)) AS part FROM v)),
c0 AS MATERIALIZED (SELECT part, entry - 1 AS entry, x FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS entry FROM p) WHERE entry <= 16),
"""
_OP11_ROUND = """
a{0} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min(b)[1]::BIGINT AS error, min(b)[2] AS entry
  FROM (SELECT p.*, [list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.entry] AS b FROM p JOIN c{0} c USING (part)) GROUP BY vec_id, label, part),
s{0} AS (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, 9)) AS i FROM a{0}) GROUP BY part, entry, i),
m{0} AS (SELECT part, entry, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM s{0} GROUP BY part, entry),
c{1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN m{0} m USING (part, entry)),
"""
_OP11_END = """
e AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a6 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM e, h
"""
OP11_SQL = "WITH" + _OP11_START + "".join(_OP11_ROUND.format(k, k + 1) for k in range(7)) + _OP11_END.lstrip()


def _op12_sql() -> str:
    """Where a match lies follows from the lengths of the matches before it and of what lies between them."""
    either = lambda words: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)
    patterns = {r.kind: r.pattern for r in secrets.RULES}
    names = "password|passwd|secret|token|api_?key"
    patterns["assign"] = patterns["assign"].replace(names, "|".join(map(either, names.split("|"))))
    patterns["bearer"] = patterns["bearer"].replace("bearer", either("bearer"))
    one = """SELECT doc_id, {nth} AS nth, '{kind}' AS kind, m[i] AS m, g[i] AS g, list_sum(list_transform(b[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS b FROM d)) WHERE len(g[i]) >= {least}"""
    every = " UNION ALL ".join(one.format(nth=i, kind=r.kind, p=patterns[r.kind].replace("'", "''"), group=r.group, least=r.least) for i, r in enumerate(secrets.RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({every}), s AS (SELECT *, kind || ':' || start || ':' || (start + len(m)) AS span FROM f),
    x AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)}, string_agg(span, ',' ORDER BY start, nth) AS spans, string_agg(span, ',' ORDER BY start, nth) FILTER (nth < 3) AS base FROM s GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (doc_id)"""


OP12_SQL = _op12_sql()

OP13_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, u.f AS l, v.f AS r FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = f2.lang AND t.x = f2.x AND t.y = f2.y AND 100 * t.f >= 50 * f2.f) AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = f2.lang AND t.y = f2.x AND t.z = f2.y AND 100 * t.f >= 50 * f2.f)),
c3 AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, u.f AS l1, v.f AS r1, i.f AS l2, j.f AS r2 FROM f3 t JOIN f1 u ON u.lang = t.lang AND u.x = t.x JOIN f2 v ON v.lang = t.lang AND v.x = t.y AND v.y = t.z
  JOIN f2 i ON i.lang = t.lang AND i.x = t.x AND i.y = t.y JOIN f1 j ON j.lang = t.lang AND j.x = t.z),
s AS (SELECT lang, phrase, a, l, r, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN q1 <= q2 THEN l1 ELSE l2 END, CASE WHEN q1 <= q2 THEN r1 ELSE r2 END, least(q1, q2) FROM (SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS q1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS q2 FROM c3))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s) JOIN n USING (lang) WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_network": op1_quality_network,
    "op2_edit_token_counts": op2_edit_token_counts,
    "op3_slot_sharding": op3_slot_sharding,
    "op4_zstd_language": op4_zstd_language,
    "op5_deleted_interpolation": op5_deleted_interpolation,
    "op6_bucket_refinement": op6_bucket_refinement,
    "op7_latent_decontamination": op7_latent_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_source_mixing": op9_source_mixing,
    "op10_collision_ann": op10_collision_ann,
    "op11_segment_mean_codes": op11_segment_mean_codes,
    "op12_blob_ledger": op12_blob_ledger,
    "op13_pair_naming": op13_pair_naming,
    "pipeline": pipeline,
}
ORACLES = {
    "op6_bucket_refinement": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op9_source_mixing": OP9_SQL, "op11_segment_mean_codes": OP11_SQL, "op12_blob_ledger": OP12_SQL,
    "op13_pair_naming": OP13_SQL,
}
