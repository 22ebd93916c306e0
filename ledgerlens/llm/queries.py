"""Registered queries of the subpackage (``opN_<name>``) and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import block_lstm, cdc, chosen_path, decontaminate, legacy_archive, line_runs, packing, prefix_free, quality_rules, rans
from . import secret_scan, spelling_groups, vector_codes
from . import common as C
from . import tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return register


def _byte_bpe() -> tokens.WordIds:
    return tokens.byte_level(public_tokenizers.path("byte_bpe_50k.json"))


def _word_bpe() -> tokens.WordIds:
    return tokens.word_level(public_tokenizers.path("word_bpe_49k.json"))


@query()
def op1_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = block_lstm.extract(C.table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(C.table(spark, sf_dir, "documents"), _byte_bpe)
    # the digests are taken before the join, so the ids themselves stay where they are
    digests = pieces.select("piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.sequences(digests, packing.place(pieces)).drop("piece")


#: Strips white space at both ends and lower-cases A-Z of a DuckDB column ``line``.
_SQL_KEY = """translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


@query(f"""
WITH lines AS (SELECT rowid AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
keyed AS (SELECT r, line, pos, {_SQL_KEY} AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.r, k.line, k.pos, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key),
folded AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT d.doc_id, f.n_lines, f.n_dropped, sha256(f.kept) AS kept_sha256
FROM (SELECT row_number() OVER () AS rowid, doc_id FROM documents) d JOIN folded f ON d.rowid = f.r""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.drop_frequent_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("_doc.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2("_doc.text", 256).alias("kept_sha256"))


_SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  coalesce('h' || source, 'none') AS host FROM documents),
w AS (SELECT *, {_SQL_WORDS.format('text')} AS words FROM d),
grams AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, host, doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, {_SQL_KEY} AS key, len({_SQL_WORDS.format('line')}) AS n FROM l),
real_lines AS (SELECT * FROM lw WHERE n > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM real_lines GROUP BY r),
common AS (SELECT host, key, min(doc_id) AS keeper FROM real_lines GROUP BY host, key HAVING count(DISTINCT r) > {quality_rules.MAX_DOCS}),
removed AS (SELECT x.r, sum(x.n) AS n FROM real_lines x JOIN common c ON x.host = c.host AND x.key = c.key
  WHERE x.doc_id IS DISTINCT FROM c.keeper GROUP BY x.r),
base AS (SELECT w.r, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
  coalesce(repeated.n, 0) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)),
judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= CAST({quality_rules.MIN_LEFT} AS DOUBLE) * n_words AS kept FROM judged""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(C.table(spark, sf_dir, "documents")).drop("_host", "_digest")


@query(rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (SELECT r, CASE WHEN len(w) < {chosen_path.SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {chosen_path.SHINGLE} + 2), lambda i: array_to_string(w[i : i + {chosen_path.SHINGLE - 1}], ' '))) END AS s
  FROM d WHERE len(w) > 0),
n AS (SELECT r, len(s) AS n FROM g),
s AS (SELECT r, hash(unnest(s)) AS h FROM g),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
pairs AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE {chosen_path.SIMILARITY[1]} * k >= {chosen_path.SIMILARITY[0]} * (x.n + y.n - k)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
class AS (SELECT reach.r, min(o.doc_id) AS class_id FROM reach JOIN d o ON o.r = reach.t GROUP BY ALL)
SELECT d.doc_id, class.class_id, (SELECT count(*) FROM links WHERE links.a = d.r) AS n_links FROM d JOIN class USING (r)""")
def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM f""")
def op5_legacy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = legacy_archive.scratch(spark, "arc"), legacy_archive.scratch(spark, "warc")
    legacy_archive.write_arc(C.table(spark, sf_dir, "pages"), arc)
    legacy_archive.convert(spark, arc, warc)
    records = C.saved(legacy_archive.read_warc(spark, warc).drop("block"), "warc-records")
    return legacy_archive.with_targets(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_ITEM_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM
  (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM
  (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.hits(docs, C.table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit("_spans")
    return out.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"),
                      F.size("_items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT *, unnest(generate_series(0, length(h) // 2 - 50)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM w JOIN f USING (g) WHERE low < coalesce(doc_id, 9223372036854775807)),
runs AS (SELECT r, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hit),
spans AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
cut AS (SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
  string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)""")
def op8_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_free.dedup_substrings(C.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["last"] - x["first"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op9_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.scratch(spark)
    rans.write_ids(C.table(spark, sf_dir, "documents"), _word_bpe, 2, path)
    digests = rans.read_ids(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return rans.with_starts(C.saved(digests, "decoded-ids")).drop("part", "segment")


@query()
def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cdc.dedup_chunks(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_chunks_removed"),
                      F.sha2("kept", 256).alias("kept_sha256"))


_SQL_CANDIDATE = f"{secret_scan.CANDIDATE}{{{min(c.window for c in secret_scan.CLASSES)},}}"


def _sql_matches(source: str, text: str, at: str, keep: str, pattern: str) -> str:
    """(keep, s, first) of the matches of a pattern: places follow from the pieces between the matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT {keep}, s, CAST({at} + sum(length(gap) + length(s)) OVER (PARTITION BY {keep} ORDER BY k) - length(s) AS BIGINT) AS first
  FROM (SELECT {keep}, {at}, unnest(found) AS s, unnest(gaps[1:len(found)]) AS gap, unnest(generate_series(1, len(found))) AS k
    FROM (SELECT {keep}, {at}, regexp_extract_all({text}, '{p}') AS found, string_split_regex({text}, '{p}') AS gaps FROM {source}) WHERE len(found) > 0)"""


def _secrets_sql() -> str:
    S = secret_scan
    quoted = S.ASSIGN.replace("'", "''")
    ctes = [f"""d AS (SELECT row_number() OVER () AS r, 0 AS zero, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT r, 0 AS kind, first, first + length(s) AS last FROM ({_sql_matches('d', 'text', 'zero', 'r', S.ASSIGN)})
    WHERE length(regexp_extract(s, '{quoted}', 2)) >= {S.MIN_ASSIGN}
  UNION ALL SELECT r, 1, first, first + length(s) FROM ({_sql_matches('d', 'text', 'zero', 'r', S.ACCESS)}) WHERE length(s) >= {S.MIN_ACCESS}
  UNION ALL SELECT r, 2, first, first + length(s) FROM ({_sql_matches('d', 'text', 'zero', 'r', S.HEX)}) WHERE length(s) >= {S.MIN_HEX}),
runs AS (SELECT r, first AS start, s AS run FROM ({_sql_matches('d', 'text', 'zero', 'r', _SQL_CANDIDATE)})
  WHERE NOT ({" OR ".join(f"regexp_matches(s, '{a}')" for a in S.ALLOWED)}))"""]
    taken = "SELECT r, first, last FROM base"
    for i, c in enumerate(S.CLASSES):
        inner = f"[{c.chars}]{{{c.window},}}"
        w = c.window
        ctes.append(f"""c{i} AS (SELECT r, first, s FROM ({_sql_matches('runs', 'run', 'start', 'r, start', inner)})),
w{i} AS (SELECT r, first, s, unnest(generate_series(0, length(s) - {w})) AS i FROM c{i}),
n{i} AS (SELECT r, first + i AS spot, ch, count(*) AS n FROM (SELECT r, first, i, unnest(string_split(substr(s, i + 1, {w}), '')) AS ch FROM w{i}) GROUP BY r, first, i, ch),
h{i} AS (SELECT r, spot FROM n{i} GROUP BY r, spot HAVING sum(CAST(round(n * log2(n) * 1000000) AS BIGINT)) <= {S.most_sum(w, c.min_bits)}),
g{i} AS (SELECT r, spot, sum(fresh) OVER (PARTITION BY r ORDER BY spot) AS island FROM
  (SELECT r, spot, CASE WHEN spot - lag(spot) OVER (PARTITION BY r ORDER BY spot) <= {w} THEN 0 ELSE 1 END AS fresh FROM h{i})),
j{i} AS (SELECT r, min(spot) AS first, max(spot) + {w} AS last FROM g{i} GROUP BY r, island),
f{i} AS (SELECT r, {len(S.BASE_KINDS) + i} AS kind, first, last FROM j{i} j
  WHERE NOT EXISTS (SELECT 1 FROM ({taken}) t WHERE t.r = j.r AND t.first < j.last AND j.first < t.last))""")
        taken += f" UNION ALL SELECT r, first, last FROM f{i}"
    kinds = [*S.BASE_KINDS, *(c.name for c in S.CLASSES)]
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(kinds)) + " END"
    line = f"string_agg({name} || ':' || first || ':' || last, ',' ORDER BY first, kind)"
    ctes.append(f"""b AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {line} AS spans FROM base GROUP BY r),
e AS (SELECT r, {line} AS spans FROM (SELECT * FROM base {"".join(f" UNION ALL SELECT * FROM f{i}" for i in range(len(S.CLASSES)))}) GROUP BY r)""")
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans FROM d LEFT JOIN b USING (r) LEFT JOIN e USING (r)"""


@query(_secrets_sql())
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    S = secret_scan
    out = S.scan(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("_doc.doc_id", S.n_of("assign").alias("n_assign"), S.n_of("access").alias("n_access"), S.n_of("hex").alias("n_hex"),
                      F.sha2(S.joined("_base"), 256).alias("base_sha256"), S.joined("_spans").alias("spans"))


def _codes_sql() -> str:
    V = vector_codes
    ctes = [f"""k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, i // (n // {V.PARTS}) AS part, i % (n // {V.PARTS}) AS pos, CAST(floor({V.SCALE} * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, v, len(v) AS n, unnest(generate_series(0, len(v) - 1)) AS i FROM k)),
b0 AS (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= {V.ENTRIES})"""]
    for t in range(V.ROUNDS + 1):
        ctes.append(f"""d{t} AS (SELECT r, x.part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN b{t} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL),
a{t} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * {V.ENTRIES} + entry) AS entry, min(d) AS d FROM d{t} GROUP BY r, part)""")
        if t < V.ROUNDS:
            ctes.append(f"""m{t} AS (SELECT x.part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM x JOIN a{t} a ON x.r = a.r AND x.part = a.part GROUP BY ALL),
b{t + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{t} b LEFT JOIN m{t} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    t = V.ROUNDS
    ctes.append(f"""f AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{t} GROUP BY r),
s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{t})""")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), s"""


@query(_codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.quantize(C.table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_error(coded)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                      F.lit(vector_codes.book_digest(books[-1])).alias("codebooks_sha256"))


#: CRC-32 of a DuckDB column ``s`` in UTF-8, by the table ``t`` of 256 remainders.
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(generate_series(1, octet_length(encode(s))), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])))"""


@query(f"""
WITH RECURSIVE rem AS (SELECT v AS b, 0 AS k, CAST(v AS BIGINT) AS c FROM (SELECT unnest(generate_series(0, 255)) AS v)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rem WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM rem WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
kinds AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM runs
  WHERE length(run) >= {spelling_groups.MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {_SQL_CRC} AS h FROM kinds, crc),
fated AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM fated WHERE length(word) >= {spelling_groups.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling_groups.MIN_COUNT}),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(generate_series(0, length(word) - 1)) AS i FROM v)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.rest = b.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY a),
picked AS (SELECT p.a, min(p.b) AS form, any_value(n_near) AS n_near, any_value(most) AS most FROM pairs p JOIN best USING (a) WHERE p.n = most GROUP BY p.a),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling_groups.MIN_RATIO} * v.n THEN form END AS form,
  CASE WHEN most >= {spelling_groups.MIN_RATIO} * v.n THEN most END AS form_n FROM v LEFT JOIN picked ON v.word = picked.a),
walk AS (SELECT word, form AS tip, 1 AS k FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN formed f ON walk.tip = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(tip, k) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, coalesce(root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends USING (word)""")
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_groups.noisy_words(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_groups.group(spelling_groups.vocabulary(words))
