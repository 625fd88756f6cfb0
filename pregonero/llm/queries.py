"""Queries opN_<name> over the test tables, and the SQL that a second engine checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    chat_format, decontamination, language_id, line_dedup, lm_scoring, mixing, quality_rules, ranked_search, secret_scan, simhash,
    token_alignment, token_files, url_filters,
)
from ..session import work_dir
from .store import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with check SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            CHECKS[f.__name__] = sql
        return f

    return add


@query()
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


_PHRASES = "|".join((
    "enable javascript", "javascript is disabled", "cookie policy", "use cookies", "accept cookies", "privacy policy", "terms of use",
    "terms of service", "all rights reserved", "skip to content", "read more", "sign in", "log in", "click here", "lorem ipsum",
))


@query(
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, i, list_slice(w, i, i + 4) AS win FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d) x),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) x WHERE c > 1) y GROUP BY r),
l AS (
  SELECT r, pos, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d) x),
m AS (
  SELECT r, pos, line, len(w) AS n, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS again,
    len(regexp_extract_all(line, '[|»›·]')) AS seps, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    list_sum(list_transform(w, lambda x: strlen(x))) AS bytes, len(regexp_extract_all(line, '\\p{{Lu}}')) AS capitals, len(regexp_extract_all(line, '\\p{{Ll}}')) AS smalls,
    len(list_filter(w, lambda x: ends_with(x, '!'))) AS cries, list_max(map_values(list_histogram(w))) AS most,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutter
  FROM l WHERE len(w) > 0),
f AS (
  SELECT *, CASE WHEN seps >= 3 AND 3 * seps >= n THEN 'navigation' WHEN symbols >= 3 AND 4 * symbols >= bytes THEN 'symbols'
    WHEN n >= 3 AND 10 * capitals >= length(line) AND capitals + smalls >= 10 AND 10 * capitals >= 7 * (capitals + smalls) THEN 'shouting'
    WHEN n >= 3 AND 2 * cries >= n THEN 'exclamation' WHEN n >= 5 AND (2 * most > n OR 3 * stutter >= n) THEN 'repeat'
    WHEN n <= 12 AND regexp_matches(lower(line), '(^|[^\\pL\\pN_])({_PHRASES})([^\\pL\\pN_]|$)') THEN 'boilerplate'
    WHEN n >= 40 AND NOT regexp_matches(line, '[.!?:;,”»]') THEN 'unpunctuated' END AS fault
  FROM m),
g AS (
  SELECT r, count(*) FILTER (again) AS n_dup_lines, count(fault) AS n_failed_lines, coalesce(sum(n) FILTER (fault IS NOT NULL), 0) AS lost_words,
    string_agg(DISTINCT fault, ',' ORDER BY fault) AS failed_rules FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (length(text) - len(regexp_extract_all(text, '[\\x20\\x09-\\x0D]')))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed,
  NOT (len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w)) AND coalesce(lost_words, 0) <= 0.3::DOUBLE * len(w) AS kept,
  coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost_words, 0)::BIGINT AS lost_words, coalesce(failed_rules, '') AS failed_rules
FROM d LEFT JOIN rep USING (r) LEFT JOIN g USING (r)
"""
)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], cleaned=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_failed_lines", "lost_words", "failed_rules",
    )


@query(
    """
WITH dw AS (
  SELECT doc_id, row_no, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents)),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT d.doc_id, d.row_no, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, row_no, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n) d),
hit AS (SELECT row_no, i, dwin.n, item_id FROM dwin JOIN win USING (win)),
cover AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM hit) GROUP BY row_no),
its AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS item FROM hit) GROUP BY row_no)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (row_no) LEFT JOIN its USING (row_no)
"""
)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decontamination.search(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def remainder(column: str, divisor: int):
    """crc32 of a value as text, modulo divisor; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.filter(~held_out & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang"))
    judged = language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query()
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    model = lm_scoring.fit(docs.filter(remainder("doc_id", 10) != 0).withColumnRenamed("doc_id", "id"))
    scored = lm_scoring.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"
    )


#: Rules of the contract, then the method's own list.
URL_RULES = [
    ("net/", "block", 0), ("example.net/en/", "allow", 0), ("example.com/de/", "block", 0), ("org/fr/", "allow", 0),
    *[(r, "block", 1) for r in url_filters.METHOD_BLOCKS],
]


@query(
    """
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
rules(rule, verdict, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
own(name) AS (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')),
found AS (
  SELECT p.page_id, p.host, p.path, p.url_no, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT *, row_number() OVER () AS url_no FROM parsed) p
  LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN path <> '' AND EXISTS (
  SELECT 1 FROM own WHERE regexp_matches(host, '(^|\\.)' || name || '\\.example\\.(com|net|org)$')) THEN 'block' ELSE 'allow' END) AS verdict
FROM found
"""
)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string, rank int")
    judged = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    given = F.array(*[F.lit(r) for r, _, rank in URL_RULES if rank == 0])
    return judged.select(
        "page_id", "host", "path", F.when(F.array_contains(given, F.col("rule")), F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


@query()
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "place", "value", "before", "label", "score", "is_secret")


@query(
    """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + escaped + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    records = chat_format.records_of_rows(rows.unionByName(extra))
    chats = chat_format.format_chats(chat_format.canonical_turns(records), "conv_id")
    back = chats.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "masked", chat_format.read_masked(F.col("formatted"), F.col("loss_mask"))
    )
    said_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_turns, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _mix_round(k: int) -> str:
    """A round of the mix: where the budget runs out and what is left."""
    return f"""e{k} AS (
  SELECT d.source, hash, rest, low, sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN s{k - 1} p ON d.source IS NOT DISTINCT FROM p.source WHERE rest > 0 AND hash > low AND size <= rest),
c{k} AS (
  SELECT source, min(hash) FILTER (upto > rest) AS edge, any_value(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS short FROM e{k} GROUP BY source),
t{k} AS (
  SELECT p.source, low, rest AS most, CASE WHEN edge IS NULL THEN 4611686018427387903 ELSE edge - 1 END AS high, edge, CASE WHEN edge IS NULL THEN 0 ELSE short END AS kept
  FROM s{k - 1} p LEFT JOIN c{k} c ON p.source IS NOT DISTINCT FROM c.source WHERE rest > 0),
s{k} AS (SELECT source, edge AS low, kept AS rest FROM t{k} WHERE kept > 0)"""


_MIX_ROUNDS = ",\n".join(_mix_round(k) for k in range(1, mixing.ROUNDS + 1))
_MIX_TAKEN = " OR ".join(f"(hash > t{k}.low AND hash <= t{k}.high AND size <= t{k}.most)" for k in range(1, mixing.ROUNDS + 1))
_MIX_JOINS = " ".join(f"LEFT JOIN t{k} ON d.source IS NOT DISTINCT FROM t{k}.source" for k in range(1, mixing.ROUNDS + 1))


@query(
    f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS share,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights_left
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, coalesce(least((SELECT arg_max(share, weights_left) FROM r WHERE share * weight <= 3 * source_size) * weight, (3 * source_size)::DOUBLE), 0) AS target FROM r),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS "full",
    floor(target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size)::BIGINT AS budget
  FROM t),
s0 AS (SELECT source, -1::BIGINT AS low, budget AS rest FROM b),
{_MIX_ROUNDS},
x AS (SELECT d.*, CASE WHEN {_MIX_TAKEN} THEN 1 ELSE 0 END AS more FROM d {_MIX_JOINS}),
u AS (SELECT b.source, budget - coalesce(sum(size) FILTER (more = 1), 0) AS rest FROM b JOIN x ON x.source IS NOT DISTINCT FROM b.source WHERE budget > 0 GROUP BY b.source, budget),
l AS (
  SELECT x.source, rest, arg_min(hash, {{'a': abs(size - rest), 'b': hash}}) AS last
  FROM x JOIN u ON x.source IS NOT DISTINCT FROM u.source WHERE more = 0 AND abs(size - rest) < rest GROUP BY x.source, rest),
z AS (
  SELECT l.source, last FROM l JOIN d ON d.source IS NOT DISTINCT FROM l.source AND d.hash = last GROUP BY l.source, last, rest HAVING abs(sum(size) - rest) < rest),
y AS (SELECT x.*, CASE WHEN more = 1 OR z.last = x.hash THEN 1 ELSE 0 END AS extra FROM x LEFT JOIN z ON x.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, size, b.source_size, target, least("full" + extra, 3)::BIGINT AS repeats, (size * least("full" + extra, 3))::BIGINT AS taken
FROM y JOIN b ON y.source IS NOT DISTINCT FROM b.source
"""
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query(
    """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
t AS (SELECT q, term, count(*) AS repeats FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY q, term),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term, n_docs),
g AS (
  SELECT p.r, p.term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(d.w) * n_docs) // n_terms))) AS gain
  FROM p JOIN f USING (term) JOIN d USING (r), s),
x AS (SELECT q, r, sum(gain * repeats)::BIGINT AS score FROM t JOIN g USING (term) GROUP BY q, r HAVING sum(gain * repeats) > 0),
o AS (SELECT q, r, d.doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d.doc_id, r) AS place FROM x JOIN d USING (r))
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM o JOIN i USING (q) WHERE place <= 20
"""
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = ranked_search.search(index, table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-files")
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_files.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path, f.read())
    back = token_files.read_ids(spark, path, table(spark, sf_dir, "documents").schema["doc_id"].dataType)
    digests = stage(back.select("doc_id", "shard", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-digests")
    return token_files.with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as a, open(vocabulary("piece_bpe_32k.model"), "rb") as b:
        aligned = token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), a.read(), b.read())
    return token_alignment.link_counts(aligned).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
