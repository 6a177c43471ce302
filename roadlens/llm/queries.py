"""The registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, jaccard_join, line_dedup, lsh_forest, mixing, periodic_runs, quality_classifier, quality_rules, sharding, spotsigs, token_counts, toxicity
from .common import stored, table, word_count

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_WORDS = r"'[^\x20\x09-\x0D]+'"
_RULE_BITS = " + ".join(f"CASE WHEN {cond} THEN {quality_rules.bit(r)} ELSE 0 END" for r, cond in quality_rules.RULES.items())

_OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
  FROM w LEFT JOIN covered c USING (doc_id)),
f AS (SELECT *, ({_RULE_BITS})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper_words, failures,
       (failures & {quality_rules.mask(quality_rules.POLICIES['base'])}) <> 0 AS base_failed,
       (failures & {quality_rules.mask(quality_rules.POLICIES['v1'])}) = 0 AS kept
FROM f
"""


@_query("op4_quality_rules", _OP4_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "failures",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"),
    )


def _mix_sql(docs: str = "documents") -> str:
    return rf"""
WITH d AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)::BIGINT) AS cls,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {mixing.SPREAD} AS spread
  FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM {docs})),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) AS rk FROM per),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt, source_size * {mixing.MAX_REPEAT}::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / wt AS full_at,
         (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
           / sum(wt) OVER (ORDER BY cap / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
t AS (
  SELECT source, source_size, CASE WHEN rk_at IS NULL THEN cap ELSE rk_at * wt END AS target
  FROM (SELECT *, first_value(CASE WHEN level <= full_at THEN level END IGNORE NULLS) OVER (ORDER BY full_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk_at FROM levels)),
c AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY cls, spread, size, doc_id NULLS LAST) AS upto,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""


_OP5_SQL = _mix_sql() + r"""
SELECT doc_id, size, source_size, target, ((floor(rate * upto + u) - floor(rate * (upto - 1) + u))::BIGINT * size)::BIGINT AS taken,
       (floor(rate * upto + u) - floor(rate * (upto - 1) + u))::BIGINT AS copies
FROM c
"""


@_query("op5_mix_sources", _OP5_SQL.replace(" COLLATE C", ""))
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    plan = mixing.copies_plan(sizes)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


_OP6_SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS hs FROM l),
r AS (SELECT *, hs * {line_dedup.BASE} + coalesce(lead(hs) OVER (PARTITION BY doc_id ORDER BY i), 0) AS rolling FROM h),
b AS (
  SELECT *, CASE WHEN i BETWEEN 2 AND n - 2 AND rolling < lag(rolling) OVER w AND rolling <= lead(rolling) OVER w THEN 1 ELSE 0 END AS cut
  FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM b),
ch AS (SELECT doc_id, no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY doc_id, no),
p AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, no) > 1 AS repeat
  FROM ch WHERE n_lines > 1 AND regexp_matches(body, {_WORDS})),
lost AS (SELECT doc_id, no FROM p WHERE repeat),
pairs AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM l),
q AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS repeat
  FROM pairs WHERE body IS NOT NULL AND regexp_matches(body, {_WORDS})),
g AS (
  SELECT doc_id, i FROM k JOIN lost USING (doc_id, no)
  UNION SELECT doc_id, i + j FROM q, (SELECT unnest([0, 1]) AS j) WHERE repeat),
m AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g USING (doc_id, i)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
a AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines,
         count(*) FILTER (WHERE gone) AS n_removed_lines, count(*) FILTER (WHERE opens) AS n_removed_passages
  FROM e GROUP BY doc_id),
w AS (SELECT doc_id, count(*) AS n_removed_chunks FROM lost GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_removed_chunks, 0)::BIGINT AS n_removed_chunks,
       coalesce(n_removed_passages, 0)::BIGINT AS n_removed_passages
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN w USING (doc_id)
"""


@_query("op6_line_dedup", _OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


_PASSAGES_SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM l),
q AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS repeat
  FROM p WHERE body IS NOT NULL AND regexp_matches(body, {_WORDS})),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM q, (SELECT unnest([0, 1]) AS k) WHERE repeat),
m AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g USING (doc_id, i)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
a AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines,
         count(*) FILTER (WHERE gone) AS n_removed_lines, count(*) FILTER (WHERE opens) AS n_removed_passages
  FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_removed_passages, 0)::BIGINT AS n_removed_passages
FROM documents LEFT JOIN a USING (doc_id)
"""


@_query("passage_dedup", _PASSAGES_SQL)
def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op10_shards")
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer(spark: SparkSession, file: str = "byte_bpe_50k.tiktoken") -> bpe.BPE:
    import public_tokenizers

    return bpe.BPE(spark, public_tokenizers.path(file), public_tokenizers.PATTERN)


@_query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenizer(spark)
    encoded = table(spark, sf_dir, "documents").select("doc_id", tok.round_trip().alias("e"))
    return encoded.select(
        "doc_id", F.size("e.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("e.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("e.decoded", 256).alias("decoded_sha256"),
    )


@_query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.suffix_sums(stored(token_counts.length_histogram(docs, tokenizer(spark).count()), "lengths"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components_sql(docs: str = "documents", width: int = jaccard_join.WIDTH, percent: int = jaccard_join.PERCENT) -> str:
    return rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS ws FROM {docs}),
sh AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))) END) AS g
  FROM w),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM common JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y
  WHERE 100 * k >= {percent} * (p.n + q.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT DISTINCT x AS doc_id, x AS seen FROM edge
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.seen)
"""


_OP9_SQL = f"""
WITH RECURSIVE {_components_sql()}
SELECT d.doc_id, coalesce(any_value(sz.n), 0)::BIGINT AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id
FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id
"""


@_query("op9_ngram_jaccard", _OP9_SQL)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The chain's categories, from the labels: toxic in junk, toxic in good prose, and at last toxic at all.
TOXIC_CATEGORIES = {
    "in_junk": "toxic = 1 AND quality = 0",
    "in_prose": "toxic = 1 AND quality = 1",
    "any": "toxic = 1",
}


@_query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", *[F.expr(f"CAST({c} AS INT)").alias(k) for k, c in TOXIC_CATEGORIES.items()])
    return toxicity.score(docs, toxicity.train(docs, labels, list(TOXIC_CATEGORIES))).drop("text")


@_query("op3_spotsigs")
def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Graded rating from the labels: 0 junk, 1 good prose that is toxic, 2 good prose.
GRADE = "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END"


@_query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").dropna(subset=["quality", "toxic"]).select("doc_id", F.expr(GRADE).alias("grade"))
    return quality_classifier.grade(docs, quality_classifier.train(docs, ratings, n_grades=3)).drop("text")


def echo_tail(key: str | None, words: list) -> list:
    """Words whose tail repeats, for one id in ten (by the checksum of its digits); others, and rows without an id, as they are."""
    h = 1 if key is None else zlib.crc32(key.encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


@_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), echo_tail).drop("text")
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best,
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


_OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {collocations.LEAST}),
inner_ AS (
  SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM q))),
around AS (SELECT lang, phrase, max(f) AS m FROM inner_ GROUP BY ALL),
c AS (SELECT q.* FROM q LEFT JOIN around USING (lang, phrase) WHERE around.m IS NULL OR 100 * around.m < 100 * q.f),
cut AS (SELECT *, unnest(range(1, k)) AS cut_at FROM c),
s AS (
  SELECT cut.lang, cut.phrase, cut.f AS a, cut_at, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * cut.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN t ON t.lang = cut.lang
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:cut_at], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[cut_at + 1:], ' ')),
least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
  FROM least) WHERE rank <= {collocations.TOP}
"""


@_query("op12_collocations", _OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_OP11_SQL = f"""
WITH RECURSIVE {_components_sql("documents", lsh_forest.WIDTH, lsh_forest.PERCENT)}
SELECT d.doc_id, coalesce(any_value(sz.n), 0)::BIGINT AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id, d.doc_id = coalesce(min(r.seen), d.doc_id) AS kept
FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id
"""


@_query("op11_lsh_forest", _OP11_SQL)
def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_RULE_FAILS = "\nUNION ALL ".join(
    f"SELECT 'v1' AS policy, '{r}' AS rule, count(*) AS n_docs, count(*) FILTER (WHERE failures & {quality_rules.bit(r)} <> 0) AS n_failed, "
    f"count(*) FILTER (WHERE failures & {quality_rules.mask(quality_rules.POLICIES['v1'])} = 0) AS n_kept, "
    f"count(*) FILTER (WHERE failures & {quality_rules.mask(quality_rules.POLICIES['v1']) - quality_rules.bit(r)} = 0) AS n_kept_without FROM led"
    for r in quality_rules.POLICIES["v1"])


@_query("quality_ablations", f"WITH led AS ({_OP4_SQL})\nSELECT * FROM ({_RULE_FAILS}) WHERE n_docs > 0")
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, and what would be kept without it."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v1")
