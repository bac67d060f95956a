"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestegg.llm.collocations import collocations
from nestegg.llm.common import held_out, labelled_documents, read_table, sha256_joined
from nestegg.llm.decontaminate import contamination
from nestegg.llm.language import learn_models, with_language
from nestegg.llm.lexical_search import search
from nestegg.llm.mixing import mix, taken_words
from nestegg.llm.neighbours import nearest_neighbours
from nestegg.llm.quality import with_quality
from nestegg.llm.secret_scan import learn_network, with_secrets
from nestegg.llm.simhash import near_duplicates
from nestegg.llm.suffix_dedup import deduplicated
from nestegg.llm.toxicity import SAMPLE_ROWS as TOXICITY_ROWS
from nestegg.llm.toxicity import learn_lexicon, with_toxicity
from nestegg.llm.url_filter import Rule, judged
from nestegg.llm.warc import round_trip

URL_RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]
#: Hosts are listed that have one of these labels.
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken_words(mix(docs, weights=[3, 1, 2], share=1.5, max_repeat=2))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256_joined(F.array_sort("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200, keep_text=False)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4, 2))
    return with_quality(docs, labels).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = learn_models(docs.filter(~held_out("doc_id", 4, 2)))
    return with_language(docs.select("doc_id", "text"), models).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_secrets(docs, learn_network(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != "model")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    lexicon = learn_lexicon(labelled_documents(docs, labels, "toxic", TOXICITY_ROWS))
    return with_toxicity(docs, lexicon).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, read_table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    return collocations(docs, min_count=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_neighbours": op2_neighbours,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_search": op11_search,
    "op12_warc": op12_warc,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATE_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM phrases),
found AS (
  SELECT row_id, i, n, item FROM (
    SELECT row_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i))
  JOIN phrases USING (n, phrase)),
hits AS (SELECT row_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS t(j) GROUP BY row_id),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row_id, item FROM found WHERE item IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)
"""


def _url_sql() -> str:
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    longest = sorted(URL_RULES, key=lambda r: -len(r.host + r.path))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.host + r.path}'" for r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in longest)
    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parts AS (SELECT page_id, {_LOWER.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_SEARCH_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce({_TERMS}, []) AS w FROM documents),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w)) AS n_words FROM docs),
items AS (SELECT row_number() OVER () AS item_row, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
words AS (SELECT row_id, len(w) AS n, unnest(w) AS term FROM docs),
tfs AS (SELECT row_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, corpus GROUP BY term),
impacts AS (
  SELECT row_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // CAST(n_words AS BIGINT)))) AS impact
  FROM tfs JOIN weights USING (term), corpus),
scores AS (
  SELECT item_row, item_id, row_id, CAST(sum(impact) AS BIGINT) AS score
  FROM items JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN docs USING (row_id)
QUALIFY rank <= 10
"""

_WARC_SQL = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM payloads)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""

_COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, w[i:i + s - 1] AS w FROM (
    SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM words, unnest(range(1, 6)) AS t(s) WHERE len(w) >= s)),
counts AS (SELECT lang, w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM counts WHERE len(w) > 1),
inside AS (
  SELECT DISTINCT lang, w[i:j] AS part, f FROM (
    SELECT lang, w, f, i, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w))) AS i FROM candidates))
  WHERE j - i + 1 < len(w)),
kept AS (
  SELECT lang, w, f FROM candidates
  WHERE NOT EXISTS (FROM inside WHERE inside.lang = candidates.lang AND inside.part = candidates.w AND 100 * inside.f >= 100 * candidates.f)),
cuts AS (SELECT lang, w, f AS a, unnest(range(1, len(w))) AS k FROM kept),
scores AS (
  SELECT cuts.lang, cuts.w, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM (
    SELECT *, w[1:k] AS x_w, w[k + 1:] AS y_w FROM cuts) AS cuts
  JOIN counts AS x ON x.lang = cuts.lang AND x.w = x_w JOIN counts AS y ON y.lang = cuts.lang AND y.w = y_w JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase,
  a, l, r, n, CAST(score AS BIGINT) AS score
FROM weakest QUALIFY rank <= 2000
"""

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": _DECONTAMINATE_SQL, "op5_url_filter": _url_sql(), "op11_search": _SEARCH_SQL, "op12_warc": _WARC_SQL, "op13_collocations": _COLLOCATIONS_SQL}
