"""One query per operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cropline.llm.common import read
from cropline.llm.exact_dedup import resolve_copies
from cropline.llm.lexical import rank_documents
from cropline.llm.line_dedup import MIN_LINES, MIN_WORDS, line_dedup
from cropline.llm.mixing import mix_sources
from cropline.llm.pieces import encode_texts
from cropline.llm.prefix_trie import SharedHeads, conversation_trie
from cropline.llm.rules import fit_rules, score_quality
from cropline.llm.secret_scan import scan_secrets
from cropline.llm.sharding import SHARDS, SLOTS, fill_table, place
from cropline.llm.simhash import near_groups
from cropline.llm.topk import top_k
from cropline.llm.toxicity import fit_severity, score_severity
from cropline.llm.url_filter import Rule, canonical, host_and_path, judge_urls

# The tokenizer's model; rules of the URL contract, host labels whose pages are listed.
MODEL = "piece_bpe_32k.model"
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier place has."""
    cleaned = line_dedup(read(spark, sf_dir, "documents"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return cleaned.select("doc_id", "lines", "removed_lines", sha)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; listed are the URLs of hosts with a listed label."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = host_and_path("url")
    listed = pages.filter(F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in LISTED_LABELS])))
    judged = judge_urls(pages, listed.select(canonical("url").alias("url")), URL_RULES)
    return judged.select(F.col("_id").alias("page_id"), "host", "path", "rule", "verdict", "canonical", "listed")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document and the layers encoded in it."""
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
        "layers",
        "skipped_layers",
    )


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    groups = near_groups(read(spark, sf_dir, "documents"))
    text = F.lpad(F.lower(F.hex("_fp")), 16, "0")
    return groups.select(F.col("_id").alias("doc_id"), text.alias("fingerprint"), "component_id")


def pieces_of(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Number and digest of every document's ids, and digest of what they decode to.

    ``with_ids`` adds the ids themselves, as little-endian unsigned 32-bit integers.
    """
    coded = encode_texts(docs, public_tokenizers.path(MODEL))
    return coded.select(
        F.col("_id").alias("doc_id"),
        *(["ids"] if with_ids else []),
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return pieces_of(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model of the labelled ones."""
    docs = read(spark, sf_dir, "documents")
    model = fit_severity(docs, read(spark, sf_dir, "labels"))
    return score_severity(docs, model).withColumnRenamed("_id", "doc_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays in its place."""
    rows = resolve_copies(read(spark, sf_dir, "documents"))
    sha = F.lower(F.hex("_digest")).alias("text_sha256")
    return rows.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", sha)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, which share heads."""
    return conversation_trie(read(spark, sf_dir, "conversations"), SharedHeads())


def _held_out() -> Column:
    """Whether the labels of a document are kept from the model."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by rules learnt from the labels not held out."""
    docs = read(spark, sf_dir, "documents")
    model = fit_rules(docs, read(spark, sf_dir, "labels").filter(~_held_out()))
    scored = score_quality(docs, model).withColumnRenamed("_id", "doc_id")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_secrets": op5_secrets,
    "op6_top_k": op6_top_k,
    "op7_simhash": op7_simhash,
    "op8_pieces": op8_pieces,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality": op12_quality,
    "op13_ranked_search": op13_ranked_search,
}

_TABLE = ",".join(map(str, fill_table(SHARDS)))

ORACLES = {
    "op1_line_dedup": f"""
WITH RECURSIVE split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line_list FROM documents
), line AS (
  SELECT doc_id, unnest(line_list) AS line, generate_subscripts(line_list, 1) AS pos, len(line_list) AS lines FROM split
), sized AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM line
), ahead AS (
  SELECT doc_id, pos, lines, line, w, lead(line) OVER d AS line2, lead(line, 2) OVER d AS line3,
         w + coalesce(lead(w) OVER d, 0) AS w2, w + coalesce(lead(w) OVER d, 0) + coalesce(lead(w, 2) OVER d, 0) AS w3
  FROM sized WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), window_ AS (
  SELECT doc_id, pos, CASE WHEN w >= {MIN_WORDS} THEN 1 WHEN w2 >= {MIN_WORDS} THEN 2 ELSE {MIN_LINES} END AS n,
         line, line2, line3, lines, w3 FROM ahead
), content AS (
  SELECT doc_id, pos, n, n || chr(10) || line || CASE WHEN n > 1 THEN chr(10) || line2 ELSE '' END
         || CASE WHEN n > 2 THEN chr(10) || line3 ELSE '' END AS whole
  FROM window_ WHERE pos + n - 1 <= lines AND w3 > 0
), pair AS (
  SELECT b.doc_id, b.pos, b.pos + b.n AS stop, a.doc_id AS first_id, a.pos AS first_pos
  FROM content a JOIN content b ON a.whole = b.whole AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.pos < b.pos)
), behind AS (
  SELECT doc_id, stop, first_id, first_pos + stop - pos AS first_stop, pos FROM pair
  UNION SELECT r.doc_id, r.stop + 1, r.first_id, r.first_stop + 1, r.pos
  FROM behind r JOIN line x ON x.doc_id = r.doc_id AND x.pos = r.stop
  JOIN line y ON y.doc_id = r.first_id AND y.pos = r.first_stop AND y.line = x.line
), before AS (
  SELECT doc_id, pos, first_id, first_pos FROM pair
  UNION SELECT r.doc_id, r.pos - 1, r.first_id, r.first_pos - 1
  FROM before r JOIN line x ON x.doc_id = r.doc_id AND x.pos = r.pos - 1
  JOIN line y ON y.doc_id = r.first_id AND y.pos = r.first_pos - 1 AND y.line = x.line
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, stop)) AS pos FROM (SELECT doc_id, pos, max(stop) AS stop FROM behind GROUP BY ALL)
  UNION SELECT doc_id, pos FROM before
)
SELECT line.doc_id, CAST(max(line.lines) AS INTEGER) AS lines, CAST(count(gone.pos) AS INTEGER) AS removed_lines,
       sha256(coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY line.pos), '')) AS text_sha256
FROM line LEFT JOIN gone USING (doc_id, pos) GROUP BY line.doc_id
""",
    "op2_url_filter": """
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query
  FROM cut
), canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), ':(80|443)$', '')
           || regexp_replace(path, '/+$', '')
           || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical
  FROM (SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split(query, '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))), '&'), '') AS q FROM parts)
), listed AS (
  SELECT DISTINCT canonical FROM canon WHERE list_has_any(string_split(host, '.'),
    ['spam-farm', 'cheap-pills', 'casino-win', 'adult-x', 'free-bets', 'ads-track'])
), judged AS (
  SELECT page_id, host, path, canonical, coalesce(canonical IN (SELECT canonical FROM listed), FALSE) AS listed,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM canon
)
SELECT page_id, host, path, rule, canonical, listed,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""",
    "op4_sharding": f"""
SELECT doc_id, slot, printf('shard-%03d', [{_TABLE}][slot + 1]) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce('k' || doc_id, 'n')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
""",
    "op6_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op11_prefix_trie": """
WITH turn_ AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), size_ AS (
  SELECT c, count(*) AS n FROM turn_ GROUP BY c
), head AS (
  SELECT size_.c, size_.c - size_.c % 20 AS base, least(h, coalesce(b.n, 0)) AS got, h
  FROM (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
            lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM size_) AS size_
  LEFT JOIN (SELECT c AS b, n FROM size_) AS b ON b.b = size_.c - size_.c % 20
), rebuilt AS (
  SELECT head.c, p, role, text FROM head JOIN turn_ ON turn_.c = base AND p < h
  UNION ALL SELECT head.c, p - h + got, role, text FROM head JOIN turn_ ON turn_.c = head.c AND p >= h
), way AS (
  SELECT c, 0 AS d, '' AS node, 0 AS words FROM head
  UNION ALL SELECT c, p + 1, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY p),
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM rebuilt
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS above FROM way
), node_ AS (
  SELECT d, node, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM linked GROUP BY d, node
), child AS (
  SELECT d - 1 AS d, above AS node, count(*) AS n FROM node_ WHERE d > 0 GROUP BY ALL
), counted AS (
  SELECT node_.*, coalesce(child.n, 0) AS n_children FROM node_ LEFT JOIN child USING (d, node)
), total AS (
  SELECT way.d, way.node, sum((n_convs - 1) * v.words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM counted v JOIN way ON way.c = v.conv_id AND way.d <= v.d GROUP BY ALL
), ended AS (
  SELECT d, node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT c, max(d) AS d, arg_max(node, d) AS node FROM way GROUP BY c) GROUP BY d, node
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted n JOIN total USING (d, node) LEFT JOIN ended USING (d, node)
LEFT JOIN node_ parent ON parent.d = n.d - 1 AND parent.node = n.above
""",
    "op13_ranked_search": """
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark
), size_ AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM term GROUP BY doc_id
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS l FROM size_
), tf AS (
  SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM term WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, whole GROUP BY t, docs
), hit AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))) AS v
  FROM tf JOIN size_ USING (doc_id) JOIN weight USING (t), whole
), scored AS (
  SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM asked JOIN hit USING (t) GROUP BY ALL HAVING sum(v) > 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
