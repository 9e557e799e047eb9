"""One query for each operator, over the whole table it is meant for, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectus.llm.alignment import aligned_documents
from prospectus.llm.ann import neighbours
from prospectus.llm.common import table
from prospectus.llm.language import document_languages
from prospectus.llm.licenses import TEMPLATES, license_scan, size_bounds, template_bigrams
from prospectus.llm.line_dedup import without_near_lines
from prospectus.llm.mixing import SEED, WEIGHTS, mixed
from prospectus.llm.packing import packed
from prospectus.llm.prefix_trie import prefix_trie
from prospectus.llm.quality import quality_scores
from prospectus.llm.sharding import resharded
from prospectus.llm.simhash import simhash_components
from prospectus.llm.token_counts import with_token_counts
from prospectus.llm.vector_dedup import vector_components


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's rows with their copy and shuffle key."""
    return mixed(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    return without_near_lines(table(spark, sf_dir, "documents"), exact_chars=1).select("doc_id", "text", "removed_lines")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return with_token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with the checksum of its ids."""
    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, by nearly equal bytes."""
    rows = resharded(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_components(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", "line", "n_findings")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every text by two tokenizers."""
    return aligned_documents(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return document_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    found = (
        op1_quality, op2_mixing, op3_line_dedup, op4_token_counts, op5_packing, op6_neighbours, op7_sharding, op8_vector_dedup, op9_simhash,
        op10_licenses, op11_prefix_trie, op12_alignment, op13_language,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows, by the query's name."""
    return {"op2_mixing": MIXING, "op8_vector_dedup": VECTOR_DEDUP, "op10_licenses": LICENSES, "op11_prefix_trie": PREFIX_TRIE}


_NAMED = ", ".join(f"('{name}', {share!r}::DOUBLE)" for name, share in sorted(WEIGHTS.items()))

#: Rates from the byte counts, a distribution table for each, and as many copies as its steps that the hash reaches.
MIXING = f"""
WITH named(source, share) AS (VALUES {_NAMED}),
grouped AS (
  SELECT d.*, n.source AS grp, strlen(coalesce(d.text, '')) AS bytes,
         ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents d LEFT JOIN named n ON d.source = n.source
),
sizes AS (SELECT grp, sum(bytes)::DOUBLE AS size, (SELECT sum(bytes)::DOUBLE FROM grouped) AS total FROM grouped GROUP BY grp),
rates AS (
  SELECT s.grp, coalesce(n.share, 1 - (SELECT sum(share) FROM named)) * s.total / s.size AS rate
  FROM sizes s LEFT JOIN named n ON s.grp = n.source
),
masses AS (
  SELECT grp, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS mass FROM rates, range(0, 120) AS r(k)
),
steps AS (SELECT grp, k, sum(mass) OVER (PARTITION BY grp ORDER BY k) AS below FROM masses),
counted AS (
  SELECT g.*, (SELECT count(*) FROM steps s WHERE s.grp IS NOT DISTINCT FROM g.grp AND s.below <= g.u) AS n FROM grouped g
),
copies AS (SELECT *, unnest(range(0, n)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       ('0x' || substr(md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 12))::BIGINT AS shuffle_key
FROM copies
"""


def _license_rows(threshold: float = 0.8) -> str:
    """The templates' bigrams with their size bounds, as rows."""
    rows = []
    for rank, (name, text) in enumerate(sorted(TEMPLATES.items())):
        own = template_bigrams(text)
        least, most = size_bounds(len(own), threshold)
        words = ", ".join("'" + word.replace("'", "''") + "'" for word in own)
        rows.append(f"({rank}, '{name}', {len(own)}, {least}, {most}, [{words}])")
    return ", ".join(rows)


#: Lines and whole texts as rows, each joined with the templates that its size allows.
LICENSES = rf"""
WITH templates(rank, license, n, least, most, bigrams) AS (VALUES {_license_rows()}),
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
clean AS (
  SELECT doc_id, list_transform(parts, lambda l: trim(regexp_replace(lower(l), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS parts FROM cut
),
units AS (
  SELECT doc_id, unnest(parts) AS unit, (unnest(range(1, len(parts) + 1)) - 1)::INTEGER AS line FROM clean
  UNION ALL
  SELECT doc_id, array_to_string(list_filter(parts, lambda l: l <> ''), ' '), -1 FROM clean WHERE len(parts) > 1
),
worded AS (SELECT doc_id, line, string_split(unit, ' ') AS words FROM units WHERE unit <> ''),
paired AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams FROM worded
),
compared AS (
  SELECT p.doc_id, p.line, t.rank, t.license, 2.0::DOUBLE * len(list_intersect(p.bigrams, t.bigrams)) / (len(p.bigrams) + t.n) AS dice
  FROM paired p JOIN templates t ON len(p.bigrams) BETWEEN t.least AND t.most
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, rank) AS nth FROM compared WHERE dice >= 0.8
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, rank, CASE WHEN line < 0 THEN 2147483647 ELSE line END) AS place,
         count(*) OVER (PARTITION BY doc_id) AS n_findings
  FROM best WHERE nth = 1
)
SELECT d.doc_id, r.license, r.dice, r.line, coalesce(r.n_findings, 0)::INTEGER AS n_findings
FROM documents d LEFT JOIN ranked r ON d.doc_id = r.doc_id AND r.place = 1
"""

#: All pairs of a label, and everything reachable by links.
VECTOR_DEDUP = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, min(reach.b) AS component_id,
       e.vec_id = min(reach.b) AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id GROUP BY e.vec_id
"""

#: Paths as lists of turns; every node is sent to all nodes above it.
PREFIX_TRIE = r"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS pos
  FROM clean
),
bits AS (
  SELECT conv_id, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
         lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))) AS steps
  FROM (SELECT DISTINCT conv_id FROM clean)
),
heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first_conv,
         xor(list_reduce(steps, lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295) % 4 AS h
  FROM bits
),
begun AS (
  SELECT heads.conv_id, placed.pos, placed.role, placed.text
  FROM heads JOIN placed ON placed.conv_id = heads.first_conv AND placed.pos <= heads.h
),
given AS (SELECT heads.conv_id, h, count(begun.pos) AS n FROM heads LEFT JOIN begun ON heads.conv_id = begun.conv_id GROUP BY ALL),
turns AS (
  SELECT * FROM begun
  UNION ALL
  SELECT placed.conv_id, placed.pos - h + n, role, text FROM placed JOIN given ON placed.conv_id = given.conv_id WHERE placed.pos > h
),
whole AS (
  SELECT given.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path
  FROM given LEFT JOIN turns ON given.conv_id = turns.conv_id GROUP BY given.conv_id
),
begins AS (SELECT conv_id, len(path) AS size, unnest(range(0, len(path) + 1)) AS depth, path FROM whole),
nodes AS (
  SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM begins GROUP BY ALL
),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children,
         CASE WHEN nodes.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(nodes.path[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes LEFT JOIN children ON nodes.path = children.path
),
upwards AS (SELECT path, unnest(range(0, depth + 1)) AS above, n_children, saved FROM valued),
sums AS (
  SELECT path[1:above] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM upwards GROUP BY ALL
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON v.path = s.path LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
"""
