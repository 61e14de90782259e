"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banditframe.llm import decontaminate, licenses, manifest, mixing, negatives, ogg, pii, quality, simhash, tokens, toxicity, urls, wrappers
from banditframe.llm.common import table
from banditframe.plans.data import crc_sql


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer documents are likelier to be drawn, up to three times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, importance=mixing.by_length(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs).drop("text")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: source, language and each thousand of ids stand for directories."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, benchmark)


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return ogg.features(ogg.media(sized)).drop("text")


def _number(text, digits: int = 7):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages themselves: hosts, their parent domains and first path segments, each with up to
    four changes at times that follow from their MD5."""
    host = F.regexp_extract("url", "//([^/?#]+)", 1)
    parent = F.regexp_replace(host, r"^[^.]+\.(?=[^.]+\.[^.]+\.)", "")
    head = F.concat(host, F.lit("/"), F.regexp_extract("url", "//[^/?#]+/([^/?#]+)", 1))
    names = pages.select(F.explode(F.array(host, parent, head)).alias("pattern")).distinct()
    names = names.filter(_number(F.concat(F.lit("in:"), "pattern")) % 3 == 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    code = F.concat("pattern", F.lit(":"), F.col("k").cast("string"))
    at = F.timestamp_seconds(F.lit(1704067200) + _number(code) % (366 * 86400))
    action = F.when(F.col("k") % 2 == 0, "add").otherwise("remove")
    kind = F.when(_number(F.concat(F.lit("kind:"), "pattern")) % 2 == 0, "spam").otherwise("adult")
    return names.select("pattern", kind.alias("category"), action.alias("action"), at.alias("at"))


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, fetched in 2024 at a time that follows from its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + _number(F.concat(F.lit("page:"), F.col("page_id").cast("string"))) % (366 * 86400))
    return urls.listed(pages.withColumn("fetched", fetched), url_list(pages))


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, make_timestamp((1704067200 + ('0x' || substr(md5('page:' || page_id), 1, 7))::BIGINT % (366 * 86400)) * 1000000) AS fetched,
    lower(regexp_extract(url, '//([^/?#]+)', 1)) AS host, string_split(regexp_extract(url, '//[^/?#]+/([^?#]*)', 1), '/') AS seg FROM pages),
names AS (SELECT DISTINCT unnest([regexp_extract(url, '//([^/?#]+)', 1), regexp_replace(regexp_extract(url, '//([^/?#]+)', 1), '^[^.]+\.([^.]+\.[^.]+\.)', '\1'),
    regexp_extract(url, '//([^/?#]+)', 1) || '/' || regexp_extract(url, '//[^/?#]+/([^/?#]+)', 1)]) AS pattern FROM pages),
e AS (SELECT pattern, CASE WHEN ('0x' || substr(md5('kind:' || pattern), 1, 7))::BIGINT % 2 = 0 THEN 'spam' ELSE 'adult' END AS category,
    CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
    make_timestamp((1704067200 + ('0x' || substr(md5(pattern || ':' || k), 1, 7))::BIGINT % (366 * 86400)) * 1000000) AS changed
    FROM names, range(4) r(k) WHERE ('0x' || substr(md5('in:' || pattern), 1, 7))::BIGINT % 3 = 0),
one AS (SELECT pattern, changed, max(action) AS action, any_value(category) AS category FROM e GROUP BY pattern, changed),
v AS (SELECT pattern, category, action, changed AS since, lead(changed) OVER (PARTITION BY pattern ORDER BY changed) AS until FROM one),
m AS (SELECT p.page_id, v.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.pattern) DESC, v.pattern DESC) AS rk FROM p JOIN v
    ON (v.pattern = p.host OR ends_with(p.host, '.' || v.pattern) OR (starts_with(v.pattern, p.host || '/') AND v.pattern = p.host || '/' || p.seg[1]))
    WHERE v.action = 'add' AND v.since <= p.fetched AND (v.until IS NULL OR p.fetched < v.until))
SELECT p.page_id, p.url, p.fetched, m.pattern IS NOT NULL AS listed, m.pattern, m.category, m.since FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.rk = 1
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, labels, keep_text=False)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth row asks; each seventh row's label is taken for the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what it says to a table in which some texts have been lower-cased."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    presented = manifest.leaf([text if c == "text" else F.col(c) for c in manifest.FIELDS])
    found = manifest.manifest(docs, presented=presented)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql(levels: int = 7, above: int = 3) -> str:
    """levels within a language (8^7 documents) and above (8^3 languages), unrolled."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    head = "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars"])) + " || "
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""WITH ids AS (SELECT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL), {crc_sql('ids', 19)},
docs AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {head}{field('text')}) AS leaf, {head}CASE WHEN crc.v % 3 = 0 THEN {field(low)} ELSE {field('text')} END) AS shown
    FROM documents LEFT JOIN crc ON doc_id::VARCHAR = s),
l0 AS (SELECT doc_id, leaf, shown, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs),
n0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM l0)"""
    for k in range(levels + above):
        if k == levels:
            sql += f",\nn{k} AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM m{k})"
        nxt = f"m{k + 1}" if k + 1 == levels else f"n{k + 1}"
        sql += f""",
s{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM n{k}),
{nxt} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM n{k} GROUP BY g, i // 8))"""
    sql += ",\nw0 AS (SELECT doc_id, leaf, g, i, shown AS x, '' AS p FROM l0)"
    for k in range(levels + above):
        at = f"w{k}.g AND s{k}.i = w{k}.i" if k != levels else f"0 AND s{k}.i = w{k}.g"
        up = f"w{k}.g, w{k}.i // 8 AS i" if k < levels else f"0 AS g, s{k}.i // 8 AS i"
        sql += f",\nw{k + 1} AS (SELECT doc_id, leaf, w{k}.g AS own, {up}, CASE WHEN s{k}.n = 1 THEN x ELSE sha256(a || x || b) END AS x, p || a || b AS p{', subroot' if k > levels else f', m{levels}.h AS subroot' if k == levels else ''} FROM w{k} JOIN s{k} ON s{k}.g = {at}{f' JOIN m{levels} ON m{levels}.g = w{k}.g' if k == levels else ''})"
    last = levels + above
    return sql + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = h AS verified FROM w{last}, n{last}"


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, labels, lambda i: F.crc32(i.cast("string")) % 5 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_token_counts, op3_pii, op4_simhash, op5_licenses, op6_wrappers, op7_decontamination, op8_ogg, op9_url_lists, op10_quality, op11_negatives, op12_merkle, op13_toxicity]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_lists": OP9_SQL, "op11_negatives": OP11_SQL, "op12_merkle": _merkle_sql()}
