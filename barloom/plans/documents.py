"""Queries on documents: chunks, change scans, retrieval, keyword scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorStore
from ..session import shared_folder
from ..sources.tables import table
from ..streaming.ingest import CHANGES as CHANGES_OF_STREAM
from ..streaming.ingest import Ingest, changes_stream, word_windows
from .base import query

RULES = {"alpha": ["tion", "ción"], "beta": ["ung"], "gamma": ["eau"]}
NAMES = {"AAA": "ment", "BBB": "heit", "CCC": "zzzz"}
GOOD, BAD = ["and", "der", "les"], ["the", "que", "und"]

_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), s AS (SELECT doc_id, w, range(0, len(w), 450) AS st FROM w WHERE len(w) > 0),
    e AS (SELECT doc_id, w, len(st) AS total_chunks, unnest(st) AS s FROM s)
    SELECT doc_id, (s / 450)::INT AS chunk_index, total_chunks::INT AS total_chunks, md5(array_to_string(w[s + 1:s + 500], ' ')) AS text_md5 FROM e""")
def chunks_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.word_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


_SPLIT = r"""list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: trim(p)), lambda p: p <> '')"""
_SENTENCES = r"""list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"""


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, {_SPLIT} AS ps FROM documents),
    u AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN floor(len({_WORDS.format('p')}) * 1.3::DOUBLE) > 500 THEN {_SENTENCES} ELSE [p] END)) AS units FROM p),
    n AS (SELECT doc_id, units, list_transform(units, lambda p: {_WORDS.format('p')}) AS ws, list_transform(units, lambda p: len({_WORDS.format('p')})) AS n FROM u WHERE len(units) > 0),
    r AS (SELECT doc_id, 1::BIGINT AS i, n[1]::BIGINT AS now, 0 AS chunk, 0::BIGINT AS word FROM n
        UNION ALL SELECT r.doc_id, i + 1, CASE WHEN floor(now * 1.3::DOUBLE) + floor(n[i + 1] * 1.3::DOUBLE) > 500 THEN least(now, 50) ELSE now END + n[i + 1],
            chunk + (floor(now * 1.3::DOUBLE) + floor(n[i + 1] * 1.3::DOUBLE) > 500)::INT, word + n[i] FROM r JOIN n ON n.doc_id = r.doc_id WHERE i < len(n)),
    c AS (SELECT doc_id, chunk, min(i) AS a, max(i) AS b, min(word) AS word FROM r GROUP BY 1, 2), t AS (SELECT doc_id, count(*) AS total FROM c GROUP BY 1),
    x AS (SELECT c.doc_id, chunk, total, array_to_string(units[a:b], chr(10) || chr(10)) AS own, list_sum(n[a:b]) AS own_words, (flatten(ws))[greatest(c.word - 50, 0) + 1:c.word] AS before FROM c JOIN n ON n.doc_id = c.doc_id JOIN t ON t.doc_id = c.doc_id)
    SELECT doc_id, chunk AS chunk_index, total::INT AS total_chunks, floor((own_words + CASE WHEN chunk > 0 THEN len(before) ELSE 0 END) * 1.3::DOUBLE)::INT AS tokens,
        md5(CASE WHEN chunk > 0 THEN array_to_string(before, ' ') || chr(10) || chr(10) ELSE '' END || own) AS text_md5 FROM x""")
def chunks_by_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for paragraphs here, as these documents have no empty lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return D.paragraph_chunks(docs, "doc_id", "text").select("doc_id", "chunk_index", "total_chunks", D.tokens(F.col("text")).alias("tokens"), F.md5("text").alias("text_md5"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_WORDS.format("coalesce(text, '')")} AS w FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, array_to_string(w, ' ')) - 1 AS i FROM t),
    p AS (SELECT conv_id, i, role, w, unnest(range(0, len(w), 20)) AS pos FROM k WHERE len(w) > 0)
    SELECT conv_id, i::INT AS chunk_index, (pos / 20)::INT AS part, CASE WHEN len(w) > 20 THEN 'turn ' || role || ' (part ' || (pos / 20 + 1)::INT || ')' ELSE 'turn ' || role END AS title,
        md5(array_to_string(w[pos + 1:pos + 20], ' ')) AS text_md5 FROM p""")
def chunks_by_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with a heading for each turn."""
    flat = F.array_join(D.words(F.coalesce("text", F.lit(""))), " ")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", flat.alias("text")).alias("t"))
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.concat(F.lit("## turn "), t["role"], F.lit("\n"), t["text"])), "\n").alias("text"))
    return D.section_chunks(docs, "conv_id", "text", 20).select("conv_id", "chunk_index", "part", "title", F.md5("text").alias("text_md5"))


CHANGES = """old AS (SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 5 <> 0),
    now AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN coalesce(text, '') || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
    ch AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.hash <> md5(coalesce(n.text, '')) THEN 'modified' ELSE 'unchanged' END AS status
        FROM old o FULL JOIN now n ON o.doc_id = n.doc_id)"""


def _versions(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *more)
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 7 <> 0").withColumn("text", changed)


@query(f"WITH {CHANGES} SELECT doc_id, status FROM ch")
def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = _versions(spark, sf_dir)
    return D.content_changes(old.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash")), now, "doc_id", "text").select("doc_id", "status")


@query(f"""WITH {CHANGES}, a AS (SELECT o.doc_id, o.hash FROM old o WHERE o.doc_id NOT IN (SELECT doc_id FROM ch WHERE status IN ('deleted', 'modified'))
        UNION ALL SELECT n.doc_id, md5(coalesce(n.text, '')) FROM now n WHERE n.doc_id IN (SELECT doc_id FROM ch WHERE status IN ('new', 'modified')))
    SELECT doc_id, hash FROM a""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = _versions(spark, sf_dir)
    hashed = lambda d: d.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    changes = D.content_changes(hashed(old), now, "doc_id", "text")
    return D.apply_changes(hashed(old), changes, hashed(now), "doc_id")


NEAREST = """q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 20 = 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    d AS (SELECT query, vec_id, label, list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i]::DOUBLE) * (v[i] - q[i]::DOUBLE))) AS distance FROM q CROSS JOIN v)"""


def _whole(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size("embedding") == 64) & ~bad)


@query(f"""WITH {NEAREST}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id)::INT AS rank FROM d WHERE label % 2 = 0)
    SELECT query, vec_id, rank, round(1 / (1 + distance), 4) AS score FROM r WHERE rank <= 5""")
def search_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five of each query vector among the vectors of even labels."""
    vectors = _whole(table(spark, sf_dir, "embeddings"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return D.nearest(queries, vectors.where("label % 2 = 0"), 5).select("query", "vec_id", "rank", "score")


@query(f"""WITH {NEAREST}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id)::INT AS rank FROM d)
    SELECT query, vec_id, rank, round(1 / (1 + distance), 4) AS score FROM r WHERE rank <= 15 AND label % 2 = 0""")
def search_postfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top fifteen of each query vector, of which those of even labels are shown."""
    vectors = _whole(table(spark, sf_dir, "embeddings"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    found = D.nearest(queries, vectors, 15)
    return found.join(vectors.where("label % 2 = 0").select("vec_id"), "vec_id", "left_semi").select("query", "vec_id", "rank", "score")


@query()
def search_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top fifteen re-ranked to five different texts."""
    vectors = _whole(table(spark, sf_dir, "embeddings"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return D.mmr(D.nearest(queries, vectors, 15).join(texts, "vec_id", "left"), 5).select("query", "vec_id", "rank", "score", "mmr_rank")


INGEST = f"""{CHANGES}, held AS (SELECT n.doc_id, d.source, n.text FROM now n JOIN documents d USING (doc_id) WHERE len({_WORDS.format("coalesce(n.text, '')")}) > 0
        UNION ALL SELECT o.doc_id, d.source, d.text FROM documents d JOIN old o USING (doc_id) WHERE d.doc_id % 7 <> 0 AND d.doc_id NOT IN (SELECT doc_id FROM now))"""


def _ingested(spark: SparkSession, sf_dir: str) -> Ingest:
    """First most documents, then the changed and new ones with all that did not change, then deletions; the second batch is taken twice."""
    old, now = _versions(spark, sf_dir, "source")
    gone = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").withColumn("text", F.lit(None).cast("string"))
    changes = lambda d, gone: d.select("doc_id", "source", "text", F.lit(gone).alias("deleted"))
    ingest = Ingest(spark, f"{shared_folder(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}", word_windows(200, 150))
    folder = f"{ingest.path}-in"
    for i, part in enumerate((changes(old, False), changes(now, False), changes(gone, True))):
        part.write.option("compression", "zstd").parquet(f"{folder}/{i}")
        ingest.run(changes_stream(spark, f"{folder}/*"))
        if i == 1:
            ingest.apply(spark.read.schema(CHANGES_OF_STREAM).parquet(f"{folder}/{i}"), i)
    return ingest


@query(f"WITH {INGEST} SELECT doc_id, md5(text) AS hash FROM held")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of changes leaves: the texts that are there, by their MD5."""
    return _ingested(spark, sf_dir).documents().select("doc_id", "hash")


@query(f"""WITH {INGEST}, c AS (SELECT source, doc_id, len(range(0, len({_WORDS.format("text")}), 150)) AS n FROM held),
    t AS (SELECT source, count(*) AS n_docs, sum(n) AS n_chunks FROM c GROUP BY 1),
    e AS (SELECT source, count(*) AS n_errors FROM (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, text FROM now) x JOIN documents d USING (doc_id) WHERE len({_WORDS.format("coalesce(x.text, '')")}) = 0 GROUP BY 1)
    SELECT coalesce(t.source, e.source) AS source, coalesce(n_docs, 0) AS n_docs, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_errors, 0) AS n_errors FROM t FULL JOIN e ON t.source IS NOT DISTINCT FROM e.source""")
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunks and errors by source after the stream."""
    return _ingested(spark, sf_dir).totals()


STORE = """s AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    held AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN label + 100 ELSE label END AS label, embedding FROM s WHERE vec_id % 7 <> 0)"""


def _store(spark: SparkSession, sf_dir: str) -> VectorStore:
    """A store of most vectors to which the others come, some labels change, and of which some are deleted."""
    vectors = _whole(table(spark, sf_dir, "embeddings")).select("vec_id", "label", "embedding")
    store = VectorStore.create(vectors.where("vec_id % 5 <> 0"))
    store.add(vectors.where("vec_id % 5 = 0"))
    store.add(vectors.where("vec_id % 11 = 0").withColumn("label", F.col("label") + 100))
    store.delete(vectors.where("vec_id % 7 = 0").select("vec_id"))
    return store


@query(f"WITH {STORE} SELECT vec_id, label, list_sum(embedding::DOUBLE[]) IS NOT NULL AS whole FROM held")
def vector_store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of vectors holds after additions, replacements and deletions."""
    return _store(spark, sf_dir).rows().select("vec_id", "label", (F.size("embedding") == 64).alias("whole"))


@query(f"WITH {STORE} SELECT label, count(*) AS n FROM held GROUP BY 1")
def vector_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).compact().count_by("label")


HELD = f"""{STORE}, q AS (SELECT vec_id AS query, embedding AS q FROM s WHERE vec_id % 20 = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM held),
    d AS (SELECT query, vec_id, label, list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i]::DOUBLE) * (v[i] - q[i]::DOUBLE))) AS distance FROM q CROSS JOIN v)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(table(spark, sf_dir, "embeddings")).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query(f"""WITH {HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id)::INT AS rank FROM d)
    SELECT query, vec_id, rank, round(1 / (1 + distance), 4) AS score FROM r WHERE rank <= 5""")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each query in the changed store, exactly, from the lists that can hold them."""
    return _store(spark, sf_dir).search(_asked(spark, sf_dir), 5).select("query", "vec_id", "rank", "score")


@query(f"""WITH {HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id)::INT AS rank FROM d WHERE label > 100)
    SELECT query, vec_id, rank, round(1 / (1 + distance), 4) AS score FROM r WHERE rank <= 5""")
def search_indexed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of some labels."""
    return _store(spark, sf_dir).search(_asked(spark, sf_dir), 5, where=F.col("label") > 100).select("query", "vec_id", "rank", "score")


@query()
def search_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each query in the lists that are probed first; recall is measured by a test."""
    return _store(spark, sf_dir).search(_asked(spark, sf_dir), 5, exact=False).select("query", "vec_id", "rank", "score")


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS w FROM documents),
    t AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 262144 AS dim, count(*) AS tf FROM w GROUP BY 1, 2),
    i AS (SELECT dim, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM t GROUP BY 1),
    v AS (SELECT doc_id, dim, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM t JOIN i USING (dim)),
    s AS (SELECT q.doc_id AS query, d.doc_id, floor(sum(q.w * d.w) * 1e6::DOUBLE + 0.4142::DOUBLE) / 1e6::DOUBLE AS score FROM v q JOIN v d USING (dim) WHERE q.doc_id % 20 = 0 AND q.doc_id <> d.doc_id GROUP BY 1, 2)
    SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents closest to each query text by hashed terms; queries are the documents whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    return TextIndex.create(docs).search(queries, 5).select("query", F.col("key").alias("doc_id"), "score", "rank")


@query("""WITH r AS (SELECT source, doc_id, text, sum(floor(length(text) * 0.25::DOUBLE)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE text IS NOT NULL)
    SELECT source, doc_id, used::BIGINT AS used FROM r WHERE used <= 4000""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return D.within_budget(docs, 4000, "text", "doc_id", "source").select("source", "doc_id", F.col("used").cast("long").alias("used"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS text_md5 FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(D.strip_tags(F.coalesce("html", F.lit("")))).alias("text_md5"))


def _hits(ks: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN 1 ELSE 0 END" for k in ks) + ")"


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(text), '{k}')''' for k in ks)} THEN '{c}'" for c, ks in RULES.items()) + " ELSE 'general' END"


@query(f"SELECT doc_id, round(coalesce(({_hits(GOOD)} - {_hits(BAD)}) / nullif({_hits(GOOD)} + {_hits(BAD)}, 0)::DOUBLE, 0), 6) AS score, {_CATEGORY} AS category FROM documents WHERE text IS NOT NULL")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.round(D.keyword_score(F.col("text"), GOOD, BAD), 6).alias("score"), D.category(F.col("text"), RULES).alias("category"))


_SYMBOLS = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{n}') THEN '{s}' END" for s, n in NAMES.items()) + ")"


@query(f"""WITH n AS (SELECT substr(md5(text), 1, 12) AS id, split_part(text, chr(10), 1) AS headline, {_SYMBOLS} AS symbols, {_CATEGORY} AS category FROM documents WHERE text IS NOT NULL)
    SELECT id, md5(min(headline)) AS headline_md5, min(symbols) AS symbols, min(category) AS category FROM n GROUP BY id""")
def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.news(table(spark, sf_dir, "documents"), "text", NAMES, RULES)
    return out.select("id", F.md5("headline").alias("headline_md5"), F.array_join("symbols", ",").alias("symbols"), "category")


@query(f"""WITH r AS (SELECT source, coalesce(({_hits(GOOD)} - {_hits(BAD)}) / nullif({_hits(GOOD)} + {_hits(BAD)}, 0)::DOUBLE, 0) AS score, least(n_chars / 4000.0::DOUBLE, 1) AS confidence,
        CASE WHEN n_chars > 6000 THEN 'critical' WHEN n_chars > 3000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' ELSE 'low' END AS impact FROM documents WHERE text IS NOT NULL),
    c AS (SELECT source, sum(score * confidence) / sum(confidence) AS score, count(*) FILTER (impact = 'critical') AS a, count(*) FILTER (impact = 'high') AS b, count(*) FILTER (impact = 'medium') AS m,
        count(*) FILTER (impact = 'low') AS l, count(*) AS n FROM r GROUP BY 1)
    SELECT source, round(score, 6) AS score, CASE greatest(a, b, m, l) WHEN a THEN 'critical' WHEN b THEN 'high' WHEN m THEN 'medium' ELSE 'low' END AS impact, n FROM c""")
def source_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "source", D.keyword_score(F.col("text"), GOOD, BAD).alias("score"), F.least(n / 4000.0, F.lit(1.0)).alias("confidence"),
        F.when(n > 6000, "critical").when(n > 3000, "high").when(n > 1000, "medium").otherwise("low").alias("impact"))
    return D.weighted_sentiment(rows, "source").withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT source, lang, count(*) AS n, count(DISTINCT md5(coalesce(text, ''))) AS n_distinct, sum(n_chars) AS chars FROM documents GROUP BY 1, 2)
    SELECT source, lang, n, n_distinct, chars::BIGINT AS chars, round(n / sum(n) OVER (PARTITION BY source)::DOUBLE, 6) AS share FROM d""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, distinct texts and sizes by source and language."""
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.countDistinct(F.md5(F.coalesce("text", F.lit("")))).alias("n_distinct"), F.sum("n_chars").alias("chars"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))
