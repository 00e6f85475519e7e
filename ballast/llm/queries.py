"""The registered queries of the corpus operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import decontaminate, jaccard, language, licenses, neighbours, packing, repeats, rules, search, shards, spelling, toxicity, warc
from ballast.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op6_benchmark_containment", f"""
with i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') w from benchmark),
si as (select distinct item_id, unnest(case when len(w) >= {decontaminate.WIDTH} then list_transform(range(1, len(w) - {decontaminate.WIDTH - 2}), lambda k: array_to_string(w[k:k + {decontaminate.WIDTH - 1}], ' '))
       when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s, least(len(w), {decontaminate.WIDTH}) width from i),
n as (select item_id, count(*) n_item from si group by item_id),
d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') w from documents),
sd as (select distinct doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) s
       from d, (select distinct width from si) where len(w) >= width)
select doc_id, item_id, n_item, count(*) n_shared, count(*) / n_item containment
from sd join si using (s, width) join n using (item_id)
group by doc_id, item_id, n_item having count(*) >= {decontaminate.CONTAINMENT} * n_item - 1e-9
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every (document, benchmark item) pair in which the document holds 0.8 or more of the item's shingles."""
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_minimax_shards")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, copies together."""
    placed = shards.shard_documents(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_decision_list")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document, by a decision list learned from the quality labels."""
    found = rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_sum_of_squares_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"))


@query("op2_warc_captures")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back through the merged capture index."""
    found = warc.archive_pages(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "at", "size")


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents linked at a Jaccard similarity of 0.85 of their 4-word shingles."""
    return jaccard.near_duplicates(table(spark, folder, "documents"), width=4, percent=85)


@query("op5_language_bloom_filters")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two folds of three."""
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.learn(language.learning_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op1_toxicity_network")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from four folds of five."""
    docs = table(spark, folder, "documents")
    net = toxicity.fit(docs, toxicity.learning_labels(table(spark, folder, "labels")))
    found = toxicity.score_documents(docs, net)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "windows", "worst_start", "worst_end")


@query("op10_repeated_strings")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    found = repeats.without_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_license_spans")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every license notice or text in a document, with matched coverage and span."""
    return licenses.license_spans(table(spark, folder, "documents"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word of all documents with the more frequent word one edit away that it is a variant of."""
    return spelling.group_variants(table(spark, folder, "documents"))


@query("op12_permutation_index")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors found of every vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query("op13_ranked_search", r"""
with terms as (select row_number() over () d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') t from documents where text is not null),
held as (select d, doc_id, t, len(t)::bigint n from terms where len(t) > 0),
total as (select count(*)::bigint docs, sum(n)::bigint tokens from held),
tf as (select d, term, count(*)::bigint tf from (select d, unnest(t) term from held) group by d, term),
items as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) term from benchmark where text is not null),
asked as (select item_id, term, count(*)::bigint k from items group by item_id, term),
df as (select term, count(*)::bigint df from tf where term in (select term from asked) group by term),
weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint w from df, total),
norm as (select d, doc_id, 100 - 25 + ((25 * n * docs) // tokens) m from held, total),
scored as (select item_id, d, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
           from asked join weight using (term) join tf using (term) join norm using (d) group by item_id, d, doc_id)
select item_id, rank::int rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from scored where score > 0) where rank <= 20
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty documents of highest score for every benchmark item."""
    return search.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"))
