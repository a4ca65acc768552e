"""Queries of the corpus operators on the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions.keyed import md5_32
from brindle.functions.libm import scaled_round
from brindle.operators import corpus as C
from brindle.operators import knn as KN
from brindle.operators import near_dup as N
from brindle.operators import qa as Q
from brindle.operators.order import numbered, shuffled, take_first
from brindle.plans.tables import table
from brindle.sources import files
from brindle.sources import harvest as H

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Building blocks of the SQL side.
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '[ \t\x{{a0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '[\s\x{{a0}}]+'), lambda w: w != ''))"
NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
U32 = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
UNIFORM = "((" + U32 + " + 0.5) / 4294967296.0)"
SHINGLES = (
    "SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] "
    "ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s "
    r"FROM (SELECT {1} AS doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x != '') AS w FROM {0})"
)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("harvest_budget", """
WITH d AS (SELECT doc_id, source, substr(text, 1, 6000) AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, greatest(1, length(t) // 4) AS tokens FROM d),
r AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, md5(t) AS text_md5 FROM r WHERE before < 100000
""")
def harvest_budget(spark, sf_dir):
    """Documents in (source, doc_id) order until the token budget is spent."""
    out = C.harvest(docs(spark, sf_dir), [F.col("source"), F.col("doc_id")], token_budget=100_000)
    return out.select("doc_id", "source", "tokens", F.md5("text").alias("text_md5"))


@query("training_split_rows", "SELECT doc_id, split FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' WHEN 2 THEN 'part_a' ELSE 'part_b' END AS split FROM documents) WHERE split IN ('part_a', 'part_b')")
def training_split_rows(spark, sf_dir):
    """Without a split named train, those that are not for testing."""
    rows = docs(spark, sf_dir).select("doc_id", F.element_at(F.array(*map(F.lit, ("validation", "test", "part_a", "part_b"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("split"))
    return rows.filter(F.col("split").isin(C.training_splits(["validation", "test", "part_a", "part_b"])))


@query("longest_field", "SELECT page_id, CASE WHEN greatest(length(coalesce(url, '')), length(coalesce(html, ''))) > 80 THEN md5(CASE WHEN length(coalesce(url, '')) >= length(coalesce(html, '')) THEN url ELSE html END) END AS text_md5 FROM pages")
def longest_field(spark, sf_dir):
    """S3: the longest string field of a page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(C.longest_string(pages)).alias("text_md5"))


@query("longest_field_short", "SELECT p_partkey, CASE WHEN greatest(length(p_name), length(p_brand), length(p_type)) > 10 THEN CASE WHEN length(p_name) >= greatest(length(p_brand), length(p_type)) THEN p_name WHEN length(p_brand) >= length(p_type) THEN p_brand ELSE p_type END END AS field FROM part")
def longest_field_short(spark, sf_dir):
    """The same rule with another threshold, ties to the first field."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", C.longest_string(part, 10).alias("field"))


@query("plain_text_rows", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 80")
def plain_text_rows(spark, sf_dir):
    """S4."""
    return C.plain_texts(docs(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n"))


@query("tokens_or_first_string", r"SELECT doc_id, md5(t) AS text_md5 FROM (SELECT doc_id, coalesce(nullif(array_to_string(regexp_split_to_array(text, '\s+'), ' '), ''), source) AS t FROM documents) WHERE length(t) > 100")
def tokens_or_first_string(spark, sf_dir):
    """Joined tokens, else the first string column, above 100 characters."""
    rows = docs(spark, sf_dir).select("doc_id", F.split("text", r"\s+").alias("tokens"), "source")
    joined = F.coalesce(F.nullif(F.array_join("tokens", " "), F.lit("")), F.col("source"))
    return rows.select("doc_id", joined.alias("t")).filter(F.length("t") > 100).select("doc_id", F.md5("t").alias("text_md5"))


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read with a schema."""
    path = files.write_jsonl(docs(spark, sf_dir), name="documents")
    return files.read_jsonl(spark, path, docs(spark, sf_dir).schema).select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """CSV with a header."""
    nation = table(spark, sf_dir, "nation")
    return files.read_csv(spark, files.write_csv(nation, name="nation"), nation.schema)


@query("eval_cell_scan", "SELECT event_type AS model, event_id AS item, value AS score FROM events")
def eval_cell_scan(spark, sf_dir):
    """One JSON cell for each model, its rows exploded; broken files are skipped."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 64).alias("shard"), F.struct(F.col("event_id").alias("item"), F.col("value").alias("score")).alias("row"))
    cells = rows.groupBy("model", "shard").agg(F.collect_list("row").alias("rows"))  # a cell's items: at most a test set
    path = files.write_jsonl(cells, name="cells")
    return files.read_cells(spark, path, "model string, rows array<struct<item: bigint, score: double>>").select("model", "item", "score")


@query("stack_seeds", "SELECT CAST(year(o_orderdate) AS INT) AS seed, o_orderpriority AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2")
def stack_seeds(spark, sf_dir):
    """One CSV folder for each seed, stacked with the seed taken from the path."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("seed"), F.col("o_orderpriority").alias("metric"), "o_totalprice")
    per = orders.groupBy("seed", "metric").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return files.read_seeds(spark, files.write_seeds(per, "seed"), "metric string, value double")


@query("clean_text", f"SELECT doc_id, md5({CLEAN.format('text')}) AS clean_md5, CAST(length({CLEAN.format('text')}) AS BIGINT) AS n FROM documents")
def clean_text(spark, sf_dir):
    """T1, T2."""
    t = X.clean_text("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(t).alias("clean_md5"), F.length(t).cast("long").alias("n"))


@query("clean_length_gate", f"SELECT doc_id, CAST(words AS BIGINT) AS words FROM (SELECT doc_id, {WORDS.format('t')} AS words FROM (SELECT doc_id, {CLEAN.format('text')} AS t FROM documents) WHERE t != '') WHERE words BETWEEN 24 AND 2048")
def clean_length_gate(spark, sf_dir):
    """Cleaned documents of 24 to 2048 words."""
    return C.clean_and_gate(docs(spark, sf_dir)).select("doc_id", "words")


@query("replay_min_length", f"SELECT doc_id FROM documents WHERE length({CLEAN.format('text')}) > 200")
def replay_min_length(spark, sf_dir):
    """T4."""
    return docs(spark, sf_dir).filter(F.length(X.clean_text("text")) > 200).select("doc_id")


@query("harvest_funnel", f"""
WITH a AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
b AS (SELECT lang, {CLEAN.format('text')} AS t FROM documents),
c AS (SELECT lang, count(*) FILTER (WHERE t != '') AS cleaned, count(*) FILTER (WHERE t != '' AND {WORDS.format('t')} BETWEEN 24 AND 2048) AS gated FROM b GROUP BY lang)
SELECT lang, docs, cleaned, gated, docs - gated AS removed FROM a JOIN c USING (lang)
""")
def harvest_funnel(spark, sf_dir):
    """Flagship slice: cleaning and length gate, counted by language in one pass."""
    words = X.word_count(F.col("t"))
    rows = docs(spark, sf_dir).select("lang", X.clean_text("text").alias("t"))
    ok = F.col("t") != ""
    out = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(ok).alias("cleaned"), F.count_if(ok & words.between(24, 2048)).alias("gated"))
    return out.withColumn("removed", F.col("docs") - F.col("gated"))


@query("funnel_manifest", """
WITH s AS (SELECT 0 AS ord, 'raw' AS stage, count(*) AS docs FROM documents UNION ALL SELECT 1, 'english', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 2, 'long', count(*) FROM documents WHERE lang = 'en' AND n_chars > 500)
SELECT ord, stage, docs, coalesce(lag(docs) OVER (ORDER BY ord) - docs, 0) AS removed FROM s
""")
def funnel_manifest(spark, sf_dir):
    """A3."""
    d = docs(spark, sf_dir)
    en = d.filter("lang = 'en'")
    return C.funnel([("raw", d), ("english", en), ("long", en.filter("n_chars > 500"))])


@query("normalize_for_hash", f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def normalize_for_hash(spark, sf_dir):
    """T8."""
    return docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_for_hash("text")).alias("norm_md5"))


@query("hash_text", "SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 12) AS h FROM documents")
def hash_text(spark, sf_dir):
    """T9."""
    return docs(spark, sf_dir).select("doc_id", X.hash_text("text").alias("h"))


@query("exact_dup_keep_first", f"SELECT md5({NORM.format('text')}) AS text_hash, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dup_keep_first(spark, sf_dir):
    return N.exact_dup_keep_first(docs(spark, sf_dir))


@query("shingle_counts", f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM ({SHINGLES.format('documents', 'doc_id')})")
def shingle_counts(spark, sf_dir):
    """J1."""
    return docs(spark, sf_dir).select("doc_id", F.size(N.shingles(F.col("text"))).cast("long").alias("n"))


@query("shingle_counts_core", r"SELECT item_id, CAST(CASE WHEN len(w) < 5 THEN len(list_distinct(w)) ELSE len(list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)])) END AS BIGINT) AS n FROM (SELECT item_id, list_filter(string_split(" + NORM.format("text") + r", ' '), lambda x: x != '') AS w FROM benchmark)")
def shingle_counts_core(spark, sf_dir):
    """J2's shingles: without punctuation, unigrams when short."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(N.shingles_core(F.col("text"))).cast("long").alias("n"))


_AB = "[" + ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in N.multipliers(128)) + "]"
_HASHED = "[" + U32.format("g") + " % 2147483647 for g in s]"
_SIGN = f"[coalesce(list_min([(h * p.a + p.b) % {N.PRIME} for h in hs]), {N.PRIME}) for p in {_AB}]"


@query("minhash_signature", f"SELECT item_id, md5(array_to_string({_SIGN}, ',')) AS sig_md5 FROM (SELECT doc_id AS item_id, {_HASHED} AS hs FROM ({SHINGLES.format('benchmark', 'item_id')}))")
def minhash_signature(spark, sf_dir):
    """128 permutations of the benchmark's shingles."""
    return N.signatures(table(spark, sf_dir, "benchmark"), id_col="item_id").select("item_id", F.md5(F.array_join("sig", ",")).alias("sig_md5"))


_CORE = r"SELECT item_id AS doc_id, CASE WHEN len(w) < 5 THEN list_distinct(w) ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM (SELECT item_id, list_filter(string_split(" + NORM.format("text") + r", ' '), lambda x: x != '') AS w FROM benchmark)"


@query("minhash_core", f"SELECT item_id, md5(array_to_string({_SIGN}, ',')) AS sig_md5 FROM (SELECT doc_id AS item_id, {_HASHED} AS hs FROM ({_CORE}))")
def minhash_core(spark, sf_dir):
    """Signatures of the core shingles."""
    return N.core_signatures(table(spark, sf_dir, "benchmark"), id_col="item_id").select("item_id", F.md5(F.array_join("sig", ",")).alias("sig_md5"))


@query("lsh_bands", f"SELECT item_id, b AS band, md5(array_to_string(sig[b * 13 + 1 : b * 13 + 13], ',')) AS band_hash FROM (SELECT item_id, {_SIGN} AS sig, unnest(range(0, 9)) AS b FROM (SELECT doc_id AS item_id, {_HASHED} AS hs FROM ({SHINGLES.format('benchmark', 'item_id')}) WHERE len(s) > 0))")
def lsh_bands(spark, sf_dir):
    """J4."""
    return N.lsh_index(table(spark, sf_dir, "benchmark"), 0.80, id_col="item_id").select("item_id", F.col("band").cast("long").alias("band"), "band_hash")


def _banded(source: str, key: str, threshold: float) -> str:
    """SQL: id, band, h of the LSH index of a table."""
    b, r = N.BANDS[threshold]
    least = ", ".join(f"min((h * {x} + {y}) % {N.PRIME}) AS p{i}" for i, (x, y) in enumerate(N.multipliers(b * r)))
    band = " UNION ALL ".join(f"SELECT id, {i} AS band, concat_ws(',', {', '.join(f'p{j}' for j in range(i * r, i * r + r))}) AS h FROM sig" for i in range(b))
    return f"(WITH sig AS (SELECT id, {least} FROM (SELECT doc_id AS id, {U32.format('g')} % 2147483647 AS h FROM (SELECT doc_id, unnest(s) AS g FROM ({SHINGLES.format(source, key)}))) GROUP BY id) {band})"


_HIT = f"SELECT DISTINCT d.id FROM {_banded('documents', 'doc_id', 0.80)} d JOIN {_banded('benchmark', 'item_id', 0.80)} b USING (band, h)"


@query("leakage_filter", f"SELECT doc_id FROM documents WHERE doc_id NOT IN ({_HIT})")
def leakage_filter(spark, sf_dir):
    """Documents that share no LSH band with the benchmark."""
    index = N.lsh_index(table(spark, sf_dir, "benchmark"), 0.80, id_col="item_id")
    return N.leakage_filter(docs(spark, sf_dir), index).select("doc_id")


@query("shield_report", f"WITH c AS (SELECT doc_id, lang, source, {CLEAN.format('text')} AS text FROM documents), k AS (SELECT item_id, {CLEAN.format('text')} AS text FROM benchmark), h AS (SELECT DISTINCT d.id FROM {_banded('c', 'doc_id', 0.80)} d JOIN {_banded('k', 'item_id', 0.80)} b USING (band, h)) SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE doc_id IN (FROM h)) AS dropped, count(*) FILTER (WHERE doc_id NOT IN (FROM h)) AS kept FROM c GROUP BY lang, source")
def shield_report(spark, sf_dir):
    """Documents shielded against the benchmark, counted by language and source."""
    flagged = N.shield_flags(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), F.col("text"), F.col("text"), id_col="doc_id")
    return N.leakage_report(flagged, "lang", "source")


@query("shingle_jaccard_pairs", f"""
WITH t AS (SELECT min(doc_id) AS doc_id, s FROM (SELECT doc_id, list_sort(s) AS s FROM ({SHINGLES.format('documents', 'doc_id')})) WHERE len(s) > 0 GROUP BY s),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM t),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM o WHERE k / (na + nb - k) >= 0.85
""")
def shingle_jaccard_pairs(spark, sf_dir):
    """Exact Jaccard pairs at 0.85 between classes of equal sets, each by its least id."""
    return N.jaccard_pairs(docs(spark, sf_dir))[1].select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("shingle_classes", f"WITH t AS (SELECT doc_id, list_sort(s) AS s FROM ({SHINGLES.format('documents', 'doc_id')}) WHERE len(s) > 0) SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM t")
def shingle_classes(spark, sf_dir):
    """The members of the classes of shingle_jaccard_pairs."""
    return N.shingle_classes(docs(spark, sf_dir))[0].select(F.col("id").alias("doc_id"), "rep")


@query("near_dup_greedy", f"""
WITH RECURSIVE s AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM ({SHINGLES.format('documents', 'doc_id')})),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM o WHERE k / (na + nb - k) >= 0.85),
m AS (SELECT b AS id, list(a) AS less FROM p GROUP BY b),
q AS (SELECT id, less, row_number() OVER (ORDER BY id) AS i FROM m),
loop AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS dropped UNION ALL
  SELECT l.i + 1, CASE WHEN len(list_filter(q.less, lambda x: NOT list_contains(l.dropped, x))) > 0 THEN list_append(l.dropped, q.id) ELSE l.dropped END FROM loop l JOIN q ON q.i = l.i + 1)
SELECT doc_id, NOT list_contains((SELECT arg_max(dropped, i) FROM loop), doc_id) AS kept FROM documents
""")
def near_dup_greedy(spark, sf_dir):
    """J8's decision rule on exact Jaccard pairs."""
    return N.near_dup_greedy(docs(spark, sf_dir)).select("doc_id", "kept")


@query("minhash_dedup", f"""
WITH RECURSIVE x AS {_banded('documents', 'doc_id', 0.85)},
p AS (SELECT DISTINCT l.id AS a, r.id AS b FROM x l JOIN x r USING (band, h) WHERE l.id < r.id),
m AS (SELECT b AS id, list(a) AS less FROM p GROUP BY b), q AS (SELECT id, less, row_number() OVER (ORDER BY id) AS i FROM m),
loop AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS dropped UNION ALL
  SELECT l.i + 1, CASE WHEN len(list_filter(q.less, lambda x: NOT list_contains(l.dropped, x))) > 0 THEN list_append(l.dropped, q.id) ELSE l.dropped END FROM loop l JOIN q ON q.i = l.i + 1)
SELECT doc_id, NOT list_contains((SELECT arg_max(dropped, i) FROM loop), doc_id) AS kept FROM documents
""")
def minhash_dedup(spark, sf_dir):
    """J8, J18 with LSH candidates."""
    return N.minhash_dedup(docs(spark, sf_dir)).select("doc_id", "kept")


@query("leakage_containment", f"""
WITH d AS (SELECT doc_id, unnest(s) AS g FROM ({SHINGLES.format('documents', 'doc_id')})), b AS (SELECT doc_id AS item_id, len(s) AS n, unnest(s) AS g FROM ({SHINGLES.format('benchmark', 'item_id')}))
SELECT doc_id, item_id, round(count(*) / first(n), 6) AS share FROM d JOIN b USING (g) GROUP BY doc_id, item_id HAVING count(*) / first(n) >= 0.8
""")
def leakage_containment(spark, sf_dir):
    """Extension: items of whose shingles a document holds four fifths."""
    return N.containment(docs(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("share", 6).alias("share"))


@query("cosine_knn", """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings),
s AS (SELECT query_id, vec_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-12) AS sim FROM q, p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(sim, 5) AS similarity, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5
""")
def cosine_knn(spark, sf_dir):
    """The five nearest exemplars of a stated query set."""
    e = table(spark, sf_dir, "embeddings")
    return KN.cosine_neighbours(e, e.filter("vec_id % 100 = 0"), 5).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_PPL = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x != '')) AS w FROM documents),
c AS (SELECT w, count(*) AS c FROM w GROUP BY w), t AS (SELECT sum(c) AS n, count(*) AS v FROM c), l AS (SELECT w, -ln((c + 1.0) / (n + v)) AS nll FROM c, t),
s AS (SELECT doc_id, sum(nll) AS s, count(*) AS k FROM w JOIN l USING (w) GROUP BY doc_id),
ppl AS (SELECT d.doc_id, exp(least(20.0, coalesce(s, 0) / greatest(1, coalesce(k, 0)))) AS ppl FROM documents d LEFT JOIN s USING (doc_id))
"""


@query("unigram_ppl", _PPL + "SELECT doc_id, round(ppl, 4) AS ppl FROM ppl")
def unigram_ppl(spark, sf_dir):
    """M9 with the corpus's own unigram scorer."""
    return C.unigram_perplexity(docs(spark, sf_dir)).select("doc_id", scaled_round("ppl", 4).alias("ppl"))


@query("ppl_filter", _PPL + "SELECT doc_id, round(ppl, 4) AS ppl FROM ppl WHERE ppl BETWEEN 300 AND 20000")
def ppl_filter(spark, sf_dir):
    """T5 with a window for the unigram scorer."""
    return C.perplexity_filter(C.unigram_perplexity(docs(spark, sf_dir)), 300, 20000).select("doc_id", scaled_round("ppl", 4).alias("ppl"))


@query("ppl_impute", _PPL + f", o AS (SELECT doc_id, row_number() OVER (ORDER BY {U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) AS r FROM documents), k AS (SELECT doc_id, ppl FROM ppl JOIN o USING (doc_id) WHERE r <= 300), m AS (SELECT quantile_cont(ppl, 0.5) AS med FROM k) SELECT d.doc_id, round(coalesce(k.ppl, med), 4) AS ppl FROM documents d LEFT JOIN k USING (doc_id), m")
def ppl_impute(spark, sf_dir):
    """A seeded sample is scored, the others get its median."""
    d = docs(spark, sf_dir)
    return C.score_sample_impute(d, lambda sample: C.unigram_perplexity(sample, d), 300).select("doc_id", scaled_round("ppl", 4).alias("ppl"))


_GRAMS = r"SELECT {1} AS id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS g FROM (SELECT {1}, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM {0})"
_DSIR = f"""
WITH r AS (SELECT id, {U32.format('g')} % 262144 AS f, count(*) AS c FROM ({_GRAMS.format('documents', 'doc_id')}) GROUP BY 1, 2),
t AS (SELECT {U32.format('g')} % 262144 AS f, count(*) AS c FROM ({_GRAMS.format('benchmark', 'item_id')}) GROUP BY 1),
rf AS (SELECT f, sum(c) AS c FROM r GROUP BY f), n AS (SELECT (SELECT sum(c) FROM rf) AS nr, (SELECT coalesce(sum(c), 0) FROM t) AS nt),
lr AS (SELECT rf.f, ln((coalesce(t.c, 0) + 1.0) / (nt + 262144)) - ln((rf.c + 1.0) / (nr + 262144)) AS lr FROM rf LEFT JOIN t USING (f), n),
s AS (SELECT id, sum(c * lr) AS s, sum(c) AS k FROM r JOIN lr USING (f) GROUP BY id),
wt AS (SELECT doc_id, coalesce(s, 0) / greatest(coalesce(k, 0), 1) AS weight FROM documents LEFT JOIN s ON id = doc_id)
"""


@query("dsir_weights", _DSIR + "SELECT doc_id, round(weight, 6) AS weight FROM wt")
def dsir_weights(spark, sf_dir):
    """P5: documents against the benchmark."""
    return C.dsir_weights(docs(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id", F.round("weight", 6).alias("weight"))


@query("dsir_topk", _DSIR + f", k AS (SELECT doc_id, weight - ln(-ln({UNIFORM.format(chr(39) + '42|' + chr(39) + ' || doc_id')})) AS key FROM wt), m AS (SELECT greatest(1, round_even(count(*) * 0.7, 0)) AS m FROM k) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY key DESC, doc_id) AS r FROM k), m WHERE r <= m")
def dsir_topk(spark, sf_dir):
    """70 % by weight and Gumbel noise."""
    return C.dsir_resample(C.dsir_weights(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))).select("doc_id")


@query("curriculum_buckets", _PPL + f", b AS (SELECT doc_id, ntile(6) OVER (ORDER BY round(ppl, 6), doc_id) - 1 AS bucket FROM ppl) SELECT doc_id, bucket, row_number() OVER (ORDER BY bucket, {U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) - 1 AS pos FROM b")
def curriculum_buckets(spark, sf_dir):
    """Six buckets of perplexity, shuffled inside."""
    scored = C.unigram_perplexity(docs(spark, sf_dir)).select("doc_id", scaled_round("ppl", 6).alias("ppl"))
    return C.curriculum(scored, buckets=6).select("doc_id", F.col("bucket").cast("long").alias("bucket"), "pos")


_REPLAY = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE lang = 'fr'), p AS (SELECT doc_id, row_number() OVER (ORDER BY {U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) - 1 AS j FROM documents WHERE lang = 'en'),
n AS (SELECT (SELECT count(*) FROM d) AS n, least((SELECT count(*) FROM p), CAST(round_even((SELECT count(*) FROM d) * 0.25 / 0.75, 0) AS BIGINT)) AS r), e AS (SELECT n, r, greatest(1, n // greatest(r, 1)) AS every FROM n),
mix AS (SELECT doc_id, 'domain' AS kind, i + least(r, i // every) AS pos FROM d, e UNION ALL SELECT doc_id, 'replay', CASE WHEN (j + 1) * every <= n THEN (j + 1) * every + j ELSE n + j END FROM p, e WHERE j < r)
"""


def _replayed(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang")
    return C.interleave_replay(numbered(d.filter("lang = 'fr'").select("doc_id"), [F.col("doc_id")]), d.filter("lang = 'en'").select("doc_id"))


@query("replay_interleave", _REPLAY + "SELECT doc_id, kind, CAST(pos AS BIGINT) AS pos FROM mix")
def replay_interleave(spark, sf_dir):
    """French documents with a quarter of English replay."""
    return _replayed(spark, sf_dir).select("doc_id", "kind", F.col("pos").cast("long").alias("pos"))


@query("val_split_tail", _REPLAY + ", k AS (SELECT count(*) AS c, least(greatest(200, CAST(floor(count(*) * 0.02) AS BIGINT)), count(*) // 2) AS v FROM mix) SELECT doc_id, CASE WHEN pos >= c - v THEN 'val' ELSE 'train' END AS split FROM mix, k")
def val_split_tail(spark, sf_dir):
    """The tail of the ordered corpus."""
    return C.validation_split(_replayed(spark, sf_dir)).select("doc_id", "split")


_RANK = f"row_number() OVER (ORDER BY {U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id)"


@query("split_carve", f"WITH n AS (SELECT greatest(50, count(*) // 20) AS t, greatest(50, count(*) // 10) AS v FROM documents), r AS (SELECT doc_id, {_RANK} - 1 AS p FROM documents) SELECT doc_id, CASE WHEN p < t THEN 'test' WHEN p < t + v THEN 'val' ELSE 'train' END AS split FROM r, n")
def split_carve(spark, sf_dir):
    """Seeded test, val and train."""
    return C.carve(docs(spark, sf_dir).select("doc_id"), 42)


@query("exemplar_pool", f"SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) <= 20 AS pool FROM documents")
def exemplar_pool(spark, sf_dir):
    """20 exemplars of each language."""
    return C.exemplar_pool(docs(spark, sf_dir).select("doc_id", "lang"), 20, by="lang").select("doc_id", "pool")


@query("deterministic_shuffle", f"SELECT doc_id, {_RANK} - 1 AS pos FROM documents")
def deterministic_shuffle(spark, sf_dir):
    """P4."""
    return numbered(docs(spark, sf_dir).select("doc_id"), shuffled(42, "doc_id"))


@query("demos_random", f"SELECT doc_id FROM (SELECT doc_id, {_RANK} AS r FROM documents) WHERE r <= 5")
def demos_random(spark, sf_dir):
    """The same five demos for every item."""
    return take_first(docs(spark, sf_dir).select("doc_id"), shuffled(42, "doc_id"), 5)


@query("demos_stratified", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) AS turn FROM documents), o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY turn, {U32.format(chr(39) + '42|' + chr(39) + ' || lang')}, lang) AS place FROM r) SELECT doc_id, lang, place FROM o WHERE place <= 6")
def demos_stratified(spark, sf_dir):
    """P12."""
    return C.demos_stratified(docs(spark, sf_dir).select("doc_id", "lang"), 6, "lang").select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@query("training_steps", "SELECT lang, CAST(ceil(count(*) / 32.0) * 3 AS BIGINT) AS steps FROM documents GROUP BY lang")
def training_steps(spark, sf_dir):
    """P16."""
    return docs(spark, sf_dir).groupBy("lang").agg(C.training_steps(F.count("*"), 8, 4, 3).cast("long").alias("steps"))


@query("task_stats", f"SELECT lang, count(*) AS n, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.95), 6) AS p95, count(DISTINCT source) AS n_specialties FROM (SELECT lang, source, {WORDS.format(chr(116) + 'ext')} AS w FROM documents) GROUP BY lang")
def task_stats(spark, sf_dir):
    """A1."""
    out = Q.task_stats(docs(spark, sf_dir), ["lang"], X.word_count("text"), "source")
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "n_specialties")


@query("top5", "SELECT lang, source, n, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f, source) AS rank FROM (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2)) WHERE rank <= 5")
def top5(spark, sf_dir):
    """A2."""
    return Q.most_common(docs(spark, sf_dir), ["lang"], "source", 5, "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query("test_fingerprints", f"SELECT item_id, md5({CLEAN.format(chr(116) + 'ext')}) AS print_md5 FROM benchmark WHERE {CLEAN.format(chr(116) + 'ext')} != ''")
def test_fingerprints(spark, sf_dir):
    """Cleaned, non-empty fingerprints."""
    return table(spark, sf_dir, "benchmark").select("item_id", X.clean_text("text").alias("t")).filter("t != ''").select("item_id", F.md5("t").alias("print_md5"))


@query("set_operations", "SELECT kind, count(*) AS n FROM (SELECT 'intersect' AS kind, x FROM (SELECT c_nationkey AS x FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', x FROM (SELECT doc_id AS x FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'union', x FROM (SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier)) GROUP BY kind")
def set_operations(spark, sf_dir):
    """Section 2.10: union, intersect and except."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("x")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("x"))
    d, k = docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = [("intersect", a.intersect(b)), ("except", d.exceptAll(k)), ("union", a.unionByName(b))]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_HARVEST = """
WITH d AS (SELECT 0 AS src_ord, 'items' AS source, item_id AS k, text AS t FROM benchmark UNION ALL SELECT 2, 'french', doc_id, text FROM documents WHERE lang = 'fr' AND doc_id % 3 != 0 UNION ALL SELECT 3, 'pages', page_id, html FROM pages UNION ALL SELECT 4, 'rest', doc_id, text FROM documents WHERE lang != 'fr'),
k AS (SELECT src_ord, source, k, substr(t, 1, 6000) AS t, greatest(1, length(substr(t, 1, 6000)) // 4) AS tokens FROM d WHERE length(t) > 80),
r AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY src_ord, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT CAST(src_ord AS INT) AS src_ord, source, CAST(k AS VARCHAR) AS id, CAST(tokens AS BIGINT) AS tokens, md5(t) AS text_md5 FROM r WHERE before < 300000
"""


@query("harvest_sources", _HARVEST)
def harvest_sources(spark, sf_dir):
    """Five sources in order until the budget is spent; the second cannot be opened, the third is a dict of splits, later ones may stay unopened."""
    d = docs(spark, sf_dir)
    splits = {"test": d.filter("lang = 'fr' AND doc_id % 3 = 0"), "train": d.filter("lang = 'fr' AND doc_id % 3 != 0")}
    out, _ = H.harvest_sources(spark, [
        H.Source("items", lambda: table(spark, sf_dir, "benchmark"), ("item_id",)), H.Source("gone", lambda: table(spark, sf_dir, "no_such_table"), ("id",)),
        H.Source("french", lambda: splits, ("doc_id",)), H.Source("pages", lambda: table(spark, sf_dir, "pages"), ("page_id",)), H.Source("rest", lambda: d.filter("lang != 'fr'"), ("doc_id",)),
    ], token_budget=300_000)
    return out.select("src_ord", "source", "id", "tokens", F.md5("text").alias("text_md5"))
