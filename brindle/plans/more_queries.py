"""Queries of scorers, token gates, positional joins, versioned output, wide CSV, table functions and the rarer cases of corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import generators as G
from brindle.functions import text as X
from brindle.functions import vocab
from brindle.functions.libm import scaled_round
from brindle.operators import corpus as C
from brindle.operators import qa as Q
from brindle.operators import scoring
from brindle.operators import stats as S
from brindle.plans import corpus_queries as CQ
from brindle.plans import eval_queries as V
from brindle.plans.tables import CELL_SCORES_SQL, cell_scores, table
from brindle.sources import files, partitioned

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_IDS = f"SELECT doc_id, [{CQ.U32.format('x')} FOR x IN list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x != '')] AS ids FROM documents"
_BIGRAM = f"""
WITH i AS ({_IDS}),
u AS (SELECT x % 262144 AS f, count(*) AS c FROM (SELECT unnest(ids) AS x FROM i) GROUP BY 1), t AS (SELECT sum(c) AS n FROM u),
b AS (SELECT (v * 1000003 + w) % 262144 AS f, count(*) AS c FROM (SELECT unnest(ids[: -2]) AS v, unnest(ids[2 :]) AS w FROM i) GROUP BY 1),
p AS (SELECT doc_id, unnest(ids[1 : 512][: -2]) AS v, unnest(ids[1 : 512][2 :]) AS w FROM i),
s AS (SELECT doc_id, avg(-ln(0.7 * coalesce(b.c, 0) / greatest(1, coalesce(uv.c, 0)) + 0.3 * (coalesce(uw.c, 0) + 1.0) / (n + 262144))) AS nll
  FROM p LEFT JOIN b ON b.f = (v * 1000003 + w) % 262144 LEFT JOIN u uv ON uv.f = v % 262144 LEFT JOIN u uw ON uw.f = w % 262144, t GROUP BY doc_id),
ppl AS (SELECT doc_id, exp(least(20.0, coalesce(nll, 0))) AS ppl FROM documents LEFT JOIN s USING (doc_id))
"""


@query("bigram_ppl", _BIGRAM + "SELECT doc_id, round(ppl, 4) AS ppl FROM ppl")
def bigram_ppl(spark, sf_dir):
    """M9: an interpolated bigram model fitted on all documents scores each, cut to 512 tokens."""
    d = table(spark, sf_dir, "documents")
    return scoring.perplexities(d, scoring.fit_bigrams(d)).select("doc_id", F.round("ppl", 4).alias("ppl"))


@query("bigram_ppl_impute", _BIGRAM + f", o AS (SELECT doc_id, row_number() OVER (ORDER BY {CQ.U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) AS r FROM documents), k AS (SELECT doc_id, ppl FROM ppl JOIN o USING (doc_id) WHERE r <= 300), m AS (SELECT quantile_cont(ppl, 0.5) AS med FROM k) SELECT d.doc_id, round(coalesce(k.ppl, med), 4) AS ppl FROM documents d LEFT JOIN k USING (doc_id), m")
def bigram_ppl_impute(spark, sf_dir):
    """T6 with a scorer: it sees the sample only."""
    d = table(spark, sf_dir, "documents")
    model = scoring.fit_bigrams(d)
    return C.score_sample_impute(d, lambda sample: scoring.perplexities(sample, model), 300).select("doc_id", F.round("ppl", 4).alias("ppl"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("token_length_gate")
def token_length_gate(spark, sf_dir):
    """T3 with a tokenizer: documents of 24 to 2048 tokens."""
    return vocab.token_gate(table(spark, sf_dir, "documents"), _vocabulary()).select("doc_id", "n_tokens")


@query("train_pack")
def train_pack(spark, sf_dir):
    """Training chats rendered, those above 400 tokens go."""
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(F.array(F.lit("mcqa"), F.lit("absqa"), F.lit("extqa")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("task"), F.col("p_name").alias("question"), F.repeat("p_type", (F.col("p_size") % 9).cast("int")).alias("context"),
        F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type")).alias("options"), F.when(F.col("p_partkey") % 11 > 0, F.lit("A")).alias("answer"),
    )
    return vocab.train_pack(rows, _vocabulary(), 400).select("p_partkey", "task", "n_tokens", F.md5("text").alias("text_md5"))


@query("positional_join", "WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), b AS (SELECT doc_id AS other, quality, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels) SELECT pos, doc_id, lang, other, quality FROM a JOIN b USING (pos)")
def positional_join(spark, sf_dir):
    """Documents and labels side by side by place, as many as there are labels."""
    out = S.positional_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], ["doc_id"])
    return out.select("pos", "l.doc_id", "l.lang", F.col("r.doc_id").alias("other"), "r.quality")


@query("positional_cells", """
WITH a AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events WHERE event_id % 3 != 0), b AS (SELECT event_type, event_id AS other, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS pos FROM events WHERE event_id % 2 = 0)
SELECT event_type, pos, event_id, other, round(value, 6) AS value FROM a JOIN b USING (event_type, pos)
""")
def positional_cells(spark, sf_dir):
    """J15 inside cells of unequal lengths: items by id, scores in their own order."""
    e = table(spark, sf_dir, "events")
    out = S.positional_join(e.filter("event_id % 3 != 0").select("event_type", "event_id"), e.filter("event_id % 2 = 0").select("event_type", "event_id", "value"), ["event_id"], ["value", "event_id"], ["event_type"])
    return out.select("event_type", "pos", "l.event_id", F.col("r.event_id").alias("other"), F.round("r.value", 6).alias("value"))


@query("positional_arrays", """
WITH c AS (SELECT conv_id, list({'r': role, 't': turn} ORDER BY turn) AS a, list(length(text) ORDER BY turn DESC) FILTER (WHERE role != 'system') AS b FROM conversations GROUP BY 1),
n AS (SELECT conv_id, a, b, unnest(range(0, least(len(a), coalesce(len(b), 0)))) AS pos FROM c)
SELECT conv_id, pos, a[pos + 1].r AS role, CAST(a[pos + 1].t AS BIGINT) AS turn, CAST(b[pos + 1] AS BIGINT) AS n FROM n
""")
def positional_arrays(spark, sf_dir):
    """J15 on the lists of a cell: rows and scores zipped, the longer one cut."""
    rows = table(spark, sf_dir, "conversations")
    cells = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"),
        F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", F.length("text").alias("n")))))), lambda x: x["n"]).alias("b"),
    )
    out = cells.select("conv_id", F.explode(S.zip_arrays("a", "b")).alias("x"))
    return out.select("conv_id", F.col("x.pos").cast("long").alias("pos"), "x.left.role", "x.left.turn", F.col("x.right").cast("long").alias("n"))


@query("partition_overwrite", "SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS version, md5(CASE WHEN lang = 'fr' THEN upper(source) ELSE source END) AS h FROM documents")
def partition_overwrite(spark, sf_dir):
    """A partition of the written table is replaced by a second version, the others stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    path = partitioned.write_partitions(d.withColumn("version", F.lit(1)), "lang", name="tasks")
    partitioned.write_partitions(d.filter("lang = 'fr'").select("doc_id", "lang", F.upper("source").alias("source"), F.lit(2).alias("version")), "lang", path)
    return partitioned.read_partition(spark, path, "doc_id long, source string, version int, lang string", "lang").select("doc_id", "lang", "version", F.md5("source").alias("h"))


_WIDE = [(a, str(n)) for a in ("mean", "spread") for n in (0, 3, 5)]


@query("wide_csv_round_trip", f"WITH c AS ({CELL_SCORES_SQL}), m AS (SELECT model, n_shot, round(avg(score), 6) AS mean, round(max(score) - min(score), 6) AS spread FROM c GROUP BY 1, 2) SELECT model, metric, CAST(n_shot AS VARCHAR) AS shots, value FROM m UNPIVOT (value FOR metric IN (mean, spread)) WHERE NOT (model = 'view' AND n_shot = 3)")
def wide_csv_round_trip(spark, sf_dir):
    """A table with two header rows is written and read back as long rows; a missing cell gives none."""
    cells = cell_scores(spark, sf_dir).groupBy("model", "n_shot").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score") - F.min("score"), 6).alias("spread"))
    long = cells.unpivot(["model", "n_shot"], ["mean", "spread"], "metric", "value").filter("NOT (model = 'view' AND n_shot = 3)").withColumn("shots", F.col("n_shot").cast("string"))
    path = files.write_wide_csv(long, index="model", levels=("metric", "shots"), value="value", columns=_WIDE)
    return files.read_wide_csv(spark, path, levels=("metric", "shots"))


@query("entity_spans_udtf", V.ORACLES["entity_spans"])
def entity_spans_udtf(spark, sf_dir):
    """G4 by a converter that makes rows, called from SQL."""
    G.register(spark, "bio_spans", G.bio_spans, G.BIO_SCHEMA)
    return V.spans_result(G.generated(V.tagged_sentences(spark, sf_dir), "bio_spans", "tokens", "tags", keep=("sent_id",)).withColumnRenamed("sent_id", "id"))


@query("holdout_carve", f"WITH n AS (SELECT greatest(50, count(*) // 10) AS t FROM documents), r AS (SELECT doc_id, {CQ._RANK} - 1 AS p FROM documents) SELECT doc_id, CASE WHEN p < t THEN 'test' ELSE 'train' END AS split FROM r, n")
def holdout_carve(spark, sf_dir):
    """P1 where only a training split exists."""
    return C.carve_holdout(table(spark, sf_dir, "documents").select("doc_id"), 42)


_TOP = "SELECT lang, list({{'value': v, 'n': n}} ORDER BY n DESC, f, v)[1 : 5] AS top FROM (SELECT lang, {0} AS v, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2) GROUP BY lang"


_SUMMARY = f"WITH b AS ({CQ.ORACLES['task_stats']}), s AS ({_TOP.format('source')}), a AS ({_TOP.format('substr(text, 1, 30)')}) SELECT b.*, array_to_string([x.value || '=' || x.n FOR x IN s.top], ';') AS top5, array_to_string([x.value || '=' || x.n FOR x IN a.top], ';') AS answers FROM b JOIN s USING (lang) JOIN a USING (lang)"


@query("task_summary", _SUMMARY)
def task_summary(spark, sf_dir):
    """A1 with its top-5 columns."""
    out = Q.task_summary(table(spark, sf_dir, "documents"), ["lang"], X.word_count("text"), "source", "text", "doc_id")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ";")
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "n_specialties", said("top5_specialties").alias("top5"), said("answer_distribution_top5").alias("answers"))


@query("step_intervals", "SELECT lang, steps, greatest(1, CAST(floor(steps * 0.05) AS BIGINT)) AS warmup_steps, greatest(1, CAST(floor(steps * 0.25) AS BIGINT)) AS save_steps FROM (SELECT lang, CAST(ceil(count(*) / 32.0) * 3 AS BIGINT) AS steps FROM documents GROUP BY lang)")
def step_intervals(spark, sf_dir):
    """P16's warm-up and save intervals."""
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(C.training_steps(F.count("*"), 8, 4, 3).cast("long").alias("steps"))
    return n.select("lang", "steps", C.step_intervals(F.col("steps")).alias("x")).select("lang", "steps", "x.*")


@query("val_split_head", CQ._REPLAY + ", k AS (SELECT count(*) AS c, least(greatest(200, CAST(floor(count(*) * 0.02) AS BIGINT)), count(*) // 2) AS v FROM mix) SELECT doc_id, CASE WHEN pos < v THEN 'val' ELSE 'train' END AS split FROM mix, k")
def val_split_head(spark, sf_dir):
    """The head of the ordered corpus."""
    return C.validation_split(CQ._replayed(spark, sf_dir), tail=False).select("doc_id", "split")


@query("curriculum_ascending", CQ._PPL + "SELECT doc_id, row_number() OVER (ORDER BY round(ppl, 6), doc_id) - 1 AS pos FROM ppl")
def curriculum_ascending(spark, sf_dir):
    """Ascending perplexity."""
    scored = C.unigram_perplexity(table(spark, sf_dir, "documents")).select("doc_id", scaled_round("ppl", 6).alias("ppl"))
    return C.curriculum(scored, scheme="ascending").select("doc_id", "pos")
