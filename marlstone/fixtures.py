"""Views that give the driver's tables the shape the engine works on, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chains import tokens

#: Family by the first digit of an order's priority.
FAMILY = {"1": "direct", "2": "platform_like", "3": "telephony", "4": "simreplay", "5": "hybrid"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order with lines; its first four lines are the operators of a chain."""
    flag = F.col("l_returnflag")
    op = F.struct(
        F.when(flag == "A", "codec").when(flag == "N", "noise").otherwise("packet_loss").alias("op"), F.when(flag == "A", F.col("l_quantity")).alias("bitrate"),
        F.when(flag == "N", F.col("l_quantity")).alias("snr_db"), F.when(flag == "R", F.round(100 * F.col("l_discount"))).alias("loss_rate_pct"),
    )
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", op.alias("op"))
    chains = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(line)), 1, 4).alias("lines"))  # an order has few lines
    orders = table(spark, sf_dir, "orders").join(chains, F.col("o_orderkey") == F.col("l_orderkey"))
    parent = F.floor(F.col("o_custkey") / 30).cast("long")
    families = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    made = orders.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("sample_id"), parent.cast("string").alias("parent_id"), families[F.substring("o_orderpriority", 1, 1)].alias("chain_family"),
        F.when(F.col("o_orderstatus") == "F", "bona_fide").otherwise("spoof").alias("label"), F.when(parent % 5 <= 2, "train").when(parent % 5 == 3, "dev").otherwise("test").alias("split"),
        F.col("o_custkey").alias("speaker_id"), F.to_json(F.transform("lines", lambda x: x["op"])).alias("operator_params"), tokens(F.transform("lines", lambda x: x["op"]), ("bitrate", "snr_db", "loss_rate_pct")).alias("sig"), F.concat(F.lit("len"), F.size("lines").cast("string")).alias("chain_template_id"),
        F.col("o_totalprice").alias("score"), F.round(F.col("o_totalprice"), -4).alias("score_coarse"),
    )
    return made


DELIVERIES = """
lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
    CASE l_returnflag
      WHEN 'A' THEN 'codec[bitrate=' || CASE WHEN l_quantity <= 16 THEN 'very_low' WHEN l_quantity <= 24 THEN 'low' WHEN l_quantity <= 32 THEN 'medium' ELSE 'high' END || ']'
      WHEN 'N' THEN 'noise[snr=' || CASE WHEN l_quantity <= 12 THEN 'low' WHEN l_quantity <= 24 THEN 'medium' ELSE 'high' END || ']'
      ELSE 'packet_loss[plr=' || CASE WHEN round(100 * l_discount) <= 2 THEN 'light' WHEN round(100 * l_discount) <= 5 THEN 'moderate' ELSE 'severe' END || ']' END AS tok,
    l_returnflag, l_quantity, l_discount
  FROM lineitem
), sigs AS (SELECT l_orderkey, list(tok ORDER BY rn) AS sig FROM lines WHERE rn <= 4 GROUP BY 1),
deliveries AS (
  SELECT o_orderkey AS ord, 'o' || o_orderkey AS sample_id, CAST(o_custkey // 30 AS VARCHAR) AS parent_id,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'direct' WHEN '2' THEN 'platform_like' WHEN '3' THEN 'telephony' WHEN '4' THEN 'simreplay' ELSE 'hybrid' END AS chain_family,
    CASE WHEN o_orderstatus = 'F' THEN 'bona_fide' ELSE 'spoof' END AS label,
    CASE WHEN (o_custkey // 30) % 5 <= 2 THEN 'train' WHEN (o_custkey // 30) % 5 = 3 THEN 'dev' ELSE 'test' END AS split,
    o_custkey AS speaker_id, 'len' || len(sig) AS chain_template_id, o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, sig
  FROM orders JOIN sigs ON l_orderkey = o_orderkey
)"""


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: label is their quality, score their length."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").cast("string").alias("label"), "lang", "source")


DOC_SCORES = "doc_scores AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, CAST(n_chars AS DOUBLE) AS s, quality AS y, lang, source FROM labels JOIN documents USING (doc_id))"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as references and their followers as hypotheses."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("reference"), "hypothesis")


TRANSCRIPTS = r"""
normal AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM conversations),
transcripts AS (SELECT a.conv_id, a.turn, a.text AS reference, b.text AS hypothesis FROM normal a JOIN normal b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
