"""The engine's queries over the test tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokenizers as tok
from ..operators import chunks, ledger, neardup, order, packing, pipelines, profile, quality, scoring, splits, stats
from ..session import materialize, shared_dir, table
from ..sources import readers
from ..streaming import ledger as streams
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEQ_LEN, BUDGET, SEED = 512, 510, 42
#: The vocabulary file that the BPE queries derive their family from.
BPE_FILE = os.environ.get("LOOMCORPUS_BPE", "/opt/tokenizers/byte_bpe_50k.json")
FAMILY = {"bpe_6400": 6400, "bpe_16384": 16384}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _big(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and decimals as they are, so that types agree with the oracle's."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# Scans and identity


@query(f"""SELECT count(*) AS "rows", count(text) AS texts, count(DISTINCT line) AS "lines", CAST(coalesce(sum(CASE WHEN text IS NULL OR regexp_matches(text, {S.BLANK}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS bad FROM train""")
def scan_validate(spark, d):
    t = table(spark, d, "train")
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count("text").alias("texts"), F.countDistinct("line").alias("lines"), F.coalesce(F.sum(T.is_blank("text").cast("bigint")), F.lit(0)).alias("bad"))


@query("SELECT doc_id, sha256(text) AS key, length(text) AS chars, strlen(text) AS bytes, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk FROM documents")
def content_key(spark, d):
    t = table(spark, d, "documents")
    return _big(t.select("doc_id", T.content_key("text").alias("key"), F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), T.has_cjk("text").alias("cjk")))


@query(f"""SELECT key, min(line) AS line, count(*) AS copies FROM {S.keyed("train", "line")} GROUP BY key HAVING count(*) > 1""")
def exact_dup_groups(spark, d):
    return splits.first_of_each(splits.keyed(table(spark, d, "train")), "line").filter("copies > 1")


@query(f"""SELECT key, min(doc_id) AS doc_id, count(*) AS copies FROM {S.keyed("documents", "doc_id")} GROUP BY key""")
def dedup_first(spark, d):
    return splits.first_of_each(splits.keyed(table(spark, d, "documents")), "doc_id")


# Splits


@query(f"""SELECT line, CASE WHEN rank() OVER (ORDER BY {S.hash60("'42:' || line")}) <= 150 THEN 'val' ELSE 'train' END AS split FROM train""")
def split_rowhash(spark, d):
    return splits.split_by_row_hash(table(spark, d, "train").select("line"), "line", 150).select("line", "split")


def _split_sides(spark, d):
    val = splits.keyed(table(spark, d, "val_large")).select("doc", "split", "key")
    return splits.keyed(table(spark, d, "train")).select("line", "key"), val, val.filter("split = 'val_old'")


_SIDES = f"""WITH t AS {S.keyed("train", "line")}, v AS {S.keyed("val_large", "doc, split")},
held AS (SELECT DISTINCT key FROM v WHERE key NOT IN (SELECT key FROM v WHERE split = 'val_old'))"""


@query(f"{_SIDES} SELECT key FROM held")
def holdout_exclude(spark, d):
    train, val, old = _split_sides(spark, d)
    return splits.holdout(train, val, old)["val"]


@query(f"{_SIDES} SELECT line, key IN (SELECT key FROM held) AS held FROM t")
def holdout_partition(spark, d):
    train, val, old = _split_sides(spark, d)
    h = splits.holdout(train, val, old)
    return h["train"].select("line", F.lit(False).alias("held")).unionByName(h["heldout"].select("line", F.lit(True).alias("held")))


@query(f"{_SIDES} SELECT DISTINCT key FROM t WHERE key NOT IN (SELECT key FROM v WHERE split = 'val_old') ORDER BY key LIMIT 100")
def hash_bottom_k_val(spark, d):
    train, _, old = _split_sides(spark, d)
    return splits.bottom_k(train, old, old.select("key").distinct().count() + 100)


_FROZEN = f"""{_SIDES}, o AS (SELECT key, min(doc) AS ord, 0 AS is_new FROM v WHERE split = 'val_old' GROUP BY key),
nw AS (SELECT DISTINCT key, 0 AS ord, 1 AS is_new FROM t WHERE key NOT IN (SELECT key FROM o) ORDER BY key LIMIT 100),
frozen AS (SELECT row_number() OVER (ORDER BY is_new, ord, key) - 1 AS i, key, CAST(is_new AS BIGINT) AS is_new FROM (SELECT * FROM o UNION ALL SELECT * FROM nw))"""


@query(f"{_FROZEN} SELECT i, key, is_new FROM frozen")
def val_freeze_manifest(spark, d):
    train, _, old = _split_sides(spark, d)
    return _big(splits.freeze(train, old, "doc", old.select("key").distinct().count() + 100))


@query(f"{_FROZEN} SELECT count(*) AS rows_read, CAST(sum(CASE WHEN key IN (SELECT key FROM frozen) THEN 1 ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN key NOT IN (SELECT key FROM frozen) THEN 1 ELSE 0 END) AS BIGINT) AS written, count(DISTINCT CASE WHEN key NOT IN (SELECT key FROM frozen) THEN key END) AS unique_written FROM t")
def val_freeze_accounting(spark, d):
    """Rows read, removed with the frozen set, and written."""
    train, _, old = _split_sides(spark, d)
    frozen = splits.freeze(train, old, "doc", old.select("key").distinct().count() + 100)
    marked = train.join(frozen.select("key", F.lit(1).alias("hit")), "key", "left")
    gone = F.col("hit").isNotNull()
    return marked.agg(F.count(F.lit(1)).alias("rows_read"), F.sum(gone.cast("bigint")).alias("removed"), F.sum((~gone).cast("bigint")).alias("written"), F.countDistinct(F.when(~gone, F.col("key"))).alias("unique_written"))


@query(f"""{_SIDES} SELECT (SELECT count(*) FROM (SELECT key FROM t INTERSECT SELECT key FROM v)) AS both, (SELECT count(*) FROM (SELECT key FROM t UNION SELECT key FROM v)) AS either, (SELECT count(*) FROM (SELECT key FROM v EXCEPT SELECT key FROM t)) AS val_only, (SELECT count(*) FROM v) - (SELECT count(DISTINCT key) FROM v) AS val_duplicates""")
def overlap_check(spark, d):
    train, val, _ = _split_sides(spark, d)
    sides = train.select("key", F.lit(1).alias("t"), F.lit(0).alias("v")).unionByName(val.select("key", F.lit(0).alias("t"), F.lit(1).alias("v")))
    per = sides.groupBy("key").agg(F.sum("t").alias("t"), F.sum("v").alias("v"))
    has = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return per.agg(has((F.col("t") > 0) & (F.col("v") > 0)).alias("both"), F.count(F.lit(1)).alias("either"), has((F.col("t") == 0) & (F.col("v") > 0)).alias("val_only"), (F.coalesce(F.sum("v"), F.lit(0)) - has(F.col("v") > 0)).alias("val_duplicates"))


@query(f"""WITH m AS (SELECT DISTINCT i, lower(sha256) AS sha256 FROM val_manifest WHERE i IS NOT NULL AND sha256 IS NOT NULL), u AS (SELECT key, min(doc) AS line FROM {S.keyed("val_large", "doc")} GROUP BY key)
SELECT i, sha256, line FROM m LEFT JOIN u ON sha256 = key""")
def rebuild_from_manifest(spark, d):
    return splits.rebuild(table(spark, d, "val_manifest"), splits.keyed(table(spark, d, "val_large")), "doc")


@query(f"""WITH k AS (SELECT DISTINCT key FROM {S.keyed("train", "line")}) SELECT key FROM k ORDER BY {S.hash60("'42:' || key")} LIMIT 200""")
def reservoir_hash_sample(spark, d):
    return splits.sample(splits.keyed(table(spark, d, "train")), 200).select("key")


@query(f"""SELECT doc_id, row_number() OVER (ORDER BY {S.hash60("'42:' || doc_id")}, doc_id) - 1 AS pos FROM documents""")
def seeded_order(spark, d):
    return splits.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", SEED).select("doc_id", "pos")


# Near-duplicate audit


@query(f"""SELECT doc AS item_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, w FROM ({S.WINDOWED.format(doc="item_id", table="benchmark")})""")
def char_windows(spark, d):
    return _big(neardup.windows(table(spark, d, "benchmark"), "item_id").select(F.col("doc").alias("item_id"), "s", "e", "w"))


def _audit(spark, d) -> neardup.Audit:
    return neardup.Audit(table(spark, d, "val_large"), "doc", table(spark, d, "train"), "line")


@query(f"{S.AUDIT} SELECT w, df FROM f")
def window_doc_freq(spark, d):
    return _audit(spark, d).doc_freq().select("w", "df")


@query(f"{S.AUDIT} SELECT bucket, CAST((SELECT count(*) FROM f WHERE df BETWEEN lo AND hi) AS BIGINT) AS windows FROM (VALUES ('1', 1, 1), ('2', 2, 2), ('3-10', 3, 10), ('11-100', 11, 100), ('101-1000', 101, 1000), ('>1000', 1001, 9000000000)) b(bucket, lo, hi)")
def doc_freq_histogram(spark, d):
    return _audit(spark, d).histogram()


_PAIR = "doc, line, hits_raw, covered_raw, hits_flt, covered_flt, round(coverage_raw, 6) AS coverage_raw, round(coverage_flt, 6) AS coverage_flt"


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc", "line", "hits_raw", "covered_raw", "hits_flt", "covered_flt", F.round("coverage_raw", 6).alias("coverage_raw"), F.round("coverage_flt", 6).alias("coverage_flt"), *more)


@query(f"{S.AUDIT} SELECT {_PAIR} FROM pairs")
def neardup_pairs(spark, d):
    return _rounded(_audit(spark, d).pairs())


@query(f"{S.AUDIT} SELECT {_PAIR}, rule FROM flagged")
def neardup_flags(spark, d):
    return _rounded(_audit(spark, d).flagged(), "rule")


@query(f"""{S.AUDIT}, best AS (SELECT doc, max(hits_raw) AS b FROM pairs GROUP BY doc)
SELECT CAST(m AS BIGINT) AS m, count(b) AS docs, round(count(b) / (SELECT count(*) FROM val), 6) AS rate FROM (VALUES (1), (2), (3), (4), (5)) g(m) LEFT JOIN best ON b >= m GROUP BY m""")
def neardup_sensitivity_hits(spark, d):
    return _big(_audit(spark, d).sensitivity_hits())


@query(f"""{S.AUDIT}, best AS (SELECT doc, m, coalesce(max(CASE WHEN hits_flt >= m THEN coverage_flt END), 0) AS b FROM pairs, (VALUES (1), (2), (3), (4), (5)) g(m) GROUP BY doc, m)
SELECT CAST(m AS BIGINT) AS m, c, CAST((SELECT count(*) FROM best WHERE best.m = g.m AND b >= c) AS BIGINT) AS docs FROM (VALUES (1), (2), (3), (4), (5)) g(m), (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5), (0.75), (0.9), (1.0)) h(c)""")
def neardup_sensitivity_grid(spark, d):
    return _big(_audit(spark, d).sensitivity_grid())


@query(f"{S.AUDIT} SELECT doc, line, rule, CAST(rank AS BIGINT) AS rank, matched FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line) AS rank, count(*) OVER (PARTITION BY doc) AS matched FROM flagged) WHERE rank <= 20")
def neardup_top_hits(spark, d):
    return _big(_audit(spark, d).top_hits().select("doc", "line", "rule", "rank", "matched"))


@query(f"{S.AUDIT} SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS i FROM val WHERE doc NOT IN (SELECT doc FROM flagged)")
def neardup_apply(spark, d):
    return _audit(spark, d).kept().select("doc", "i")


@query(f"""{S.AUDIT}, s AS (SELECT doc, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'contains_cjk' ELSE 'no_cjk' END AS script, doc IN (SELECT doc FROM flagged) AS hit FROM val_large WHERE text IS NOT NULL)
SELECT script, count(*) AS docs, CAST(sum(hit::INT) AS BIGINT) AS hits, round(avg(hit::INT), 6) AS rate FROM s GROUP BY script""")
def bias_by_script(spark, d):
    flagged = _audit(spark, d).flagged().select("doc").distinct().withColumn("hit", F.lit(1))
    v = table(spark, d, "val_large").filter("text is not null").select("doc", F.when(T.has_cjk("text"), "contains_cjk").otherwise("no_cjk").alias("script"))
    hit = F.coalesce("hit", F.lit(0))
    return v.join(flagged, "doc", "left").groupBy("script").agg(F.count(F.lit(1)).alias("docs"), F.sum(hit).cast("bigint").alias("hits"), F.round(F.avg(hit), 6).alias("rate"))


# Tokenizer profiles


_GROUPS = "CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(chars) AS BIGINT) AS tokens, round(sum(chars) / sum(chars), 6) AS chars_per_token, round(sum(bytes) / sum(chars), 6) AS bytes_per_token"


@query(f"""WITH s AS (SELECT CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'contains_cjk' ELSE 'no_cjk' END AS c, length(text) AS chars, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL)
SELECT coalesce(c, 'all') AS grp, count(*) AS docs, {_GROUPS} FROM s GROUP BY GROUPING SETS ((), (c))""")
def cjk_group_stats(spark, d):
    return profile.by_script(table(spark, d, "documents").withColumn("tokens", tok.char_tokens()))


@query(f"""SELECT count(*) AS docs, CAST(sum(greatest(0, {SEQ_LEN} - length(text) - 2)) AS BIGINT) AS pad, CAST(sum((length(text) > {SEQ_LEN} - 2)::INT) AS BIGINT) AS truncated, round(sum(greatest(0, {SEQ_LEN} - length(text) - 2)) / (count(*) * {SEQ_LEN}), 6) AS share FROM documents WHERE text IS NOT NULL""")
def padding_truncation(spark, d):
    return profile.padding(table(spark, d, "documents").withColumn("tokens", tok.char_tokens()), SEQ_LEN)


@query(f"""WITH r AS (SELECT 'char' AS tok, length(text) AS tokens, strlen(text) AS bytes FROM val_large WHERE text IS NOT NULL UNION ALL SELECT 'byte', strlen(text), strlen(text) FROM val_large WHERE text IS NOT NULL), c AS (SELECT *, -(-tokens // {BUDGET}) AS c FROM r)
SELECT tok, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum((c > 1)::INT) AS BIGINT) AS multi_docs, round(100 * sum(CASE WHEN c > 1 THEN bytes ELSE 0 END) / sum(bytes), 4) AS multi_bytes_pct FROM c GROUP BY tok""".replace("-(-tokens // 510)", "CAST(ceil(tokens / 510.0) AS BIGINT)"))
def mirror_confusion(spark, d):
    v = table(spark, d, "val_large").filter("text is not null")
    rows = v.select("doc", tok.byte_tokens().alias("bytes"), F.explode(F.array(F.struct(F.lit("char").alias("tok"), tok.char_tokens().alias("tokens")), F.struct(F.lit("byte").alias("tok"), tok.byte_tokens().alias("tokens")))).alias("x"))
    return stats.mirror_confusion(rows.select("doc", "bytes", "x.*"), BUDGET)


@query("""WITH h AS (SELECT hex(text) AS x FROM val_large WHERE text IS NOT NULL), p AS (SELECT substring(x, CAST(2 * k + 1 AS INT), 4) AS p FROM (SELECT x, unnest(range(0, length(x) // 2 - 1)) AS k FROM h))
SELECT CAST('0x' || substr(p, 1, 2) AS BIGINT) AS a, CAST('0x' || substr(p, 3, 2) AS BIGINT) AS b, count(*) AS n FROM p GROUP BY p""")
def byte_pairs(spark, d):
    return tok.byte_pairs(table(spark, d, "val_large"))


# Packing


def _by_hash(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text", tok.char_tokens().alias("tokens"), tok.byte_tokens().alias("bytes"), T.seeded(SEED, "doc_id").alias("h"))


def _placed(spark, d) -> DataFrame:
    return packing.offsets(_by_hash(spark, d), ["h", "doc_id"])


@query(f"{S.PLACED} SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(bytes_before AS BIGINT) AS bytes_before FROM p")
def pack_offsets(spark, d):
    return packing.offsets(_by_hash(spark, d).drop("text"), ["h", "doc_id"]).select("doc_id", "start", "bytes_before")


@query(f"""SELECT docs, text_tokens, structural_tokens, stream, stream // {SEQ_LEN} AS n_seq, stream % {SEQ_LEN} AS tail, bytes, round(bytes / stream, 6) AS bytes_per_token
FROM (SELECT count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS text_tokens, 2 * count(*) AS structural_tokens, CAST(sum(length(text) + 2) AS BIGINT) AS stream, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL)""")
def pack_totals(spark, d):
    return packing.totals(_by_hash(spark, d), SEQ_LEN)


def _cum(spark, d) -> DataFrame:
    n_seq = packing.totals(_by_hash(spark, d), SEQ_LEN).first()["n_seq"]
    return packing.block_bytes(_placed(spark, d), SEQ_LEN, n_seq, packing.char_widths)


_CUM = f"""{S.PLACED}, b AS (SELECT *, unnest(range(CAST(start // {SEQ_LEN} AS BIGINT), CAST((start + tokens + 1) // {SEQ_LEN} AS BIGINT) + 1)) AS seq_id FROM p),
c AS (SELECT seq_id, CAST(max(bytes_before + strlen(substring(text, 1, CAST(least(greatest((seq_id + 1) * {SEQ_LEN} - start - 1, 0), tokens) AS INT)))) AS BIGINT) AS bytes_cum FROM b
      WHERE seq_id < (SELECT sum(tokens + 2) // {SEQ_LEN} FROM d) GROUP BY seq_id)"""


@query(f"{_CUM} SELECT seq_id, bytes_cum FROM c")
def pack_block_bytes(spark, d):
    return _cum(spark, d)


_DELTA = f"{_CUM}, dl AS (SELECT seq_id, bytes_cum, bytes_cum - lag(bytes_cum, 1, 0) OVER (ORDER BY seq_id) AS bytes_delta FROM c)"


@query(f"{_DELTA} SELECT seq_id, bytes_cum, bytes_delta FROM dl")
def bytes_delta(spark, d):
    return packing.deltas(_cum(spark, d))


@query(f"{_DELTA} SELECT seq_id // 32 + 1 AS step, count(*) AS seqs, CAST(sum(bytes_delta) AS BIGINT) AS bytes FROM dl GROUP BY 1")
def pack_updates(spark, d):
    return packing.updates(packing.deltas(_cum(spark, d)), 32)


@query(f"{_DELTA} SELECT count(*) AS blocks, CAST(sum((bytes_delta < 0)::INT) AS BIGINT) AS falls, max(bytes_cum) AS last, (SELECT CAST(sum(bytes) AS BIGINT) FROM d) AS total FROM dl")
def pack_monotone(spark, d):
    """Cumulative bytes never fall, and end within the corpus."""
    total = _by_hash(spark, d).agg(F.sum("bytes").alias("total"))
    one = packing.deltas(_cum(spark, d)).agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.col("bytes_delta") < 0).cast("bigint")).alias("falls"), F.max("bytes_cum").alias("last"))
    return one.join(F.broadcast(total), how="cross")  # one row each


# Chunks


@query(f"""SELECT doc, k AS chunk, k * {BUDGET} AS cs, least((k + 1) * {BUDGET}, n) AS ce, strlen(substring(text, CAST(k * {BUDGET} + 1 AS INT), {BUDGET})) AS utf8_bytes
FROM (SELECT doc, text, length(text) AS n, unnest(range(0, (length(text) - 1) // {BUDGET} + 1)) AS k FROM val_large WHERE length(text) > 0)""")
def chunks_char(spark, d):
    return chunks.char_chunks(table(spark, d, "val_large"), "doc", BUDGET)


_CHUNKS = """WITH v AS (SELECT doc, min(length(text)) AS n FROM val_large WHERE text IS NOT NULL GROUP BY doc), r AS (SELECT DISTINCT doc, chunk, cs, ce FROM eval_chunks_v3),
e AS (SELECT doc, chunk, cs, coalesce(ce, n) AS ce, n FROM r JOIN v USING (doc)), g AS (SELECT *, (cs <> coalesce(lag(ce) OVER (PARTITION BY doc ORDER BY chunk, cs), 0))::INT AS gap FROM e),
per AS (SELECT doc, count(*) AS chunks, CAST(sum(gap) AS BIGINT) AS gaps, max(ce) AS last FROM g GROUP BY doc), al AS (SELECT doc FROM v UNION SELECT doc FROM r WHERE doc IS NOT NULL),
cov AS (SELECT al.doc, chunks, n, gaps, coalesce(gaps = 0 AND last = n, false) AS covers FROM al LEFT JOIN v ON al.doc = v.doc LEFT JOIN per ON al.doc = per.doc)"""


@query(f"{_CHUNKS} SELECT doc, chunks, n, gaps, covers FROM cov")
def chunk_contiguity(spark, d):
    return _big(chunks.contiguity(table(spark, d, "eval_chunks_v3").filter("doc is not null"), table(spark, d, "val_large"), "doc"))


@query("""WITH r AS (SELECT DISTINCT doc, chunk, cs, ce, utf8_bytes FROM eval_chunks_v3 WHERE doc IS NOT NULL AND cs IS NOT NULL)
SELECT doc, chunk, cs, coalesce(ce, length(text)) AS ce, utf8_bytes, strlen(substring(text, CAST(cs + 1 AS INT), CAST(coalesce(ce, length(text)) - cs AS INT))) AS true_bytes FROM r JOIN val_large USING (doc) WHERE text IS NOT NULL""")
def chunk_bytes(spark, d):
    return chunks.measured(table(spark, d, "eval_chunks_v3"), table(spark, d, "val_large"), "doc")


@query("""WITH r AS (SELECT DISTINCT doc, chunk, cs, coalesce(ce, length(text)) - cs AS n FROM eval_chunks_v3 JOIN val_large USING (doc) WHERE text IS NOT NULL AND cs IS NOT NULL) SELECT CAST(min(n) AS BIGINT) AS least, round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS greatest FROM r""")
def chunk_summary(spark, d):
    m = chunks.measured(table(spark, d, "eval_chunks_v3"), table(spark, d, "val_large"), "doc")
    return profile.summary(m.select("doc", "chunk", "cs", (F.col("ce") - F.col("cs")).alias("n")).distinct(), "n")


# Scores and statistics


def _sizes(spark, d) -> DataFrame:
    return table(spark, d, "val_large").filter("text is not null").groupBy("doc").agg(F.min(F.octet_length("text")).cast("bigint").alias("true_bytes"))


def _evals(spark, d) -> DataFrame:
    return stats.clean_eval(table(spark, d, "per_document_eval"), _sizes(spark, d))


def _ab(spark, d) -> DataFrame:
    e = _evals(spark, d)
    return stats.paired(e.filter("arm = 'A'"), e.filter("arm = 'B'"))


@query(f"{S.EVAL} SELECT arm, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(utf8_bytes) AS BIGINT) AS bytes, round(sum(nll) / sum(tokens), 6) AS loss, round(exp(sum(nll) / sum(tokens)), 4) AS ppl, round(sum(nll) / (ln(2) * sum(utf8_bytes)), 6) AS bpb FROM ev GROUP BY arm")
def bpb_by_arm(spark, d):
    return stats.summary(_evals(spark, d), ["arm"])


_SE = "SELECT {k}count(*) AS n, round(max(ratio), 6) AS ratio, round(sqrt(count(*) * var_samp({y} - ratio * {x})) / sum({x}), 9) AS se FROM {t}"


@query(f"""{S.EVAL}, r AS (SELECT arm, nll / ln(2) AS y, utf8_bytes AS x, sum(nll / ln(2)) OVER (PARTITION BY arm) / sum(utf8_bytes) OVER (PARTITION BY arm) AS ratio FROM ev) {_SE.format(k="arm, ", y="y", x="x", t="r")} GROUP BY arm""")
def ratio_se(spark, d):
    r = stats.ratio_se(_evals(spark, d).withColumn("y", F.col("nll") / stats.LN2), "y", "utf8_bytes", ["arm"])
    return r.select("arm", "n", F.round("ratio", 6).alias("ratio"), F.round("se", 9).alias("se"))


@query(f"""WITH r AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x, sum(l_extendedprice) OVER (PARTITION BY l_returnflag) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS ratio FROM lineitem) SELECT l_returnflag, count(*) AS n, round(max(ratio), 4) AS ratio, round(sqrt(count(*) * var_samp(y - ratio * x)) / sum(x), 6) AS se FROM r GROUP BY l_returnflag""")
def lineitem_ratio_se(spark, d):
    """The same estimator on a wide fact table."""
    r = stats.ratio_se(table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x")), "y", "x", ["l_returnflag"])
    return r.select("l_returnflag", "n", F.round("ratio", 4).alias("ratio"), F.round("se", 6).alias("se"))


@query(f"""{S.EVAL}, y AS (SELECT nll_a / ln(2) AS ya, nll_b / ln(2) AS yb, (nll_a - nll_b) / ln(2) AS yd, x FROM ab), r AS (SELECT *, sum(ya) OVER () / sum(x) OVER () AS ra, sum(yb) OVER () / sum(x) OVER () AS rb, sum(yd) OVER () / sum(x) OVER () AS rd FROM y),
o AS (SELECT count(*) AS n, max(ra) AS bpb_a, max(rb) AS bpb_b, max(rd) AS delta, sqrt(count(*) * var_samp(ya - ra * x)) / sum(x) AS sa, sqrt(count(*) * var_samp(yb - rb * x)) / sum(x) AS sb, sqrt(count(*) * var_samp(yd - rd * x)) / sum(x) AS sd FROM r)
SELECT n, round(bpb_a, 6) AS bpb_a, round(bpb_b, 6) AS bpb_b, round(delta, 6) AS delta, round(sqrt(sa * sa + sb * sb), 8) AS unpaired_se, round(sd, 8) AS paired_se, round(sqrt(sa * sa + sb * sb) / sd, 4) AS gain FROM o""")
def paired_se(spark, d):
    p = stats.paired_se(_ab(spark, d))
    digits = {"bpb_a": 6, "bpb_b": 6, "delta": 6, "unpaired_se": 8, "paired_se": 8, "gain": 4}
    return p.select("n", *[F.round(c, k).alias(c) for c, k in digits.items()])


RESAMPLES = 2000
_BOOT = f"""{S.EVAL}, p AS (SELECT row_number() OVER (ORDER BY doc) - 1 AS j, CAST(round((nll_a - nll_b) * 1e6) AS BIGINT) AS dd, x FROM ab),
dr AS (SELECT r, {S.hash60("'0:' || r || ':' || k")} % (SELECT count(*) FROM p) AS j FROM range({RESAMPLES}) a(r), (SELECT unnest(range((SELECT count(*) FROM p))) AS k) b),
bo AS (SELECT r, CAST(sum(dd) AS BIGINT) AS num, CAST(sum(x) AS BIGINT) AS den FROM dr JOIN p USING (j) GROUP BY r)"""


@query(f"{_BOOT} SELECT r, num, den FROM bo")
def bootstrap_hash(spark, d):
    return stats.bootstrap(_ab(spark, d), RESAMPLES)


@query(f"""{_BOOT}, z AS (SELECT (num / 1e6) / (ln(2) * den) AS z, row_number() OVER (ORDER BY (num / 1e6) / (ln(2) * den)) - 1 AS k FROM bo),
o AS (SELECT count(*) AS resamples, avg(z) AS mean, stddev_samp(z) AS sd, max(CASE WHEN k = {int(0.025 * RESAMPLES)} THEN z END) AS lo, max(CASE WHEN k = {int(0.975 * RESAMPLES)} THEN z END) AS hi FROM z)
SELECT resamples, round(mean, 8) AS mean, round(sd, 8) AS sd, round(lo, 8) AS lo, round(hi, 8) AS hi, round(2 * sd, 8) AS mde, lo > 0 OR hi < 0 AS excludes_zero FROM o""")
def bootstrap_interval(spark, d):
    return stats.interval(stats.bootstrap(_ab(spark, d), RESAMPLES), RESAMPLES)


@query(f"{S.EVAL} SELECT coalesce(a.doc, b.doc) AS doc, a.utf8_bytes AS bytes_a, b.utf8_bytes AS bytes_b, coalesce(a.utf8_bytes = b.utf8_bytes, false) AS aligned FROM (SELECT * FROM ev WHERE arm = 'A') a FULL JOIN (SELECT * FROM ev WHERE arm = 'B') b ON a.doc = b.doc")
def eval_alignment(spark, d):
    return _ab(spark, d).select("doc", "bytes_a", "bytes_b", "aligned")


@query(f"""WITH s AS (SELECT split, length(text) AS n, strlen(text) AS b FROM val_large WHERE text IS NOT NULL) SELECT split, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(b) AS BIGINT) AS bytes, round(sum(n) * ln(6400) / (ln(2) * sum(b)), 6) AS bpb FROM s GROUP BY split""")
def bpb_uniform(spark, d):
    v = table(spark, d, "val_large").filter("text is not null").select("split", tok.char_tokens().alias("tokens"), tok.byte_tokens().alias("utf8_bytes"))
    scored = v.withColumn("nll", scoring.uniform("tokens", 6400))
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum("utf8_bytes").alias("bytes"), F.round(stats.bpb(), 6).alias("bpb"))


@query("""WITH tc AS (SELECT ch, count(*) AS c FROM (SELECT unnest(string_split(text, '')) AS ch FROM train WHERE text IS NOT NULL AND text <> '') GROUP BY ch), tot AS (SELECT sum(c) AS n, count(*) AS v FROM tc),
vc AS (SELECT doc, ch, count(*) AS c FROM (SELECT doc, unnest(string_split(text, '')) AS ch FROM val_large WHERE text IS NOT NULL AND text <> '') GROUP BY doc, ch)
SELECT doc, CAST(sum(vc.c) AS BIGINT) AS tokens, round(-sum(vc.c * ln((coalesce(tc.c, 0) + 1) / (n + v + 1))), 3) AS nll FROM vc LEFT JOIN tc USING (ch), tot GROUP BY doc""")
def unigram_nll(spark, d):
    counts = scoring.char_counts(table(spark, d, "train"))
    return scoring.unigram(table(spark, d, "val_large"), "doc", counts).select("doc", "tokens", F.round("nll", 3).alias("nll"))


# Ledgers


@query(f"{S.LEDGER} SELECT run_id, step, tokens_cum, utf8_bytes_cum, loss_nats_per_target, logged_at FROM l")
def ledger_latest(spark, d):
    return ledger.latest(table(spark, d, "run_ledger")).select("run_id", "step", "tokens_cum", "utf8_bytes_cum", "loss_nats_per_target", "logged_at")


@query(f"{S.LEDGER} SELECT run_id, step, {', '.join(f'{c} - coalesce(lag({c}) OVER (PARTITION BY run_id ORDER BY step), 0) AS d_{c.removesuffix("_cum")}' for c in ledger.COUNTERS)} FROM l")
def ledger_increments(spark, d):
    return ledger.per_update(ledger.latest(table(spark, d, "run_ledger")))


@query(f"{S.LEDGER} SELECT run_id, step, {', '.join(ledger.COUNTERS)} FROM l")
def ledger_cumulative(spark, d):
    """Running sums of the increments give the counters back."""
    return ledger.cumulative(ledger.per_update(ledger.latest(table(spark, d, "run_ledger"))))


@query(f"{S.LEDGER} SELECT run_id, step, round(loss_nats_per_target * targets_cum / (ln(2) * utf8_bytes_cum), 6) AS bpb, step % 100 = 0 AS sampled FROM l WHERE loss_nats_per_target IS NOT NULL")
def ledger_train_bpb(spark, d):
    rows = ledger.latest(table(spark, d, "run_ledger")).filter("loss_nats_per_target is not null")
    return rows.select("run_id", "step", F.round(ledger.train_bpb(), 6).alias("bpb"), (F.col("step") % 100 == 0).alias("sampled"))


_FALLS = " OR ".join(f"coalesce({c} < lag({c}) OVER w, false)" for c in ledger.COUNTERS)


@query(f"""{S.LEDGER}, m AS (SELECT run_id, ({_FALLS})::INT AS falls, coalesce(targets_cum <> text_targets_cum + structural_targets_cum, false)::INT AS split, coalesce(utf8_bytes_cum < 0, false)::INT AS negative FROM l WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, count(*) AS "rows", CAST(sum(falls) AS BIGINT) AS falls, CAST(sum(split) AS BIGINT) AS split, CAST(sum(negative) AS BIGINT) AS negative FROM m GROUP BY run_id""")
def ledger_invariants(spark, d):
    return ledger.invariants(ledger.latest(table(spark, d, "run_ledger")))


@query(f"{S.LEDGER}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS k FROM l WHERE loss_nats_per_target IS NOT NULL) SELECT run_id, count(*) AS n, round(avg(loss_nats_per_target), 6) AS tail_mean, round(max(CASE WHEN k = 1 THEN loss_nats_per_target END), 6) AS last FROM k WHERE k <= 20 GROUP BY run_id")
def tail_mean_20(spark, d):
    return ledger.tail_mean(ledger.latest(table(spark, d, "run_ledger")), "loss_nats_per_target")


@query(f"{S.LEDGER} SELECT run_id, step, tokens_cum FROM l WHERE step <= 50")
def ledger_retained(spark, d):
    return ledger.retained(ledger.latest(table(spark, d, "run_ledger")), 50).select("run_id", "step", "tokens_cum")


@query("""WITH x AS (SELECT 'Epoch:[1/1](' || step || '/5000), loss: ' || printf('%.4f', loss_nats_per_target) || ', lr: 0.1' AS value FROM run_ledger WHERE loss_nats_per_target IS NOT NULL AND step IS NOT NULL)
SELECT CAST(regexp_extract(value, '\\((\\d+)/(\\d+)\\), loss: ([0-9.]+)', 1) AS BIGINT) AS step, CAST(regexp_extract(value, '\\((\\d+)/(\\d+)\\), loss: ([0-9.]+)', 2) AS BIGINT) AS total, CAST(regexp_extract(value, '\\((\\d+)/(\\d+)\\), loss: ([0-9.]+)', 3) AS DOUBLE) AS loss FROM x""")
def log_regex_extract(spark, d):
    r = table(spark, d, "run_ledger").filter("loss_nats_per_target is not null and step is not null")
    return readers.log_losses(r.select(F.format_string("Epoch:[1/1](%d/5000), loss: %.4f, lr: 0.1", "step", "loss_nats_per_target").alias("value")))


@query("""WITH c AS (SELECT 1000 AS t, 20 AS w, 100 AS d, 0.0002 AS lr) SELECT s AS step, round(CASE WHEN s < w THEN lr * (s + 1) / w WHEN s < t - d THEN lr ELSE lr * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (s - (t - d)) / d))) END, 12) AS wsd, round(lr * (0.1 + 0.45 * (1 + cos(pi() * s / t))), 12) AS cosine FROM c, range(1000) r(s)""")
def lr_schedules(spark, d):
    s = F.col("id")
    return spark.range(1000).select(s.alias("step"), F.round(ledger.lr_wsd(s, 1000, 2e-4), 12).alias("wsd"), F.round(ledger.lr_cosine(s, 1000, 2e-4), 12).alias("cosine"))


@query(f"SELECT arm, p AS params, 6 * p + 12 * num_hidden_layers * hidden_size * {SEQ_LEN} AS flops FROM (SELECT *, CAST(vocab_size AS BIGINT) * hidden_size + num_hidden_layers * 12 * CAST(hidden_size AS BIGINT) * hidden_size AS p FROM arms)")
def flops_nominal(spark, d):
    a = table(spark, d, "arms").select("arm", *[F.col(c).cast("bigint").alias(c) for c in ("vocab_size", "hidden_size", "num_hidden_layers")])
    p = F.col("vocab_size") * F.col("hidden_size") + F.col("num_hidden_layers") * 12 * F.col("hidden_size") * F.col("hidden_size")
    return a.select("arm", p.alias("params"), ledger.flops_per_position(p, F.col("num_hidden_layers"), F.col("hidden_size"), SEQ_LEN).alias("flops"))


@query("SELECT CAST(16352 AS BIGINT) AS tokens_per_update, CAST(ceil(120000000 / 16352.0) AS BIGINT) AS updates")
def budget_plan(spark, d):
    p = ledger.plan(120_000_000, 8, 4, 512)
    return spark.createDataFrame([tuple(p.values())], "tokens_per_update bigint, updates bigint")


@query(f"{S.LEDGER} SELECT run_id, step, tokens_cum FROM l")
def stream_ledger(spark, d):
    """The ledger read as a stream to its end, merged batch by batch."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "run_ledger").schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = streams.read_stream(spark, f"{d}/run_ledger.parquet*", "parquet", schema.replace(":", " "))
    streams.accumulate(stream, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return streams.current(spark, f"{base}/state").select("run_id", "step", "tokens_cum")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    w = streams.event_windows(table(spark, d, "events"), "ts", ["event_type"], "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """The same windows kept by a stream over the events."""
    import uuid

    base = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    streams.keep_windows(streams.event_windows(stream, "ts", ["event_type"], "value"), f"{base}/windows", f"{base}/checkpoint").awaitTermination()
    w = streams.kept_windows(spark, f"{base}/windows")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# Gates


@query(f"""{_CHUNKS}, t AS {S.keyed("train", "line")}, vk AS {S.keyed("val_large", "doc, split")}, {S.LEDGER.removeprefix("WITH ")}, sz AS (SELECT doc, min(strlen(text)) AS true_bytes FROM val_large WHERE text IS NOT NULL GROUP BY doc)
SELECT 'train_rows' AS gate, CAST(sum((text IS NULL OR regexp_matches(text, {S.BLANK}))::INT) AS BIGINT) AS violations FROM train
UNION ALL SELECT 'val_old_duplicates', (SELECT count(*) - count(DISTINCT key) FROM vk WHERE split = 'val_old')
UNION ALL SELECT 'train_val_overlap', (SELECT count(*) FROM (SELECT key FROM t INTERSECT SELECT key FROM vk))
UNION ALL SELECT 'val_duplicates', (SELECT count(*) - count(DISTINCT key) FROM vk)
UNION ALL SELECT 'manifest_form', (SELECT CAST(sum((i IS NULL OR sha256 IS NULL OR NOT regexp_matches(sha256, '^[0-9a-fA-F]{{64}}$'))::INT) AS BIGINT) FROM val_manifest)
UNION ALL SELECT 'manifest_missing', (SELECT count(*) FROM (SELECT DISTINCT lower(sha256) FROM val_manifest WHERE sha256 IS NOT NULL EXCEPT SELECT key FROM vk))
UNION ALL SELECT 'chunk_coverage', (SELECT CAST(sum((NOT covers)::INT) AS BIGINT) FROM cov)
UNION ALL SELECT 'eval_bytes', (SELECT CAST(coalesce(sum((utf8_bytes <> true_bytes)::INT), 0) AS BIGINT) FROM per_document_eval JOIN sz USING (doc))
UNION ALL SELECT 'ledger_repeats', (SELECT count(*) FROM run_ledger WHERE run_id IS NOT NULL AND step IS NOT NULL) - (SELECT count(*) FROM l)""")
def quality_gates(spark, d):
    train, val, old = _split_sides(spark, d)
    m = table(spark, d, "val_manifest")
    form = m["i"].isNull() | m["sha256"].isNull() | ~m["sha256"].rlike("^[0-9a-fA-F]{64}$")
    cov = chunks.contiguity(table(spark, d, "eval_chunks_v3").filter("doc is not null"), table(spark, d, "val_large"), "doc")
    ev = table(spark, d, "per_document_eval").join(_sizes(spark, d), "doc")
    led = table(spark, d, "run_ledger").dropna(subset=["run_id", "step"])
    return quality.report([
        quality.rows(table(spark, d, "train"), "train_rows", T.is_blank("text")),
        quality.duplicates(old, "val_old_duplicates", ["key"]),
        quality.overlap(train, val, "train_val_overlap", "key"),
        quality.duplicates(val, "val_duplicates", ["key"]),
        quality.rows(m, "manifest_form", form),
        quality.missing(m.filter("sha256 is not null").select(F.lower("sha256").alias("key")), val, "manifest_missing", "key"),
        quality.rows(cov, "chunk_coverage", ~F.col("covers")),
        quality.rows(ev, "eval_bytes", F.coalesce(F.col("utf8_bytes") != F.col("true_bytes"), F.lit(False))),
        quality.duplicates(led, "ledger_repeats", ["run_id", "step"]),
    ])


# Pipelines: counts and gates (all 0 where the rules hold)


def _counts(gates: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """Gates, and rows of the tables that came out, as name and value."""
    out = gates.select(F.col("gate").alias("name"), F.col("violations").alias("value"))
    for name, df in counts.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value"))
    return out


@query(f"""{_SIDES}, tr AS (SELECT key FROM t WHERE key NOT IN (SELECT key FROM held))
SELECT unnest(['source_rows', 'train_val', 'exclude_val', 'sample_val', 'train_empty', 'sample_size']) AS name, CAST(0 AS BIGINT) AS value
UNION ALL SELECT 'train', count(*) FROM tr UNION ALL SELECT 'heldout', (SELECT count(*) FROM t) - count(*) FROM tr UNION ALL SELECT 'val', count(*) FROM held UNION ALL SELECT 'sample', least(300, count(DISTINCT key)) FROM tr""")
def prepare_counts(spark, d):
    p = pipelines.prepare(*_split_sides(spark, d), 300)
    return _counts(p["gates"], {k: p[k] for k in ("train", "heldout", "val", "sample")})


@query(f"""{_FROZEN}
SELECT unnest(['new_missing', 'size', 'frozen_duplicates', 'prefix_moved', 'not_captured', 'train_frozen', 'train_rows', 'train_empty']) AS name, CAST(0 AS BIGINT) AS value
UNION ALL SELECT 'old_duplicates', (SELECT count(*) - count(DISTINCT key) FROM v WHERE split = 'val_old') UNION ALL SELECT 'frozen', count(*) FROM frozen
UNION ALL SELECT 'train', count(*) FROM t WHERE key NOT IN (SELECT key FROM frozen) UNION ALL SELECT 'dropped', count(*) FROM t WHERE key IN (SELECT key FROM frozen)
UNION ALL SELECT 'captured', count(DISTINCT key) FROM t WHERE key IN (SELECT key FROM frozen WHERE is_new = 1)""")
def val_large_counts(spark, d):
    """The old set of the test tables holds redelivered texts, so its gate counts them and nothing is enforced."""
    train, _, old = _split_sides(spark, d)
    p = pipelines.make_val_large(train, "line", old, "doc", old.select("key").distinct().count() + 100, enforce=False)
    return _counts(p["gates"], {"frozen": p["frozen"], "train": p["train"], "dropped": p["dropped"], "captured": p["frozen"].filter("line is not null")})


@query(f"""{S.AUDIT}, s AS (SELECT row_number() OVER (ORDER BY doc) - 1 AS i, doc IN (SELECT doc FROM flagged) AS hit FROM val), o AS (SELECT count(*) AS rows_before, CAST(sum(hit::INT) AS BIGINT) AS removed, CAST(sum((hit AND i < 100)::INT) AS BIGINT) AS of_prefix FROM s)
SELECT rows_before, rows_before - removed AS rows_after, removed, of_prefix AS removed_of_prefix, 100 - of_prefix AS prefix_after, round(removed / rows_before, 6) AS hit_rate, (SELECT count(*) FROM train) AS train_rows_scanned, true AS frozen, CAST(0 AS BIGINT) AS violations FROM o""")
def removal_record(spark, d):
    """The audited val_large without its flagged documents: the record that is appended to the manifest, and the sum of its gates."""
    audit = _audit(spark, d)
    frozen = materialize(order.row_numbers(audit.val.select("doc", F.col("doc").cast("string").alias("key")), ["doc"], "i"), "frozen")
    n = table(spark, d, "train").count()
    digest = str(readers.content_digest(frozen, ["i", "key"]).first()["digest"])
    p = pipelines.apply_removal(frozen, frozen.join(audit.flagged().select("doc").distinct(), "doc", "left_semi"), n, n, 100, digest)
    return p["record"].crossJoin(F.broadcast(p["gates"].agg(F.sum("violations").alias("violations"))))  # one row each


@query(f"""WITH u AS (SELECT DISTINCT key FROM {S.keyed("val_large", "doc")}), m AS (SELECT * FROM val_manifest), w AS (SELECT DISTINCT i, lower(sha256) AS sha256 FROM m WHERE i IS NOT NULL AND sha256 IS NOT NULL)
SELECT 'form' AS name, CAST(sum((i IS NULL OR sha256 IS NULL OR NOT regexp_matches(sha256, '^[0-9a-fA-F]{{64}}$'))::INT) AS BIGINT) AS value FROM m UNION ALL SELECT 'repeated', count(i) - count(DISTINCT i) FROM m UNION ALL SELECT 'gaps', max(i) + 1 - count(DISTINCT i) FROM m
UNION ALL SELECT 'missing', count(*) FROM w WHERE sha256 NOT IN (SELECT key FROM u) UNION ALL SELECT 'digest', 0 UNION ALL SELECT 'texts', count(*) FROM w WHERE sha256 IN (SELECT key FROM u)""")
def rebuild_counts(spark, d):
    p = pipelines.rebuild(table(spark, d, "val_manifest"), splits.keyed(table(spark, d, "val_large")), "doc", enforce=False)
    return _counts(p["gates"], {"texts": p["texts"]})


#: Ids of the code-point tokenizer: those of padding and of the marks come first.
FIRST_ID, CODE_POINT_IDS = 3, 0x110000 + 3


def _char_ids(text: str) -> list[int]:
    return [ord(c) + FIRST_ID for c in text]


def _char_blocks(spark, d) -> tuple[DataFrame, DataFrame, int]:
    placed = materialize(_placed(spark, d), "placed")
    n_seq = packing.totals(placed, SEQ_LEN).first()["n_seq"]
    return materialize(packing.blocks(placed, SEQ_LEN, n_seq, _char_ids), "blocks"), placed, n_seq


@query("SELECT unnest(['blocks', 'repeated_blocks', 'length', 'vocabulary', 'padding', 'tokens_recounted', 'bytes_fall', 'bytes_over', 'round_trip']) AS gate, CAST(0 AS BIGINT) AS violations")
def pack_gates(spark, d):
    made, placed, n_seq = _char_blocks(spark, d)
    cum = materialize(packing.block_bytes(placed, SEQ_LEN, n_seq, packing.char_widths), "cum")
    again = table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(F.split("text", "")).cast("bigint").alias("tokens"))
    again = again.withColumn("tokens", F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(F.lit(0)))
    bad = packing.round_trip(made, placed, SEQ_LEN, lambda ids: "".join(chr(i - FIRST_ID) for i in ids))
    report = quality.report(packing.gates(made, cum, placed.select("doc_id", "tokens", "bytes"), again, "doc_id", SEQ_LEN, n_seq, CODE_POINT_IDS))
    return report.unionByName(spark.createDataFrame([("round_trip", bad)], "gate string, violations bigint"))


@query(f"""{_DELTA}, e AS (SELECT start // {SEQ_LEN} AS seq_id, start % {SEQ_LEN} AS pl FROM p UNION ALL SELECT (start + tokens + 1) // {SEQ_LEN}, (start + tokens + 1) % {SEQ_LEN} FROM p), m AS (SELECT seq_id, count(*) AS marks FROM e WHERE pl > 0 GROUP BY seq_id)
SELECT seq_id // 32 + 1 AS step, count(*) AS seqs, CAST(sum(bytes_delta) AS BIGINT) AS bytes, CAST(sum({SEQ_LEN} - 1) AS BIGINT) AS targets, CAST(sum({SEQ_LEN} - 1 - coalesce(marks, 0)) AS BIGINT) AS text_targets, CAST(sum(coalesce(marks, 0)) AS BIGINT) AS structural_targets, round(sum({SEQ_LEN} - 1) * ln(6400), 3) AS nll FROM dl LEFT JOIN m USING (seq_id) GROUP BY 1""")
def update_targets(spark, d):
    """Updates of 32 blocks with their targets and the NLL of a model that knows nothing."""
    made, placed, n_seq = _char_blocks(spark, d)
    delta = packing.deltas(packing.block_bytes(placed, SEQ_LEN, n_seq, packing.char_widths))
    per = delta.join(packing.structural(made), "seq_id").withColumn("nll", scoring.uniform("targets", 6400))
    return packing.updates(per, 32).withColumn("nll", F.round("nll", 3))


@query(f"""{_DELTA}, u AS (SELECT (seq_id // 32 + 1) AS step, max(seq_id) + 1 AS seqs_consumed, max(bytes_cum) AS utf8_bytes_cum FROM dl GROUP BY 1) SELECT count(*) AS updates, CAST(0 AS BIGINT) AS disagree FROM u""")
def ledger_blocks(spark, d):
    """A ledger summed update by update agrees with the packed bytes at every update."""
    cum = materialize(_cum(spark, d), "cum")
    u = packing.updates(packing.deltas(cum), 32)
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row for each update
    summed = u.select("step", F.sum("seqs").over(w).alias("seqs_consumed"), F.sum("bytes").over(w).alias("utf8_bytes_cum"))
    return ledger.bytes_agree(summed, cum).agg(F.count(F.lit(1)).alias("updates"), F.sum((~F.col("agrees")).cast("bigint")).alias("disagree"))


@query(f"""WITH s AS (SELECT doc, length(text) AS n, strlen(text) AS b FROM val_large WHERE length(text) > 0)
SELECT doc, b AS utf8_bytes, n AS tokens, round(n * ln(6400), 4) AS nll, CAST(ceil(n / {BUDGET}.0) AS BIGINT) AS chunks FROM s""")
def score_v3(spark, d):
    """Spans of at most the budget scored one by one; a span over it would raise."""
    import math

    v = table(spark, d, "val_large")
    spans = materialize(chunks.char_chunks(v, "doc", BUDGET), "spans")
    return chunks.score_spans(spans, v, "doc", _char_ids, lambda ids: len(ids) * math.log(6400), BUDGET).withColumn("nll", F.round("nll", 4))


@query(f"""WITH r AS (SELECT CAST(ceil(length(text) / {BUDGET}.0) AS BIGINT) AS c, CAST(ceil(strlen(text) / {BUDGET}.0) AS BIGINT) AS b FROM val_large WHERE text IS NOT NULL)
SELECT CAST(sum(b) AS BIGINT) AS chunks_a, CAST(sum(c) AS BIGINT) AS chunks_b, CAST(sum(b) - sum(c) AS BIGINT) AS extra_chunks, round(100 * (sum(b) - sum(c)) / sum(c), 4) AS extra_resets_pct FROM r""")
def extra_chunks(spark, d):
    return stats.extra_chunks(mirror_confusion(spark, d), "byte", "char")


@query("SELECT line, text FROM train WHERE line < (SELECT min(line) + 500 FROM train)")
def first_rows(spark, d):
    """The rows below a row number, a limit that doesn't depend on partitioning."""
    t = table(spark, d, "train")
    return splits.below(t, "line", t.agg(F.min("line")).first()[0] + 500).select("line", "text")


@query(f"""WITH k AS (SELECT DISTINCT key FROM {S.keyed("train", "line")}) SELECT key FROM k ORDER BY {S.hash60("'42:' || key")} LIMIT 200""")
def stream_reservoir(spark, d):
    """The sample of distinct texts kept up to date by a stream over the training rows."""
    import uuid

    base = f"{shared_dir(spark)}/reservoir-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "train").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/train.parquet*")
    streams.reservoir(splits.keyed(stream), 200, f"{base}/state", f"{base}/checkpoint", SEED).awaitTermination()
    return streams.reservoir_keys(spark, f"{base}/state")


# Byte-level BPE (no oracle: DuckDB has no tokenizer)


def _family(spark) -> dict[str, tok.Bpe]:
    return tok.family(spark, BPE_FILE, FAMILY)


@query()
def bpe_profile(spark, d):
    """Sizes by script, padding and lossless round trips of every tokenizer of the family."""
    out = None
    for name, bpe in _family(spark).items():
        t = table(spark, d, "val_large").select("doc", "text")
        e = tok.encoded(t, "doc", bpe).select("doc", "tokens", "lossless")
        both = t.join(e, "doc")
        one = profile.by_script(both).withColumn("tokenizer", F.lit(name))
        pad = profile.padding(both, SEQ_LEN).select("truncated", F.col("share").alias("padding"))
        bad = e.agg(F.coalesce(F.sum((~F.col("lossless")).cast("bigint")), F.lit(0)).alias("lossy"))
        one = one.join(F.broadcast(pad), how="cross").join(F.broadcast(bad), how="cross")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query()
def bpe_mirror_confusion(spark, d):
    rows = None
    for name, bpe in _family(spark).items():
        one = tok.encoded(table(spark, d, "val_large"), "doc", bpe).select(F.lit(name).alias("tok"), "doc", "tokens", "bytes")
        rows = one if rows is None else rows.unionByName(one)
    return stats.mirror_confusion(rows, BUDGET)


@query()
def bpe_chunks(spark, d):
    """Common-text chunks: cut by the smaller tokenizer, which bounds the larger one of a nested family."""
    return chunks.token_chunks(table(spark, d, "val_large"), "doc", _family(spark)["bpe_6400"].ends, BUDGET)


@query("SELECT unnest(['over_bpe_6400', 'over_bpe_16384', 'uncovered', 'empty']) AS gate, CAST(0 AS BIGINT) AS violations")
def bpe_common_chunks(spark, d):
    """The same spans counted by both tokenizers, with the gates that no span is over the budget for either."""
    f = _family(spark)
    p = pipelines.common_chunks(table(spark, d, "val_large").select("doc", "text"), "doc", {k: f[k].ends for k in ("bpe_6400", "bpe_16384")}, BUDGET)
    return p["gates"]


@query()
def bpe_residual(spark, d):
    """Tokens that chunk boundaries add, for the cutting tokenizer."""
    bpe = _family(spark)["bpe_6400"]
    docs = tok.encoded(table(spark, d, "val_large"), "doc", bpe).select("tokens")
    return profile.residual(bpe_chunks(spark, d), docs)


@query()
def bpe_blocks(spark, d):
    """Packed blocks of the smaller tokenizer."""
    bpe = _family(spark)["bpe_6400"]
    docs = table(spark, d, "val_large").filter("text is not null").select("doc", "text")
    e = materialize(tok.encoded(docs, "doc", bpe, check=False).select("doc", "ids", "tokens", "bytes", T.seeded(SEED, "doc").alias("h")), "encoded")
    n_seq = packing.totals(e, SEQ_LEN).first()["n_seq"]
    return packing.blocks(packing.offsets(e, ["h", "doc"]), SEQ_LEN, n_seq, column="ids")


@query("SELECT unnest(['merges_not_prefix', 'ids_differ', 'dropout', 'byte_fallback', 'pre_tokenizer', 'ignore_merges', 'byte_lengths_differ']) AS gate, CAST(0 AS BIGINT) AS violations")
def nested_family(spark, d):
    """Gates of nesting and the byte-length table of the family: gate, violations (0 each)."""
    spec = tok.load_spec(BPE_FILE)
    a, b = (tok.derive_prefix(spec, n) for n in sorted(FAMILY.values()))
    rows = list(tok.nested_violations(a, b).items())
    la, lb = tok.byte_lengths(a), tok.byte_lengths(b)
    rows.append(("byte_lengths_differ", sum(lb[i] != n for i, n in la.items())))
    return spark.createDataFrame(rows, "gate string, violations bigint")

