"""Pieces of the oracle's SQL that several queries share."""

BLANK = r"'^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]*$'"


def hash60(expr: str) -> str:
    return f"CAST('0x' || substr(sha256({expr}), 1, 15) AS BIGINT)"


def keyed(table: str, cols: str) -> str:
    return f"(SELECT {cols}, text, sha256(text) AS key FROM {table} WHERE text IS NOT NULL AND NOT regexp_matches(text, {BLANK}))"


BY_HASH = f"SELECT doc_id, text, length(text) AS tokens, strlen(text) AS bytes, {hash60("'42:' || doc_id")} AS h FROM documents WHERE text IS NOT NULL"

PLACED = f"""WITH d AS ({BY_HASH}),
p AS (SELECT *, sum(tokens + 2) OVER w - tokens - 2 AS start, sum(bytes) OVER w - bytes AS bytes_before FROM d
      WINDOW w AS (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

WINDOWED = """SELECT {doc} AS doc, length(text) AS n, s, CASE WHEN length(text) <= 64 THEN length(text) ELSE s + 64 END AS e, substring(text, CAST(s AS INT) + 1, 64) AS w
FROM (SELECT {doc}, text, unnest(CASE WHEN length(text) <= 64 THEN [0] ELSE list_distinct(list_concat(range(0, length(text) - 63, 32), [length(text) - 64])) END) AS s
      FROM {table} WHERE text IS NOT NULL)"""

AUDIT = f"""WITH vw AS ({WINDOWED.format(doc="doc", table="val_large")}),
tw AS ({WINDOWED.format(doc="line", table="train")}),
m AS (SELECT DISTINCT doc AS line, w FROM tw WHERE w IN (SELECT w FROM vw)),
f AS (SELECT w, count(*) AS df FROM m GROUP BY w),
val AS (SELECT doc, n, count(*) AS n_windows FROM vw GROUP BY doc, n),
j AS (SELECT vw.doc, m.line, vw.n, s, e, vw.w, df > 100 AS template FROM vw JOIN f USING (w) JOIN m USING (w)),
r AS (SELECT doc, line, n, count(DISTINCT w) AS hits, sum(a) AS covered FROM (SELECT *, greatest(0, e - greatest(s, coalesce(max(e) OVER (PARTITION BY doc, line ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS a FROM j) GROUP BY doc, line, n),
t AS (SELECT doc, line, count(DISTINCT w) AS hits, sum(a) AS covered FROM (SELECT *, greatest(0, e - greatest(s, coalesce(max(e) OVER (PARTITION BY doc, line ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS a FROM j WHERE NOT template) GROUP BY doc, line),
pairs AS (SELECT r.doc, r.line, r.n, CAST(r.hits AS BIGINT) AS hits_raw, CAST(r.covered AS BIGINT) AS covered_raw, CAST(coalesce(t.hits, 0) AS BIGINT) AS hits_flt, CAST(coalesce(t.covered, 0) AS BIGINT) AS covered_flt,
  CASE WHEN r.n > 0 THEN r.covered / r.n ELSE 1.0 END AS coverage_raw, CASE WHEN r.n > 0 THEN coalesce(t.covered, 0) / r.n ELSE 1.0 END AS coverage_flt FROM r LEFT JOIN t USING (doc, line)),
flagged AS (SELECT pairs.*, CASE WHEN hits_flt >= least(3, n_windows) AND coverage_flt >= 0.5 THEN 'coverage' ELSE 'full_containment' END AS rule FROM pairs JOIN val USING (doc)
  WHERE (hits_flt >= least(3, n_windows) AND coverage_flt >= 0.5) OR coverage_raw >= 0.98)"""

EVAL = """WITH v AS (SELECT doc, min(strlen(text)) AS true_bytes FROM val_large WHERE text IS NOT NULL GROUP BY doc),
ev AS (SELECT arm, doc, true_bytes AS utf8_bytes, tokens, nll_nats AS nll FROM
  (SELECT *, row_number() OVER (PARTITION BY arm, doc ORDER BY nll_nats DESC, utf8_bytes DESC NULLS LAST, tokens DESC NULLS LAST, chunks DESC NULLS LAST) AS k
   FROM per_document_eval WHERE arm IS NOT NULL AND doc IS NOT NULL AND nll_nats IS NOT NULL) JOIN v USING (doc) WHERE k = 1),
ab AS (SELECT doc, a.nll AS nll_a, b.nll AS nll_b, a.utf8_bytes AS x FROM (SELECT * FROM ev WHERE arm = 'A') a JOIN (SELECT * FROM ev WHERE arm = 'B') b USING (doc) WHERE a.utf8_bytes = b.utf8_bytes)"""

LEDGER_COLS = ("arm", "seqs_consumed", "tokens_cum", "targets_cum", "text_targets_cum", "structural_targets_cum", "positions_cum", "utf8_bytes_cum", "flops_nominal_cum", "wall_seconds_cum", "lr", "grad_norm", "loss_nats_per_target", "train_bits_per_byte")
LEDGER = f"""WITH l AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY logged_at DESC NULLS LAST, {", ".join(c + " DESC NULLS LAST" for c in LEDGER_COLS)}) AS k FROM run_ledger WHERE run_id IS NOT NULL AND step IS NOT NULL) WHERE k = 1)"""
