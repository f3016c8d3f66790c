"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is content-addressed by its SHA-256. The ledger holds which blobs were
scanned under which version of which rule, and what was found. A run scans only pairs of blob and
rule version that the ledger lacks, each distinct blob once, then joins findings back to all rows
that hold the blob.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, free_name, on_hadoop, save, small, work_dir


def either(word: str) -> str:
    """The word with letters in either case; a case flag would fold letters outside ASCII in some engines."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # whose length counts
    least: int
    base: bool = False

    @property
    def version(self) -> str:
        return f"{self.kind}:{zlib.crc32(f'{self.pattern} {self.group} {self.least}'.encode()):08x}"


KEYWORDS = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
#: In the order in which kinds are listed. Runs of hex digits and access keys have no shorter match inside.
RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
FINDING = "blob binary, rule string, start int, end int"
SCANNED = "blob binary, rules array<string>"


def blob_of(text: Column) -> Column:
    """Content address; a null text is empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256))


def has_table(spark, ledger: str, table: str) -> bool:
    path, system = on_hadoop(spark, f"{ledger}/{table}")
    return system.exists(path)


def read_ledger(spark, ledger: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{ledger}/{table}") if has_table(spark, ledger, table) else spark.createDataFrame([], schema)


def matches(text: Column, rule: Rule) -> Column:
    """array<struct(before, size, ok)>: characters since the last match, of the match, and whether it counts."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    return F.transform(
        F.arrays_zip(between.alias("b"), found.alias("f"), counted.alias("c")),
        lambda x: F.struct(F.length(x["b"]).alias("before"), F.length(x["f"]).alias("size"), (F.length(x["c"]) >= rule.least).alias("ok")),
    )


def scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in (blob, text, missing): only rules whose version is in ``missing`` are run."""
    def of_rule(rule: Rule) -> Column:
        marked = F.transform(matches(F.col("text"), rule), lambda m: F.struct(F.lit(rule.version).alias("rule"), m["before"].alias("before"), m["size"].alias("size"), m["ok"].alias("ok")))
        return F.when(F.array_contains("missing", rule.version) & F.col("text").rlike(rule.pattern), marked)

    per_rule = [of_rule(r) for r in rules]
    # a position in each rule's own array orders its matches; one window then sums what lies before
    hits = texts.select("blob", F.explode(F.array(*per_rule)).alias("of_rule")).select("blob", F.posexplode("of_rule").alias("n", "m")).select("blob", "n", "m.*")
    end = F.expr("sum(before + size) over (partition by blob, rule order by n rows between unbounded preceding and current row)")
    return hits.withColumn("end", end.cast("int")).where("ok").select("blob", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scans what the ledger lacks of the texts in ``docs`` and appends it.

    Hashes are held against the ledger first; then only texts of blobs that lack a rule are moved,
    one of each blob to the scan. Findings are written before the mark that their blob is scanned,
    so a run that dies in between is made up by the next; findings written twice count once.
    """
    spark = docs.sparkSession
    versions = F.array(*[F.lit(r.version) for r in rules])
    rows = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = has_table(spark, ledger, "scanned")
    done = read_ledger(spark, ledger, "scanned", SCANNED).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
    missing = F.array_except(versions, F.coalesce("done", F.array().cast("array<string>")))
    todo = rows.select("blob").distinct().join(done, "blob", "left").select("blob", missing.alias("rules")).where(F.size("rules") > 0)
    todo = save(todo, pending := f"{ledger}/todo-{uuid.uuid4().hex}")
    if seen:  # else all of them are to do
        rows = rows.join(small(todo.select("blob")), "blob", "left_semi")
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).join(small(todo), "blob")
    scan(blobs.select("blob", "text", F.col("rules").alias("missing")), rules).write.mode("append").parquet(f"{ledger}/findings")
    todo.write.mode("append").parquet(f"{ledger}/scanned")
    drop(spark, pending)
    return read_ledger(spark, ledger, "findings", FINDING)


def spans_by_blob(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans: array<struct(start, rank, end, kind, base)> by start, then kind as listed."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.base).alias("base")))])
    known = findings.where(F.col("rule").isin([r.version for r in rules])).dropDuplicates(["blob", "rule", "start", "end"]).withColumn("r", rank[F.col("rule")])
    span = F.struct("start", F.col("r.rank").alias("rank"), "end", F.col("r.kind").alias("kind"), F.col("r.base").alias("base"))
    return known.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>"


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with a column ``out``: spans sorted by start, then kind as listed; empty where none is.

    Offsets count code points; the end is exclusive. ledger: a folder that all executors share;
    without one this run starts an empty ledger. Null and empty texts have no spans; whole texts are
    scanned, however long; repeated rows each get the findings of their blob; an empty table gives
    no rows. All columns stay, but one named ``out`` is replaced.
    """
    folder = work_dir(docs.sparkSession, "secrets")
    findings = update_ledger(docs, ledger or f"{folder}/ledger", rules, text_col)
    key = free_name(docs, "blob")
    spans = small(save(spans_by_blob(findings, rules), f"{folder}/spans")).select(F.col("blob").alias(key), F.col("spans").alias(out))
    rows = docs.withColumn(key, blob_of(F.col(text_col))).drop(out)
    return rows.join(spans, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(NO_SPANS))).drop(key)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    reached = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda p: p["end"])), F.lit(0)).alias("after")))
    heads = F.filter(reached, lambda h: h["start"] >= h["after"])
    pieces = F.transform(heads, lambda h: F.substring(text, h["after"] + 1, h["start"] - h["after"]))
    last = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.array_join(F.concat(pieces, F.array(last)), mark)).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("secret_spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES if r.base]
    return found.select(F.col(id_col).alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def oracle(table: str = "documents") -> str:
    """The same result in SQL, without a ledger."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(RULES):
        inner = f"SELECT doc_id, string_split_regex(t, {q(r.pattern)}) AS b, regexp_extract_all(t, {q(r.pattern)}, 0) AS f, regexp_extract_all(t, {q(r.pattern)}, {r.group}) AS c FROM d WHERE regexp_matches(t, {q(r.pattern)})"
        parts.append(f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {str(r.base).lower()} AS base, i, length(b[i]) AS before, length(f[i]) AS size, length(c[i]) >= {r.least} AS ok FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM ({inner}))")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    zero = ", ".join(f"coalesce(s.n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    word = "kind || ':' || (e - size) || ':' || e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}), m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, CAST(sum(before + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS INTEGER) AS e FROM m),
s AS (SELECT doc_id, {counts}, string_agg({word}, ',' ORDER BY e - size, rank) FILTER (WHERE base) AS base_spans, string_agg({word}, ',' ORDER BY e - size, rank) AS spans FROM p WHERE ok GROUP BY doc_id)
SELECT d.doc_id, {zero}, sha256(coalesce(s.base_spans, '')) AS base_sha256, coalesce(s.spans, '') AS spans FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""
