"""Secret scans with an incremental ledger of blobs.

Every version of every text is content-addressed: its blob is the SHA-256 of its bytes. The ledger is a folder of two Parquet tables:
findings (blob, rule_version, spans) and versions (doc_id, blob, scan). A scan groups the paths by blob, drops the pairs of blob and
rule version that the ledger holds, scans one copy of each of the rest, appends what it found and which paths have a blob that they
had not before, and joins findings back to all paths. A change of the rules gets a new version, which makes all blobs unseen again;
old rows stay, so history() tells what every version of every path held. Rows that a repeated append left twice count once.

Null texts count as empty; the empty text is a blob like any other and has no spans; repeated rows and ids come back one row
each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, divided, fresh, map_arrow, materialise, member_filter, quoted, shared_folder, texts

#: Names the set of rules below in the ledger; raise it with every change of a rule.
RULE_VERSION = 3

# The base rules, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "private_key", "jwt", "provider", "basic_auth", "entropy")

# Further rules. Each starts with a literal, so that a text without it costs a single search.
# A private key goes on to its END line; where that is missing, to the end of its headers and base64 lines.
PRIVATE_KEY = re.compile(
    r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
    r"|(?:[ \t]*\r?\n[A-Za-z-]+: [^\n]*)*(?:(?:[ \t]*\r?\n)+[ \t]*[A-Za-z0-9+/=]+(?=[ \t]*\r?(?:\n|\Z)))*)"
)
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PROVIDER = re.compile(r"(?:ghp_|gho_|ghs_|github_pat_|glpat-|xoxb-|xoxp-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}")
PROVIDER_STARTS = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza")
BASIC_AUTH = re.compile(r"://[A-Za-z0-9._-]+:[^\s:@/]{6,}@")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
#: Bits a character from which a long run of mixed letters and digits counts as a secret.
LEAST_ENTROPY = 4.2


def entropy(run: str) -> float:
    n = len(run)
    return -sum(k / n * math.log2(k / n) for k in Counter(run).values())


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans in code points, end exclusive, sorted; kind indexes KINDS."""
    out: list[tuple[int, int, int]] = []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 3, m.end()) for m in PRIVATE_KEY.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    if any(s in text for s in PROVIDER_STARTS):
        out += [(m.start(), 5, m.end()) for m in PROVIDER.finditer(text)]
    if "://" in text:
        out += [(m.start(), 6, m.end()) for m in BASIC_AUTH.finditer(text)]
    for m in LONG_RUN.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and run.upper() != run and run.lower() != run and entropy(run) >= LEAST_ENTROPY:
            out.append((m.start(), 7, m.end()))
    out.sort()
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "blob binary, rule_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(b: pa.RecordBatch, version: int) -> pa.RecordBatch:
    counts, base, every = ([], [], []), [], []
    for text in texts(b, "text"):
        spans = find(text)
        for k in range(3):
            counts[k].append(sum(x[1] == k for x in spans))
        base.append(hashlib.sha256(spelled([x for x in spans if x[1] < 3]).encode()).hexdigest())
        every.append(spelled(spans))
    n = b.num_rows
    return pa.record_batch(
        [b.column("blob"), pa.array([version] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())],
        ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    )


VERSIONS = "doc_id {kind}, blob binary, scan long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table; an empty one where nothing was written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def findings(spark: SparkSession, ledger_path: str, rule_version: int | None = None) -> DataFrame:
    """The ledger's findings, of one rule version or all, each pair of blob and rule version once."""
    rows = _table(spark, f"{ledger_path}/findings", SCHEMA)
    rows = rows if rule_version is None else rows.filter(F.col("rule_version") == rule_version)
    return rows.dropDuplicates(["blob", "rule_version"])


def history(spark: SparkSession, ledger_path: str, rule_version: int = RULE_VERSION, kind: str = "long") -> DataFrame:
    """(doc_id, scan, blob, findings): every version that a path ever had, the scan that first saw it there, and what it holds."""
    versions = _table(spark, f"{ledger_path}/versions", VERSIONS.format(kind=kind)).groupBy("doc_id", "blob").agg(F.min("scan").alias("scan"))
    return versions.join(findings(spark, ledger_path, rule_version).drop("rule_version"), "blob", "left")


def scan(df: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """One row per row of df: (doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans). Appends to the ledger.

    No text is shuffled. The first pass writes (path, blob); of each unseen blob one path is elected, and the second pass scans the
    texts whose path is in a bit filter of the elected ones. The filter's size is bounded; where it errs, a text is scanned
    once more than needed, and the repeated finding of its blob is dropped. Where nothing is unseen there is no second pass.
    """
    spark = df.sparkSession
    rows = df.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    rows = rows.withColumn("path", F.xxhash64("doc_id"))
    paths = materialise(rows.select("doc_id", "path", F.unhex(F.sha2("text", 256)).alias("blob")), "paths")
    seen = findings(spark, ledger_path, rule_version).select("blob")
    unseen = materialise(paths.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left_anti"), "unseen")
    if unseen.take(1):
        elected, _ = divided(rows.select("path", "text"), F.col("path"), member_filter(unseen, "path"))
        found = map_arrow(elected.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text"), lambda b: _scan(b, rule_version), SCHEMA)
        found.dropDuplicates(["blob"]).join(seen, "blob", "left_anti").write.mode("append").parquet(f"{ledger_path}/findings")
    kind = rows.schema["doc_id"].dataType.simpleString()
    before = _table(spark, f"{ledger_path}/versions", VERSIONS.format(kind=kind))
    number = before.agg(F.coalesce(F.max("scan") + 1, F.lit(0)).alias("scan")).first().scan
    known = before.select(F.col("doc_id").alias("d"), F.col("blob").alias("b")).distinct()
    new = paths.select("doc_id", "blob").distinct().join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("blob") == F.col("b")), "left_anti")
    new.withColumn("scan", F.lit(number).cast("long")).write.mode("append").parquet(f"{ledger_path}/versions")
    return paths.select("doc_id", "blob").join(findings(spark, ledger_path, rule_version).drop("rule_version"), "blob")


def scan_once(df: DataFrame) -> DataFrame:
    """scan() with a new ledger in the shared folder."""
    return scan(df, shared_folder(df.sparkSession, "ledger"))


def scan_again(df: DataFrame) -> DataFrame:
    """scan() of a table whose blobs the ledger holds from a scan before: nothing is unseen, findings come from the ledger."""
    ledger_path = shared_folder(df.sparkSession, "ledger")
    scan(df, ledger_path)
    return scan(df, ledger_path)


def redact(df: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """df with every span that scan() found in its text replaced by mark, n_chars set anew where there is such a column; all rows and columns stay.

    Findings meet texts by blob. Only rows whose blob may have findings, as a bit filter tells, are shuffled for that.
    """
    schema = df.schema
    blob, told = fresh(df, "_blob", "_spans")
    hits = found.filter("spans <> ''").select("blob", "spans").dropDuplicates(["blob"])
    rows = df.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    some, clean = divided(rows, F.col(blob), member_filter(hits, "blob"))
    marked = some.join(hits.select(F.col("blob").alias(blob), F.col("spans").alias(told)), blob, "left").select(*columns(df), told)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
        out = []
        for t, spans in zip(cols["text"].to_pylist(), cols.pop(told).to_pylist(), strict=True):
            if t is not None and spans:
                bits, at = [], 0
                for x in spans.split(","):
                    a, z = map(int, x.split(":")[1:])
                    if a >= at:
                        bits += [t[at:a], mark]
                    at = max(at, z)
                t = "".join([*bits, t[at:]])
            out.append(t)
        cols["text"] = pa.array(out, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], cols["n_chars"].type)
        return pa.record_batch(list(cols.values()), list(cols))

    return clean.drop(blob).unionByName(map_arrow(marked, run, schema))
