"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its text. The ledger is a table of (blob, rules) with the blob's
findings, one folder for each version of the rules. A scan reads the texts, keeps one text for each blob, leaves out the
blobs that the ledger has under these rules, scans the rest, appends their findings, and joins the ledger back to all paths.

A text is scanned whole, however long; null texts count as empty and share the blob of the empty text. Two runs that add to
one ledger at the same time may both append a blob; its findings are the same, and reading the ledger folds them.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text
from tiewright.llm.skew import hot_keys, join_spread, unused
from tiewright.sources.tables import materialize, shared_dir

#: Kinds of the base, in order; then those of RULES.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further kinds; their spans are added to those of the base.
RULES = {
    # up to the line that ends the key; without one, up to the last of the lines that look like a part of it
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{16,})*(?:\s+[A-Za-z0-9+/]{1,15}={1,2})?)"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "forge": re.compile(r"\b(?:gh[pousr]|glpat|github_pat)[_-][A-Za-z0-9_-]{20,}"),
    "chat": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    "basic": re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
}
#: For each of RULES, strings of which any text with a match has one.
SIGNS = {"pem": ("-----BEGIN",), "jwt": ("eyJ",), "forge": ("ghp", "gho", "ghu", "ghs", "ghr", "glpat", "github_pat"), "chat": ("xox",), "basic": ("://",)}
KINDS = ("assign", "access", "hex", *RULES)
RULES_VERSION = hashlib.sha256(repr([ASSIGN.pattern, ACCESS.pattern, HEX.pattern, *((k, r.pattern) for k, r in RULES.items())]).encode()).hexdigest()[:12]
FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order; positions are code points and ends exclusive."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, rule in RULES.items():
        if any(sign in text for sign in SIGNS[kind]):
            spans += [(m.start(), KINDS.index(kind), m.end()) for m in rule.finditer(text)]
    return sorted(spans)


def describe(spans: list[tuple[int, int, int]]) -> tuple[int, int, int, str, str]:
    shown = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
    base = ",".join(s for s, (_, k, _) in zip(shown, spans) if k < 3)
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(shown))


def redact(text: str, spans: str) -> str:
    """The text with every secret of ``spans`` replaced by its kind; of an assignment, only the value."""
    cuts = []
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        start = int(a)
        cuts.append((ASSIGN.match(text, start).start(2) if kind == "assign" else start, int(b), kind))
    out, at = [], 0
    for a, b, kind in sorted(cuts):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


class Ledger:
    """Findings by blob and rules version, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def findings(self) -> DataFrame | None:
        """The ledger's rows under the present rules, a blob once; None before the first scan."""
        path = f"{self.folder}/rules={RULES_VERSION}"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(FINDINGS).parquet(path).dropDuplicates(["blob"])

    def add(self, versions: DataFrame, text: str = "text") -> None:
        """Scan the blobs of ``versions`` that the ledger has not seen under these rules, and append their findings."""
        texts = versions.select(whole_text(text).alias("body")).select(F.sha2("body", 256).alias("blob"), "body")
        if (seen := self.findings()) is not None:
            texts = texts.join(seen.select("blob"), "blob", "left_anti")

        def once(batches):
            """One text for each blob of a task, before the shuffle."""
            met: set = set()
            for batch in batches:
                yield batch.take(pa.array([i for i, b in enumerate(batch.column(0).to_pylist()) if b not in met and not met.add(b)], pa.int64()))

        def run(batches):
            met: set = set()
            for batch in batches:
                fresh = [i for i, b in enumerate(batch.column(0).to_pylist()) if b not in met and not met.add(b)]
                batch = batch.take(pa.array(fresh, pa.int64()))
                columns = list(zip(*(describe(find(t)) for t in batch.column(1).to_pylist()))) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=[x.split()[0] for x in FINDINGS.split(", ")])

        blobs = texts.mapInArrow(once, "blob string, body string").repartition("blob")
        blobs.mapInArrow(run, FINDINGS).write.mode("append").parquet(f"{self.folder}/rules={RULES_VERSION}")

    def report(self, versions: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """One row for each row of ``versions``: its key as doc_id, blob, and the blob's findings.

        Copies of a text share a blob, which is scanned once and reported for each path; repeated rows are reported each,
        and an empty table gives no rows. Blobs that many paths share are met by a bounded broadcast.
        """
        paths = materialize(versions.select(F.col(key).alias("doc_id"), F.sha2(whole_text(text), 256).alias("blob")), "paths")
        hot = hot_keys(paths.groupBy("blob").agg(F.count("*").alias("n")), "blob")
        return join_spread(paths, self.findings(), "blob", materialize(hot, "hot"))


def new_ledger(spark: SparkSession) -> Ledger:
    """An empty ledger in the shared folder."""
    return Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def scan(versions: DataFrame, ledger: Ledger | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add ``versions`` to the ledger (a new one in the shared folder if none is given) and report on them."""
    ledger = ledger or new_ledger(versions.sparkSession)
    ledger.add(versions, text)
    return ledger.report(versions, text, key)


def redacted(docs: DataFrame, ledger: Ledger | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in their texts replaced by their kinds; n_chars, if there is one, follows a changed text.

    The ledger says which blobs have findings; rows of other blobs, null and empty texts among them, stay as they are.
    Repeated rows stay repeated, an empty table stays empty, and columns of ``docs`` may have any names.
    """
    ledger = ledger or new_ledger(docs.sparkSession)
    ledger.add(docs, text)
    blob, spans, cleaned = unused(docs, "blob"), unused(docs, "spans"), unused(docs, "cleaned")
    found = ledger.findings().where("spans <> ''").select(F.col("blob").alias(blob), F.col("spans").alias(spans))

    @F.pandas_udf("string")
    def clean(texts, spans):
        return texts.combine(spans, lambda t, s: redact(t, s) if s else t)

    own = docs.withColumn(blob, F.sha2(whole_text(text), 256))
    hot = materialize(hot_keys(own.groupBy(blob).agg(F.count("*").alias("n")), blob), "hot")
    joined = join_spread(own, found, blob, hot, "left")
    changed = F.col(spans).isNotNull()
    joined = joined.withColumn(cleaned, clean(whole_text(text), F.coalesce(F.col(spans), F.lit(""))))
    columns = {text: F.when(changed, F.col(cleaned)).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length(cleaned).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumns(columns).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
