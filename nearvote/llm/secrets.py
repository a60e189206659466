"""Secret scans with an incremental ledger of blobs.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds what a
version of a rule has found in a blob, also if that was nothing. A scan reads only the texts of blobs
that lack a rule's current version, one path's copy of each, and runs only the rules that it lacks.
Findings then join back to all paths and versions that hold the blob. The ledger grows by appending.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.common import by_size, filled, marked, stored, table


@dataclass(frozen=True)
class Rule:
    """A pattern; matches with fewer than `least` characters in `group` are dropped after they have matched.

    `needs`: lower-case strings of which a text must hold one (its letters in either case) to match at all.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII
    needs: tuple[str, ...] = ()


#: The first three are fixed. Runs of a class are scanned at their least length at once: of a maximal
#: run of [0-9a-f] all or nothing matches, and of AKIA[A-Z0-9]+ too.
RULES = (
    Rule("assign", 1, r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, re.ASCII | re.IGNORECASE, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, re.ASCII, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 0, re.ASCII, ("private key",)),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 0, re.ASCII, ("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, re.ASCII, ("gh",)),
)
BASE_KINDS = ("assign", "access", "hex")

LEDGER = "blob string, kind string, version int, spans array<struct<start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def found_by(rule: Rule, compiled: re.Pattern, text: str, lower: str) -> list[dict[str, int]]:
    """Leftmost non-overlapping matches, in code points, end exclusive."""
    if rule.needs and not any(n in lower for n in rule.needs):
        return []
    return [{"start": m.start(), "end": m.end()} for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs: blob, text, lacking array<string> of kinds. A ledger row for each blob and kind that it lacks."""
    schema = pa.schema([("blob", pa.string()), ("kind", pa.string()), ("version", pa.int32()), ("spans", _SPANS)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.kind: (r, re.compile(r.pattern, r.flags)) for r in rules}
        for batch in by_size(batches, "text", 4 << 20):
            out, last = [], None
            for blob, text, lacking in zip(batch["blob"].to_pylist(), batch["text"].to_pylist(), batch["lacking"].to_pylist(), strict=True):
                if blob == last:
                    continue  # a row that is repeated under one path
                last, lower = blob, text.lower()
                out += [{"blob": blob, "kind": k, "version": compiled[k][0].version, "spans": found_by(*compiled[k], text, lower)} for k in lacking]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return blobs.select("blob", "text", "lacking").mapInArrow(work, LEDGER)


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks: the new ledger rows, and the findings of every row of `versions`.

    `versions` has a row for each version of each path. Findings: path, blob, and findings, a sorted
    array of (start, kind's place in `rules`, end, kind), empty where nothing was found. Null text counts
    as empty; null and repeated paths are allowed, one row out for each row in; an empty table gives no
    rows. Columns other than path and text don't matter. New ledger rows are written in the shared folder
    before they are used, so that a lost executor repeats no scan; append them to a ledger of your own.
    """
    spark = versions.sparkSession
    ledger = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    rows = versions.select(F.col(path_col).alias("path"), filled(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    known = ledger.join(F.broadcast(current), ["kind", "version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("known"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    # of equal texts one path's copy is read: the filter keeps the others, and blobs that lack nothing, out of the exchange
    blobs = rows.groupBy("blob").agg(F.min("path").alias("of"))
    lacking = blobs.join(known, "blob", "left").select("blob", "of", F.array_except(kinds, F.coalesce("known", F.array().cast("array<string>"))).alias("lacking")).filter(F.size("lacking") > 0)
    lacking = lacking.checkpoint()
    copies = marked(rows, lacking.select("blob", F.col("of").alias("path")), "first").filter("first")
    texts = copies.join(lacking.withColumnRenamed("blob", "b"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("of")))
    new = stored(scanned(texts, rules).dropDuplicates(["blob", "kind"]), "ledger")

    place = F.array_position(kinds, F.col("kind")).cast("int")
    all_found = ledger.join(F.broadcast(current), ["kind", "version"], "left_semi").unionByName(new).filter(F.size("spans") > 0)
    each = all_found.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place.alias("place"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("f"))
    by_blob = each.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("f"))).alias("findings"))
    nothing = F.array().cast("array<struct<start: int, place: int, end: int, kind: string>>")
    return new, rows.select("path", "blob").join(by_blob, "blob", "left").select("path", "blob", F.coalesce("findings", nothing).alias("findings"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = update(table(spark, sf_dir, "documents"), path_col="doc_id")
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    number = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[number(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", said), ",").alias("spans"),
    )
