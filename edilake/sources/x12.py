"""X12 files as DataFrames: documents, delimiters, segments, errors.

A document row is (source_file, source_transaction, input_ordinal, text), the
text decoded as ISO-8859-1 so that characters are bytes. Parsing stays in
Catalyst: delimiters are columns, segments a posexplode, and offsets, ordinals
and control numbers windows over one document, which share one sort.

Documents are dealt out by name before they are split, so that no segment is
shuffled. A column ``shard``, any value of the document's by which its rows are
dealt out already, saves that too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import quoted

TYPES = ("270", "271", "834", "835", "837")
#: What can be wrong with a document.
ERRORS = {
    "NOT_X12": "input does not start with ISA",
    "BAD_ISA": "ISA is too short or has an invalid delimiter",
    "MISSING_SEGMENT_TERM": "the last segment has no terminator",
    "SEGMENT_OVERFLOW": "a segment has too many elements",
    "ST_SE_COUNT": "ST and SE do not enclose the stated number of segments",
    "ST_SE_CONTROL": "SE02 differs from ST02",
}
MAX_ELEMENTS = 128
ISA_BYTES = 106


def read_files(spark: SparkSession, paths: dict[str, list[str]], root: str | None = None) -> DataFrame:
    """Documents of typed files: {"837": [...], ...}; any number, folders and globs included."""
    out = None
    for ordinal, (kind, own) in enumerate(paths.items()):
        if kind not in TYPES:
            raise ValueError(f"unsupported transaction type {kind}")
        if not own:
            continue
        got = spark.read.format("binaryFile").load(own).select(
            relative(F.col("path"), root).alias("source_file"), F.lit(kind).alias("source_transaction"), F.lit(ordinal).alias("input_ordinal"), F.decode("content", "ISO-8859-1").alias("text")
        )
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no input files")
    return out


def read_list(spark: SparkSession, path: str) -> list[str]:
    """The paths in a list file: one a line, blank lines skipped. Input configuration, hence on the driver."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("p")).where("p <> ''")
    return [r.p for r in rows.collect()]


def relative(path: Column, root: str | None) -> Column:
    """The path below the root with forward slashes; else the whole path, as files of one name in two folders are two documents."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^file:/*", "/"), r"\\", "/")
    if not root:
        return plain
    base = root.rstrip("/") + "/"
    return F.when(plain.startswith(base) & ~plain.contains("/../"), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)


def _held(docs: DataFrame) -> DataFrame:
    """docs with the text made once for each row: filters that read it don't go through an explode, else each of their tests would make it again."""
    return docs.select(*(c for c in docs.columns if c != "text"), F.explode(F.array("text")).alias("text"))


def with_delimiters(docs: DataFrame) -> DataFrame:
    """Adds element_mark, component_mark, segment_mark and isa_error."""
    docs = _held(docs)
    text = F.coalesce(F.substring_index("text", "\0", 1), F.lit(""))
    bad = lambda c: c.isin("\r", "\n", "\0") | (c == "")
    e, c, t = F.substring("text", 4, 1), F.substring("text", 105, 1), F.substring("text", 106, 1)
    short = F.length(F.coalesce("text", F.lit(""))) < ISA_BYTES
    error = F.when(short, "BAD_ISA").when(~F.col("text").startswith("ISA"), "NOT_X12").when(bad(e) | bad(c) | bad(t), "BAD_ISA")
    return docs.select("*", e.alias("element_mark"), c.alias("component_mark"), t.alias("segment_mark"), error.alias("isa_error")).withColumn("text", F.when(short, F.col("text")).otherwise(text))


def place(rows: DataFrame) -> list[str]:
    """The columns that tell a document's rows."""
    return [c for c in ("shard", "source_file", "source_transaction") if c in rows.columns]


def _raw(docs: DataFrame) -> DataFrame:
    """Pieces between terminators, with the offset of each."""
    own = place(docs)
    dealt = docs if "shard" in own else docs.repartition(*own)
    good = with_delimiters(dealt).where("isa_error is null")
    split = good.select(*own, "input_ordinal", "element_mark", F.call_function("split", F.col("text"), quoted(F.col("segment_mark")), F.lit(-1)).alias("pieces"))
    split = split.withColumn("ends", F.size("pieces") - 1)
    pieces = split.select(*own, "input_ordinal", "element_mark", "ends", F.posexplode("pieces").alias("p", "raw"))
    by = W.partitionBy(*own).orderBy("p")
    before = F.coalesce(F.sum(F.length("raw") + 1).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lead = F.length("raw") - F.length(F.ltrim(F.col("raw"), F.lit("\r\n")))
    return pieces.select("*", (before + lead).cast("long").alias("byte_offset"), F.trim(F.col("raw"), F.lit("\r\n")).alias("body"), (F.col("p") == F.col("ends")).alias("last"))


def segments(docs: DataFrame, ahead=None) -> DataFrame:
    """Segments with their place, elements and the control numbers seen so far.

    ahead: gives, for the window over a document's segments, more columns that are made in the same pass (events.ahead).

    Columns: source_file, source_transaction, input_ordinal, segment_index (from
    1), byte_offset, tag, e (elements), component, isa13, gs06, st02, txn, the
    number of STs so far, and p, by which the rows are sorted; the shard if any.
    """
    parts = F.call_function("split", F.col("body"), quoted(F.col("element_mark")), F.lit(-1))
    # Empty pieces and tags are no segments, so the index counts what is left; the order by p is the windows' one sort.
    rows = _raw(docs).where("not last and body <> '' and not startswith(body, element_mark)").withColumn("x", parts)
    own = place(rows)
    by = W.partitionBy(*own).orderBy("p")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    e = F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0)))
    seen = lambda tag, n: F.coalesce(F.last(F.when(F.col("tag") == tag, F.coalesce(F.get("e", F.lit(n - 1)), F.lit(""))), ignorenulls=True).over(upto), F.lit(""))
    rows = rows.select(*own, "input_ordinal", "p", "byte_offset", F.col("x")[0].alias("tag"), e.alias("e"))
    mark = F.substring(seen("ISA", 16), 1, 1)
    return rows.select(
        *own, "input_ordinal", "p", F.row_number().over(by).cast("long").alias("segment_index"), "byte_offset", "tag", "e",
        F.when(mark == "", F.lit(":")).otherwise(mark).alias("component"), seen("ISA", 13).alias("isa13"), seen("GS", 6).alias("gs06"), seen("ST", 2).alias("st02"),
        F.sum((F.col("tag") == "ST").cast("long")).over(upto).alias("txn"), *(ahead(by) if ahead else ()),
    )


def errors(docs: DataFrame) -> DataFrame:
    """(source_file, source_transaction, segment_index, code, message): the first thing wrong with each document."""
    isa = with_delimiters(docs).where("isa_error is not null").select("source_file", "source_transaction", F.lit(0).cast("long").alias("segment_index"), F.col("isa_error").alias("code"))
    end = _raw(docs).where("last and replace(replace(raw, '\r', ''), '\n', '') <> ''").select("source_file", "source_transaction", F.lit(2**62).cast("long").alias("segment_index"), F.lit("MISSING_SEGMENT_TERM").alias("code"))
    s = segments(docs)
    by = W.partitionBy("source_file", "source_transaction").orderBy("segment_index")
    # What is open: the last ST or SE before this segment.
    mark = F.when(F.col("tag").isin("ST", "SE"), F.struct("tag", F.col("segment_index").alias("i"), F.coalesce(F.get("e", F.lit(1)), F.lit("")).alias("control")))
    s = s.withColumn("before", F.last(mark, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))).withColumn("final", F.lead("tag").over(by).isNull())
    inside = F.coalesce(F.col("before.tag") == "ST", F.lit(False))
    count = F.coalesce(F.get("e", F.lit(0)), F.lit(""))
    code = (
        F.when(F.size("e") > MAX_ELEMENTS, "SEGMENT_OVERFLOW")
        .when((F.col("tag") == "ST") & inside, "ST_SE_COUNT")
        .when((F.col("tag") == "SE") & ~inside, "ST_SE_COUNT")
        .when((F.col("tag") == "SE") & (~count.rlike("^[0-9]+$") | (count.try_cast("long") != F.col("segment_index") - F.col("before.i") + 1)), "ST_SE_COUNT")
        .when((F.col("tag") == "SE") & (F.coalesce(F.get("e", F.lit(1)), F.lit("")) != F.col("before.control")), "ST_SE_CONTROL")
        .when(F.col("final") & ((F.col("tag") == "ST") | (inside & (F.col("tag") != "SE"))), "ST_SE_COUNT")
    )
    wrong = s.select("source_file", "source_transaction", "segment_index", code.alias("code")).where("code is not null")
    every = isa.union(end).union(wrong).groupBy("source_file", "source_transaction").agg(F.min(F.struct("segment_index", "code")).alias("f"))
    message = F.create_map(*(F.lit(x) for kv in ERRORS.items() for x in kv))
    return every.select("source_file", "source_transaction", "f.segment_index", "f.code", message[F.col("f.code")].alias("message"))


def parse(docs: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Segments of documents; FAILFAST raises at the first bad one, DROPMALFORMED leaves bad ones out, PERMISSIVE keeps what comes before the error."""
    if mode == "PERMISSIVE":
        bad = errors(docs).select("source_file", "source_transaction", F.col("segment_index").alias("stop"))
        got = segments(docs).join(bad, ["source_file", "source_transaction"], "left")
        return got.where("stop is null or segment_index < stop").drop("stop")
    bad = errors(docs)
    if mode == "FAILFAST":
        first = bad.first()
        if first:
            raise ValueError(f"{first.source_file}: {first.code} at segment {first.segment_index}: {first.message}")
        return segments(docs)
    if mode != "DROPMALFORMED":
        raise ValueError(f"unknown mode {mode}")
    return segments(docs).join(bad.select("source_file", "source_transaction"), ["source_file", "source_transaction"], "left_anti")


def dump(segs: DataFrame) -> DataFrame:
    """One line of text for each segment."""
    return segs.select("source_file", "segment_index", F.format_string("%06d %s elements=%d", F.col("segment_index"), F.col("tag"), F.size("e")).alias("line"))
