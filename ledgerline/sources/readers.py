"""Readers and sinks: contract records, page replies, answer keys, terms, adjudications, manifests, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = "struct<raw:string,parsed:decimal(18,4),parse_status:string>"
FIELD = f"struct<value:{AMOUNT},evidence_text:string,page:int,batch:int,provenance:string>"
QUOTE = f"contract_version string, processing_complete boolean, pages_processed array<int>, pages_skipped array<int>, base_price {FIELD}, gst_amount {FIELD}, gross_total {FIELD}, net_cost {FIELD}, option_fields map<string,map<string,string>>"
BLOCKS = "array<struct<Id:string,BlockType:string,Text:string,Confidence:double,RowIndex:int,ColumnIndex:int,Relationships:array<struct<Type:string,Ids:array<string>>>>>"
MAX_RECORD = 380_000
MAX_READING = 100_000


def read_quotes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records of version v1, all others): explicit schema, corrupt records among the others."""
    df = spark.read.schema(QUOTE + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = F.coalesce(F.col("contract_version") == "v1", F.lit(False))
    return df.where(good).drop("_corrupt"), df.where(~good)


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges) of saved page replies; a reply's file name orders batches by number."""
    raw = spark.read.schema(f"doc string, page int, Blocks {BLOCKS}").option("multiLine", True).json(path).withColumn("batch", F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)", 1).try_cast("int"))
    rows = raw.select("doc", "page", "batch", F.inline("Blocks"))
    blocks = rows.select("doc", "page", "batch", F.col("Id").alias("id"), F.col("BlockType").alias("block_type"), F.col("Text").alias("text"), F.col("Confidence").alias("confidence"), F.col("RowIndex").alias("row"), F.col("ColumnIndex").alias("col"))
    edges = rows.select("doc", "page", F.col("Id").alias("parent_id"), F.inline("Relationships")).select("doc", "page", "parent_id", F.col("Type").alias("kind"), F.posexplode("Ids").alias("pos", "child_id"))
    return blocks.dropDuplicates(["doc", "page", "id"]), edges


def parse_answer_key(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth, report) of lines (file, n, text). `[doc]` starts a document; `key: value | page, page` states a value, absent words give null; the last one counts."""
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract("text", "^\\[(.+)\\]\\s*$", 1)
    rows = lines.where(~F.col("text").rlike("^\\s*(?:#|$)")).withColumn("doc", F.last(F.when(header != "", header), ignorenulls=True).over(order)).where(header == "")
    p = "^\\s*([A-Za-z_]+)\\s*:\\s*(.*?)\\s*(?:\\|\\s*([0-9, ]+))?$"
    key, value, pages = (F.regexp_extract("text", p, i) for i in (1, 2, 3))
    rows = rows.withColumns({"field": F.lower(key), "raw": value, "pages": pages})
    orphan = F.col("doc").isNull() | (F.col("field") == "")
    good = rows.where(~orphan).withColumn("r", F.row_number().over(Window.partitionBy("doc", "field").orderBy(F.desc("n"))))
    absent = F.lower("raw").isin("", "-", "none", "not stated", "absent")
    truth = good.where("r = 1").select("doc", "field", F.when(~absent, F.col("raw")).alias("value"), F.transform(F.filter(F.split("pages", "\\s*,\\s*"), lambda x: x != ""), lambda x: F.trim(x).try_cast("int")).alias("pages"))
    report = rows.where(orphan).select("file", "n", F.lit("orphan").alias("problem")).unionByName(good.where("r > 1").select("file", "n", F.lit("repeated").alias("problem")))
    return truth, report


def read_answer_key(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("n", "text"))
    return parse_answer_key(text)


def union_keys(*keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, documents that more than one key names)."""
    out = keys[0].withColumn("key_no", F.lit(0))
    for i, k in enumerate(keys[1:], 1):
        out = out.unionByName(k.withColumn("key_no", F.lit(i)))
    return out, out.groupBy("doc").agg(F.count_distinct("key_no").alias("n_keys")).where("n_keys > 1")


def clean_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^computed:", ""), "[₹,\\s]|Rs\\.?", "").try_cast("decimal(18,4)")


def read_adjudication(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return df.withColumns({"computed": F.startswith("value", F.lit("computed:")), "number": clean_number(F.col("value"))})


def parse_terms(lines: DataFrame) -> DataFrame:
    """term, kind, pattern of lines (text): comments dropped, `keep:` terms kept; words join over any spaces, dots and commas."""
    t = F.trim("text")
    rows = lines.where(~t.rlike("^(?:#|$)")).withColumns({"kind": F.when(F.lower(t).startswith("keep:"), "keep").otherwise("deny"), "term": F.trim(F.regexp_replace(t, "(?i)^keep:", ""))})
    quoted = F.array_join(F.transform(F.split("term", "\\s+"), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "[\\s,.]+")
    return rows.select("term", "kind", F.concat(F.lit("(?i)"), quoted).alias("pattern"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """One entry a document, the last exported (doc, exported_at, hash)."""
    return old.unionByName(new).groupBy("doc").agg(F.max(F.struct("exported_at", "hash")).alias("m")).select("doc", "m.exported_at", "m.hash")


def audit_page_plan(plans: DataFrame) -> DataFrame:
    """doc, problems of plans (doc, total, pages, omitted): ascending and unique, in range, disjoint, adding up."""
    p, o = F.col("pages"), F.col("omitted")
    bad = F.array_compact(F.array(
        F.when(p != F.array_sort(F.array_distinct(p)), "order"), F.when(~F.forall(p, lambda x: (x >= 1) & (x <= F.col("total"))), "range"),
        F.when(F.arrays_overlap(p, o), "overlap"), F.when(F.size(p) + F.size(o) != F.col("total"), "sum"),
    ))
    return plans.select("doc", F.array_join(bad, ",").alias("problems")).where("problems <> ''")


def record_size(df: DataFrame) -> Column:
    """Bytes of a row as JSON with nulls."""
    return F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))


def stored_size(df: DataFrame) -> Column:
    """Bytes of a row as a store counts them: names and texts in UTF-8, a number as long as it is written and one more, yes, no and null one byte."""

    def size(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            n = sum((F.octet_length(F.lit(f.name)) + size(c[f.name], f.dataType) + 1 for f in kind), F.lit(3))
        elif isinstance(kind, T.ArrayType):
            n = F.aggregate(c, F.lit(3), lambda t, x: t + size(x, kind.elementType) + 1)
        elif isinstance(kind, T.MapType):
            n = F.aggregate(F.map_entries(c), F.lit(3), lambda t, e: t + F.octet_length(e["key"].cast("string")) + size(e["value"], kind.valueType) + 1)
        elif isinstance(kind, T.BooleanType):
            n = F.lit(1)
        else:
            n = F.octet_length(c if isinstance(kind, T.BinaryType) else c.cast("string")) + (1 if isinstance(kind, T.NumericType) else 0)
        return F.when(c.isNotNull(), n).otherwise(1)

    return sum((F.lit(len(f.name.encode())) + size(F.col(f"`{f.name}`"), f.dataType) + 1 for f in df.schema), F.lit(3))


def kept_readings(readings: DataFrame, limit: int = MAX_READING, whole: int = MAX_RECORD) -> DataFrame:
    """readings (job, batch, text) with kept: a batch's text of at most limit characters, as long as the job's kept texts stay under whole bytes together.

    A job whose small texts exceed whole keeps none: its record would be refused. A null text is kept and weighs nothing.
    """
    small = F.coalesce(F.length("text") <= limit, F.lit(True))
    sums = readings.groupBy("job").agg(F.sum(F.when(small, F.coalesce(F.octet_length("text"), F.lit(0)))).alias("__all"))
    joined = readings.join(sums, readings["job"].eqNullSafe(sums["job"]), "left").drop(sums["job"])
    return joined.select(*readings.columns, (small & (F.coalesce("__all", F.lit(0)) <= whole)).alias("kept"))


def oversize(df: DataFrame, limit: int = MAX_RECORD) -> DataFrame:
    return df.withColumn("bytes", record_size(df)).where(F.col("bytes") > limit)


def validate_records(records: DataFrame, rules: list[dict], n_pages: str = "n_pages") -> DataFrame:
    """key, path, problem for each broken rule of a record; the text itself is never shown.

    records: key, a column `fields` map<string, struct<value: string, page: int>>, and the number of pages of its batch. rules: dicts of path, and as
    needed required, type (text, number or yes_no) and values. Blank values count as absent.
    """
    checks = []
    for r in rules:
        x = F.col("fields")[r["path"]]
        value = F.trim(x["value"])
        blank = F.coalesce(value == "", F.lit(True))
        wrong = {"number": ~value.rlike("^-?[0-9]+(?:[.][0-9]+)?$"), "yes_no": ~F.lower(value).isin("yes", "no")}.get(r.get("type", "text"), F.lit(False))
        problem = F.when(blank, "missing" if r.get("required") else None).when(wrong, "type").when(~value.isin(*r["values"]) if r.get("values") else F.lit(False), "value")
        page = F.when(~blank & (x["page"].isNull() | (x["page"] < 1) | (x["page"] > F.col(n_pages))), "page")
        checks += [F.when(p.isNotNull(), F.struct(F.lit(r["path"]).alias("path"), p.alias("problem"))) for p in (problem, page)]
    known = F.array(*[F.lit(r["path"]) for r in rules])
    unknown = F.transform(F.array_except(F.map_keys("fields"), known), lambda k: F.struct(k.alias("path"), F.lit("unknown").alias("problem")))
    return records.select("key", F.inline(F.concat(F.array_compact(F.array(*checks)), unknown)))


def form_corrections(forms: DataFrame, field_map: dict[str, str], most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(corrections key, path, value; refused key, field, reason) from typed forms: key and a map `typed` of form field to text."""
    named = F.create_map(*[F.lit(x) for pair in field_map.items() for x in pair])
    rows = forms.select("key", F.explode("typed").alias("field", "text")).withColumns({"path": F.element_at(named, F.col("field")), "value": F.trim(F.regexp_replace("text", "\\s+", " "))})
    reason = F.when(F.col("path").isNull(), "unknown_field").when(F.length("value") > most, "too_long")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null and value <> ''").select("key", "path", "value"), rows.where("reason is not null").select("key", "field", "reason")
