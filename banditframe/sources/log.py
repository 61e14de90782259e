"""The result log: JSON lines of a version, the parameters of environments, learners and evaluators, and packed interactions.

A triple of many rows has several packed lines; each says where it begins and how many rows the triple has. A triple that is logged
again replaces what an earlier line says: of its lines, those of as many rows as the latest one has count, the latest of each
beginning. Lines are in the order of their files' times, and in the order of a file."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditframe.functions.encoders import minimize
from banditframe.operators.results import ENV, INDEX, LRN, TRIPLE, VAL, Result
from banditframe.plans.prefix import numbered
from banditframe.plans.tables import cut

VERSION = 4
#: Rows of a packed line at most.
ROWS = 1 << 16


def _line_no(rows: DataFrame) -> DataFrame:
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def packed_types(ints: DataFrame) -> str:
    """The packed columns of all lines (p: their JSON text) and their types, as DDL: what numbers, texts or lists they hold; a column
    of several kinds is of variants."""
    found = ints.agg(F.schema_of_variant_agg(F.parse_json("p"))).first()[0]
    if found in (None, "VOID", "OBJECT<>"):
        return ""
    ddl = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", found.removeprefix("OBJECT<").removesuffix(">"))
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", ddl).replace("VOID", "STRING")
    return re.sub(r"(^|, )reward: ARRAY<BIGINT>", r"\1reward: ARRAY<DOUBLE>", ddl)


def decode(rows: DataFrame, columns: str | None = None) -> Result:
    """rows (value, line_no) -> the four tables. Parameters are maps of text; a later line of an id updates an earlier one key by
    key. columns gives the packed columns and their types; if it doesn't, they are found in a pass over the lines. Logs of
    another version are an error."""
    parsed = rows.withColumn("kind", F.get_json_object("value", "$[0]"))
    versions = [r[0] for r in parsed.filter("kind = 'version'").select(F.get_json_object("value", "$[1]")).distinct().collect()]
    if any(v != str(VERSION) for v in versions):
        raise ValueError(f"logs of version {versions} can't be read, only {VERSION}")

    def dim(kind: str, id_: str) -> DataFrame:
        own = parsed.filter(F.col("kind") == kind).select(F.get_json_object("value", "$[1]").cast("int").alias(id_), "line_no", F.from_json(F.get_json_object("value", "$[2]"), "map<string,string>").alias("p"))
        last = own.select(id_, "line_no", F.explode("p").alias("k", "v")).groupBy(id_, "k").agg(F.max_by("v", "line_no").alias("v"))
        ids = own.select(id_).distinct()
        return ids.join(last.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("params")), id_, "left").withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>")))

    ints = parsed.filter("kind = 'I'").select("line_no", F.from_json(F.get_json_object("value", "$[1]"), "array<int>").alias("ids"), F.get_json_object("value", "$[2]._packed").alias("p"), *[F.get_json_object("value", f"$[2]._{c}").cast("long").alias(f"__{c}") for c in ("from", "of")])
    ints = cut(ints.select(F.get("ids", F.lit(0)).alias(ENV), F.get("ids", F.lit(1)).alias(LRN), F.coalesce(F.get("ids", F.lit(2)), F.lit(0)).alias(VAL), "line_no", F.coalesce("__from", F.lit(0)).alias("__from"), F.coalesce("__of", F.lit(-1)).alias("__of"), "p"))
    last = ints.groupBy(*TRIPLE).agg(F.max_by("__of", "line_no").alias("__now"))
    lines = ints.drop("p").join(last, TRIPLE).filter("__of = __now").groupBy(*TRIPLE, "__from").agg(F.max("line_no").alias("line_no"))
    ints = ints.drop("__of").join(lines, [*TRIPLE, "__from", "line_no"], "left_semi")
    types = packed_types(ints) if columns is None else columns
    schema = T.StructType.fromDDL(types) if types else T.StructType([])
    names = schema.names
    if not names:
        return Result(dim("E", ENV), dim("L", LRN), dim("V", VAL), ints.limit(0).select(*TRIPLE, F.lit(1).cast("long").alias(INDEX)))
    # a column that a triple has not is empty there
    cells = [F.coalesce(F.col("j")[n], F.array().cast(schema[n].dataType)).alias(n) for n in names]
    flat = ints.withColumn("j", F.from_json("p", schema)).select(*TRIPLE, "__from", F.posexplode(F.arrays_zip(*cells)).alias("pos", "r"))
    facts = flat.select(*TRIPLE, (F.col("__from") + F.col("pos") + 1).cast("long").alias(INDEX), *[F.col("r")[n].alias(n) for n in names])
    return Result(dim("E", ENV), dim("L", LRN), dim("V", VAL), facts)


def read(spark: SparkSession, path: str, columns: str | None = None) -> Result:
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")).alias("line_no"))
    return decode(lines, columns)


def encode(result: Result, restored: bool = False, rows: int = ROWS) -> DataFrame:
    """(value): log lines. A triple's rows are packed by column, numbers at 5 decimals, at most `rows` of them in a line; the version
    line is left out of a log that goes on."""
    spark = result.interactions.sparkSession
    head = spark.createDataFrame([(json.dumps(["version", VERSION]),)] if not restored else [], "value string")

    def dim(df: DataFrame, id_: str, kind: str) -> DataFrame:
        params = F.to_json(F.col("params") if "params" in df.columns else F.struct(*[c for c in df.columns if c != id_]))
        return df.select(F.concat(F.lit(f'["{kind}",'), F.col(id_).cast("string"), F.lit(","), params, F.lit("]")).alias("value"))

    facts = result.interactions
    names = [c for c in facts.columns if c not in (*TRIPLE, INDEX)]
    types = dict(facts.dtypes)
    small = facts.select(*TRIPLE, INDEX, *[minimize(F.col(n), types[n]).alias(n) for n in names])
    placed = numbered(small, TRIPLE, INDEX, "__at").withColumn("__chunk", F.floor(F.col("__at") / rows))
    packed = placed.groupBy(*TRIPLE, "__chunk").agg(F.sort_array(F.collect_list(F.struct("__at", *names))).alias("r"))
    sizes = small.groupBy(*TRIPLE).agg(F.count("*").alias("__of"))
    packed = packed.join(sizes, TRIPLE).select(*TRIPLE, "__chunk", "__of", F.to_json(F.struct(*[F.col("r")[n].alias(n) for n in names])).alias("p"))
    where = F.when(F.col("__of") > rows, F.concat(F.lit(',"_from":'), (F.col("__chunk") * rows).cast("string"), F.lit(',"_of":'), F.col("__of").cast("string"))).otherwise("")
    ints = packed.select(F.concat(F.lit('["I",['), F.concat_ws(",", *[F.col(c).cast("string") for c in TRIPLE]), F.lit('],{"_packed":'), F.col("p"), where, F.lit("}]")).alias("value"))
    return head.union(dim(result.environments, ENV, "E")).union(dim(result.learners, LRN, "L")).union(dim(result.evaluators, VAL, "V")).union(ints)


def write(result: Result, path: str, restored: bool = False, gzip: bool = False, rows: int = ROWS) -> None:
    encode(result, restored, rows).write.mode("append").option("compression", "gzip" if gzip else "none").text(path)
