"""Text formats: lines, CSV, ARFF (dense and sparse), libsvm and the header-line variant of it.

All readers are Spark scans of whole files. The one thing read by the driver is an ARFF header, whose size is that of the list
of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without their end; .gz files are unpacked."""
    return spark.read.text(path)


def delimited(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Chunks between delimiters, wherever lines end."""
    return spark.read.option("lineSep", delimiter).text(path)


def open_path(spark: SparkSession, url: str) -> DataFrame:
    """Lines of a local path or a URL that Hadoop's file systems know; other schemes are an error."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", url)
    if scheme and scheme[1].lower() in ("http", "https", "ftp"):
        raise ValueError(f"{scheme[1]} is not a file system")
    return lines(spark, url)


def csv(spark: SparkSession, path: str, header: bool = False, **dialect) -> DataFrame:
    """Cells as text; without a header columns are numbered. White space around lines goes, blank lines are left out."""
    options = {"header": header, "inferSchema": False, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "FAILFAST"} | dialect
    out = spark.read.options(**options).csv(path)
    return out if header else out.toDF(*[str(i) for i in range(len(out.columns))])


def libsvm(rows: DataFrame, column: str = "value") -> DataFrame:
    """(features: map of index to value, labels) of lines 'l1,l2 k:v k:v'; lines without a label are left out."""
    words = F.split(F.trim(column), r"\s+")
    keep = rows.filter((F.trim(column) != "") & ~F.contains(words[0], F.lit(":")))
    pairs = F.transform(F.slice(words, 2, F.size(words)), lambda w: F.struct(F.split(w, ":")[0].cast("int").alias("k"), F.split(w, ":")[1].cast("double").alias("v")))
    return keep.select(F.map_from_entries(pairs).alias("features"), F.split(words[0], ",").alias("labels"))


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    return libsvm(lines(spark, path))


def read_manik(spark: SparkSession, path: str) -> DataFrame:
    """libsvm lines after each file's first line, which the header option of the reader skips."""
    rows = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").schema("value string").csv(path)
    return libsvm(rows)


# ---- ARFF


class ArffHeader:
    """Names, kinds (numeric, string or nominal) and levels of an ARFF file's attributes."""

    def __init__(self, attributes: list[str], sparse: bool = False) -> None:
        self.names: list[str] = []
        self.kinds: list[str] = []
        self.levels: list[list[str] | None] = []
        for line in attributes:
            m = re.match(r"""\s*@attribute\s+('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|\S+)\s+(.*?)\s*$""", line, re.I)
            if not m:
                raise ValueError(f"not an attribute: {line}")
            name = _unquote(m[1])
            if name in self.names:
                raise ValueError(f"two attributes have the name {name}")
            self.names.append(name)
            kind = m[2].lower()
            if kind.startswith("{"):
                values = [_unquote(v.strip()) for v in re.findall(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^,{}]+""", m[2].strip()[1:-1]) if v.strip()]
                self.kinds.append("nominal")
                self.levels.append(["0", *values] if sparse and "0" not in values else values)
            else:
                self.kinds.append("numeric" if kind.split()[0] in ("numeric", "integer", "real") else "string")
                self.levels.append(None)

    def schema(self) -> T.StructType:
        """Nominal columns carry their levels as metadata."""
        return T.StructType([T.StructField(n, T.StringType(), True, {"levels": lv} if lv else {}) for n, lv in zip(self.names, self.levels)])


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s[1:-1]) if s[:1] in "'\"" and s[-1:] == s[:1] else s


def arff_header(rows: DataFrame, sparse: bool = False, column: str = "value") -> ArffHeader:
    """The @attribute lines, in file order; there are as many as columns."""
    found = rows.filter(F.lower(F.ltrim(column)).startswith("@attribute")).select(F.monotonically_increasing_id().alias("i"), column)
    return ArffHeader([r[1] for r in found.orderBy("i").collect()], sparse)


def _data(rows: DataFrame, column: str) -> DataFrame:
    """Data lines: not blank, no comment, no declaration."""
    text = F.trim(column)
    return rows.filter((text != "") & ~text.startswith("%") & ~text.rlike(r"(?i)^@(relation|attribute|data)\b")).select(text.alias(column))


def arff_dense(rows: DataFrame, header: ArffHeader, column: str = "value", sep: str = ",") -> DataFrame:
    """One column an attribute and `missing`, set where any cell is '?' (which is null). Numeric cells are doubles. Cells may be
    quoted by ' or ", with \\ before a quote; a line of another width is an error."""
    cell = rf"""\s*('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^{re.escape(sep)}]*?)\s*(?:{re.escape(sep)}|$)"""
    found = F.regexp_extract_all(F.concat(F.col(column)), F.lit(cell), F.lit(1))
    n = len(header.names)
    # after a last cell that is not empty the pattern finds one more at the line's end
    text = _data(rows, column).withColumn("__cells", found)
    width = F.size("__cells") - F.when(F.endswith(F.col(column), F.lit(sep)), 0).otherwise(1)
    ok = F.when(width == n, F.col("__cells")).otherwise(F.raise_error(F.concat(F.lit(f"a line has not {n} cells: "), F.col(column))))
    clean = F.transform(ok, lambda c: F.when(c == "?", None).when(c.rlike(r"""^(['"]).*\1$"""), F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r"\\(.)", "$1")).otherwise(c))
    cells = text.withColumn("__cells", clean)
    typed = [F.get("__cells", F.lit(i)).cast("double").alias(x) if k == "numeric" else F.get("__cells", F.lit(i)).alias(x, metadata={"levels": lv} if lv else {}) for i, (x, k, lv) in enumerate(zip(header.names, header.kinds, header.levels))]
    return cells.select(*typed, F.exists(F.slice("__cells", 1, n), lambda c: c.isNull()).alias("missing"))


def arff_sparse(rows: DataFrame, header: ArffHeader, column: str = "value") -> DataFrame:
    """(row: map of attribute name to text) of lines '{i v, i v}'; an index beyond the attributes is an error. Nominal attributes
    whose first level is not '0' are always present, with '0'."""
    inside = F.trim(F.regexp_extract(column, r"^\{(.*)\}$", 1))
    cells = F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r"\s*,\s*"))
    names = F.array(*[F.lit(n) for n in header.names])

    def entry(c: Column) -> Column:
        i = F.regexp_extract(c, r"^(\d+)\s", 1).cast("int")
        name = F.when(i < len(header.names), F.get(names, i)).otherwise(F.raise_error(F.concat(F.lit("no attribute has the index of "), c)))
        return F.struct(name.alias("key"), F.regexp_replace(F.regexp_extract(c, r"^\d+\s+(.*)$", 1), r"""^['"]|['"]$""", "").alias("value"))

    made = F.map_from_entries(F.transform(cells, entry))
    always = [n for n, lv in zip(header.names, header.levels) if lv and lv[0] != "0"]
    if always:
        base = F.create_map(*[F.lit(x) for n in always for x in (n, "0")])
        made = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(made, k)), made)
    return _data(rows, column).select(made.alias("row"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Dense or sparse by the first data line."""
    rows = lines(spark, path)
    first = _data(rows, "value").first()
    sparse = first is not None and first[0].startswith("{")
    header = arff_header(rows, sparse)
    sep = "\t" if first is not None and not sparse and "\t" in first[0] and "," not in first[0] else ","
    return arff_sparse(rows, header) if sparse else arff_dense(rows, header, sep=sep)


def write_arff(df: DataFrame, path: str, relation: str, levels: dict[str, list[str]] = {}) -> None:
    """df as text parts, the header in a part of its own that sorts first."""
    kinds = {"double": "numeric", "float": "numeric", "int": "numeric", "bigint": "numeric"}
    head = [f"@relation {relation}", *[f"@attribute '{c}' " + ("{" + ",".join(levels[c]) + "}" if c in levels else kinds.get(t, "string")) for c, t in df.dtypes], "@data"]
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/part=0")
    cells = [F.coalesce(F.col(c).cast("string") if t in kinds or c in levels else F.concat(F.lit("'"), F.regexp_replace(c, r"(['\\])", r"\\$1"), F.lit("'")), F.lit("?")) for c, t in df.dtypes]
    df.select(F.concat_ws(",", *cells).alias("value")).write.text(f"{path}/part=1")
