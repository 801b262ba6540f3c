"""Readers and writers.  Everything goes through Spark's file sources, so any store that Spark reads will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, stored, there
from . import schemas

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str | None:
    """Paragraphs, then table cells, non-empty ones joined by a blank line; None for a file that is no docx."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    if body is None:
        return ""
    said = lambda p: "".join(t.text or "" if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "" for t in p.iter())
    paragraphs = [said(p) for p in body.findall(f"{_W}p")]
    cells = ["\n".join(said(p) for p in cell.iter(f"{_W}p")) for cell in body.iter(f"{_W}tc")]
    return "\n\n".join(x.strip() for x in [*paragraphs, *cells] if x.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every .docx under path; unreadable files have null text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [docx_text(b) for b in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def write_texts(df: DataFrame, path: str, text: str = "text", order: str = "path") -> None:
    """All texts, each followed by a blank line."""
    df.where(F.col(text).isNotNull()).orderBy(order).select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_json_array(spark: SparkSession, path: str, schema: str = schemas.ARTICLE) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, limit: int | None = None) -> DataFrame:
    """One record a line; malformed lines are dropped, or fatal if strict."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.limit(limit) if limit is not None else df


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All .json (arrays) and .jsonl files of a folder with the file's stem as ``dataset``."""
    reader = spark.read.schema(schema)
    arrays = reader.option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl?$", 1)
    return arrays.withColumn("dataset", stem).unionByName(lines.withColumn("dataset", stem))


def read_gold_tree(spark: SparkSession, root: str) -> DataFrame:
    """(id, text, codes) of every dnaf.json below root; the id is the folder's name."""
    df = spark.read.schema(schemas.GOLD_TREE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "dnaf.json").json(root)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.where("doc is not null").select(folder.alias("id"), F.col("doc.token_string").alias("text"), F.col("doc.annotations.iptc_codes.certain").alias("codes"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


#: Tags of the frequency list and their parts of speech.
TAGS = {
    "LID": "DET", "VZ": "ADP", "LET": "PUNCT", "VG": "CCONJ", "WW": "VERB", "VNW": "PRON", "BW": "ADV", "N": "NOUN",
    "ADJ": "ADJ", "TW": "NUM", "SPEC": "X", "TSW": "INTJ",
}


def frequency_list(df: DataFrame, first: str = "_c0", second: str = "_c1") -> DataFrame:
    """Lexicon rows of 'word TAG(...)' and a count; rows that are not so go."""
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    parts = F.split(F.trim(F.col(first)), r"\s+")
    word, tag = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    upos = F.coalesce(F.try_element_at(tags, F.split(tag, r"\(")[0]), F.lit("X"))
    count = F.trim(F.col(second)).try_cast("bigint")
    return df.where(tag.isNotNull() & count.isNotNull()).select(word.alias("text"), word.alias("lemma"), upos.alias("upos"), tag.alias("xpos"), count.alias("frequency"))


def read_frequency_list(spark: SparkSession, path: str) -> DataFrame:
    return frequency_list(spark.read.option("sep", "\t").option("quote", "").csv(path))


#: Any bytes are valid in the second, so no third is ever reached (and Spark knows no cp1252).
ENCODINGS = ("UTF-8", "ISO-8859-1")
SEPARATORS = ("\t", ",", ";")


def read_delimited(spark: SparkSession, path: str, minimum: int = 100) -> DataFrame:
    """A delimited table of unknown encoding and separator, all columns strings.

    First strategy, for each encoding: lines are cut at the separator that the header holds (tab before comma before
    semicolon), cells lose their quotes, longer rows are cut and shorter ones dropped.  Second, for each encoding and
    separator: Spark's reader without quoting, at least two columns.  Whatever first gives ``minimum`` rows is taken;
    nothing is an error.
    """
    for encoding in ENCODINGS:
        lines = spark.read.option("encoding", encoding).option("quote", "").schema("value string").csv(path, sep="\x01")
        head = lines.limit(1).collect()
        line = head[0].value if head else None
        if not line or "\ufffd" in line:
            continue
        sep = next((s for s in SEPARATORS if s in line), "\t")
        bare = lambda x: F.regexp_replace(F.trim(x), r"^[\"']+|[\"']+$", "")
        names = [n.strip().strip("\"'").lstrip("\ufeff") for n in line.split(sep)]
        cells = F.transform(F.split("value", f"\\Q{sep}\\E"), bare)
        rows = lines.where((F.col("value") != line) & (F.trim("value") != "")).select(cells.alias("c")).where(F.size("c") >= len(names))
        full = rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])
        if len(full.take(minimum)) >= minimum:
            return full
    for encoding in ENCODINGS:
        for sep in SEPARATORS:
            table = spark.read.option("encoding", encoding).option("sep", sep).option("header", True).option("quote", "").option("mode", "DROPMALFORMED").csv(path)
            if len(table.columns) >= 2 and len(table.take(minimum)) >= minimum:
                return table
    raise ValueError(f"{path}: no encoding and separator gives {minimum} rows")


def read_detector(spark: SparkSession, path: str) -> DataFrame:
    """Detector results with the mean score of their windows; failed records have an error and no fractions."""
    from ..operators.ai_use import assistance_score

    return read_jsonl(spark, path, schemas.DETECTOR).withColumn("mean_ai_assistance_score", assistance_score("windows"))


def read_outlets(spark: SparkSession, files: dict[str, str], types: dict[str, str]) -> DataFrame:
    """One CSV per outlet as one table with outlet and type; missing files are skipped, none at all is an error."""
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    parts = [
        read_csv(spark, p).withColumns({"outlet": F.lit(k), "outlet_type": F.lit(types.get(k))})
        for k, p in files.items()
        if fs(p).getFileSystem(conf).exists(fs(p))
    ]
    if not parts:
        raise FileNotFoundError("no input file")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_per_value(df: DataFrame, path: str, column: str) -> None:
    """The whole table and one folder per distinct value."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/all")
    df.write.mode("overwrite").option("header", True).partitionBy(column).csv(f"{path}/by_{column}")


def write_scopes(df: DataFrame, path: str, scope: str = "scope", category: str = "category") -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(scope, category).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def compact(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """An append log as one clean JSON table."""
    write_jsonl(read_jsonl(spark, source, schema), target)


def parse_label_list(x: Column | str) -> Column:
    """A list literal in a CSV field as an array; null where it is none."""
    x = F.col(x) if isinstance(x, str) else x
    return F.from_json(F.replace(x, F.lit("'"), F.lit('"')), "array<string>")


def append_new(df: DataFrame, path: str, on: list[str]) -> int:
    """Append rows whose keys the sink lacks (resume by anti join); returns how many were new.  df is computed once."""
    spark = df.sparkSession
    if there(spark, path):
        df = df.join(spark.read.parquet(path).select(*on).distinct(), on, "left_anti")
    new = stored(spark, df, "new")
    new.write.mode("append").parquet(path)
    n = new.count()
    discard(new)
    return n
