"""Sources and sinks: declared schemas, coalesced columns, transcripts, lexicons. Schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: StructType | str, lines_in_cells: bool = True, **options) -> DataFrame:
    """Quoted CSV with a header; blank cells are null. Where no cell holds a line end, say so: large files are then split."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=lines_in_cells, escape='"', **options)


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line, blank lines skipped; a malformed line fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def numbered_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As jsonl, with file and line: the line's number in its file from 1, blank lines counted.

    A file is read in one piece, since its lines can be counted in order only; that suits manifests, not large corpora.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("lines"))
    each = files.select("file", F.posexplode("lines").alias("at", "text")).where("trim(text) <> ''")
    parsed = each.select("file", (F.col("at") + 1).alias("line"), F.from_json("text", schema, {"mode": "FAILFAST"}).alias("o"))
    return parsed.select("o.*", "file", "line")


def write_jsonl(rows: DataFrame, path: str) -> int:
    """One object a line, keys in order; returns how many."""
    counted = Observation()
    rows.select(*sorted(rows.columns)).observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return counted.get["n"]


def write_union_csv(tables: list[DataFrame], path: str) -> None:
    """Tables of different columns under one header, the union of theirs in order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.select(*sorted(out.columns)).write.mode("overwrite").csv(path, header=True, escape='"')


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that there is, on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    return None


def group(spark: SparkSession, path: str, schemas: dict[str, StructType | str], lines_in_cells: bool = True) -> dict[str, DataFrame]:
    """The CSV files of a folder that there are, by name, each with its declared schema."""
    found = {name: f"{path}/{name}" for name in schemas if first_existing(spark, f"{path}/{name}")}
    return {name: csv(spark, at, schemas[name], lines_in_cells) for name, at in found.items()}


def phone_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(phone, kind) of lines "PHONE kind", stress digits stripped; comments skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' and not value rlike '^(;;;|#)'")
    return lines.select(F.regexp_replace(F.get(parts, F.lit(0)), "[0-9]$", "").alias("phone"), F.get(parts, F.lit(1)).alias("kind")).distinct()


def predictions(spark: SparkSession, path: str, row_schema: str, field: str = "predictions") -> DataFrame:
    """Rows of an array of objects in JSON documents, with the file that held them."""
    whole = spark.read.json(path, schema=f"`{field}` array<{row_schema}>", multiLine=True).select(F.col("_metadata.file_name").alias("file"), field)
    return whole.select("file", F.explode(field).alias("r")).select("r.*", "file")


def parsed_index(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """A unified table's metadata as a map again; what is no object is kept whole under ``raw``, null and blank are an empty map."""
    text = F.trim(F.coalesce(column, F.lit("")))
    none = F.create_map().cast("map<string,string>")
    # An object that is cut off still parses in part, so it has to end as one.
    whole = F.when(text.startswith("{") & text.endswith("}"), F.from_json(text, "map<string,string>"))
    return rows.withColumn(column, F.when(text == "", none).otherwise(F.coalesce(whole, F.create_map(F.lit("raw"), text))))


def cleaned(rows: DataFrame) -> DataFrame:
    """Every column as text, null and NaN as the empty text; lists and structs as they print in JSON."""

    def clean(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        text = F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return rows.select(*[clean(n, k) for n, k in rows.dtypes])


def parquet_counts(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(file, rows) of the files that match; no column is read, only what the footers tell. Files without a row are left out."""
    found = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(path)
    return found.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The columns asked for that exist, with a header."""
    rows.select(*[c for c in columns or rows.columns if c in rows.columns]).write.mode("overwrite").csv(path, header=True, escape='"')


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True, escape='"')


def write_partitioned(rows: DataFrame, path: str, *by: str, form: str = "parquet") -> None:
    rows.write.mode("overwrite").partitionBy(*by).format(form).save(path)


def first_filled(rows: DataFrame, *names: str) -> Column:
    """The first of the named columns, of those that exist, that isn't blank."""
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def unified(tables: list[DataFrame], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Tables of different columns as one: each target from the first filled of its sources, whole rows kept as JSON."""
    parts = [t.select(*[first_filled(t, *names).alias(c) for c, names in columns.items()], F.to_json(F.struct(*t.columns)).alias("metadata")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transcripts(spark: SparkSession, path: str, glob: str = "*.trans.txt") -> DataFrame:
    """(id, text, file) of lines "id text"."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    at = lambda k: F.regexp_extract("value", r"^(\S+)\s+(.*)$", k)
    return lines.where("trim(value) <> ''").select(at(1).alias("id"), at(2).alias("text"), F.col("_metadata.file_name").alias("file"))


def headerless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines split at commas into the named columns; the last holds the rest of the line, commas included."""
    parts = F.split("value", ",", len(names))
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, variant, phones) of lines "WORD PH1 PH2": comments skipped, "(2)" a variant, stress digits stripped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not value rlike '^(;;;|#)'")
    parts = F.split(F.trim("value"), r"\s+")
    head = F.lower(F.get(parts, F.lit(0)))
    phones = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.regexp_replace(p, "[0-9]$", ""))
    variant = F.coalesce(F.regexp_extract(head, r"\(([0-9]+)\)$", 1).try_cast("int"), F.lit(1))
    return lines.select(F.regexp_replace(head, r"\([0-9]+\)$", "").alias("word"), variant.alias("variant"), phones.alias("phones"))


def objects(spark: SparkSession, path: str, value_schema: str, key: str = "id") -> DataFrame:
    """Rows of a JSON object of objects: its keys, and the fields of its values."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value_schema}>").alias("m"))
    return whole.select(F.explode("m").alias(key, "v")).select(key, "v.*")


#: The fields of an utterance's scores, as ``objects`` reads them.
UTTERANCE = "struct<text:string, speaker:string, age:string, gender:string, total:double, words:array<struct<text:string, total:double, phones:array<string>, `phones-accuracy`:array<double>, mispronunciations:array<string>>>>"


def scored_utterances(rows: DataFrame, audio: DataFrame, details: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Utterances read by ``objects`` under UTTERANCE, with mean scores, labels as JSON and what they lack.

    Adds word_score and phoneme_score (means to three digits of what is a number, null without any), word_labels and
    phoneme_labels, row_status (missing_audio, missing_transcript, missing_scores joined by bars, or ok), audio_path and
    notes. audio: stem, path; the first path of a stem counts. details: the side file's keys, if there is one.
    """
    mean = lambda values: F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), 3))
    words = F.coalesce("words", F.array().cast(rows.schema["words"].dataType))
    totals = F.array_compact(F.transform(words, lambda w: w["total"]))
    phones = F.array_compact(F.flatten(F.transform(words, lambda w: F.coalesce(w["phones-accuracy"], F.array().cast("array<double>")))))
    labels = F.transform(words, lambda w: F.struct(w["text"].alias("word"), w["phones"].alias("phones"), w["phones-accuracy"].alias("phones_accuracy"), F.coalesce(w["mispronunciations"], F.array().cast("array<string>")).alias("mispronunciations")))
    paths = audio.groupBy(F.col("stem").alias("__stem")).agg(F.min("path").alias("audio_path"))
    met = rows.join(paths, F.col(key) == F.col("__stem"), "left").drop("__stem")
    if details is not None:
        side = details.select(F.col(key).alias("__side")).distinct()
        met = met.join(side, F.col(key) == F.col("__side"), "left").withColumn("notes", F.when(F.col("__side").isNotNull(), "score_detail_available").otherwise("")).drop("__side")
    else:
        met = met.withColumn("notes", F.lit(""))
    lacks = [("missing_audio", F.col("audio_path").isNull()), ("missing_transcript", F.trim(F.coalesce("text", F.lit(""))) == ""), ("missing_scores", F.size(words) == 0)]
    status = F.array_join(F.array_compact(F.array(*[F.when(holds, name) for name, holds in lacks])), "|")
    return met.withColumns({
        "word_score": mean(totals), "phoneme_score": mean(phones), "word_labels": F.to_json(words), "phoneme_labels": F.to_json(labels), "row_status": F.coalesce(F.nullif(status, F.lit("")), F.lit("ok")),
    }).drop("words")


def listing(spark: SparkSession, path: str, *extensions: str) -> DataFrame:
    """(path, length, stem) of files by extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(kind.isin(*extensions)).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def by_stem(files: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """Files with the transcripts that bear their stem."""
    return files.join(texts, files["stem"] == texts[id_col])


def word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(word, path, valid) of a word corpus's table."""
    return csv(spark, path, "word string, path string, valid string")


def capped(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """At most n rows of each group by order: the operator's feature, not a limit on the input."""
    from lexmill.operators.lookup import ranked

    return ranked(rows, by, order, top=n).drop("place")
