"""Files: transcripts, glossaries, backgrounds, templates, and sinks."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.glossary import Term
from ..operators.prompts import DEFAULT_BACKGROUND
from ..operators.rendering import Template, TemplateSection
from ..schemas import BACKGROUNDS

try:  # YAML is optional; JSON is a subset of it and always works.
    import yaml
except ImportError:  # pragma: no cover
    yaml = None


# Folders that transcripts of one writing are dealt to.
PARTS = 128
# Paths, and bytes of files, that leave a task together.
PATHS = 1 << 12
BYTES = 1 << 23
# Levels of folders that are dealt to tasks anew before the rest is walked.
LEVELS = 2


def _without_store(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)


def transcript_files(spark: SparkSession, root: str, endings: Sequence[str] = ("txt", "md")) -> DataFrame:
    """``meeting_id, source, bytes, text, problem``: one row per transcript file below a folder.

    Of a folder on a store of the file system (``file:``) tasks list and read the files,
    and the driver holds none of their names. On other stores Spark lists the folder on
    the driver and packs small files into splits by their sizes. A
    ``meeting_id`` is the path below ``root`` without the ending, so that files of the
    same name in different folders stay apart. A file that is no UTF-8 has no text and a
    ``problem``; a mark of the byte order at its start is left out. A file of no bytes
    gives no row.
    """
    wanted = F.lower("path").rlike(f"\\.({'|'.join(endings)})$")
    place = re.sub("/+", "/", _without_store(root))
    if root.startswith("file:") and os.path.isabs(place) and os.path.isdir(place):
        read = _files_below(spark, place, wanted)
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(wanted)
    fine = F.is_valid_utf8("content")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    # The folder may be named without its store; paths have it.
    folder = place.rstrip("/") + "/"
    below = F.substr(F.col("path"), F.locate(folder, F.col("path")) + len(folder))
    return read.select(F.regexp_replace(below, "\\.[^./]*$", "").alias("meeting_id"), F.col("path").alias("source"),
                       F.col("length").alias("bytes"), F.when(fine, text).alias("text"), F.when(~fine, "not UTF-8").alias("problem"))


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    if name.startswith(".") or name.endswith("._COPYING_"):
        return True
    return name.startswith("_") and "=" not in name and not (folder and name.startswith(("_metadata", "_common_metadata")))


def _walk(path: bytes, deep: bool) -> Iterator[tuple[bytes, int | None]]:
    """Files of a folder with their lengths, and its folders with none; or all files below it."""
    with os.scandir(path) as entries:
        for e in entries:
            try:
                folder = e.is_dir()
                if _hidden(os.fsdecode(e.name), folder):
                    continue
                if folder and deep:
                    yield from _walk(e.path, True)
                elif folder:
                    yield e.path, None
                elif size := e.stat().st_size:
                    yield e.path, size
            except FileNotFoundError:  # a link to nothing, or gone meanwhile
                continue


def _content(path: bytes) -> bytes:
    """A file, compared with the sums of its pieces where Hadoop has written them beside it."""
    with open(path, "rb") as f:
        content = f.read()
    folder, name = os.path.split(path)
    try:
        with open(os.path.join(folder, b"." + name + b".crc"), "rb") as f:
            sums = f.read()
    except FileNotFoundError:
        return content
    size, sums = int.from_bytes(sums[4:8], "big"), sums[8:]
    for i in range(0, len(sums), 4):
        if zlib.crc32(content[i // 4 * size:(i // 4 + 1) * size]) != int.from_bytes(sums[i:i + 4], "big"):
            raise OSError(f"checksum of {os.fsdecode(path)}")
    return content


def _files_below(spark: SparkSession, place: str, wanted: Column) -> DataFrame:
    """``path, length, content`` as Spark's reader of whole files has them. Tasks list the folders, one level after the other, and read the files."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for b in batches for path, size in zip(b["name"].to_pylist(), b["length"].to_pylist(), strict=True)
                    for row in ([(path, size)] if size is not None else _walk(path, deep)))
            while some := [*islice(rows, PATHS)]:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.binary()), pa.array([r[1] for r in some], pa.int64())], ["name", "length"])

        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, held = ([], [], []), 0
            for *row, name in zip(b["path"].to_pylist(), b["length"].to_pylist(), b["name"].to_pylist(), strict=True):
                for column, v in zip(columns, (*row, _content(name)), strict=True):
                    column.append(v)
                held += len(columns[2][-1])
                if held > BYTES:
                    yield pa.RecordBatch.from_pydict(dict(zip(("path", "length", "content"), columns, strict=True)), schema)
                    columns, held = ([], [], []), 0
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "length", "content"), columns, strict=True)), schema)

    schema = pa.schema({"path": pa.string(), "length": pa.int64(), "content": pa.binary()})
    rows = spark.range(0, 1, 1, 1).select(F.lit(os.fsencode(place)).alias("name"), F.lit(None).cast("long").alias("length"))
    for level in range(LEVELS + 1):
        rows = rows.mapInArrow(walk(level == LEVELS), "name binary, length long").repartition(parts, "name")
    named = rows.withColumn("path", F.concat(F.lit("file:"), F.decode("name", "UTF-8"))).where(wanted)
    return named.select("path", "length", "name").mapInArrow(read, "path string, length long, content binary")


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """``meeting_id, source, text`` of the readable files below a folder."""
    return transcript_files(spark, root).where("problem IS NULL").select("meeting_id", "source", "text")


def rejected_files(spark: SparkSession, root: str) -> DataFrame:
    """``meeting_id, source, bytes, problem`` of the files that ``read_transcripts`` leaves out; their contents are not returned."""
    return transcript_files(spark, root).where("problem IS NOT NULL").select("meeting_id", "source", "bytes", "problem")


def read_documents(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """What ``write_documents`` wrote: ``meeting_id, text``."""
    return spark.read.schema(f"meeting_id {key_type}, text string").json(path)


def _load(text: str):
    return yaml.safe_load(text) if yaml else json.loads(text)


def _document(path_or_data, what: str) -> dict:
    if isinstance(path_or_data, str):
        with open(path_or_data, encoding="utf-8") as f:
            path_or_data = _load(f.read())
    if not isinstance(path_or_data, dict):
        raise ValueError(f"invalid {what} format")
    return path_or_data


def _list(data: dict, name: str) -> list:
    value = data.get(name)
    value = [] if value is None else value
    if not isinstance(value, list):
        raise ValueError(f"'{name}' must be a list")
    return value


def load_glossary(path_or_data) -> list[Term]:
    """Terms of a glossary file or dict, validated."""
    terms = []
    for item in _list(_document(path_or_data, "glossary"), "terms"):
        if not isinstance(item, dict) or "term" not in item:
            raise ValueError(f"invalid term entry: {item}")
        terms.append(Term(item["term"], item.get("context") or "", tuple(item.get("corrections") or ()),
                          tuple(item.get("auto_variants") or ())))
    return terms


def glossary_from_output(text: str) -> list[Term] | None:
    """Glossary in model output, fenced or bare; None if there is none."""
    fenced = re.search(r"```(?:yaml)?\s*(.*?)```", text, re.S)
    for candidate in ([fenced.group(1)] if fenced else []) + [text]:
        try:
            return load_glossary(_load(candidate))
        except Exception:  # not parsable, or not a glossary
            continue
    return None


def dump_glossary(terms: Iterable[Term], industry: str = "") -> dict:
    """Serialisable form; empty fields are left out, variants are kept."""
    rows = []
    for t in terms:
        fields = {"context": t.context, "corrections": list(t.corrections), "auto_variants": list(t.auto_variants)}
        rows.append({"term": t.term, **{k: v for k, v in fields.items() if v}})
    return {"industry": industry, "terms": rows}


def load_background(path_or_data) -> dict:
    """Fields of a background file or dict; None gives the default background."""
    if path_or_data is None:
        return {**DEFAULT_BACKGROUND, "known_consensus": []}
    data = _document(path_or_data, "background")
    fields = {k: data.get(k) or "" for k in DEFAULT_BACKGROUND}
    return {**fields, "known_consensus": _list(data, "known_consensus")}


def background_table(spark: SparkSession, by_meeting: dict) -> DataFrame:
    names = ["company", "industry", "participants", "known_consensus", "meeting_purpose"]
    rows = [(m, *[b[n] for n in names]) for m, b in by_meeting.items()]
    return spark.createDataFrame(rows, BACKGROUNDS)


def load_template(path_or_data) -> Template:
    data = _document(path_or_data, "template")
    sections = []
    for item in _list(data, "sections"):
        if not isinstance(item, dict) or "title" not in item:
            raise ValueError(f"invalid section entry: {item}")
        sections.append(TemplateSection(item["title"], item.get("prompt") or ""))
    return Template(data.get("name") or "", data.get("description") or "", tuple(sections))


# ----------------------------------------------------------------------- sinks
def write_table(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet under ``root/name``: cleaned texts, hits, coverage."""
    path = os.path.join(root, name)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_documents(documents: DataFrame, root: str, suffix: str, mode: str = "overwrite") -> str:
    """Assembled documents as JSON lines of ``meeting_id`` and ``text``, as many files as there are partitions."""
    path = os.path.join(root, suffix)
    documents.select("meeting_id", "text").write.mode(mode).json(path)
    return path


def write_transcripts(documents: DataFrame, root: str, parts: int = PARTS) -> str:
    """Every transcript as a text file in a folder of its own, ``part=N/meeting_id=ID/part-*.txt`` below ``root``, a new folder.

    Texts of one ID share a file, and each ends with a newline. A task writes a part
    of the documents into the part's folder, so that Spark lists the parts side by side.
    On a store of the file system (``file:``) tasks put their files in place
    themselves: Spark's writer starts several processes a file there, and its driver
    moves file by file. On other stores Spark writes and the tasks move.
    """
    dealt = (documents.select("meeting_id", "text").repartition(parts, "meeting_id").sortWithinPartitions("meeting_id", "text")
             .withColumn("part", F.spark_partition_id()))
    if not root.startswith("file:"):
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("part", "meeting_id").text(root)
        return root
    place = _without_store(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b["folder"].to_pylist(), b["text"], strict=True))
        n = 0
        for n, (folder, texts) in enumerate(groupby(rows, lambda row: row[0]), 1):
            os.makedirs(f"{place}/{folder}", exist_ok=True)
            # Another attempt of the task may write the same file: it appears whole or not at all.
            unfinished = f"{place}/{folder}/.{uuid.uuid4().hex}"
            with open(unfinished, "wb") as f:
                for _, text in texts:
                    f.write((text.as_py() or b"") + b"\n")
            os.replace(unfinished, f"{place}/{folder}/part-0.txt")
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    os.makedirs(place, exist_ok=True)
    key = F.coalesce(F.url_encode(F.col("meeting_id").cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    dealt.select(F.concat(F.lit("part="), "part", F.lit("/meeting_id="), key).alias("folder"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root


def write_lines(lines: DataFrame, root: str, suffix: str, mode: str = "overwrite") -> str:
    """Laid out documents (``meeting_id, text_start, text``) as JSON lines: a document's lines follow each other, in one file or in several."""
    path = os.path.join(root, suffix)
    order = ["meeting_id", "text_start"]
    lines.select(*order, "text").repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).json(path)
    return path
